"""Engagement, credibility, sarcasm and the weighted score, all plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio

#: Weight of a source; anything else weighs 0.5.
SOURCE_WEIGHT = {"news": 1.0, "stocktwits": 0.7, "reddit": 0.5}
FLIP, MAYBE = 0.65, 0.40


def source_weight(source: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv])
    return F.coalesce(F.try_element_at(m, source), F.lit(0.5))


def engagement(source: Column, upvotes: Column, upvote_ratio: Column) -> Column:
    s = source
    return (
        F.when(s == "reddit", F.coalesce(upvote_ratio, ratio(upvotes, upvotes + 1)))
        .when(s == "stocktwits", F.when(upvotes.isNull(), 0.5).otherwise(F.least(upvotes / 50.0, F.lit(1.0))))
        .when(s == "news", F.lit(1.0))
        .otherwise(F.lit(0.5))
    )


def credibility(eng: Column, weight: Column, uncertain: Column) -> Column:
    """Their mean, halved while sarcasm is unclear, within [0.1, 1]."""
    x = (eng + weight) / 2
    return clip(F.when(F.coalesce(uncertain, F.lit(False)), x * 0.5).otherwise(x), 0.1, 1.0)


def sarcasm_flag(score: Column) -> Column:
    return F.when(score > FLIP, "flip").when(score >= MAYBE, "uncertain").otherwise("normal")


def flip_numeric(num: Column, flag: Column) -> Column:
    return F.when(flag == "flip", -num).otherwise(num)


def flip_label(label: Column, flag: Column) -> Column:
    other = F.when(label == "positive", "negative").when(label == "negative", "positive").otherwise(label)
    return F.when(flag == "flip", other).otherwise(label)


def low_confidence(cred: Column, conf: Column, least: float = 0.70, weight: float = 0.30) -> Column:
    return F.when(conf < least, cred * weight).otherwise(cred)


def weighted(num: Column, conf: Column, cred: Column, uncertain: Column, weight: float = 0.30) -> Column:
    return num * conf * cred * F.when(uncertain, weight).otherwise(1.0)
