"""Pluggable sentiment scoring. A scorer turns texts into label, number, confidence and class scores.

``lexicon`` is a native, deterministic default. ``model_scorer`` runs any Python model in an iterator of Arrow batches, loaded once
for each worker; only rows that need it are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_handles

#: Confidence under which a label is uncertain, and the weight of such a row.
UNCERTAIN, UNCERTAIN_WEIGHT = 0.70, 0.30
POSITIVE = ("good", "great", "gain", "gains", "up", "bull", "bullish", "buy", "beat", "strong", "profit", "win")
NEGATIVE = ("bad", "loss", "down", "bear", "bearish", "sell", "miss", "weak", "fraud", "trash", "idiot", "disgusting")
LABELS = ("negative", "neutral", "positive")


def numeric(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return F.when(low.isin("positive", "bullish"), 1).when(low.isin("negative", "bearish"), -1).when(low.isin("neutral"), 0)


def lexicon(text: Column) -> dict[str, Column]:
    """Counts of words of either list; the label is the sign, the confidence the margin among the hits."""
    w = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " ")), " ")
    hit = lambda ws: F.size(F.filter(w, lambda x: x.isin(*ws)))
    p, n = hit(POSITIVE), hit(NEGATIVE)
    total = p + n
    num = F.signum((p - n).cast("double")).cast("int")
    conf = F.when(total == 0, F.lit(0.5)).otherwise(0.5 + 0.5 * F.abs(p - n) / total)
    label = F.when(num > 0, "positive").when(num < 0, "negative").otherwise("neutral")
    return {"sentiment_label": label, "sentiment_numeric": num, "sentiment_confidence": conf, "is_uncertain": conf < UNCERTAIN}


#: Marks of irony and how far each speaks for it.
IRONY = ((0.9, "(^|\\s)/s\\s*$"), (0.8, "#(sarcasm|irony)\\b"), (0.7, "\\byeah,? right\\b|\\bwhat could go wrong\\b"), (0.5, "\\b(oh|just) (great|wonderful|perfect)\\b|\\bthanks a lot\\b|\\bgood luck with that\\b|\\bsure thing\\b"))


def irony(text: Column) -> Column:
    """The strongest mark of irony in a text, 0 without any: a native stand-in for a trained classifier."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0.0)
    for value, pattern in reversed(IRONY):
        out = F.when(low.rlike(pattern), value).otherwise(out)
    return out


def probability_scorer(load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 96):
    """An Arrow function text -> probability around a model that ``load`` returns; rows with a null text are not sent to it."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out = pd.Series([None] * len(s), dtype="float64")
            at = [i for i, x in enumerate(s) if x is not None]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                out.iloc[part] = model([s.iloc[i] for i in part])
            yield out

    return score


def sarcasm(text: Column, source: Column, scorer=irony, live: Column | None = None, most: Column | None = None) -> Column:
    """The score of prepared texts (handles, hash marks and addresses gone) of rows in scope, 0 for all others and for texts of which
    nothing is left. ``live`` marks the rows in scope (all if None); ``most`` may narrow them, for a deterministic cap."""
    ready = strip_handles(F.coalesce(text, F.lit("")), source)
    scope = ready != ""
    for more in (live, most):
        scope = scope & F.coalesce(more, F.lit(False)) if more is not None else scope
    return F.coalesce(F.when(scope, scorer(F.when(scope, ready))), F.lit(0.0))


def best_class(scores: Column) -> dict[str, Column]:
    """Label and confidence from a map of class scores; ties go to the first class by name."""
    top = F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    ties = F.array_min(F.transform(F.filter(F.map_entries(scores), lambda e: e["value"] == top["p"]), lambda e: e["key"]))
    return {"sentiment_label": ties, "sentiment_confidence": top["p"]}


def model_scorer(load: Callable[[], Callable[[list[str]], list[dict[str, float]]]], batch: int = 64):
    """A pandas UDF text -> map of class scores, around a model that ``load`` returns."""

    @F.pandas_udf("map<string,double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([x for i in range(0, len(texts), batch) for x in model(texts[i : i + batch])], dtype=object)

    return score


def score_posts(posts: DataFrame, text: str = "text", only_unlabelled: bool = False, scorer=lexicon) -> DataFrame:
    """Scored posts; with ``only_unlabelled`` rows that came with a label keep it with confidence 1."""
    s = scorer(F.col(text))
    given = numeric(F.col("sentiment_label")) if "sentiment_label" in posts.columns else F.lit(None).cast("int")
    own = given.isNotNull()
    p = posts.withColumns({
        "original_sentiment_label": F.col("sentiment_label") if "sentiment_label" in posts.columns else F.lit(None).cast("string"),
        "original_label_available": own, "_given": given,
    })
    if not only_unlabelled:
        return p.withColumns(s).drop("_given")
    own = F.col("original_label_available")
    name = F.when(F.col("_given") > 0, "positive").when(F.col("_given") < 0, "negative").otherwise("neutral")
    return p.withColumns({
        "sentiment_label": F.when(own, name).otherwise(s["sentiment_label"]), "sentiment_numeric": F.when(own, F.col("_given")).otherwise(s["sentiment_numeric"]),
        "sentiment_confidence": F.when(own, 1.0).otherwise(s["sentiment_confidence"]), "is_uncertain": F.when(own, False).otherwise(s["is_uncertain"]),
    }).drop("_given")
