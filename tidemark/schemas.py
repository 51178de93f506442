"""Logical tables, alias resolution and null handling, all decided from the column list when the plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _table(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


#: The canonical post columns in their order.
POST = _table(
    ("id", _S), ("source", _S), ("subreddit", _S), ("type", _S), ("author", _S), ("text", _S), ("upvotes", _D), ("downvotes", _D),
    ("upvote_ratio", _D), ("account_age_days", _L), ("account_karma", _L), ("post_flair", _S), ("timestamp_utc", _S),
    ("pull_timestamp_utc", _S), ("sentiment_label", _S), ("sentiment_score", _D),
)
PRICE = _table(("timestamp_utc", _TS), ("Open", _D), ("High", _D), ("Low", _D), ("Close", _D), ("Volume", _L), ("ticker", _S))
VIX = _table(("timestamp_utc", _TS), ("vix_close", _D), ("index", _S))
INDICES = _table(("timestamp_utc", _TS), ("Close", _D), ("index_name", _S), ("ticker", _S))
EARNINGS = _table(("ticker", _S), ("earnings_date", T.DateType()))
LABELLED = _table(("text", _S), ("label", T.IntegerType()), ("source", _S), ("type", _S), ("market", _S), ("timestamp_utc", _S))

#: Names that stand for a column, the first that exists wins.
ALIASES = {
    "text": ("text", "clean_text", "tweet", "Tweet", "content", "body", "message"),
    "author": ("author", "user", "username", "author_name", "screen_name", "handle"),
    "source": ("source", "platform"),
    "timestamp_utc": ("timestamp_utc", "created_utc", "timestamp", "created_at", "datetime", "date", "Date"),
    "upvotes": ("upvotes", "likes", "like_count", "favorite_count", "favorites", "votes"),
}
#: The shorter lists that single steps go by when they are run alone.
_TEXT, _SOURCE = ("text", "tweet", "Tweet", "content", "body"), ("source", "platform")
STEP_ALIASES = {
    "bots": {"text": _TEXT, "author": ("author", "user", "username", "screen_name", "handle"), "source": _SOURCE, "timestamp_utc": ALIASES["timestamp_utc"]},
    "spam": {"text": _TEXT, "source": _SOURCE, "upvotes": ("upvotes", "likes", "like_count", "favorite_count", "favorites")},
    "sarcasm": {"text": _TEXT, "source": _SOURCE},
}
#: What a column holds if none of its names exists; others are null.
DEFAULTS = {"text": "", "author": "[unknown]", "source": "unknown"}
#: Columns that hold votes, the first that exists wins.
VOTES = ("ups", "upvotes")


def first_existing(df: DataFrame, names: Iterable[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def role_column(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first column whose name is among the candidates, whatever its case."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    return next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)


def coalesce_aliases(df: DataFrame, defaults: dict[str, Column] | None = None, aliases=ALIASES) -> DataFrame:
    """Each canonical column from the first of its names that exists, else its default, else null."""
    defaults = {k: F.lit(v) for k, v in DEFAULTS.items()} | (defaults or {})
    out = {}
    for name, names in aliases.items():
        have = first_existing(df, names)
        if have is None:
            out[name] = defaults.get(name, F.lit(None).cast("string"))
        elif have != name:
            out[name] = F.col(have)
    return df.withColumns(out) if out else df


def canonical(df: DataFrame, schema: T.StructType = POST) -> DataFrame:
    """The schema's columns in order, missing ones null, the others kept on the right."""
    have = set(df.columns)
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols, *[c for c in df.columns if c not in schema.names])


def plain_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Only null stands for a missing number: NaN sorts above everything and is not skipped by aggregates."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def require(df: DataFrame, *names: str) -> None:
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")


def union_drifting(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
