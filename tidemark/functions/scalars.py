"""Numbers, dates and windows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Time formats that are tried in this order; numbers may have one digit or two, fractions one to six.
TIME_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'", "M/d/yyyy H:m", "yyyy-M-d")
_TWITTER = "^[A-Z][a-z]{2} ([A-Z][a-z]{2} \\d{1,2} \\d{1,2}:\\d{1,2}:\\d{1,2}) \\+0000 (\\d{4})$"


def parse_time(c: Column, fallback: Column) -> Column:
    t = F.trim(c)
    tried = [F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS]
    tweet = F.when(t.rlike(_TWITTER), F.try_to_timestamp(F.regexp_replace(t, _TWITTER, "$1 $2"), F.lit("MMM d H:m:s yyyy")))
    return F.coalesce(*tried[:4], tweet, *tried[4:], fallback)


def parse_rfc2822(c: Column, fallback: Column) -> Column:
    t = F.regexp_replace(F.trim(c), "^[A-Za-z]{3}, ", "")
    t = F.regexp_replace(F.regexp_replace(t, " (GMT|UTC)$", " +0000"), "^(\\d) ", "0$1 ")
    return F.coalesce(F.try_to_timestamp(t, F.lit("dd MMM yyyy HH:mm:ss Z")), fallback)


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a, b)


def clip(c: Column, low=None, high=None) -> Column:
    """Bounds that keep null, which greatest and least would skip."""
    x = c
    if low is not None:
        x = F.greatest(x, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        x = F.least(x, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), x)


def safe(c: Column) -> Column:
    """A finite number, else 0."""
    c = c.cast("double")
    odd = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(odd, 0.0).otherwise(c)


def ordered(keys, *order) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def rolling(c: Column, w: WindowSpec, n: int, fn) -> Column:
    """An aggregate over the last ``n`` rows, null until all of them are there and not null."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(f) == n, fn(c).over(f))


def change(c: Column, w: WindowSpec, k: int = 1) -> Column:
    return ratio(c, F.lag(c, k).over(w)) - 1


def fill_forward(c: Column, w: WindowSpec, limit: int | None = None) -> Column:
    f = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(c, ignorenulls=True).over(f)


def fill_both(c: Column, w: WindowSpec, default: float = 0.0) -> Column:
    ahead = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(fill_forward(c, w), ahead, F.lit(default))
