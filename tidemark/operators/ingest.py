"""Row-level ingest: keeping the first of repeated keys, label reports, samples, ticker universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of every key in the given order (dropDuplicates may keep any)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """``keep_first`` of a few columns by a unique order, as an aggregate with map-side combine."""
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in cols])


def label_distribution(df: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def label_by_source(df: DataFrame, labels: list, source: str = "source", label: str = "label") -> DataFrame:
    return df.groupBy(source).pivot(label, labels).count().na.fill(0)


def describe(df: DataFrame, c: str, *keys: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles (between neighbours in proportion) and most."""
    cut = F.percentile(c, [0.25, 0.5, 0.75])
    g = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("low"), cut.alias("_q"), F.max(c).alias("high"))
    return g.select(*keys, "n", "mean", "sd", "low", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high")


def report_by_file(df: DataFrame, label: str = "label") -> DataFrame:
    """Label shares of every file that a scan reads."""
    return label_distribution(df.withColumn("file", F.col("_metadata.file_name")), "file", label=label)


def stratified(df: DataFrame, label: str, n: int, order: Column, tie: str) -> DataFrame:
    """``n`` rows of each class by a fixed pseudo-random order."""
    w = Window.partitionBy(label).orderBy(order, tie)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cap(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def not_deleted(df: DataFrame, c: str = "text") -> DataFrame:
    t = F.lower(F.trim(c))
    return df.where(F.col(c).isNotNull() & ~t.isin("[deleted]", "[removed]", ""))


def without_bots(df: DataFrame, authors: tuple[str, ...] = ("VisualMod", "AutoModerator")) -> DataFrame:
    """A row without an author stays."""
    return df.where(F.coalesce(~F.col("author").isin(*authors), F.lit(True)))


def long_enough(df: DataFrame, c: str = "text", n: int = 20) -> DataFrame:
    return df.where(F.length(tx.clean_a(F.col(c))) >= n)


def tickers_of(df: DataFrame) -> DataFrame:
    return df.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()


def ticker_universe(*tables: DataFrame | None, default: tuple[str, ...] = tx.KNOWN) -> DataFrame:
    """Tickers of the first table that has any, upper case, distinct; else the default ones. No job runs while this is planned:
    each table's tickers carry its place, and the smallest place that has any wins."""
    spark = next(t for t in tables if t is not None).sparkSession
    parts = [tickers_of(t) for t in tables if t is not None and "ticker" in t.columns] + [spark.createDataFrame([(x,) for x in default], "ticker string")]
    u = parts[0].withColumn("_at", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        u = u.unionByName(p.withColumn("_at", F.lit(i)))
    return u.join(F.broadcast(u.agg(F.min("_at").alias("_at"))), "_at", "left_semi").select("ticker")


def common_tickers(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tickers that both tables have, as they are written."""
    return a.select("ticker").intersect(b.select("ticker")).where("ticker IS NOT NULL")
