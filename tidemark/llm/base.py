"""Shared plumbing: reading tables, cutting lineage in the shared folder, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Ids are sent to every executor only below this many rows (8 bytes each); above it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Rows that go to a Python worker at once: rows hold whole texts or sets of some ten kilobytes.
BATCH_ROWS = 2000
#: Items of an array that is built by appending, as such an array is copied for every item.
RUN = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The queries of this subpackage call it first, and from here on the session sends at most
    ``BATCH_ROWS`` rows at once to Python workers (a smaller number stays): Spark has that as a setting of the session alone."""
    spark.conf.set(_BATCH, str(min(int(spark.conf.get(_BATCH)), BATCH_ROWS)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Deletes what ``store`` wrote for tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; the ids are broadcast only when they are counted to be few."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``, with the same check of size."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) from md5, the same in Spark and in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def int_hash(*cols: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column, n: int = RUN) -> Column:
    """An array in parts of ``n`` items each; one empty part of an empty one."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(n)), lambda i: F.slice(items, i + 1, F.lit(n)))


def words_pattern() -> str:
    return "[^\\x20\\x09-\\x0D]+"


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node reachable.

    Alternating large-star and small-star steps: every step sends each node's neighbours to the smallest of them, so
    the number of rounds grows with the logarithm of the graph, whatever its diameter. The minimum of a node is taken by
    an aggregate with map-side combine and joined back, so a node with very many neighbours is never gathered in one
    task. Each round is cut in the shared folder; the old one is deleted.
    """
    e = store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges"
    )
    if e.isEmpty():
        forget(e)
        return edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)
    nodes_of = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    kept = store(nodes_of, "nodes")
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v")))
        nxt = store(
            small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges"
        )
        forget(e, large)
        e = nxt
        # A star forest is reached when no centre is itself a leaf; sums tell a changed edge set apart.
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    comp = e.groupBy("u").agg(F.min("v").alias("v"))
    return kept.join(comp, kept.node == comp.u, "left").select("node", F.coalesce("v", "node").alias("comp"))
