"""Tables in the shared folder that cut lineage, and global row numbers without a window over everything."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shared_dir

_ROW = (1 << 33) - 1  # the low bits of monotonically_increasing_id: the row inside its partition


def store(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lost executor costs nothing that came before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Deletes what ``store`` wrote for tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_stored_at", None)
        if path:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, *order, out: str = "row") -> tuple[DataFrame, int]:
    """(``df`` with each row's place from 0 in the order, number of rows). Rows are dealt by ranges and sorted inside; a range's rows
    are counted, and the counts, one of each range, become what precedes it. No task holds more than a range."""
    own = "_part_" + "_" * max(len(c) for c in df.columns)
    r = df.repartitionByRange(*order).sortWithinPartitions(*order)
    r = store(r.withColumns({own: F.spark_partition_id(), own + "r": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))}), "numbered")
    counts = sorted((p, n) for p, n in r.groupBy(own).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    first = df.sparkSession.createDataFrame(before, f"{own} int, _before long")
    j = r.join(F.broadcast(first), own)  # one row for each range
    return j.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col(own + "r")).alias(out)), total
