"""Sinks: Parquet or CSV by run, and an upsert of a JSON registry."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.causality import upsert_registry


def write_run(df: DataFrame, folder: str, run_id: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    path = f"{folder.rstrip('/')}/run_id={run_id}"
    w = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    w.format(kind).option("header", True).save(path)
    return path


#: Seconds after which the claim of a writer that never published is void.
LEASE = 600.0
_AT, _CLAIM, _DATA = "_at-", "_claim-", "v"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    to = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}" if name else path)
    return to().getFileSystem(spark._jsc.hadoopConfiguration()), to


def registry_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, folder) of the version that counts: the one that the pointer file with the highest number names; (0, None) if none."""
    fs, to = _folder(spark, path)
    found = sorted(s.getPath().getName() for s in (fs.globStatus(to(f"{_AT}*")) or []))
    if not found:
        return 0, None
    n, name = found[-1].removeprefix(_AT).split("-", 1)
    return int(n), f"{path.rstrip('/')}/{name}"


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """The registry as its last publisher left it; empty if there is none."""
    n, folder = registry_version(spark, path)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).json(folder)


def upsert_json(spark: SparkSession, new: DataFrame, path: str, key: str = "ticker", lease: float = LEASE, wait: float = 0.5) -> DataFrame:
    """Writes new rows over the old ones of their key, as a new version.

    A version is a folder of its own; it counts from the moment that an empty pointer file with its number and name is there, which
    is the last thing written. So a writer that dies between any two steps leaves the version before it whole. One writer at a time
    may follow a version: it claims the next number by a file that must not be there yet; others wait, and build on what it
    published. A claim without a publication is void after ``lease`` seconds. The version before the last one stays for those who
    still read it; older ones are deleted."""
    fs, to = _folder(spark, path)
    fs.mkdirs(to())
    while True:
        n, folder = registry_version(spark, path)
        claim = to(f"{_CLAIM}{n + 1:09d}")
        if not fs.createNewFile(claim):
            try:
                age = time.time() - fs.getFileStatus(claim).getModificationTime() / 1000
            except Exception:  # noqa: BLE001  (published and cleaned up meanwhile)
                age = 0.0
            if age > lease:
                fs.delete(claim, False)
            else:
                time.sleep(wait)
            continue
        if registry_version(spark, path)[0] != n:  # published between the two looks
            fs.delete(claim, False)
            continue
        name = f"{_DATA}{n + 1:09d}-{uuid.uuid4().hex}"
        old = None if folder is None else spark.read.schema(new.schema).json(folder)
        upsert_registry(old, new, key).write.json(to(name).toString())
        if registry_version(spark, path)[0] != n:  # the claim was void and another took it
            fs.delete(to(name), True)
            continue
        fs.createNewFile(to(f"{_AT}{n + 1:09d}-{name}"))
        _clean(fs, to, n)
        return spark.read.schema(new.schema).json(to(name).toString())


def _clean(fs, to, last: int) -> None:
    """Deletes what is older than version ``last``, pointers first."""
    number = lambda name, head: int(name.removeprefix(head).split("-")[0])
    for head in (_AT, _CLAIM, _DATA):
        for s in fs.globStatus(to(f"{head}[0-9]*")) or []:
            if number(s.getPath().getName(), head) < last + (head == _CLAIM):
                fs.delete(s.getPath(), True)
