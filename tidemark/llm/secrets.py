"""Secret scans over every historical version of every path, through an incremental ledger of blobs.

A version's text is addressed by its SHA-256. The ledger keeps (blob, rule, version) triples that were scanned and what was
found, in a folder for each run; a run scans only triples that the ledger lacks, once per distinct blob however many paths hold
it, writes them under its own name, so that a repeated run replaces itself, and joins the findings of its own blobs back to all
paths. Everything is DataFrame expressions; texts are shuffled at most once, and exact copies meet in an aggregate with map-side
combine, never in one task. The registered query keeps a new ledger in the folder of spark.checkpoint.dir.

Positions come from splitting the text at the rule's pattern: the lengths of the pieces and of the matches give every
start, in code points.

Defined cases: null text is the empty text; a repeated (path, text) row is scanned once and reported for every row; an
empty table gives an empty result and an unchanged ledger; extra columns are ignored; spans of different kinds may overlap,
those of one kind never do; spans with one start stand in the order of the rules; a text of any length is one row's value, and
takes time in proportion to its length and its spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import forget, let, runs, shared_dir, store, table


class Rule(NamedTuple):
    """``pattern`` finds candidates left to right; ``group``'s text must have ``least`` characters or the match is dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    gate: str = ""  # a cheaper pattern that every text with a match also matches


#: The three base kinds. A run of 16 or more of a class is what is left of all runs once shorter ones are
#: dropped, as runs are taken whole; the same holds for access keys, whose run can only get shorter further right.
RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Blobs with findings and their spans together are sent to every task up to this many (under 20 MB); unseen blobs (100 bytes each).
BROADCAST_SPANS, BROADCAST_BLOBS = 200_000, 100_000
_EMPTY = "array<struct<start:long,end:long>>"
LEDGER = "blob string, kind string, version int, spans array<struct<start:long,end:long>>"


def _scan(items: Column, fold: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(state, item)`` of every item, the state being a long that starts at 0 and goes through ``fold(state, item)``.

    Arrays grow by copies, so items are taken in runs: those of a run are short, and so is the list of the runs' first states."""
    zero = F.lit(0).cast("long")

    def begins(parts: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("all"))
        step = lambda s, run: F.struct(F.aggregate(run, s["at"], fold).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        return F.aggregate(parts, start, step, lambda s: s["all"])

    def inside(run: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        step = lambda s, x: F.struct(fold(s["at"], x).alias("at"), F.concat(s["out"], F.array(emit(s["at"], x))).alias("out"))
        return F.aggregate(run, start, step, lambda s: s["out"])

    return let(items, lambda all_: let(runs(all_), lambda parts: F.flatten(F.zip_with(parts, begins(parts), inside))))


def find(text: Column, rule: Rule) -> Column:
    """The kept matches of a rule as an array of (start, end), code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.arrays_zip(
        F.transform(parts, lambda p: F.length(p).cast("long")).alias("gap"),
        F.transform(hits, lambda h: F.length(h).cast("long")).alias("len"),
        F.transform(values, lambda v: F.length(v).cast("long")).alias("val"),
    )
    # What follows the last match has no length and no value, and is not kept.
    found = _scan(
        rows,
        lambda at, r: at + r["gap"] + F.coalesce(r["len"], F.lit(0)),
        lambda at, r: F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["len"]).alias("end"), r["val"].alias("val")),
        "array<struct<start:long,end:long,val:long>>",
    )
    kept = F.filter(found, lambda x: x["val"] >= rule.least)
    kept = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    gate = text.rlike(rule.gate or rule.pattern)
    return F.when(gate, kept).otherwise(F.array().cast(_EMPTY))


def _there(spark: SparkSession, path: str) -> bool:
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark._jsc.hadoopConfiguration()).exists(here)


def read_ledger(spark: SparkSession, path: str, without_run: str | None = None) -> DataFrame:
    """The ledger stored at ``path`` (empty if there is none yet), one folder for each run; ``without_run`` is left out."""
    if not _there(spark, path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(f"{LEDGER}, run string").parquet(path)
    return (rows if without_run is None else rows.where(F.col("run") != without_run)).drop("run")


def scan(versions: DataFrame, path_cols: list[str], ledger: DataFrame | None = None, rules=RULES, text_col: str = "text"):
    """(paths with their blobs, new ledger rows). ``versions`` holds one row per path and version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = store(versions.select(*path_cols, F.sha2(text, 256).alias("blob")), "paths")
    wanted = paths.select("blob").distinct()
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    pairs = wanted.select("blob", F.explode(asked).alias("r")).select("blob", "r.kind", "r.version")
    bodies = versions.select(F.sha2(text, 256).alias("blob"), text.alias("body"))
    if ledger is None:
        todo = wanted.withColumn("rules", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        todo = store(pairs.groupBy("blob").agg(F.collect_set("kind").alias("rules")), "todo")
        n, all_ = todo.count(), wanted.count()
        if n < all_:  # most blobs were seen before: their texts are not sent anywhere
            bodies = bodies.join(F.broadcast(todo.select("blob")) if n <= BROADCAST_BLOBS else todo.select("blob"), "blob", "left_semi")
    # One text for each blob: copies meet in an aggregate, at first where they are read, so a blob of very many paths is sent
    # a few times. The texts are dealt by blob once, and their rules meet them there.
    hit = bodies.groupBy("blob").agg(F.first("body").alias("body")).join(todo, "blob")
    found = [F.when(F.array_contains("rules", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find(F.col("body"), r).alias("spans"))) for r in rules]
    fresh = hit.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("blob", "f.*")
    return paths, fresh


def findings(fresh: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(blob, spans: array of (start, order, kind, end)) for blobs in which anything was found."""
    known = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "kind", "version", "spans"))
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    known = known.where((F.size("spans") > 0) & (F.col("version") == now[F.col("kind")]))
    one = known.select("blob", order[F.col("kind")].alias("ord"), "kind", F.explode("spans").alias("s")).distinct()
    spans = F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), "ord", "kind", F.col("s.end").alias("end"))))
    return one.groupBy("blob").agg(spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Every path with its spans; an empty array where nothing was found. Both are stored tables: a blob of very many paths is
    split when it is joined, and few findings go to every task."""
    none = F.array().cast("array<struct<start:long,ord:int,kind:string,end:long>>")
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def record(versions: DataFrame, path_cols: list[str], ledger_path: str, rules=RULES, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger at ``ledger_path`` lacks and appends it there as ``run``; (paths, stored findings of their blobs).

    A run that is repeated under its name, after a failure say, replaces its own rows and no others."""
    spark, run = versions.sparkSession, run or uuid.uuid4().hex
    paths, fresh = scan(versions, path_cols, read_ledger(spark, ledger_path, run), rules)
    fresh.write.mode("overwrite").parquet(f"{ledger_path}/run={run}")
    known = read_ledger(spark, ledger_path).where(F.size("spans") > 0)
    known = known.join(paths.select("blob").distinct(), "blob", "left_semi")
    return paths, store(findings(known, rules=rules), "findings")


def update(versions: DataFrame, path_cols: list[str], ledger_path: str, rules=RULES, run: str | None = None) -> DataFrame:
    """Every path of ``versions`` with its spans, after ``record``."""
    return report(*record(versions, path_cols, ledger_path, rules, run))


def own_ledger(spark: SparkSession) -> str:
    """A new ledger's folder, for callers that keep none."""
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def redact(docs: DataFrame, mask: str = "[SECRET]", rules=RULES, ledger_path: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans are replaced as one. n_chars follows the text.

    Null texts stay null; rows, other columns and repeats stay as they are, whatever their names."""
    paths, found = record(docs, ["doc_id"], ledger_path or own_ledger(docs.sparkSession), rules)
    forget(paths)
    blob = "_blob" + "_" * max(len(c) for c in docs.columns)  # a name no column has
    found = found.select(F.col("blob").alias(blob), F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias(blob + "s"))
    load = found.agg(F.count("*") + F.sum(F.size(blob + "s"))).first()[0] or 0
    found = F.broadcast(found) if load <= BROADCAST_SPANS else found
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(blob, F.sha2(text, 256)).join(found, blob, "left")
    # The gaps before the spans, from the furthest end so far; a span that begins before it belongs to the one before.
    gaps = _scan(
        F.col(blob + "s"), lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.struct(at.alias("from"), x["start"].alias("to")), "array<struct<from:long,to:long>>"
    )
    part = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

    def cut(run: Column) -> Column:
        """The gaps of a run with a mask behind each, cut from the run's own stretch, as a place in a text is found by walking there."""
        first = F.get(run, F.lit(0))["from"]
        inside = lambda t: F.array_join(F.transform(run, lambda x: F.concat(part(t, x["from"] - first, x["to"] - first), F.lit(mask))), "")
        return F.when(F.size(run) > 0, let(part(text, first, F.element_at(run, -1)["to"]), inside)).otherwise(F.lit(""))

    last = F.array_max(F.transform(blob + "s", lambda x: x["end"]))
    masked = let(F.filter(gaps, lambda x: x["to"] >= x["from"]), lambda kept: F.array_join(F.transform(runs(kept), cut), ""))
    clean = F.concat(masked, F.substr(text, (last + 1).cast("int")))
    hit = F.col(blob + "s").isNotNull()
    out = out.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = update(table(spark, sf_dir, "documents"), ["doc_id"], own_ledger(spark))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    count = [of(rule.kind) for rule in RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(*[x.kind for x in RULES]))
    return r.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


_ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _kind_sql(kind: str, ord_: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {ord_} AS ord, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, p, m, v, {least} AS least FROM (
  SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS ({_kind_sql("assign", 0, _ASSIGN, 2, 12)} UNION ALL {_kind_sql("access", 1, "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_kind_sql("hex", 2, "[0-9a-f]{16,}", 0, 16)}),
s AS (SELECT doc_id, ord, kind, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS a, length(m[i]) AS n FROM c WHERE length(v[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
