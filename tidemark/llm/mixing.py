"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size (at most 2). The documents of a
source stand in one order, their expected copies are summed along it, one offset per source is added, and a document is
emitted once for each whole number that the sum passes while it crosses the document. The order goes by size, so that
each stretch of similar sizes gets its share and the taken words stay close to the target.

The running sum is a rank times a constant. The rank is the number of rows in earlier cells plus the row number inside
the cell; a cell is (source, band of sizes, salt) with about ``CELL`` rows, so a source with a third of all rows is
still spread over many tasks. Cells are summed in runs of ``RUN``, so the one window of a source has a row for each
262,144 documents. The targets are one window over one row for each source.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, last; a source whose
documents are all empty has target 0; an empty table gives an empty result; rows repeated with the same id are documents
of their own; ties of size are ordered by id; a very long text is one document like any other; extra columns, whatever their
names (band, salt), are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import BROADCAST_IDS, int_hash, store, table, unit_hash, words_pattern

#: Weights of the sources by code point, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows of a cell, on average; cells of a run.
CELL, RUN = 256, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")


def size_band(size: Column) -> Column:
    """The number of binary digits and the top three of them: monotone in size, within 25 percent."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(
        bits * 4 + F.call_function("shiftright", size, bits - 3)
    ).cast("int")



def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, so a small table."""
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank - 1) % n + 1)
    t = sizes.select("source", "source_size", w.alias("w"))
    t = t.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    t = t.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(W.partitionBy())
    t = t.withColumn("final", first["level"])
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", seed: str = "mix", weights=WEIGHTS, share=SHARE, most=MOST, cell=CELL, together: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row of ``docs``; ``together``: for every (id, source)."""
    d = docs.select(F.col(id_col).alias("id"), "source", word_count(F.col("text")).alias("size"))
    if together:
        d = d.groupBy("id", "source").agg(F.sum("size").alias("size"))
    d = store(d.withColumn("band", size_band(F.col("size"))), "sizes")
    groups = d.groupBy("source", "band").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    groups = store(groups.withColumn("salts", F.ceil(F.col("n") / cell).cast("long")), "bands")
    sizes = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, share, most)

    key = F.coalesce(F.col("source"), F.lit("")).alias("skey"), F.col("source").isNull().alias("snull")
    salted = d.select("*", *key).join(groups.select(*key, "band", "salts"), ["skey", "snull", "band"])
    salted = salted.withColumn("salt", F.pmod(int_hash(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.col("salts")))
    cells = salted.groupBy("skey", "snull", "band", "salt").agg(F.count("*").alias("m"))
    cells = store(cells.withColumn("run", F.floor(F.col("salt") / RUN)), "cells")
    # Rows before a cell: before its run of cells, summed over one row for each run, and inside the run.
    before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = cells.groupBy("skey", "snull", "band", "run").agg(F.sum("m").alias("m"))
    runs = runs.withColumn("runs_before", before(W.partitionBy("skey", "snull").orderBy("band", "run"))).drop("m")
    cells = cells.withColumn("inside_run", before(W.partitionBy("skey", "snull", "band", "run").orderBy("salt")))
    cells = cells.join(runs, ["skey", "snull", "band", "run"]).withColumn("earlier", F.col("runs_before") + F.col("inside_run"))
    goal = goal.select(*key, "source_size", "target")
    cells = cells.join(goal, ["skey", "snull"]).select("skey", "snull", "band", "salt", "earlier", "source_size", "target")
    inside = F.row_number().over(W.partitionBy("skey", "snull", "band", "salt").orderBy("size", F.col("id").asc_nulls_last()))
    r = salted.withColumn("inside", inside).join(cells, ["skey", "snull", "band", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit_hash(F.lit(seed), F.col("skey"), F.col("snull").cast("string"))
    pos = (F.col("earlier") + F.col("inside")).cast("double")
    r = r.withColumn("rate", rate).withColumn("offset", offset)
    copies = F.floor(pos * F.col("rate") + F.col("offset")) - F.floor((pos - 1.0) * F.col("rate") + F.col("offset"))
    return r.select("id", "source", "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def emit(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows with one id and source are taken together. Rows without an id
    are told apart by their texts: those with one text and source are taken together."""
    own = "_mix" + "_" * max(len(c) for c in docs.columns)  # names no column has
    # What stands for a missing id is below every id in use.
    stand_in = -F.abs(F.xxhash64(F.coalesce("text", F.lit(""))) % (1 << 62)) - (1 << 62)
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), stand_in))
    m = mix(keyed.select(F.col(own).alias("doc_id"), "source", "text"), seed=seed, together=True)
    m = store(m.where("copies > 0").select(F.col("id").alias(f"{own}i"), F.col("source").alias(f"{own}s"), F.col("copies").alias(f"{own}c")), "copies")
    n = m.limit(BROADCAST_IDS + 1).count()
    m = F.broadcast(m) if n <= BROADCAST_IDS else m
    out = keyed.join(m, (F.col(own) == F.col(f"{own}i")) & F.col("source").eqNullSafe(F.col(f"{own}s")))
    return out.withColumn(f"{own}n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{own}c")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select(
        F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken")
    )


_W = "[^\\x20\\x09-\\x0D]+"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size FROM documents),
b AS (SELECT *, CASE WHEN size < 8 THEN size ELSE 4 * length(bin(size)) + (size >> (length(bin(size)) - 3)::BIGINT) END AS band FROM d),
g AS (SELECT source, band, ceil(count(*) / {CELL}.0)::BIGINT AS salts FROM b GROUP BY ALL),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM z),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(f.level * w, cap)) AS target FROM l LEFT JOIN f ON true),
s AS (SELECT b.*, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % salts AS salt FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source AND b.band = g.band),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY band, salt, size, doc_id NULLS LAST))::DOUBLE AS pos FROM s),
o AS (SELECT r.doc_id, r.size, t.source_size, t.target, pos, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix|' || coalesce(r.source, '') || '|' || (r.source IS NULL)::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (least(floor(pos * rate + u) - floor((pos - 1) * rate + u), 2)::BIGINT * size)::BIGINT AS taken FROM o
"""
