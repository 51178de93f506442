"""Document fingerprints from content-defined chunks.

A gear hash runs over a text's bytes (32 of them count); a chunk ends where its high bits are zero. Normalised chunking asks for
more zero bits before the normal size than after it, between a least and a most size, so lengths stay close together and a
boundary depends on nearby bytes only: an insertion or a cut moves no other boundary for long. A fingerprint is the set of
(chunk digest, chunk length) records, sorted, in base 64. Containment is the share of a text's distinct chunks, weighted by
length, that the other text has too.

``with_next`` compares each document with the next one in descending id. Documents are dealt by ranges of (id, hash of the text) and
sorted inside, so the next document is the next row; a task goes through its range as a stream and holds a slice of it. There are
as many ranges as the table has ``RANGE`` bytes of text, however large it is, and one id on very many rows fills several. The first
and the last document of each range are written beside the results, and the last of one meets the first of the next in a join over
these alone. Each text is shuffled once. Equal rows (id and text) are one row with a number of copies until the end, so they never
fill a task.

Defined cases: null text is empty; two empty texts have likeness 1, an empty and a non-empty one 0; null ids stand last; rows
with one id are ordered by a descending hash of the text, then the text; of equal rows each is the next one of the one before; a
single document is its own next; sparse ids, or one id on all rows, make ranges like any others; an empty table gives an empty
result; extra columns, whatever their names, are ignored; a very long text is a slice of its own.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .base import forget, only, store, table, without
from .kernel import U, mix, span_hash, trim

#: Least, normal and most bytes of a chunk; zero bits asked for before and after the normal size.
LEAST, NORMAL, MOST, STRICT, LOOSE = 24, 56, 224, 7, 5
#: Bytes of text of a range, copies of a row that are told at once; bytes that are hashed at once.
RANGE, TOLD, AT_ONCE = 64 << 20, 10_000, 1 << 20
_REACH = 32
GEAR = (mix(np.arange(1, 257, dtype=U)) >> U(32)).astype(np.uint32)


def _gear(data: np.ndarray) -> np.ndarray:
    """The 32-byte gear hash at every byte, by doubling the window."""
    h = GEAR[data]
    h[data == 0xFF] = 0  # the padding between texts; no UTF-8 text has this byte
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def _cuts(n: int, strict: list[int], loose: list[int], base: int) -> list[int]:
    """Ends of the chunks of a text of ``n`` bytes, from ends that the hash allows."""
    out, at, ns, nl = [], 0, len(strict), len(loose)
    while n - at > LEAST:
        end = min(at + MOST, n)
        i = bisect_left(strict, base + at + LEAST)
        if i < ns and strict[i] < base + at + NORMAL and strict[i] - base < end:
            at = strict[i] - base
        else:
            i = bisect_left(loose, base + at + NORMAL)
            at = loose[i] - base if i < nl and loose[i] - base < end else end
        out.append(at)
    if at < n:
        out.append(n)
    return out


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct records, digest << 8 | length - 1."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= AT_ONCE):
            size += len(texts[j]) + _REACH
            j += 1
        out += _some(texts[i:j])
        i = j
    return out


def _some(texts: list[bytes]) -> list[np.ndarray]:
    pad = b"\xff" * _REACH
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    h = _gear(data)
    strict = np.flatnonzero(h >> np.uint32(32 - STRICT) == 0) + 1
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = _REACH + np.cumsum(sizes + _REACH) - sizes - _REACH
    s0, s1 = np.searchsorted(strict, begin), np.searchsorted(strict, begin + sizes)
    l0, l1 = np.searchsorted(loose, begin), np.searchsorted(loose, begin + sizes)
    strict, loose = strict.tolist(), loose.tolist()
    starts, ends, count = [], [], []
    for k, (b, n) in enumerate(zip(begin.tolist(), sizes.tolist())):
        cuts = _cuts(n, strict[s0[k] : s1[k]], loose[l0[k] : l1[k]], b)
        count.append(len(cuts))
        starts += [b, *[b + c for c in cuts[:-1]]] if cuts else []
        ends += [b + c for c in cuts]
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    rec = (span_hash(data, starts, ends) >> U(32)) << U(8) | (ends - starts - 1).astype(U)
    at = np.cumsum([0, *count])
    return [np.unique(rec[at[k] : at[k + 1]]) for k in range(len(texts))]


def text_of(rec: np.ndarray) -> str:
    """A fingerprint as text: five bytes a record, base 64."""
    return base64.b64encode(rec.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of ``a``, by length, that ``b`` has too."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = lambda x: float(((x & U(255)) + U(1)).sum())
    return weight(np.intersect1d(a, b, assume_unique=True)) / weight(a)


def _edited(text: str, after: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


_OUT = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("copies", pa.int64()), ("edge", pa.int32()), ("part", pa.int32()), ("text", pa.string()),
])
OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: ``edge`` is 0 for a result, and 1 and 2 for the first and the last document of a range, which have a text and no results.
_WITH_EDGES = f"{OUT}, copies long, edge int, part int, text string"


def _compared(pairs: list[tuple[int | None, str, str, int]]) -> pa.RecordBatch:
    """Results of (id, text, next text, copies)."""
    # A text and the next one's next are mostly the same: each is cut once.
    texts = list(dict.fromkeys(x for _, a, b, _ in pairs for x in (a, b)))
    of = dict(zip(texts, fingerprints([x.encode() for x in texts])))
    own, follow = [of[a] for _, a, _, _ in pairs], [of[b] for _, _, b, _ in pairs]
    changed = [_edited(a, b).encode() for _, a, b, _ in pairs]
    new = fingerprints(changed)
    n = len(pairs)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, *_ in pairs], pa.int64()), pa.array([len(a) for _, a, _, _ in pairs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
            pa.array([text_of(x) for x in own], pa.string()), pa.array([text_of(x) for x in new], pa.string()), pa.array([containment(x, y) for x, y in zip(own, new)], pa.float64()),
            pa.array([containment(x, y) for x, y in zip(own, follow)], pa.float64()), pa.array([c for *_, c in pairs], pa.int64()),
            pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([None] * n, pa.string()),
        ],
        schema=_OUT,
    )


def _edge(kind: int, part: int, doc: tuple[int | None, str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"id": doc[0], "copies": doc[2], "edge": kind, "part": part, "text": doc[1]}], _OUT)


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents (id, text, copies) of a range, in order: each compared with the next, the copies of one with itself."""
    part, held, pairs, size = TaskContext.get().partitionId(), None, [], 0
    for b in batches:
        # One text at a time leaves Arrow.
        for i, text, copies in ((x.as_py(), y.as_py(), z.as_py()) for x, y, z in zip(*b.columns)):
            if held is None:
                yield _edge(1, part, (i, text, copies))
            else:
                pairs.append((held[0], held[1], text, 1))
            pairs += [(i, text, text, min(copies - 1 - k, TOLD)) for k in range(0, copies - 1, TOLD)]
            held = (i, text, copies)
            size += len(text)
            if size >= AT_ONCE and pairs:
                yield _compared(pairs)
                pairs, size = [], 0
    if pairs:
        yield _compared(pairs)
    if held is not None:
        yield _edge(2, part, held)
    trim()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for i in range(0, len(rows), 64):
            yield _compared([(r["id"], r["text"], r["follows"], 1) for r in rows[i : i + 64]])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE, tasks: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document and its next one.
    There is a range for every ``size`` bytes, and at least ``tasks`` (the session's shuffle partitions)."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)))
    d = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    light = store(d.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")), "keys")
    much, most = light.agg(F.sum("bytes"), F.max("n")).first()
    one = F.lit(1).cast("long").alias("copies")
    order = [F.desc("key")]
    again = None
    if (most or 0) > 1:
        again = store(light.where("n > 1").select("key"), "again")
        many = only(d, again, "key").groupBy("key", "text").agg(F.first("id").alias("id"), F.count("*").alias("copies"))
        d = without(d, again, "key").select("*", one).unionByName(many).withColumn("tie", F.xxhash64("text"))
        order += [F.desc("tie"), F.desc("text")]
    else:
        d = d.select("*", one)
    ranges = max(-(-(much or 0) // size), tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ranges are cut by id and hash; equal hashes of one id, other texts, are in one range and in order of the text.
    dealt = d.repartitionByRange(int(ranges), *order[:2]).sortWithinPartitions(*order)
    out = store(dealt.select("id", "text", "copies").mapInArrow(_range, _WITH_EDGES), "fingerprints")
    forget(light, *([again] if again is not None else []))
    firsts = out.where("edge = 1").select(F.col("part").alias("to"), F.col("text").alias("follows"))
    parts = sorted(r["to"] for r in firsts.select("to").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, to int")
    lasts = out.where("edge = 2").select("id", "part", "text")
    met = lasts.join(F.broadcast(after), "part").join(firsts, "to").select("id", "text", "follows").mapInArrow(_meet, _WITH_EDGES)
    both = out.where("edge = 0").unionByName(met)
    both = both.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return both.select(*[f.split()[0] for f in OUT.split(", ")])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
