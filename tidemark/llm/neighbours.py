"""Near-duplicate vectors by NN-descent, with equal labels only.

Equal vectors (by 128 bits of hash) are one class with a number of copies. The first graph links vectors that share a sign pattern
of random planes; the number of bits grows with the label, so that some ``K`` vectors share a pattern, the number of tables follows
from the bits so that a pair at the threshold meets in one table with ``SURE`` probability, and all members of a pattern are compared. Everyone's best ``K`` of a pattern
are kept, and links that join what all its links join.

Rounds of neighbours-of-neighbours joins then refine lists of ``K`` neighbours: around every vector its neighbours and those that have
it as one are compared with each other, if one of the two is new there. What gets into a list stays in it, at or over the threshold or
not; a list whose entries are all links is saturated and grows by ``K`` every round. Rounds end when hardly any list changes, or
when a round after the first brings hardly any link into a list that is not saturated (unrelated vectors change theirs for long). Vectors
are dealt into blocks of neighbours (label, length and some sign bits), a block gets each vector it needs once, and a pair is
compared in it once; a block returns only what gets into lists, and links that join what all links it saw join, so the work of a
round is in proportion to the vectors. Edges at or over the threshold then give the components. Where lists are saturated they are
enlarged to everything in the component.

Neither step pairs a tight group with itself. Every crowded pattern and every saturated component has a centre; members within half
the threshold's angle of it, its core, all link with each other by the triangle inequality, so the core is joined and counted without
a comparison. Only the others, the rim, are compared, with each other and with the core, in pairs of blocks, inside tasks that return
lists, joining links or counts, never all pairs. That is the square of the rim and the rim times the core.

The audit compares the links of ``AUDIT`` vectors (smallest hash) with brute force over all vectors, as a share for each vector, and
apart for saturated components; under ``RECALL`` the graph is built again with twice the tables, and after ``MOST`` tables all
vectors of each label are compared, which is exact and the square of a label. So no result is returned under the asked recall;
``Graph.recall`` has it.

Defined cases: null ids, null labels, and vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing and are components of their own; only vectors of equal length are compared; repeated rows are copies of each other; an id
given with several vectors has a row for each, and a component has the smallest id of its vectors; ties are ordered by a hash; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import BROADCAST_IDS, connected_components, forget, store, table
from .whitening import rows_of

#: Threshold; neighbours in a list; rounds at most; the share of lists that change, and from the second round on new links a vector in
#: lists that are not saturated, that end them.
COSINE, K, ROUNDS, STILL, FEW = 0.98, 8, 6, 0.02, 0.001
#: Chance that a pair at the threshold meets in a table; members of a block of a pattern; rows that a task compares in small patterns;
#: numbers in the vectors of a block of the rounds, and products that are held at once there.
SURE, PART, POOL, NUMBERS, PRODUCTS = 0.98, 2048, 4096, 1 << 18, 1 << 20
#: Vectors of a block; audited vectors; recall asked for.
BLOCK, AUDIT, RECALL = 1024, 400, 0.97
#: Sign bits of a label of up to SMALL vectors.
FEWEST, SMALL = 3, 64
#: The number of the table whose bits deal the blocks of the rounds: its planes are no other table's.
APART = 1 << 20
#: Tables after which no more are tried, and all vectors of a label are compared.
MOST = 256


def _plan(largest: int, threshold: float = COSINE) -> tuple[int, int]:
    """(bits, tables) for labels of this size."""
    bits = min(max(FEWEST, math.ceil(math.log2(max(largest, 1) / K))), 60)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - SURE) / math.log(1 - same)))  # one table alone has no way between its patterns


def _unit(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(cls, label, v): vectors as bytes of ``kind``; those that link with nothing are left out."""
    for b in batches:
        for at, x in rows_of(b.column(2)):
            some = x.any(axis=1)
            at, x = pa.array(at[some]), np.ascontiguousarray(x[some], kind)
            off = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
            v = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), v], ["cls", "label", "v"])


def _rows(v: list[bytes], kind: str) -> np.ndarray:
    """The unit vectors, of one length, in double precision."""
    x = np.frombuffer(b"".join(v), kind).astype(np.float64).reshape(len(v), -1)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    far = ~np.isfinite(n) | (n < 1e-140)
    if far.any():
        x[far] /= np.abs(x[far]).max(axis=1)[:, None]
        n[far] = np.sqrt(np.einsum("ij,ij->i", x[far], x[far]))
    return x / n[:, None]


def _planes(dim: int, bits: int, at: int) -> np.ndarray:
    return np.random.default_rng([dim, bits, at]).standard_normal((bits, dim))


def _patterns(batches: Iterator[pa.RecordBatch], bits: int, tables: range, kind: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(2).to_pylist()
        size = np.array([len(x) for x in v])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            m = _rows([v[i] for i in at], kind)
            dim = m.shape[1]
            cls, label = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))
            for t in tables:
                code = ((m @ _planes(dim, bits, t).T > 0) * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(1)
                yield pa.RecordBatch.from_arrays([cls, label, pa.array([t] * len(at), pa.int32()), pa.array([dim] * len(at), pa.int32()), pa.array(code)], ["cls", "label", "t", "dim", "code"])


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (left, right) that join what all links of the matrix join, found breadth first."""
    free, left, right = [near.any(1), near.any(0)], [], []
    while free[0].any():
        at = np.array([free[0].argmax()])
        free[0][at] = False
        while len(at):
            step = near[at] & free[1]
            to = np.flatnonzero(step.any(0))
            left.append(at[step[:, to].argmax(0)] if len(to) else to)
            right.append(to)
            free[1][to] = False
            step = near[:, to] & free[0][:, None]
            at = np.flatnonzero(step.any(1))
            right.append(to[step[at].argmax(1)] if len(at) else at)
            left.append(at)
            free[0][at] = False
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _joining(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Places of links (i, j) among ``n`` nodes that join what all of them join: every group takes one link out, until none leads out."""
    group, out, at = np.arange(n), [], np.arange(len(i))
    while True:
        gi, gj = group[i[at]], group[j[at]]
        apart = gi != gj
        at, gi, gj = at[apart], gi[apart], gj[apart]
        if not len(at):
            return np.concatenate(out) if out else at
        # Each group takes the link to the smallest group beside it, if that is smaller than itself: no circles.
        high, low = np.maximum(gi, gj), np.minimum(gi, gj)
        order = np.lexsort((low, high))
        first = order[np.append(True, np.diff(high[order]) != 0)]
        out.append(at[first])
        up = np.arange(n)
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        group = up[group]


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best ``k``."""
    if s.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(s.shape))
    return np.repeat(np.arange(len(s)), k), np.argpartition(-s, k - 1, axis=1)[:, :k].ravel()


def _compare(t: pa.Table, threshold: float, k: int, kind: str) -> pa.Table:
    """All members of each bucket against each other: everyone's best ``k``, and links that join what all links join."""
    bucket, cls, side = (t[c].to_numpy() for c in ("bucket", "cls", "side"))
    v = t["v"].to_pylist()
    dims = np.array([len(x) for x in v])
    order = np.lexsort((dims, bucket))
    cut = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
    out: list[tuple] = []
    for at in np.split(order, cut):
        left, right = at[side[at] != 1], at[side[at] != 0]
        if not len(left) or not len(right) or len(at) < 2:
            continue
        x = _rows([v[i] for i in left], kind)
        y = x if len(left) == len(right) == len(at) else _rows([v[i] for i in right], kind)
        s = x @ y.T
        s[cls[left][:, None] == cls[right][None, :]] = -2.0
        got = [_best(s, k)]
        if side[at[0]] != 2:
            got.append(_best(s.T, k)[::-1])
        near = s >= threshold
        if max(near.sum(0).max(), near.sum(1).max()) > k:
            got.append(_forest(near))
        i, j = (np.concatenate(z) for z in zip(*got))
        out.append((cls[left[i]], cls[right[j]], s[i, j]))
    a, b, s = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ok = s > -2.0
    return pa.table({"a": pa.array(np.minimum(a, b)[ok], pa.int64()), "b": pa.array(np.maximum(a, b)[ok], pa.int64()), "s": pa.array(s[ok], pa.float64())})


def _around(lists: pa.Table, vectors: pa.Table, threshold: float, kind: str) -> pa.Table:
    """Of the pairs around each vector of a block, one of them new there: (a, b, s) where b gets into a's list, for each vector as
    many as its list has room for, and links that join what all links found here join. ``vectors`` has each one's room and ``low``,
    what an entry of its list must exceed."""
    mid, new = lists["mid"].to_numpy(), lists["new"].to_numpy(zero_copy_only=False)
    cls, low, room = (vectors[c].to_numpy() for c in ("cls", "low", "room"))
    order = np.argsort(cls)
    cls, low, room = cls[order], low[order], room[order]
    x = _rows([vectors["v"][i].as_py() for i in order.tolist()], kind)
    at = np.searchsorted(cls, lists["cls"].to_numpy())
    order = np.argsort(mid, kind="stable")
    at, new = at[order], new[order]
    begin = np.flatnonzero(np.append(True, np.diff(mid[order]) != 0))
    size = np.diff(np.append(begin, len(at)))
    by = np.argsort(size, kind="stable")
    out: list[tuple] = []
    done = 0
    while done < len(by):
        # Vectors with lists of about one length are compared at once; shorter ones are filled up with a place that counts for nothing.
        width = int(size[by[done]])
        while True:
            n = max(1, min(PRODUCTS // max(width * width, width * x.shape[1]), len(by) - done))
            longest = int(size[by[done + n - 1]])
            if longest <= width * 1.25 + 1 or n == 1:
                break
            width = longest if PRODUCTS // max(longest * longest, longest * x.shape[1]) >= n // 2 else width + 1
        now = by[done : done + n]
        done += n
        width = int(size[now].max())
        place = np.minimum(begin[now][:, None] + np.arange(width), len(at) - 1)
        real = np.arange(width) < size[now][:, None]
        p, fresh = at[place], new[place] & real
        y = x[p]
        s = y @ y.transpose(0, 2, 1)
        ok = (p[:, :, None] < p[:, None, :]) & real[:, :, None] & real[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
        ok &= (s >= threshold) | (s > low[p][:, :, None]) | (s > low[p][:, None, :])
        m, i, j = np.nonzero(ok)
        a, b, s = p[m, i], p[m, j], s[m, i, j]
        _, once = np.unique(a * len(cls) + b, return_index=True)
        out.append((a[once], b[once], s[once]))
    a, b, s = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    _, once = np.unique(a * len(cls) + b, return_index=True)
    a, b, s = a[once], b[once], s[once]
    link = np.flatnonzero(s >= threshold)
    link = link[_joining(a[link], b[link], len(cls))]
    # Each vector's best, both ways.
    i, j, both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    gets = np.flatnonzero(both > low[i])
    gets = gets[np.lexsort((-both[gets], i[gets]))]
    rank = np.arange(len(gets)) - np.searchsorted(i[gets], i[gets])
    gets = gets[rank < room[i[gets]]]
    i, j, s = np.concatenate([i[gets], a[link]]), np.concatenate([j[gets], b[link]]), np.concatenate([both[gets], s[link]])
    return pa.table({"a": pa.array(cls[i], pa.int64()), "b": pa.array(cls[j], pa.int64()), "s": pa.array(s, pa.float64())})


def _block_links(t: pa.Table, threshold: float, kind: str) -> pa.Table:
    """Links of the members of two blocks of one component, counted with copies."""
    cls, side, copies, v = (t[c].to_pylist() for c in ("cls", "side", "copies", "v"))
    cls, copies, side = np.array(cls), np.array(copies, np.int64), np.array(side)
    dims = np.array([len(x) for x in v])
    out = np.zeros(len(cls), np.int64)
    for dim in np.unique(dims):
        here = dims == dim
        left, right = np.flatnonzero(here & (side != 1)), np.flatnonzero(here & (side != 0))
        if not len(left) or not len(right):
            continue
        a, b = (_rows([v[i] for i in at], kind) for at in (left, right))
        near = a @ b.T >= threshold
        near &= cls[left][:, None] != cls[right][None, :]
        out[left] += near @ copies[right]
        if (side != 2).any():  # two blocks: the other way too
            out[right] += near.T @ copies[left]
    return pa.table({"cls": pa.array(cls, pa.int64()), "links": pa.array(out, pa.int64())})


def _spokes(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector's cosine with its centre, the last two columns; vectors of another length get -2."""
    for b in batches:
        out = np.full(b.num_rows, -2.0)
        x, y = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        size = np.array([len(v) if len(v) == len(w) else 0 for v, w in zip(x, y)])
        for n in np.unique(size[size > 0]):
            at = np.flatnonzero(size == n)
            out[at] = np.einsum("ij,ij->i", _rows([x[i] for i in at], kind), _rows([y[i] for i in at], kind))
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out)], [*b.schema.names[:-2], "s"])


class Graph:
    """Stored tables are deleted when nothing reads them any more; what the result reads stays."""

    def __init__(self, rows: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", threshold: float = COSINE):
        self.threshold = threshold
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
        kinds = dict(rows.dtypes)
        self.spark, self.label = rows.sparkSession, kinds["label"]
        self.kind = "float32" if kinds["vec"] == "array<float>" else "float64"
        # A class is known by two hashes and named by the first; of classes that share that one all but one get another name.
        there = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
        first, second = F.xxhash64("label", "vec"), F.xxhash64(F.lit(1), "label", "vec")
        keyed = rows.select("id", F.when(there, first).alias("h1"), F.when(there, second).alias("h2"))
        classes = rows.where(there).groupBy(first.alias("h1"), second.alias("h2")).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
        self.whole = classes = store(classes, "classes")
        clash = classes.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo < hi").select("h1", "lo")
        if clash.isEmpty():
            name = lambda d: d.withColumn("cls", F.col("h1"))
        else:
            clash = store(clash, "clash")
            name = lambda d: d.join(clash, "h1", "left").withColumn("cls", F.when(F.col("lo").isNull() | (F.col("h2") == F.col("lo")), F.col("h1")).otherwise(F.xxhash64("h1", "h2")))
        self.named = name(keyed).select("id", "cls")
        classes = name(classes)
        kind = self.kind
        self.vectors = store(classes.select("cls", "label", "vec").mapInArrow(lambda it: _unit(it, kind), f"cls long, label {self.label}, v binary"), "vectors")
        self.classes = store(classes.select("cls", "rep", "copies").join(self.vectors.select("cls"), "cls", "left_semi"), "copies")

    def patterns(self, bits: int, tables: range) -> DataFrame:
        kind = self.kind
        return self.vectors.select("cls", "label", "v").mapInArrow(lambda it: _patterns(it, bits, tables, kind), f"cls long, label {self.label}, t int, dim int, code long")

    def sized(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the size of their label, which is small where it is not counted; sent to every task only if counted to be few."""
        large = self.vectors.groupBy("label").agg(F.count("*").alias("size")).where(f"size > {SMALL}")
        n = large.limit(BROADCAST_IDS + 1).count()
        rows = rows.join(F.broadcast(large) if n <= BROADCAST_IDS else large, "label", "left")
        return rows.withColumn("size", F.coalesce("size", F.lit(SMALL)))

    def first(self, bits: int, tables: range) -> DataFrame:
        """Edges (a < b, s) from shared sign patterns, each pattern compared in full."""
        # A label's patterns have as many of the bits as let some K of its vectors share one.
        own = F.least(F.greatest(F.lit(FEWEST), F.ceil(F.log2(F.col("size") / K))), F.lit(bits))
        p = self.sized(self.patterns(bits, tables)).withColumn("code", F.pmod("code", F.pow(F.lit(2.0), own).cast("long")))
        p = store(p.select("cls", F.xxhash64("label", "t", "dim", "code").alias("bucket")), "patterns")
        n = p.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        e = store(self.compared(p.join(n, "bucket").select("cls", "bucket", "n")), "edges")
        forget(p)
        return e

    def places(self, bits: int = 30) -> DataFrame:
        """(cls, blk): blocks of the rounds, of one label and length and alike in some sign bits, more of them the larger the label."""
        p = self.sized(self.patterns(bits, range(APART, APART + 1))).withColumn("most", F.lit(NUMBERS) / F.col("dim"))
        near = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / F.greatest("most", F.lit(64)))))
        p = p.withColumn("cell", F.xxhash64("label", "dim", F.pmod("code", F.pow(F.lit(2.0), F.least(near, F.lit(bits))).cast("long"))))
        n = p.groupBy("cell").agg(F.ceil(F.count("*") / F.greatest(F.lit(64), F.min("most"))).alias("parts"))
        p = p.select("cls", "cell").join(n, "cell")
        return p.select("cls", F.xxhash64("cell", F.pmod(F.xxhash64("cls", F.lit(3)), "parts")).alias("blk"))

    def spokes(self, members: DataFrame, group: str, order) -> DataFrame:
        """``members`` (with cls) with their group's centre, the first of it by ``order``, their cosine with it, and whether they
        are in the core: within half the threshold's angle, less what rounding may add."""
        kind = self.kind
        centre = store(members.groupBy(group).agg(F.min(F.struct(order.alias("o"), "cls")).alias("x")).select(group, F.col("x.cls").alias("centre")), "centres")
        v = self.vectors.select("cls", "v")
        x = members.join(centre, group).join(v, "cls").join(v.select(F.col("cls").alias("centre"), F.col("v").alias("cv")), "centre")
        kinds = ", ".join(f"{c} {t}" for c, t in x.drop("v", "cv").dtypes)
        half = math.cos(math.acos(self.threshold) / 2 - 1e-6)
        out = store(x.mapInArrow(lambda it: _spokes(it, kind), f"{kinds}, s double").withColumn("core", F.col("s") >= half), "spokes")
        forget(centre)
        return out

    def rim_blocks(self, m: DataFrame, group: str, size: int) -> DataFrame:
        """``m`` (with core and v) dealt so that every pair of a group with one of the rim in it meets in one task (g, i, j)."""
        n = m.groupBy(group).agg(*[F.ceil(F.count_if(x) / size).alias(c) for c, x in (("nr", ~F.col("core")), ("nc", F.col("core")))]).where("nr > 0")
        m = m.join(n, group)
        own = F.pmod(F.xxhash64("cls", F.lit(1)), F.when(F.col("core"), F.col("nc")).otherwise(F.col("nr")))
        m = m.withColumn("blk", own + F.when(F.col("core"), F.col("nr")).otherwise(F.lit(0)))
        m = m.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("core"), F.col("nr")).otherwise(F.col("nr") + F.col("nc")) - 1)))
        side = F.when(F.col("with") == F.col("blk"), 2).when(F.col("blk") < F.col("with"), 0).otherwise(1)
        m = m.withColumns({"i": F.least("blk", "with"), "j": F.greatest("blk", "with"), "side": side})
        return m.repartition(group, "i", "j")  # else all blocks of a group would stay where the join by group put them

    def compared(self, members: DataFrame) -> DataFrame:
        """The edges of (cls, bucket, n): of small buckets, many to a task, what ``_compare`` gives; of crowded ones the core's
        links with the centre, and what it gives for the rim."""
        m, t, f, kind = members, self.threshold, self.kind, "a long, b long, s double"
        v = self.vectors.select("cls", "v")
        pools = m.where(F.col("n") <= PART).count() // POOL + 1
        small = m.where(F.col("n") <= PART).join(v, "cls").select(F.pmod("bucket", F.lit(pools)).alias("g"), F.lit(2).alias("side"), "bucket", "cls", "v")
        e = small.groupBy("g").applyInArrow(lambda x: _compare(x, t, K, f), kind)
        crowd = m.where(F.col("n") > PART)
        if not crowd.isEmpty():
            crowd = self.spokes(crowd.select("cls", "bucket"), "bucket", F.xxhash64("cls", F.lit(2)))
            near = crowd.where((F.col("core") | (F.col("s") >= t)) & (F.col("cls") != F.col("centre")))
            e = e.union(near.select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b"), "s"))
            rim = self.rim_blocks(crowd.join(v, "cls"), "bucket", PART).select("bucket", "i", "j", "side", "cls", "v")
            e = e.union(rim.groupBy("bucket", "i", "j").applyInArrow(lambda x: _compare(x, t, K, f), kind))
        return e.groupBy("a", "b").agg(F.max("s").alias("s"))

    @staticmethod
    def lists(edges: DataFrame, turn: int = 0, threshold: float = 2.0) -> DataFrame:
        """(a, b, s, new): each vector's best ``K`` neighbours, and of links ``K`` more in every turn."""
        w = W.partitionBy("a").orderBy(F.col("s").desc(), F.xxhash64("a", "b"))
        ranked = edges.withColumn("r", F.row_number().over(w))
        return ranked.where((F.col("r") <= K) | ((F.col("s") >= threshold) & (F.col("r") <= K * (turn + 1)))).drop("r")

    def descend(self, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
        """Links (a < b) of the lists after the rounds, and those that joined what links a round came across."""
        t, kind = self.threshold, self.kind
        places = store(self.places(), "places")
        both = edges.select("a", "b", "s").union(edges.select("b", "a", "s")).withColumn("new", F.lit(True))
        near = store(self.lists(both, 0, t), "lists")
        links = [store(edges.where(F.col("s") >= t).select("a", "b"), "links")]
        for turn in range(rounds):
            # Of each neighbour's list and the lists it stands in, as many again at most, so no vector is a hub.
            back = self.lists(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "new"), turn, t)
            around = near.union(back).groupBy("a", "b").agg(F.max("new").alias("new"))
            around = around.join(around.where("new").select("a").distinct(), "a", "left_semi")
            around = store(around.join(places.withColumnRenamed("cls", "a"), "a").select("blk", F.col("a").alias("mid"), F.col("b").alias("cls"), "new"), "around")
            # Next turn's room of a list, and what an entry must exceed while it is full.
            full = F.count("*") >= F.when(F.min("s") >= t, K * (turn + 2)).otherwise(K)
            worst = near.groupBy("a").agg(F.when(F.min("s") >= t, K * (turn + 2)).otherwise(K).cast("long").alias("room"), F.when(full, F.min("s")).otherwise(-2.0).alias("low"))
            v = self.vectors.select("cls", "v").join(worst.withColumnRenamed("a", "cls"), "cls")
            v = around.select(F.col("blk").alias("at"), F.col("cls").alias("cls")).distinct().join(v, "cls")
            found = around.groupBy("blk").cogroup(v.groupBy("at")).applyInArrow(lambda x, y: _around(x, y, t, kind), "a long, b long, s double")
            found = store(found, "found")
            links.append(store(found.where(F.col("s") >= t).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"))
            both = near.select("a", "b", "s", F.lit(False).alias("new")).union(found.select("a", "b", "s", F.lit(True)))
            after = store(self.lists(both.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new")), turn + 1, t), "lists")
            forget(around, near, found)
            near = after
            # A list is still if nothing came in; saturated lists get longer whatever is found, so theirs does not count.
            state = near.groupBy("a").agg(F.count_if("new").alias("n"), F.count_if(F.col("new") & (F.col("s") >= t)).alias("links"), F.min("s").alias("low"))
            total, changed, fresh = state.agg(F.count("*"), F.count_if(F.col("n") > 0), F.sum(F.when(F.col("low") < t, F.col("links")))).first()
            if changed <= STILL * total or (turn > 0 and (fresh or 0) <= FEW * total):
                break
        both = links[0]
        for x in links[1:]:
            both = both.union(x)
        out = store(both.distinct(), "links")
        forget(places, near, *links)
        return out

    def counted(self, links: DataFrame) -> DataFrame:
        """(cls, comp, links, full): saturated lists enlarged to all members of the component."""
        comp = store(connected_components(links), "components")
        f = self.kind
        both = links.union(links.select("b", "a")).toDF("cls", "other")
        copies = self.classes.select(F.col("cls").alias("other"), "copies")
        plain = both.join(copies, "other").groupBy("cls").agg(F.count("*").alias("n"), F.sum("copies").alias("links"))
        plain = store(comp.withColumnRenamed("node", "cls").join(plain, "cls"), "plain")
        full = store(plain.groupBy("comp").agg(F.max("n").alias("most")).where(f"most >= {K}").select("comp"), "full")
        members = self.spokes(plain.select("cls", "comp", "n").join(full, "comp"), "comp", F.struct(-F.col("n"), F.xxhash64("cls")))
        m = members.join(self.classes.select("cls", "copies"), "cls")
        t = self.threshold
        core = m.where("core").groupBy("comp").agg(F.sum("copies").alias("sum"))
        inside = m.where("core").join(core, "comp").select("cls", (F.col("sum") - F.col("copies")).alias("links"))
        rim = self.rim_blocks(m.join(self.vectors.select("cls", "v"), "cls"), "comp", BLOCK).select("comp", "i", "j", "side", "cls", "copies", "v")
        exact = inside.union(rim.groupBy("comp", "i", "j").applyInArrow(lambda g: _block_links(g, t, f), "cls long, links long"))
        none = m.select("cls", F.lit(0).cast("long").alias("links"))
        exact = exact.union(none).groupBy("cls").agg(F.sum("links").alias("all"))
        out = store(plain.join(exact, "cls", "left").select("cls", "comp", F.coalesce("all", "links").alias("links"), F.col("all").isNotNull().alias("full")), "counted")
        forget(comp, plain, full, members)
        return out

    def audit(self, counted: DataFrame, size: int = AUDIT) -> float:
        """The mean share of its links that is found, over those of ``size`` vectors that have any; the smaller of the mean over
        members of saturated components, which are compared in full, and over all others."""
        q = self.vectors.join(self.classes.select("cls", "copies"), "cls").orderBy(F.xxhash64("cls", F.lit(7))).limit(size)
        asked = q.join(counted.select("cls", "links", "full"), "cls", "left").select("cls", "label", "v", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("full", F.lit(False)).alias("full")).collect()
        if not asked:
            return 1.0
        sent = self.spark.sparkContext.broadcast([(r["cls"], r["label"], bytes(r["v"])) for r in asked])
        t, kind = self.threshold, self.kind

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked: dict = {}
            for k, (_, label, x) in enumerate(sent.value):
                asked.setdefault((label, len(x)), []).append(k)
            known = np.array([c for c, *_ in sent.value])
            queries = {key: _rows([sent.value[k][2] for k in ks], kind) for key, ks in asked.items()}
            total = np.zeros(len(known), np.int64)
            for b in batches:
                cls, copies, v = b.column(0).to_numpy(), b.column(3).to_numpy(), b.column(2).to_pylist()
                here: dict = {}
                for i, (label, x) in enumerate(zip(b.column(1).to_pylist(), v)):
                    here.setdefault((label, len(x)), []).append(i)
                for key in here.keys() & queries.keys():
                    at, ks = np.array(here[key]), np.array(asked[key])
                    near = (queries[key] @ _rows([v[i] for i in at], kind).T >= t) & (known[ks][:, None] != cls[at])
                    total[ks] += near @ copies[at]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(known[some], pa.int64()), pa.array(total[some])], ["cls", "n"])

        all_ = self.vectors.join(self.classes.select("cls", "copies"), "cls").select("cls", "label", "v", "copies")
        true = {r["cls"]: r["n"] for r in all_.mapInArrow(against, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n")).collect()}
        shares = [[min(1.0, r["links"] / true[r["cls"]]) for r in asked if r["cls"] in true and r["full"] == f] for f in (False, True)]
        return min((float(np.mean(x)) for x in shares if x), default=1.0)

    def run(self) -> tuple[DataFrame, float]:
        """((cls, comp, links), recall)."""
        largest = self.vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        bits, tables = _plan(largest, self.threshold)
        while True:
            edges = self.first(bits, range(tables))
            links = self.descend(edges)
            out = self.counted(links)
            forget(edges, links)
            recall = self.audit(out)
            if recall >= RECALL:
                return out, recall
            forget(out)
            if tables > MOST:
                break
            tables *= 2
        # Patterns do not find the links of this table: all vectors of each label are compared.
        size = self.vectors.groupBy("label").agg(F.count("*").alias("n"))
        all_ = self.vectors.join(size, "label").select("cls", F.xxhash64("label").alias("bucket"), "n")
        links = store(self.compared(all_).where(F.col("s") >= self.threshold).select("a", "b"), "links")
        out = self.counted(links)
        forget(links)
        return out, self.audit(out)

    def result(self) -> DataFrame:
        """(id, n_links, component_id, kept) for every row."""
        counted, self.recall = self.run()
        c = self.classes.join(counted, "cls", "left").select("cls", "rep", "copies", F.coalesce("comp", "cls").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
        low = c.groupBy("comp").agg(F.min("rep").alias("component_id"))
        c = store(c.join(low, "comp").select("cls", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "result")
        forget(counted, self.classes, self.vectors, self.whole)
        r = self.named.join(c, "cls", "left")
        r = r.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        return r.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(table(spark, sf_dir, "embeddings")).result().withColumnRenamed("id", "vec_id")
