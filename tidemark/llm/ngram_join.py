"""Jaccard self-join on word n-grams: rare-first prefix filter, then length, positional and suffix filters, one check per pair.

Documents with equal n-gram sets are one class, named by 128 bits; classes are joined. N-grams are ordered by the number of
classes that have them, counted over all documents: every n-gram is dealt to a bucket by its hash (five bytes each and the
class's place in its batch), counted there, and those that two classes or more have go back to their batch. A class whose own
n-grams fill its prefix has no partner and is out; of the others only the shared part of the prefix becomes postings. N-grams so
frequent that they would swell one bucket are counted by a bounded list of heavy ones beforehand and are not dealt at all. Two
n-grams that get one five-byte name in one bucket are taken for one n-gram in the order; that can add a candidate but lose none.

A pair is looked for at the first n-gram of the order that both classes have: there the overlap is at most the rest of either set,
which is the positional filter and holds the length filter. Pairs are never made of whole lists: in each n-gram one class is the
hub and the others are compared with it, which is linear, in ``TURNS`` rounds with other hubs. What is left, classes of one
n-gram that are not known to be connected, is compared in full: lists with the same hub share a task, large ones are cut into
blocks by bytes, each class's set goes to a task once, and a task returns no more links than classes, those that join something.
So no link between groups is lost; inside a group that is already connected no more links are looked for.

Defined cases: null and empty texts have no n-grams and are a group of their own; fewer words than ``n`` are one n-gram; repeated
rows are in one group; an id with several texts is in the group of each; the component id is the smallest id of the group; classes
of which all ids are null are compared with nothing and have a null component id; an empty table gives an empty result; extra
columns are ignored; texts may be as long as memory holds one text's set.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .base import connected_components, forget, only, store, table, without
from .kernel import LOWER, U, mix, shingles, slices, span_hash, strings, trim, words

#: Words of an n-gram; least intersection as a share of the union, in hundredths.
WORDS, LEAST = 5, 75
#: N-grams that a task deals out at once, and those of a bucket, at least (it grows with the root of their number); fewest buckets.
DEAL, BUCKETS = 1 << 20, 12
#: An n-gram is heavy in a batch if this share of its classes have it, and ``HEAVY_LEAST`` of them; it is not dealt if ``HEAVY``
#: classes have it. Where more than ``HEAVY_MOST`` are so frequent (the list is broadcast), the rest only make larger buckets.
HEAVY_SHARE, HEAVY_LEAST, HEAVY, HEAVY_MOST = 64, 32, 1 << 18, 1 << 17
#: Rounds of hubs; bytes of sets in a block; cells of the suffix filter.
TURNS, BLOCK, CELLS = 2, 4 << 20, 128
#: Classes of one hub in a block, as long as that makes no more blocks than ``SHARED``.
APART, SHARED = 256, 16
#: Bytes of an n-gram's name in its bucket.
NAME = 5


def _sets(b: pa.RecordBatch, col: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes)."""
    data, off = strings(b.column(col))
    for i, j in slices(off):
        d = LOWER[data[off[i] : off[j]]]
        s, e, first = words(d, off[i : j + 1] - off[i])
        x, xo = shingles(span_hash(d, s, e), first, k)
        for r in range(j - i):
            yield i + r, np.unique(x[xo[r] : xo[r + 1]])


def class_of(u: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    if not len(u):
        return bytes(16)
    with np.errstate(over="ignore"):
        two = [mix(u + U(0x1234567)).sum(dtype=U), mix(u ^ U(0x9E3779B97F4A7C15)).sum(dtype=U)]
    return blake2b(np.array([*two, len(u)], U).tobytes(), digest_size=16).digest()


def prefix_length(n, least: int = LEAST):
    return n + (-least * n) // 100 + 1


_SCAN = "kind int, id long, n int, cls binary, h long, m long"
_SCAN_ARROW = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("h", pa.int64()), ("m", pa.int64())])


def _heavy(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that a large share of these sets has, and how many have each."""
    least = max(least, len(sets) // HEAVY_SHARE)
    h = np.concatenate(sets)
    cell = (h & U(0xFFFF)).astype(np.int64)
    h, m = np.unique(h[np.bincount(cell, minlength=1 << 16)[cell] >= least], return_counts=True)
    return h[m >= least].astype(np.int64), m[m >= least]


def _scan(batches: Iterator[pa.RecordBatch], k: int, deal: int, often: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 tell each row's class; rows of kind 1 count n-grams that many classes of one batch have."""

    def rows(kind: int, count: int, **cols) -> pa.RecordBatch:
        full = {"kind": [kind] * count} | cols
        return pa.RecordBatch.from_arrays([pa.array(full.get(f.name, [None] * count), f.type) for f in _SCAN_ARROW], schema=_SCAN_ARROW)

    hold: dict[bytes, np.ndarray] = {}
    size = 0
    for b in batches:
        n, cls = [], []
        for _, u in _sets(b, 1, k):
            n.append(len(u))
            cls.append(class_of(u))
            if len(u) and cls[-1] not in hold:
                hold[cls[-1]] = u
                size += len(u)
            if size >= deal:
                h, m = _heavy(list(hold.values()), often)
                yield rows(1, len(h), h=h, m=m)
                hold, size = {}, 0
        yield rows(0, len(n), id=b.column(0).to_pylist(), n=n, cls=cls)
    if hold:
        h, m = _heavy(list(hold.values()), often)
        yield rows(1, len(h), h=h, m=m)
    trim()


_DEALT = "bucket int, batch long, name binary, who binary, cls binary, n binary, heavy binary"
_DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("name", "who", "cls", "n", "heavy")]])


def _split(x: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """One binary value for each range of items of ``width`` bytes; ``at`` has the starts and the end."""
    off = (at * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])


def _join(col: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all items, number of items of each row) of a binary column without nulls."""
    parts = [np.frombuffer(x, kind) for x in col.to_pylist()]
    return np.concatenate([*parts, np.zeros(0, kind)]), np.array([len(x) for x in parts], np.int64)


def _name(b: np.ndarray) -> np.ndarray:
    """Numbers from their ``NAME`` bytes."""
    out = np.zeros((len(b) // NAME, 8), np.uint8)
    out[:, :NAME] = b.reshape(-1, NAME)
    return out.reshape(-1).view(U)


def _deal(batches: Iterator[pa.RecordBatch], heavy, buckets: int, k: int, deal: int) -> Iterator[pa.RecordBatch]:
    """N-grams by bucket, for every batch of classes; and each batch's classes, which travel through a bucket unread.

    A batch is named by its classes, so a task that runs again deals the same."""
    known = heavy.value
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    hold: dict[bytes, np.ndarray] = {}
    size = number = 0

    def dealt() -> pa.RecordBatch:
        cls = sorted(hold)
        n = np.array([len(hold[c]) for c in cls], np.uint32)
        h, who = np.concatenate([hold[c] for c in cls]), np.repeat(np.arange(len(cls), dtype=np.uint16), n)
        batch = int.from_bytes(blake2b(b"".join(cls) + b"%d %d" % (task, number), digest_size=8).digest(), "little", signed=True)
        own = b""
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hot = known[at] == h
            own = np.stack([who[hot].astype(U), at[hot].astype(U)], 1).tobytes()
            h, who = h[~hot], who[~hot]
        to = ((h >> U(8 * NAME)) % U(buckets)).astype(np.uint16 if buckets <= 65536 else np.int32)
        order = np.argsort(to, kind="stable")
        h, who, to = h[order], who[order], to[order]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        ends = np.append(at, len(to))
        cells = [pa.array(to[at].astype(np.int32)), pa.array([batch] * len(at), pa.int64()), _split(h.view(np.uint8).reshape(-1, 8)[:, :NAME], ends, NAME), _split(who, ends, 2)]
        cells += [pa.nulls(len(at), pa.binary())] * 3
        about = [[batch % buckets], [batch], [None], [None], [b"".join(cls)], [n.tobytes()], [own]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.array(a, f.type)]) for c, a, f in zip(cells, about, _DEALT_ARROW)], schema=_DEALT_ARROW)

    for b in batches:
        for _, u in _sets(b, 0, k):
            if not len(u):
                continue
            c = class_of(u)
            if c not in hold:
                hold[c] = u
                size += len(u)
            if size >= deal or len(hold) == 60_000:
                yield dealt()
                hold, size, number = {}, 0, number + 1
    if hold:
        yield dealt()
    trim()


_COUNTED = "bucket int, batch long, name binary, who binary, df binary, cls binary, n binary, heavy binary"
_COUNTED_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("name", "who", "df", "cls", "n", "heavy")]])


def _count(t: pa.Table) -> pa.Table:
    """For each batch the n-grams of this bucket that two classes or more have, with the number of those."""
    about = t.filter(t["cls"].is_valid())
    cells = t.filter(t["name"].is_valid())
    raw, size = _join(cells["name"], np.uint8)
    name, size = _name(raw), size // NAME
    who, _ = _join(cells["who"], np.uint16)
    # Sorted by name with the entry's place in the low bits, where that fits; else by way of an index.
    if len(name) <= 1 << 24:
        x = np.sort(name << U(24) | np.arange(len(name), dtype=U))
        entry, name = (x & U(0xFFFFFF)).astype(np.int64), x >> U(24)
    else:
        entry = np.argsort(name, kind="stable")
        name = name[entry]
    start = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    run = np.diff(np.append(start, len(name)))
    df = np.repeat(run, run)
    many = df > 1
    entry, name, df = entry[many], name[many], df[many].astype(np.uint32)
    back = np.argsort(entry)
    entry, name, df = entry[back], name[back], df[back]
    ends = np.searchsorted(entry, np.append(0, np.cumsum(size)))
    cells = cells.combine_chunks()
    none = pa.nulls(len(cells), pa.binary())
    out = [cells["bucket"].combine_chunks(), cells["batch"].combine_chunks(), _split(name.view(np.uint8).reshape(-1, 8)[:, :NAME], ends, NAME), _split(who[entry], ends, 2), _split(df, ends, 4), none, none, none]
    out = pa.Table.from_arrays(out, schema=_COUNTED_ARROW)
    out = out.filter(pa.array(np.diff(ends) > 0))
    rest = pa.Table.from_arrays([about[f.name] if f.name in about.column_names else pa.nulls(len(about), f.type) for f in _COUNTED_ARROW], schema=_COUNTED_ARROW)
    return pa.concat_tables([out, rest])


_POSTINGS = "h long, cls binary, n int, pos int"


def _prefixes(t: pa.Table, heavy, least: int) -> pa.Table:
    """The prefix n-grams that others have too, of each class of a batch, with their places in the set's order."""
    about = t.filter(t["cls"].is_valid())
    if len(about) != 1:
        raise RuntimeError("a batch of n-grams came without its classes, or with several lists of them")
    cells = t.filter(t["name"].is_valid())
    raw, size = _join(cells["name"], np.uint8)
    name = _name(raw) | np.repeat(cells["bucket"].to_numpy().astype(U), size // NAME) << U(8 * NAME)
    who, _ = _join(cells["who"], np.uint16)
    df, _ = _join(cells["df"], np.uint32)
    df, who, name = df.astype(np.int64), who.astype(np.int64), name.astype(np.int64)
    own = np.frombuffer(about["heavy"][0].as_py(), U).reshape(-1, 2).astype(np.int64)
    if len(own):  # heavy ones come after all others, by their place in the list; their names are negative
        df, who, name = np.append(df, own[:, 1] + (1 << 40)), np.append(who, own[:, 0]), np.append(name, -1 - own[:, 1])
    cls, n = about["cls"][0].as_py(), np.frombuffer(about["n"][0].as_py(), np.uint32).astype(np.int64)
    order = np.lexsort((name, df, who))
    who, name = who[order], name[order]
    many = np.bincount(who, minlength=len(n))
    pos = n[who] - many[who] + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    keep = pos < prefix_length(n[who], least)
    who, name, pos = who[keep], name[keep], pos[keep]
    names = pa.array([cls[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary())
    return pa.table({"h": pa.array(name), "cls": names.take(pa.array(who)), "n": pa.array(n[who], pa.int32()), "pos": pa.array(pos, pa.int32())})


def _kind(n: int):
    """The smallest type that holds a cell's count."""
    return np.uint8 if n < 256 else np.uint16 if n < 65536 else np.uint32


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams of each set fall into each cell of the hash range."""
    out = np.empty((len(sets), CELLS), _kind(max(map(len, sets), default=0)))
    for i, u in enumerate(sets):
        out[i] = np.bincount((u >> U(57)).astype(np.int64), minlength=CELLS)
    return out


def _similar(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= least * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets those that link: the suffix filter, then the sets."""
    for b in batches:
        x, y = ([np.frombuffer(s, U) for s in b.column(c).to_pylist()] for c in ("ga", "gb"))
        sizes = np.array([len(u) + len(v) for u, v in zip(x, y)], np.int64)
        ok = (100 + least) * np.minimum(_counts(x), _counts(y)).sum(1, dtype=np.int64) >= least * sizes
        for i in np.flatnonzero(ok):
            ok[i] = _similar(x[i], y[i], least)
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    trim()


def _whole(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, sets = [], []
        for _, u in _sets(b, 0, k):
            cls.append(class_of(u))
            sets.append(u.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["cls", "grams"])
    trim()


def _candidates(t: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a task that pass the positional filter in one n-gram and whose labels differ, list by list.

    Rows are classes with ``at`` (n-gram and place, two numbers each). In a task of two blocks only pairs across them count."""
    n, blk = t["n"].to_numpy().astype(np.int64), t["blk"].to_numpy()
    label = pa.compute.index_in(t["label"], t["label"].unique()).to_numpy()
    at, size = _join(t["at"], np.int64)
    at, row = at.reshape(-1, 2), np.repeat(np.arange(len(n)), size // 2)
    order = np.lexsort((n[row], at[:, 0]))
    h, row = at[order, 0], row[order]
    size = n[row]
    rest = size - at[order, 1]
    across = bool((blk != blk[0]).any())
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    for lo, hi in zip(start, np.append(start[1:], len(h))):
        if hi - lo < 2 or (label[row[lo:hi]] == label[row[lo]]).all():
            continue
        most = ((100 + least) * rest[lo:hi] - least * size[lo:hi]) // least  # the largest partner
        for a in range(lo, hi, 256):
            z = min(a + 256, hi)
            end = lo + int(np.searchsorted(size[lo:hi], most[a - lo : z - lo].max(), "right"))
            if end <= a:
                continue
            i, j = np.arange(a, z)[:, None], np.arange(a, end)[None, :]
            ok = (i < j) & ((100 + least) * np.minimum(rest[i], rest[j]) >= least * (size[i] + size[j]))
            ok &= label[row[i]] != label[row[j]]
            if across:
                ok &= blk[row[i]] != blk[row[j]]
            x, y = np.nonzero(ok)
            if len(x):
                yield row[a + x], row[a + y]


def _near(t: pa.Table, least: int) -> pa.Table:
    """The classes of a task that have a candidate."""
    hit = np.zeros(len(t), bool)
    for x, y in _candidates(t, least):
        hit[x] = hit[y] = True
    return t.select(["g", "cls"]).filter(pa.array(hit))


def _prove(t: pa.Table, least: int) -> pa.Table:
    """Links that join what is not joined yet: at most one less than classes. Each pair is looked at once."""
    sets = [np.frombuffer(s, U) for s in t["grams"].to_pylist()]
    cells = _counts(sets)
    n = np.array([len(s) for s in sets], np.int64)
    root = pa.compute.index_in(t["label"], t["label"].unique()).to_numpy().astype(np.int64)
    seen = np.zeros(0, np.int64)
    out: list[tuple[int, int]] = []
    for x, y in _candidates(t, least):
        code = np.unique(np.minimum(x, y) * len(n) + np.maximum(x, y))
        if len(seen):
            code = code[seen[np.minimum(np.searchsorted(seen, code), len(seen) - 1)] != code]
        seen = np.union1d(seen, code) if len(seen) < 1 << 22 else code  # forgotten pairs are only looked at again
        for q in range(0, len(code), 1 << 14):
            x, y = np.divmod(code[q : q + (1 << 14)], len(n))
            ok = (100 + least) * np.minimum(cells[x], cells[y]).sum(1, dtype=np.int64) >= least * (n[x] + n[y])
            for i, j in zip(x[ok].tolist(), y[ok].tolist()):
                if root[i] != root[j] and _similar(sets[i], sets[j], least):
                    root[root == root[j]] = root[i]
                    out.append((i, j))
    i, j = (pa.array([p[c] for p in out], pa.int64()) for c in (0, 1))
    return pa.table({"a": t["cls"].take(i), "b": t["cls"].take(j)})


class Join:
    """The classes of a table of documents and the links between them.

    ``deal``, ``heavy`` and ``often`` (the least count of a batch that is told), ``block`` and ``turns`` change how the work is
    laid out, never the result."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: int = LEAST,
        *, deal: int = DEAL, heavy: int = HEAVY, often: int = HEAVY_LEAST, block: int = BLOCK, turns: int = TURNS,
    ):
        self.k, self.least, self.deal, self.heavy_at, self.block, self.turns = k, least, deal, heavy, block, turns
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.scanned = store(self.docs.mapInArrow(lambda it: _scan(it, k, deal, often), _SCAN), "grams")
        self.rows = self.scanned.where("kind = 0").select("id", "n", "cls")
        c = self.rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"))
        self.classes = store(c, "classes")

    def representatives(self) -> DataFrame:
        """(id, text) of one document per class; ids that come with several texts may add more."""
        copies = self.rows.join(self.classes.where("copies > 1").select("cls", "rep"), "cls").where("id <> rep").select("id").distinct()
        # An id that stands for another of its texts stays.
        copies = copies.join(self.classes.select(F.col("rep").alias("id")), "id", "left_anti")
        return without(self.docs.where("id IS NOT NULL"), copies, "id")

    def heavy(self) -> np.ndarray:
        """The sorted hashes of n-grams that are not dealt."""
        m = self.scanned.where("kind = 1").groupBy("h").agg(F.sum("m").alias("m")).where(F.col("m") >= self.heavy_at)
        got = m.orderBy(F.desc("m"), "h").limit(HEAVY_MOST).select("h").collect()  # at most HEAVY_MOST numbers
        return np.sort(np.array([r["h"] for r in got], np.int64).view(U))

    def postings(self) -> DataFrame:
        """(h, cls, n, pos) of n-grams that two classes have in their prefixes' shared parts."""
        k, least, deal = self.k, self.least, self.deal
        total = self.classes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
        buckets = min(max(BUCKETS, int(total // max(deal, 4 * total**0.5))), 1 << 23)
        heavy = self.docs.sparkSession.sparkContext.broadcast(self.heavy())
        d = self.representatives().select("text").mapInArrow(lambda it: _deal(it, heavy, buckets, k, deal), _DEALT)
        c = d.groupBy("bucket").applyInArrow(_count, _COUNTED)
        p = store(c.groupBy("batch").applyInArrow(lambda t: _prefixes(t, heavy, least), _POSTINGS), "prefixes")
        many = p.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("h")
        many = store(many, "many")
        out = store(p.join(many, "h", "left_semi").distinct(), "postings")
        forget(p, many)
        return out

    def sets(self, posts: DataFrame) -> DataFrame:
        """(cls, grams) of every class with postings, read from its representative's text."""
        who = store(posts.select("cls").distinct(), "who")
        ids = self.classes.join(who, "cls", "left_semi").select(F.col("rep").alias("id"))
        k = self.k
        texts = only(self.docs, ids.distinct(), "id").select("text").mapInArrow(lambda it: _whole(it, k), "cls binary, grams binary")
        out = store(texts.join(who, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
        forget(who)
        return out

    def links(self) -> DataFrame:
        """Links (a, b) between classes that join the same classes as all links do."""
        posts = self.postings()
        sets = self.sets(posts)
        found = tried = label = None
        for turn in range(self.turns):
            p = posts if label is None else self._apart(posts, label)
            new = self._pairs(p, turn, tried)
            links = self._check(new, sets)
            found = links if found is None else found.union(links)
            tried = new.select("a", "b") if tried is None else tried.union(new.select("a", "b"))
            label = self._labels(found)
        out = store(found.union(self._rest(self._apart(posts, label), sets)), "links")
        forget(posts, sets)
        return out

    def _pairs(self, p: DataFrame, turn: int, tried: DataFrame | None) -> DataFrame:
        """Each class of a list with the list's hub, where the place of the n-gram allows the similarity; each pair once."""
        least = self.least
        hub = p.groupBy("h").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("o"), "cls", "n", "pos")).alias("x"))
        hub = store(hub.select("h", F.col("x.cls").alias("cls2"), F.col("x.n").alias("n2"), F.col("x.pos").alias("pos2")), "hubs")
        left = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
        c = p.join(hub, "h").where((F.col("cls") != F.col("cls2")) & ((100 + least) * left >= least * (F.col("n") + F.col("n2"))))
        c = c.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()
        out = store(c if tried is None else c.join(tried, ["a", "b"], "left_anti"), "pairs")
        forget(hub)
        return out

    def _check(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        least = self.least
        x = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
        x = x.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")
        return store(x.mapInArrow(lambda it: _verify(it, least), "a binary, b binary"), "found")

    def _blocks(self, p: DataFrame) -> DataFrame:
        """Rows (g, cls, n, label, at) dealt to the tasks (g, i, j): each pair of a hub's blocks meets in one task."""
        # By bytes, and for groups that would fit into one task by classes, so that several tasks share them.
        blocks = F.greatest(F.ceil(F.sum(F.lit(8) * F.col("n")) / self.block), F.least(F.ceil(F.count("*") / APART), F.lit(SHARED)))
        nb = p.groupBy("g").agg(blocks.cast("int").alias("nb"))
        p = p.join(nb, "g").withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("nb")).cast("int"))
        p = p.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        return p.select("g", F.least("blk", "with").alias("i"), F.greatest("blk", "with").alias("j"), "cls", "n", "label", "at", "blk")

    def _rest(self, p: DataFrame, sets: DataFrame) -> DataFrame:
        """The links between differently labelled classes of one n-gram, a spanning forest for each task."""
        least = self.least
        hub = p.groupBy("h").agg(F.min(F.struct(F.xxhash64("cls", F.lit(self.turns)).alias("o"), "cls")).alias("x"))
        hub = store(hub.select("h", F.col("x.cls").alias("g")), "hubs")
        p = p.join(hub, "h").groupBy("g", "cls").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list(F.struct("h", "pos")).alias("at"))
        p = store(p.mapInArrow(_pack, "g binary, cls binary, n int, label binary, at binary"), "lists")
        # Dealt anew by block: the join by hub would leave all blocks of one hub in one task.
        blocks = self._blocks(p).repartition("g", "i", "j")
        near = store(blocks.groupBy("g", "i", "j").applyInArrow(lambda t: _near(t, least), "g binary, cls binary").distinct(), "near")
        left = self._blocks(p.join(near, ["g", "cls"], "left_semi")).join(sets, "cls").repartition("g", "i", "j")
        out = store(left.groupBy("g", "i", "j").applyInArrow(lambda t: _prove(t, least), "a binary, b binary"), "found")
        forget(hub, p, near)
        return out

    @staticmethod
    def _labels(links: DataFrame) -> DataFrame:
        """(cls, label): classes with one label are connected; some that are connected may have two."""
        # The smallest name within three steps: all of a hub's neighbours get the same, whichever of them has it.
        both = store(links.union(links.select("b", "a")).toDF("cls", "other"), "both")
        label = both.groupBy("cls").agg(F.min("other").alias("m")).select("cls", F.least("cls", "m").alias("label"))
        for _ in range(2):
            near = both.join(label.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.min("label").alias("label"))
            label = near
        out = store(label, "label")
        forget(both)
        return out

    @staticmethod
    def _apart(posts: DataFrame, label: DataFrame) -> DataFrame:
        """The postings of n-grams that hold classes with different labels."""
        p = posts.join(label, "cls", "left").select("h", "cls", "n", "pos", F.coalesce("label", "cls").alias("label"))
        p = store(p, "labelled")
        many = store(p.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h"), "many")
        out = store(p.join(many, "h", "left_semi"), "apart")
        forget(p, many)
        return out

    def components(self) -> DataFrame:
        """(cls, component_id) for every class."""
        links = self.links()
        comp = store(connected_components(links), "components")
        of = self.classes.join(comp, self.classes["cls"] == comp["node"], "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
        low = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
        out = store(of.join(low, "comp").select("cls", "component_id"), "classes")
        forget(links, comp)
        return out

    def groups(self) -> DataFrame:
        """(id, n_shingles, component_id, cls) for every document."""
        r = self.rows.join(self.components(), "cls", "left")
        own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        return r.select("id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "cls")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of (n-gram, place) as bytes."""
    for b in batches:
        at = b.column(4)
        flat = at.flatten()
        x = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)], 1)
        ends = np.append(0, np.cumsum(at.value_lengths().to_numpy()))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], _split(x, ends, 16)], ["g", "cls", "n", "label", "at"])


def _named(batches: Iterator[pa.RecordBatch], col: int, name: str, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls = [class_of(u) for _, u in _sets(b, col, k)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls, pa.binary())], [*b.schema.names, name])
    trim()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: of its smallest (id, class) the smallest text. Rows without an id or without n-grams
    all stay. An id decides where it occurs once; of ids that occur more than once each text is judged by itself, so a text goes
    only if a row of its own group stays."""
    groups = store(Join(docs, id_col, text_col).groups(), "groups")
    again = store(groups.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"), "again")
    go = groups.where("id <> component_id").select("id").union(again).distinct().withColumnRenamed("id", id_col)
    go = store(go, "copies")
    out = without(docs, go, id_col)
    if not again.isEmpty():
        name = "_cls"
        while name in docs.columns:
            name += "_"
        k, col, columns = WORDS, docs.columns.index(text_col), docs.columns
        schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
        rows = only(docs, again.withColumnRenamed("id", id_col), id_col).mapInArrow(lambda it: _named(it, col, name, k), schema)
        first = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("id", "cls")).alias("x"))
        first = store(first.select(F.col("x.id").alias(id_col), F.col("x.cls").alias(name)), "first")
        one = rows.join(first, [id_col, name], "left_semi").groupBy(id_col, name).agg(F.min_by(F.struct(*columns), text_col).alias("x")).select("x.*")
        none = rows.where(F.col(name) == F.lit(bytes(16))).select(*columns)
        out = out.unionByName(one).unionByName(none)
    return out


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join(table(spark, sf_dir, "documents")).groups().select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
