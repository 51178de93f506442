"""Benchmark decontamination: a broadcast hash set of the test items' word windows against every window of the training texts.

Words are runs of ASCII letters (lower-cased), digits and all characters beyond ASCII. A window is ``WINDOW`` consecutive words of
an item; an item of fewer words is one window of that length. The items' windows become one sorted array of 64-bit hashes behind
a bit table; a task hashes the words of a slice of texts, rolls the hashes over windows of every length that occurs, and looks all
of them up at once. What the hash set lets through is verified word by word on the bytes. Hit windows mark words, runs of marked
words are spans, and spans or whole documents are removed.

Only a block of items of at most ``ROOM`` bytes of text is ever broadcast. Items are cut first, on executors, into pieces of at most
``PIECE`` words that overlap by a window less one word, so no single item is too large. If all pieces fit one block, as benchmarks
do, texts are read once and nothing is shuffled. Otherwise pieces are dealt into as many blocks as are needed (sizes are counted
before anything is collected), texts are read once for each block, only texts with hits are kept, under their digest, and the
marks of all blocks are united there. Every window of every item is looked for in both ways.

Memory of a task is one slice of texts, or one text: some 16 bytes a byte of text for hashes of a megabyte at a time, and some
50 bytes a word.

Defined cases: null and empty texts have no words and no hits, and a null text stays null; items without words are not looked for;
items without an id mark words but are in no list; an id on several items, and a repeated item, counts once; repeated rows are
repeated; an empty table on either side gives no hits; a text of any length is read whole; extra columns are kept by ``clean``,
whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import forget, store, table
from .kernel import LOWER, SLICE, U, mix, slices, span_hash, strings, trim, words

WINDOW = 10
#: Bytes of items broadcast at once, words of a piece of an item, places of the bit table for each window, hits verified at once.
ROOM, PIECE, BITS, VERIFIED = 8 << 20, 20_000, 16, 1 << 16
#: Bytes that words consist of.
WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
with np.errstate(over="ignore"):
    _MUL = mix(np.arange(1, 65, dtype=U) * U(0x9FB21C651E98DF25)) | U(1)
SPANS = "array<struct<first:int,last:int,start:int,end:int>>"
HITS = f"n_words long, items array<string>, spans {SPANS}"


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, of some ``SLICE`` bytes at a time."""
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE)))
        a = starts[i]
        out[i:j] = span_hash(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words."""
    m = max(len(h) - k + 1, 0)
    out = np.zeros(m, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + m] * _MUL[j]
        return mix(out + U(k))


class Windows(NamedTuple):
    """The windows of one length: sorted hashes, a place in the items' words for each, and the items that hold it."""

    size: int
    hashes: np.ndarray
    word: np.ndarray
    at: np.ndarray  # where a window's items begin in ``items``; one more at the end
    items: np.ndarray
    bits: np.ndarray


class Index(NamedTuple):
    """The windows of a block of items. Words are byte ranges of ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: list[str | None]
    windows: list[Windows]


def index(ids: list[str | None], texts: list[str | None], window: int = WINDOW) -> Index:
    """The distinct windows of some items."""
    data, off = strings(pa.array(texts, pa.string()))
    data = lowered(data)
    starts, ends, first = words(data, off, WORD)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    out = []
    for k in np.unique(np.minimum(count[count > 0], window)).tolist():
        of = np.flatnonzero(count >= k if k == window else count == k)
        per = count[of] - k + 1
        place = np.repeat(first[of] - np.cumsum(per) + per, per) + np.arange(per.sum())
        item = np.repeat(of, per)
        key = runs(h, k)[place]
        order = np.lexsort((item, key))
        key, place, item = key[order], place[order], item[order]
        # Equal hashes are one window if their words are the same; the very rare others stand side by side.
        text = [b" ".join([data[a:b].tobytes() for a, b in zip(starts[p : p + k], ends[p : p + k])]) for p in place.tolist()]
        if any(x == y and s != t for x, y, s, t in zip(key, key[1:], text, text[1:])):
            order = np.array(sorted(range(len(text)), key=lambda i: (int(key[i]), text[i], int(item[i]))))
            key, place, item, text = key[order], place[order], item[order], [text[i] for i in order]
        new = np.array([True] + [s != t for s, t in zip(text, text[1:])])
        again = ~new & np.append(False, item[1:] == item[:-1])
        window_of = np.cumsum(new) - 1
        at = np.searchsorted(window_of[~again], np.arange(new.sum() + 1))
        size = 1 << int(max(new.sum() * BITS, 1 << 17)).bit_length()
        bits = np.zeros(size, bool)
        bits[(key & U(size - 1)).astype(np.int64)] = True
        out.append(Windows(k, key[new], place[new], at, item[~again], bits))
    return Index(data, starts, ends, ids, out)


def _same(x: Index, k: int, there: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether the ``k`` words of the items at ``there`` are those of the texts at ``here``, by length and then by byte."""
    step = np.arange(k)
    a, b = (there[:, None] + step).ravel(), (here[:, None] + step).ravel()
    size = ends[b] - starts[b]
    out = (x.ends[a] - x.starts[a] == size).reshape(-1, k).all(axis=1)
    left = np.flatnonzero(out)
    if len(left):
        w = (left[:, None] * k + step).ravel()
        n = size[w]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = x.data[np.repeat(x.starts[a[w]], n) + within] != data[np.repeat(starts[b[w]], n) + within]
        bad = np.repeat(np.repeat(left, k), n)[differ]
        out[bad] = False
    return out


def _hits(x: Index, w: Windows, h: np.ndarray, doc: np.ndarray, first: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, windows) of verified hits."""
    key = runs(h, w.size)
    maybe = np.flatnonzero(w.bits[(key & U(len(w.bits) - 1)).astype(np.int64)])
    maybe = maybe[maybe + w.size <= first[doc[maybe] + 1]]  # not over a text's end
    low, high = np.searchsorted(w.hashes, key[maybe], "left"), np.searchsorted(w.hashes, key[maybe], "right")
    n = high - low
    place, at = np.repeat(maybe, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    for i in range(0, len(place), VERIFIED):
        p, a = place[i : i + VERIFIED], at[i : i + VERIFIED]
        ok = _same(x, w.size, w.word[a], data, starts, ends, p)
        yield p[ok], a[ok]


def scan(data: np.ndarray, off: np.ndarray, x: Index) -> list[tuple[int, list[str], list[dict]]]:
    """(words, ids of the items with windows in it, spans) of each text. A span is a run of hit words: the first and last word's
    number, and code points, end exclusive."""
    low = lowered(data)
    starts, ends, first = words(low, off, WORD)
    h = word_hashes(low, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    cover = np.zeros(len(starts) + 1, np.int32)
    pairs = []
    for w in x.windows:
        for place, at in _hits(x, w, h, doc, first, low, starts, ends):
            np.add.at(cover, place, 1)
            np.add.at(cover, place + w.size, -1)
            # A text meets a window once however often it holds it.
            met = np.unique(doc[place] * len(w.hashes) + at)
            d, at = met // len(w.hashes), met % len(w.hashes)
            n = w.at[at + 1] - w.at[at]
            item = w.items[np.repeat(w.at[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs.append(np.unique(np.repeat(d, n) * len(x.ids) + item))
    out: list[tuple[int, list[str], list[dict]]] = [(int(n), [], []) for n in count]
    if not pairs:
        return out
    for p in np.unique(np.concatenate(pairs)).tolist():
        name = x.ids[p % len(x.ids)]
        if name is not None:
            out[p // len(x.ids)][1].append(name)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    new = np.append(True, (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0)) if len(hit) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    d, point, byte = -1, 0, 0
    for a, b in zip(hit[heads].tolist(), hit[np.append(heads[1:], len(hit)) - 1].tolist() if len(hit) else []):
        if doc[a] != d:  # code points are counted once, on from the last span of the text
            d = int(doc[a])
            point, byte = 0, off[d]
        start = point + int((data[byte : starts[a]] & 0xC0 != 0x80).sum())
        point, byte = start + int((data[starts[a] : ends[b]] & 0xC0 != 0x80).sum()), ends[b]
        out[d][2].append({"first": a - int(first[d]), "last": b - int(first[d]), "start": start, "end": point})
    return [(n, sorted(set(names)), spans) for n, names, spans in out]


_OUT = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _scanned(batches: Iterator[pa.RecordBatch], block, only_hits: bool) -> Iterator[pa.RecordBatch]:
    x = block.value
    for b in batches:
        data, off = strings(b.column(b.num_columns - 1))
        for i, j in slices(off):
            got = scan(data[off[i] : off[j]], off[i : j + 1] - off[i], x)
            keep = [k for k, r in enumerate(got) if r[2]] if only_hits else range(len(got))
            part = b.slice(i, j - i).take(pa.array(keep, pa.int64()))
            cols = [pa.array([got[k][c] for k in keep], kind) for c, kind in enumerate((pa.int64(), pa.list_(pa.string()), _OUT))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*b.schema.names[:-1], "n_words", "items", "spans"])
    trim()


def _cut(batches: Iterator[pa.RecordBatch], window: int, piece: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = strings(b.column(1))
        starts, ends, first = words(lowered(data), off, WORD)
        ids, texts = [], []
        for k, name in enumerate(b.column(0).to_pylist()):
            for i in range(int(first[k]), max(int(first[k + 1]) - window + 1, int(first[k]) + (first[k + 1] > first[k])), piece):
                j = min(i + piece + window - 1, int(first[k + 1]))
                ids.append(name)
                texts.append(data[starts[i] : ends[j - 1]].tobytes().decode("utf-8"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item", "text"])


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, room: int = ROOM, piece: int = PIECE) -> tuple[DataFrame, int]:
    """(pieces of all items with the number of their block, blocks): counted, none of more than ``room`` bytes unless it is one piece."""
    b = benchmark.selectExpr(f"CAST(`{item_col}` AS string) AS item", f"`{text_col}` AS text")
    pieces = store(b.mapInArrow(lambda it: _cut(it, window, piece), "item string, text string"), "items")
    total = pieces.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-total // room)
    while True:
        placed = pieces.withColumn("block", F.lit(0) if n <= 1 else F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
        held = placed.distinct().groupBy("block").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n"))
        if n <= 1 or held.where((F.col("bytes") > room) & (F.col("n") > 1)).isEmpty():
            placed._stored_at = pieces._stored_at
            return placed, max(n, 1)
        n *= 2


def _broadcast(pieces: DataFrame, block: int, window: int):
    rows = pieces.where(F.col("block") == block).select("item", "text").distinct().collect()  # at most ROOM bytes, counted
    rows.sort(key=lambda r: (r["item"] is None, r["item"], r["text"]))
    return pieces.sparkSession.sparkContext.broadcast(index([r["item"] for r in rows], [r["text"] for r in rows], window))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of several blocks: sorted, and made one where they overlap or touch."""
    for b in batches:
        out = []
        for spans in b.column(2).to_pylist():
            one: list[dict] = []
            for s in sorted(spans, key=lambda s: s["first"]):
                if one and s["first"] <= one[-1]["last"] + 1:
                    one[-1]["last"], one[-1]["end"] = max(one[-1]["last"], s["last"]), max(one[-1]["end"], s["end"])
                else:
                    one.append(s)
            out.append(one)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _OUT)], b.schema.names)


def hits(docs: DataFrame, benchmark: DataFrame, key_cols: list[str], text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, room: int = ROOM, piece: int = PIECE) -> DataFrame:
    """``key_cols``, n_words, items and spans of every row of ``docs``."""
    pieces, n = blocks(benchmark, item_col, window=window, room=room, piece=piece)
    kinds = dict(docs.dtypes)
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key_cols)]
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(key_cols)]
    d = docs.select(*keys, F.col(f"`{text_col}`").alias("text"))
    schema = "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(key_cols)) + HITS
    if n == 1:
        block = _broadcast(pieces, 0, window)
        forget(pieces)
        return d.mapInArrow(lambda it: _scanned(it, block, False), schema).select(*named, "n_words", "items", "spans")
    d = d.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = []
    for k in range(n):
        block = _broadcast(pieces, k, window)
        each = d.select("digest", "text").mapInArrow(lambda it, block=block: _scanned(it, block, True), f"digest string, {HITS}")
        found.append(store(each.dropDuplicates(["digest"]), "hits"))  # equal texts have equal hits
        block.unpersist()
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    one = both.groupBy("digest").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    one = store(one.mapInArrow(_united, f"digest string, items array<string>, spans {SPANS}"), "hits")
    forget(pieces, *found)
    count = d.mapInArrow(lambda it: _counted(it), "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(key_cols)) + "digest string, n_words long")
    out = count.join(one, "digest", "left")
    return out.select(*named, "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text comes before their digest; the number of words instead of the text."""
    for b in batches:
        at = b.schema.get_field_index("text")
        data, off = strings(b.column(at))
        n = np.concatenate([np.diff(words(lowered(data[off[i] : off[j]]), off[i : j + 1] - off[i], WORD)[2]) for i, j in slices(off)] or [np.zeros(0, np.int64)])
        cols = [c for i, c in enumerate(b.columns) if i != at]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], [*[c for c in b.schema.names if c != "text"], "n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without contamination: hit documents go (``remove="documents"``), or their hit spans are cut out of the text."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove spans or documents, not {remove}")
    own = "_hit" + "_" * max(len(c) for c in docs.columns)  # a name no column has
    rows = hits(docs.select(F.struct(*docs.columns).alias(own), F.col(f"`{text_col}`").alias("text")), benchmark, [own, "text"], **how)
    if remove == "documents":
        return rows.where(F.size("spans") == 0).select(f"{own}.*")
    # The text between the spans, by the places at which they end and begin.
    n = F.size("spans")
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(begins, stops, lambda a, b: F.substr(F.col("text"), a + 1, b - a)), "")
    text = F.when(n > 0, kept).otherwise(F.col("text"))
    return rows.select(f"{own}.*", text.alias(own)).select(*[F.col(own).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return r.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark),
bi AS (SELECT item_id, v, least(len(v), 10) AS k, unnest(range(1, len(v) - least(len(v), 10) + 2)) AS i FROM b WHERE len(v) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(v[i:i + k - 1], ' ') AS win FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT row, v, k, unnest(range(1, len(v) - k + 2)) AS i FROM w, ks WHERE len(v) >= k),
dw AS (SELECT row, k, i, array_to_string(v[i:i + k - 1], ' ') AS win FROM di),
hits AS (SELECT row, item_id, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT row, i, k FROM hits)) GROUP BY row),
it AS (SELECT row, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT row, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(v)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (row) LEFT JOIN it USING (row)
"""
