"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy arrays.

The model file gives pieces and scores; the merges are done here. A text is cut where a space follows another character: no
piece of the model goes over such a place (checked when the model is loaded, else texts stay whole), so merges never do.
All segments that are not known yet stand in one flat array of symbols. A round looks up every neighbouring pair's rank,
takes each segment's smallest by a segmented minimum, merges its occurrences from the left, and compacts the array; segments
without a pair leave. Occurrences of one rank are merged at once only if no merge that their result can take part in has a
smaller rank (checked per piece when the model is loaded); otherwise the leftmost one is merged alone. This gives what the
sequential algorithm gives: best score first, leftmost among equals.

A segment over ``LONG`` characters (texts without spaces, runs of spaces) is cut further where two characters stand that no
piece has side by side: no merge goes over such a place. What is still longer is merged one pair after the other from a
heap over linked symbols, as rounds over a flat array would take a pass for every merge there.

Segments that were encoded are remembered in two generations of about ``KNOWN`` bytes each, what Python adds to a string
counted in; when the newer is full the older goes, and what is met again moves up. Segments over ``LONG`` characters (texts
without spaces) are encoded where they are met and not remembered. So a worker holds two generations and what one slice of
texts needs, whatever the vocabulary. Rows are independent: no shuffle, nothing is skewed.

Defined cases: null and empty texts give the end id alone and decode to the empty text; repeated rows are repeated; an empty
table gives an empty result; a very long text or word takes time in proportion, but for a logarithm; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import table
from .kernel import slices, strings, trim
from .tokencount import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of the segments a worker remembers in a generation, and what Python's objects add to each; characters from which a
#: segment is not remembered; symbols of the segments encoded at once.
KNOWN, EACH, LONG, FLAT = 48 << 20, 360, 256, 1 << 17
_SLOTS = 21
_SEGMENT = re.compile(" *[^ ]+| +")
_NONE = np.int64(1 << 40)


class Model:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = {names[i]: i for i in range(n) if not special[i]}
        self.whole = any(SPACE in p.lstrip(SPACE) for p in normal)  # a piece goes over a segment's edge
        # Symbols: ids of pieces, then single characters that only occur inside pieces, then any other character.
        chars = sorted({c for p in normal for c in p if c not in normal})
        extra = {c: n + k for k, c in enumerate(chars)}
        symbol = normal | extra
        order = sorted({-sp.get_score(i) for i in normal.values()})
        rank_of = dict(zip(order, range(len(order))))
        rank = {p: rank_of[-sp.get_score(i)] for p, i in normal.items()}
        shared = {r for r, k in zip(*np.unique(list(rank.values()), return_counts=True)) if k > 1}
        pairs, safe = {}, {p: rank[p] not in shared for p in normal}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[p], i)
                    for part in (p[:k], p[k:]):
                        if part in safe and rank[p] <= rank[part]:
                            safe[part] = False
        beside = {ord(a) << 32 | ord(b) for p in normal for a, b in zip(p, p[1:])}
        self.beside = np.array(sorted(beside) or [-1], np.int64)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # A hash table of the pairs; slots that several pairs share are looked up in the sorted keys instead.
        slot = self._slot(self.keys)
        self.table = np.full(1 << _SLOTS, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        crowded, k = np.unique(slot, return_counts=True)
        self.table[crowded[k > 1]] = -2
        self.safe = np.zeros(n + len(chars), bool)
        for p, ok in safe.items():
            self.safe[normal[p]] = ok
        self.base = n + len(chars)  # symbols from here on are characters without a piece
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        lone = self.char < 0
        self.char[lone] = self.base + np.flatnonzero(lone)
        self.n, self.extra = n, chars
        text = [b"" if s else p.replace(SPACE, " ").encode() for p, s in zip(names, special)]
        for v, i in self.bytes.items():
            text[i] = bytes([v])
        text[self.unk] = " ⁇ ".encode()
        self.text, self.ids = text, [str(i) for i in range(n)]

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank _NONE where there is no such piece."""
        key = a.astype(np.int64) << 32 | b
        at = self.table[self._slot(key)]
        odd = np.flatnonzero(at == -2)
        at[odd] = np.minimum(np.searchsorted(self.keys, key[odd]), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (at >= 0)
        return np.where(ok, self.ranks[at], _NONE), self.merged[at]

    def rounds(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges until no pair remains; ``first`` holds each segment's first symbol. (symbols, segment) in order."""
        seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sym))))
        done_sym, done_seg = [], []
        while len(sym):
            rank, into = np.full(len(sym), _NONE, np.int64), np.zeros(len(sym), np.int64)
            rank[:-1], into[:-1] = self.lookup(sym[:-1], sym[1:])
            rank[:-1][seg[:-1] != seg[1:]] = _NONE
            heads = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            low = np.minimum.reduceat(rank, heads)
            low = np.repeat(low, np.diff(np.append(heads, len(seg))))
            over = low == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_seg.append(seg[over])
            at = np.flatnonzero((rank == low) & ~over)
            if not len(at):
                break
            # From the left: of candidates that overlap every second one, and one alone where merging all is not safe.
            joined = np.append(False, (np.diff(at) == 1) & (seg[at[1:]] == seg[at[:-1]]))
            head = np.flatnonzero(~joined)
            pos = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            newest = np.append(True, seg[at[1:]] != seg[at[:-1]])
            take = at[np.where(self.safe[into[at]], pos % 2 == 0, newest)]
            sym = sym.copy()
            sym[take] = into[take]
            keep = ~over
            keep[take + 1] = False
            sym, seg = sym[keep], seg[keep]
        if not done_sym:
            return sym, seg
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

    def cut(self, segment: str) -> list[str]:
        """A segment's parts between characters that no piece has side by side."""
        c = np.frombuffer(segment.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        key = c[:-1] << 32 | c[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        ends = [*(np.flatnonzero(self.beside[at] != key) + 1).tolist(), len(segment)]
        return [segment[a:b] for a, b in zip([0, *ends], ends)]

    def one_by_one(self, sym: np.ndarray) -> np.ndarray:
        """Merges of one long segment: smallest rank first, leftmost among equals."""
        n = len(sym)
        rank, _ = self.lookup(sym[:-1], sym[1:])
        at = np.flatnonzero(rank != _NONE)
        at = at[np.argsort(rank[at], kind="stable")]
        begun = ((rank[at] << 32) | at).tolist()[::-1]  # the pairs of the start, smallest last; the heap has those that arise
        pairs, heap = self.pairs, []
        sym, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while begun or heap:
            x = heappop(heap) if heap and not (begun and begun[-1] < heap[0]) else begun.pop()
            i = x & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            pair = pairs.get(sym[i] << 32 | sym[j])
            if pair is None or pair[0] != x >> 32:  # one of the two was merged since
                continue
            sym[i], sym[j] = pair[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if right := pairs.get(sym[i] << 32 | sym[k]):
                    heappush(heap, right[0] << 32 | i)
            h = before[i]
            if h >= 0 and (left := pairs.get(sym[h] << 32 | sym[i])):
                heappush(heap, left[0] << 32 | h)
        return np.array([s for s in sym if s >= 0], np.int64)

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Piece ids of each segment; spaces stand for themselves."""
        lens = np.array([len(s) for s in segments], np.int64)
        points = np.frombuffer("".join(segments).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(lens) - lens
        if len(segments) == 1 and len(points) > LONG:
            sym = self.one_by_one(self.char[points].astype(np.int64))
            seg = np.zeros(len(sym), np.int64)
        else:
            sym, seg = self.rounds(self.char[points].astype(np.int64), first)
        odd = np.flatnonzero(sym >= self.n)
        if len(odd):  # characters without a piece become their bytes
            of = {x: self._spelled(x) for x in np.unique(sym[odd]).tolist()}
            put = [of[x] for x in sym[odd].tolist()]
            count = np.ones(len(sym), np.int64)
            count[odd] = [len(x) for x in put]
            at = np.cumsum(count) - count
            sym, seg = np.repeat(sym, count), np.repeat(seg, count)
            sym[np.repeat(at[odd], count[odd]) + np.concatenate([np.arange(len(x)) for x in put])] = np.concatenate(put)
        ends = np.searchsorted(seg, np.arange(len(segments)), "right").tolist()
        flat = sym.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _spelled(self, symbol: int) -> list[int]:
        c = chr(symbol - self.base) if symbol >= self.base else self.extra[symbol - self.n]
        return [self.bytes[x] for x in c.encode()] if self.bytes else [self.unk]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the space put in front, bytes read as UTF-8."""
        return b"".join([self.text[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        return [text] if self.whole else _SEGMENT.findall(text)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(vocabulary_path(path))


class _Both(dict):
    """A small dictionary in front of another."""

    def __init__(self, first: dict, then: dict):
        super().__init__(first)
        self.then = then

    def __missing__(self, key):
        return self.then[key]


class Encoder:
    """Encodes many texts, remembering segments: for each its ids as text and the bytes they decode to."""

    def __init__(self, path: str = MODEL):
        self.model, self.known, self.older, self.size = load(path), {}, {}, 0

    def learn(self, segments: set[str], into: dict[str, tuple[str, bytes]]) -> None:
        todo, size = [], 0
        for s in segments:
            todo.append(s)
            size += len(s)
            if size >= FLAT:
                self._put(todo, into)
                todo, size = [], 0
        if todo:
            self._put(todo, into)

    def _put(self, todo: list[str], into: dict[str, tuple[str, bytes]]) -> None:
        name, text = self.model.ids, self.model.text
        for s, ids in zip(todo, self.model.encode(todo)):
            into[s] = " ".join([name[i] for i in ids]), b"".join([text[i] for i in ids])

    def cut_up(self, segments: set[str]) -> dict[str, tuple[str, bytes]]:
        """Long segments from their parts, each of which is encoded once."""
        cut = {s: self.model.cut(s) for s in segments}
        parts = set().union(*cut.values())
        here: dict[str, tuple[str, bytes]] = {}
        self.learn({p for p in parts if len(p) <= LONG}, here)
        for p in parts:
            if len(p) > LONG:
                self._put([p], here)
        return {s: (" ".join([here[p][0] for p in ps]), b"".join([here[p][1] for p in ps])) for s, ps in cut.items()}

    def _weight(self, segments: set[str]) -> int:
        return sum(EACH + len(s) + len(self.known[s][0]) + len(self.known[s][1]) for s in segments)

    def run(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """(ids and the end id joined by spaces, decoded bytes) of each text."""
        cut = [self.model.segments(t) for t in texts]
        if self.size > KNOWN:
            self.known, self.older, self.size = {}, self.known, 0
        new = set().union(*cut) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((s, self.older[s]) for s in again)
        once = {s for s in new if len(s) > LONG}
        self.learn(new - again - once, self.known)
        self.size += self._weight(new - once)
        known, end = self.known, str(self.model.eos)
        if once:
            known = _Both(self.cut_up(once), known)
        out = []
        for parts in cut:
            both = [known[p] for p in parts]
            out.append((" ".join([*[x[0] for x in both], end]), b"".join([x[1] for x in both]).removeprefix(b" ")))
        return out


def _digest(batches: Iterator[pa.RecordBatch], path: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    enc = Encoder(path)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *keep]
    for b in batches:
        data, off = strings(b.column(1))
        for i, j in slices(off):  # a slice is a batch of its own, so what is held follows the slice
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for ids, text in enc.run([bytes(data[off[k] : off[k + 1]]).decode("utf-8") for k in range(i, j)]):
                text = text.decode("utf-8", "replace")
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if "ids" in keep:
                    all_ids.append(ids)
                if "decoded" in keep:
                    all_text.append(text)
            more = {"ids": all_ids, "decoded": all_text}
            cols = [pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in (ids_sha, text_sha, *[more[c] for c in keep])]]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], names)
    del enc
    trim()


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and as asked by ``keep`` "ids" (joined by spaces) and the "decoded" text."""
    kind = dict(docs.dtypes)[id_col]
    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    more = "".join(f", {c} string" for c in keep)
    return d.mapInArrow(lambda it: _digest(it, model, keep), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
