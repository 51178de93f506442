"""Language-model scoring with a class-based hidden Markov model, and exact unigram counts under it.

Counts: every task counts its training tokens by 64-bit word hash and deals the counts to buckets by hash; buckets add them up.
The most frequent ``HEAD`` words (a bounded table) go to every task, so most tokens are looked up where they are; only tokens of
rarer words travel, to the bucket that holds their count, and come back as one sum for each document of a batch.

Model: p(word | state) = p(class | state) p(word) / p(class). The most frequent words are classes of their own, the end is one, and
all other words fall into classes by their last two bytes and their hash. The number of classes of both kinds grows with the
distinct words of the training documents (one for ``SHARE`` of them, up to what two bytes can name: it bounds what travels).

Baum-Welch over whole documents: each task adds up expected counts of all its training documents, a tree of tasks adds those, the
driver normalises (states x classes numbers) and the next round begins. Texts over ``SEGMENT`` tokens are cut only to work on their
segments side by side: of each the transfer matrix (states by states) is computed, the matrices are chained over the text both
ways, and every segment then begins and ends with the exact distribution that its neighbours give it, the step over the edge counted. Scoring runs the scaled forward recursion in the same way, so the likelihood is exact.
A class without a training token is as likely in every state as in the base. A text is the HMM's or, rarely (``APART``), the base's:
log10 p(text) = base score + log10 of ((1 - APART) HMM / product of p(class) + APART), so no text is further than 6 below its base.

Defined cases: null and empty texts are the end token alone; null ids are learned from like the empty id; repeated rows count and
are scored each; an empty table gives an empty result; with no training documents the base is uniform and the model has no effect;
very long texts take more segments, not more memory at once than a batch; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import store, table
from .kernel import LOWER, U, mix, slices, span_hash, strings, words

#: Words known to every task; hidden states; rounds of training; tokens of a segment.
HEAD, STATES, ROUNDS, SEGMENT = 1 << 18, 8, 4, 2048
#: Distinct words for each class; fewest and most frequent words that are classes, and classes of all others.
SHARE, OWN, OWN_MOST, REST, REST_MOST = 64, 2047, 24_575, 1024, 40_000
#: Rows of sums that are added in one task; tokens of documents that are worked on at once.
FAN, AT_ONCE = 16, 1 << 19
#: Tokens that each state is taken to have seen beforehand, in the proportions of all.
PRIOR = 200.0
#: Share of texts taken to be unlike all that was learned: their tokens are independent, as the base has them.
APART = 1e-6
#: Documents for each bucket of words; fewest buckets.
PER_BUCKET, BUCKETS = 8000, 16
#: Distinct words held by a task before it hands its counts on.
HELD = 1 << 20
END = U(0x5851F42D4C957F2D)


def sizes(words_: int) -> tuple[int, int]:
    """(words that are classes, classes of the others) for this many distinct words."""
    return min(max(OWN, words_ // SHARE), OWN_MOST), min(max(REST, words_ // SHARE), REST_MOST)


def rest_class(h: np.ndarray, ending: np.ndarray, rest: int) -> np.ndarray:
    """The class, from 0, of words that are no class of their own: by ending, and the more classes there are the more by hash."""
    split = U(max(1, rest // REST))
    with np.errstate(over="ignore"):
        return (mix(ending.astype(U) * split + h % split + U(1)) % U(rest)).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the last two bytes, offsets) of the tokens of each text, its end included."""
    data = LOWER[data]
    s, e, first = words(data, offsets)
    h = span_hash(data, s, e)
    last = data[e - 1].astype(np.int64) if len(e) else np.zeros(0, np.int64)
    pair = np.where(e - s > 1, data[np.maximum(e - 2, 0)], 0).astype(np.int64) if len(e) else last
    ending = (mix((pair << 8 | last).astype(U)) & U(0xFFFF)).astype(np.uint16)
    at = first[1:]  # each text's end goes after its last word
    h, ending = np.insert(h, at, END), np.insert(ending, at, np.uint16(0))
    return h, ending, first + np.arange(len(first))


def _texts(b: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = strings(b.column(b.schema.get_field_index(name)))
    for i, j in slices(off):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def _add(h: np.ndarray, n: np.ndarray, *more: np.ndarray):
    """Distinct hashes with their counts added up, and ``more`` as it came with the first."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return (h[at], np.add.reduceat(n, at) if len(at) else n, *[m[order][at] for m in more])


_COUNTED = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("e", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0

    def dealt():
        h, n, e = _add(*[np.concatenate(x) for x in zip(*parts)])
        to = (h % U(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        h, n, e, to = h[order], n[order], e[order], to[order]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        ends = np.append(at[1:], len(to))
        cols = [[x[a:b].tobytes() for a, b in zip(at, ends)] for x in (h, n, e)]
        return pa.RecordBatch.from_arrays([pa.array(to[at], pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], schema=_COUNTED)

    for b in batches:
        for _, _, data, off in _texts(b):
            h, e, _ = _tokens(data, off)
            part = _add(h, np.ones(len(h), np.int64), e)
            parts.append(part)
            held += len(part[0])
            if held > HELD:
                parts = [_add(*[np.concatenate(x) for x in zip(*parts)])]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield dealt()
                    parts, held = [], 0
    if parts:
        yield dealt()


def _arr(col, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind)


_TOTALS = "bucket int, h binary, n binary, e binary, words long, tokens long, levels array<long>"


def _total(t: pa.Table) -> pa.Table:
    h, n, e = _add(_arr(t["h"], U), _arr(t["n"], np.int64), _arr(t["e"], np.uint16))
    levels = np.bincount(_level(n), minlength=256)
    return pa.table({
        "bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "h": pa.array([h.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()),
        "e": pa.array([e.tobytes()], pa.binary()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()),
        "levels": pa.array([levels.tolist()], pa.list_(pa.int64())),
    })


def _level(n: np.ndarray) -> np.ndarray:
    """Counts on a scale of four steps to a doubling."""
    return np.minimum((np.log2(np.maximum(n, 1)) * 4).astype(np.int64), 255)


_HEADS = "h binary, n binary, e binary, words array<long>, tokens array<long>"


def _heads(batches: Iterator[pa.RecordBatch], least: int, rest: int) -> Iterator[pa.RecordBatch]:
    """The words at or over a level, and for each class of other words its words and tokens."""
    for b in batches:
        for k in range(b.num_rows):
            h, n, e = (np.frombuffer(b.column(c)[k].as_py(), kind) for c, kind in ((0, U), (1, np.int64), (2, np.uint16)))
            up = (_level(n) >= least) | (h == END)  # the end is a class of its own, however few documents there are
            c = rest_class(h, e, rest)
            sums = np.bincount(c, minlength=rest), np.bincount(c, weights=n, minlength=rest).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[up].tobytes()], pa.binary()) for x in (h, n, e)] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in sums], ["h", "n", "e", "words", "tokens"]
            )


class Vocabulary:
    """What every task knows: the head's hashes, counts and classes, the totals, and each class's share of tokens."""

    def __init__(self, h, n, e, words_by_class, tokens_by_class, words, tokens):
        self.own, self.rest = sizes(int(words))
        order = np.lexsort((h, -n, h != END))[:HEAD]
        h, n, e = h[order], n[order], e[order]
        own = np.flatnonzero(h != END)[: self.own]
        other = self.own + 1 + rest_class(h, e, self.rest)
        cls = other.astype(np.uint16)
        cls[own] = np.arange(len(own))
        cls[h == END] = self.own
        self.tokens, self.words = int(tokens), int(words)
        self.base = self.tokens + 0.5 * (self.words + 1)
        total = self.own + 1 + self.rest
        seen, kinds = np.zeros(total, np.int64), np.zeros(total, np.int64)  # training tokens and words of each class
        seen[self.own + 1 :], kinds[self.own + 1 :] = tokens_by_class, words_by_class
        single = np.append(own, np.flatnonzero(h == END))
        for of, x in ((seen, n[single]), (kinds, np.ones(len(single), np.int64))):
            np.subtract.at(of, other[single], x)
            of[cls[single]] += x
        mass = seen + 0.5 * kinds + 0.5 / total
        self.log_class, self.unseen = np.log(mass / mass.sum()), seen == 0
        up = np.argsort(h)
        self.h, self.n, self.cls = h[up], n[up], cls[up]

    def find(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, class) of each hash; -1 where only its bucket knows."""
        if not len(self.h):
            return np.full(len(h), -1), self.own + 1 + rest_class(h, ending, self.rest)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        ok = self.h[at] == h
        cls = np.where(h == END, self.own, self.own + 1 + rest_class(h, ending, self.rest))
        return np.where(ok, self.n[at], -1), np.where(ok, self.cls[at], cls)


_ENCODED = "kind int, batch long, row int, id long, train boolean, n_tokens long, s double, known long, classes binary, bucket int, h binary, i binary, c binary"
_ENCODED_ARROW = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("s", pa.float64()), ("known", pa.int64()), ("classes", pa.binary()), ("bucket", pa.int32()), ("h", pa.binary()), ("i", pa.binary()), ("c", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch], vocabulary, buckets: int) -> Iterator[pa.RecordBatch]:
    """Document rows (kind 0) with classes and the head's sums, and the rarer words by bucket (kind 1)."""
    voc: Vocabulary = vocabulary.value
    part, number = TaskContext.get().partitionId(), 0
    for b in batches:
        ids, train = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, j, data, off in _texts(b):
            h, ending, first = _tokens(data, off)
            n = j - i
            doc = np.repeat(np.arange(n), np.diff(first))
            u, back = np.unique(h, return_inverse=True)
            e = np.zeros(len(u), np.uint16)
            e[back] = ending
            count, cls = voc.find(u, e)
            here = count[back] >= 0
            logs = np.log10(np.maximum(count, 0) + 0.5)[back]
            s = np.bincount(doc[here], weights=logs[here], minlength=n)
            known = np.bincount(doc[here], minlength=n)
            classes = cls[back].astype(np.uint16)
            key = part << 32 | number
            number += 1
            cols = [[0] * n, [key] * n, range(n), ids[i:j], train[i:j], np.diff(first).tolist(), s.tolist(), known.tolist(), [classes[a:z].tobytes() for a, z in zip(first, first[1:])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, *[[None] * n] * 4], _ENCODED_ARROW)], schema=_ENCODED_ARROW)
            away = ~here
            if away.any():
                # One entry for each word and document.
                pair = back[away] * np.int64(n) + doc[away]
                pair, times = np.unique(pair, return_counts=True)
                hh, dd = u[pair // n], (pair % n).astype(np.uint32)
                to = (hh % U(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                hh, dd, times, to = hh[order], dd[order], times[order].astype(np.uint32), to[order]
                at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                ends = np.append(at[1:], len(to))
                m = len(at)
                blobs = [[x[a:z].tobytes() for a, z in zip(at, ends)] for x in (hh, dd, times)]
                cols = [[1] * m, [key] * m, *[[None] * m] * 7, to[at].tolist(), *blobs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENCODED_ARROW)], schema=_ENCODED_ARROW)


def _away(counts: pa.Table, asked: pa.Table) -> pa.Table:
    """For each batch that asks a bucket: documents, sums of log counts, and known tokens."""
    h, n = _arr(counts["h"], U), _arr(counts["n"], np.int64)
    keys, ii, ss, kk = [], [], [], []
    for key, hh, dd, times in zip(*[asked[c].to_pylist() for c in ("batch", "h", "i", "c")]):
        hh, dd, times = np.frombuffer(hh, U), np.frombuffer(dd, np.uint32), np.frombuffer(times, np.uint32)
        at = np.minimum(np.searchsorted(h, hh), max(len(h) - 1, 0))
        c = np.where(h[at] == hh, n[at], 0) if len(h) else np.zeros(len(hh), np.int64)
        size = int(dd.max()) + 1
        s, k = np.bincount(dd, weights=times * np.log10(c + 0.5), minlength=size), np.bincount(dd, weights=times * (c > 0), minlength=size)
        some = np.unique(dd)
        keys.append(key)
        ii.append(some.tobytes())
        ss.append(s[some].tobytes())
        kk.append(k[some].astype(np.uint32).tobytes())
    return pa.table({"batch": pa.array(keys, pa.int64()), "i": pa.array(ii, pa.binary()), "s": pa.array(ss, pa.binary()), "k": pa.array(kk, pa.binary())})


def _back(t: pa.Table) -> pa.Table:
    i, s, k = _arr(t["i"], np.uint32), _arr(t["s"], np.float64), _arr(t["k"], np.uint32)
    rows, inv = np.unique(i, return_inverse=True)
    return pa.table({
        "batch": pa.array(np.full(len(rows), t["batch"][0].as_py()), pa.int64()), "row": pa.array(rows, pa.int32()),
        "s_away": pa.array(np.bincount(inv, weights=s), pa.float64()), "known_away": pa.array(np.bincount(inv, weights=k).astype(np.int64), pa.int64()),
    })


# The model ------------------------------------------------------------------------------------------------------------


class Params:
    """Start, transition and emission probabilities."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(log_class: np.ndarray, states: int = STATES) -> Params:
        """Each state sees the classes about as often as all do, differently enough to part; sticky transitions."""
        c, k = np.meshgrid(np.arange(len(log_class)), np.arange(states))
        noise = (mix((c * 1000 + k).astype(U)) >> U(11)).astype(np.float64) / 2.0**53
        emit = np.exp(log_class)[None, :] * (0.25 + 1.5 * noise)
        move = np.full((states, states), 0.3 / max(states - 1, 1))
        np.fill_diagonal(move, 0.7 if states > 1 else 1.0)
        return Params(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


class Segments:
    """Texts cut into segments, with the exact distributions at their edges. Tokens lie in order of their place in the segment, of
    one place those of longer segments first, so a step of the recursions works on one stretch and nothing is filled up.

    ``before`` is the distribution after the token before a segment (for a text's first segment unused), ``after`` the backward
    vector at its last token, up to a factor."""

    def __init__(self, seqs: list[np.ndarray], p: Params, length: int = SEGMENT, both: bool = True):
        self.p = p
        flat = np.concatenate(seqs).astype(np.int64)
        whole = np.array([len(s) for s in seqs])
        n = -(-whole // length)
        begin = np.cumsum(whole) - whole
        text = np.repeat(np.arange(len(seqs)), n)
        part = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(whole[text] - part * length, length)
        order = np.argsort(-size, kind="stable")
        self.size, self.text, self.part = size[order], text[order], part[order]
        self.row = np.empty(len(order), np.int64)  # by text, then place in it
        self.row[order] = np.arange(len(order))
        self.first, self.n = np.cumsum(n) - n, n
        steps = int(self.size[0])
        self.live = np.searchsorted(-self.size, -np.arange(steps), "left")  # segments with a token at t
        self.at = np.append(0, np.cumsum(self.live))  # where the tokens at t begin
        place = np.repeat(np.arange(steps), self.live)
        row = np.arange(len(flat)) - self.at[place]
        self.x = flat[(begin[self.text] + self.part * length)[row] + place]
        self.last = self.at[self.size - 1] + np.arange(len(order))
        self.emit = np.ascontiguousarray(p.emit.T)
        states = len(p.start)
        self.before, self.after = np.zeros((len(order), states)), np.ones((len(order), states))
        if (n > 1).any():
            self._chain(both)

    def start(self) -> np.ndarray:
        """What each segment expects of its first state."""
        return np.where((self.part == 0)[:, None], self.p.start[None, :], self.before @ self.p.move)

    def _transfer(self, rows: np.ndarray) -> np.ndarray:
        """For each segment the matrix from the state before it to the state at its last token, up to a factor; of a text's first
        segment all its rows are the distribution that it ends with."""
        p, size = self.p, self.size[rows]
        states = len(p.start)
        m = np.where((self.part[rows] == 0)[:, None, None], p.start[None, None, :], p.move[None, :, :]) * self.emit[self.x[rows]][:, None, :]
        m /= m.max((1, 2))[:, None, None]
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        for t in range(1, len(live)):
            k = live[t]
            m[:k] = (m[:k].reshape(-1, states) @ p.move).reshape(k, states, states) * self.emit[self.x[self.at[t] + rows[:k]]][:, None, :]
            m[:k] /= m[:k].max((1, 2))[:, None, None]  # at every step: a few rare classes in a row leave single precision
        return m

    def _chain(self, both: bool) -> None:
        many = np.flatnonzero(self.n[self.text] > 1)  # still longest first
        moved = np.empty(len(self.size), np.int64)
        moved[many] = np.arange(len(many))
        m = self._transfer(many)
        texts = np.flatnonzero(self.n > 1)
        texts = texts[np.argsort(-self.n[texts], kind="stable")]
        count = self.n[texts]
        now = m[moved[self.row[self.first[texts]]], 0]
        now /= now.sum(1, keepdims=True)
        for k in range(1, int(count[0])):
            some = int(np.searchsorted(-count, -k, "left"))
            rows = self.row[self.first[texts[:some]] + k]
            self.before[rows] = now[:some]
            now = np.einsum("ij,ijk->ik", now[:some], m[moved[rows]])
            now /= now.sum(1, keepdims=True)
        if not both:
            return
        for k in range(int(count[0]) - 1, 0, -1):
            some = int(np.searchsorted(-count, -k, "left"))
            rows = self.row[self.first[texts[:some]] + k]
            b = np.einsum("ijk,ik->ij", m[moved[rows]], self.after[rows])
            self.after[self.row[self.first[texts[:some]] + k - 1]] = b / b.max(1, keepdims=True)


def expected(seqs: list[np.ndarray], p: Params, length: int = SEGMENT):
    """Expected counts (start, move, emit) of the texts, and their log likelihood."""
    s = Segments(seqs, p, length)
    at, live, begin = s.at, s.live, s.start()
    seen = s.emit[s.x]
    alpha, scale = np.empty_like(seen), np.empty(len(seen))
    for t, m in enumerate(live):
        now = slice(at[t], at[t] + m)
        a = np.multiply(begin if t == 0 else alpha[at[t - 1] : at[t - 1] + m] @ p.move, seen[now], out=alpha[now])
        c = np.sum(a, axis=1, out=scale[now])
        a /= c[:, None]
    loglik = float(np.log(scale).sum())
    seen /= scale[:, None]
    # Backward, scaled so that its product with alpha sums to one at every token; ``seen`` becomes what the step before it needs.
    beta = np.empty_like(seen)
    beta[s.last] = s.after / (alpha[s.last] * s.after).sum(1, keepdims=True)
    back = np.ascontiguousarray(p.move.T)
    for t in range(len(live) - 1, 0, -1):
        now, m = slice(at[t], at[t] + live[t]), live[t]
        seen[now] *= beta[now]
        np.matmul(seen[now], back, out=beta[at[t - 1] : at[t - 1] + m])
    seen[: live[0]] *= beta[: live[0]]
    inner = s.part > 0
    # The steps inside segments, then those over their edges.
    place = np.repeat(np.arange(1, len(live)), live[1:])
    before = at[place - 1] + np.arange(at[1], len(seen)) - at[place]
    move = (alpha[before].T @ seen[at[1] :] + s.before[inner].T @ seen[: live[0]][inner]) * p.move
    beta *= alpha
    counts = np.stack([np.bincount(s.x, weights=beta[:, k], minlength=p.emit.shape[1]) for k in range(len(p.start))])
    return beta[: live[0]][~inner].sum(0), move, counts, loglik


def likelihood(seqs: list[np.ndarray], p: Params, length: int = SEGMENT) -> np.ndarray:
    """The natural logarithm of each whole text's probability, by the scaled forward recursion."""
    if not len(seqs):
        return np.zeros(0)
    s = Segments(seqs, p, length, both=False)
    a, total = s.start(), np.zeros(len(s.size))
    for t, m in enumerate(s.live):
        a = (a if t == 0 else a[:m] @ p.move) * s.emit[s.x[s.at[t] : s.at[t] + m]]
        c = a.sum(1)
        a /= c[:, None]
        total[:m] += np.log(c)
    return np.bincount(s.text, weights=total, minlength=len(seqs))


def _seqs(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in b.column(k).to_pylist()]


_SUMS = "grp long, start binary, move binary, emit binary, loglik double"


def _sums_of(grp: int, start, move, emit, loglik) -> pa.RecordBatch:
    blobs = [start.astype(np.float64).tobytes(), move.astype(np.float64).tobytes(), emit.astype(np.float32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs], pa.array([loglik], pa.float64())], ["grp", "start", "move", "emit", "loglik"])


def _at_once(seqs: list[np.ndarray], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` tokens, one text at least."""
    ends = np.cumsum([0, *[len(s) for s in seqs]])
    at = 0
    while at < len(seqs):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def _expect(batches: Iterator[pa.RecordBatch], params) -> Iterator[pa.RecordBatch]:
    p, acc = params.value, None
    p = Params(*[x.astype(np.float32) for x in (p.start, p.move, p.emit)])  # sums are in double precision
    for b in batches:
        seqs = _seqs(b, 0)
        for i, j in _at_once(seqs):
            r = expected(seqs[i:j], p)
            acc = r if acc is None else tuple(x + y for x, y in zip(acc, r))
    if acc is not None:
        yield _sums_of(TaskContext.get().partitionId(), *acc)


def _merge(t: pa.Table) -> pa.Table:
    sums = [sum(np.frombuffer(x, kind).astype(np.float64) for x in t[c].to_pylist()) for c, kind in (("start", np.float64), ("move", np.float64), ("emit", np.float32))]
    return pa.Table.from_batches([_sums_of(t["grp"][0].as_py(), *sums, sum(t["loglik"].to_pylist()))])


def train(classes: DataFrame, log_class: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Params, list[float]]:
    """Baum-Welch over ``classes(classes)``; the parameters and each round's log likelihood."""
    sc = classes.sparkSession.sparkContext
    p, told = Params.first(log_class, states), []
    tasks = classes.rdd.getNumPartitions()
    prior = PRIOR * np.exp(log_class)[None, :]
    for _ in range(rounds):
        sent = sc.broadcast(p)
        part, n = classes.mapInArrow(lambda it: _expect(it, sent), _SUMS), tasks
        while n > FAN:  # a tree: no task adds more than about FAN rows, each of fixed size
            n = -(-n // FAN)
            part = part.withColumn("grp", F.col("grp") % n).groupBy("grp").applyInArrow(_merge, _SUMS)
        rows = part.withColumn("grp", F.lit(0).cast("long")).groupBy("grp").applyInArrow(_merge, _SUMS).collect()  # one row
        if not rows:
            break
        start, move = (np.frombuffer(rows[0][c], np.float64) for c in ("start", "move"))
        emit = np.frombuffer(rows[0]["emit"], np.float32).astype(np.float64).reshape(states, -1) + prior
        move = move.reshape(states, states) + 0.01
        p = Params((start + 0.01) / (start + 0.01).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        told.append(rows[0]["loglik"])
    return p, told


def _score(batches: Iterator[pa.RecordBatch], params) -> Iterator[pa.RecordBatch]:
    p, log_class = params.value
    for b in batches:
        whole = _seqs(b, b.schema.get_field_index("classes"))
        for i, j in _at_once(whole):
            part, seqs = b.slice(i, j - i), whole[i:j]
            off = np.cumsum([0, *[len(s) for s in seqs]])
            plain = np.add.reduceat(log_class[np.concatenate(seqs)], off[:-1])
            gain = np.logaddexp(likelihood(seqs, p) - plain + np.log1p(-APART), np.log(APART)) / np.log(10)
            cols = [part.column(part.schema.get_field_index(c)) for c in ("batch", "row", "id", "train", "n_tokens", "s", "known")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gain)], ["batch", "row", "id", "train", "n_tokens", "s", "known", "gain"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    train_row = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) != 1
    d = docs.select(F.col(id_col).cast("long").alias("id"), train_row.alias("train"), F.col(text_col).alias("text"))
    buckets = max(BUCKETS, d.count() // PER_BUCKET)
    counted = d.where("train").select("text").mapInArrow(lambda it: _count(it, buckets), "bucket int, h binary, n binary, e binary")
    totals = store(counted.groupBy("bucket").applyInArrow(_total, _TOTALS), "counts")
    n = totals.agg(F.sum("words"), F.sum("tokens")).first()
    words_, tokens = n[0] or 0, n[1] or 0
    levels = totals.select(F.posexplode("levels").alias("level", "words")).groupBy("level").agg(F.sum("words").alias("words")).collect()
    rest, least = HEAD, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        rest -= r["words"]
        if rest < 0:
            least = r["level"] + 1
            break
    others = sizes(words_)[1]
    heads = totals.select("h", "n", "e").mapInArrow(lambda it: _heads(it, least, others), _HEADS)
    sums = heads.select(*[F.posexplode("words").alias("k", "v")], F.lit(0).alias("w")).unionByName(heads.select(F.posexplode("tokens").alias("k", "v"), F.lit(1).alias("w")))
    by_class = np.zeros((2, others))
    for r in sums.groupBy("w", "k").agg(F.sum("v").alias("v")).collect():
        by_class[r["w"], r["k"]] = r["v"]
    got = heads.select("h", "n", "e").collect()  # HEAD words at most
    join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in got), kind)
    voc = Vocabulary(join("h", U), join("n", np.int64), join("e", np.uint16), by_class[0], by_class[1], words_, tokens)
    sent = sc.broadcast(voc)
    coded = store(d.mapInArrow(lambda it: _encode(it, sent, buckets), _ENCODED), "encoded")

    asked = coded.where("kind = 1").select("bucket", "batch", "h", "i", "c")
    away = totals.select("bucket", "h", "n").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_away, "batch long, i binary, s binary, k binary")
    away = away.groupBy("batch").applyInArrow(_back, "batch long, row int, s_away double, known_away long")
    p, _ = train(coded.where("kind = 0 AND train").select("classes"), voc.log_class, states, rounds)
    p.emit[:, voc.unseen] = np.exp(voc.log_class[voc.unseen])  # nothing is known of them: as the base has them
    model = sc.broadcast((p, voc.log_class))
    rows = coded.where("kind = 0").select("batch", "row", "id", "train", "n_tokens", "s", "known", "classes")
    kinds = "batch long, row int, id long, train boolean, n_tokens long, s double, known long, gain double"
    scored = rows.mapInArrow(lambda it: _score(it, model), kinds)
    r = scored.join(away, ["batch", "row"], "left")
    base = F.col("s") + F.coalesce("s_away", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(voc.base)))
    return r.select(
        "id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known_away", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
