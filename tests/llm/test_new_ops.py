"""Whitening, decontamination and fill-in-middle against brute force, with every odd case."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty_docs, odd_docs
from tidemark.llm import decontaminate, infill, whitening
from tidemark.llm.base import table

VECTORS = "vec_id long, embedding array<float>, label int, id string, n long, component string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], VECTORS)


def _brute(vectors, grid):
    x = np.array([[math.floor(grid.steps * float(c)) + grid.shift if grid else float(c) for c in v] for v in vectors], np.float64)
    y = x - x.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    return e[::-1], np.abs(y @ u[:, ::-1]) / np.sqrt(np.maximum(e[::-1], 1e-300)), e.sum()


def test_whitening_is_that_of_the_covariance(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").repartition(7)
    rows = {r.vec_id: r.embedding for r in t.collect()}
    grid = whitening.Grid()
    w = whitening.fit(t, grid=grid, block=37, fan=2)
    ids = sorted(rows)
    e, y, trace = _brute([rows[i] for i in ids], grid)
    assert np.allclose(w.values, e[:8], rtol=1e-10) and w.trace == pytest.approx(trace, rel=1e-12)
    assert w.fit.n == len(ids) and len(w.fit.values) == 64  # nothing is cut off
    got = {(r.id, r.component): r for r in whitening.transform(t, w).collect()}
    assert len(got) == 8 * len(ids)
    n = len(ids)
    x = [[math.floor(1024 * float(c)) + 100000 for c in rows[i]] for i in ids]
    s = [sum(c) for c in zip(*x)]
    for k, i in enumerate(ids):
        assert got[i, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(x[k], s))
        for c in range(8):
            assert abs(got[i, c + 1].whitened) == pytest.approx(y[k, c], abs=1e-8)
    assert whitening.identity_error(t, w) < 1e-10


def test_the_query_of_whitening(spark, sf_dir):
    from tidemark.llm.registry import QUERIES

    out = QUERIES["op11_whitening"](spark, sf_dir)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert out.agg(F.max("identity_error")).first()[0] < 1e-8 and out.select("identity_error").distinct().count() == 1


def test_merging_loses_nothing():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 6)) * [1e4, 1e2, 1, 1e-2, 1e-4, 1e-5] + 1e3
    whole = whitening.summary_of(x, False)
    cuts = [0, 1, 3, 90, 91, 200, 300]
    parts = [whitening.summary_of(x[a:b], False) for a, b in zip(cuts, cuts[1:])]
    for order in (parts, parts[::-1]):
        out = order[0]
        for p in order[1:]:
            out = whitening.merge(out, p)
        assert out.n == 300 and np.allclose(out.mean, whole.mean, rtol=1e-12)
        assert np.allclose(out.values, whole.values, rtol=1e-4) and len(out.values) == 6  # the least is 1e-9 of the largest
        assert np.allclose(np.abs((out.vectors * whole.vectors).sum(axis=1)), 1, atol=1e-6)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, 0.3]), (2, [0.5, 0.1, 0.9]), (2, [0.5, 0.1, 0.9]), (None, [0.4, 0.4, 0.1]), (3, [0.0, 0.0, 0.0])]
    bad = [(4, None), (5, []), (6, [nan, 1.0, 2.0]), (7, [inf, 1.0, 2.0]), (8, [None, 1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0] * 5)]
    t = _vectors(spark, good + bad)
    w = whitening.fit(t, grid=whitening.Grid())
    out = whitening.transform(t, w).collect()
    assert sorted((str(r.id) for r in out)) == sorted(str(i) for i, _ in good for _ in range(3))
    _, y, _ = _brute([[np.float32(c) for c in v] for _, v in good], whitening.Grid())
    assert sorted(abs(r.whitened) for r in out if r.component == 1) == pytest.approx(sorted(y[:, 0]), abs=1e-9)
    assert whitening.identity_error(t, w) < 1e-10
    assert whitening.fit(_vectors(spark, bad[:5]), grid=whitening.Grid()) is None
    assert whitening.fit(_vectors(spark, []), grid=whitening.Grid()) is None


def test_equal_few_and_huge_vectors(spark):
    same = _vectors(spark, [(i, [0.25, -0.5]) for i in range(5)])
    w = whitening.fit(same, grid=whitening.Grid())
    out = whitening.transform(same, w).collect()
    assert len(out) == 10 and all(r.whitened is None and r.deviation == 0 for r in out)
    assert w.trace == 0 and whitening.identity_error(same, w) == 0
    few = _vectors(spark, [(1, [1.0, 2.0, 3.0, 4.0]), (2, [2.0, 1.0, 0.0, 4.0])])
    w = whitening.fit(few, grid=whitening.Grid())
    assert [r.whitened is None for r in sorted(whitening.transform(few, w).where("id = 1").collect(), key=lambda r: r.component)] == [False, True, True, True]
    assert whitening.identity_error(few, w) < 1e-10
    huge = _vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])
    w = whitening.fit(huge, grid=whitening.Grid())
    assert all(r.deviation is None for r in whitening.transform(huge, w).collect())
    mid = _vectors(spark, [(i, [float(i) * 1e6, 1.0]) for i in range(4)])  # squares beyond the quick path, within a long
    w = whitening.fit(mid, grid=whitening.Grid())
    x = [math.floor(1024 * float(np.float32(i * 1e6))) + 100000 for i in range(4)]
    want = {i: (4 * x[i] - sum(x)) ** 2 for i in range(4)}
    assert {r.id: r.deviation for r in whitening.transform(mid, w).collect()} == {i: v if v < 1 << 63 else None for i, v in want.items()}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _plain_hits(text, items, window=10):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    at = list(WORD.finditer(lower(text)))
    words = [m.group() for m in at]
    hit, found = set(), set()
    for name, t in items:
        v = WORD.findall(lower(t))
        k = min(len(v), window)
        own = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in own:
                hit.update(range(i, i + k))
                if name is not None:
                    found.add(str(name))
    runs = [(min(r), max(r)) for r in _runs(sorted(hit))]
    return len(words), sorted(found), [(a, b, at[a].start(), at[b].end()) for a, b in runs]


def _runs(numbers):
    out = []
    for x in numbers:
        if out and x == out[-1][-1] + 1:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _contaminated(spark):
    r = random.Random(11)
    word = lambda: r.choice(["a", "B", "é1", "日本", "x9", "Zed"])
    items = [(1, " ".join(word() for _ in range(14))), (2, "One two, THREE"), (3, None), (4, " -- !"), (None, "no id at all here"), (5, "lone"), (6, "One two, THREE"), (6, "One two, THREE"), (7, " ".join(f"t{i}" for i in range(40)))]
    texts = [" ".join(word() for _ in range(r.randrange(300))) for _ in range(25)]
    texts += ["start " + items[0][1].replace(" ", ",\n") + " end", "one-TWO-three", "é😀 no id AT all here 😀 lone, lone.", None, "", "...", items[8][1] + " gap " + items[8][1][:60]]
    texts += [" ".join(f"t{i}" for i in range(20, 40)) + " t1", "lone " * 400]
    rows = [(i, t, None, "s", 0, "x", "y", 0.5, 1) for i, t in enumerate(texts)] + [(None, "One two three", "en", "s", 1, "x", "y", 0.5, 1), (0, texts[0], "en", "s", 1, "x", "y", 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, items string, spans long, id string, k0 string, digest double, n_words int")
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int"), items


@pytest.mark.parametrize("how", [{}, {"room": 60, "piece": 5}, {"room": 200, "piece": 12}])
def test_decontamination_is_that_of_all_windows(spark, how):
    docs, bench, items = _contaminated(spark)
    got = decontaminate.hits(docs, bench, ["doc_id", "text"], **how).collect()
    want = sorted([repr((r.doc_id, *_plain_hits(r.text, items))) for r in docs.collect()])
    assert sorted(repr((r.doc_id, r.n_words, r["items"], [tuple(s) for s in r.spans])) for r in got) == want


@pytest.mark.parametrize("how", [{}, {"room": 60, "piece": 5}])
def test_removal_of_spans_and_documents(spark, how):
    docs, bench, items = _contaminated(spark)
    out = decontaminate.clean(docs, bench, **how)
    assert out.dtypes == docs.dtypes

    def cut(text):
        if text is None:
            return None
        at, parts = 0, []
        for _, _, a, b in _plain_hits(text, items)[2]:
            parts.append(text[at:a])
            at = b
        return "".join(parts) + text[at:]

    key = lambda r: (str(r[0]), r[1] or "", str(r))
    assert sorted(out.collect(), key=key) == sorted([r.__class__(*[cut(v) if c == "text" else v for c, v in r.asDict().items()]) for r in docs.collect()], key=key)
    rest = decontaminate.clean(docs, bench, remove="documents", **how).collect()
    assert sorted(map(str, rest)) == sorted(str(r) for r in docs.collect() if not _plain_hits(r.text, items)[2])


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "runs", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))
    items = [(str(i), " ".join(f"{c}{j}" for j in range(11))) for i, c in enumerate("abc")]
    x = decontaminate.index([i for i, _ in items], [t for _, t in items])
    texts = [items[1][1], " ".join(f"b{j}" for j in range(9)), "q " + items[2][1] + " q " + items[0][1]]
    data, off = decontaminate.strings(__import__("pyarrow").array(texts))
    got = decontaminate.scan(data, off, x)
    assert [(n, names, [tuple(s.values()) for s in spans]) for n, names, spans in got] == [_plain_hits(t, items) for t in texts]


def test_decontamination_of_empty_tables(spark):
    docs, bench, _ = _contaminated(spark)
    assert decontaminate.hits(empty_docs(spark), bench, ["doc_id"]).count() == 0
    none = decontaminate.hits(docs, bench.limit(0), ["doc_id"]).collect()
    assert len(none) == docs.count() and not any(r.spans or r["items"] for r in none)


def test_a_long_text_with_many_hits_takes_time_in_proportion():
    import time

    import pyarrow as pa

    x = decontaminate.index(["1"], ["lone word"])
    took = []
    for n in (50_000, 100_000):
        data, off = decontaminate.strings(pa.array(["lone word é " * n]))
        begin = time.perf_counter()
        (words, names, spans), *_ = decontaminate.scan(data, off, x)
        took.append(time.perf_counter() - begin)
        assert (words, names, len(spans)) == (3 * n, ["1"], n) and spans[-1]["end"] == 12 * n - 3
    assert took[1] < 2.5 * took[0] + 0.5


def _plain_fill(text, key, seed=7, rate=100, first=50):
    import hashlib

    text = text or ""
    u = re.findall("[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < first else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 13])
def test_ropes_are_plain_strings(size):
    r = random.Random(size)
    for k in range(300):
        text = "".join(r.choice(["a", "é", "日", "😀", "\n", "\n\n", "<", "<P", "\r\n", "\x00", ">"]) for _ in range(r.randrange(60)))
        got = infill.fill(text.encode(), str(k), size=size)
        assert (*got[:4], got.output.decode()) == _plain_fill(text, k)
        assert infill.restore(got.output, got.form, size=size).decode() == text
        tree = infill.rope(text.encode(), size)
        assert tree.chars == len(text) and tree.ends == text.count("\n")
        at = r.randrange(len(text) + 1)
        assert [infill.flat(x).decode() for x in infill.split_chars(tree, at)] == [text[:at], text[at:]]


def test_rates_of_fill_in_middle():
    how = infill.Infill(seed=3, rate=40, suffix_first=10)
    for k in range(200):
        got = infill.fill(b"a\nb\nc", str(k), how)
        assert (*got[:4], got.output.decode()) == _plain_fill("a\nb\nc", k, 3, 40, 10)


def test_fill_in_middle_of_odd_documents(spark):
    long = "line of text\n" * 200_000
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one line", "en", "a"), (None, "no\nid\n", "en", "a"), (4, "has <S> in it\n", "en", "a"), (5, "\n\n\n", "en", "a"), (6, long, "en", "a"), (6, long + "é", "en", "a"), (7, "tail\nwithout end", None, None), (7, "tail\nwithout end", None, None), (8, "<P" + "\n<", "en", "a"), (-7, "a\nb", "en", "a")]
    docs = odd_docs(spark, rows)
    out = infill.invert(infill.transform(docs)).collect()
    assert len(out) == len(rows)
    want = sorted(repr((i, *_plain_fill(t, "" if i is None else i), t or "")) for i, t, *_ in rows)
    assert sorted(repr((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in out) == want
    assert infill.invert(infill.transform(empty_docs(spark))).count() == 0
