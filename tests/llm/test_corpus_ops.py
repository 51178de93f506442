"""Quality, n-gram join, embeddings, mixing, language model and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty_docs, odd_docs
from tidemark.llm import base, hmm, mixing, neighbours, ngram_join, quality

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_groups(docs):
    s, g = Sets(), [(i, grams(t)) for i, t in docs]
    for k, (i, a) in enumerate(g):
        for j, b in g[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                s.join(i, j)
    return sorted((i, len(a), s.find(i)) for i, a in g)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    got = {x.node: x.comp for x in base.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: s.find(n) for e in edges if e[0] != e[1] for n in e}
    assert base.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed, groups=6, members=9, n=90):
    """Chains: each text differs from the one before, so ends of a chain are no longer similar themselves."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(4000)]
    passage = [r.choice(vocab) for _ in range(40)]
    out = []
    for _ in range(groups):
        t = [r.choice(vocab) for _ in range(n)]
        for _ in range(members):
            t = list(t)
            t[r.randrange(n)] = r.choice(vocab)
            out.append(" ".join(t))
        out.append(" ".join(passage + [r.choice(vocab) for _ in range(r.choice([2, 8, 30, 60]))]))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("how", [{}, {"turns": 1, "deal": 500, "block": 4000}, {"heavy": 3, "often": 2, "deal": 2000}])
def test_ngram_join(spark, how):
    docs = list(enumerate(near_texts(4), 1))
    got = ngram_join.Join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **how).groups().collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == brute_groups(docs)


@pytest.mark.parametrize("how", [{}, {"turns": 1, "block": 200_000}])
def test_ngram_join_crowded_passage(spark, how):
    """One passage in 5000 texts, in shares from just under to just over what links; brute force over sets of numbers."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(50)]
    docs = []
    for i in range(5000):
        own = [f"u{i}x{j}" for j in range(r.choice([2, 5, 7, 9, 12, 20]))]
        cut = r.choice([0, 0, 0, 3, 8])
        docs.append((i + 1, " ".join(own + passage[cut:]) if r.random() < 0.5 else " ".join(passage[cut:] + own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.id: x.component_id for x in ngram_join.Join(df, **how).groups().collect()}
    sets = {i: grams(t) for i, t in docs}
    shared = np.zeros((5000, 60), np.float32)
    col = {}
    for i, x in sets.items():
        for g in x:
            if all(w[0] == "p" for w in g):
                shared[i - 1, col.setdefault(g, len(col))] = 1
    size = np.array([len(sets[i + 1]) for i in range(5000)])
    both = shared @ shared.T
    s = Sets()
    for a, b in zip(*np.nonzero(np.triu(100 * both >= 75 * (size[:, None] + size[None] - both), 1))):
        s.join(int(a) + 1, int(b) + 1)
    assert got == {i: s.find(i) for i, _ in docs}


def test_ngram_join_odd_cases(spark):
    docs = odd_docs(spark)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in ngram_join.Join(docs).groups().collect()), key=repr)
    want = brute_groups([(r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()])
    want = [(None if i == -1 else i, n, None if c == -1 else c) for i, n, c in want]
    assert got == sorted(want, key=repr) and (2, 116, 1) in got and (3, 116, 1) in got and (9, 1, 8) in got
    assert ngram_join.Join(empty_docs(spark)).groups().count() == 0


def test_ngram_join_repeated_id_keeps_its_other_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = [(3, b), (7, b), (7, a), (9, a + " more")]
    j = ngram_join.Join(spark.createDataFrame(docs, "doc_id long, text string"))
    sent = {r.text for r in j.representatives().collect()}
    assert sent == {a, b, a + " more"} and j.links().count() == 1


def test_prefix_is_long_enough():
    for n in range(1, 400):
        assert ngram_join.prefix_length(n) == n - math.ceil(0.75 * n) + 1


VEC = "vec_id long, embedding array<float>, label int, id long, cls string"


def vectors(seed=0, dim=16, hub=40, pairs=30, lone=80):
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out, c = [], unit(r.normal(size=dim))
    out += [(c + r.normal(scale=0.02, size=dim), 0) for _ in range(hub)]
    for _ in range(pairs):
        v = unit(r.normal(size=dim))
        out += [(v, 1), (v + r.normal(scale=0.03, size=dim), int(r.integers(1, 3)))]
    out += [(r.normal(size=dim), int(r.integers(0, 3))) for _ in range(lone)]
    out += [out[0], out[0], (out[3][0] * 5, 0)]
    return [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(out)]


def brute_links(rows):
    s, n = Sets(), Counter()
    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows]
    for k, (i, a, x) in enumerate(ok):
        for j, b, y in ok[:k]:
            if x == y and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                s.join(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n[i], s.find(i)) for i, *_ in rows}


def test_neighbours(spark):
    rows = vectors()
    want = brute_links(rows)
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [float("inf")] * 16, 0), (907, [], 0)]
    g = neighbours.Graph(spark.createDataFrame([(*x, 1, "z") for x in rows + odd], VEC))
    got = {x.id: x for x in g.result().collect()}
    true, found = sum(n for n, _ in want.values()), sum(min(got[i].n_links, n) for i, (n, _) in want.items())
    assert found >= 0.97 * true and all(got[i].n_links <= n for i, (n, _) in want.items()) and g.recall >= 0.9
    assert sum(got[i].component_id != c for i, (_, c) in want.items()) <= 0.03 * len(want)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 908))
    assert got[0].n_links >= 40  # a saturated list, enlarged


def crowd(n, spread, near, seed=5, dim=16):
    """One dense region: ``n`` vectors around one direction, ``near`` of them with a near copy each."""
    r = np.random.default_rng(seed)
    x = np.append(4.0, np.zeros(dim - 1)) + spread * r.standard_normal((n, dim))
    copy = x[:near] + 0.02 * r.standard_normal((near, dim))
    return [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, copy]))]


def test_neighbours_crowded_pattern(spark):
    rows = crowd(700, 0.35, 100)
    want = brute_links(rows)
    got = {x.id: x for x in neighbours.Graph(spark.createDataFrame([(*x, 1, "z") for x in rows], VEC)).result().collect()}
    true, found = sum(n for n, _ in want.values()), sum(min(got[i].n_links, n) for i, (n, _) in want.items())
    assert found >= 0.98 * true


def near_groups(n, seed=9, dim=64):
    """``n`` unrelated vectors of one label, a quarter of them with five near copies each, and two groups of 60."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(r.standard_normal((n, dim)))
    copies = [unit(x[: n // 4] + 0.012 * r.standard_normal((n // 4, dim))) for _ in range(5)]
    hubs = [unit(unit(r.standard_normal(dim)) + 0.012 * r.standard_normal((60, dim))) for _ in range(2)]
    return np.concatenate([x, *copies, *hubs]).astype(np.float32)


def test_neighbours_rounds_find_what_the_first_graph_lacks(spark):
    v = near_groups(1000)  # 2370 vectors of one label
    m = v.astype(np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, -1)
    true = {(i, j) for i, j in zip(*np.nonzero(s >= 0.98)) if i < j and j < 2250}
    g = neighbours.Graph(spark.createDataFrame([(i, x.tolist(), 0, 1, "z") for i, x in enumerate(v)], VEC))
    of = {x.cls: x.rep for x in g.classes.collect()}
    pairs = lambda d: {tuple(sorted((of[x.a], of[x.b]))) for x in d.collect()} & true
    first = g.first(9, range(2))  # too few tables to meet in
    before, after = pairs(first.where("s >= 0.98")), pairs(g.descend(first))
    assert before <= after
    assert len(before) < 0.92 * len(true) and len(true - after) < 0.5 * len(true - before), (len(before), len(after), len(true))
    out = {x.id: x for x in g.result().collect()}
    want = (s >= 0.98).sum(axis=1)
    assert sum(min(out[i].n_links, want[i]) for i in out) >= 0.99 * want.sum() and all(out[i].n_links <= want[i] for i in out)


def test_joining_links_are_a_forest():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (5, 3), (200, 150), (200, 2000)):
        i, j = r.integers(0, n, m), r.integers(0, n, m)
        at = neighbours._joining(i, j, n)
        all_, some = Sets(), Sets()
        for a, b in zip(i.tolist(), j.tolist()):
            all_.join(a, b)
        for a, b in zip(i[at].tolist(), j[at].tolist()):
            assert some.find(a) != some.find(b)
            some.join(a, b)
        assert all(all_.find(x) == some.find(x) for x in range(n))


def test_neighbours_audit_counts_vectors(spark):
    r = np.random.default_rng(1)
    big = [0.01 * r.standard_normal(16) + np.eye(16)[0] for _ in range(150)]
    one = [r.standard_normal(16) for _ in range(60)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*big, *one, *one_more(one, r)])]
    g = neighbours.Graph(spark.createDataFrame([(*x, 1, "z") for x in rows], VEC))
    bits, tables = neighbours._plan(len(rows))
    whole = g.counted(g.descend(g.first(bits, range(tables))))
    lost = whole.where(F.col("links") >= 100)  # the pairs are lost, the large group is exact
    assert g.audit(whole) >= 0.97 and g.audit(lost) < 0.5


def one_more(rows, r):
    return [v + 0.01 * r.standard_normal(len(v)) for v in rows]


def test_neighbours_falls_back_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_plan", lambda *a: (40, 300))  # too many bits for 300 tables of these
    monkeypatch.setattr(neighbours, "_patterns", lambda it, bits, tables, kind, f=neighbours._patterns: f(it, bits, range(1), kind))
    monkeypatch.setattr(neighbours, "K", 1)
    rows = crowd(100, 0.35, 40)
    want = brute_links(rows)
    g = neighbours.Graph(spark.createDataFrame([(*x, 1, "z") for x in rows], VEC))
    got = {x.id: x for x in g.result().collect()}
    assert g.recall == 1.0 and all((got[i].n_links, got[i].component_id) == x for i, x in want.items())


def test_neighbours_rounds_keep_closer_pairs(spark, monkeypatch):
    turn = lambda d, k: math.cos(math.radians(d)) * np.eye(16)[0] + math.sin(math.radians(d)) * np.eye(16)[k]
    v = [turn(0, 1), turn(20, 1), turn(40, 1), turn(60, 1), turn(5, 2)]  # only the first and the last are a link
    g = neighbours.Graph(spark.createDataFrame([(i, x.tolist(), 0, 1, "z") for i, x in enumerate(v)], VEC))
    c = {x.rep: x.cls for x in g.classes.collect()}
    path = [(0, 1), (1, 2), (2, 3), (3, 4)]
    edges = spark.createDataFrame([(min(c[i], c[j]), max(c[i], c[j]), float(v[i] @ v[j])) for i, j in path], "a long, b long, s double")
    assert {frozenset(x) for x in g.descend(edges).collect()} == {frozenset((c[0], c[4]))}


def test_neighbours_empty(spark):
    assert neighbours.Graph(spark.createDataFrame([], VEC)).result().count() == 0


def test_mix_targets_and_copies(spark):
    r = random.Random(0)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 20, 20, 20, 300])), "en", r.choice(["hot", "hot", "hot", "b", "c", None, "é"])) for i in range(1500)] + [(5000, "w w", "en", "tiny"), (5000, "w w", "en", "tiny")]
    docs = odd_docs(spark, rows)
    m = mixing.mix(docs, cell=16).collect()
    assert len(m) == len(rows)
    size = Counter()
    for x in m:
        size[x.source] += x.size
    names = sorted(k for k in size if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[k] for k in capped)
        w = sum(weight[k] for k in names if k not in capped)
        goal = {k: 2 * size[k] if k in capped else rest * weight[k] / w for k in names}
        over = {k for k in names if k not in capped and goal[k] > 2 * size[k]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for x in m:
        assert x.target == pytest.approx(goal[x.source]) and x.source_size == size[x.source] and 0 <= x.copies <= 2
        taken[x.source] += x.copies * x.size
    for k in names:
        assert abs(taken[k] - goal[k]) <= max(600, 0.05 * goal[k]), k
    again = {(x.id, x.copies) for x in mixing.mix(docs.repartition(7), cell=16).collect()}
    assert again == {(x.id, x.copies) for x in m}


def test_mix_odd_cases(spark):
    docs = odd_docs(spark)
    m = mixing.mix(docs).collect()
    assert len(m) == docs.count() and {x.size for x in m if x.id in (4, 5, 6)} == {0}
    assert mixing.mix(empty_docs(spark)).count() == 0
    e = mixing.emit(docs)
    assert e.columns == docs.columns and all(v <= 4 for v in Counter(x.doc_id for x in e.collect()).values())
    lost = odd_docs(spark, [(None, f"text number {i} of some words", "en", "a") for i in range(200)] + [(1, "one", "en", "a"), (2, None, "en", None)])
    taken = Counter(x.text for x in mixing.emit(lost).where("doc_id IS NULL").collect())
    assert 90 <= len(taken) and abs(sum(taken.values()) - 300) <= 10 and max(taken.values()) <= 2  # each on its own, near the target


def test_classifier_learns_and_is_fair(spark, sf_dir):
    docs, labels = base.table(spark, "/root/testdata/sf0.01", "documents"), base.table(spark, "/root/testdata/sf0.01", "labels")
    w = quality.train(docs.select("doc_id", "text"), labels)
    s = quality.score(docs, w).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    good, bad = [x.score for x in s if x.quality == 1], [x.score for x in s if x.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and np.mean([x >= quality.KEEP for x in good]) > 0.95
    # Labels of held-out documents are not looked at.
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(w, quality.train(docs.select("doc_id", "text"), other))


def test_labels_of_other_documents_use_up_no_place(spark):
    docs = odd_docs(spark, [(i, "good words here" if i % 2 else "bad things there", "en", "a") for i in range(100)])
    labels = [(i, i % 2, 0) for i in range(100)]
    other = [(i, i % 2, 0) for i in range(1000, 3000)]
    kind = "doc_id long, quality int, toxic int"
    alone = quality.train(docs, spark.createDataFrame(labels, kind), rows=60)
    assert alone.any() and np.array_equal(quality.train(docs, spark.createDataFrame(labels + other, kind), rows=60), alone)


def test_classifier_odd_cases(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (7, 0)], "doc_id long, quality int")
    w = quality.train(docs.select("doc_id", "text"), labels)
    got = quality.score(docs, w, out="s").collect()
    assert len(got) == docs.count() and all(0 <= x.s <= 1 for x in got) and len({x.s for x in got if x.doc_id in (4, 5, 6)}) == 1
    none = quality.train(docs.select("doc_id", "text"), labels.limit(0))
    assert {x.s for x in quality.score(docs, none, out="s").collect()} == {0.5}
    assert quality.score(empty_docs(spark), w).count() == 0


def test_update_is_the_published_one():
    f, z, n = quality.Ftrl(4, 0.1, 1.0, 0.01, 0.1), np.zeros(4), np.zeros(4)
    r = np.random.default_rng(0)
    for _ in range(50):
        x, y = r.normal(size=4), float(r.integers(0, 2))
        w = np.array([0.0 if abs(a) <= 0.01 else -(a - np.sign(a) * 0.01) / ((1.0 + math.sqrt(b)) / 0.1 + 0.1) for a, b in zip(z, n)])
        g = (1 / (1 + math.exp(-w @ x)) - y) * x
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / 0.1
        z, n = z + g - s * w, n + g * g
        f.learn(np.arange(4), x, y)
    np.testing.assert_allclose(f.z[:4], z)


def _tokens(docs):
    return {i: [*words(t), None] for i, t in docs}


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_counts_and_base(spark, sf_dir, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    docs = base.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    c = Counter()
    for i, t in _tokens(rows).items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(t)
    total, distinct = sum(c.values()), len(c)
    got = {x.id: x for x in hmm.score(docs, rounds=2).collect()}
    for i, t in _tokens(rows).items():
        x = got[i]
        want = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert x.base_score == pytest.approx(want, rel=1e-9) and x.n_tokens == len(t) and x.n_known == sum(w in c for w in t) and x.train_tokens == total
        assert math.isfinite(x.score) and x.score < 0
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_language_model_odd_cases(spark):
    got = hmm.score(odd_docs(spark), rounds=1).collect()
    assert len(got) == 15 and {x.n_tokens for x in got if x.id in (4, 5, 6)} == {1} and all(math.isfinite(x.score) for x in got)
    assert hmm.score(empty_docs(spark), rounds=1).count() == 0


def _paths(seq, p):
    """Likelihood by summing over all state paths."""
    from itertools import product

    k = len(p.start)
    return sum(math.prod([p.start[s[0]] * p.emit[s[0], seq[0]], *[p.move[a, b] * p.emit[b, o] for a, b, o in zip(s, s[1:], seq[1:])]]) for s in product(range(k), repeat=len(seq)))


def _plain_counts(seq, p):
    """Expected counts of one whole text by the textbook's forward and backward recursions."""
    k, n = len(p.start), len(seq)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = p.start * p.emit[:, seq[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ p.move) * p.emit[:, seq[t]]
    for t in range(n - 2, -1, -1):
        b[t] = p.move @ (p.emit[:, seq[t + 1]] * b[t + 1])
    whole = a[-1].sum()
    move = sum(np.outer(a[t], p.emit[:, seq[t + 1]] * b[t + 1]) * p.move for t in range(n - 1)) / whole if n > 1 else np.zeros((k, k))
    emit = np.zeros_like(p.emit)
    for t in range(n):
        emit[:, seq[t]] += a[t] * b[t] / whole
    return a[0] * b[0] / whole, move, emit, math.log(whole)


@pytest.mark.parametrize("length", [1, 3, 8, 10**3])
def test_segments_give_what_whole_texts_give(length):
    r = np.random.default_rng(0)
    p = hmm.Params(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(6), 3))
    seqs = [r.integers(0, 6, n).astype(np.uint16) for n in (1, 4, 70, 8, 2, 33, 16)]
    want = [sum(x) for x in zip(*[_plain_counts(s, p) for s in seqs])]
    for got, w in zip(hmm.expected(seqs, p, length), want):
        np.testing.assert_allclose(got, w, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(hmm.likelihood(seqs, p, length), [_plain_counts(s, p)[3] for s in seqs])


def test_forward_is_exact_and_training_climbs():
    r = np.random.default_rng(0)
    p = hmm.Params(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), r.dirichlet(np.ones(5), 2))
    seqs = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 7, 2)]
    np.testing.assert_allclose(hmm.likelihood(seqs, p), [math.log(_paths(s, p)) for s in seqs])
    long = [r.integers(0, 5, n).astype(np.uint16) for n in (30, 200, 64, 65, 1, 3000)]
    told = []
    for _ in range(6):
        start, move, emit, ll = hmm.expected(long, p)
        assert emit.sum() == pytest.approx(sum(map(len, long))) and move.sum() == pytest.approx(sum(len(s) - 1 for s in long))
        told.append(ll)
        p = hmm.Params(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    assert all(b >= a - 1e-9 for a, b in zip(told, told[1:]))


def test_classes_are_a_distribution_and_grow():
    h, e = np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint16) % 3
    n = np.arange(1, 11)
    c = hmm.rest_class(h, e, hmm.REST)
    v = hmm.Vocabulary(h, n, e, np.bincount(c, minlength=hmm.REST), np.bincount(c, weights=n, minlength=hmm.REST), 12, 70)
    assert np.exp(v.log_class).sum() == pytest.approx(1)
    assert hmm.sizes(0) == (hmm.OWN, hmm.REST) and hmm.sizes(10**6) == (15_625, 15_625) and sum(hmm.sizes(10**9)) < 65_535


def test_scores_are_those_of_a_plain_model(spark):
    """The query's scores from counts, classes, training and likelihood written out with dictionaries and loops."""
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["the", "The", "cat", "sat", "on", "mats", "rats", "ran"]) for _ in range(r.choice([0, 1, 5, 90, 200])))) for i in range(40)]
    got = {x.id: x.score for x in hmm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), rounds=2).collect()}
    texts = {i: [*words(t), "END"] for i, t in docs}
    train = [texts[i] for i, _ in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    total, k = sum(c.values()), hmm.STATES
    own, rest = hmm.sizes(len(c))
    hashes = {}
    for w in c:
        if w != "END":
            data = np.frombuffer(w.encode(), np.uint8)
            hashes[w] = int(hmm.span_hash(data, np.array([0]), np.array([len(data)]))[0])
    order = sorted((w for w in c if w != "END"), key=lambda w: (-c[w], hashes[w]))
    cls = {w: i for i, w in enumerate(order)} | {"END": own}
    mass = np.full(own + 1 + rest, 0.5 / (own + 1 + rest))
    for w, i in cls.items():
        mass[i] += c[w] + 0.5
    log_class = np.log(mass / mass.sum())
    p = hmm.Params.first(log_class, k)
    for _ in range(2):
        sums = [sum(x) for x in zip(*[_plain_counts([cls[w] for w in t], p)[:3] for t in train])]
        move, emit = sums[1] + 0.01, sums[2] + hmm.PRIOR * np.exp(log_class)[None, :]
        p = hmm.Params((sums[0] + 0.01) / (sums[0] + 0.01).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    for i, t in texts.items():
        base_ = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in t)
        seq = [cls[w] for w in t]
        want = base_ + (_plain_counts(seq, p)[3] - sum(log_class[x] for x in seq)) / math.log(10)
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_rare_classes_in_a_row_stay_finite():
    """Long texts of classes that are all very rare: the matrices of segments stay inside single precision."""
    r = np.random.default_rng(2)
    emit = np.append(np.full(5000, 1e-7), 1 - 5e-4)
    p = hmm.Params(np.full(4, 0.25, np.float32), r.dirichlet(np.ones(4), 4).astype(np.float32), np.tile(emit, (4, 1)).astype(np.float32))
    seqs = [r.integers(0, 5000, 5000).astype(np.uint16), np.full(3, 5000, np.uint16)]
    assert all(np.isfinite(x).all() for x in hmm.expected(seqs, p))


def test_unlike_texts_score_near_the_base(spark):
    """A held-out text of words and word endings that training never had is about as likely as in the base; without training too."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    r = random.Random(5)
    new = lambda: "".join(r.choice("qxzjkvw") for _ in range(9))
    docs = [(i, " ".join(new() if i in held else r.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(400))) for i in range(60)]
    for rows in (docs, [d for d in docs if d[0] in held]):
        got = [x for x in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=2).collect() if x.held_out]
        assert len(got) == len(held) and all(x.score > x.base_score - 6.001 for x in got)
        assert sum(x.score - x.base_score for x in got) / len(got) > -4


def test_the_end_is_known_however_rare(monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 4)
    h, n = np.array([5, 6, 7, 8, int(hmm.END)], np.uint64), np.array([9, 9, 9, 9, 1])
    c = hmm.rest_class(h, np.zeros(5, np.uint16), hmm.REST)
    v = hmm.Vocabulary(h, n, np.zeros(5, np.uint16), np.bincount(c, minlength=hmm.REST), np.bincount(c, weights=n, minlength=hmm.REST), 5, 37)
    assert v.find(np.array([hmm.END]), np.zeros(1, np.uint16)) == (1, v.own) and not v.unseen[v.own]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = base.table(spark, sf_dir, "documents")
    at = docs
    for name, stage in cp.STAGES:
        before, at = at, base.store(stage(spark, at, sf_dir), "t")
        if name != cp.STAGES[-1][0]:
            assert at.columns == docs.columns
        if name == "quality classifier":
            clean = base.table(spark, sf_dir, "labels").where("quality = 1").join(docs, "doc_id", "left_semi")
            assert at.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()
        elif name == "n-gram Jaccard join":
            want = {c for _, _, c in brute_groups([(r.doc_id, r.text) for r in before.collect()])}
            assert {r.doc_id for r in at.collect()} == want
        elif name == "secret scans":
            text = {r.doc_id: r.text for r in before.collect()}
            from tests.llm.test_text_ops import spans

            got = {r.doc_id: r.text for r in at.collect()}
            assert all((got[i] == t) == (spans(t) == "") and spans(got[i]) == "" for i, t in text.items())
        elif name.startswith("mixing"):
            size = sum(len(words(r.text)) for r in before.collect())
            assert sum(len(words(r.text)) for r in at.collect()) == pytest.approx(1.5 * size, rel=0.1)
        else:
            assert at.count() == before.count()
    assert cp.run(spark, sf_dir).count() == at.count()
