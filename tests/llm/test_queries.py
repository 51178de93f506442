"""Every registered query through the registry: names and types of its columns, and its rows against the libraries or plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty_docs, odd_docs
from tests.llm.test_corpus_ops import brute_groups, brute_links, words
from tests.llm.test_text_ops import M64, _brute_fingerprints, _hashed, _library, _splitmix
from tidemark.llm import base, chunks, ngram_join, quality, registry

COLUMNS = {
    "op1_secret_scan": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op2_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op3_sentencepiece": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op4_embedding_near_dedup": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op5_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op6_ngram_jaccard": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op7_chat_format": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op8_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op9_fingerprints": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op10_lm_scores": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op11_whitening": "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double",
    "op12_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op13_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    done = {}

    def of(name):
        if name not in done:
            df = registry.QUERIES[name](spark, sf_dir)
            done[name] = (df.dtypes, df.collect())
        return done[name]

    return of


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return base.table(spark, sf_dir, "documents").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(results, docs, name):
    kinds, rows = results(name)
    assert dict(x.split(":") for x in COLUMNS[name].split()).items() <= dict(kinds).items()
    if "doc_id" in dict(kinds):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)


def test_sentencepiece(results, docs):
    sp, sha = _library(), lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results("op3_sentencepiece")[1]}
    for d in docs:
        ids = sp.encode(d.text or "", add_eos=True)
        assert got[d.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_token_counts(results, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in results("op5_token_counts")[1]}
    for d in docs:
        n = len(lib.encode(d.text or "", add_special_tokens=False).ids)
        assert got[d.doc_id] == (len((d.text or "").encode()), n, n > 512)


def test_ngram_jaccard(results, docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in results("op6_ngram_jaccard")[1])
    assert got == brute_groups([tuple(d) for d in docs])


def test_embeddings(spark, sf_dir, results):
    rows = [(r.vec_id, r.embedding, r.label) for r in base.table(spark, sf_dir, "embeddings").collect()]
    want = brute_links([r for r in rows if r[1] is not None and r[2] is not None and np.isfinite(np.array(r[1], float)).all() and np.any(r[1])])
    got = {r.vec_id: r for r in results("op4_embedding_near_dedup")[1]}
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    total = sum(n for n, _ in want.values())
    assert sum(min(got[i].n_links, n) for i, (n, _) in want.items()) >= 0.97 * total and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].component_id != c for i, (_, c) in want.items()) <= 0.03 * len(want)


def test_fingerprints(spark, sf_dir, results):
    d = base.table(spark, sf_dir, "documents")
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in results("op9_fingerprints")[1]]
    short = d.where(F.length("text") < 3000)  # the plain chunker goes byte by byte
    ids = {r.doc_id for r in short.collect()}
    want = {r[0]: r for r in _brute_fingerprints(_hashed(d.withColumn("text", F.col("text"))))} if len(ids) == d.count() else None
    by = {g[0]: g for g in got}
    if want is None:
        rows = sorted(((r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect()), reverse=True)
        from tests.llm.test_text_ops import plain_records, plain_share

        for i, (k, t) in enumerate(rows):
            n = rows[(i + 1) % len(rows)][1]
            if len(t) + len(n) > 6000:
                continue
            e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            a, b, c = (plain_records(x.encode()) for x in (t, e, n))
            assert by[k][1:3] == (len(t), hashlib.sha256(e.encode()).hexdigest()) and by[k][5:] == (plain_share(a, b), plain_share(a, c))
    else:
        assert by == want


def test_lm_scores(results, docs):
    tokens = {d.doc_id: [*words(d.text), None] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in results("op10_lm_scores")[1]}
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    # The model is a better one than the base on texts it has not seen.
    assert sum(r.score - r.base_score for r in rows.values() if r.held_out) > 0


SHAPES = {**{chr(i): "A" for i in range(65, 91)}, **{chr(i): "a" for i in range(97, 123)}, **{chr(i): "0" for i in range(48, 58)}}


def _digest(data):
    total, p = 1, 1
    for y in data:
        total, p = (total + _splitmix((y + 1) * 0x9E3779B97F4A7C15 & M64) * p) & M64, p * 0x9E3779B97F4A7C15 & M64
    return _splitmix(total)


def plain_features(text):
    """Weight index -> value, with dictionaries and Python's numbers."""
    raw = [w.encode() for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    low = [_digest(bytes(b + 32 if 65 <= b < 91 else b for b in w)) for w in raw]
    shapes = []
    for w in raw:
        s = [ord(SHAPES.get(chr(b), "a" if b >= 128 else chr(b))) for b in w]
        shapes.append(_digest(bytes(x for i, x in enumerate(s) if i == 0 or x != s[i - 1])))
    keys = [h + 1 for h in low] + [a * 3 + b + 2 for a, b in zip(low, low[1:])] + [g + 3 for g in shapes] + [a * 3 + b + 4 for a, b in zip(shapes, shapes[1:])]
    keys += [(a * 3 + b) * 5 + c + 5 for a, b, c in zip(shapes, shapes[1:], shapes[2:])] + [6 for a, b in zip(low, low[1:]) if a == b]
    n = Counter(_splitmix(k & M64) % quality.DIMS for k in keys)
    return {k: x * quality.SCALE / max(len(raw), 1) for k, x in n.items()}


def test_quality(spark, sf_dir, results, docs):
    """Features, the order of training, its updates and the scores, written out plainly."""
    y = {}
    for r in base.table(spark, sf_dir, "labels").collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            y.setdefault(r.doc_id, []).append(float(r.quality))
    at = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in y], "doc_id long").select("doc_id", F.xxhash64("doc_id")).collect()}
    f = {d.doc_id: plain_features(d.text) for d in docs}
    z, n = Counter(), Counter()
    one = quality.DIMS  # the intercept

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    def margin(x):
        return sum(weight(k) * v for k, v in x.items()) + weight(one)

    for _ in range(quality.EPOCHS):
        for i in sorted((i for i in y if i in f), key=lambda i: (at[i], i)):
            x = f[i] | {one: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - sum(y[i]) / len(y[i])) * v
                s = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA
                z[k] += g - s * w[k]
                n[k] += g * g
    for r in results("op2_quality")[1]:
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin(f[r.doc_id]))), abs=2e-3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


# The pipeline on odd tables ----------------------------------------------------------------------------------------


@pytest.fixture
def folder(spark, tmp_path):
    def put(d, labels=()):
        d.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return put


def test_near_copies_never_take_another_text_with_them(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    d = odd_docs(spark, [(3, a, "en", "x"), (5, a, "en", "x"), (5, b, "en", "x"), (9, b + " more", "en", "x"), (2, "short", "en", "x"), (2, "short", "en", "x"), (None, a, "en", "x"), (4, "", "en", "x"), (4, None, "en", "x")])
    d = d.withColumn("_cls", F.lit("clash"))
    got = ngram_join.keep_first(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, a), (5, b), (2, "short"), (None, a), (4, ""), (4, None)], key=repr)


def test_pipeline_on_odd_documents(spark, folder):
    import corpus_pipeline as cp

    path = folder(odd_docs(spark), [(1, 1, 0), (3, 1, 0), (7, 0, 0), (9, None, 1), (None, 1, 0)])
    docs = base.table(spark, path, "documents")
    at = docs
    for name, stage in cp.STAGES:
        at = base.store(stage(spark, at, path), "t")
        assert name == cp.STAGES[-1][0] or at.columns == docs.columns
    assert at.count() == cp.run(spark, path).count() > 0


def test_pipeline_on_an_empty_table(spark, folder):
    import corpus_pipeline as cp

    assert cp.run(spark, folder(empty_docs(spark))).count() == 0


def test_operators_on_an_empty_table(spark, folder, tmp_path):
    path = folder(empty_docs(spark))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, q in registry.QUERIES.items():
        assert q(spark, path).count() == (1 if name.startswith("op7") else 0)
    assert chunks.RANGE > 0
