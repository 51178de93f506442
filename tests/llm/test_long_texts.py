"""One very long text takes time in proportion, and gives what a plain loop gives."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import odd_docs
from tidemark.llm import pieces, secrets
from tidemark.llm.tokencount import vocabulary_path


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(pieces.MODEL))


def _plain(library, text):
    ids = library.encode(text) + [library.eos_id()]
    return " ".join(map(str, ids)), library.decode(ids)


@pytest.mark.parametrize("kind", [" ", "-", "\t", "hex", "=", "letters"])
def test_pieces_of_a_long_segment(library, kind):
    r = random.Random(1)
    make = {"hex": lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n)), "letters": lambda n: "".join(r.choice("aeioustrnmlé") for _ in range(n))}.get(kind, lambda n: kind * n)
    enc = pieces.Encoder()
    enc.run([make(3000)])
    took = []
    for n in (100_000, 200_000):
        text = make(n)
        begin = time.perf_counter()
        ids, decoded = enc.run([text])[0]
        took.append(time.perf_counter() - begin)
        assert (ids, decoded.decode("utf-8", "replace")) == _plain(library, text)
    assert took[1] < 2.5 * took[0] + 0.3, took


def test_pieces_of_random_long_segments(library):
    r = random.Random(2)
    enc = pieces.Encoder()
    for _ in range(150):
        alphabet = r.choice(["ab ", "-= ", "  \t", "01ef", "é日▁ ", "=-_*# ", "the "])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(250, 1200)))
        ids, decoded = enc.run([text])[0]
        assert (ids, decoded.decode("utf-8", "replace")) == _plain(library, text), repr(text)


def _keys(n, seed=3):
    r = random.Random(seed)
    return " ".join(r.choice(["é", "token = ", "x "]) + "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(16, 20))) for _ in range(n))


def _found(text):
    """The base rules by a plain loop."""
    out = []
    for order, (kind, pattern, group, least) in enumerate((("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def _masked(text, spans):
    at, out = 0, []
    for start, _, _, end in spans:
        if start >= at:
            out.append(text[at:start] + "[SECRET]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_secrets_of_a_long_text(spark):
    took = []
    for n in (25_000, 50_000):
        text = _keys(n)
        docs = odd_docs(spark, [(1, text, "en", "a"), (2, "nothing here", "en", "a")])
        begin = time.perf_counter()
        rows = {r.doc_id: r for r in secrets.update(docs, ["doc_id"], secrets.own_ledger(spark)).collect()}
        clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
        took.append(time.perf_counter() - begin)
        want = _found(text)
        assert len(want) > n and [tuple(s) for s in rows[1].spans] == want and not rows[2].spans
        assert clean == {1: _masked(text, want), 2: "nothing here"}
    assert took[1] < 2.5 * took[0] + 1, took


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 512, 700])
def test_runs_of_spans_meet(spark, n):
    text = _keys(n, seed=n)
    docs = odd_docs(spark, [(1, text, "en", "a")])
    assert secrets.redact(docs).select("text", F.col("n_chars")).first() == (_masked(text, _found(text)), len(_masked(text, _found(text))))
