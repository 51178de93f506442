"""Fill-in-middle transformation over ropes.

A text is a balanced tree over leaves of some ``LEAF`` bytes that begin at code points; leaves and nodes cache how many lines end
in them and how many code points they hold. The tree is split at two line ranks by going down once each, its three parts are
concatenated in another order with marks between them, and only then is the text put together. The way back splits the tree of the
output at the marks, by code points, and concatenates in the old order.

What happens to a text depends on its id and the seed alone: four numbers of a SHA-256. Rows are independent: no shuffle, nothing is
skewed, and a repeated task gives the same. A worker holds one slice of texts and the trees of one.

Defined cases: null and empty texts are plain; so is a text that holds a mark, which could not be inverted; a null id counts as an
empty one; a last line without an end counts as a line; a text of one very long line is split before or behind it; equal ranks leave
the middle empty; repeated rows are repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table
from .kernel import slices, strings, trim

#: The marks before prefix, suffix and middle. None begins inside another, so a mark is found where it was put.
MARKS = (b"<P>", b"<S>", b"<M>")
LEAF = 1 << 13


class Rope(NamedTuple):
    """A leaf (``text``) or a node (``left``, ``right``) with the line ends and code points below it."""

    ends: int
    chars: int
    text: bytes = b""
    left: Rope | None = None
    right: Rope | None = None


NOTHING = Rope(0, 0)


def leaf(text: bytes) -> Rope:
    return Rope(text.count(b"\n"), len(text.decode("utf-8")), text) if text else NOTHING


def joined(*parts: Rope) -> Rope:
    """The concatenation, without copying any text."""
    out = NOTHING
    for p in parts:
        if p.chars:
            out = Rope(out.ends + p.ends, out.chars + p.chars, b"", out, p) if out.chars else p
    return out


def rope(text: bytes, size: int = LEAF) -> Rope:
    """A balanced tree over ``text``."""
    leaves, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        leaves.append(leaf(text[at:end]))
        at = end
    while len(leaves) > 1:
        leaves = [joined(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else NOTHING


def _after_end(text: bytes, k: int) -> int:
    at = -1
    for _ in range(k):
        at = text.index(b"\n", at + 1)
    return at + 1


def split_lines(r: Rope, k: int) -> tuple[Rope, Rope]:
    """The first ``k`` lines and the rest. The line after the last end, if any, goes to the left where ``k`` counts it too."""
    if k > r.ends:
        return r, NOTHING
    if k == 0 or not r.chars:
        return NOTHING, r
    if r.left is None:
        at = _after_end(r.text, k)
        return leaf(r.text[:at]), leaf(r.text[at:])
    if k <= r.left.ends:
        a, b = split_lines(r.left, k)
        return a, joined(b, r.right)
    a, b = split_lines(r.right, k - r.left.ends)
    return joined(r.left, a), b


def split_chars(r: Rope, k: int) -> tuple[Rope, Rope]:
    """The first ``k`` code points and the rest."""
    if k >= r.chars:
        return r, NOTHING
    if k <= 0:
        return NOTHING, r
    if r.left is None:
        text = r.text.decode("utf-8")
        return leaf(text[:k].encode()), leaf(text[k:].encode())
    if k <= r.left.chars:
        a, b = split_chars(r.left, k)
        return a, joined(b, r.right)
    a, b = split_chars(r.right, k - r.left.chars)
    return joined(r.left, a), b


def flat(r: Rope) -> bytes:
    out, todo = [], [r]
    while todo:
        x = todo.pop()
        if x.left is None:
            out.append(x.text)
        else:
            todo += [x.right, x.left]
    return b"".join(out)


def lines(r: Rope, text: bytes) -> int:
    return r.ends + (bool(text) and not text.endswith(b"\n"))


class Infill(NamedTuple):
    """Parameters: the seed, how many of 100 texts are transformed, and how many of 100 of those have the suffix first."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50


class Filled(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def draws(key: str, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def fill(text: bytes, key: str, how: Infill = Infill(), size: int = LEAF) -> Filled:
    """The transformed text of one document; ``key`` is its id as text."""
    tree = rope(text, size)
    n = lines(tree, text)
    h1, h2, h3, h4 = draws(key, how.seed)
    if not text or h3 % 100 >= how.rate or any(m in text for m in MARKS):
        return Filled(n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split_lines(tree, low)
    middle, suffix = split_lines(rest, high - low)
    p, s, m = map(leaf, MARKS)
    if h4 % 100 < how.suffix_first:
        form, out = "spm", joined(s, suffix, p, prefix, m, middle)
    else:
        form, out = "psm", joined(p, prefix, s, suffix, m, middle)
    return Filled(n, form, prefix.chars, middle.chars, flat(out))


def restore(output: bytes, form: str, size: int = LEAF) -> bytes:
    """The text that ``fill`` was given, from its output and form alone."""
    if form == "plain":
        return output
    tree, parts, at = rope(output, size), [], 0
    for mark in (MARKS[1], MARKS[0], MARKS[2]) if form == "spm" else MARKS:
        found = output.index(mark, at)
        before, tree = split_chars(tree, len(output[at:found].decode("utf-8")))
        _, tree = split_chars(tree, len(mark))
        parts.append(before)
        at = found + len(mark)
    parts.append(tree)  # before the first mark there is nothing
    _, a, b, middle = parts
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return flat(joined(prefix, middle, suffix))


def _run(batches: Iterator[pa.RecordBatch], how: Infill) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for b in batches:
        data, off = strings(b.column(2))
        keys = b.column(1).to_pylist()
        for i, j in slices(off):
            out = [fill(data[off[k] : off[k + 1]].tobytes(), keys[k], how) for k in range(i, j)]
            cols = [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols, pa.array([r.output for r in out], pa.binary()).cast(pa.string())], names)
    trim()


def transform(docs: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; n counts lines."""
    kind = dict(docs.dtypes)[id_col]
    d = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(cast(`{id_col}` AS string), '') AS key", f"`{text_col}` AS text")
    return d.mapInArrow(lambda it: _run(it, how), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = strings(b.column(b.schema.get_field_index("output")))
        forms = b.column(b.schema.get_field_index("form")).to_pylist()
        for i, j in slices(off):
            text = [restore(data[off[k] : off[k + 1]].tobytes(), forms[k]) for k in range(i, j)]
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.binary()).cast(pa.string())], [*b.schema.names, "restored"])
    trim()


def invert(filled: DataFrame) -> DataFrame:
    """``filled`` (with columns output and form) and the ``restored`` texts."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in filled.dtypes)
    return filled.mapInArrow(_undo, f"{kinds}, restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = invert(transform(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
    WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
y AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
  array_to_string(u[greatest(a, b) + 1:], '') AS s FROM x)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM y
"""
