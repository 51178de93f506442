"""Token counts of whole texts, with overlap resynchronisation for huge ones.

The byte-level vocabulary is run through its rank file, which gives the ids of the JSON file's library several times faster;
a test holds both against each other, special strings included. A text over ``HUGE`` bytes is encoded in overlapping chunks.
Token lengths give every token's byte offset; two neighbouring chunks are spliced at a byte where both have a token boundary
and which is proven stable: a space between two printable ASCII characters, or the end of a run of letters before a character
that is none. The pattern that cuts text before merging always begins a piece there, whatever stands further left or right, and
no special string holds such a place (a bar after a letter is left out for that). Where an overlap has no such place it is
widened, at last to the whole chunk, which then doubles, so the work stays in proportion to the text.

Memory is bounded by one Arrow batch plus one chunk, or the longest run without a stable place. Rows are independent, so there
is no shuffle and nothing is skewed.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are repeated; an empty table gives an empty
result; a text without any stable place is encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import table
from .kernel import strings

#: The special string of this vocabulary.
SPECIAL = {"<|endoftext|>": 50256}
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes over which a text is cut, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 256
LIMIT = 512


def vocabulary_path(name: str) -> str:
    """A path as it is, or the place of an installed public vocabulary."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    """(encoding, length in bytes of each id)."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(*ranks.values(), *SPECIAL.values()) + 1, np.int64)
    for piece, i in ranks.items():
        size[i] = len(piece)
    for s, i in SPECIAL.items():
        size[i] = len(s)
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL), size


def ids_of(text: str, name: str = VOCABULARY) -> np.ndarray:
    return encoder(name)[0].encode_to_numpy(text, allowed_special="all")


def token_offsets(data: bytes, name: str = VOCABULARY) -> np.ndarray:
    """The byte at which each token of a chunk begins, and the chunk's end."""
    ids = ids_of(data.decode("utf-8"), name)
    out = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(encoder(name)[1][ids], out=out[1:])
    return out


#: Characters that every version of Unicode calls letters, and beyond ASCII some that it does not.
LETTERS = (
    (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x481), (0x48A, 0x513),
    (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
OTHERS = ((0x3001, 0x3002), (0xFF01, 0xFF01), (0xFF0C, 0xFF0C), (0xFF0E, 0xFF0E), (0xFF1A, 0xFF1B), (0xFF1F, 0xFF1F), (0x300C, 0x300D))


def _within(c: np.ndarray, ranges) -> np.ndarray:
    out = np.zeros(len(c), bool)
    for a, b in ranges:
        out |= (c >= a) & (c <= b)
    return out


def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the characters that begin at ``at``; -1 for those of four bytes and for bytes that begin none."""
    pad = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    a, b, c = pad[at], pad[at + 1] & 0x3F, pad[at + 2] & 0x3F
    two, three = (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c
    return np.select([a < 0x80, a & 0xE0 == 0xC0, a & 0xF0 == 0xE0], [a, two, three], -1)


def stable(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes at which a piece begins whatever surrounds them."""
    at = at[(at > 0) & (at < len(data) - 1)]
    plain = lambda x: (x > 0x20) & (x < 0x7F)
    space = (data[at] == 0x20) & plain(data[at - 1]) & plain(data[at + 1])
    before = at - 1
    for _ in range(2):  # to the first byte of a character of up to three
        before = np.where((data[before] & 0xC0 == 0x80) & (before > 0), before - 1, before)
    left, right = _points(data, before), _points(data, at)
    other = ((right >= 0) & (right < 0x80) & ~_within(right, LETTERS[:2]) & (right != 0x7C)) | _within(right, OTHERS)
    return at[space | (_within(left, LETTERS) & other)]


def _char_start(data: np.ndarray, i: int) -> int:
    while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
        i -= 1
    return i


def count_spliced(text: bytes, name: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """(tokens, times an overlap was widened) of a text encoded in overlapping chunks."""
    data = np.frombuffer(text, np.uint8)
    n, total, cut, widened = len(data), 0, 0, 0
    start, end = 0, _char_start(data, min(chunk, n))
    left = token_offsets(text[start:end], name) + start
    while end < n:
        width = overlap
        while True:
            s = _char_start(data, max(start, end - width))
            if s <= max(start, cut):  # the whole chunk overlaps: let it grow instead
                end = _char_start(data, min(n, start + 2 * (end - start)))
                left = token_offsets(text[start:end], name) + start
                break
            e = _char_start(data, min(n, s + chunk + width))
            right = token_offsets(text[s:e], name) + s
            common = stable(data, np.intersect1d(left, right, assume_unique=True))
            common = common[(common > max(s, cut)) & (common < end)]
            if len(common):
                at = int(common[len(common) // 2])
                total += int(((left >= cut) & (left < at)).sum())
                cut, start, end, left = at, s, e, right
                break
            width *= 2
            widened += 1
    return total + int(((left >= cut) & (left < n)).sum()), widened


def _count(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = strings(b.column(1))
        raw = data.tobytes()
        out = np.zeros(len(off) - 1, np.int64)
        for i in range(len(out)):
            t = raw[off[i] : off[i + 1]]
            out[i] = count_spliced(t, name)[0] if len(t) > HUGE else len(ids_of(t.decode("utf-8"), name)) if t else 0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(out)], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    kind = dict(docs.dtypes)[id_col]
    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return d.mapInArrow(lambda it: _count(it, vocabulary), f"id {kind}, n_bytes long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = count_tokens(table(spark, sf_dir, "documents"))
    return c.selectExpr("id AS doc_id", "n_bytes", "n_tokens", f"n_tokens > {LIMIT} AS over_limit")
