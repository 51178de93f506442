"""A corpus pipeline of five operators: low quality goes, near copies go, secrets are masked, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a table of documents; the last adds tokens. Rows that share an id are kept or
dropped together. A document is judged at each stage on the text that the stage before it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, pieces, quality, secrets
from tidemark.llm.base import forget, store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled documents that are here, scores at its threshold or over.

    A null or empty text is scored like any other, by what a text without words scores; a very long text is read whole; repeated rows
    share a score, so they stay or go together; without usable labels nothing can be learned and all documents stay; columns of any
    name are kept."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights, out="_score").where(F.col("_score") >= quality.KEEP).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id's, and of that id's texts in the group the first class's smallest text.
    A text goes only if a row of its own group stays, whatever other texts its id has. Rows without an id or without words (null and
    empty texts) stay; very long texts are compared whole; of repeated rows one stays; columns of any name are kept."""
    return ngram_join.keep_first(docs).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, each secret of its text replaced by a mask and n_chars by the new length; overlapping secrets are one mask. Null and
    empty texts stay as they are; a very long text takes time in proportion; repeated rows stay repeated, masked alike; columns of any
    name are kept."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: not at all, once or twice. Rows of one id and source are taken together, rows without
    an id by their texts. Null and empty texts weigh nothing and are taken at their source's rate; a very long text is one document, so
    its source may miss its target by as much; a null source is a source; ties are ordered by id; columns of any name are kept."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's id with its piece ids (joined by spaces), their number and digests. A null or empty text has the end id alone; a
    very long text is encoded whole; null ids stay null; repeated rows stay repeated; other columns go."""
    return pieces.encode_decode(docs, keep=("ids",)).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Training, connected components and merges cannot be said in SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir), name.split()[0])
        forget(before)  # a stage's table goes when the next one is written; the given table stays
    return STAGES[-1][1](spark, docs, sf_dir)
