"""Sources: CSV, text, JSON, XML, zip; tolerant, recursive, latest-file and drifting-schema scans. All schemas are given."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_rfc2822
from ..functions.text import title_and_description
from ..schemas import PRICE, VIX, plain_headers, role_column, union_drifting


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, tolerant: bool = False, recursive: bool = False, lines: bool = False, exact: bool = False) -> DataFrame:
    """CSV with quoted line breaks; ``tolerant`` drops malformed lines, ``recursive`` goes into folders. Files of which every row is
    one line (``lines``) are split among tasks; others are read whole, each by one. ``exact`` keeps each text as it was written: only
    what stands without quotes and is empty is null, and NUL characters stay."""
    r = spark.read.option("header", True).option("multiLine", not lines).option("escape", '"').option("recursiveFileLookup", recursive)
    r = r.option("mode", "DROPMALFORMED" if tolerant else "PERMISSIVE")
    if exact:
        # A text equal to the null value is read as null, so it is one that no file holds; the sign before an escape is NUL by default.
        r = r.option("nullValue", uuid.uuid4().hex).option("charToEscapeQuoteEscaping", '"')
    return (r.schema(schema) if schema is not None else r).csv(path)


def excluding(df: DataFrame, *names: str) -> DataFrame:
    """Without the files of these names."""
    return df.where(~F.col("_metadata.file_name").isin(*names)) if names else df


def files(spark: SparkSession, folder: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, time of change) of a folder's files, through the file system that Spark reads with."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [(s.getPath().toString(), s.getModificationTime()) for s in (found or []) if s.isFile()]


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.csv", by: str = "time") -> str | None:
    got = files(spark, folder, pattern)
    return max(got, key=(lambda x: (x[1], x[0])) if by == "time" else (lambda x: x[0]))[0] if got else None


def read_prices(spark: SparkSession, folder: str, tickers: list[str] | None = None) -> DataFrame:
    """All price files but those whose name holds "all"; the first row of a (time, ticker) stays."""
    paths = sorted(p for p, _ in files(spark, folder, "*.csv") if "all" not in p.rsplit("/", 1)[-1])
    df = read_csv(spark, paths, PRICE, lines=True)
    if tickers:
        df = df.where(F.upper("ticker").isin(*[t.upper() for t in tickers]))
    return df.groupBy("timestamp_utc", "ticker").agg(*[F.min_by(c, "_metadata.file_name").alias(c) for c in ("Open", "High", "Low", "Close", "Volume")]) if paths else df


def read_vix(spark: SparkSession, folder: str) -> DataFrame:
    """Volatility files with or without an index column, as one table without repeated rows."""
    parts = [read_csv(spark, p, lines=True) for p, _ in sorted(files(spark, folder, "*vix*.csv"))]
    if not parts:
        return spark.createDataFrame([], VIX)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    index = F.col("index") if "index" in out.columns else F.lit(None)
    return out.select(F.try_to_timestamp("timestamp_utc").alias("timestamp_utc"), F.col("vix_close").cast("double").alias("vix_close"), index.cast("string").alias("index")).distinct()


def read_at_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text@label`` lines; the last mark splits."""
    pattern = "^(.*)@([^@]*)$"
    v = F.col("value")
    return spark.read.text(path).where(v.rlike(pattern)).select(F.trim(F.regexp_extract(v, pattern, 1)).alias("text"), F.trim(F.regexp_extract(v, pattern, 2)).alias("label"))


def read_zipped_csv(spark: SparkSession, path: str, schema: str, prefer: str | None = None) -> DataFrame:
    """The preferred CSV of each archive, else its first one; archives are opened where they are read."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inside = [n for n in z.namelist() if n.lower().endswith(".csv")]
                    pick = next((n for n in inside if prefer and n.endswith(prefer)), inside[0] if inside else None)
                    if pick:
                        yield pd.read_csv(z.open(pick), dtype=str, keep_default_na=False).reindex(columns=names)

    text = ", ".join(f"`{n}` string" for n in names)
    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, text)
    return out.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])


#: Kinds of a listing's items, and what stands for an account or a text that is gone.
POST, COMMENT, GONE = "t3", "t1", ("[deleted]", "[removed]")
#: Comments asked for with a post.
COMMENTS = 50
_COMMENT = "struct<id:string,author:string,body:string,score:double,created_utc:double>"
_POST = "struct<id:string,author:string,title:string,selftext:string,score:double,upvote_ratio:double,created_utc:double,subreddit:string,link_flair_text:string,removed_by_category:string>"
_PAGE = "struct<data:struct<after:string,children:array<struct<kind:string,data:{}>>>>"
LISTING, REPLIES = _PAGE.format(_POST), f"array<{_PAGE.format(_COMMENT)}>"


def read_listing(raw: DataFrame, column: str = "value") -> DataFrame:
    """Posts of JSON listing pages (one page a row): no other kinds of items, no removed posts, none of a deleted account. Votes
    are the score, 0 where a page has none; votes against it are not known."""
    page = F.from_json(column, LISTING)
    p = raw.select(F.explode(page["data"]["children"]).alias("c")).where(F.col("c.kind") == POST).select("c.data.*")
    p = p.where((F.coalesce("removed_by_category", F.lit("")) == "") & F.col("author").isNotNull() & (F.col("author") != GONE[0]))
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit(""))))
    return p.select(
        "id", F.lit("reddit").alias("source"), "subreddit", F.lit("post").alias("type"), "author", text.alias("text"), F.coalesce("score", F.lit(0.0)).alias("upvotes"),
        F.lit(None).cast("double").alias("downvotes"), "upvote_ratio", F.col("link_flair_text").alias("post_flair"), F.timestamp_seconds("created_utc").alias("timestamp_utc"),
    )


def read_comments(raw: DataFrame, column: str = "value", most: int = COMMENTS) -> DataFrame:
    """First-level comments of posts' own pages (subreddit, one page a row: the post, then its comments): of a page's first
    ``most`` items those that are comments and have a text that was not taken away."""
    page = F.from_json(column, REPLIES)
    c = raw.select("subreddit", F.explode(F.slice(F.get(page, F.lit(1))["data"]["children"], 1, most)).alias("c")).where(F.col("c.kind") == COMMENT).select("subreddit", "c.data.*")
    c = c.withColumn("body", F.trim("body")).where(~F.col("body").isin("", *GONE))
    return c.select(
        F.coalesce("id", F.lit("")).alias("id"), F.lit("reddit").alias("source"), "subreddit", F.lit("comment").alias("type"), F.coalesce("author", F.lit(GONE[0])).alias("author"), F.col("body").alias("text"),
        F.coalesce("score", F.lit(0.0)).alias("upvotes"), F.timestamp_seconds("created_utc").alias("timestamp_utc"),
    )


def read_feed(spark: SparkSession, path: str, market: str = "US", pulled=None) -> DataFrame:
    """News items of an XML feed."""
    x = spark.read.format("xml").option("rowTag", "item").schema("title string, description string, link string, pubDate string, guid string").load(path)
    pulled = F.current_timestamp() if pulled is None else pulled
    return x.select(
        F.md5(F.coalesce("guid", "link", "title")).alias("id"), F.lit("news").alias("source"), F.lit("news").alias("type"), title_and_description(F.col("title"), F.col("description")).alias("text"),
        parse_rfc2822(F.col("pubDate"), pulled).alias("timestamp_utc"), F.lit(market).alias("market"),
    )


def read_chart(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bars of quote payloads (one a row, with the symbol that was asked for as ``ticker``): times are seconds and become UTC."""
    kind = "struct<timestamp:array<long>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<long>>"
    c = raw.select("ticker", F.from_json(column, kind).alias("c"))
    rows = F.arrays_zip("c.timestamp", "c.open", "c.high", "c.low", "c.close", "c.volume")
    r = c.select("ticker", F.explode(rows).alias("r")).select("ticker", "r.*")
    return r.select(F.timestamp_seconds("timestamp").alias("timestamp_utc"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"), "ticker")


def volatility_of(charts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(timestamp_utc, vix_close, index) of the symbols that are volatility indices."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return charts.where(F.col("ticker").isin(*labels)).select("timestamp_utc", F.col("Close").alias("vix_close"), names[F.col("ticker")].alias("index"))


def indices_of(charts: DataFrame, names: dict[str, str]) -> DataFrame:
    """(timestamp_utc, Close, index_name, ticker) of a basket of index symbols."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return charts.where(F.col("ticker").isin(*names)).select("timestamp_utc", "Close", known[F.col("ticker")].alias("index_name"), "ticker")


def read_calendar(raw: DataFrame, column: str = "value") -> DataFrame:
    """(ticker, earnings_date) of calendar payloads; a payload has one date, a list of them, or none."""
    many, one = F.from_json(column, "struct<earnings:array<string>>")["earnings"], F.get_json_object(column, "$.earnings")
    dates = F.coalesce(many, F.array(one))
    d = raw.select("ticker", F.explode(dates).alias("d")).select("ticker", F.substring("d", 1, 10).try_cast("date").alias("earnings_date"))
    return d.where("earnings_date IS NOT NULL").distinct()


def with_fallback(primary: DataFrame, *others: DataFrame, key: str = "ticker") -> DataFrame:
    """For each key the rows of the first table that has any: symbol fallback."""
    out = primary
    for o in others:
        out = out.unionByName(o.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def read_labelled(spark: SparkSession, path: str, text=("text", "sentence", "tweet"), label=("label", "sentiment")) -> DataFrame:
    """(text, label) of a labelled CSV, its columns found by name whatever their case."""
    df = plain_headers(read_csv(spark, path, tolerant=True))
    t, y = role_column(df, text), role_column(df, label)
    if t is None or y is None:
        raise ValueError(f"no text or label column among {df.columns}")
    return df.select(F.col(t).alias("text"), F.col(y).cast("string").alias("label"))


def read_hub(spark: SparkSession, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """(dataset, split, text, label) of labelled datasets: name -> paths of its splits, each file's split in its name."""
    parts = []
    for name, paths in sets.items():
        for p in paths:
            split = F.lit(re.split(r"[-.*]", p.rstrip("/").rsplit("/", 1)[-1])[0])  # train.csv, train-0001.csv, train*.csv
            parts.append(read_labelled(spark, p).select(F.lit(name).alias("dataset"), split.alias("split"), "text", "label"))
    return union_drifting(*parts)
