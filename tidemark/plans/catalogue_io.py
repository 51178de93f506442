"""Queries for sources, sinks and schema handling: the driver's tables are written out in each format and read back.

What is written goes to a folder of its own in the shared folder; single files are named by a rename in the file system that Spark
writes to.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import Config
from ..functions import scalars as sc
from ..operators import clean, ingest, market, model, score
from ..schemas import plain_headers, require, role_column
from ..sources import paged, readers, sinks
from ..streaming import streams
from .catalogue import _folder, bit, model_matrix, out, query, r9, sec
from .views import Views


def _path(spark: SparkSession, p: str):
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    return here, here.getFileSystem(spark._jsc.hadoopConfiguration())


#: Texts are written as they are; Spark's CSV writer takes blanks and line ends off both ends otherwise.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def put(df: DataFrame, path: str, kind: str = "csv", one: bool = False, **options) -> str:
    """A file for each task, named ``name-0.csv`` and so on for ``name.csv``; what finds them all. Only where the name of a single file
    is what a query is about, ``one`` task writes it."""
    spark = df.sparkSession
    (df.coalesce(1) if one else df).write.format(kind).options(**(_CSV | options if kind == "csv" else options)).save(f"{path}.parts")
    to, fs = _path(spark, path)
    fs.mkdirs(to.getParent())
    stem, ending = path.rsplit(".", 1)
    for i, s in enumerate(fs.globStatus(_path(spark, f"{path}.parts/part-*")[0])):
        fs.rename(s.getPath(), to if one else _path(spark, f"{stem}-{i}.{ending}")[0])
    fs.delete(_path(spark, f"{path}.parts")[0], True)
    return path if one else f"{stem}-*.{ending}"


def put_bytes(spark: SparkSession, data: bytes, path: str) -> str:
    to, fs = _path(spark, path)
    f = fs.create(to, True)
    f.write(bytearray(data))
    f.close()
    return path


def _address(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


_POSTS = "id long, source string, author string, upvotes long, text string"


def _few(v: Views) -> DataFrame:
    return v.posts.select("id", "source", "author", "upvotes", "text")


@query("csv_scan", "SELECT doc_id, lang, source, md5(text) AS text FROM documents")
def _(v: Views):
    at = put(v.table("documents").select("doc_id", "lang", "source", "text"), f"{_folder(v)}/d.csv")
    return readers.read_csv(v.spark, at, "doc_id long, lang string, source string, text string", exact=True).select("doc_id", "lang", "source", F.md5("text").alias("text"))


@query("csv_tolerant", "SELECT id, source, upvotes FROM posts WHERE id % 3 <> 0", "posts")
def _(v: Views):
    line = F.when(F.col("id") % 3 == 0, F.concat_ws(",", "id", "source", F.lit("one"), F.lit("two"), F.lit("many"))).otherwise(F.concat_ws(",", "id", "source", "upvotes"))
    # One column that holds whole lines, under a heading that is a line as well.
    at = put(v.posts.select(line.alias("id,source,upvotes")), f"{_folder(v)}/bad.csv", quote="", sep="\x01")
    return readers.read_csv(v.spark, at, "id long, source string, upvotes long", tolerant=True, lines=True)


@query("csv_recursive", "SELECT id, source FROM posts WHERE source <> 'news'", "posts")
def _(v: Views):
    at = _folder(v)
    for s in ("reddit", "stocktwits", "news", "kaggle", "huggingface"):
        put(_few(v).where(F.col("source") == s), f"{at}/{s[:2]}/deep/{s}.csv")
    left_out = [p.rsplit("/", 1)[-1] for p, _ in readers.files(v.spark, f"{at}/ne/deep", "news*.csv")]
    return readers.excluding(readers.read_csv(v.spark, at, _POSTS, recursive=True, lines=True), *left_out).select("id", "source")


@query("latest_file", "SELECT id, author FROM posts WHERE source = 'news'", "posts")
def _(v: Views):
    at = _folder(v)
    for name, s in (("run_20240101.csv", "reddit"), ("run_20240301.csv", "news"), ("run_20240201.csv", "kaggle")):
        put(_few(v).where(F.col("source") == s), f"{at}/{name}", one=True)  # the newest single file is what is asked for
    return readers.read_csv(v.spark, readers.latest_file(v.spark, at, "run_*.csv", by="name"), _POSTS).select("id", "author")


@query("price_files", 'SELECT ticker, epoch(ts)::BIGINT AS ts, round("Close", 9) AS close, "Volume" AS volume FROM bars', "bars")
def _(v: Views):
    at = _folder(v)
    b = v.bars.withColumn("timestamp_utc", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).select("timestamp_utc", "Open", "High", "Low", "Close", "Volume", "ticker")
    for t in ("AAPL", "TSLA", "NVDA", "GME", "AMZN"):
        put(b.where(F.col("ticker") == t), f"{at}/prices_{t.lower()}.csv")
    put(b.withColumn("Close", F.lit(-1.0)), f"{at}/prices_all.csv")  # never read
    put(b.where("ticker = 'AAPL'").withColumn("Close", F.lit(-2.0)), f"{at}/prices_zz_again.csv")  # repeated rows of a later file
    p = readers.read_prices(v.spark, at, ["aapl", "tsla", "nvda", "gme", "amzn"])
    return out(p.select("ticker", F.col("timestamp_utc").alias("ts"), F.col("Close").alias("close"), F.col("Volume").alias("volume")))


@query("vix_files", "SELECT epoch(timestamp_utc)::BIGINT AS ts, round(vix_close, 9) AS vix_close, CASE WHEN index = 'US_VIX' THEN index END AS index FROM vix", "vix")
def _(v: Views):
    at = _folder(v)
    t = v.vix.withColumn("timestamp_utc", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"))
    put(t.where("index = 'US_VIX'").select("timestamp_utc", "vix_close", "index"), f"{at}/vix_1.csv")
    put(t.where("index = 'US_VIX'").select("timestamp_utc", "vix_close", "index"), f"{at}/vix_2.csv")
    put(t.where("index <> 'US_VIX'").select("timestamp_utc", "vix_close"), f"{at}/india_vix_3.csv")
    return out(readers.read_vix(v.spark, at).withColumnRenamed("timestamp_utc", "ts"))


@query("at_lines", "SELECT text || ' of ' || author || '@home' AS text, CASE sentiment_numeric WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' ELSE 'negative' END AS label FROM posts", "posts")
def _(v: Views):
    label = F.when(F.col("sentiment_numeric") == 1, "positive").when(F.col("sentiment_numeric") == 0, "neutral").otherwise("negative")
    line = F.concat("text", F.lit(" of "), "author", F.lit("@home @ "), label)
    lines = v.posts.select(F.replace(line, F.lit("home @ "), F.lit("home@ ")).alias("value"))
    return readers.read_at_lines(v.spark, put(lines, f"{_folder(v)}/lines.txt", "text"))


@query("zipped_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(v: Views):
    rows = v.table("nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").collect()  # a table of fixed size
    body = "n_nationkey,n_name,n_regionkey\n" + "".join(f"{r[0]},{r[1]},{r[2]}\n" for r in rows)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("readme.txt", "no table")
        f.writestr("other.csv", "a,b\n1,2\n")
        f.writestr("data/nations.csv", body)
    at = put_bytes(v.spark, z.getvalue(), f"{_folder(v)}/n.zip")
    return readers.read_zipped_csv(v.spark, at, "n_nationkey long, n_name string, n_regionkey long", "nations.csv")


def write_texts(rows: DataFrame, root: str) -> None:
    """(name, value) rows as one file each under ``root``, written by the tasks that hold them."""
    address, own = _address(root).removeprefix("file://"), lambda: f"{TaskContext.get().taskAttemptId()}.part"
    if "://" in address:
        raise ValueError(f"tasks write to mounted folders only, not to {root}")

    def put_all(rows):  # one row after the other: texts may be large
        made = set()
        for name, value in rows:
            to = os.path.join(address, name)
            folder = os.path.dirname(to)
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            part = f"{to}.{own()}"
            with open(part, "w", encoding="utf-8", newline="") as f:  # a repeated task replaces the file whole
                f.write(value)
            os.replace(part, to)

    rows.select("name", "value").foreachPartition(put_all)


def _post(v: Views):
    """A post as an item of a listing. Of every seven, one was removed, one is of a deleted account, and one is no post."""
    at = F.col("id") % 7
    data = F.struct(
        F.col("id").cast("string").alias("id"), F.when(at == 1, "[deleted]").when(at != 2, F.col("author")).alias("author"), F.lit("Title").alias("title"), F.col("text").alias("selftext"),
        F.when(F.col("upvotes") != 0, F.col("upvotes").cast("double")).alias("score"), F.lit(99.0).alias("ups"), F.lit(1.0).alias("downs"), F.lit(0.9).alias("upvote_ratio"),
        F.unix_seconds("timestamp_utc").cast("double").alias("created_utc"), F.col("source").alias("subreddit"), F.col("ticker").alias("link_flair_text"), F.when(at == 3, "moderator").alias("removed_by_category"),
    )
    return F.struct(F.when(at == 4, "t1").otherwise("t3").alias("kind"), data.alias("data"))


#: Posts of a listing and of one of its pages where the number of listings is ours; a listing is read by one task, page after page.
LISTED, PAGED = 200_000, 500


def _pages(p: DataFrame) -> DataFrame:
    """(listing, n, after, rows) as (listing, n, value): pages, each naming the next."""
    page = F.struct(F.struct(F.col("after").cast("string").alias("after"), F.transform("rows", lambda r: r["x"]).alias("children")).alias("data"))
    return p.select("listing", "n", F.to_json(page).alias("value"))


def _listing(v: Views, size: int = 100, listings: int = 1) -> DataFrame:
    """(listing, n, value): posts as pages of listings, each naming the next page that is there; n is 0 for a listing's first."""
    at = F.floor(F.col("id") / size).cast("long")
    p = v.posts.groupBy(at.alias("at")).agg(F.sort_array(F.collect_list(F.struct("id", _post(v).alias("x")))).alias("rows"))
    of = v.posts.select(at.alias("at")).distinct().withColumn("listing", F.pmod("at", F.lit(listings)))
    w = Window.partitionBy("listing").orderBy("at")  # over one number for each page
    of = of.withColumn("n", F.row_number().over(w) - 1)
    of = of.withColumn("after", F.when(F.lead("at").over(w).isNotNull(), F.concat(F.lit("p"), F.col("n") + 1)))
    return _pages(p.join(of, "at"))


def _named(folder, n, sign: str = "p"):
    """A page's file: the first has no name, as nothing comes before it."""
    return F.concat(folder, F.lit("/"), F.when(n > 0, F.concat(F.lit(sign), n)).otherwise(F.lit("")), F.lit(".json"))


_LISTED = "SELECT id::VARCHAR AS id, 'reddit' AS source, source AS subreddit, author, 'Title ' || text AS text, upvotes::DOUBLE AS upvotes, ticker AS post_flair, floor(epoch(timestamp_utc))::BIGINT AS timestamp_utc FROM posts WHERE id % 7 NOT IN (1, 2, 3, 4)"
_LISTING_COLUMNS = ("id", "source", "subreddit", "author", "text", "upvotes", "post_flair", "timestamp_utc")


@query("listing_posts", _LISTED, "posts")
def _(v: Views):
    return out(readers.read_listing(_listing(v)), *_LISTING_COLUMNS)


def _replies(v: Views) -> DataFrame:
    """(subreddit, id, value): every post's own page, itself and two comments, one of which may be taken away or no comment."""
    body = F.when(F.col("id") % 4 == 0, "[deleted]").when(F.col("id") % 4 == 1, " [removed] ").otherwise(F.concat(F.lit(" re: "), "text", F.lit(" ")))
    comment = lambda end, text, kind: F.struct(kind.alias("kind"), F.struct(F.concat(F.col("id").cast("string"), F.lit(end)).alias("id"), "author", text.alias("body"), F.col("upvotes").cast("double").alias("score"), F.unix_seconds("timestamp_utc").cast("double").alias("created_utc")).alias("data"))
    items = F.array(comment("a", F.lit("agreed"), F.when(F.col("id") % 3 == 0, "more").otherwise("t1")), comment("b", body, F.lit("t1")))
    listing = lambda children: F.struct(F.struct(F.lit(None).cast("string").alias("after"), children.alias("children")).alias("data"))
    value = F.concat(F.lit("["), F.to_json(listing(F.array(_post(v)))), F.lit(","), F.to_json(listing(items)), F.lit("]"))
    return v.posts.select(F.col("source").alias("subreddit"), F.col("id").cast("string").alias("id"), value.alias("value"))


_REPLIED = "SELECT id || 'a' AS id, author, 'agreed' AS text, upvotes::DOUBLE AS upvotes FROM posts WHERE id % 3 <> 0 UNION ALL SELECT id || 'b', author, trim('re: ' || text), upvotes::DOUBLE FROM posts WHERE id % 4 > 1"


@query("listing_comments", _REPLIED, "posts")
def _(v: Views):
    return out(readers.read_comments(_replies(v)), "id", "author", "text", "upvotes")


@query("paged_source", _LISTED, "posts")
def _(v: Views):
    paged.register(v.spark)
    at = _folder(v)
    many = max(1, -(-v.posts.count() // LISTED))
    write_texts(_listing(v, PAGED, many).select(_named(F.concat(F.lit("r/market"), "listing"), F.col("n")).alias("name"), "value"), at)
    url = _address(at) + "/r/{listing}/{after}.json"
    of = [*[f"market{k}" for k in range(many)], "nothing here"]
    raw = v.spark.read.format("paged_listing").options(of=json.dumps(of), url=url, limit=str(10**9)).load()
    return out(readers.read_listing(raw), *_LISTING_COLUMNS)


@query("polled_source", _LISTED, "posts")
def _(v: Views):
    """The listing as a stream, polled at two times: first its older half is there, then all of it; every post comes once."""
    paged.register(v.spark)
    at = _folder(v)
    url = _address(at) + "/{listing}/{after}.json"
    second = F.unix_seconds("timestamp_utc")
    half, count = v.posts.agg(F.percentile_approx(second, 0.5), F.count("*")).first()
    many = max(1, -(-count // LISTED))
    listing, newest = F.pmod("id", F.lit(many)), [F.desc("t"), F.desc("key")]  # as a listing's places are ordered
    for rows in (v.posts.where(second <= half), v.posts):
        w = Window.partitionBy("listing").orderBy(*newest)  # over the posts of one listing, at most some LISTED
        p = rows.select(listing.alias("listing"), second.alias("t"), F.col("id").cast("string").alias("key"), _post(v).alias("x"))
        p = p.withColumns({"row": F.row_number().over(w), "all": F.count("*").over(Window.partitionBy("listing"))})
        p = p.withColumn("n", F.floor((F.col("row") - 1) / PAGED)).groupBy("listing", "n").agg(F.max("all").alias("all"), F.sort_array(F.collect_list(F.struct("row", "x"))).alias("rows"))
        p = _pages(p.withColumn("after", F.when((F.col("n") + 1) * PAGED < F.col("all"), F.col("n") + 1)))
        write_texts(p.select(_named(F.concat(F.lit("market"), "listing"), F.col("n"), "").alias("name"), "value"), at)
        live = v.spark.readStream.format("paged_listing").options(of=json.dumps([f"market{k}" for k in range(many)]), url=url).load()
        streams.run_available(live, f"{at}/out", f"{at}/state")
    raw = v.spark.read.schema("listing string, page int, value string").parquet(f"{at}/out")
    return out(readers.read_listing(raw), *_LISTING_COLUMNS)


@query("comments_source", _REPLIED, "posts")
def _(v: Views):
    at = _folder(v)
    # Folders of some posts each: tasks that make files in one folder wait for each other.
    r = _replies(v).withColumn("part", F.floor(F.col("id").cast("long") / 1000))
    write_texts(r.select(F.concat_ws("/", "subreddit", "part", F.concat("id", F.lit(".json"))).alias("name"), "value"), at)
    posts = r.select("subreddit", "part", "id").union(v.posts.select(F.col("source"), F.lit(0).cast("long"), F.lit("gone")).distinct())  # these have no page
    return out(readers.read_comments(paged.fetch_each(posts, _address(at) + "/{subreddit}/{part}/{id}.json", tries=1)), "id", "author", "text", "upvotes")


@query("page_limit", "SELECT count(*) AS pages, 20 * count(*) AS items FROM (SELECT id // 20 AS p FROM posts GROUP BY 1 ORDER BY 1 LIMIT greatest(1, (SELECT ceil(count(*) / 40.0) FROM posts)::BIGINT))", "posts")
def _(v: Views):
    paged.register(v.spark)
    at = _folder(v)
    write_texts(_listing(v, 20).select(_named(F.lit("x"), F.col("n")).alias("name"), "value"), at)
    half = v.posts.count() // 2  # items asked for: pages follow until there are as many
    raw = v.spark.read.format("paged_listing").options(of='["x"]', url=_address(at) + "/{listing}/{after}.json", limit=str(half)).load()
    items = F.size(F.from_json("value", readers.LISTING)["data"]["children"])
    return raw.agg(F.count("*").alias("pages"), F.sum(items).cast("long").alias("items"))


def _charts(v: Views, of: dict[str, str], root: str) -> str:
    """Payloads of these tickers' bars under the symbols they are given; the address of any symbol."""
    b = v.bars.withColumn("t", F.unix_seconds("ts"))
    cols = [("t", "timestamp"), ("Open", "open"), ("High", "high"), ("Low", "low"), ("Close", "close"), ("Volume", "volume")]
    g = b.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*[c for c, _ in cols]))).alias("r"))
    names = F.create_map(*[F.lit(x) for t, symbol in of.items() for x in (t, f"{symbol}.json")])
    g = g.select(names[F.col("ticker")].alias("name"), F.to_json(F.struct(*[F.col("r")[c].alias(n) for c, n in cols])).alias("value"))
    write_texts(g.where("name IS NOT NULL"), root)
    return _address(root) + "/{symbol}.json"


@query("quotes_fallback", """SELECT CASE ticker WHEN 'TSLA' THEN ' tata.ns' ELSE ticker END AS ticker, CASE ticker WHEN 'TSLA' THEN 'TATA.BO' ELSE ticker END AS symbol, epoch(ts)::BIGINT AS timestamp_utc, round("Close", 9) AS close, "Volume" AS volume FROM bars""", "bars")
def _(v: Views):
    paged.register(v.spark)
    own = [r[0] for r in v.bars.select("ticker").distinct().collect()]  # the tickers that are asked for
    url = _charts(v, {t: "TATA.BO" if t == "TSLA" else t for t in own}, _folder(v))  # the first ending asked for is not there
    raw = v.spark.read.format("quotes").options(of=json.dumps([" tata.ns" if t == "TSLA" else t for t in own]), url=url).load()
    bars = readers.read_chart(raw).join(raw.select("ticker", "symbol"), "ticker")
    return out(bars, "ticker", "symbol", "timestamp_utc", "Close", "Volume").withColumnsRenamed({"Close": "close", "Volume": "volume"})


@query("volatility_source", """SELECT epoch(ts)::BIGINT AS timestamp_utc, round("Close", 9) AS vix_close, CASE ticker WHEN 'NVDA' THEN 'US_VIX' ELSE 'INDIA_VIX' END AS index FROM bars WHERE ticker IN ('NVDA', 'GME')""", "bars")
def _(v: Views):
    paged.register(v.spark)
    url = _charts(v, {"NVDA": "^VIX", "GME": "^INDIAVIX"}, _folder(v))
    raw = v.spark.read.format("quotes").options(of='["^VIX", "^INDIAVIX"]', url=url.replace("{symbol}", "{symbol}")).load()
    return out(readers.volatility_of(readers.read_chart(raw), {"^VIX": "US_VIX", "^INDIAVIX": "INDIA_VIX"}))


@query("index_source", """SELECT epoch(ts)::BIGINT AS timestamp_utc, round("Close", 9) AS close, CASE ticker WHEN 'NVDA' THEN 'NASDAQ' ELSE 'NIFTY_50' END AS index_name, CASE ticker WHEN 'NVDA' THEN '^IXIC' ELSE '^NSEI' END AS ticker FROM bars WHERE ticker IN ('NVDA', 'GME')""", "bars")
def _(v: Views):
    paged.register(v.spark)
    url = _charts(v, {"NVDA": "^IXIC", "GME": "^NSEI"}, _folder(v))
    raw = v.spark.read.format("quotes").options(of='["^IXIC", "^NSEI", "^MISSING"]', url=url).load()
    return out(readers.indices_of(readers.read_chart(raw), {"^IXIC": "NASDAQ", "^NSEI": "NIFTY_50"})).withColumnRenamed("Close", "close")


@query("earnings_source", "SELECT DISTINCT ticker, earnings_date FROM earnings", "earnings")
def _(v: Views):
    day = F.concat(F.col("earnings_date").cast("string"), F.lit(" 16:00"))
    e = v.earnings.groupBy("ticker").agg(F.collect_list(day).alias("d"))
    one = v.earnings.groupBy("ticker").agg(F.to_json(F.struct(F.min(day).alias("earnings"))).alias("value"))  # a payload may hold a single date
    many = e.select("ticker", F.to_json(F.struct(F.col("d").alias("earnings"))).alias("value"))
    return readers.read_calendar(many.union(one).union(e.select("ticker", F.lit("{}"))))


_ORDER = ("news", "kaggle", "reddit", "stocktwits", "huggingface")


@query("symbol_fallback", f""", o AS (SELECT *, CASE source {" ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_ORDER))} END AS place FROM posts WHERE user_id % (CASE source WHEN 'news' THEN 7 WHEN 'kaggle' THEN 3 ELSE 1 END) = 0)
SELECT user_id, source, k FROM o JOIN (SELECT user_id, min(place) AS place FROM o GROUP BY 1) USING (user_id, place)""", "posts")
def _(v: Views):
    """For each account the rows of the first source that has any; the first two sources know a part of the accounts only."""
    some = F.col("user_id") % F.when(F.col("source") == "news", 7).when(F.col("source") == "kaggle", 3).otherwise(1) == 0
    first, *others = (v.posts.where((F.col("source") == s) & some).select("user_id", "source", "k") for s in _ORDER)
    return readers.with_fallback(first, *others, key="user_id")


@query("feed", "SELECT md5('g' || page_id) AS id, trim(coalesce(url, '') || '. ' || 'Story ' || page_id, '. ') AS text, 86400 * (page_id % 300) + 1704067200 AS timestamp_utc, 'US' AS market FROM pages")
def _(v: Views):
    at = F.timestamp_seconds(F.lit(1704067200) + 86400 * (F.col("page_id") % 300))
    p = v.table("pages").select(F.col("url").alias("title"), F.concat(F.lit("Story "), F.col("page_id").cast("string")).alias("description"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"), F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("guid"))
    f = put(p, f"{_folder(v)}/feed.xml", "xml", rowTag="item", rootTag="channel")
    return out(readers.read_feed(v.spark, f), "id", "text", "timestamp_utc", "market")


@query("rfc2822", "SELECT event_id, floor(epoch(ts))::BIGINT AS ts FROM (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '2024-02-01' WHEN event_id % 5 = 3 THEN ts - INTERVAL 90 MINUTE ELSE ts END AS ts FROM events)")
def _(v: Views):
    kinds = [F.date_format("ts", f) for f in ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "dd MMM yyyy HH:mm:ss 'UTC'", "EEE, d MMM yyyy HH:mm:ss '+0000'", "EEE, dd MMM yyyy HH:mm:ss '+0130'")]
    raw = F.element_at(F.array(*kinds, F.lit("soon")), (F.col("event_id") % 5 + 1).cast("int"))
    return v.events.select("event_id", sec(sc.parse_rfc2822(raw, F.lit("2024-02-01").cast("timestamp"))).alias("ts"))


@query("labelled_hub", """SELECT 'news' AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split, 'doc ' || doc_id AS text, quality::VARCHAR AS label FROM labels UNION ALL SELECT 'emoji', 'train', 'doc ' || doc_id, toxic::VARCHAR FROM labels""")
def _(v: Views):
    at = _folder(v)
    t = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    d = v.table("labels")
    a = put(d.where("doc_id % 2 = 0").select(t.alias("Text"), F.col("quality").alias("Label")), f"{at}/news/train.csv")
    b = put(d.where("doc_id % 2 <> 0").select(F.col("quality").alias(" LABEL "), t.alias("sentence")), f"{at}/news/validation.csv")
    c = put(d.select(t.alias("Tweet"), F.col("toxic").alias("sentiment")), f"{at}/emoji/train.csv")
    return readers.read_hub(v.spark, {"news": (a, b), "emoji": (c,)})


@query("label_report_by_file", "SELECT source || '.csv' AS file, label::VARCHAR AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS pct FROM labelled GROUP BY source, label", "labelled")
def _(v: Views):
    at = _folder(v)
    names = [r[0] for r in v.labelled.select("source").distinct().orderBy("source").collect()]  # a file each
    for s in names:
        put(v.labelled.where(F.col("source") == s).select("doc_id", F.col("label").cast("string").alias("label")), f"{at}/{s}.csv", one=True)
    return out(ingest.report_by_file(readers.read_csv(v.spark, at, "doc_id long, label string")))


@query("run_sink", "SELECT id, source, author FROM posts", "posts")
def _(v: Views):
    at = _folder(v)
    sinks.write_run(v.posts.limit(0).select("id", "source", "author"), at, "r1", partition_by=("source",))
    path = sinks.write_run(v.posts.select("id", "source", "author"), at, "r1", partition_by=("source",))  # the same run again replaces itself
    return v.spark.read.parquet(path).select("id", "source", "author")


@query("run_sink_csv", "SELECT id, source, text FROM posts", "posts")
def _(v: Views):
    path = sinks.write_run(v.posts.select("id", "source", "text"), _folder(v), "r1", kind="csv")
    return readers.read_csv(v.spark, path, "id long, source string, text string")


@query("json_upsert", "SELECT p_partkey AS ticker, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM part")
def _(v: Views):
    at, p = f"{_folder(v)}/registry", v.table("part").select(F.col("p_partkey").alias("ticker"))
    sinks.upsert_json(v.spark, p.withColumn("origin", F.lit("old")), at)
    return sinks.upsert_json(v.spark, p.where("ticker % 2 = 0").withColumn("origin", F.lit("new")), at)


@query("model_save_load", 'SELECT ticker, epoch(ts)::BIGINT AS ts, 1 AS same FROM bars', "bars")
def _(v: Views):
    b = v.bars.withColumns({"target": (F.col("Close") > F.col("Open")).cast("int"), "Volume": F.col("Volume").cast("double")})
    cols = ["Open", "High", "Low", "Close", "Volume"]
    cfg = Config()
    trees = model.boosted_trees(b, cols, cfg.boost_rounds, cfg.boost_depth, cfg.boost_rate, val=F.pmod(F.hash("ticker", "ts"), F.lit(5)) == 0)
    model.save(trees, at := f"{_folder(v)}/model")
    both = model.probability_up(model.load(at), model.probability_up(trees, b, "p1"), "p2")
    return out(both.withColumn("same", F.col("p1") == F.col("p2")), "ticker", "ts", "same")


# Schema and rows ---------------------------------------------------------------------------------------------------


@query("role_columns", "SELECT doc_id, text AS body, source AS origin FROM documents")
def _(v: Views):
    d = v.table("documents").select("doc_id", F.col("text").alias("TWEET"), F.col("source").alias("Platform"))
    return d.select("doc_id", F.col(role_column(d, ("text", "sentence", "tweet"))).alias("body"), F.col(role_column(d, ("source", "platform"))).alias("origin"))


@query("plain_headers", "SELECT p_partkey AS partkey, p_name AS name FROM part")
def _(v: Views):
    p = plain_headers(v.table("part").select(F.col("p_partkey").alias(" PartKey"), F.col("p_name").alias("NAME ")))
    require(p, "partkey", "name")
    return p


@query("unparseable_times", "SELECT id FROM posts WHERE k % 4 <> 0", "posts")
def _(v: Views):
    raw = F.when(F.col("k") % 4 == 0, "not a time").otherwise(F.col("timestamp_utc").cast("string"))
    p = v.posts.withColumn("timestamp_utc", raw.try_cast("timestamp"))
    return clean.flag_bots(p).select("id")


@query("epoch_seconds", "SELECT event_id, floor(epoch(ts))::BIGINT AS ts FROM events")
def _(v: Views):
    data = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("someone").alias("author"), F.unix_seconds("ts").cast("double").alias("created_utc"))
    page = F.struct(F.struct(F.lit(None).cast("string").alias("after"), F.array(F.struct(F.lit(readers.POST).alias("kind"), data.alias("data"))).alias("children")).alias("data"))
    p = readers.read_listing(v.events.select(F.to_json(page).alias("value")))
    return p.select(F.col("id").cast("long").alias("event_id"), sec("timestamp_utc").alias("ts"))


@query("safe_float", "SELECT id, CASE WHEN k % 5 = 0 THEN 0.0::DOUBLE WHEN k % 5 = 1 THEN 0.0::DOUBLE WHEN k % 5 = 2 THEN 0.0::DOUBLE ELSE round(value, 9) END AS x FROM posts", "posts")
def _(v: Views):
    k = F.col("k") % 5
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None)).otherwise(F.col("value"))
    return v.posts.select("id", r9(sc.safe(x)).alias("x"))


@query("preview", "SELECT id, ticker FROM posts ORDER BY timestamp_utc DESC, id DESC LIMIT 10", "posts")
def _(v: Views):
    return v.posts.orderBy(F.desc("timestamp_utc"), F.desc("id")).limit(10).select("id", "ticker")


@query("deterministic_cap", "SELECT id, source FROM posts WHERE source = 'reddit' ORDER BY id LIMIT 50", "posts")
def _(v: Views):
    return ingest.cap(v.posts.where("source = 'reddit'"), 50, "id").select("id", "source")


@query("available_features", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) FILTER (WHERE "{c}" IS NOT NULL AND isfinite("{c}"::DOUBLE)) AS n FROM technicals""" for c in model.TECHNICAL), "technicals")
def _(v: Views):
    """The features of the full set that the indicators have, each with the rows in which it is usable."""
    m = market.technicals(v.bars, fill=False, clip_at=None)
    have = model.available(m, model.FULL)
    usable = lambda c: F.count_if(F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")))
    counts = m.agg(*[usable(c).alias(c) for c in have])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in have])).alias("r")).select("r.*")


# Scorers and served rows -------------------------------------------------------------------------------------------


_IRONY = "CASE WHEN regexp_matches(t, '(^|\\s)/s\\s*$') THEN 0.9 WHEN regexp_matches(t, '\\byeah,? right\\b') THEN 0.7 WHEN regexp_matches(t, '\\b(oh|just) (great|wonderful|perfect)\\b') THEN 0.5 ELSE 0.0 END"
_ENDS = ("", " /s", " yeah right", " oh great", " https://x.y/s")


@query("sarcasm_scores", f"""SELECT id, CASE WHEN source = 'news' THEN 0.0 ELSE {_IRONY} END::DOUBLE AS sarcasm_score FROM (SELECT id, source, trim(regexp_replace(lower(text) || {list(_ENDS)}[(id % 5 + 1)::INT], 'http\\S+', ' ', 'g')) AS t FROM said)""", "said")
def _(v: Views):
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (F.col("id") % 5 + 1).cast("int"))
    s = score.sarcasm(F.concat("text", end), F.col("source"), live=clean.is_live(F.col("source")))
    return v.said.select("id", s.alias("sarcasm_score"))


@query("model_scorer", "SELECT id, CASE WHEN length(text) % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment_label, 0.75::DOUBLE AS sentiment_confidence FROM said", "said")
def _(v: Views):
    udf = score.model_scorer(lambda: lambda texts: [{"positive": 0.75, "negative": 0.25} if len(t) % 2 == 0 else {"positive": 0.25, "negative": 0.75} for t in texts])
    b = score.best_class(F.col("m"))
    return out(v.said.select("id", udf("text").alias("m")).select("id", b["sentiment_label"].alias("sentiment_label"), b["sentiment_confidence"].alias("sentiment_confidence")))


@query("probability_scorer", "SELECT id, CASE WHEN source = 'news' THEN 0.0 ELSE (length(trim(regexp_replace(regexp_replace(CASE WHEN source = 'stocktwits' THEN replace(regexp_replace(text, '@[\\p{L}\\p{N}_]+', ' ', 'g'), '#', '') ELSE text END, 'http\\S+|www\\S+', ' ', 'g'), '\\s+', ' ', 'g'))) % 100) / 100.0 END::DOUBLE AS p FROM said", "said")
def _(v: Views):
    udf = score.probability_scorer(lambda: lambda texts: [len(t) % 100 / 100.0 for t in texts])
    p = score.sarcasm(F.col("text"), F.col("source"), udf, clean.is_live(F.col("source")))
    return v.said.select("id", p.alias("p"))


@query("score_latest")
def _(v: Views):
    d = model_matrix(v).na.fill(0.0)
    cols = model.available(d, model.TECHNICAL)
    fit = model.scaler(d.where("split = 'train'"), cols)
    cfg = Config()
    trees = model.boosted_trees(model.scale(d.where("split <> 'test'"), fit), cols, cfg.boost_rounds, cfg.boost_depth, cfg.boost_rate, val=F.col("split") == "val")
    fresh = v.spark.createDataFrame([("AAPL", 0.5)], "ticker string, avg_sentiment double")
    return out(model.score_latest(d, fresh, trees, cols, fit))


@query("walk_forward_trees")
def _(v: Views):
    d, cfg = model_matrix(v), Config()
    rows = model.walk_forward_trees(d, model.available(d, model.TECHNICAL), rounds=cfg.boost_rounds, depth=cfg.boost_depth, rate=cfg.boost_rate)
    kind = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("accuracy", T.DoubleType()), T.StructField("f1_weighted", T.DoubleType())])
    return v.spark.createDataFrame([tuple(r.values()) for r in rows], kind)


__all__ = ["bit", "put", "put_bytes"]
