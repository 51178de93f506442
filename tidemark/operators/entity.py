"""Ticker linking: cashtags, plain symbols, hints, then names; one row for each ticker of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def candidates(text: Column, hints: list[Column]) -> Column:
    own = F.array_compact(F.array(*[tx.normalise_ticker(h) for h in hints])) if hints else F.array().cast("array<string>")
    return F.concat(tx.cashtags(text), tx.plain_tickers(text), own)


def organisation_tickers(organisations: Column, companies: dict[str, str]) -> Column:
    """Tickers of the organisation names (an array of strings) that a company list has, whatever their case."""
    known = F.create_map(*[F.lit(x) for k, v in companies.items() for x in (k.lower(), v)])
    return F.array_compact(F.transform(organisations, lambda o: known[F.lower(o)]))


def link(posts: DataFrame, valid: tuple[str, ...] | None = tx.KNOWN, names: dict[str, str] = tx.NAMES, organisations=None, companies: dict[str, str] | DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Names are looked at only where nothing else was found; posts without a ticker go. ``organisations`` is a recogniser of
    organisation names (a text column to an array of names, an Arrow function for instance): what it finds in ``companies`` comes
    before the names. It is given the texts that nothing else was found in, null for the others. Without a recogniser ``companies``
may be a table (company, ticker) of any size, whose names are looked for in those texts (``mentions``). ``place`` names a column for the
    ticker's place among the post's, from 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hints = [F.col(c).cast("string") for c in ("ticker", "post_flair", "symbol") if c in posts.columns]
    # Distinct, in order of first appearance.
    known = lambda a: F.array_intersect(a, F.array(*[F.lit(t) for t in valid])) if valid else F.array_distinct(F.array_compact(a))
    p = posts.withColumn("_first", known(candidates(text, hints)))
    none = F.size("_first") == 0
    later = tx.named_tickers(text, names)
    if organisations is None and isinstance(companies, DataFrame):
        digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
        m = mentions(p.where(none), companies).withColumnRenamed("id", "_id").withColumnRenamed("organisations", "_organisations")
        p = p.join(m, (F.col("id").eqNullSafe(F.col("_id"))) & none & (digest == F.col("digest")), "left").drop("_id", "digest")
        later = F.concat(F.coalesce("_organisations", F.array().cast("array<string>")), later)
    elif organisations is not None and companies:
        p = p.withColumn("_organisations", organisations(F.when(none, text)))
        later = F.concat(F.coalesce(organisation_tickers(F.col("_organisations"), companies), F.array().cast("array<string>")), later)
    found = F.when(none, known(later)).otherwise(F.col("_first"))
    # The outer form, as the plain one makes the optimiser push a test of the array's size, and so all of the search, to the scan.
    kept = [F.col(c) for c in posts.columns if c not in ("ticker", place)]
    p = p.select(*kept, F.posexplode_outer(found).alias("_place", "ticker")).where("ticker IS NOT NULL")
    return p.withColumn(place, F.col("_place") + 1).drop("_place") if place else p.drop("_place")


def resolve_company(names: DataFrame, companies: DataFrame, name: str = "name") -> DataFrame:
    """The ticker of a company: its row in the list, else the name itself if it looks like a symbol."""
    c = companies.groupBy(F.lower(F.trim("company")).alias("_key")).agg(F.min("ticker").alias("_ticker"))
    j = names.join(c, F.lower(F.trim(name)) == F.col("_key"), "left")
    return j.withColumn("ticker", F.coalesce("_ticker", tx.bare_ticker(F.col(name)))).drop("_key", "_ticker")


#: Companies that are sent to every task, checked before; more than that meet the texts by a shuffle.
BROADCAST_COMPANIES = 200_000


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?U)[\\p{L}\\p{N}]+"), F.lit(0))


def mentions(posts: DataFrame, companies: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, digest, organisations): tickers of the companies that a text names, in order, leftmost first and of those that begin at
    one word the longest; no two share a word. Names and texts are compared as sequences of lower-case words, so a name ends where
    a word ends. ``companies`` (company, ticker) may be of any size; of equal names the smallest ticker counts, names without a word
    none. Every run of words up to the longest name is looked up once, rows are kept by id and digest of the text, and only
    texts that name a company come back."""
    w = F.col("_w")
    c = companies.withColumn("_w", _words(F.col("company"))).where((F.size("_w") > 0) & F.col("ticker").isNotNull())
    c = c.groupBy(F.array_join("_w", " ").alias("_name")).agg(F.min("ticker").alias("ticker"), F.min(F.size("_w")).alias("_n"))
    longest, n = c.agg(F.max("_n"), F.count("*")).first()
    p = posts.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), _words(F.col(text)).alias("_w"))

    def runs(w: Column) -> Column:
        """(at, n, name) of every run of words of a text that is not longer than a name."""
        one = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest or 1), F.size(w) - i)), lambda k: F.struct(i.alias("at"), k.alias("n"), F.array_join(F.slice(w, i + 1, k), " ").alias("name")))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), one))

    once = F.get(F.transform(F.array(w), runs), F.lit(0))
    r = p.where(F.size("_w") > 0).distinct().select("id", "digest", F.explode(once).alias("r")).select("id", "digest", "r.at", "r.n", F.col("r.name").alias("_name"))
    c = c.select("_name", "ticker")
    hit = r.join(F.broadcast(c) if n <= BROADCAST_COMPANIES else c, "_name")
    longest_at = hit.groupBy("id", "digest", "at").agg(F.max_by(F.struct("n", "ticker"), "n").alias("x"))
    found = longest_at.groupBy("id", "digest").agg(F.sort_array(F.collect_list(F.struct("at", F.col("x.n").alias("n"), F.col("x.ticker").alias("ticker")))).alias("_all"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.struct(F.when(x["at"] >= s["free"], x["at"] + x["n"]).otherwise(s["free"]).alias("free"), F.when(x["at"] >= s["free"], F.concat(s["out"], F.array(x["ticker"]))).otherwise(s["out"]).alias("out"))
    return found.select("id", "digest", F.aggregate("_all", start, step, lambda s: s["out"]).alias("organisations"))
