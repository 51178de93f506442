"""Bot and spam filters. Windows run per author or per repeated text; predicates are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..schemas import VOTES as VOTE_COLUMNS
from ..schemas import first_existing

LIVE = ("reddit", "stocktwits")
#: Posts an hour, copies and seconds of a burst, votes, words, letters.
RATE, COPIES, SPAN, VOTES, WORDS_LIVE, WORDS_ELSE, LETTERS = 120, 4, 2700, 6, 4, 2, 6
PLACEHOLDERS = ("[unknown]", "unknown", "none", "null", "nan", "")


def is_live(source: Column) -> Column:
    return F.coalesce(F.lower(source).isin(*LIVE), F.lit(False))


def is_placeholder(author: Column) -> Column:
    return author.isNull() | F.lower(F.trim(author)).isin(*PLACEHOLDERS)


def posts_last_hour(author: str, ts: str, what: str) -> Column:
    """Posts of the author in (t - 1 hour, t]; rows at the same microsecond see each other."""
    w = Window.partitionBy(author).orderBy(F.unix_micros(ts)).rangeBetween(-3_599_999_999, 0)
    return F.count(what).over(w)


def hourly_counts(posts: DataFrame, which: str, author: str, ts: str, what: str, out: str) -> DataFrame:
    """``posts`` and, where ``which`` holds, the posts of the author in (t - 1 hour, t] that have ``what``; else null. An author's
    hours are counted apart, each with the hour before it as well, of which only times are sent: one who wrote half of all posts is
    spread over as many tasks as there are hours."""
    cols, kinds = posts.columns, dict(posts.dtypes)
    # Rows that are not counted are of no author and spread by their time.
    hour = F.when(F.col(which), F.floor(F.unix_micros(ts) / 3_600_000_000)).otherwise(F.xxhash64(ts))
    key = F.when(F.col(which), F.col(author)).otherwise(F.lit(None).cast(kinds[author]))
    row = lambda own, at, put: F.struct(F.lit(own).alias("_own"), at.alias("_hour"), F.unix_micros(ts).alias("_t"), F.col(what).isNotNull().cast("long").alias("_has"), key.alias("_key"), *[put(c).alias(c) for c in cols])
    own = row(True, hour, F.col)
    before = row(False, hour + 1, lambda c: F.lit(None).cast(kinds[c]))
    e = posts.select(F.explode(F.when(F.col(which), F.array(own, before)).otherwise(F.array(own))).alias("_r")).select("_r.*")
    w = Window.partitionBy("_key", "_hour").orderBy("_t").rangeBetween(-3_599_999_999, 0)
    e = e.withColumn(out, F.when(F.col(which), F.sum("_has").over(w))).where("_own")
    return e.select(*cols, out)


def suspicious_name(author: Column) -> Column:
    u = F.trim(author)
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    odd = u.rlike("^[a-zA-Z]{2,}[0-9]{4,}$") | u.rlike("^[a-zA-Z0-9]{16,}$") | ((digits > 0.9 * F.length(u)) & (F.length(u) >= 8))
    return F.coalesce(~is_placeholder(author) & odd, F.lit(False))


def flag_bots(posts: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """post_count_last_hour, freq_bot, username_bot, text_hash, duplicate_bot, is_bot; rows without a time go."""
    p = posts.where(F.col(ts).isNotNull())
    live = is_live(F.col("source"))
    named = live & ~is_placeholder(F.col("author"))
    p = p.withColumns({"_named": named, "text_hash": tx.text_hash(F.col("text"))})
    p = hourly_counts(p, "_named", "author", ts, "text", "post_count_last_hour")
    # Copies are counted where they are read and joined back: no task holds all copies of a text.
    same = ["source", "author", "text_hash"]
    span = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    found = p.where("_named").groupBy(*same).agg((span <= SPAN * 1_000_000).alias("_short"), F.count("*").alias("_n")).where((F.col("_n") >= COPIES) & F.col("_short"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in same])
    at = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    p = p.join(found, at[0] & at[1] & at[2] & F.col("_named"), "left")
    burst = F.col("_source").isNotNull()
    p = p.withColumns({
        "freq_bot": F.coalesce(F.col("post_count_last_hour") > RATE, F.lit(False)),
        "username_bot": live & suspicious_name(F.col("author")),
        "duplicate_bot": F.coalesce(burst, F.lit(False)),
    })
    return p.withColumn("is_bot", F.col("freq_bot") | F.col("username_bot") | F.col("duplicate_bot")).drop("_named", *[f"_{c}" for c in same])


def vote_gate(posts: DataFrame, votes: str = "upvotes") -> DataFrame:
    """One row: whether the vote filter applies at all."""
    live = is_live(F.col("source"))
    known = F.count_if(live & F.col(votes).isNotNull())
    mean = F.avg(F.when(live, F.coalesce(F.col(votes), F.lit(0))))
    return posts.agg(F.coalesce((known > 0.3 * F.count_if(live)) & (mean > 1), F.lit(False)).alias("_gate"))


def vote_filter(posts: DataFrame, votes: str | None = None) -> DataFrame:
    """Live posts need votes if most have them; the gate is one row, so joining it is a broadcast of one row. Without a column
    of votes all stay."""
    votes = votes or first_existing(posts, VOTE_COLUMNS)
    if votes is None:
        return posts
    gated = posts.join(F.broadcast(vote_gate(posts, votes)))
    keep = ~F.col("_gate") | ~is_live(F.col("source")) | F.coalesce(F.col(votes) >= VOTES, F.lit(False))
    return gated.where(keep).drop("_gate")


def enough_words(text: Column, source: Column) -> Column:
    return tx.word_count(text) >= F.when(is_live(source), WORDS_LIVE).otherwise(WORDS_ELSE)


def enough_letters(text: Column) -> Column:
    return F.coalesce(tx.has_letters(text, LETTERS), F.lit(False))


def filter_spam(posts: DataFrame) -> DataFrame:
    """Votes, words, addresses alone, letters; then the text is cleaned."""
    p = vote_filter(posts).where(enough_letters(F.col("text")) & ~F.coalesce(tx.is_url_only(F.col("text")), F.lit(False)))
    p = p.withColumn("word_count", tx.word_count(F.col("text")))
    p = p.where(F.col("word_count") >= F.when(is_live(F.col("source")), WORDS_LIVE).otherwise(WORDS_ELSE))
    return p.withColumn("text", tx.clean_b(F.col("text")))
