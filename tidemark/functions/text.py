"""Text functions as Column expressions; regular expressions stay inside whole-stage code."""

from __future__ import annotations

import html.entities
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The commonest entities, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_common_entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)


#: Fixed value: how an entity looks in a text: a number, or up to 32 signs of a name.
ENTITY = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


def _signs(n: Column) -> Column:
    """The character of a number, by the published rules: numbers of the old western code page mean its characters, no characters
    are left out, and what is outside of Unicode becomes the sign for that."""
    old = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
    known = F.create_map(*[F.lit(x) for kv in old.items() for x in kv])
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(n.isin(*old), known[n]).when(control, "").otherwise(own)


def _entity(e: Column) -> Column:
    """What an entity stands for; itself, if nothing."""
    digits = lambda base: F.regexp_replace(F.regexp_replace(e, "^&#[xX]?0*|;$", ""), "^$", "0")  # noqa: E731,ARG005
    number = F.when(F.length(digits(10)) <= 7, digits(10).try_cast("int"))
    hexed = F.when(F.length(digits(16)) <= 7, F.conv(digits(16), 16, 10).try_cast("int"))
    whole = {f"&{k}": v for k, v in html.entities.html5.items()}
    # Names that may stand without a semicolon, and so before other letters: of these the longest that fits.
    open_ = {k: v for k, v in whole.items() if not k.endswith(";")}
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    longest = max(map(len, open_))
    fits = F.filter(F.transform(F.sequence(F.lit(longest), F.lit(3), F.lit(-1)), lambda n: F.substr(e, F.lit(1), n)), lambda k: k.isin(*open_))
    head = F.get(fits, F.lit(0))
    named = F.coalesce(table(whole)[e], F.concat(table(open_)[head], F.substr(e, F.length(head) + 1)), e)
    return F.when(e.rlike("^&#[xX]"), _signs(hexed)).when(F.startswith(e, F.lit("&#")), _signs(number)).otherwise(named)


def decode_entities(c: Column) -> Column:
    """Every named and numeric entity, with and without semicolon. A text is cut at its entities, each is looked up, and the parts are
    put together."""
    parts, found = F.split(c, ENTITY, -1), F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))
    both = F.zip_with(parts, F.concat(F.transform(found, _entity), F.array(F.lit(""))), lambda p, e: F.concat(p, e))
    return F.array_join(both, "")


#: Fixed value: how an entity looks where only those with a semicolon count, by name or decimal number.
CLOSED = "&(?:#[0-9]+|[0-9a-zA-Z]+);"


def decode_closed(c: Column) -> Column:
    """Named and decimal entities that end with a semicolon; cut ones stay as they are. A number is its code point, whatever that is;
    numbers that are none stay."""
    names = F.create_map(*[F.lit(x) for k, v in html.entities.html5.items() if k.endswith(";") for x in (f"&{k}", v)])

    def one(e: Column) -> Column:
        n = F.substr(e, F.lit(3), F.length(e) - 3).try_cast("int")
        sign = F.when((n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(e.startswith("&#"), sign).otherwise(names[e]), e)

    parts, found = F.split(c, CLOSED, -1), F.regexp_extract_all(c, F.lit(CLOSED), F.lit(0))
    return F.array_join(F.zip_with(parts, F.concat(F.transform(found, one), F.array(F.lit(""))), lambda p, e: F.concat(p, e)), "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def decode(c: Column) -> Column:
    """Every entity; texts without an ampersand stay as they are."""
    return F.when(F.contains(c, F.lit("&")), decode_entities(c)).otherwise(c)


def clean_a(c: Column, full_entities: bool = True) -> Column:
    """Entities, tags, web addresses, cashtags, then only letters, digits and common marks."""
    c = decode(c) if full_entities else decode_common_entities(c)
    c = F.regexp_replace(strip_tags(c), "http\\S+|www\\.\\S+", "")
    c = F.regexp_replace(c, "\\$[A-Z]{1,5}\\b", "")
    return F.coalesce(squeeze(F.regexp_replace(c, "[^a-zA-Z0-9\\s.,!?'\"-]", " ")), F.lit(""))


def clean_b(c: Column) -> Column:
    """Web addresses, markdown marks, cashtags without a word end, and everything outside ASCII go."""
    for pattern in ("http\\S+|www\\S+", "[*_`~>]", "\\$[A-Z]{1,5}", "[^\\x00-\\x7F]"):
        c = F.regexp_replace(c, pattern, "")
    return squeeze(c)


#: Sources whose texts hold handles and hash marks.
TWITTER_LIKE = ("huggingface", "kaggle", "kaggle_india_stocktwits", "stocktwits")


def strip_handles(c: Column, source: Column, twitter_like: tuple[str, ...] = TWITTER_LIKE) -> Column:
    """Handles and hash marks of twitter-like sources; web addresses of all."""
    plain = F.regexp_replace(F.regexp_replace(c, "@[\\p{L}\\p{N}_]+", " "), "#", "")
    c = F.when(F.lower(source).isin(*twitter_like), plain).otherwise(c)
    return squeeze(F.regexp_replace(c, "http\\S+|www\\S+", " "))


def hash_form(c: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_]+", "")


def text_hash(c: Column) -> Column:
    return F.md5(hash_form(c))


def word_count(c: Column) -> Column:
    """Words between white space; a null counts as one word, as a missing text is read as a word."""
    return F.coalesce(F.regexp_count(c, F.lit("\\S+")), F.lit(1)).cast("int")


def has_letters(c: Column, n: int) -> Column:
    """Whether a text has ``n`` letters; the search ends at the last of them."""
    return c.rlike(f"(?:[A-Za-z][^A-Za-z]*+){{{n}}}")


def is_url_only(c: Column) -> Column:
    return F.trim(c).rlike("^https?://\\S+$")


def title_and_description(title: Column, description: Column) -> Column:
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    return F.btrim(joined, F.lit(". "))


def stable_id(tag: Column, raw: Column) -> Column:
    """``tag_raw``; a null, blank or zero raw id is hashed instead."""
    text = raw.cast("string")
    empty = raw.isNull() | (F.trim(text) == "") | (text == "0")
    return F.when(empty, F.md5(F.coalesce(text, F.lit("None")))).otherwise(F.concat_ws("_", tag, text))


# Tickers -----------------------------------------------------------------------------------------------------------


#: Symbols that take the suffix of their exchange.
BARE_INDIAN = ("RELIANCE", "TCS", "INFY", "HDFCBANK", "ICICIBANK", "WIPRO", "SBIN", "TATAMOTORS", "ADANIENT", "BAJFINANCE")
#: Symbols accepted where no company list is given.
KNOWN = ("TSLA", "GME", "AAPL", "NVDA", "AMZN", *[f"{x}_NS" for x in BARE_INDIAN])
#: Names found anywhere in a text.
NAMES = {
    "tesla": "TSLA", "gamestop": "GME", "apple": "AAPL", "nvidia": "NVDA", "amazon": "AMZN", "reliance": "RELIANCE_NS", "tcs": "TCS_NS",
    "infosys": "INFY_NS", "hdfc bank": "HDFCBANK_NS", "icici bank": "ICICIBANK_NS", "wipro": "WIPRO_NS", "state bank of india": "SBIN_NS",
    "sbi": "SBIN_NS", "tata motors": "TATAMOTORS_NS", "adani enterprises": "ADANIENT_NS", "bajaj finance": "BAJFINANCE_NS",
}


def normalise_ticker(c: Column) -> Column:
    return F.nullif(F.replace(F.upper(F.trim(c)), F.lit(".NS"), F.lit("_NS")), F.lit(""))


def cashtags(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("\\$([A-Z]{1,5})"), F.lit(1)), normalise_ticker)


def plain_tickers(c: Column) -> Column:
    found = F.regexp_extract_all(F.upper(c), F.lit("(?U)\\b[A-Z]{2,10}(?:_NS)?\\b"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.isin(*BARE_INDIAN), F.concat(t, F.lit("_NS"))).otherwise(t))


def named_tickers(c: Column, names: dict[str, str] = NAMES) -> Column:
    """Tickers of the names that occur in the text, in the order of the list; a name may occur inside a longer word."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("ticker")) for k, v in names.items()])
    return F.transform(F.filter(pairs, lambda p: F.contains(F.lower(c), p["name"])), lambda p: p["ticker"])


def market_of(ticker: Column) -> Column:
    return F.when(ticker.rlike("\\.(NS|BO)$"), "IN").otherwise("US")


def bare(ticker: Column) -> Column:
    return F.regexp_replace(ticker, "\\.(NS|BO)$", "")


def bare_ticker(c: Column) -> Column:
    """The name as a symbol, upper case without hyphens and spaces, if that is one to six letters; else null."""
    t = F.upper(F.regexp_replace(F.trim(c), "[- ]", ""))
    return F.when(t.rlike("^\\p{L}{1,6}$"), t)


def queries_for(ticker: Column) -> Column:
    us = F.array(F.concat(F.lit("$"), ticker), ticker)
    return F.when(market_of(ticker) == "IN", F.array(bare(ticker), F.concat(bare(ticker), F.lit(".NS")))).otherwise(us)


def swap_suffix(c: Column, to_dot: bool = False) -> Column:
    for a, b in (("_NS", ".NS"), ("_BO", ".BO")):
        a, b = (a, b) if to_dot else (b, a)
        c = F.regexp_replace(c, a.replace(".", "\\.") + "$", b)
    return c


# Labels: three maps that disagree and are kept apart ---------------------------------------------------------------


#: The words of each map.
HUB_BLANK = ("none", "nan", "na", "n/a", "null", "unlabeled", "unlabelled", "unknown", "")
HUB = {"Bullish": ("bullish", "positive", "pos", "buy", "1"), "Bearish": ("bearish", "negative", "neg", "sell", "-1"), "Neutral": ("neutral", "neu", "0")}
STATIC = {2: ("positive", "pos", "bullish", "buy", "1"), 1: ("neutral", "neu", "hold", "0"), 0: ("negative", "neg", "bearish", "sell", "-1")}
TRAIN = {"positive": ("positive", "pos", "bullish", "2", "buy"), "negative": ("negative", "neg", "bearish", "0", "-1", "sell"), "neutral": ("neutral", "neu", "hold", "1")}


def _named(low: Column, words: dict, start: Column | None = None) -> Column:
    out = start if start is not None else F
    for name, ws in words.items():
        out = out.when(low.isin(*ws), name)
    return out


def label_hub(c: Column) -> Column:
    """Words to Bullish, Bearish, Neutral; blanks to null; anything else as it is."""
    t = F.trim(c)
    low = F.lower(t)
    return _named(low, HUB, F.when(low.isin(*HUB_BLANK), None)).otherwise(t)


def label_static(c: Column) -> Column:
    """2, 1, 0; text forms first, so a bare 1 is positive; then whole numbers."""
    low = F.lower(F.trim(c))
    n = low.try_cast("double").try_cast("int")
    return _named(low, STATIC).when(n.isin(0, 1, 2), n).when(n == -1, 0)


def label_train(c: Column) -> Column:
    """Words, here with 2 positive, 1 neutral, 0 and -1 negative."""
    return _named(F.lower(F.trim(c)), TRAIN)


# Log lines ---------------------------------------------------------------------------------------------------------


def event_frame(stage: Column, status: Column, rows: Column) -> Column:
    """A progress event as JSON."""
    return F.to_json(F.struct(stage.alias("stage"), status.alias("status"), rows.alias("rows")))


#: Words of a line that name its stage, in order of preference; the end needs one of each pair.
STAGE_WORDS = (
    ("1A", ("stage 1a", "data cleaning", "bot detection")), ("1B", ("stage 1b", "finbert", "sentiment analysis")), ("1C", ("stage 1c", "aggregat", "sentiment feature")),
    ("2A", ("stage 2a", "market data", "technical indicator")), ("2B", ("stage 2b", "granger")), ("2C", ("stage 2c", "feature fusion", "fusing")),
    ("3", ("stage 3", "prediction model", "ensemble")),
)
STAGE_END = ("pipeline", ("complete", "summary"))


def stage_of(message: Column) -> Column:
    """The stage that a message names, null if none."""
    low = F.lower(message)
    has = lambda ws: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws])
    out = F.when(has(STAGE_END[:1]) & has(STAGE_END[1]), "complete")
    for name, ws in reversed(STAGE_WORDS):
        out = F.when(has(ws), name).otherwise(out)
    return out


#: Fixed value: a line's date and time, level, logger and message between bars, with any or no white space around them.
LOG_LINE = "(?U)^(\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}:\\d{2})\\s*\\|\\s*(\\w+)\\s*\\|\\s*(\\w+)\\s*\\|\\s*(.+)$"


def parse_log(c: Column) -> dict[str, Column]:
    """Time, level, logger, message and stage of log lines; all of them null for a line of another form."""
    line = F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    part = lambda n: F.when(line.rlike(LOG_LINE), F.regexp_extract(line, LOG_LINE, n))
    return {"time": part(1), "level": part(2), "logger": part(3), "message": part(4), "stage": stage_of(part(4))}
