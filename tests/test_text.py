import html

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans import catalogue


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_cleaner_a(spark):
    got = run(spark, tx.clean_a, ["<b>Hi</b> &amp; bye http://a.b/c $TSLA now", "  a\n\tb ", "Été 😀 ok", None, "", "$TSLAQX stays"])
    assert got == ["Hi bye now", "a b", "t ok", "", "", "TSLAQX stays"]


def test_cleaner_b_takes_cashtags_without_a_word_end(spark):
    assert run(spark, tx.clean_b, ["*Hi* $TSLAQX `x` > é www.a.b end", None]) == ["Hi X x end", None]


def test_entities_in_full(spark):
    values = ["&eacute;&#233;&hellip;", "&lt;b&gt;", "plain", None]
    assert run(spark, tx.decode_entities, values) == [None if v is None else html.unescape(v) for v in values]


def test_closed_entities_as_the_sql_has_them(spark, tmp_path):
    values = ["cut &amp</b> &am &amp;amp; &&lt;;", "&#38;&#233;&eacute;&nosuch;&#x41; &#1114112;", "two\nlines &hellip;", "plain", ""]
    assert run(spark, tx.decode_closed, [*values, None]) == ["cut &amp</b> &am &amp; &<;", "&éé&nosuch;&#x41; &#1114112;", "two\nlines …", "plain", "", None]
    rows = [(i, v.replace("&#1114112;", "")) for i, v in enumerate(values)] + [(9, None)]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/*.parquet')")
    got = catalogue.QUERIES["entity_decode_full"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.sql(catalogue.ORACLES["entity_decode_full"]).fetchall())


def test_hash_form_keeps_letters_of_all_scripts(spark):
    assert run(spark, tx.hash_form, ["Été_x!", "Ünï 1-2", "日本 語"]) == ["été_x", "ünï12", "日本語"]


def test_words_letters_addresses(spark):
    assert run(spark, tx.word_count, ["a b  c", "", "   ", None]) == [3, 0, 0, 1]
    assert run(spark, lambda c: tx.has_letters(c, 3), ["ab1 c", "é", "ab", "a1b2c3d4"]) == [True, False, False, True]
    assert run(spark, tx.is_url_only, [" https://x.y ", "https://x.y z", "http://"]) == [True, False, False]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (tx.label_hub, ["Bullish", "Neutral", "Bearish", None, "2", "Bullish", None, "odd"]),
        (tx.label_static, [2, 1, 0, None, 2, 2, None, None]),
        (tx.label_train, ["neutral", "negative", "negative", None, "positive", "positive", None, None]),
    ],
)
def test_label_maps_disagree(spark, f, want):
    assert run(spark, f, ["1", "0", "-1", " ", "2", "Bullish", None, "odd"]) == want


def test_static_map_of_numbers(spark):
    assert run(spark, tx.label_static, ["1.0", "2.0", "-1.0", "3", "0.0"]) == [1, 2, 0, None, 0]


def test_stable_id(spark):
    import hashlib

    got = run(spark, lambda c: tx.stable_id(F.lit("t"), c), [0, 5, None], "long")
    assert got == [hashlib.md5(b"0").hexdigest(), "t_5", hashlib.md5(b"None").hexdigest()]


def test_tickers(spark):
    assert run(spark, tx.cashtags, ["$TSLA and $abc $TOOLONG"]) == [["TSLA", "TOOLO"]]
    assert run(spark, tx.plain_tickers, ["tcs and AAPL x"]) == [["TCS_NS", "AND", "AAPL"]]
    assert run(spark, tx.named_tickers, ["a pineapple"]) == [["AAPL"]]
    assert run(spark, tx.normalise_ticker, [" infy.ns ", "  "]) == ["INFY_NS", None]
    assert run(spark, tx.queries_for, ["AAPL", "TCS.NS"]) == [["$AAPL", "AAPL"], ["TCS", "TCS.NS"]]


def test_title_and_description(spark):
    df = spark.createDataFrame([("T", "D."), ("T", None), (None, "D")], "t string, d string")
    assert [r[0] for r in df.select(tx.title_and_description(F.col("t"), F.col("d"))).collect()] == ["T. D", "T", "D"]


def test_entities_are_those_of_the_published_table(spark):
    import html.entities
    import random

    r = random.Random(6)
    names = list(html.entities.html5)
    values = [f"&{n}" for n in names] + [f"x&{n.rstrip(';')}y;" for n in names[::3]] + [f"&{n.rstrip(';')}" for n in names[::5]]
    values += [f"&#{n};" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**40]]
    values += [f"&#x{n:X}" for n in [0, 1, 13, 0x80, 0x9F, 0x3A9, 0x1F600, 0x10FFFF, 0x110000, 16**20]] + ["&#X3a9;z", "&#0000065;", "&#x000000000041;", "&#", "&#x;", "&;", "&", "& amp;", "&amp", "&ampx", "&notit;", "&notin;", "&\tamp;", "&#65&#66;"]
    pieces = ["&", "amp", "lt", ";", "#", "x41", "65", "not", "it", "in", " ", "é", "😀", "<", "copy", "\n", "GT"]
    values += ["".join(r.choice(pieces) for _ in range(r.randrange(1, 12))) for _ in range(1500)]
    got = run(spark, tx.decode, values)
    assert [(v, g) for v, g in zip(values, got) if g != html.unescape(v)] == []
