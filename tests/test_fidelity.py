"""Rows written by hand from the published rules, so that a query and its SQL cannot agree on a wrong one."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.functions import text as tx
from tidemark.operators import causality, clean, entity, ingest, market, model, score
from tidemark.plans import pipeline
from tidemark.schemas import STEP_ALIASES, coalesce_aliases
from tidemark.sources import paged, readers
from tidemark.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_stage_router(spark):
    lines = {
        "Downloading market data": "2A", "FinBERT loaded": "1B", "Prediction model ready": "3", "Fusing frames": "2C", "Pipeline complete": "complete", "PIPELINE SUMMARY": "complete", "Running the robot": None,
        "Stage 1a begins": "1A", "data cleaning": "1A", "Sentiment Features aggregated": "1C", "technical indicators": "2A", "Granger": "2B", "ensemble": "3", "complete": None, "spam": None,
        "sentiment analysis of market data": "1B",
    }
    assert column(spark, tx.stage_of, list(lines)) == list(lines.values())


def test_alias_order(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", 1, 2, "e", "f")], "handle string, username string, timestamp string, created_utc string, votes int, favorites int, tweet string, content string")
    r = coalesce_aliases(df).first()
    assert (r.author, r.upvotes, r.text, r.source) == ("b", 2, "e", "unknown") and r.timestamp_utc == "d"
    none = coalesce_aliases(spark.createDataFrame([(1,)], "x int")).first()
    assert (none.author, none.text, none.upvotes) == ("[unknown]", "", None)
    bots = coalesce_aliases(spark.createDataFrame([("m", "n")], "message string, author_name string"), aliases=STEP_ALIASES["bots"]).first()
    assert (bots.text, bots.author) == ("", "[unknown]")  # this step does not know these names


def test_votes_come_from_ups_first(spark):
    df = spark.createDataFrame([("reddit", 10, 0), ("reddit", 2, 99)], "source string, ups long, upvotes long")
    assert [r.ups for r in clean.vote_filter(df).collect()] == [10]
    assert clean.vote_filter(df.drop("ups", "upvotes")).count() == 2


@pytest.mark.parametrize(("seconds", "flagged"), [(2700.0, True), (2700.5, False), (2699.9, True)])
def test_burst_span_has_fractions(spark, seconds, flagged):
    last = T0 + dt.timedelta(seconds=seconds)
    rows = [(str(i), "reddit", "joe", "same", t) for i, t in enumerate((T0, T0, T0, last))]
    p = spark.createDataFrame(rows, "id string, source string, author string, text string, timestamp_utc timestamp")
    assert {r.duplicate_bot for r in clean.flag_bots(p).collect()} == {flagged}


def test_handles(spark):
    df = spark.createDataFrame([("@Jürgen_1 #up http://x.y go", s) for s in ("huggingface", "kaggle", "kaggle_india_stocktwits", "StockTwits", "twitter", "reddit")], "t string, s string")
    assert [r[0] for r in df.select(tx.strip_handles(F.col("t"), F.col("s"))).collect()] == ["up go"] * 4 + ["@Jürgen_1 #up go"] * 2


def test_bare_tickers(spark):
    assert column(spark, tx.bare_ticker, ["brk-b", " BRK B ", "toolong", "abc1", "aapl", "é-a", ""]) == ["BRKB", "BRKB", None, None, "AAPL", "ÉA", None]
    names = spark.createDataFrame([("Tesla",), ("brk-b",), ("no such company",)], "name string")
    got = entity.resolve_company(names, spark.createDataFrame([("tesla", "TSLA")], "company string, ticker string")).collect()
    assert {r.name: r.ticker for r in got} == {"Tesla": "TSLA", "brk-b": "BRKB", "no such company": None}


@pytest.mark.parametrize(("n", "size"), [(100, 14), (7, 1), (13, 1), (6, 0)])
def test_walk_forward_cuts_whole_rows(spark, n, size):
    rows = [("B" if i % 2 else "A", T0 + dt.timedelta(hours=i // 2)) for i in range(n)]
    got = market.walk_forward(spark.createDataFrame(rows, "ticker string, ts timestamp")).collect()
    for k in range(1, 7):
        fold = [r for r in got if r.fold == k]
        train, val = [(r.ts, r.ticker) for r in fold if r.part == "train"], [(r.ts, r.ticker) for r in fold if r.part == "val"]
        assert (len(train), len(val)) == (size * k, size) and (not val or max(train) < min(val))


def test_cleaner_decodes_every_entity(spark):
    values = ["wait&hellip; A&#66;&#x43; R&amp;D &lt;b&gt;x&lt;/b&gt; &nosuch; &copy", "no entity", None]
    assert column(spark, tx.clean_a, values) == ["wait ABC R D x nosuch", "no entity", ""]


def test_times_with_one_digit(spark):
    values = ["1/2/2024 3:04", "2024-1-2", "2024-1-2 3:4:5", "2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05.123456Z", "Tue Jan 2 3:04:05 +0000 2024", "2/30/2024 1:00"]
    d = dt.datetime(2024, 1, 2)
    got = column(spark, lambda c: sc.parse_time(c, F.lit(T0)), values)
    assert got == [d.replace(hour=3, minute=4), d, d.replace(hour=3, minute=4, second=5), d.replace(hour=3, minute=4, second=5, microsecond=500000), d.replace(hour=3, minute=4, second=5, microsecond=123456), d.replace(hour=3, minute=4, second=5), T0]


def test_hints_come_last(spark):
    df = spark.createDataFrame([(1, "AAPL then $TSLA", " nvda ", None), (2, "nothing", None, "infy.ns"), (3, "I like tesla", None, None), (4, "none at all", None, None)], "id int, text string, ticker string, symbol string")
    got = entity.link(df).select("id", "ticker").collect()
    assert [tuple(r) for r in got] == [(1, "TSLA"), (1, "AAPL"), (1, "NVDA"), (2, "INFY_NS"), (3, "TSLA")]


def test_organisations_come_before_names(spark):
    df = spark.createDataFrame([(1, "Acme buys tesla"), (2, "Acme and AAPL")], "id int, text string")

    @F.pandas_udf("array<string>")
    def find(s):
        assert not any(t is not None and "AAPL" in t for t in s)  # texts that need none are not sent
        return s.map(lambda t: [] if t is None else ["ACME"] if "Acme" in t else [])

    got = entity.link(df, organisations=find, companies={"Acme": "GME"}).select("id", "ticker").collect()
    assert [tuple(r) for r in got] == [(1, "GME"), (1, "TSLA"), (2, "AAPL")]


def test_sarcasm_scope_and_flags(spark):
    df = spark.createDataFrame([("oh great", "reddit"), ("oh great", "news"), ("@a http://x.y", "stocktwits"), ("fine /s", "reddit")], "text string, source string")
    s = score.sarcasm(F.col("text"), F.col("source"), live=clean.is_live(F.col("source")))
    assert [r[0] for r in df.select(s).collect()] == [0.5, 0.0, 0.0, 0.9]
    udf = score.probability_scorer(lambda: lambda texts: [0.7] * len(texts))
    posts = spark.createDataFrame([(str(i), "reddit", "joe", f"good gains for apple number {i}", 9.0, T0 + dt.timedelta(hours=i)) for i in range(5)], "id string, source string, author string, text string, upvotes double, timestamp_utc timestamp")
    got = pipeline.preprocess(posts, sarcasm=udf).collect()
    assert {(r.sarcasm_score, r.sarcasm_flag) for r in got} == {(0.7, "flip")}
    assert {r.sarcasm_score for r in pipeline.preprocess(posts).collect()} == {0.0}


def _series(name, hours, days=0):
    step = [dt.timedelta(hours=i) for i in range(hours)] + [dt.timedelta(days=i) for i in range(1, days)]
    return [(name, T0 + d, float(i)) for i, d in enumerate(step)]


def test_alignment_ladder(spark):
    kind = "ticker string, ts timestamp, {} double"
    price = spark.createDataFrame(_series("HOUR", 24) + _series("DAY", 1, 12) + _series("OLD", 3) + _series("NONE", 3) + _series("ALONE", 30), kind.format("price"))
    mood = spark.createDataFrame([(t, T0 + dt.timedelta(hours=2), 0.5) for t in ("HOUR", "DAY", "OLD", "NONE")], kind.format("sentiment"))
    more = spark.createDataFrame([("OLD", T0 - dt.timedelta(days=31 - i), float(i)) for i in range(40)], kind.format("price"))
    got = causality.align(price, mood, backfill=more).collect()
    by = {t: sorted(r for r in got if r.ticker == t) for t in ("HOUR", "DAY", "OLD", "NONE", "ALONE")}
    assert {t: len(r) for t, r in by.items()} == {"HOUR": 24, "DAY": 12, "OLD": 32, "NONE": 0, "ALONE": 0}
    assert [r.grain for r in (by["HOUR"][0], by["DAY"][0], by["OLD"][0])] == ["hour", "day", "backfill"]
    assert [r.sentiment for r in by["HOUR"]] == [0.0] * 2 + [0.5] * 22 and [r.sentiment for r in by["OLD"]] == [0.0] * 30 + [0.5] * 2
    assert by["OLD"][0].ts == T0 - dt.timedelta(days=30) and by["OLD"][-1].ts == T0 + dt.timedelta(days=1)
    assert causality.align(price, mood).where("ticker = 'OLD'").count() == 0


def test_common_tickers_and_universe(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "ticker string") for xs in (["A", "A", "B", None], ["B", "C", None]))
    assert [r.ticker for r in ingest.common_tickers(a, b).collect()] == ["B"]
    assert {r.ticker for r in ingest.ticker_universe(a.limit(0), b).collect()} == {"B", "C"}
    assert {r.ticker for r in ingest.ticker_universe(a.limit(0), default=("X", "Y")).collect()} == {"X", "Y"}


def test_class_report(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 2 + [(0, 1)] * 2, "y int, p int")
    got = {r.label: r for r in model.class_report(df, "y", "p").collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].support) == (pytest.approx(0.6), 0.75, 4)
    assert got["macro avg"].f1 == pytest.approx((2 / 3 + 4 / 7) / 2) and got["weighted avg"].support == 8


def test_quartiles(spark):
    r = ingest.describe(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 10)], "k string, x double"), "x", "k").first()
    assert (r.q1, r.median, r.q3) == (1.75, 2.5, 4.75)


def test_threshold_counts_each_row_once(spark):
    df = spark.createDataFrame([(0.1 + i / 100, int(i > 37)) for i in range(80)] + [(None, 1)], "prob_up double, target int")
    best = model.best_threshold(df).first()
    assert best.accuracy == 1.0 and best.t == pytest.approx(0.48)


def test_walk_forward_training(spark):
    rows = [("A", T0 + dt.timedelta(hours=i), float(i % 2), i % 2) for i in range(70)]
    got = model.walk_forward_trees(spark.createDataFrame(rows, "ticker string, ts timestamp, x double, target int"), ["x"], rounds=2, depth=2)
    assert [(r["fold"], r["n"], r["accuracy"]) for r in got] == [(k, 10, 1.0) for k in range(1, 7)]


def test_walk_forward_cuts_all_rows_first(spark):
    # 70 rows; rows 5 to 14 have no target and row 27 no feature: folds are still 10 rows each, some of them shorter inside.
    rows = [("A", T0 + dt.timedelta(hours=i), None if i == 27 else float(i % 2), None if 5 <= i < 15 else i % 2) for i in range(70)]
    got = model.walk_forward_trees(spark.createDataFrame(rows, "ticker string, ts timestamp, x double, target int"), ["x"], rounds=2, depth=2)
    assert [(r["fold"], r["n"]) for r in got] == [(1, 5), (2, 9), (3, 10), (4, 10), (5, 10), (6, 10)]


def _item(kind="t3", **more):
    return {"kind": kind, "data": {"id": "p", "author": "joe", "title": "T", "selftext": "body", "score": 5, "ups": 9, "downs": 2, "created_utc": 0} | more}


def test_listing_keeps_posts_only(spark):
    items = [_item(), _item("t1", id="c"), _item(id="gone", removed_by_category="moderator"), _item(id="d", author="[deleted]"), _item(id="n", author=None), _item(id="z", score=None, title=None), _item(id="e", removed_by_category="", selftext="")]
    page = json.dumps({"data": {"children": items, "after": None}})
    got = readers.read_listing(spark.createDataFrame([(page,)], "value string")).collect()
    assert [(r.id, r.upvotes, r.downvotes, r.text) for r in got] == [("p", 5.0, None, "T body"), ("z", 0.0, None, "body"), ("e", 5.0, None, "T")]


def test_comments_come_from_each_posts_own_page(spark):
    c = lambda kind="t1", **more: {"kind": kind, "data": {"id": "c", "author": "ann", "body": " yes ", "score": 2, "created_utc": 60} | more}
    items = [c(), c(id="d", body="[deleted]"), c(id="r", body=" [removed]"), c("more", id="m"), c(id="x", body="  "), c(id="a", author=None, score=None, body="[Deleted] once"), c(id="late")]
    page = json.dumps([{"data": {"children": [_item()]}}, {"data": {"children": items}}])
    got = readers.read_comments(spark.createDataFrame([("s", page), ("s", "[]"), ("s", None)], "subreddit string, value string"), most=6).collect()
    assert [(r.id, r.author, r.text, r.upvotes, r.type) for r in got] == [("c", "ann", "yes", 2.0, "comment"), ("a", "[deleted]", "[Deleted] once", 0.0, "comment")]


def test_each_row_has_its_own_request(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p {i}.json").write_text(f"page {i}")
    rows = spark.createDataFrame([(f"p {i}", i) for i in range(5)], "id string, n int").repartition(2)
    got = paged.fetch_each(rows, f"file://{tmp_path}/{{id}}.json", tries=1)
    assert sorted(map(tuple, got.collect())) == [(f"p {i}", i, f"page {i}") for i in range(3)]


def test_log_lines(spark):
    lines = {
        "2024-01-01 12:00:00 | INFO    | PIPELINE   | Stage 1A": ("2024-01-01 12:00:00", "INFO", "PIPELINE", "Stage 1A", "1A"), "2024-01-01 12:00:00|INFO|run|Stage 1A": ("2024-01-01 12:00:00", "INFO", "run", "Stage 1A", "1A"),
        "  2024-01-01\t12:00:00 | info\t|r_1| granger  ": ("2024-01-01\t12:00:00", "info", "r_1", "granger", "2B"), "2024-01-01 12:00:00 | INFO | run | a | b": ("2024-01-01 12:00:00", "INFO", "run", "a | b", None),
        "12:00:00 | INFO | run | Stage 1A": (None,) * 5, "2024-01-01 12:00:00 | INFO | a b | Stage 1A": (None,) * 5, "2024-01-01 12:00:00 | INFO | run |": (None,) * 5, "Stage 1A": (None,) * 5, "": (None,) * 5,
    }
    f = lambda c: F.struct(*[v.alias(k) for k, v in tx.parse_log(c).items()])
    assert [tuple(r) for r in column(spark, f, list(lines))] == list(lines.values())


def test_requests_are_repeated():
    waits, asked = [], []

    def answers(*codes):
        left = list(codes)

        def get(url):
            asked.append(url)
            c = left.pop(0)
            if c == "down":
                raise OSError
            return c, "ok"

        return get

    assert paged.patient(answers(429, 500, 200), "u", sleep=waits.append) == "ok" and waits == [15.0, 4.0]
    assert paged.patient(answers(403), "u", sleep=waits.append) is None and paged.patient(answers("down", "down", 429), "u", sleep=waits.append) is None
    page = lambda n, after: json.dumps({"data": {"children": [{}] * n, "after": after}})
    bodies = {"0-": page(100, "x"), "1-x": page(60, "y"), "2-y": page(1, None)}
    seen = []

    def get(url):
        seen.append(url)
        return 200, bodies[f"{len(seen) - 1}-{url.split('|')[1]}"]

    got = list(paged.pages(get, "{listing}|{after}|{limit}", "r/x", 170))
    assert len(got) == 3 and seen == ["r/x||100", "r/x|x|70", "r/x|y|10"]


def test_symbol_candidates():
    assert paged.candidates("TCS.NS") == ["TCS.NS", "TCS.NSE", "TCS.BO", "TCS.BSE"] and paged.candidates("TCS.BO") == ["TCS.BO", "TCS.BSE", "TCS.NS", "TCS.NSE"]
    assert paged.candidates("AAPL") == ["AAPL"] and paged.candidates(" tata.ns ") == ["TATA.NS", "TATA.NSE", "TATA.BO", "TATA.BSE"]
    got = paged.first_quote(lambda u: (200, '{"timestamp": [1]}' if u == "A.BO" else '{"timestamp": []}'), "{symbol}", "A.NS")
    assert got == ("A.BO", '{"timestamp": [1]}')


def test_calendars(spark):
    raw = spark.createDataFrame([("A", '{"earnings": ["2024-05-01 16:00", "2024-05-01", "None"]}'), ("B", '{"earnings": "2024-06-01"}'), ("C", "{}"), ("D", None)], "ticker string, value string")
    assert sorted(map(tuple, readers.read_calendar(raw).collect())) == [("A", dt.date(2024, 5, 1)), ("B", dt.date(2024, 6, 1))]


def test_exact_rate_over_batches(spark, tmp_path):
    kind = "id long, author string, timestamp_utc timestamp"
    first = [(i, "a", T0 + dt.timedelta(minutes=20 * i)) for i in range(4)]
    late = [(10, "a", T0 + dt.timedelta(minutes=60)), (11, "a", T0 + dt.timedelta(minutes=30))]
    for n, rows in enumerate((first, late)):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        streams.run_available(streams.author_rate_exact(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.id: r.posts for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 10: 5, 11: 3}
