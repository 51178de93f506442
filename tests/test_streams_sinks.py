"""Polled listings, bursts and rates as streams with bounded state, the versioned registry, and hot authors."""

import datetime as dt
import json
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import clean
from tidemark.plans import catalogue, catalogue_io
from tidemark.sources import paged, readers, sinks
from tidemark.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def _pages(root, listing, ids, size=3):
    """Newest first, by pages."""
    (root / listing).mkdir(exist_ok=True)
    ids = sorted(ids, reverse=True)
    cuts = [ids[i : i + size] for i in range(0, len(ids), size)] or [[]]
    for n, part in enumerate(cuts):
        items = [{"kind": "t3", "data": {"id": f"{listing}{i:03d}", "author": "joe", "title": "t", "created_utc": 1000 + i // 2}} for i in part]
        (root / listing / f"{'' if n == 0 else n}.json").write_text(json.dumps({"data": {"children": items, "after": str(n + 1) if n + 1 < len(cuts) else None}}))


def test_a_polled_listing_gives_each_post_once_over_restarts(spark, tmp_path):
    paged.register(spark)
    out = str(tmp_path / "out")
    have = {"a": set(range(5)), "b": set()}
    for more in ({}, {"a": range(5, 12), "b": range(4)}, {}, {"b": range(4, 5), "a": range(12, 13)}):
        for k, v in more.items():
            have[k] |= set(v)
        for k, v in have.items():
            _pages(tmp_path, k, v)
        live = spark.readStream.format("paged_listing").options(of='["a", "b"]', url=f"file://{tmp_path}/{{listing}}/{{after}}.json", tries="1").load()
        streams.run_available(live, out, str(tmp_path / "state"))  # a new query each time, from the same state
        raw = spark.read.schema("listing string, page int, value string").parquet(out)
        got = sorted(r.id for r in readers.read_listing(raw).collect())
        assert got == sorted(f"{k}{i:03d}" for k, v in have.items() for i in v)


def test_a_batch_that_is_run_again_is_the_same(tmp_path):
    _pages(tmp_path, "a", range(10))
    r = paged._Polls({"of": '["a"]', "url": f"file://{tmp_path}/{{listing}}/{{after}}.json", "tries": "1"})
    start = r.initialOffset()
    end = r.latestOffset()
    first = [x for p in r.partitions(start, end) for x in r.read(p)]
    _pages(tmp_path, "a", range(30))  # more came in the meantime
    again = [x for p in r.partitions(start, end) for x in r.read(p)]
    ids = lambda rows: sorted(i["data"]["id"] for _, _, v in rows for i in json.loads(v)["data"]["children"])
    assert ids(first) == ids(again) == [f"a{i:03d}" for i in range(10)]
    later = r.latestOffset()
    assert ids([x for p in r.partitions(end, later) for x in r.read(p)]) == [f"a{i:03d}" for i in range(10, 30)] and not r.partitions(later, later)


def test_a_listing_that_does_not_answer_stays_where_it_is(tmp_path):
    r = paged._Polls({"of": '["a"]', "url": f"file://{tmp_path}/{{listing}}/{{after}}.json", "tries": "1"})
    with pytest.raises(OSError):
        r.latestOffset()
    _pages(tmp_path, "a", range(3))
    end = r.latestOffset()
    (tmp_path / "a" / ".json").unlink()
    assert r.latestOffset() == end


POSTS = "id long, source string, author string, text_hash string, timestamp_utc timestamp"


def _run(spark, tmp_path, make, rows, parts, schema=POSTS):
    """The stream over files that come one after the other, each its own batch; rows, and state rows of the last batch."""
    src = str(tmp_path / "in")
    cut = [rows[i::parts] for i in range(parts)]
    result = None
    for n, part in enumerate(cut):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        df = make(spark.readStream.schema(schema).parquet(src))
        q = streams.run_available(df, str(tmp_path / "out"), str(tmp_path / "cp"))
        result = (df.schema, q.lastProgress)
    state = sum(o["numRowsTotal"] for o in result[1]["stateOperators"])
    return spark.read.schema(result[0]).parquet(str(tmp_path / "out")).collect(), state


def test_stream_bursts_are_those_of_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows, at = [], T0
    for k in range(12):
        span = r.choice([600, 2700, 2701, 5000])
        n = r.choice([3, 4, 7])
        times = [0, span, *[r.randrange(span) for _ in range(n - 2)]]
        rows += [(len(rows) + i, "reddit", f"a{k % 5}", f"h{k}", at + dt.timedelta(seconds=t)) for i, t in enumerate(times)]
    last = [(999, "reddit", "z", "z", T0 + dt.timedelta(hours=9)), (1000, "reddit", "z", "z2", T0 + dt.timedelta(hours=40))]  # move the watermark
    r.shuffle(rows)
    batch = {}
    for i, s, a, h, t in rows:
        batch.setdefault((a, h), []).append(t)
    want = sorted((a, h, min(t), max(t), len(t)) for (a, h), t in batch.items() if len(t) >= 4 and max(t) - min(t) <= dt.timedelta(seconds=2700))
    # All within the lateness, in three shuffled batches.
    got, state = _run(spark, tmp_path, lambda s: streams.bursts(s, late="3 hours", keep=5000), rows + last[:1], 3)
    got2, state2 = _run(spark, tmp_path, lambda s: streams.bursts(s, late="3 hours", keep=5000), last[1:], 1)
    assert sorted((x.author, x.text_hash, x.start, x.end, x.copies) for x in got2) == want and want
    assert state2 <= 2  # what moved the watermark


def test_bursts_are_cut_where_copies_are_apart(spark, tmp_path):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(i, "reddit", "a", "h", t(s)) for i, s in enumerate([0, 10, 20, 30, 9000, 9010, 9020, 20000, 20001, 20002, 20003])] + [(99, "reddit", "z", "z", T0 + dt.timedelta(hours=20))]
    got, _ = _run(spark, tmp_path, streams.bursts, rows, 1)
    assert sorted((x.start, x.copies) for x in got if x.author == "a") == [(t(0), 4), (t(20000), 4)]


def test_state_of_rates_and_momentum_goes(spark, tmp_path):
    rows = [(i, "reddit", f"a{i}", "h", T0 + dt.timedelta(minutes=i)) for i in range(50)]
    (tmp_path / "r").mkdir()
    got, state = _run(spark, tmp_path / "r", streams.author_rate_exact, rows, 1)
    assert len(got) == 50 and state == 50
    got, state = _run(spark, tmp_path / "r", streams.author_rate_exact, [(99, "reddit", "z", "z", T0 + dt.timedelta(hours=20)), (98, "reddit", "a1", "z", T0)], 1)
    assert len(got) == 52 and state == 1
    late, state = _run(spark, tmp_path / "r", streams.author_rate_exact, [(97, "reddit", "a1", "z", T0)], 1)
    assert len(late) == 52 and state == 1  # far behind the watermark: dropped
    (tmp_path / "m").mkdir()
    windows = "ticker string, window_start timestamp, avg_sentiment double"
    got, state = _run(spark, tmp_path / "m", streams.momentum, [("A", T0, 1.0), ("B", T0 + dt.timedelta(days=1), 2.0)], 1, windows)
    got, state = _run(spark, tmp_path / "m", streams.momentum, [("B", T0 + dt.timedelta(days=7, hours=9), 5.0)], 1, windows)
    assert state == 1 and [(x.ticker, x.sentiment_momentum) for x in sorted(got, key=lambda x: (x.ticker, x.window_start))] == [("A", None), ("B", None), ("B", 3.0)]


KIND = "ticker string, origin string"


def _rows(spark, path):
    return sorted(map(tuple, sinks.read_json(spark, path, spark.createDataFrame([], KIND).schema).collect()))


def test_registry_versions(spark, tmp_path):
    at = str(tmp_path / "reg")
    put = lambda *rows: sinks.upsert_json(spark, spark.createDataFrame(rows, KIND), at)
    assert _rows(spark, at) == []
    put(("A", "1"), ("B", "1"))
    put(("B", "2"), ("C", "2"))
    assert sorted(map(tuple, put(("C", "3")).collect())) == _rows(spark, at) == [("A", "1"), ("B", "2"), ("C", "3")]
    assert sinks.registry_version(spark, at)[0] == 3 and len([p for p in (tmp_path / "reg").iterdir() if p.name.startswith("v")]) == 2


@pytest.mark.parametrize("step", ["claim", "data", "pointer", "clean"])
def test_a_killed_writer_leaves_a_readable_registry(spark, tmp_path, monkeypatch, step):
    at = str(tmp_path / "reg")
    sinks.upsert_json(spark, spark.createDataFrame([("A", "1")], KIND), at)

    class Killed(Exception):
        pass

    def die(*a, **k):
        raise Killed

    real, calls = sinks.registry_version, [0]
    if step == "claim":
        monkeypatch.setattr(sinks, "upsert_registry", die)
    elif step in ("data", "pointer"):

        def third(*a):
            calls[0] += 1
            if calls[0] == 3:  # after the data, before the pointer
                raise Killed
            return real(*a)

        monkeypatch.setattr(sinks, "registry_version", third)
    else:
        monkeypatch.setattr(sinks, "_clean", die)
    with pytest.raises(Killed):
        sinks.upsert_json(spark, spark.createDataFrame([("B", "2")], KIND), at)
    monkeypatch.undo()
    assert _rows(spark, at) == ([("A", "1"), ("B", "2")] if step == "clean" else [("A", "1")])
    sinks.upsert_json(spark, spark.createDataFrame([("C", "3")], KIND), at, lease=-1)
    assert ("C", "3") in _rows(spark, at) and ("A", "1") in _rows(spark, at)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    at = str(tmp_path / "reg")
    work = [threading.Thread(target=lambda i=i: sinks.upsert_json(spark, spark.createDataFrame([(f"T{i}", str(i))], KIND), at, wait=0.05)) for i in range(4)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert _rows(spark, at) == [(f"T{i}", str(i)) for i in range(4)]


def test_a_hot_authors_hours_are_counted_apart(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["hot"] * 5 + ["b", "c", None]), r.random() < 0.8, T0 + dt.timedelta(microseconds=r.choice([r.randrange(20 * 3_600_000_000), 3_600_000_000 * r.randrange(20)])), r.choice(["x", None])) for i in range(3000)]
    p = spark.createDataFrame(rows, "id long, author string, which boolean, ts timestamp, text string")
    got = {x.id: x.n for x in clean.hourly_counts(p, "which", "author", "ts", "text", "n").collect()}
    w = Window.partitionBy("author").orderBy(F.unix_micros("ts")).rangeBetween(-3_599_999_999, 0)
    want = {x.id: x.n for x in p.where("which").withColumn("n", F.count("text").over(w)).collect()}
    assert len(got) == 3000 and {i: n for i, n in got.items() if i in want} == want and all(got[i] is None for i in got.keys() - want.keys())


def test_pages_are_handed_on_before_they_are_many():
    got = list(paged.batches(iter([("a", n, "x" * 40) for n in range(10)]), paged._PAGES, 100))
    assert [b.num_rows for b in got] == [3, 3, 3, 1] and got[0].to_pydict()["page"] == [0, 1, 2]


def _against_sql(spark, folder, name, rows):
    path = str(folder / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(path)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel, df = con.sql(catalogue.ORACLES[name]), catalogue.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = sorted(map(tuple, df.select(*rel.columns).collect())), sorted(rel.fetchall())
    assert len(got) == len(want) and got == want


@pytest.mark.parametrize("name", ["paged_source", "polled_source"])
def test_listings_of_dense_posts_with_gaps_are_whole(spark, tmp_path, monkeypatch, name):
    """Several posts in a second, on both sides of the first poll, ids with gaps of pages, many listings."""
    monkeypatch.setattr(catalogue_io, "LISTED", 700, raising=False)
    monkeypatch.setattr(catalogue_io, "PAGED", 50, raising=False)
    at = dt.datetime(2024, 1, 1)
    rows = [(i + (9000 if i > 500 else 0), at + dt.timedelta(milliseconds=217 * i), i % 50, "click", float(i), json.dumps({"k": i % 100})) for i in range(3000)]
    _against_sql(spark, tmp_path, name, rows)


@pytest.mark.parametrize("name", ["align_ladder", "align_daily"])
def test_prices_of_one_moment_go_by_their_order(spark, tmp_path, name):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i // 4), i // 4 % 5, "click", float(i * 7 % 100), json.dumps({"k": i % 100})) for i in range(3000)]
    random.Random(1).shuffle(rows)
    _against_sql(spark, tmp_path, name, rows)


def test_no_folder_gets_the_pages_of_all_posts(spark, tmp_path, monkeypatch):
    named, write = [], catalogue_io.write_texts
    monkeypatch.setattr(catalogue_io, "write_texts", lambda rows, root: (named.extend(r[0] for r in rows.select("name").collect()), write(rows, root)))
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i % 50, "click", float(i), json.dumps({"k": i % 100})) for i in range(2500)]
    _against_sql(spark, tmp_path, "comments_source", rows)
    folders = [n.rsplit("/", 1)[0] for n in named]
    assert len(set(named)) == 2500 and max(map(folders.count, set(folders))) == 1000


#: Edges that a CSV writer may trim; empty beside null; NUL before what a CSV parser looks for.
EDGES = [" a", "a ", "\ta", "a\t", "\na", "a\n", "\ra", "a\r\n", "\x0b", " ", "\r\n", " \n\t"]
EMPTY = ["", None, '""', '"', '","', "null", "\\N", "\\", '\\"']
NUL = ["\0", '\0"a"', 'a\0"b', "a\0\nb", "a\0,", "\0\0"]


@pytest.mark.parametrize("texts", [EDGES, EMPTY, NUL], ids=["edges", "empty", "nul"])
def test_csv_scan_gives_every_text_back(spark, tmp_path, texts):
    rows = [(i, "en", "web", t) for i, t in enumerate(texts)] + [(100 + i, t, t, "x") for i, t in enumerate(texts)] + [(None, None, None, None), (None, "", "", "")]
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(at)
    got = [tuple(r) for r in catalogue.QUERIES["csv_scan"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/*.parquet')")
    assert sorted(got, key=repr) == sorted(con.sql(catalogue.ORACLES["csv_scan"]).fetchall(), key=repr)


def test_other_files_keep_quoted_empty_values_as_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,t\n1,""\n2,\n"",x\n')
    assert sorted(map(tuple, readers.read_csv(spark, f"file://{tmp_path}", "i long, t string", tolerant=True).collect()), key=repr) == [(1, None), (2, None), (None, "x")]
