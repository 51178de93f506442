"""Social and market views over the driver's tables, the same in Spark and in SQL.

The tables hold no posts or prices, so posts come from events (a user's id gives the ticker), bars from the same events, daily bars
from orders, texts from documents. Every view is a deterministic expression; nothing is sampled or cut.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features, fuse, market, score, weight

TICKERS = ("AAPL", "TSLA", "NVDA", "GME", "AMZN")
SOURCES = {"click": "reddit", "view": "stocktwits", "purchase": "news", "signup": "kaggle"}
#: Company names that parts are taken for.
COMPANIES = (("Tesla", "TSLA"), ("GameStop", "GME"), ("Apple", "AAPL"), ("red widget", "REDW"), ("blue bolt", "BLUB"), ("small ring", "SMRG"))


#: Sources and endings that documents are given as posts.
SAID_BY = ("reddit", "stocktwits", "news")
SAYINGS = ("Buy $TSLA and $GME now", "TCS and AAPL rally", "I like pineapple and tesla", "nothing here", "RELIANCE_NS or $NVDA or NVDA", "state bank of india, infosys")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def posts(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        source = F.lit("huggingface")
        for event, name in SOURCES.items():
            source = F.when(F.col("event_type") == event, name).otherwise(source)
        names = F.array(*[F.lit(t) for t in TICKERS])
        e = self.events.withColumn("k", k)
        return e.select(
            F.col("event_id").alias("id"), F.col("ts").alias("timestamp_utc"), "user_id", F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("ticker"), "k",
            source.alias("source"), F.concat(F.lit("user"), (F.col("user_id") * 37).cast("string")).alias("author"), F.floor(F.col("value") / 10).cast("long").alias("upvotes"),
            (F.col("k") % 3 - 1).alias("sentiment_numeric"), (0.34 + (F.col("k") * 7) % 66 / 100.0).alias("sentiment_confidence"),
            F.greatest(F.least(F.col("value") / 300.0, F.lit(1.0)), F.lit(0.1)).alias("user_credibility"), ((F.col("k") * 11) % 100 / 100.0).alias("sarcasm_score"),
            F.concat(F.lit("Post number "), F.col("k").cast("string"), F.lit(" on the market")).alias("text"), "value",
        )

    @cached_property
    def scored(self) -> DataFrame:
        n, c, cred = F.col("sentiment_numeric"), F.col("sentiment_confidence"), F.col("user_credibility")
        label = F.when(n > 0, "positive").when(n < 0, "negative").otherwise("neutral")
        unsure = c < score.UNCERTAIN
        return self.posts.withColumns({"sentiment_label": label, "is_uncertain": unsure, "weighted_sentiment_score": weight.weighted(n, c, cred, unsure)})

    @cached_property
    def features(self) -> DataFrame:
        return features.sentiment_features(self.scored)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.posts.select("ticker", F.col("timestamp_utc").alias("ts"), F.col("id").alias("seq"), F.col("value").alias("price"), F.col("k").cast("long").alias("volume"))

    _PRICE = {"Open": "price", "High": "price", "Low": "price", "Close": "price", "Volume": "volume"}

    @cached_property
    def bars(self) -> DataFrame:
        return market.resample(self.ticks, price=self._PRICE, order=("seq",))

    @cached_property
    def bars_daily(self) -> DataFrame:
        o = self.table("orders")
        t = o.select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1).cast("long").alias("volume"))
        return market.resample(t, price=self._PRICE, order=("seq",), unit="day")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents inside the noise that posts carry."""
        t = F.concat(F.lit("$TSLA &amp; <b>"), F.coalesce("text", F.lit("")), F.lit("</b> http://x.y/z #tag @someone $GMEX *bold*"))
        return self.table("documents").select(F.col("doc_id").alias("id"), "source", t.alias("text"), F.col("text").alias("plain"))

    @cached_property
    def said(self) -> DataFrame:
        """Documents as posts of live and other sources, each followed by one of six sayings."""
        k = (F.col("doc_id") % 6).cast("int")
        source = F.element_at(F.array(*[F.lit(s) for s in SAID_BY]), (F.col("doc_id") % 3 + 1).cast("int"))
        saying = F.element_at(F.array(*[F.lit(s) for s in SAYINGS]), k + 1)
        text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), saying)
        return self.table("documents").select(F.col("doc_id").alias("id"), source.alias("source"), text.alias("text"), (F.col("doc_id") % 13).alias("upvotes"))

    @cached_property
    def labelled(self) -> DataFrame:
        return self.table("labels").join(self.table("documents"), "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("label"), "toxic")

    @cached_property
    def labelled_texts(self) -> DataFrame:
        """Labelled documents as texts with a sentiment: toxic ones negative, good ones positive, the others neutral."""
        label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
        return self.table("labels").join(self.table("documents"), "doc_id").select("text", label.alias("label"))

    @cached_property
    def vix(self) -> DataFrame:
        e = self.events.where("event_type = 'error'")
        index = F.when(F.col("user_id") % 2 == 0, "US_VIX").otherwise("INDIA VIX")
        hour = F.date_trunc("hour", "ts")
        v = e.groupBy(hour.alias("timestamp_utc"), index.alias("index")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("x"))
        return v.select("timestamp_utc", "index", (10 + F.col("x") % 30).alias("vix_close"))

    @cached_property
    def earnings(self) -> DataFrame:
        """A ticker's day every eleven days of the events' month, from the nations."""
        names = F.array(*[F.lit(t) for t in TICKERS])
        return self.table("nation").select(F.element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_nationkey") * 11 % 30).cast("int")).alias("earnings_date"))

    @cached_property
    def companies(self) -> DataFrame:
        return self.spark.createDataFrame(COMPANIES, "company string, ticker string")

    @cached_property
    def fused(self) -> DataFrame:
        return fuse.fuse(self.bars, self.features, "zero")


_S = "CASE event_type WHEN 'click' THEN 'reddit' WHEN 'view' THEN 'stocktwits' WHEN 'purchase' THEN 'news' WHEN 'signup' THEN 'kaggle' ELSE 'huggingface' END"
_T = "['AAPL', 'TSLA', 'NVDA', 'GME', 'AMZN']"
_OHLCV = "first(price ORDER BY ts, seq) AS \"Open\", max(price) AS \"High\", min(price) AS \"Low\", last(price ORDER BY ts, seq) AS \"Close\", sum(volume)::BIGINT AS \"Volume\""

#: The same views in SQL: name -> (views it needs, body).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "posts0": ((), f"SELECT event_id AS id, ts AS timestamp_utc, user_id, {_T}[(user_id % 5 + 1)::INT] AS ticker, regexp_extract(props, '[0-9]+')::INT AS k, {_S} AS source, 'user' || (user_id * 37)::VARCHAR AS author, floor(value / 10)::BIGINT AS upvotes, value FROM events"),
    "posts": (("posts0",), "SELECT *, k % 3 - 1 AS sentiment_numeric, 0.34::DOUBLE + ((k * 7) % 66)::DOUBLE / 100.0::DOUBLE AS sentiment_confidence, greatest(least(value / 300.0::DOUBLE, 1.0::DOUBLE), 0.1::DOUBLE) AS user_credibility, ((k * 11) % 100)::DOUBLE / 100.0::DOUBLE AS sarcasm_score, 'Post number ' || k || ' on the market' AS text FROM posts0"),
    "scored": (("posts",), "SELECT *, CASE WHEN sentiment_numeric > 0 THEN 'positive' WHEN sentiment_numeric < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_label, sentiment_confidence < 0.7::DOUBLE AS is_uncertain, sentiment_numeric * sentiment_confidence * user_credibility * CASE WHEN sentiment_confidence < 0.7::DOUBLE THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS weighted_sentiment_score FROM posts"),
    "ticks": (("posts",), "SELECT ticker, timestamp_utc AS ts, id AS seq, value AS price, k::BIGINT AS volume FROM posts"),
    "bars": (("ticks",), f"SELECT ticker, date_trunc('hour', t.ts) AS ts, {_OHLCV.replace('ts, seq', 't.ts, seq')} FROM ticks t GROUP BY 1, 2"),
    "ticks_daily": ((), "SELECT o_orderpriority AS ticker, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS price, 1 AS volume FROM orders"),
    "bars_daily": (("ticks_daily",), f"SELECT ticker, date_trunc('day', t.ts)::TIMESTAMP AS ts, {_OHLCV.replace('ts, seq', 't.ts, seq')} FROM ticks_daily t GROUP BY 1, 2"),
    "texts": ((), "SELECT doc_id AS id, source, '$TSLA &amp; <b>' || coalesce(text, '') || '</b> http://x.y/z #tag @someone $GMEX *bold*' AS text, text AS plain FROM documents"),
    "said": ((), f"SELECT doc_id AS id, {list(SAID_BY)}[(doc_id % 3 + 1)::INT] AS source, coalesce(text, '') || ' ' || {list(SAYINGS)}[(doc_id % 6 + 1)::INT] AS text, doc_id % 13 AS upvotes FROM documents"),
    "labelled": ((), "SELECT l.doc_id, d.source, d.lang, l.quality AS label, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id"),
    "vix": ((), "SELECT date_trunc('hour', ts) AS timestamp_utc, CASE WHEN user_id % 2 = 0 THEN 'US_VIX' ELSE 'INDIA VIX' END AS index, 10 + last(value ORDER BY ts, event_id) % 30 AS vix_close FROM events WHERE event_type = 'error' GROUP BY 1, 2"),
    "earnings": ((), f"SELECT {_T}[(n_nationkey % 5 + 1)::INT] AS ticker, (DATE '2024-01-01' + (n_nationkey * 11 % 30)::INT)::DATE AS earnings_date FROM nation"),
    "windows": (("scored",), """SELECT ticker, date_trunc('hour', timestamp_utc) AS window_start,
  CASE WHEN sum(user_credibility) > 0 THEN sum(weighted_sentiment_score * user_credibility) / sum(user_credibility) ELSE 0 END AS avg_sentiment,
  CASE WHEN count(*) = 1 THEN 0 ELSE stddev_pop(weighted_sentiment_score) END AS sentiment_std,
  count(*) FILTER (WHERE sentiment_label = 'positive') AS pos_count, count(*) FILTER (WHERE sentiment_label = 'negative') AS neg_count,
  count(*) FILTER (WHERE sentiment_label = 'neutral') AS neu_count,
  coalesce(count(*) FILTER (WHERE sentiment_label = 'positive')::DOUBLE / nullif(count(*) FILTER (WHERE sentiment_label IN ('positive', 'negative')), 0), 0.5) AS bull_bear_ratio,
  count(*) AS mention_volume, sum(user_credibility) AS weighted_volume, avg(CASE WHEN sentiment_confidence > 0.8 THEN 1.0 ELSE 0.0 END) AS high_confidence_ratio
FROM scored GROUP BY 1, 2"""),
    "momentum": (("windows",), "SELECT *, avg_sentiment - lag(avg_sentiment) OVER (PARTITION BY ticker ORDER BY window_start) AS sentiment_momentum FROM windows"),
    "features": (("momentum",), "SELECT * REPLACE (window_start + INTERVAL 1 HOUR AS window_start), window_start AS feature_source_window, sentiment_momentum - lag(sentiment_momentum) OVER (PARTITION BY ticker ORDER BY window_start) AS sentiment_acceleration FROM momentum"),
    "numbered": (("bars",), "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS rn, \"Close\" - lag(\"Close\") OVER (PARTITION BY ticker ORDER BY ts) AS d FROM bars"),
    "ewm": (("numbered",), """SELECT ticker, rn, "Close"::DOUBLE AS e12, "Close"::DOUBLE AS e26, NULL::DOUBLE AS g, NULL::DOUBLE AS l, 0.0::DOUBLE AS sig FROM numbered WHERE rn = 1
UNION ALL SELECT n.ticker, n.rn, p.e12 * (1 - 2.0::DOUBLE / 13) + n."Close" * (2.0::DOUBLE / 13), p.e26 * (1 - 2.0::DOUBLE / 27) + n."Close" * (2.0::DOUBLE / 27),
  CASE WHEN p.g IS NULL THEN greatest(n.d, 0) ELSE p.g * (1 - 1.0::DOUBLE / 14) + greatest(n.d, 0) * (1.0::DOUBLE / 14) END,
  CASE WHEN p.l IS NULL THEN greatest(-n.d, 0) ELSE p.l * (1 - 1.0::DOUBLE / 14) + greatest(-n.d, 0) * (1.0::DOUBLE / 14) END,
  p.sig * (1 - 2.0::DOUBLE / 10) + ((p.e12 * (1 - 2.0::DOUBLE / 13) + n."Close" * (2.0::DOUBLE / 13)) - (p.e26 * (1 - 2.0::DOUBLE / 27) + n."Close" * (2.0::DOUBLE / 27))) * (2.0::DOUBLE / 10)
FROM ewm p JOIN numbered n ON n.ticker = p.ticker AND n.rn = p.rn + 1"""),
    "oscillators": (("ewm", "numbered"), "SELECT n.*, e.e12 - e.e26 AS macd, e.sig AS macd_signal, e.e12 - e.e26 - e.sig AS macd_hist, CASE WHEN e.l = 0 THEN NULL ELSE 100 - 100 / (1 + e.g / e.l) END AS rsi_14 FROM numbered n JOIN ewm e ON n.ticker = e.ticker AND n.rn = e.rn"),
    "raw_technicals": (("oscillators",), """SELECT ticker, ts, "Open", "High", "Low", "Close", "Volume", rsi_14, macd, macd_signal, macd_hist,
  "Close" / nullif(lag("Close", 1) OVER w, 0) - 1 AS return_1h, "Close" / nullif(lag("Close", 3) OVER w, 0) - 1 AS return_3h, "Close" / nullif(lag("Close", 24) OVER w, 0) - 1 AS return_24h,
  CASE WHEN rn >= 20 THEN avg("Close") OVER w20 END AS mid, CASE WHEN rn >= 20 THEN stddev_samp("Close") OVER w20 END AS sd,
  greatest("High" - "Low", abs("High" - lag("Close") OVER w), abs("Low" - lag("Close") OVER w)) AS tr, rn,
  "Volume"::DOUBLE / nullif(lag("Volume") OVER w, 0) - 1 AS volume_change, CASE WHEN rn >= 24 THEN "Volume" / nullif(avg("Volume") OVER w24, 0) END AS volume_ma_ratio,
  coalesce(sign(d) * "Volume", 0)::DOUBLE AS step FROM oscillators
WINDOW w AS (PARTITION BY ticker ORDER BY ts), w20 AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING), w24 AS (PARTITION BY ticker ORDER BY ts ROWS 23 PRECEDING)"""),
    "daily_numbered": (("bars_daily",), """SELECT *, row_number() OVER w AS rn, greatest("High" - "Low", abs("High" - lag("Close") OVER w), abs("Low" - lag("Close") OVER w)) AS tr FROM bars_daily WINDOW w AS (PARTITION BY ticker ORDER BY ts)"""),
    "daily_atr": (("daily_numbered",), """SELECT ticker, rn, tr::DOUBLE AS atr_14 FROM daily_numbered WHERE rn = 1
UNION ALL SELECT n.ticker, n.rn, p.atr_14 * (1 - 1.0::DOUBLE / 14) + n.tr * (1.0::DOUBLE / 14) FROM daily_atr p JOIN daily_numbered n ON n.ticker = p.ticker AND n.rn = p.rn + 1"""),
    "technicals": (("raw_technicals",), """SELECT ticker, ts, "Open", "High", "Low", "Close", "Volume", rsi_14, macd, macd_signal, macd_hist, return_1h, return_3h, return_24h,
  mid + 2 * sd AS bb_upper, mid - 2 * sd AS bb_lower, (mid + 2 * sd - (mid - 2 * sd)) / nullif(mid, 0) AS bb_width, ("Close" - (mid - 2 * sd)) / (mid + 2 * sd - (mid - 2 * sd) + 1e-9::DOUBLE) AS bb_position,
  CASE WHEN rn >= 14 THEN avg(tr) OVER w14 END AS atr_14, volume_change, volume_ma_ratio, sum(step) OVER (PARTITION BY ticker ORDER BY ts) AS obv,
  CASE WHEN count(return_1h) OVER w24 = 24 THEN stddev_samp(return_1h) OVER w24 END AS volatility_24h FROM raw_technicals
WINDOW w14 AS (PARTITION BY ticker ORDER BY ts ROWS 13 PRECEDING), w24 AS (PARTITION BY ticker ORDER BY ts ROWS 23 PRECEDING)"""),
}


def sql(body: str, *views: str) -> str:
    """``body`` after the views that it needs, as one statement."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in SQL[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    head = ",\n".join(f"{n} AS ({SQL[n][1]})" for n in order)
    return f"WITH RECURSIVE {head}\n{body}" if order else body


__all__ = ["SQL", "Views", "sql", "tx"]
