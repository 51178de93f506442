"""The stages as one graph of lazy tables, the two scoring calls, and the command line.

``python -m tidemark.plans.pipeline --data DIR --out DIR [--stages 1A,1B,1C,2A,2B,2C,3A | --full | --quick]``
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import causality, classifier, clean, entity, features, fuse, market, model, score, weight
from ..schemas import coalesce_aliases, union_drifting

#: What each stage needs before it.
NEEDS = {"1A": (), "1B": ("1A",), "1C": ("1B",), "2A": (), "2B": ("1C", "2A"), "2C": ("1C", "2A"), "3": ("2C",), "3A": ("2C",)}
FULL, QUICK = tuple(NEEDS), ("1A", "1B", "1C")


def preprocess(posts: DataFrame, cfg: Config = Config(), sarcasm=score.irony, organisations=None, companies: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Bots, spam, sarcasm, tickers, credibility, in this order. ``sarcasm`` turns a text column into a score (``score.irony``, or
    ``score.probability_scorer`` around a model); ``organisations`` into an array of names that are looked up in ``companies``, or
    ``companies`` is a table of names, of any size, that are looked for in the texts."""
    p = coalesce_aliases(posts)
    p = p.withColumns({"author": F.coalesce("author", F.lit("[unknown]")), "timestamp_utc": F.col("timestamp_utc").try_cast("timestamp"), "upvotes": F.col("upvotes").try_cast("double")})
    if "id" not in p.columns:
        p = p.withColumn("id", F.md5(F.concat_ws("|", "source", "author", F.col("timestamp_utc").cast("string"), "text")))
    p = clean.flag_bots(p).where(~F.col("is_bot"))
    p = clean.filter_spam(p)
    live = clean.is_live(F.col("source")) if cfg.sarcasm_only_live else None
    p = p.withColumn("sarcasm_score", score.sarcasm(F.col("text"), F.col("source"), sarcasm, live))
    p = p.withColumn("sarcasm_flag", weight.sarcasm_flag(F.col("sarcasm_score")))
    p = entity.link(p, cfg.tickers, organisations=organisations, companies=companies)
    uncertain = F.col("sarcasm_flag") == "uncertain"
    ratio = F.col("upvote_ratio") if "upvote_ratio" in p.columns else F.lit(None).cast("double")
    cred = weight.credibility(weight.engagement(F.col("source"), F.col("upvotes"), ratio), weight.source_weight(F.col("source")), uncertain)
    # An unclear post is halved here a second time, after the bounds.
    return p.withColumn("user_credibility", F.when(uncertain, cred * 0.5).otherwise(cred))


def score_stage(posts: DataFrame, cfg: Config = Config(), scorer=score.lexicon) -> DataFrame:
    s = score.score_posts(posts, only_unlabelled=cfg.only_unlabelled, scorer=scorer)
    flag = F.col("sarcasm_flag")
    s = s.withColumns({"sentiment_numeric": weight.flip_numeric(F.col("sentiment_numeric"), flag), "sentiment_label": weight.flip_label(F.col("sentiment_label"), flag)})
    s = s.withColumn("user_credibility", weight.low_confidence(F.coalesce("user_credibility", F.lit(1.0)), F.col("sentiment_confidence")))
    w = weight.weighted(F.col("sentiment_numeric"), F.col("sentiment_confidence"), F.col("user_credibility"), F.col("is_uncertain"))
    return s.withColumn("weighted_sentiment_score", w)


def market_stage(bars: DataFrame, earnings: DataFrame | None = None, vix: DataFrame | None = None, indices: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    t = market.technicals(bars)
    for dim in (vix, indices):
        if dim is not None:
            t = market.join_time(t, dim)
    if earnings is not None:
        t = market.earnings_flags(t, earnings)
    return market.add_target(t, cfg.target_threshold, cfg.drop_neutral)


def run_stages(spark: SparkSession, stages, posts: DataFrame | None = None, bars: DataFrame | None = None, news: DataFrame | None = None, earnings=None, vix=None, cfg: Config = Config(), scorer=None, labelled: DataFrame | None = None, companies: DataFrame | None = None) -> dict[str, DataFrame]:
    """The asked stages and what they need, as lazy tables by stage. Without a ``scorer`` one is trained from ``labelled`` (text,
    label); without both the word list scores."""
    wanted: list[str] = []

    def need(s: str) -> None:
        for n in NEEDS[s]:
            need(n)
        if s not in wanted:
            wanted.append(s)

    for s in stages:
        need(s)
    out: dict[str, DataFrame] = {}
    for s in wanted:
        if s == "1A":
            out[s] = preprocess(posts if news is None else union_drifting(posts, news), cfg, companies=companies)
        elif s == "1B":
            if scorer is None:
                scorer = score.lexicon if labelled is None else classifier.scorer(spark, classifier.train(labelled))
            out[s] = score_stage(out["1A"], cfg, scorer)
        elif s == "1C":
            out[s] = features.sentiment_features(out["1B"], freq=cfg.freq, lags=cfg.lags)
        elif s == "2A":
            out[s] = market_stage(bars, earnings, vix, cfg=cfg)
        elif s == "2B":
            # A ticker without prices, or without sentiment, is in neither.
            series = causality.align(out["2A"].select("ticker", "ts", F.col("Close").alias("price")), out["1C"].select("ticker", F.col("window_start").alias("ts"), F.col("avg_sentiment").alias("sentiment")))
            out[s] = causality.run_granger(series, lags=cfg.granger_lags, jitter=cfg.granger_jitter)
        elif s == "2C":
            out[s] = fuse.interactions(fuse.fuse(out["2A"], out["1C"], cfg.fill, cfg.fill_limit))
        elif s == "3":
            out[s] = train_stage(out["2C"], cfg)
        else:
            rows = model.ablation(market.time_split(out["2C"], cfg.train, cfg.val).na.fill(0.0), cfg.boost_rounds, cfg.boost_depth, rate=cfg.boost_rate)
            out[s] = spark.createDataFrame(rows) if rows else out["2C"].limit(0)
    return out


def train_stage(fused: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Test rows that have a whole sequence, with the trees' probability, the recurrent model's, and the ensemble's answer."""
    d = market.time_split(fused.na.fill(0.0), cfg.train, cfg.val)
    cols = model.available(d, model.SENTIMENT)
    d = model.finite(d.where("target IS NOT NULL"), cols)
    fit = model.scaler(d.where("split = 'train'"), cols)
    d = model.scale(d, fit)
    trees = model.boosted_trees(d.where("split <> 'test'"), cols, cfg.boost_rounds, cfg.boost_depth, cfg.boost_rate, val=F.col("split") == "val")
    test = model.probability_up(trees, model.recurrent_probability(d, cols, "p2"), "p1")
    e = model.ensemble(F.col("p1"), F.col("p2"), cfg.up, cfg.down)
    return test.withColumns(e)


def score_text(spark: SparkSession, text: str, ticker: str, user_credibility: float = 1.0, cfg: Config = Config(), scorer=score.lexicon) -> dict:
    """The score of one text, as a dictionary."""
    if not text or not 0.1 <= user_credibility <= 1:
        raise ValueError("a text and a credibility from 0.1 to 1 are needed")
    df = spark.createDataFrame([(text, ticker, float(user_credibility), "normal")], "text string, ticker string, user_credibility double, sarcasm_flag string")
    keep = ("ticker", "sentiment_label", "sentiment_numeric", "sentiment_confidence", "is_uncertain", "user_credibility", "weighted_sentiment_score")
    return score_stage(df, cfg, scorer).select(*keep).first().asDict()


def score_company(posts: DataFrame, company: str, companies: DataFrame, cfg: Config = Config(), scorer=score.lexicon) -> dict:
    """All posts of one company together; LookupError if no ticker is found."""
    spark = posts.sparkSession
    row = entity.resolve_company(spark.createDataFrame([(company,)], "name string"), companies).first()
    if row is None or row["ticker"] is None:
        raise LookupError(company)
    scored = score_stage(preprocess(posts, cfg), cfg, scorer).where(F.col("ticker") == row["ticker"])
    got = features.company_aggregate(scored, "ticker").first()
    return {"ticker": row["ticker"], **(got.asDict() if got else {"mention_volume": 0})}


def main(argv: list[str] | None = None) -> None:
    from ..session import build_session
    from ..sources.sinks import write_run
    from .views import Views

    a = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    a.add_argument("--data", required=True, help="folder of the input tables")
    a.add_argument("--out", required=True)
    a.add_argument("--stages", default="")
    a.add_argument("--full", action="store_true")
    a.add_argument("--quick", action="store_true")
    o = a.parse_args(argv)
    stages = FULL if o.full else QUICK if o.quick else tuple(s for s in o.stages.split(",") if s)
    spark = build_session()
    v = Views(spark, o.data)
    run = uuid.uuid4().hex[:12]
    for name, df in run_stages(spark, stages, v.posts.drop("ticker", "sentiment_numeric", "sentiment_confidence", "user_credibility").withColumn("text", F.concat("text", F.lit(" apple"))), v.bars, earnings=v.earnings, labelled=v.labelled_texts, companies=v.companies).items():
        print(name, write_run(df, f"{o.out.rstrip('/')}/{name}", run))


if __name__ == "__main__":
    main()
