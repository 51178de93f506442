"""Granger tests from moments against the grouped form, cut anywhere."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import causality, moments

T0 = dt.datetime(2024, 1, 1)
KIND = "ticker string, ts timestamp, price double, sentiment double"


def _series(n, seed, lead):
    r = np.random.default_rng(seed)
    x = r.standard_normal(n)
    y = 1000 + np.cumsum(0.1 * r.standard_normal(n)) + lead * np.concatenate([[0], x[:-1]])
    return y, x


@pytest.mark.parametrize("segment", [1 << 16, 50, 7, 4])
def test_moments_give_what_the_whole_series_gives(spark, segment):
    data = {"A": _series(400, 1, 0.4), "B": _series(150, 2, 0.0), "C": _series(12, 3, 1.0)}
    rows = [(k, T0 + dt.timedelta(hours=i), float(a), float(b)) for k, (y, x) in data.items() for i, (a, b) in enumerate(zip(y, x))]
    rows += [("A", T0 + dt.timedelta(days=99), None, 1.0), ("A", T0 + dt.timedelta(days=98), 1.0, float("nan"))]
    got = {(r.ticker, r.lag): r for r in moments.granger(spark.createDataFrame(rows[::-1], KIND).repartition(5), segment=segment).collect()}
    assert len(got) == 12
    for (k, lag), r in got.items():
        f, p = causality.granger(*data[k], lag)
        assert r.n == len(data[k][0]) - lag and r.f_stat == pytest.approx(f, rel=1e-6, abs=1e-8) and r.p_value == pytest.approx(p, rel=1e-6, abs=1e-9)


def test_short_constant_and_no_series(spark):
    rows = [("short", T0 + dt.timedelta(hours=i), float(i * i % 5), float(i % 3)) for i in range(4)] + [("flat", T0 + dt.timedelta(hours=i), 5.0, float(i % 7)) for i in range(40)]
    got = {(r.ticker, r.lag): (r.n, r.f_stat, r.p_value) for r in moments.granger(spark.createDataFrame(rows, KIND)).collect()}
    assert got["short", 2] == (2, 0.0, 1.0) and ("short", 4) not in got and got["flat", 1] == (39, 0.0, 1.0)
    assert moments.granger(spark.createDataFrame([], KIND)).count() == 0
