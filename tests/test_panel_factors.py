"""Calendar, fill and factors on hand tables: no lookahead, ramps, eligibility, gaps, as-of joins."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import factors as FA
from tidemark.operators import panel as P


def days(n, start="2020-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def frame(spark, series, start="2020-01-01"):
    n = max(len(v) for v in series.values())
    ds = days(n, start)
    rows = [(t, "G", ds[i], float(v)) for t, vs in series.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "ticker string, grp string, d date, close double")


def factors_at_end(spark, series, spec=FA.Spec()):
    p = frame(spark, series)
    d = FA.factors(P.fill(P.align(p, P.calendar(p))), spec)
    last = d.agg({"rn": "max"}).first()[0]
    return {r["ticker"]: r for r in d.filter(f"rn = {last}").collect()}


def test_ramp_up_and_down(spark):
    up = [10.0 + i for i in range(300)]
    got = factors_at_end(spark, {"R": up, "D": up[::-1]})
    r, d = got["R"], got["D"]
    assert (r["close"], r["n_days"], r["hi52"], r["trend"], r["eligible"]) == (309.0, 300, 1.0, True, True)
    assert r["ret_12_1"] == pytest.approx(up[-22] / up[-253] - 1) and r["sma200"] == pytest.approx(np.mean(up[-200:]))
    v = pd.Series(up).pct_change().iloc[-252:].std() * np.sqrt(252)
    assert r["vol_252"] == pytest.approx(v) and r["mom_raw"] == pytest.approx(r["ret_12_1"] / v)
    down = up[::-1]
    assert d["hi52"] == pytest.approx(down[-1] / down[-252]) and not d["trend"]


def test_short_history_and_eligibility(spark):
    flat = [20.0] * 400
    series = {"OK": flat, "IPO272": [None] * 128 + flat[:272], "IPO273": [None] * 127 + flat[:273], "STALE": flat[:-5] + [None] * 5, "GAP": flat[:-4] + [None] * 4, "SHORT": [None] * 250 + flat[:150]}
    got = factors_at_end(spark, series)
    assert {k for k, r in got.items() if r["eligible"]} == {"OK", "IPO273", "GAP"}
    assert got["STALE"]["close"] is None and got["GAP"]["close"] == 20.0
    s = got["SHORT"]
    assert s["ret_12m"] is None and s["sma200"] is None and s["vol_252"] is None and s["sma50"] == 20.0 and not s["trend"]


def test_future_rows_change_nothing(spark):
    rng = np.random.default_rng(7)
    walk = list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 340))))
    changed = walk[:320] + [10 * x for x in walk[320:330]] + [None] * 10
    a, b = (frame(spark, {"A": w, "B": walk}) for w in (walk, changed))
    get = lambda p: FA.factors(P.fill(P.align(p, P.calendar(p)))).filter("rn = 320 and ticker = 'A'").collect()
    assert get(a) == get(b)


def test_fip_on_a_small_window(spark):
    spec = FA.Spec(history=1, month=0, half=1, year=4, short=2, long=3)
    series = {"smooth": [1, 2, 3, 4, 5], "flat": [1, 1, 1, 1, 1], "down": [5, 4, 3, 2, 1]}
    p = frame(spark, series)
    d = FA.fip(P.fill(P.align(p, P.calendar(p))), spec).filter("rn = 5")
    assert {r["ticker"]: r["fip"] for r in d.collect()} == {"smooth": -1.0, "flat": 0.0, "down": -1.0}


def test_month_ends_and_completed_months(spark):
    cal = P.calendar(spark.createDataFrame([(d,) for d in days(55, "2024-01-01")], "d date"))
    ends = [r["d"] for r in P.month_ends(cal).orderBy("d").collect()]
    assert ends == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 15)]
    good_friday = P.calendar(spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 3, 28),)], "d date"))
    n = lambda ref: P.completed_month_ends(good_friday, "2024-03-28", ref).count()
    assert (n("2024-03-28"), n("2024-03-30"), n("2024-04-02")) == (1, 2, 2)


def test_fill_limit_and_coverage(spark):
    p = frame(spark, {"A": [1.0] + [None] * 5 + [2.0], "B": [3.0] * 7})
    d = P.fill(P.align(p, P.calendar(p)))
    px = [r["px"] for r in d.filter("ticker = 'A'").orderBy("rn").collect()]
    assert px == [1.0] * 5 + [None, 2.0]
    assert P.coverage(d.drop("px", "full")).first()["coverage"] == 1.0
    assert P.asof_day(p).first()["d"] == days(7)[-1]


def test_asof_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 4, 40.0), ("a", 4, 41.0), ("b", 9, 90.0)], "k string, u int, v double")
    back = {(r["k"], r["t"]): r["x"] for r in P.asof_join(left, right, "k", "t", "u", "v", "x").collect()}
    assert back == {("a", 1): None, ("a", 5): 41.0, ("b", 3): None}
    ahead = {(r["k"], r["t"]): r["x"] for r in P.forward_join(left, right, "k", "t", "u", "x").collect()}
    assert ahead == {("a", 1): 2, ("a", 5): None, ("b", 3): 9}
