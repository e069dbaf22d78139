"""Percentiles, labels, tie-breaks, caps, rotation, sells."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import score as SC
from tidemark.operators import select as SE

COLS = "ticker string, grp string, d int, close double, n_days long, mom_raw double, hi52 double, gp_assets double, rev_growth double, earnings_yield double, rev_chg double, rev_breadth double, eligible boolean, trend boolean, above200 boolean, sma200 double, ret_12_1 double, dd_52w double"


def table(spark, n, **over):
    rows = []
    for i in range(n):
        r = dict(ticker=f"T{i:02d}", grp=f"g{i % 5}", d=1, close=10.0, n_days=300, mom_raw=float(i), hi52=0.5 + i / 100, gp_assets=None, rev_growth=None, earnings_yield=None, rev_chg=None, rev_breadth=None, eligible=True, trend=True, above200=True, sma200=9.0, ret_12_1=0.125, dd_52w=-0.004)
        r |= {k: v(i) for k, v in over.items()}
        rows.append(tuple(r.values()))
    return spark.createDataFrame(rows, COLS)


def test_percentile_equals_pandas(spark):
    rng = random.Random(3)
    v = [rng.choice([None, 1.0, 2.0, 2.0, 3.0, 4.0, 4.0]) for _ in range(60)]
    got = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "d int, i int, x double").withColumn("p", SC.pct(F.col("x"), ["d"])).orderBy("i").collect()
    want = pd.Series(v, dtype=float).rank(pct=True)
    assert all((a["p"] is None and pd.isna(b)) or abs(a["p"] - b) < 1e-12 for a, b in zip(got, want, strict=True))


def test_labels_and_order(spark):
    s = SC.score(table(spark, 20, trend=lambda i: i != 19)).collect()
    label = {r["ticker"]: r["label"] for r in s}
    assert (label["T19"], label["T18"], label["T14"], label["T00"]) == ("WATCH", "BUY", "HOLD", "AVOID")
    tied = SC.score(table(spark, 3, mom_raw=lambda i: 1.0, hi52=lambda i: 1.0, earnings_yield=lambda i: [None, 0.1, 0.1][i])).orderBy("ord").collect()
    assert [r["ticker"] for r in tied] == ["T01", "T02", "T00"]


def test_missing_quality_reweights_and_ineligible_have_none(spark):
    s = {r["ticker"]: r for r in SC.score(table(spark, 4, gp_assets=lambda i: None if i == 3 else float(i), eligible=lambda i: i > 0), "W2").collect()}
    assert s["T03"]["qual"] is None and s["T03"]["raw_score"] == s["T03"]["mom"]
    assert s["T00"]["composite"] is None and s["T00"]["label"] == "Insufficient data"


def test_reason_text(spark):
    r = SC.reason(SC.score(table(spark, 4, gp_assets=lambda i: 0.5, rev_growth=lambda i: 0.155))).filter("ticker = 'T03'").first()["reason"]
    assert r == "Momentum 100th pct (12-1m +12%, 0% from high) · Quality 62nd pct (GP/A 0.50, rev +16%) · in uptrend"


def test_group_cap_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(40):
        names = [(f"N{i}", rng.choice(["a", "b", "c", "", None])) for i in range(rng.randint(0, 25))]
        rng.shuffle(names)
        limit = 6
        kept, used = [], {}
        for t, g in names:
            key = g or ("own", t)
            if used.get(key, 0) < 3 and len(kept) < limit:
                used[key] = used.get(key, 0) + 1
                kept.append(t)
        want[d] = kept
        rows += [(d, t, g, k) for k, (t, g) in enumerate(names)]
    got = SE.take_by_group(spark.createDataFrame(rows, "d int, ticker string, grp string, o int"), [F.col("o").asc()], 6).orderBy("d", "pick").collect()
    found = {d: [r["ticker"] for r in got if r["d"] == d] for d in want}
    assert found == want


def test_rotation_takes_the_least_held(spark):
    s = SC.score(table(spark, 14, trend=lambda i: i < 12))
    held = spark.createDataFrame([("T00", 500.0), ("T01", 100.0)], "ticker string, held double")
    b = SE.rotation_buys(s, held, 2500.0).collect()
    assert {r["ticker"] for r in b} == {f"T{i:02d}" for i in range(2, 12)} and all(r["dollars"] == 250.0 for r in b)


def test_caps(spark):
    s = SC.score(table(spark, 6, earnings_yield=lambda i: 0.0)).withColumn("speculative", F.col("ticker") == "T05")
    pos = lambda *r: spark.createDataFrame(r, "ticker string, value double, grp string")
    assert SE.capped(s, pos(("T00", 24_000.0, "g0"))).count() == 0
    got = {r["ticker"] for r in SE.capped(s, pos(("T00", 20_000.0, "g0"), ("T01", 9_000.0, "g1"), ("T02", 2_000.0, "g2"), ("T05", 1_000.0, "g0"))).collect()}
    assert got == {"T00", "T05", "T01"}


def test_sell_rules_in_their_order(spark):
    scored = spark.createDataFrame([("A", 10.0, False, True, 0.9, 6.0), ("B", 10.0, False, True, 0.9, 9.0), ("C", 10.0, True, False, 0.5, 11.0), ("D", None, False, True, 0.9, 9.0)], "ticker string, sma200 double, above200 boolean, below_prev boolean, composite double, close double")
    h = spark.createDataFrame([("A", 10.0, 6.0), ("B", 10.0, 9.0), ("C", 10.0, 11.0), ("D", 10.0, 9.0), ("X", 10.0, 6.5), ("Y", 10.0, 7.0)], "ticker string, cost double, price double")
    rules = lambda r: {x["ticker"]: x["rule"].split()[0] for x in SE.sells(h, scored, r).collect()}
    assert rules("S1") == {} and rules("S2") == {"A": "-35%", "B": "2", "X": "-35%"} and rules("S3")["C"] == "rank"


def test_step_accounting(spark):
    d = spark.sql("select map('A', 10D, 'B', 5D) s, map('A', 300D, 'B', 200D) b, map('A', 50D, 'B', 60D, 'C', 20D, 'D', 0D) px")
    st = F.struct(F.col("s").alias("shares"), F.col("b").alias("basis"), F.lit(100.0).alias("cash")).cast(L.STATE)
    r = d.select(L.step(st, F.array(F.lit("A")), F.array(F.lit("B"), F.lit("C"), F.lit("D")), F.col("px"), F.lit(1000.0), 0.0).alias("r")).first()["r"]
    assert r["shares"] == {"B": 5 + 800 / 60, "C": 40.0} and r["basis"] == {"B": 1000.0, "C": 800.0} and r["cash"] == 0.0


def test_selection_ties_fall_in_the_listed_order(spark):
    """Equal returns to ten places: sells first, then gates, then weights W3, W1, W2; a deeper drawdown is out, whatever it returns."""
    from tidemark.operators import select as SE

    row = lambda w, g, s, x=0.2, dd=-0.1: (f"{w}-{g}-{s}-Nvar", w, g, s, x, dd)
    rows = [row("W2", "G0", "S1"), row("W3", "G1", "S1"), row("W1", "G0", "S2"), row("W3", "G0", "S1", 0.2 - 1e-13), row("W1", "G0", "S1"), row("W1", "G1", "S1", 0.5, -0.3), row("W1", "G0", "S1", None)]
    d = spark.createDataFrame(rows, "name string, weights string, gate string, sell string, xirr double, max_dd double")
    pick = lambda d, floor=-0.25: [r["name"] for r in SE.select_config(d, F.lit(floor)).collect()]
    assert pick(d) == ["W3-G0-S1-Nvar"] and pick(d.filter("weights <> 'W3'")) == ["W1-G0-S1-Nvar"] and pick(d, -0.4) == ["W1-G1-S1-Nvar"] and pick(d, 0.0) == []
