"""Bitemporal selection, trailing years, performance, ledgers."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import metrics as M
from tidemark.operators import pit as PIT


def day(s):
    return dt.date.fromisoformat(s) if s else None


def known(spark, items, *asofs, concept="Revenues"):
    rows = [(1, concept if len(i) < 5 else i[4], day(i[0]), day(i[1]), float(i[2]), day(i[3]), "10-K", k) for k, i in enumerate(items)]
    f = spark.createDataFrame(rows, "entity int, concept string, start date, end date, val double, filed date, form string, k int")
    return PIT.known(f, spark.createDataFrame([(day(a),) for a in asofs], "asof date"), PIT.concept_rows(spark))


FY = ("2023-01-01", "2023-12-31", 1000, "2024-02-15")
YTD = [("2024-01-01", "2024-09-30", 900, "2024-11-05"), ("2023-01-01", "2023-09-30", 700, "2023-11-05")]


def test_filed_strictly_before(spark):
    k = known(spark, [FY], "2024-02-15", "2024-02-16")
    assert [r["asof"] for r in k.collect()] == [day("2024-02-16")]


def test_amendments_count_from_the_day_after(spark):
    k = known(spark, [("2023-01-01", "2023-12-31", 100, "2024-02-01"), ("2023-01-01", "2023-12-31", 90, "2024-05-01")], "2024-05-01", "2024-05-02")
    assert {str(r["asof"]): r["val"] for r in k.collect()} == {"2024-05-01": 100.0, "2024-05-02": 90.0}


def test_ttm(spark):
    t = {str(r["asof"]): (r["val"], str(r["end"])) for r in PIT.ttm(known(spark, [FY, *YTD], "2024-10-01", "2024-12-01")).collect()}
    assert t == {"2024-10-01": (1000.0, "2023-12-31"), "2024-12-01": (1200.0, "2024-09-30")}
    alone = PIT.ttm(known(spark, [FY, YTD[0]], "2024-12-01")).first()
    assert (alone["val"], str(alone["end"])) == (1000.0, "2023-12-31")


def test_concept_rank_beats_filing_day(spark):
    k = known(spark, [(*FY[:2], 1, "2024-03-01", "SalesRevenueNet"), (*FY[:2], 2, "2024-02-01", "Revenues")], "2024-04-01")
    assert k.first()["val"] == 2.0


def test_duration_classes_and_staleness(spark):
    d = spark.createDataFrame([(day("2024-01-01"), day(e)) for e in ("2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2024-05-01")] + [(None, day("2024-01-01"))], "s date, e date")
    assert [r[0] for r in d.select(PIT.duration_class(F.col("s"), F.col("e"))).collect()] == ["quarter", "half", "nine", "annual", None, None]
    k = known(spark, [(None, "2022-12-31", 5, "2023-02-01", "Assets")], "2024-05-14", "2024-05-16")
    assert [str(r["asof"]) for r in PIT.fresh(PIT.instant(k)).collect()] == ["2024-05-14"]


def test_fundamentals_of_filed_facts(spark):
    """Expected values of the behaviour to match: ratios, gross from cost, shares of the cover before the balance sheet's."""
    year = lambda v, c, y=2023: (f"{y}-01-01", f"{y}-12-31", v, f"{y + 1}-02-15", c)
    at = lambda v, c, day="2023-12-31": (None, day, v, "2024-02-15", c)
    full = [year(800, "Revenues", 2022), year(1000, "Revenues"), year(600, "GrossProfit"), at(2000, "Assets"), year(150, "NetIncomeLoss"), at(50, "EntityCommonStockSharesOutstanding", "2024-02-01"), at(42, "CommonStockSharesOutstanding")]
    g = PIT.fundamentals(known(spark, full, "2024-03-01")).first()
    assert (g["revenue_ttm"], g["revenue_ttm_prev"], g["gross_profit_ttm"], g["assets"], g["gp_assets"], g["net_income_ttm"], g["shares"], str(g["fund_end"])) == (1000, 800, 600, 2000, 0.3, 150, 50, "2023-12-31")
    assert g["revenue_growth"] == pytest.approx(0.25)
    g = PIT.fundamentals(known(spark, [year(1000, "Revenues"), year(700, "CostOfRevenue"), at(42, "CommonStockSharesOutstanding")], "2024-03-01")).first()
    assert (g["gross_profit_ttm"], g["shares"], g["assets"], g["gp_assets"], g["revenue_growth"], g["net_income_ttm"]) == (300, 42, None, None, None, None)
    assert PIT.fundamentals(known(spark, [year(500, "SalesRevenueNet", 2016), (None, "2016-12-31", 900, "2017-02-15", "Assets")], "2024-03-01")).count() == 0
    ff = PIT.fund_factors(PIT.fundamentals(known(spark, full, "2024-03-01")).withColumn("close", F.lit(10.0))).first()
    assert ff["earnings_yield"] == pytest.approx(0.3) and not ff["speculative"] and not ff["fund_missing"]


def test_a_preferred_concept_filed_later_hides_nothing_before(spark):
    items = [("2017-01-01", "2017-12-31", 100, "2018-02-15", "SalesRevenueNet"), ("2017-01-01", "2017-12-31", 101, "2019-02-15", "Revenues"), ("2018-01-01", "2018-12-31", 130, "2019-02-15", "Revenues"), ("2017-01-01", "2017-12-31", 99, "2020-02-15", "SalesRevenueNet")]
    t = {str(r["asof"]): r["val"] for r in PIT.ttm(known(spark, items, "2018-06-01", "2019-06-01")).collect()}
    assert t == {"2018-06-01": 100.0, "2019-06-01": 130.0}
    k = known(spark, items, "2020-06-01").filter("`end` = '2017-12-31'").collect()
    assert [(r["val"], str(r["filed"])) for r in k] == [(101.0, "2019-02-15")]


def test_known_by_entity_equals_known_by_calendar(spark):
    f = spark.createDataFrame([(e, "Revenues", day("2023-01-01"), day("2023-12-31"), float(e), day(x), "10-K", k) for e in (1, 2) for k, x in enumerate(("2024-02-01", "2024-05-01"))], "entity int, concept string, start date, end date, val double, filed date, form string, k int")
    days = spark.createDataFrame([(day(x),) for x in ("2024-02-01", "2024-03-01", "2024-06-01")], "asof date")
    own = days.crossJoin(spark.createDataFrame([(1,), (2,)], "entity int"))
    c = PIT.concept_rows(spark)
    one, two = (sorted(map(str, PIT.known(f, a, c).select("entity", "asof", "filed", "val").collect())) for a in (days, own))
    assert one == two and len(one) == 4


def test_revisions(spark):
    d = spark.createDataFrame([([(3.0, 1.0), (2.0, 0.0)], [(3, 1), (None, 2)])], "t array<struct<current:double,d90:double>>, r array<struct<up30:int,down30:int>>")
    r = d.select(*PIT.revisions(F.col("t"), F.col("r"))).first()
    assert tuple(r) == (0.5, 0.5)


def test_companyfacts_flatten(spark):
    raw = spark.read.json(spark.sparkContext.parallelize(['{"entity": 1, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 5, "filed": "2024-02-01", "form": "10-K"}, {"end": "2023-12-31", "val": null, "filed": "2024-02-01", "form": "10-K"}]}}}}}']), schema="entity int, facts map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,filed:string,form:string>>>>>>")
    assert [(r["concept"], r["val"]) for r in PIT.flatten_companyfacts(raw).collect()] == [("Revenues", 5.0)]


def ledger(spark, values, contribution=100.0):
    ends = [d.date() for d in pd.date_range("2020-01-31", periods=len(values), freq="ME")]
    return spark.createDataFrame([("s", d, contribution, float(v)) for d, v in zip(ends, values, strict=True)], "scenario string, exec date, contribution double, value double")


def test_constant_growth(spark):
    v, values = 0.0, []
    for _ in range(36):
        v = v * 1.01 + 100.0
        values.append(v)
    led = ledger(spark, values)
    r = M.twr(led, ["scenario"])
    assert all(x["r"] is None or abs(x["r"] - 0.01) < 1e-9 for x in r.collect())
    g = M.growth(r, ["scenario"]).first()
    assert g["cagr"] == pytest.approx(1.01**12 - 1) and M.drawdown(r, ["scenario"]).first()["max_dd"] == 0.0
    assert M.ledger_xirr(led, ["scenario"]).first()["xirr"] == pytest.approx(0.1268, abs=2e-3)


def test_xirr_leap_year_and_no_sign_change(spark):
    d = spark.createDataFrame([([(0.0, -100.0), (366 / 365, 110.0)],), ([(0.0, -100.0), (0.0, -5.0)],)], "f array<struct<t:double,f:double>>")
    a, b = [r[0] for r in d.select(M.xirr(F.col("f"))).collect()]
    assert a == pytest.approx(1.1 ** (365 / 366) - 1, abs=1e-9) and b is None


def test_newey_west_without_lags_is_the_plain_t(spark):
    x = [0.1, 0.3, -0.2, 0.05, 0.4]
    d = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "scenario string, o int, x double")
    s = pd.Series(x)
    assert M.newey_west(d, ["scenario"], "o", lags=0).first()["t"] == pytest.approx(s.mean() / (s.std(ddof=0) / len(x) ** 0.5))


def context(spark, months=12, names=45, flat=True):
    rows = []
    for m in range(months):
        d, e = dt.date(2020, 1, 28) + dt.timedelta(days=30 * m), dt.date(2020, 1, 29) + dt.timedelta(days=30 * m)
        for i in range(names):
            px = 50.0 if flat else 50.0 + ((i * 7 + m * 3) % 11)
            rows.append((f"N{i:02d}", f"g{i % 4}", d, e, i + 1, True, True, 1 - i / names, True, 40.0, False, False, False, px, px, 40.0, True, False, False, 40.0, True, False, False, i % 9 == 0))
    return spark.createDataFrame(rows, "ticker string, grp string, d date, exec date, ord int, eligible boolean, trend boolean, composite double, above200 boolean, sma200 double, below_prev boolean, speculative boolean, brake boolean, px double, mark double, v1_level double, v1_up boolean, v1_below boolean, v1_below_prev boolean, v2_level double, v2_up boolean, v2_below boolean, v2_below_prev boolean, v3_in boolean")


SCEN = "scenario string, pick string, sell string, gate string, buy string, seed int, sim int, n int"


def test_flat_prices_lose_only_costs(spark):
    sc = spark.createDataFrame([(p, p, "S2", "G1", "Nvar", 1, 0, 3) for p in L.PICKS], SCEN)
    out = L.simulate(sc, context(spark)).groupBy("scenario").agg(F.max_by("value", "d").alias("v")).collect()
    spent = {r["scenario"]: r["v"] for r in out}
    assert len(spent) == len(L.PICKS) and 30_000 * (1 - L.COST) <= spent.pop("rank") < 30_000  # capped names leave it cash
    assert all(v == pytest.approx(30_000 * (1 - L.COST)) for v in spent.values())


def test_draws_do_not_depend_on_tasks(spark):
    sc = spark.createDataFrame([(f"r{k}", "random_up", "S2", "G1", "B0R", 11, k, 4) for k in range(6)], SCEN)
    ctx = context(spark, flat=False)
    one, many = (sorted(map(tuple, L.simulate(sc, ctx, n).collect())) for n in (1, 4))
    assert one == many


def test_stop_sells_next_day(spark):
    ctx = context(spark, months=3).withColumn("mark", F.when((F.month("d") == 2) & (F.col("ticker") == "N00"), 20.0).otherwise(F.col("mark")))
    out = L.simulate(spark.createDataFrame([("a", "ew_trend", "S2", "G1", "B0R", 1, 0, 0)], SCEN), ctx).orderBy("d").collect()
    assert [r["n_sells"] for r in out] == [0, 1, 0]


def test_a_holding_without_a_context_row_is_still_stopped(spark):
    """N00 is bought in the first month, unknown in the second, and back at 30 % of its price: the stop doesn't need a score."""
    ctx = context(spark, months=3).filter("not (month(d) = 2 and ticker = 'N00')")
    ctx = ctx.withColumn("eligible", F.col("eligible") & ((F.month("d") == 1) | (F.col("ticker") != "N00"))).withColumn("composite", F.when((F.month("d") == 1) | (F.col("ticker") != "N00"), F.col("composite")))
    ctx = ctx.withColumn("mark", F.when((F.month("d") == 3) & (F.col("ticker") == "N00"), 15.0).otherwise(F.col("mark")))
    t = L.simulate(spark.createDataFrame([("a", "ew_trend", "S2", "G1", "B0R", 1, 0, 0)], SCEN), ctx, trades=True)
    assert [(r["ticker"], r["rule"], r["d"].month) for r in t.filter("side = 'sell'").collect()] == [("N00", "-35% stop", 3)]
    assert t.filter("side = 'buy' and ticker = 'N00'").count() == 1


def test_trades_add_up_to_the_ledger(spark):
    sc = spark.createDataFrame([(p, p, "S3", "G1", "Nvar", 1, 0, 3) for p in L.PICKS], SCEN)
    ctx = context(spark, flat=False).withColumn("below_prev", F.col("ticker") < "N09").withColumn("above200", F.col("ticker") >= "N05")
    led, t = L.simulate(sc, ctx), L.simulate(sc, ctx, trades=True)
    n = t.groupBy("scenario", "d").agg(F.sum(F.when(F.col("side") == "buy", 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("side") == "sell", 1).otherwise(0)).alias("s"), F.sum("dollars").alias("x"))
    j = led.join(n, ["scenario", "d"], "left").fillna(0)
    assert j.count() == len(L.PICKS) * 12 and j.filter("b <> n_buys or s <> n_sells or abs(x / value - turnover) > 1e-9").count() == 0 and j.agg(F.sum("s")).first()[0] > 0


def test_picks_of_a_month_equal_the_selection_operators(spark):
    """The fold's first purchases are those of the DataFrame operators on the same month."""
    from tidemark.operators import select as SE

    ctx = context(spark, months=1).withColumn("composite", F.round(F.abs(F.hash("ticker")) % 1000 / 1000.0, 3)).withColumn("trend", F.hash("ticker") % 3 != 0)
    ctx = ctx.withColumn("ord", F.expr("row_number() over (order by composite desc, ticker)"))
    sc = spark.createDataFrame([("rank", "rank", "S3", "G1", "Nvar", 1, 0, 3), ("three", "rank", "S3", "G0", "N3", 1, 0, 3), ("spin", "ew_trend10", "S2", "G1", "B0R", 1, 0, 3)], SCEN)
    got = {k: {r["ticker"] for r in L.simulate(sc, ctx, trades=True).filter(F.col("scenario") == k).collect()} for k in ("rank", "three", "spin")}
    none = spark.createDataFrame([], "ticker string, value double, grp string")
    held = spark.createDataFrame([], "ticker string, held double")
    names = lambda d: {r["ticker"] for r in d.collect()}
    assert got == {"rank": names(SE.ranked_buys(ctx, none)), "three": names(SE.ranked_buys(ctx, none, "N3", "G0")), "spin": names(SE.rotation_buys(ctx, held, 1.0))}


def test_replay_is_split_proof(spark):
    d = [("s", "2020-01", [], ["A", "B"], {"A": 10.0, "B": 20.0}, 100.0), ("s", "2020-02", ["A"], ["B"], {"A": 20.0, "B": 20.0}, 100.0)]
    half = [(*x[:4], {k: v / (2 if k == "B" else 1) for k, v in x[4].items()}, x[5]) for x in d]
    cols = "strategy string, month string, sells array<string>, buys array<string>, px map<string,double>, contrib double"
    val = lambda rows, px: L.replay(spark.createDataFrame(rows, cols), ["strategy"], 0.0).select(L.state_value(F.col("state"), F.create_map(F.lit("B"), F.lit(px)))).first()[0]
    assert val(d, 20.0) == pytest.approx(val(half, 10.0)) == pytest.approx(250.0)


def test_purchases_merge_by_average(spark):
    h = spark.createDataFrame([("A", 10.0, 5.0)], "ticker string, shares double, cost double")
    b = spark.createDataFrame([("A", 10.0, 15.0), ("B", 2.0, 3.0), ("C", 1.0, None)], "ticker string, shares double, price double")
    assert {r["ticker"]: (r["shares"], r["cost"]) for r in L.merge_purchase(h, b).collect()} == {"A": (20.0, 10.0), "B": (2.0, 3.0)}


def test_exact_quantiles_equal_sorted_ones(spark):
    import random

    from tidemark.operators import metrics as M

    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1.0, 1.0, 1.0, rng.gauss(0, 1), -1e300, float(rng.randint(0, 5))])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    qs = [0.0, 0.1, 0.5, 0.6, 0.999, 1.0]
    got = {(r["k"], r["q"]): r["v"] for r in M.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", qs).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        for q in qs if v else []:
            at = q * (len(v) - 1)
            a, b = v[int(at)], v[min(len(v) - 1, int(at) + (at > int(at)))]
            want[k, q] = a + (b - a) * (at - int(at))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 1e-9 * max(1, abs(want[x])) for x in want)
    whole = M.exact_quantiles(spark.createDataFrame(rows, "k string, v double").filter("v > 1"), [], "v", [0.5]).collect()
    assert len(whole) == 1 and M.exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", qs).count() == 0
