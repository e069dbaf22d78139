"""The live side of the rules: scoring with further names, sells on completed months, fallbacks, track records and forward ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag, ratio
from tidemark.operators import ledger as L
from tidemark.operators import metrics as M
from tidemark.operators import score as SC
from tidemark.operators import select as SE
from tidemark.operators.panel import asof_join, forward_join
from tidemark.sources.scratch import kept


def score_alongside(universe: DataFrame, extra: DataFrame, weights: str = "W2", use_revisions: bool = False, by: tuple[str, ...] = ("d",)) -> DataFrame:
    """Scores of the universe and of further tickers in one cross-section: these change everybody's percentiles.

    A ticker that the universe has already counts once. Adds in_universe.
    """
    more = extra.join(universe.select(*by, "ticker"), [*by, "ticker"], "left_anti").withColumn("in_universe", F.lit(False))
    return SC.score(universe.withColumn("in_universe", F.lit(True)).unionByName(more, allowMissingColumns=True), weights, use_revisions, by)


def live_sells(month_fac: DataFrame, completed: DataFrame, holdings: DataFrame, rule: str = "S2") -> DataFrame:
    """Holdings (ticker, cost, price: the current one) to sell, by the rules of the last two completed month-ends.

    month_fac: factors and composite of every loaded ticker at month-ends, names outside the universe included; completed:
    (d). With fewer than two month-ends the trend rule can't fire; the stop looks at the current price alone.
    """
    top = completed.agg(F.array_sort(F.collect_set("d")).alias("me"))  # as many as months
    me = top.select(F.try_element_at("me", F.lit(-1)).alias("d"), F.try_element_at("me", F.lit(-2)).alias("before"))
    now = month_fac.join(F.broadcast(me), "d")
    prev = month_fac.join(F.broadcast(me.select(F.col("before").alias("d"))), "d").select("ticker", (F.col("sma200").isNotNull() & ~flag(F.col("above200"))).alias("below_prev"))
    now = now.join(prev, "ticker", "left").withColumn("below_prev", flag(F.col("below_prev"))).withColumn("sma200", F.when(F.col("before").isNotNull(), F.col("sma200")))
    return SE.sells(holdings.select("ticker", "cost", "price"), now, rule)


def vendor_fallback(d: DataFrame, live: bool) -> DataFrame:
    """Fundamentals with a vendor's figures where the filed ones lack revenue, only outside point-in-time runs.

    d: fund_factors columns with revenue_ttm, and trailing_eps, vendor_growth, vendor_price, close, has_vendor. Adds fund_pit.
    """
    use = F.lit(live) & F.col("revenue_ttm").isNull() & flag(F.col("has_vendor"))
    px = F.coalesce(F.nullif(F.col("vendor_price"), F.lit(0.0)), F.col("close"))
    eps = F.col("trailing_eps")
    pick = lambda a, b: F.when(use, a).otherwise(F.col(b)).alias(b)
    changed = {"rev_growth": F.col("vendor_growth"), "gp_assets": F.lit(None).cast("double"), "earnings_yield": F.when(px != 0, ratio(eps, px)), "speculative": flag(eps < 0), "fund_missing": F.lit(False)}
    return d.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in d.columns], (~use).alias("fund_pit"))


def track_record(picks: DataFrame, closes: DataFrame, bench: str, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, averages) of picks (month, ticker, price, d): return since the pick, the benchmark's and the equal-weight mean's.

    closes: (ticker, d, px) carried forward without limit. The base is the last close day at or before d, or without d
    the first one in the month; returns end on the last day. Repeated picks count once. Averages skip nulls.
    """
    last = closes.groupBy("ticker").agg(F.max_by("px", "d").alias("last"), F.max("d").alias("d"))
    last = last.join(F.broadcast(last.agg(F.max("d").alias("d"))), "d").select("ticker", "last")
    # One pass over the closes gives each day's means; picks meet these days, a calendar, by as-of joins.
    moved = closes.join(last, "ticker").join(universe.select("ticker").distinct().withColumn("own", F.lit(True)), "ticker", "left").withColumn("r", ratio(F.col("last"), F.col("px")) - 1)
    days = moved.groupBy("d").agg(F.avg(F.when(F.col("own"), F.col("r"))).alias("ew"), F.max(F.when(F.col("ticker") == bench, F.col("r"))).alias("bench"))
    days = days.join(closes.select("d").distinct(), "d", "right").select(F.lit("k").alias("k"), F.col("d").alias("t"), F.struct(F.col("d").alias("base"), "ew", "bench").alias("day"))
    days = kept(days, "days")  # a row a day, read five times below
    at = picks.select("month", "ticker", "price", F.col("d").alias("d0"), F.coalesce("d", F.to_date(F.concat("month", F.lit("-01")))).alias("asked"), F.col("d").isNotNull().alias("back")).distinct()
    asked = at.select("asked", "back").distinct().withColumn("k", F.lit("k"))
    before = asof_join(asked.filter("back"), days, "k", "asked", "t", "day", "day").select("asked", "back", "day")
    behind = forward_join(asked.filter("not back"), days, "k", "asked", "t", "t").join(days.select("t", "day"), "t", "left").select("asked", "back", "day")
    at = at.join(before.unionByName(behind), ["asked", "back"], "left").select("month", "ticker", "price", "d0", "day.ew", "day.bench")
    rows = at.join(last, "ticker", "left")
    rows = rows.select("month", "ticker", "price", "last", (ratio(F.col("last"), F.nullif(F.col("price"), F.lit(0.0))) - 1).alias("ret"), "bench", "ew")
    return rows, rows.agg(F.avg("ret").alias("ret"), F.avg("bench").alias("bench"), F.avg("ew").alias("ew"))


def shadow_rows(decisions: DataFrame, last: DataFrame, cost: float = L.COST) -> DataFrame:
    """(strategy, months, invested, value, xirr) of forward ledgers, replayed at current prices.

    decisions: (strategy, month, fill_date, sells, buys, px, contrib); last: (d, px map) of the latest closes, one row.
    """
    state = L.replay(decisions, ["strategy"], cost)
    paid = decisions.groupBy("strategy").agg(F.count(F.lit(1)).alias("months"), F.sum("contrib").alias("invested"), F.min("fill_date").alias("d0"), F.collect_list(F.struct("fill_date", "contrib")).alias("paid"))
    d = paid.join(state, "strategy").crossJoin(F.broadcast(last.select(F.col("d").alias("last_d"), F.col("px").alias("last_px"))))
    d = d.withColumn("value", L.state_value(F.col("state"), F.col("last_px")))
    years = lambda day: F.datediff(day, "d0") / 365.0
    flows = F.concat(F.transform("paid", lambda x: F.struct(years(x["fill_date"]).alias("t"), (-x["contrib"]).alias("f"))), F.array(F.struct(years(F.col("last_d")).alias("t"), F.col("value").alias("f"))))
    return d.withColumn("flows", flows).select("strategy", "months", "invested", "value", M.xirr(F.col("flows")).alias("xirr"))


def metrics_bundle(ledgers: DataFrame, bench: DataFrame, by: list[str]) -> DataFrame:
    """One row a ledger: xirr, growth, drawdown, its excess over the benchmark's returns with Newey-West t, and dates_match.

    bench: (exec, contribution, value) of one ledger. Without the same days dates_match is false and the excess is null.
    """
    r, b = M.twr(ledgers, by), M.twr(bench.withColumn("__b", F.lit("b")), ["__b"]).select("exec", F.col("r").alias("rb"), F.lit(1).alias("in_b"))
    n_b = b.agg(F.count(F.lit(1)).alias("n_b"))
    j = r.join(b, "exec", "left")
    same = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"), F.count("in_b").alias("n_both")).crossJoin(F.broadcast(n_b))
    same = same.select(*by, ((F.col("n_all") == F.col("n_both")) & (F.col("n_both") == F.col("n_b"))).alias("dates_match"))
    x = j.filter("r is not null and rb is not null").withColumn("x", F.col("r") - F.col("rb"))
    over = x.groupBy(*by).agg((F.avg("x") * 12).alias("excess")).join(M.newey_west(x, by, "exec"), by, "left")
    out = M.ledger_xirr(ledgers, by).join(M.growth(r, by), by, "left").join(M.drawdown(r, by), by, "left").join(over, by, "left").join(same, by)
    return out.withColumns({c: F.when(F.col("dates_match"), F.col(c)) for c in ("excess", "t")})


def headline_differences(results: DataFrame, base: str, value: str = "xirr") -> DataFrame:
    """(scenario, diff): each scenario's value less that of the base scenario."""
    b = results.filter(F.col("scenario") == base).select(F.col(value).alias("__base"))
    return results.crossJoin(F.broadcast(b.limit(1))).select("scenario", (F.col(value) - F.col("__base")).alias("diff"))


def mean_percentile(signals: DataFrame, draws: DataFrame, value: str = "xirr") -> DataFrame:
    """(mean, ok): mean of the mid-rank percentiles of seeded signals among the draws; about 50 if a random signal has no skill.

    signals: (seed, value), draws: (value). Draws are ranked once: each signal's place comes from running counts, so no pairs arise.
    """
    both = draws.select(F.col(value).alias("v"), F.lit(None).cast("int").alias("seed")).unionByName(signals.select(F.col(value).alias("v"), F.col("seed").cast("int").alias("seed"))).filter("v is not null")
    at = both.groupBy("v").agg(F.count(F.when(F.col("seed").isNull(), 1)).alias("n"), F.count("seed").alias("s"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # distinct results of some thousand scenarios
    at = at.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    g = at.filter("s > 0").agg((F.sum(F.col("s") * 100 * (F.col("below") + F.col("n") / 2) / F.col("all")) / F.sum("s")).alias("mean"))
    return g.withColumn("ok", F.col("mean").between(35, 65))


def grounding_report(d: DataFrame, points: Column, texts: Column, facts: Column) -> DataFrame:
    """d with bad_keys and ungrounded_numbers."""
    from tidemark.operators.textops import grounding

    return d.withColumn("__g", grounding(points, texts, facts)).select(*d.columns, "__g.bad_keys", "__g.ungrounded_numbers")


# What a rule's label means, in words.
RULE_STATUS = {
    "UPTREND": "in uptrend — buyable under the equal-weight rule",
    "NO UPTREND": "no uptrend — not buyable; held positions sell after 2 month-ends below 200DMA",
}


def analysis_facts(columns: list[str]) -> Column:
    """map<string,string> of what is known of a ticker, formatted for reading; missing values are left out.

    Reads those of its fields that are among `columns`: name, price, returns, trend, percentiles, rule, fundamentals,
    estimates, eps_rev (struct up30, down30), fund_pit, sec_flags (array of struct date, items, labels) and news (array of
    struct date, publisher, title; ten at most).
    """
    from tidemark.functions import scalars as S
    from tidemark.operators import textops as T

    c = F.col
    place = lambda v: F.concat(S.percent_ordinal(v), F.lit(" percentile"))
    rule = F.when(c("rule") == "UPTREND", RULE_STATUS["UPTREND"]).when(c("rule") == "NO UPTREND", RULE_STATUS["NO UPTREND"]) if "rule" in columns else None
    fields = [
        ("company", "name", lambda v: v), ("ticker", "ticker", lambda v: v), ("price", "price", S.dollars), ("ret_1m", "ret_1m", S.signed_percent), ("ret_6m", "ret_6m", S.signed_percent), ("ret_12m", "ret_12m", S.signed_percent),
        ("ret_12_1", "ret_12_1", S.signed_percent), ("from_52w_high", "dd_52w", S.signed_percent), ("volatility_1y", "vol_252", S.percent), ("above_200dma", "above200", S.yes_no), ("trend_gate", "trend", lambda v: S.yes_no(v, "passes", "fails")),
        ("momentum_pct", "mom", place), ("quality_pct", "qual", place), ("revisions_pct", "rev", place), ("research_rank_pct", "composite", place), ("rule_status", "rule", lambda v: rule), ("model_reason", "reason", lambda v: v),
        ("gp_assets", "gp_assets", S.fixed), ("revenue_growth_ttm", "rev_growth", S.signed_percent), ("fy_eps_est_change_90d", "rev_chg", S.signed_percent), ("forward_pe", "forward_pe", S.multiple), ("earnings_yield", "earnings_yield", lambda v: S.percent(v, 1)),
        ("market_cap", "market_cap", S.money), ("sector", "sector", lambda v: v), ("industry", "industry", lambda v: v), ("category", "category", lambda v: v), ("speculative", "speculative", S.yes_no),
    ]
    said = {key: F.when(c(src).isNotNull(), show(c(src))) for key, src, show in fields if src in columns}
    if "eps_rev" in columns:
        up, down = c("eps_rev.up30"), c("eps_rev.down30")
        said["eps_revisions_30d"] = F.when(up.isNotNull() & down.isNotNull(), F.concat(up.cast("int").cast("string"), F.lit(" up / "), down.cast("int").cast("string"), F.lit(" down")))
    if "fund_pit" in columns:
        said["fundamentals_source"] = F.when(c("fund_pit"), "SEC point-in-time").when(~c("fund_pit"), "Yahoo, not point-in-time")
    if "sec_flags" in columns:
        said["sec_8k_last_45d"] = F.coalesce(S.event_warning(c("sec_flags")), F.lit("none"))
    titled = F.filter("news", lambda n: F.coalesce(n["title"], F.lit("")) != "") if "news" in columns else None
    for i in range(10) if titled is not None else ():
        n = F.get(titled, F.lit(i))
        said[f"news_{i + 1}"] = F.when(n.isNotNull(), F.concat_ws(" · ", F.coalesce(n["date"], F.lit("undated")), F.coalesce(n["publisher"], F.lit("unknown")), n["title"]))
    return T.facts_map(said)
