"""The query catalogue: each query in DataFrame form and, beside it, the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import factors as FA
from tidemark.operators import filings as FI
from tidemark.operators import ledger as L
from tidemark.operators import metrics as M
from tidemark.operators import panel as P
from tidemark.operators import pit as PIT
from tidemark.operators import score as SC
from tidemark.operators import select as SE
from tidemark.operators import textops as T
from tidemark.plans import ledger_sql as LS
from tidemark.sources import stores as ST
from tidemark.sources import views as V
from tidemark.sources.scratch import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Columns that are days, and the queries that have them.
DAYS: dict[str, tuple[str, ...]] = {
    "d": ("chart_series", "corrected_frames", "month_ends", "completed_month_ends", "calendar_panel", "ffill_limited", "ffill_full", "daily_panel_gaps", "next_fill_date", "asof_half_coverage", "lag_returns", "volatility_252", "momentum_raw", "high_52w", "sma_complete", "trend_flags", "factor_frame", "monthly_sma10", "band_signals", "fip_id", "two_month_below", "regime_breadth", "composite_score", "composite_with_revisions", "reason_text", "grades_labels", "tie_break_order", "rule_labels_warnings", "group_capped_top10", "rotation_buys", "fip_pool", "sell_rules", "wide_to_long", "dca_closed_form", "ew_hold_closed_form", "stress_clones",),
    "exec": ("next_fill_date", "twr_monthly", "simulation_equals_closed_form",),
    "first": ("pruned_history", "key_spans",),
    "last": ("pruned_history", "key_spans",),
    "asof": ("fund_factors", "pit_known_versions", "pit_ttm_revenue", "pit_instant_latest", "pit_growth_and_margin", "member_revenue_floor", "asof_membership",),
    "start": ("pit_known_versions", "ticker_mapping",),
    "end": ("pit_known_versions", "pit_ttm_revenue", "pit_instant_latest", "ticker_mapping",),
    "filed": ("pit_known_versions", "latest_filing_then_filter", "latest_of_year",),
    "fund_end": ("pit_growth_and_margin",),
    "l_start": ("interval_listing_match",),
    "l_end": ("interval_listing_match",),
    "date": ("hard_event_flags", "latest_snapshot", "upsert_replace", "insert_if_absent",),
    "picked": ("track_record_vs_benchmark",),
    "fill_date": ("shadow_due",),
}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL. Days come out as ISO text on both sides."""

    def add(f):
        name = f.__name__

        def days_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = f(spark, sf_dir)
            return d.withColumns({c: F.col(f"`{c}`").cast("string") for c, t in d.dtypes if t == "date"})

        QUERIES[name] = days_as_text
        if sql:
            text = re.sub(r'(?<!")\basof\b(?!")', '"asof"', sql)
            text = re.sub(r"(?<!\(e), 6\)", " + 1e-9, 6)", text)
            casts = ", ".join(f'"{c}"::VARCHAR AS "{c}"' for c, names in DAYS.items() if name in names)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({text})" if casts else text
        return f

    return add


def r6(d: DataFrame, *skip: str) -> DataFrame:
    """Doubles to six places; the nudge settles exact halves alike in any order of summation."""
    return d.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c, t in d.dtypes if t == "double" and c not in skip})


# ---- shared views and their SQL ----

CAL = "cal AS (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM (SELECT DISTINCT d FROM panel))"
GRID = """tick AS (SELECT ticker, min(grp) AS grp FROM panel GROUP BY 1),
grid AS (SELECT t.ticker, t.grp, c.d, c.rn, p.close AS raw FROM cal c CROSS JOIN tick t LEFT JOIN panel p ON p.ticker = t.ticker AND p.d = c.d)"""
FILLED = """filled AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS px,
  last_value(raw IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "full" FROM grid)"""
ME = "me AS (SELECT max(d) AS d FROM cal GROUP BY date_trunc('month', d))"
FAC = """f0 AS (SELECT *, px / nullif(lag(px) OVER w, 0) - 1 AS ret, lag(px, 21) OVER w AS c_m, lag(px, 126) OVER w AS c_h, lag(px, 252) OVER w AS c_y FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY rn)),
f1 AS (SELECT *, px AS close, count(raw) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_days, stddev_samp(ret) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS sd,
  count(ret) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS n_ret, max(px) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi,
  CASE WHEN count(px) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 50 THEN avg(px) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS sma50,
  CASE WHEN count(px) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 THEN avg(px) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma200
  FROM f0 WINDOW w AS (PARTITION BY ticker ORDER BY rn)),
f2 AS (SELECT *, px / nullif(c_m, 0) - 1 AS ret_1m, px / nullif(c_h, 0) - 1 AS ret_6m, px / nullif(c_y, 0) - 1 AS ret_12m, c_m / nullif(c_y, 0) - 1 AS ret_12_1,
  CASE WHEN c_y IS NOT NULL AND n_ret > 1 THEN sd * sqrt(252.0) END AS vol_252, px / nullif(hi, 0) AS hi52, coalesce(px > sma200, false) AS above200 FROM f1),
fac AS (SELECT *, ret_12_1 / nullif(vol_252, 0) AS mom_raw, hi52 - 1 AS dd_52w, above200 AND coalesce(sma50 > sma200, false) AS trend, n_days >= 273 AND coalesce(px > 0, false) AS eligible FROM f2)"""
MFAC = "mfac AS (SELECT * FROM fac SEMI JOIN me USING (d))"


def pct_sql(v: str, by: str = "d") -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY {by}, {v} IS NULL) END"


def grade_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN '–' WHEN {v} >= 0.8 THEN 'A' WHEN {v} >= 0.6 THEN 'B' WHEN {v} >= 0.4 THEN 'C' WHEN {v} >= 0.2 THEN 'D' ELSE 'F' END"


SCORED = f"""s0 AS (SELECT m.*, t.* EXCLUDE (ticker), CASE WHEN eligible THEN mom_raw END AS e_m, CASE WHEN eligible THEN hi52 END AS e_h, CASE WHEN eligible THEN gp_assets END AS e_g, CASE WHEN eligible THEN rev_growth END AS e_r
  FROM mfac m LEFT JOIN traits t USING (ticker)),
s1 AS (SELECT *, {pct_sql("e_m")} AS p_m, {pct_sql("e_h")} AS p_h, {pct_sql("e_g")} AS p_g, {pct_sql("e_r")} AS p_r FROM s0),
s2 AS (SELECT *, 0.7 * p_m + 0.3 * p_h AS mom, coalesce((p_g + p_r) / 2, p_g, p_r) AS qual FROM s1),
s3 AS (SELECT *, round(CASE WHEN qual IS NOT NULL THEN 0.6 * mom + 0.4 * qual ELSE mom END, 12) AS raw_score FROM s2),
s4 AS (SELECT *, {pct_sql("raw_score")} AS composite FROM s3),
scored AS (SELECT *, CASE WHEN NOT eligible OR composite IS NULL THEN 'Insufficient data' WHEN composite >= 0.85 THEN CASE WHEN trend THEN 'BUY' ELSE 'WATCH' END WHEN composite >= 0.70 THEN 'HOLD' ELSE 'AVOID' END AS label,
  row_number() OVER (PARTITION BY d ORDER BY composite DESC NULLS LAST, earnings_yield DESC NULLS LAST, ticker) AS ord FROM s4)"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (V.PANEL, CAL, GRID)
FULL = (*BASE, FILLED, FAC, ME, MFAC)
RANKED = (*FULL, V.TRAITS, SCORED)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly panel, kept once it was computed: a row a ticker and week, whatever the size of the tables below."""
    return V.panel(spark, sf).persist()


def grid(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return P.align(p, P.calendar(p))


def filled(spark: SparkSession, sf: str) -> DataFrame:
    """The filled panel, kept as well: every factor and ledger starts here."""
    return P.fill(grid(spark, sf)).persist()


def fac(spark: SparkSession, sf: str) -> DataFrame:
    return FA.factors(filled(spark, sf))


def ends(spark: SparkSession, sf: str) -> DataFrame:
    return P.month_ends(P.calendar(panel(spark, sf)))


def mfac(spark: SparkSession, sf: str) -> DataFrame:
    return fac(spark, sf).join(ends(spark, sf), "d", "left_semi")


def from_first(months: DataFrame) -> DataFrame:
    """Months from the first one with an eligible name on: before it no ledger can buy."""
    return months.join(F.broadcast(months.filter("eligible").agg(F.min("d").alias("__first"))), F.col("d") >= F.col("__first")).drop("__first")


def scored(spark: SparkSession, sf: str, weights: str = "W2", use_revisions: bool = False) -> DataFrame:
    return SC.score(mfac(spark, sf).join(V.traits(spark, sf), "ticker", "left"), weights, use_revisions).persist()


# ---- calendar and panel ----


@query(chain(V.PANEL, CAL, ME) + "SELECT d FROM me")
def month_ends(spark, sf):
    return ends(spark, sf)


@query(chain(V.PANEL, CAL) + """, t AS (SELECT DATE '2000-06-26' AS t, DATE '2000-07-01' AS ref),
c AS (SELECT max(d) AS d FROM cal, t WHERE d <= t.t GROUP BY date_trunc('month', d))
SELECT d FROM c, t WHERE date_trunc('month', d) < date_trunc('month', t.t)
  OR date_trunc('month', t.t + CASE isodow(t.t) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) > date_trunc('month', t.t)
  OR date_trunc('month', ref + CASE isodow(ref) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) > date_trunc('month', t.t)""")
def completed_month_ends(spark, sf):
    return P.completed_month_ends(P.calendar(panel(spark, sf)), "2000-06-26", "2000-07-01")


@query(chain(*BASE) + "SELECT ticker, grp, d, rn, round(raw, 6) AS raw FROM grid")
def calendar_panel(spark, sf):
    return r6(grid(spark, sf))


@query(chain(*BASE, FILLED) + 'SELECT ticker, d, round(px, 6) AS px FROM filled')
def ffill_limited(spark, sf):
    return r6(filled(spark, sf).select("ticker", "d", "px"))


@query(chain(*BASE, FILLED) + 'SELECT ticker, d, round("full", 6) AS px FROM filled')
def ffill_full(spark, sf):
    return r6(filled(spark, sf).select("ticker", "d", F.col("full").alias("px")))


@query(chain(V.PANEL_DAILY, CAL, GRID, FILLED) + "SELECT ticker, d, round(px, 6) AS px, raw IS NULL AS carried FROM filled")
def daily_panel_gaps(spark, sf):
    p = V.panel(spark, sf, "p_type", "day")
    return r6(P.fill(P.align(p, P.calendar(p))).select("ticker", "d", "px", F.col("raw").isNull().alias("carried")))


@query(chain(*BASE, FILLED) + """, x AS (SELECT d, lead(d) OVER (ORDER BY d) AS exec FROM cal), m AS (SELECT max(d) AS d FROM cal GROUP BY date_trunc('month', d))
SELECT a.ticker, x.d, x.exec, round(a."full", 6) AS mark, round(b."full", 6) AS fill_px FROM x SEMI JOIN m USING (d) JOIN filled a ON a.d = x.d JOIN filled b ON b.d = x.exec AND b.ticker = a.ticker""")
def next_fill_date(spark, sf):
    f = filled(spark, sf)
    x = P.fill_dates(P.calendar(panel(spark, sf))).join(ends(spark, sf), "d", "left_semi")
    marks = f.select("ticker", "d", F.col("full").alias("mark")).join(x, "d")
    return r6(marks.join(f.select("ticker", F.col("d").alias("exec"), F.col("full").alias("fill_px")), ["ticker", "exec"]).select("ticker", "d", "exec", "mark", "fill_px"))


@query(chain(V.PANEL) + ", n AS (SELECT d, count(close) AS n FROM panel GROUP BY d) SELECT max(d) AS d FROM n WHERE n * 2 >= (SELECT max(n) FROM n)")
def asof_half_coverage(spark, sf):
    return P.asof_day(panel(spark, sf))


@query(chain(*BASE) + """, l AS (SELECT ticker, max(CASE WHEN raw IS NOT NULL AND rn > (SELECT max(rn) FROM cal) - 5 THEN 1 ELSE 0 END) AS fresh FROM grid GROUP BY 1)
SELECT sum(fresh)::BIGINT AS fresh, count(*) AS tickers, round(sum(fresh) / count(*), 6) AS coverage, sum(fresh) / count(*) >= 0.9 AS ok FROM l""")
def coverage_gate(spark, sf):
    return r6(P.coverage(grid(spark, sf)))


@query(chain(V.PANEL) + "SELECT ticker, count(*) AS n, min(d) AS first, max(d) AS last FROM panel WHERE d >= DATE '1999-01-04' - INTERVAL 70 DAY GROUP BY ticker")
def pruned_history(spark, sf):
    g = P.prune_history(grid(spark, sf), "1999-01-04", 10).filter("raw is not null")
    return g.groupBy("ticker").agg(F.count("raw").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


# ---- factors ----


def _factor(name: str, *cols: str) -> None:
    def f(spark, sf):
        return r6(fac(spark, sf).select("ticker", "d", *cols))

    f.__name__ = name
    doubles = [c if c in ("n_days", "above200", "trend", "eligible") else f"round({c}, 6) AS {c}" for c in cols]
    query(chain(*BASE, FILLED, FAC) + f"SELECT ticker, d, {', '.join(doubles)} FROM fac")(f)


_factor("lag_returns", "ret_1m", "ret_6m", "ret_12m", "ret_12_1", "ret")
_factor("volatility_252", "vol_252")
_factor("momentum_raw", "mom_raw")
_factor("high_52w", "hi52", "dd_52w")
_factor("sma_complete", "sma50", "sma200")
_factor("trend_flags", "above200", "trend", "eligible", "n_days")


@query(chain(*FULL) + """SELECT ticker, d, round(close, 6) AS close, n_days, round(ret_1m, 6) AS ret_1m, round(ret_12_1, 6) AS ret_12_1, round(vol_252, 6) AS vol_252, round(mom_raw, 6) AS mom_raw,
  round(hi52, 6) AS hi52, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200, above200, trend, eligible FROM mfac""")
def factor_frame(spark, sf):
    p = panel(spark, sf)
    frame = FA.chunked_factors(p, P.calendar(p)).join(ends(spark, sf), "d", "left_semi")
    return r6(frame.select("ticker", "d", "close", "n_days", "ret_1m", "ret_12_1", "vol_252", "mom_raw", "hi52", "sma50", "sma200", "above200", "trend", "eligible"))


@query(chain(*FULL) + """, m AS (SELECT ticker, d, close, CASE WHEN count(close) OVER w = 10 THEN avg(close) OVER w END AS level FROM mfac WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT ticker, d, round(level, 6) AS level, coalesce(close > level, false) AS up, level IS NOT NULL AND NOT coalesce(close > level, false) AS below FROM m""")
def monthly_sma10(spark, sf):
    return r6(FA.monthly_sma(mfac(spark, sf)).select("ticker", "d", "level", "up", "below"))


@query(chain(*FULL) + "SELECT ticker, d, coalesce(close > 1.02 * sma200 AND sma50 > sma200, false) AS up, coalesce(close < 0.98 * sma200, false) AS below FROM mfac")
def band_signals(spark, sf):
    return FA.band(mfac(spark, sf)).select("ticker", "d", "up", "below")


FIP = """fp AS (SELECT *, CASE WHEN c_m / nullif(c_y, 0) IS NOT NULL AND count(ret) OVER w > 0 THEN sign(c_m / c_y - 1) * (count(*) FILTER (ret < 0) OVER w - count(*) FILTER (ret > 0) OVER w) / count(ret) OVER w END AS fip
  FROM f0 WINDOW w AS (PARTITION BY ticker ORDER BY rn ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING))"""


@query(chain(*BASE, FILLED, FAC, ME, FIP) + "SELECT ticker, d, round(fip, 6) AS fip FROM fp SEMI JOIN me USING (d)")
def fip_id(spark, sf):
    return r6(FA.fip(filled(spark, sf)).join(ends(spark, sf), "d", "left_semi").select("ticker", "d", "fip"))


BELOW = "bp AS (SELECT *, coalesce(lag(sma200 IS NOT NULL AND NOT above200) OVER (PARTITION BY ticker ORDER BY d), false) AS below_prev FROM mfac)"


@query(chain(*FULL, BELOW) + "SELECT ticker, d, sma200 IS NOT NULL AND NOT above200 AS below, below_prev FROM bp WHERE d >= DATE '2000-01-01'")
def two_month_below(spark, sf):
    return FA.below_before(mfac(spark, sf)).filter("d >= '2000-01-01'").select("ticker", "d", "below", "below_prev")


REGIME = f"""{V.BENCH}, bs AS (SELECT d, close, CASE WHEN count(close) OVER w = 200 THEN avg(close) OVER w END AS sma FROM bench WINDOW w AS (ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
br AS (SELECT d, avg(CASE WHEN eligible THEN above200::INT END) AS breadth FROM mfac GROUP BY d),
reg AS (SELECT br.d, breadth, coalesce(close > sma, false) AS above, NOT coalesce(close > sma, false) OR breadth IS NULL OR breadth < 0.4 AS brake FROM br LEFT JOIN bs USING (d))"""


@query(chain(*FULL, REGIME) + "SELECT d, round(breadth, 6) AS breadth, above, brake FROM reg")
def regime_breadth(spark, sf):
    return r6(FA.regime(mfac(spark, sf), V.benchmark_series(panel(spark, sf))).select("d", "breadth", "above", "brake"))


@query(chain(*FULL) + """, l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rn DESC) AS k FROM fac), x AS (SELECT *, min(close) OVER p AS lo, max(close) OVER p AS hi2, count(*) OVER p AS n FROM l WHERE k <= 252 WINDOW p AS (PARTITION BY ticker))
SELECT ticker, rn, round(600.0 * (n - k) / nullif(n - 1, 0), 4) AS x, round(120 - 120 * (close - lo) / nullif(hi2 - lo, 0), 4) + 0.0 AS y FROM x""")
def sparkline_points(spark, sf):
    d = fac(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("rn").desc()))).filter("k <= 252")
    w = Window.partitionBy("ticker")
    d = d.withColumn("lo", F.min("close").over(w)).withColumn("hi", F.max("close").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    y = 120 - F.try_divide(120 * (F.col("close") - F.col("lo")), F.col("hi") - F.col("lo"))
    return d.select("ticker", "rn", F.round(F.try_divide(600.0 * (F.col("n") - F.col("k")), F.col("n") - 1), 4).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


@query(chain(*BASE) + """, s AS (SELECT ticker, d, raw AS close, row_number() OVER w AS k, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS back, CASE WHEN count(*) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 THEN avg(raw) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma
  FROM grid WHERE raw IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY d)) SELECT ticker, d, round(close, 6) AS close, round(sma, 6) AS sma FROM s WHERE back <= 252""")
def chart_series(spark, sf):
    """The last 252 closes of each ticker and their average over 200 closes, days without a close left out."""
    d = FA.chart_series(panel(spark, sf))
    return r6(d)


# ---- scoring ----


@query(chain(V.TRAITS) + f"SELECT ticker, round({pct_sql('rev_chg', 'speculative')}, 6) AS p, round({pct_sql('gp_assets', 'speculative')}, 6) AS q FROM traits")
def pct_rank_average(spark, sf):
    t = V.traits(spark, sf)
    return t.select("ticker", F.round(SC.pct(F.col("rev_chg"), ["speculative"]) + 1e-9, 6).alias("p"), F.round(SC.pct(F.col("gp_assets"), ["speculative"]) + 1e-9, 6).alias("q"))


@query(chain(*RANKED) + "SELECT d, ticker, round(mom, 6) AS mom, round(qual, 6) AS qual, round(raw_score, 6) AS raw_score, round(composite, 6) AS composite FROM scored")
def composite_score(spark, sf):
    return r6(scored(spark, sf).select("d", "ticker", "mom", "qual", "raw_score", "composite"))


@query(chain(*FULL, V.TRAITS) + f""", a0 AS (SELECT m.*, t.* EXCLUDE (ticker), CASE WHEN eligible THEN mom_raw END e_m, CASE WHEN eligible THEN hi52 END e_h, CASE WHEN eligible THEN gp_assets END e_g, CASE WHEN eligible THEN rev_growth END e_r,
  CASE WHEN eligible THEN rev_chg END e_c, CASE WHEN eligible THEN rev_breadth END e_b FROM mfac m LEFT JOIN traits t USING (ticker)),
a1 AS (SELECT *, {pct_sql("e_m")} p_m, {pct_sql("e_h")} p_h, {pct_sql("e_g")} p_g, {pct_sql("e_r")} p_r, {pct_sql("e_c")} p_c, {pct_sql("e_b")} p_b FROM a0),
a2 AS (SELECT *, 0.7 * p_m + 0.3 * p_h AS mom, coalesce((p_g + p_r) / 2, p_g, p_r) AS qual, coalesce((p_c + p_b) / 2, p_c, p_b) AS rev FROM a1),
a3 AS (SELECT *, CASE WHEN qual IS NOT NULL THEN 0.8 * mom + 0.2 * qual ELSE mom END AS raw0 FROM a2)
SELECT d, ticker, round(rev, 6) AS rev, round(CASE WHEN rev IS NOT NULL THEN 0.85 * raw0 + 0.15 * rev ELSE raw0 END, 6) AS raw_score FROM a3""")
def composite_with_revisions(spark, sf):
    return r6(scored(spark, sf, "W1", True).select("d", "ticker", "rev", "raw_score"))


@query(chain(*RANKED) + f"SELECT d, ticker, {grade_sql('mom')} AS grade_mom, {grade_sql('qual')} AS grade_qual, {grade_sql('composite')} AS grade_composite, label FROM scored")
def grades_labels(spark, sf):
    return scored(spark, sf).select("d", "ticker", "grade_mom", "grade_qual", "grade_composite", "label")


@query(chain(*RANKED) + "SELECT d, ticker, ord FROM scored")
def tie_break_order(spark, sf):
    return scored(spark, sf).select("d", "ticker", "ord")


@query(chain(*RANKED) + "SELECT d, ticker, CASE WHEN NOT eligible THEN 'Insufficient data' WHEN trend THEN 'UPTREND' ELSE 'NO UPTREND' END AS rule, list_filter([CASE WHEN rev_breadth < -0.3 THEN 'EPS revisions negative' END, CASE WHEN speculative THEN 'speculative' END], lambda x: x IS NOT NULL) AS w0, len(list_filter([CASE WHEN rev_breadth < -0.3 THEN 1 END, CASE WHEN speculative THEN 1 END], lambda x: x IS NOT NULL)) AS n FROM scored".replace("list_filter([CASE WHEN rev_breadth < -0.3 THEN 'EPS revisions negative' END, CASE WHEN speculative THEN 'speculative' END], lambda x: x IS NOT NULL) AS w0", "concat_ws('; ', CASE WHEN rev_breadth < -0.3 THEN 'EPS revisions negative' END, CASE WHEN speculative THEN 'speculative' END) AS said"))
def rule_labels_warnings(spark, sf):
    s = scored(spark, sf)
    w = S.warnings(F.col("rev_breadth"), F.col("speculative"), F.lit(None).cast("boolean"))
    return s.select("d", "ticker", S.rule_label(F.col("eligible"), F.col("trend")).alias("rule"), F.array_join(w, "; ").alias("said"), F.size(w).cast("long").alias("n"))


def _place_sql(p: str) -> str:
    n = f"round_even({p} * 100, 0)::INT"
    return f"({n} || CASE WHEN {n} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"


def _signed_sql(v: str) -> str:
    n = f"round_even(round_even({v}, 2) * 100, 0)::BIGINT"
    return f"(CASE WHEN {n} >= 0 THEN '+' ELSE '' END || {n} || '%')"


def _clause_sql(name: str, p: str, *inner: str) -> str:
    said = f"concat_ws(', ', {', '.join(inner)})"
    return f"CASE WHEN {p} IS NOT NULL THEN '{name} ' || {_place_sql(p)} || ' pct' || CASE WHEN {said} <> '' THEN ' (' || {said} || ')' ELSE '' END END"


REASONS = f"""rs AS (SELECT *, {_clause_sql("Momentum", "mom", f"'12-1m ' || {_signed_sql('ret_12_1')}", "round_even(dd_52w * 100, 0)::BIGINT || '% from high'")} AS c_mom,
  {_clause_sql("Quality", "qual", "'GP/A ' || printf('%.2f', round_even(gp_assets, 2))", f"'rev ' || {_signed_sql('rev_growth')}")} AS c_qual FROM scored)
SELECT d, ticker, CASE WHEN NOT eligible THEN CASE WHEN close IS NULL THEN 'Insufficient data: no recent price' ELSE 'Insufficient data: ' || n_days || ' trading days of history (need 273)' END
  ELSE concat_ws(' · ', CASE WHEN coalesce(qual, -1) > coalesce(mom, -1) THEN concat_ws(' · ', c_qual, c_mom) ELSE concat_ws(' · ', c_mom, c_qual) END, CASE WHEN trend THEN 'in uptrend' WHEN above200 THEN 'above 200DMA, 50DMA below 200DMA (no uptrend)' ELSE 'below 200DMA' END) END AS reason FROM rs"""


@query(chain(*RANKED, REASONS.split(")\nSELECT d, ticker, CASE WHEN NOT eligible")[0] + ")") + "SELECT d, ticker, CASE WHEN NOT eligible" + REASONS.split(")\nSELECT d, ticker, CASE WHEN NOT eligible")[1])
def reason_text(spark, sf):
    return SC.reason(scored(spark, sf)).select("d", "ticker", "reason")


# ---- selection ----

GK = "coalesce('g:' || nullif(grp, ''), 't:' || ticker)"
CAPPED10 = f"""up AS (SELECT * FROM scored WHERE eligible AND composite IS NOT NULL AND trend),
g1 AS (SELECT *, row_number() OVER (PARTITION BY d, {GK} ORDER BY ord) AS gr FROM up), g2 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ord) AS pick FROM g1 WHERE gr <= 3)"""


@query(chain(*RANKED, CAPPED10) + "SELECT d, ticker, grp, pick FROM g2 WHERE pick <= 10")
def group_capped_top10(spark, sf):
    return SE.take_by_group(SE.uptrend(scored(spark, sf)), [F.col("ord").asc()], 10).select("d", "ticker", "grp", "pick")


@query(chain(*RANKED, V.HOLDINGS) + f""", up AS (SELECT s.*, coalesce(shares, 0) AS held FROM scored s LEFT JOIN holdings h USING (ticker) WHERE eligible AND composite IS NOT NULL AND trend),
g1 AS (SELECT *, row_number() OVER (PARTITION BY d, {GK} ORDER BY held, composite DESC, ticker) AS gr FROM up),
g2 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY held, composite DESC, ticker) AS pick FROM g1 WHERE gr <= 3)
SELECT d, ticker, held, pick, round(2500.0 / count(*) OVER (PARTITION BY d), 6) AS dollars FROM g2 WHERE pick <= 10""")
def rotation_buys(spark, sf):
    held = V.holdings(spark, sf, panel(spark, sf)).select("ticker", F.col("shares").alias("held"))
    return r6(SE.rotation_buys(scored(spark, sf), held, 2500.0).select("d", "ticker", "held", "pick", "dollars"))


LASTD = "lastd AS (SELECT max(d) AS d FROM scored WHERE trend AND eligible)"
POS = """pos AS (SELECT h.ticker, h.shares * 1000 + h.cost AS value, s.grp, coalesce(s.speculative, false) AS spec FROM holdings h LEFT JOIN (SELECT * FROM scored SEMI JOIN lastd USING (d)) s USING (ticker)),
tot AS (SELECT sum(value) AS port, coalesce(sum(value) FILTER (spec), 0) AS spec_total FROM pos), pg AS (SELECT coalesce('g:' || nullif(grp, ''), 't:' || ticker) AS g, sum(value) AS in_group FROM pos GROUP BY 1)"""
CAPS = f"""cp AS (SELECT s.ticker FROM (SELECT * FROM scored SEMI JOIN lastd USING (d)) s LEFT JOIN pos p USING (ticker) LEFT JOIN pg ON pg.g = coalesce('g:' || nullif(s.grp, ''), 't:' || s.ticker) CROSS JOIN tot
  WHERE port >= 25000 AND (coalesce(p.value, 0) >= 0.1 * port OR coalesce(in_group, 0) >= 0.3 * port OR (coalesce(s.speculative, false) AND (coalesce(p.value, 0) >= 0.03 * port OR spec_total >= 0.1 * port))))"""


def _last_scored(spark, sf):
    s = scored(spark, sf)
    return s.join(s.filter("trend and eligible").agg(F.max("d").alias("d")), "d", "left_semi")


def _positions(spark, sf, s):
    h = V.holdings(spark, sf, panel(spark, sf)).select("ticker", (F.col("shares") * 1000 + F.col("cost")).alias("value"))
    return h.join(s.select("ticker", "grp"), "ticker", "left")


@query(chain(*RANKED, V.HOLDINGS, LASTD, POS, CAPS) + "SELECT ticker FROM cp")
def position_caps(spark, sf):
    s = _last_scored(spark, sf)
    return SE.capped(s, _positions(spark, sf, s))


@query(chain(*RANKED, V.HOLDINGS, LASTD, POS, CAPS) + f""", pool AS (SELECT s.* FROM scored s SEMI JOIN lastd USING (d) ANTI JOIN cp USING (ticker) WHERE eligible AND composite IS NOT NULL),
g1 AS (SELECT *, row_number() OVER (PARTITION BY {GK} ORDER BY ord) AS gr FROM pool WHERE composite >= 0.85), g2 AS (SELECT *, row_number() OVER (ORDER BY ord) AS pick FROM g1 WHERE gr <= 3) SELECT ticker, pick FROM g2 WHERE pick <= 2""")
def ranked_buys_braked(spark, sf):
    s = _last_scored(spark, sf)
    return SE.ranked_buys(s, _positions(spark, sf, s), "Nvar", "G0", True).select("ticker", "pick")


@query(chain(*RANKED, FIP, CAPPED10) + """, u AS (SELECT up.d, up.ticker, up.ord, up.ret_12_1, fp.fip FROM up JOIN fp USING (ticker, d) WHERE up.ret_12_1 IS NOT NULL),
t1 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ret_12_1 DESC, ord) AS r, count(*) OVER (PARTITION BY d) AS n FROM u),
t2 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY fip, r) AS q, count(*) OVER (PARTITION BY d) AS m FROM t1 WHERE r <= ceil(n / 3.0) AND fip IS NOT NULL) SELECT d, ticker, q AS pick FROM t2 WHERE q <= ceil(m / 2.0)""")
def fip_pool(spark, sf):
    f = FA.fip(filled(spark, sf)).select("ticker", "d", "fip")
    return SE.fip_pool(scored(spark, sf).join(f, ["ticker", "d"])).select("d", "ticker", "pick")


@query(chain(*RANKED, BELOW, V.HOLDINGS) + """, x AS (SELECT s.d, h.ticker, h.cost, s.close, s.sma200, s.above200, b.below_prev, s.composite FROM holdings h JOIN scored s USING (ticker) JOIN bp b ON b.ticker = s.ticker AND b.d = s.d),
y AS (SELECT d, ticker, CASE WHEN cost > 0 AND close <= 0.65 * cost THEN '-35% stop' WHEN sma200 IS NOT NULL AND NOT above200 AND below_prev THEN '2 month-ends below 200DMA' WHEN composite < 0.7 THEN 'rank fell below 70th pct' END AS rule FROM x)
SELECT d, ticker, rule FROM y WHERE rule IS NOT NULL AND d = (SELECT max(d) FROM me)""")
def sell_rules(spark, sf):
    last = ends(spark, sf).agg(F.max("d").alias("d"))
    s = scored(spark, sf).join(FA.below_before(mfac(spark, sf)).select("ticker", "d", "below_prev"), ["ticker", "d"]).join(last, "d", "left_semi")
    h = V.holdings(spark, sf, panel(spark, sf)).join(s.select("ticker", "d", F.col("close").alias("price")), "ticker")
    return SE.sells(h.select("ticker", "cost", "price"), s, "S3").select("ticker", "rule").crossJoin(last).select("d", "ticker", "rule")


# ---- fundamentals ----

ASOFS = "asofs AS (SELECT (make_date(y::BIGINT, m::BIGINT, 1::BIGINT))::DATE AS asof FROM range(1996, 2002) a(y), (VALUES (3), (6), (9), (12)) b(m))"
CONC = "conc AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{c}', {k})" for m, cs in PIT.CONCEPTS.items() for k, c in enumerate(cs)) + ") v(metric, concept, rank))"
KNOWN = """kn0 AS (SELECT f.entity, c.metric, a.asof, f.start, f."end" AS e, f.val, f.filed, row_number() OVER (PARTITION BY f.entity, c.metric, a.asof, f.start, f."end" ORDER BY c.rank, f.filed DESC, f.k) AS r
  FROM facts f JOIN conc c USING (concept) JOIN asofs a ON f.filed < a.asof),
kn AS (SELECT *, CASE WHEN start IS NULL THEN NULL WHEN e - start BETWEEN 80 AND 100 THEN 'quarter' WHEN e - start BETWEEN 170 AND 200 THEN 'half' WHEN e - start BETWEEN 260 AND 290 THEN 'nine' WHEN e - start BETWEEN 350 AND 380 THEN 'annual' END AS cls FROM kn0 WHERE r = 1)"""


def ttm_sql(name: str, src: str) -> str:
    k = "entity, metric, asof"
    return f"""{name}_fy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY e DESC, start) AS q FROM {src} WHERE cls = 'annual') WHERE q = 1),
{name}_y AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.entity, s.metric, s.asof ORDER BY s.e DESC, s.start) AS q FROM {src} s JOIN {name}_fy f USING ({k}) WHERE s.cls IN ('quarter', 'half', 'nine') AND s.start > f.e - 5 AND s.start <= f.e + 5 AND s.e > f.e) WHERE q = 1),
{name}_p AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.entity, s.metric, s.asof ORDER BY abs(y.e - s.e - 365), s.e DESC, s.start) AS q FROM {src} s JOIN {name}_y y USING ({k}) WHERE s.start IS NOT NULL AND abs((s.e - s.start) - (y.e - y.start)) <= 10 AND abs(y.e - s.e - 365) <= 10) WHERE q = 1),
{name} AS (SELECT f.entity, f.metric, f.asof, CASE WHEN p.val IS NOT NULL THEN f.val + y.val - p.val ELSE f.val END AS val, CASE WHEN p.val IS NOT NULL THEN y.e ELSE f.e END AS e FROM {name}_fy f LEFT JOIN {name}_y y USING ({k}) LEFT JOIN {name}_p p USING ({k}))"""


PITS = (V.FACTS, ASOFS, CONC, KNOWN)


def _known(spark, sf):
    asofs = spark.range(1996, 2002).select(F.col("id").cast("int").alias("y")).crossJoin(spark.createDataFrame([(3,), (6,), (9,), (12,)], "m int")).select(F.make_date("y", "m", F.lit(1)).alias("asof"))
    return PIT.known(V.facts(spark, sf), asofs, PIT.concept_rows(spark))


@query(chain(*PITS) + 'SELECT entity, metric, asof, start, e AS "end", round(val, 2) AS val, filed FROM kn')
def pit_known_versions(spark, sf):
    return _known(spark, sf).select("entity", "metric", "asof", "start", "end", F.round("val", 2).alias("val"), "filed")


@query(chain(*PITS) + "SELECT metric, coalesce(cls, 'none') AS cls, count(*) AS n FROM kn GROUP BY ALL")
def pit_duration_class(spark, sf):
    return _known(spark, sf).groupBy("metric", F.coalesce("cls", F.lit("none")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query(chain(*PITS, ttm_sql("ttm", "kn")) + """SELECT entity, metric, asof, round(val, 2) AS val, e AS "end" FROM ttm""")
def pit_ttm_revenue(spark, sf):
    return PIT.ttm(_known(spark, sf)).select("entity", "metric", "asof", F.round("val", 2).alias("val"), "end")


@query(chain(*PITS) + """SELECT entity, metric, asof, round(arg_max(val, e), 2) AS val, max(e) AS "end" FROM kn WHERE start IS NULL GROUP BY ALL HAVING asof - max(e) <= 500""")
def pit_instant_latest(spark, sf):
    return PIT.fresh(PIT.instant(_known(spark, sf))).select("entity", "metric", "asof", F.round("val", 2).alias("val"), "end")


FUND = f"""{ttm_sql("ttm", "kn")}, rev AS (SELECT * FROM ttm WHERE metric = 'revenue' AND asof - e <= 500),
kb AS (SELECT kn.* FROM kn JOIN rev r USING (entity, metric, asof) WHERE kn.e <= r.e - 330),
{ttm_sql("prv", "kb")},
ast AS (SELECT entity, asof, arg_max(val, e) AS assets FROM kn WHERE start IS NULL AND metric = 'assets' GROUP BY ALL HAVING asof - max(e) <= 500),
shx AS (SELECT entity, asof, metric, arg_max(val, e) AS val, max(e) AS e FROM kn WHERE start IS NULL AND metric IN ('shares', 'shares_filed') GROUP BY ALL),
shr AS (SELECT entity, asof, val AS shares FROM (SELECT *, row_number() OVER (PARTITION BY entity, asof ORDER BY metric) AS q FROM shx) WHERE q = 1 AND asof - e <= 500),
one AS (SELECT entity, asof, metric, val, e FROM ttm WHERE metric IN ('gross', 'net_income') AND asof - e <= 500),
ky AS (SELECT entity, asof FROM rev UNION SELECT entity, asof FROM ast UNION SELECT entity, asof FROM shr UNION SELECT entity, asof FROM one),
fund AS (SELECT ky.entity, ky.asof, r.val AS revenue_ttm, p.val AS revenue_ttm_prev, r.e AS fund_end, CASE WHEN p.val > 0 THEN r.val / p.val - 1 END AS revenue_growth, coalesce(g.val, CASE WHEN c.e = r.e THEN r.val - c.val END) AS gross_profit_ttm, a.assets, n.val AS net_income_ttm, s.shares
  FROM ky LEFT JOIN rev r USING (entity, asof) LEFT JOIN prv p USING (entity, asof) LEFT JOIN (SELECT * FROM ttm WHERE metric = 'cost') c USING (entity, asof) LEFT JOIN ast a USING (entity, asof) LEFT JOIN shr s USING (entity, asof)
  LEFT JOIN (SELECT * FROM one WHERE metric = 'gross') g USING (entity, asof) LEFT JOIN (SELECT * FROM one WHERE metric = 'net_income') n USING (entity, asof))"""


@query(chain(*PITS, FUND) + "SELECT entity, asof, round(revenue_ttm, 2) AS revenue_ttm, round(revenue_ttm_prev, 2) AS revenue_ttm_prev, round(revenue_growth, 6) AS revenue_growth, round(gross_profit_ttm, 2) AS gross_profit_ttm, round(assets, 2) AS assets, round(gross_profit_ttm / nullif(assets, 0), 6) AS gp_assets, round(net_income_ttm, 2) AS net_income_ttm, shares, fund_end FROM fund")
def pit_growth_and_margin(spark, sf):
    d = PIT.fundamentals(_known(spark, sf))
    two = [F.round(c, 2).alias(c) for c in ("revenue_ttm", "revenue_ttm_prev", "gross_profit_ttm", "assets", "net_income_ttm")]
    return d.select("entity", "asof", *two, F.round(F.col("revenue_growth") + 1e-9, 6).alias("revenue_growth"), F.round(F.col("gp_assets") + 1e-9, 6).alias("gp_assets"), "shares", "fund_end")


@query(chain(*PITS, FUND) + """SELECT entity, asof, round(CASE WHEN shares > 0 THEN net_income_ttm / (shares * (100 + entity)) END, 6) AS earnings_yield, coalesce(net_income_ttm < 0, false) AS speculative, net_income_ttm IS NULL AND shares IS NULL AS fund_missing FROM fund""")
def fund_factors(spark, sf):
    d = PIT.fundamentals(_known(spark, sf)).withColumn("close", (100 + F.col("entity")).cast("double"))
    return r6(PIT.fund_factors(d).select("entity", "asof", "earnings_yield", "speculative", "fund_missing"))


@query(chain(*PITS, ttm_sql("ttm", "kn")) + ", ey AS (SELECT DISTINCT c_nationkey AS entity, year(o_orderdate) + 1 AS year FROM orders JOIN customer ON o_custkey = c_custkey) SELECT entity, asof FROM ttm JOIN ey ON ey.entity = ttm.entity AND ey.year = year(asof) WHERE metric = 'revenue' AND val >= 1000000".replace("SELECT entity, asof FROM", "SELECT ttm.entity, asof FROM"))
def member_revenue_floor(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    years = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("entity"), (F.year("o_orderdate") + 1).alias("year")).distinct()
    return PIT.members(years, PIT.ttm(_known(spark, sf)).filter("metric = 'revenue'"), 1e6)


@query("""WITH t AS (SELECT user_id, value AS cur, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d90 FROM events),
c AS (SELECT user_id, avg(greatest(least((cur - d90) / abs(d90), 0.5), -0.5)) AS chg FROM t WHERE cur IS NOT NULL AND d90 <> 0 GROUP BY 1),
n AS (SELECT user_id, ts::DATE AS day, nullif(count(*) FILTER (event_type = 'view'), 0) AS up30, nullif(count(*) FILTER (event_type = 'click'), 0) AS down30 FROM events GROUP BY ALL),
b AS (SELECT user_id, avg((up30 - down30) / greatest(up30 + down30, 1)) AS breadth FROM n WHERE up30 IS NOT NULL AND down30 IS NOT NULL GROUP BY 1)
SELECT user_id, round(chg, 6) AS rev_chg, round(breadth, 6) AS rev_breadth FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN c USING (user_id) LEFT JOIN b USING (user_id)""")
def estimate_revisions(spark, sf):
    """Each event's value against the user's one before it, and each day's views against its clicks."""
    e = V.table(spark, sf, "events")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    t = e.select("user_id", F.struct(F.col("value").alias("current"), before.alias("d90")).alias("x")).groupBy("user_id").agg(F.collect_list("x").alias("t"))
    some = lambda kind: F.nullif(F.count_if(F.col("event_type") == kind), F.lit(0).cast("long"))
    n = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(some("view").alias("up30"), some("click").alias("down30"))
    r = n.groupBy("user_id").agg(F.collect_list(F.struct("up30", "down30")).alias("r"))
    chg, breadth = PIT.revisions(F.col("t"), F.col("r"))
    return r6(t.join(r, "user_id").select("user_id", chg.alias("rev_chg"), breadth.alias("rev_breadth")))


# ---- joins ----


@query("""WITH m AS (SELECT date_trunc('month', ts)::DATE AS month, user_id, sum(value) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, max_by(s.value, s.ts) AS v FROM events e JOIN s ON s.user_id = e.user_id AND s.ts <= e.ts WHERE e.event_type = 'error' GROUP BY ALL""".replace("max_by(s.value, s.ts) AS v", "round(arg_max(s.value, (s.ts, s.value)), 6) AS last_purchase"))
def asof_backward(spark, sf):
    e = V.table(spark, sf, "events")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("t"), "value")
    return r6(P.asof_join(left, right, "user_id", "ts", "t", "value", "last_purchase").filter("last_purchase is not null").select("event_id", "user_id", "last_purchase"))


@query("""SELECT e.event_id, min(s.ts) AS next_purchase FROM events e LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') s ON s.user_id = e.user_id AND s.ts >= e.ts WHERE e.event_type = 'error' GROUP BY 1""")
def asof_forward(spark, sf):
    e = V.table(spark, sf, "events")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("t"))
    return P.forward_join(left, right, "user_id", "ts", "t", "next_purchase").select("event_id", "next_purchase")


MEMB = """q AS (SELECT c_nationkey AS n, date_trunc('quarter', o_orderdate)::DATE AS d, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
mb AS (SELECT d, n FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY v DESC, n) AS r FROM q) WHERE r <= 15)"""


@query(chain(MEMB) + """, cp AS (SELECT DISTINCT d FROM mb), x AS (SELECT o_orderkey, o_orderdate::DATE AS od, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT x.*, (SELECT max(d) FROM cp WHERE cp.d <= x.od) AS d FROM x) SELECT a.d AS asof, count(*) AS orders, count(mb.n) AS member_orders FROM a LEFT JOIN mb ON mb.d = a.d AND mb.n = a.n GROUP BY 1""")
def asof_membership(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    x = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.to_date("o_orderdate").alias("od"), F.col("c_nationkey").alias("n"), "o_totalprice")
    q = x.groupBy("n", F.trunc("od", "quarter").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    mb = q.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy(F.col("v").desc(), "n"))).filter("r <= 15").select("d", "n", F.lit(1).alias("m"))
    # The change points are as many as quarters: each day finds its own once, orders then join by day.
    days = x.select("od").distinct().withColumn("k", F.lit(0))
    cps = mb.select(F.lit(0).alias("k"), "d").distinct().withColumn("v", F.col("d"))
    at = P.asof_join(days, cps, "k", "od", "d", "v", "asof").select("od", "asof")
    j = x.join(at, "od").join(mb.select(F.col("d").alias("asof"), "n", "m"), ["asof", "n"], "left")
    return j.groupBy("asof").agg(F.count(F.lit(1)).alias("orders"), F.count("m").alias("member_orders"))


@query(chain(V.LISTINGS) + """, cl AS (SELECT l_orderkey * 10 + l_linenumber AS claim, 'T' || (l_partkey % 200) AS ticker, l_shipdate::DATE AS d0, l_shipdate::DATE + 5 AS d1 FROM lineitem),
j AS (SELECT cl.claim, cl.ticker, l.start, l."end" AS e, l.owner, l.exchange, row_number() OVER (PARTITION BY cl.claim, cl.ticker ORDER BY l."end" DESC NULLS LAST, l.start DESC, l.owner) AS r FROM cl LEFT JOIN listings l ON l.ticker = cl.ticker AND l.start <= d1 AND l."end" >= d0)
SELECT claim, ticker, start AS l_start, e AS l_end, owner, exchange FROM j WHERE r = 1""")
def interval_listing_match(spark, sf):
    li = V.table(spark, sf, "lineitem")
    c = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), F.concat(F.lit("T"), (F.col("l_partkey") % 200).cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("d0"), F.date_add(F.to_date("l_shipdate"), 5).alias("d1"))
    return FI.match_listing(c, V.listings(spark, sf)).select("claim", "ticker", "l_start", "l_end", "owner", "exchange")


# ---- filings ----

DICT = {"compute": ("the", "and"), "ai": ("in on",), "network": ("die", "der"), "power": ("les des", "la"), "cooling": ("de la",)}
_EDGE = r"[^\p{L}\p{N}_]"  # RE2 has no word edge beyond ASCII; the oracle doubles each edge character instead
_N = lambda t: f"len(regexp_extract_all(text2, '(?i)(?:^|{_EDGE}){t.replace(' ', chr(92) + 's+')}(?:$|{_EDGE})'))"
HITS = ", ".join(f"{' + '.join(_N(t) for t in ts)} AS hits_{g}" for g, ts in DICT.items())
TEXTS = f"""tx AS (SELECT acc, cik, filed, sic, {HITS}, len(regexp_extract_all(text, '[^\\s]+')) AS words FROM (SELECT *, regexp_replace(text, '({_EDGE})', '\\1\\1', 'g') AS text2 FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM filings))),
ts AS (SELECT *, (CASE WHEN regexp_full_match(sic, '[0-9]+') THEN sic::INT ELSE -1 END) AS s, hits_compute + hits_ai + hits_network + hits_power + hits_cooling AS total FROM tx),
sc AS (SELECT *, s BETWEEN 3570 AND 3579 OR s BETWEEN 3612 AND 3629 OR s BETWEEN 3661 AND 3679 OR s BETWEEN 7370 AND 7379 OR s IN (3812, 3585, 6798, 4911, 4931, 4991, 1094) AS in_group,
  CASE WHEN words > 0 THEN round_even(total * 10000 / words, 3) ELSE 0 END AS per10k_total, CASE WHEN words > 0 THEN round_even(hits_power * 10000 / words, 3) ELSE 0 END AS per10k_power FROM ts),
scores AS (SELECT *, in_group AND CASE WHEN s IN (1094, 4911, 4931, 4991) THEN per10k_power >= 200 ELSE per10k_total >= 900 END AS eligible_text FROM sc)"""


def _scores(spark, sf):
    d = T.score_text(V.filings(spark, sf), dictionary=DICT)
    ok = F.when(S.sic_code(F.col("sic")).isin(*S.UTILITY_SIC), F.col("per10k_power") >= 200).otherwise(F.col("per10k_total") >= 900)
    return d.withColumn("eligible_text", F.col("in_group") & ok)


@query(chain(V.FILINGS, TEXTS) + "SELECT acc, words::INT AS words, hits_compute::INT AS hits_compute, hits_ai::INT AS hits_ai, hits_network::INT AS hits_network, hits_power::INT AS hits_power, hits_cooling::INT AS hits_cooling, in_group, round(per10k_total + 1e-6, 2) AS per10k_total, round(per10k_power + 1e-6, 2) AS per10k_power FROM scores")
def keyword_hits_per_10k(spark, sf):
    s = _scores(spark, sf)
    return s.select("acc", "words", *[f"hits_{g}" for g in DICT], "in_group", F.round(F.col("per10k_total") + 1e-6, 2).alias("per10k_total"), F.round(F.col("per10k_power") + 1e-6, 2).alias("per10k_power"))


@query(chain(V.FILINGS, TEXTS) + """, l AS (SELECT *, year(filed) + 1 AS year, row_number() OVER (PARTITION BY year(filed) + 1, cik ORDER BY filed DESC, acc DESC) AS r FROM scores WHERE year(filed) + 1 BETWEEN 2010 AND 2026)
SELECT year::INT AS year, cik, acc, filed, sic FROM l WHERE r = 1 AND in_group AND eligible_text""")
def latest_filing_then_filter(spark, sf):
    return FI.eligible(_scores(spark, sf)).select("year", "cik", "acc", "filed", "sic")


@query(chain(V.FILINGS) + """, l AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, acc DESC) AS r FROM filings WHERE year(filed) = 2012) SELECT cik, acc, filed FROM l WHERE r = 1""")
def latest_of_year(spark, sf):
    return FI.latest_of_year(V.filings(spark, sf), 2012).select("cik", "acc", "filed")


@query("""WITH a AS (SELECT doc_id AS acc, doc_id % 400 AS k, n_chars AS seq FROM documents) SELECT k, acc FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY acc DESC) AS r FROM a) WHERE r = 1""")
def index_dedupe(spark, sf):
    d = V.table(spark, sf, "documents").select((F.col("doc_id") % 400).alias("k"), F.col("doc_id").alias("acc"))
    return FI.dedupe_index(d, "k", "acc").select("k", "acc")


@query(chain(V.FILINGS) + "SELECT acc, CASE WHEN s BETWEEN 3670 AND 3679 OR (s BETWEEN 3570 AND 3579 AND s <> 3576) THEN 'semis' WHEN s = 3576 OR s BETWEEN 3661 AND 3669 THEN 'network' WHEN s BETWEEN 7370 AND 7379 THEN 'cloud' WHEN s BETWEEN 3612 AND 3629 OR s IN (3585, 3812, 4911, 4931, 4991, 6798, 1094) THEN 'infra' ELSE 'other' END AS grp FROM (SELECT acc, sic::INT AS s FROM filings)")
def sic_groups(spark, sf):
    return V.filings(spark, sf).select("acc", S.sic_group(F.col("sic")).alias("grp"))


@query(chain(V.FILINGS, TEXTS) + "SELECT acc FROM scores ANTI JOIN (SELECT doc_id AS acc FROM labels) USING (acc) WHERE in_group")
def resumable_todo(spark, sf):
    done = V.table(spark, sf, "labels").select(F.col("doc_id").alias("acc"))
    return ST.todo(V.filings(spark, sf).filter(S.in_group(F.col("sic"))).select("acc"), done, "acc")


def _elig(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 97).alias("cik")).agg(F.to_date(F.max("o_orderdate")).alias("filed"))


ELIG = "el AS (SELECT year(o_orderdate)::INT AS year, o_custkey % 97 AS cik, max(o_orderdate)::DATE AS filed FROM orders GROUP BY 1, 2)"
OWN = "own AS (SELECT s_suppkey AS cik, 0 AS pos, 'T' || (s_suppkey * 3 % 200) AS ticker FROM supplier)"
STATED = "stated AS (SELECT cik, 0 AS pos, filed, 'T' || (cik * 5 % 200) AS ticker FROM el)"
CLAIMS = """cl AS (SELECT el.year, el.cik, 0 AS tier, 0 AS near, '' AS said, pos, ticker, DATE '2001-06-01' AS d0, DATE '9999-12-31' AS d1, NULL::DATE AS alive, make_date(el.year::BIGINT, 12, 31) AS y1 FROM el JOIN own USING (cik)
  UNION ALL SELECT el.year, el.cik, 1, CASE WHEN s.filed = el.filed THEN -1 ELSE abs(year(s.filed) - el.year + 1) END, s.filed::VARCHAR, pos, t, s.filed, s.filed, el.filed, make_date(el.year::BIGINT, 12, 31) FROM el JOIN stated s USING (cik), LATERAL (SELECT unnest([s.ticker, s.ticker || 'Q']) AS t)),
ml AS (SELECT cl.*, l.start, l."end" AS e, l.owner, l.exchange, row_number() OVER (PARTITION BY year, cik, tier, near, said, pos, cl.ticker ORDER BY l."end" DESC, l.start DESC, l.owner) AS r FROM cl JOIN listings l ON l.ticker = cl.ticker AND l.start <= d1 AND l."end" >= d0),
m2 AS (SELECT *, row_number() OVER (PARTITION BY year, cik ORDER BY tier, near, said, pos, ticker) AS q FROM ml WHERE r = 1 AND start <= y1 AND (tier = 0 OR e >= alive)),
m3 AS (SELECT m2.year, m2.cik, m2.ticker, start, e, exchange, o.ticker IS NOT NULL AS own FROM m2 LEFT JOIN (SELECT DISTINCT cik, ticker FROM own) o USING (cik, ticker) WHERE q = 1),
m4 AS (SELECT *, CASE WHEN own AND e >= DATE '2001-06-01' THEN 'listed' ELSE 'delisted' END AS status, row_number() OVER (PARTITION BY year, ticker, start ORDER BY own DESC, cik) = 1 AS kept FROM m3),
mapped AS (SELECT el.year, el.cik, ticker, start, e AS "end", exchange, coalesce(status, 'unmapped') AS status, coalesce(kept, true) AS kept FROM el LEFT JOIN m4 USING (year, cik))"""


def _mapped(spark, sf):
    e = _elig(spark, sf)
    own = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cik"), F.lit(0).alias("pos"), F.concat(F.lit("T"), (F.col("s_suppkey") * 3 % 200).cast("string")).alias("ticker"))
    stated = e.select("cik", F.lit(0).alias("pos"), "filed", F.concat(F.lit("T"), (F.col("cik") * 5 % 200).cast("string")).alias("ticker"))
    return FI.map_tickers(e, own, stated, V.listings(spark, sf), "2001-06-01")


@query(chain(V.LISTINGS, ELIG, OWN, STATED, CLAIMS) + 'SELECT year, cik, ticker, start, "end", exchange, status, kept FROM mapped')
def ticker_mapping(spark, sf):
    return _mapped(spark, sf).select("year", "cik", "ticker", "start", "end", "exchange", "status", "kept")


STATUS = "st AS (SELECT cik, status, ticker FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY CASE status WHEN 'listed' THEN 2 WHEN 'delisted' THEN 1 ELSE 0 END DESC, year DESC) AS r FROM mapped) WHERE r = 1)"


@query(chain(V.LISTINGS, ELIG, OWN, STATED, CLAIMS, STATUS) + "SELECT * FROM st")
def status_priority(spark, sf):
    return FI.status_of(_mapped(spark, sf)).select("cik", "status", "ticker")


@query(chain(V.LISTINGS, ELIG, OWN, STATED, CLAIMS, STATUS) + ", od AS (SELECT s_suppkey AS cik, CASE WHEN s_suppkey % 2 = 0 THEN 'listed' ELSE 'delisted' END AS status FROM supplier) SELECT coalesce(od.cik, st.cik) AS cik, od.status AS old, st.status AS new FROM od FULL JOIN st ON od.cik = st.cik WHERE od.status IS DISTINCT FROM st.status")
def status_diff(spark, sf):
    old = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cik"), F.when(F.col("s_suppkey") % 2 == 0, "listed").otherwise("delisted").alias("status"))
    return FI.status_diff(old, FI.status_of(_mapped(spark, sf)))


@query(chain(V.PANEL) + ", c AS (SELECT 'C' || substr(ticker, 2) AS ticker, d, close FROM panel UNION ALL SELECT ticker, d, close FROM panel) SELECT ticker, min(d) AS first, max(d) AS last FROM c WHERE regexp_matches(ticker, '^C[0-9]+$') AND close IS NOT NULL GROUP BY 1")
def key_spans(spark, sf):
    p = panel(spark, sf)
    return FI.key_spans(p.withColumn("ticker", F.concat(F.lit("C"), F.substring("ticker", 2, 9))).unionByName(p))


@query(chain(V.FILINGS, TEXTS) + """, f AS (SELECT acc, acc AS cik, CASE WHEN acc % 4 = 0 THEN 'M' || acc % 40 ELSE 'T' || acc END AS ticker, sic, CASE WHEN in_group THEN 1e4 * CASE WHEN s IN (1094, 4911, 4931, 4991) THEN hits_power ELSE total END / greatest(words, 1) ELSE 0 END AS score, words * 1e6 AS revenue FROM scores),
j AS (SELECT f.*, l.quality = 1 AS si, CASE acc % 5 WHEN 0 THEN 'power_energy' WHEN 1 THEN 'cloud' WHEN 2 THEN 'compute' WHEN 3 THEN 'networking' ELSE 'none' END AS role, CASE WHEN f.acc % 4 = 0 THEN 'member' END AS mc FROM f LEFT JOIN labels l ON l.doc_id = f.acc),
k AS (SELECT *, CASE WHEN mc IS NOT NULL THEN CASE WHEN NOT si THEN 'remove' END WHEN score >= 2 AND revenue >= 1e8 THEN CASE WHEN si IS NULL THEN 'pending' WHEN si THEN 'candidate' END END AS kind, CASE WHEN si IS NULL THEN '' ELSE role END AS rl FROM j)
SELECT cik, ticker, kind, CASE WHEN kind = 'remove' THEN mc WHEN rl = 'power_energy' THEN CASE WHEN sic LIKE '49%' THEN 'power' ELSE 'grid' END WHEN rl = 'cloud' THEN CASE WHEN revenue >= 50e9 THEN 'hyperscalers' ELSE 'software' END WHEN rl = 'compute' THEN 'compute' WHEN rl = 'networking' THEN 'networking' ELSE '—' END AS category FROM k WHERE kind IS NOT NULL""")
def universe_review(spark, sf):
    s = FI.ra_score(_scores(spark, sf), tuple(DICT))
    f = s.select("acc", F.col("acc").alias("cik"), F.when(F.col("acc") % 4 == 0, F.concat(F.lit("M"), (F.col("acc") % 40).cast("string"))).otherwise(F.concat(F.lit("T"), F.col("acc").cast("string"))).alias("ticker"), "sic", "score", (F.col("words") * 1e6).alias("revenue"))
    k = F.col("doc_id") % 5
    role = F.when(k == 0, "power_energy").when(k == 1, "cloud").when(k == 2, "compute").when(k == 3, "networking").otherwise("none")
    classes = V.table(spark, sf, "labels").select(F.col("doc_id").alias("acc"), (F.col("quality") == 1).alias("sells_into"), role.alias("role"))
    members = f.filter(F.col("acc") % 4 == 0).select("ticker", F.lit("member").alias("category")).distinct()
    return FI.review(f.drop("revenue"), classes, members, f.select("cik", "revenue"))


@query(chain(V.FILINGS, TEXTS) + """, g AS (SELECT l.quality = 1 AS t, eligible_text AS p FROM scores JOIN labels l ON l.doc_id = acc)
SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, round(count(*) FILTER (t = p) / count(*), 6) AS agreement FROM g""")
def confusion_matrix(spark, sf):
    j = _scores(spark, sf).join(V.table(spark, sf, "labels"), F.col("acc") == F.col("doc_id"))
    return r6(T.confusion(j, F.col("quality") == 1, F.col("eligible_text")))


# ---- text ----

_TAGS = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<ix:header\\b.*?</ix:header\\s*>|<head\\b.*?</head\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_TXT = _TAGS
for _n, _s in T.ENTITIES:
    _TXT = f"replace({_TXT}, '{_n.replace(chr(39), chr(39) * 2)}', '{_s.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, md5(trim(regexp_replace({_TXT}, '\\s+', ' ', 'g'))) AS text_md5, length(trim(regexp_replace({_TXT}, '\\s+', ' ', 'g'))) AS n FROM pages")
def html_to_text(spark, sf):
    t = T.html_to_text(F.col("html"))
    return V.table(spark, sf, "pages").select("page_id", F.md5(t.cast("binary")).alias("text_md5"), F.length(t).cast("long").alias("n"))


@query()
def html_to_text_all_entities(spark, sf):
    return T.html_to_text_full(V.table(spark, sf, "pages")).select("page_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH s AS (SELECT doc_id, 'listed under the symbol "' || upper(substr(source, 1, 3)) || '" and ' || upper(lang) || ' Nasdaq or SEC NYSE; ' || text AS t FROM documents),
f AS (SELECT doc_id, list_filter(list_distinct(list_concat(regexp_extract_all(substr(t, 1, 400000), 'under the (?:ticker |trading )?symbols? ["“''(]*([A-Z]{1,5}(?:[.-][A-Z])?)\\b', 1), regexp_extract_all(substr(t, 1, 400000), '\\b([A-Z]{1,5}(?:[.-][A-Z])?)\\s+(?:The\\s+)?(?:Nasdaq|NASDAQ|New York Stock Exchange|NYSE)\\b', 1))), lambda x: x <> 'SEC') AS l FROM s)
SELECT doc_id, CASE WHEN list_contains(l, 'SRC') THEN 1 ELSE 0 END AS has_src, len(l) AS n FROM f""")
def symbol_extract(spark, sf):
    t = F.concat(F.lit('listed under the symbol "'), F.upper(F.substring("source", 1, 3)), F.lit('" and '), F.upper("lang"), F.lit(" Nasdaq or SEC NYSE; "), "text")
    d = V.table(spark, sf, "documents").select("doc_id", T.symbols(t).alias("s"))
    l = F.filter(F.split("s", r"\|"), lambda x: x != "")  # noqa: E741
    return d.select("doc_id", F.array_contains(l, "SRC").cast("int").alias("has_src"), F.size(l).cast("long").alias("n"))


@query("""WITH e AS (SELECT user_id, ts::DATE AS date, ['1.03', '2.04', '3.01', '4.01', '4.02'][((props->>'$.k')::INT % 5) + 1] AS item FROM events WHERE event_type = 'error' AND (props->>'$.k')::INT % 3 = 0)
SELECT user_id AS entity, date, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM e WHERE date > DATE '2024-01-20' - 7 AND date < DATE '2024-01-20' GROUP BY 1, 2""")
def hard_event_flags(spark, sf):
    e = V.table(spark, sf, "events").filter("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*[F.lit(c) for c in T.SEVERE])
    sub = e.withColumn("item", F.when(k % 3 == 0, F.get(codes, k % 5)).otherwise("9.99")).groupBy(F.col("user_id").alias("entity")).agg(
        F.collect_list(F.struct(F.lit("8-K").alias("form"), F.to_date("ts").cast("string").alias("filingDate"), F.col("item").alias("items"))).alias("x"))
    sub = sub.select("entity", F.col("x.form").alias("form"), F.col("x.filingDate").alias("filingDate"), F.col("x.items").alias("items"))
    d = T.severe_events(sub, F.lit("2024-01-20").cast("date"), 7)
    return d.select("entity", "date", F.explode("items").alias("i")).groupBy("entity", "date").agg(F.count("i").alias("n"), F.array_join(F.sort_array(F.collect_list("i")), ",").alias("items"))


@query("""SELECT c_custkey AS id, upper(CASE WHEN c_custkey % 9 = 0 THEN '9bad' ELSE 's' || (c_custkey % 50) END) AS ticker, (c_custkey % 7 + 1)::DOUBLE AS shares, round(abs(c_acctbal) + 1, 2) AS cost FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 11 <> 0""")
def parse_holdings(spark, sf):
    c = V.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 9 == 0, "9bad").otherwise(F.concat(F.lit("s"), (F.col("c_custkey") % 50).cast("string")))
    cost = F.when(F.col("c_custkey") % 11 == 0, "zero").otherwise(F.concat(F.lit("$"), F.round(F.abs("c_acctbal") + 1, 2).cast("string")))
    text = F.concat(F.lit("# mine\n"), name, F.lit(", "), (F.col("c_custkey") % 7 + 1).cast("string"), F.lit(", "), cost, F.lit("  # bought\n\n"))
    return T.parse_holdings(c.select(F.col("c_custkey").alias("id"), text.alias("text")))[0]


@query()
def number_grounding(spark, sf):
    c = V.table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" up 42% to $1.2T, about "), F.col("conv_id").cast("string"), F.lit(" names, 3 of 2019")).alias("text"))
    facts = T.numbers(F.concat(F.lit("share 41.9% names "), F.col("conv_id").cast("string")))
    return c.select("conv_id", "turn", F.array_join(T.ungrounded(T.numbers(F.col("text")), facts), " ").alias("ungrounded"))


@query()
def business_excerpts(spark, sf):
    return T.excerpts(V.filings(spark, sf).select("acc", "text")).select("acc", "method", F.length("excerpt").cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN abs(v) >= 1e9 THEN '$' || printf('%.1f', round_even(v / 1e9, 1)) || 'B' WHEN abs(v / 1e6) >= 100 THEN '$' || round_even(v / 1e6, 0)::BIGINT || 'M' WHEN abs(v) >= 1e6 THEN '$' || printf('%.1f', round_even(v / 1e6, 1)) || 'M' ELSE '$' || format('{:,}', round_even(v, 0)::BIGINT) END AS money, CASE WHEN p % 100 BETWEEN 10 AND 20 THEN p || 'th' ELSE p || CASE p % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS place, isoyear(d) || '-W' || lpad(week(d)::VARCHAR, 2, '0') AS week FROM (SELECT o_orderkey, o_totalprice * 3e4 AS v, o_orderkey % 130 AS p, o_orderdate::DATE AS d FROM orders)")
def text_formats(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", S.money(F.col("o_totalprice") * 3e4).alias("money"), S.ordinal(F.col("o_orderkey") % 130).alias("place"), S.iso_week(F.to_date("o_orderdate")).alias("week"))


# ---- stores ----

SNAP = "snap AS (SELECT user_id AS ticker, date_trunc('week', ts)::DATE AS date, arg_max(event_type = 'purchase', (ts, event_id)) AS trend, count(*) AS n FROM events GROUP BY ALL)"


def _snaps(spark, sf):
    e = V.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("ticker"), F.date_trunc("week", "ts").cast("date").alias("date")).agg(F.max_by(F.col("event_type") == "purchase", F.struct("ts", "event_id")).alias("trend"), F.count(F.lit(1)).alias("n"))


@query(chain(SNAP) + "SELECT ticker, max(date) AS date, arg_max(trend, date) AS trend, arg_max(n, date) AS n FROM snap GROUP BY 1")
def latest_snapshot(spark, sf):
    return ST.latest(_snaps(spark, sf))


@query(chain(SNAP) + ", d AS (SELECT max(date) AS b FROM snap), e AS (SELECT max(date) AS a FROM snap, d WHERE date <= b - 5) SELECT x.ticker, CASE WHEN x.trend THEN 'up' ELSE 'down' END AS change FROM snap x JOIN d ON x.date = b JOIN (SELECT s.ticker, s.trend FROM snap s JOIN e ON s.date = a) y USING (ticker) WHERE x.trend <> y.trend")
def trend_changes(spark, sf):
    return ST.changes(_snaps(spark, sf))


@query(chain(SNAP) + ", nw AS (SELECT ticker, date, NOT trend AS trend, n + 1 AS n FROM snap WHERE ticker % 3 = 0) SELECT * FROM nw UNION ALL SELECT * FROM snap ANTI JOIN nw USING (ticker, date)")
def upsert_replace(spark, sf):
    s = _snaps(spark, sf)
    return ST.upsert(s, s.filter("ticker % 3 = 0").select("ticker", "date", (~F.col("trend")).alias("trend"), (F.col("n") + 1).alias("n")), ["ticker", "date"])


@query(chain(SNAP) + ", o AS (SELECT * FROM snap WHERE ticker % 4 <> 0), nw AS (SELECT ticker, date, trend, n * 2 AS n FROM snap) SELECT * FROM o UNION ALL SELECT * FROM nw ANTI JOIN o USING (ticker, date)")
def insert_if_absent(spark, sf):
    s = _snaps(spark, sf)
    return ST.insert_absent(s.filter("ticker % 4 <> 0"), s.withColumn("n", F.col("n") * 2), ["ticker", "date"])


@query(chain(V.PANEL) + ", nw AS (SELECT ticker, d, close * 0.5 AS close FROM panel WHERE ticker IN ('S1', 'S7') AND d < DATE '1999-01-01') SELECT ticker, count(*) AS n, round(sum(close), 4) AS total FROM (SELECT ticker, d, close FROM nw UNION ALL SELECT ticker, d, close FROM panel WHERE ticker NOT IN ('S1', 'S7')) GROUP BY 1")
def replace_history(spark, sf):
    p = panel(spark, sf).select("ticker", "d", "close")
    new = p.filter("ticker in ('S1', 'S7') and d < '1999-01-01'").withColumn("close", F.col("close") * 0.5)
    return ST.replace_history(p, new).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query(chain(V.PANEL) + "SELECT DISTINCT 'S' || p_size AS ticker FROM part ANTI JOIN (SELECT p_size FROM part JOIN (SELECT DISTINCT ticker FROM panel WHERE d > DATE '2001-10-25') x ON x.ticker = 'S' || p_size) USING (p_size)")
def download_failures(spark, sf):
    req = V.table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("ticker"))
    return ST.failures(req, panel(spark, sf).filter("d > '2001-10-25'").select("ticker"))


@query(chain(V.PANEL) + ", w AS (SELECT d, ticker, close FROM panel) SELECT ticker, d, round(close, 6) AS close FROM w WHERE close IS NOT NULL")
def wide_to_long(spark, sf):
    wide = panel(spark, sf).groupBy("d").pivot("ticker").agg(F.first("close"))
    return r6(ST.unpivot_closes(wide))


# ---- ledgers and performance ----

MPX = 'mpx AS (SELECT ticker, d, "full" AS px FROM filled SEMI JOIN me USING (d) WHERE "full" IS NOT NULL)'
BENCHM = f"{V.BENCH}, mb2 AS (SELECT d, close AS px FROM bench SEMI JOIN me USING (d))"


def _bench_months(spark, sf):
    p = panel(spark, sf)
    return V.benchmark_series(p).join(ends(spark, sf), "d", "left_semi").select("d", F.col("close").alias("px"))


def _dca(spark, sf):
    return M.dca(_bench_months(spark, sf).withColumn("scenario", F.lit("dca")), ["scenario"])


DCA = "dca AS (SELECT d, sum(2500.0 / px) OVER (ORDER BY d) * px AS value FROM mb2)"


@query(chain(V.PANEL, CAL, ME, BENCHM, DCA) + "SELECT d, round(value, 4) AS value FROM dca")
def dca_closed_form(spark, sf):
    return _dca(spark, sf).select("d", F.round("value", 4).alias("value"))


EW = """n AS (SELECT m.ticker, m.d, f."full" AS px, m.eligible, sum(m.eligible::INT) OVER (PARTITION BY m.d) AS n FROM mfac m JOIN filled f USING (ticker, d) WHERE m.d >= (SELECT min(d) FROM mfac WHERE eligible)),
sh AS (SELECT *, sum(CASE WHEN eligible AND px > 0 THEN 2500.0 * (1 - 0.0015) / n / px ELSE 0 END) OVER (PARTITION BY ticker ORDER BY d) AS sh FROM n), ew AS (SELECT d, sum(sh * px) AS value FROM sh GROUP BY d)"""


def _ew_prices(spark, sf):
    m = from_first(mfac(spark, sf)).select("ticker", "d", "eligible")
    return m.join(filled(spark, sf).select("ticker", "d", F.col("full").alias("px")), ["ticker", "d"])


@query(chain(*FULL, EW) + "SELECT d, round(value, 4) AS value FROM ew")
def ew_hold_closed_form(spark, sf):
    return L.ew_hold(_ew_prices(spark, sf)).select("d", F.round("value", 4).alias("value"))


@query(chain(V.PANEL, V.HOLDINGS) + """, b AS (SELECT 'S' || (c_custkey % 30 + 1) AS ticker, sum(2.0) AS s1, avg(100 + c_custkey % 7) AS p1 FROM customer GROUP BY 1)
SELECT ticker, coalesce(shares, 0) + coalesce(s1, 0) AS shares, round((coalesce(shares, 0) * coalesce(cost, 0) + coalesce(s1, 0) * coalesce(p1, 0)) / (coalesce(shares, 0) + coalesce(s1, 0)), 6) AS cost FROM holdings FULL JOIN b USING (ticker)""")
def weighted_cost_merge(spark, sf):
    h = V.holdings(spark, sf, panel(spark, sf))
    b = V.table(spark, sf, "customer").select(F.concat(F.lit("S"), (F.col("c_custkey") % 30 + 1).cast("string")).alias("ticker"), F.lit(2.0).alias("shares"), (100 + F.col("c_custkey") % 7).cast("double").alias("price"))
    return r6(L.merge_purchase(h, b))


@query(chain(*FULL, MPX).replace("WITH ", "WITH RECURSIVE ", 1) + """, p0 AS (SELECT ticker, px, substr(ticker, 2)::INT AS n, dense_rank() OVER (ORDER BY d) AS m FROM mpx WHERE d >= DATE '2000-01-01'),
st AS (SELECT 0::BIGINT AS m, ticker, substr(ticker, 2)::INT AS n, 0::DOUBLE AS shares, 0::DOUBLE AS basis, 0::DOUBLE AS cash FROM (SELECT DISTINCT ticker FROM p0)
  UNION ALL SELECT m::BIGINT, ticker, n, CASE WHEN gone THEN 0 ELSE shares END + CASE WHEN buy THEN budget / nb * (1 - 0.0015) / px ELSE 0 END, CASE WHEN gone THEN 0 ELSE basis END + CASE WHEN buy THEN budget / nb ELSE 0 END, CASE WHEN nb > 0 THEN 0 ELSE budget END
  FROM (SELECT *, 2500 + cash + sum(CASE WHEN gone THEN shares * px * (1 - 0.0015) ELSE 0 END) OVER () AS budget, count(*) FILTER (buy) OVER () AS nb
    FROM (SELECT st.m + 1 AS m, st.ticker, st.n, px, shares, basis, cash, shares > 0 AND px IS NOT NULL AND (st.n + st.m + 1) % 4 = 0 AS gone, coalesce(px > 0, false) AND (st.n + st.m + 1) % 3 = 0 AS buy
      FROM st LEFT JOIN p0 ON p0.m = st.m + 1 AND p0.ticker = st.ticker WHERE st.m < (SELECT max(m) FROM p0))))
SELECT ticker, round(shares, 6) AS shares, round(basis, 4) AS basis FROM st WHERE m = (SELECT max(m) FROM p0) AND shares > 0""")
def decision_replay(spark, sf):
    px = filled(spark, sf).join(ends(spark, sf), "d", "left_semi").filter("d >= '2000-01-01' and `full` is not null").select("ticker", "d", F.col("full").alias("px"))
    g = px.groupBy(F.col("d").alias("month")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "px")))).alias("px"))
    g = g.withColumn("m", F.row_number().over(Window.orderBy("month")))
    every = lambda k: F.filter(F.map_keys("px"), lambda t: (F.substring(t, 2, 9).cast("int") + F.col("m")) % k == 0)
    s = L.replay(g.select(F.lit("b").alias("strategy"), "month", every(4).alias("sells"), every(3).alias("buys"), "px", F.lit(2500.0).alias("contrib")), ["strategy"])
    e = s.select(F.explode("state.shares").alias("ticker", "shares"), "state")
    return e.select("ticker", F.round(F.col("shares") + 1e-9, 6).alias("shares"), F.round(F.element_at("state.basis", F.col("ticker")), 4).alias("basis"))


def _ew_ledger(spark, sf):
    return L.ew_hold(_ew_prices(spark, sf)).select(F.lit("ew").alias("scenario"), F.col("d").alias("exec"), F.lit(2500.0).alias("contribution"), "value")


def _dca_ledger(spark, sf):
    return _dca(spark, sf).select("scenario", F.col("d").alias("exec"), F.lit(2500.0).alias("contribution"), "value")


LEDGER = f"ledger AS (SELECT 'dca' AS scenario, d AS exec, 2500.0 AS contribution, value FROM dca)"
TWR = "twr AS (SELECT *, (value - contribution) / lag(value) OVER (PARTITION BY scenario ORDER BY exec) - 1 AS r FROM ledger)"
DCAS = (V.PANEL, CAL, ME, BENCHM, DCA, LEDGER, TWR)


@query(chain(*DCAS) + "SELECT exec, round(r, 6) AS r FROM twr")
def twr_monthly(spark, sf):
    return r6(M.twr(_dca_ledger(spark, sf), ["scenario"]).select("exec", "r"))


@query(chain(*DCAS) + "SELECT year(exec)::INT AS year, round(product(1 + r) - 1, 6) AS ret FROM twr WHERE r IS NOT NULL GROUP BY 1")
def twr_yearly(spark, sf):
    return r6(M.yearly(M.twr(_dca_ledger(spark, sf), ["scenario"]), ["scenario"]).select("year", "ret"))


@query(chain(*DCAS) + "SELECT scenario, count(r) AS n, round(product(1 + r) ** (12.0 / count(r)) - 1, 6) AS cagr, round(stddev_samp(r) * sqrt(12.0), 6) AS vol, round(avg(r) * 12 / (stddev_samp(r) * sqrt(12.0)), 6) AS sharpe FROM twr WHERE r IS NOT NULL GROUP BY 1")
def cagr_vol_sharpe(spark, sf):
    return r6(M.growth(M.twr(_dca_ledger(spark, sf), ["scenario"]), ["scenario"]))


@query(chain(*DCAS) + ", i AS (SELECT exec, product(1 + r) OVER (ORDER BY exec) AS idx FROM twr WHERE r IS NOT NULL), j AS (SELECT *, greatest(1.0, max(idx) OVER (ORDER BY exec)) AS top FROM i) SELECT 'dca' AS scenario, round(least(0.0, min(idx / top - 1)), 6) AS max_dd FROM j")
def max_drawdown(spark, sf):
    return r6(M.drawdown(M.twr(_dca_ledger(spark, sf), ["scenario"]), ["scenario"]))


_NW = " + ".join(f"2 * (1 - {j} / 7.0) * sum(e * coalesce(l{j}, 0))" for j in range(1, 7))
_LAGS = ", ".join(f"lag(e, {j}) OVER (ORDER BY exec) AS l{j}" for j in range(1, 7))


@query(chain(*DCAS) + f", e AS (SELECT exec, r, r - avg(r) OVER () AS e FROM twr WHERE r IS NOT NULL), l AS (SELECT *, {_LAGS} FROM e), s AS (SELECT count(*) AS n, avg(r) AS m, (sum(e * e) + {_NW}) / count(*) AS s FROM l) SELECT 'dca' AS scenario, round(CASE WHEN s > 0 THEN m / sqrt(s / n) END, 6) AS t FROM s")
def newey_west_t(spark, sf):
    t = M.twr(_dca_ledger(spark, sf), ["scenario"]).filter("r is not null").withColumnRenamed("r", "x")
    return r6(M.newey_west(t, ["scenario"], "exec"))


_XIRR = """fl AS (SELECT scenario, (exec - min(exec) OVER (PARTITION BY scenario)) / 365.0 AS t, -contribution + CASE WHEN row_number() OVER (PARTITION BY scenario ORDER BY exec DESC) = 1 THEN value ELSE 0 END AS f FROM ledger),
fs2 AS (SELECT scenario, list(t) AS ts, list(f) AS fs FROM fl GROUP BY 1),
bi AS (SELECT scenario, list_reduce(list_prepend({'lo': -0.9999::DOUBLE, 'hi': 100::DOUBLE}, list_transform(range(100), lambda i: {'lo': 0::DOUBLE, 'hi': 0::DOUBLE})), lambda s, x: CASE WHEN
  list_sum(list_transform(range(1, len(ts) + 1), lambda k: fs[k] / (1 + s.lo) ** ts[k])) * list_sum(list_transform(range(1, len(ts) + 1), lambda k: fs[k] / (1 + (s.lo + s.hi) / 2) ** ts[k])) <= 0
  THEN {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} ELSE {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} END) AS s FROM fs2)"""


@query(chain(V.PANEL, CAL, ME, BENCHM, DCA, LEDGER, _XIRR) + "SELECT scenario, round((s.lo + s.hi) / 2, 6) AS xirr FROM bi")
def xirr_bisection(spark, sf):
    return r6(M.ledger_xirr(_dca_ledger(spark, sf), ["scenario"]))


@query(chain(*FULL) + ", n AS (SELECT d, sum(eligible::INT) AS n FROM mfac GROUP BY d) SELECT year(d)::INT AS year, min(n)::BIGINT AS lo, floor(median(n))::BIGINT AS mid, max(n)::BIGINT AS hi FROM n GROUP BY 1")
def eligible_by_year(spark, sf):
    n = mfac(spark, sf).groupBy("d").agg(F.sum(F.col("eligible").cast("int")).alias("n"))
    return n.groupBy(F.year("d").alias("year")).agg(F.min("n").alias("lo"), F.floor(F.median("n")).alias("mid"), F.max("n").alias("hi"))


@query(chain(V.LISTINGS, ELIG, OWN, STATED, CLAIMS) + "SELECT coalesce(year::VARCHAR, 'all') AS year, coalesce(status, 'all') AS status, n, priced FROM (SELECT year, status, count(*) AS n, count(ticker) AS priced FROM mapped GROUP BY ROLLUP (year, status))")
def coverage_by_year_rollup(spark, sf):
    return _mapped(spark, sf).rollup("year", "status").agg(F.count(F.lit(1)).alias("n"), F.count("ticker").alias("priced")).select(F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("year"), F.coalesce("status", F.lit("all")).alias("status"), "n", "priced")


@query(chain(*FULL, V.BENCH, V.HOLDINGS) + """, pk AS (SELECT ticker, DATE '1997-03-05' + (shares::INT * 60) AS picked FROM holdings), lastp AS (SELECT max(d) AS d FROM cal),
x AS (SELECT pk.ticker, picked, (SELECT arg_max("full", d) FROM filled f WHERE f.ticker = pk.ticker AND f.d <= picked) AS p0, (SELECT arg_max(close, d) FROM bench b WHERE b.d <= picked) AS b0 FROM pk)
SELECT x.ticker, picked, round(f."full" / p0 - 1, 6) AS ret, round(b.close / b0 - 1, 6) AS bench_ret FROM x, lastp JOIN filled f ON f.d = lastp.d JOIN bench b ON b.d = lastp.d WHERE f.ticker = x.ticker""")
def track_record_vs_benchmark(spark, sf):
    p = panel(spark, sf)
    f = filled(spark, sf).select("ticker", "d", F.col("full").alias("px"))
    picks = V.holdings(spark, sf, p).select("ticker", F.date_add(F.lit("1997-03-05").cast("date"), (F.col("shares") * 60).cast("int")).alias("picked"))
    b = V.benchmark_series(p).select(F.lit("b").alias("k"), "d", "close")
    x = P.asof_join(picks, f.filter("px is not null").select("ticker", F.col("d").alias("t"), "px"), "ticker", "picked", "t", "px", "p0")
    x = P.asof_join(x.withColumn("k", F.lit("b")), b.select("k", F.col("d").alias("t"), "close"), "k", "picked", "t", "close", "b0")
    last = P.calendar(p).agg(F.max("d").alias("d"))
    end = f.join(last, "d").select("ticker", F.col("px").alias("p1")), b.join(last, "d").select("k", F.col("close").alias("b1"))
    return r6(x.join(end[0], "ticker").join(end[1], "k").select("ticker", "picked", (F.try_divide("p1", "p0") - 1).alias("ret"), (F.try_divide("b1", "b0") - 1).alias("bench_ret")))


@query(chain(*BASE, FILLED, V.HOLDINGS) + """, l AS (SELECT ticker, "full" AS px FROM filled WHERE d = (SELECT max(d) FROM cal)) SELECT ticker, round(shares * px, 4) AS value, round(shares * px / sum(shares * px) OVER (), 6) AS weight, round(px / nullif(cost, 0) - 1, 6) AS pl FROM holdings JOIN l USING (ticker)""")
def holdings_pnl(spark, sf):
    p = panel(spark, sf)
    last = P.calendar(p).agg(F.max("d").alias("d"))
    px = filled(spark, sf).join(last, "d").select("ticker", F.col("full").alias("px"))
    h = V.holdings(spark, sf, p).join(px, "ticker").withColumn("v", F.col("shares") * F.col("px"))
    return h.select("ticker", F.round("v", 4).alias("value"), F.round(F.col("v") / F.sum("v").over(Window.partitionBy()) + 1e-9, 6).alias("weight"), F.round(F.try_divide("px", "cost") - 1 + 1e-9, 6).alias("pl"))


@query("""WITH x AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer) SELECT k, round(quantile_cont(v, 0.6), 6) AS p60, round(quantile_cont(v, 0.75), 6) AS p75, round(median(v), 6) AS med,
  round(100 * avg(CASE WHEN v < 1000 THEN 1.0 WHEN v = 1000 THEN 0.5 ELSE 0 END), 6) AS percentile FROM x GROUP BY 1""")
def midrank_and_exact_percentiles(spark, sf):
    x = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    one = lambda q, name: F.max(F.when(F.col("q") == q, F.col("v"))).alias(name)
    q = M.exact_quantiles(x, ["k"], "v", [0.5, 0.6, 0.75]).groupBy("k").agg(one(0.6, "p60"), one(0.75, "p75"), one(0.5, "med"))
    return r6(q.join(M.midrank(x, ["k"], "v", F.lit(1000.0)), "k"))


@query(chain(*FULL) + """, m AS (SELECT d, max(d) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM me WHERE d IN (SELECT d FROM mfac WHERE eligible)), first AS (SELECT min(d) AS m0 FROM mfac WHERE eligible),
dy AS (SELECT c.d, c.rn, coalesce((SELECT max(m.d) FROM m WHERE m.d < c.d), m0) AS prev FROM cal c, first),
ew AS (SELECT f.d, avg(f.ret) AS ew FROM fac f JOIN dy USING (d) JOIN mfac e ON e.d = dy.prev AND e.ticker = f.ticker AND e.eligible GROUP BY f.d),
lv AS (SELECT dy.d, dy.rn, 100 * product(1 + coalesce(ew, 0)) OVER (ORDER BY dy.d) AS level FROM dy LEFT JOIN ew USING (d)),
cl AS (SELECT * FROM (VALUES (9, 2001, DATE '2001-07-10', true), (10, 2001, DATE '2001-09-12', false)) v(cik, y, e, nasdaq)),
at0 AS (SELECT cl.*, (SELECT min(rn) FROM cal WHERE d >= make_date(cl.y::BIGINT, 1, 1)) AS at_ FROM cl),
s AS (SELECT at0.*, lv.d, lv.rn, level, lag(level) OVER w AS pv, lead(level) OVER w IS NULL AS last FROM at0 JOIN lv ON lv.rn >= greatest(at_ - 280, 1) AND lv.d <= e WINDOW w AS (PARTITION BY cik ORDER BY rn))
SELECT 'C' || cik AS ticker, d, round(ln(CASE WHEN last AND pv IS NOT NULL THEN pv * CASE WHEN nasdaq THEN 0.45 ELSE 0.7 END ELSE level END), 6) AS log_close FROM s""")
def stress_clones(spark, sf):
    f = fac(spark, sf)
    el = f.join(ends(spark, sf), "d", "left_semi").filter("eligible").select("ticker", "d")
    cl = spark.createDataFrame([(9, 2001, "2001-07-10", True), (10, 2001, "2001-09-12", False)], "cik int, year int, e string, nasdaq boolean").select("cik", "year", F.to_date("e").alias("end"), "nasdaq")
    d = FI.stress_clones(f.select("ticker", "d", "ret"), el, P.calendar(panel(spark, sf)), cl)
    return r6(d.select("ticker", "d", F.log("close").alias("log_close")))


# ---- scenarios ----


def context(spark, sf) -> DataFrame:
    """One row a month, ticker and weights with all that a scenario reads; the filled panel is computed once."""
    p = panel(spark, sf)
    cal = P.calendar(p)
    f = filled(spark, sf)
    ends_ = P.month_ends(cal)
    m = FA.below_before(FA.factors(f).join(ends_, "d", "left_semi").join(V.traits(spark, sf), "ticker", "left"))
    v1 = FA.monthly_sma(m.drop("below")).withColumnsRenamed({"level": "v1_level", "up": "v1_up", "below": "v1_below"})
    v2 = FA.band(v1).withColumnsRenamed({"up": "v2_up", "below": "v2_below"}).withColumn("v2_level", F.col("sma200"))
    w = Window.partitionBy("ticker").orderBy("d")
    s = v2.withColumn("v1_below_prev", S.flag(F.lag("v1_below").over(w))).withColumn("v2_below_prev", S.flag(F.lag("v2_below").over(w)))
    s = s.join(FA.fip(f).select("ticker", "d", "fip"), ["ticker", "d"])
    s = SC.score(s.withColumn("weights", F.explode(F.array(*map(F.lit, SC.WEIGHTS)))), None, by=("weights", "d"))
    v3 = SE.fip_pool(s, ("weights", "d")).select("weights", "ticker", "d", F.lit(True).alias("v3_in"))
    reg = FA.regime(m, V.benchmark_series(p)).select("d", "brake")
    px = f.select("ticker", F.col("d").alias("exec"), F.col("full").alias("px"))
    mark = f.select("ticker", "d", F.col("full").alias("mark"))
    x = P.fill_dates(cal).filter("exec is not null")
    s = s.join(v3, ["weights", "ticker", "d"], "left").withColumn("v3_in", S.flag(F.col("v3_in"))).join(reg, "d").join(x, "d").join(px, ["ticker", "exec"]).join(mark, ["ticker", "d"])
    return from_first(s).select(
        "weights", "ticker", "grp", "d", "exec", "ord", "eligible", "trend", "composite", "above200", "sma200", "below_prev", "speculative", "brake", "px", "mark", "v1_level", "v1_up", "v1_below", "v1_below_prev", "v2_level", "v2_up", "v2_below", "v2_below_prev", "v3_in").persist()


def grid_rows() -> list[tuple]:
    """Thirty-six configurations of sells, gates, buys and weights, and the equal-weight and rotation references."""
    rows = [(f"{w}-{g}-{s}-{b}", "rank", w, s, g, b, 0, 0, 0) for w in SC.WEIGHTS for g in ("G0", "G1") for s in ("S1", "S2", "S3") for b in ("Nvar", "N3")]
    return rows + [(p, p, "W2", "S2", "G1", "B0R", 0, 0, 0) for p in ("ew_all", "ew_trend", "ew_trend10", "b0h", "v1", "v2", "v3")]


def grid_scenarios(spark) -> DataFrame:
    return spark.createDataFrame(grid_rows(), "scenario string, pick string, weights string, sell string, gate string, buy string, seed int, sim int, n int")


#: Random portfolios of a pool, in each query that compares with them.
DRAWS = 1000


#: The scenario that a pool's draws are compared with: they buy as many names a month, and random and random_all follow its sells.
COMPARED = {"random_up": "ew_trend10", "random": "W2-G1-S3-Nvar", "random_all": "W2-G1-S3-Nvar"}


def random_scenarios(spark, sims: int, seed: int = 11, pick: str = "random_up") -> DataFrame:
    sell = "S2" if pick == "random_up" else "S3"
    return spark.range(sims).select(F.concat(F.lit(f"{pick}-"), F.col("id").cast("string")).alias("scenario"), F.lit(pick).alias("pick"), F.lit("W2").alias("weights"), F.lit(sell).alias("sell"), F.lit("G1").alias("gate"), F.lit("B0R").alias("buy"), F.lit(seed).alias("seed"), F.col("id").cast("int").alias("sim"), F.lit(5).alias("n"))


def _buys_made(spark, ctx: DataFrame) -> dict[str, dict[str, int]]:
    """Names bought in each month by the compared scenario of each pool: some hundred months."""
    led = L.simulate(grid_scenarios(spark).filter(F.col("scenario").isin(*COMPARED.values())), ctx)
    made: dict[str, dict[str, int]] = {}
    for r in led.select("scenario", "d", "n_buys").collect():
        made.setdefault(r["scenario"], {})[str(r["d"])] = r["n_buys"]
    return {pick: made.get(s, {}) for pick, s in COMPARED.items()}


def _summary(led: DataFrame) -> DataFrame:
    r = M.twr(led, ["scenario"])
    return M.ledger_xirr(led, ["scenario"]).join(M.growth(r, ["scenario"]), "scenario", "left").join(M.drawdown(r, ["scenario"]), "scenario", "left")


CONTEXT_SQL = (*FULL, V.TRAITS, REGIME, LS.context_sql(pct_sql))
GRID_SQL = f"gsc AS {LS.values([r[:8] for r in grid_rows()])}"
POOLS = {"random_up": ("S2", 11), "random": ("S3", 11), "random_all": ("S3", 13)}


def draws_sql(pools: tuple[str, ...]) -> str:
    """rsc: the random scenarios of some pools; made: what the scenario that each is compared with bought, from the ledgers of stg."""
    each = " UNION ALL ".join(f"SELECT '{p}-' || i AS scenario, '{p}' AS pick, 'W2' AS weights, '{POOLS[p][0]}' AS sell, 'G1' AS gate, 'B0R' AS buy, {POOLS[p][1]} AS seed, i AS sim FROM range({DRAWS}) t(i)" for p in pools)
    made = " UNION ALL ".join(f"SELECT '{p}' AS pick, k, n_buys AS n FROM stg_led WHERE scenario = '{COMPARED[p]}'" for p in pools)
    return f"rsc AS ({each}), made AS ({made})"


def chain_r(*parts: str) -> str:
    return chain(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query(chain_r(*CONTEXT_SQL, GRID_SQL, LS.fold_sql("stg", "gsc"), LS.returns_sql("stg_led")) + """SELECT xr.scenario, round(xirr, 6) AS xirr, n, round(cagr, 6) AS cagr, round(vol, 6) AS vol, round(sharpe, 6) AS sharpe, round(max_dd, 6) AS max_dd
FROM xr LEFT JOIN gw USING (scenario) LEFT JOIN dd USING (scenario)""")
def rule_simulation(spark, sf):
    return r6(_summary(L.simulate(grid_scenarios(spark), context(spark, sf))))


@query(chain_r(*CONTEXT_SQL, GRID_SQL, LS.fold_sql("stg", "gsc"), LS.returns_sql("stg_led")) + """, r AS (SELECT xr.scenario AS name, xirr, max_dd, string_split(xr.scenario, '-') AS c FROM xr LEFT JOIN dd USING (scenario))
SELECT c[1] AS weights, c[2] AS gate, c[3] AS sell, name FROM r WHERE len(c) = 4 AND xirr IS NOT NULL AND max_dd >= (SELECT max_dd FROM r WHERE name = 'ew_all') - 0.1
ORDER BY round(xirr, 10) DESC, list_position(['S1', 'S2', 'S3'], c[3]), list_position(['G0', 'G1'], c[2]), list_position(['W3', 'W1', 'W2'], c[1]), name LIMIT 1""")
def config_select(spark, sf):
    """The configuration of the grid with the best return whose drawdown is at most ten points worse than the equal-weight one's."""
    r = _summary(L.simulate(grid_scenarios(spark), context(spark, sf))).persist()
    c = F.split("scenario", "-")
    floor = r.filter("scenario = 'ew_all'").first()["max_dd"]
    grid_ = r.filter(F.size(c) == 4).select(c[0].alias("weights"), c[1].alias("gate"), c[2].alias("sell"), F.col("scenario").alias("name"), "xirr", "max_dd")
    return SE.select_config(grid_, F.lit(floor) - 0.1).select("weights", "gate", "sell", "name")


@query(chain(*FULL) + """, x AS (SELECT d, lead(d) OVER (ORDER BY d) AS exec FROM cal), e AS (SELECT m.ticker, x.exec, f."full" AS px, m.eligible, sum(m.eligible::INT) OVER (PARTITION BY m.d) AS n FROM mfac m JOIN x USING (d) JOIN filled f ON f.ticker = m.ticker AND f.d = x.exec WHERE m.d >= (SELECT min(d) FROM mfac WHERE eligible)),
sh AS (SELECT *, sum(CASE WHEN eligible AND px > 0 THEN 2500.0 * (1 - 0.0015) / n / px ELSE 0 END) OVER (PARTITION BY ticker ORDER BY exec) AS sh FROM e) SELECT exec, round(sum(sh * px), 4) AS value FROM sh GROUP BY 1""")
def simulation_equals_closed_form(spark, sf):
    one = grid_scenarios(spark).filter("scenario = 'ew_all'")
    return L.simulate(one, context(spark, sf)).select("exec", F.round("value", 4).alias("value"))


@query(chain_r(*CONTEXT_SQL, GRID_SQL, LS.fold_sql("stg", "gsc"), draws_sql(tuple(POOLS)), LS.fold_sql("str", "rsc", "made"), LS.returns_sql("str_led")) + "SELECT xr.scenario, round(xirr, 6) AS xirr, round(max_dd, 6) AS max_dd FROM xr LEFT JOIN dd USING (scenario)")
def random_portfolios(spark, sf):
    ctx = context(spark, sf)
    draws = random_scenarios(spark, DRAWS).unionByName(random_scenarios(spark, DRAWS, pick="random")).unionByName(random_scenarios(spark, DRAWS, 13, "random_all"))
    return r6(_summary(L.simulate(draws, ctx, buys_made=_buys_made(spark, ctx))).select("scenario", "xirr", "max_dd"))


@query(chain_r(*CONTEXT_SQL, GRID_SQL, LS.fold_sql("stg", "gsc"), draws_sql(("random_up",)), LS.fold_sql("str", "rsc", "made"), "all_led AS (SELECT * FROM stg_led UNION ALL SELECT * FROM str_led)", LS.returns_sql("all_led")) + """
, g AS (SELECT max(xirr) FILTER (scenario = 'ew_trend10') AS b0r, max(xirr) FILTER (scenario = 'ew_all') AS ew, max(xirr) FILTER (scenario = 'b0h') AS b0h, quantile_cont(xirr, 0.6) FILTER (scenario LIKE 'random_up%') AS p60 FROM xr)
SELECT b0r >= ew AS beats_ew, b0r >= p60 AS ge_p60_random, b0r >= b0h AS beats_hold, b0r >= ew AND b0r >= p60 AND b0r >= b0h AS ship FROM g""")
def gates(spark, sf):
    ctx = context(spark, sf)
    led = L.simulate(grid_scenarios(spark).unionByName(random_scenarios(spark, DRAWS)), ctx, buys_made=_buys_made(spark, ctx))
    x = kept(M.ledger_xirr(led, ["scenario"]), "xirrs")
    one = lambda s: F.max(F.when(F.col("scenario") == s, F.col("xirr")))
    p60 = M.exact_quantiles(x.filter(F.col("scenario").startswith("random_up")), [], "xirr", [0.6]).select(F.col("xirr").alias("p60"))
    g = x.agg(one("ew_trend10").alias("b0r"), one("ew_all").alias("ew"), one("b0h").alias("b0h")).crossJoin(p60)
    tests = F.struct((F.col("b0r") >= F.col("ew")).alias("beats_ew"), (F.col("b0r") >= F.col("p60")).alias("ge_p60_random"), (F.col("b0r") >= F.col("b0h")).alias("beats_hold"))
    return g.select(tests.alias("t")).select("t.*", (F.col("t.beats_ew") & F.col("t.ge_p60_random") & F.col("t.beats_hold")).alias("ship"))


# ---- streaming ----


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    from tidemark.streaming import windows

    return windows.window_counts(windows.distinct_events(V.table(spark, sf, "events"))).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    from tidemark.streaming import windows

    return windows.sessions(windows.distinct_events(V.table(spark, sf, "events"))).withColumn("total", F.round("total", 4))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def quota_windows(spark, sf):
    from tidemark.streaming import shadow

    return shadow.quota_use(V.table(spark, sf, "events").withColumn("key", F.col("user_id"))).select("event_id", "in_window")


@query("""WITH RECURSIVE q AS (SELECT user_id AS k, event_id, floor(epoch(ts))::BIGINT AS ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
a(k, i, event_id, run_at, seen) AS (SELECT k, i, event_id, ts, [ts] FROM q WHERE i = 1 UNION ALL SELECT q.k, q.i, q.event_id, x.run_at, list_append(a.seen, x.run_at)[-20:]
  FROM a JOIN q ON q.k = a.k AND q.i = a.i + 1, LATERAL (SELECT greatest(q.ts, a.seen[-1], CASE WHEN len(a.seen) >= 5 THEN a.seen[-5] + 3600 ELSE 0 END, CASE WHEN len(a.seen) >= 20 THEN a.seen[-20] + 86400 ELSE 0 END) AS run_at) x)
SELECT event_id, k AS user_id, i AS place, run_at FROM a""")
def quota_admissions(spark, sf):
    """Every event as a request of its user, under five an hour and twenty a day, in two runs: the second goes on from the first one's tail."""
    from tidemark.streaming import quotas as Q

    limits = ((5, 3600), (20, 86400))
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    half = e.agg((F.max("seq") / 2).alias("x")).first()["x"] or 0
    first = Q.admit(e.filter(F.col("seq") <= half), None, limits)
    both = first.unionByName(Q.admit(e.filter(F.col("seq") > half), Q.tail_of(first, limits), limits))
    return both.select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "place", F.col("at").alias("run_at"))


@query("""WITH p AS (SELECT 'u' || (user_id % 4) AS strategy, strftime(ts, '%Y-%m-%d') AS month, ts::DATE + 3 AS fill_date FROM events GROUP BY ALL), l AS (SELECT * FROM p WHERE month < '2024-01-10')
SELECT strategy, month, fill_date FROM p ANTI JOIN l USING (strategy, month) WHERE fill_date < DATE '2024-01-25'""")
def shadow_due(spark, sf):
    from tidemark.streaming import shadow

    e = V.table(spark, sf, "events")
    p = e.select(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("strategy"), F.date_format("ts", "yyyy-MM-dd").alias("month"), F.date_add(F.to_date("ts"), 3).alias("fill_date")).distinct()
    return shadow.due(p, p.filter("month < '2024-01-10'"), "2024-01-25").select("strategy", "month", "fill_date")


@query(chain(V.TRAITS) + ", u AS (SELECT DISTINCT 'S' || p_size AS ticker, p_size % 4 AS c FROM part) SELECT c, arg_min(u.ticker, rk) FILTER (gp_assets IS NOT NULL) AS best, count(*) FILTER (rev_chg > 0) AS up, count(*) AS n FROM (SELECT u.*, gp_assets, rev_chg, row_number() OVER (ORDER BY gp_assets DESC NULLS LAST, u.ticker) AS rk FROM u LEFT JOIN traits USING (ticker)) u GROUP BY c")
def category_rows(spark, sf):
    u = V.table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("ticker"), (F.col("p_size") % 4).cast("long").alias("c")).distinct()
    d = u.join(V.traits(spark, sf), "ticker", "left").withColumn("rk", F.row_number().over(Window.orderBy(F.col("gp_assets").desc_nulls_last(), "ticker")))
    return d.groupBy("c").agg(F.min_by("ticker", F.when(F.col("gp_assets").isNotNull(), F.col("rk"))).alias("best"), F.count_if(F.col("rev_chg") > 0).alias("up"), F.count(F.lit(1)).alias("n"))
