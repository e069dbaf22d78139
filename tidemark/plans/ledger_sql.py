"""SQL twin of the scenario ledgers: the month context, a recursive fold over months, and the summary of its ledgers."""

from __future__ import annotations

from tidemark.operators.ledger import CONTRIB, COST, MIN_SCORED
from tidemark.operators.score import BUY, HOLD, WEIGHTS
from tidemark.operators.select import BRAKED, CAP_GROUP, CAP_POSITION, CAP_SPEC, CAP_SPEC_TOTAL, CAPS_FROM, MAX_NAMES, PER_GROUP, ROTATE, STOP

#: Ledgers start in the first month with an eligible name, whatever the table.
START = "(SELECT min(d) FROM mfac WHERE eligible)"


def context_sql(pct) -> str:
    """cx: one row a weighting, month and ticker, from fac, mfac, filled, traits, f0 and cal; pct(value, by) is a percentile."""
    weights = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in WEIGHTS.items())
    return f"""wts AS (SELECT * FROM (VALUES {weights}) v(weights, wm, wq)),
c0 AS (SELECT m.*, t.* EXCLUDE (ticker), CASE WHEN eligible THEN mom_raw END AS e_m, CASE WHEN eligible THEN hi52 END AS e_h, CASE WHEN eligible THEN gp_assets END AS e_g, CASE WHEN eligible THEN rev_growth END AS e_r
  FROM mfac m LEFT JOIN traits t USING (ticker)),
c1 AS (SELECT *, {pct("e_m", "d")} AS p_m, {pct("e_h", "d")} AS p_h, {pct("e_g", "d")} AS p_g, {pct("e_r", "d")} AS p_r FROM c0),
c2 AS (SELECT *, 0.7 * p_m + 0.3 * p_h AS mom, coalesce((p_g + p_r) / 2, p_g, p_r) AS qual FROM c1),
c3 AS (SELECT c2.*, weights, round(CASE WHEN qual IS NOT NULL THEN wm * mom + wq * qual ELSE mom END, 12) AS raw_score FROM c2, wts),
c4 AS (SELECT *, {pct("raw_score", "weights, d")} AS composite FROM c3),
c5 AS (SELECT *, row_number() OVER (PARTITION BY weights, d ORDER BY composite DESC NULLS LAST, earnings_yield DESC NULLS LAST, ticker) AS ord FROM c4),
fpx AS (SELECT *, CASE WHEN c_m / nullif(c_y, 0) IS NOT NULL AND count(ret) OVER w > 0 THEN sign(c_m / c_y - 1) * (count(*) FILTER (ret < 0) OVER w - count(*) FILTER (ret > 0) OVER w) / count(ret) OVER w END AS fip
  FROM f0 WINDOW w AS (PARTITION BY ticker ORDER BY rn ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING)),
t3 AS (SELECT c5.weights, c5.d, c5.ticker, fpx.fip, row_number() OVER (PARTITION BY c5.weights, c5.d ORDER BY c5.ret_12_1 DESC, ord) AS r, count(*) OVER (PARTITION BY c5.weights, c5.d) AS n
  FROM c5 JOIN fpx USING (ticker, d) WHERE c5.eligible AND composite IS NOT NULL AND c5.trend AND c5.ret_12_1 IS NOT NULL),
t4 AS (SELECT *, row_number() OVER (PARTITION BY weights, d ORDER BY fip, r) AS q, count(*) OVER (PARTITION BY weights, d) AS m FROM t3 WHERE r <= ceil(n / 3.0) AND fip IS NOT NULL),
v1 AS (SELECT ticker, d, close, CASE WHEN count(close) OVER w = 10 THEN avg(close) OVER w END AS level FROM mfac WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
vs AS (SELECT ticker, d, level AS v1_level, coalesce(m.close > level, false) AS v1_up, level IS NOT NULL AND NOT coalesce(m.close > level, false) AS v1_below, sma200 IS NOT NULL AND NOT above200 AS below,
  coalesce(m.close > 1.02 * sma200 AND sma50 > sma200, false) AS v2_up, coalesce(m.close < 0.98 * sma200, false) AS v2_below FROM mfac m JOIN v1 USING (ticker, d)),
vp AS (SELECT *, coalesce(lag(v1_below) OVER w, false) AS v1_below_prev, coalesce(lag(v2_below) OVER w, false) AS v2_below_prev, coalesce(lag(below) OVER w, false) AS below_prev FROM vs WINDOW w AS (PARTITION BY ticker ORDER BY d)),
xd AS (SELECT d, lead(d) OVER (ORDER BY d) AS exec FROM cal),
cx AS (SELECT c5.weights, c5.ticker, coalesce('g:' || nullif(c5.grp, ''), 't:' || c5.ticker) AS g, c5.d, xd.exec, dense_rank() OVER (ORDER BY c5.d) AS k, ord, c5.eligible, c5.trend, composite, c5.above200, c5.sma200, vp.below_prev, coalesce(speculative, false) AS spec,
  brake, fx."full" AS px, fd."full" AS mark, v1_level, v1_up, v1_below, v1_below_prev, v2_up, v2_below, v2_below_prev, t4.q IS NOT NULL AND t4.q <= ceil(t4.m / 2.0) AS v3_in
  FROM c5 JOIN vp USING (ticker, d) JOIN xd ON xd.d = c5.d AND xd.exec IS NOT NULL JOIN reg ON reg.d = c5.d JOIN filled fx ON fx.ticker = c5.ticker AND fx.d = xd.exec JOIN filled fd ON fd.ticker = c5.ticker AND fd.d = c5.d
  LEFT JOIN t4 ON t4.weights = c5.weights AND t4.d = c5.d AND t4.ticker = c5.ticker WHERE c5.d >= {START})"""


def fold_sql(name: str, scenarios: str, made: str | None = None) -> str:
    """`name`: state rows (k, scenario, ticker, shares, basis, cash, ...) of all months, by recursion; name_led: the ledgers.

    scenarios: a table (scenario, pick, weights, sell, gate, buy, seed, sim). made: a table (pick, k, n) of names to draw.
    """
    drawn = f"(SELECT n FROM {made} WHERE {made}.pick = z.pick AND {made}.k = z.k + 1)" if made else "0"
    rows = f"""(SELECT z.scenario, z.pick, z.sell, z.gate, z.buy, z.seed, z.sim, z.k + 1 AS k, c.ticker, c.g, c.d, c.exec, c.ord, c.eligible, c.trend, c.composite, c.spec, c.brake, c.px, coalesce(c.mark, c.px) AS mark, v1_up, v2_up, v3_in,
    z.shares, z.basis, z.cash, {drawn} AS want, CASE z.pick WHEN 'v1' THEN c.v1_level ELSE c.sma200 END AS line,
    CASE z.pick WHEN 'v1' THEN c.v1_below WHEN 'v2' THEN c.v2_below ELSE NOT c.above200 END AS under, CASE z.pick WHEN 'v1' THEN c.v1_below_prev WHEN 'v2' THEN c.v2_below_prev ELSE c.below_prev END AS was,
    sum(c.eligible::INT) OVER (PARTITION BY z.scenario) AS n_elig
    FROM {name} z JOIN cx c ON c.weights = z.weights AND c.k = z.k + 1 AND c.ticker = z.ticker)"""
    ruled = f"""(SELECT *, n_elig < {MIN_SCORED} AS unscored, CASE WHEN pick = 'ew_all' THEN 'S1' WHEN pick NOT IN ('rank', 'random', 'random_all') THEN 'S2' WHEN sell = 'S3' AND n_elig < {MIN_SCORED} THEN 'S2' ELSE sell END AS rule FROM {rows})"""
    sold = f"""(SELECT *, coalesce(rule <> 'S1' AND shares > 0 AND (mark <= {STOP} * basis / shares OR (pick <> 'b0h' AND line IS NOT NULL AND under AND was) OR (rule = 'S3' AND composite < {HOLD})), false) AS sold FROM {ruled})"""
    held = f"(SELECT *, CASE WHEN sold OR shares <= 0 THEN 0 ELSE shares * coalesce(mark, 0) END AS hv FROM {sold})"
    sums = f"""(SELECT *, sum(hv) OVER (PARTITION BY scenario) AS port, sum(hv) OVER (PARTITION BY scenario, g) AS in_group, sum(CASE WHEN spec THEN hv ELSE 0 END) OVER (PARTITION BY scenario) AS risky FROM {held})"""
    free = f"""(SELECT *, eligible AND composite IS NOT NULL AND NOT (port >= {CAPS_FROM} AND (hv >= {CAP_POSITION} * port OR in_group >= {CAP_GROUP} * port OR (spec AND (hv >= {CAP_SPEC} * port OR risky >= {CAP_SPEC_TOTAL} * port)))) AS free,
    eligible AND composite IS NOT NULL AS scored FROM {sums})"""
    cand = f"""(SELECT *, CASE WHEN unscored OR pick = 'ew_all' THEN eligible AND NOT sold WHEN pick = 'ew_trend' THEN eligible AND trend WHEN pick IN ('ew_trend10', 'b0h') THEN scored AND trend WHEN pick = 'v1' THEN scored AND v1_up
    WHEN pick = 'v2' THEN scored AND v2_up WHEN pick = 'v3' THEN scored AND v3_in WHEN pick = 'rank' THEN free AND (trend OR gate = 'G0') AND (buy = 'N3' OR composite >= {BUY}) WHEN pick = 'random_up' THEN scored AND trend
    WHEN pick = 'random' THEN free AND (trend OR gate = 'G0') ELSE free END AS cand,
    CASE WHEN unscored OR pick IN ('ew_all', 'ew_trend') THEN NULL WHEN pick = 'rank' THEN least(CASE WHEN buy = 'N3' THEN 3 ELSE {MAX_NAMES} END, CASE WHEN brake THEN {BRAKED} ELSE 99 END) WHEN pick LIKE 'random%' THEN want ELSE {ROTATE} END AS cap,
    CASE WHEN pick IN ('ew_trend10', 'b0h', 'v1', 'v2', 'v3') THEN hv ELSE 0 END AS o1, CASE WHEN pick = 'rank' THEN ord WHEN pick LIKE 'random%' THEN 0 ELSE -composite END AS o2,
    CASE WHEN pick LIKE 'random%' THEN md5(seed || ':' || sim || ':' || d || ':' || ticker) ELSE '' END AS o3 FROM {free})"""
    by_group = f"(SELECT *, row_number() OVER (PARTITION BY scenario, cand, g ORDER BY o1, o2, o3, ticker) AS gr FROM {cand})"
    placed = f"(SELECT *, row_number() OVER (PARTITION BY scenario, cand AND (cap IS NULL OR gr <= {PER_GROUP}) ORDER BY o1, o2, o3, ticker) AS place FROM {by_group})"
    bought = f"(SELECT *, coalesce(cand AND (cap IS NULL OR (gr <= {PER_GROUP} AND place <= cap)) AND px > 0, false) AS bought FROM {placed})"
    money = f"""(SELECT *, sum(CASE WHEN sold AND px IS NOT NULL THEN shares * px ELSE 0 END) OVER w AS worth, count(*) FILTER (bought) OVER w AS n, count(*) FILTER (sold) OVER w AS n_sold FROM {bought} WINDOW w AS (PARTITION BY scenario))"""
    spent = f"(SELECT *, {CONTRIB} + cash + worth * (1 - {COST}) AS budget FROM {money})"
    return f"""{name} AS (
  SELECT 0::BIGINT AS k, s.*, t.ticker, 0::DOUBLE AS shares, 0::DOUBLE AS basis, 0::DOUBLE AS cash, NULL::DATE AS d, NULL::DATE AS exec, 0::BIGINT AS n, 0::BIGINT AS n_sold, 0::DOUBLE AS moved, NULL::DOUBLE AS px, 0::BIGINT AS n_elig
  FROM {scenarios} s, (SELECT DISTINCT ticker FROM cx) t
  UNION ALL
  SELECT k::BIGINT, scenario, pick, weights_, sell, gate, buy, seed, sim, ticker, CASE WHEN sold AND px IS NOT NULL THEN 0 ELSE shares END + CASE WHEN bought THEN budget / n * (1 - {COST}) / px ELSE 0 END,
    CASE WHEN sold AND px IS NOT NULL THEN 0 ELSE basis END + CASE WHEN bought THEN budget / n ELSE 0 END, CASE WHEN n > 0 THEN 0 ELSE budget END, d, exec, n, n_sold, worth + CASE WHEN n > 0 THEN budget ELSE 0 END, px, n_elig::BIGINT
  FROM (SELECT q.*, s2.weights AS weights_ FROM {spent} q JOIN {scenarios} s2 USING (scenario))),
{name}_led AS (SELECT scenario, k, d, exec, {CONTRIB} AS contribution, sum(shares * coalesce(px, 0)) + any_value(cash) AS value, any_value(n) AS n_buys, any_value(n_sold) AS n_sells, any_value(moved) AS moved FROM {name} WHERE k > 0 GROUP BY scenario, k, d, exec)"""


def values(rows: list[tuple]) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ") v(scenario, pick, weights, sell, gate, buy, seed, sim))"


def returns_sql(ledger: str) -> str:
    """xr: xirr of every scenario; gw: growth; dd: drawdown."""
    return f"""ledger AS (SELECT scenario, exec, contribution, value FROM {ledger}),
twr AS (SELECT *, (value - contribution) / nullif(lag(value) OVER (PARTITION BY scenario ORDER BY exec), 0) - 1 AS r FROM ledger),
gw AS (SELECT scenario, count(r) AS n, product(1 + r) ** (12.0 / count(r)) - 1 AS cagr, stddev_samp(r) * sqrt(12.0) AS vol, CASE WHEN stddev_samp(r) > 0 THEN avg(r) * 12 / (stddev_samp(r) * sqrt(12.0)) END AS sharpe FROM twr WHERE r IS NOT NULL GROUP BY 1),
ix AS (SELECT scenario, exec, product(1 + r) OVER (PARTITION BY scenario ORDER BY exec) AS idx FROM twr WHERE r IS NOT NULL),
dt AS (SELECT *, greatest(1.0, max(idx) OVER (PARTITION BY scenario ORDER BY exec)) AS top FROM ix), dd AS (SELECT scenario, least(0.0, min(idx / top - 1)) AS max_dd FROM dt GROUP BY 1),
fl AS (SELECT scenario, (exec - min(exec) OVER (PARTITION BY scenario)) / 365.0 AS t, -contribution + CASE WHEN row_number() OVER (PARTITION BY scenario ORDER BY exec DESC) = 1 THEN value ELSE 0 END AS f FROM ledger),
fs2 AS (SELECT scenario, list(t) AS ts, list(f) AS fs FROM fl GROUP BY 1),
bi AS (SELECT scenario, list_reduce(list_prepend({{'lo': -0.9999::DOUBLE, 'hi': 100::DOUBLE}}, list_transform(range(100), lambda i: {{'lo': 0::DOUBLE, 'hi': 0::DOUBLE}})), lambda s, x: CASE WHEN
  list_sum(list_transform(range(1, len(ts) + 1), lambda k: fs[k] / (1 + s.lo) ** ts[k])) * list_sum(list_transform(range(1, len(ts) + 1), lambda k: fs[k] / (1 + (s.lo + s.hi) / 2) ** ts[k])) <= 0
  THEN {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} ELSE {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} END) AS s FROM fs2),
xr AS (SELECT scenario, CASE WHEN list_sum(list_transform(range(1, len(ts) + 1), lambda k: fs[k] / (1 - 0.9999) ** ts[k])) * list_sum(list_transform(range(1, len(ts) + 1), lambda k: fs[k] / (1 + 100.0) ** ts[k])) <= 0
  THEN (s.lo + s.hi) / 2 END AS xirr FROM bi JOIN fs2 USING (scenario))"""
