"""Queries of the filing scan and of the live side, with their SQL; they join the catalogue's when this module is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import filing_scan as FS
from tidemark.operators import live as LV
from tidemark.operators import panel as P
from tidemark.operators import textops as T
from tidemark.plans import catalogue as C
from tidemark.plans.catalogue import BASE, FILLED, FULL, RANKED, chain, query, r6
from tidemark.sources import stores as ST
from tidemark.sources import views as V
from tidemark.sources.scratch import kept

C.DAYS["d"] += ("scored_alongside",)

# ---- filing scan ----



@query("""SELECT s_suppkey AS acc, CASE WHEN s_suppkey % 5 = 4 THEN 6770 ELSE 3000 + s_suppkey % 700 END AS sic,
  'https://www.sec.gov/Archives/' || CASE WHEN s_suppkey % 3 = 0 THEN 'big' || s_suppkey || '.htm' ELSE 'main' || s_suppkey || '.htm' END AS "primary" FROM supplier""")
def index_pages(spark, sf):
    k = F.col("s_suppkey")
    pad = F.lpad(k.cast("string"), 10, "0")
    other = F.lit('<div class="companyInfo">CIK=0999999999 SIC=6770</div>')
    code = (3000 + k % 700).cast("string")
    own = F.when(k % 5 == 4, F.concat(F.lit('<div class="companyInfo">CIK='), pad, F.lit(" none</div>"))).when(
        k % 2 == 0, F.concat(F.lit('<div class="companyInfo">CIK='), pad, F.lit(" <a>SIC="), code, F.lit("</a></div>"))).otherwise(
        F.concat(F.lit('<div class="companyInfo">CIK='), pad, F.lit(" SIC</acronym>: <b><a>"), code, F.lit("</a></b></div>")))
    row = lambda form, href, size: F.concat(F.lit("<tr><td>1</td><td>d</td><td><a href=\""), href, F.lit("\">f</a></td><td>"), F.lit(form), F.lit("</td><td>"), F.lit(str(size)), F.lit("</td></tr>"))
    at = lambda name: F.concat(F.lit("/ix?doc=/Archives/" + name), k.cast("string"), F.lit(".htm"))
    annual = F.when(k % 3 == 0, row("10-K/A", at("small"), 10)).otherwise(row("<b>10-k</b>", at("main"), 10))
    docs = F.concat(F.lit("<table><tr><th>n</th></tr>"), row("EX-21", at("exhibit"), "9,999,999"), annual, row("GRAPHIC", F.lit("/Archives/x.jpg"), 8888888), row("page", at("big"), "1,000"), row("", F.lit("/Archives/0001-20-000001.txt"), 5), row("", F.lit("/Archives/0000000001-20-000001.txt"), 7777777), F.lit("</table>"))
    page = F.concat(other, own, docs)
    return V.table(spark, sf, "supplier").select(k.alias("acc"), FS.index_page(page, k).alias("x")).select("acc", "x.sic", "x.primary")


@query(chain(V.FILINGS) + """, c AS (SELECT s_suppkey AS cik, CASE s_suppkey % 4 WHEN 0 THEN '3674' WHEN 1 THEN '' WHEN 2 THEN '2834' END AS sic FROM supplier)
SELECT acc FROM filings LEFT JOIN c USING (cik) WHERE coalesce(c.sic, '') = '' OR c.sic = '3674'""")
def filing_candidates(spark, sf):
    k = F.col("s_suppkey") % 4
    companies = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cik"), F.when(k == 0, "3674").when(k == 1, "").when(k == 2, "2834").alias("sic"))
    return FS.candidates(V.filings(spark, sf).select("acc", "cik"), companies).select("acc")


@query(chain(V.FILINGS) + """, s AS (SELECT acc, CASE WHEN acc % 3 = 0 THEN sic::INT END AS page, CASE WHEN acc % 5 = 0 THEN 'n/a' ELSE '7372' END AS cur, text FROM filings),
t AS (SELECT acc, coalesce(page, CASE WHEN cur = '7372' THEN 7372 END) AS sic, CASE WHEN page IS NOT NULL OR cur <> '7372' THEN 'filing' ELSE 'current' END AS src, coalesce(text, '') AS text FROM s),
u AS (SELECT *, coalesce(sic IN (3674, 4911, 7372), false) AS g FROM t)
SELECT acc, sic::DOUBLE AS sic_filing, src AS sic_src, g AS in_group, CASE WHEN g THEN len(regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;|&lt;|&gt;|&quot;|&#39;|&apos;|&amp;', 'x', 'g'), '\\s+', ' ', 'g')), '[^ ]+'))::DOUBLE END AS words FROM u""")
def filing_scores_lazy(spark, sf):
    f = V.filings(spark, sf)
    d = f.select("acc", "cik", "filed", F.when(F.col("acc") % 3 == 0, F.col("sic").cast("int")).alias("sic_page"), F.when(F.col("acc") % 5 == 0, "n/a").otherwise("7372").alias("sic_current"), F.col("text").alias("html"))
    return FS.score_filings(d, C.DICT).select("acc", F.col("sic_filing").cast("double").alias("sic_filing"), "sic_src", "in_group", F.col("words").cast("double").alias("words"))


@query("""WITH s AS (SELECT doc_id % 97 AS cik, doc_id AS acc, DATE '2009-02-01' + (doc_id * 7 % 500)::INT AS filed FROM documents),
a AS (SELECT cik, filed, max(acc) AS acc FROM s GROUP BY ALL), e AS (SELECT cik, filed FROM s WHERE acc % 2 = 0 UNION SELECT cik, filed FROM s WHERE acc % 3 = 0) SELECT acc, cik, filed::VARCHAR AS filed FROM a SEMI JOIN e USING (cik, filed)""")
def excerpt_targets(spark, sf):
    s = _short_filings(spark, sf)
    return FS.targets(s, s.filter("acc % 2 = 0"), s.filter("acc % 3 = 0")).select("acc", "cik", "filed")


def _short_filings(spark, sf):
    k = F.col("doc_id")
    return V.table(spark, sf, "documents").select((k % 97).alias("cik"), k.alias("acc"), F.date_add(F.lit("2009-02-01").cast("date"), (k * 7 % 500).cast("int")).alias("filed"))


@query("""WITH s AS (SELECT doc_id % 97 AS cik, doc_id AS acc, DATE '2009-02-01' + (doc_id * 7 % 500)::INT AS filed FROM documents), a AS (SELECT cik, filed, max(acc) AS acc FROM s GROUP BY ALL),
r AS (SELECT DISTINCT cik, filed, year(filed)::INT + 1 AS year FROM s), y AS (SELECT a.cik, a.filed FROM a JOIN labels ON doc_id = acc WHERE quality = 1),
k AS (SELECT r.* FROM r SEMI JOIN y USING (cik, filed)) SELECT year, count(*) AS before, count(k.cik) AS after FROM r LEFT JOIN k USING (cik, filed, year) GROUP BY 1""")
def universe_filter_counts(spark, sf):
    s = _short_filings(spark, sf)
    rows = s.select("cik", "filed", (F.year("filed") + 1).alias("year")).distinct()
    classes = V.table(spark, sf, "labels").select(F.col("doc_id").alias("acc"), (F.col("quality") == 1).alias("sells_into"))
    return FS.year_counts(rows, FS.filter_universe(rows, s, classes))


@query("""SELECT c.cik, array_to_string(list_sort(list_distinct(list_concat([c.name], CASE WHEN c.cik % 3 = 0 THEN ['Old ' || c.cik || ' (1999..)'] ELSE [] END))), ';') AS names,
  array_to_string(list_sort(list_distinct(list_concat(['T' || (c.cik % 7)], coalesce(s.t, [])))), ';') AS tickers
FROM (SELECT s_suppkey AS cik, s_name AS name FROM supplier) c LEFT JOIN (SELECT doc_id % 97 AS cik, list(DISTINCT 'F' || (doc_id % 11)) AS t FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1) s ON s.cik = c.cik
UNION ALL SELECT s.cik, '', array_to_string(list_sort(s.t), ';') FROM (SELECT doc_id % 97 AS cik, list(DISTINCT 'F' || (doc_id % 11)) FILTER (doc_id % 4 <> 0) AS t FROM documents GROUP BY 1) s ANTI JOIN supplier ON s_suppkey = s.cik""")
def filer_identity(spark, sf):
    k = F.col("s_suppkey")
    sub = F.struct(F.col("s_name").alias("name"), F.lit("3674").alias("sic"), F.array(F.concat(F.lit("T"), (k % 7).cast("string"))).alias("tickers"), F.array(F.lit(None).cast("string")).alias("exchanges"), F.when(k % 3 == 0, F.array(F.struct(F.concat(F.lit("Old "), k.cast("string")).alias("name"), F.lit("1999").alias("from"), F.lit(None).cast("string").alias("to")))).alias("formerNames"))
    companies = FS.company_rows(V.table(spark, sf, "supplier").select(k.alias("cik"), sub.alias("sub")))
    scores = V.table(spark, sf, "documents").select((F.col("doc_id") % 97).alias("cik"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("F"), (F.col("doc_id") % 11).cast("string"))).alias("symbols"))
    return FS.identity(companies, scores).select("cik", F.array_join("names", ";").alias("names"), F.array_join("tickers", ";").alias("tickers"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN doc_id % 2 = 0 END AS sells_into, CASE WHEN doc_id % 6 < 2 THEN 'networking' END AS role, CASE WHEN doc_id % 6 < 2 THEN 'high' END AS confidence,
  CASE WHEN doc_id % 6 < 2 THEN substr(trim('sells switches ' || repeat('x', (doc_id % 300)::INT)), 1, 200) END AS evidence FROM documents""")
def strict_replies(spark, sf):
    k = F.col("doc_id")
    flag = F.when(k % 2 == 0, "true").otherwise("false")
    body = lambda extra, role, sells: F.concat(F.lit('{"role": "'), role, F.lit('", "sells_into": '), sells, F.lit(', "confidence": "high", "evidence": "sells\\nswitches  '), F.repeat(F.lit("x"), (k % 300).cast("int")), F.lit('"'), extra, F.lit("}"))
    good = body(F.lit(""), F.lit("networking"), flag)
    text = F.when(k % 6 == 0, good).when(k % 6 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k % 6 == 2, body(F.lit(', "more": 1'), F.lit("networking"), flag)).when(
        k % 6 == 3, body(F.lit(""), F.lit("banking"), flag)).when(k % 6 == 4, body(F.lit(""), F.lit("networking"), F.lit('"yes"'))).otherwise(F.lit("not json"))
    return V.table(spark, sf, "documents").select("doc_id", FS.strict_reply(text).alias("x")).select("doc_id", "x.sells_into", "x.role", "x.confidence", "x.evidence")


@query(chain(V.FILINGS) + """, s AS (SELECT doc_id % 97 AS cik, 2009 + doc_id % 14 AS year, CASE doc_id % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'PARTIAL' ELSE 'BOILERPLATE' END AS verdict, 'Name ' || doc_id AS name FROM documents),
f AS (SELECT cik, year(filed) AS year, arg_max(acc, (acc % 2 = 0, filed, acc)) AS acc, arg_max(filed, (acc % 2 = 0, filed, acc)) AS filed FROM filings GROUP BY ALL)
SELECT s.name, s.cik, s.year::INT AS year, verdict, verdict <> 'BOILERPLATE' AS truth, f.acc::DOUBLE AS acc, f.filed::VARCHAR AS filed FROM s LEFT JOIN f ON f.cik = s.cik AND f.year = s.year""")
def spot_check_filings(spark, sf):
    k = F.col("doc_id")
    verdict = F.when(k % 3 == 0, "REAL").when(k % 3 == 1, "PARTIAL").otherwise("BOILERPLATE")
    line = F.concat(F.lit("| "), (k % 97).cast("string"), F.lit(" | Name "), k.cast("string"), F.lit(" | "), (2009 + k % 14).cast("string"), F.lit(" | **"), verdict, F.lit("** | note |"))
    notes = V.table(spark, sf, "documents").select(F.concat(F.lit("| cik | name |\n|---|---|\r\n"), line, F.lit("\ntext\n")).alias("text"))
    scores = V.filings(spark, sf).select("acc", "cik", "filed", (F.col("acc") % 2 == 0).alias("eligible_text"))
    return FS.spot_filings(FS.spot_rows(notes), scores).select("name", "cik", "year", "verdict", "truth", F.col("acc").cast("double").alias("acc"), "filed")


@query(chain(V.LISTINGS, C.ELIG, C.OWN, C.STATED, C.CLAIMS) + """, l AS (SELECT cik, max(year) AS year, arg_max(ticker, year) AS ticker FROM mapped WHERE status = 'listed' GROUP BY 1),
r AS (SELECT * FROM mapped ANTI JOIN l USING (cik)), n AS (SELECT cik, ticker, count(*) AS n, min(year) AS y FROM r WHERE status = 'delisted' GROUP BY ALL), m AS (SELECT cik, arg_max(ticker, (n, -y)) AS ticker FROM n GROUP BY 1)
SELECT cik, 'listed' AS plan, ticker, year::BIGINT AS n FROM l UNION ALL SELECT m.cik, 'todo', m.ticker, count(*) FROM m JOIN r ON r.cik = m.cik GROUP BY ALL""")
def price_plans(spark, sf):
    best, todo = FS.price_plan(C._mapped(spark, sf))
    return best.select("cik", F.lit("listed").alias("plan"), "ticker", F.col("year").cast("long").alias("n")).unionByName(todo.select("cik", F.lit("todo").alias("plan"), "ticker", F.col("years").alias("n")))


# ---- live side ----

ALONG = C.SCORED.replace("s0 AS (SELECT m.*", "xm AS (SELECT * FROM mfac UNION ALL SELECT * REPLACE ('X' || ticker AS ticker, mom_raw * 1.01 AS mom_raw) FROM mfac WHERE d >= DATE '2000-01-01'),\ns0 AS (SELECT m.*").replace("FROM mfac m LEFT JOIN traits t USING (ticker))", "FROM xm m LEFT JOIN traits t USING (ticker))")


@query(chain(*FULL, V.TRAITS, ALONG) + "SELECT d, ticker, NOT starts_with(ticker, 'X') AS in_universe, round(composite, 6) AS composite, ord FROM scored")
def scored_alongside(spark, sf):
    m, traits = C.mfac(spark, sf), V.traits(spark, sf)
    extra = m.filter("d >= '2000-01-01'").withColumn("ticker", F.concat(F.lit("X"), "ticker")).withColumn("mom_raw", F.col("mom_raw") * 1.01)
    s = LV.score_alongside(m.join(traits, "ticker", "left"), extra.join(traits, "ticker", "left"))
    return r6(s.select("d", "ticker", "in_universe", "composite", "ord"))


@query(chain(*RANKED, V.HOLDINGS) + """, c AS (SELECT DISTINCT d FROM me WHERE d < DATE '2001-10-01'), m1 AS (SELECT max(d) AS d FROM c), m0 AS (SELECT max(d) AS d FROM c WHERE d < (SELECT d FROM m1)), now AS (SELECT ticker, "full" AS price FROM filled WHERE d = (SELECT max(d) FROM cal)),
b AS (SELECT ticker FROM fac SEMI JOIN m0 USING (d) WHERE sma200 IS NOT NULL AND NOT above200), x AS (SELECT h.ticker, h.cost, price, s.sma200, s.above200, s.composite, b.ticker IS NOT NULL AS bp FROM holdings h JOIN now USING (ticker) LEFT JOIN (SELECT * FROM scored SEMI JOIN m1 USING (d)) s ON s.ticker = h.ticker LEFT JOIN b ON b.ticker = h.ticker)
SELECT ticker, CASE WHEN cost > 0 AND price <= 0.65 * cost THEN '-35% stop' ELSE '2 month-ends below 200DMA' END AS rule FROM x WHERE (cost > 0 AND price <= 0.65 * cost) OR (sma200 IS NOT NULL AND NOT above200 AND bp)""")
def live_sell_list(spark, sf):
    p = C.panel(spark, sf)
    done = C.ends(spark, sf).filter("d < '2001-10-01'")
    last = P.calendar(p).agg(F.max("d").alias("d"))
    now = C.filled(spark, sf).join(last, "d").select("ticker", F.col("full").alias("price"))
    return LV.live_sells(C.scored(spark, sf), done, V.holdings(spark, sf, p).join(now, "ticker")).select("ticker", "rule")


@query("""SELECT s_suppkey AS k, CASE WHEN use THEN s_acctbal / 1e4 ELSE 0.1 END AS rev_growth, CASE WHEN NOT use THEN 0.5 END AS gp_assets, round(CASE WHEN use THEN eps / nullif(px, 0) ELSE 0.02 END, 6) AS earnings_yield,
  CASE WHEN use THEN coalesce(eps < 0, false) ELSE false END AS speculative, NOT use AND s_suppkey % 3 = 0 AS fund_missing, NOT use AS fund_pit
FROM (SELECT *, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS use, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS eps, CASE WHEN s_suppkey % 5 = 0 THEN 7.0 ELSE 100.0 END AS px FROM supplier)""")
def vendor_fallbacks(spark, sf):
    k = F.col("s_suppkey")
    d = V.table(spark, sf, "supplier").select(
        k.alias("k"), F.when(k % 3 != 0, 1.0).alias("revenue_ttm"), F.lit(0.1).alias("rev_growth"), F.lit(0.5).alias("gp_assets"), F.lit(0.02).alias("earnings_yield"), F.lit(False).alias("speculative"), (k % 3 == 0).alias("fund_missing"),
        F.when(k % 4 != 0, F.col("s_acctbal")).alias("trailing_eps"), (F.col("s_acctbal") / 1e4).alias("vendor_growth"), F.when(k % 5 != 0, 100.0).otherwise(0.0).alias("vendor_price"), F.lit(7.0).alias("close"), (k % 2 == 0).alias("has_vendor"))
    return LV.vendor_fallback(d, True).select("k", "rev_growth", "gp_assets", F.round(F.col("earnings_yield") + 1e-9, 6).alias("earnings_yield"), "speculative", "fund_missing", "fund_pit")


@query(chain(*BASE, FILLED) + """, px AS (SELECT ticker, d, "full" AS px FROM filled WHERE "full" IS NOT NULL), pk AS (SELECT c_custkey AS id, 'S' || (c_custkey % 50 + 1) AS ticker, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE DATE '1999-01-05' + (c_custkey % 900)::INT END AS d0, strftime(DATE '1999-02-01' + (c_custkey % 900)::INT, '%Y-%m') AS month, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1000.0 END AS price FROM customer),
b AS (SELECT pk.*, CASE WHEN d0 IS NOT NULL THEN (SELECT max(d) FROM cal WHERE cal.d <= d0) ELSE (SELECT min(d) FROM cal WHERE cal.d >= (month || '-01')::DATE) END AS base FROM pk), l AS (SELECT ticker, px AS last FROM px WHERE d = (SELECT max(d) FROM cal)),
mv AS (SELECT px.ticker, px.d AS base, last / nullif(px, 0) - 1 AS r FROM px JOIN l USING (ticker)), ew AS (SELECT base, avg(r) AS ew FROM mv GROUP BY 1),
rw AS (SELECT DISTINCT b.month, b.ticker, price, d0, last, last / nullif(price, 0) - 1 AS ret, mv.r AS bench, ew FROM b LEFT JOIN l ON l.ticker = b.ticker LEFT JOIN ew ON ew.base = b.base LEFT JOIN mv ON mv.base = b.base AND mv.ticker = 'S1')
SELECT 'mean' AS what, round(avg(ret), 6) AS ret, round(avg(bench), 6) AS bench, round(avg(ew), 6) AS ew, count(*) AS n FROM rw""")
def track_record_means(spark, sf):
    k = F.col("c_custkey")
    closes = C.filled(spark, sf).select("ticker", "d", F.col("full").alias("px")).filter("px is not null")
    picks = V.table(spark, sf, "customer").select(
        F.date_format(F.date_add(F.lit("1999-02-01").cast("date"), (k % 900).cast("int")), "yyyy-MM").alias("month"), F.concat(F.lit("S"), (k % 50 + 1).cast("string")).alias("ticker"),
        F.when(k % 9 == 0, 0.0).otherwise(1000.0).alias("price"), F.when(k % 4 != 0, F.date_add(F.lit("1999-01-05").cast("date"), (k % 900).cast("int"))).alias("d")).distinct()
    rows, mean = LV.track_record(picks, closes, "S1", closes.select("ticker"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return r6(mean.crossJoin(n).select(F.lit("mean").alias("what"), "ret", "bench", "ew", "n"))


BUNDLE = f"""{C.BENCHM.split(', mb2')[0]}, xb AS (SELECT x.exec AS d, b.close AS px FROM (SELECT DISTINCT exec FROM e) x JOIN bench b ON b.d = x.exec), bl AS (SELECT d AS exec, 2500.0 AS contribution, sum(2500.0 / px) OVER (ORDER BY d) * px AS value FROM xb),
rb AS (SELECT exec, (value - contribution) / nullif(lag(value) OVER (ORDER BY exec), 0) - 1 AS rb FROM bl),
el AS (SELECT 'ew' AS scenario, exec, 2500.0 AS contribution, sum(sh * px) AS value FROM sh GROUP BY exec), ra AS (SELECT scenario, exec, (value - contribution) / nullif(lag(value) OVER (ORDER BY exec), 0) - 1 AS r FROM el),
df AS (SELECT scenario, exec, r - rb AS x FROM ra JOIN rb USING (exec) WHERE r IS NOT NULL)"""
_E = """x AS (SELECT d, lead(d) OVER (ORDER BY d) AS exec FROM cal), e AS (SELECT m.ticker, x.exec, f."full" AS px, m.eligible, sum(m.eligible::INT) OVER (PARTITION BY m.d) AS n FROM mfac m JOIN x USING (d) JOIN filled f ON f.ticker = m.ticker AND f.d = x.exec WHERE m.d >= (SELECT min(d) FROM mfac WHERE eligible)),
sh AS (SELECT *, sum(CASE WHEN eligible AND px > 0 THEN 2500.0 * (1 - 0.0015) / n / px ELSE 0 END) OVER (PARTITION BY ticker ORDER BY exec) AS sh FROM e)"""


@query(chain(*FULL, _E, BUNDLE) + f""", cc AS (SELECT exec, x - avg(x) OVER () AS e, x FROM df), lg AS (SELECT *, {C._LAGS} FROM cc), nw AS (SELECT count(*) AS n, avg(x) AS m, (sum(e * e) + {C._NW}) / count(*) AS s FROM lg)
SELECT 'ew' AS scenario, round(m * 12, 6) AS excess, round(CASE WHEN s > 0 THEN m / sqrt(s / n) END, 6) AS t, true AS dates_match FROM nw""")
def bundle_against_benchmark(spark, sf):
    led = _ew_exec_ledger(spark, sf)
    days = led.select("exec").distinct()
    bench = V.benchmark_series(C.panel(spark, sf)).join(days, F.col("d") == F.col("exec"), "left_semi").select(F.lit("b").alias("scenario"), "d", F.col("close").alias("px"))
    b = C.M.dca(bench, ["scenario"]).select(F.col("d").alias("exec"), F.lit(2500.0).alias("contribution"), "value")
    return r6(LV.metrics_bundle(led, b, ["scenario"]).select("scenario", "excess", "t", "dates_match"))


def _ew_exec_ledger(spark, sf):
    m = C.from_first(C.mfac(spark, sf)).select("ticker", "d", "eligible")
    x = P.fill_dates(P.calendar(C.panel(spark, sf))).filter("exec is not null")
    px = C.filled(spark, sf).select("ticker", F.col("d").alias("exec"), F.col("full").alias("px"))
    e = m.join(x, "d").join(px, ["ticker", "exec"]).select("ticker", F.col("exec").alias("d"), "eligible", "px")
    return C.L.ew_hold(e).select(F.lit("ew").alias("scenario"), F.col("d").alias("exec"), F.lit(2500.0).alias("contribution"), "value")


@query(C.chain_r(*C.CONTEXT_SQL, C.GRID_SQL, C.LS.fold_sql("stg", "gsc"), C.LS.returns_sql("stg_led")) + "SELECT xr.scenario, round(xirr - (SELECT xirr FROM xr WHERE scenario = 'ew_all'), 6) AS diff FROM xr")
def headline_differences(spark, sf):
    """Returns of the grid's scenarios less that of the equal-weight one."""
    x = C.M.ledger_xirr(C.L.simulate(C.grid_scenarios(spark), C.context(spark, sf)), ["scenario"])
    return r6(LV.headline_differences(kept(x, "xirrs"), "ew_all"))


@query("""WITH d AS (SELECT c_acctbal AS v FROM customer), s AS (SELECT s_suppkey AS seed, s_acctbal AS v FROM supplier), p AS (SELECT seed, 100.0 * (count(*) FILTER (d.v < s.v) + 0.5 * count(*) FILTER (d.v = s.v)) / count(*) AS p FROM s, d GROUP BY 1)
SELECT round(avg(p), 6) AS mean, avg(p) BETWEEN 35 AND 65 AS ok FROM p""")
def seed_percentiles(spark, sf):
    draws = V.table(spark, sf, "customer").select(F.col("c_acctbal").alias("xirr"))
    return r6(LV.mean_percentile(V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"), F.col("s_acctbal").alias("xirr")), draws))


@query("""WITH f AS (SELECT c_custkey AS id, round(abs(c_acctbal), 2) AS a FROM customer)
SELECT id, CASE WHEN id % 3 = 0 THEN 'ghost' ELSE '' END AS bad_keys, CASE WHEN id % 2 = 0 THEN '987654321' ELSE '' END AS ungrounded FROM f""")
def evidence_grounding(spark, sf):
    k = F.col("c_custkey")
    amount = F.printf(F.lit("%.2f"), F.round(F.abs("c_acctbal"), 2))
    facts = T.facts_map({"price": amount, "ret_12m": F.lit("+42%"), "missing": F.lit(None).cast("string"), "empty": F.lit("")})
    point = F.struct(F.concat(F.lit("the price is "), amount, F.lit(", up 41.9% in 2019 with 7 names")).alias("point"), F.when(k % 3 == 0, F.array(F.lit("price"), F.lit("ghost"))).otherwise(F.array(F.lit("price"))).alias("evidence"))
    texts = F.array(F.when(k % 2 == 0, "worth 987654321 in all").otherwise("nothing more in 12 months"))
    g = LV.grounding_report(V.table(spark, sf, "customer").select(k.alias("id"), "c_custkey", "c_acctbal"), F.array(point), texts, facts)
    return g.select("id", F.array_join("bad_keys", ";").alias("bad_keys"), F.array_join("ungrounded_numbers", ";").alias("ungrounded"))


# ---- feeds ----


@query("""WITH m AS (SELECT upper('s' || (c_custkey % 60)) AS ticker, min(c_custkey) AS k FROM customer GROUP BY 1), w AS (SELECT DISTINCT CASE WHEN p_size % 4 = 0 THEN 'S' || p_size || '.B' ELSE 'S' || p_size END AS ticker FROM part)
SELECT w.ticker, m.k::DOUBLE AS cik FROM w LEFT JOIN m ON m.ticker = w.ticker""")
def symbol_lookup(spark, sf):
    from tidemark.sources import feeds

    c = V.table(spark, sf, "customer").select(F.create_map(F.col("c_custkey").cast("string"), F.struct(F.concat(F.lit("s"), (F.col("c_custkey") % 60).cast("string")).alias("ticker"), F.col("c_custkey").cast("string").alias("cik_str"))).alias("companies"))
    name = F.concat(F.lit("S"), F.col("p_size").cast("string"))
    want = V.table(spark, sf, "part").select(F.when(F.col("p_size") % 4 == 0, F.concat(name, F.lit(".B"))).otherwise(name).alias("ticker")).distinct()
    return feeds.lookup_cik(want, feeds.cik_map(c)).select("ticker", F.col("cik").cast("double").alias("cik"))


@query("""SELECT c_custkey AS id, c_custkey % 3 <> 0 AND (c_custkey % 4 <> 0 OR c_custkey % 5 <> 0) AS ok, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN c_acctbal END AS price, CASE WHEN c_custkey % 2 = 0 THEN 'trend: no data' ELSE 'late' END AS error,
  (CASE WHEN c_custkey % 6 < 3 THEN 1 ELSE 0 END)::BIGINT AS n_splits FROM customer""")
def estimate_snapshots(spark, sf):
    from tidemark.sources import feeds

    k = F.col("c_custkey")
    none = F.lit(None).cast("double")
    price = F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    info = F.when(k % 3 != 0, F.struct(F.when(k % 5 != 0, "name").alias("name"), F.when(~F.isnan(price), price).alias("price"), none.alias("trailing_eps")))
    splits = F.array(F.struct(F.lit("2020-01-01").cast("date").alias("d"), F.lit(2.0).alias("ratio")), F.struct(F.when(k % 6 < 3, F.lit("2025-01-01").cast("date")).otherwise(F.lit("2021-01-01").cast("date")).alias("d"), F.lit(3.0).alias("ratio")))
    raw = V.table(spark, sf, "customer").select(k.alias("ticker"), info.alias("info"), none.alias("trend"), none.alias("revisions"), splits.alias("splits"), F.array(F.lit(None).cast("string"), F.when(k % 2 == 0, "trend: no data"), F.lit("late")).alias("errors"))
    e = feeds.estimates(raw, F.lit("2026-01-01").cast("date"))
    return e.select(F.col("ticker").alias("id"), "ok", "price", "error", F.size("splits").cast("long").alias("n_splits"))


@query("""WITH x AS (SELECT conv_id AS ticker, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE substr(text, 1, 20) END AS title FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY turn, title) AS pos FROM x WHERE title <> '')
SELECT ticker, pos::BIGINT AS pos, title, CASE WHEN turn % 2 = 0 THEN 'nested' ELSE 'flat' END AS publisher, CASE WHEN turn % 2 = 0 THEN '2026-01-02' ELSE '1970-01-02' END AS date FROM n WHERE pos <= 2""")
def news_items(spark, sf):
    from tidemark.sources import feeds

    t = F.col("turn")
    title = F.when(t % 3 == 0, "").otherwise(F.substring("text", 1, 20))
    none = F.lit(None).cast("string")
    content = F.when(t % 2 == 0, F.struct(title.alias("title"), F.lit("nested").alias("provider"), F.lit("2026-01-02T10:00:00Z").alias("pubDate")))
    x = F.struct(t.alias("turn"), title.alias("order"), content.alias("content"), F.when(t % 2 == 1, title).otherwise(none).alias("title"), F.when(t % 2 == 1, "flat").alias("publisher"), F.when(t % 2 == 1, 100_000).alias("providerPublishTime"))
    raw = V.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("ticker")).agg(F.array_sort(F.collect_list(x)).alias("items"))
    return feeds.news(raw, 2).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT 'u' || (user_id % 4) AS strategy, event_id, CASE WHEN event_id % 5 <> 0 THEN event_id * 1.0 END AS contrib, CASE WHEN event_id % 5 <> 0 THEN 2::BIGINT ELSE -1 END AS n_sells, CASE WHEN event_id % 5 <> 0 THEN '2024-02-01' END AS fill_date FROM events""")
def decision_log(spark, sf):
    from tidemark.sources import feeds

    e = V.table(spark, sf, "events")
    state = F.concat(F.lit('{"sells": ["A", "B"], "buys": [], "fill_date": "2024-02-01", "contrib": '), F.col("event_id").cast("string"), F.lit(".0}"))
    log = e.select(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("strategy"), F.col("event_id").alias("month"), F.when(F.col("event_id") % 5 == 0, '{"sells": [').otherwise(state).alias("state"))
    d = feeds.decisions(feeds.conform(log, "shadow"))
    return d.select("strategy", F.col("month").cast("long").alias("event_id"), "contrib", F.coalesce(F.size("sells"), F.lit(-1)).cast("long").alias("n_sells"), F.col("fill_date").cast("string").alias("fill_date"))


@query("""WITH c AS (SELECT user_id AS key, max(ts) AS fetched, bool_or(event_type = 'error' AND event_id % 10 = 0) AS gone FROM events WHERE event_id % 20 = 0 GROUP BY 1)
SELECT DISTINCT user_id AS key FROM events ANTI JOIN (SELECT key FROM c WHERE gone OR fetched > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) f ON f.key = events.user_id""")
def stale_answers(spark, sf):
    from tidemark.sources import feeds

    e = V.table(spark, sf, "events")
    cache = e.filter("event_id % 20 = 0").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("fetched"), F.when(F.bool_or((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0)), 404).otherwise(200).alias("status"))
    return feeds.to_fetch(e.select(F.col("user_id").alias("key")), cache, F.lit("2024-01-31").cast("timestamp"), 7)


@query(chain(C.SNAP) + """, d AS (SELECT max(date) AS b FROM snap), e AS (SELECT max(date) AS a FROM snap, d WHERE date <= b - 5), ch AS (SELECT x.ticker, CASE WHEN x.trend THEN 'up' ELSE 'down' END AS change FROM snap x JOIN d ON x.date = b JOIN (SELECT s.ticker, s.trend FROM snap s JOIN e ON s.date = a) y USING (ticker) WHERE x.trend <> y.trend)
SELECT * FROM ch UNION ALL SELECT DISTINCT user_id, 'sec' FROM events, e WHERE event_type = 'error' AND ts::DATE > a AND user_id IN (SELECT ticker FROM snap, d WHERE date = b)""")
def changes_and_events(spark, sf):
    events = V.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
    return ST.changes_with_events(C._snaps(spark, sf), events)


@query(chain(*BASE, FILLED) + """, k AS (SELECT s_suppkey AS k, 'T' || s_suppkey AS strategy, unnest([s_suppkey % 50 + 1, s_suppkey * 7 % 50 + 1]) AS n, 150 + s_suppkey % 5 * 20 AS rn FROM supplier),
b AS (SELECT DISTINCT strategy, f.d AS fill, f.ticker, f."full" AS px, l."full" AS last, l.d AS last_d FROM k JOIN filled f ON f.rn = k.rn AND f.ticker = 'S' || n JOIN filled l ON l.ticker = f.ticker AND l.d = (SELECT max(d) FROM cal) WHERE f."full" > 0),
v AS (SELECT strategy, fill, last_d, sum(100.0 / n_ / px * last) AS value FROM (SELECT *, count(*) OVER (PARTITION BY strategy) AS n_ FROM b) GROUP BY ALL)
SELECT strategy, 1::BIGINT AS months, 100.0 AS invested, round(value, 6) AS value, round((value / 100) ** (365.0 / (last_d - fill)) - 1, 6) AS xirr FROM v""")
def shadow_summary(spark, sf):
    """A ledger a supplier that buys two tickers at the panel's prices of a day of its own, at the last day's prices."""
    k, f = F.col("s_suppkey"), C.filled(spark, sf).select("ticker", "d", "rn", F.col("full").alias("px")).filter("px > 0")
    names = F.array(*[F.concat(F.lit("S"), x.cast("string")) for x in (k % 50 + 1, k * 7 % 50 + 1)])
    bought = V.table(spark, sf, "supplier").select(F.concat(F.lit("T"), k.cast("string")).alias("strategy"), (F.lit(150) + k % 5 * 20).alias("rn"), F.explode(F.array_distinct(names)).alias("ticker"))
    prices = lambda: F.map_from_entries(F.collect_list(F.struct("ticker", "px"))).alias("px")
    d = bought.join(f, ["rn", "ticker"]).groupBy("strategy", F.col("d").alias("fill_date")).agg(F.sort_array(F.collect_list("ticker")).alias("buys"), prices())
    d = d.select("strategy", F.date_format("fill_date", "yyyy-MM").alias("month"), "fill_date", F.array().cast("array<string>").alias("sells"), "buys", "px", F.lit(100.0).alias("contrib"))
    days = P.calendar(C.panel(spark, sf)).agg(F.max("d").alias("d"))
    last = f.join(F.broadcast(days), "d").groupBy("d").agg(prices())
    return r6(LV.shadow_rows(d, last, 0.0).select("strategy", "months", "invested", "value", "xirr"))
