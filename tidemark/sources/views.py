"""Domain views over the driver's tables: price panel, facts, listings, holdings and the like, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, key: str = "p_size", unit: str = "week") -> DataFrame:
    """(ticker, grp, d, close): average unit price of the parts of a key by week or day; NaN and infinities become null."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey).select(
        F.concat(F.lit("S") if key == "p_size" else F.lit(""), F.col(key).cast("string")).alias("ticker"),
        (F.concat(F.lit("G"), (F.col("p_size") % 6).cast("string")) if key == "p_size" else F.concat(F.lit("G"), F.substring(key, -1, 1))).alias("grp"),
        F.date_trunc(unit, "l_shipdate").cast("date").alias("d"), F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"))
    return rows.groupBy("ticker", "grp", "d").agg(clean(F.avg("unit_price")).alias("close"))


PANEL = """panel AS (SELECT 'S' || p_size AS ticker, 'G' || (p_size % 6) AS grp, date_trunc('week', l_shipdate)::DATE AS d,
  avg(l_extendedprice / nullif(l_quantity, 0)) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
PANEL_DAILY = """panel AS (SELECT p_type AS ticker, 'G' || right(p_type, 1) AS grp, date_trunc('day', l_shipdate)::DATE AS d,
  avg(l_extendedprice / nullif(l_quantity, 0)) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def benchmark_series(panel_: DataFrame) -> DataFrame:
    """(d, close): mean close of all tickers, the stand-in for an index fund."""
    return panel_.groupBy("d").agg(F.avg("close").alias("close"))


BENCH = "bench AS (SELECT d, avg(close) AS close FROM panel GROUP BY d)"


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, gp_assets, rev_growth, earnings_yield, rev_chg, rev_breadth, speculative) of each ticker, with gaps."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    g = li.join(part, li.l_partkey == part.p_partkey).groupBy("p_size").agg(
        F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("q"))
    s = F.col("p_size")
    return g.select(
        F.concat(F.lit("S"), s.cast("string")).alias("ticker"), F.when(s % 7 != 0, F.round("a", 4)).alias("gp_assets"), F.when((s % 5 != 0) & (s % 7 != 0), F.round("b", 4)).alias("rev_growth"),
        F.when(s % 3 != 0, F.round(F.col("b") - F.col("a"), 4)).alias("earnings_yield"), F.when(s % 4 != 0, F.round((F.col("q") - 25) / 25, 4)).alias("rev_chg"),
        F.when(s % 6 != 0, F.round((F.col("a") - 0.05) * 20, 4)).alias("rev_breadth"), (s % 9 == 0).alias("speculative"))


TRAITS = """traits AS (SELECT 'S' || p_size AS ticker, CASE WHEN p_size % 7 <> 0 THEN round(a, 4) END AS gp_assets,
  CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN round(b, 4) END AS rev_growth, CASE WHEN p_size % 3 <> 0 THEN round(b - a, 4) END AS earnings_yield,
  CASE WHEN p_size % 4 <> 0 THEN round((q - 25) / 25, 4) END AS rev_chg, CASE WHEN p_size % 6 <> 0 THEN round((a - 0.05) * 20, 4) END AS rev_breadth, p_size % 9 = 0 AS speculative
  FROM (SELECT p_size, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_size))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal items (entity, concept, start, end, val, filed, form, seq): quarters, year-to-date and years of revenue
    and cost by nation, each filed twice (a first value and an amendment), and balances as instants."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    q = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("entity"), F.trunc("o_orderdate", "quarter").alias("qs")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("v0"), F.sum("o_totalprice").alias("v1"))
    from pyspark.sql import Window

    w = Window.partitionBy("entity", F.year("qs")).orderBy("qs").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("y0", F.trunc("qs", "year")).withColumn("end", F.date_sub(F.add_months("qs", 3), 1)).withColumn("c0", F.sum("v0").over(w)).withColumn("c1", F.sum("v1").over(w))
    spans = q.select("entity", "end", "qs", F.explode(F.array(
        F.struct(F.col("qs").alias("start"), F.col("v0").alias("a"), F.col("v1").alias("b"), F.lit(0).alias("k")),
        F.struct(F.col("y0").alias("start"), F.col("c0").alias("a"), F.col("c1").alias("b"), F.lit(1).alias("k")))).alias("x")).filter("x.k = 0 or month(qs) > 1")
    filed = spans.select("entity", "end", "x.start", "x.k", F.explode(F.array(F.struct(F.col("x.a").alias("val"), F.lit(45).alias("lag")), F.struct(F.col("x.b").alias("val"), F.lit(120).alias("lag")))).alias("y"))
    rows = filed.select("entity", "start", "end", "k", F.round("y.val", 2).alias("val"), F.date_add("end", F.col("y.lag")).alias("filed"), "y.lag")
    concept = F.when(F.col("entity") % 5 == 0, "SalesRevenueNet").otherwise("Revenues")
    money = rows.select("entity", F.explode(F.array(F.struct(concept.alias("concept"), F.col("val").alias("v")), F.struct(F.lit("CostOfRevenue").alias("concept"), F.round(F.col("val") * 0.6, 2).alias("v")),
        F.struct(F.lit("NetIncomeLoss").alias("concept"), F.round(F.col("val") * F.when(F.col("entity") % 7 == 0, -0.05).otherwise(0.08) + 1e-6, 2).alias("v")), F.struct(F.when(F.col("entity") % 4 == 0, "GrossProfit").alias("concept"), F.round(F.col("val") * 0.45 + 1e-6, 2).alias("v")))).alias("z"), "start", "end", "filed", "lag", "k").filter("z.concept is not null")
    money = money.select("entity", "z.concept", "start", "end", F.col("z.v").alias("val"), "filed", F.when(F.col("lag") == 45, "10-Q").otherwise("10-Q/A").alias("form"), "k")
    balances = c.groupBy(F.col("c_nationkey").alias("entity")).agg(F.round(F.sum("c_acctbal"), 2).alias("val"))
    ends = q.select("entity", "end").distinct()
    assets = ends.join(balances, "entity").select("entity", F.lit("Assets").alias("concept"), F.lit(None).cast("date").alias("start"), "end", F.round(F.abs("val") * (1 + F.quarter("end") * 0.01) + 1e-6, 2).alias("val"), F.date_add("end", 45).alias("filed"), F.lit("10-Q").alias("form"), F.lit(2).alias("k"))
    cover = F.when(F.col("entity") % 3 == 0, "CommonStockSharesOutstanding").otherwise("EntityCommonStockSharesOutstanding")
    shares = assets.filter("entity % 6 <> 5").withColumn("concept", cover).withColumn("val", (1000 + F.col("entity") * 10 + F.quarter("end")).cast("double"))
    return money.unionByName(assets).unionByName(shares)


FACTS = """fq AS (SELECT c_nationkey AS entity, date_trunc('quarter', o_orderdate)::DATE AS qs, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS v0, sum(o_totalprice) AS v1
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
fc AS (SELECT *, date_trunc('year', qs)::DATE AS y0, (qs + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS e, sum(v0) OVER w AS c0, sum(v1) OVER w AS c1 FROM fq WINDOW w AS (PARTITION BY entity, year(qs) ORDER BY qs)),
fs AS (SELECT entity, qs AS start, e, v0 AS a, v1 AS b, 0 AS k FROM fc UNION ALL SELECT entity, y0, e, c0, c1, 1 FROM fc WHERE month(qs) > 1),
ff AS (SELECT entity, start, e, k, round(a, 2) AS val, e + 45 AS filed, '10-Q' AS form FROM fs UNION ALL SELECT entity, start, e, k, round(b, 2), e + 120, '10-Q/A' FROM fs),
facts AS (SELECT entity, CASE WHEN entity % 5 = 0 THEN 'SalesRevenueNet' ELSE 'Revenues' END AS concept, start, e AS "end", val, filed, form, k FROM ff
  UNION ALL SELECT entity, 'CostOfRevenue', start, e, round(val * 0.6, 2), filed, form, k FROM ff
  UNION ALL SELECT entity, 'NetIncomeLoss', start, e, round(val * CASE WHEN entity % 7 = 0 THEN -0.05 ELSE 0.08 END + 1e-6, 2), filed, form, k FROM ff UNION ALL SELECT entity, 'GrossProfit', start, e, round(val * 0.45 + 1e-6, 2), filed, form, k FROM ff WHERE entity % 4 = 0
  UNION ALL SELECT DISTINCT entity, CASE WHEN entity % 3 = 0 THEN 'CommonStockSharesOutstanding' ELSE 'EntityCommonStockSharesOutstanding' END, NULL::DATE, e, (1000 + entity * 10 + quarter(e))::DOUBLE, e + 45, '10-Q', 2 FROM fc WHERE entity % 6 <> 5
  UNION ALL SELECT DISTINCT entity, 'Assets', NULL::DATE, e, round(abs(bal) * (1 + quarter(e) * 0.01) + 1e-6, 2), e + 45, '10-Q', 2 FROM fc JOIN (SELECT c_nationkey AS entity, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1) USING (entity))"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor rows (ticker, owner, start, end, exchange): parts as recycled tickers, suppliers as owners."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("T"), (F.col("l_partkey") % 200).cast("string")).alias("ticker"), F.col("l_suppkey").alias("owner")).agg(
        F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("end")).withColumn("exchange", F.when(F.col("owner") % 3 == 0, "NASDAQ").otherwise("NYSE"))


LISTINGS = """listings AS (SELECT 'T' || (l_partkey % 200) AS ticker, l_suppkey AS owner, min(l_shipdate)::DATE AS start, max(l_shipdate)::DATE AS "end",
  CASE WHEN l_suppkey % 3 = 0 THEN 'NASDAQ' ELSE 'NYSE' END AS exchange FROM lineitem GROUP BY 1, 2)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings (acc, cik, filed, sic, in_group, text) made of documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("acc"), (F.col("doc_id") % 97).alias("cik"), F.date_add(F.lit("2009-02-01").cast("date"), (F.col("doc_id") * 7 % 5000).cast("int")).alias("filed"),
        F.when(F.col("lang") == "en", "3674").when(F.col("lang") == "fr", "4911").when(F.col("lang") == "de", "7372").otherwise("2834").alias("sic"), "text")


FILINGS = """filings AS (SELECT doc_id AS acc, doc_id % 97 AS cik, DATE '2009-02-01' + (doc_id * 7 % 5000)::INT AS filed,
  CASE lang WHEN 'en' THEN '3674' WHEN 'fr' THEN '4911' WHEN 'de' THEN '7372' ELSE '2834' END AS sic, text FROM documents)"""


def holdings(spark: SparkSession, sf_dir: str, panel_: DataFrame) -> DataFrame:
    """(ticker, shares, cost) of every customer whose number is a ticker's, costs around each one's first close."""
    c = table(spark, sf_dir, "customer")
    first = panel_.groupBy("ticker").agg(F.min_by("close", "d").alias("px0"))
    h = c.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("ticker"), (F.col("c_custkey") % 7 + 1).cast("double").alias("shares"), F.col("c_acctbal").alias("bal"))
    return h.join(first, "ticker").select("ticker", "shares", F.round(F.col("px0") * (1 + F.col("bal") / 10000), 4).alias("cost"))


HOLDINGS = """holdings AS (SELECT 'S' || c_custkey AS ticker, (c_custkey % 7 + 1)::DOUBLE AS shares, round(px0 * (1 + c_acctbal / 10000), 4) AS cost
  FROM customer JOIN (SELECT ticker, arg_min(close, d) AS px0 FROM panel GROUP BY 1) f ON f.ticker = 'S' || c_custkey)"""
