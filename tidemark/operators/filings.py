"""Filing universe: latest filings, eligibility by year, tickers by date interval, status and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import UTILITY_SIC, role_category, sic_code
from tidemark.operators.panel import running, segment

LISTED_FROM = "2026-09-01"


def dedupe_index(rows: DataFrame, key: str = "acc", order: str = "seq") -> DataFrame:
    """One row a filing: of repeats the last wins."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("__r = 1").drop("__r")


def eligible(scores: DataFrame, first: int = 2010, last: int = 2026, rule: Column | None = None) -> DataFrame:
    """Company-years: the latest filing of the year before decides, then the rule is applied (never the other way round)."""
    cols = [c for c in scores.columns if c != "cik"]
    d = scores.withColumn("year", F.year("filed") + 1).filter(F.col("year").between(first, last))
    d = d.groupBy("year", "cik").agg(F.max_by(F.struct(*cols), F.struct("filed", "acc")).alias("__x")).select("year", "cik", "__x.*")
    return d.filter(F.col("in_group") & F.col("eligible_text") if rule is None else rule)


def latest_of_year(scores: DataFrame, year: int) -> DataFrame:
    cols = [c for c in scores.columns if c != "cik"]
    return scores.filter(F.year("filed") == year).groupBy("cik").agg(F.max_by(F.struct(*cols), F.struct("filed", "acc")).alias("__x")).select("cik", "__x.*")


def match_listing(claims: DataFrame, listings: DataFrame, seconds: int = 365 * 86400) -> DataFrame:
    """claims (claim, ticker, d0, d1) with the latest-ending listing of the ticker that overlaps d0..d1, or nulls.

    Ties go to the later start, then the least owner. A sweep, not a range join: distinct intervals and listings of a
    ticker in order of time, and the running greatest (end, start) of what began by d1 is the match if it ends at d0
    or later. It runs within years, with the greatest of earlier years carried, so one ticker is many tasks. Claims meet
    their interval in an equi-join that adaptive execution may split. Null tickers and days match nothing. Of rows with
    one claim and ticker the best match stays.
    """
    spans = listings.filter("ticker is not null and start is not null and `end` is not null").groupBy("ticker", "start", "end").agg(F.min(F.struct("owner", "exchange")).alias("x"))
    best = F.struct("end", "start", F.col("x.owner").alias("owner"), F.col("x.exchange").alias("exchange"))
    spans = spans.select("ticker", F.lit(None).cast("date").alias("d0"), F.col("start").alias("d1"), F.lit(0).alias("side"), best.alias("l"))
    asked = claims.select("ticker", "d0", "d1").filter("ticker is not null and d0 is not null and d1 is not null").distinct()
    asked = asked.select("ticker", "d0", "d1", F.lit(1).alias("side"), F.lit(None).cast(spans.schema["l"].dataType).alias("l"))
    rows = spans.unionByName(asked).withColumn("part", segment(F.col("d1"), seconds))
    swept = running(rows, "ticker", "part", ["d1", "side"], "l", "max", "best").withColumn("l", F.col("best")).filter((F.col("side") == 1) & (F.col("l.end") >= F.col("d0")))
    found = swept.select("ticker", "d0", "d1", F.col("l.start").alias("l_start"), F.col("l.end").alias("l_end"), "l.owner", "l.exchange")
    w = Window.partitionBy("claim", "ticker").orderBy(F.col("l_end").desc_nulls_last(), F.col("l_start").desc(), "owner")
    return claims.join(found, ["ticker", "d0", "d1"], "left").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def map_tickers(elig: DataFrame, own: DataFrame, stated: DataFrame, listings: DataFrame, listed_from: str = LISTED_FROM) -> DataFrame:
    """(year, cik, ticker, start, end, exchange, status, kept): one listing for each company-year, one company for each.

    elig: (year, cik, filed); own: (cik, pos, ticker) current symbols; stated: (cik, pos, filed, ticker) of filings.
    First choice is a current symbol with an active listing that began by the year's end; then a stated symbol, or it
    with a Q, whose listing covers that filing's day and lives after this year's filing, nearest filing first.
    Of companies with one listing in a year the owner of the symbol stays, then the lowest cik; kept marks it.
    """
    end = F.make_date("year", F.lit(12), F.lit(31))
    a = elig.join(own, "cik").select("year", "cik", F.lit(0).alias("tier"), F.lit(0).alias("near"), F.lit("").alias("said"), "pos", "ticker", F.lit(listed_from).cast("date").alias("d0"), F.lit("9999-12-31").cast("date").alias("d1"), F.lit(None).cast("date").alias("alive"), end.alias("y1"))
    s = stated.select("cik", "pos", F.col("filed").alias("s_filed"), F.explode(F.array("ticker", F.concat("ticker", F.lit("Q")))).alias("ticker"))
    near = F.when(F.col("s_filed") == F.col("filed"), -1).otherwise(F.abs(F.year("s_filed") - F.col("year") + 1))
    b = elig.join(s, "cik").select("year", "cik", F.lit(1).alias("tier"), near.alias("near"), F.col("s_filed").cast("string").alias("said"), "pos", "ticker", F.col("s_filed").alias("d0"), F.col("s_filed").alias("d1"), F.col("filed").alias("alive"), end.alias("y1"))
    claims = a.unionByName(b).withColumn("claim", F.concat_ws("|", "year", "cik", "tier", "near", "said", "pos"))
    m = match_listing(claims, listings).filter("l_start is not null")
    m = m.filter(F.when(F.col("tier") == 0, F.col("l_start") <= F.col("y1")).otherwise((F.col("l_start") <= F.col("y1")) & (F.col("l_end") >= F.col("alive"))))
    first = F.row_number().over(Window.partitionBy("year", "cik").orderBy("tier", "near", "said", "pos", "ticker"))
    m = m.withColumn("__r", first).filter("__r = 1").select("year", "cik", "tier", "ticker", F.col("l_start").alias("start"), F.col("l_end").alias("end"), "exchange")
    mine = own.select("cik", "ticker").distinct().withColumn("own", F.lit(True))
    m = m.join(mine, ["cik", "ticker"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    status = F.when(F.col("own") & (F.col("end") >= F.lit(listed_from).cast("date")), "listed").otherwise("delisted")
    w = Window.partitionBy("year", "ticker", "start").orderBy(F.col("own").desc(), "cik")
    m = m.withColumn("status", status).withColumn("kept", F.row_number().over(w) == 1).drop("tier", "own")
    return elig.select("year", "cik").join(m, ["year", "cik"], "left").withColumn("status", F.coalesce("status", F.lit("unmapped"))).withColumn("kept", F.coalesce("kept", F.lit(True)))


def status_of(rows: DataFrame) -> DataFrame:
    """(cik, status, ticker, start): listed in any year, else delisted in any, else unmapped; of the best class the last row."""
    best = F.when(F.col("status") == "listed", 2).when(F.col("status") == "delisted", 1).otherwise(0)
    return rows.groupBy("cik").agg(F.max_by(F.struct("status", "ticker", "start"), F.struct(best.alias("b"), "year")).alias("x")).select("cik", "x.*")


def status_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cik, old, new) where they differ; a missing side is null and differs."""
    return old.select("cik", F.col("status").alias("old")).join(new.select("cik", F.col("status").alias("new")), "cik", "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def stale_series(diff: DataFrame, prefix: str = "C") -> DataFrame:
    """(ticker) of the stored series to delete: those of companies that were listed and whose status is another now."""
    return diff.filter(F.col("old") == "listed").select(F.concat(F.lit(prefix), F.col("cik").cast("string")).alias("ticker")).distinct()


def key_spans(prices: DataFrame) -> DataFrame:
    """(ticker, first, last) of the keys made of a C and digits."""
    return prices.filter(F.col("ticker").rlike(r"^C\d+$") & F.col("close").isNotNull()).groupBy("ticker").agg(F.min("d").alias("first"), F.max("d").alias("last"))


def ra_score(d: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Adds score: hits of all groups per 10,000 words, of power alone for utility codes; 0 for filers out of the group.

    d has sic, in_group, words and hits_<group>; a text without words counts as of one word, null hits as none.
    """
    hit = lambda g: F.coalesce(F.col(f"hits_{g}"), F.lit(0))
    hits = F.when(sic_code(F.col("sic")).isin(*UTILITY_SIC), hit("power")).otherwise(sum((hit(g) for g in groups), F.lit(0)))
    return d.withColumn("score", F.when(F.col("in_group"), 1e4 * hits / F.greatest(F.col("words"), F.lit(1))).otherwise(0.0))


def review(filings: DataFrame, classes: DataFrame, members: DataFrame, revenue: DataFrame, floor: float = 100e6, least: float = 2.0) -> DataFrame:
    """(cik, ticker, kind, category): members whose class says no go (`remove`); others with score and revenue are
    candidates if their class says yes, and pending without a class.

    filings: (cik, acc, ticker, sic, score); classes: (acc, sells_into, role); members: (ticker, category).
    """
    d = filings.join(classes, "acc", "left").join(members.withColumnRenamed("category", "m_cat"), "ticker", "left").join(revenue, "cik", "left")
    kind = F.when(F.col("m_cat").isNotNull(), F.when(~F.col("sells_into"), "remove")).when((F.col("score") >= least) & (F.coalesce("revenue", F.lit(0.0)) >= floor), F.when(F.col("sells_into").isNull(), "pending").when(F.col("sells_into"), "candidate"))
    return d.withColumn("kind", kind).filter("kind is not null").select("cik", "ticker", "kind", F.when(F.col("kind") == "remove", F.col("m_cat")).otherwise(role_category(F.coalesce("role", F.lit("")), F.col("sic"), F.col("revenue"))).alias("category"))


def stress_clones(returns: DataFrame, eligible_: DataFrame, cal: DataFrame, clones: DataFrame, pad: int = 280) -> DataFrame:
    """(ticker, d, close) of stand-ins for companies without prices: the equal-weight index of the names eligible at the
    previous month-end, from `pad` rows before the first eligible year to the end, whose last day is one fall.

    returns: (ticker, d, ret); eligible_: (ticker, d) at month-ends; cal: (d, rn); clones: (cik, year, end, nasdaq).
    """
    ends = eligible_.select("d").distinct().withColumn("one", F.lit(1))
    w = Window.orderBy("d")
    days = cal.join(ends, "d", "left").withColumn("prev", F.max(F.when(F.col("one") == 1, F.col("d"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    first = ends.agg(F.min("d").alias("m0"))
    days = days.crossJoin(first).withColumn("prev", F.coalesce("prev", "m0")).select("d", "rn", "prev")
    member = eligible_.select("ticker", F.col("d").alias("prev"))
    r = returns.join(days.select("d", "prev"), "d").join(member, ["ticker", "prev"]).groupBy("d").agg(F.avg("ret").alias("ew"))
    level = days.join(r, "d", "left").withColumn("level", 100 * F.product(1 + F.coalesce("ew", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).select("d", "rn", "level")
    last = cal.agg(F.max("d").alias("last_d"))
    c = clones.groupBy("cik").agg(F.min("year").alias("y"), F.max("end").alias("end"), F.max("nasdaq").alias("nasdaq"))
    at = c.crossJoin(cal).filter(F.col("d") >= F.make_date("y", F.lit(1), F.lit(1))).groupBy("cik").agg(F.min("rn").alias("at"))
    c = c.join(at, "cik").crossJoin(last)
    s = c.join(level, (F.col("rn") >= F.greatest(F.col("at") - pad, F.lit(1))) & (F.col("d") <= F.col("end")))
    o = Window.partitionBy("cik").orderBy("rn")
    prev, final = F.lag("level").over(o), F.lead("level").over(o).isNull()
    drop = prev * F.when(F.col("nasdaq"), 0.45).otherwise(0.70)
    return s.withColumn("close", F.when(final & prev.isNotNull() & (F.col("end") <= F.col("last_d")), drop).otherwise(F.col("level"))).select(F.concat(F.lit("C"), F.col("cik").cast("string")).alias("ticker"), "d", "close")
