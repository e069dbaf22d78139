"""Point-in-time fundamentals: which version of a fact was known on a day, trailing years, instants and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag, ratio

# Days of each class of period, age at which a value is stale, and the concepts of each metric in order.
CLASSES = {"quarter": (80, 100), "half": (170, 200), "nine": (260, 290), "annual": (350, 380)}
MAX_AGE = 500
CONCEPTS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet"),
    "cost": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization"),
    "gross": ("GrossProfit",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "assets": ("Assets",),
    "shares": ("EntityCommonStockSharesOutstanding",),
    "shares_filed": ("CommonStockSharesOutstanding",),
}


def concept_rows(spark, concepts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(m, c, k) for m, cs in (concepts or CONCEPTS).items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, "metric string, concept string, rank int")


def flatten_companyfacts(raw: DataFrame) -> DataFrame:
    """(entity, taxonomy, concept, unit, start, end, val, filed, form, seq) of nested documents (entity, facts).

    facts: map of taxonomy to map of concept to struct(units: map of unit to array of items). Items without value, end or filing day go.
    """
    d = raw.select("entity", F.explode("facts").alias("taxonomy", "c")).select("entity", "taxonomy", F.explode("c").alias("concept", "u"))
    d = d.select("entity", "taxonomy", "concept", F.explode("u.units").alias("unit", "items")).select("entity", "taxonomy", "concept", "unit", F.posexplode("items").alias("seq", "i"))
    day = lambda c: F.to_date(F.col(c))
    return d.select("entity", "taxonomy", "concept", "unit", day("i.start").alias("start"), day("i.end").alias("end"), F.col("i.val").cast("double").alias("val"), day("i.filed").alias("filed"), "i.form", "seq").filter("val is not null and `end` is not null and filed is not null")


def duration_class(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    out = F.when(start.isNull(), None)
    for name, (lo, hi) in CLASSES.items():
        out = out.when(days.between(lo, hi), name)
    return out


ITEM = ("entity", "metric", "start", "end")
KEY = ("entity", "metric", "asof")


def versions(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Each item's best version with the days from which it is known (filed, exclusive) and until which it is the best.

    Best: concept rank, then latest filed, then first seen. A version holds until a better one is filed; an amendment of
    a worse concept never becomes one. One exchange by item, with the day's own best taken before it.
    """
    f = facts.join(F.broadcast(concepts), "concept")  # a few dozen concepts, fixed in code
    day = f.groupBy(*ITEM, "filed").agg(F.min(F.struct("rank", "k", "val")).alias("x"))
    w = Window.partitionBy(*ITEM).orderBy("filed")
    own = F.struct(F.col("x.rank").alias("rank"), (-F.unix_date("filed")).alias("age"), F.col("x.k").alias("k"), F.col("x.val").alias("val"))
    d = day.withColumn("own", own).withColumn("best", F.min("own").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("filed").over(w))
    return d.select(*ITEM, "best.val", F.date_from_unix_date(-F.col("best.age")).alias("filed"), F.col("best.rank").alias("rank"), F.col("best.k").alias("k"), F.col("filed").alias("since"), "until")


def known(facts: DataFrame, asofs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per (entity, metric, asof, start, end) the item known before asof: best concept, then latest filed, then first seen.

    asofs: (asof), a calendar of some hundred days that every version looks up by itself, or (entity, asof), which meet in
    an equi-join on the entity. Either way an item and a day give one row: versions are cut into spans of days before.
    """
    v = versions(facts, concepts)
    here = (F.col("asof") > F.col("since")) & (F.col("until").isNull() | (F.col("asof") <= F.col("until")))
    if "entity" in asofs.columns:
        rows = v.join(asofs.distinct(), "entity").filter(here)
    else:
        days = asofs.agg(F.array_sort(F.collect_set("asof")).alias("days")).scalar()
        fits = lambda d: (d > F.col("since")) & (F.col("until").isNull() | (d <= F.col("until")))
        rows = v.withColumn("days", days).withColumn("asof", F.explode(F.filter("days", fits)))
    return rows.drop("since", "until", "days").withColumn("cls", duration_class(F.col("start"), F.col("end")))


def _items() -> Column:
    """An item as it sorts: by end, of equal ends the longest first, and then last in descending order."""
    return F.struct("end", (-F.unix_date(F.coalesce("start", F.lit("1970-01-01").cast("date")))).alias("late"), "start", "val", "cls")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: what stands outside of a function of array elements would be done for each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trailing(items: Column, bound: Column | None = None) -> Column:
    """struct(val, end) of an array of items: latest year plus year-to-date minus the prior year's, else the latest year."""
    days = lambda i: F.datediff(i["end"], i["start"])
    near = lambda i, day: (i["start"] > F.date_sub(day, 5)) & (i["start"] <= F.date_add(day, 5)) & (i["end"] > day)
    far = lambda i, y: F.abs(F.datediff(y["end"], i["end"]) - 365)

    def with_items(its: Column) -> Column:
        return let(F.array_max(F.filter(its, lambda i: i["cls"] == "annual")), lambda fy: with_year(its, fy))

    def with_year(its: Column, fy: Column) -> Column:
        return let(F.array_max(F.filter(its, lambda i: i["cls"].isin("quarter", "half", "nine") & near(i, fy["end"]))), lambda y: with_part(its, fy, y))

    def with_part(its: Column, fy: Column, y: Column) -> Column:
        prior = F.filter(its, lambda i: i["start"].isNotNull() & (F.abs(days(i) - days(y)) <= 10) & (far(i, y) <= 10))
        # The nearest to a year before; of equally near ones the later, then the longer.
        best = F.array_max(F.transform(prior, lambda i: F.struct((-far(i, y)).alias("near"), i["end"].alias("end"), i["late"].alias("late"), i["val"].alias("val"))))
        return let(best, lambda p: picked(fy, y, p))

    def picked(fy: Column, y: Column, p: Column) -> Column:
        year = F.struct(fy["val"].alias("val"), fy["end"].alias("end"))
        return F.when(fy.isNull(), None).when(p.isNull(), year).otherwise(F.struct((fy["val"] + y["val"] - p["val"]).alias("val"), y["end"].alias("end")))

    return let(items if bound is None else F.filter(items, lambda i: i["end"] <= bound), with_items)


def ttm(known_: DataFrame) -> DataFrame:
    """(entity, metric, asof, val, end) of trailing years. One exchange: the items of a key, as many as a company has
    periods, are picked from in one expression."""
    d = known_.groupBy(*KEY).agg(F.collect_list(_items()).alias("items")).withColumn("t", trailing(F.col("items")))
    return d.filter("t is not null").select(*KEY, "t.val", "t.end")


def instant(known_: DataFrame) -> DataFrame:
    """(entity, metric, asof, val, end) of the latest item without a start, of which an end has one."""
    return known_.filter("start is null").groupBy(*KEY).agg(F.max(F.struct("end", "val")).alias("x")).select(*KEY, "x.val", "x.end")


def fresh(d: DataFrame, age: int = MAX_AGE) -> DataFrame:
    return d.filter(F.datediff("asof", "end") <= age)


FUNDAMENTALS = ("revenue_ttm", "revenue_ttm_prev", "revenue_growth", "gross_profit_ttm", "assets", "gp_assets", "net_income_ttm", "shares", "fund_end")


def fundamentals(known_: DataFrame, age: int = MAX_AGE) -> DataFrame:
    """(entity, asof, *FUNDAMENTALS) as known at each day; days on which nothing is known and fresh have no row.

    Gross profit is the filed one, else revenue less the cost of the same end; shares are the cover's, else the balance
    sheet's, and dropped if stale after that choice. All items of an entity and day come together once.
    """
    of = lambda m: F.collect_list(F.when(F.col("metric") == m, _items())).alias(m)
    d = known_.filter(F.col("metric").isin(*CONCEPTS)).groupBy("entity", "asof").agg(*[of(m) for m in CONCEPTS])
    last = lambda m: F.array_max(F.filter(F.col(m), lambda i: i["start"].isNull()))
    new = lambda c: F.when(F.datediff("asof", c["end"]) <= age, c)
    pair = lambda c: F.when(c.isNotNull(), F.struct(c["val"].alias("val"), c["end"].alias("end")))
    d = d.withColumns({"rev": trailing(F.col("revenue")), "c": trailing(F.col("cost")), "g": trailing(F.col("gross")), "ni": trailing(F.col("net_income")), "a": pair(last("assets")), "sh": F.coalesce(pair(last("shares")), pair(last("shares_filed")))})
    d = d.withColumns({c: new(F.col(c)) for c in ("rev", "g", "ni", "a", "sh")})
    d = d.withColumn("prev", F.when(F.col("rev").isNotNull(), trailing(F.col("revenue"), F.date_sub("rev.end", 330))))
    gross = F.coalesce(F.col("g.val"), F.when(F.col("c.end") == F.col("rev.end"), F.col("rev.val") - F.col("c.val")))
    out = d.select(
        "entity", "asof", F.col("rev.val").alias("revenue_ttm"), F.col("prev.val").alias("revenue_ttm_prev"), gross.alias("gross_profit_ttm"), F.col("a.val").alias("assets"),
        F.col("ni.val").alias("net_income_ttm"), F.col("sh.val").alias("shares"), F.col("rev.end").alias("fund_end"))
    out = out.withColumn("revenue_growth", F.when(F.col("revenue_ttm_prev") > 0, ratio(F.col("revenue_ttm"), F.col("revenue_ttm_prev")) - 1))
    out = out.withColumn("gp_assets", F.when(F.col("assets") != 0, ratio(F.col("gross_profit_ttm"), F.col("assets"))))
    return out.filter(F.coalesce(*[F.col(c).cast("string") for c in FUNDAMENTALS]).isNotNull()).select("entity", "asof", *FUNDAMENTALS)


def fund_factors(d: DataFrame) -> DataFrame:
    """Adds earnings_yield (positive capitalisation only), speculative (a known loss) and fund_missing. Needs net_income_ttm, shares, close."""
    cap = F.col("close") * F.col("shares")
    return d.withColumn("earnings_yield", F.when(cap > 0, ratio(F.col("net_income_ttm"), cap))).withColumn("speculative", flag(F.col("net_income_ttm") < 0)).withColumn("fund_missing", F.col("shares").isNull() & F.col("net_income_ttm").isNull())


def revisions(trend: Column, revs: Column) -> tuple[Column, Column]:
    """(rev_chg, rev_breadth) of arrays of struct(current, d90) and struct(up30, down30); null where no term exists."""
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    ok = F.filter(trend, lambda x: x["current"].isNotNull() & x["d90"].isNotNull() & (x["d90"] != 0))
    chg = F.transform(ok, lambda x: F.greatest(F.least((x["current"] - x["d90"]) / F.abs(x["d90"]), F.lit(0.5)), F.lit(-0.5)))
    both = F.filter(revs, lambda x: x["up30"].isNotNull() & x["down30"].isNotNull())
    breadth = F.transform(both, lambda x: (x["up30"] - x["down30"]) / F.greatest(x["up30"] + x["down30"], F.lit(1)))
    return mean(chg), mean(breadth)


def members(eligible_years: DataFrame, revenue: DataFrame, floor: float) -> DataFrame:
    """(entity, asof) eligible in the day's year with a trailing revenue of at least the floor."""
    return revenue.filter(F.col("val") >= floor).withColumn("year", F.year("asof")).join(eligible_years, ["entity", "year"], "left_semi").select("entity", "asof")
