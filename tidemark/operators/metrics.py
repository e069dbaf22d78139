"""Performance: money- and time-weighted returns, drawdown, Newey-West, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH, STEPS = -0.9999, 100.0, 200


def xirr(flows: Column) -> Column:
    """Annual rate of an array of struct(t: years, f: amount) by bisection; null if the value has one sign at both ends."""

    def npv(r: Column) -> Column:
        return F.aggregate(flows, F.lit(0.0), lambda a, x: a + x["f"] / F.pow(1 + r, x["t"]))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        v = npv(mid)
        left = s["v"] * v <= 0
        return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"), F.when(left, s["v"]).otherwise(v).alias("v"))

    start = F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"), npv(F.lit(LOW)).alias("v"))
    rate = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(npv(F.lit(LOW)) * npv(F.lit(HIGH)) <= 0, rate)


def ledger_xirr(ledger: DataFrame, by: list[str], date: str = "exec") -> DataFrame:
    """(by, xirr): contributions out, and the last value back on the last day. Months of one scenario make one array."""
    w = Window.partitionBy(*by).orderBy(F.col(date).desc())
    first = F.min(date).over(Window.partitionBy(*by))
    d = ledger.withColumn("t", F.datediff(F.col(date), first) / 365.0).withColumn("f", -F.col("contribution") + F.when(F.row_number().over(w) == 1, F.col("value")).otherwise(0.0))
    return d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "f"))).alias("flows")).select(*by, xirr(F.col("flows")).alias("xirr"))


def twr(ledger: DataFrame, by: list[str], date: str = "exec") -> DataFrame:
    """Adds r = (value - contribution) / previous value - 1; null in a ledger's first month and after a value of zero."""
    return ledger.withColumn("r", F.try_divide(F.col("value") - F.col("contribution"), F.lag("value").over(Window.partitionBy(*by).orderBy(date))) - 1)


def yearly(returns: DataFrame, by: list[str], date: str = "exec") -> DataFrame:
    return returns.filter("r is not null").groupBy(*by, F.year(date).alias("year")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))


def growth(returns: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, cagr, vol, sharpe) of monthly returns; vol needs two, sharpe a positive vol."""
    g = returns.filter("r is not null").groupBy(*by).agg(F.count("r").alias("n"), F.product(1 + F.col("r")).alias("idx"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"))
    vol = F.when(F.col("n") > 1, F.col("sd") * F.sqrt(F.lit(12.0)))
    return g.select(*by, "n", (F.pow("idx", F.lit(12.0) / F.col("n")) - 1).alias("cagr"), vol.alias("vol"), F.when(vol > 0, F.col("mean") * 12 / vol).alias("sharpe"))


def drawdown(returns: DataFrame, by: list[str], date: str = "exec") -> DataFrame:
    """(by, max_dd): the least index over its running maximum, which starts at 1; at most 0."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = returns.filter("r is not null").withColumn("idx", F.product(1 + F.col("r")).over(w)).withColumn("top", F.greatest(F.lit(1.0), F.max("idx").over(w)))
    return d.groupBy(*by).agg(F.least(F.lit(0.0), F.min(F.col("idx") / F.col("top") - 1)).alias("max_dd"))


def newey_west(diffs: DataFrame, by: list[str], order: str, value: str = "x", lags: int = 6) -> DataFrame:
    """(by, t): mean over its Bartlett-weighted standard error; null where the variance isn't positive."""
    w = Window.partitionBy(*by)
    o = w.orderBy(order)
    d = diffs.withColumn("__m", F.avg(value).over(w)).withColumn("__n", F.count(value).over(w)).withColumn("__e", F.col(value) - F.col("__m"))
    s = F.col("__e") * F.col("__e")
    for j in range(1, lags + 1):
        s = s + 2 * (1 - j / (lags + 1)) * F.col("__e") * F.coalesce(F.lag("__e", j).over(o), F.lit(0.0))
    d = d.withColumn("__s", s)
    g = d.groupBy(*by).agg((F.sum("__s") / F.count(value)).alias("s"), F.avg(value).alias("m"), F.count(value).alias("n"))
    return g.select(*by, F.when(F.col("s") > 0, F.col("m") / F.sqrt(F.col("s") / F.col("n"))).alias("t"))


def midrank(draws: DataFrame, by: list[str], value: str, x: Column) -> DataFrame:
    """(by, percentile): 100 times the share of draws below x plus half of those equal."""
    return draws.groupBy(*by).agg((100 * F.avg(F.when(F.col(value) < x, 1.0).when(F.col(value) == x, 0.5).otherwise(0.0))).alias("percentile"))


def dca(prices: DataFrame, by: list[str], contribution: float = 2500.0, order: str = "d") -> DataFrame:
    """Adds value: what equal monthly contributions without cost are worth, in closed form."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return prices.withColumn("value", F.sum(F.lit(contribution) / F.col("px")).over(w) * F.col("px"))


EDGES = 255  # bounds of the histogram by which quantiles are found


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """(by, q, value): each group's quantiles, interpolated between the two ranks around q * (n - 1); nulls don't count.

    Two passes: a histogram of all groups, whose bounds are estimated quantiles of the whole, tells in which of its 256
    ranges a rank lies, with exact counts; only the values of those ranges are then sorted, range by range. So no task
    holds a group's values, and values that repeat are counted before they are shuffled. Groups without values have no row.
    """
    d = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    edges = d.agg(F.percentile_approx("__v", [k / (EDGES + 1) for k in range(1, EDGES + 1)], 10_000)).first()[0]
    if not edges:
        return d.select(*by, F.lit(None).cast("double").alias("q"), F.col("__v").alias(value)).limit(0)
    up = F.array(*[F.lit(e) for e in sorted(set(edges))])
    c = d.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.size(F.filter(up, lambda e: e < F.col("__v"))))
    keys = [F.col(k) for k in by]
    ranges = c.groupBy(*by, "__b").agg(F.sum("__n").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b")
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.select(*by, "__b", before.alias("__before"), "__n", total.alias("__all"))
    ranges = ranges.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("__at", F.col("q") * (F.col("__all") - 1))
    ranges = ranges.withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))))
    hit = ranges.filter((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
    hit = hit.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(by)], F.col("__b").alias("__in"), "q", "__at", "__rank", "__before")
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(by)] + [F.col("__b") == F.col("__in")]
    wanted = hit.select(*[c for c in hit.columns if c.startswith("__") and c[2:].isdigit()], "__in").distinct()
    some = c.join(wanted, same, "left_semi").withColumn("__upto", F.sum("__n").over(inside))
    found = some.join(hit, same).filter((F.col("__rank") >= F.col("__before") + F.col("__upto") - F.col("__n")) & (F.col("__rank") < F.col("__before") + F.col("__upto")))
    low, high = F.min("__v"), F.max("__v")
    return found.groupBy(*by, "q", "__at").agg((low + (high - low) * (F.col("__at") - F.floor("__at"))).alias(value)).drop("__at")
