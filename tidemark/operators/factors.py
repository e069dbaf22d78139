"""Rolling price factors: one window exchange for every frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag, ratio
from tidemark.operators.panel import FILL, align, by_ticker, chunks

BAND = 0.02
BREADTH = 0.40


@dataclass(frozen=True)
class Spec:
    """Rows of the windows; the defaults are trading days of a month, half a year, a year and two moving averages."""

    history: int = 273
    month: int = 21
    half: int = 126
    year: int = 252
    short: int = 50
    long: int = 200


def full_mean(col: str, n: int, w):
    """Mean of the last n rows; null unless all n are there."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(f) == n, F.avg(col).over(f))


def factors(filled: DataFrame, s: Spec = Spec(), by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds close, n_days, returns, volatility, momentum, the year's high, moving averages, trend and eligibility.

    Rows only look back: the values at a day don't change with later ones. n_days counts `raw` from the first row of a
    group of `by`, and on from the column `days_before` where there is one.
    """
    w = Window.partitionBy(*by).orderBy("rn")
    back = lambda k: F.lag("px", k).over(w)
    year = w.rowsBetween(-(s.year - 1), 0)
    d = filled.withColumn("ret", ratio(F.col("px"), back(1)) - 1).withColumn("c_m", back(s.month)).withColumn("c_h", back(s.half)).withColumn("c_y", back(s.year))
    d = d.withColumns({
        "n_days": F.count("raw").over(w.rowsBetween(Window.unboundedPreceding, 0)) + (F.col("days_before") if "days_before" in filled.columns else F.lit(0)), "sd": F.stddev_samp("ret").over(year), "hi": F.max("px").over(year),
        "sma50": full_mean("px", s.short, w), "sma200": full_mean("px", s.long, w), "n_ret": F.count("ret").over(year),
    })
    d = d.withColumns({
        "close": F.col("px"), "ret_1m": ratio(F.col("px"), F.col("c_m")) - 1, "ret_6m": ratio(F.col("px"), F.col("c_h")) - 1, "ret_12m": ratio(F.col("px"), F.col("c_y")) - 1,
        "ret_12_1": ratio(F.col("c_m"), F.col("c_y")) - 1, "vol_252": F.when(F.col("c_y").isNotNull() & (F.col("n_ret") > 1), F.col("sd") * F.sqrt(F.lit(float(s.year)))),
        "hi52": ratio(F.col("px"), F.col("hi")), "above200": flag(F.col("px") > F.col("sma200")),
    })
    d = d.withColumns({
        "mom_raw": ratio(F.col("ret_12_1"), F.col("vol_252")), "dd_52w": F.col("hi52") - 1, "trend": F.col("above200") & flag(F.col("sma50") > F.col("sma200")),
        "eligible": (F.col("n_days") >= s.history) & flag(F.col("px") > 0),
    })
    return d.select(*FACTOR_COLUMNS, *[c for c in ("own",) if c in d.columns])


def chunked_factors(panel: DataFrame, cal: DataFrame, s: Spec = Spec(), size: int = 1024) -> DataFrame:
    """The factor frame of `factors(fill(align(panel, cal)))`, with a ticker's series cut into pieces of `size` calendar rows.

    A piece carries the rows before it that its windows reach. What reaches further back, the count of days with a close,
    is summed by piece first: a table of tickers times pieces, broadcast by Spark only if that is small.
    """
    halo = max(s.year + 1, s.long, s.half, s.month) + FILL + 1
    p = panel.filter(F.col("close").isNotNull() & F.col("ticker").isNotNull()).join(F.broadcast(cal), "d")
    lead = Window.partitionBy("ticker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    n = p.groupBy("ticker", F.floor((F.col("rn") - 1) / size).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    every = cal.agg(F.max("rn").alias("rows")).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / size).cast("int"))).alias("chunk"))
    n = panel.select("ticker").distinct().crossJoin(F.broadcast(every)).join(n, ["ticker", "chunk"], "left")
    n = n.select("ticker", "chunk", F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("days"))
    d = chunks(align(panel, cal), size, halo).join(n, ["ticker", "chunk"])
    w = Window.partitionBy("ticker", "chunk").orderBy("rn")
    d = d.withColumn("px", F.last("raw", True).over(w.rowsBetween(-FILL, 0)))
    # Days of the halo are counted in the piece that owns them.
    extra = F.count(F.when(~F.col("own"), F.col("raw"))).over(Window.partitionBy("ticker", "chunk"))
    return factors(d.withColumn("days_before", F.col("days") - extra), s, ("ticker", "chunk")).filter("own").drop("own")


FACTOR_COLUMNS = ("ticker", "grp", "d", "rn", "close", "n_days", "ret", "ret_1m", "ret_6m", "ret_12m", "ret_12_1", "vol_252", "mom_raw", "hi52", "dd_52w", "sma50", "sma200", "above200", "trend", "eligible")


def chart_series(panel: DataFrame, last: int = 252, n: int = 200) -> DataFrame:
    """(ticker, d, close, sma): a ticker's last closes with their mean over n closes; the average counts closes, not calendar rows.

    The mean is null until there are n closes. Null closes and tickers are left out.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    d = panel.filter(F.col("close").isNotNull() & F.col("ticker").isNotNull()).select("ticker", "d", "close", full_mean("close", n, w).alias("sma"))
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("d").desc()))
    return d.withColumn("__back", back).filter(F.col("__back") <= last).drop("__back")


def monthly_sma(month_close: DataFrame, n: int = 10) -> DataFrame:
    """Month-end closes against the mean of the last n month-ends: level, up and below (null level: neither)."""
    w = Window.partitionBy("ticker").orderBy("d")
    d = month_close.withColumn("level", full_mean("close", n, w))
    return d.withColumn("up", flag(F.col("close") > F.col("level"))).withColumn("below", F.col("level").isNotNull() & ~flag(F.col("close") > F.col("level")))


def band(fac: DataFrame, width: float = BAND) -> DataFrame:
    """up: above the long average by the band, the short one above the long; below: under it by the band."""
    return fac.withColumn("up", flag((F.col("close") > (1 + width) * F.col("sma200")) & (F.col("sma50") > F.col("sma200")))).withColumn("below", flag(F.col("close") < (1 - width) * F.col("sma200")))


def fip(filled: DataFrame, s: Spec = Spec()) -> DataFrame:
    """Adds fip: sign of the return over t-year..t-month times (falls - rises) / returns in it; null without both ends."""
    w = by_ticker()
    span = w.rowsBetween(-(s.year - 1), -s.month)
    d = filled.withColumn("ret", ratio(F.col("px"), F.lag("px", 1).over(w)) - 1)
    past = ratio(F.lag("px", s.month).over(w), F.lag("px", s.year).over(w)) - 1
    n = F.count("ret").over(span)
    tilt = F.sum((F.col("ret") < 0).cast("int")).over(span) - F.sum((F.col("ret") > 0).cast("int")).over(span)
    return d.withColumn("fip", F.when(past.isNotNull() & (n > 0), F.signum(past) * tilt / n))


def below_before(month_fac: DataFrame) -> DataFrame:
    """Adds below_prev: the close was not above a known long average at the previous month-end. Filter months after, not before."""
    below = F.col("sma200").isNotNull() & ~F.col("above200")
    return month_fac.withColumn("below", below).withColumn("below_prev", flag(F.lag("below", 1).over(Window.partitionBy("ticker").orderBy("d"))))


def regime(month_fac: DataFrame, bench: DataFrame, n: int = 200, floor: float = BREADTH) -> DataFrame:
    """(d, breadth, above, brake): share of eligible names above their long average, and the benchmark above its own."""
    b = month_fac.groupBy("d").agg(F.avg(F.when(F.col("eligible"), F.col("above200").cast("double"))).alias("breadth"))
    w = Window.orderBy("d")
    spy = bench.withColumn("sma", full_mean("close", n, w)).select("d", flag(F.col("close") > F.col("sma")).alias("above"))
    return b.join(spy, "d", "left").withColumn("above", flag(F.col("above"))).withColumn("brake", ~F.col("above") | F.col("breadth").isNull() | flag(F.col("breadth") < floor))
