"""Calendar and panel alignment: long frames, windows by calendar row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILL = 4  # rows that a close is carried: one must exist within the last five
STALE = FILL + 1


def calendar(dates: DataFrame, col: str = "d") -> DataFrame:
    """(d, rn): distinct days and their 1-based number. A calendar has some thousand rows, whatever the panel holds."""
    return dates.filter(F.col(col).isNotNull()).select(F.col(col).alias("d")).distinct().withColumn("rn", F.row_number().over(Window.orderBy("d")))


def align(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """(ticker, grp, d, rn, raw): every ticker on every calendar day, null where it has no close."""
    tickers = panel.groupBy("ticker").agg(F.min("grp").alias("grp"))
    return tickers.crossJoin(F.broadcast(cal)).join(panel.select("ticker", "d", F.col("close").alias("raw")), ["ticker", "d"], "left").select("ticker", "grp", "d", "rn", "raw")


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("rn")


def fill(grid: DataFrame, limit: int = FILL) -> DataFrame:
    """Adds px (raw carried over at most `limit` rows) and full (carried without limit)."""
    w = by_ticker()
    return grid.withColumn("px", F.last("raw", True).over(w.rowsBetween(-limit, 0))).withColumn("full", F.last("raw", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def chunks(grid: DataFrame, size: int = 1024, halo: int = 256) -> DataFrame:
    """grid dealt into pieces of `size` calendar rows: adds chunk, and own; each piece also has the `halo` rows before it, not own.

    Windows that look back at most `halo` rows are right on own rows when they are cut by (ticker, chunk), so a long
    series is many tasks. A row is in one piece, or in the next ones as well if it is near their start.
    """
    at = lambda r: F.floor((r - 1) / size).cast("int")
    d = grid.select("*", F.explode(F.sequence(at(F.col("rn")), at(F.col("rn") + halo))).alias("chunk"))
    return d.withColumn("own", F.col("chunk") == at(F.col("rn")))


def month_ends(cal: DataFrame) -> DataFrame:
    """(d): the last day present in each month."""
    return cal.groupBy(F.trunc("d", "MM").alias("m")).agg(F.max("d").alias("d")).select("d")


def next_weekday(d):
    """The next Monday-to-Friday day after d; holidays aren't modelled."""
    n = F.dayofweek(d)  # 1 Sunday ... 7 Saturday
    return F.date_add(d, F.when(n == 6, 3).when(n == 7, 2).otherwise(1))


def completed_month_ends(cal: DataFrame, t, ref) -> DataFrame:
    """Month-ends up to t; t's own month counts if t is its last weekday, or ref, rolled to a weekday, is in a later month."""
    t, ref = F.lit(t).cast("date"), F.lit(ref).cast("date")
    rolled = F.when(F.dayofweek(ref) == 7, F.date_add(ref, 2)).when(F.dayofweek(ref) == 1, F.date_add(ref, 1)).otherwise(ref)
    closed = (F.trunc(next_weekday(t), "MM") > F.trunc(t, "MM")) | (F.trunc(rolled, "MM") > F.trunc(t, "MM"))
    return month_ends(cal.filter(F.col("d") <= t)).filter((F.trunc("d", "MM") < F.trunc(t, "MM")) | closed)


def fill_dates(cal: DataFrame) -> DataFrame:
    """(d, exec): each day and the next calendar day."""
    return cal.select("d", F.lead("d").over(Window.orderBy("d")).alias("exec"))


def asof_day(panel: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """(d): the last day on which at least half of the best day's closes exist, among `tickers` only if given."""
    p = panel if tickers is None else panel.join(tickers, "ticker", "left_semi")
    n = p.groupBy("d").agg(F.count("close").alias("n"))
    best = n.agg(F.max("n").alias("top"))
    return n.crossJoin(best).filter(F.col("n") * 2 >= F.col("top")).agg(F.max("d").alias("d"))


def coverage(grid: DataFrame, rows: int = STALE, floor: float = 0.90) -> DataFrame:
    """(fresh, tickers, coverage, ok): share of tickers with a close in the calendar's last rows."""
    last = grid.agg(F.max("rn").alias("top"))
    g = grid.crossJoin(last).groupBy("ticker").agg(F.max(F.when(F.col("raw").isNotNull() & (F.col("rn") > F.col("top") - rows), 1).otherwise(0)).alias("fresh"))
    return g.agg(F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("tickers")).withColumn("coverage", F.col("fresh") / F.col("tickers")).withColumn("ok", F.col("coverage") >= floor)


SEGMENT = 30 * 86400  # seconds of a segment of time


def segment(t, seconds: int = SEGMENT):  # noqa: ANN001, ANN201
    """Number of the segment of a day or time; null for null."""
    return F.floor(F.unix_seconds(t.cast("timestamp")) / seconds)


def running(rows: DataFrame, on: str, seg: str, order: list[str], value: str, how: str, out: str) -> DataFrame:
    """Adds the last (or first, or greatest) value that isn't null of the rows up to this one (`first`: from this one on).

    Rows of a key are swept within their segments of time, which one task each can hold, however long the key is. One value
    of each segment, a table of keys times segments, is carried across in a second small window. `seg` must not fall in
    the order of `order`. Null keys are a key, a null segment the first one.
    """
    w = Window.partitionBy(on, seg).orderBy(*order)
    to_here, on_wards = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    by, known = F.struct(*order), F.col(value).isNotNull()
    local = {"last": F.last(value, True).over(to_here), "first": F.first(value, True).over(on_wards), "max": F.max(value).over(to_here)}[how]
    one = {"last": F.max_by(value, F.when(known, by)), "first": F.min_by(value, F.when(known, by)), "max": F.max(value)}[how]
    across = Window.partitionBy("__on").orderBy(F.col("__seg").asc_nulls_first())
    before, behind = across.rowsBetween(Window.unboundedPreceding, -1), across.rowsBetween(1, Window.unboundedFollowing)
    carried = {"last": F.last("__one", True).over(before), "first": F.first("__one", True).over(behind), "max": F.max("__one").over(before)}[how]
    segs = rows.groupBy(F.col(on).alias("__on"), F.col(seg).alias("__seg")).agg(one.alias("__one")).select("__on", "__seg", carried.alias("__carried"))
    d = rows.withColumn("__local", local).join(segs.filter("__carried is not null"), F.col(on).eqNullSafe(F.col("__on")) & F.col(seg).eqNullSafe(F.col("__seg")), "left")
    both = F.greatest("__local", "__carried") if how == "max" else F.coalesce("__local", "__carried")
    return d.withColumn(out, both).drop("__local", "__carried", "__on", "__seg")


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, value: str, out: str, seconds: int = SEGMENT) -> DataFrame:
    """left with the value of right's latest row at or before left_time, by key: a union swept by segments of time, no range join.

    Of right rows with one key and time the greatest value counts; those without time or value, and left rows without time, meet nothing.
    """
    r = right.filter(F.col(right_time).isNotNull()).groupBy(on, F.col(right_time).alias("__t")).agg(F.max(value).alias("__v"))
    cols = [F.col(c) for c in left.columns]
    rows = left.select(*cols, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(r.dtypes)["__v"]).alias("__v"))
    blank = [F.col(on) if c == on else F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    rows = rows.unionByName(r.select(*blank, "__t", F.lit(0).alias("__side"), "__v")).withColumn("__part", segment(F.col("__t"), seconds))
    return running(rows, on, "__part", ["__t", "__side"], "__v", "last", out).filter("__side = 1").select(*left.columns, out)


def forward_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, out: str, seconds: int = SEGMENT) -> DataFrame:
    """left with right's first time at or after left_time, by key, or null. A left row without time stands before all times."""
    rows = left.select(*[F.col(c) for c in left.columns], F.col(left_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(dict(right.dtypes)[right_time]).alias("__v"))
    blank = [F.col(on) if c == on else F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    ahead = right.filter(F.col(right_time).isNotNull()).select(*blank, F.col(right_time).alias("__t"), F.lit(1).alias("__side"), F.col(right_time).alias("__v"))
    rows = rows.unionByName(ahead).withColumn("__part", segment(F.col("__t"), seconds))
    return running(rows, on, "__part", ["__t", "__side"], "__v", "first", out).filter("__side = 0").select(*left.columns, out)


def prune_history(grid: DataFrame, first, lookback: int) -> DataFrame:
    """Rows that windows of `lookback` rows need for days from `first` on; Catalyst doesn't move a date filter below a window."""
    cut = grid.filter(F.col("d") >= F.lit(first).cast("date")).agg((F.min("rn") - lookback).alias("cut"))
    return grid.crossJoin(cut).filter("rn >= cut").drop("cut")
