"""Selection: top-N under group caps, rotation and ranked buys, position caps, sell rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag
from tidemark.operators.score import BUY, HOLD

PER_GROUP, ROTATE, MAX_NAMES, BRAKED = 3, 10, 10, 2
STOP = 0.65
CAPS_FROM, CAP_POSITION, CAP_GROUP, CAP_SPEC, CAP_SPEC_TOTAL = 25_000.0, 0.10, 0.30, 0.03, 0.10


def group_key(grp: str = "grp", ticker: str = "ticker") -> Column:
    """The group, or the ticker's own where it is null or empty."""
    return F.coalesce(F.concat(F.lit("g:"), F.nullif(F.col(grp), F.lit(""))), F.concat(F.lit("t:"), F.col(ticker)))


def take_by_group(d: DataFrame, order: list[Column], limit: int, by: tuple[str, ...] = ("d",), per_group: int = PER_GROUP, out: str = "pick") -> DataFrame:
    """The first `limit` rows of each `by` in the order, at most per_group of a group: the greedy walk as two numberings."""
    part = [F.col(c) for c in by]
    first = d.withColumn("__g", F.row_number().over(Window.partitionBy(*part, group_key()).orderBy(*order))).filter(F.col("__g") <= per_group)
    return first.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col(out) <= limit).drop("__g")


def uptrend(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("eligible") & F.col("composite").isNotNull() & flag(F.col("trend")))


def rotation_buys(scored: DataFrame, held: DataFrame, budget: float, limit: int = ROTATE, by: tuple[str, ...] = ("d",)) -> DataFrame:
    """Up to ten uptrend names, the least held first, then by composite and ticker; the budget in equal parts. held: (ticker, held)."""
    up = uptrend(scored).join(held, "ticker", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    pick = take_by_group(up, [F.col("held").asc(), F.col("composite").desc(), F.col("ticker").asc()], limit, by)
    return pick.withColumn("dollars", F.lit(budget) / F.count(F.lit(1)).over(Window.partitionBy(*by)))


def capped(scored: DataFrame, positions: DataFrame) -> DataFrame:
    """(ticker) that may receive no new money. positions: (ticker, value, grp). No caps below 25,000 in all."""
    # Positions are a portfolio: some dozen rows.
    p = positions.join(scored.select("ticker", "speculative"), "ticker", "left").withColumn("spec", flag(F.col("speculative")))
    p = p.select("ticker", "value", "spec", group_key().alias("g"))
    total = p.agg(F.sum("value").alias("port"), F.coalesce(F.sum(F.when(F.col("spec"), F.col("value"))), F.lit(0.0)).alias("spec_total"))
    groups = p.groupBy("g").agg(F.sum("value").alias("in_group"))
    d = scored.select("ticker", flag(F.col("speculative")).alias("spec"), group_key().alias("g")).join(p.select("ticker", "value"), "ticker", "left").join(groups, "g", "left").crossJoin(total)
    pos, port = F.coalesce("value", F.lit(0.0)), F.col("port")
    hit = (pos >= CAP_POSITION * port) | (F.coalesce("in_group", F.lit(0.0)) >= CAP_GROUP * port) | (F.col("spec") & ((pos >= CAP_SPEC * port) | (F.col("spec_total") >= CAP_SPEC_TOTAL * port)))
    return d.filter((port >= CAPS_FROM) & hit).select("ticker")


def buy_pool(scored: DataFrame, positions: DataFrame, gate: str = "G1") -> DataFrame:
    d = scored.filter(F.col("eligible") & F.col("composite").isNotNull())
    return (d.filter(flag(F.col("trend"))) if gate == "G1" else d).join(capped(scored, positions), "ticker", "left_anti")


def ranked_buys(scored: DataFrame, positions: DataFrame, rule: str = "Nvar", gate: str = "G1", brake: Column | bool = False, by: tuple[str, ...] = ("d",)) -> DataFrame:
    """Nvar: composites from 0.85, ten at most; N3: three. Under the brake the first two of them."""
    pool = buy_pool(scored, positions, gate)
    if rule == "Nvar":
        pool, limit = pool.filter(F.col("composite") >= BUY), MAX_NAMES
    elif rule == "N3":
        limit = 3
    else:
        raise ValueError(f"unknown buy rule {rule!r}")
    pick = take_by_group(pool, [F.col("ord").asc()], limit, by)
    return pick.filter(~(brake if isinstance(brake, Column) else F.lit(brake)) | (F.col("pick") <= BRAKED))


def fip_pool(scored: DataFrame, by: tuple[str, ...] = ("d",)) -> DataFrame:
    """Of uptrend names the top third by 12-1 momentum, of those the lower half by fip (both rounded up; ties by order)."""
    up = uptrend(scored).filter("ret_12_1 is not null")
    w = Window.partitionBy(*by)
    top = up.withColumn("__r", F.row_number().over(w.orderBy(F.col("ret_12_1").desc(), "ord"))).withColumn("__n", F.count(F.lit(1)).over(w)).filter("__r <= ceil(__n / 3)").filter("fip is not null")
    low = top.withColumn("__q", F.row_number().over(w.orderBy("fip", "__r"))).withColumn("__n", F.count(F.lit(1)).over(w)).filter("__q <= ceil(__n / 2)")
    return low.withColumnRenamed("__q", "pick").drop("__r", "__n")


def sells(holdings: DataFrame, scored: DataFrame, rule: str = "S2", price: str = "price") -> DataFrame:
    """Holdings to sell with the first rule that fires: stop, two month-ends below the line, rank (S3 only).

    holdings: (ticker, cost, price); scored: (ticker, sma200, above200, below_prev, composite, close). S1 never sells.
    A holding that isn't scored can only be stopped.
    """
    h = holdings.join(scored.select("ticker", "sma200", "above200", "below_prev", "composite", "close", F.lit(True).alias("scored")), "ticker", "left")
    now = F.coalesce(F.col(price), F.col("close"))
    fired = F.when(flag((F.col("cost") > 0) & (now <= STOP * F.col("cost"))), "-35% stop").when(
        F.col("scored").isNull(), None).when(F.col("sma200").isNotNull() & ~flag(F.col("above200")) & flag(F.col("below_prev")), "2 month-ends below 200DMA")
    if rule == "S3":
        fired = fired.when(flag(F.col("composite") < HOLD), "rank fell below 70th pct")
    out = h.withColumn("rule", F.lit(None).cast("string") if rule == "S1" else fired)
    return out.filter("rule is not null").select("ticker", "rule", "composite")


#: Configurations in the order in which ties fall; fixed values.
TIES = {"sell": ("S1", "S2", "S3"), "gate": ("G0", "G1"), "weights": ("W3", "W1", "W2")}


def select_config(results: DataFrame, floor: Column) -> DataFrame:
    """The row with the best xirr, to ten places, whose drawdown is at least the floor; ties by the order of TIES, then name.

    A value that TIES doesn't have comes behind its others; null xirr and drawdowns are never selected.
    """
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIES[c])), F.col(c)), F.lit(0)), F.lit(99))
    known = results.filter((F.col("max_dd") >= floor) & F.col("xirr").isNotNull())
    return known.orderBy(F.round("xirr", 10).desc(), *map(place, TIES), "name").limit(1)
