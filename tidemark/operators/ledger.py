"""Monthly portfolio ledgers: a native fold where decisions are given, a grouped fold where they depend on the state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.score import BUY, HOLD
from tidemark.operators.select import BRAKED, CAP_GROUP, CAP_POSITION, CAP_SPEC, CAP_SPEC_TOTAL, CAPS_FROM, MAX_NAMES, ROTATE, STOP

CONTRIB, COST = 2500.0, 0.0015
MIN_SCORED = 40
PICKS = ("rank", "ew_all", "ew_trend", "ew_trend10", "b0h", "random", "random_all", "random_up", "v1", "v2", "v3")
STATE = "struct<shares:map<string,double>,basis:map<string,double>,cash:double>"


def step(state: Column, sells: Column, buys: Column, px: Column, contrib: Column, cost: float = COST) -> Column:
    """One month: sell what has a price, then split contribution, cash and proceeds over buys with a positive price.

    Shares are net of cost, basis gross of it; holdings without a price stay; without buys the money stays as cash.
    """
    price = lambda k: F.try_element_at(px, k)
    gone = F.filter(sells, lambda k: F.map_contains_key(state["shares"], k) & price(k).isNotNull())
    proceeds = F.aggregate(gone, F.lit(0.0), lambda a, k: a + state["shares"][k] * price(k) * (1 - cost))
    names = F.filter(F.array_distinct(buys), lambda k: F.coalesce(price(k) > 0, F.lit(False)))
    budget, n = contrib + state["cash"] + proceeds, F.size(names)
    part = F.when(n > 0, budget / n)
    keep = lambda m: F.map_filter(m, lambda k, _: ~F.array_contains(gone, k))
    new = lambda per: F.map_from_arrays(names, F.transform(names, per))
    plus = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.struct(
        plus(keep(state["shares"]), new(lambda k: part * (1 - cost) / price(k))).alias("shares"), plus(keep(state["basis"]), new(lambda _: part)).alias("basis"),
        F.when(n > 0, F.lit(0.0)).otherwise(budget).alias("cash")).cast(STATE)


def replay(decisions: DataFrame, by: list[str], cost: float = COST) -> DataFrame:
    """(by, state) of stored decisions (month, sells, buys, px, contrib) at current prices: splits can't break it.

    The months of one ledger, some hundred, are folded in order in one expression.
    """
    earlier = lambda a, b: F.when(a["month"] < b["month"], -1).when(a["month"] > b["month"], 1).otherwise(0)
    months = decisions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("month", "sells", "buys", "px", "contrib")), earlier).alias("m"))
    zero = F.expr(f"cast(named_struct('shares', map(), 'basis', map(), 'cash', 0D) as {STATE})")
    return months.select(*by, F.aggregate("m", zero, lambda s, x: step(s, x["sells"], x["buys"], x["px"], x["contrib"], cost)).alias("state"))


def state_value(state: Column, px: Column) -> Column:
    held = F.map_keys(state["shares"])
    return F.aggregate(held, state["cash"], lambda a, k: a + state["shares"][k] * F.coalesce(F.try_element_at(px, k), F.lit(0.0)))


def merge_purchase(held: DataFrame, bought: DataFrame) -> DataFrame:
    """Holdings after purchases (ticker, shares, price): average cost by shares; purchases without a price are skipped."""
    b = bought.filter(F.col("price") > 0).groupBy("ticker").agg(F.sum("shares").alias("s1"), F.try_divide(F.sum(F.col("shares") * F.col("price")), F.sum("shares")).alias("p1"))
    d = held.select("ticker", F.col("shares").alias("s0"), F.col("cost").alias("c0")).join(b, "ticker", "full")
    s0, s1 = F.coalesce("s0", F.lit(0.0)), F.coalesce("s1", F.lit(0.0))
    return d.select("ticker", (s0 + s1).alias("shares"), F.try_divide(s0 * F.coalesce("c0", F.lit(0.0)) + s1 * F.coalesce("p1", F.lit(0.0)), s0 + s1).alias("cost"))


def ew_hold(prices: DataFrame, contrib: float = CONTRIB, cost: float = COST) -> DataFrame:
    """(d, value) of equal parts into all names of each month, never selling, in closed form. prices: (ticker, d, px, eligible)."""
    n = Window.partitionBy("d")
    w = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    d = prices.withColumn("n", F.sum(F.col("eligible").cast("int")).over(n))
    d = d.withColumn("sh", F.sum(F.when(F.col("eligible") & (F.col("px") > 0), F.lit(contrib * (1 - cost)) / F.col("n") / F.col("px")).otherwise(0.0)).over(w))
    return d.groupBy("d").agg(F.sum(F.col("sh") * F.col("px")).alias("value"))


# ---- path-dependent scenarios ----

LEDGER = "scenario string, d date, exec date, contribution double, value double, cash double, n_buys int, n_sells int, turnover double, eligible int, unscored boolean"
TRADES = "scenario string, d date, exec date, ticker string, side string, dollars double, price double, rule string"
SCENARIO = ("scenario", "pick", "weights", "sell", "gate", "buy", "seed", "sim", "n")
FLAGS = ("eligible", "trend", "above200", "below_prev", "speculative", "brake", "v1_up", "v1_below", "v1_below_prev", "v2_up", "v2_below", "v2_below_prev", "v3_in")
NUMBERS = ("ord", "composite", "sma200", "px", "mark", "v1_level", "v2_level")
LINES = {"v1": ("v1_level", "v1_below", "v1_below_prev"), "v2": ("v2_level", "v2_below", "v2_below_prev")}
RULES = ("-35% stop", "2 month-ends below 200DMA", "rank fell below 70th pct")


def shuffled(seed: int, sim: int, month: str, names: list[str]) -> list[int]:
    """A shuffle that SQL can repeat: places by md5 of seed, simulation, month and name."""
    import hashlib

    keys = [hashlib.md5(f"{seed}:{sim}:{month}:{k}".encode()).digest() for k in names]
    return sorted(range(len(names)), key=lambda i: (keys[i], names[i]))


def first_by_group(mask: np.ndarray, order: np.ndarray, groups: np.ndarray, limit: np.ndarray, per_group: int = 3) -> np.ndarray:
    """Of each row's marked columns, walked in the row's order, the first `limit` with at most per_group of a group."""
    rows = np.arange(len(mask))[:, None]
    m, g = mask[rows, order], groups[order]
    ids, n = np.unique(groups, return_counts=True)
    for i in ids[n > per_group]:
        mine = m & (g == i)
        m &= ~(mine & (np.cumsum(mine, axis=1) > per_group))
    m &= np.cumsum(m, axis=1) <= limit[:, None]
    out = np.zeros_like(mask)
    out[rows, order] = m
    return out


class Book:
    """The ledgers of scenarios of one weighting side by side: rows are scenarios, columns tickers; months come in turn."""

    def __init__(self, scenarios: list[dict], buys_made: dict[str, dict[str, int]] | None = None, min_scored: int = MIN_SCORED, cost: float = COST) -> None:
        self.sc, self.made, self.min_scored, self.cost = scenarios, buys_made or {}, min_scored, cost
        field = lambda f: np.array([s[f] for s in scenarios], object)
        self.pick, chosen = field("pick"), np.array([s["sell"] or "S1" for s in scenarios], object)
        if wrong := set(self.pick) - set(PICKS):
            raise ValueError(f"unknown picks {sorted(wrong)}")
        self.rule = np.where(self.pick == "ew_all", "S1", np.where(np.isin(self.pick, ("rank", "random", "random_all")), chosen, "S2"))
        self.open_gate, self.three = (field("gate") == "G0") | (self.pick == "random_all"), field("buy") == "N3"
        self.names: list[str] = []
        self.column: dict[str, int] = {}
        self.group: dict[str, str] = {}
        self.shares = self.basis = np.zeros((len(scenarios), 0))
        self.last, self.cash = np.zeros(0), np.zeros(len(scenarios))

    def _columns(self, tickers: list[str], groups: list[str | None]) -> np.ndarray:
        """Places of the month's tickers; new ones get columns at the end. An empty group is the ticker's own."""
        new = [t for t in tickers if t not in self.column]
        self.column.update((t, len(self.names) + k) for k, t in enumerate(new))
        self.names += new
        self.group.update((t, f"g:{g}" if g else f"t:{t}") for t, g in zip(tickers, groups, strict=True))
        self.shares, self.basis = (np.pad(x, ((0, 0), (0, len(new)))) for x in (self.shares, self.basis))
        self.last = np.pad(self.last, (0, len(new)), constant_values=np.nan)
        return np.array([self.column[t] for t in tickers], np.int64)

    def _sells(self, m: dict, mark: np.ndarray, unscored: bool) -> tuple[np.ndarray, np.ndarray]:
        """(sold, which of RULES) of all holdings: the stop looks at every one, the other rules at this month's names."""
        held = self.shares > 0
        rule = np.where((self.rule == "S3") & unscored, "S2", self.rule)
        with np.errstate(invalid="ignore", divide="ignore"):
            stop = held & (mark <= STOP * self.basis / self.shares)
        below = np.broadcast_to(~np.isnan(m["sma200"]) & ~m["above200"] & m["below_prev"] & m["here"], held.shape).copy()
        for pick, (level, under, before) in LINES.items():
            below[self.pick == pick] = ~np.isnan(m[level]) & m[under] & m[before]
        below &= held & (self.pick != "b0h")[:, None]
        late = held & (m["composite"] < HOLD) & (rule == "S3")[:, None]
        return (stop | below | late) & (rule != "S1")[:, None], np.where(stop, 0, np.where(below, 1, 2))

    def _capped(self, held: np.ndarray, groups: np.ndarray, spec: np.ndarray) -> np.ndarray:
        """Names that get no new money, once a portfolio is worth 25,000."""
        port = held.sum(axis=1, keepdims=True)
        in_group = (held @ (groups[:, None] == np.arange(groups.max(initial=0) + 1)))[:, groups]
        hit = (held >= CAP_POSITION * port) | (in_group >= CAP_GROUP * port) | (spec & ((held >= CAP_SPEC * port) | ((held @ spec)[:, None] >= CAP_SPEC_TOTAL * port)))
        return hit & (port >= CAPS_FROM)

    def _buys(self, d, m: dict, held: np.ndarray, sold: np.ndarray, groups: np.ndarray, unscored: bool) -> np.ndarray:
        pick, names = self.pick, np.zeros(held.shape, bool)
        elig, comp, trend = m["eligible"], m["composite"], m["trend"]
        scored = elig & ~np.isnan(comp)
        whole = (pick == "ew_all") | unscored
        names[whole] = elig & ~sold[whole]
        names[(pick == "ew_trend") & ~whole] = elig & trend
        spin = np.isin(pick, ("ew_trend10", "b0h", "v1", "v2", "v3")) & ~whole
        if spin.any():
            gates = {"v1": m["v1_up"], "v2": m["v2_up"], "v3": m["v3_in"]}
            mask = np.array([scored & gates.get(p, trend) for p in pick[spin]])
            order = np.argsort(np.array(self.names, object), kind="stable")
            order = order[np.argsort(-np.nan_to_num(comp[order], nan=-1.0), kind="stable")]
            order = order[np.argsort(held[spin][:, order], axis=1, kind="stable")]
            names[spin] = first_by_group(mask, order, groups, np.full(len(mask), ROTATE))
        free = scored & (trend | self.open_gate[:, None]) & ~self._capped(held, groups, m["speculative"])
        ranked = (pick == "rank") & ~whole
        if ranked.any():
            mask = free[ranked] & ((comp >= BUY) | self.three[ranked][:, None])
            limit = np.where(self.three[ranked], 3, MAX_NAMES)
            order = np.argsort(np.nan_to_num(m["ord"], nan=np.inf), kind="stable")
            names[ranked] = first_by_group(mask, np.broadcast_to(order, mask.shape), groups, np.minimum(limit, BRAKED) if m["brake"].any() else limit)
        drawn = np.flatnonzero(np.isin(pick, ("random", "random_all", "random_up")) & ~whole)
        if len(drawn):
            mask = np.where((pick[drawn] == "random_up")[:, None], scored & trend, free[drawn])
            order, limit = np.argsort(~mask, axis=1, kind="stable"), np.zeros(len(drawn), np.int64)
            for r, s in enumerate(self.sc[i] for i in drawn.tolist()):
                limit[r] = self.made[s["pick"]].get(str(d), 0) if s["pick"] in self.made else s["n"]
                if limit[r]:  # the pool's names come first; what is behind them isn't marked
                    pool = np.flatnonzero(mask[r])
                    order[r, : len(pool)] = pool[shuffled(s["seed"], s["sim"], str(d), [self.names[k] for k in pool.tolist()])]
            names[drawn] = first_by_group(mask, order, groups, limit)
        return names

    def step(self, d, exec_, month: dict) -> tuple[dict, dict]:
        """One month: ledger rows of all scenarios, and their trades. month: columns by name, a row a ticker.

        Sells come first and leave the positions; buys follow; both fill at the next day's price. Names sold this month
        may be bought again except where a pick takes all eligible names. A holding that the month doesn't know keeps
        its last price, and is sold only by the stop, and only when a price to sell at exists.
        """
        c = self._columns(month["ticker"], month["grp"])
        m = {}
        for name in (*NUMBERS, *FLAGS):
            m[name] = np.full(len(self.names), np.nan) if name in NUMBERS else np.zeros(len(self.names), bool)
            m[name][c] = month[name]
        m["here"] = np.zeros(len(self.names), bool)
        m["here"][c] = True
        codes: dict[str, int] = {}
        groups = np.array([codes.setdefault(self.group[t], len(codes)) for t in self.names], np.int64)
        px = m["px"]
        mark = np.where(np.isnan(m["mark"]), np.where(np.isnan(px), self.last, px), m["mark"])
        n_elig = int(m["eligible"].sum())
        unscored = n_elig < self.min_scored
        sold, why = self._sells(m, mark, unscored)
        held = np.where(sold, 0.0, self.shares * np.nan_to_num(mark))
        names = self._buys(d, m, held, sold, groups, unscored) & (px > 0)
        out = sold & ~np.isnan(px)
        worth = np.where(out, self.shares * np.nan_to_num(px), 0.0)
        budget, n = CONTRIB + self.cash + worth.sum(axis=1) * (1 - self.cost), names.sum(axis=1)
        dollars = np.where(names, (budget / np.maximum(n, 1))[:, None], 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.shares = np.where(out, 0.0, self.shares) + np.where(names, dollars * (1 - self.cost) / px, 0.0)
        self.basis, self.cash = np.where(out, 0.0, self.basis) + dollars, np.where(n > 0, 0.0, budget)
        self.last = np.where(np.isnan(px), self.last, px)
        value = (self.shares * np.nan_to_num(self.last)).sum(axis=1) + self.cash
        moved = worth.sum(axis=1) + dollars.sum(axis=1)
        label = np.array([s["scenario"] for s in self.sc], object)
        ledger = {
            "scenario": label, "d": d, "exec": exec_, "contribution": CONTRIB, "value": value, "cash": self.cash, "n_buys": n, "n_sells": sold.sum(axis=1),
            "turnover": np.divide(moved, value, out=np.zeros(len(value)), where=value != 0), "eligible": n_elig, "unscored": unscored}
        (i, k), (j, b) = np.nonzero(out), np.nonzero(names)
        col = np.concatenate([k, b])
        trades = {
            "scenario": label[np.concatenate([i, j])], "d": d, "exec": exec_, "ticker": np.array(self.names, object)[col], "side": ["sell"] * len(i) + ["buy"] * len(j),
            "dollars": np.concatenate([worth[i, k], dollars[j, b]]), "price": px[col], "rule": [*np.array(RULES, object)[why[i, k]], *self.pick[j]]}
        return ledger, trades


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that agree in the first `keys` columns, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = list(zip(*(b.column(k).to_pylist() for k in range(keys)), strict=True))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for a, e in zip(cuts, cuts[1:], strict=False):
            if held and rows[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = rows[a]
            held.append(b.slice(a, e - a))
    if held:
        yield last, pa.Table.from_batches(held)


def simulate(scenarios: DataFrame, context: DataFrame, tasks: int | None = None, buys_made: dict[str, dict[str, int]] | None = None, trades: bool = False) -> DataFrame:
    """Ledgers of all scenarios, or their trades: months in sequence, scenarios in parallel.

    scenarios: (scenario, pick, sell, gate, buy, seed, sim, n). context: one row a month and ticker, with ord, px (the
    fill), mark, composite and flags. With a column weights in both, a scenario reads the context's rows of its own.
    Scenarios are dealt into `tasks` parts; each part gets the context's rows in order of time through the shuffle and
    holds one month of them, so neither the driver nor a task holds the context, however long or wide it is. Results
    don't depend on the number of tasks. buys_made: for a random pick, the names to draw in each month (none in months
    that it lacks); without it n of the scenario in all months. Null flags are false; a pick of another name fails.
    """
    spark = scenarios.sparkSession
    # Each part reads all of the context: no more parts than scenarios need, a few dozen of these each.
    parts = tasks or max(1, min(spark.sparkContext.defaultParallelism, -(-scenarios.count() // 40)))
    keyed = "weights" in context.columns
    weight = lambda d: F.coalesce(F.col("weights"), F.lit("")) if keyed else F.lit("")
    kinds = dict(scenarios.dtypes)
    own = [F.col(c).cast("int" if c in ("seed", "sim", "n") else "string").alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in SCENARIO if c != "weights"]
    sc = scenarios.select(F.pmod(F.xxhash64("scenario"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("date").alias("d"), weight(scenarios).alias("weights"), *own)
    rows = context.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "d", weight(context).alias("weights"), "exec", "ticker", "grp",
        *[F.col(c).cast("double").alias(c) for c in NUMBERS], *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAGS]).filter("d is not null")
    both = sc.unionByName(rows, allowMissingColumns=True).select("part", "d", "weights", "exec", "ticker", "grp", *[c for c in SCENARIO if c != "weights"], *NUMBERS, *FLAGS)
    schema = TRADES if trades else LEDGER
    types = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [tuple(x.split()) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, books = None, {}
        for (at, d, w), t in _runs(batches, 3):
            if at != part:
                part, books = at, {}
            if d is None:
                books[w] = Book(t.select(["scenario", "pick", "sell", "gate", "buy", "seed", "sim", "n"]).to_pylist(), buys_made)
            elif w in books:
                m = {c: t.column(c).to_pylist() for c in ("ticker", "grp")}
                m |= {c: t.column(c).to_numpy().astype(float) for c in NUMBERS} | {c: t.column(c).to_numpy().astype(bool) for c in FLAGS}
                got = books[w].step(d, t.column("exec")[0].as_py(), m)[trades]
                size = len(got["scenario"])
                if size:
                    cols = [pa.array([v] * size if np.isscalar(v) or not hasattr(v, "__len__") else list(v), types[k]) for v, k in ((got[name], kind) for name, kind in fields)]
                    yield pa.RecordBatch.from_arrays(cols, names=[name for name, _ in fields])

    # Scenarios have no day and come first; a part's months follow in order.
    placed = both.repartitionByRange(parts, "part").sortWithinPartitions("part", F.col("d").asc_nulls_first(), "weights", "ticker")
    return placed.mapInArrow(run, schema)
