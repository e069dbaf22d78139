"""Cross-sectional scoring: exact percentile ranks with average ties, blends, grades, labels and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import INSUFFICIENT, MISSING, flag, grade, percent_ordinal, signed_percent

WEIGHTS = {"W1": (0.8, 0.2), "W2": (0.6, 0.4), "W3": (1.0, 0.0)}  # fixed values: momentum, quality
REVISIONS = 0.15
BUY, HOLD = 0.85, 0.70


def pct(value: Column, by: list[str]) -> Column:
    """Average-tie rank over the number of non-null values in the group; null stays null.

    All windows are cut by the group alone, nulls last, and ties are the peers in the sort that the rank needs: factors of
    one group share one exchange, and each is sorted once. A group is a day's cross-section, a row a ticker.
    """
    group = Window.partitionBy(*[F.col(c) for c in by])
    sorted_ = group.orderBy(value.asc_nulls_last())
    ties = F.count(F.lit(1)).over(sorted_.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(sorted_) + (ties - 1) / 2) / F.count(value).over(group))


def mean2(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2, a, b)


def score(fac: DataFrame, weights: str | None = "W1", use_revisions: bool = False, by: tuple[str, ...] = ("d",)) -> DataFrame:
    """Adds mom, qual, rev, raw, composite, grades, label and ord (the tie-break order in its group).

    Only eligible rows are ranked; others have nulls. A missing quality or revision leaves the weights to the rest.
    Without weights each row takes those that its column weights names; that column then belongs into by.
    """
    by_ = list(by)
    e = lambda c: F.when(F.col("eligible"), F.col(c))
    d = fac.withColumns({f"__{c}": pct(e(c), by_) for c in ("mom_raw", "hi52", "gp_assets", "rev_growth", "rev_chg", "rev_breadth")})
    own = lambda i: F.coalesce(*[F.when(F.col("weights") == k, F.lit(w[i])) for k, w in WEIGHTS.items()])
    w_mom, w_qual = WEIGHTS[weights] if weights else (own(0), own(1))
    d = d.withColumn("mom", 0.7 * F.col("__mom_raw") + 0.3 * F.col("__hi52")).withColumn("qual", mean2(F.col("__gp_assets"), F.col("__rev_growth")))
    d = d.withColumn("rev", mean2(F.col("__rev_chg"), F.col("__rev_breadth")) if use_revisions else F.lit(None).cast("double"))
    raw = F.when(F.col("qual").isNotNull(), w_mom * F.col("mom") + w_qual * F.col("qual")).otherwise(F.col("mom"))
    if use_revisions:
        raw = F.when(F.col("rev").isNotNull(), (1 - REVISIONS) * raw + REVISIONS * F.col("rev")).otherwise(raw)
    d = d.withColumn("raw_score", F.round(raw, 12)).withColumn("composite", pct(F.col("raw_score"), by_))
    d = d.withColumns({f"grade_{c}": grade(F.col(c)) for c in ("mom", "qual", "rev", "composite")})
    label = F.when(~F.col("eligible") | F.col("composite").isNull(), INSUFFICIENT).when(F.col("composite") >= BUY, F.when(flag(F.col("trend")), "BUY").otherwise("WATCH")).when(F.col("composite") >= HOLD, "HOLD").otherwise("AVOID")
    d = d.withColumn("label", label).withColumn("ord", F.row_number().over(Window.partitionBy(*by_).orderBy(*tie_break())))
    return d.drop(*[c for c in d.columns if c.startswith("__")])


def tie_break() -> list[Column]:
    return [F.col("composite").desc_nulls_last(), F.col("earnings_yield").desc_nulls_last(), F.col("ticker").asc()]


def reason(d: DataFrame) -> DataFrame:
    """Adds reason: the two best factor clauses (ties in the order momentum, quality, revisions), then the trend."""
    name = lambda n, p, inner: F.when(p.isNotNull(), F.struct((-p).alias("k"), F.concat(F.lit(n + " "), percent_ordinal(p), F.lit(" pct"), F.when(F.size(inner) > 0, F.concat(F.lit(" ("), F.array_join(inner, ", "), F.lit(")"))).otherwise("")).alias("text")))
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    said = lambda c, text: F.when(F.col(c).isNotNull(), text)
    mom = name("Momentum", F.col("mom"), some(said("ret_12_1", F.concat(F.lit("12-1m "), signed_percent(F.bround("ret_12_1", 2)))), said("dd_52w", F.concat((F.bround(F.col("dd_52w") * 100, 0).cast("long")).cast("string"), F.lit("% from high")))))
    qual = name("Quality", F.col("qual"), some(said("gp_assets", F.concat(F.lit("GP/A "), F.printf(F.lit("%.2f"), F.bround("gp_assets", 2)))), said("rev_growth", F.concat(F.lit("rev "), signed_percent(F.bround("rev_growth", 2))))))
    rev = name("Revisions", F.col("rev"), some(said("rev_chg", F.concat(F.lit("FY EPS est "), signed_percent(F.bround("rev_chg", 2)), F.lit("/90d")))))
    put = lambda x, k: F.when(x.isNotNull(), F.struct(x["k"].alias("k"), F.lit(k).alias("i"), x["text"].alias("text")))
    best = F.slice(F.array_sort(some(put(mom, 0), put(qual, 1), put(rev, 2))), 1, 2)
    trend = F.when(flag(F.col("trend")), "in uptrend").when(flag(F.col("above200")), "above 200DMA, 50DMA below 200DMA (no uptrend)").otherwise("below 200DMA")
    short = F.when(F.col("close").isNull(), F.lit(f"{INSUFFICIENT}: no recent price")).otherwise(F.concat(F.lit(f"{INSUFFICIENT}: "), F.coalesce("n_days", F.lit(0)).cast("string"), F.lit(" trading days of history (need 273)")))
    return d.withColumn("reason", F.when(~flag(F.col("eligible")), short).otherwise(F.array_join(F.concat(F.transform(best, lambda x: x["text"]), F.array(trend)), " · ")))


__all__ = ["BUY", "HOLD", "MISSING", "WEIGHTS", "mean2", "pct", "reason", "score", "tie_break"]
