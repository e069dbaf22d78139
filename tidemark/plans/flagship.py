"""This month's buys: up to ten uptrend names, at most three of a group, in equal dollars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import factors as FA
from tidemark.operators import panel as P
from tidemark.operators import score as SC
from tidemark.operators import select as SE
from tidemark.sources import views as V

SMALL = FA.Spec(history=26, month=4, half=13, year=20, short=5, long=20)


def monthly_buys(spark: SparkSession, sf_dir: str, key: str = "p_brand", spec: FA.Spec = SMALL, budget: float = 2500.0) -> DataFrame:
    """(d, ticker, grp, composite, pick, dollars) at the latest month-end that has an uptrend name."""
    p = V.panel(spark, sf_dir, key)
    cal = P.calendar(p)
    fac = FA.factors(P.fill(P.align(p, cal)), spec).join(P.month_ends(cal), "d", "left_semi")
    none = {c: F.lit(None).cast("double") for c in ("gp_assets", "rev_growth", "earnings_yield", "rev_chg", "rev_breadth")}
    scored = SC.score(fac.withColumns(none))
    last = SE.uptrend(scored).agg(F.max("d").alias("d"))
    held = spark.createDataFrame([], "ticker string, held double")
    return SE.rotation_buys(scored.join(last, "d", "left_semi"), held, budget).select("d", "ticker", "grp", "composite", "pick", "dollars")
