"""Corrected histories: what changed in the closes is recomputed in the frames, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import factors as FA
from tidemark.operators import panel as P
from tidemark.sources.snapshots import SnapshotStore


def frames(closes: DataFrame, cal: DataFrame) -> DataFrame:
    """The factor frame of each ticker of closes (ticker, grp, d, close) on the days of cal (d, rn)."""
    return FA.factors(P.fill(P.align(closes, cal)))


def changed_from(old: DataFrame, new: DataFrame) -> DataFrame:
    """(ticker, from_d): the first day on which a ticker's close is another, is new, or is gone. Of equal histories there is no row.

    Null closes count as absent. old and new hold the tickers that a correction names, not the whole table.
    """
    a = old.filter("close is not null").select("ticker", "d", F.col("close").alias("was"))
    b = new.filter("close is not null").select("ticker", "d", F.col("close").alias("now"))
    d = a.join(b, ["ticker", "d"], "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    return d.groupBy("ticker").agg(F.min("d").alias("from_d"))


def correct(closes: SnapshotStore, frame: SnapshotStore, new: DataFrame, cal: DataFrame) -> list[str]:
    """Replaces the histories of new's tickers (ticker, grp, d, close), and their frame rows from the first changed day on.

    Rows of a frame look back only, so those before that day hold. Both stores read and write the buckets of the changed
    tickers alone. The calendar is given: days that it doesn't have are no rows. A ticker that is new gets a frame; one
    whose histories are equal stays untouched. Gives the tickers that were recomputed; a correction names some, not all.
    """
    names = sorted(r[0] for r in new.select("ticker").filter("ticker is not null").distinct().collect())
    new = new.filter("ticker is not null")
    moved = {r["ticker"]: r["from_d"] for r in changed_from(closes.read(keys=names), new).collect()}
    if not moved:
        return []
    some = sorted(moved)
    fresh = new.filter(F.col("ticker").isin(some))
    closes.merge(fresh.select("ticker", "grp", "d", "close"))
    start = F.create_map(*[x for t in some for x in (F.lit(t), F.lit(moved[t]))])[F.col("ticker")]
    again = frames(fresh, cal)
    kept = frame.read(keys=some).filter(F.col("d") < start)
    frame.merge(kept.unionByName(again.filter(F.col("d") >= start).select(kept.columns)))
    return some
