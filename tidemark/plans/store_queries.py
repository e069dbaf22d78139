"""Queries over copy-on-write stores: deletions by key and corrected histories, with the SQL of what a reader must see."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import corrections as CO
from tidemark.operators import filings as FI
from tidemark.operators import panel as P
from tidemark.plans import catalogue as C
from tidemark.plans.catalogue import CAL, CLAIMS, ELIG, FAC, FILLED, GRID, ME, MFAC, OWN, STATED, STATUS, chain, query
from tidemark.sources import views as V
from tidemark.sources.scratch import scratch
from tidemark.sources.snapshots import SnapshotStore

#: A correction: from this day on the closes of these tickers are halved, as after a split.
SPLIT_FROM, SPLIT = "2000-01-01", ("S1", "S7")
_HALVED = f"CASE WHEN ticker IN {SPLIT} AND d >= DATE '{SPLIT_FROM}' THEN close / 2 ELSE close END AS close"
CORRECTED = V.PANEL.replace("panel AS", "raw_panel AS", 1) + f", panel AS (SELECT ticker, grp, d, {_HALVED} FROM raw_panel)"


def _halved(d):
    return d.filter(F.col("ticker").isin(*SPLIT)).withColumn("close", F.when(F.col("d") >= F.lit(SPLIT_FROM).cast("date"), F.col("close") / 2).otherwise(F.col("close")))


@query(chain(V.LISTINGS, ELIG, OWN, STATED, CLAIMS, STATUS, CORRECTED) + """, od AS (SELECT s_suppkey AS cik, 'listed' AS status FROM supplier),
gone AS (SELECT 'S' || (od.cik - 60) AS ticker FROM od LEFT JOIN st ON od.cik = st.cik WHERE od.status = 'listed' AND st.status IS DISTINCT FROM 'listed')
SELECT ticker, count(*) AS n, round(sum(close), 4) AS total FROM panel ANTI JOIN gone USING (ticker) GROUP BY ticker""")
def stale_series_deleted(spark, sf):
    """A store of closes in which corrected histories take the old ones' place and series of companies no longer listed go."""
    p = V.panel(spark, sf)
    store = SnapshotStore(spark, scratch(spark, "closes"), "ticker")
    store.create(p)
    store.merge(_halved(p))
    old = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cik"), F.lit("listed").alias("status"))
    diff = FI.status_diff(old, FI.status_of(C._mapped(spark, sf)))
    store.delete(FI.stale_series(diff.withColumn("cik", F.col("cik") - 60), "S"))
    store.vacuum(1)
    return store.read().groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query(chain(CORRECTED, CAL, GRID, FILLED, FAC, ME, MFAC) + "SELECT ticker, d, round(close, 6) AS close, n_days, round(ret_12_1, 6) AS ret_12_1, round(vol_252, 6) AS vol_252, round(hi52, 6) AS hi52, round(sma200, 6) AS sma200, trend, eligible FROM mfac")
def corrected_frames(spark, sf):
    """Factor frames in a store, after a correction that recomputes the changed tickers from their first changed day on."""
    p = V.panel(spark, sf).persist()
    cal = P.calendar(p)
    closes, frame = (SnapshotStore(spark, scratch(spark, name), "ticker") for name in ("closes", "frames"))
    closes.create(p)
    frame.create(CO.frames(p, cal))
    CO.correct(closes, frame, _halved(p), cal)
    for s in (closes, frame):
        s.vacuum(1)
    ends = P.month_ends(cal)
    p.unpersist()
    d = frame.read().join(ends, "d", "left_semi").select("ticker", "d", "close", "n_days", "ret_12_1", "vol_252", "hi52", "sma200", "trend", "eligible")
    return C.r6(d)
