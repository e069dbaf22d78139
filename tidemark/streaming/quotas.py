"""A queue under several quotas: when each request may run, with its tail carried from run to run."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTAS = ((50, 3600), (1000, 86400))  # requests and seconds; fixed values of the vendor
SHIFT = 1 << 40  # puts a tail before all requests


def admit(requests: DataFrame, tail: DataFrame | None = None, quotas: tuple[tuple[int, int], ...] = QUOTAS, monthly: int | None = None) -> DataFrame:
    """requests (key, seq, ts in seconds) with place and at: the second in which each runs, in the order of seq.

    at is the latest of ts, the time of the request before it, and for each quota (n, s) the time of the n-th last one
    plus s. With `monthly`, a key stops when a calendar month (UTC) has had so many: that request and all behind it get
    null, and are the next run's. tail: (key, place, at) of earlier runs, the last of each key's rows as far as the
    largest quota reaches (with `monthly`, the month's as well); a run goes on from it, so two runs give what one gives.
    Null keys are a queue of their own; a null ts waits for nothing; repeated seqs of a key run in any order.

    A time depends on the ones before it, so a key is a queue by nature: its rows stream through one task in order, which
    holds the times that its quotas reach back to and nothing else. Keys are dealt out by the shuffle.
    """
    most = max(n for n, _ in quotas)
    rows = requests.select("key", "seq", F.col("ts").cast("long").alias("ts"), F.lit(None).cast("long").alias("was"), F.lit(1).alias("new"))
    if tail is not None:
        rows = rows.unionByName(tail.select("key", (F.col("place") - SHIFT).alias("seq"), F.lit(None).cast("long").alias("ts"), F.col("at").alias("was"), F.lit(0).alias("new")))
    kind = dict(rows.dtypes)["key"]
    placed = rows.withColumn("seq", F.col("seq").cast("long")).repartition("key").sortWithinPartitions("key", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: tuple | None = None
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for key, seq, ts, was, new in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if queue is None or queue[0] != key:
                    queue, times, place, used, stopped = (key,), deque(maxlen=most), 0, {}, False
                at = was
                if new:
                    at = max([t for t in (ts, times[-1] if times else None) if t is not None] + [times[-n] + s for n, s in quotas if len(times) >= n], default=0)
                    stopped = stopped or (monthly is not None and used.get(_month(at), 0) >= monthly)
                    if stopped:
                        at = None
                place = seq + SHIFT if not new else place + (at is not None)
                if at is not None:
                    times.append(at)
                    if monthly is not None:
                        used = {_month(at): used.get(_month(at), 0) + 1}
                if new:
                    for column, v in zip(out, (key, seq, ts, place if at is not None else None, at), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:])], ["key", "seq", "ts", "place", "at"])

    return placed.mapInArrow(run, f"key {kind}, seq long, ts long, place long, at long")


def _month(at: int) -> tuple[int, int]:
    t = dt.datetime.fromtimestamp(at, dt.UTC)
    return t.year, t.month


def tail_of(admitted: DataFrame, quotas: tuple[tuple[int, int], ...] = QUOTAS) -> DataFrame:
    """(key, place, at) of the last admissions of each key: what the next run goes on from."""
    most = max(n for n, _ in quotas)
    last = admitted.filter("at is not null").groupBy(F.col("key").alias("k")).agg(F.max("place").alias("last"))
    d = admitted.filter("at is not null").join(last, F.col("key").eqNullSafe(F.col("k")))
    return d.filter(F.col("place") > F.col("last") - most).select("key", "place", "at")
