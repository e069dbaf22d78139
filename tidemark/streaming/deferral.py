"""The ledger advance as a stream of plans and closes: a plan waits in state while its fill day is incomplete."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.shadow import DECISION

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Deferral(StatefulProcessor):
    """Of one strategy: months that are out, plans that wait, the last day seen of each ticker and of all."""

    def __init__(self, ref: dt.date) -> None:
        self.ref = ref

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.out = handle.getMapState("out", "month string", "fill_date date")
        self.waiting = handle.getMapState("waiting", "month string", "fill_date date, sells array<string>, buys array<string>, contrib double")
        self.seen = handle.getMapState("seen", "ticker string", "d date")
        self.last = handle.getValueState("last", "d date")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            closes = part[part["ticker"].notna() & part["d"].notna()]
            for ticker, d in closes.groupby("ticker")["d"].max().items():
                if not self.seen.containsKey((ticker,)) or self.seen.getValue((ticker,))[0] < d:
                    self.seen.updateValue((ticker,), (d,))
                last = d if last is None or d > last else last
            for r in part[part["month"].notna()].itertuples():
                if not self.out.containsKey((r.month,)) and not self.waiting.containsKey((r.month,)):
                    self.waiting.updateValue((r.month,), (None if pd.isna(r.fill_date) else r.fill_date, list(r.sells), list(r.buys), r.contrib))
        if last is not None:
            self.last.update((last,))
        done = [(k[0], *v) for k, v in self.waiting.iterator() if self._complete(v[0], [*v[1], *v[2]], last)]
        for month, fill_date, *_ in done:
            self.waiting.removeKey((month,))
            self.out.updateValue((month,), (fill_date,))
        if done:
            yield pd.DataFrame([(key[0], m, f, list(s), list(b), c) for m, f, s, b, c in sorted(done, key=lambda x: x[0])], columns=["strategy", "month", "fill_date", "sells", "buys", "contrib"])

    def _complete(self, fill_date: dt.date | None, names: list[str], last: dt.date | None) -> bool:
        if fill_date is None or fill_date >= self.ref:
            return False
        return fill_date != last or all(self.seen.getValue((n,))[0] == last for n in names if self.seen.containsKey((n,)))


def advance_when_complete(plans: DataFrame, closes: DataFrame, strategies: list[str], ref: dt.date) -> DataFrame:
    """Decisions of two streams, plans (strategy, month, fill_date, sells, buys, contrib) and closes (ticker, d): each month of
    a strategy once, as soon as `shadow.due` would give it.

    A plan waits in the strategy's state while its fill day isn't before ref, or is the last day of all closes and a name
    that it trades, and that has closes, has none on that day. Later rows of the strategy, or any close, look at the
    waiting plans again; repeated plans and late closes change nothing. Every close goes to each of the `strategies`, a
    short list of ledgers, so a strategy's state holds one day a ticker, whatever the history. ref is that of the run:
    a restart may name a later one. A plan of a null month, a close of a null ticker or day is ignored.
    """
    blank = lambda t: F.lit(None).cast(t)
    p = plans.select("strategy", "month", "fill_date", "sells", "buys", "contrib", blank("string").alias("ticker"), blank("date").alias("d"))
    c = closes.select(F.explode(F.array(*map(F.lit, strategies))).alias("strategy"), blank("string").alias("month"), blank("date").alias("fill_date"), blank("array<string>").alias("sells"), blank("array<string>").alias("buys"), blank("double").alias("contrib"), "ticker", "d")
    return p.unionByName(c).groupBy("strategy").transformWithStateInPandas(Deferral(ref), DECISION, "Append", "None")


def refresh(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what the streams have now and ends; waiting plans stay in the checkpoint's state for the next run."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
    q.awaitTermination()
