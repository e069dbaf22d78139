"""Forward ledgers as a stream: each strategy advances once a month, when the fill day is complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "strategy string, month string, fill_date date, sells array<string>, buys array<string>, contrib double"


def due(plans: DataFrame, log: DataFrame, ref, closes: DataFrame | None = None) -> DataFrame:
    """Plans (strategy, month, fill_date, sells, buys, contrib) to append: absent from the log, filled before ref.

    closes: (ticker, d), if given: a plan whose fill day is the last one of all closes waits while any name that it sells
    or buys has no close on that day yet, though it has closes at all; the next refresh continues with it.
    """
    d = plans.filter(F.col("fill_date").isNotNull() & (F.col("fill_date") < F.lit(ref).cast("date"))).dropDuplicates(["strategy", "month"]).join(log, ["strategy", "month"], "left_anti")
    if closes is None:
        return d
    last = closes.agg(F.max("d").alias("last_d"))
    waiting = closes.groupBy("ticker").agg(F.max("d").alias("seen")).join(F.broadcast(last), F.col("seen") < F.col("last_d")).select("ticker", "last_d")
    names = d.select("strategy", "month", "fill_date", F.explode(F.concat("sells", "buys")).alias("ticker"))
    late = names.join(waiting, "ticker").filter(F.col("fill_date") == F.col("last_d")).select("strategy", "month").distinct()
    return d.join(late, ["strategy", "month"], "left_anti")


def refresh(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream has now and ends, to be run weekly: the checkpoint knows what earlier runs have written."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def advance(plans: DataFrame, delay: str = "5 days") -> DataFrame:
    """The same over a stream of plans with an event time `ts`: a month of a strategy comes out once, late repeats don't.

    State is the last month written of each strategy, so a restart or a repeated source row writes nothing twice.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values(["month", "fill_date"]).drop_duplicates("month")
        rows = rows[rows["month"] > last]
        if len(rows):
            state.update((rows["month"].iloc[-1],))
            yield rows[["strategy", "month", "fill_date", "sells", "buys", "contrib"]]

    return plans.withWatermark("ts", delay).groupBy("strategy").applyInPandasWithState(step, DECISION, "last string", "append", GroupStateTimeout.NoTimeout)


def quota_use(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """Adds in_window: requests of the same key in the last `seconds`, to the microsecond, this one included; one just that old is not."""
    from pyspark.sql import Window

    micros = F.unix_timestamp("ts") * 1_000_000 + (F.extract(F.lit("SECOND"), "ts") % 1 * 1_000_000).cast("long")  # unix_micros would read a time without zone in the session's
    w = Window.partitionBy("key").orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))
