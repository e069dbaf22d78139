"""Keyed stores over Parquet: replacing histories, newest versions, inserts of what is absent, snapshots and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unpivot_closes(wide: DataFrame, day: str = "d") -> DataFrame:
    """(ticker, d, close) of a frame with one column a ticker; rows without a close go, of repeated days any close stays."""
    names = [c for c in wide.columns if c != day]
    long = wide.unpivot([day], names, "ticker", "close").filter("close is not null and not isnan(close)")
    return long.groupBy("ticker", F.col(day).alias("d")).agg(F.first("close").alias("close"))


def failures(requested: DataFrame, present: DataFrame, key: str = "ticker") -> DataFrame:
    return requested.select(key).distinct().join(present, key, "left_anti")


def replace_history(existing: DataFrame, new: DataFrame, key: str = "ticker", value: str = "close") -> DataFrame:
    """existing with the whole history of each key in new replaced; rows of new without a value are left out."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new.filter(F.col(value).isNotNull()).select(existing.columns))


def load_closes(spark: SparkSession, path: str, tickers: list[str] | None = None, asof: str | None = None) -> DataFrame:
    d = spark.read.schema("ticker string, d date, close double").parquet(path)
    d = d.filter(F.col("ticker").isin(tickers)) if tickers is not None else d
    return d.filter(F.col("d") <= F.lit(asof).cast("date")) if asof else d


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR REPLACE: rows of new win by key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(existing.columns))


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR IGNORE: rows of new whose key is absent are added; of new's rows with one key any one."""
    fresh = new.dropDuplicates(keys).join(existing, keys, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def latest(snapshots: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """The newest row of each key."""
    cols = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*cols), date).alias("__x")).select(key, "__x.*")


def todo(all_: DataFrame, done: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """What a resumed job still has to do, the oldest first."""
    d = all_.join(done.select(key), key, "left_anti")
    return d.orderBy(order) if order else d


def changes(snapshots: DataFrame, key: str = "ticker", date: str = "date", flag_: str = "trend", gap: int = 5) -> DataFrame:
    """(key, change): flags that flipped between the newest snapshot day and the latest one at least `gap` days older.

    Only true against false counts; null never does.
    """
    days = snapshots.select(F.max(date).alias("new_d"))
    old_d = snapshots.crossJoin(days).filter(F.col(date) <= F.date_sub("new_d", gap)).agg(F.max(date).alias("old_d"))
    new = snapshots.join(days, F.col(date) == F.col("new_d")).select(key, F.col(flag_).alias("b"))
    old = snapshots.join(old_d, F.col(date) == F.col("old_d")).select(key, F.col(flag_).alias("a"))
    return new.join(old, key).filter("a <> b").select(key, F.when(F.col("b"), "up").otherwise("down").alias("change"))


def changes_with_events(snapshots: DataFrame, events: DataFrame, key: str = "ticker", date: str = "date", flag_: str = "trend", gap: int = 5) -> DataFrame:
    """changes, and (key, `sec`) of keys in the newest snapshot with an event (key, date) after the older day."""
    days = snapshots.select(F.max(date).alias("new_d"))
    old_d = snapshots.crossJoin(F.broadcast(days)).filter(F.col(date) <= F.date_sub("new_d", gap)).agg(F.max(date).alias("old_d"))
    here = snapshots.join(F.broadcast(days), F.col(date) == F.col("new_d")).select(key).distinct()
    sec = events.select(key, F.col(date).alias("__d")).join(F.broadcast(old_d), F.col("__d") > F.col("old_d")).select(key).distinct().join(here, key, "left_semi")
    return changes(snapshots, key, date, flag_, gap).unionByName(sec.select(key, F.lit("sec").alias("change")))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions of `by` that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def universe(spark: SparkSession, toml_text: str) -> DataFrame:
    """(pos, ticker, category, category_name, grp, is_laggard) of a TOML universe; of a ticker's categories the first counts."""
    import tomllib

    doc = tomllib.loads(toml_text)
    rows, k = [], 0
    for cat, body in doc.get("categories", {}).items():
        for t in body.get("tickers", []):
            rows.append((k, t.upper(), cat, body.get("name", cat), body.get("group", cat), False))
            k += 1
    for t in doc.get("laggards", {}).get("tickers", []) if isinstance(doc.get("laggards"), dict) else doc.get("laggards", []):
        rows.append((k, t.upper(), None, None, None, True))
        k += 1
    d = spark.createDataFrame(rows, "pos int, ticker string, category string, category_name string, grp string, is_laggard boolean")
    first = F.row_number().over(Window.partitionBy("ticker", "is_laggard").orderBy("pos"))
    return d.withColumn("__r", first).filter("__r = 1").drop("__r")


def vendor_listings(raw: DataFrame, exchanges: tuple[str, ...] = ("NYSE", "NASDAQ", "NYSE ARCA", "NYSE MKT", "AMEX")) -> DataFrame:
    """US stocks in dollars with an end day, tickers in upper case, of a vendor's all-string rows."""
    d = raw.filter(F.col("exchange").isin(*exchanges) & (F.col("assetType") == "Stock") & (F.col("priceCurrency") == "USD") & (F.coalesce("endDate", F.lit("")) != ""))
    return d.select(F.upper("ticker").alias("ticker"), "exchange", F.to_date("startDate").alias("start"), F.to_date("endDate").alias("end"))
