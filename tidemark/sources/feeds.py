"""What downloads leave behind, as tables: symbol maps, vendor snapshots, news, cached answers, decision logs, delimited files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean

#: Declared schemas of the stores; a frame is brought to its schema before it is written.
SCHEMAS = {
    "prices": "ticker string, d date, close double",
    "snapshot": "ticker string, date date, factors string, raw string",
    "holdings": "ticker string, shares double, cost double, added date",
    "picks": "month string, ticker string, price double, rank int, reason string, d date",
    "shadow": "strategy string, month string, state string",
    "thesis": "ticker string, week string, json string, created timestamp",
}
DECISION = "struct<sells:array<string>,buys:array<string>,fill_date:date,contrib:double>"


def conform(d: DataFrame, store: str) -> DataFrame:
    """d with exactly the columns and types of a store: missing ones become null (an additive migration), others go."""
    out = []
    for part in SCHEMAS[store].split(", "):
        name, kind = part.split()
        out.append((F.col(f"`{name}`") if name in d.columns else F.lit(None)).cast(kind).alias(name))
    return d.select(*out)


def cik_map(raw: DataFrame) -> DataFrame:
    """(ticker, cik) of nested rows (companies: map of number to struct(ticker, cik_str)); tickers in upper case, the first counts."""
    d = raw.select(F.explode("companies").alias("k", "c")).select(F.upper("c.ticker").alias("ticker"), F.col("c.cik_str").cast("long").alias("cik"), F.col("k").cast("int").alias("k"))
    return d.groupBy("ticker").agg(F.min_by("cik", "k").alias("cik"))


def lookup_cik(tickers: DataFrame, ciks: DataFrame) -> DataFrame:
    """tickers with cik: by the ticker itself, else with a dash for its point; null for neither."""
    d = tickers.join(ciks.withColumnRenamed("cik", "__a"), "ticker", "left").withColumn("__t", F.replace("ticker", F.lit("."), F.lit("-")))
    return d.join(ciks.select(F.col("ticker").alias("__t"), F.col("cik").alias("__b")), "__t", "left").withColumn("cik", F.coalesce("__a", "__b")).drop("__a", "__b", "__t")


def estimates(raw: DataFrame, asof: Column, years: int = 3) -> DataFrame:
    """(ticker, price, trailing_eps, eps_trend, eps_rev, splits, ok, error) of independently fetched parts (ticker, info, trend,
    revisions, splits, errors): NaN and infinities are null, splits of the last years only, the first error is kept; a
    snapshot is ok if it has any info, and a price or a name."""
    i = F.col("info")
    recent = F.filter(F.coalesce("splits", F.array().cast("array<struct<d:date,ratio:double>>")), lambda s: s["d"] >= F.add_months(asof, -12 * years))
    ok = i.isNotNull() & (i["price"].isNotNull() | (F.coalesce(i["name"], F.lit("")) != ""))
    return raw.select(
        "ticker", i["name"].alias("name"), clean(i["price"]).alias("price"), clean(i["trailing_eps"]).alias("trailing_eps"), F.col("trend").alias("eps_trend"), F.col("revisions").alias("eps_rev"),
        F.array_sort(recent).alias("splits"), ok.alias("ok"), F.try_element_at(F.filter("errors", lambda e: e.isNotNull()), F.lit(1)).alias("error"))


def news(raw: DataFrame, n: int) -> DataFrame:
    """(ticker, pos, title, publisher, date) of the first n items with a title, of two shapes of payload: fields under
    `content`, or flat. raw: (ticker, items)."""
    each = raw.select("ticker", F.posexplode("items").alias("at", "x"))
    title = F.nullif(F.coalesce(F.col("x.content.title"), F.col("x.title")), F.lit(""))
    date = F.coalesce(F.substring("x.content.pubDate", 1, 10), F.date_format(F.timestamp_seconds("x.providerPublishTime"), "yyyy-MM-dd"))
    d = each.select("ticker", "at", title.alias("title"), F.coalesce(F.col("x.content.provider"), F.col("x.publisher")).alias("publisher"), date.alias("date")).filter("title is not null")
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("at")))
    return d.filter(F.col("pos") <= n).select("ticker", "pos", "title", "publisher", "date")


def decisions(log: DataFrame) -> DataFrame:
    """(strategy, month, sells, buys, fill_date, contrib) of a log of JSON states; a state that can't be read has nulls."""
    return log.withColumn("__s", F.from_json("state", DECISION, {"mode": "PERMISSIVE"})).select("strategy", "month", "__s.sells", "__s.buys", "__s.fill_date", "__s.contrib")


def fresh_cache(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Cached answers (key, status, fetched, body) that needn't be fetched again: young ones, and not-found tombstones of any age."""
    return cache.filter((F.col("status") == 404) | (F.col("fetched") > now - F.expr(f"interval {days} days")))


def to_fetch(keys: DataFrame, cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Keys without a fresh answer, each once."""
    return keys.select("key").distinct().join(fresh_cache(cache, now, days).select("key"), "key", "left_anti")


def read_delimited(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV files of one line a row with a declared schema: lines that don't fit are in errors as they stand.

    Lines that are the schema's column names are headers.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    lines = spark.read.text(path).filter(F.col("value") != ",".join(names))
    raw = lines.select("value", F.from_csv("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return raw.filter("x._bad is null").select(*[F.col(f"x.{n}") for n in names]), raw.filter("x._bad is not null").select(F.col("value").alias("line"))


def write_delimited(d: DataFrame, path: str) -> None:
    """One folder of CSV files with a header; booleans and days as text, nulls empty."""
    d.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
