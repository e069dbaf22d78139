"""Copy-on-write stores and corrected histories: files that stay, versions that hold, frames equal to a full recomputation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corrections
from tidemark.operators import panel as P
from tidemark.sources.snapshots import SnapshotStore


def rows(d):
    return sorted(map(repr, map(tuple, d.collect())))


def test_merge_and_delete_rewrite_touched_buckets_only(spark, tmp_path):
    first = [(f"T{k % 20}", k, float(k)) for k in range(200)] + [(None, 1, 1.0), ("T1", None, None)]
    s = SnapshotStore(spark, f"file://{tmp_path}/s", "ticker", 16)
    df = spark.createDataFrame(first, "ticker string, day int, close double")
    with pytest.raises(ValueError):
        s.read()
    assert s.create(df) == 1 and rows(s.read()) == rows(df)
    before = s.files()
    new = spark.createDataFrame([("T3", 3, -1.0), ("T3", 500, 5.0), ("NEW", 1, 2.0), (None, 7, 7.0)], df.schema)
    assert s.merge(new) == 2 and s.merge(new.limit(0)) == 2
    want = [r for r in first if r[0] not in ("T3", "NEW", None)] + [tuple(r) for r in new.collect()]
    assert rows(s.read()) == sorted(map(repr, want)) and rows(s.read(1)) == rows(df)
    same = {b for b in before if s.files().get(b) == before[b]}
    assert len(same) >= len(before) - 3 and set(before) - same
    assert rows(s.read(keys=["T3", "NEW"])) == sorted(map(repr, [r for r in want if r[0] in ("T3", "NEW")]))
    # By key and day: one row goes, one comes; a key that isn't there changes nothing.
    s.merge(spark.createDataFrame([("T3", 500, 9.0)], df.schema), ["ticker", "day"])
    s.delete(spark.createDataFrame([("T5",), ("nobody",)], "ticker string"))
    s.delete(spark.createDataFrame([("T6", 6), ("T6", 1)], "ticker string, day int"), ["ticker", "day"])
    want = [r if r[1] != 500 else ("T3", 500, 9.0) for r in want if r[0] != "T5" and r[:2] != ("T6", 6)]
    assert rows(s.read()) == sorted(map(repr, want)) and s.versions() == [1, 2, 3, 4, 5]
    gone = s.vacuum(1)
    assert gone and s.versions() == [5] and rows(s.read()) == sorted(map(repr, want)) and not s.vacuum(1)


def test_a_failed_or_second_writer_changes_nothing(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/s", "k", 4)
    df = spark.createDataFrame([(k, "x") for k in range(20)], "k long, v string")
    s.create(df)
    bad = df.withColumn("v", F.when(F.col("k") == 19, F.raise_error("lost").cast("string")).otherwise("y"))
    with pytest.raises(Exception, match="lost"):
        s.merge(bad)
    assert s.versions() == [1] and rows(s.read()) == rows(df)
    with pytest.raises(Exception, match="exist"):
        s._publish(1, {"version": 1, "folders": {}})
    assert rows(s.read()) == rows(df) and s.merge(df.withColumn("v", F.lit("y"))) == 2 and {r["v"] for r in s.read().collect()} == {"y"}


def test_corrected_histories_equal_a_full_recomputation(spark, tmp_path):
    rng, day = random.Random(2), dt.date(2020, 1, 1)
    days = [day + dt.timedelta(k) for k in range(320)]
    price = lambda t: [(t, "g", d, round(10 + rng.random(), 4)) for d in days if rng.random() < 0.9]
    closes = {t: price(t) for t in ("A", "B", "C", "D", "E", "F")}
    schema = "ticker string, grp string, d date, close double"
    df = lambda: spark.createDataFrame([r for rs in closes.values() for r in rs], schema)
    cal = P.calendar(spark.createDataFrame([(d,) for d in days], "d date"))
    c, f = SnapshotStore(spark, f"file://{tmp_path}/c", "ticker", 8), SnapshotStore(spark, f"file://{tmp_path}/f", "ticker", 8)
    c.create(df())
    f.create(corrections.frames(df(), cal))
    before = f.files()
    closes["B"] = [r if k < 290 else (*r[:3], r[3] * 2) for k, r in enumerate(closes["B"]) if k != 280]  # one day gone, later ones doubled
    closes["N"] = price("N")
    new = spark.createDataFrame(closes["B"] + closes["N"] + closes["C"] + [(None, "g", day, 1.0)], schema)
    assert corrections.correct(c, f, new, cal) == ["B", "N"]  # C's history is the same
    assert rows(c.read()) == rows(df()) and rows(f.read()) == rows(corrections.frames(df(), cal).select(f.read().columns))
    assert sum(f.files().get(b) != before[b] for b in before) <= 2
    assert corrections.correct(c, f, new, cal) == [] and len(f.versions()) == 2
