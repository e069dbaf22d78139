"""Streams with restarts, late, repeated and out-of-order rows against the batch form of the same operator."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalogue
from tidemark.streaming import deferral, quotas, shadow, windows

D = dt.date.fromisoformat
PLANS = "strategy string, month string, fill_date date, sells array<string>, buys array<string>, contrib double"


def test_plans_wait_for_their_fill_day(spark, tmp_path):
    """Five runs over growing folders: each gives what `due` gives on all rows so far and what earlier runs have written."""
    src, out = f"file://{tmp_path}", f"file://{tmp_path}/out"
    plan = lambda s, m, f, sells=(), buys=(): (s, m, f and D(f), list(sells), list(buys), 1.0)
    runs = [
        ("2026-03-03", [plan("a", "2026-02", "2026-03-02", (), ("A", "B")), plan("b", "2026-02", "2026-03-02", (), ("A",)), plan("b", "2026-03", None)], [("A", "2026-03-02"), ("B", "2026-02-27"), (None, "2026-03-09")]),
        ("2026-03-03", [plan("a", "2026-02", "2026-03-02", ("Z",), ())], [("A", "2026-03-02"), ("B", "2026-02-20")]),  # repeated and late rows alone
        ("2026-03-04", [plan("b", "2026-04", "2026-03-04", (), ("A",)), plan("a", "2026-04", "2026-03-03", (), ("N", "A"))], [("B", "2026-03-02"), ("A", "2026-03-03")]),
        ("2026-03-05", [plan("a", "2026-05", "2026-03-04", ("B",), ())], [("C", "2026-03-04")]),  # the fill day is the last one, and A and B lack it
        ("2026-03-06", [], [("A", "2026-03-05")]),  # a later day: what waited comes out
    ]
    plans, closes, written = [], [], []
    for k, (ref, new_plans, new_closes) in enumerate(runs):
        plans, closes = plans + new_plans, closes + [(t, D(d)) for t, d in new_closes]
        spark.createDataFrame(new_plans, PLANS).coalesce(1).write.mode("append").parquet(f"{src}/plans")
        spark.createDataFrame([(t, D(d)) for t, d in new_closes], "ticker string, d date").coalesce(1).write.mode("append").parquet(f"{src}/closes")
        log = spark.createDataFrame([r[:2] for r in written], "strategy string, month string")
        held = spark.createDataFrame([c for c in closes if c[0]], "ticker string, d date")
        want = {(r["strategy"], r["month"]) for r in shadow.due(spark.createDataFrame(plans, PLANS), log, ref, held).collect()}
        stream = deferral.advance_when_complete(spark.readStream.schema(PLANS).parquet(f"{src}/plans"), spark.readStream.schema("ticker string, d date").parquet(f"{src}/closes"), ["a", "b"], D(ref))
        deferral.refresh(stream, out, f"file://{tmp_path}/checkpoint")
        rows = [tuple(r) for r in spark.read.schema(PLANS).parquet(out).collect()]
        assert sorted(r[:2] for r in rows) == sorted({*(r[:2] for r in written), *want}) and len(rows) == len(written) + len(want)
        written = rows
        assert (k != 0 or want == {("b", "2026-02")}) and (k != 1 or not want)
    assert {r[:2] for r in written} == {("a", "2026-02"), ("b", "2026-02"), ("a", "2026-04"), ("b", "2026-04"), ("a", "2026-05")}
    assert next(r[4] for r in written if r[:2] == ("a", "2026-02")) == ["A", "B"]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_windows_and_sessions_of_unordered_repeated_rows(spark, tmp_path):
    """Three files of shuffled rows with repeats, the second run again after a failed write: sums equal those of the distinct rows."""
    rng, at = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(minutes=rng.randint(0, 1000)), k % 5, "ab"[k % 2], float(k)) for k in range(200)]
    parts = [rows[:80], rows[60:140] + rows[:5], rows[130:] + rows[100:110]]
    src, schema = f"file://{tmp_path}/in", spark.createDataFrame([], EVENTS).schema
    once = spark.createDataFrame(rows, EVENTS)
    for name, op, keys in (("windows", lambda d: windows.window_counts(d, "1 hour"), ["start", "event_type"]), ("sessions", windows.sessions, ["user_id", "start"])):
        out, append = f"file://{tmp_path}/{name}", name == "sessions"
        for k, part in enumerate(parts):
            rng.shuffle(part)
            if name == "windows":
                spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)
            if not append:
                stream = op(windows.distinct_events(spark.readStream.schema(schema).parquet(src)))
                q = windows.keyed_writer(stream, out, f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
                q.awaitTermination()
                if k == 1:  # the batch's folder is written, its commit is lost: it runs again under the same number
                    commits = tmp_path / f"cp-{name}" / "commits"
                    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
                    last.unlink()
                    (commits / f".{last.name}.crc").unlink(missing_ok=True)
                    windows.keyed_writer(op(windows.distinct_events(spark.readStream.schema(schema).parquet(src))), out, f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
        if append:  # sessions come out whole, once the watermark has passed them
            late = spark.createDataFrame([(999, at + dt.timedelta(days=9), 0, "a", 0.0)], EVENTS)
            late.coalesce(1).write.mode("append").parquet(src)
            stream = op(windows.distinct_events(spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(src)))
            windows.keyed_writer(stream, out, f"file://{tmp_path}/cp-{name}", "append").trigger(availableNow=True).start().awaitTermination()
        got = windows.newest(spark, out, keys)
        want = op(once)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    at, src, out = dt.datetime(2024, 1, 10), f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = spark.createDataFrame([], EVENTS).schema
    for rows in ([(1, at, 1, "a", 1.0)], [(2, at + dt.timedelta(days=3), 1, "a", 2.0)], [(3, at - dt.timedelta(days=2), 1, "a", 4.0), (2, at + dt.timedelta(days=3), 1, "a", 2.0)]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = windows.window_counts(windows.distinct_events(spark.readStream.schema(schema).parquet(src)), "1 day")
        windows.keyed_writer(stream, out, f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = windows.newest(spark, out, ["start", "event_type"]).collect()
    assert sorted((r["start"], r["n"], r["total"]) for r in got) == [(at, 1, 1.0), (at + dt.timedelta(days=3), 1, 2.0)]


def test_quota_windows_count_to_the_microsecond(spark, tmp_path):
    """Pairs around an hour apart, in all positions within a second: as counted by hand, and by the query's SQL."""
    hour, at = 3_600_000_000, 1_704_067_200_000_000
    gaps = [hour - 1, hour, hour - 800_000, hour - 400_000, hour + 400_000, 0, 1, 300_000]
    starts = [0, 100_000, 400_000, 499_999, 500_000, 900_000, -200_000]
    rows = [(u, at + s + g) for u, (s, gap) in enumerate((s, g) for s in starts for g in gaps) for g in (0, gap)] + [(None, at), (None, at + hour - 1), (0, None), (0, None)]
    want = [2 if t is None else sum(v == u and s is not None and t - hour < s <= t for v, s in rows) for u, t in rows]  # requests without a time are a window of their own
    src = f"{tmp_path}/events.parquet"
    for kind in ("timestamp_ntz", "timestamp"):
        d = spark.createDataFrame([(k, t, u) for k, (u, t) in enumerate(rows)], "event_id long, t long, user_id long")
        d.select("event_id", F.timestamp_micros("t").cast(kind).alias("ts"), "user_id").write.mode("overwrite").parquet(f"file://{src}")
        assert [r["in_window"] for r in catalogue.QUERIES["quota_windows"](spark, str(tmp_path)).orderBy("event_id").collect()] == want
        sql = catalogue.ORACLES["quota_windows"].replace("FROM events", f"FROM (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM read_parquet('{src}/*.parquet'))")
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        assert [r[1] for r in sorted(con.execute(sql).fetchall())] == want


def plain_admissions(rows, quotas, monthly=None):
    out, times, stopped = {}, {}, set()
    for key, seq, ts in sorted(rows, key=lambda r: r[1]):
        t = times.setdefault(key, [])
        at = max([x for x in (ts, t[-1] if t else None) if x is not None] + [t[-n] + s for n, s in quotas if len(t) >= n], default=0)
        month = lambda x: dt.datetime.fromtimestamp(x, dt.UTC).strftime("%Y-%m")
        if monthly and sum(month(x) == month(at) for x in t) >= monthly:
            stopped.add(key)
        if key not in stopped:
            t.append(at)
        out[key, seq] = (len(t), at) if key not in stopped else (None, None)
    return out


@pytest.mark.parametrize("monthly", [None, 25])
def test_admissions_of_two_runs_equal_one(spark, monthly):
    rng, limits = random.Random(6), ((3, 3600), (10, 86400))
    rows = [(rng.choice(["a", "a", "b", None]), k, None if rng.random() < 0.05 else 1_700_000_000 + k * rng.randint(0, 900)) for k in range(200)]
    df = lambda r: spark.createDataFrame(r, "key string, seq long, ts long")
    want = plain_admissions(rows, limits, monthly)
    read = lambda d: {(r["key"], r["seq"]): (r["place"], r["at"]) for r in d.collect()}
    one = quotas.admit(df(rows), None, limits, monthly)
    assert read(one) == want and quotas.admit(df([]), None, limits).count() == 0
    first = quotas.admit(df(rows[:90]), None, limits, monthly)
    tail = quotas.tail_of(first, limits) if monthly is None else first.filter("at is not null").select("key", "place", "at")
    left = {k for k, (_, at) in read(first).items() if at is None}
    second = quotas.admit(df([r for r in rows if r[1] >= 90 or (r[0], r[1]) in left]), tail, limits, monthly)
    assert {k: v for k, v in read(first).items() if k not in left} | read(second) == want
