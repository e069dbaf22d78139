"""One key over many tasks: sweeps by segments of time and frames in pieces, against plain Python and the plain frame."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors as FA
from tidemark.operators import filings as FI
from tidemark.operators import panel as P

D0 = dt.date(2020, 1, 1)


@pytest.mark.parametrize("seconds", [86400, 40 * 86400, 10**9])
def test_joins_by_segments_equal_plain_ones(spark, seconds):
    rng = random.Random(seconds)
    day = lambda: None if rng.random() < 0.05 else D0 + dt.timedelta(rng.randint(-400, 400))
    left = [(k, rng.choice(["h", "h", "h", "a", None]), day()) for k in range(300)]
    right = [(rng.choice(["h", "h", "h", "a", None]), day(), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(200)]
    lf, rf = spark.createDataFrame(left, "i long, k string, t date"), spark.createDataFrame(right, "k string, u date, v double")
    back = {r["i"]: r["x"] for r in P.asof_join(lf, rf, "k", "t", "u", "v", "x", seconds).collect()}
    ahead = {r["i"]: r["x"] for r in P.forward_join(lf, rf, "k", "t", "u", "x", seconds).collect()}
    for i, k, t in left:
        mine = [(u, v) for key, u, v in right if key == k and u is not None]
        past = [(u, v) for u, v in mine if t is not None and u <= t and v is not None]
        assert back[i] == (max(past)[1] if past else None)
        assert ahead[i] == min((u for u, _ in mine if t is None or u >= t), default=None)
    parts = P.asof_join(lf.filter("k = 'h'"), rf, "k", "t", "u", "v", "x", 86400)._jdf.queryExecution().executedPlan().toString()
    assert "__part" in parts and parts.count("hashpartitioning(k") >= 1


@pytest.mark.parametrize("seconds", [7 * 86400, 10**10])
def test_listings_by_segments_equal_plain_ones(spark, seconds):
    rng = random.Random(1)
    span = lambda: sorted(D0 + dt.timedelta(rng.randint(0, 2000)) for _ in range(2))
    claims = [(k, rng.choice(["h", "h", "a"]), *span()) for k in range(150)] + [(150, None, D0, D0), (151, "h", None, D0)]
    listings = [(rng.choice(["h", "h", "a"]), rng.randint(0, 9), "X", *span()) for _ in range(60)] + [("h", 1, "X", None, D0)]
    got = FI.match_listing(spark.createDataFrame(claims, "claim long, ticker string, d0 date, d1 date"), spark.createDataFrame(listings, "ticker string, owner int, exchange string, start date, end date"), seconds)
    for r in got.collect():
        _, t, a, b = claims[r["claim"]]
        fits = [(e, s, -o) for k, o, _, s, e in listings if k == t and t and a and s and s <= b and e >= a]
        want = max(fits, default=None)
        assert (r["l_end"], r["l_start"], r["owner"]) == ((want[0], want[1], -want[2]) if want else (None, None, None))


@pytest.mark.parametrize("size", [40, 128, 5000])
def test_frames_in_pieces_equal_whole_ones(spark, size):
    """A ticker with gaps, a short one, and one that ends early; every column, at every day."""
    rng, s = random.Random(size), FA.Spec(30, 3, 10, 21, 5, 18)
    days = [D0 + dt.timedelta(k) for k in range(400)]
    closes = [(t, "g", d, None if rng.random() < 0.02 else round(5 + rng.random(), 3)) for t, a, b, p in (("hot", 0, 400, 0.9), ("gap", 0, 400, 0.3), ("late", 350, 400, 1), ("early", 0, 60, 1)) for d in days[a:b] if rng.random() < p]
    panel = spark.createDataFrame(closes, "ticker string, grp string, d date, close double")
    cal = P.calendar(spark.createDataFrame([(d,) for d in days], "d date"))
    r9 = lambda d: sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*FA.FACTOR_COLUMNS).collect())))
    whole, pieces = FA.factors(P.fill(P.align(panel, cal)), s), FA.chunked_factors(panel, cal, s, size)
    assert r9(pieces) == r9(whole)
    if size == 40:
        n = P.chunks(P.align(panel, cal), size, 30).filter("own").groupBy("ticker", "chunk").agg(F.count(F.lit(1)).alias("n")).filter("ticker = 'hot'")
        assert n.count() == 10 and {r["n"] for r in n.collect()} == {40}
