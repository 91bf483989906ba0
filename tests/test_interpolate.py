"""Interpolation joins against a plain version, across buckets, logs, ties and nulls, and their cost."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from skylattice.operators import interpolate as ip


def plain(at, log):
    """Linear interpolation of (t, v) pairs; of equal times the least value counts, null least of all."""
    first = {}
    for t, v in log:
        if t is not None:
            first[t] = min(first.get(t, v), v, key=lambda x: (x is not None, x or 0))
    ts = sorted(first)
    i = bisect.bisect_left(ts, at) if at is not None else len(ts)
    if i == len(ts):
        return None
    if i == 0:
        return first[ts[0]] if ts[0] == at else None
    lo, hi = first[ts[i - 1]], first[ts[i]]
    return None if lo is None or hi is None else lo + (hi - lo) / (ts[i] - ts[i - 1]) * (at - ts[i - 1])


def table(spark, pairs, *names):
    df = spark.createDataFrame(pairs, ", ".join(f"{n} {'long' if n in ('id', 's', 'flight') else 'double'}" for n in names))
    return df.withColumn("t", F.timestamp_micros("s")).drop("s")


@pytest.mark.parametrize("bucket", [1, 7, 10**6, None])
def test_two_logs_equal_a_plain_version(spark, bucket):
    r = random.Random(bucket or 0)
    img = [(i, r.choice([None, *range(-40, 240)]), i % 3 or None) for i in range(200)]
    logs = [[(f, r.choice([None, *range(0, 200)]), r.choice([None, 1.0, 2.5, -3.0])) for f in (1, 2) for _ in range(60)] for _ in range(2)]
    rows = table(spark, img, "id", "s", "flight")
    a, b = (table(spark, log, "flight", "s", n) for log, n in zip(logs, ("a", "b"), strict=True))
    got = {x.id: (x.a, x.b) for x in ip.interpolate_logs(rows, [(a, ["a"]), (b, ["b"])], "t", ["flight"], bucket).collect()}
    assert len(got) == len(img)
    for i, s, flight in img:
        want = [plain(s, [(t, v) for f, t, v in log if f == flight]) for log in logs]
        for x, y in zip(got[i], want, strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)), (i, s, flight, got[i], want)


def test_empty_sides(spark):
    rows, none = table(spark, [(1, 5)], "id", "s"), table(spark, [], "s", "a")
    assert [tuple(x) for x in ip.interpolate_at(rows, none, "t", ["a"]).select("id", "a").collect()] == [(1, None)]
    assert ip.interpolate_at(rows.limit(0), table(spark, [(5, 1.0)], "s", "a"), "t", ["a"]).count() == 0


def test_cost_of_one_full_bucket_is_linear(spark):
    """Twice the rows of a single bucket take at most three times as long."""

    def seconds(n):
        rows = spark.range(n).select("id", F.timestamp_micros(F.col("id") * 10 + 5).alias("t"))
        log = spark.range(n + 1).select(F.timestamp_micros(F.col("id") * 10).alias("t"), (F.col("id") * 2.0).alias("a"))
        best = []
        for _ in range(2):
            began = time.perf_counter()
            wrong = ip.interpolate_at(rows, log, "t", ["a"], bucket_us=1 << 50).where(F.abs(F.col("a") - F.col("id") * 2 - 1) > 1e-9).count()
            best.append(time.perf_counter() - began)
            assert wrong == 0
        return min(best)

    seconds(1000)
    assert seconds(200_000) <= 3 * max(seconds(100_000), 0.5)


def test_times_without_a_zone_do_not_depend_on_the_session(spark):
    """An hour that the session's zone skips, or has twice, counts as any other."""
    log = [("2024-03-10 01:00:00", 0.0), ("2024-03-10 05:00:00", 4.0), ("2024-11-03 00:00:00", 0.0), ("2024-11-03 04:00:00", 4.0)]
    at = [("2024-03-10 02:30:00.5", 1.5 + 0.5 / 3600), ("2024-03-10 03:30:00", 2.5), ("2024-11-03 02:00:00", 2.0), ("2024-03-10 01:00:00", 0.0)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        times = lambda pairs, name: spark.createDataFrame(pairs, f"t string, {name} double").withColumn("t", F.col("t").cast("timestamp_ntz"))
        got = ip.interpolate_at(times(at, "want"), times(log, "a"), "t", ["a"]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(got) == len(at)
    for r in got:
        assert r.a == pytest.approx(r.want, abs=1e-9), r
