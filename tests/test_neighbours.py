"""Nearest neighbours by pivots against comparing everything, and how few rows are compared."""

import numpy as np
import pytest

from skylattice.operators import neighbours as nn

ROWS = "vec_id long, embedding array<double>"


def brute(queries, rows):
    out, ids = {}, np.array([i for i, _ in rows])
    y = np.array([v for _, v in rows])
    for i, v in queries:
        d = np.round(np.sqrt(((y - v) ** 2).sum(1)), 6)
        d[ids == i] = np.inf
        if np.isfinite(d).any():
            best = d.min()
            out[i] = (int(ids[d == best].min()), float(best))
    return out


def found(df):
    return {r.src: (r.dst, round(r.distance, 6)) for r in df.collect()}


@pytest.mark.parametrize(("block", "most"), [(4096, 2048), (7, 5), (16, 1)])
def test_equals_brute_force(spark, block, most):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(0, 1, 5)).round(2).tolist()) for i in range(150)]
    rows += [(i, [1.0] * 5) for i in range(200, 260)]  # copies: one hot cell, ties to the least key
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    queries = [r for r in rows if r[0] % 3 == 0] + [(900, [50.0] * 5)]
    got = nn.nearest(spark.createDataFrame(queries, ROWS), df, block=block, most_pivots=most)
    assert found(got) == brute(queries, rows)


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [5.0, 0.0]), (2, [float("nan"), 0.0]), (3, None), (4, [float("inf"), 1.0]), (None, [0.0, 0.1]), (5, [0.0, 3.0])]
    df = spark.createDataFrame(rows, ROWS)
    got = found(nn.nearest(df, df))
    assert got == {1: (5, 3.0), 5: (1, 3.0)}
    assert nn.nearest(df, df.limit(0)).count() == 0 == nn.nearest(df.limit(0), df).count()
    assert nn.nearest(df.where("vec_id = 5"), df.where("vec_id = 5")).count() == 0


def test_share_of_compared_pairs_falls_with_size(spark):
    """Descriptors come in clusters: the share of all pairs that are compared, at two sizes."""
    share = []
    for n in (500, 4000):
        rng = np.random.default_rng(n)
        centres = rng.normal(0, 10, (n // 20, 8))
        rows = [(i, (centres[i % len(centres)] + rng.normal(0, 0.5, 8)).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, ROWS)
        queries = df.where("vec_id % 10 = 0")
        got = nn.nearest(queries, df)
        share.append(got.agg({"compared": "sum"}).first()[0] / (n / 10 * n))
        if n == 500:
            assert found(got) == brute([r for r in rows if r[0] % 10 == 0], rows)
    assert share[1] < share[0] / 2 < 0.25
