"""Exact quantiles against NumPy: ties, outliers, infinities, nulls, few and many groups, and the scans they take."""

import numpy as np
import pytest

from skylattice.operators import quantiles as qu
from skylattice.operators.quantiles import exact_quantiles

WANTED = {"p0": ("v", 0.0), "p16": ("v", 0.16), "p50": ("v", 0.5), "p84": ("v", 0.84), "p100": ("v", 1.0), "m": ("u", 0.5)}


def plain(pairs):
    v, u = (np.array([x for x in column if x is not None and x == x], float) for column in zip(*pairs, strict=True))
    with np.errstate(invalid="ignore"):
        return tuple(None if not len(x) else float(np.quantile(x, p)) for x, p in [(v, 0.0), (v, 0.16), (v, 0.5), (v, 0.84), (v, 1.0), (u, 0.5)])


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12, abs=1e-12)), (got, want)


def samples(n, seed):
    rng = np.random.default_rng(seed)
    shapes = [rng.normal(0, 1, n), rng.integers(0, 4, n) * 1.0, np.exp(rng.normal(0, 30, n)), rng.choice([-1e300, -1.0, 0.0, 1e-300, 1.7e308], n), np.full(n, 7.25)]
    return [(float(a), None if i % 5 == 0 else float(-a)) for i, a in enumerate(shapes[seed % len(shapes)])]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize(("bins", "listed"), [(2048, 2048), (4, 3)])
def test_of_a_whole_table(spark, seed, bins, listed, monkeypatch):
    monkeypatch.setattr(qu, "BINS", bins)
    monkeypatch.setattr(qu, "LISTED", listed)
    pairs = [*samples(211, seed), (None, 1.0), (float("nan"), None)]
    df = spark.createDataFrame(pairs, "v double, u double").repartition(3)
    near(tuple(exact_quantiles(df, WANTED).first()), plain(pairs))


@pytest.mark.parametrize("few", [256, 0])
def test_of_groups(spark, few, monkeypatch):
    monkeypatch.setattr(qu, "FEW", few)
    monkeypatch.setattr(qu, "BINS", 8)
    monkeypatch.setattr(qu, "LISTED", 5)
    groups = {("a", 1): samples(40, 0), ("a", None): samples(9, 1), (None, 2): [(3.0, None)], ("b", 2): [(None, None), (float("nan"), None)], ("c", 1): samples(30, 3)}
    df = spark.createDataFrame([(*g, *p) for g, pairs in groups.items() for p in pairs], "g string, h long, v double, u double").repartition(4)
    got = {(r.g, r.h): tuple(r)[2:] for r in exact_quantiles(df, WANTED, ["g", "h"]).collect()}
    assert set(got) == set(groups)
    for g, pairs in groups.items():
        near(got[g], plain(pairs))


def test_infinities_and_no_rows(spark):
    values = [float("-inf"), -3.0, 2.0, 5.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert tuple(exact_quantiles(df, {"a": ("v", 0.0), "b": ("v", 0.25), "c": ("v", 0.5), "d": ("v", 0.75), "e": ("v", 1.0)}).first()) == tuple(values)
    assert tuple(exact_quantiles(df.limit(0), {"a": ("v", 0.5)}).first()) == (None,)
    assert exact_quantiles(df.limit(0).selectExpr("v", "1 AS g"), {"a": ("v", 0.5)}, ["g"]).count() == 0


def test_four_scans_at_most(spark, monkeypatch):
    """Half a million uneven values: the ends, and three rounds of counts at most."""
    rounds, real = [], qu.local
    monkeypatch.setattr(qu, "local", lambda s, rows, schema: rounds.append(schema) or real(s, rows, schema))
    df = spark.range(500_000).selectExpr("id * id % 1000003 * 1.5 + CASE WHEN id % 1000 = 0 THEN 1e7 ELSE 0 END AS v")
    got = exact_quantiles(df, {"a": ("v", 0.5), "b": ("v", 0.16), "c": ("v", 0.999)}).first()
    near(tuple(got), tuple(float(x) for x in np.quantile(np.array([r[0] for r in df.collect()], float), [0.5, 0.16, 0.999])))
    assert sum("size" in r for r in rounds) <= 3
