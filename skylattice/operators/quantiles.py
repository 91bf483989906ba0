"""Exact quantiles by counts over shrinking ranges: values are neither sorted nor sent."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graph import cut, discard

#: Equal parts of a range that are counted in a round, and values of a range that are listed at the end.
BINS, LISTED = 2048, 2048
#: Groups times quantiles up to which ranges live on the driver, where BINS counts of each are read.
FEW = 256
TOP = 1.7976931348623157e308
STATE = "t int, i int, at long, w double, lo double, hi double, below long, n long"
NAMES = [f.split()[0] for f in STATE.split(", ")]


def exact_quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str] | None = None) -> DataFrame:
    """One row per group: for each output name the (column, share) quantile, linear between neighbours.

    A quantile lies at one place in the order of a group's values, or between two. For each place there is
    a range that holds its value: first from the least to the greatest value; then the rows of the
    range are counted in BINS equal parts, with the least and greatest value of each, and the part in
    which the place falls is the next range. Once a range holds LISTED rows or a single value, its
    values are counted one by one and the place is read off. A round is one scan and an
    aggregation with partial results, and three scans do for some millions of rows; only counts are
    shuffled. Parts are cut by value, so rounds grow only with how unevenly values lie. Ranges of
    few groups are kept on the driver and broadcast; those of many are a table that is joined.

    Nulls and NaN don't count; a group without values has nulls.
    """
    by, columns = by or [], list(dict.fromkeys(c for c, _ in wanted.values()))
    rows = rows.select(*by, *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)))
    ends = rows.groupBy(*by).agg(*(x for i in range(len(columns)) for x in (F.count(f"_v{i}").alias(f"n{i}"), F.min(f"_v{i}").alias(f"lo{i}"), F.max(f"_v{i}").alias(f"hi{i}"))))
    places = []
    for k, (c, p) in enumerate(wanted.values()):
        i = columns.index(c)
        at = F.lit(float(p)) * (F.col(f"n{i}") - 1)
        for upper in (0, 1):
            weight = at - F.floor(at) if upper else 1 - (at - F.floor(at))
            places.append(F.struct(F.lit(2 * k + upper).alias("t"), F.lit(i).alias("i"), (F.floor(at) + upper).alias("at"), weight.alias("w"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.lit(0).cast("long").alias("below"), F.col(f"n{i}").alias("n")))
    state = ends.select(*by, F.explode(F.array(*places)).alias("_s")).select(*by, "_s.*")
    if not by:
        return on_driver(rows, state.collect(), list(wanted), by, state)
    state = cut(state)
    first = state.limit(FEW + 1).collect()
    return on_driver(rows, first, list(wanted), by, state) if len(first) <= FEW else as_table(rows, state, list(wanted), by)


def part_of(listed: Column) -> Column:
    """The value itself, or the number of its part of a range."""
    lo, hi, v = (F.greatest(F.least(F.col(x), F.lit(TOP)), F.lit(-TOP)) / 2 for x in ("lo", "hi", "v"))
    return F.when(listed, F.col("v")).otherwise(F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("double"))


def value_of(n: int) -> Column:
    """The value of the column whose number is in ``i``."""
    return reduce(lambda out, k: F.when(F.col("i") == k, F.col(f"_v{k}")).otherwise(out), range(n), F.lit(None).cast("double"))


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan, so no job reads it."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds), StructType.fromDDL(schema))


def on_driver(rows: DataFrame, state: list[Row], names: list[str], by: list[str], every: DataFrame) -> DataFrame:
    """Rounds over ranges that the driver keeps: a scan counts the parts of all ranges together."""
    spark, n_columns = rows.sparkSession, sum(c.startswith("_v") for c in rows.columns)
    done: dict[tuple, float] = {}
    places = [r.asDict() for r in state if r["n"] and r["w"] > 0]
    while True:
        for p in places:
            if p["lo"] == p["hi"]:
                done[(*(p[c] for c in by), p["t"])] = p["w"] * p["lo"]
        places = [p for p in places if p["lo"] != p["hi"]]
        if not places:
            break
        same = lambda p: (*(p[c] for c in by), p["i"], p["lo"], p["hi"])  # noqa: E731  two places may share a range
        ranges = {k: j for j, k in enumerate(dict.fromkeys(map(same, places)))}
        kinds = [f"`_g{j}` {every.schema[c].dataType.simpleString()}" for j, c in enumerate(by)]
        sizes = {ranges[same(p)]: p["n"] for p in places}
        table = local(spark, [(*k, j, sizes[j]) for k, j in ranges.items()], ", ".join([*kinds, "i int, lo double, hi double, r int, size long"]))
        met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{j}")) for j, c in enumerate(by)], F.lit(True))
        v = value_of(n_columns)
        inside = rows.join(F.broadcast(table), met & (v >= F.col("lo")) & (v <= F.col("hi"))).select("r", "lo", "hi", "size", v.alias("v"))
        counts = inside.groupBy("r", part_of(F.col("size") <= LISTED).alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found: dict[int, list[Row]] = {}
        for c in sorted(counts.collect(), key=lambda c: (c["r"], c["part"])):
            found.setdefault(c["r"], []).append(c)
        for p in places:
            for c in found[ranges[same(p)]]:
                if p["at"] < p["below"] + c["n"]:
                    p |= {"lo": c["lo"], "hi": c["hi"], "n": c["n"]}
                    break
                p["below"] += c["n"]
    groups = dict.fromkeys(tuple(r[c] for c in by) for r in state) if by else {(): None}
    out = []
    for g in groups:
        pairs = [[done[(*g, t)] for t in (2 * k, 2 * k + 1) if (*g, t) in done] for k in range(len(names))]
        out.append((*g, *(sum(x) if x else None for x in pairs)))
    kinds = [f"`{c}` {every.schema[c].dataType.simpleString()}" for c in by]
    return local(spark, out, ", ".join([*kinds, *(f"`{n}` double" for n in names)]))


def as_table(rows: DataFrame, every: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Rounds over ranges in a table, joined with the rows by group."""
    n_columns, kept = sum(c.startswith("_v") for c in rows.columns), []

    def marked(df: DataFrame, *more: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"_{c}" for c in (*by, *more)})

    def same(*more: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, *more)])

    places = every.where("n > 0 and w > 0")
    while True:
        wide = places.where("lo < hi")
        if wide.isEmpty():
            break
        v = value_of(n_columns)
        inside = rows.join(marked(wide), same()).withColumn("v", v).where("v >= lo and v <= hi")
        counts = inside.groupBy(*by, "t", part_of(F.col("n") <= LISTED).alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("below").alias("below"))
        before = F.sum("n").over(Window.partitionBy(*by, "t").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        counts = counts.withColumn("below", F.col("below") + before)
        found = counts.join(marked(wide.select(*by, "t", "i", "at", "w"), "t"), same("t")).where("below <= at and at < below + n")
        places = cut(places.where("lo = hi").select(*by, *NAMES).unionByName(found.select(*by, *NAMES)))
        kept.append(places)
    sums = places.groupBy(*by).agg(*(F.sum(F.when(F.floor(F.col("t") / 2) == k, F.col("w") * F.col("lo"))).alias(name) for k, name in enumerate(names)))
    out = cut(every.select(*by).distinct().join(marked(sums), same(), "left").select(*by, *names))
    for x in (every, *kept):
        discard(x)
    return out
