"""Exact nearest neighbours: rows live in cells around pivots, and bounds tell which cells a query can skip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .graph import cut

#: Pivots, at most; that many vectors are all that the driver and each task hold of the table.
PIVOTS = 2048
FOUND = "src long, r double, dst long, distance double, compared long"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors to all pivots."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def compare(table: pa.Table) -> pa.Table:
    """A row per query of a group: its nearest row there, of those that the bound does not exclude."""
    q, r = (table.filter(pc.equal(table["side"], k)).sort_by("id").combine_chunks() for k in (0, 1))
    out: dict[str, list] = {n.split()[0]: [] for n in FOUND.split(", ")}
    if q.num_rows and r.num_rows:
        x, y, ids, to = matrix(q["v"]), matrix(r["v"]), r["id"].to_numpy(), r["to"].to_numpy()
        for i, (me, d, most) in enumerate(zip(*(q[n].to_numpy() for n in ("id", "to", "most")), strict=True)):
            near = np.flatnonzero((np.abs(to - d) <= most) & (ids != me))
            far = np.sqrt(((y[near] - x[i]) ** 2).sum(1))
            j = int(np.round(far, 6).argmin()) if len(near) else -1  # the first of equal ones has the least id
            for name, v in zip(out, (int(me), round(float(far[j]), 6), int(ids[near[j]]), float(far[j]), len(near)) if len(near) else (int(me), None, None, None, 0), strict=True):
                out[name].append(v)
    return pa.table({n: pa.array(v, pa.float64() if n in ("r", "distance") else pa.int64()) for n, v in out.items()})


def nearest(queries: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = 4096, most_pivots: int = PIVOTS) -> DataFrame:
    """For each query vector the nearest other row (Euclidean, to six digits), ties to the least key.

    About the square root of the rows, up to ``most_pivots``, are pivots, picked by a hash, and each row
    belongs to the cell of its nearest one. A query is first compared with its own cell. The best
    distance there and the triangle inequality then tell which other cells can hold something as
    near (by the cell's radii, and by the plane between the two pivots), and which rows inside them;
    only those are compared. Cells and the queries sent to one are split into blocks of about
    ``block`` by a hash, so that a cell which holds most rows is many groups. Nothing is left out: a
    cell or row is skipped only when its bound is beyond the best.

    Rows without a key, or with a null or non-finite component, are neighbours of nothing, and a
    query with nothing to compare has no row. ``compared`` counts the rows a query met.

    Returns src, dst, distance, compared.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    side = lambda df, n: df.select(F.lit(n).alias("side"), F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    rows, queries = side(rows, 1), side(queries, 0)
    spark, n = rows.sparkSession, rows.count()
    want = max(1, min(most_pivots, round(n**0.5)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(want).select("v").toArrow()
    if not len(picked):
        return spark.createDataFrame([], "src long, dst long, distance double, compared long")
    pivots = spark.sparkContext.broadcast(matrix(picked["v"]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                d = to_pivots(matrix(part["v"]), pivots.value)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own])], names=[*part.schema.names, "cell", "to"])

    placed = "side int, id long, v array<double>, cell int, to double"
    rows, queries = (cut(df.mapInArrow(assign, placed)) for df in (rows, queries))
    size = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("to").alias("low"), F.max("to").alias("high"))
    cells = {r.cell: (r.low, r.high) for r in size.collect()}  # a row a pivot
    slack = 1e-6 * (1 + 2 * float(np.abs(pivots.value).max()) * pivots.value.shape[1] ** 0.5)
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    parts = lambda n: F.ceil(F.col(n) / block)

    def met(asked: DataFrame) -> DataFrame:
        """Queries (id, v, cell, to, most) compared with the rows of those cells, in groups of blocks."""
        load = asked.groupBy("cell").agg(F.count("*").alias("m")).join(size.select("cell", "n"), "cell")
        load = F.broadcast(load.select("cell", parts("m").alias("qs"), parts("n").alias("rs")))  # a row a pivot
        q = asked.join(load, "cell").select("side", "id", "v", "cell", "to", "most", own(F.col("qs")).alias("a"), every(F.col("rs")).alias("b"))
        r = rows.join(load, "cell").select("side", "id", "v", "cell", "to", F.lit(None).cast("double").alias("most"), every(F.col("qs")).alias("a"), own(F.col("rs")).alias("b"))
        return q.unionByName(r).groupBy("cell", "a", "b").applyInArrow(compare, FOUND)

    def best(found: DataFrame) -> DataFrame:
        key: Column = F.when(F.col("dst").isNotNull(), F.struct("r", "dst", "distance"))
        return found.groupBy("src").agg(F.min(key).alias("k"), F.sum("compared").alias("compared"))

    first = cut(best(met(queries.withColumn("most", F.lit(float("inf"))))))
    bounds = np.array([cells.get(c, (np.inf, -np.inf)) for c in range(len(pivots.value))])

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = bounds.T
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                d, at = to_pivots(matrix(part["v"]), pivots.value), part["cell"].to_numpy()
                mine, most = d[np.arange(len(at)), at][:, None], part["most"].to_numpy()[:, None]
                least = np.maximum(np.maximum(d - high, low - d), (d - mine) / 2)
                go = (least <= most) & (high >= low)
                go[np.arange(len(at)), at] = False
                i, cell = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([part["side"].take(i), part["id"].take(i), part["v"].take(i), pa.array(cell, pa.int32()), pa.array(d[i, cell]), part["most"].take(i)], names=["side", "id", "v", "cell", "to", "most"])

    radius = first.select(F.col("src").alias("id"), (F.coalesce("k.distance", F.lit(float("inf"))) + slack).alias("most"))
    asked = queries.join(radius, "id", "left").select("side", "id", "v", "cell", "to", F.coalesce("most", F.lit(float("inf"))).alias("most"))
    asked = cut(asked.mapInArrow(onward, placed + ", most double"))
    both = met(asked).unionByName(first.select("src", "k.r", "k.dst", "k.distance", "compared"))
    return best(both).where("k is not null").select("src", "k.dst", "k.distance", "compared")
