"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .components import components, cut

#: Vectors of one block of a leaf: a leaf of more is compared block by block.
BLOCK = 768
#: Leaves of more than one block up to this number are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


class Forest:
    """Trees of random splits at the sample median; ``margin`` to both sides of a split spills over."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, margin: float, seed: int):
        rng = np.random.default_rng(seed)
        self.dim, self.depth, self.margin = sample.shape[1], depth, margin
        self.directions = rng.standard_normal((trees, (1 << depth) - 1, self.dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros(self.directions.shape[:2])
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range((1 << depth) - 1):
                own = rows.pop(node)
                p = sample[own] @ self.directions[t, node]
                self.cuts[t, node] = np.median(p) if len(p) else 0.0
                rows[2 * node + 1], rows[2 * node + 2] = own[p < self.cuts[t, node]], own[p >= self.cuts[t, node]]

    def leaves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf id) of every leaf each row falls into; ids are distinct across trees."""
        out = []
        for t in range(len(self.directions)):
            row, node = np.arange(len(v)), np.zeros(len(v), np.int64)
            for _ in range(self.depth):
                d = np.einsum("ij,ij->i", v[row], self.directions[t, node]) - self.cuts[t, node]
                left, right = d < self.margin, d >= -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            out.append((row, node - ((1 << self.depth) - 1) + (t << self.depth)))
        row, leaf = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort([leaf, row])
        return row[order], leaf[order]


def compare(v: np.ndarray, w: np.ndarray, mine: pa.ListArray, other: pa.ListArray, leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, counted) of each pair: counted are links that share no leaf before this one."""
    linked = v @ w.T >= threshold

    def before(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        return row[flat < leaf], flat[flat < leaf]

    (row_a, a), (row_b, b) = before(mine), before(other)
    shared = np.intersect1d(a, b)
    if not len(shared):
        return linked, linked

    def marks(row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out, own = np.zeros((n, len(shared)), np.float32), np.isin(at, shared)
        out[row[own], np.searchsorted(shared, at[own])] = 1
        return out

    return linked, linked & (marks(row_a, a, len(v)) @ marks(row_b, b, len(w)).T == 0)


def roots(linked: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of the n rows by the symmetric links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def unit_vectors(flat: np.ndarray, n: int) -> np.ndarray:
    """Rows of double precision and length 1; dividing by the largest part first avoids overflow."""
    if not n:
        return np.zeros((0, 1))
    v = flat.astype(np.float64).reshape(n, -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, trees: int = 5, leaf: int = 64, per_leaf: int = 16, most: int = 1 << 18, seed: int = 7) -> DataFrame:
    """Link vectors of equal, non-null label whose cosine (double precision) is >= threshold.

    Equal vectors of one label are one class, numbered in the order of the classes' least vec_id.
    Classes fall down ``trees`` random-projection trees, deep enough that the largest label has
    about ``leaf`` classes a leaf before spill. They are fitted on a hash sample of about
    ``per_leaf`` classes a leaf, ``most`` (a bound) at most; beyond ``most / per_leaf * leaf``
    classes of a label leaves grow, and are still compared whole. A class within 0.8 standard
    deviations of a linked pair's projected distance of a split goes to both sides, so a pair at
    the threshold is parted in one tree with a probability of about 1 % a level, and in all
    trees hardly ever. Every leaf is compared exactly, in blocks of BLOCK classes, each pair of
    blocks a group of its own, whatever the leaf's size. A block returns sums of links and a
    spanning forest, never pairs. A pair that meets in several leaves counts in the first one.

    Vectors that are null, zero, or hold null or non-finite components, and rows without a label,
    link with nothing. Only vectors of equal length are compared. Rows are vectors of their own,
    also with a repeated or null vec_id; a component of rows without one has a null component_id,
    and its rows count as kept. An empty table gives no rows; other columns are ignored.

    Returns vec_id, n_links, component_id, kept, one row per input row.
    """
    spark = vectors.sparkSession
    kept = dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>")
    value = F.col("embedding") if kept else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", F.col("label").alias("label"), value.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(good, F.col("v")).alias("v"))
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("vec"), F.count("*").alias("k"))
    classes = classes.orderBy(F.asc_nulls_last("vec"), F.xxhash64("label", "v"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "vec", "label", "k", "v"))
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("dim").agg(F.sum("n").alias("t"), F.max("n").alias("m")).orderBy(F.desc("t"), "dim").limit(1).collect()
    dim, total, largest = sizes[0] if sizes else (1, 0, 0)
    wanted = min(per_leaf * largest / leaf, most) * total / max(largest, 1)  # the largest label's share of the sample is its share of all
    share = min(1.0, min(wanted, most) / max(total, 1))
    picked = classes.where(F.size("v") == dim).where(F.shiftrightunsigned(F.xxhash64("rep", F.lit(seed)), 11) < F.lit(int(share * (1 << 53))))
    fitted = [r[0] for r in picked.select("v").collect()]
    fitted = unit_vectors(np.array(fitted), len(fitted)) if fitted else np.zeros((0, dim))
    depth = max(0, min(math.ceil(math.log2(max(largest, 1) / leaf)), int(math.log2(max(len(fitted), 1) / per_leaf)) if len(fitted) >= per_leaf else 0))
    margin = 0.8 * math.sqrt(2 * (1 - threshold) / dim)
    forest = spark.sparkContext.broadcast(Forest(fitted, trees, depth, margin, seed))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            own = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == forest.value.dim)
            row, at = forest.value.leaves(unit_vectors(lists.take(pa.array(own)).flatten().to_numpy(), len(own))) if len(own) else (own, own)
            # vectors of other lengths, few by the choice of dim, share leaf 0
            other = np.setdiff1d(np.arange(batch.num_rows), own)
            row, at = np.concatenate([own[row], other]), np.concatenate([at, np.zeros(len(other), np.int64)])
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("label", "rep", "k", "v")), leaves], names=["label", "rep", "k", "v", "leaves"])

    kinds = dict(classes.dtypes)
    routed = cut(classes.select("label", "rep", "k", "v").mapInArrow(T.lean(route), f"label {kinds['label']}, rep long, k long, v {kinds['v']}, leaves array<int>"))
    falls = routed.select(F.xxhash64("label", F.size("v")).alias("lab"), "rep", "k", "v", "leaves", F.explode("leaves").alias("leaf"))
    large = falls.groupBy("lab", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).where("nb > 1")
    large = cut(large)
    blocks = F.coalesce("nb", F.lit(1))
    placed = falls.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, ["lab", "leaf"], "left").withColumn("b", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = placed.select("lab", "leaf", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "rep", "k", "v", "leaves")

    def unit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("b", "ascending"), ("rep", "ascending")]).combine_chunks()
        p, q, leaf, n = *(table[c][0].as_py() for c in ("p", "q", "leaf")), table.num_rows
        rep, k, leaves = table["rep"].to_numpy(), table["k"].to_numpy(), table["leaves"].chunk(0)
        # a hash of the label and the length stands for both; lengths of one group are checked here
        length = np.diff(table["v"].chunk(0).offsets.to_numpy())
        assert (length == length[0]).all()
        v = unit_vectors(table["v"].chunk(0).flatten().to_numpy(), n)
        mid = n if p == q else int(np.searchsorted(table["b"].to_numpy(), q))
        linked, counted = np.zeros((n, n), bool), np.zeros((n, n), bool)
        a, b = (slice(0, n), slice(0, n)) if p == q else (slice(0, mid), slice(mid, n))
        linked[a, b], counted[a, b] = compare(v[a], v[b], leaves[a], leaves[b], leaf, threshold)
        if p == q:
            np.fill_diagonal(linked, False)
            np.fill_diagonal(counted, False)
        else:
            linked, counted = linked | linked.T, counted | counted.T
        links, root = counted @ k.astype(float), roots(linked, n)
        some = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table({"rep": rep[some], "n": links[some].astype(np.int64), "root": rep[root[some]]})

    found = cut(units.groupBy("lab", "leaf", "p", "q").applyInArrow(unit, "rep long, n long, root long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    # the side of a component of very many classes is one that Spark splits
    label = label.join(classes.select(F.col("rep").alias("component"), F.col("vec").alias("root")), "component").withColumnRenamed("id", "rep")
    root = F.when(F.col("component").isNull(), F.col("vec")).otherwise(F.col("root"))
    named = classes.join(links, "rep", "left").join(label, "rep", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"), root.alias("root"))
    out = rows.join(named, ["label", "v"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("root"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
