"""Near-duplicate documents by SetSketch registers: banding, joint likelihood, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .components import components, cut

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5
#: Registers come in bands of 4; a register is a 16-bit number.
BAND = 4
#: Base and rate of the register scale: neighbouring values differ by 2 %.
B, RATE = 1.02, 20.0
TOP = (1 << 16) - 2


def shingle_sets(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the document, its distinct shingle hashes, sorted)."""
    data = LOWER[data]
    starts, ends, bounds = T.word_bounds(data, offsets, T.NON_SPACE)
    spans = T.SpanHash(T.word_hashes(data, starts, ends), T.BASE_B)
    every, bounds = spans.every(size), bounds.tolist()
    for i in range(len(ids)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= size:
            yield i, np.unique(every[a : b - size + 1])
        else:
            yield i, spans.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, T.U64)


def seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    h = T.mix(np.arange(1, 2 * m + 1).astype(T.U64) * T.U64(T.BASE_A))
    return (h[:m] >> T.U64(32)).astype(np.uint32) | np.uint32(1), (h[m:] >> T.U64(32)).astype(np.uint32)


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers: per register the least exponential of all elements, on a log scale.

    The exponential is a monotone map of a uniform number, so only the least uniform number of
    each register is transformed.
    """
    mult, add = seeds(m)
    x, low = (hashes >> T.U64(32)).astype(np.uint32), np.full(m, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048] * mult[:, None]
        part += add[:, None]
        np.minimum(low, part.min(1), out=low)
    e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(e) / math.log(B)), 0, TOP).astype("<u2")


def log_likelihood(plus: np.ndarray, minus: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the similarity j, given how many registers are larger, smaller and equal and the
    relative set sizes u + v = 1."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B)
    a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    return plus * np.log(a) + minus * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, slack: float = 14.0) -> np.ndarray:
    """Pairs whose likelihood at some similarity >= threshold is within e**-slack of the best."""
    plus, minus = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - plus - minus
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    grid = np.linspace(0, 1, 41)[None, :] * np.minimum(u / v, v / u)
    fit = log_likelihood(plus, minus, same, u, v, grid)
    high = np.where(grid >= threshold - 1e-9, fit, -np.inf).max(1)
    at = log_likelihood(plus, minus, same, u, v, np.full_like(u, threshold))[:, 0]
    return np.maximum(high, np.where(np.minimum(u / v, v / u)[:, 0] >= threshold, at, -np.inf)) >= fit.max(1) - slack


def sketches(docs: DataFrame, size: int, m: int) -> DataFrame:
    """doc_id, th, n (shingles), two sums that identify the set, registers."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("regs", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in T.blocks(np.arange(batch.num_rows), batch["text"], 1 << 20):
                cols: dict[str, list] = {c: [] for c in ("n", "s1", "s2", "regs")}
                for _, h in shingle_sets(rows, data, offsets, size):
                    cols["n"].append(len(h))
                    s1, s2 = T.mix(h).sum(dtype=T.U64), T.mix(h ^ T.U64(T.BASE_A)).sum(dtype=T.U64)
                    cols["s1"].append(int(s1.astype(np.int64)))
                    cols["s2"].append(int(s2.astype(np.int64)))
                    cols["regs"].append(registers(h, m).tobytes() if len(h) else b"")
                own = batch.slice(int(rows[0]), len(rows))
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["th"], *(pa.array(cols[c], schema.field(c).type) for c in cols)], schema=schema)

    return docs.mapInArrow(T.lean(task), "doc_id long, th long, n long, s1 long, s2 long, regs binary")


def shingle_arrays(docs: DataFrame, size: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in T.blocks(np.arange(batch.num_rows), batch["text"], 1 << 20):
                sets = [h for _, h in shingle_sets(rows, data, offsets, size)]
                cut = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
                values = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch["rep"].take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(cut), pa.array(values))], names=["id", "shingles"])

    return docs.mapInArrow(T.lean(task), "id long, shingles array<long>")


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that sizes and the joint likelihood of the registers don't rule out."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - F.lit(1e-6))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("ra", "rb"))
                keep = plausible(a, b, batch["na"].to_numpy(), batch["nb"].to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(T.lean(task), "a long, b long")


#: Documents of one block of the comparison across components, and of a bundle of small clusters.
BLOCK, BUNDLE = 512, 256
#: Clusters of more than one block up to this number are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def linked(x: list[np.ndarray], y: list[np.ndarray], xid: np.ndarray, yid: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix: the pairs of sets with 100 * intersection >= percent * union."""
    sets, (_, again) = [*x, *y], np.unique(np.concatenate([xid, yid]), return_index=True)
    size = np.array([len(s) for s in sets])
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    once = np.isin(row, again)  # a document on both sides counts once
    shared = np.flatnonzero(np.bincount(column[once], minlength=len(tokens)) > 1)
    place = np.full(len(tokens), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column, both = row[order], column[order], np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        both += m[: len(x)] @ m[len(x) :].T
    return 100 * both >= percent * (size[: len(x), None] + size[None, len(x) :] - both)


def across(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components so far.

    Buckets with the same largest component form a cluster. The members outside that component
    are compared with all members, exactly, in blocks of BLOCK documents: a block pair is a group of
    its own and returns one link for each two components it joins, never its pairs. Clusters of
    one block are bundled, about BUNDLE documents a group.
    """
    sizes = named.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("m.c").alias("main"))
    mixed = cut(named.join(main, "bucket").select("main", "rep", "c").distinct())
    count = mixed.groupBy("main").agg(F.ceil(F.sum(F.expr("int(c <> main)")) / BLOCK).cast("int").alias("nx"), F.ceil(F.count("*") / BLOCK).cast("int").alias("ny")).where("ny > 1")
    count, bundles = cut(count), max(1, mixed.count() // BUNDLE)
    full = mixed.join(F.broadcast(count) if count.count() <= BROADCAST_ROWS else count, "main", "left").join(sets.withColumnRenamed("id", "rep"), "rep")
    full = full.withColumn("small", F.col("nx").isNull()).withColumns({n: F.coalesce(n, F.lit(1)) for n in ("nx", "ny")})
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = full.where("c <> main").select("main", "small", own("nx").alias("bx"), every("ny").alias("by"), F.lit(0).alias("side"), "rep", "c", "shingles")
    y = full.select("main", "small", every("nx").alias("bx"), own("ny").alias("by"), F.lit(1).alias("side"), "rep", "c", "shingles")

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("main", "bx", "by", "side", "rep")]).combine_chunks()
        key = np.stack([table[c].to_numpy() for c in ("main", "bx", "by", "side")])
        rep, comp = table["rep"].to_numpy(), table["c"].to_numpy()
        lists = table["shingles"].chunk(0) if table.num_rows else None
        starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        ends = np.append(np.flatnonzero((key[:3, 1:] != key[:3, :-1]).any(0)) + 1, table.num_rows)
        out, at = [np.zeros((0, 2), np.int64)], 0
        for to in ends.tolist():
            mid = at + int(np.searchsorted(key[3, at:to], 1))
            if at < mid < to:
                s = [values[starts[i] : starts[i + 1]] for i in range(at, to)]
                i, j = np.nonzero(linked(s[: mid - at], s[mid - at :], rep[at:mid], rep[mid:to], percent) & (comp[at:mid, None] != comp[None, mid:to]))
                if len(i):
                    _, first = np.unique(np.stack([comp[at + i], comp[mid + j]], 1), axis=0, return_index=True)
                    out.append(np.stack([rep[at + i[first]], rep[mid + j[first]]], 1))
            at = to
        a, b = np.concatenate(out).T
        T.release()
        return pa.table({"a": a, "b": b})

    group = F.when(F.col("small"), F.pmod(F.xxhash64("main"), F.lit(bundles))).otherwise(F.xxhash64("main", "bx", "by"))
    return x.unionByName(y).withColumn("grp", group).drop("small").groupBy("grp").applyInArrow(task, "a long, b long")


def minhash_dedup(docs: DataFrame, threshold_percent: int = 75, shingle: int = SHINGLE, bands: int = 40, leaders: bool = False) -> DataFrame:
    """Components of documents linked by shingle-set similarity >= threshold.

    Text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; the set holds the distinct
    ``shingle``-word shingles, or the whole sequence of a shorter text. Null and empty texts have an
    empty set and link with nothing.

    Equal sets are one class, numbered in the order of the classes' least documents, so the least
    number of a component is the class of its least document. Each class sends its registers in
    ``bands`` bands of four; classes that share a band value are compared with the least class of
    that bucket, confirmed pairs are joined to components, and then members of one bucket that
    lie in different components are compared in blocks (``across``), so a large bucket of near
    copies costs a star, and no pairs are made of it.
    A pair at the threshold misses all bands with probability (1 - 0.75**4)**40 < 3e-7. Pairs
    go on unless the joint likelihood of both register vectors rules the threshold out by
    e**-14; links are confirmed on full sets.

    Returns doc_id, n_shingles, component_id, kept, one row per input row. Rows of one doc_id are
    linked each by its own text. Rows without a doc_id link like all others and come after them;
    a component of nothing else has a null component_id, and its rows count as kept. An empty
    table gives no rows; very long texts are read whole; other columns are ignored.

    ``leaders`` adds th (xxhash64 of the text) and leader: of each component exactly one text of one
    doc_id, and every text without words.
    """
    docs, threshold = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), threshold_percent / 100
    sketch = cut(sketches(docs, shingle, BAND * bands))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    classes = sketch.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(first).alias("first"), F.first("regs").alias("regs"))
    reps = cut(classes.orderBy("first").select(F.monotonically_increasing_id().alias("rep"), "n", "s1", "s2", F.col("first.doc_id").alias("doc"), F.col("first.th").alias("dth"), "regs"))
    member = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("j"), "regs").select(F.xxhash64("j", F.expr(f"substring(regs, {2 * BAND} * j + 1, {2 * BAND})")).alias("bucket"), "rep")
    shared = member.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("bucket", "least")
    member = cut(member.join(shared, "bucket"))
    star = member.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    active = member.select("rep").distinct().join(reps, "rep")
    # a null doc_id equals itself; rows of one doc_id and one text are one
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("d"), F.isnull(c).alias("none"))
    found = docs.select(*key("doc_id"), "th", "text").join(active.select("rep", *key("doc"), F.col("dth").alias("th")), ["d", "none", "th"]).dropDuplicates(["d", "none", "th"])
    sets = cut(shingle_arrays(found.select("rep", "text"), shingle))

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
        both = likely(pairs, reps, threshold).join(side("b"), "b").join(side("a"), "a")
        both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
        return both.where(100 * F.col("i") >= threshold_percent * (F.col("t") - F.col("i"))).select("a", "b")

    links = cut(confirmed(star))
    label = components(links)
    named = cut(member.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c")))
    links = links.unionByName(across(named, sets, threshold_percent))
    # the side of a component of very many classes is one that Spark splits
    label = components(links).join(reps.select(F.col("rep").alias("component"), F.col("doc").alias("root")), "component").withColumnRenamed("id", "rep")
    root = F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("root"))
    by_class = reps.join(label, "rep", "left").select("n", "s1", "s2", "doc", "dth", root.alias("root"), F.coalesce(F.col("component") == F.col("rep"), F.lit(True)).alias("top"))
    # a class of very many copies is joined to one row; Spark splits its side where it is large
    out = sketch.select("doc_id", "th", "n", "s1", "s2").join(by_class, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    leader = (F.col("n") == 0) | F.coalesce(F.col("top") & F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("dth")), F.lit(False))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th", leader.alias("leader"))
    return out if leaders else out.drop("th", "leader")
