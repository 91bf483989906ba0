"""Prefix trie of conversations: built one depth at a time, rolled up one depth at a time from below."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textops as T
from .components import cut, discard, shared_folder

#: Ids of a family of conversations, and one more than the most turns they take from its first one.
FAMILY, SHARED = 100, 6
#: Places of a conversation in one group of a window, so that none holds a whole conversation.
BLOCK = 1024
#: Depths after which the turns that are still needed are written anew.
BAND = 8
#: Conversation ids in one piece of a list that is hashed.
PIECE = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def before(rows: DataFrame, by: str, block: Column, order: list[Column], value: Column, out: str, last_first: bool = False) -> DataFrame:
    """Adds the sum of ``value`` over a group's rows up to and with each one, in ``order`` within blocks,
    whose numbers follow the same order: sums of blocks first, then of the rows of each block."""
    rows = rows.withColumn("_b", block)
    sort = F.desc("_b") if last_first else F.asc("_b")
    earlier = Window.partitionBy(by).orderBy(sort).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "_b").agg(F.sum(value).alias("_s")).select(by, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_e"))
    own = Window.partitionBy(by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(value).over(own)).join(sums, [by, "_b"]).withColumn(out, F.col(out) + F.col("_e")).drop("_b", "_e")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, key, length): place from 1, digest of role and text, and code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("length"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))
    return before(turns, "conv_id", block, [F.asc_nulls_first("turn"), F.asc("key")], F.lit(1), "i").drop("turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, length) after each conversation took its family's first turns."""
    base, taken = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("taken")
    first = turns.where((F.col("i") < SHARED) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("i", "key", "length"))).alias("first"))  # SHARED - 1 turns at most
    ids = turns.select("conv_id").distinct().select("conv_id", base, taken)
    head = ids.join(first, "base").select("conv_id", F.explode(F.slice("first", 1, F.col("taken").cast("int"))).alias("t")).select("conv_id", F.col("t.i").alias("depth"), "t.key", "t.length")
    own = turns.select("conv_id", "i", "key", "length", base, taken).where("i > taken").join(first.select("base", F.size("first").alias("held")), "base", "left")
    depth = F.col("i") - F.col("taken") + F.least("taken", F.coalesce(F.col("held").cast("long"), F.lit(0)))
    return head.unionByName(own.select("conv_id", depth.alias("depth"), "key", "length"))


def list_hashes(members: DataFrame) -> DataFrame:
    """(rep, sha): lowercase SHA-256 of each group's conv_ids, ascending, comma-joined.

    Ids are joined in pieces of a bounded range of ids; a task then feeds the sorted pieces of a
    group into one running hash, so that it holds one piece, however long the list is.
    """
    piece = F.floor(F.col("conv_id") / PIECE).alias("piece")
    pieces = members.groupBy("rep", piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            reps, shas = [], []
            for rep, ids in zip(batch["rep"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if running is not None and rep == at:
                    running.update(b"," + ids.encode())
                    continue
                if running is not None:
                    reps.append(at)
                    shas.append(running.hexdigest())
                at, running = rep, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], names=["rep", "sha"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([running.hexdigest()])], names=["rep", "sha"])

    return pieces.repartition("rep").sortWithinPartitions("rep", "piece").select("rep", "ids").mapInArrow(T.lean(task), "rep long, sha string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the prefix trie of all conversations, with what its subtree would save.

    A conversation's turns are ordered by turn, null first, those of one turn by a digest of role and
    text; a null role or text is empty. It then takes the first crc32(conv_id) % 6 turns of
    conversation conv_id - conv_id % 100 in place of as many of its own. A node is a distinct
    sequence of first turns; its conv_id is the least among the conversations that start with it.

    Conversations with the same turns throughout are one class, of which the least conv_id stands
    for all. At each depth the classes that still share a node are grouped by (parent, next
    turn), and each group is a node; a class that shares no more has a path of its own, whose
    nodes are written at once. Leaves and savings are then summed from the deepest shared depth
    upwards, a join a depth. No group of a window or of a Python task holds a conversation, or
    the members of a node, as a whole.

    Rows without conv_id belong to no conversation; repeated rows are turns of their own, very long
    texts are read whole and only their digests are sent; other columns are ignored. A conversation
    that keeps no turn is a member of the root alone; an empty table gives no rows.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = conversations.sparkSession
    numbers = cut(numbered(conversations))
    turns = cut(rebuilt(numbers))
    sign = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("depth", "key")).alias("s1"), F.bit_xor(F.xxhash64("key", "depth")).alias("s2"))
    sign = cut(numbers.select("conv_id").distinct().join(sign, "conv_id", "left").na.fill(0, ["n", "s1", "s2"]))
    discard(numbers)
    root, members = sign.agg(F.min("conv_id"), F.count("*")).first()
    if root is None:
        return spark.createDataFrame([], NODE)
    classes = cut(sign.groupBy("n", "s1", "s2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")))
    every = cut(turns.join(classes.select(F.col("rep").alias("conv_id"), "n", "copies"), "conv_id").withColumnRenamed("conv_id", "rep"))
    discard(turns)

    shared, alone, ending = [], [], []  # by depth: nodes of several classes; classes that go on alone; classes that end
    live, source, depth = classes.where("n > 0").select("rep", F.lit(root).alias("node")), every, 0
    while not live.isEmpty():
        depth += 1
        if depth % BAND == 0:
            old, source = source, cut(source.where(F.col("depth") >= depth).join(live.select("rep"), "rep", "left_semi"))
            if old is not every:
                discard(old)
        step = live.join(source.where(F.col("depth") == depth).drop("depth"), "rep")
        made = step.groupBy("node", "key").agg(F.min("rep").alias("child"), F.sum("copies").alias("n_convs"), F.count("*").alias("classes"))
        level = cut(step.join(made, ["node", "key"]).drop("key"))
        shared.append(level.where("classes > 1").groupBy("node", "child").agg(F.first("n_convs").alias("n_convs"), F.first("length").alias("length")))
        alone.append(level.where("classes = 1").select("rep", "node", F.lit(depth).cast("long").alias("since")))
        ending.append(level.where(F.col("n") == depth).select("rep", F.col("n").alias("depth"), F.col("child").alias("conv_id")))
        if depth % BAND == 0:
            alone, ending = ([stored(union(x))] for x in (alone, ending))
        live = level.where(F.col("classes") > 1).where(F.col("n") > depth).select("rep", F.col("child").alias("node"))

    ends = [classes.where("n = 0").select("rep", F.col("n").alias("depth"), F.lit(root).alias("conv_id")), *ending]
    zero = F.lit(0).cast("long")
    paths = None
    if alone:
        path = every.join(union(alone), "rep").where("depth >= since").withColumn("saves", (F.col("copies") - 1) * F.col("length"))
        many = before(path.where("copies > 1"), "rep", F.floor(F.col("depth") / BLOCK), [F.desc("depth")], F.col("saves"), "saved_tokens", last_first=True)
        path = path.where("copies = 1").withColumn("saved_tokens", zero).unionByName(many)
        paths = stored(path.select(F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("since"), F.col("node")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("copies").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", "since"))
        ends.append(union(alone).join(classes, "rep").where("n > since").select("rep", F.col("n").alias("depth"), F.col("rep").alias("conv_id")))

    out, below = [], None
    one = spark.createDataFrame([(None, root, members, 0)], "node long, child long, n_convs long, length long")
    for d in range(len(shared), -1, -1):
        tops = paths.where((F.col("since") == d + 1) & (F.col("depth") == d + 1)) if paths is not None else None
        children = [x.select("parent_conv_id", "n_leaves", "saved_tokens") for x in (below, tops) if x is not None]
        nodes = (shared[d - 1] if d else one).select(F.col("child").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("length")).alias("saves"))
        if children:
            up = union(children).groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
            nodes = nodes.join(up, "conv_id", "left")
        else:
            nodes = nodes.withColumns({"n_children": zero, "n_leaves": F.lit(1).cast("long"), "below": zero})
        below = cut(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("saves") + F.coalesce("below", zero)).alias("saved_tokens")))
        out.append(below)
        if len(out) % BAND == 0:
            out = [stored(union(out))]

    hashed = classes.where("copies = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("sha"))
    copies = sign.join(classes.where("copies > 1").drop("copies"), ["n", "s1", "s2"]).select("rep", "conv_id")
    hashed = union(ends).join(hashed.unionByName(list_hashes(copies)), "rep").drop("rep")
    nodes = union([*out, *([paths.drop("since")] if paths is not None else [])])
    nodes = nodes.join(hashed, ["depth", "conv_id"], "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder. What a checkpoint of a union remembers of its columns
    can name some of another table, at which a union with it then fails."""
    folder = f"{shared_folder(df.sparkSession)}/trie-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def union(tables: list[DataFrame]) -> DataFrame:
    first, *rest = tables
    for x in rest:
        first = first.unionByName(x)
    return first
