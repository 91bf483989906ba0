"""Connected components by alternating large-star and small-star steps, all in joins, and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


#: The temporary folder of each local application.
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, in
    which all threads share a disk, and else one in the warehouse, which all executors reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        local, app = spark.sparkContext.master.split("[")[0] == "local", spark.sparkContext.applicationId
        if local and app not in _folders:
            _folders[app] = tempfile.mkdtemp(prefix="checkpoints-")
        folder = _folders[app] if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` returned and nothing reads any more."""
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if found.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the least id reachable.

    Each step groups with partial aggregation and joins back; the side of a vertex with very many
    neighbours is one that adaptive execution can split, as nothing but a shuffle follows the
    join. Goes on until a round changes nothing. Edges with a null end are ignored.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, changed = None, True
    while changed:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, e = e, cut(small.where("u <> v").distinct())
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        changed, state = now != state, now
    own = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own).groupBy("id").agg(F.min("component").alias("component"))
