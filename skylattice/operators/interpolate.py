"""Linear interpolation of log columns at the times of other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a time bucket, on average.
PER_BUCKET = 50_000


def clock_micros(t: Column) -> Column:
    """Microseconds from 1970 of a time without a zone, as its clock says: the session's zone and its
    changes of the hour play no part."""
    return F.unix_date(t.cast("date")) * F.lit(86_400_000_000) + (F.hour(t) * 3600 + F.minute(t) * 60) * F.lit(1_000_000).cast("long") + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def interpolate_at(rows: DataFrame, log: DataFrame, time: str, values: list[str], by: list[str] | None = None, bucket_us: int | None = None) -> DataFrame:
    """``interpolate_logs`` of a single log."""
    return interpolate_logs(rows, [(log, values)], time, by, bucket_us)


def interpolate_logs(rows: DataFrame, logs: list[tuple[DataFrame, list[str]]], time: str, by: list[str] | None = None, bucket_us: int | None = None) -> DataFrame:
    """``rows`` with the values of each log taken at ``time``, linearly between that log's nearest rows
    before (t_lo < t) and after (t_hi >= t). A null on either side, or no row on one side, gives null;
    the very first log time gives its own value. Of rows of one log at one time the least counts.

    Rows and logs are united once and dealt by ``by`` and time bucket. There a running last value
    goes forward and another one backward in time, each with a frame that ends at its row, so a
    bucket costs two sorts and two passes whatever it holds. The first and last log rows of each
    bucket are carried across buckets over one row a bucket. Without ``bucket_us`` buckets are so
    wide that they hold PER_BUCKET rows of all tables on average. Times without a zone are taken
    as they stand; only where some have one are the others read in the session's zone.
    """
    by = by or []
    plain = all(dict(df.dtypes)[time] == "timestamp_ntz" for df in (rows, *(log for log, _ in logs)))
    micros = lambda c: clock_micros(F.col(c)) if plain else F.unix_micros(F.col(c).cast("timestamp"))
    both = rows.withColumns({"_t": micros(time), "_row": F.lit(True)})
    marks = [f"_k{j}" for j in range(len(logs))]
    for mark, (log, values) in zip(marks, logs, strict=True):
        entry = log.where(F.col(time).isNotNull()).withColumn("_t", micros(time)).select(*by, "_t", F.struct("_t", *values).alias(mark))
        both = both.unionByName(entry, allowMissingColumns=True)
    if bucket_us is None:
        least, most, n = both.agg(F.min("_t"), F.max("_t"), F.count("_t")).first()
        bucket_us = max(1, -(-((most or 0) - (least or 0) + 1) // -(-max(n, 1) // PER_BUCKET)))
    # rows without a time meet no log: they stay spread as they are read
    both = both.withColumn("_b", F.coalesce(F.floor(F.col("_t") / bucket_us), F.spark_partition_id() - F.lit(1 << 62)))

    late = lambda mark, values: F.min(F.when(F.col(mark).isNotNull(), F.struct((-F.col("_t")).alias("_t"), *(F.col(f"{mark}.{v}").alias(v) for v in values))))
    ends = both.where("_t is not null").groupBy(*by, "_b").agg(*(x for mark, (_, values) in zip(marks, logs, strict=True) for x in (F.min(mark).alias(f"{mark}f"), late(mark, values).alias(f"{mark}l"))))
    ends = ends.withColumns({f"{m}l": F.when(F.col(f"{m}l").isNotNull(), F.col(f"{m}l").withField("_t", -F.col(f"{m}l._t"))) for m in marks})

    def carried(name: str, order: list[Column], part: list[str], end: int) -> Column:
        return F.last(name, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end))

    ends = ends.select(*by, "_b", *(carried(f"{m}l", [F.asc("_b")], by, -1).alias(f"{m}before") for m in marks), *(carried(f"{m}f", [F.desc("_b")], by, -1).alias(f"{m}after") for m in marks))
    # at one time rows come before logs, and backward in time behind them, so t_lo < t <= t_hi
    log_row = F.col("_row").isNull()
    lo = {f"{m}lo": carried(m, [F.asc("_t"), log_row.asc(), *(F.desc(x) for x in marks)], [*by, "_b"], 0) for m in marks}
    hi = {f"{m}hi": carried(m, [F.desc("_t"), log_row.desc(), *(F.desc(x) for x in marks)], [*by, "_b"], 0) for m in marks}
    both = both.withColumns(lo).withColumns(hi).where("_row").join(ends, [*by, "_b"], "left")
    both = both.withColumns({f"{m}{side}": F.coalesce(f"{m}{side}", f"{m}{other}") for m in marks for side, other in (("lo", "before"), ("hi", "after"))})
    out = []
    for m, (_, values) in zip(marks, logs, strict=True):
        for v in values:
            lo, hi = F.col(f"{m}lo.{v}"), F.col(f"{m}hi.{v}")
            between = lo + (hi - lo) / (F.col(f"{m}hi._t") - F.col(f"{m}lo._t")) * (F.col("_t") - F.col(f"{m}lo._t"))
            out.append(F.when(F.col(f"{m}lo").isNull() & (F.col(f"{m}hi._t") == F.col("_t")), hi).otherwise(between).alias(v))
    return both.select(*rows.columns, *out)
