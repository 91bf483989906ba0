"""Fixity audit of replicated WARC archives by Merkle trees over offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import cut

#: Bytes of an offset range (a leaf of the tree), children of a node, levels above the leaves.
RANGE, FAN, LEVELS = 1 << 18, 16, 4


def warc_records(pages: DataFrame, per_file: int = 512) -> DataFrame:
    """Pages as WARC/1.1 response records: page_id, warc (file), record (text of the whole record).

    A file holds the pages of ``per_file`` consecutive page_ids, so it is bounded. Null url or html
    are empty, very long ones whole; pages without an id are dealt by content to 2**24 files.
    Other columns are ignored.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    name = F.coalesce(F.format_string("part-%08d.warc", F.floor(F.col("page_id") / per_file)), F.concat(F.lit("none-"), F.substring(F.md5(record.cast("binary")), 1, 6), F.lit(".warc")))
    return pages.select("page_id", name.alias("warc"), record.alias("record"))


def measured(record: Column) -> Column:
    """Length and SHA-256 digest of a record's bytes; null for none."""
    return F.when(record.isNotNull(), F.struct(F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest")))


def damaged(records: DataFrame) -> DataFrame:
    """``copy``: the bytes of a replica with known damage, as the tables hold one copy; ``stray``: a
    record that only the replica has, one byte further on. Where the first two hex digits of the
    record's digest are below '02' a byte has changed, below '04' the record is cut short, below '06'
    it is lost, and below '08' there is a stray one besides."""
    mark = F.substring(F.sha2(F.col("record").cast("binary"), 256), 1, 2)
    copy = F.when(mark < "02", F.concat(F.lit("WARC/1.0"), F.expr("substring(record, 9)"))).when(mark < "04", F.substring("record", 1, 8)).when(mark >= "06", F.col("record"))
    return records.withColumns({"copy": copy, "stray": F.when((mark >= "06") & (mark < "08"), F.lit("stray"))})


def catalogue(records: DataFrame) -> DataFrame:
    """Both copies as one table: side ('p' or 'r'), warc, offset, length, digest. Every record of both
    is hashed. Offsets are sums over the primary's lengths in its file, where rows of one page_id
    follow each other by their digests; a damaged record keeps its place."""
    rows = records.select("page_id", "warc", measured(F.col("record")).alias("p"), measured(F.col("copy")).alias("r"), measured(F.col("stray")).alias("s"))
    before = F.expr("sum(p.length) OVER (PARTITION BY warc ORDER BY page_id NULLS LAST, p.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    at = F.coalesce(before, F.lit(0)).cast("long")
    entry = lambda side, what, shift=0: F.struct(F.lit(side).alias("side"), (F.col("at") + shift).alias("offset"), F.col(f"{what}.length").alias("length"), F.col(f"{what}.digest").alias("digest"))
    found = rows.withColumn("at", at).select("warc", F.explode(F.array(entry("p", "p"), entry("r", "r"), entry("r", "s", 1))).alias("e"))
    return found.select("e.side", "warc", "e.offset", "e.length", "e.digest").where("digest is not null")


def joined(level: DataFrame, parent: Column) -> DataFrame:
    """Nodes one level up: the hash of their children's hashes in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return level.groupBy("side", "warc", parent.alias("node")).agg(F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), "\n").cast("binary"), 256).alias("hash"))


def merkle_levels(records: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots, each (side, warc, node, hash), and each kept, as the
    descent reads it again.

    A leaf is one range of RANGE bytes of a file and hashes the records that begin there, in
    order of offset with their lengths; a node has FAN children at most, so no group grows with
    the file. The root joins what the top level has, one node per RANGE * FAN**LEVELS bytes.
    """
    entry = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))
    text = F.array_join(F.transform(entry, lambda e: F.concat_ws(":", e["offset"].cast("string"), e["length"].cast("string"), e["digest"])), "\n")
    levels = [cut(records.groupBy("side", "warc", F.expr(f"offset div {RANGE}").alias("node")).agg(F.sha2(text.cast("binary"), 256).alias("hash")))]
    for _ in range(LEVELS):
        levels.append(cut(joined(levels[-1], F.expr(f"node div {FAN}"))))
    return [*levels, cut(joined(levels[-1], F.lit(0).cast("long")))]


def audit(records: DataFrame) -> DataFrame:
    """Where the two copies of an archive (``catalogue``) differ.

    Roots are compared first; a level below is compared only under the nodes that differ, and
    records only in leaf ranges that differ. An unharmed file therefore costs its root. Files or
    records that one side lacks are found too; several records at one offset are told apart by
    their digests, and exact repeats by their number.

    Returns warc, offset, length, status (corrupt, missing, extra), primary_digest,
    replica_digest, primary_root, replica_root. An empty table gives no rows, one empty side what
    the other holds. Other columns are ignored.
    """
    records = cut(records.select("side", "warc", "offset", "length", "digest"))
    levels = merkle_levels(records)
    own = lambda side, what: F.max(F.when(F.col("side") == side, F.col(what)))
    apart = ~F.col("p").eqNullSafe(F.col("r"))
    under = lambda df, parent, bad: df.withColumn("up", parent).join(bad.select("warc", F.col("node").alias("up")), ["warc", "up"], "left_semi")

    bad = roots = cut(levels[-1].groupBy("warc", "node").agg(own("p", "hash").alias("p"), own("r", "hash").alias("r")).where(apart))
    for i in range(len(levels) - 2, -1, -1):
        parent = F.lit(0).cast("long") if i == len(levels) - 2 else F.expr(f"node div {FAN}")
        bad = cut(under(levels[i], parent, bad).groupBy("warc", "node").agg(own("p", "hash").alias("p"), own("r", "hash").alias("r")).where(apart).select("warc", "node"))
    held = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("digest", "length"))))
    both = under(records, F.expr(f"offset div {RANGE}"), bad).groupBy("warc", "offset").agg(held("p").alias("p"), held("r").alias("r")).where(apart)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(f"{c}.digest"), ","))
    status = F.when(F.size("r") == 0, "missing").when(F.size("p") == 0, "extra").otherwise("corrupt")
    named = roots.select("warc", F.col("p").alias("primary_root"), F.col("r").alias("replica_root"))
    length = F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("r"))[0]["length"]
    out = both.select("warc", "offset", length.alias("length"), status.alias("status"), text("p").alias("primary_digest"), text("r").alias("replica_digest"))
    return out.join(named, "warc").select("warc", "offset", "length", "status", "primary_digest", "replica_digest", "primary_root", "replica_root")
