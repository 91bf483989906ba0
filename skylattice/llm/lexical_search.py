"""Ranked lexical search: postings in a table laid out by term, joined with the terms of the items."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textops as T
from .components import shared_folder

#: Each byte of a text as the byte of a term, or as a space between terms; A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text whose terms are cut at once.
AT_ONCE = 1 << 20
#: Rows of a batch of postings.
BATCH_ROWS = 1 << 17
#: Parts over which the postings of one term spread, as a term may stand in most documents.
SALTS = 16
#: Terms of all items up to this number are broadcast; beyond it their joins shuffle.
BROADCAST_ROWS = 500_000


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term stands in a text, which is cut at spaces so that few words are held at once."""
    text, counts, at = text.translate(TERM_BYTES), Counter(), 0
    while at < len(text):
        to = text.find(b" ", at + AT_ONCE)
        to = len(text) if to < 0 else to
        counts.update(text[at:to].split())
        at = to
    return counts


def postings(texts: DataFrame, key: str) -> DataFrame:
    """(uid, key, n, term, tf) for each distinct term of each text, and one with the term '' for each text
    that has any; n is its number of terms with repeats. ``uid`` tells repeated rows apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows, counts = batch["text"].cast(pa.large_binary()), [], []

            def made(batch=batch, rows=rows, counts=counts) -> pa.RecordBatch:
                each = np.repeat(rows, [len(c) for c in counts]).astype(np.int64)
                n = np.repeat([c[b""] for c in counts], [len(c) for c in counts]).astype(np.int64)
                tf = np.fromiter((x for c in counts for x in c.values()), np.int64, len(each))
                term = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
                return pa.RecordBatch.from_arrays([batch["uid"].take(each), batch[key].take(each), pa.array(n), term, pa.array(tf)], names=["uid", key, "n", "term", "tf"])

            held = 0
            for i in range(batch.num_rows):
                c = term_counts(column[i].as_py() or b"")
                if c:
                    c[b""] = c.total()
                    rows.append(i)
                    counts.append(c)
                    held += len(c)
                if held >= BATCH_ROWS:
                    yield made()
                    rows.clear()
                    counts.clear()
                    held = 0
            if rows:
                yield made()

    kind = dict(texts.dtypes)[key]
    return texts.select(F.monotonically_increasing_id().alias("uid"), key, "text").mapInArrow(T.lean(task), f"uid long, `{key}` {kind}, n long, term string, tf long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents for each item, by integer BM25 scores.

    Terms are maximal runs of letters, digits and bytes from 0x80, A-Z lower-cased. Every document
    is counted, and the postings of all terms that stand in an item are written to a table laid out
    by term, where a common term takes up to SALTS parts. Document frequencies and bounds come from
    that table. For scoring it is dealt once by document, so that joining the items' terms and
    summing a document's matches send nothing more, and only the best ``k`` of each item in
    each task are ranked together. Equal scores go by ascending doc_id, null last.

    A null text has no terms and is no document, nor is an item without terms or without item_id
    ever listed; rows of one item_id are one item. Repeated documents, with or without a doc_id,
    are ranked each by its row; very long texts are read whole. Other columns are ignored; an empty
    table on either side gives no rows.

    Returns item_id, rank, doc_id, score.
    """
    spark = docs.sparkSession
    wanted = postings(items.where("item_id is not null"), "item_id").where("term <> ''").select("item_id", "term").distinct().cache()
    few = wanted.count() <= BROADCAST_ROWS
    near = F.broadcast if few else lambda df: df
    terms = wanted.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
    found = postings(docs, "doc_id").join(near(terms), "term", "left_semi").withColumn("part", F.col("uid") % SALTS)
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    found.repartition("term", "part").sortWithinPartitions("term", "uid").drop("part").write.parquet(folder)
    index = spark.read.schema(found.drop("part").schema).parquet(folder)

    n_docs, n_terms = index.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    known = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w"))
    asked = wanted.join(near(known), "term")
    length = F.expr(f"50L + (50L * n * {n_docs}L) div {n_terms}L")
    dealt = index.where("term <> ''").select("uid", "doc_id", "term", "tf", length.alias("m")).selectExpr("uid", "doc_id", "term", "(1000000000L * tf) div (1000L * tf + 20L * m) AS share").repartition("uid")
    score = dealt.join(near(asked), "term").groupBy("item_id", "uid", "doc_id").agg(F.sum(F.col("w") * F.col("share")).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
