"""Corpus pipeline: a chain of stages over documents, each by one operator of ``skylattice.llm``.

Every stage but the last takes and returns the columns of documents; each works on all rows its
predecessor kept. Rows are told apart by doc_id and text: rows of one doc_id with other texts are
documents of their own, and so are rows without a doc_id; equal rows are one from the second
stage on. Other columns are left out. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.llm.components import cut, discard
from skylattice.llm.decontamination import decontaminate
from skylattice.llm.language_id import language_id
from skylattice.llm.lexical_packing import lexical_packing
from skylattice.llm.minhash_dedup import minhash_dedup
from skylattice.llm.substring_dedup import substring_dedup
from skylattice.llm.words import text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = ["_none", "_doc", "_th"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, *text_key(th=F.xxhash64("text")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, empty, or without a letter. Fills in a missing lang.

    Where no row has a lang, nothing can be learned: texts with a letter stay and keep a null lang.
    Repeated rows and rows without a doc_id are judged like all others.
    """
    named = language_id(docs, keep=COLUMNS).where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))
    return named.select("doc_id", "text", F.coalesce("lang", F.nullif("lang_pred", F.lit("und"))).alias("lang"), "source", "n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id, any with
    one before those without; of rows with the same doc_id one text, and of equal rows one.
    Null and empty texts are near nothing and stay."""
    kept = minhash_dedup(docs, leaders=True).where("leader").select(*text_key())
    return keyed(docs).join(kept, KEY, "left_semi").dropDuplicates(KEY).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand in an earlier document.

    The words left of a changed text are joined by one space; unchanged texts stay as they are,
    and n_chars is counted anew. Documents without a word left, or with none, go.
    """
    kept = substring_dedup(docs, keep_text=True).where("n_removed > 0").select(*text_key(), "kept_text").dropDuplicates(KEY)
    text = F.coalesce("kept_text", "text")
    out = keyed(docs).join(kept, KEY, "left").where(text.rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    bad = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_hash=True).where("contaminated").select(*text_key())
    return keyed(docs).join(bad, KEY, "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids, one row per piece of a document; all rows are packed, null and
    empty texts as one id, repeated rows as documents of their own."""
    return lexical_packing(docs)


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("lexical_packing", packing_stage),
]

#: Language ID, registers and packing have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder before the next and removed after it."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            if held is not None:
                discard(held)
            held = docs
    return docs
