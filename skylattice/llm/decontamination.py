"""Benchmark decontamination by winnowed fingerprints, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .words import by_text, every_run, words

#: Fingerprints, and runs, of a benchmark up to this number are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def fingerprints(df: DataFrame, span: int, k: int) -> DataFrame:
    """Column ``fp``: for each run of ``span`` words the least hash of its k-grams.

    Every run has a fingerprint and equal runs have equal ones, so a shared run of ``span``
    words is always found; most neighbouring runs share theirs, so few are distinct.
    """
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    df = every_run(df, "_h", k, lambda a, b: F.xxhash64(a, b), "grams").drop("_h")
    return every_run(df, "grams", span - k + 1, lambda a, b: F.least(a, b), "fp").drop("grams")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, text_hash: bool = False) -> DataFrame:
    """Words of documents inside any occurrence of ``window`` consecutive words of an item.

    An item of fewer words, but not none, is one window of its own length. Documents and items
    are cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Winnowed
    fingerprints of both sides are joined, those of all window lengths in one scan; where they
    meet, the run is compared word by word and extended to all its places, so no hash decides
    a hit. The join spreads by fingerprint and splits where one is very common.

    Null text has no words and no item; very long texts are read whole. Rows of the same or no
    doc_id are judged each by its text; repeated items count once by item_id, items without one
    are no items. An empty benchmark leaves everything clean, an empty table gives no rows.
    Other columns are ignored.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with ``text_hash`` th
    (xxhash64 of the text), which with doc_id tells rows apart.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0 and item_id is not null")
    spans = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())  # ``window`` lengths at most

    def tagged(df: DataFrame, span: int, shape: Callable[[int], Column]) -> DataFrame:
        """Column fp<span>: what ``shape`` makes of the fingerprints of runs of ``span`` words."""
        return fingerprints(df, span, min(gram, span)).withColumn(f"fp{span}", shape(span)).drop("fp")

    def mark(span: int, fp: Column) -> Column:
        return F.struct(F.lit(span).alias("span"), fp.alias("fp"))

    def marks(span: int) -> Column:
        return F.transform(F.array_distinct("fp"), lambda x: mark(span, x))

    def met_places(span: int) -> Column:
        place = F.transform("fp", lambda x, i: F.when(F.array_contains("met", mark(span, x)), F.struct(F.lit(span).alias("span"), i.alias("i"))))
        return F.filter(place, lambda x: x.isNotNull())

    base = docs.select("doc_id", "th", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if not spans:
        found = base.select("doc_id", "th", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items")).limit(0)
    else:
        known = runs = None
        for span in spans:
            own = items.where(F.size("words") >= window if span == window else F.size("words") == span)
            # outer generators: the filter Spark infers for inner ones would be pushed through, and
            # so repeat, every step of the fingerprint expressions
            own = fingerprints(own, span, min(gram, span)).select("item_id", F.posexplode_outer("fp").alias("i", "fp"), "words")
            own = own.select("item_id", mark(span, F.col("fp")).alias("fp"), F.slice("words", F.col("i") + 1, span).alias("run"))
            known, runs = (x if y is None else y.unionByName(x) for x, y in ((own.select("fp").distinct(), known), (own.select("item_id", "run").distinct(), runs)))
        known, runs = (F.broadcast(x) if x.count() <= BROADCAST_ROWS else x for x in (known, runs))
        split = docs.select("doc_id", "th", words(F.col("text")).alias("words"))
        for span in spans:
            split = tagged(split, span, marks)
        every = F.concat(*(f"fp{span}" for span in spans))
        marked = split.select("doc_id", "th", F.explode_outer(every).alias("fp")).join(known, "fp")
        marked = marked.groupBy("doc_id", "th").agg(F.collect_set("fp").alias("met"))
        near = by_text(docs, marked, "inner").select("doc_id", "th", words(F.col("text")).alias("words"), "met")
        for span in spans:
            near = tagged(near, span, met_places)
        near = near.select("doc_id", "th", "words", F.explode_outer(every).alias("at")).select("doc_id", "th", "at.i", "at.span", F.slice("words", F.col("at.i") + 1, F.col("at.span")).alias("run"))
        hits = near.where("i is not null").join(runs, "run")
        places = hits.select("doc_id", "th", F.explode(F.sequence("i", F.expr("i + span - 1"))).alias("p"), "item_id")
        found = places.groupBy("doc_id", "th").agg(F.size(F.collect_set("p")).cast("long").alias("n_hit"), F.collect_set("item_id").alias("items"))
    none = F.array().cast("array<string>")
    return by_text(base, found, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.coalesce("items", none)), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *(["th"] if text_hash else []),
    )
