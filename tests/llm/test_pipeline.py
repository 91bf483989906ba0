import re

import corpus_pipeline as cp
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_near

from skylattice.llm import queries
from skylattice.llm.lexical_packing import Encoder

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, odd):
    docs, seen = odd, []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).persist()
        seen.append({r[0] for r in docs.select("doc_id").distinct().collect()})
        if name != "lexical_packing":
            assert tuple(docs.columns) == cp.COLUMNS
    everything = set(range(18))
    assert seen[0] == everything - {3, 4, 5, 6}
    assert seen[1] == seen[0] - {1, 2, 8, 12, 17}
    assert 17 not in seen[2] and seen[3] <= seen[2] and seen[4] == seen[3]


def test_run_equals_brute_force(spark, text_of, odd_texts, tmp_path):
    """All stages but the choice of neighbours, on rows with odd texts, repeated and null ids."""
    item = text_of(31, 14)
    extra = [(20, f"{text_of(32, 20)} {item} {text_of(33, 9)}"), (None, text_of(34, 30)), (5, text_of(35, 40)), (21, text_of(35, 40).upper())]
    rows = [*odd_texts, *extra, odd_texts[9]]
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    last = 10**9
    left = sorted({(last if i is None else i, t) for i, t in rows if any(x.isalpha() for x in t or "")})
    number = {k: (i, t) for k, (i, t) in enumerate(left)}
    near = brute_near([(k, t) for k, (_, t) in number.items()])
    left = [number[k] for k, x in near.items() if x[2]]
    seen, out = {}, []
    for i, t in left:
        w = t.split()
        for s in range(len(w) - 12):
            seen.setdefault(tuple(w[s : s + 13]), i)
    for i, t in left:
        w = re.split(r"[ \t-\r]+", t.strip(" \t\n\v\f\r"))
        gone = {p for s in range(len(w) - 12) if seen[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        t = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
        words, want = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()), re.findall(r"[0-9a-z]+", item)
        hit = any(words[s : s + 10] == want[k : k + 10] for s in range(len(words) - 9) for k in range(len(want) - 9))
        if t and not hit:
            out.append((None if i == last else i, len(Encoder(public_tokenizers.path("byte_bpe_50k.json")).ids(t)) + 1))
    got = {(r["doc_id"], r["doc_tokens"]) for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == set(out) and (20, None) not in got and 20 not in {i for i, _ in got} and {5, 21} & {i for i, _ in got} == {5}


def test_changed_texts(spark, odd_texts):
    passage, other = odd_texts[17][1], odd_texts[0][1]
    df = spark.createDataFrame([(1, passage + "\n\nend", "en", "s", 0), (2, f"start  {passage} stop", None, "s", 0), (3, other, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.substring_stage(spark, df, SF).collect()}
    assert got == {1: (passage + "\n\nend", len(passage) + 5), 2: ("start stop", 10), 3: (other, len(other))}


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_tables(spark, no_docs):
    docs = no_docs
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op4_suffix_array_dedup"}))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect()))) == sorted(map(repr, want))


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
