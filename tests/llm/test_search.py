"""Personal data, lexical search and conversation tries against plain versions of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from skylattice.llm import conversation_trie as ct, lexical_search as ls, personal_data as pd_
from skylattice.llm.conversation_trie import conversation_trie
from skylattice.llm.lexical_search import lexical_search
from skylattice.llm.personal_data import personal_data
from skylattice.llm.queries import OP11_SQL, OP12_SQL, OP13_SQL

TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect())))


def duck_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().convert_dtypes())
    rel = con.sql(sql)
    return sorted(map(repr, con.sql("SELECT " + ", ".join(f'"{c}"' for c in sorted(rel.columns)) + f" FROM ({sql})").fetchall()))


# personal data


def plain_base(text):
    """Spans of the four base kinds, straight from their patterns."""

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def digits(m):
        return re.sub(r"[^0-9]", "", m)

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, pattern, ok in rules for m in re.finditer(pattern, text) if ok(m[0])]


PARTS = ["a", "b.c", "@", "@x.y", ".", "1", "12", "255", "256", "300", "0001", "+1", "+", "(", ")", " ", "-", "4465758382889437", "4111 1111 1111 1111", "1.2.3.4", "é", "日", "Account ", "acct no: ", "IBAN ", "DE89 3704 0044 0532 0130 00", "AT611904300234573201", "at61 1904 3002 3457 3201 with", "http://", "u:p@host.com", "sftp://", "_", "\n", "+49 (30) 123-4567"]


def test_base_spans_equal_the_patterns(monkeypatch):
    monkeypatch.setattr(pd_, "AT_ONCE", 7)  # many borders between the parts that the automaton reads
    found, r = pd_.automaton(), random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(14)))
        raw = text.encode()
        rows = [(pd_.KINDS[k], a, b) for k, a, b in pd_.places(raw, pd_.spans(raw, found))]
        assert [x for x in rows if x[0] in pd_.KINDS[: pd_.BASE]] == plain_base(text), text
        for kind, a, b in rows:
            assert text[a:b].strip() == text[a:b] and b > a, kind


def test_added_kinds():
    found = pd_.automaton()

    def of(text):
        raw = text.encode()
        return [(pd_.KINDS[k], text[a:b]) for k, a, b in pd_.places(raw, pd_.spans(raw, found)) if k >= pd_.BASE]

    assert of("é see HTTPS://joe:pw@host.example:80/x") == [("address", "HTTPS://joe:pw@host.example")]
    assert of("http://host.example/@") == []
    assert of("my Account Number: 12 345-678, subaccount 123456") == [("account", "12 345-678")]
    assert of("acct 12345; account of 123456") == []
    assert of("iban AT61 1904 3002 3457 3201 with") == [("iban", "AT61 1904 3002 3457 3201")]
    assert of("IBAN:GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert of("iban AT61 1904 3002 3457 3202") == []


def test_personal_data_of_odd_tables(spark, odd, odd_texts, no_docs):
    tail = ["x@y.zz " * 3 + "é " * 700000 + "1.2.3.4", "+1 (555) 555-0000", "+1 (555) 555-0000", None]
    more = spark.createDataFrame([(None if i < 2 else 50, t, "", "", 0, 1, "", 2) for i, t in enumerate(tail)], odd.schema)
    both = odd.unionByName(more)
    got = {(r["doc_id"], r["spans"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in personal_data(both).collect()}
    want = set()
    for i, t in [*odd_texts, *((None if i < 2 else 50, t) for i, t in enumerate(tail))]:
        rows = plain_base(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in rows)
        n = Counter(k for k, _, _ in rows)
        want.add((i, text, hashlib.sha256(text.encode()).hexdigest(), n["email"], n["ip"], n["card"], n["phone"]))
    assert got == want and personal_data(both).count() == both.count()
    assert rows_of(personal_data(both)) == duck_rows(OP11_SQL, documents=both.select("doc_id", "text"))
    assert personal_data(no_docs).count() == 0


# lexical search


def plain_search(docs, items, k=50):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))

    docs = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df, wanted, out = Counter(t for _, c, _ in docs for t in c), {}, []
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    for item, ts in wanted.items():
        scores = []
        for i, c, n in docs:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out.append((item, rank + 1, i, -s))
    return sorted(map(repr, out))


def test_term_counts_of_a_cut_text(monkeypatch):
    text = "Ab-ab, é9É ab\tZ日z " * 50
    want = Counter({b"ab": 150, "é9É".encode(): 50, "z日z".encode(): 50})
    assert ls.term_counts(text.encode()) == want
    monkeypatch.setattr(ls, "AT_ONCE", 5)
    assert ls.term_counts(text.encode()) == want


def test_search_equals_a_plain_one(spark, odd, odd_texts, no_docs, text_of):
    docs = [*odd_texts, (None, "one two three"), (3, "one two"), (3, "one two"), *((100 + i, text_of(i, 30, 60)) for i in range(120))]
    items = [(1, text_of(7, 20, 60)), (2, None), (3, "..."), (None, "one"), (4, "one"), (4, "TWO, one"), (5, "nowhere"), (6, "a ab x" + "x" * 4999), (7, text_of(3, 8, 60) + " " + odd_texts[0][1])]
    bench = spark.createDataFrame([(*x, 1, "t") for x in items], "item_id long, text string, doc_id int, term string")
    table = spark.createDataFrame([(i, t, 1, "t", 2) for i, t in docs], "doc_id long, text string, uid int, term string, tf int").repartition(5)
    for k in (50, 3):
        got = sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in lexical_search(table, bench, k).collect())
        assert got == plain_search(docs, items, k)
    assert rows_of(lexical_search(table, bench)) == duck_rows(OP12_SQL, documents=table.select("doc_id", "text"), benchmark=bench.select("item_id", "text"))
    assert lexical_search(no_docs, bench).count() == 0 == lexical_search(table, bench.limit(0)).count()


def test_search_beyond_the_broadcast_bound(spark, monkeypatch, text_of):
    monkeypatch.setattr(ls, "BROADCAST_ROWS", 0)
    docs, items = [(i, text_of(i, 30, 60)) for i in range(40)], [(1, text_of(90, 20, 60)), (2, text_of(91, 9, 60))]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(repr(tuple(r)) for r in lexical_search(table, bench).collect()) == plain_search(docs, items)


# conversations


def plain_trie(rows):
    """Nodes by whole prefixes of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    for c in own:
        own[c] = [(role, text) for *_, role, text in sorted(own[c])]
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, out = {}, {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = [out[q] for q in children.get(p, [])]
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(made[c]) == len(p))))
        saved = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        out[p] = (min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), sum(x[5] for x in below) or 1, saved + sum(x[6] for x in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(repr, out.values()))


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(repr(tuple(r)) for r in df.select(names).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_whole_prefixes(spark, seed):
    r, rows = random.Random(seed), []
    for c in [*range(0, 12), *range(195, 215), 300, 399, 401, 1234, -7, -100]:
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None, ""]), r.choice(["a", "bb", "é日", "", None])))
    rows += [(None, 0, "user", "lost"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 0, "", "x" * 100000)]
    for c in range(500, 520):  # copies of one conversation, and a long one that two share but for its end
        rows += [(c, t, "u", f"copy {t}") for t in range(7)]
    for c in (600, 601, 602):
        rows += [(c, t, "u", str(t)) for t in range(12)]
    rows.append((602, 12, "u", "more"))
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], TURNS + ", depth int, key string").repartition(4)
    got = trie_rows(conversation_trie(df))
    assert got == plain_trie(rows)
    assert rows_of(conversation_trie(df)) == duck_rows(OP13_SQL, conversations=df.select("conv_id", "turn", "role", "text"))


def test_trie_of_few_rows(spark, monkeypatch):
    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(7, 0, "u", "a")], [(207, 0, "u", "a"), (208, 0, "u", "a")], [(700, t, "u", str(t)) for t in range(4)]):
        assert trie_rows(conversation_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)


def test_trie_in_small_blocks(spark, monkeypatch):
    """Blocks of a few places and pieces of a few ids give the same sums, numbers and hashes."""
    monkeypatch.setattr(ct, "BLOCK", 4)
    monkeypatch.setattr(ct, "PIECE", 3)
    monkeypatch.setattr(ct, "BAND", 2)
    rows = [(c, t * 3, "u", f"{t}" * (t % 4)) for c in range(900, 925) for t in range(9)] + [(0, t, "u", f"{t}" * (t % 3)) for t in range(40)]
    assert trie_rows(conversation_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)
