"""Queries of the training-data operators over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import conversation_trie
from .decontamination import decontaminate
from .embedding_dedup import embedding_dedup
from .language_id import language_id
from .lexical_packing import lexical_packing
from .lexical_search import lexical_search
from .license_scan import SIZES, TEMPLATES, license_scan, size_of, template_words
from .lm_scoring import lm_scores
from .minhash_dedup import minhash_dedup
from .personal_data import CUES, SCHEMES, personal_data
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .warc_fixity import audit, catalogue, damaged, warc_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w)
), least_doc AS (
  SELECT k, min(doc_id) AS m FROM win GROUP BY k
), hit AS (
  SELECT DISTINCT doc_id, s + j AS p
  FROM win JOIN least_doc USING (k), range(13) AS t(j) WHERE m < doc_id
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), segment AS (  -- of 512 bytes and what windows reach beyond; substr on a long string is slow
  SELECT doc_id, c * 512 AS base, length(h) // 2 AS n, substr(h, 1024 * c + 1, 1024 + 198) AS g
  FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 1023) // 1024)) AS c FROM d)
), win AS (
  SELECT doc_id, base + i AS s, md5_number(substr(g, 2 * i + 1, 200)) AS k
  FROM (SELECT *, unnest(range(0, greatest(least(512, n - 99 - base), 0))) AS i FROM segment)
), least_place AS (
  SELECT k, min({'d': doc_id, 's': s}) AS m FROM win GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT doc_id, s FROM win JOIN least_place USING (k) WHERE m.d <> doc_id OR m.s <> s
), byte AS (
  SELECT doc_id, base + i AS p, substr(g, 2 * i + 1, 2) AS b FROM (SELECT *, unnest(range(0, least(512, n - base))) AS i FROM segment)
), seen AS (
  SELECT byte.doc_id, b, p,
         coalesce(p - max(hit.s) OVER (PARTITION BY byte.doc_id ORDER BY p) < 100, false) AS gone
  FROM byte LEFT JOIN hit ON byte.doc_id = hit.doc_id AND byte.p = hit.s
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM seen
), per_doc AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
         string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN per_doc USING (doc_id)
"""


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good AS a JOIN good AS b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
)
SELECT reach.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(other) AS component_id, min(other) = reach.vec_id AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY reach.vec_id
"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sh AS a JOIN sh AS b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, min(other) = w.doc_id AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""

#: The word cut of the two scans below, as DuckDB SQL.
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


TEMPLATE_ROWS = ", ".join(f"({i}, {size_of(len(template_words(text)))}, '{label}', string_split('{' '.join(template_words(text))}', ' '))" for i, (label, text) in enumerate(TEMPLATES))
SIZE_ROWS = ", ".join(f"({i}, {width}, {step})" for i, (width, step) in enumerate(SIZES))
OP5_SQL = f"""
WITH w AS (
  SELECT doc_id, {WORDS_SQL} AS ws FROM documents
), phrase(label, ps) AS (
  VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])
), pos AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), place AS (
  SELECT doc_id, label, i - 1 AS i FROM pos JOIN phrase ON ws[i:i + len(ps) - 1] = ps
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM place GROUP BY doc_id
), template(k, label, tokens) AS (
  SELECT k, label, list_distinct(tokens) FROM (VALUES {TEMPLATE_ROWS}) AS v(t, k, label, tokens)
), block AS (
  SELECT doc_id, k, ws[b + 1:b + width] AS held
  FROM (SELECT doc_id, ws, k, width, unnest(range(0, len(ws), step)) AS b FROM w, (VALUES {SIZE_ROWS}) AS s(k, width, step))
), match AS (
  SELECT doc_id, label, len(list_intersect(tokens, held)) / len(tokens) AS share
  FROM block JOIN template USING (k) WHERE len(list_intersect(tokens, held)) >= ceil(0.9 * len(tokens) - 1e-9)
), best AS (
  SELECT doc_id, max(share) AS best FROM match GROUP BY doc_id
), named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM match UNION SELECT doc_id, label FROM place) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_warc_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(catalogue(damaged(warc_records(table(spark, sf_dir, "pages")))))


OP6_LEVELS = "".join(
    f""", l{i + 1} AS (
  SELECT s, warc, node // 16 AS node, sha256(string_agg(node || ':' || hash, chr(10) ORDER BY node)) AS hash
  FROM (SELECT s, warc, node, hash FROM l{i}) GROUP BY s, warc, node // 16
)"""
    for i in range(4)
)
CRLF = "chr(13) || chr(10)"
OP6_SQL = f"""
WITH page AS (
  SELECT page_id, 'part-' || lpad(CAST(page_id // 512 AS VARCHAR), 8, '0') || '.warc' AS warc,
    'WARC/1.1' || {CRLF} || 'WARC-Type: response' || {CRLF} || 'WARC-Record-ID: <urn:page:' || page_id
    || '>' || {CRLF} || 'WARC-Target-URI: ' || coalesce(url, '') || {CRLF}
    || 'Content-Type: text/html' || {CRLF} || 'Content-Length: ' || strlen(coalesce(html, ''))
    || {CRLF} || {CRLF} || coalesce(html, '') || {CRLF} || {CRLF} AS record
  FROM pages
), rec AS (
  SELECT warc, record, strlen(record) AS length, digest, substr(digest, 1, 2) AS mark, CAST(coalesce(sum(strlen(record)) OVER (
    PARTITION BY warc ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM (SELECT *, sha256(record) AS digest FROM page)
), side AS (
  SELECT 'p' AS s, warc, pos, length, digest FROM rec
  UNION ALL
  SELECT 'r', warc, pos, strlen(copy), sha256(copy) FROM (
    SELECT warc, pos, CASE WHEN mark < '02' THEN 'WARC/1.0' || substr(record, 9) WHEN mark < '04' THEN substr(record, 1, 8) ELSE record END AS copy
    FROM rec WHERE mark < '04' OR mark >= '06')
  UNION ALL
  SELECT 'r', warc, pos + 1, 5, sha256('stray') FROM rec WHERE mark >= '06' AND mark < '08'
), l0 AS (
  SELECT s, warc, pos // 262144 AS node,
         sha256(string_agg(pos || ':' || length || ':' || digest, chr(10) ORDER BY pos, length, digest)) AS hash
  FROM side GROUP BY s, warc, pos // 262144
){OP6_LEVELS}, root AS (
  SELECT s, warc, sha256(string_agg(node || ':' || hash, chr(10) ORDER BY node)) AS hash FROM l4 GROUP BY s, warc
)
SELECT coalesce(p.warc, r.warc) AS warc, coalesce(p.pos, r.pos) AS "offset", CAST(coalesce(p.length, r.length) AS BIGINT) AS length,
       CASE WHEN r.warc IS NULL THEN 'missing' WHEN p.warc IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
       p.digest AS primary_digest, r.digest AS replica_digest, a.hash AS primary_root, b.hash AS replica_root
FROM (SELECT * FROM side WHERE s = 'p') AS p
FULL JOIN (SELECT * FROM side WHERE s = 'r') AS r ON p.warc = r.warc AND p.pos = r.pos
LEFT JOIN root AS a ON a.warc = coalesce(p.warc, r.warc) AND a.s = 'p' LEFT JOIN root AS b ON b.warc = coalesce(p.warc, r.warc) AND b.s = 'r'
WHERE r.digest IS DISTINCT FROM p.digest
"""


def op8_masked_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = f"""
WITH w AS (
  SELECT doc_id, {WORDS_SQL} AS ws FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS ws FROM benchmark
), run AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS span, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM item WHERE len(ws) > 0)
), win AS (
  SELECT doc_id, i, span, array_to_string(ws[i:i + span - 1], ' ') AS k
  FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS i FROM w, (SELECT DISTINCT span FROM run))
), hit AS (
  SELECT doc_id, i, run.span, item_id FROM win JOIN run ON win.k = run.k AND win.span = run.span
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM hit) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""

def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


RUN_SQL, GAP_SQL = r"[0-9]([\x20-]?[0-9])+", r"(\x20(number|no|nr))?[\x20.:#=]{0,3}"
IBAN_SQL = r"[a-z]{2}[0-9]{2}((\x20[a-z0-9]{4}){2,7}(\x20[a-z0-9]{1,3})?|[a-z0-9]{11,30})"
#: Kind, text, pattern, the part of a match that is the span, and its check.
KIND_SQL = [
    ("email", "t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "m", "true"),
    ("ip", "t", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "m", "len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 OR CAST('0' || substr(ltrim(x, '0'), 1, 4) AS INT) > 255)) = 0"),
    ("card", "t", RUN_SQL, "m", "len(d) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(d), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) ELSE 2 * CAST(x AS INT) - 9 * CAST(CAST(x AS INT) > 4 AS INT) END)) % 10 = 0"),
    ("phone", "t", r"\+[0-9][\x20().0-9-]+[0-9]", "m", "len(d) BETWEEN 8 AND 15"),
    ("address", "low", rf"({'|'.join(SCHEMES)})://[a-z0-9._~%!$&''()*+,;=:-]+@[a-z0-9-]+(\.[a-z0-9-]+)*", "m", "true"),
    ("account", "low", rf"\b({'|'.join(CUES)}){GAP_SQL}{RUN_SQL}", rf"regexp_extract(m, '{RUN_SQL}$')", "len(d) BETWEEN 6 AND 17"),
    ("iban", "low", rf"\biban{GAP_SQL}{IBAN_SQL}", f"CASE WHEN {{97}} THEN regexp_extract(m, '{IBAN_SQL}$') ELSE regexp_replace(regexp_extract(m, '{IBAN_SQL}$'), '\\x20[a-z0-9]+$', '') END", "{97}"),
]
CHECK_97 = r"list_reduce(list_concat([0], list_transform(string_split({0}[5:] || {0}[:4], ''), lambda x: ascii(x))), lambda r, x: CASE WHEN x < 58 THEN (r * 10 + x - 48) % 97 ELSE (r * 100 + x - 87) % 97 END) = 1"
KIND_SQL[-1] = (*KIND_SQL[-1][:3], KIND_SQL[-1][3].replace("{97}", CHECK_97.format(f"replace(regexp_extract(m, '{IBAN_SQL}$'), ' ', '')")), CHECK_97.format("replace(v, ' ', '')"))
OP11_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), found AS ({" UNION ALL ".join(f"""
  SELECT uid, {i} AS k, '{kind}' AS kind, s + len(m) - len(regexp_extract(m, '{tail}')) AS a, v FROM (
    SELECT uid, m, s, {value} AS v FROM (
      SELECT uid, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i: list_sum(list_transform(gaps[:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda y: len(y))), 0))) AS s
      FROM (SELECT uid, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gaps FROM doc) WHERE len(ms) > 0))
  WHERE {check.replace("(d)", "(regexp_replace(v, '[^0-9]', '', 'g'))")}""" for i, (kind, text, pattern, value, check) in enumerate(KIND_SQL) for tail in [{"account": RUN_SQL + "$", "iban": IBAN_SQL + "$"}.get(kind, "(?s).*")])}
), one AS (
  SELECT uid, k, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len(v) AS BIGINT) AS span FROM found
), per_doc AS (
  SELECT uid, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(("email", "ip", "card", "phone")))},
         string_agg(span, ',' ORDER BY k, a) FILTER (k < 4) AS base, string_agg(span, ',' ORDER BY k, a) AS spans
  FROM one GROUP BY uid
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in ("email", "ip", "card", "phone"))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN per_doc USING (uid)
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid, {TERMS_SQL} AS ts FROM documents
), p AS (
  SELECT doc_id, uid, len(ts) AS n, t, count(*) AS tf FROM (SELECT doc_id, uid, ts, unnest(ts) AS t FROM d) GROUP BY ALL
), total AS (
  SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY t, docs
), item AS (
  SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS t FROM benchmark WHERE item_id IS NOT NULL
), score AS (
  SELECT item_id, doc_id, uid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN p USING (t) JOIN weight USING (t), total GROUP BY item_id, doc_id, uid
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM score WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of an id's decimal digits, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, key, length, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i FROM (
    SELECT conv_id, turn, length(coalesce(text, '')) AS length, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
    FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC_SQL} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), held AS (
  SELECT conv_id AS base, count(*) AS n FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, t.i AS depth, key, length FROM c JOIN t ON t.conv_id = c.base WHERE t.i <= h
  UNION ALL
  SELECT c.conv_id, t.i - h + least(h, coalesce(held.n, 0)), key, length FROM c JOIN t USING (conv_id) LEFT JOIN held USING (base) WHERE t.i > h
), p AS (
  SELECT conv_id, depth, length, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c
), node AS (
  SELECT depth, path, min(conv_id) AS node, count(*) AS n_convs, (count(*) - 1) * any_value(length) AS saves FROM p GROUP BY depth, path
), member AS (
  SELECT p.conv_id, p.depth, node, n_convs, saves, p.depth = max(p.depth) OVER (PARTITION BY p.conv_id) AS ends FROM p JOIN node USING (depth, path)
), link AS (
  SELECT DISTINCT below.depth, below.node, above.node AS parent
  FROM member AS below JOIN member AS above ON above.conv_id = below.conv_id AND above.depth = below.depth - 1
), under AS (
  SELECT DISTINCT top.depth, top.node, low.depth AS low_depth, low.node AS low_node, low.saves
  FROM member AS top JOIN member AS low ON low.conv_id = top.conv_id AND low.depth >= top.depth
), fork AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM link GROUP BY ALL
), summed AS (
  SELECT under.depth, under.node, count(*) FILTER (fork.n IS NULL) AS n_leaves, sum(saves) AS saved_tokens
  FROM under LEFT JOIN fork ON fork.depth = low_depth AND fork.node = low_node GROUP BY ALL
), ended AS (
  SELECT depth, node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM member WHERE ends GROUP BY ALL
)
SELECT node.node AS conv_id, CAST(node.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, coalesce(fork.n, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM node LEFT JOIN link USING (depth, node) LEFT JOIN fork USING (depth, node) JOIN summed USING (depth, node) LEFT JOIN ended USING (depth, node)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lexical_packing": op3_lexical_packing,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_warc_merkle_fixity": op6_warc_merkle_fixity,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_masked_lm_scoring": op8_masked_lm_scoring,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_personal_data": op11_personal_data,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op4_suffix_array_dedup": OP4_SQL,
    "op5_license_scan": OP5_SQL,
    "op6_warc_merkle_fixity": OP6_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op11_personal_data": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
