"""The registered queries of this subpackage: thin digests of the operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.llm import bpe, html, langid, licences, manifest, prefixes, quality, simhash, suffix, topk, toxicity, warc, winnow
from tonegauge.llm.common import crc_bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_extraction")
def op1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html.extract_pages(pages, F.col("html"), {"page_id": "bigint", "url": "string"})


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bucket = crc_bucket(F.col("doc_id"), 3)
    found = langid.identify(docs, bucket != 1, {"doc_id": "bigint"})
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op3_bpe_round_trip")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_texts(docs, F.col("text"), public_tokenizers.path("word_bpe_49k.json"), {"doc_id": "bigint"})


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, crc_bucket(F.col("doc_id"), 5) != 0)
    found = toxicity.score_texts(docs, model, {"doc_id": "bigint"})
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return suffix.dedup(table(spark, sf_dir, "documents")).drop("row")


OP7_SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS top FROM p GROUP BY payload)
SELECT p.page_id, octet_length(p.payload) AS payload_bytes, {warc.base32_sha1_sql('p.payload')} AS payload_digest,
CASE WHEN p.page_id <> g.top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN p.page_id <> g.top THEN g.top END AS refers_to
FROM p JOIN g ON p.payload = g.payload"""


@query("op7_warc_zstd", OP7_SQL)
def op7(spark, sf_dir):
    back = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op8_exact_top_k", OP8_SQL)
def op8(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


_WORDS = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP9_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
i AS (SELECT item_id, CAST(least(13, len(w)) AS INT) AS l, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s, w FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, l, array_to_string(w[s + 1 : s + l], ' ') AS t FROM i),
z AS (SELECT DISTINCT l FROM k),
x AS (SELECT doc_id, l, unnest(range(0, len(w) - l + 1)) AS s, w FROM d, z WHERE len(w) >= l),
y AS (SELECT doc_id, l, s, array_to_string(w[s + 1 : s + l], ' ') AS t FROM x),
h AS (SELECT y.doc_id, y.s, y.l, k.item_id FROM y JOIN k ON y.l = k.l AND y.t = k.t),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""


@query("op9_winnow_decontamination", OP9_SQL)
def op9(spark, sf_dir):
    found = winnow.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), winnow.contaminated().alias("contaminated"))


@query("op10_licence_scan", licences.scan_sql(_WORDS.format("coalesce(text, '')")))
def op10(spark, sf_dir):
    found = licences.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    every = F.array_sort(F.array_union("base_labels", "found_labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", licences.joined(F.col("base_labels")).alias("base_labels"), licences.joined(every).alias("labels"), "score")


#: The unsigned crc32 of an ASCII text, byte by byte.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i])::BIGINT)),
lambda a, b: xor(a // 256, list_reduce(list_concat([xor(a, b) % 256], range(8)), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))), 4294967295)"""

OP11_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(octet_length(encode(r)) || ':' || r || x), 32)) - 1 AS spot FROM t),
m AS (SELECT c, h.* FROM (SELECT DISTINCT conv_id AS c FROM t) k, LATERAL (SELECT c - c % 5 AS base, {_CRC.format("CAST(c AS VARCHAR)")} % 9 AS first) h),
b AS (SELECT m.c, o.spot, o.r, o.x FROM m JOIN o ON o.conv_id = m.base AND m.c <> m.base AND o.spot < m.first
UNION ALL SELECT m.c, o.spot + 1000000000 AS spot, o.r, o.x FROM m JOIN o ON o.conv_id = m.c AND (m.c = m.base OR o.spot >= m.first)),
p AS (SELECT c, row_number() OVER w AS d, x, string_agg(sha256(octet_length(encode(r)) || ':' || r || x), '') OVER w AS k FROM b WINDOW w AS (PARTITION BY c ORDER BY spot)),
q AS (SELECT c, d, md5(k) AS k, CASE WHEN d > 1 THEN md5(left(k, -64)) ELSE '' END AS up, octet_length(encode(x)) AS n FROM p UNION ALL SELECT c, 0, '', NULL, 0 FROM m),
e AS (SELECT q.* FROM q JOIN (SELECT c, max(d) AS d FROM q GROUP BY c) USING (c, d)),
s AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM e GROUP BY d, k),
v AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(n) AS size FROM q GROUP BY d, k),
f AS (SELECT d - 1 AS d, up AS k, count(*) AS children FROM v WHERE d > 0 GROUP BY d, up),
g AS (SELECT v.*, coalesce(f.children, 0) AS children FROM v LEFT JOIN f ON v.d = f.d AND v.k = f.k),
a AS (SELECT q.d, q.k, sum(CASE WHEN g.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((g.n - 1) * g.size) AS saved FROM g JOIN q ON q.c = g.c AND q.d <= g.d GROUP BY q.d, q.k)
SELECT g.c AS conv_id, g.d AS depth, u.c AS parent_conv_id, g.n AS n_convs, g.children AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens,
sha256(coalesce(s.ids, '')) AS ends_sha256
FROM g JOIN a ON g.d = a.d AND g.k = a.k LEFT JOIN s ON g.d = s.d AND g.k = s.k LEFT JOIN v u ON g.d = u.d + 1 AND g.up = u.k"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf_dir):
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_quality")
def op12(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, crc_bucket(F.col("doc_id"), 5) != 0)
    found = quality.score_texts(docs, model, {"doc_id": "bigint"})
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_SIDES = """SELECT {1}lev, i, coalesce(string_agg(d, '') OVER (PARTITION BY {1}lev, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
coalesce(string_agg(d, '') OVER (PARTITION BY {1}lev, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY {1}lev) AS c FROM {0}) WHERE c > 1"""
OP13_SQL = f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (SELECT doc_id, coalesce('1' || source, '0') AS g,
{_LEAF.format("text")} AS leaf, CASE WHEN {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS bad FROM documents)),
n AS (SELECT g, 0 AS lev, i, leaf AS d FROM l UNION ALL SELECT g, lev + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM n) WHERE c > 1 GROUP BY g, lev, i // 3),
s AS (SELECT g, arg_max(d, lev) AS d, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM n GROUP BY g),
t AS (SELECT 0 AS lev, i, d FROM s UNION ALL SELECT lev + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM t) WHERE c > 1 GROUP BY lev, i // 3),
x AS ({_SIDES.format("n", "g, ")}), y AS ({_SIDES.format("t", "")}),
f AS (SELECT id, g, 0 AS lev, i, coalesce(bad, leaf) AS v, '' AS p FROM l UNION ALL SELECT f.id, f.g, f.lev + 1, f.i // 3, sha256(x.l || v || x.r), p || x.l || x.r FROM f JOIN x ON f.g = x.g AND f.lev = x.lev AND f.i = x.i),
a AS (SELECT id, g, arg_max(v, lev) AS v, arg_max(p, lev) AS p FROM f GROUP BY id, g),
h AS (SELECT a.id, 0 AS lev, s.i, a.v, a.p FROM a JOIN s ON a.g = s.g UNION ALL SELECT h.id, h.lev + 1, h.i // 3, sha256(y.l || v || y.r), p || y.l || y.r FROM h JOIN y ON h.lev = y.lev AND h.i = y.i),
o AS (SELECT id, arg_max(v, lev) AS v, arg_max(p, lev) AS p FROM h GROUP BY id), z AS (SELECT arg_max(d, lev) AS root FROM t)
SELECT l.doc_id, l.leaf, s.d AS subroot, z.root, sha256(o.p) AS proof_sha256, o.v AS folded_root, o.v = z.root AS verified
FROM l JOIN s ON l.g = s.g JOIN o ON l.id = o.id, z"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf_dir):
    return manifest.manifest(table(spark, sf_dir, "documents"))
