"""The queries of this subpackage and their SQL; an operator that SQL can't express has none and is tested by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.ann import op5_posting_list_search
from vocalith.llm.bagminhash import op10_bagminhash_dedup
from vocalith.llm.common import table
from vocalith.llm.decontaminate import WINDOWS_SQL, op13_winnowing
from vocalith.llm.embedding_dedup import op6_multi_index_dedup
from vocalith.llm.filter_audit import AUDIT_SQL, op12_filter_audit
from vocalith.llm.html_text import op9_template_text
from vocalith.llm.mixing import op4_pivotal_mixing, targets, words
from vocalith.llm.periodic import op11_periodic_runs
from vocalith.llm.pieces import op8_piece_encoding
from vocalith.llm.quality import op7_neighbour_quality
from vocalith.llm.sharding import op1_rendezvous_sharding, shard
from vocalith.llm.url_filter import host, match_rules, op2_url_ratio_filter, path
from vocalith.llm.warc import op3_warc_chunk_table


def shards_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of sharding that SQL has: sizes and shards, without checksums and slots."""
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "shard", "grown_shard")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of mixing that SQL has: sizes and targets of the sources."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    return targets(sizes).select("source", "source_size", F.round("target", 6).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the URL filter that SQL has: hosts, paths and what rules decide."""
    rows = table(spark, sf_dir, "pages").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = match_rules(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rendezvous_sharding,
        op2_url_ratio_filter,
        op3_warc_chunk_table,
        op4_pivotal_mixing,
        op5_posting_list_search,
        op6_multi_index_dedup,
        op7_neighbour_quality,
        op8_piece_encoding,
        op9_template_text,
        op10_bagminhash_dedup,
        op11_periodic_runs,
        op12_filter_audit,
        op13_winnowing,
        shards_of_keys,
        mixing_targets,
        url_rules,
    )
}

SHARDS_SQL = """WITH k AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(cast(doc_id AS VARCHAR), 'null') AS k FROM documents),
c AS (SELECT doc_id, size, list_transform(range(0, 9), lambda i: -ln((cast('0x' || substr(md5(k || '#' || i), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)) AS cost FROM k)
SELECT doc_id, cast(size AS BIGINT) AS size, cast(list_position(cost[:8], list_min(cost[:8])) - 1 AS INT) AS shard, cast(list_position(cost, list_min(cost)) - 1 AS INT) AS grown_shard FROM c"""

WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, cast(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, cast(5 * (j // 4) + 1 AS INT), 5) AS BIGINT) >> cast(15 - 5 * (j % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, CASE WHEN page_id = top THEN true END AS digest_ok FROM g"""

TARGETS_SQL = """WITH s AS (SELECT source, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 3.0 * size AS cap FROM s),
l AS (SELECT *, (sum(size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT max(CASE WHEN cap / w >= level THEN level END) AS level FROM l)
SELECT source, size AS source_size, round(cast(least(cap, m.level * w) AS DOUBLE), 6) AS target FROM l, m"""

RULES_SQL = """WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['host', 'path']) AS u FROM pages),
h AS (SELECT page_id, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.path AS path FROM u),
r(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN f ON h.page_id = f.page_id"""

NEAR_SQL = """WITH RECURSIVE a AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM a WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
v AS (SELECT * FROM g WHERE len(v) = (SELECT len(v) FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.a = c.c AS kept FROM c LEFT JOIN n ON c.a = n.a"""

DEDUP_SQL = """WITH RECURSIVE t AS (SELECT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT min(doc_id) AS d, any_value(w) AS w, count(*) AS n, text FROM t WHERE len(w) > 0 GROUP BY text),
g AS (SELECT d, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(w[i : i + 4]))) AS s FROM d),
c AS (SELECT d, s, count(*) AS n FROM g GROUP BY d, s), z AS (SELECT d, sum(n) AS z FROM c GROUP BY d),
p AS (SELECT x.d AS a, y.d AS b, sum(least(x.n, y.n)) AS k FROM c x JOIN c y ON x.s = y.s AND x.d <> y.d GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON a = x.d JOIN z y ON b = y.d WHERE 5 * k >= 4 * (x.z + y.z - k)),
r(a, b) AS (SELECT d, d FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS d, min(b) AS class_id FROM r GROUP BY a), q AS (SELECT class_id, cast(sum(n) AS BIGINT) AS n_class FROM m JOIN d ON m.d = d.d GROUP BY class_id)
SELECT t.doc_id, coalesce(m.class_id, t.doc_id) AS class_id, coalesce(q.n_class, 1) AS n_class, t.doc_id = coalesce(m.class_id, t.doc_id) AS kept
FROM t LEFT JOIN d ON t.text = d.text AND len(t.w) > 0 LEFT JOIN m ON d.d = m.d LEFT JOIN q ON m.class_id = q.class_id"""

ORACLE: dict[str, str] = {"op3_warc_chunk_table": WARC_SQL, "op6_multi_index_dedup": NEAR_SQL, "op10_bagminhash_dedup": DEDUP_SQL, "op12_filter_audit": AUDIT_SQL, "op13_winnowing": WINDOWS_SQL, "shards_of_keys": SHARDS_SQL, "mixing_targets": TARGETS_SQL, "url_rules": RULES_SQL}
