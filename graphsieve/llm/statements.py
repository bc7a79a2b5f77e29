"""SQL of queries that compare all pairs, hash payloads or count within texts, and queries on parts of others' results that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import BASE, op8
from .sharding import op1

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

#: All pairs that share a shingle; components by reaching from every smaller document.
OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 links AS MATERIALIZED (SELECT x AS a, y AS b FROM (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2)
   JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE e.b > r.root),
 comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON node = d.doc_id
"""

#: Base32 of a SHA-1 by fives of hexadecimal digits, which are fours of base32 digits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '')"
OP9_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 r AS (SELECT page_id, html, h, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) AS k, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM r
"""

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
 grams AS (SELECT rn, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
 twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM grams) WHERE c > 1),
 rep AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
 dup AS (SELECT rn, count(*) - count(DISTINCT l) AS n FROM (SELECT rn, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, {_WORD}) GROUP BY 1),
 b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN dup USING (rn) LEFT JOIN rep USING (rn))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
"""

SHARDING_SQL = """
SELECT CAST(s AS INTEGER) AS shard, n // 40 + CAST(s < n % 40 AS BIGINT) AS n_rows, n // 40 + CAST(s < n % 40 AS BIGINT) AS n_slots, 0 AS first_slot, n // 40 + CAST(s < n % 40 AS BIGINT) - 1 AS last_slot, total
FROM (SELECT unnest(range(0, 40)) AS s), (SELECT count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, ''))) + 16) AS BIGINT) AS total FROM documents)
"""


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 without the trees' verdict."""
    return op8(spark, sf_dir).select("doc_id", *BASE, "base_failed")


def sharding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of op1's shards, and the bytes of all."""
    out = op1(spark, sf_dir)
    each = out.groupBy("shard").agg(F.count("*").alias("n_rows"), F.count_distinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.sum("size").alias("size"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("size").alias("total")))).drop("size")
