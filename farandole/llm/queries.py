"""The registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, mixing, packing, quality, simhash, tokens, topk, urls, warc
from .common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as 8-bit WAVE samples, sniffed, read back and measured."""
    stored = media.text_media(table(spark, sf_dir, "documents"))
    return media.features(media.sniffed(stored, ["doc_id", "n_bytes"]))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each document."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that aren't held out."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other rows of every vector whose id is divisible by 20, over all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url under the fixed rules and its redirect aliases."""
    return urls.judged(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32k piece model."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of a copy of all pages' WARC archives, located by the Merkle audit."""
    return warc.damage(table(spark, sf_dir, "pages"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, a row per piece."""
    return packing.with_crc(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicate_ids(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_mix": op2_mix,
    "op3_quality": op3_quality,
    "op4_topk": op4_topk,
    "op5_urls": op5_urls,
    "op6_tokens": op6_tokens,
    "op7_warc": op7_warc,
    "op8_pack": op8_pack,
    "op9_simhash": op9_simhash,
    "op10_langid": op10_langid,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS k
            FROM documents),
        s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s1),
        s3 AS (SELECT *, [5, 2, 1][((nth - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM s2),
        s4 AS (SELECT *, cap / weight AS ratio FROM s3),
        s5 AS (SELECT *, (sum(source_size) OVER ()::BIGINT - (sum(cap) OVER w::BIGINT - cap))::DOUBLE
                         / (sum(weight) OVER ()::BIGINT - (sum(weight) OVER w::BIGINT - weight))::DOUBLE AS level
               FROM s4 WINDOW w AS (ORDER BY ratio, nth ROWS UNBOUNDED PRECEDING)),
        s6 AS (SELECT *, (SELECT arg_min(level, struct_pack(ratio, nth)) FROM s5 WHERE level <= ratio) AS reached FROM s5),
        s7 AS (SELECT source, source_size, nth, greatest(1, ceil(sum(source_size) OVER () / 131072))::BIGINT AS quantum, sum(source_size) OVER ()::BIGINT AS budget,
                      least(cap::DOUBLE, coalesce(reached, 0) * weight) AS target FROM s6),
        queue AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.nth, s.quantum, s.budget,
                         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
                  FROM sized d JOIN s7 s ON d.source IS NOT DISTINCT FROM s.source),
        quanta AS (SELECT nth, quantum, budget, target, size, c.copy * source_size + done - size AS first, unnest(range(0, size, quantum)) AS k
                   FROM queue, range(3) c(copy) WHERE size > 0 AND target > 0),
        parts AS (SELECT nth, budget, least(quantum, size - k) AS words, (first + k + least(quantum, size - k))::DOUBLE / target AS finish FROM quanta WHERE first + k < target),
        spent AS (SELECT nth, words, budget, sum(words) OVER (ORDER BY finish, nth ROWS UNBOUNDED PRECEDING) - words AS before FROM parts),
        served AS (SELECT nth, sum(greatest(0, least(words, budget - before)))::BIGINT AS served FROM spent GROUP BY nth)
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(size, coalesce(served, 0) - done + size))
                + greatest(0, least(size, coalesce(served, 0) - source_size - done + size))
                + greatest(0, least(size, coalesce(served, 0) - 2 * source_size - done + size)))::BIGINT AS taken
        FROM queue LEFT JOIN served USING (nth)""",
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
                  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op5_urls": r"""
        WITH RECURSIVE rules(action, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
        p AS (SELECT page_id, html, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') AS path,
                     coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '') AS query FROM pages),
        n AS (SELECT *, CASE WHEN host <> '' THEN '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM p),
        links AS (
            SELECT *, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b'))[1], '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1) AS link FROM n
            UNION ALL
            SELECT *, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b'))[1], '(?is)\burl\s*=\s*["'']?([^"''>\s]*)', 1) FROM n),
        l2 AS (SELECT *, replace(trim(link), '&amp;', '&') AS k, 'x://' || host AS base, CASE WHEN path = '' THEN '/' ELSE path END AS dir FROM links WHERE link <> ''),
        l3 AS (SELECT node AS a, CASE WHEN k = '' OR k LIKE '#%' THEN NULL WHEN regexp_matches(k, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN k WHEN k LIKE '//%' THEN 'x:' || k
                      WHEN regexp_matches(k, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN k LIKE '/%' THEN base || k WHEN k LIKE '?%' THEN base || dir || k
                      ELSE base || regexp_replace(dir, '[^/]*$', '') || k END AS t FROM l2),
        l4 AS (SELECT a, translate(regexp_extract(t, '://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS path,
                      coalesce(regexp_extract(t, '://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '') AS query FROM l3),
        e AS (SELECT DISTINCT a, '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query AS b FROM l4 WHERE host <> ''),
        e2 AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
        reach(a, b) AS (SELECT a, a FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON r.b = e2.a),
        urls AS (SELECT DISTINCT host, path FROM n UNION SELECT DISTINCT regexp_extract(b, '://([^/?#]*)([^?#]*)', 1), regexp_extract(b, '://([^/?#]*)([^?#]*)', 2) FROM reach),
        fits AS (SELECT u.host, u.path, arg_max(struct_pack(rule, action), struct_pack(len := length(rule), ok := (action = 'allow')::INT, rule := rule)) AS best
                 FROM urls u JOIN rules r ON (u.host = split_part(rule, '/', 1) OR ends_with(u.host, '.' || split_part(rule, '/', 1))) AND starts_with(u.path, substr(rule, instr(rule, '/')))
                 GROUP BY ALL),
        alias AS (SELECT r.a AS node, max(CASE f.best.action WHEN 'allow' THEN 2 ELSE 1 END) AS most
                  FROM reach r JOIN fits f ON f.host = regexp_extract(r.b, '://([^/?#]*)([^?#]*)', 1) AND f.path = regexp_extract(r.b, '://([^/?#]*)([^?#]*)', 2) GROUP BY 1)
        SELECT page_id, n.host, n.path, f.best.rule AS rule, coalesce(f.best.action, CASE most WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
        FROM n LEFT JOIN fits f ON n.host = f.host AND n.path = f.path LEFT JOIN alias USING (node)""",
    "op7_warc": r"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5(concat_ws('|', page_id::VARCHAR, url)) AS m,
                          ('0x' || substr(md5(coalesce(page_id::VARCHAR, 'x')), 1, 6))::BIGINT AS k FROM pages),
        r AS (SELECT page_id, k, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)
                     || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) AS text FROM p),
        d AS (SELECT page_id, sha256(text || chr(10)) AS digest, strlen(text) + 1 AS length, CASE WHEN k % 211 = 7 THEN NULL WHEN k % 61 = 0 THEN sha256(text || '!') ELSE sha256(text || chr(10)) END AS replica_digest FROM r),
        once AS (SELECT page_id, digest, length, replica_digest, count(*)::BIGINT AS copies FROM d GROUP BY ALL),
        a AS (SELECT *, substr(digest, 1, greatest(1, ceil(ln((SELECT sum(length) FROM once) / 1073741824.0) / ln(16.0)))::INT) AS archive FROM once),
        o AS (SELECT *, (sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset" FROM a)
        SELECT page_id, archive, "offset", length::BIGINT AS length, digest, replica_digest, CASE WHEN replica_digest IS NULL THEN 'missing' ELSE 'corrupt' END AS status, copies
        FROM o WHERE replica_digest IS DISTINCT FROM digest""",
}
