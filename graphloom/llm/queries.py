"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_fold, read_table

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses_of_pages

    return derivatives(responses_of_pages(read_table(spark, sf_dir, "pages")), ["page_id"])


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    rows = rotate(read_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s.begin.cast("string"), s.end.cast("string"))), ",")
    return rows.withColumn("mask", mask)


def op3_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import find_leaks

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    items = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", items.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (items >= 2).alias("contaminated"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decision_list import judged, learn_rules

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored, train_on

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold("doc_id", 3)
    model = train_on(docs, read_table(spark, sf_dir, "labels").where(fold != 1))
    return scored(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identified, train_on

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold("doc_id", 5)
    tagger = train_on(docs.where(fold != 0))
    return identified(docs.select("doc_id", "text"), tagger).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, keep_ids=False)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op6_chat_rotation": op6_chat_rotation,
    "op3_simhash_covering": op3_simhash_covering,
    "op4_substring_index": op4_substring_index,
    "op7_winnowing": op7_winnowing,
    "op5_quality_rules": op5_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op10_language_id": op10_language_id,
    "op9_byte_bpe": op9_byte_bpe,
}

ORACLE_SQL = {
    "op6_chat_rotation": """
WITH t AS (SELECT conv_id, coalesce(turn // 512, 0) AS segment, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
names AS (SELECT DISTINCT conv_id, role AS me FROM t WHERE role <> 'system'),
parts AS (SELECT t.conv_id, n.me, t.segment, t.role = n.me AS mine,
    '<|begin|>' || CASE WHEN t.role = n.me THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head, t.text || '<|end|>' AS body,
    row_number() OVER (PARTITION BY t.conv_id, n.me, t.segment ORDER BY t.turn NULLS FIRST, t.role, t.text) AS i
    FROM t JOIN names n ON t.conv_id IS NOT DISTINCT FROM n.conv_id),
placed AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, me, segment ORDER BY i) - length(body) - 1 AS b FROM parts)
SELECT conv_id, me AS participant, segment, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_target_turns,
    string_agg(head || body || chr(10), '' ORDER BY i) AS rendered,
    coalesce(string_agg(CAST(b AS BIGINT)::VARCHAR || '-' || CAST(b + length(body) AS BIGINT)::VARCHAR, ',' ORDER BY i) FILTER (WHERE mine), '') AS mask
FROM placed GROUP BY conv_id, me, segment
""",
    "op1_url_filter": """
WITH rules(rule, host, prefix, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM rest),
best AS (SELECT p.row, arg_max(r.rule, length(r.rule) * 1000 + length(r.host)) AS rule, arg_max(r.verdict, length(r.rule) * 1000 + length(r.host)) AS verdict
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.prefix) GROUP BY p.row)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b ON p.row = b.row
""",
}
