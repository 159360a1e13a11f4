"""The registered queries: each operator over its whole table, thin digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, packing, pii, quality_classifier, quality_rules, secrets, simhash, substring_dedup, token_counts
from ._common import table, work_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(remainder(4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    renamed = [F.col(f"_{c}").alias(c) for c in [*quality_rules.BASE, "base_failed", "kept", "posterior"]]
    return made.select("row.doc_id", *renamed)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return quality_classifier.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The query's own cache: a run counts all of its documents anew.
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, work_path(spark, "token-cache"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The query's own ledger: a run scans all of its blobs anew.
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents"), work_path(spark, "secret-ledger")))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_decontamination, op3_substring_dedup, op4_language_id, op5_quality_rules, op6_quality_classifier, op7_simhash, op8_pii, op9_token_counts, op10_secrets)
}

def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op5, which SQL can express."""
    made = op5_quality_rules(spark, sf_dir)
    return made.select("doc_id", *quality_rules.BASE, "base_failed")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op8."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op10."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


#: Columns of the operators above that SQL can express, held against it.
CHECKS = {f.__name__: f for f in (base_quality, base_pii, base_secrets)}

_SPACE = "\\x20\\x09-\\x0D"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) END)) % 10 = 0"


def _counted(pattern: str, check: str = "true", group: int = 0) -> str:
    return f"CAST(len(list_filter(regexp_extract_all(t, '{pattern}', {group}), lambda x: {check})) AS BIGINT)"


ORACLES = {
    "base_quality": f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS times FROM g) WHERE times > 1) GROUP BY r
), b AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
""",
    "base_pii": f"""
SELECT doc_id, {_counted("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+")} AS n_email,
  {_counted("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0")} AS n_ip,
  {_counted("[0-9]([\\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")} AS n_card,
  {_counted("\\+[0-9][\\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 8 AND 15")} AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "base_secrets": f"""
SELECT doc_id, {_counted("((?i:password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "length(x) >= 12", 2)} AS n_assign,
  {_counted("AKIA[A-Z0-9]+", "length(x) >= 18")} AS n_access, {_counted("[0-9a-f]+", "length(x) >= 16")} AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "op2_decontamination": """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) e, (SELECT DISTINCT n FROM bw) s
  WHERE i + s.n - 1 <= len(w)
), hit AS (
  SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN items ON d.r = items.r
"""
}
