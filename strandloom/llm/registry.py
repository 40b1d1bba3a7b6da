"""The queries of the document operators: ``opN_<name>``, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, licenses, lm, omh, shards, simhash, toxicity, urlrep, warc
from strandloom.llm.common import Scratch, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.score(table(spark, sf_dir, "documents"), good)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path("archive")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.summary(warc.read(spark, folder))
    return found.withColumnRenamed("id", "page_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.write(table(spark, sf_dir, "documents"), Scratch(spark, "shards").path("shards"), 20260117, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("ids", "doc_ids")


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labels = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    outcomes = pages.select("page_id", urlrep.host(F.col("url")).alias("host")).join(labels, "page_id").select("host", "bad")
    return urlrep.judge(pages, URL_RULES, outcomes).withColumn("reputation", F.round("reputation", 6))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = omh.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP5_SQL = """
WITH hashed AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), owned AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner
    FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM owned
"""


_FITS = " ".join(
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule}'"
    for _, rule in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])) for name, _, rest in [rule.partition("/")]
)
_VERDICTS = " ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for verdict, rule in URL_RULES)


def _strength_sql(level: str, mean: str, to: str) -> str:
    """A CTE with the prior observations of a level, by the method of moments, from 1 to 1000."""
    return f"""{to} AS (SELECT CASE WHEN k = 0 OR scale = 0 OR scale <= within OR (spread - within) / (scale - within) <= 1 / 1001.0 THEN 1000.0
        ELSE greatest(1.0, (scale - within) / (spread - within) - 1) END::DOUBLE AS k
    FROM (SELECT count(*) AS k, sum(n * (bad / n - {mean}) * (bad / n - {mean})) AS spread, sum({mean} * (1 - {mean})) AS within, sum(n * {mean} * (1 - {mean})) AS scale FROM {level} WHERE n > 0))"""


OP8_SQL = f"""
WITH urls AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), named AS (
    SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name, CASE {_FITS} END AS rule FROM urls
), outcome AS (
    SELECT name, count(*) AS n, sum(bad) AS bad FROM named JOIN (SELECT doc_id AS page_id, max((quality = 0)::INTEGER) AS bad FROM labels GROUP BY doc_id) USING (page_id) WHERE bad IS NOT NULL GROUP BY name
), labelled AS (
    SELECT name, string_split(name, '.') AS l, regexp_matches(name, '^[0-9.]+$|[\\[\\]:]') AS address FROM (SELECT DISTINCT name FROM named)
), own AS (
    SELECT name, coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad,
        CASE WHEN address THEN name ELSE array_to_string(l[-(size + 1):], '.') END AS domain, CASE WHEN address THEN name ELSE array_to_string(l[-size:], '.') END AS suffix
    FROM (SELECT *, CASE WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ({", ".join(f"'{x}'" for x in urlrep.SECOND_LEVEL)}) THEN 2 ELSE 1 END AS size FROM labelled) LEFT JOIN outcome USING (name)
), by_domain AS (
    SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM own GROUP BY suffix, domain
), whole AS (
    SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1) ELSE 0.5 END::DOUBLE AS mean FROM by_domain
), s0 AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS up FROM by_domain, whole GROUP BY suffix
), {_strength_sql("s0", "up", "ks")}, d0 AS (
    SELECT d.*, (s0.bad + k * up) / (s0.n + k) AS up FROM by_domain d JOIN s0 USING (suffix), ks
), {_strength_sql("d0", "up", "kd")}, h0 AS (
    SELECT own.*, (d0.bad + k * up) / (d0.n + k) AS up FROM own JOIN d0 USING (suffix, domain), kd
), {_strength_sql("h0", "up", "kh")}, judged AS (
    SELECT name, (bad + k * up) / (n + k) AS mean, n + k + 1 AS weight FROM h0, kh
)
SELECT page_id, host, path, rule, CASE {_VERDICTS} WHEN mean - 1.645 * sqrt(mean * (1 - mean) / weight) > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS reputation
FROM named JOIN judged USING (name)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op8_url_filter": OP8_SQL}
