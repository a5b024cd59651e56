"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import load
from logloom.llm.merkle_sql import merkle_sql


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.neighbours import nearest_neighbours

    return nearest_neighbours(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.decontaminate import find_leaks

    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.quality import classify

    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.mixing import mix_documents

    return mix_documents(load(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.licenses import scan_licenses

    return scan_licenses(load(spark, sf_dir, "documents")).drop("found")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.urls import judge_urls, rule_table

    judged = judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.secrets import scan_secrets

    found = scan_secrets(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.simhash import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"), width=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.substrings import remove_repeats

    cut = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.toxicity import toxicity

    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.whitening import whiten

    return whiten(load(spark, sf_dir, "embeddings"))


def op12_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.sharding import shard

    return shard(load(spark, sf_dir, "documents"), 40, law="rows").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.merkle import merkle_proofs

    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return merkle_proofs(load(spark, sf_dir, "documents"), cut, F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/de/8', 'com/en/', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM fit
"""


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS j FROM g JOIN f ON g.s = f.s WHERE f.m < g.doc_id),
l AS (SELECT doc_id, list(j) AS js FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w) AS n, coalesce(len(l.js), 0) AS x,
  list_filter(d.w, lambda v, i: l.js IS NULL OR NOT list_contains(l.js, i)) AS kept FROM d LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(x AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op13_merkle_proofs": merkle_sql()}
