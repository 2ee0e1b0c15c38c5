"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, hnsw, language_id, line_dedup, ngram_join, packing, pipeline, quality, secret_scan, substring_dedup, url_rules
from .parameters import QUALITY_THRESHOLD, table, tokenizer_path


def sha(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


#: Production parameters of op2: the listed rules, longest first wins.
LISTED_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def url_rule_set() -> list[url_rules.UrlRule]:
    return [url_rules.domain_rule(*r) for r in LISTED_RULES] + url_rules.own_rules()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", sha("kept").alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rule_set()).select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024, end_id=0)
    return out.select("doc_id", "start", "length", packing.crc32_column("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hnsw.sound_vectors(table(spark, sf_dir, "embeddings"))
    return hnsw.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10).select("query_id", "rank", "vec_id", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", sha("kept").alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("assign", "access", "hex")
    return s.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(secret_scan.joined(*map(F.col, base)).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(*map(F.col, secret_scan.KINDS)).alias("spans"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), percent=75, shingle=5).select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per benchmark item that a document holds."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.75)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify_language(docs, language_id.train_language(docs))
    return out.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL["op1_substring_dedup"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
wins AS MATERIALIZED (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM wins GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM wins JOIN firsts USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, (SELECT unnest(range(0, 50)) AS k)),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

_HOST = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LISTED = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in LISTED_RULES)
_HOST_WORDS, _ENDINGS = "|".join(url_rules.HOST_WORDS), "|".join(url_rules.FILE_ENDINGS)
_PLACES = " OR ".join(f"regexp_matches(host || '#' || path, '{p[1]}')" for p in url_rules.PLACES)

SQL["op2_url_filter"] = rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed(action, h, p) AS (VALUES {_LISTED}),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN regexp_matches(host, '(^|[.-])({_HOST_WORDS})([.-]|$)') OR regexp_matches(path, '\.({_ENDINGS})$') OR {_PLACES} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

SQL["op6_line_dedup"] = r"""
WITH lines AS MATERIALIZED (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS MATERIALIZED (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (k) GROUP BY doc_id
"""


SQL["op8_ngram_join"] = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS g FROM d),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN size USING (doc_id) GROUP BY d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(own, key=lambda f: int(f.__name__[2:].split("_")[0]))} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)  # none for the pipeline: pipeline.ORACLE_SQL is None
