"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddup, htmltext, langid, lm, mixing, neardup, quality, secrets, tokencount
from .common import id_remainder, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    held_out = id_remainder("id", 7) == 2
    return lm.score(rows, lm.fit(rows, ~held_out), {"held_out": held_out})


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.zipf_vocabulary())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddup.link_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(id_remainder("doc_id", 3) != 1))
    return quality.score(docs, model, keep={"held_out": id_remainder("doc_id", 3) == 1})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_remainder("doc_id", 4) != 2))
    return langid.identify(docs, model, keep={"held_out": id_remainder("doc_id", 4) == 2})


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs)
    return mixed.select("row.doc_id", "row.source", F.col("mix.tokens").alias("n_tokens"), "mix.rate", "mix.copies")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def contract_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``op1_decontaminate``: all but the proximity matches."""
    return op1_decontaminate(spark, sf_dir).drop("n_near")


def contract_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``op2_lm_scores``: counts, and the base in thousandths."""
    return op2_lm_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round(F.col("base_score") * 1000).cast("long").alias("base_milli"))


def contract_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``op10_secret_scan``: the counts of base spans, whose places it has no function for."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_lm_scores, op3_near_duplicates, op4_token_counts, op5_html_text, op6_embedding_near_duplicates, op7_quality, op8_language_id, op9_mix_sources, op10_secret_scan, contract_decontaminate, contract_lm_base, contract_secret_counts)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(s[k]) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
ORACLE_SQL: dict[str, str] = {
    "contract_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + 12], ' ') AS win FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(k) WHERE len(w) > 0),
        dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT * FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n), unnest(range(1, len(w) - n + 2)) t(k)),
        hit AS (SELECT doc_id, COUNT(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, n FROM dw JOIN (SELECT DISTINCT win, n FROM iw) USING (win, n)), unnest(range(0, n)) u(j) GROUP BY doc_id),
        item AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM dw JOIN iw USING (win, n)) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "contract_lm_base": rf"""
        WITH t AS (SELECT doc_id, {_CRC32} % 7 = 2 AS held_out, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
        tokens AS (SELECT doc_id, held_out, unnest(list_append(w, ' end')) AS x FROM t), c AS (SELECT x, COUNT(*) AS c FROM tokens WHERE NOT held_out GROUP BY x), n AS (SELECT SUM(c) AS total, COUNT(*) AS different FROM c)
        SELECT doc_id, held_out, COUNT(*) AS n_tokens, COUNT(c) AS n_known, CAST(MAX(total) AS BIGINT) AS train_tokens, CAST(ROUND(SUM(log10((coalesce(c, 0) + 1) / (total + different + 1))) * 1000) AS BIGINT) AS base_milli
        FROM tokens LEFT JOIN c USING (x), n GROUP BY doc_id, held_out""",
    "op6_embedding_near_duplicates": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT vec_id, (SELECT COUNT(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT MIN(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id, vec_id = least(vec_id, coalesce((SELECT MIN(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
        FROM v""",
    "contract_secret_counts": rf"""
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '{_ANY_CASE}["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
            CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}
