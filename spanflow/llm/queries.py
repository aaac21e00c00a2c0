"""One query for each operator over its whole table, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, exact, html, language, licenses, lines, media, mixing, near, packing, quality, repair
from .common import tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n_bytes"), text.alias("payload"))
    made = media.fingerprint(docs)
    pairs = F.concat_ws(",", F.transform(F.arrays_zip("pair_time", "pair_code"), lambda x: F.concat_ws(":", x["pair_time"], x["pair_code"])))
    return made.select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.length("wav").cast("long").alias("media_bytes"),
        F.sha2("wav", 256).alias("media_sha256"),
        F.concat_ws("-", F.size("pair_code"), F.hex(F.xxhash64(pairs))).alias("feature"),
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs.select("doc_id", "lang"), "lang", columns=["doc_id", "source"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_substrings(_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.col("spans.start").alias("starts"),
        F.col("spans.end").alias("ends"),
        F.col("spans.first_doc").alias("first_docs"),
        "n_removed",
        F.length("text").cast("long").alias("n_kept"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify_language(docs, language.train_language(docs))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history is the lower half of the range of ids."""
    docs = _table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return exact.exact_dedup_at(docs, F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), size=3, similarity=0.85)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of number -1 whose texts are control strings."""
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return chat.checked_format(own.unionByName(spark.createDataFrame(extra, own.schema)))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    made = (
        op1_quality_classifier, op2_html_extraction, op3_media_columns, op4_source_mixing, op5_substring_dedup, op6_packing, op7_language_id,
        op8_exact_dedup, op9_minhash_near_dedup, op10_license_scan, op11_centroid_clustering, op12_chat_formatting, op13_structure_repair,
    )
    return {f.__name__: f for f in made}


def _clustering_sql() -> str:
    """The rounds written out one after the other: every vector against every centroid, whole-number arithmetic."""
    first = f"""WITH kept AS (
        SELECT vec_id, [CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMS}),
      c0 AS (SELECT row_number() OVER (ORDER BY rank) - 1 AS k, v AS c FROM (
        SELECT sha256('{centroids.SEED}:' || vec_id) AS rank, v FROM kept ORDER BY rank LIMIT {centroids.CLUSTERS}))"""
    away = f"list_sum([CAST((v[i] - c[i]) * (v[i] - c[i]) AS BIGINT) FOR i IN range(1, {centroids.DIMS + 1})])"

    def nearest(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, v, best.k AS k, best.d AS d FROM (
        SELECT vec_id, v, min({{'d': CAST({away} AS BIGINT), 'k': k}}) AS best FROM kept, c{r} GROUP BY vec_id, v))"""

    steps = [first]
    for r in range(centroids.ROUNDS):
        steps += [nearest(r), f"""m{r} AS (SELECT k, list(m ORDER BY i) AS c FROM (
        SELECT k, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, {centroids.DIMS + 1}) t(i) GROUP BY k, i) GROUP BY k)""",
        f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))"]
    last = centroids.ROUNDS
    return ", ".join([*steps, nearest(last)]) + f"""
      SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (k)"""


def _chat_sql() -> str:
    """Whole texts, without tokens; the marks' lengths as the template has them."""
    like = r"<\\*(<SYS>>|</SYS>>|s>|/s>|\|endoftext\|>)|\[\\*(INST|/INST|OUT|ROLE|TEXT)\]"
    escaped = lambda x: f"length({x}) + len(regexp_extract_all({x}, '{like}'))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
      o AS (SELECT *, {escaped("text")} + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 9
        ELSE 16 + {escaped("role")} END AS chars FROM t)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_centroid_clustering": _clustering_sql(),
        "op12_chat_formatting": _chat_sql(),
        "op8_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)
        """,
    }
