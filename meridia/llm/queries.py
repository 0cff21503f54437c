"""The registered queries opN_<name> over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary files are; a name is looked up in their package.
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, fold, quality_score, training_labels

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), quality_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmlcrf import main_text, trained

    pages = table(spark, sf_dir, "pages")
    text = pages.select("page_id", "url", main_text(trained(), pages, "html").alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import bounded_batches, text_or_empty
    from .media import read_back_column, sniff_column, store_column

    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"), store_column(text_or_empty("text")).alias("content"))
    # Declared by size alone, mostly wrongly: the type and length used come from sniffing.
    declared = F.when(F.col("n_bytes") % 2 == 0, F.lit("image/png")).otherwise(F.lit("application/octet-stream"))
    sniffed = stored.withColumn("sniffed", sniff_column(F.col("content"), declared))
    read = sniffed.withColumn("read", read_back_column(F.col("content"), F.col("sniffed.media_type"), F.col("sniffed.length")))
    return read.select("doc_id", "n_bytes", "read.payload_bytes", "read.payload_sha256", "read.tail_crc32", "read.media_bytes", "read.media_sha256", "read.feature", "sniffed.media_type", "sniffed.corrected", F.size("sniffed.embedded").alias("n_embedded"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_boilerplate

    out = drop_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import tokenise_to_shards

    return tokenise_to_shards(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack,
        "op2_warc": op2_warc,
        "op3_quality": op3_quality,
        "op4_html": op4_html,
        "op5_mix": op5_mix,
        "op6_simhash": op6_simhash,
        "op7_embeddings": op7_embeddings,
        "op8_media": op8_media,
        "op9_line_dedup": op9_line_dedup,
        "op10_tokens": op10_tokens,
    }


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS mix_key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS most FROM sizes),
ordered AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(most) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighted WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
limited AS (SELECT *, (total - most_before) * weight > most * (all_weight - weight_before) AS lim FROM ordered),
shared AS (SELECT *, total - coalesce(sum(CASE WHEN lim THEN most END) OVER (), 0) AS left_over, sum(CASE WHEN NOT lim THEN weight END) OVER () AS free_weight FROM limited),
targets AS (SELECT source, source_size, CASE WHEN lim THEN most ELSE left_over * weight / free_weight END AS target FROM shared),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY mix_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized)
SELECT r.doc_id, r.size, e.source_size, e.target,
       CAST(r.size * (e.epochs + CASE WHEN 2 * r.upto - r.size <= 2 * (e.target - e.epochs * e.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running r JOIN epochs e ON r.source IS NOT DISTINCT FROM e.source
"""

OP9_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
lines AS (SELECT rid, source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM split),
counts AS (SELECT source, line, count(*) AS pages FROM lines GROUP BY source, line HAVING count(*) >= 3),
boiler AS (SELECT c.source, list(c.line) AS dropped FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.pages > t.host_pages * CAST(0.05 AS DOUBLE) GROUP BY c.source),
kept AS (
  SELECT s.doc_id, s.text, s.lines, list_filter(s.lines, lambda x: NOT list_contains(coalesce(b.dropped, []), trim(x, ' '))) AS stay
  FROM split s LEFT JOIN boiler b ON s.source IS NOT DISTINCT FROM b.source),
done AS (SELECT doc_id, text, lines, stay, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS kept_text FROM kept)
SELECT doc_id, coalesce(CAST(len(lines) AS BIGINT), 0) AS n_lines, coalesce(CAST(len(lines) - len(stay) AS BIGINT), 0) AS n_dropped,
       CAST(length(kept_text) AS BIGINT) AS kept_chars, md5(kept_text) AS kept_md5
FROM done
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mix": OP5_SQL, "op9_line_dedup": OP9_SQL}
