"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, dedup, html_text, jaccard, pii, quality, sharding, toxicity, warc
from .common import documents, scratch_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(documents(spark, sf_dir), k=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), map_path=scratch_path(spark, "slot-map"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return warc.read_archive(spark, root).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.scan(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_ngram_jaccard_join,
        op2_exact_dedup,
        op3_sharding,
        op4_toxicity,
        op5_warc,
        op6_pii,
        op7_quality_classifier,
        op8_benchmark_decontamination,
        op9_html_extraction,
        op10_byte_level_bpe,
        pipeline,
    )
    return {f.__name__: f for f in own}


JACCARD_SQL = r"""
WITH RECURSIVE
w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
),
sh AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION
    SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY 1) c ON c.node = d.doc_id
"""

DEDUP_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _base32_sql(hex_digest: str) -> str:
    """Five hex digits at a time are four letters."""
    letters = []
    for i in range(8):
        value = f"('0x' || substr({hex_digest}, {5 * i + 1}, 5))::BIGINT"
        letters += [f"substr('{warc.ALPHABET}', ((({value}) >> {shift}) & 31)::INT + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


WARC_SQL = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
    FROM pages
)
SELECT page_id, payload_bytes, {_base32_sql("hex")} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": JACCARD_SQL, "op2_exact_dedup": DEDUP_SQL, "op5_warc": WARC_SQL}
