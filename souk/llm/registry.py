"""Contract queries of this package: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads its whole table, calls the operator and derives the digest
columns of its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import NAMES, scan, span_text

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["k"] < 3)

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long").alias(f"n_{NAMES[k]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import severity

    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
# hosts whose pages make up the list of canonical URLs
LISTED_HOSTS = r"(^|\.)(spam-farm|cheap-pills)\."


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge, url_parts

    pages = table(spark, sf_dir, "pages")
    host, _ = url_parts("url")
    listed = pages.where(host.rlike(LISTED_HOSTS)).select("url")
    return judge(pages, URL_RULES, listed)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import book_digest, code_text, product_codes, with_label_error

    coded, books = product_codes(table(spark, sf_dir, "embeddings"), scale=256, parts=16, entries=64, rounds=2)
    return with_label_error(coded).select(
        "vec_id", code_text("codes").alias("code"), "error", "label_error",
        F.lit(book_digest(books)).alias("codebooks_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10,
                    least_words=20, ngrams=1, buckets=10_000, seed=2024)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import labels_and_score, license_scan

    return labels_and_score(license_scan(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}
