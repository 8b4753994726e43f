"""Training-data pipeline over ``documents`` (part of the ``llm`` subpackage).

Five stages, each on all rows its predecessor kept:

1. toxicity: documents that the severity model rejects go;
2. SimHash near-duplicates: one document of each group stays;
3. secrets: every reported span is masked, all documents stay;
4. mixing: each document appears as often as the source mix takes it;
5. packing: the pieces of all documents with their place in a sequence.

All stages but the last return the columns of ``documents``. The first depends on a learned
model and the last on a tokenizer, so SQL cannot express the whole; ``tests/llm`` runs the
pipeline on a small corpus and compares every stage's rows with a plain Python version.

Defined results: null and empty texts, and texts without words, are not toxic; together they
are one group of near-duplicates, of which one document stays; they hold no secrets (a null
text stays null, with a null ``n_chars``), are taken as often as the certain copies of their
source, and are packed as the end token alone. Repeated rows of an id are near-duplicates of
each other; a null id stays behind all others of its group. Without labels of both classes no
document goes in the first stage. An empty table gives no rows; extra columns are carried by
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm.common import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from souk.llm.toxicity import reject_toxic as reject

    return reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from souk.llm.simhash import simhash_dedup

    return simhash_dedup(docs, shingle=3, radius=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from souk.llm.secret_scan import redact

    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from souk.llm.mixing import mixed_documents

    return mixed_documents(docs, weights=(1, 2, 3), cap=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from souk.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
