"""The corpus pipeline: documents in, token ids of a clean, deduplicated and mixed corpus out.

Each stage is written as Parquet in the shared scratch folder and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, minhash, mixing, quality, secrets
from tessera.llm.common import materialize, scratch_path, table


#: Setting with the folder of the secrets ledger; where it is unset a run begins with an empty one.
LEDGER = "spark.tessera.secrets.ledger"


def drop_bad_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: what the classifier rejects goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each class stays, that with the least id."""
    return minhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: found secrets are replaced in the texts. The ledger of scanned blobs is kept where ``LEDGER`` says, so that a later run scans only what is new."""
    return secrets.redact_documents(docs, spark.conf.get(LEDGER, None) or scratch_path(spark, "pipeline-ledger"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids (little-endian unsigned 32-bit), their number and hash."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_bad_documents),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: SQL can express none of the classifier, the sampled signatures and the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def written(docs: DataFrame) -> DataFrame:
    return materialize(docs, "pipeline-stage")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
