"""From documents to training tokens: filter, dedup twice, mix, encode. Each stage works on all that the one before kept.

Null texts count as empty; they and empty texts are scored, are copies of each other, and give no tokens. Null keys rank last in both
dedups. Of repeated rows one stays. Columns beside those of documents pass through all stages but the last, also those that
have the name of a column that a stage makes. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.bpe import encode_documents
from flowlake.llm.common import table, written
from flowlake.llm.exact_dedup import exact_dedup
from flowlake.llm.mixing import mix
from flowlake.llm.simhash import near_dedup
from flowlake.llm.toxicity import THRESHOLD, score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labels outside of the held-out fold."""
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    own = {c: f"_own_{c}" for c in docs.columns}
    kept = score_documents(docs.withColumnsRenamed(own), model, text=own["text"]).filter(F.col("score") < THRESHOLD)
    return kept.select(*[F.col(name).alias(c) for c, name in own.items()])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to the case of A-Z, the row with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints over four-word shingles that differ in 4 bits at most, the row with the least doc_id stays."""
    return near_dedup(docs, words=4, bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of the ids and of what they decode to."""
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = coded.withColumns({"ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2("decoded", 256)})
    return coded.select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Trained models, fingerprints and rounding at random have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), release=True)
    return docs
