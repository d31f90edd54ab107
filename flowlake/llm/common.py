"""Reading tables, writing intermediate ones, and the text rules that several operators share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space between words.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows of an Arrow batch; with whole texts in them, batches stay at some megabytes.
BATCH_ROWS = 1000
#: Spark's setting that removes a query's shuffle files when the query has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, release: bool = False) -> DataFrame:
    """The frame as a table in the shared folder: it is computed once, and a lost executor takes nothing with it.

    ``release`` drops the shuffle files of this one job as soon as the table stands.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/flowlake-llm-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true" if release else before)
    try:
        frame.write.parquet(folder)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(frame.schema).parquet(folder)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that where every character is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACES), "")).cast("long")


def in_fold(key: str, parts: int, fold: int) -> Column:
    """Whether crc32 of the key's text leaves ``fold``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == fold, F.lit(False))


def give_back() -> None:
    """What a worker has freed goes back to the system; Arrow and the C library would keep it while the worker waits for tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)
