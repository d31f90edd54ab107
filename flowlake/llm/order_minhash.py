"""Order MinHash fingerprints, which are sensitive to edit distance.

Each k-mer of code points is numbered by its occurrence. For each of ``SKETCHES`` hash functions the ``LENGTH`` k-mers of least
hash are taken, put back into text order, and hashed as a tuple: two texts agree on a tuple only if they share the k-mers and
their order. The likeness of two fingerprints is the share of tuples that agree.

``with_fingerprints`` is narrow. ``with_next`` looks at each document's successor by key: documents are dealt by ranges of the
key to sorted buckets, one shuffle of the texts, and the first document of a bucket is also sent to the bucket before it, so no
order over all rows is needed in one place. The ranges come from a sample of keys and change no result.

Defined cases: null is the empty text, whose fingerprint is that of no k-mers; a text shorter than k is one k-mer; fewer
k-mers than a tuple has make a shorter tuple; null keys come first; rows that share a key are ordered by text; a single
document is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import small_batches, table, text_of

K, LENGTH, SKETCHES = 8, 2, 64
#: K-mers that all hash functions see at once.
BLOCK = 16_384
#: Buckets for each shuffle partition, and fewest rows of a bucket.
BUCKETS, ROWS = 8, 256
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_random = np.random.RandomState(20_011)
_TIMES = (_random.randint(0, 2**31, SKETCHES).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PLUS = _random.randint(0, 2**32, SKETCHES, dtype=np.uint64).astype(np.uint32)[:, None]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def numbered_kmers(text: str) -> np.ndarray:
    """64-bit hashes of the k-mers with their occurrence numbers, in text order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(points):
        return points
    size = min(K, len(points))
    h = np.zeros(len(points) - size + 1, np.uint64)
    for k in range(size):
        h = h * _BASE + points[k : k + len(h)]
    h = _mixed(h)
    n = len(h)
    if n < 1 << 24:  # sort by the upper bits, then by position
        ordered = np.sort((h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64))
        place, group = (ordered & np.uint64(0xFFFFFF)).astype(np.int64), ordered >> np.uint64(24)
    else:
        place = np.argsort(h, kind="stable")
        group = h[place]
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    number = np.empty(n, np.uint64)
    number[place] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(number == 0, h, _mixed(h + number * _BASE))


def fingerprint(text: str) -> np.ndarray:
    """One 32-bit number for each hash function."""
    kmers = numbered_kmers(text)
    out = np.arange(SKETCHES, dtype=np.uint64) * _BASE
    if len(kmers):
        low = (kmers >> np.uint64(16)).astype(np.uint32)
        values = np.zeros((SKETCHES, 0), np.uint32)
        places = np.zeros((SKETCHES, 0), np.int64)
        every = np.arange(SKETCHES)
        for begin in range(0, len(low), BLOCK):
            hashed = (low[None, begin : begin + BLOCK] ^ _PLUS) * _TIMES
            for _ in range(min(LENGTH, hashed.shape[1])):
                least = hashed.argmin(1)
                values = np.column_stack((values, hashed[every, least]))
                places = np.column_stack((places, least + begin))
                hashed[every, least] = np.uint32(0xFFFFFFFF)
            if values.shape[1] > LENGTH:
                best = np.argsort(values, axis=1, kind="stable")[:, :LENGTH]
                values, places = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
        for column in np.sort(places, axis=1).T:
            out = _mixed(out * _BASE + kmers[column])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(prints: np.ndarray) -> str:
    return prints.astype(">u4").tobytes().hex()


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their ``fingerprint``, as hexadecimal text."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "fingerprint"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_text(fingerprint(value or "")) for value in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prints, pa.string())], [*names, "fingerprint"])

    return docs.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField("fingerprint", T.StringType())]))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    n = rows.count()
    buckets = max(1, min(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS))
    sampled = rows.select("key").filter("key IS NOT NULL").sample(min(1.0, 20 * buckets / max(1, n)), seed=11).distinct()
    keys = sorted(row["key"] for row in sampled.collect())  # some 20 for each bucket
    starts = [keys[len(keys) * k // buckets] for k in range(1, buckets)] if len(keys) > buckets else []
    starts = sorted(set(starts))
    n_null, least = rows.agg(F.count_if(F.col("key").isNull()), F.min("key")).first()

    @F.pandas_udf("array<int>")
    def places(values: pd.Series, nulls: pd.Series) -> pd.Series:
        """The bucket of a key; that of the one before, where the key starts a bucket; the last, where it is the first of all."""
        out = []
        for value, none in zip(values, nulls, strict=True):
            bucket = 0 if none else bisect_right(starts, value)
            ahead = [bucket - 1] if bucket and value == starts[bucket - 1] else []
            ahead += [len(starts)] if (none if n_null else not none and value == least) else []
            out.append([bucket, *(-1 - b for b in ahead)])  # negative: only looked at
        return pd.Series(out)

    # a series of long keys with a null among them would turn into floats: nulls go as a column of their own
    filled = F.coalesce(F.col("key"), F.lit(0).cast(docs.schema[key].dataType))
    dealt = rows.withColumn("place", F.explode(places(filled, F.col("key").isNull())))
    dealt = dealt.withColumns({"ahead": F.col("place") < 0, "bucket": F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))})
    dealt = dealt.select("key", "text", "ahead", "bucket").repartition("bucket").sortWithinPartitions("bucket", "ahead", F.asc_nulls_first("key"), "text")
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_chars", T.LongType()),
            *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
            *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")),
        ]
    )
    arrow_types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, None
        for batch in batches:
            key_type, done = batch.schema.field("key").type, []
            columns = (batch.column(c).to_pylist() for c in ("key", "text", "ahead", "bucket"))
            for name, value, ahead, at in zip(*columns, strict=True):
                if at != bucket:
                    bucket, held = at, None
                if ahead and held is None:
                    continue
                prints = fingerprint(value)
                if held is not None:
                    name0, value0, prints0 = held
                    edited = _edited(value0, value)
                    other = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    near = likeness(prints0, other), likeness(prints0, prints)
                    done.append((name0, len(value0), sha, as_text(prints0), as_text(other), *near))
                held = None if ahead else (name, value, prints)
            columns = list(zip(*done, strict=True)) if done else [[] for _ in schema.names]
            types = [key_type, *arrow_types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return dealt.mapInArrow(run, schema)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
