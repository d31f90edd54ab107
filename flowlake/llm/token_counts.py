"""Token counts through a two-tier lookup on the map side, without any shuffle of pre-tokens.

Tier one is a broadcast hash table of the token lengths of frequent pre-tokens, at most ``TABLE`` entries; it is taken from a
bounded sample of documents, and what is in it changes no result. Tier two is a worker's own cache: pre-tokens that the table
lacks are encoded by the library in one batch and remembered. Texts are first split at the strings of added tokens, each of
which is one token, as the library does by default.

Defined cases: null is the empty text (0 tokens, 0 bytes); further columns stay; repeated rows are counted each; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowlake.llm.common import small_batches, table
from flowlake.llm.pretokens import Pretokens

#: Documents whose pre-tokens make the broadcast table, on average, and its largest number of entries.
SAMPLE = 3000
TABLE = 65_536
#: Different text parts, and different pre-tokens, that a worker remembers before it starts anew.
CACHE = 250_000


def _unassigned() -> np.ndarray:
    """By code point: unknown to this Python. Libraries of other Unicode versions may sort them as letters or not."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


class Lengths:
    """Token counts of texts in one worker."""

    def __init__(self, path: str, pattern: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            added = [token["content"] for token in json.load(file)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pretokens, self.unknown = Pretokens(pattern), _unassigned()
        self.frequent, self.rare, self.known = frequent, {}, {}

    def _encode(self, words: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _odd(self, text: str) -> bool:
        return bool(self.unknown[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())

    def counts(self, texts: list[str]) -> list[int]:
        for cache in (self.rare, self.known):
            if len(cache) > CACHE:
                cache.clear()
        extra, cuts = [], []
        for text in texts:
            parts = self.added.split(text) if self.added else [text]
            extra.append(len(parts) - 1)
            cuts.append([cut for part in parts if part for cut in self.pretokens.cuts(part)])
        new = set().union(*cuts).difference(self.known)
        if self._odd("".join(new)):
            odd = [cut for cut in new if self._odd(cut)]
            self.known.update(zip(odd, self._encode(odd), strict=True))
            new.difference_update(odd)
        words = {cut: self.pretokens.split(cut) for cut in new}
        frequent, rare = self.frequent, self.rare
        missing = [w for w in set().union(*words.values()) if w not in frequent and w not in rare]
        rare.update(zip(missing, self._encode(missing), strict=True))
        for cut, parts in words.items():
            self.known[cut] = sum([frequent.get(w) or rare[w] for w in parts])
        return [n + sum(map(self.known.__getitem__, parts)) for n, parts in zip(extra, cuts, strict=True)]


def frequent_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text", sample: int = SAMPLE) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of a bounded sample."""
    rows = max(1, docs.count())
    some = docs.select(docs[text].alias("_text")).sample(fraction=min(1.0, sample / rows), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Pretokens(pattern).split, Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(split(value or ""))
        words, counts = zip(*seen.most_common(TABLE), strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for word, n in some.mapInArrow(run, "word string, n long").toLocalIterator():
        seen[word] += n
    words = [word for word, _ in seen.most_common(TABLE)]
    return dict(zip(words, Lengths(path, pattern, {})._encode(words), strict=True))


_WORKER: dict[tuple, Lengths] = {}


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The documents with ``n_bytes`` and ``n_tokens``; the text goes."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, pattern, text))
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "n_tokens")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = (path, pattern, id(shared.value))
        if which not in _WORKER:
            _WORKER.clear()
            _WORKER[which] = Lengths(path, pattern, shared.value)
        for batch in batches:
            texts = [value or "" for value in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array([len(value.encode()) for value in texts], pa.int64()),
                    pa.array(_WORKER[which].counts(texts), pa.int64()),
                ],
                [*names, "n_bytes", "n_tokens"],
            )

    return docs.select(*names, docs[text].alias("_text")).mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", counted.n_tokens > 512)
