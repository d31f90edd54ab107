"""Language-model scoring with Brown class-based bigrams.

P(text) is the product over tokens of P(class | class before) and P(word | class). Classes come from exchange clustering: each
type moves to the class that raises the likelihood of the training bigrams most. The ``TYPES`` most frequent words are types of
their own; all other words are types by their ending (``ENDINGS`` of them), so each word of any vocabulary has a class that was
found by exchange, and the bigram table stays bounded by the square of the number of types. Counts cover all training rows.

A round of the exchange is distributed: the bigram table is kept twice, dealt by first and by second type, tasks sum it into the
neighbour classes of each type, and the driver makes one sweep over types with that bounded matrix (types x ``CLASSES``). Of
``ROUNDS`` rounds the classes of highest likelihood are kept.

Smoothing: transitions are mixed with class shares (``ALPHA`` virtual counts). A word of an ending is (count - D) / ending's count,
and what the discount D frees, D * different words / count, is the probability of an unknown word with that ending; so known
words and the unknown words of each ending sum to one.

Scoring looks words up in two tiers: ``LOOKUP`` words of highest count are broadcast, the rest of a document's words meet the
full count table by a shuffle, in one row per document and word.

Defined cases: null is the empty text, which is the end token alone; rows with a null key are training rows; repeated rows are
scored each (and counted each); without training rows all words are unknown; an empty table gives an empty result; further
columns stay.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import in_fold, small_batches, table, text_of, written

TYPES, ENDINGS, CLASSES = 4096, 512, 64
#: Letters of an ending, in bytes.
ENDING = 3
LOOKUP = 262_144
ROUNDS = 4
ALPHA = 20.0
#: Different words, or bigrams, that a task sums before it sends them on.
HELD, HELD_PAIRS = 300_000, 4_000_000
END = b"\n"  # holds white space, so no word is equal to it


def tokens_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*text.encode().lower().split(), END]


def ending_of(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % ENDINGS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            words = list(seen)
            arrays = [pa.array(words, pa.binary()), pa.array(map(ending_of, words), pa.int32()), pa.array(seen.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["word", "ending", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(tokens_of(value or ""))
            if len(seen) > HELD:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    counts = texts.mapInArrow(run, "word binary, ending int, n long")
    return counts.groupBy("word", "ending").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words known to every task: their counts, types, and what each type holds."""

    def __init__(self, words: list[bytes], counts: list[int], ending_words: np.ndarray, ending_counts: np.ndarray, discount: float):
        order = sorted(range(len(words)), key=lambda k: (words[k] != END, -counts[k], words[k]))
        self.words = [words[k] for k in order]
        self.counts = np.array([counts[k] for k in order], np.int64)
        if not self.words or self.words[0] != END:
            self.words, self.counts = [END, *self.words], np.append(0, self.counts)
        self.n_types = min(TYPES, len(self.words))
        endings = np.array([ending_of(w) for w in self.words], np.int64)
        self.types = np.where(np.arange(len(self.words)) < self.n_types, np.arange(len(self.words)), self.n_types + endings)
        own = endings[: self.n_types][self.counts[: self.n_types] > 0]
        size = self.counts[: self.n_types][self.counts[: self.n_types] > 0]
        self.ending_words = ending_words - np.bincount(own, minlength=ENDINGS)
        self.ending_counts = ending_counts - np.bincount(own, size, minlength=ENDINGS).astype(np.int64)
        self.discount = discount
        self.type_counts = np.append(self.counts[: self.n_types], self.ending_counts).astype(float)

    def rare_log(self, count: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """log10 P(word | ending) of known words."""
        return np.log10(count - self.discount) - np.log10(np.maximum(self.ending_counts[ending], 1))

    def unknown_log(self) -> np.ndarray:
        """log10 P(unknown | ending)."""
        some = self.ending_counts > 0
        share = self.discount * self.ending_words / np.maximum(self.ending_counts, 1)
        return np.where(some, np.log10(np.where(some, share, 1.0)), 0.0)


class Typed:
    """Words to places in the vocabulary and to types, in one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.place = {word: k for k, word in enumerate(vocabulary.words)}
        self.types, self.n_types = vocabulary.types, vocabulary.n_types

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        places = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        types = self.types[places]
        for k in np.flatnonzero(places < 0).tolist():
            types[k] = self.n_types + ending_of(words[k])
        return places, types


def type_bigrams(texts: DataFrame, shared, n: int) -> DataFrame:
    """(a, b, n): how often type b follows type a; an end stands before each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = Typed(shared.value)

        def rows(codes: list[np.ndarray]) -> pa.RecordBatch:
            code, times = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
            arrays = [pa.array((code // n).astype(np.int32)), pa.array((code % n).astype(np.int32)), pa.array(times.astype(np.int64))]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "n"])

        codes: list[np.ndarray] = []
        for batch in batches:
            words = [END]
            for value in batch.column(0).to_pylist():
                words += tokens_of(value or "")
            _, types = typed(words)
            codes.append(types[:-1] * n + types[1:])
            if sum(map(len, codes)) > HELD_PAIRS:
                yield rows(codes)
                codes = []
        yield rows(codes)

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _neighbours(pairs: DataFrame, of: str, other: str, classes: np.ndarray) -> np.ndarray:
    """By type and class: how often the ``other`` of a pair is in the class. Pairs are dealt by ``of``, so each sum is one task's."""
    n = len(classes)
    shared = pairs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * CLASSES)
        for batch in batches:
            mine, next_to, times = (batch.column(c).to_numpy() for c in (of, other, "n"))
            total += np.bincount(mine * np.int64(CLASSES) + shared.value[next_to], times, n * CLASSES)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    got = pairs.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * CLASSES)  # types x classes, whatever the corpus
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(n, CLASSES)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def sweep(classes: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """One exchange sweep. ``before``/``after``: by type, how often each class stands before/after it. Class 0 is the end's own."""
    classes = classes.copy()
    joint = np.zeros((CLASSES, CLASSES))
    np.add.at(joint, classes, before)
    joint = joint.T.copy()  # joint[c, d]: d follows c
    sizes = np.bincount(classes, counts, CLASSES)
    moved = 0
    for w in np.argsort(-counts, kind="stable").tolist():
        a = classes[w]
        if a == 0 or not counts[w]:
            continue
        left, right, own = before[w].copy(), after[w].copy(), itself[w]
        left[a], right[a] = left[a] - own, right[a] - own
        joint[:, a] -= left
        joint[a, :] -= right
        joint[a, a] -= own
        np.maximum(joint, 0, out=joint)
        sizes[a] -= counts[w]
        known = _f(joint)
        column, row = _f(joint + np.maximum(left, 0)[:, None]) - known, _f(joint + np.maximum(right, 0)[None, :]) - known
        corner = joint.diagonal()
        gain = column.sum(0) - column.diagonal() + row.sum(1) - row.diagonal()
        gain += _f(corner + np.maximum(left + right, 0) + own) - _f(corner) - 2 * (_f(sizes + counts[w]) - _f(sizes))
        gain[0] = -np.inf
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        joint[:, b] += left
        joint[b, :] += right
        joint[b, b] += own
        sizes[b] += counts[w]
        classes[w] = b
        moved += b != a
    return classes, moved


class ClassModel:
    """log10 of class transitions and of types in their classes."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray, joint: np.ndarray):
        counts = vocabulary.type_counts
        soft = counts + np.where(np.arange(len(counts)) < vocabulary.n_types, 0.0, 0.5)
        soft[0] += 0.5
        sizes = np.bincount(classes, soft, CLASSES)
        self.classes = classes
        self.emission = np.log10(np.maximum(soft, 1e-300)) - np.log10(sizes[classes])
        share = np.where(sizes > 0, sizes, 0.0) / sizes.sum()
        before = joint.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):  # an empty class is never entered
            self.transition = np.log10((joint + ALPHA * share[None, :]) / (before + ALPHA))


def train(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Vocabulary, ClassModel, int, int, int]:
    """Count table, vocabulary, classes, tokens N, different tokens V, and the count from which words are broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text_of(text).alias("text"))
    counts = written(word_counts(texts))
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    # the least count that at most LOOKUP words reach; the window runs over the different counts
    hist = written(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")))
    reach = hist.withColumn("reached", F.sum("words").over(W.orderBy(F.desc("n"))))
    least = reach.filter(F.col("reached") <= LOOKUP).agg(F.min("n")).first()[0] or (1 << 62)
    top = counts.filter(F.col("n") >= least).select("word", "n").toArrow()  # LOOKUP words at most
    by_ending = counts.groupBy("ending").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()  # ENDINGS rows
    ending_words, ending_counts = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for row in by_ending:
        ending_words[row["ending"]], ending_counts[row["ending"]] = row["words"], row["n"]
    once, twice = (next((r["words"] for r in hist.filter(F.col("n") == k).collect()), 0) for k in (1, 2))
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    vocabulary = Vocabulary(top.column("word").to_pylist(), top.column("n").to_pylist(), ending_words, ending_counts, discount)

    n_types = len(vocabulary.type_counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    first = written(type_bigrams(texts, shared, n_types).repartition("a"))
    second = written(first.repartition("b"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    itself = np.zeros(n_types)
    for row in first.filter("a = b").select("a", "n").collect():  # a row for each type
        itself[row["a"]] = row["n"]
    counts_of = vocabulary.type_counts
    ranks = np.argsort(np.argsort(-counts_of, kind="stable"), kind="stable")
    classes = 1 + ranks % (CLASSES - 1)
    classes[0] = 0
    best = None
    for left in range(ROUNDS, -1, -1):
        after = _neighbours(first, "a", "b", classes)
        joint = np.zeros((CLASSES, CLASSES))
        np.add.at(joint, classes, after)
        value = _f(joint).sum() - 2 * _f(joint.sum(1)).sum()  # log likelihood but for a constant
        if best is None or value > best[0]:
            best = (value, classes, joint)
        if left:
            before = _neighbours(second, "b", "a", classes)
            classes, _ = sweep(classes, before, after, itself, before.sum(1))
    small_batches(spark)
    return counts, vocabulary, ClassModel(vocabulary, best[1], best[2]), int(n_tokens), int(n_words), least


def score(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """The documents without their text, with n_tokens, n_known, train_tokens, base_score and score."""
    counts, vocabulary, classes, n_train, n_words, least = model
    spark = docs.sparkSession
    small_batches(spark)
    added = ("row", "n_tokens", "known", "base", "log_p", "rare", "n_known", "train_tokens", "base_score", "score")
    kept = [f for f in docs.schema.fields if f.name not in (text, *added)]
    names = [f.name for f in kept]
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.IntegerType()), T.StructField("unknown", T.DoubleType())]))
    schema = T.StructType(
        [
            *kept,
            *(T.StructField(c, T.LongType()) for c in ("row", "n_tokens", "known")),
            *(T.StructField(c, T.DoubleType()) for c in ("base", "log_p")),
            T.StructField("rare", rare),
        ]
    )
    shared = spark.sparkContext.broadcast((vocabulary, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, model = shared.value
        typed = Typed(words_known)
        size = words_known.counts
        log_count, unknown = np.log10(size + 1.0), words_known.unknown_log()
        endings = words_known.types - words_known.n_types
        rare_log = np.where(endings >= 0, words_known.rare_log(np.maximum(size, 1), np.maximum(endings, 0)), 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            words, ends = [], []
            for value in batch.column("_text").to_pylist():
                words += tokens_of(value or "")
                ends.append(len(words))
            places, types = typed(words)
            starts = np.array([0, *ends[:-1]])
            doc = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
            found = places >= 0
            group = model.classes[types]
            before = np.append(0, group[:-1])  # the end's class stands before each text, and the last token is an end
            log_p = model.transition[before, group] + model.emission[types] + np.where(found, rare_log[places], 0.0)
            met = Counter(zip(doc[~found].tolist(), [words[k] for k in np.flatnonzero(~found).tolist()], strict=True))
            owners = np.fromiter((d for d, _ in met), np.int64, len(met))
            order = np.argsort(owners, kind="stable")
            missed = [w for _, w in met]
            missed = [missed[k] for k in order.tolist()]
            structs = pa.StructArray.from_arrays(
                [
                    pa.array(missed, pa.binary()),
                    pa.array(np.fromiter(met.values(), np.int32, len(met))[order]),
                    pa.array(unknown[np.fromiter(map(ending_of, missed), np.int64, len(missed))]),
                ],
                ["word", "k", "unknown"],
            )
            offsets = np.append(0, np.cumsum(np.bincount(owners, minlength=len(ends)))).astype(np.int32)
            sums = lambda x: pa.array(np.add.reduceat(x, starts))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array(row + np.arange(len(ends))),
                    pa.array(np.diff([0, *ends])),
                    sums((found & (size[places] > 0)).astype(np.int64)),
                    sums(np.where(found, log_count[places], 0.0)),
                    sums(log_p),
                    pa.ListArray.from_arrays(pa.array(offsets), structs),
                ],
                schema.names,
            )
            row += len(ends)

    # written, so that row numbers stay what they are
    parts = written(docs.select(*names, docs[text].alias("_text")).mapInArrow(run, schema))
    ending_counts = [float(max(1, x)) for x in vocabulary.ending_counts]
    sizes = spark.createDataFrame([(k, x) for k, x in enumerate(ending_counts)], "ending int, size double")
    rest = counts.filter(F.col("n") < least).join(F.broadcast(sizes), "ending")
    rest = rest.select(
        "word", F.log10(F.col("n") + 1).alias("log_count"), F.log10((F.col("n") - vocabulary.discount) / F.col("size")).alias("rare_log")
    )
    missed = parts.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(rest, "word", "left")
    k = F.col("k")
    sums = missed.groupBy("row").agg(
        F.sum(F.when(F.col("log_count").isNotNull(), k).otherwise(0)).alias("more_known"),
        F.sum(k * F.coalesce("log_count", F.lit(0.0))).alias("more_base"),
        F.sum(k * F.coalesce("rare_log", "unknown")).alias("more_log_p"),
    )
    zero = F.lit(0.0)
    return parts.drop("rare").join(sums, "row", "left").select(
        *names,
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * float(np.log10(n_train + n_words + 1))).alias("base_score"),
        (F.col("log_p") + F.coalesce("more_log_p", zero)).alias("score"),
    )


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", in_fold("doc_id", 7, 2))
    scored = score(docs, train(docs.filter(~F.col("held_out"))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
