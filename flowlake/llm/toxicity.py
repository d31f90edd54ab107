"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The value of an n-gram that a text holds is log(rate in toxic texts / rate in others); logistic regression weighs these values.
The model is fitted on a bounded sample of labelled rows (``POSITIVE`` toxic and ``NEGATIVE`` others, those of least hash), in
one task, and class weights restore the shares of all labelled rows. Its ``FEATURES`` weights are broadcast, and each text is
scored whole where it is read, without a shuffle. N-grams are told apart by 64-bit hashes of their code points, so long texts
do not collect chance hits.

Defined cases: a null text is the empty text, whose score is the model's bias; a row without label or document teaches nothing;
of several labels of a document the largest holds; with one class missing the score is that of the shares; further columns
stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import give_back, in_fold, small_batches, table, text_of, written

POSITIVE, NEGATIVE = 4000, 8000
SIZES = (3, 4, 5, 6)
FEATURES = 8192
#: Fewest toxic texts an n-gram is in, and fewest standard errors between its rates.
SUPPORT, ERRORS = 6, 4.0
THRESHOLD = 0.3
#: The sample's n-grams are first counted in so many buckets (2 to this power).
BUCKETS = 22
#: Entries, and texts, that the fit handles at a time.
BLOCK, TEXTS = 1 << 18, 256
L2, STEPS, RATE = 1e-4, 300, 0.05
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the text's n-grams, an array for each size."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(points) + 1, np.uint64)
    for size in range(1, SIZES[-1] + 1):
        if len(points) < size:
            return
        h = h[: len(points) - size + 1] * _BASE + points[size - 1 :]
        if size in SIZES:
            mixed = (h ^ (h >> np.uint64(32))) * _MIX
            yield mixed ^ (mixed >> np.uint64(29))


class Model:
    """Weights by n-gram hash, sorted, with a table of hash prefixes in front."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.front = np.zeros(1 << 20, bool)
        self.front[keys >> np.uint64(44)] = True

    def found(self, text: str) -> np.ndarray:
        """Which of the keys the text holds."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        places = []
        for hashes in gram_hashes(text):
            some = hashes[self.front[hashes >> np.uint64(44)]]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            places.append(at[self.keys[at] == some])
        return np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.found(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _ratio_and_errors(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = (toxic + 0.5) / (n_toxic + 1), (other + 0.5) / (n_other + 1)
    both = (toxic + other + 1.0) / (n_toxic + n_other + 2)
    return np.log(p / q), np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_other))


def _texts_with(texts: list[str], toxic: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The wanted n-grams in the order in which they are met, and in how many texts of either class each is."""
    keys, counts, place = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    met: list[np.ndarray] = []
    labels: list[np.ndarray] = []
    held = read = 0
    for k, (text, label) in enumerate(zip(texts, toxic.tolist(), strict=True)):
        for hashes in gram_hashes(text):
            met.append(np.unique(hashes[wanted(hashes)]))
            labels.append(np.full(len(met[-1]), label))
            held += len(met[-1])
        if met and (held >= BLOCK or k == len(texts) - 1):
            place = np.concatenate((place, np.arange(read, read + held)))
            every, first, at = np.unique(np.concatenate((keys, *met)), return_index=True, return_inverse=True)
            old, new, label_of = at[: len(keys)], at[len(keys) :], np.concatenate(labels)
            grown = np.stack([np.bincount(new[label_of == c], minlength=len(every)) for c in (False, True)])
            grown[:, old] += counts
            keys, counts, place, read = every, grown, place[first], read + held
            met, labels, held = [], [], 0
    order = np.argsort(place)
    return keys[order], counts[:, order].astype(float)


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """The model of a sample; ``share`` is that of toxic texts among all labelled ones."""
    n_toxic, n_other = int(toxic.sum()), int((~toxic).sum())
    none = np.zeros(0, np.uint64)
    if not n_toxic or not n_other:
        return Model(none, np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    # buckets that differ between the classes, then the n-grams in them; a block at a time, as the task has little memory of its own
    counts = np.zeros((2, 1 << BUCKETS), np.uint32)
    shift = np.uint64(64 - BUCKETS)
    for text, label in zip(texts, toxic.tolist(), strict=True):
        for hashes in gram_hashes(text):
            counts[int(label), np.unique(hashes >> shift)] += 1
    wanted = np.zeros(1 << BUCKETS, bool)
    for begin in range(0, 1 << BUCKETS, BLOCK):
        other_in, toxic_in = counts[:, begin : begin + BLOCK].astype(float)
        _, errors = _ratio_and_errors(toxic_in, other_in, n_toxic, n_other)
        wanted[begin : begin + BLOCK] = (toxic_in >= SUPPORT) & (errors >= ERRORS * 0.75)
    del counts
    keys, (other_in, toxic_in) = _texts_with(texts, toxic, lambda hashes: wanted[hashes >> shift])
    if not len(keys):
        return Model(none, np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    ratio, errors = _ratio_and_errors(toxic_in, other_in, n_toxic, n_other)
    fine = (toxic_in >= SUPPORT) & (errors >= ERRORS)
    best = np.flatnonzero(fine)[np.argsort(-errors[fine], kind="stable")[:FEATURES]]
    best = best[np.argsort(keys[best])]
    keys, ratio = keys[best], ratio[best]
    # logistic regression on the scaled values, by Adam
    plain = Model(keys, ratio, 0.0)
    held = [plain.found(text).astype(np.int32) for text in texts]
    blocks = [held[i : i + TEXTS] for i in range(0, len(held), TEXTS)]
    blocks = [(TEXTS * i, np.repeat(np.arange(len(x), dtype=np.int32), [len(y) for y in x]), np.concatenate(x)) for i, x in enumerate(blocks)]
    del held
    weight = np.where(toxic, share / n_toxic, (1 - share) / n_other)
    w, bias = np.zeros(len(keys)), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, STEPS + 1):
        scaled, total, wrong = ratio * w, np.zeros(len(keys)), np.zeros(len(texts))
        for begin, row, column in blocks:
            these = slice(begin, begin + TEXTS)
            z = bias + np.bincount(row, scaled[column], len(weight[these]))
            wrong[these] = weight[these] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic[these])
            np.add.at(total, column, ratio[column] * wrong[these][row])
        gradient = np.append(total + L2 * w, wrong.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(keys, w * ratio, float(bias))


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """(keys, weights, bias) from labelled rows outside of the held-out fold."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", parts, held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    share = (n_toxic + 0.5) / (n + 1)
    order = F.xxhash64("doc_id", F.lit(3))
    some = known.filter("toxic > 0").orderBy(order, "doc_id").limit(POSITIVE)
    some = written(some.unionByName(known.filter("toxic <= 0").orderBy(order, "doc_id").limit(NEGATIVE)))
    # at most POSITIVE + NEGATIVE rows of 16 bytes
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y > 0, t) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        model = fit([t for _, _, t in rows], np.array([y for _, y, _ in rows], bool), share)
        keys = pa.array(np.append(model.keys.view(np.int64), 0))
        del rows
        give_back()
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(np.append(model.weights, model.bias)), pa.array(np.append(np.zeros(len(model.keys), bool), True))],
            ["key", "weight", "bias"],
        )

    got = sample.repartition(1).mapInArrow(run, "key long, weight double, bias boolean").collect()
    bias = sum(r.weight for r in got if r.bias) if got else float(np.log(share / (1 - share)))
    pairs = sorted((r.key & (2**64 - 1), r.weight) for r in got if not r.bias)
    return np.array([k for k, _ in pairs], np.uint64), np.array([w for _, w in pairs], float), bias


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """The documents, text included, with their ``score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    kept = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in batches:
            scores = [fitted.score(value or "") for value in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], [*names, "score"])

    return docs.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_documents(docs, model)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", predicted)
