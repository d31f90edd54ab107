"""Ranked lexical search: branch-and-bound over FP-trees of documents.

Documents are reduced to the terms of the items, with their frequencies (the *restricted vector*), and written once; sums over
that table give the corpus figures. Each task then takes its documents in shards. In a shard the vectors are ordered by the
terms' document frequency, most frequent first, and put into a trie, where documents with a common beginning share a path. A
node of the trie is a run of documents; it knows, for every term below it, the greatest tf, and the least m of its documents.
Both together bound any score below the node, because a term's share of the score rises with tf and falls with m. Each item
goes depth-first through the tree, best bound first, and leaves out nodes whose bound can't enter its ten best; documents of a
leaf are scored exactly. The best of one shard bound the next; the best of all tasks meet in one small window per item.

Pruning is exact, ties included: a node also knows its least key. Items are the query set; they are taken in blocks of
``ITEMS``, and only a block's terms and frequencies are sent to tasks.

Defined cases: a null or empty text has no terms, so that document is never found and that item finds nothing; a null key
comes after all others among equal scores; rows with equal keys are documents of their own; rows with equal item_id are ranked
each by itself; an empty table on either side gives an empty result; columns but key and text are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlake.llm.byte_words import NOT_ALPHANUMERIC, cut_words
from flowlake.llm.common import small_batches, table, written

#: Results per item.
BEST = 10
#: Items searched in one pass over the documents.
ITEMS = 4096
#: Documents and term entries of one tree; the first to be reached closes it.
TREE_DOCS, TREE_TERMS = 16_384, 4_000_000
#: Documents that are scored together at the end of a path.
LEAF = 32

Item = tuple[object, list[bytes]]


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """A trie over restricted vectors whose terms are numbered from the most frequent on."""

    def __init__(self, keys: list[int | None], m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        at = np.concatenate(([0], np.cumsum(sizes)))
        paths = [terms[a:b].astype(">u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        order = sorted(range(len(keys)), key=paths.__getitem__)
        self.keys = [keys[i] for i in order]
        self.m, sizes = m[order], sizes[order]
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        gather = np.repeat(at[order] - self.at[:-1], sizes) + np.arange(self.at[-1])
        self.terms, self.tfs = terms[gather], tfs[gather]
        self.doc = np.repeat(np.arange(len(order)), sizes)
        self.common = self._common(sizes)
        self.begin, self.end, self.children = [], [], []
        self._grow()
        self._bound()

    def _common(self, sizes: np.ndarray) -> np.ndarray:
        """How many leading terms a document shares with the one before it."""
        out = np.full(len(sizes), -1)
        for i in range(1, len(sizes)):
            n = min(sizes[i - 1], sizes[i])
            unlike = np.flatnonzero(self.terms[self.at[i - 1] : self.at[i - 1] + n] != self.terms[self.at[i] : self.at[i] + n])
            out[i] = unlike[0] if len(unlike) else n
        return out

    def _node(self, begin: int, end: int) -> int:
        self.begin.append(begin)
        self.end.append(end)
        self.children.append([])
        return len(self.begin) - 1

    def _grow(self) -> None:
        """A node branches where its documents' common beginning ends; short branches beside each other make one leaf."""
        todo = [self._node(0, len(self.keys))]
        while todo:
            node = todo.pop()
            begin, end = self.begin[node], self.end[node]
            if end - begin <= LEAF:
                continue
            inner = self.common[begin + 1 : end]
            cuts = [*(np.flatnonzero(inner == inner.min()) + begin + 1).tolist(), end]
            left = begin
            for k, cut in enumerate(cuts):
                following = cuts[k + 1] if k + 1 < len(cuts) else None
                if following is None or following - left > LEAF:
                    child = self._node(left, cut)
                    self.children[node].append(child)
                    todo.append(child)
                    left = cut

    def _bound(self) -> None:
        n = len(self.begin)
        self.least_m = np.array([self.m[b:e].min() for b, e in zip(self.begin, self.end, strict=True)])
        lowest = [_rank(key) for key in self.keys]
        self.least_key = [min(lowest[b:e]) for b, e in zip(self.begin, self.end, strict=True)]
        scratch = np.zeros(int(self.terms.max(initial=0)) + 1, np.int64)
        below: list[tuple[np.ndarray, np.ndarray]] = [(self.terms[:0], self.tfs[:0])] * n
        for node in range(n - 1, -1, -1):  # children come after their parents
            if self.children[node]:
                parts = [below[c] for c in self.children[node]]
                terms, tfs = (np.concatenate(p) for p in zip(*parts, strict=True))
            else:
                span = slice(self.at[self.begin[node]], self.at[self.end[node]])
                terms, tfs = self.terms[span], self.tfs[span]
            np.maximum.at(scratch, terms, tfs)
            terms = np.flatnonzero(scratch)
            below[node] = terms, scratch[terms]
            scratch[terms] = 0
        nodes = np.repeat(np.arange(n), [len(t) for t, _ in below])
        terms, tfs = (np.concatenate(p) for p in zip(*below, strict=True))
        by_term = np.argsort(terms, kind="stable")
        nodes, tfs = nodes[by_term], tfs[by_term]
        self.nodes, self.shares = nodes, _share(tfs, self.least_m[nodes])
        self.term_at = np.searchsorted(terms[by_term], np.arange(len(scratch) + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list) -> None:
        """Put this tree's documents into ``best``, a heap of (score, -key rank, key); ``dense`` holds the weights by term."""
        bound = np.zeros(len(self.begin), np.int64)
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            if term + 1 < len(self.term_at):
                span = slice(self.term_at[term], self.term_at[term + 1])
                bound[self.nodes[span]] += weight * self.shares[span]
        bounds, todo = bound.tolist(), [0]
        while todo:
            node = todo.pop()
            most = bounds[node]
            if most == 0 or (len(best) == BEST and (most, -self.least_key[node]) <= best[0][:2]):
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=bounds.__getitem__)
            else:
                self._score(self.begin[node], self.end[node], dense, best)

    def _score(self, begin: int, end: int, dense: np.ndarray, best: list) -> None:
        a, b = self.at[begin], self.at[end]
        weights = dense[self.terms[a:b]]
        has = np.flatnonzero(weights)
        doc = self.doc[a:b][has]
        shares = weights[has] * _share(self.tfs[a:b][has], self.m[doc])
        scores = np.zeros(end - begin, np.int64)
        np.add.at(scores, doc - begin, shares)
        least = best[0][0] if len(best) == BEST else 1
        for i in np.flatnonzero(scores >= least).tolist():
            key = self.keys[begin + i]
            entry = int(scores[i]), -_rank(key), key
            if len(best) < BEST:
                heapq.heappush(best, entry)
            elif entry[:2] > best[0][:2]:
                heapq.heapreplace(best, entry)


def _rank(key: int | None) -> int:
    return 2**63 if key is None else key


def _vectors(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, n (terms of the whole text), and the restricted vector as two arrays; documents without terms have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = cut_words(batch.column(1).to_pylist(), NOT_ALPHANUMERIC, lower=True)
            number = np.array([vocabulary.get(w, -1) for w in words.distinct], np.int64)[words.codes] if words.distinct else words.codes
            counts = np.diff(words.first)
            doc = np.repeat(np.arange(len(counts)), counts)[number >= 0]
            pairs, tfs = np.unique(doc * max(1, len(vocabulary)) + number[number >= 0], return_counts=True)
            doc, terms = np.divmod(pairs, max(1, len(vocabulary)))
            at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(counts)))))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *lists], ["key", "n", "terms", "tfs"])
            yield rows.filter(pa.array(counts > 0))

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, "key long, n long, terms array<int>, tfs array<int>"
    )


def _frequencies(vectors: DataFrame) -> DataFrame:
    """term, df; counted per batch before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.bincount(batch.column(0).flatten().to_numpy())
            terms = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(counts[terms], pa.int64())], ["term", "df"])

    return vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _search(vectors: DataFrame, items: list[Item], vocabulary: dict[bytes, int]) -> DataFrame:
    """item (its number), key, score: the best of every task."""
    n_docs, n_all = vectors.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, count in _frequencies(vectors).collect():  # one row per term of the items
        df[term] = count
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df[order].tolist()], np.int64)
    asked = []
    for _, terms in items:
        places = np.sort(place[[vocabulary[t] for t in terms]]) if terms else np.zeros(0, np.int64)
        asked.append(places[weight[places] > 0])
    n_places = len(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in asked]
        dense = np.zeros(n_places, np.int64)

        def settle(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes = rows.column("terms").combine_chunks().value_lengths().to_numpy().astype(np.int64)
            terms = place[rows.column("terms").combine_chunks().flatten().to_numpy()]
            tfs = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            by_place = np.lexsort((terms, doc))
            m = 10 + (90 * rows.column("n").to_numpy() * n_docs) // n_all
            tree = Tree(rows.column("key").to_pylist(), m, sizes, terms[by_place], tfs[by_place])
            for places, heap in zip(asked, best, strict=True):
                dense[places] = weight[places]
                tree.search(places, weight[places], dense, heap)
                dense[places] = 0

        held, docs, entries = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs, entries = docs + batch.num_rows, entries + len(batch.column(2).flatten())
            if docs >= TREE_DOCS or entries >= TREE_TERMS:
                settle(held)
                held, docs, entries = [], 0, 0
        if docs:
            settle(held)
        found = [(i, key, score) for i, heap in enumerate(best) for score, _, key in heap]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "key", "score"])

    return vectors.mapInArrow(run, "item int, key long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """item, rank, key, score: for every row of ``items`` its ``BEST`` documents by score, then by key."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator()
    item_type = items.schema[item].dataType.simpleString()
    found = spark.createDataFrame([], f"`{item}` {item_type}, rank int, `{key}` long, score long")
    while block := list(islice(rows, ITEMS)):
        words = cut_words([r["text"] for r in block], NOT_ALPHANUMERIC, lower=True)
        vocabulary = {word: i for i, word in enumerate(words.distinct)}
        own = [[words.distinct[c] for c in np.unique(words.codes[a:b])] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        asked = [(row["item"], terms) for row, terms in zip(block, own, strict=True)]
        vectors = written(_vectors(docs, key, text, vocabulary))
        if vocabulary and not vectors.isEmpty():
            best = _search(vectors, asked, vocabulary)
            turn = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
            names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(asked)], f"item int, name {item_type}")
            best = best.withColumn("rank", turn).filter(F.col("rank") <= BEST).join(F.broadcast(names), "item")
            found = found.unionByName(best.select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score"))
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)
), asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM benchmark)
), counted AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS size FROM counted GROUP BY r),
corpus AS (SELECT count(*) AS all_docs, sum(size)::BIGINT AS all_terms FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, corpus GROUP BY term, all_docs
), norms AS (SELECT r, 10 + (90 * size * all_docs) // all_terms AS m FROM sizes, corpus),
scored AS (
  SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY i, item_id, doc_id, r
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
