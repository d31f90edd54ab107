import math
import random
import re
from collections import Counter

from flowlake.llm import lexical_search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plainly(documents, items):
    counts = [(key, Counter(TERM.findall(lowered(text)))) for key, text in documents]
    counts = [(key, c) for key, c in counts if c]
    n_docs, n_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_all
            total = 0
            for t in set(TERM.findall(lowered(text))) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                total += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if total > 0:
                scores.append((-total, key is None, key or 0, key))
        out += [(item, i + 1, key, -score) for i, (score, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


def result(spark, documents, items):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    found = s.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in found.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{'Ä' * (i % 2)}T{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    documents = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]
    items = [(i, ", ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(30)]
    return documents, items


def test_equals_plain_version(spark, monkeypatch):
    documents, items = corpus(900, 1)
    want = plainly(documents, items)
    assert result(spark, documents, items) == want
    monkeypatch.setattr(s, "TREE_DOCS", 100)
    monkeypatch.setattr(s, "LEAF", 3)
    monkeypatch.setattr(s, "ITEMS", 7)
    assert result(spark, documents, items) == want


def test_ties_copies_and_odd_rows(spark):
    copies = [(i, "Alpha beta gamma") for i in range(500, 0, -1)]
    odd = [(None, "alpha alpha"), (None, None), (9000, ""), (9001, "..."), (9002, "alpha " * 3000), (-3, "éa ÉA")]
    items = [(1, "ALPHA"), (2, "beta, alpha"), (None, "éA"), (4, None), (5, "nothing here"), (1, "gamma")]
    assert result(spark, copies + odd, items) == plainly(copies + odd, items)


def test_branches_are_left_out(monkeypatch):
    """Of many documents only the leaves whose bound reaches the ten best are scored."""
    import numpy as np

    rng = np.random.default_rng(2)
    sizes = np.full(4000, 6)
    terms = np.concatenate([np.sort(rng.choice(200, 6, replace=False)) for _ in sizes])
    tree = s.Tree(list(range(4000)), np.full(4000, 100), sizes, terms, rng.integers(1, 9, len(terms)))
    scored = []
    score = s.Tree._score
    monkeypatch.setattr(s.Tree, "_score", lambda self, a, b, *rest: (scored.append(b - a), score(self, a, b, *rest)))
    dense, best = np.zeros(200, np.int64), []
    asked = np.array([0, 1, 2])
    dense[asked] = 1000
    tree.search(asked, dense[asked], dense, best)
    assert len(best) == s.BEST and sum(scored) < 1000


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a")], []) == []
    assert result(spark, [(1, None)], [(1, "a")]) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, item string, score int")
    items = spark.createDataFrame([(5, "a", 1)], "item_id int, text string, rank int")
    rows = s.search(docs.unionByName(docs), items).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [(5, 1, 1), (5, 2, 1)]
    assert rows[0]["score"] == rows[1]["score"] > 0
