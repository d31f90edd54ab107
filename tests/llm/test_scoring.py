"""Language model, toxicity and Order MinHash: sums by hand, held-out quality, and the rules of the edited text."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from flowlake.llm import brown_lm as bl
from flowlake.llm import order_minhash as om
from flowlake.llm import toxicity as tx

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Some WORDS some"), (4, "Some WORDS some"), (None, "no key é"), (5, "w" * 50_000), (6, "many words " * 20_000)]


# ------------------------------------------------------------------ language model


def test_op1_base_and_held_out(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    tokens = {i: bl.tokens_of(t) for i, t in docs.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, different = sum(counts.values()), len(counts)
    rows = bl.op1_brown_lm(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words) and r.base_score == pytest.approx(base, rel=1e-9)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_sum_to_one(spark):
    """After any class: over all known words, and the unknown word of each ending."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts, vocabulary, model, total, _, least = bl.train(docs)
    words = [(bytes(r.word), r.n) for r in counts.collect()]
    assert total == sum(n for _, n in words)
    typed = bl.Typed(vocabulary)
    mass = collections.Counter()
    for word, n in words:
        places, types = typed([word])
        inside = 0.0 if types[0] < vocabulary.n_types else vocabulary.rare_log(np.array([n]), np.array([bl.ending_of(word)]))[0]
        mass[int(types[0])] += 10**inside
    for ending, x in enumerate(vocabulary.unknown_log()):
        mass[vocabulary.n_types + ending] += 10**x
    for before in range(bl.CLASSES):
        p = sum(10 ** (model.transition[before, model.classes[t]] + model.emission[t]) * m for t, m in mass.items())
        assert p == pytest.approx(1.0, abs=1e-6)


def test_sweeps_find_alternating_classes(monkeypatch):
    """Two kinds of types that only follow each other: the exchange tells them apart."""
    monkeypatch.setattr(bl, "CLASSES", 3)
    draw = np.random.RandomState(1)
    pairs = np.zeros((13, 13))
    for a in range(1, 7):
        for b in range(7, 13):
            pairs[a, b], pairs[b, a] = draw.randint(5, 30), draw.randint(5, 30)
    pairs[0, 1] = pairs[7, 0] = 10
    classes = np.array([0, *(1 + k % 2 for k in range(12))])
    for _ in range(6):
        table = np.eye(3)[classes]
        classes, moved = bl.sweep(classes, pairs.T @ table, pairs @ table, pairs.diagonal(), pairs.sum(0))
        if not moved:
            break
    assert len(set(classes[1:7])) == 1 and len(set(classes[7:])) == 1 and classes[1] != classes[7]


def test_score_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, score string")
    rows = bl.score(docs, bl.train(docs)).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_tokens == by_id[2].n_tokens == by_id[3].n_tokens == 1 and by_id[1].score == by_id[3].score
    nothing = bl.score(docs, bl.train(docs.limit(0))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in nothing)
    assert bl.score(docs.limit(0), bl.train(docs)).count() == 0


# ------------------------------------------------------------------ toxicity


def test_op7_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in tx.op7_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    unseen = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    toxic, other = [s for s, y in unseen if y], [s for s, y in unseen if not y]
    assert np.mean([a > b for a in toxic for b in other]) > 0.8
    assert np.mean([s >= 0.3 for s in other]) < 0.1


def test_toxicity_learns_only_outside_of_the_fold(spark):
    docs = spark.createDataFrame([(k, f"{'awful rude' if k % 2 else 'nice kind'} text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    flipped = spark.createDataFrame([(k, k % 2 if k not in held else 1 - k % 2) for k in range(200)], "doc_id long, toxic int")
    one, two = tx.train(docs, labels), tx.train(docs, flipped)
    assert np.array_equal(one[0], two[0]) and np.allclose(one[1], two[1]) and one[2] == pytest.approx(two[2])
    scores = {r.doc_id: r.score for r in tx.score_documents(docs, one).collect()}
    assert min(scores[k] for k in held if k % 2) > max(scores[k] for k in held if not k % 2)


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(4, None), (None, 1), (4, 0), (4, 1), (99, 1), (5, 0), (6, 0), (1, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = tx.score_documents(docs, tx.train(docs, labels)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert tx.score_documents(docs.limit(0), tx.train(docs.limit(0), odd)).count() == 0


# ------------------------------------------------------------------ Order MinHash


def brute_kmers(text):
    seen, out = collections.Counter(), []
    k = min(om.K, len(text))
    for at in range(len(text) - k + 1 if text else 0):
        out.append((text[at : at + k], seen[text[at : at + k]]))
        seen[text[at : at + k]] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "ab" * 50, "the cat sat on the mat " * 40, "é😀" * 30, "x" * 40_000])
def test_kmers_are_numbered_by_occurrence(text):
    hashes, expected = om.numbered_kmers(text), brute_kmers(text)
    assert len(hashes) == len(expected) and len(set(hashes.tolist())) == len(set(expected))
    names = {}
    assert all(names.setdefault(h, e) == e for h, e in zip(hashes.tolist(), expected, strict=True))


def test_order_counts():
    a, b = "the first sentence is here, and nothing more. ", "a second one comes after it, with other words. "
    assert om.likeness(om.fingerprint(a + b), om.fingerprint(a + b)) == 1
    same = om.likeness(om.fingerprint(a + b), om.fingerprint(a + b + "end"))
    swapped = om.likeness(om.fingerprint(a + b), om.fingerprint(b + a))
    assert same > 0.7 > swapped
    whole = om.fingerprint("lorem ipsum dolor " * 4000)
    assert np.array_equal(whole, om.fingerprint("lorem ipsum dolor " * 4000))


def check_next(rows, docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in docs]
    expected = []
    for k, (i, _) in enumerate(docs):
        text, after = texts[k], texts[(k + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [om.fingerprint(x) for x in (text, edited, after)]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((i, len(text), sha, om.as_text(prints[0]), om.as_text(prints[1]), om.likeness(*prints[:2]), om.likeness(prints[0], prints[2])))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))


def test_op5(spark, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    monkeypatch.setattr(om, "ROWS", 8)
    check_next(om.op5_order_minhash(spark, SMALL).collect(), docs)


def test_next_cases(spark, monkeypatch):
    monkeypatch.setattr(om, "ROWS", 1)
    large = [(2**53 + 1 + k, f"text {k}") for k in range(100)]
    for rows in (ODD, ODD[:1], ODD[3:5], [(k // 3, f"text {k}") for k in range(40)], large, [*large, *[(None, f"none {k}") for k in range(3)]]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        check_next(om.with_next(docs).collect(), rows)
    assert om.with_next(docs.limit(0)).count() == 0
    clash = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, fingerprint string")
    assert om.with_fingerprints(clash).count() == len(ODD) and om.with_fingerprints(clash.limit(0)).count() == 0
