import hashlib
import random

import numpy as np
import pytest

from flowlake.llm import substring_dedup as s

WINDOW = s.WINDOW


def plainly(documents):
    """One dictionary of windows; documents are in order."""
    seen, out = set(), []
    for key, text in documents:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            part = tuple(words[i : i + WINDOW])
            if part in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(part)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((key, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def result(spark, documents, columns="doc_id long, text string"):
    rows = s.remove_repeats(spark.createDataFrame(documents, columns)).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    return [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in order]


def corpus(n, seed=1):
    """Random prose with shared passages at odd places, repeats inside a document, whole copies and odd white space."""
    rng = random.Random(seed)
    vocabulary = ["é" * (i % 3) + f"w{i}" for i in range(300)]

    def prose(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passages = [prose(rng.randint(18, 70)) for _ in range(6)]
    out = []
    for i in range(n):
        words = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)[rng.randint(0, 5) :]
        if rng.random() < 0.1:
            words = words * 2
        if out and rng.random() < 0.1:
            words = out[rng.randrange(len(out))][1].split()
        out.append((i, rng.choice([" ", "\n", " \t", "  "]).join(words)))
    return out


def test_equals_plain_version(spark):
    documents = corpus(400)
    assert result(spark, documents) == plainly(documents)


def test_many_shards_and_hot_minimizers(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD_BYTES", 4000)
    monkeypatch.setattr(s, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(40)]
    around = [(i, " ".join([f"a{rng.random()}" for _ in range(15)] + shared + [f"b{rng.random()}" for _ in range(15)])) for i in range(300)]
    documents = around + [(k + 1000, t) for k, t in corpus(200, 7)]
    rows = spark.createDataFrame(documents, "key long, text string")
    assert len(s._hot_minimizers(rows, len(documents), 30)) > 0
    assert result(spark, documents) == plainly(documents)


def test_long_runs(spark, monkeypatch):
    monkeypatch.setattr(s, "RUN", 7)
    documents = [(1, "x " * 500), (2, "y " * 30), (3, "x " * 45 + "y " * 25), (4, "a b " * 200)]
    assert result(spark, documents) == plainly(documents)


def test_repeats_inside_one_segment(spark):
    rng = random.Random(9)
    documents = []
    for i in range(60):
        period = [f"{i}p{k}" for k in range(rng.randint(1, 30))]
        documents.append((i, " ".join(period * rng.randint(1, 8) + [f"{i}e{k}" for k in range(rng.randint(0, 30))])))
    want = plainly(documents)
    assert any(n for _, _, n, _ in want) and result(spark, documents) == want


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    documents = [(None, passage), (1, None), (2, ""), (3, passage), (4, "few words"), (2**60, passage + " end"), (-7, "start " + passage)]
    ordered = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0))
    assert result(spark, documents) == plainly(ordered)
    assert result(spark, []) == []


def test_repeated_rows_and_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, passage, "x", 5)] * 3 + [(1, "other " + passage, "x", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, copies int")
    got = s.remove_repeats(frame).collect()
    assert sorted(r["n_removed"] for r in got)[-2:] == [25, 25]
    assert sum(r["n_words"] - r["n_removed"] for r in got) == 26  # the passage once, and the other word
    assert set(got[0].asDict()) == {"doc_id", "n_words", "n_removed", "kept", "removed"}


@pytest.mark.parametrize("depth", [1, 3, 20])
def test_index_counts_patterns(depth):
    rng = np.random.default_rng(depth)
    text = np.concatenate(([0], rng.integers(1, 4, 400), [0], rng.integers(1, 4, 90), [0]))
    index = s.FmIndex(text, depth)
    ends = np.array([e for e in range(depth, len(text) - 1) if 0 not in text[e - depth + 1 : e + 1]])
    length, low, rows = index.matches(ends, np.full(len(ends), depth))
    for e, n, row, count in zip(ends, length, low, rows, strict=True):
        pattern = text[e - n + 1 : e + 1]
        found = [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]
        assert count == len(found) and n <= depth
        assert n == depth or count == 1
        if n == depth:
            assert index.places[row] == found[0]


def test_wavelet_ranks():
    values = np.random.default_rng(3).integers(0, 37, 1000)
    matrix = s.WaveletMatrix(values, 40)
    for symbol in (0, 5, 36, 40):
        for at in (0, 1, 63, 64, 500, 1000):
            assert matrix.rank(np.array([symbol]), np.array([at]))[0] == (values[:at] == symbol).sum()
