"""What Python workers hold: between tasks, and while the toxicity model is fitted."""

import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from flowlake.llm import bpe
from flowlake.llm import toxicity as tx

FILE = P.path("byte_bpe_50k.tiktoken")


def sample(n):
    draw = random.Random(7)
    plain, rude = ["river", "stone", "quiet", "garden", "letter"], ["vile", "rotten", "scum", "wretch", "loathe"]
    toxic = np.array([k % 3 == 0 for k in range(n)])
    return [" ".join(draw.choice(rude if bad and draw.random() < 0.6 else plain) for _ in range(40)) for bad in toxic.tolist()], toxic


def test_fit_holds_a_block_of_buckets_at_a_time():
    texts, toxic = sample(60)
    tracemalloc.start()
    try:
        tx.fit(texts, toxic, 0.3)
        assert tracemalloc.get_traced_memory()[1] < 80e6  # of them 34 MB of counts
    finally:
        tracemalloc.stop()


def test_blocks_change_no_weight(monkeypatch):
    texts, toxic = sample(61)
    texts[0], texts[-1] = "", "ab"
    whole = tx.fit(texts, toxic, 0.3)
    assert len(whole.keys)
    monkeypatch.setattr(tx, "TEXTS", 7)
    monkeypatch.setattr(tx, "BLOCK", 1 << 12)
    some = tx.fit(texts, toxic, 0.3)
    assert (some.keys == whole.keys).all() and (some.weights == whole.weights).all() and some.bias == whole.bias


def test_n_grams_keep_the_order_in_which_they_are_met(monkeypatch):
    texts, toxic = sample(30)
    seen = {}
    for text, label in zip(texts, toxic.tolist(), strict=True):
        for hashes in tx.gram_hashes(text):
            for key in np.unique(hashes[hashes % np.uint64(3) == 0]).tolist():
                seen.setdefault(key, [0, 0])[label] += 1
    for block in (1, 500, 1 << 18):
        monkeypatch.setattr(tx, "BLOCK", block)
        keys, counts = tx._texts_with(texts, toxic, lambda hashes: hashes % np.uint64(3) == 0)
        assert keys.tolist() == list(seen) and counts.T.tolist() == list(seen.values())
    assert not len(tx._texts_with(texts, toxic, lambda hashes: np.zeros(len(hashes), bool))[0])


def test_a_worker_between_tasks_remembers_no_texts(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('quixot', hex(id), 'ing zebr', hex(id * 7919), 'ish') AS text").repartition(8)
    coded = bpe.encode_documents(docs, FILE, P.PATTERN)
    assert coded.where("cast(decoded AS string) LIKE 'quixot%ish' AND n_tokens > 2").count() == 400

    def held(batches):
        for _ in batches:
            pass
        own = bpe._WORKER.get((FILE, P.PATTERN))
        yield pa.RecordBatch.from_pydict({"n": [len(own.once) + len(own.often) if own else None]})

    found = [r.n for r in spark.range(64).repartition(16).mapInArrow(held, "n long").where("n IS NOT NULL").collect()]
    assert found and not any(found)
