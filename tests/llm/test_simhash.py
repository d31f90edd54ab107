"""SimHash groups against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from flowlake.llm import simhash as sh


def brute_print(text, words):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, near):
    """Least index reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def test_fingerprints():
    for text in ["", None, "one", "One two", "a b c d", "a b c d e a b c d", "x\x0by\tz é É", "w " * 70_000, "a b c d " * 3]:
        assert sh.fingerprint(sh.shingle_hashes(text or "", 4, False)) == brute_print(text, 4)


def test_op8(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    prints = [brute_print(r.text, 4) for r in docs]
    groups = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    expected = sorted((r.doc_id, f"{p:016x}", docs[g].doc_id) for r, p, g in zip(docs, prints, groups, strict=True))
    assert sorted(map(tuple, sh.op8_simhash(spark, d).collect())) == expected


@pytest.mark.parametrize("thresholds", [[0, 0, 0, 0, 0], [1, -1, 0, 0, 0], [0, 0, 0, 1], [2, -1, 0, 0], [1, 2], [1, 1, 0], [4]])
@pytest.mark.parametrize("part", [20, 10_000])
def test_links_for_any_thresholds(spark, thresholds, part):
    """The thresholds sum to bits - partitions + 1, so no link is lost; small parts put every value into the grid."""
    if thresholds == [4] and part == 20:
        pytest.skip("one partition of 64 bits has 679,121 probes for each print")
    draw = np.random.RandomState(5)
    centres = draw.randint(0, 2**63, 25 if thresholds != [4] else 2).astype(np.uint64)
    prints = {0}
    for c in centres.tolist():
        for _ in range(12 if thresholds != [4] else 3):
            x = c
            for b in draw.randint(0, 64, draw.randint(0, 4)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    if thresholds == [4]:
        prints = prints[:4]
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 0) for p in prints], "fp long, fp2 long").repartition(3)
    groups = [list(range(k, 64, len(thresholds))) for k in range(len(thresholds))]
    links = sh.links_of(frame, groups, thresholds, 4, None, part)
    roots = {r.node: r.root for r in sh.components(links).collect()}
    names = [f"{p:016x}" + "0" * 16 for p in prints]
    expected = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [roots.get(n, n) for n in names] == [names[g] for g in expected]


def test_allocation_is_the_cheapest():
    costs = [[0.0, 5.0, 9.0], [0.0, 1.0, 2.0], [0.0, 4.0, 30.0]]
    cost, thresholds = sh.allocate(costs, 0)
    options = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if a + b + c - 3 == 0]
    assert cost == min(costs[0][a] + costs[1][b] + costs[2][c] for a, b, c in options) and sum(thresholds) == 0


def test_bits_that_go_together_share_a_group():
    correlation = np.zeros((64, 64))
    for a, b in ((3, 40), (40, 61), (3, 61)):
        correlation[a, b] = correlation[b, a] = 0.9
    groups = sh.grouped_bits(correlation, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({3, 40, 61} <= set(g) for g in groups)


def test_chains_become_one_component(spark):
    chain = [(f"{k:04d}", f"{k + 1:04d}") for k in range(60)] + [("x1", "x2"), ("x2", "x1")]
    got = {r.node: r.root for r in sh.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"{k:04d}"] for k in range(1, 61)} == {"0000"} and got["x2"] == "x1"
    assert sh.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_cases(spark):
    long = "alpha beta gamma delta epsilon " * 2000
    words = [f"word{k}" for k in range(400)]
    near = words[:200] + ["other"] + words[201:]
    rows = [(5, None), (6, ""), (7, " \t"), (1, long), (2, long.upper()), (8, " ".join(words)), (9, " ".join(near)), (8, " ".join(words)), (None, "lone words here now"), (3, "solo")]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, fp string")
    got = sh.near_groups(docs.drop("fp"))
    by_id = {r.doc_id: r.component_id for r in got.collect()}
    assert got.count() == len(rows)
    assert by_id[5] == by_id[6] == by_id[7] == 5 and by_id[1] == by_id[2] == 1 and by_id[3] == 3 and by_id[None] is None
    left = sh.near_dedup(docs, words=2, distinct=True, all_bits=17)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 3, 5, 8] and left.count() == 5
    assert sh.near_groups(docs.drop("fp").limit(0)).count() == 0 and sh.near_dedup(docs.limit(0)).count() == 0
