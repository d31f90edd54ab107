"""Exact dedup and mixing: cases by hand, brute force, and the SQL of exact dedup."""

import collections

import pytest
from pyspark.sql import functions as F

from flowlake.llm import exact_dedup as ed
from flowlake.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string, keep_id long, _n string"
ROWS = [
    (1, "Same Text", "a", 7, "x"),
    (2, "same text", "a", 7, "x"),
    (2, "same text", "a", 7, "y"),
    (3, "SAME TEXT", None, 7, "x"),
    (4, "Ähnlich", "b", None, None),
    (5, "ähnlich", "b", None, None),
    (6, None, "b", None, None),
    (7, "", "b", None, None),
    (None, "", "c", None, None),
    (8, "long " * 30_000, "c", None, None),
    (9, "LONG " * 30_000, "c", None, None),
    (10, "long " * 30_000 + "x", "c", None, None),
    (11, "p" * 300 + "1", "c", None, None),
    (12, "p" * 300 + "2", "c", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_exact_groups(docs):
    got = [r.asDict() for r in ed.exact_groups(docs.drop("keep_id", "_n"), carry=("source",)).collect()]
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["keep_id"] == by_id[2]["keep_id"] == by_id[3]["keep_id"] == 3 and by_id[1]["group_size"] == 4
    assert by_id[4]["keep_id"] == 4 and by_id[5]["keep_id"] == 5  # only A-Z are lower-cased
    assert by_id[6]["keep_id"] == by_id[7]["keep_id"] == by_id[None]["keep_id"] == 7 and by_id[6]["group_size"] == 3
    assert by_id[8]["keep_id"] == 9 and by_id[10]["group_size"] == 1
    assert by_id[11]["group_size"] == by_id[12]["group_size"] == 1  # same length and prefix
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [3, 4, 5, 7, 9, 10, 11, 12]


def test_exact_dedup_keeps_one_of_repeated_rows(spark, docs):
    twice = docs.unionByName(docs)
    left = ed.exact_dedup(twice)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 9, 10, 11, 12]
    assert ed.exact_dedup(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert ed.exact_dedup(nulls).count() == 1


@pytest.mark.parametrize(("name", "value"), [("BROADCAST_KEYS", 0), ("HOT", 0), ("HOT", 4)])
def test_exact_groups_by_other_joins(docs, monkeypatch, name, value):
    def groups():
        return sorted(map(str, ed.exact_groups(docs.select("doc_id", "text")).drop("full").collect()))

    some = groups()
    monkeypatch.setattr(ed, name, value)
    assert groups() == some


def targets(sizes, weights=(5, 2, 1), repeats=3):
    """Shares that are cut to repeats * size, the excess going to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(repeats * sizes[s]) for s in over}


def test_mixing_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source").collect()}
    rows = mx.op3_mixing(spark, d).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[sources[r.doc_id]] += r["size"]
        taken[sources[r.doc_id]] += r.taken
        assert r.taken <= 3 * r["size"]
    expected = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[sources[r.doc_id]]
        assert r.target == pytest.approx(expected[sources[r.doc_id]])
    for source, words in taken.items():
        assert abs(words - expected[source]) < 0.02 * expected[source]
    again = {(r.doc_id, r.taken) for r in mx.op3_mixing(spark, d).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixing_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (sorted(map(tuple, mx.mixed_copies(x).select("doc_id", "copies").collect())) for x in (docs.coalesce(1), docs.repartition(7)))
    assert one == many


def test_mixing_cases(spark, docs):
    caps = [(k, "w " * n, s) for k, (n, s) in enumerate([(1, "a"), (500, "b"), (300, "b"), (0, "c"), (3, None)])]
    small = spark.createDataFrame(caps, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mx.mixed_copies(small).collect()}
    expected = targets({"a": 1, "b": 800, "c": 0, None: 3})
    assert {r.source: r.target for r in rows.values()} == pytest.approx(expected)
    assert rows[0].copies == 3 and rows[3].copies * rows[3]["size"] == 0 and all(r.copies <= 3 for r in rows.values())
    assert mx.mixed_copies(small.limit(0)).count() == 0 and mx.mix(small.limit(0)).count() == 0
    twice = docs.unionByName(docs)
    copies = mx.mixed_copies(twice).agg(F.sum("copies")).first()[0]
    mixed = mx.mix(twice)
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert mx.mixed_copies(twice).count() == 2 * len(ROWS)


def test_rounding_keeps_expectations(spark):
    """Over many sources with the same documents, each document is taken about as often as its share says."""
    rows = [(k, "w " * n, f"s{k // 6:04d}") for k in range(6 * 600) for n in [(3, 5, 8, 13, 21, 34)[k % 6]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.mixed_copies(docs, weights=(1, 2, 3)).withColumn("share", F.col("target") / F.col("source_size"))
    got = got.groupBy(F.round("share", 6).alias("share"), "size").agg(F.avg("copies").alias("mean"), F.count("*").alias("n")).collect()
    for r in got:
        assert abs(r["mean"] - r["share"]) < 5 * 0.5 / r["n"] ** 0.5, r
