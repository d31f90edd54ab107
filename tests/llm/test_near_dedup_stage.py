"""The pipeline's SimHash stage, and the columns that pass through stages."""

import corpus_pipeline as cp
from test_simhash import brute_groups, brute_print

D = "/root/testdata/sf0.001"


def test_one_of_each_group_stays(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in rows.orderBy("doc_id").collect()]
    roots = brute_groups([brute_print(t, 4) for _, t in texts], lambda a, b: (a ^ b).bit_count() <= 4)
    kept = cp.drop_near_copies(spark, rows, "")
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(texts[k][0] for k in set(roots)) and len(set(roots)) < len(texts)


def test_repeated_rows_keys_and_nulls(spark):
    texts = ["a b c d e f g h i j k l m n", "A b c d e f g h i j k l m n", "x y z"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (2, texts[2]), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == [1, 2, 3]
    assert cp.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_choice_among_rows_that_differ_elsewhere(spark):
    """Whatever the partitions, the same row stays."""
    rows = [(1, "a b c d e", s) for s in ("p", "q", "r", "s")]
    for stage in (cp.drop_copies, cp.drop_near_copies):
        stay = set()
        for order in (rows, rows[::-1], rows[2:] + rows[:2]):
            docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
            stay.add(tuple(r.source for r in stage(spark, docs, "").collect()))
        assert len(stay) == 1 and len(stay.pop()) == 1


def test_clashing_columns_pass(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(30)
    extra = ["score", "component_id", "fp", "keep_id", "full", "taken", "copies"]
    docs = docs.selectExpr("*", *[f"concat('own ', doc_id) AS {c}" for c in extra])
    for name, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, D)
        rows = docs.collect()
        assert rows and all(r[c] == f"own {r.doc_id}" for r in rows for c in extra), name
