"""The pipeline's stages on rows with planted cases."""

import corpus_pipeline as cp
import pytest
from test_simhash import brute_groups, brute_print


@pytest.fixture(scope="module")
def kept(spark):
    """doc_ids after each stage, at sf0.01."""
    d = "/root/testdata/sf0.01"
    docs = cp.table(spark, d, "documents")
    out, columns = [[r.doc_id for r in docs.select("doc_id").collect()]], docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = cp.written(stage(spark, docs, d))
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
        out.append([r.doc_id for r in docs.select("doc_id").collect()])
    return out


def test_stages_use_what_the_one_before_kept(kept):
    for before, after in zip(kept, kept[1:], strict=False):
        assert set(after) <= set(before)
    documents, toxic, exact, near, mixed, encoded = kept
    assert len(documents) > len(toxic) > len(exact) > len(near) and sorted(mixed) == sorted(encoded)
    assert len(mixed) > len(set(mixed))  # the mix repeats documents


def test_toxic_documents_go_and_others_stay(spark, kept):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    stay = set(kept[1])
    toxic, clean = [i for i, y in labels.items() if y], [i for i, y in labels.items() if not y]
    assert sum(i not in stay for i in toxic) > 0.6 * len(toxic) and sum(i in stay for i in clean) > 0.97 * len(clean)


def test_copies_and_near_copies_go(spark, kept):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fold = str.maketrans(upper, upper.lower())
    plain = [texts[i].translate(fold) for i in kept[2]]
    assert len(set(plain)) == len(plain) == len({texts[i].translate(fold) for i in kept[1]})

    prints = {i: brute_print(texts[i], 4) for i in kept[2]}
    stay = kept[3]
    assert set(stay) == {list(prints)[k] for k in brute_groups_by_key(prints)}
    assert all((prints[a] ^ prints[b]).bit_count() > 4 for a in stay for b in stay if a < b)


def brute_groups_by_key(prints):
    """Places of the documents with the least key of each group."""
    keys = sorted(prints)
    roots = brute_groups([prints[k] for k in keys], lambda a, b: (a ^ b).bit_count() <= 4)
    places = {key: place for place, key in enumerate(prints)}
    return {places[keys[r]] for r in roots}


def test_run_and_empty_tables(spark, tmp_path):
    rows = cp.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.columns[:3] == ["doc_id", "source", "n_tokens"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
