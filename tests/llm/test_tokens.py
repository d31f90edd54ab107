"""BPE encoding and token counts against the libraries."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlake.llm import bpe
from flowlake.llm import token_counts as tc
from flowlake.llm.pretokens import Pretokens

SPECIAL = "<|endoftext|>"
TEXTS = ["", "a", " a  b\n\n c  \n", "a" * 5000, "ab" * 3000, "=" * 4097, " " * 3000 + "x", "é" * 900, "x y\x1c\x1d \x85 z﷐ q", "日本語" * 300, "  "]
TEXTS += [f"x {SPECIAL}{SPECIAL} y", SPECIAL, "it's we'LL", "tab\t two  \n spaces \r\n", "՘ ꟎꟏b c"]


def noise(seed, n):
    draw = random.Random(seed)
    parts = ["a", "b", "th", "e", "  ", " ", "\n", "1", "é", "'s", "!", "　", "\t", "ing", "ß", "😀", SPECIAL, "aaaa", "͸"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_is_the_library(pairs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    texts = TEXTS + noise(1, 60)
    got = pairs.encode(texts)
    assert got == [" ".join(map(str, library.encode_ordinary(t))) for t in texts]
    ids = [np.array(list(map(int, g.split())), np.int64) for g in got]
    assert pairs.decode(ids) == [t.encode() for t in texts]


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_long_words_by_either_contraction(file):
    pairs = bpe.BytePairs(P.path(file), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    draw = random.Random(3)
    words = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("ab", "the", "aeimnrst", "=") for n in (2, 7, 48, 61, 700)]
    for chosen in (bpe._ONE, bpe._ALL):
        assert pairs._contract([w.encode() for w in words], chosen) == [library.encode_ordinary(w) for w in words]


def test_a_step_of_short_words_takes_one_row_a_word(pairs):
    pairs._contract([b"antiontion", b"thereandthere"], bpe._ONE)
    values = {"steps": 60, "rank_at": 41, "none": 2**21 - 1, "id_bits": 21, "unranked": 2**41 - 1, "chosen": ""}
    plan = pairs.db.execute("EXPLAIN " + bpe._ONE.format(**values)).fetchall()[0][1].upper()
    assert "CTE" in plan and not any(node in plan for node in ("WINDOW", "UNNEST", "GROUP BY", "GROUP_BY"))


def test_words_of_many_steps_and_equal_pairs(pairs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    draw = random.Random(5)
    words = ["".join(draw.choice(x) for _ in range(n)) for x in ("a", "aab", "=-", "antioe", "\x00é日") for n in range(1, 47)]
    words += ["x" * 300, "ab" * 150]  # more steps than one query takes
    assert pairs._contract([w.encode() for w in words], bpe._ONE) == [library._encode_single_piece(w.encode()) for w in words]


def test_parts_met_again_outlive_rare_ones(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    pairs = bpe.BytePairs(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    contracted, contract = [], pairs._contract_lists
    monkeypatch.setattr(pairs, "_contract_lists", lambda words: contracted.extend(words) or contract(words))
    hot = " ".join(f"hotword{x}thn" for x in "abcdefgh")
    for batch in range(9):
        pairs.encode([hot + " " + " ".join(f"rare{x}{'qz' * batch}zq" for x in "abcdefghijklmnopqrst")])
    assert max(sum(w.startswith(b" hot") and w == x for w in contracted) for x in set(contracted)) <= 2
    assert len(pairs.once) + len(pairs.often) < 80


def test_a_word_that_splits_otherwise_alone():
    path, pattern = P.path("byte_bpe_50k.tiktoken"), r"(?<=a)t+h+|\S| "
    pairs = bpe.BytePairs(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pairs.ranks, special_tokens={})
    for texts in (["tth", "atth"], ["atth", "tth"], ["tth atth", "atth tth"]):
        assert pairs.encode(texts) == [" ".join(map(str, library.encode_ordinary(t))) for t in texts]


def test_parts_of_a_column_are_the_cuts():
    pretokens = Pretokens(P.PATTERN)
    every = [*TEXTS, *noise(3, 40), "", " a b", "a  b", "a   b", "end ", "x\u2003  y", "q\x1c \x1d", "\ufdd0 x"]
    plain = [t for t in every if pc.any(pc.match_substring_regex(pa.array([t]), "[^!-~ ]|  ")).as_py() is False]
    for texts in (every, plain, [""], ["", ""], []):
        column = pa.array(["skipped", *texts], pa.large_string())[1:]
        parts, ends = pretokens.parts(column)
        found = [parts.to_pylist()[a:b] for a, b in zip(ends, ends[1:])]
        assert found == [pretokens.cuts(t) for t in texts] and len(plain) > 3


def test_bpe_frame(spark):
    rows = [(k, t, "mine") for k, t in enumerate([*TEXTS, None, TEXTS[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(bytes(got[k].decoded) == (t or "").encode() for k, t, _ in rows)
    assert got[0].n_tokens == 0 and got[len(TEXTS)].token_ids == ""
    assert bpe.encode_documents(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op4(spark):
    d = "/root/testdata/sf0.001"
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, " ".join(map(str, library.encode_ordinary(r.text))), r.text) for r in texts.collect()]
    expected = spark.createDataFrame(rows, "doc_id long, ids string, text string").select(
        "doc_id", F.size(F.split("ids", " ")).alias("n"), F.sha2("ids", 256).alias("i"), F.sha2("text", 256).alias("d")
    )
    assert sorted(map(tuple, bpe.op4_bpe(spark, d).collect())) == sorted(map(tuple, expected.collect()))


def test_counts_are_the_library():
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = TEXTS + noise(2, 60)
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert tc.Lengths(path, P.PATTERN, {}).counts(texts) == expected
    assert tc.Lengths(path, P.PATTERN, {" a": 1, "b": 1, "th": 1}).counts(texts) == expected


def test_counts_frame(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(k, t, 5) for k, t in enumerate([*TEXTS, None, TEXTS[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in tc.count_tokens(docs, path, P.PATTERN).collect()}
    for k, t, _ in rows:
        assert got[k].n_bytes == len((t or "").encode())
        assert got[k].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
    assert tc.count_tokens(docs.limit(0), path, P.PATTERN).count() == 0


def test_op9(spark):
    d = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = tc.op9_token_counts(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 512)
