import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowlake.llm import conversation_trie as s

COLUMNS = "conv_id long, turn long, role string, text string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plainly(rows):
    """A dictionary of prefixes; turns with equal places must be equal."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for name in members:
        if name:
            children[name[:-1]].append(name)
    leaves, saved = defaultdict(int), defaultdict(int)
    for name in members:
        for d in range(len(name) + 1):
            leaves[name[:d]] += not children[name]
            saved[name[:d]] += (len(members[name]) - 1) * len(name[-1][1]) if name else 0
    out = []
    for name, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(rebuilt[c]) == len(name))
        parent = min(members[name[:-1]]) if name else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(inside), len(name), parent, len(inside), len(children[name]), leaves[name], saved[name], digest))
    return sorted(out, key=lambda r: r[:2])


def result(spark, rows, columns=COLUMNS):
    return sorted((tuple(r[c] for c in RESULT) for r in s.trie(spark.createDataFrame(rows, columns)).collect()), key=lambda r: r[:2])


def corpus(n, seed=1):
    """Conversations that share beginnings within a hundred and beyond, copies, a very long one, and a missing base."""
    rng = random.Random(seed)
    starts = [("user", f"start {i} é") for i in range(3)]
    out = []
    for c in rng.sample(range(-150, 700), n):
        if c == 300:
            continue
        turns = [rng.choice(starts)] + [("assistant", f"t{rng.randint(0, 2)}") for _ in range(rng.randint(0, 7))]
        out += [(c, i, *turn) for i, turn in enumerate(turns)]
    out += [(9001, i, "user", f"long {i % 3}") for i in range(200)]
    rng.shuffle(out)
    return out


def small(monkeypatch):
    for name, value in {"NODES": 16, "STRETCHES": 8, "MEMBERS": 3, "CHUNK": 8, "HOT": 20}.items():
        monkeypatch.setattr(s, name, value)


def test_equals_plain_version(spark):
    rows = corpus(250)
    assert result(spark, rows) == plainly(rows)


def test_many_partitions_rounds_and_chunks(spark, monkeypatch):
    small(monkeypatch)
    rows = corpus(60, 4)
    assert result(spark, rows) == plainly(rows)


def test_tour_places(spark):
    nodes = s.trie(spark.createDataFrame(corpus(80, 2), COLUMNS)).collect()
    places = sorted(p for r in nodes for p in (r["enter_at"], r["exit_at"]))
    assert places == list(range(2 * len(nodes)))
    assert all((r["exit_at"] - r["enter_at"] == 1) == (r["n_children"] == 0) for r in nodes)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"), (1, None, "user", "first"), (1, 0, None, None), (1, 5, "", ""), (1, 6, "user", "x" * 50_000),
        (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "a"), (107, 1, "user", "only"), (200, 3, "u", "ser"), (201, 1, "us", "er"),
    ]
    assert result(spark, rows) == plainly(rows)
    assert result(spark, []) == []
    assert result(spark, [(None, 1, "a", "b")]) == []


def test_turnless_members_end_at_the_root(spark):
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(short, 0, "user", "goes")]
    assert result(spark, rows) == plainly(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_clashing_columns(spark):
    rows = [(*r, 1, "x") for r in corpus(20, 3)]
    assert result(spark, rows, COLUMNS + ", depth int, parent string") == plainly([r[:4] for r in rows])


@pytest.mark.parametrize("n", [1, 2, 57])
def test_list_ranking(spark, monkeypatch, n):
    monkeypatch.setattr(s, "STRETCHES", 4)
    order = random.Random(n).sample(range(1000), n)
    rows = [((c, 2 * c), (order[i + 1], 2 * order[i + 1]) if i + 1 < n else None, 1, c, 2) for i, c in enumerate(order)]
    arc = "struct<conv:long,arc:long>"
    found = s.ranked(spark.createDataFrame(rows, f"id {arc}, next {arc}, pos long, leaves long, saved long")).collect()
    ranks = {r["id"]["conv"]: (r["pos"], r["leaves"], r["saved"]) for r in found}
    assert ranks == {c: (i, sum(order[:i]), 2 * i) for i, c in enumerate(order)}
