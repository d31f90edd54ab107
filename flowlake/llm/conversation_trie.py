"""The prefix trie of conversations, with subtree sums by the Euler-tour technique.

A conversation's prefixes are named by polynomial hashes of its turns (four primes fields, 124 bits), which are prefix sums: turns
are sorted by ranges of (conversation, turn), each partition sums its own stretch, and one row per partition carries on what
a conversation that spans partitions had before. So a conversation of any length is spread over tasks. Prefixes become nodes
by one grouping with partial aggregates. A node is named by its least member and its depth.

The Euler tour has two arcs per node, enter and exit. Enter leads to the first child's enter (the child with the least member),
or to the own exit; exit leads to the next sibling's enter, or to the parent's exit. Nodes are sorted by ranges of (parent,
child), where siblings are neighbours. List ranking then runs in two steps. Each partition joins the arcs that follow each other
inside of it to stretches, by pointer jumping. The list of stretches is contracted further by random mates (a stretch that
drew 1 joins the one before it that drew 0) until ``STRETCHES`` are left, which one task ranks; the rounds are then undone. Prefix
sums of (1, childless, saved) come along, and a subtree's sum is that at the exit minus that at the enter.

Hot keys: parents with over a thousandth of all nodes as children are broadcast (fewer than a thousand can be), turns of a long
conversation meet its facts in chunks, and members that end at one node are joined to text in parallel; only the SHA-256 itself,
which has to read them in order, streams through one task.

Defined cases: rows without conv_id belong to no conversation; null turns come first; equal turns are ordered by a digest of role
and text, repeated rows are turns of their own; null role or text is empty; a conversation whose rebuilt form has no turns is a
member of the root; an empty table gives an empty result. Columns but these four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlake.llm.common import table, written

#: Conversations of a hundred share their beginning: at most ``SHARED - 1`` turns.
FAMILY, SHARED = 100, 6
PRIME = 2**31 - 1
BASES = (1_103_515_245, 1_566_083_941, 1_812_433_253, 69_069_069)
FIELDS = range(len(BASES))
#: Turns of a conversation that meet its facts in one key.
CHUNK = 4096
#: Nodes of a partition of the tour.
NODES = 1 << 15
#: Stretches that one task ranks.
STRETCHES = 100_000
#: A parent with more than this part of all nodes as children is broadcast.
HOT = 1000
#: Members joined to one text.
MEMBERS = 4096


def _mod(value: Column) -> Column:
    return F.pmod(value, F.lit(PRIME))


def _powers(n: int) -> np.ndarray:
    """base ** i for each field, i below n."""
    out = np.ones((len(BASES), 1), np.int64)
    bases = np.array(BASES, np.int64)[:, None]
    while out.shape[1] < n:
        out = np.hstack((out, out * (out[:, -1:] * bases % PRIME) % PRIME))
    return out


# ------------------------------------------------------------------ prefixes


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv, r (from 0), n (code points), and for each field the prefix hash ``s`` with the turn's own term ``t``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    marked = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("n")
    )
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    shares = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") % PRIME for k in FIELDS]
    dealt = dealt.select("conv", "n", *[share.alias(f"x{k}") for k, share in zip(FIELDS, shares, strict=True)], F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, sums, powers = None, 0, np.zeros((len(BASES), 1), np.int64), _powers(1024)
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            new = np.concatenate(([held != conv[0]], conv[1:] != conv[:-1]))
            at = np.arange(len(conv))
            opened = np.maximum.accumulate(np.where(new, at, -1))
            r = np.where(opened >= 0, at - opened, at + before)
            if r.max() >= powers.shape[1]:
                powers = _powers(int(r.max()) + 1)
            x = np.vstack([batch.column(2 + k).to_numpy() for k in FIELDS])
            terms = x * powers[:, r] % PRIME
            running = np.cumsum(terms, axis=1)
            base = np.where(opened >= 0, (running - terms)[:, np.maximum(opened, 0)], -sums)
            prefix = (running - base) % PRIME
            held, before, sums = conv[-1], int(r[-1]) + 1, prefix[:, -1:]
            columns = [batch.column(0), pa.array(r.astype(np.int64)), batch.column(1), batch.column(2 + len(BASES))]
            columns += [pa.array(v.astype(np.int32)) for v in (*prefix, *terms)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "r", "n", "part", *names])

    names = [*(f"s{k}" for k in FIELDS), *(f"t{k}" for k in FIELDS)]
    schema = "conv long, r long, n long, part int, " + ", ".join(f"{c} int" for c in names)
    turns = written(dealt.mapInArrow(run, schema))
    carried = _carried(turns)
    if not carried:
        return turns.drop("part")
    columns = "part int, conv long, c long, " + ", ".join(f"p{k} long, f{k} long" for k in FIELDS)
    before = turns.sparkSession.createDataFrame(carried, columns)
    joined = turns.join(F.broadcast(before), ["part", "conv"], "left")
    on = F.col("c").isNotNull()
    moved = {"r": F.when(on, F.col("r") + F.col("c")).otherwise(F.col("r"))}
    for k in FIELDS:
        s, t = F.col(f"s{k}").cast("long"), F.col(f"t{k}").cast("long")
        moved[f"s{k}"] = F.when(on, _mod(F.col(f"p{k}") + F.col(f"f{k}") * s)).otherwise(s).cast("int")
        moved[f"t{k}"] = F.when(on, _mod(F.col(f"f{k}") * t)).otherwise(t).cast("int")
    return joined.withColumns(moved).select("conv", "r", "n", *names)


def _carried(turns: DataFrame) -> list[tuple]:
    """For each partition that goes on with a conversation: what came before it. One row per partition is read."""
    ends = F.max_by(F.struct("conv", "r", *[f"s{k}" for k in FIELDS]), F.struct("conv", "r")).alias("e")
    lasts = sorted(turns.groupBy("part").agg(F.min("conv").alias("begins"), ends).collect(), key=lambda row: row["part"])
    out, conv, count, sums = [], None, 0, [0] * len(BASES)
    for row in lasts:
        end = row["e"]
        factors = [pow(base, count, PRIME) for base in BASES]
        if conv is not None and conv == row["begins"]:
            out.append((row["part"], conv, count, *(v for pair in zip(sums, factors, strict=True) for v in pair)))
        if conv == end["conv"]:
            sums = [(s + f * end[f"s{k}"]) % PRIME for k, (s, f) in enumerate(zip(sums, factors, strict=True))]
            count += end["r"] + 1
        else:
            conv, count, sums = end["conv"], end["r"] + 1, [end[f"s{k}"] for k in FIELDS]
    return out


def _key(parts: list[Column]) -> list[Column]:
    """Four numbers of 31 bits as two."""
    return [parts[0] * 2**31 + parts[1], parts[2] * 2**31 + parts[3]]


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, and the conversations with the number of their turns."""
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    own = turns.withColumn("h", shared)
    before = [F.max(F.when(F.col("r") == F.col("h") - 1, F.col(f"s{k}"))).alias(f"o{k}") for k in FIELDS]
    convs = own.groupBy("conv", "h").agg((F.max("r") + 1).alias("len"), *before)
    names = ["r", "n", *(f"s{k}" for k in FIELDS), *(f"t{k}" for k in FIELDS)]
    heads = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("r") < SHARED - 1))
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("head"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.slice(F.array(F.struct(*[F.lit(0).alias(c) for c in names])), 1, 0))
    convs = convs.withColumn("head", head).withColumn("b", F.size("head").cast("long"))
    convs = written(convs.withColumn("total", F.col("b") + F.greatest(F.col("len") - F.col("h"), F.lit(0))))

    def row(depth: Column, sums: list[Column], terms: list[Column]) -> list[Column]:
        key, parent = _key(sums), _key([_mod(s - t) for s, t in zip(sums, terms, strict=True)])
        named = [key[0].alias("a"), key[1].alias("b"), parent[0].alias("pa"), parent[1].alias("pb")]
        return [F.col("conv"), depth.alias("depth"), *named, F.col("n"), (depth == F.col("total")).alias("ends")]

    first = convs.select("conv", "total", F.explode("head").alias("t")).select("conv", "total", "t.*")
    longs = [[F.col(f"{c}{k}").cast("long") for k in FIELDS] for c in "st"]
    lent = first.select(*row(F.col("r") + 1, *longs))

    facts = convs.filter("len > h").select(
        "conv", "h", F.col("b").alias("lent"), "total", *[f"o{k}" for k in FIELDS],
        *[F.coalesce(F.try_element_at("head", F.lit(-1))[f"s{k}"], F.lit(0)).alias(f"b{k}") for k in FIELDS],
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / CHUNK))).alias("chunk"),
    )
    rest = turns.withColumn("chunk", F.floor(F.col("r") / CHUNK)).join(facts, ["conv", "chunk"]).filter(F.col("r") >= F.col("h"))
    less = (F.col("h") - F.col("lent") + 1).cast("int")
    sums, terms = [], []
    for k, base in enumerate(BASES):
        inverse = pow(base, -1, PRIME)
        power = F.element_at(F.array(*[F.lit(pow(inverse, j, PRIME)).cast("long") for j in range(SHARED)]), less)
        since = _mod(F.col(f"s{k}").cast("long") - F.coalesce(F.col(f"o{k}"), F.lit(0)))
        sums.append(_mod(F.col(f"b{k}") + power * since))
        terms.append(_mod(power * F.col(f"t{k}").cast("long")))
    kept = rest.select(*row(F.col("lent") + F.col("r") - F.col("h") + 1, sums, terms))
    return lent.unionByName(kept), convs.select("conv", "total")


# ------------------------------------------------------------------ nodes


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, key (a, b), parent, n_convs, saved, n_children, first (the first child's conv)."""
    plain = prefixes.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("n").alias("n")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv", "n_convs", zero.alias("pa"), zero.alias("pb"), zero.alias("n"))
    plain = written(plain.unionByName(root))
    children = plain.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = children.agg(F.count("*").alias("n_children"), F.min("conv").alias("first"))
    nodes = written(plain.join(children, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero)))

    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"), F.col("n_children").alias("_n")
    )
    large = F.col("_n") * HOT > nodes.count()
    on = ["depth", "pa", "pb"]
    below, hot = nodes.filter("depth > 0"), F.broadcast(parents.filter(large).drop("_n"))
    met = below.join(hot, on).unionByName(below.join(hot, on, "left_anti").join(parents.filter(~large).drop("_n"), on))
    return met.unionByName(nodes.filter("depth = 0").withColumn("parent", F.lit(None).cast("long"))).drop("pa", "pb")


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """The digest of the members that end at a node, by its key; nodes without are left out."""
    zero = F.lit(0).cast("long")
    ends = prefixes.filter("ends").select("depth", "a", "b", "conv")
    ends = ends.unionByName(convs.filter("total = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv"))
    order = ["depth", "a", "b", "conv"]
    dealt = ends.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "a", "b", "part", "seq", "members"]
        for seq, batch in enumerate(batches):
            depth, a, b, conv, part = (batch.column(k).to_numpy() for k in range(5))
            new = np.concatenate(([True], (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            cuts = np.flatnonzero(new)
            cuts = np.union1d(cuts, np.arange(0, len(conv), MEMBERS))
            texts = conv.astype(str).tolist()
            joined = [",".join(texts[x:y]) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(texts)], strict=True)]
            columns = [depth[cuts], a[cuts], b[cuts], part[cuts], np.arange(len(cuts)) + (seq << 32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(joined, pa.string())], names)

    texts = written(dealt.mapInArrow(join, "depth long, a long, b long, part int, seq long, members string"))
    counted = texts.groupBy("depth", "a", "b").agg(F.count("*").alias("texts"), F.min("members").alias("members"))
    counted = counted.withColumn("members", F.when(F.col("texts") == 1, F.col("members")))
    single = counted.filter("texts = 1").select("depth", "a", "b", F.sha2("members", 256).alias("ends_sha256"))
    several = texts.join(counted.filter("texts > 1").select("depth", "a", "b"), ["depth", "a", "b"], "left_semi")
    several = several.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "part", "seq")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "members")), strict=True):
                if key == at:
                    state.update(b"," + text.encode())
                else:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(text.encode())
        if at:
            done.append((*at, state.hexdigest()))
        columns = list(zip(*done, strict=True)) if done else [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["depth", "a", "b", "ends_sha256"])

    return single.unionByName(several.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string"))


# ------------------------------------------------------------------ Euler tour


def local_stretches(after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointer jumping: each arc's first arc of its stretch, and the weights from there up to it; ``after`` is -1 at the ends."""
    first = np.arange(len(after))
    has = np.flatnonzero(after >= 0)
    first[after[has]] = has
    sums = np.where(first != np.arange(len(after)), weights[:, first], 0)
    while True:
        further = first[first]
        if (further == first).all():
            return first, sums
        sums = sums + sums[:, first]
        first = further


def _tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the stretch and place of both arcs, and the stretches as a list.

    An arc is named by its node's conv and by twice its depth, plus one for exit.
    """
    n_nodes = nodes.count()
    own = F.coalesce("parent", "conv")
    order = ["owner", "depth", "conv"]
    rows = nodes.select(
        own.alias("owner"), "depth", "conv", F.coalesce("first", F.lit(0)).alias("first"), "n_children",
        ((F.col("n_convs") - 1) * F.col("n")).alias("saved"), "a", "b", "n_convs", "parent",
    )
    dealt = rows.repartitionByRange(max(1, -(-n_nodes // NODES)), *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    node_columns = ["conv", "depth", "a", "b", "n_convs", "parent", "n_children"]
    places = [f"{side}_{c}" for side in ("enter", "exit") for c in ("conv", "arc", "pos", "leaves", "saved")]
    list_columns = ["part", "edge", "next_conv", "next_arc", "pos", "leaves", "saved"]
    names = [*node_columns, *places, *list_columns, "head_conv", "head_arc", "owner", "own_depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        parents = rows.column("parent").combine_chunks()
        owner, depth, conv, first, n_children, saved, part = (
            rows.column(c).to_numpy() for c in ("owner", "depth", "conv", "first", "n_children", "saved", "part")
        )
        n = len(conv)
        known, code = np.unique(conv, return_inverse=True)
        wide = int(depth.max()) + 2
        named = code * wide + depth
        by_name = np.argsort(named)

        def row_of(conv_: np.ndarray, depth_: np.ndarray) -> np.ndarray:
            """Rows of these nodes, -1 for those of other partitions."""
            at = np.minimum(np.searchsorted(known, conv_), len(known) - 1)
            name = at * wide + depth_
            place = np.minimum(np.searchsorted(named[by_name], name), n - 1)
            row = by_name[place]
            return np.where((known[at] == conv_) & (depth_ >= 0) & (named[row] == name), row, -1)

        every = np.arange(n)
        child = row_of(first, depth + 1)
        leaf = n_children == 0
        sibling = np.zeros(n, bool)
        sibling[:-1] = (owner[1:] == owner[:-1]) & (depth[1:] == depth[:-1]) & (depth[1:] > 0)
        parent = row_of(owner, depth - 1)
        after = np.full(2 * n, -1)
        after[0::2] = np.where(leaf, 2 * every + 1, np.where(child >= 0, 2 * child, -1))
        after[1::2] = np.where(sibling, 2 * (every + 1), np.where((parent >= 0) & (depth > 0), 2 * parent + 1, -1))
        after[-1] = -1  # what follows the last row is not known here
        weights = np.zeros((3, 2 * n), np.int64)
        weights[0], weights[1, 0::2], weights[2, 0::2] = 1, leaf, saved
        head, sums = local_stretches(after, weights)
        tail = np.flatnonzero(after < 0)
        node, is_exit = tail // 2, tail % 2 == 1
        # the arc after a stretch; a null conv ends the list, and an edge asks the next partition
        next_conv = np.where(is_exit, owner[node], first[node])
        next_arc = np.where(is_exit, 2 * depth[node] - 1, 2 * depth[node] + 2)
        final, edge = is_exit & (depth[node] == 0), tail == 2 * n - 1
        total = sums[:, tail] + weights[:, tail]

        def arc(column: np.ndarray) -> list[pa.Array]:
            return [pa.array(conv[column // 2]), pa.array(2 * depth[column // 2] + column % 2)]

        enter, exit_ = 2 * every, 2 * every + 1
        columns = [rows.column(c).combine_chunks() for c in node_columns[:5]] + [parents, rows.column("n_children").combine_chunks()]
        for arcs in (enter, exit_):
            columns += [*arc(head[arcs]), *(pa.array(sums[k, arcs]) for k in range(3))]
        none = [pa.nulls(n, pa.bool_() if c == "edge" else pa.int64()) for c in names[len(columns) :]]
        yield pa.RecordBatch.from_arrays(columns + none, names)
        m = len(tail)
        none = [pa.nulls(m, pa.int64()) for _ in range(len(columns))]
        listed = [pa.array(part[node].astype(np.int64)), pa.array(edge & ~final), pa.array(next_conv, mask=final), pa.array(next_arc, mask=final)]
        listed += [pa.array(total[k]) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*none, *listed, *arc(head[tail]), pa.array(owner[node]), pa.array(depth[node])], names)
        # the first row, for the partition before
        none = [pa.nulls(1, pa.bool_() if c == "edge" else pa.int64()) for c in names]
        begins = {"part": part[:1].astype(np.int64), "next_conv": conv[:1], "owner": owner[:1], "own_depth": depth[:1]}
        yield pa.RecordBatch.from_arrays([pa.array(begins[c]) if c in begins else v for c, v in zip(names, none, strict=True)], names)

    schema = ", ".join(f"{c} {'boolean' if c == 'edge' else 'long'}" for c in names)
    out = written(dealt.mapInArrow(run, schema))
    toured = out.filter("conv IS NOT NULL").select(*node_columns, *places)
    listed = out.filter("head_conv IS NOT NULL")
    begins = out.filter("conv IS NULL AND head_conv IS NULL").select("part", "owner", "own_depth", F.col("next_conv").alias("begins"))
    # one row per partition: the first row of the partition that follows
    over = W.orderBy("part")
    following = begins.select("part", *[F.lead(c).over(over).alias(f"then_{c}") for c in ("owner", "own_depth", "begins")])
    listed = listed.join(F.broadcast(following), "part", "left")
    goes_on = F.col("edge") & F.coalesce((F.col("then_owner") == F.col("owner")) & (F.col("then_own_depth") == F.col("own_depth")), F.lit(False))
    arc = F.struct(
        F.when(goes_on, F.col("then_begins")).otherwise(F.col("next_conv")).alias("conv"),
        F.when(goes_on, 2 * F.col("own_depth")).otherwise(F.col("next_arc")).alias("arc"),
    )
    return toured, listed.select(
        F.struct(F.col("head_conv").alias("conv"), F.col("head_arc").alias("arc")).alias("id"),
        F.when(arc["conv"].isNotNull(), arc).alias("next"), "pos", "leaves", "saved",
    )


SUMS = ["pos", "leaves", "saved"]


def _ranked_in_one_task(stretches: DataFrame) -> DataFrame:
    """The prefix sums of a short list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, weights = {}, {}
        for batch in batches:
            conv, arc, next_conv, next_arc, *sums = (c.to_pylist() for c in batch.columns)
            for c, a, nc, na, *w in zip(conv, arc, next_conv, next_arc, *sums, strict=True):
                after[c, a], weights[c, a] = (nc, na), w
        begins = after.keys() - set(after.values())
        done, total = [], [0, 0, 0]
        for at in begins:  # one
            while at in after:
                done.append((*at, *total))
                total = [t + w for t, w in zip(total, weights[at], strict=True)]
                at = after[at]
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["conv", "arc", *SUMS])

    flat = stretches.select("id.conv", "id.arc", F.col("next.conv").alias("next_conv"), F.col("next.arc").alias("next_arc"), *SUMS)
    ranked = flat.repartition(1).mapInArrow(run, "conv long, arc long, pos long, leaves long, saved long")
    return ranked.select(F.struct("conv", "arc").alias("id"), *SUMS)


def ranked(stretches: DataFrame) -> DataFrame:
    """Weighted list ranking: id, and the sums of what comes before it. Random mates join until few are left."""
    rounds: list[DataFrame] = []
    stretches = written(stretches)
    while stretches.count() > STRETCHES:
        drawn = stretches.withColumn("coin", F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(2)))
        ones = drawn.filter("coin = 1").select(F.col("id").alias("mate"), F.col("next").alias("then"), *[F.col(c).alias(f"m_{c}") for c in SUMS])
        joined = written(drawn.filter("coin = 0").join(ones, F.col("next") == F.col("mate")).drop("coin", "next"))
        longer = joined.select("id", F.col("then").alias("next"), *[(F.col(c) + F.col(f"m_{c}")).alias(c) for c in SUMS])
        used = joined.select(F.explode(F.array("id", "mate")).alias("id"))
        stretches = written(longer.unionByName(stretches.join(used, "id", "left_anti")))
        rounds.append(joined)
    out = _ranked_in_one_task(stretches)
    for joined in reversed(rounds):
        out = written(out)
        at = out.select("id", *[F.col(c).alias(f"at_{c}") for c in SUMS])
        mates = joined.join(at, "id").select(F.col("mate").alias("id"), *[(F.col(c) + F.col(f"at_{c}")).alias(c) for c in SUMS])
        out = out.unionByName(mates)
    return out


def trie(rows: DataFrame) -> DataFrame:
    """One row per node; ``enter_at`` and ``exit_at`` are the places of its arcs in the tour."""
    prefixes, convs = _prefixes(written(numbered_turns(rows)))
    prefixes = written(prefixes)
    toured, stretches = _tour(written(_nodes(prefixes, convs)))
    places = written(ranked(stretches))
    for side in ("enter", "exit"):
        at = places.select(F.col("id.conv").alias(f"{side}_conv"), F.col("id.arc").alias(f"{side}_arc"), *[F.col(c).alias(f"{side}_at_{c}") for c in SUMS])
        toured = toured.join(at, [f"{side}_conv", f"{side}_arc"])

    def at(side: str, what: str) -> Column:
        return F.col(f"{side}_{what}") + F.col(f"{side}_at_{what}")

    summed = toured.select(
        "conv", "depth", "a", "b", "parent", "n_convs", "n_children",
        (at("exit", "leaves") - at("enter", "leaves")).alias("n_leaves"),
        (at("exit", "saved") - at("enter", "saved")).alias("saved_tokens"),
        at("enter", "pos").alias("enter_at"), at("exit", "pos").alias("exit_at"),
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(_ends(prefixes, convs), ["depth", "a", "b"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "enter_at", "exit_at",
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS x FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(x, ascii(s[k // 8 + 1])::BIGINT) ELSE x END AS y FROM crc WHERE k < 8 * length(s))
), shared AS (SELECT conv_id, xor(x, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 8 * length(s)),
own AS (
  SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns,
         list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS sizes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[:h], []), c.turns[h + 1:]) AS turns,
         list_concat(coalesce(b.sizes[:h], []), c.sizes[h + 1:]) AS sizes
  FROM own c JOIN shared USING (conv_id) LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d AS depth, array_to_string(turns[:d], ',') AS name, array_to_string(turns[:d - 1], ',') AS above,
         CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(above) AS above, max(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, name
), children AS (SELECT depth - 1 AS depth, above AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, name)),
sums AS (
  SELECT p.depth, p.name, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.size)::BIGINT AS saved_tokens
  FROM full_nodes u JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (depth, name) LEFT JOIN full_nodes p ON p.depth = n.depth - 1 AND p.name = n.above
"""
