"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints that differ in at most ``bits`` bits are linked; components of links are groups. Bits are grouped by correlation
into partitions, and a dynamic program gives each partition its own threshold so that the thresholds sum to bits - partitions +
1, at the least estimated cost of probes and candidates (a threshold of -1 leaves a partition out). Two linked fingerprints then
agree up to its threshold in one partition at least: a fingerprint posts its value, and probes the values within the threshold
that are not below its own. Candidates of a value are verified in blocks, and of a dense group only enough links to span it are
kept, so that no group makes all its pairs. A value that many fingerprints post is split into a grid of parts.

Copies share a fingerprint and are one node, so they cost nothing after the first aggregation. Components come from alternating
large-star and small-star steps, each written to the shared folder.

Defined cases: a null text has fingerprint zero, which is linked as any other; null keys rank last; repeated rows share a
component; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import small_batches, table, text_of, written

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 65_536
#: Fingerprints that the candidate counts are estimated from.
SAMPLE = 4096
#: Measured nanoseconds of one probe row (made, shuffled, sorted, read) and of one candidate (compared).
PROBE_COST, CANDIDATE_COST = 4000.0, 4.0
#: A value is split into parts of this size, or of this part of all fingerprints if that is more.
PART, PART_SHARE = 4096, 1 / 32


def shingle_hashes(text: str, words: int, distinct: bool) -> np.ndarray:
    """XXH64 of the text's word shingles, or of the whole sequence if it has fewer words."""
    tokens = text.encode().lower().split()  # bytes: A-Z only, and the ASCII white space
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    lasts = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), lasts.tolist(), strict=True)], np.uint64)
    return np.unique(hashes) if distinct else hashes


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), BLOCK):
        some = hashes[begin : begin + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def remixed(hashes: np.ndarray) -> np.ndarray:
    """A second, independent set of bits of each hash."""
    h = hashes ^ (hashes >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def with_fingerprints(docs: DataFrame, words: int, distinct: bool, text: str = "text") -> DataFrame:
    """The documents without their text, with ``fp`` and a second fingerprint ``fp2``, as signed longs."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, "fp", "fp2")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for value in batch.column("_text").to_pylist():
                hashes = shingle_hashes(value or "", words, distinct)
                first.append(fingerprint(hashes))
                second.append(fingerprint(remixed(hashes)) if distinct else 0)
            prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *prints], [*names, "fp", "fp2"])

    return docs.select(*names, docs[text].alias("_text")).mapInArrow(run, schema)


# ------------------------------------------------------------------ partitions and thresholds


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of even size, each grown by the bit that correlates most with it."""
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - (BITS - len(free))) // (parts - k)
        group = [min(free)] if not groups else [max(free, key=lambda b: (max(correlation[b, c] for c in free if c != b) if len(free) > 1 else 0, -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def values_of(prints: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one group, packed; bit 0 is the most significant."""
    out = np.zeros(len(prints), np.uint64)
    for bit in group:
        out = (out << np.uint64(1)) | ((prints >> np.uint64(BITS - 1 - bit)) & np.uint64(1))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one per partition, that sum to ``total`` at the least cost; costs[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(options):
                at = used + k - 1
                if at not in new or cost + more < new[at][0]:
                    new[at] = (cost + more, [*chosen, k - 1])
        best = new
    return best[total]


def plan(sample: np.ndarray, correlation: np.ndarray, n: int, bits: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost."""
    choices = []
    for parts in range(2, min(bits + 2, 12)):
        groups, costs, total = grouped_bits(correlation, parts), [], bits - parts + 1
        for group in groups:
            own, width = values_of(sample, group), len(group)
            apart = np.zeros(width + 1)
            for begin in range(0, len(own), 512):
                d = np.bitwise_count(own[begin : begin + 512, None] ^ own[None, :])
                apart += np.bincount(d.ravel(), minlength=width + 1)
            apart[0] -= len(own)
            seen = np.cumsum(apart) / max(1, len(own) * (len(own) - 1))
            options = [0.0]
            for t in range(0, min(width, max(total, 0) + parts) + 1):
                ball = sum(comb(width, k) for k in range(t + 1))
                pairs = max(seen[t], ball / 2.0**width)
                probes = (ball + 1) / 2 + (t > 0)
                options.append(PROBE_COST * probes + CANDIDATE_COST * n * pairs)
                if ball > 5_000:
                    break
            costs.append(options)
        if total <= sum(len(c) - 2 for c in costs):
            choices.append((*allocate(costs, total), groups))
    cost, thresholds, groups = min(choices, key=lambda c: c[0])
    return groups, thresholds


# ------------------------------------------------------------------ candidates of one value


def spanning_links(left: np.ndarray, right: np.ndarray | None, near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of ``left`` (or of left and right, linked across): a seed and what it reaches.

    Whatever is reached leaves the rows still to be reached, so a dense group costs a few passes and not all its pairs.
    """
    links = []
    while len(left) and (right is None or len(right)):
        block = left[:64]
        hit = near(block, left if right is None else right)
        if right is None:
            hit[np.arange(len(block)), np.arange(len(block))] = False
        some = hit.any(1)
        if not some.any():
            left = left[64:]
            continue
        k = int(some.argmax())
        seed, left = left[k], left[k + 1 :]
        fronts = [left[:0], left[:0]]
        reached = hit[k][k + 1 :] if right is None else hit[k]
        rest = [left, left if right is None else right]
        new, rest[1] = rest[1][reached], rest[1][~reached]
        links.append((seed, new))
        fronts[1] = new
        if right is None:
            rest[0] = rest[1]
        while len(fronts[0]) or len(fronts[1]):
            side = 1 if len(fronts[1]) else 0
            other = 1 if right is None else 1 - side
            chunk, fronts[side] = fronts[side][:64], fronts[side][64:]
            if not len(rest[other]):
                continue
            reached = near(chunk, rest[other]).any(0)
            new, rest[other] = rest[other][reached], rest[other][~reached]
            if len(new):
                links.append((seed, new))
                fronts[other] = np.concatenate((fronts[other], new))
        if right is None:
            left = rest[1]
        else:
            left, right = rest
    return links


def _nearness(bits: int, all_bits: int | None):
    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
        ok = d <= bits
        if all_bits is not None and ok.any():
            ok &= d + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1]) <= all_bits
        return ok

    return near


def _names(rows: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in rows.tolist()]


def links_of(prints: DataFrame, groups: list[list[int]], thresholds: list[int], bits: int, all_bits: int | None, part: int) -> DataFrame:
    """Spanning links (a, b) between different fingerprints, by name."""
    spark = prints.sparkSession
    used = [(k, group, t) for k, (group, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    masks = {
        k: np.array([sum(1 << b for b in flips) for r in range(t + 1) for flips in combinations(range(len(group)), r)], np.uint64)
        for k, group, t in used
    }
    key_of = lambda k, value: (value | np.uint64(k << 56)).view(np.int64)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            keys = np.concatenate([key_of(k, values_of(fp, group)) for k, group, _ in used])
            yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])

    counts = prints.select("fp").mapInArrow(posted, "key long").groupBy("key").count()
    often = {key: -(-n // part) for key, n in counts.filter(F.col("count") > part).toLocalIterator()}
    often_keys = np.array(sorted(often), np.int64)
    often_parts = np.array([often[k] for k in often_keys.tolist()], np.int64)

    def dealt(key: np.ndarray, fp: np.ndarray, fp2: np.ndarray, role: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of values that are often posted go to each cell of a grid of parts that may pair them."""
        cell = np.zeros(len(key), np.int64)
        if len(often_keys):
            at = np.minimum(np.searchsorted(often_keys, key), len(often_keys) - 1)
            split = np.flatnonzero(often_keys[at] == key)
            n = often_parts[at[split]]
            own = ((fp[split] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
            row = np.repeat(np.arange(len(split)), n)
            other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            mine, posts = own[row], role[split][row]
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            grid = np.where(posts == 2, low << 24 | high, np.where(posts == 1, mine << 24 | other, other << 24 | mine)) + 1
            whole = np.setdiff1d(np.arange(len(key)), split)
            pick = np.concatenate((whole, split[row]))
            cell = np.concatenate((cell[whole], grid))
            key, fp, fp2, role = key[pick], fp[pick], fp2[pick], role[pick]
        columns = [pa.array(key), pa.array(cell), pa.array(fp.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(role)]
        for begin in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(begin, 100_000) for c in columns], ["key", "cell", "fp", "fp2", "role"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """role 1 posts, 0 probes, 2 does both (a threshold of 0)."""
        for batch in batches:
            fp, fp2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2"))
            for k, group, t in used:
                value = values_of(fp, group)
                roles = np.full(len(fp), 2 if t == 0 else 1, np.int8)
                yield from dealt(key_of(k, value), fp, fp2, roles)
                for mask in masks[k] if t else ():
                    up = (value ^ mask) >= value
                    yield from dealt(key_of(k, value[up] ^ mask), fp[up], fp2[up], np.zeros(int(up.sum()), np.int8))

    near = _nearness(bits, all_bits)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[np.ndarray], roles: list[np.ndarray]) -> tuple[list[str], list[str]]:
            both, role = np.concatenate(rows), np.concatenate(roles)
            if role.max() == 2:
                found = spanning_links(both, None, near)
            else:
                found = spanning_links(np.unique(both[role == 1], axis=0), np.unique(both[role == 0], axis=0), near)
            a, b = [], []
            for seed, new in found:
                new = new[(new != seed).any(1)]
                a += _names(seed[None, :]) * len(new)
                b += _names(new)
            return a, b

        held: tuple | None = None
        rows: list[np.ndarray] = []
        roles: list[np.ndarray] = []
        for batch in batches:
            key, cell, fp, fp2, role = (batch.column(n).to_numpy() for n in ("key", "cell", "fp", "fp2", "role"))
            both = np.stack((fp.view(np.uint64), fp2.view(np.uint64)), 1)
            ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
            bounds = [0, *ends.tolist(), len(key)]
            a, b = [], []
            for begin, end in zip(bounds, bounds[1:], strict=False):
                if begin == end:
                    continue
                if held != (now := (key[begin], cell[begin])):
                    if sum(map(len, rows)) > 1:
                        x, y = done(rows, roles)
                        a, b = a + x, b + y
                    held, rows, roles = now, [], []
                rows.append(both[begin:end])
                roles.append(role[begin:end])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])
        if sum(map(len, rows)) > 1:
            a, b = done(rows, roles)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = prints.mapInArrow(probes, "key long, cell long, fp long, fp2 long, role byte")
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return written(rows.mapInArrow(verified, "a string, b string").distinct())


# ------------------------------------------------------------------ components


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the least name of its component."""

    def state(edges: DataFrame) -> tuple:
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges)
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked(prints: DataFrame, n: int, bits: int, all_bits: int | None) -> DataFrame:
    """Spanning links by name, with partitions and thresholds fitted to ``fp``."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            signs = np.unpackbits(fp, axis=1).astype(np.float64) * 2 - 1
            sums += signs.T @ signs
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(sums.ravel())], ["cell", "n"])

    sums = prints.select("fp").mapInArrow(products, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    correlation = np.zeros(BITS * BITS)
    for cell, value in sums.collect():  # 4096 numbers
        correlation[cell] = abs(value) / max(1, n)
    some = prints.sample(min(1.0, SAMPLE / max(1, n)), seed=5).select("fp").collect()  # some SAMPLE numbers
    sample = np.array([r.fp for r in some], np.int64).view(np.uint64)
    groups, thresholds = plan(sample, correlation.reshape(BITS, BITS), n, bits)
    return links_of(prints.select("fp", "fp2"), groups, thresholds, bits, all_bits, max(PART, int(n * PART_SHARE)))


def near_groups(
    docs: DataFrame, key: str = "doc_id", words: int = 4, bits: int = 4, distinct: bool = False, all_bits: int | None = None
) -> DataFrame:
    """One row per document, without its text: its columns, ``fp``, ``fp2`` and ``component_id``, the least key of its group.

    ``distinct`` counts a shingle once per document. With ``all_bits`` two documents are linked if both fingerprints together
    differ in at most so many bits; one of the two then differs in at most half of them, so each is searched for that many.
    """
    marked = written(with_fingerprints(docs, words, distinct))
    name = F.concat(F.lower(F.lpad(F.hex("fp"), 16, "0")), F.lower(F.lpad(F.hex("fp2"), 16, "0")))
    prints = written(marked.groupBy("fp", "fp2").agg(F.min(key).alias("least_key")))
    n = prints.count()
    if all_bits is None:
        links = linked(prints, n, bits, None)
    else:
        turned = prints.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"))
        back = [F.concat(F.substring(c, 17, 16), F.substring(c, 1, 16)).alias(c) for c in ("a", "b")]
        links = linked(prints, n, all_bits // 2, all_bits).unionByName(linked(turned, n, all_bits // 2, all_bits).select(*back))
    roots = components(links)
    nodes = prints.withColumn("node", name).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least_key").alias("component_id"))
    of_print = nodes.join(least, "root").select("fp", "fp2", "component_id")
    return marked.join(of_print, ["fp", "fp2"]).select(*marked.columns, "component_id")


def near_dedup(docs: DataFrame, key: str = "doc_id", **parameters) -> DataFrame:
    """The rows that stay, one of each group (the least key), with all their columns."""
    mark = F.xxhash64(text_of())
    marked = docs.withColumn("_key2", F.col(key)).withColumn("_mark", mark)
    groups = near_groups(marked.select("_key2", "_mark", "text"), key="_key2", **parameters)
    stay = groups.filter(F.col("_key2").eqNullSafe(F.col("component_id"))).select("_key2", "_mark", "fp", "fp2")
    # a key that repeats may have several texts in one group: the least mark stays, once
    first = stay.groupBy("_key2", "fp", "fp2").agg(F.min("_mark").alias("_mark")).select("_key2", "_mark").distinct()
    # rows that share key and text may differ elsewhere: the order by all columns makes reruns agree
    turn = F.row_number().over(W.partitionBy("_key2", "_mark").orderBy(F.xxhash64(*docs.columns)))
    same = [marked[c].eqNullSafe(first[c]) for c in ("_key2", "_mark")]
    left = marked.join(first, same[0] & same[1], "left_semi")
    return left.withColumn("_turn", turn).filter("_turn = 1").select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
