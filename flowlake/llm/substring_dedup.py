"""Substring dedup: words inside a passage of ``WINDOW`` words that also starts earlier go.

Documents are cut into *segments*: runs of neighbouring windows with the same minimizer, which is the least hash among a
window's ``GRAM``-word parts. Equal windows have equal minimizers, so all occurrences of a window meet in the one shard that its
minimizer is dealt to, and each window of the input lies in exactly one segment. A shard builds a compressed FM-index over its
different segments: suffixes sorted to the depth of a window, the Burrows-Wheeler transform in a wavelet matrix of packed bits,
and symbol counts. The segments are then streamed against it: backward search over the wavelet matrix gives, for each word, how
far to the left its text occurs elsewhere in the shard (the matching statistics, up to the window); where that reaches the
threshold, the first row of the interval is the window's earliest occurrence, for rows that tie are in order of position. A
segment whose common core is found nowhere else needs one short search for all its windows; one whose minimizer no other segment
of the shard has needs none and is not indexed.

Segments that are equal are sent once per block of a task, with the earliest place: a passage in a third of all documents
reaches its shard as some rows per task. Minimizers that a sample shows to be hot (copies that differ around a shared passage)
are dealt by window instead, so that no shard grows with one key. The sample steers the deal and changes no result. A shard
answers with the windows that are first, packed in two numbers a run; whatever window is not among them repeats an earlier
one. Texts move once more, to meet these answers.

Defined cases: a null or empty text has no words; a text of fewer words than a window stays whole; documents are ordered by
key, a null key first, then by a hash of the text; of repeated rows with the same key and text the first stays and the
others repeat it; an empty table gives an empty result. Columns but key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.byte_words import WHITE_SPACE, Words, cut_words
from flowlake.llm.common import small_batches, table, text_of, written

WINDOW = 20
#: Words of the parts whose least hash names a window.
GRAM = 4
#: Windows of a segment at most; a longer run is cut, which changes no result.
RUN = 1024
#: Bytes of text for one shard (segments overlap, so it indexes some three times as much), and of text cut at once in a task.
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20
#: Documents that estimate which minimizers are hot, and the share of a shard's segments from which one is.
SAMPLE, HOT = 20_000, 0.25
#: Rank blocks of the wavelet matrix, in bits.
_BITS = 64
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = np.dtype([("key", "<i8"), ("null", "i1"), ("mark", "<i8"), ("start", "<i4"), ("bytes", "<i4"), ("least", "<u4"), ("again", "i1")])


# ------------------------------------------------------------------ FM-index


class WaveletMatrix:
    """Ranks over a sequence of small numbers, a packed bit vector for each bit of them."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        starts = np.zeros(top + 1, np.int64)
        symbols = np.arange(top + 1)
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            padded = np.zeros(-(-(len(values) + 1) // _BITS) * _BITS, bool)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)))[:-1].astype(np.int32)
            zeros = len(bit) - int(np.count_nonzero(bit))
            self.bits.append(packed)
            self.before.append(before)
            self.zeros.append(zeros)
            starts = self._down(len(self.bits) - 1, ((symbols >> level) & 1).astype(bool), starts)
            values = np.concatenate((values[~bit], values[bit]))
        self.starts = starts

    def _down(self, k: int, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        part = self.bits[k][word] & ((np.uint64(1) << rest) - np.uint64(1))
        rank = self.before[k][word] + np.bitwise_count(part)
        return np.where(ones, self.zeros[k] + rank, at - rank)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        for k in range(self.levels):
            at = self._down(k, ((symbols >> (self.levels - 1 - k)) & 1).astype(bool), at)
        return at - self.starts[symbols]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` symbols that begin there, ties in order of place."""
    n = len(text)

    def joined(rank: np.ndarray, other: np.ndarray, by: int) -> np.ndarray:
        pair = rank * (int(other.max(initial=0)) + 2)
        pair[: n - by] += other[by:] + 1
        return pair

    rank, known, powers = text.astype(np.int64), 1, {1: text.astype(np.int64)}
    while known < depth:
        by = max(p for p in powers if p <= depth - known)
        pair = joined(rank, powers[by], known) if known < n else rank
        order = np.argsort(pair)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        known += by
        powers[known] = rank
    return np.argsort(rank, kind="stable")


class FmIndex:
    """Backward search for patterns of at most ``depth`` symbols; symbol 0 separates texts and is in no pattern."""

    def __init__(self, text: np.ndarray, depth: int):
        top = int(text.max(initial=0))
        self.text = text
        self.places = sorted_suffixes(text, depth).astype(np.int32)
        self.matrix = WaveletMatrix(text[self.places - 1], top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))

    def matches(self, ends: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place in the text: length, first row and rows of the longest match that ends there and occurs elsewhere.

        A search stops when only one row is left, or at ``longest``. Its length then is that of the pattern searched last.
        """
        symbol = self.text[ends]
        low, high = self.first[symbol], self.first[symbol + 1]
        length = np.ones(len(ends), np.int64)
        active = np.flatnonzero((high - low > 1) & (longest > 1))
        while len(active):
            symbol = self.text[ends[active] - length[active]]
            both = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low[active], high[active])))
            base = self.first[symbol]
            low[active], high[active] = base + both[: len(active)], base + both[len(active) :]
            length[active] += 1
            active = active[(high[active] - low[active] > 1) & (length[active] < longest[active])]
        return length, low, high - low


def first_windows(segments: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, in order of place and all different: whether each of its windows occurs nowhere before."""
    if not segments:
        return []
    words = cut_words([s.decode() for s in segments], WHITE_SPACE)
    sizes = np.diff(words.first)
    # a separator before each segment and one at the end
    begin = words.first[:-1] + np.arange(1, len(segments) + 1)
    text = np.zeros(len(words.codes) + len(segments) + 1, np.int64)
    text[np.repeat(begin - words.first[:-1], sizes) + np.arange(len(words.codes))] = words.codes + 1
    index = FmIndex(text, window)
    n_windows = sizes - window + 1
    # the words that all windows of a segment share end with its first window
    core = window - n_windows + 1
    probe = begin + window - 1
    reach = np.where(core >= 1, core, 1)
    length, _, rows = index.matches(probe, reach)
    alone = (core >= 1) & (rows == 1)
    out = [np.ones(n, bool) for n in n_windows.tolist()]
    open_ = np.flatnonzero(~alone)
    counts = n_windows[open_]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(begin[open_], counts) + within
    length, low, rows = index.matches(starts + window - 1, np.full(len(starts), window))
    first = (rows == 1) | (index.places[low] == starts)
    for k, part in zip(open_.tolist(), np.split(first, np.cumsum(counts)[:-1]) if len(counts) else [], strict=True):
        out[k] = part
    return out


# ------------------------------------------------------------------ segments


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in steps that double."""
    known = 1
    while known < width:
        by = min(known, width - known)
        values = np.minimum(values[: len(values) - by], values[by:])
        known += by
    return values


def _grams(words: Words, size: int) -> np.ndarray:
    """A hash of the ``size`` words that begin at each word."""
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words.distinct], np.uint64)[words.codes]
    n = max(0, len(hashed) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = _mixed(out * _ODD + hashed[k : k + n])
    return out


def minimizers(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and their minimizers; windows lie within one text."""
    sizes = np.maximum(np.diff(words.first) - window + 1, 0)
    starts = np.repeat(words.first[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    return starts, _least(_grams(words, GRAM), window - GRAM + 1)[starts]


def runs(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments as first window, windows, and minimizer."""
    starts, least = minimizers(words, window)
    if not len(starts):
        return starts, starts, least
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (np.diff(starts) != 1)))
    at = np.arange(len(starts))
    opened = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - opened) % RUN == 0
    heads = np.flatnonzero(new)
    return starts[heads], np.diff(np.concatenate((heads, [len(starts)]))), least[heads]


def _repeats_inside(words: Words, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether equal windows within one segment can't be ruled out: they need a part that comes twice in it."""
    grams = _grams(words, GRAM)
    twice = np.zeros(len(grams) + 1, np.int64)
    most = WINDOW - GRAM + 1  # windows that can share one place of their minimizer
    for by in range(1, min(most + WINDOW - GRAM, len(grams))):
        twice[1 : len(grams) - by + 1] |= grams[by:] == grams[:-by]
    twice = np.cumsum(twice)
    return (n > 1) & ((n > most) | (twice[start + n + WINDOW - GRAM] > twice[start]))


def _normal_bytes(words: Words) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and where each begins."""
    sizes = np.diff(words.offsets)
    out = np.full(len(words.data) + len(sizes), 32, np.uint8)
    shift = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(words.data)) + shift] = words.data
    return out.tobytes(), words.offsets + np.arange(len(sizes) + 1)


def _segments(rows: dict[str, list], hot: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """The different segments of a block, a packed row for each shard that some are dealt to."""
    order = sorted(range(len(rows["text"])), key=lambda i: (rows["key"][i] is not None, rows["key"][i] or 0, rows["mark"][i]))
    words = cut_words([rows["text"][i] for i in order], WHITE_SPACE)
    start, n, least = runs(words)
    if not len(start):
        return
    apart = np.isin(least, hot)
    times = np.where(apart, n, 1)  # a hot minimizer's windows go one by one
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    apart, start, n, least = (np.repeat(v, times) for v in (apart, start, n, least))
    start, n = start + inner, np.where(apart, 1, n)
    text, at = _normal_bytes(words)
    begin, end = at[start], at[start + n + WINDOW - 1] - 1
    name = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)
    shard = (np.where(apart, name, _mixed(least)) % np.uint64(shards)).astype(np.int64)
    kept = np.sort(np.unique(name, return_index=True)[1])  # the earliest of equal ones
    kept = kept[np.argsort(shard[kept], kind="stable")]
    doc = np.searchsorted(words.first, start[kept], side="right") - 1
    facts = np.zeros(len(kept), _SEGMENT)
    facts["key"] = np.array([rows["key"][i] or 0 for i in order], np.int64)[doc]
    facts["null"] = np.array([rows["key"][i] is None for i in order])[doc]
    facts["mark"] = np.array([rows["mark"][i] for i in order], np.int64)[doc]
    facts["start"] = start[kept] - words.first[doc]
    facts["bytes"] = (end - begin)[kept]
    facts["least"] = least[kept] >> np.uint64(32)
    facts["again"] = _repeats_inside(words, start[kept], n[kept])
    bounds = np.flatnonzero(np.diff(shard[kept], prepend=-1, append=shards))
    begins, ends = begin[kept].tolist(), end[kept].tolist()
    pack = zstandard.ZstdCompressor(level=3).compress
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        parts = b"".join(text[x:y] for x, y in zip(begins[a:b], ends[a:b], strict=True))
        # facts column by column, which packs better
        columns = b"".join(np.ascontiguousarray(facts[c][a:b]).tobytes() for c in _SEGMENT.names)
        yield int(shard[kept[a]]), pack(np.int64(b - a).tobytes() + columns + parts)


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    facts, at = np.zeros(n, _SEGMENT), 8
    for column in _SEGMENT.names:
        kind = _SEGMENT.fields[column][0]
        facts[column] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    ends = (np.cumsum(facts["bytes"]) + at).tolist()
    return facts, [data[a:b] for a, b in zip([at, *ends[:-1]], ends, strict=True)]


def _hot_minimizers(rows: DataFrame, n_rows: int, shards: int) -> np.ndarray:
    """Minimizers that the sample finds in more than ``HOT`` of a mean shard's segments; fewer than shards / ``HOT`` can be."""
    sampled = rows.sample(min(1.0, SAMPLE / max(1, n_rows)), seed=13) if n_rows > SAMPLE else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = np.unique(runs(cut_words(batch.column(0).to_pylist(), WHITE_SPACE))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts, pa.int64())], ["name", "n"])

    counted = sampled.select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    counted = written(counted.filter("n > 1"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # in a small sample a handful is no sign
    least = max(16.0, HOT * total / shards)
    names = [row["name"] for row in counted.filter(F.col("n") > least).select("name").collect()]
    return np.array(sorted(names), np.int64).view(np.uint64)


def _first_runs(rows: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """key, mark, and packed (start, windows): the runs of windows that are the first of their kind."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"key": [], "mark": [], "text": []}
        size = 0

        def settled() -> pa.RecordBatch:
            dealt = list(_segments(held, hot, shards))
            arrays = [pa.array([s for s, _ in dealt], pa.int32()), pa.array([b for _, b in dealt], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "blob"])

        for batch in batches:
            for key, mark, text in zip(*(batch.column(c).to_pylist() for c in held), strict=True):
                held["key"].append(key)
                held["mark"].append(mark)
                held["text"].append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield settled()
                    held, size = {"key": [], "mark": [], "text": []}, 0
        if held["key"]:
            yield settled()

    def judge(group: pa.Table) -> pa.Table:
        parts = [_unpacked(blob) for blob in group.column("blob").to_pylist()]
        facts, texts = np.concatenate([f for f, _ in parts]), [t for _, ts in parts for t in ts]
        order = np.lexsort((facts["start"], facts["mark"], facts["key"], facts["null"] == 0))
        earliest: dict[bytes, int] = {}
        for i in order.tolist():
            earliest.setdefault(texts[i], i)
        kept = list(earliest.values())
        # equal windows share their minimizer; where no other segment has it, there is nothing to search
        _, name, times = np.unique(facts["least"][kept], return_inverse=True, return_counts=True)
        shared = (times[name] > 1) | (facts["again"][kept] == 1)
        first = [np.ones(max(1, text.count(b" ") + 2 - WINDOW), bool) for text in earliest]
        searched = first_windows([text for text, several in zip(earliest, shared.tolist(), strict=True) if several])
        for k, judged in zip(np.flatnonzero(shared).tolist(), searched, strict=True):
            first[k] = judged
        sizes = np.array([len(f) for f in first])
        flags = np.concatenate(first)
        at = np.arange(len(flags)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        opens = np.flatnonzero(flags & ((at == 0) | ~np.concatenate(([False], flags[:-1]))))
        closes = np.flatnonzero(flags & ((at == np.repeat(sizes, sizes) - 1) | ~np.concatenate((flags[1:], [False]))))
        owner = np.repeat(np.array(kept), sizes)[opens]
        start, n = facts["start"][owner].astype(np.int64) + at[opens], closes - opens + 1
        key = pa.array(facts["key"][owner], mask=facts["null"][owner] == 1)
        return pa.table([key, pa.array(facts["mark"][owner]), pa.array((start << 11) | n)], ["key", "mark", "run"])

    dealt = rows.mapInArrow(deal, "shard int, blob binary")
    return dealt.groupBy("shard").applyInArrow(judge, "key long, mark long, run long")


# ------------------------------------------------------------------ documents


def _covered(n_words: int, packed: list[int] | None) -> np.ndarray:
    """Which words lie in a window that is not among the first of their kind; ``None``: no window is."""
    n = n_words - WINDOW + 1
    if n <= 0:
        return np.zeros(n_words, bool)
    edges = np.zeros(n_words + 1, np.int64)
    again = np.ones(n, np.int64)
    for value in packed or ():
        again[value >> 11 : (value >> 11) + (value & 2047)] = 0
    edges[:n] += again
    edges[WINDOW : n + WINDOW] -= again
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_removed, kept (the words that stay, joined by one space), removed (spans of words)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    first = _first_runs(rows, _hot_minimizers(rows, n_rows, shards), shards)
    first = written(first, release=True)
    # repeated rows meet in the tasks that read them, so that a row in a third of the table is no hot key
    on = [F.coalesce("key", F.lit(0)).alias("k"), F.col("key").isNull().alias("null"), "mark"]
    same = rows.groupBy(*on).agg(F.min("key").alias("key"), F.any_value("text").alias("text"), F.count("*").alias("copies"))
    found = first.groupBy(*on).agg(F.collect_list("run").alias("runs"))
    met = same.join(found, ["k", "null", "mark"], "left").select("key", "text", "copies", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            done = []
            for name, value, copies, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = value.encode().split()
                for judged, times in ((packed, 1), (None, copies - 1)):
                    if not times:
                        continue
                    gone = _covered(len(words), judged)
                    turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    spans = [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode() if spans else b" ".join(words).decode()
                    done += [(name, len(words), int(gone.sum()), kept, spans)] * times
            columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n_words", "n_removed", "kept", "removed"])

    out = met.mapInArrow(run, "key long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
    return out.withColumnRenamed("key", key)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

