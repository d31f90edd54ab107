"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one in-memory database per worker.

Tasks get Arrow batches of whole texts. Texts are cut at their spaces as one Arrow column, and each different cut is looked up
once per batch. Pre-tokens that a task does not remember (and that are not tokens themselves) are contracted: a word is a row
that lists its tokens, each with the rank of the pair it begins; each step of the recursion takes the word's leftmost pair of
minimum rank and joins only the two pairs that the new token makes with its neighbours to the merge table, until no pair is in
the table. Long words are token-position rows and contract all occurrences of the minimum pair that do not overlap in one step,
unless the new token could take part in a merge of a lower rank. A query runs a bounded number of steps and hands unfinished
words to the next one, so memory stays in proportion to one batch. Ids are decoded by joining the token table and an ordered
aggregation per document.

The plan has no shuffle: documents are independent, and caches hold only what is recomputed at need. Parts met in a second batch
are remembered apart from those met once, so rare ones do not displace them. Caches last for a task: a worker outlives it, and its
executor's memory is shared with whatever runs next.

Defined cases: null is the empty text (no tokens, the hash of nothing); further columns stay; repeated rows are encoded each;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import give_back, small_batches, table
from flowlake.llm.pretokens import Pretokens

#: Text parts that a task remembers of those met in one batch, and of those met in more; beyond, it forgets the former, or
#: keeps those of the batch at hand of the latter.
CACHE = 250_000
#: Pre-tokens that one recursive query takes; a step holds their lists.
WORDS = 50_000
#: Long pre-tokens that one recursive query takes; its steps add up in memory.
LONG_WORDS = 20_000
#: Bytes from which a pre-token counts as long.
LONG = 48
#: Steps of one recursive query.
STEPS = 60
#: Tokens that one decoding query takes.
DECODE_TOKENS = 200_000

#: A listed token is one number: the rank of the pair that it begins, its place in the word, its id, in so many bits. The least
#: number of a list is then its leftmost pair of minimum rank. ``NONE`` as a rank is no pair, as an id the front of the word.
ID_BITS, PLACE_BITS = 21, 20
RANK_AT = ID_BITS + PLACE_BITS
NONE = (1 << ID_BITS) - 1
FRONT = NONE << RANK_AT | NONE

#: The leftmost pair of minimum rank, at k, becomes one token; the token before it and the new one get the ranks of their pairs.
_ONE = """
WITH RECURSIVE r(i, w, v) AS (
  SELECT 0, w, v FROM word_lists
  UNION ALL (
    WITH lists AS (SELECT i, w, v, list_min(v) AS low FROM r WHERE i < {steps}),
    found AS (SELECT *, low >> {rank_at} AS id, list_position(v, low) AS k FROM lists WHERE (low >> {rank_at}) < {none}),
    pairs AS (
      SELECT *, v[k - 1] & {unranked} AS before, ((v[k - 1] & {none}) << {id_bits}) | id AS left_pair,
        (id << {id_bits}) | (v[k + 2] & {none}) AS right_pair
      FROM found
    )
    SELECT i + 1, w, list_concat(v[: k - 2], [
        (coalesce(x.rank, {none}) << {rank_at}) | before,
        (coalesce(y.rank, {none}) << {rank_at}) | (low & {unranked} & ~{none}) | id
      ], v[k + 2 :])
    FROM pairs LEFT JOIN merges x ON x.pair = left_pair LEFT JOIN merges y ON y.pair = right_pair
  )
)
SELECT w, v, (list_min(v) >> {rank_at}) = {none} AS done FROM r WHERE done OR i = {steps} ORDER BY w
"""
#: Rows of a word stand at ascending p. A word without a pair in the table leaves the recursion as done; a word with one goes on
#: without the rows that its pairs' second tokens had: every second one of neighbouring pairs of minimum rank, or the leftmost
#: only where the token asks for it.
_ALL = """
WITH RECURSIVE r(i, w, p, id, done) AS (
  SELECT 0, w, p, id, false FROM word_tokens
  UNION ALL (
    WITH pairs AS (
      SELECT i, w, p, id, lead(id) OVER o AS follower, CASE WHEN lead(w) OVER o = w THEN lead(p) OVER o END AS q
      FROM r WHERE NOT done AND i < {steps} WINDOW o AS (ORDER BY p)
    ), found AS (
      SELECT w, p, q, rank, alone, rank * 1073741824 + p AS place
      FROM pairs JOIN merges ON merges.a = pairs.id AND merges.b = pairs.follower WHERE q IS NOT NULL
    ), best AS (SELECT w, min(place) AS place FROM found GROUP BY w
    ), marked AS (
      SELECT pairs.*, best.place AS least, found.rank, found.alone, row_number() OVER (ORDER BY pairs.p) AS n
      FROM pairs LEFT JOIN best USING (w)
      LEFT JOIN found ON found.p = pairs.p AND found.rank = best.place // 1073741824
    ), runs AS (SELECT *, max(CASE WHEN rank IS NULL THEN n END) OVER (ORDER BY p) AS other FROM marked
    ), hits AS (
      SELECT *, rank IS NOT NULL AND CASE WHEN alone THEN p = least % 1073741824 ELSE (n - coalesce(other, 0)) % 2 = 1 END AS hit
      FROM runs
    ), ends AS (SELECT *, lag(hit) OVER (ORDER BY p) AS hit_before FROM hits)
    SELECT i + 1, w, p, CASE WHEN hit THEN rank ELSE id END, least IS NULL FROM ends WHERE NOT coalesce(hit_before, false)
  )
)
SELECT w, p, id, done FROM r WHERE done OR i = {steps} ORDER BY p
"""


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist, which makes a scalar of each


class BytePairs:
    """Encoder and decoder of one rank file, with its tables in an in-memory DuckDB."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pretokens = Pretokens(pattern)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        left, right, merged = [], [], []
        lowest: dict[int, int] = {}  # by token: the least rank of a longer token that starts or ends with it
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                for part in (a, b):
                    if part is not None and rank < lowest.get(part, rank + 1):
                        lowest[part] = rank
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        if max(self.ranks.values()) >= NONE:
            raise ValueError(f"ranks must be below {NONE}")
        alone = [lowest.get(rank, rank) < rank for rank in merged]
        a, b, rank = np.array(left, "i8"), np.array(right, "i8"), np.array(merged, "i8")
        self._table("merges", a=a, b=b, pair=a << ID_BITS | b, rank=rank, alone=np.array(alone))
        self._table("tokens", id=np.array(list(self.ranks.values()), "i8"), piece=[token.hex() for token in self.ranks])
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], "i8")
        self.byte_pairs = np.full((256, 256), NONE, "i8")  # the rank of two bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
        self.once: dict[str, str] = {}
        self.often: dict[str, str] = {}

    def _table(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, words: list[bytes], query: str) -> list[list[int]]:
        """The ids of each word, by either query."""
        return self._contract_lists(words).to_pylist() if query is _ONE else self._contract_rows(words)

    def _contract_lists(self, words: list[bytes]) -> pa.Array:
        n, raw = len(words), np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(word) for word in words])
        ends = np.cumsum(lengths)
        rank = np.full(len(raw), NONE, "i8")
        rank[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        rank[ends - 1] = NONE
        place = np.arange(len(raw)) - np.repeat(ends - lengths, lengths)
        listed = np.full(len(raw) + n, FRONT, "i8")
        listed[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), lengths)] = rank << RANK_AT | place << ID_BITS | self.byte_ids[raw]
        w, v = pa.array(np.arange(n)), pa.LargeListArray.from_arrays(np.concatenate(([0], ends + np.arange(1, n + 1))), listed)
        query = _ONE.format(steps=STEPS, rank_at=RANK_AT, none=NONE, id_bits=ID_BITS, unranked=(1 << RANK_AT) - 1)
        got = []
        while len(w):
            self._table("word_lists", w=w, v=v)
            rows = self.db.sql(query).to_arrow_table().combine_chunks()
            got.append(rows.filter(rows["done"]))
            rest = rows.filter(pc.invert(rows["done"])).combine_chunks()
            w, v = rest["w"], rest["v"]
        every = pa.concat_tables(got).sort_by("w")["v"].combine_chunks()
        sizes = pc.list_value_length(every).to_numpy() - 1
        values = every.flatten().to_numpy()
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype("i4"), values[values != FRONT] & NONE)

    def _contract_rows(self, words: list[bytes]) -> list[list[int]]:
        done: list[list[int]] = [[] for _ in words]
        lengths = np.array([len(word) for word in words])
        w, ids = np.repeat(np.arange(len(words)), lengths), self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        p = np.arange(len(ids))
        while len(w):
            self._table("word_tokens", w=w, p=p, id=ids)
            got = self.db.execute(_ALL.format(steps=STEPS)).fetchnumpy()
            over = np.asarray(got["done"])
            w, p, ids = (np.asarray(got[c]) for c in ("w", "p", "id"))
            finished, values = w[over], ids[over].tolist()
            ends = np.flatnonzero(np.diff(finished, append=-1)) + 1
            begins = np.concatenate(([0], ends))
            for word, begin, end in zip(finished[ends - 1].tolist(), begins.tolist(), ends.tolist()):  # noqa: B905
                done[word] = values[begin:end]
            w, p, ids = w[~over], p[~over], ids[~over]
        return done

    def _recall(self, parts: list[str]) -> tuple[dict[str, str], list[str]]:
        """The remembered ids of those parts that have any, and the other parts."""
        known, new = {}, []
        for part in parts:
            if (ids := self.often.get(part)) is None:
                if (ids := self.once.pop(part, None)) is None:
                    new.append(part)
                    continue
                self.often[part] = ids
            known[part] = ids
        return known, new

    def _contract_words(self, words: list[str]) -> dict[str, str]:
        """Ids of pre-tokens, in decimal, joined by spaces."""
        out: dict[str, str] = {}
        short, long = [], []
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[word] = str(rank)
            else:
                (long if len(raw) >= LONG else short).append(word)
        for every, at_once, query in ((short, WORDS, _ONE), (long, LONG_WORDS, _ALL)):
            for begin in range(0, len(every), at_once):
                some = every[begin : begin + at_once]
                raws = [word.encode() for word in some]
                ids = self._contract_lists(raws) if query is _ONE else pa.array(self._contract_rows(raws), pa.list_(pa.int64()))
                joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
                out.update(zip(some, _strings(joined), strict=True))
        return out

    def _recall(self, parts: list[str]) -> tuple[list[str | None], list[int]]:
        """The remembered ids of the parts, and the places of those that have none."""
        ids, new = list(map(self.often.get, parts)), []
        for k in [k for k, value in enumerate(ids) if value is None]:
            if (value := self.once.pop(parts[k], None)) is None:
                new.append(k)
            else:
                self.often[parts[k]] = ids[k] = value
        return ids, new

    def _encode_parts(self, parts: list[str]) -> list[str]:
        """The ids of different parts of texts, in decimal, joined by spaces."""
        ids, new = self._recall(parts)
        words, several = set(), {}
        for k in new:
            pieces = self.pretokens.split(parts[k])
            if len(pieces) == 1 and pieces[0] == parts[k]:
                words.add(parts[k])
            else:
                several[k] = tuple(pieces)
        inner = set().union(*several.values()) - words
        apart = {word for word in inner if self.pretokens.split(word) != [word]}  # as a part, such a word has other ids
        inner = list(inner - apart)
        found, missing = self._recall(inner)
        if len(self.once) > CACHE:  # those of this batch have moved on
            self.once = {}
        if len(self.often) > CACHE:
            self.often = {part: self.often[part] for part in (*parts, *inner) if part in self.often}
        fresh = self._contract_words([*words, *(inner[k] for k in missing)])
        self.once.update(fresh)
        fresh.update(self._contract_words(list(apart)))
        fresh.update((word, value) for word, value in zip(inner, found, strict=True) if value is not None)
        for k in new:
            if (pieces := several.get(k)) is None:
                ids[k] = fresh[parts[k]]
            else:
                ids[k] = self.once[parts[k]] = " ".join([fresh[word] for word in pieces])
        return ids

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, in decimal, joined by spaces."""
        parts, ends = self.pretokens.parts(texts)
        coded = parts.dictionary_encode()
        ids = pa.array(self._encode_parts(_strings(coded.dictionary)), pa.large_string()).take(coded.indices)
        return pc.binary_join(pa.ListArray.from_arrays(ends.astype("i4"), ids), pa.scalar(" ", pa.large_string()))

    def encode(self, texts: list[str]) -> list[str]:
        return self.encode_column(pa.array(texts, pa.large_string())).to_pylist()

    def rest(self) -> None:
        """Between tasks a worker holds its tables and no more: other operators' tasks run beside it and in it."""
        self.once, self.often = {}, {}
        for name in ("word_lists", "word_tokens", "token_rows"):
            self.db.execute(f"DROP TABLE IF EXISTS {name}")
        give_back()

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        return self.decode_flat(np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(x) for x in ids], np.int64))

    def decode_flat(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each document, of as many of the ids as its size."""
        out, begin, ends = [], 0, np.concatenate(([0], np.cumsum(sizes)))
        while begin < len(sizes):  # so many documents that their tokens fit one query; a document that is longer goes alone
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + DECODE_TOKENS, "right")) - 1)
            flat, part = ids[ends[begin] : ends[end]], sizes[begin:end]
            self._table("token_rows", d=np.repeat(np.arange(len(part)), part), p=np.arange(len(flat)), id=flat)
            got = self.db.execute(
                "SELECT d, string_agg(piece, '' ORDER BY p) AS text FROM token_rows JOIN tokens USING (id) GROUP BY d"
            ).fetchall()
            found = dict(got)
            out += [bytes.fromhex(found.get(d, "")) for d in range(len(part))]
            begin = end
        return out


_WORKER: dict[tuple[str, str], BytePairs] = {}


def _pairs(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = BytePairs(path, pattern)
    return _WORKER[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The documents with ``token_ids`` (decimal, joined by spaces), ``n_tokens`` and the ``decoded`` bytes; the text goes."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, "token_ids", "n_tokens", "decoded")]
    schema = T.StructType(
        [*kept, T.StructField("token_ids", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]
    )
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(path, pattern)
        try:
            yield from coded(pairs, batches)
        finally:
            pairs.rest()

    def coded(pairs: BytePairs, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = pairs.encode_column(batch.column("_text").fill_null("").cast(pa.large_string()))
            ids = np.fromstring(" ".join(filter(None, _strings(encoded))) or " ", np.int64, sep=" ")
            sizes = np.where(pc.equal(encoded, "").to_numpy(False), 0, pc.count_substring(encoded, " ").to_numpy() + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    encoded.cast(pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(pairs.decode_flat(ids, sizes), pa.binary()),
                ],
                [*names, "token_ids", "n_tokens", "decoded"],
            )

    return docs.select(*names, docs[text].alias("_text")).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
