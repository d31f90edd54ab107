"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size. Its fraction is settled in pairs: two
documents with fractional copies exchange mass (words times probability) at random, without changing either expectation, until
one of them is integral; the other goes on. Blocks of a source do that side by side, what each has left over meets in the next
level of a tree, until one document per source is left. Large documents are settled first; what rounding their last one gains or
loses is spread over the masses of the small ones, and the last of those is rounded to the nearer side. So the words taken of a
source miss its target by half of one small document (half of any document in a source too small for two tiers).

All of it is DataFrame expressions: a block is an array of at most some hundred small structs, folded by ``aggregate``. Random
numbers are hashes of the documents that meet, so that a rerun, whatever its partitions, agrees.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows
are settled each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlake.llm.common import n_words, table, text_of, written

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than that.
REPEATS = 3
#: Leftovers that meet in one fold, on average.
BLOCK = 64
#: Up to so many sources are broadcast, a hundred bytes each; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per source: ``source_size``, ``n_docs``, ``target``. The windows run over one row per source.

    A target is min(cap, level * weight). With sources in order of cap / weight, the level is what is left of the total after
    the caps before, over the weights from there on, at the first source where it doesn't exceed cap / weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = sources.withColumn("_level", (F.sum("source_size").over(everything) - before) / rest)
    fits = F.when(F.col("_level") <= F.col("cap") / F.col("weight"), F.col("_level"))
    level = F.max(fits).over(everything)
    target = F.least("cap", level * F.col("weight"))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def _fold(key_type: str, level: int) -> str:
    """SQL for one block: ``items`` in, the documents settled (``done``) and the one left over (``rest``) out.

    a is what can go from the carried document to the next one, b the way back. Choosing the first with b / (a + b) keeps
    both expectations.
    """
    chance = f"(pmod(xxhash64(i.h, i.mass, acc.rest.h, acc.rest.mass, {level}), 9007199254740992L) / 9007199254740992D)"
    settled = "named_struct('id', {0}.id, 'size', {0}.size, 'h', {0}.h, 'up', {1})".format
    moved = "named_struct('size', {0}.size, 'h', {0}.h, 'id', {0}.id, 'mass', {1})".format
    none = f"CAST(NULL AS struct<size:bigint,h:bigint,id:{key_type},mass:double>)"
    out = "named_struct('rest', {0}, 'done', concat(acc.done, array({1})))".format
    return f"""aggregate(items,
      named_struct('rest', {none}, 'done', CAST(array() AS array<struct<id:{key_type},size:bigint,h:bigint,up:boolean>>)),
      (acc, i) -> CASE
        WHEN i.mass <= 0 OR i.mass >= i.size THEN {out("acc.rest", settled("i", "i.size > 0 AND i.mass >= i.size"))}
        WHEN acc.rest IS NULL THEN named_struct('rest', i, 'done', acc.done)
        ELSE element_at(transform(
          array(named_struct('a', least(acc.rest.mass, i.size - i.mass), 'b', least(i.mass, acc.rest.size - acc.rest.mass), 'u', {chance})),
          m -> CASE
            WHEN m.u * (m.a + m.b) < m.b AND m.a >= acc.rest.mass THEN CASE
              WHEN i.mass + m.a >= i.size THEN {out(none, settled("acc.rest", "false") + ", " + settled("i", "true"))}
              ELSE {out(moved("i", "i.mass + m.a"), settled("acc.rest", "false"))} END
            WHEN m.u * (m.a + m.b) < m.b THEN {out(moved("acc.rest", "acc.rest.mass - m.a"), settled("i", "true"))}
            WHEN m.b >= i.mass THEN CASE
              WHEN acc.rest.mass + m.b >= acc.rest.size THEN {out(none, settled("i", "false") + ", " + settled("acc.rest", "true"))}
              ELSE {out(moved("acc.rest", "acc.rest.mass + m.b"), settled("i", "false"))} END
            ELSE {out(moved("i", "i.mass - m.b"), settled("acc.rest", "true"))} END), 1)
      END)"""


def _settle(state: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Run the tree over (source, block, item): the settled documents, and the one of each source that stays fractional."""
    key_type = state.schema["item"].dataType["id"].dataType.simpleString()
    largest_first = F.array_sort(
        F.collect_list("item"),
        lambda a, b: F.when(a["size"] > b["size"], -1)
        .when(a["size"] < b["size"], 1)
        .when(a["h"] < b["h"], -1)
        .when(a["h"] > b["h"], 1)
        .otherwise(0),
    )
    level, settled = 0, None
    while True:
        folded = state.groupBy("source", "block").agg(largest_first.alias("items"))
        folded = written(folded.select("source", "block", F.expr(_fold(key_type, level)).alias("f")))
        done = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.*")
        settled = done if settled is None else settled.unionByName(done)
        left = folded.filter("f.rest IS NOT NULL")
        if n_blocks <= 1:
            return settled, left.select("source", "f.rest.*")
        n_blocks, level = -(-n_blocks // BLOCK), level + 1
        state = left.select("source", F.floor(F.col("block") / BLOCK).alias("block"), F.col("f.rest").alias("item"))


def mixed_copies(docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per document: key, source, ``h`` (hash of key and text), size, source_size, target, copies."""
    whole = text_of()
    sizes = written(
        docs.select(
            F.col(key).alias("id"), "source", n_words(whole).alias("size"), F.xxhash64(F.col(key), whole).alias("h")
        )
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = source_targets(sizes, weights, repeats).withColumn("ratio", ratio)
    sources = sources.withColumn("share", F.col("ratio") - F.floor("ratio"))

    # the largest size of the second tier: the least power of two below which there is room for any one document's mass
    by_class = sizes.filter("size > 0").groupBy("source", F.ceil(F.log2("size")).alias("class"))
    by_class = by_class.agg(F.sum("size").alias("words"), F.max("size").alias("longest"))
    upward = W.partitionBy("source").orderBy("class")
    all_of = W.partitionBy("source")
    by_class = by_class.withColumn("below", F.sum("words").over(upward)).withColumn("longest", F.max("longest").over(all_of))
    tiers = by_class.join(
        sources.select(F.col("source").alias("_source"), F.least("share", 1 - F.col("share")).alias("room")),
        F.col("source").eqNullSafe(F.col("_source")),
    ).filter(F.col("below") * F.col("room") >= F.col("longest"))
    tiers = tiers.groupBy("_source").agg(F.min("class").alias("class"), F.min("below").alias("small_words"))
    sources = sources.alias("s").join(tiers.alias("t"), F.expr("s.source <=> t._source"), "left").select(
        F.col("s.source").alias("_source"), "source_size", "n_docs", "target", "ratio", "share",
        F.coalesce(F.pow(F.lit(2.0), "class"), F.lit(float("inf"))).alias("small"),
        F.coalesce("small_words", F.lit(0)).alias("small_words"),
    )
    sources = written(sources)
    n_sources, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n_docs"), F.lit(0))).first()

    def of_source(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("_source")), "left")

    block = F.pmod(F.xxhash64("h", F.lit(17)), F.ceil(F.col("n_docs") / BLOCK)).alias("block")
    n_blocks = -(-largest // BLOCK)
    rows = of_source(sizes, sources)
    mass = F.col("size") * F.col("share")
    large = rows.filter(F.col("size") > F.col("small"))
    done, rest = _settle(large.select("source", block, F.struct("size", "h", "id", mass.alias("mass")).alias("item")), n_blocks)
    # the first tier's last document is rounded at random, and the documents of the second tier share what it gained or lost
    chance = F.pmod(F.xxhash64("h", F.lit(29)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rest = written(rest.withColumn("up", chance * F.col("size") < F.col("mass")))
    gained = rest.select(
        F.col("source").alias("_source"), F.when(F.col("up"), F.col("size") - F.col("mass")).otherwise(-F.col("mass")).alias("gain")
    )
    small = rows.filter(F.col("size") <= F.col("small")).drop("_source")
    small = of_source(small, gained)
    part = F.col("share") - F.when(F.col("small_words") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("small_words")).otherwise(F.lit(0.0))
    mass = F.col("size") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))
    done2, rest2 = _settle(small.select("source", block, F.struct("size", "h", "id", mass.alias("mass")).alias("item")), n_blocks)
    columns = ("source", "id", "size", "h", "up")
    rows = done.select(*columns).unionByName(rest.select(*columns)).unionByName(done2.select(*columns))
    rows = rows.unionByName(rest2.withColumn("up", F.col("mass") * 2 >= F.col("size")).select(*columns))
    copies = (F.floor("ratio") + F.when(F.col("up"), 1).otherwise(0)).cast("long")
    return of_source(rows, sources).select(
        F.col("id").alias(key), "source", "h", "size", "source_size", "target", copies.alias("copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    marked = docs.withColumn("_h", F.xxhash64(F.col(key), text_of())).withColumn("_key", F.col(key))
    taken = mixed_copies(docs, key, weights, repeats).select(
        F.col(key).alias("_key2"), F.col("h").alias("_h2"), F.col("copies").alias("_copies")
    )
    left = marked.withColumn("_turn", F.row_number().over(W.partitionBy("_key", "_h").orderBy(F.lit(1))))
    right = taken.withColumn("_turn2", F.row_number().over(W.partitionBy("_key2", "_h2").orderBy(F.desc("_copies"))))
    right = right.filter("_copies > 0")
    same = F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_h") == F.col("_h2")) & (F.col("_turn") == F.col("_turn2"))
    return left.join(right, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixed_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return copies.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
