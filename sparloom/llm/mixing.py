"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a target number of words: its weight's share, but no more than `cap` times its size,
the excess being reshared until no source is above. Targets come from a few aggregates over the table
of sources, so their number has no bound. A source's documents are dealt by hash into blocks, and the
blocks are put into a random order (a second order for the second round of a source that is used
more than once). The blocks whose words lie below the target are its quota. The quotas are split among
the output shards by a binary tree: at every node the left half of the shards draws its share of blocks
without replacement from what the node has, so every shard gets an exact quota of every source. Shards
then take disjoint ranges of the permuted blocks, and rows are shuffled inside their shard. In the one
block that a source's target cuts, documents are taken in hash order until the target is met; the last
of them is taken in part.

The tree is planned on the driver for shards times units, at most CELLS. A unit is a source, or, where
there are more sources than that allows, a pool of sources by hash: drawing for pools and dealing a
pool's blocks in random order is the same draw. There are as many shards as words fill, and blocks in
proportion to the shards.

Everything is drawn from hashes and a seed, so reruns agree. No task holds a whole source, but for its
list of blocks (a few numbers each); only the block that is cut is ordered by document.

Rows: a null text has no words; a null source is a source of its own, ordered last; repeated rows
are taken each by itself; texts of any length are counted whole; empty documents are never taken; a null
doc_id is carried; equal orders are settled by the row's hash. Extra columns are ignored by draw() and
kept by mix().
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.llm.common import FEW, WORD, Scratch

#: Shards times units of the tree on the driver.
CELLS = 1 << 20
#: Words of an output shard, some 100 MB of text; smaller inputs have LEAST_SHARDS.
SHARD_WORDS, LEAST_SHARDS = 16_000_000, 64
#: Blocks for each shard, of all sources, and of a source at least (if it has four documents a block).
BLOCKS_A_SHARD, LEAST_BLOCKS = 16, 512


def water_level(sources: DataFrame, share: Fraction, cap: int) -> Fraction:
    """The words for each unit of weight of a source that is not capped. sources: size, weight.

    Sources whose cap lies below the level are capped, which raises the level for the others; each round
    is one aggregate, and levels only rise until no further source is capped.
    """
    total = None
    level, capped = Fraction(0), -1
    while True:
        over = F.col("weight") * F.lit(float(level)) > F.col("size") * cap
        r = sources.agg(F.sum("size"), F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)).first()
        total = min(share, cap) * (r[0] or 0)
        if r[3] == capped or not r[2]:
            return level
        level, capped = (total - cap * r[1]) / Fraction(r[2]), r[3]


def planned(scratch: Scratch, rows: DataFrame, weights: tuple[int, ...], share: Fraction, cap: int) -> DataFrame:
    """(s, name, source_size, n, weight, target, words): a row per source, s its place by code point."""
    by_name = [F.col("name").asc_nulls_last()]
    per_source = rows.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    # placed by a sort over all tasks and the rows of the parts before
    parts = scratch.save(per_source.sort(*by_name).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = before.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = parts.join(F.broadcast(before), "part").withColumn("s", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*by_name)) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("s") % len(weights)).cast("int"))
    sources = scratch.save(placed.select("s", "name", F.col("size").alias("source_size"), "n", weight.cast("bigint").alias("weight")))
    level = water_level(sources.select(F.col("source_size").alias("size"), "weight"), share, cap)
    # the level times each of the few weights is worked out exactly
    of = lambda f: F.coalesce(*[F.when(F.col("weight") == w, F.lit(f(level * w))) for w in sorted(set(weights))])
    over = F.col("weight") * F.lit(float(level)) > F.col("source_size") * cap
    capped = F.col("source_size") * cap
    return sources.select("*", F.when(over, capped.cast("double")).otherwise(of(float)).alias("target"), F.when(over, capped).otherwise(of(int)).cast("bigint").alias("words"))


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard gets; columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = int(have.sum())
        share = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, share, method="marginals") if total else have
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def draw(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, shards: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and takes, an array of (round, shard, words), by row of docs.

    row_hi and row_lo name the row by all its columns. Without `shards`, words decide their number.
    """
    return _drawn(spark, docs, weights, share, cap, shards, seed)[0]


def _drawn(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, int]:
    """What draw() gives, and the number of shards."""
    scratch = Scratch(spark, "mixing")
    rows = scratch.save(
        docs.select(
            docs["doc_id"], docs["source"], F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("bigint").alias("size"), *_row_hash(docs),
        )
    )
    sources = scratch.save(planned(scratch, rows, weights, share, cap))
    n_sources, n, words = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = shards or max(LEAST_SHARDS, math.ceil(words / SHARD_WORDS))
    units = max(1, CELLS // shards)
    wanted = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.lit(BLOCKS_A_SHARD * shards / max(1, n)) * F.col("n")))
    by_source = sources.select("s", "name", "source_size", "target", "words", F.greatest(F.lit(1), F.least(wanted, F.expr("n div 4"))).alias("n_blocks"))
    if n_sources <= FEW:
        by_source = F.broadcast(by_source)
    dealt = rows.join(by_source, F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.expr(f"pmod(xxhash64({seed}, row_hi), n_blocks)"))
    # the words of a source's blocks in permuted order, round after round
    lists = dealt.groupBy("s", "block", "words").agg(F.sum("size").alias("block_words")).withColumn("round", F.explode(F.array(*map(F.lit, range(cap)))))
    before = Window.partitionBy("s").orderBy("round", F.xxhash64(F.lit(seed + 1), "round", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    quota = lists.withColumn("start", F.coalesce(F.sum("block_words").over(before), F.lit(0))).filter("start < words and block_words > 0")
    unit = F.col("s") if n_sources <= units else F.pmod(F.xxhash64(F.lit(seed + 4), "s"), F.lit(units))
    in_unit = Window.partitionBy("unit").orderBy(F.xxhash64(F.lit(seed + 5), "s", "round", "block"), "s", "round", "block")
    quota = scratch.save(quota.withColumn("unit", unit.cast("bigint")).withColumn("rank", F.row_number().over(in_unit).cast("bigint") - 1))
    counts = sorted((r["unit"], r["n"]) for r in quota.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect())  # at most `units` rows
    tree = splitting_tree([k for _, k in counts], shards, seed)
    ends = tree.cumsum(0)
    shard, u = np.nonzero(tree)
    ranges = pa.table({"unit": pa.array(np.array([x for x, _ in counts], np.int64)[u]), "shard": pa.array(shard.astype(np.int32)), "lo": pa.array((ends - tree)[shard, u]), "hi": pa.array(ends[shard, u])})
    dealt_to = spark.createDataFrame(ranges).select("unit", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("rank"))
    part = F.struct("round", "shard", F.least(F.col("words") - F.col("start"), F.col("block_words")).alias("quota"), "block_words")
    plans = scratch.save(quota.join(dealt_to, ["unit", "rank"]).groupBy("s", "block").agg(F.sort_array(F.collect_list(part)).alias("plan")))
    with_plan = dealt.join(plans, ["s", "block"], "left").withColumn("plan", F.coalesce("plan", F.array().cast(plans.schema["plan"].dataType)))
    # the blocks that a target cuts, one a source at most, are ordered by document
    cut = F.exists("plan", lambda p: p["quota"] < p["block_words"])
    in_block = Window.partitionBy("s", "block").orderBy(F.xxhash64(F.lit(seed + 2), "row_hi"), "row_hi", "row_lo").rowsBetween(Window.unboundedPreceding, -1)
    whole = with_plan.filter(~cut).withColumn("before", F.lit(0).cast("bigint"))
    parts = with_plan.filter(cut).withColumn("before", F.coalesce(F.sum("size").over(in_block), F.lit(0)))

    def take(p: Column) -> Column:
        some = F.greatest(F.lit(0), F.least(F.col("size"), p["quota"] - F.col("before")))
        return F.struct(p["round"].alias("round"), p["shard"].alias("shard"), F.when(p["quota"] == p["block_words"], F.col("size")).otherwise(some).cast("bigint").alias("words"))

    takes = F.filter(F.transform("plan", take), lambda t: t["words"] > 0)
    return whole.unionByName(parts).select("doc_id", "size", "source_size", "target", takes.alias("takes"), "row_hi", "row_lo"), shards


def _row_hash(docs: DataFrame) -> list[Column]:
    """128 bits over all columns, nulls told from values; map columns count as their entries."""
    parts = []
    for f in docs.schema.fields:
        c = docs[f.name]
        parts += [F.map_entries(c) if f.dataType.typeName() == "map" else c, c.isNull()]
    return [F.xxhash64(*parts).alias("row_hi"), F.xxhash64(F.lit(0x5EED), *parts).alias("row_lo")]


def mix(spark: SparkSession, docs: DataFrame, shards: int | None = None, seed: int = 7, **options) -> DataFrame:
    """The mixed documents: docs' columns, a row for each taking, partly taken texts cut after their
    last taken word, ordered at random inside each output shard; a shard is a partition.
    """
    drawn, shards = _drawn(spark, docs, shards=shards, seed=seed, **options)
    takes = Scratch(spark, "mixed").save(drawn.select("row_hi", "row_lo", "size", F.explode("takes").alias("take")).select("row_hi", "row_lo", "size", "take.*"))
    # equal rows are equal in every column: one of them stands for all, each taking is a row
    contents = docs.select(*_row_hash(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row")).groupBy("row_hi", "row_lo").agg(F.first("row").alias("row"))
    out = contents.join(takes, ["row_hi", "row_lo"])
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("row.text"))
    shuffled = out.select("row", text.alias("cut_text"), "shard", F.xxhash64(F.lit(seed + 3), "round", "row_hi").alias("order"))
    shuffled = shuffled.repartitionById(shards, F.col("shard")).sortWithinPartitions("order")
    return shuffled.select(*[(F.col("cut_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
