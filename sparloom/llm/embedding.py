"""Embedding near-dedup by sorted projection passes.

Equal vectors are folded into classes first. In each pass every class gets a code, the signs of its
products with random directions, strung together; classes are ordered by code and each is compared with
the `window` classes that follow it. Verified pairs of all passes make up the components.

1. Two passes carry the vectors themselves and verify pairs on the spot. They tie crowds of near copies
   together, handing on a forest of links, and show how dense the order is.
2. The other passes carry a sketch of 256 signs in place of the vector. Pairs of different components
   so far whose sketches differ in few signs are candidates; only their vectors are fetched and verified.
3. Windows can't see all pairs of a crowd, so the pairs inside each component are counted exactly, in
   blocks of rows: no task holds a whole component, no pair is written out.

A pair at the threshold t agrees in a sign with probability q = 1 - acos(t)/pi, and meets in a pass if
it agrees in the leading signs that it takes there to tell a row from the one `window` places on. That
number of signs is measured on every row, so it follows the size of the table and the density around the
row, and there are as many passes as leave a lone pair at the threshold unmet with probability `miss`
on average. Sketches pass such a pair but for one in some ten thousand.

Rows: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
vectors of different lengths with each other. Repeated rows are vectors of their own. A null vec_id
is carried; it names a component only if that has no other id. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.common import FEW, Scratch, columns_free_of, components, grouped_for_join, tidy

#: Leading signs of a code; the number of the pass stands above them.
CODE_BITS = 52
#: Signs of a sketch.
SKETCH = 256
#: Window of the passes that carry vectors.
FIRST_WINDOW, FIRST_PASSES = 32, 2
#: Rows of a block in the exact count, by the members of its component: small ones are dealt out
#: finely, large ones in few copies.
COUNT_BLOCK = 1024
BLOCKS = ((1 << 16, 8192), (4096, COUNT_BLOCK), (0, 128))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, one_pass: int, seed: int) -> np.ndarray:
    """The sign codes of a pass as a bigint, most significant sign first, below the pass's number."""
    directions = np.random.default_rng([seed, one_pass, x.shape[1]]).standard_normal((x.shape[1], CODE_BITS))
    signs = np.packbits(np.pad(x @ directions > 0, ((0, 0), (64 - CODE_BITS, 0))), axis=1).view(">u8").ravel().astype(np.int64)
    return signs | one_pass << CODE_BITS


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    directions = np.random.default_rng([seed, 1 << 20, x.shape[1]]).standard_normal((x.shape[1], SKETCH))
    return np.packbits(x @ directions > 0, axis=1)


def agreement(threshold: float) -> float:
    """The probability that two vectors with this cosine have the same sign in a random direction."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def sketch_limit(threshold: float) -> int:
    """Signs of a sketch in which two vectors at the threshold may differ: four deviations above the mean."""
    p = 1 - agreement(threshold)
    return math.ceil(SKETCH * p + 4 * math.sqrt(SKETCH * p * (1 - p)))


def passes_needed(depths: dict[int, int], threshold: float, miss: float, most: int = 1024) -> int:
    """How many passes leave a lone pair at the threshold unmet with probability `miss` on average over
    rows; depths: number of rows by the leading signs that tell a row from the end of its window."""
    q, n = agreement(threshold), sum(depths.values())
    for passes in range(1, most):
        if sum(k * (1 - q**d) ** passes for d, k in depths.items()) <= miss * n:
            return passes
    return most


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, hi, lo): vec is null for vectors that link with nothing; hi and lo name its value."""
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    slim = columns_free_of(vectors, id_col, vec_col).toDF("vec_id", "vec").select(F.col("vec_id").cast("bigint"), F.col("vec").cast(f"array<{kind}>"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    ok = F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))
    vec = F.transform("vec", lambda x: (x + F.lit(0.0)).cast(kind))  # no negative zeros
    return slim.select("vec_id", F.when(ok, vec).alias("vec")).select("*", F.xxhash64("vec").alias("hi"), F.xxhash64(F.lit(0x5EED), "vec").alias("lo"))


def _by_length(column: pa.Array):
    """(rows, matrix in double precision) for each length of the vectors in a list column."""
    dims = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(dims):
        at = np.nonzero(dims == d)[0]
        starts = column.offsets.to_numpy()[at]
        yield at, flat[starts[:, None] + np.arange(d)]


class _Window:
    """The last rows of a sorted stream, with which new ones are compared."""

    def __init__(self, window: int):
        self.window, self.rows, self.seen = window, None, 0

    def pairs(self, new: dict[str, np.ndarray]):
        """(all rows in view, [(positions of the first, step)]): pairs of a new row with one up to `window`
        places before it, of the same stretch."""
        if self.rows is not None and self.rows["payload"].shape[1] != new["payload"].shape[1]:
            self.rows = None  # rows of another length link with none of these
        old = 0 if self.rows is None else len(self.rows["class"])
        view = new if self.rows is None else {k: np.concatenate([self.rows[k], v]) for k, v in new.items()}
        n, stretch = len(view["class"]), view["stretch"]
        steps = []
        for step in range(1, min(self.window, n - 1) + 1):
            first = np.arange(max(0, old - step), n - step)
            steps.append((first[stretch[first] == stretch[first + step]], step))
        self.rows = {k: v[-self.window :] for k, v in view.items()}
        return view, steps


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that each of n positions is tied to by links (a, b)."""
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
    return label


def _vector_links(view: dict, steps: list, threshold: float, window: int):
    """A forest of the verified links in view, and how deep the codes of rows tell them from the end of
    their window."""
    x = _unit(view["payload"])
    hits, ends = [(np.zeros(0, np.int64), 0)], np.zeros(0, np.int64)
    for first, step in steps:
        cosine = np.einsum("ij,ij->i", x[first], x[first + step])
        hits.append((first[cosine >= threshold], step))
        if step == window:
            ends = first[cosine < threshold]
    a, b = np.concatenate([h for h, _ in hits]), np.concatenate([h + step for h, step in hits])
    label = _forest(a, b, len(x))
    far = np.nonzero(label != np.arange(len(x)))[0]
    apart = view["key"][ends] ^ view["key"][ends + window]
    # the bits in front of the first one that differs, and that one
    depth = CODE_BITS + 1 - np.ceil(np.log2(np.maximum(apart, 1) + 0.5)).astype(np.int64)
    return view["class"][far], view["class"][label[far]], np.bincount(np.minimum(depth, CODE_BITS), minlength=CODE_BITS + 1)


def _sketch_pairs(view: dict, steps: list, limit: int):
    """Pairs of different components so far whose sketches differ in at most `limit` signs."""
    s, root = view["payload"].view(np.uint64), view["root"]
    out = []
    for first, step in steps:
        first = first[root[first] != root[first + step]]
        far = np.bitwise_count(s[first] ^ s[first + step]).sum(axis=1)
        first = first[far <= limit]
        out.append((first, step))
    a, b = np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([x + step for x, step in out] or [np.zeros(0, np.int64)])
    return view["class"][a], view["class"][b]


_FOUND = "a bigint, b bigint, depth int, n bigint, boundary int, side int, nth int, dim int, key bigint, class bigint, root bigint, payload binary"


def _sorted_passes(scratch: Scratch, reps: DataFrame, passes: range, window: int, threshold: float, seed: int, vectors: bool) -> DataFrame:
    """The passes as one sort: rows (a, b) of links (with vectors) or candidates (with sketches), and with
    vectors rows (depth, n). reps: class, root, vec.

    Each task compares its part of the order as it streams by, and hands on the rows at both its ends;
    those at a boundary are compared once more, so that windows go across.
    """
    limit, width = sketch_limit(threshold), window

    def code(batches):
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int32)
            payload, keys = [None] * batch.num_rows, np.zeros((len(passes), batch.num_rows), np.int64)
            for at, x in _by_length(batch.column(2)):
                own = x if vectors else sketches(x, seed)
                for i, row in zip(at.tolist(), own, strict=True):
                    payload[i] = row.tobytes()
                for j, p in enumerate(passes):
                    keys[j, at] = codes(x, p, seed)
            payload = pa.array(payload, pa.binary())
            for own in keys:
                yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(own), batch.column(0), batch.column(1), payload], ["dim", "key", "class", "root", "payload"])

    def compared(view: dict, steps: list):
        if vectors:
            a, b, depth = _vector_links(view, steps, threshold, width)
        else:
            (a, b), depth = _sketch_pairs(view, steps, limit), np.zeros(0, np.int64)
        return a, b, depth

    def rows_out(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"depth": pa.int32(), "boundary": pa.int32(), "side": pa.int32(), "nth": pa.int32(), "dim": pa.int32(), "payload": pa.binary()}
        names = [x.split()[0] for x in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns[x], kinds.get(x, pa.int64())) if x in columns else pa.nulls(n, kinds.get(x, pa.int64())) for x in names], names)

    def pieces(batch: pa.RecordBatch, stretch: str | None):
        """Runs of rows of equal length and of a batch, as arrays; a stretch is a pass or a boundary's pass."""
        col = {x: batch.column(batch.schema.get_field_index(x)) for x in batch.schema.names}
        dims = col["dim"].to_numpy()
        cuts = [0, *(np.nonzero(np.diff(dims))[0] + 1).tolist(), len(dims)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            out = {x: col[x].to_numpy()[lo:hi] for x in ("dim", "key", "class", "root")}
            out["payload"] = np.frombuffer(b"".join(col["payload"].slice(lo, hi - lo).to_pylist()), np.float64 if vectors else np.uint8).reshape(hi - lo, -1)
            out["stretch"] = out["key"] >> CODE_BITS
            if stretch:
                out["stretch"] = out["stretch"] + (col[stretch].to_numpy()[lo:hi].astype(np.int64) << 12)
            yield out

    def stream(batches):
        part, view_of, n, first = TaskContext.get().partitionId(), _Window(width), 0, 0
        depths = np.zeros(CODE_BITS + 1, np.int64)

        def edge(rows: dict, side: int, boundary: int) -> pa.RecordBatch:
            k = len(rows["class"])
            return rows_out(boundary=np.full(k, boundary), side=np.full(k, side), nth=np.arange(k), **{x: rows[x] for x in ("dim", "key", "class", "root")}, payload=[r.tobytes() for r in rows["payload"]])

        for batch in batches:
            for new in pieces(batch, None):
                if n < width:  # the first rows of the task belong to the boundary before it
                    head = {k: v[: width - n] for k, v in new.items()}
                    out = edge(head, 1, part - 1)
                    nth = out.schema.get_field_index("nth")
                    yield out.set_column(nth, "nth", pa.array(np.arange(n, n + out.num_rows), pa.int32()))
                n += len(new["class"])
                a, b, depth = compared(*view_of.pairs(new))
                depths[: len(depth)] += depth
                yield rows_out(a=a, b=b)
        if view_of.rows is not None:
            yield edge(view_of.rows, 0, part)
        at = np.nonzero(depths)[0]
        yield rows_out(depth=at, n=depths[at])

    def across(batches):
        view_of = _Window(width)
        for batch in batches:
            for new in pieces(batch, "boundary"):
                a, b, _ = compared(*view_of.pairs(new))
                yield rows_out(a=a, b=b)

    ordered = reps.select("class", "root", "vec").mapInArrow(tidy(code), "dim int, key bigint, class bigint, root bigint, payload binary").sort("dim", "key", "class")
    found = scratch.save(ordered.mapInArrow(tidy(stream), _FOUND))
    edges = found.filter("boundary is not null").select("boundary", "side", "nth", "dim", "key", "class", "root", "payload")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    met = edges.repartition(parts, "boundary", "dim").sortWithinPartitions("boundary", "dim", "side", "nth").mapInArrow(tidy(across), _FOUND)
    return found.filter("boundary is null").unionByName(met).select("a", "b", "depth", "n")


def _verified(scratch: Scratch, pairs: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose cosine reaches the threshold."""

    def verify(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            y_of = {int(i): row for at, x in _by_length(batch.column(3)) for i, row in zip(at, x, strict=True)}
            for at, x in _by_length(batch.column(2)):
                y = np.array([y_of[int(i)] for i in at])
                ok[at] = np.einsum("ij,ij->i", _unit(x), _unit(y)) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left, right = (vecs.select(F.col("class").alias(x), F.col("vec").alias(f"vec_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "vec_a", "vec_b").mapInArrow(tidy(verify), "a bigint, b bigint")


def _few(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, miss: float = 0.005, passes: int | None = None, window: int = 256, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors. passes overrides their number."""
    scratch = Scratch(spark, "embedding")
    rows = scratch.save(classes(vectors, id_col, vec_col))
    # a class is one value; its number is its hash, which distinct classes would share once in 2^64 pairs
    sizes = scratch.save(rows.filter("vec is not null").groupBy("hi", "lo", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("class", F.xxhash64("hi", "lo")))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    lone = sizes.select("class", F.lit(0).cast("bigint").alias("root"), "vec")
    first = scratch.save(_sorted_passes(scratch, lone, range(FIRST_PASSES), FIRST_WINDOW, threshold, seed, vectors=True))
    depths = {r["depth"]: r["n"] for r in first.filter("depth is not null").groupBy("depth").agg(F.sum("n").alias("n")).collect()}
    ties = scratch.save(ordered(first.filter("a is not null")))
    scratch.drop(first)
    roots = components(spark, ties)
    reps = scratch.save(sizes.join(roots, sizes["class"] == roots.node, "left").select("class", F.coalesce("root", "class").alias("root"), "vec"))
    # windows of the later passes are wider, so rows need log2 of that fewer signs
    wider = int(math.log2(window / FIRST_WINDOW))
    more = passes if passes is not None else passes_needed({max(0, d - wider): n for d, n in depths.items()} or {0: 1}, threshold, miss)
    second = _sorted_passes(scratch, reps, range(FIRST_PASSES, FIRST_PASSES + more), window, threshold, seed, vectors=False)
    candidates = scratch.save(ordered(second.filter("a is not null")))
    pairs = scratch.save(ties.unionByName(_verified(scratch, candidates, sizes, threshold)))
    for done in (candidates, ties, reps):
        scratch.drop(done)
    roots = components(spark, pairs)
    named = sizes.join(roots, sizes["class"] == roots.node, "left").select("class", "hi", "lo", "vec", "least", "n", F.coalesce("root", "class").alias("root"))
    named = scratch.save(named)
    crowds = scratch.save(grouped_for_join(named, "root", F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    links = scratch.save(_count_links(named, _few(crowds), threshold))
    of = named.join(_few(crowds), "root", "left").join(_few(links), "class", "left")
    of = scratch.save(of.select("hi", "lo", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    linked = rows.filter("vec is not null").select("vec_id", "hi", "lo").join(of, ["hi", "lo"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("vec is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _count_links(named: DataFrame, crowds: DataFrame, threshold: float) -> DataFrame:
    """(class, others): rows of other classes of the same component at the threshold or above.

    A component's classes are dealt into blocks of rows; a group compares two blocks.
    Classes alone in their component are left out.
    """
    rows = F.coalesce(*[F.when(F.col("members") > members, size) for members, size in BLOCKS])
    crowd = named.join(crowds, "root").withColumn("blocks", F.ceil(F.col("members") / rows).cast("int"))
    crowd = crowd.withColumn("own", F.expr("cast(pmod(xxhash64(7, class), blocks) as int)"))
    both = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "n", "vec")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"class": [], "others": []}).astype("int64")
        x, y = (_unit(np.array(p["vec"].tolist(), dtype=np.float64)) for p in (a, b))
        of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for start in range(0, len(a), COUNT_BLOCK):
            one = slice(start, start + COUNT_BLOCK)
            hit = x[one] @ y.T >= threshold
            if i == j:
                hit[np.arange(len(hit)), np.arange(start, start + len(hit))] = False
            of_a[one] = hit @ b["n"].to_numpy()
            of_b += hit.T @ a["n"].to_numpy()[one]
        if i == j:
            return pd.DataFrame({"class": a["class"].to_numpy(), "others": of_a})
        return pd.DataFrame({"class": np.concatenate([a["class"], b["class"]]), "others": np.concatenate([of_a, of_b])})

    return both.groupBy("root", "i", "j").applyInPandas(count, "class bigint, others bigint").groupBy("class").agg(F.sum("others").alias("others"))
