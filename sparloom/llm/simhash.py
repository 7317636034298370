"""SimHash near-duplicates: byte-position inverted index with count filtering.

Fingerprints that differ in at most d bits share at least B - d of their B positional bytes: the
guaranteed minimum of matches, here 6 of 8. The index posts every fingerprint under each set of three
positions with the bytes there, so a pair at the minimum meets in 20 lists of 56 at least (a single byte
would hold 1/256 of all fingerprints in a list, and pairs would grow with their square). In a list the
positional bytes that a pair shares are tallied; pairs that reach the minimum are retained, and their
bits are compared.

The index is one sort by key, split over tasks wherever it falls. Lists of more than LIST fingerprints,
and those that lie across the ends of a task, are posted again under all sets of six positions that
contain theirs: such a list holds 256^2 different fingerprints at most, whatever the input, and is
searched by flipping bits. A list hands on a forest of links, not all pairs.

Rows: a null text counts as empty; a text without words has fingerprint zero; equal rows are
separate rows with the same answer; a null doc_id is carried and never becomes a component's id
unless the component has no other. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.common import FEW, Scratch, columns_free_of, components, grouped_for_join, row_key, tidy

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Shingles whose bits are counted at once, so that very long texts need bounded memory.
_CHUNK = 1 << 16


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters."""
    return text.translate(_LOWER).split()


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """All runs of n words, repeats included; fewer words give the whole sequence, none nothing."""
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    s = shingles_of(words, n)
    return np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), dtype="<u8", count=len(s))


#: Fingerprints of a list that are compared pair by pair; longer ones are posted again.
LIST = 1024
_EVERY_8TH = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: byte-wide counters, 255 hashes at a time."""
    rows = np.zeros((-(-len(h) // 255), 255), dtype="<u8")
    rows.reshape(-1)[: len(h)] = h
    out = np.zeros((8, 8), dtype=np.int64)
    for i in range(8):
        sums = ((rows >> np.uint64(i)) & _EVERY_8TH).sum(axis=1, dtype=np.uint64)
        out[:, i] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.ravel()


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    total = sum(bit_counts(h[i : i + _CHUNK]) for i in range(0, len(h), _CHUNK))
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits from a 64-bit hash, for wider fingerprints; lane 0 is the hash itself."""
    if not lane:
        return h
    z = h + np.uint64((lane * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, n: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the 64-bit fingerprint as a signed bigint."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype="<u8").view("<i8"))], ["doc_id", "fp"])

    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text")
    return slim.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(tidy(run), "doc_id bigint, fp bigint")


def _masks(free_bits: list[int], max_bits: int) -> np.ndarray:
    return np.array([sum(1 << b for b in some) for k in range(1, max_bits + 1) for some in combinations(free_bits, k)], dtype=np.uint64)


def local_links(fps: np.ndarray, max_bits: int = 2, n_bytes: int = 8) -> np.ndarray:
    """For different uint64 fingerprints: the position of the smallest fingerprint each is tied to.

    Two are tied if they share at least n_bytes - max_bits positional bytes and differ in at most
    max_bits bits.
    """
    m = len(fps)
    label = np.arange(m)
    if m < 2:
        return label
    order = np.argsort(fps)
    fps = fps[order]
    # neighbours are looked up by flipping bits, so a long list costs m times the number of flips
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [b for b in range(64) if varying >> b & 1]
    if m > 128 and len(free) <= 24:
        pairs = []
        for mask in _masks(free, max_bits):
            at = np.searchsorted(fps, other := fps ^ mask)
            hit = (at < m) & (fps[np.minimum(at, m - 1)] == other)
            pairs.append((np.nonzero(hit)[0], at[hit]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    else:
        found = []
        for i in range(m - 1):
            x = fps[i + 1 :] ^ fps[i]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # positional bytes in common
            ok = (shared >= n_bytes - max_bits) & (np.bitwise_count(x) <= max_bits)
            j = np.nonzero(ok)[0] + i + 1
            found.append((np.full(len(j), i), j))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    out = np.empty(m, dtype=np.int64)
    out[order] = order[label]
    return out


def _posting_key(kept: tuple[int, ...], number: int) -> Column:
    """The bytes of fp at some positions, below the number of that set of positions."""
    parts = [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF)), 8 * i) for i, p in enumerate(kept)]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), parts, F.lit(number << 48).cast("bigint"))


def _linked_pairs(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes and differ in few enough bits."""
    apart = x ^ y
    shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= 8 - max_bits) & (np.bitwise_count(apart) <= max_bits)


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints of the column fp that hold each cluster together."""
    spark = fps.sparkSession
    scratch, parts = Scratch(spark, "postings"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    threes, wide = list(combinations(range(8), 3)), list(combinations(range(8), 8 - max_bits))
    keys = F.explode(F.array(*[_posting_key(kept, i) for i, kept in enumerate(threes)]))

    def short_lists(batches):
        """Links of whole lists in the sorted stream (a, b); of others, set of positions and fingerprint (a, None)."""

        def out(a, b, at=None):
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if at is None else pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()) if at is None else pa.array(b, pa.int32())], ["a", "b", "positions"])

        def again(key: int, x: np.ndarray):
            return out([x], [np.full(len(x), key >> 48)], at=True)

        open_key, held, first, passing = None, [], True, False  # passing: the open list is handed on as it comes
        for batch in batches:
            key, fp = (c.to_numpy() for c in batch.columns)
            cuts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
            if len(cuts) < 2:
                continue
            a, b = [], []
            start = 0
            if key[0] == open_key:
                held.append(fp[: cuts[1]])
                start = 1
            if start < len(cuts) - 1 and open_key is not None:  # the open list is whole
                own = np.concatenate(held)
                if first or passing or len(own) > LIST:
                    yield again(open_key, own)
                elif len(own) > 1:
                    far = local_links(own.view(np.uint64), max_bits)
                    at = np.nonzero(far != np.arange(len(own)))[0]
                    a.append(own[at])
                    b.append(own[far[at]])
                first, passing, held, open_key = False, False, [], None
            if start < len(cuts) - 1:
                lo, hi = cuts[start:-2], cuts[start + 1 : -1]  # whole lists inside the batch, unless it is the task's first
                size = hi - lo
                if open_key is None and first and len(lo):
                    yield again(int(key[lo[0]]), fp[lo[0] : hi[0]])
                    lo, hi, size, first = lo[1:], hi[1:], size[1:], False
                two = lo[size == 2]
                ok = _linked_pairs(fp[two].view(np.uint64), fp[two + 1].view(np.uint64), max_bits)
                a.append(np.maximum(fp[two], fp[two + 1])[ok])
                b.append(np.minimum(fp[two], fp[two + 1])[ok])
                for x, y in zip(lo[size > 2].tolist(), hi[size > 2].tolist(), strict=True):
                    own = fp[x:y]
                    if len(own) > LIST:
                        yield again(int(key[x]), own)
                        continue
                    far = local_links(own.view(np.uint64), max_bits)
                    at = np.nonzero(far != np.arange(len(own)))[0]
                    a.append(own[at])
                    b.append(own[far[at]])
                open_key, held = int(key[-1]), [fp[cuts[-2] :]]
            if sum(map(len, held)) > LIST:
                yield again(open_key, np.concatenate(held))
                held, passing = [np.zeros(0, np.int64)], True
            yield out(a, b)
        if held:  # it may go on in the next task
            yield again(open_key, np.concatenate(held))

    # dealt out by number, as a few small files would otherwise become a few long tasks
    postings = fps.select("fp").repartition(parts, "fp").distinct().select(keys.alias("key"), "fp")
    ordered = postings.repartitionByRange(parts, "key", F.xxhash64("fp")).sortWithinPartitions("key")
    found = scratch.save(ordered.mapInArrow(tidy(short_lists), "a bigint, b bigint, positions int"))
    longer = found.filter("positions is not null").select("positions", F.col("a").alias("fp")).distinct()

    def six_bytes(batches):
        for batch in batches:
            at, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in np.unique(at):
                x = fp[at == i]
                for j, six in enumerate(wide):
                    if set(threes[i]) <= set(six):
                        keys.append(j << 48 | x.view(np.uint8).reshape(-1, 8)[:, list(six)].astype(np.int64) @ (1 << 8 * np.arange(len(six))))
                        own.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(own))], ["key", "fp"])

    six = longer.mapInArrow(tidy(six_bytes), "key bigint, fp bigint").distinct()
    lists = six.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def long_lists(batches):
        for batch in batches:
            a, b = [], []
            for one in batch.column(0):
                x = one.values.to_numpy()
                to = local_links(x.view(np.uint64), max_bits)
                far = np.nonzero(to != np.arange(len(x)))[0]
                a.append(x[far])
                b.append(x[to[far]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in (a, b)], ["a", "b"])

    return found.filter("positions is null").select("a", "b").unionByName(lists.mapInArrow(tidy(long_lists), "a bigint, b bigint")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest id reachable."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col, shingle))
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(spark, links(classes, max_bits))
    named = scratch.save(classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    least = grouped_for_join(named, "root", F.min("least").alias("component_id"))
    of = scratch.save(named.join(least, "root").select("fp", "component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


# Near copies by the similarity of their shingle sets

#: Orders of the shingles whose lowest one is a key of a folding round.
FOLDS = 8
#: Folding goes on as long as a round ties this share of the texts.
FOLD_ON = 0.01
#: Words of a set's parity map (see _parity); sets of more shingles than its bits have a wide map besides.
MAP_WORDS = 8
_MAPS = [f"map_{i}" for i in range(MAP_WORDS)]
#: Texts counted, about, and counters for the order of shingles from rare to common. They decide how
#: long lists are, not what is found.
COUNTED, COUNTERS = 1 << 16, 1 << 22
#: Postings that meet in one turn of the complete join, about, and the most turns: what a turn shuffles is
#: freed before the next.
TURN_ROWS, TURNS = 1 << 23, 16
_SLACK = 1e-9


class _Texts(NamedTuple):
    """What a comparison reads. Shingle sets are made from the texts where they are needed: stored, they
    take several times the texts' disk."""

    texts: DataFrame  #: node, text of every row; texts of one node have equal sets
    classes: DataFrame  #: a row per node: node, size, maps, wide, fp, lows
    n: int  #: classes
    shingle: int
    similarity: float


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets with at least this similarity, the first so many shingles of each, in one order for
    all sets, have one in common."""
    return n - math.ceil(similarity * n - _SLACK) + 1 if n else 0


#: Bytes up to which words are hashed side by side, eight bytes of each at a time; longer ones one by one.
_WORD_BYTES = 64
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (see words_of) of the texts, and where in them each text's begin and end."""
    whole = b"\n".join([*texts, b""]).translate(_LOWER) + b"\n" + bytes(8)  # eight bytes can be read everywhere
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(whole, np.uint8)[:-8]], prepend=True))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    from_here = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))
    h = mixed(lengths.astype("<u8"), 1)
    here = np.flatnonzero(lengths <= _WORD_BYTES)
    for done in range(0, _WORD_BYTES, 8):
        here = here[lengths[here] > done]
        unused = 64 - 8 * np.minimum(lengths[here] - done, 8).astype("<u8")
        h[here] = mixed(h[here] ^ (from_here[starts[here] + done] << unused), 1)
    for i in np.flatnonzero(lengths > _WORD_BYTES):
        h[i] = xxhash.xxh64_intdigest(whole[starts[i] : starts[i] + lengths[i]], SEED)
    return h, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the words' hashes."""
    total = np.zeros(max(0, len(h) - n + 1) if n else 0, "<u8")
    for i, odd in enumerate(mixed(np.arange(n, dtype="<u8"), 2) | np.uint64(1)):
        total += h[i : i + len(total)] * odd
    return mixed(total, 1)


def _distinct(h: np.ndarray) -> np.ndarray:
    """The hashes in order, each once (np.unique takes several times as long)."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Of each text the set of its shingles (see shingles_of) as 64-bit hashes in order: not those of
    shingle_hashes, but equal where those are, in a fraction of the time."""
    h, at = word_hashes([t or b"" for t in texts])
    whole = _runs(h, n)
    return [_distinct(whole[a : b - n + 1] if b - a >= n else _runs(h[a:b], int(b - a))) for a, b in zip(at[:-1], at[1:], strict=True)]


def _sets(batches, shingle: int):
    """From batches (node, ..., text): each batch with its rows' places and sets, a node once a task."""
    seen = set()
    for batch in batches:
        at = []
        for i, node in enumerate(batch.column(0).to_pylist()):
            if node not in seen:
                seen.add(node)
                at.append(i)
        yield batch, at, shingle_sets(batch.column(batch.num_columns - 1).take(pa.array(at, pa.int64())).to_pylist(), shingle)


def _having(df: DataFrame, keys: DataFrame) -> DataFrame:
    """df's rows whose key is in the one column of the saved table keys; a short one spares df a shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= FEW else keys, keys.columns[0], "left_semi")


def _rarity(spark: SparkSession, t: _Texts) -> np.ndarray:
    """By counter, how many of a sample of the texts hold one of its shingles."""
    shingle = t.shingle

    def count(batches):
        c = np.zeros(COUNTERS, np.uint32)
        for _, _, sets in _sets(batches, shingle):
            for h in sets:
                np.add.at(c, (h & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        for block in range(-(-COUNTERS // _CHUNK)):
            some = c[block * _CHUNK : (block + 1) * _CHUNK]
            if len(at := np.nonzero(some)[0]):
                yield packed(block, np.stack([at, some[at]]).astype("<u4"))

    def add(batches):
        sums = {}
        for batch in batches:
            for block, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, n = np.frombuffer(told, "<u4").reshape(2, -1)
                sums.setdefault(block, np.zeros(_CHUNK, np.int64))[at] += n
        for block, c in sums.items():
            yield packed(block, np.minimum(c, 65535).astype("<u2"))

    def packed(block, c):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["block", "counts"])

    every, blocks = max(1, t.n // COUNTED), "block int, counts binary"
    some = t.texts.filter(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(every)) == 0)
    table = some.mapInArrow(tidy(count), blocks).repartition("block").mapInArrow(tidy(add), blocks).toArrow()  # 2 bytes a counter
    out = np.zeros(-(-COUNTERS // _CHUNK) * _CHUNK, np.uint16)
    for block, c in zip(table["block"].to_pylist(), table["counts"].to_pylist(), strict=True):
        out[block * _CHUNK : (block + 1) * _CHUNK] = np.frombuffer(c, "<u2")
    return out[:COUNTERS]


def _may_reach(similarity: float) -> Column:
    """Whether two sets, with their sizes and maps in tables a and b, may have the similarity: bounds, not
    estimates."""
    size_a, size_b = F.col("a.size"), F.col("b.size")
    apart = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in _MAPS])
    sized = F.least(size_a, size_b) >= F.lit(similarity) * F.greatest(size_a, size_b) - _SLACK
    return sized & (apart <= F.lit((1 - similarity) / (1 + similarity)) * (size_a + size_b) + _SLACK)


def _possible(scratch: Scratch, pairs: DataFrame, t: _Texts) -> DataFrame:
    """The pairs (a, b), saved, that sizes and maps leave: whole texts need not travel for the others."""
    traits = t.classes.select("node", "size", *_MAPS)
    pairs = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    met = pairs.join(traits.alias("a"), F.col("x") == F.col("a.node")).join(traits.alias("b"), F.col("y") == F.col("b.node"))
    return scratch.save(met.filter(_may_reach(t.similarity)).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _narrowed(scratch: Scratch, pairs: DataFrame, t: _Texts) -> DataFrame:
    """Of the saved pairs (a, b) those, saved, that wide maps leave too; pairs without them stay."""
    similarity = t.similarity

    def narrow(batches):
        for batch in batches:
            ok = []
            for i, (size_a, wide_a, size_b, wide_b) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(2, 6)), strict=True)):
                if wide_a is None or wide_b is None or _apart(wide_a, wide_b) <= (1 - similarity) / (1 + similarity) * (size_a + size_b) + _SLACK:
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(ok, pa.int64())) for i in (0, 1)], ["a", "b"])

    maps = t.classes.filter("wide is not null")
    left, right = (maps.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    mapped = pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", "size_a", "wide_a", "size_b", "wide_b")
    out = scratch.save(mapped.mapInArrow(tidy(narrow), "a bigint, b bigint"))
    scratch.drop(pairs)
    return out


def _verified(scratch: Scratch, pairs: DataFrame, t: _Texts, bounded: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, saved. bounded: sizes and maps leave them, and they
    are saved."""
    pairs = _narrowed(scratch, pairs if bounded else _possible(scratch, pairs, t), t)
    nodes = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = scratch.save(_having(t.texts, nodes).dropDuplicates(["node"]), codec="zstd")
    scratch.free_shuffles()
    shingle, similarity = t.shingle, t.similarity

    def verify(batches):
        for batch in batches:
            ok, left, right = [], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            different = list({*left, *right})
            set_of = dict(zip(different, shingle_sets(different, shingle), strict=True))
            for i, (x, y) in enumerate(zip(map(set_of.get, left), map(set_of.get, right), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(ok, pa.int64())) for i in (0, 1)], ["a", "b"])

    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    found = scratch.save(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(verify), "a bigint, b bigint"))
    for done in (pairs, nodes, texts):
        scratch.drop(done)
    scratch.free_shuffles()
    return found


def _parity(h: np.ndarray, bits: int = 64 * MAP_WORDS) -> bytes:
    """The parity of a set's shingles in each of so many places. Maps differ in at most as many places as
    the sets do in shingles, which tells most pairs of unlike sets apart without the sets."""
    counts = np.bincount((h >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).tobytes()


def _wide(h: np.ndarray) -> bytes | None:
    """The parity map of a set that would fill the short one: a place for each shingle, up to twice as many."""
    return _parity(h, 1 << (len(h) - 1).bit_length()) if len(h) > 64 * MAP_WORDS else None


def _apart(a: bytes, b: bytes) -> int:
    """Places in which two maps differ; the longer one is folded to the other's length."""
    x, y = sorted((np.frombuffer(m, "<u8") for m in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _lows(h: np.ndarray, fold: int) -> bytes:
    """A set's keys in a folding round: its lowest shingle in each of FOLDS orders, other ones every round."""
    orders = range(1 + fold * FOLDS, 1 + (fold + 1) * FOLDS)
    return np.array([int(mixed(h, k).min()) ^ k for k in orders] if len(h) else [], "<u8").tobytes()


def _keyed(batch: pa.RecordBatch, rows: list[int], lows: list[bytes]) -> pa.RecordBatch:
    """(key, node, root): a row for each key of these rows of a batch (node, root, ...)."""
    keys = [np.frombuffer(x, "<i8") for x in lows]
    at = pa.array(np.repeat(np.array(rows, np.int64), [len(x) for x in keys]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), batch.column(0).take(at), batch.column(1).take(at)], ["key", "node", "root"])


_KEYED = "key bigint, node bigint, root bigint"


def _neighbours(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b): texts of different roots that are next to each other in the list of a key.
    keyed: key, node, root. A range sort by key and a random number splits long lists over tasks."""

    def meet(batches):
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            key, node, root = (np.concatenate([old, new.to_numpy()]) for old, new in zip(last, batch.columns, strict=True))
            hit = np.nonzero((key[:-1] == key[1:]) & (root[:-1] != root[1:]))[0]
            last = [key[-1:], node[-1:], root[-1:]]
            turned = node[hit] > node[hit + 1]
            x, y = hit + turned, hit + ~turned
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[x], node[y], root[x], root[y])], ["a", "b", "root_a", "root_b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = keyed.withColumn("turn", F.xxhash64("key", "node"))
    ordered = postings.repartitionByRange(n, "key", "turn").sortWithinPartitions("key", "turn").select("key", "node", "root")
    return ordered.mapInArrow(tidy(meet), "a bigint, b bigint, root_a bigint, root_b bigint").distinct()


def _by_fingerprint(spark: SparkSession, scratch: Scratch, t: _Texts) -> DataFrame:
    """(a, b), saved: the pairs that the fingerprint index links and that have the similarity. Texts of one
    fingerprint are paired with the next in a sort that splits long lists over tasks."""

    def chain(batches):
        last = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            fp, node = (np.concatenate([old, new.to_numpy()]) for old, new in zip(last, batch.columns, strict=True))
            hit = np.nonzero(fp[:-1] == fp[1:])[0]
            last = [fp[-1:], node[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[hit + 1])], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fps = t.classes.select("node", "fp")
    equal = fps.repartitionByRange(n, "fp", "node").sortWithinPartitions("fp", "node").select("fp", "node").mapInArrow(tidy(chain), "a bigint, b bigint")
    first = scratch.save(fps.groupBy("fp").agg(F.min("node").alias("node")))
    linked = links(first.select("fp")).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = _verified(scratch, equal.unionByName(linked).distinct(), t)
    scratch.drop(first)
    return found


def _folded(spark: SparkSession, scratch: Scratch, t: _Texts) -> DataFrame:
    """(node, root): most of every crowd tied together, by the fingerprint index and then by rounds of
    neighbours under ever new keys.

    The first round takes in all texts. Each further one takes in the texts, with all of their group, that
    have met a text of another group without being similar, as members of crowds not yet whole do.
    """
    ties, members, shingle = [_by_fingerprint(spark, scratch, t)], None, t.shingle

    def key(batches):
        for batch in batches:
            yield _keyed(batch, list(range(batch.num_rows)), batch.column(2).to_pylist())

    active = t.classes.select("node", "lows").join(components(spark, ties[0]), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "lows")
    keyed = active.mapInArrow(tidy(key), _KEYED)
    for fold in range(1000):
        met = scratch.save(_neighbours(spark, keyed))
        scratch.free_shuffles()
        found = _verified(scratch, met.select("a", "b"), t)
        ties.append(found)
        if members:
            scratch.drop(members)
        if found.count() <= FOLD_ON * t.n and fold:
            break
        roots = components(spark, functools.reduce(DataFrame.unionByName, ties))
        failed = met.join(found, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct()
        again = failed.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
        members = scratch.save(t.classes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(again, "root", "left_semi"))
        scratch.drop(met)

        def key_again(batches, fold=fold + 1):
            for batch, rows, sets in _sets(batches, shingle):
                yield _keyed(batch, rows, [_lows(h, fold) for h in sets])

        active = t.texts.join(F.broadcast(members) if members.count() <= FEW else members, "node").select("node", "root", "text")
        keyed = active.mapInArrow(tidy(key_again), _KEYED)
    return components(spark, functools.reduce(DataFrame.unionByName, ties))


def _candidates(scratch: Scratch, t: _Texts, roots: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(a, b), saved: all pairs of different roots that may reach the similarity, by their prefixes. Keys are
    dealt out to turns, one after the other."""
    shingle, similarity = t.shingle, t.similarity
    turns = min(TURNS, 1 + int((1 - similarity) * (t.classes.agg(F.sum("size")).first()[0] or 0)) // TURN_ROWS)

    def post(batches):
        for batch, at, sets in _sets(batches, shingle):
            keys, owner, places, sizes = [np.zeros(0, "<u8")], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for i, h in zip(at, sets, strict=True):
                n = prefix_length(len(h), similarity)
                first = np.argsort(rarity[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[:n]
                keys.append(h[first])
                owner.append(np.full(n, i))
                places.append(np.arange(n, dtype=np.int32))
                sizes.append(np.full(n, len(h), dtype=np.int32))
            keys, owner, places, sizes = (np.concatenate(x) for x in (keys, owner, places, sizes))
            whole = pa.RecordBatch.from_arrays([pa.array(keys.view("<i8")), batch.column(0).take(pa.array(owner)), pa.array(places), pa.array(sizes)], ["key", "node", "place", "size"])
            for start in range(0, max(1, whole.num_rows), _CHUNK):
                yield whole.slice(start, _CHUNK)

    postings = t.texts.mapInArrow(tidy(post), "key bigint, node bigint, place int, size int")
    postings = scratch.save(postings.withColumn("turn", F.pmod("key", F.lit(turns)).cast("int")), *["turn"][: turns - 1])
    known = F.broadcast(roots) if roots.count() <= FEW else roots
    found = []
    for turn in range(turns):
        own = scratch.save(postings.filter(F.col("turn") == turn).drop("turn").join(known, "node", "left").withColumn("root", F.coalesce("root", "node")))
        # lists inside one group, as most are, have nothing to find
        flipped = own.groupBy(F.bitwise_not(F.col("key")).alias("_flipped")).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
        keys = scratch.save(flipped.select(F.bitwise_not(F.col("_flipped")).alias("key")))
        scratch.free_shuffles()
        # once for every node, of which several tasks may have had a text
        wanted = scratch.save(_having(own, keys).dropDuplicates(["key", "node"]))
        scratch.drop(own)
        scratch.drop(keys)
        scratch.free_shuffles()
        nodes = scratch.save(wanted.select("node").distinct())
        mapped = scratch.save(wanted.join(_having(t.classes.select("node", *_MAPS), nodes), "node"))
        scratch.drop(wanted)
        scratch.drop(nodes)
        scratch.free_shuffles()
        # what two sets share is at most what lies before, at and behind a common shingle
        place_a, place_b, size_a, size_b = (F.col(c) for c in ("a.place", "b.place", "a.size", "b.size"))
        most = F.least(place_a, place_b) + F.least(size_a - place_a, size_b - place_b)
        enough = most >= F.lit(similarity / (1 + similarity)) * (size_a + size_b) - _SLACK
        # both sides are one table of the same columns, so that it is shuffled once
        met = mapped.alias("a").hint("merge").join(mapped.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & enough & _may_reach(similarity))
        found.append(scratch.save(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()))
        scratch.drop(mapped)
        scratch.free_shuffles()
    scratch.drop(postings)
    out = scratch.save(functools.reduce(DataFrame.unionByName, found).distinct()) if turns > 1 else found.pop()
    for one in found:
        scratch.drop(one)
    return out


def similar_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row_hi, row_lo, keeper): for each different (id, text) of docs, its row_key and whether it is
    the one that stays of its group. Groups are the components of links between texts whose sets of
    word shingles have a Jaccard similarity of at least `similarity`; the smallest id stays.

    Texts with equal sets are one class. Pairs that the fingerprint index links (links()) are verified by
    their sets and tied. Folding rounds tie most of what is left of every crowd together: each class
    is verified against its neighbours under FOLDS keys a round. What follows is complete: every class
    posts the prefix of its set, from rare to common shingles, and two classes that reach the similarity
    share a posting's key. Lists whose classes are all of one group are passed over, as links inside a
    group add nothing; all pairs between groups in the others that can reach the similarity by size,
    place and parity maps are verified. Texts without words are copies of each other.

    On disk are the texts, compressed, beside what a row and a class are known by; a set is made from its
    text whenever it is needed.
    """
    scratch = Scratch(spark, "similar")
    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text")
    keyed = slim.select(*row_key(F.col("doc_id"), F.col("text")), F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    traits = {"size": pa.int32(), **{m: pa.int64() for m in _MAPS}, "wide": pa.binary(), "fp": pa.int64(), "lows": pa.binary()}

    def describe(batches):
        for batch in batches:
            digests, found = [], []
            for text in batch.column(3):
                h = _distinct(shingle_hashes(words_of(text.as_py() or b""), shingle))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                found.append((len(h), *np.frombuffer(_parity(h), "<i8").tolist(), _wide(h), int(np.array(majority(h), "<u8").view("<i8")), _lows(h, 0)))
            columns = zip(*found, strict=True) if found else [[] for _ in traits]
            told = [pa.array(x, kind) for x, kind in zip(columns, traits.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), *told], ["row_hi", "row_lo", "doc_id", "text", "digest", *traits])

    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    told = ", ".join(f"{k} {kinds[v]}" for k, v in traits.items())
    rows = keyed.mapInArrow(tidy(describe), f"row_hi bigint, row_lo bigint, doc_id bigint, text binary, digest binary, {told}")
    rows = scratch.save(rows.withColumn("node", F.xxhash64("digest")).drop("digest"), codec="zstd")
    # nulls last: a known id is preferred
    who = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_hi", "row_lo")
    # rows of a node have equal traits
    classes = scratch.save(rows.groupBy("node").agg(F.min(who).alias("first"), F.first(F.struct(*traits)).alias("t")).select("node", "first", "t.*"))
    scratch.free_shuffles()
    t = _Texts(rows.select("node", "text"), classes, classes.count(), shingle, similarity)
    roots = _folded(spark, scratch, t)
    rarity = _rarity(spark, t)
    scratch.free_shuffles()
    links = _verified(scratch, _candidates(scratch, t, roots, rarity), t, bounded=True)
    # what the first round tied is a star around its root by now
    roots = components(spark, links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keepers = named.groupBy("root").agg(F.min("first").alias("keep")).select("keep.row_hi", "keep.row_lo").withColumn("keeper", F.lit(True))
    told = rows.select("row_hi", "row_lo").distinct().join(keepers, ["row_hi", "row_lo"], "left").withColumn("keeper", F.coalesce("keeper", F.lit(False)))
    out = scratch.save(told)
    scratch.drop(rows)
    scratch.drop(classes)
    scratch.free_shuffles()
    return out


def drop_similar(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar texts, the one with the smallest id; all columns."""
    keepers = similar_texts(spark, docs, id_col, text_col, shingle, similarity).filter("keeper").select("row_hi", "row_lo")
    hi, lo = row_key(docs[id_col], docs[text_col])
    whole = docs.select(hi, lo, F.struct(*[docs[c] for c in docs.columns]).alias("row")).groupBy("row_hi", "row_lo").agg(F.first("row").alias("row"))
    return whole.join(keepers, ["row_hi", "row_lo"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
