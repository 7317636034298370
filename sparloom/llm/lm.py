"""Brown class-based bigram language model.

P(text) = product over tokens of P(class | class before) * P(word | class); each text ends with the
token END and starts after it. Every training word has a class of its own finding:

1. The `head` most frequent words are clustered by exchange: a word moves to the class that raises the
   likelihood of the head's bigrams most, word after word, until few move.
2. Every other word, however rare, is put into the class that raises the likelihood most, given the
   classes of the head words beside it. That is one exchange step of all words side by side, over
   counts of (word, neighbour's class) that Spark adds up; the table of words grows with the corpus.

Word emissions are additive: (c + 0.5) / (N_class + 0.5 (V_class + 1)), with one entry of 0.5 in each
class for unknown words. An unknown word of a text is taken to be of the class that makes the text
likeliest where it stands. Class transitions are interpolated with
class frequencies, the weight following the number of different successors (Witten-Bell). Both sum
to 1. Every transition of the training texts is counted: those beside head words with the bigrams and
contexts, those between two words outside the head once all words have their classes.

Word counts, contexts and class totals are Spark aggregates over all training rows. The driver holds
the bigrams of the head (at most head squared), the classes' tables, and the `known` most frequent
words, which every worker gets; rarer words are looked up by a join.

Rows: a null text is empty and is END alone; repeated rows count and are scored each by itself; very
long texts are read whole; a null doc_id hashes like the empty text. Equal gains go to the class of the
lowest number. Without training rows every word is unknown. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, columns_free_of, tidy

#: A token no word can equal, as words hold no white space.
END = b"\n"
#: Entries a worker collects before it hands them on.
FLUSH = 1_000_000
#: Bytes of words and offsets that a worker numbers together.
GROUP = 64 << 20


@dataclass(frozen=True)
class Size:
    """What the driver holds and every worker gets. The words with a class of their own have no bound."""

    head: int = 4096
    known: int = 131_072
    classes: int = 64
    rounds: int = 4


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(docs[text_col].cast("binary").alias("text"))


def in_numbers(batches, column: int = 0, most: int = 0):
    """(words, t, lengths) for groups of batches, which end at `most` tokens or GROUP bytes: the different words,
    END the last; END and then the tokens of all texts one after the other, as numbers of
    words, so that each text follows an END; and how many tokens each text has.

    Arrow cuts and numbers the words, none of which becomes a Python object. Its functions for ASCII lower
    A-Z only and cut at the six ASCII white-space characters, whatever the other bytes.
    """
    held, n, size = [], 0, 0

    def group():
        coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        lengths = np.concatenate([x for _, x in held]) + 1
        words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
        t = np.full(1 + lengths.sum(), len(words) - 1, np.int64)
        inside = np.ones(len(t), bool)
        inside[0] = inside[np.cumsum(lengths)] = False
        t[inside] = np.asarray(coded.indices)
        return words, t, lengths

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(column), b"").view(pa.string())))
        lengths = np.asarray(pc.list_value_length(cut)).astype(np.int64)
        words = cut.flatten().view(pa.binary())
        full = np.asarray(pc.binary_length(words)) > 0  # white space at an end leaves an empty piece
        if not full.all():
            lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[full], minlength=len(lengths))
            words = words.filter(pa.array(full))
        held.append((words, lengths))
        n += len(words) + len(lengths)
        size += words.nbytes
        if n > most or size > GROUP:
            yield group()
            held, n, size = [], 0, 0
    if held:
        yield group()


def places(words: pa.Array, of: list[bytes]) -> np.ndarray:
    """The place of each word in the list `of`, len(of) for others."""
    return np.asarray(pc.fill_null(pc.index_in(words, value_set=pa.array(of, pa.binary())), len(of))).astype(np.int64)


def lists_of(own: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Each column's values as bytes, a list for each run of equal numbers in own."""
    first = np.nonzero(np.diff(own, prepend=-1))[0]
    ends = np.append(first, len(own)).astype(np.int32)
    return [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in columns]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): every token of all rows, END included."""

    def run(batches):
        for words, t, _ in in_numbers(batches, most=4 * FLUSH):
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(t[1:], minlength=len(words)))], ["word", "n"])

    return _texts(docs, text_col).mapInArrow(tidy(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def count_limit(counts: DataFrame, most: int) -> int:
    """The lowest count that at most `most` words reach, from a histogram of counts in steps of a few
    per cent; no task sorts or holds the words."""
    step = F.when(F.col("c") < 32, F.col("c") - 1).otherwise(F.floor(F.log2(F.col("c").cast("double")) * 16).cast("bigint") - 48)
    bars = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("top")).collect()
    limit, held = None, 0
    for bar in sorted(bars, key=lambda b: -b["step"]):
        held += bar["n"]
        if held > most:
            break
        limit = bar["least"]
    return limit if limit is not None else max((b["top"] for b in bars), default=0) + 1


def head_bigrams(docs: DataFrame, head: list[bytes], text_col: str = "text") -> DataFrame:
    """(a, b, n): how often word b follows word a, over all rows; head words by their number, all other
    words as len(head)."""
    k = len(head) + 1

    def run(batches):
        for words, t, _ in in_numbers(batches, most=4 * FLUSH):
            t = places(words, head).astype(np.int32)[t]
            u, n = np.unique(t[:-1] * np.int32(k) + t[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((u // k).astype(np.int16)), pa.array((u % k).astype(np.int16)), pa.array(n)], ["a", "b", "n"])

    return _texts(docs, text_col).mapInArrow(tidy(run), "a smallint, b smallint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def contexts(docs: DataFrame, head: list[bytes], class_of: np.ndarray, classes: int, text_col: str = "text") -> DataFrame:
    """(word, slots, counts): for words outside the head, how often the word before is of class s (slot s)
    and the word after (slot classes + 1 + s); a neighbour outside the head too is class `classes`. slots
    are bytes, counts as many 32-bit numbers; a word has a row from each flush of a task at most."""
    slots = 2 * (classes + 1)

    def run(batches):
        cls = np.append(class_of, classes)
        for words, t, _ in in_numbers(batches, most=4 * FLUSH):
            of = cls[places(words, head)[t]]
            at = np.nonzero(of == classes)[0]  # END is before and behind in any case
            own = t[at] * slots
            u, n = np.unique(np.concatenate([own + of[at - 1], own + classes + 1 + of[at + 1]]), return_counts=True)
            own, slot = np.divmod(u, slots)
            whole = pa.RecordBatch.from_arrays([words.take(pa.array(np.unique(own))), *lists_of(own, slot.astype(np.uint8), n.astype("<u4"))], ["word", "slots", "counts"])
            for start in range(0, whole.num_rows, FLUSH // 8):
                yield whole.slice(start, FLUSH // 8)

    return _texts(docs, text_col).mapInArrow(tidy(run), "word binary, slots binary, counts binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, n_types: int, classes: int, rounds: int, rest: bool = False) -> np.ndarray:
    """The class of each type, by exchange clustering of the bigram counts (a, b, n). With rest, the last
    type is all other words and stays in a class of its own, number `classes`.

    Types start in classes by frequency rank, round robin. Types are visited from the most frequent
    on; each goes to the class that gives the highest sum of N(c, d) log N(c, d) less that of both
    margins, as long as it is better than staying.
    """
    k = classes + rest
    n_types -= rest
    left, right = np.bincount(a, n, n_types + rest), np.bincount(b, n, n_types + rest)
    order = np.argsort(-(left + right)[:n_types], kind="stable")
    of = np.full(n_types + rest, classes, dtype=np.int64)
    of[order] = np.arange(n_types) % classes
    m = np.zeros((k, k))
    np.add.at(m, (of[a], of[b]), n)

    def by(own: np.ndarray, other: np.ndarray):
        at = np.argsort(own, kind="stable")
        return np.searchsorted(own[at], np.arange(n_types + 1)), other[at], n[at]

    (a_at, after_of, after_n), (b_at, before_of, before_n) = by(a, b), by(b, a)
    for _ in range(rounds):
        moved = 0
        for t in order:
            if not left[t] + right[t]:
                continue
            to, to_n = after_of[a_at[t] : a_at[t + 1]], after_n[a_at[t] : a_at[t + 1]]
            fro, fro_n = before_of[b_at[t] : b_at[t + 1]], before_n[b_at[t] : b_at[t + 1]]
            own = to_n[to == t].sum()
            keep = to != t
            after = np.bincount(of[to[keep]], to_n[keep], k)  # followers' classes, without t itself
            keep = fro != t
            before = np.bincount(of[fro[keep]], fro_n[keep], k)
            c = of[t]
            m[c, :] -= after
            m[:, c] -= before
            m[c, c] -= own
            # the gain of adding t to each class d: its row, its column, the corner and both margins
            row, col = m + after, m.T + before  # row[d], col[d]
            gain = (_xlogx(row) - _xlogx(m)).sum(1) + (_xlogx(col) - _xlogx(m.T)).sum(1)
            corner = np.diag(m)
            gain += _xlogx(corner + after + before + own) - _xlogx(corner + after) - _xlogx(corner + before) + _xlogx(corner)
            r, s = m.sum(1), m.sum(0)
            gain -= _xlogx(r + left[t]) - _xlogx(r) + _xlogx(s + right[t]) - _xlogx(s)
            d = int(np.argmax(gain[:classes]))
            if gain[d] <= gain[c] + 1e-9:
                d = c
            m[d, :] += after
            m[:, d] += before
            m[d, d] += own
            moved += d != c
            of[t] = d
        if not moved:
            break
    return of


def best_classes(words: np.ndarray, slots: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of each word 0, 1, ..., by the gain of putting it into a class of the transitions m, the
    last class of which is that of all words outside the head.

    All words are placed side by side, so a word's gain is the slope of the likelihood at m as it is:
    for each neighbour log N(c, d) less the log of d's margin, counts smoothed by the neighbour's share.
    Row i: word words[i] (ascending) has n[i] neighbours of slot slots[i], slots as in contexts().
    """
    k = len(m) - 1
    tables = []
    for now in (m[:, :k], m[:k, :].T):  # by neighbour and class d: m[c, d] before it, m[d, c] behind
        share = (now.sum(1, keepdims=True) + 0.5) / (now.sum() + 0.5 * len(now))
        tables.append(np.log((now + share) / (now.sum(0) + 1)))
    table = np.concatenate(tables)
    gain = np.empty((int(words[-1]) + 1, k))
    for start in range(0, len(words), 1 << 14):
        one = slice(start, start + (1 << 14))
        first = np.nonzero(np.diff(words[one], prepend=-1))[0]
        sums = np.add.reduceat(table[slots[one]] * n[one][:, None], first)
        w = words[one][first]
        if start and w[0] == words[start - 1]:
            gain[w[0]] += sums[0]
            w, sums = w[1:], sums[1:]
        gain[w] = sums
    return gain.argmax(1)


def classed(spark: SparkSession, found: DataFrame, m: np.ndarray) -> DataFrame:
    """(word, c, class, slot) from contexts(): a row for each word with its count and class, and rows
    without a word that add up, by task, the neighbours of each class by slot (c is their number).
    m: the head's class transitions, the last class being that of all other words."""
    k = len(m) - 1
    slots = 2 * (k + 1)

    def run(batches):
        sums = np.zeros((k, slots), np.int64)

        def out(words: pa.Array, own: np.ndarray, slot: np.ndarray, n: np.ndarray):
            """words: different ones; row i of own, slot and n belongs to words[own[i]], own ascending."""
            u, at = np.unique(own * slots + slot, return_inverse=True)
            total = np.bincount(at, n, len(u)).astype(np.int64)
            w, s = np.divmod(u, slots)
            best = best_classes(w, s, total.astype(np.float64), m)
            np.add.at(sums, (best[w], s), total)
            c = np.bincount(w[s <= k], total[s <= k], len(best)).astype(np.int64)  # each token has one word before it
            return pa.RecordBatch.from_arrays([words, pa.array(c), pa.array(best.astype(np.int32)), pa.nulls(len(best), pa.int32())], ["word", "c", "class", "slot"])

        last, open_sums = None, np.zeros(slots, np.int64)  # the last word may go on in the next batch
        flat = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0)
            first = np.ones(len(word), bool)
            first[1:] = np.asarray(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)))
            first[0] = last is None or word[0].as_py() != last
            rows = np.cumsum(first)  # 0: goes on with the open word
            own, slot, n = np.repeat(rows, np.asarray(pc.binary_length(batch.column(1)))), flat(batch.column(1), np.uint8).astype(np.int64), flat(batch.column(2), "<u4")
            new = rows[-1]
            np.add.at(open_sums, slot[own == 0], n[own == 0])
            if new:
                whole = word.filter(pa.array(first))
                done, inner = np.nonzero(open_sums)[0], (own > 0) & (own < new)
                words = [*([last] if last is not None else []), *whole.slice(0, new - 1).to_pylist()]
                if words:
                    shift = last is None
                    yield out(pa.array(words, pa.binary()), np.concatenate([np.zeros(len(done), np.int64), own[inner] - shift]), np.concatenate([done, slot[inner]]), np.concatenate([open_sums[done], n[inner].astype(np.int64)]))
                last = whole[new - 1].as_py()
                open_sums = np.bincount(slot[own == new], n[own == new], slots).astype(np.int64)
        if last is not None:
            done = np.nonzero(open_sums)[0]
            yield out(pa.array([last], pa.binary()), np.zeros(len(done), np.int64), done, open_sums[done])
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at[0]), pa.binary()), pa.array(sums[at]), pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32))], ["word", "c", "class", "slot"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_word = found.repartition(parts, "word").sortWithinPartitions("word")
    return by_word.mapInArrow(tidy(run), "word binary, c bigint, class int, slot int")


def tail_bigrams(docs: DataFrame, head: list[bytes], known: dict[bytes, tuple[int, int]], classes: int, text_col: str = "text") -> DataFrame:
    """(word, next, slots, counts, at, n): the bigrams of two words outside the head, as three kinds of rows.

    Only at and n: workers know both words, of classes c and d; at is c * classes + d. A word without a next
    one: workers don't know it; slot s is how often a word of class s that they know is before it, slot
    classes + s behind it, as in contexts(). A word and a next one: workers know neither; n is their number.
    """
    names = ["word", "next", "slots", "counts", "at", "n"]
    kinds = [pa.binary()] * 4 + [pa.int32(), pa.int64()]
    flush = FLUSH

    def run(batches):
        of_known = {w: d for w, (_, d) in known.items()} | dict.fromkeys(head, classes)
        cls = np.array([*of_known.values(), -1], np.int64)
        sums = np.zeros(classes * classes, np.int64)

        def rows(size: int, **columns):
            whole = pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(size, kind) for x, kind in zip(names, kinds, strict=True)], names)
            for start in range(0, size, flush // 8):
                yield whole.slice(start, flush // 8)

        for words, t, _ in in_numbers(batches, most=4 * flush):
            of = cls[places(words, list(of_known))[t]]
            at = np.nonzero((of[:-1] < classes) & (of[1:] < classes))[0]
            a, b, x, y = of[at], of[at + 1], t[at], t[at + 1]
            both, first, last, none = (a >= 0) & (b >= 0), (a >= 0) & (b < 0), (a < 0) & (b >= 0), (a < 0) & (b < 0)
            sums += np.bincount(a[both] * classes + b[both], minlength=classes * classes)
            u, n = np.unique(np.concatenate([y[first] * 2 * classes + a[first], x[last] * 2 * classes + classes + b[last]]), return_counts=True)
            own, slot = np.divmod(u, 2 * classes)
            slots, counts = lists_of(own, slot.astype(np.uint8), n.astype("<u4"))
            yield from rows(len(slots), word=words.take(pa.array(np.unique(own))), slots=slots, counts=counts)
            u, n = np.unique(x[none] << 32 | y[none], return_counts=True)
            yield from rows(len(u), word=words.take(pa.array(u >> 32)), next=words.take(pa.array(u & 0xFFFFFFFF)), n=pa.array(n))
        at = np.nonzero(sums)[0]
        yield from rows(len(at), at=pa.array(at.astype(np.int32)), n=pa.array(sums[at]))

    return _texts(docs, text_col).mapInArrow(tidy(run), "word binary, next binary, slots binary, counts binary, at int, n bigint")


def tail_transitions(scratch: Scratch, bigrams: DataFrame, vocabulary: DataFrame, classes: int) -> np.ndarray:
    """How often words outside the head of class c are before such of class d, from tail_bigrams()."""

    def add(batches):
        sums = np.zeros(classes * classes, np.int64)
        for batch in batches:
            own = np.repeat(batch.column(0).to_numpy().astype(np.int64), np.asarray(pc.binary_length(batch.column(1))))
            slot, n = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).astype(np.int64) for i, kind in ((1, np.uint8), (2, "<u4")))
            np.add.at(sums, np.where(slot < classes, slot * classes + own, own * classes + slot - classes), n)
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["at", "n"])

    bigrams, of = scratch.save(bigrams), vocabulary.select("word", "class")
    beside = bigrams.filter("word is not null and next is null").select("word", "slots", "counts").join(of, "word")
    two = bigrams.filter("next is not null").select("word", "next", "n").join(of, "word").groupBy("next", "class").agg(F.sum("n").alias("n"))
    two = two.join(of.toDF("next", "after"), "next").select((F.col("class") * classes + F.col("after")).alias("at"), "n")
    parts = bigrams.filter("word is null").select("at", "n"), beside.select("class", "slots", "counts").mapInArrow(tidy(add), "at int, n bigint"), two
    m = np.zeros(classes * classes)
    for part in parts:
        for r in part.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most classes squared rows
            m[r["at"]] += r["n"]
    scratch.drop(bigrams)
    return m.reshape(classes, classes)


@dataclass
class Model:
    classes: int
    known: dict[bytes, tuple[int, int]]  # the most frequent words: count and class
    vocabulary: DataFrame  # (word, c, class) of all others
    step: np.ndarray  # log10 P(class | class before)
    total: np.ndarray  # log10 of each class's emission denominator
    n: int
    v: int

    def base(self, c: int | np.ndarray):
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def transitions(m: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), Witten-Bell towards smoothed class frequencies."""
    freq = (m.sum(0) + 0.5) / (m.sum() + 0.5 * len(m))
    kinds = (m > 0).sum(1, keepdims=True)
    return np.log10((m + np.maximum(kinds, 1) * freq) / (m.sum(1, keepdims=True) + np.maximum(kinds, 1)))


def fit(spark: SparkSession, training: DataFrame, text_col: str = "text", size: Size = Size()) -> Model:  # noqa: B008
    scratch, k = Scratch(spark, "lm"), size.classes
    counts = scratch.save(word_counts(training, text_col))
    n, v, ends = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first())
    limit = count_limit(counts, size.known)
    top = counts.filter(F.col("c") >= limit).toArrow()  # at most size.known rows
    frequent = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    scratch.drop(counts)
    of_head = dict(frequent[: size.head])
    if END not in of_head:  # only in tiny corpora, or without any row
        of_head = {**dict(frequent[: size.head - 1]), END: ends}
    head = list(of_head)
    table = head_bigrams(training, head, text_col).toArrow()  # at most size.head squared rows
    a, b, x = table["a"].to_numpy(), table["b"].to_numpy(), table["n"].to_numpy().astype(np.float32)
    del table
    of = exchange(a, b, x, len(head) + 1, k, size.rounds, rest=True)
    m = np.zeros((k + 1, k + 1))
    np.add.at(m, (of[a], of[b]), x)
    del a, b, x
    of = of[:-1]
    words = scratch.save(classed(spark, contexts(training, head, of, k, text_col), m))
    sums = words.filter("word is null").groupBy("class", "slot").agg(F.sum("c").alias("n")).collect()  # at most 2 k (k + 1) rows
    other = np.zeros((k, 2 * (k + 1)))
    for r in sums:
        other[r["class"], r["slot"]] = r["n"]
    before, after, m = other[:, : k + 1], other[:, k + 1 :], m[:k, :k].copy()
    m += before[:, :k].T + after[:, :k]
    N, V = np.bincount(of, list(of_head.values()), k), np.bincount(of, [c > 0 for c in of_head.values()], k)
    for r in words.filter("word is not null").groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        N[r["class"]] += r["c"]
        V[r["class"]] += r["v"]
    tail = words.filter("word is not null").select("word", "c", "class")
    some = tail.filter(F.col("c") >= limit).toArrow()
    known = {w: (c, d) for w, c, d in zip(*(some[x].to_pylist() for x in ("word", "c", "class")), strict=True)}
    known |= {w: (c, int(d)) for (w, c), d in zip(of_head.items(), of, strict=True)}
    rare = tail.filter(F.col("c") < limit)
    m += tail_transitions(scratch, tail_bigrams(training, head, known, k, text_col), rare, k)
    return Model(k, known, rare, transitions(m), np.log10(N + 0.5 * (V + 1)), int(n), int(v))


#: In a list of neighbours' classes: one that no worker knows.
_OPEN = 255
#: What a text's own row carries: tokens, known ones, both scores so far; then its pairs of open words.
_OWN, _OWN_SIZE = "<qqdd", 32


def _tokens_scored(model: Model):
    """(doc_id, text) batches -> a row per text, and a row per word of a text that no worker knows."""
    known, step, total, k = model.known, model.step, model.total, model.classes
    base_total = float(np.log10(model.n + 0.5 * (model.v + 1)))

    def run(batches):
        cls = np.array([d for _, d in known.values()] + [_OPEN], np.int64)
        c = np.array([c for c, _ in known.values()], np.float64)
        logs, in_training = np.append(np.log10(c + 0.5), 0.0), np.append(c > 0, False)
        emit = np.append(np.log10(c + 0.5) - total[cls[:-1]], 0.0)
        wide = np.zeros((k + 1, k + 1))
        wide[:k, :k] = step
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ((words, numbers, lengths),) = in_numbers([batch], 1)
            t = places(words, list(known))[numbers]
            own = cls[t]
            starts = np.cumsum(lengths) - lengths
            of_text = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            move = np.minimum(own, k)
            score, t = of_text(wide[move[:-1], move[1:]] + emit[t[1:]]), t[1:]
            n_known, base = of_text(in_training[t].astype(np.int64)), of_text(logs[t]) - lengths * base_total
            # the different open words of each text: a row for each
            at = np.nonzero(own == _OPEN)[0]
            text = np.repeat(np.arange(len(lengths)), lengths)[at - 1]
            rows, of_row = np.unique(text << 32 | numbers[at], return_inverse=True)
            in_text = np.searchsorted(rows >> 32, np.arange(len(lengths)))
            idx = np.arange(len(rows)) - in_text[rows >> 32]
            # the classes before its places, then those behind them
            order = np.argsort(np.concatenate([2 * of_row, 2 * of_row + 1]), kind="stable")
            sides = lists_of(np.repeat(np.arange(len(rows)), 2 * np.bincount(of_row, minlength=len(rows))), np.concatenate([own[at - 1], own[at + 1]])[order].astype(np.uint8))[0]
            again = np.nonzero(np.diff(at) == 1)[0]  # places whose next word is open too
            twice = np.stack([idx[of_row[again]], idx[of_row[again + 1]]], 1).astype("<i4")
            cuts = np.searchsorted(text[again], np.arange(len(lengths) + 1)).tolist()
            row_ids = part << 40 | np.arange(row, row + len(lengths))
            row += len(lengths)
            owns = [struct.pack(_OWN, *x) + twice[cuts[i] : cuts[i + 1]].tobytes() for i, x in enumerate(zip(lengths.tolist(), n_known.tolist(), base.tolist(), score.tolist(), strict=True))]
            m, d = len(rows), len(lengths)
            # a row of its own for each text; its key is no word, so it joins with nothing
            keys = pa.concat_arrays([words.take(pa.array(rows & 0xFFFFFFFF)), pa.array([b" %d" % r for r in row_ids.tolist()], pa.binary())])
            doc_ids = batch.column(0).take(pa.array([*[None] * m, *range(d)], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.concatenate([row_ids[rows >> 32], row_ids])), keys, pa.concat_arrays([pa.array(idx.astype(np.int32)), pa.nulls(d, pa.int32())]), pa.concat_arrays([sides, pa.nulls(d, pa.binary())]), pa.array([*[None] * m, *owns], pa.binary())],
                ["doc_id", "row_id", "word", "idx", "sides", "own"],
            )

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row; scores are log10 P(text).

    A word outside the workers' table leaves as (row, word, the classes beside it) and meets its count
    and class in a join; what that adds returns to the row. Where two such words are neighbours, the
    row's transitions between them are added once both classes have returned.
    """
    step, total = model.step, model.total
    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    parts = slim.mapInArrow(tidy(_tokens_scored(model)), "doc_id bigint, row_id bigint, word binary, idx int, sides binary, own binary")

    def neighbours(sides: pa.Array):
        """(row, class before it or behind it, whether it is the one behind) of all places of all words."""
        lengths = np.asarray(pc.binary_length(sides).fill_null(0)).astype(np.int64)
        flat = np.frombuffer(b"".join(x or b"" for x in sides.to_pylist()), np.uint8)
        at = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return at, flat, place >= lengths[at] // 2, lengths // 2

    def returned(batches):
        for batch in batches:
            col = lambda x: batch.column(batch.schema.get_field_index(x))  # noqa: B023, E731
            word, c, cls = np.asarray(col("idx").is_valid()), col("c").fill_null(0).to_numpy().astype(np.float64), col("class").fill_null(0).to_numpy().copy()
            at, beside, behind, k = neighbours(col("sides"))
            known = beside != _OPEN
            # unknown words: the class that their neighbours make likeliest
            new = np.nonzero(word & ~np.asarray(col("class").is_valid()))[0]
            if len(new):
                row = np.full(len(word), -1)
                row[new] = np.arange(len(new))
                some = known & (row[at] >= 0)
                gain = k[new, None] * (np.log10(0.5) - total)[None, :]
                np.add.at(gain, row[at[some]], np.where(behind[some, None], step.T[beside[some]], step[beside[some]]))
                cls[new] = gain.argmax(1)
            own = np.log10(c + 0.5)
            one, two = np.where(known, beside, 0), cls[at]
            moves = np.where(behind, step[two, one], step[one, two]) * known
            gain = np.where(word, k * (own - total[cls]), 0.0) + np.bincount(at, moves, len(word))
            open_ = np.bincount(at, ~known, len(word)) > 0
            yield pa.RecordBatch.from_arrays(
                [col("doc_id"), col("row_id"), col("idx"), pa.array(cls.astype(np.int32), mask=~open_), col("own"), pa.array(np.where(word & (c > 0), k, 0)), pa.array(k * np.where(word, own, 0.0)), pa.array(gain)],
                ["doc_id", "row_id", "idx", "class", "own", "n_known", "base_score", "score"],
            )

    met = parts.join(model.vocabulary, "word", "left").mapInArrow(tidy(returned), "doc_id bigint, row_id bigint, idx int, class int, own binary, n_known bigint, base_score double, score double")
    of_open = F.collect_list(F.when(F.col("class").isNotNull(), F.struct("idx", "class")))
    rows = met.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_known", "base_score", "score")], of_open.alias("open"), F.max("own").alias("own"))
    # the classes of open words as two lists, which Arrow hands over flat
    flat = rows.select("doc_id", "n_known", "base_score", "score", F.col("open.idx").alias("idx"), F.col("open.class").alias("cls"), "own")

    def between(batches):
        for batch in batches:
            texts = batch.column(6).to_pylist()
            own = np.array([struct.unpack_from(_OWN, x) for x in texts], np.float64).reshape(-1, 4)
            score = batch.column(3).to_numpy() + own[:, 3]
            for i, x in enumerate(texts):
                if len(x) > _OWN_SIZE:
                    idx, c = (batch.column(j)[i].values.to_numpy() for j in (4, 5))
                    cls = np.zeros(int(idx.max()) + 1, np.int64)
                    cls[idx] = c
                    pair = cls[np.frombuffer(x, "<i4", offset=_OWN_SIZE).reshape(-1, 2)]
                    score[i] += step[pair[:, 0], pair[:, 1]].sum()
            counts = own[:, :2].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts[:, 0].copy()), pa.array(batch.column(1).to_numpy() + counts[:, 1]), pa.array(batch.column(2).to_numpy() + own[:, 2]), pa.array(score)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return flat.mapInArrow(tidy(between), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
