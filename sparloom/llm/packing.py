"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A document is its token ids and an end id. It is cut into pieces of the whole capacity, then of
capacity/2, capacity/4 ... down to `floor`, and what is left (under `floor`) is one last piece.
Piece lengths fall into reciprocal-capacity classes: a piece of length L fits capacity // L times,
so each sequence of its class takes exactly that many pieces, wherever they come from. A piece's
sequence and offset follow from its rank in its class; ranks come from counts by input partition,
so workers fill sequences independently and no task sees a class as a whole. Each class leaves less
than one sequence over; the rests of all classes (a number of pieces bounded by capacity and floor,
whatever the input) are packed together, longest first.

Padding: none in the halved classes, under capacity/(capacity/floor) tokens a sequence in the
others, and the last few sequences. A sequence whose length is a power of two is not padded.

Rows: a null text counts as empty and is the end id alone; repeated rows are packed each by itself;
a null doc_id is carried. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, columns_free_of, tidy

END_ID = 1
#: Words, and parts of words, whose ids a worker remembers; beyond it, it starts afresh.
MEMO_WORDS, MEMO_PIECES = 400_000, 200_000
#: New words of a text that are cut at once.
_LEARN = 1 << 16
#: Characters that normalisation leaves as they are, apart from their case, and line ends between words.
_PLAIN = regex.compile(r"[\n!-~¡-ɏ]*")
#: Bytes that only characters from U+0240 on have, all combining ones among them, or none at all.
_MARKS = re.compile(rb"[\xc9-\xff]")
#: Between words' ids: no id is as large, nor does any hold 255 in its third byte.
_LINE_END = b"\xff\xff\xff\xff"
# The vocabulary file's own cutting pattern.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LINE_OR_PRE_TOKEN = regex.compile(r"\n|" + _PRE_TOKEN.pattern)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable bytes themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    out.update({b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


class WordIds:
    """Words (bytes without ASCII white space) -> their ids as little-endian uint32 bytes, remembered.

    White space always ends a token, so a text's ids are those of its words, one after another. A-Z of
    texts that normalisation only lower-cases are lowered first, so that spellings share an entry. A text's
    new plain Latin words are cut in one go, and only pieces never met go to the vocabulary's BPE model,
    which skips most of the library's overhead; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = Pieces(self._piece)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _plain(self, s: str) -> bool:
        return bool(_PLAIN.fullmatch(s)) and not any(x in s for x in self.special)

    def _piece(self, p: str) -> bytes:
        return _packed([x.id for x in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))])

    def _learn(self, words: list[bytes]) -> None:
        """Remembers new words; plain ones at once, a line each, as no piece goes over a line's end."""
        lines = b"\n".join(words).decode("utf-8", "replace")
        if self._plain(lines):
            ids = b"".join(map(self.pieces.__getitem__, _LINE_OR_PRE_TOKEN.findall(lines.lower())))
            self.words.update(zip(words, ids.split(_LINE_END), strict=True))
        elif len(words) > 1:
            for word in words:
                self._learn([word])
        else:
            self.words[words[0]] = _packed(self.tokenizer.encode(lines, add_special_tokens=False).ids)

    def text(self, text: bytes) -> bytes:
        # a mark may compose with the small letter before it and not with the capital; special ids are spelled exactly
        if not _MARKS.search(text):
            low = text.lower()
            if not any(x.encode().lower() in low for x in self.special):
                text = low
        words, out = text.split(), []
        for start in range(0, len(words), _LEARN):  # so that the new words of a very long text need bounded memory
            some = words[start : start + _LEARN]
            new = set(some).difference(self.words)
            if new:
                if len(self.words) >= MEMO_WORDS:
                    self.words.clear()
                    new = set(some)
                self._learn(list(new))
            out.append(b"".join(map(self.words.__getitem__, some)))
        return b"".join(out)


class Pieces(dict):
    """Piece of a plain word, or a line's end -> its ids, as WordIds."""

    def __init__(self, ids_of):
        super().__init__({"\n": _LINE_END})
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
            self["\n"] = _LINE_END
        out = self[piece] = self.ids_of(piece)
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory per worker process and vocabulary."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def cut(n: int, capacity: int, floor: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while part >= floor and rest:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    while rest:  # more than once only where capacity is not a power of two
        out.append(min(rest, max(floor - 1, 1)))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, floor: int = 64, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, nth[, ids]): the cut documents.

    part is the input partition and nth counts that partition's pieces of the same length.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint" + ", ids binary" * with_ids

    def run(batches):
        memo, part, seen, end = word_ids(vocabulary), TaskContext.get().partitionId(), Counter(), _packed([END_ID])
        for batch in batches:
            at, rows, ids_out = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memo.text(text or b"") + end
                total, start = len(ids) // 4, 0
                for length in cut(total, capacity, floor):
                    own = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((start, length, zlib.crc32(own), total, part, seen[length]))
                    if with_ids:
                        ids_out.append(own)
                    seen[length] += 1
                    start += length
            a = np.array(rows, dtype=np.int64).reshape(-1, 6)
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(a[:, k].copy()) for k in range(4)), pa.array(a[:, 4].astype(np.int32)), pa.array(a[:, 5].copy())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids_out, pa.binary())] if with_ids else [])], [*columns, *(["ids"] if with_ids else [])])

    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text")
    return slim.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(tidy(run), schema)


def layout(counts: dict[int, int], capacity: int) -> tuple[list[tuple], list[tuple]]:
    """From the number of pieces of each length: (length, fit, first_sequence, full) by class, and
    (length, over, sequence, offset) for the pieces that no full sequence takes.
    """
    classes, over, first = [], [], 0
    for length in sorted(counts, reverse=True):
        fit = capacity // length
        full = counts[length] // fit
        classes.append((length, fit, first, full))
        over += [(length, i) for i in range(counts[length] - full * fit)]
        first += full
    used: list[int] = []
    rests = []
    for length, i in over:  # longest first, into the first sequence with room
        at = next((k for k, x in enumerate(used) if x + length <= capacity), len(used))
        if at == len(used):
            used.append(0)
        rests.append((length, i, first + at, used[at]))
        used[at] += length
    return classes, rests


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, floor: int = 64, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece."""
    scratch = Scratch(spark, "packing")
    cut_up = scratch.save(pieces(docs, vocabulary, id_col, text_col, capacity, floor, with_ids))
    by_part = cut_up.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.save(by_part.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    # at most floor + log2(capacity) lengths, whatever the input
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    classes, rests = layout(counts, capacity)
    by_class = spark.createDataFrame(classes, "length bigint, fit bigint, first bigint, full bigint")
    # fewer than capacity * (1/1 + 1/2 + ... + 1/floor) + log2(capacity) rows
    by_rest = spark.createDataFrame(rests, "length bigint, over bigint, rest_sequence bigint, rest_offset bigint")
    ranked = cut_up.join(base.drop("n"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(by_class), "length").withColumn("over", F.col("rank") - F.col("full") * F.col("fit"))
    placed = placed.join(F.broadcast(by_rest), ["length", "over"], "left")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("rest_sequence", F.col("first") + F.expr("rank div fit")).alias("sequence_id"),
        F.coalesce("rest_offset", F.col("rank") % F.col("fit") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, pieces): each sequence's pieces by offset, for a writer of token files.

    A sequence holds at most `capacity` pieces, so the list is bounded. packed needs with_ids.
    """
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
