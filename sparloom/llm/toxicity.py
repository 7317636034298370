"""Toxicity of texts whose toxic words may be disguised: noisy-channel decoding, then a linear score.

A token, or a run of single letters set apart by blanks, becomes a lattice: each place offers
letters for look-alike digits and signs, one or two copies for a run of the same letter, and for
separators or blanks a word boundary or nothing. Viterbi search finds the most likely path under
channel costs and a character trigram model counted on all texts. Labelled texts give a lexicon of
restored words and stems that toxic texts have far more often than others. A text's score is a
logistic function of two measures: how many of its restored words the lexicon covers, and how dense
they are. For it, a token's lattice is searched only where some path may spell a word of the lexicon
(see may_spell()); no path of the others can, so they count as decoded to none.

Labels: where they hold texts of one kind only, or nothing tells the kinds apart, no lexicon can be
learned; every text then gets the same score, which is below 0.5, so nothing is rejected unjudged.
A text without a word of the lexicon never scores 0.5 or more, however many labels are toxic. Labels
that are null are left out, of several labels of a document the highest counts.

Rows: a null or empty text has no words and gets the score of the intercept alone; a null doc_id is
carried; repeated rows are scored each by itself; texts of any length are read whole, tokens over
64 characters without being remembered. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import groupby
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, columns_free_of, tidy

if TYPE_CHECKING:  # workers do without
    import pandas as pd

#: Symbols: 0 a boundary, 1 to 26 the letters, 27 any other letter.
BOUNDARY, OTHER, N_SYMBOLS = 0, 27, 28
# Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "§": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h",
}
#: Channel costs as log10 probabilities.
LETTER_FOR_SIGN, VOWEL_FOR_STAR, BOUNDARY_FOR_SIGN = -0.5, -1.2, -2.5
NOTHING_FOR_SEPARATOR, BOUNDARY_FOR_SEPARATOR = -0.5, -0.5
NOTHING_FOR_BLANK, BOUNDARY_FOR_BLANK = -0.3, -0.7
TWO_AS_TWO, TWO_AS_ONE, MANY_AS_ONE, MANY_AS_TWO = -0.1, -1.0, -0.2, -0.5
#: Decoded tokens a worker remembers; beyond it, it starts afresh.
MEMO = 200_000
#: Texts whose features are handed on at once: each has hundreds.
_TEXTS = 100
#: Characters counted at once.
_SLICE = 1 << 20

_ENDS = ".,;:?!\"'()[]{}<>#%&*-_/\\~`^=…«»“”‘’"
#: A sign in front of a word may stand for its first letter.
_STARTS = _ENDS.replace("!", "") + "¡"
_DOUBLE = re.compile(r"(.)\1", re.S)
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_DOLLARS = re.compile(r"\${3,}$")


def _folded() -> dict[str, str]:
    """Accented Latin letters by their plain letter."""
    out = {}
    for cp in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(cp).lower())[0]
        if "a" <= base <= "z" and chr(cp).isalpha():
            out[chr(cp)] = base
    return out | {"ß": "s", "æ": "a", "ø": "o", "đ": "d", "ł": "l", "œ": "o"}


FOLD = _folded()


def symbol(c: str) -> int:
    c = FOLD.get(c, c)
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else BOUNDARY


_TABLE: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    """Symbols of a lower-cased text, boundaries in a row as one."""
    if not _TABLE:
        _TABLE.append(np.array([symbol(chr(c)) for c in range(0xFFFF)] + [BOUNDARY], dtype=np.int32))
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    s = _TABLE[0][np.minimum(raw, 0xFFFF)]
    keep = s != BOUNDARY
    keep[1:] |= s[:-1] != BOUNDARY
    return s[keep]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(trigram, n) over all texts, each framed by boundaries; at most 28 cubed rows."""

    def run(batches):
        total = np.zeros(32**3, dtype=np.int64)

        def count(part: list[str]) -> None:
            s = _symbols("\n" + "\n".join(part) + "\n")
            if len(s) > 2:
                np.add(total, np.bincount(s[:-2] << 10 | s[1:-1] << 5 | s[2:], minlength=32**3), out=total)

        for batch in batches:
            part, held = [], 0
            for text in batch.column(0).to_pylist():
                if text:
                    part.append(text.lower())
                    held += len(text)
                if held > _SLICE:
                    count(part)
                    part, held = [], 0
            count(part)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "n"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(tidy(run), "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))


def smoothed(counts: np.ndarray, k: float = 5.0) -> list[float]:
    """log10 P(symbol | two before), by 32 * 32 * 32 index, backing off to one before and to none."""
    n = counts.reshape(32, 32, 32)[:N_SYMBOLS, :N_SYMBOLS, :N_SYMBOLS].astype(float)
    one = (n.sum((0, 1)) + 1) / (n.sum() + N_SYMBOLS)
    two = (n.sum(0) + k * one) / (n.sum((0, 2))[:, None] + k)
    three = (n + k * two[None]) / (n.sum(2, keepdims=True) + k)
    out = np.full((32, 32, 32), -9.0)
    out[:N_SYMBOLS, :N_SYMBOLS, :N_SYMBOLS] = np.log10(three)
    return out.ravel().tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Places of a lower-cased token, each with its options (text, cost); a blank is a boundary."""
    places = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i + 1
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c in " \t":
            places.append([("", NOTHING_FOR_BLANK), (" ", BOUNDARY_FOR_BLANK)])
        elif c in LOOKALIKES or c.isalpha():
            letters = [(x, LETTER_FOR_SIGN) for x in LOOKALIKES.get(c, "")] or [(c, 0.0)]
            if n == 1:
                options = list(letters)
            elif n == 2:
                options = [(x + x, p + TWO_AS_TWO) for x, p in letters] + [(x, p + TWO_AS_ONE) for x, p in letters]
            else:
                options = [(x, p + MANY_AS_ONE) for x, p in letters] + [(x + x, p + MANY_AS_TWO) for x, p in letters]
            if c in LOOKALIKES and not c.isalpha():
                options.append((" ", BOUNDARY_FOR_SIGN))
            places.append(options)
        else:
            vowels = [(v, VOWEL_FOR_STAR) for v in "aeiou"] if c == "*" and n == 1 else []
            places.append([("", NOTHING_FOR_SEPARATOR), (" ", BOUNDARY_FOR_SEPARATOR), *vowels])
        i = j
    return places


def viterbi(places: list[list[tuple[str, float]]], lm: list[float]) -> str:
    """The best path through the lattice under the trigram model, as text."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # the last two symbols -> score, path
    for options in places:
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for text, cost in options:
                s, total = state, score + cost
                for c in text:
                    x = symbol(c)
                    if x == BOUNDARY and s & 31 == BOUNDARY:
                        continue
                    total += lm[s << 5 | x]
                    s = (s & 31) << 5 | x
                best = after.get(s)
                if best is None or total > best[0]:
                    after[s] = (total, (path, text) if text else path)
        states = after
    _, path = max(((v[0] + (lm[s << 5] if s & 31 else 0.0), v[1]) for s, v in states.items()), key=lambda v: v[0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def stripped(token: str) -> str:
    """A token without the signs around it; a spaced-out run as it is."""
    if " " in token or "\t" in token:
        return token
    core = token.lstrip(_STARTS).rstrip(_ENDS)
    return _DOLLARS.sub("", core) if core.endswith("$$$") else core


class Restorer(dict):
    """token -> its restored words, remembered."""

    def __init__(self, lm: list[float]):
        super().__init__()
        self.lm = lm

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= MEMO:
            self.clear()
        out = self.decode(token)
        if len(token) <= 64:
            self[token] = out
        return out

    def decode(self, token: str) -> tuple[str, ...]:
        core = stripped(token)
        if core.isalpha() and not _DOUBLE.search(core) and not any(c in LOOKALIKES for c in core if c > "ɏ"):
            return (core,)
        if not any(c.isalpha() or c in LOOKALIKES for c in core) or core.isdigit():
            return ()
        return tuple(viterbi(lattice(core), self.lm).split())

    def words(self, text: str) -> list[str]:
        """All restored words of a text, in order; spaced-out words come once more at the end."""
        low = text.lower()
        out = [w for t in low.split() for w in self[t]]
        for run in _SPACED.findall(low):
            out += self[run]
        return out

    def text(self, text: str) -> str:
        """The restored text: words parted by blanks, spaced-out words in their place."""
        low = _SPACED.sub(lambda m: " ".join(self[m[0]]), text.lower())
        return "\n".join(" ".join(w for t in line.split() for w in self[t]) for line in low.split("\n"))


#: Lengths of word beginnings that are features beside whole words, as stems carry the sense.
STEMS = range(3, 8)


def features(words) -> set[str]:
    """Whole words, and their beginnings marked with a hyphen."""
    return {*words, *(w[:n] + "-" for w in words for n in STEMS if len(w) >= n)}


@dataclass
class Model:
    """The character model, the lexicon of toxic words and stems, and the weights of a text's
    measures (see measures())."""

    lm: list[float]
    weights: tuple[float, float, float]
    lexicon: frozenset[str] = frozenset()


def measures(hits: float, n_tokens: int) -> tuple[float, float, float]:
    """What the score is linear in: how many toxic words, how dense they are, and the intercept."""
    return math.log1p(hits), math.log1p(1000 * hits / (n_tokens + 20)), 1.0


def counted(restore: Restorer, text: str) -> tuple[Counter, int]:
    """How often each token stands in a text, spaced-out runs as further tokens; tokens in all."""
    low = text.lower()
    tokens = low.split()
    return Counter(tokens + _SPACED.findall(low)), len(tokens)


def fit_language_model(docs: DataFrame, text_col: str = "text") -> list[float]:
    counts = np.zeros(32**3)
    for r in trigram_counts(docs, text_col).collect():  # at most 28 cubed rows
        counts[r["trigram"]] = r["n"]
    return smoothed(counts)


def _g2(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """Log-likelihood ratio of rates a/n_a against b/n_b, signed."""
    p = (a + b) / (n_a + n_b)

    def ll(k, n, q):
        q = np.clip(q, 1e-12, 1 - 1e-12)
        return k * np.log(q) + (n - k) * np.log(1 - q)

    g = 2 * (ll(a, n_a, a / n_a) + ll(b, n_b, b / n_b) - ll(a, n_a, p) - ll(b, n_b, p))
    return np.where(a / n_a > b / n_b, g, -g)


def select(table: pd.DataFrame, n_a: int, n_b: int, docs_a: int, docs_b: int, least: float, ratio: float, most: int) -> list[str]:
    """Words and stems of toxic texts, the most telling first.

    table: feature, tokens in toxic and other texts (a, b), texts of either kind (da, db). What a
    chosen feature covers is taken from the stems that contain it; what it contains is left out.
    """
    names = table["feature"].tolist()
    at = {f: i for i, f in enumerate(names)}
    count = table[["a", "b", "da", "db"]].to_numpy(float).T.copy()
    live = np.ones(len(names), dtype=bool)
    chosen: list[str] = []
    while len(chosen) < most and live.any():
        a, b, da, db = count
        g = np.minimum(_g2(a, b, n_a, n_b), _g2(da, db, docs_a, docs_b))
        g[~live | (da < 3) | (a / n_a < ratio * (b + 0.5) / n_b)] = -1
        i = int(np.argmax(g))
        if g[i] < least:
            break
        chosen.append(names[i])
        own, stem = count[:, i].copy(), names[i].removesuffix("-")
        if names[i].endswith("-"):
            live &= np.array([not f.startswith(stem) for f in names])
        live[i] = False
        for n in STEMS:
            above = at.get(stem[:n] + "-")
            if n <= len(stem) and above is not None and above != i:
                count[:, above] = np.maximum(0, count[:, above] - own)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept (not penalised), by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, least_gain: float = 22.0, ratio: float = 8.0, max_features: int = 300) -> Model:
    """labels: (item, toxic boolean), rows to learn from.

    The character model is counted on all of docs. The lexicon and weights come from at most
    max_labelled labelled items, those with the lowest hash of the id; that bound makes them small
    enough to broadcast. A feature enters the lexicon if it is `ratio` times as frequent in toxic
    texts as in others and its log-likelihood ratios, by tokens and by texts, are least_gain.
    """
    lm = fit_language_model(docs, text_col)
    scratch = Scratch(spark, "toxicity")
    some = lowest_hashes(scratch, labels.filter("item is not null and toxic is not null").groupBy("item").agg(F.max("toxic").alias("toxic")), max_labelled)
    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text")
    sample = slim.join(F.broadcast(some), slim.doc_id == some.item).filter("text is not null").select("toxic", "text", F.xxhash64("text").alias("text_hash")).dropDuplicates(["toxic", "text_hash"])
    sample = scratch.save(sample.select("toxic", "text"))

    def count(batches):
        restore = Restorer(lm)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(at, _TEXTS)
                toxic, names, ns = [], [], []
                for y, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    found: Counter = Counter()
                    for token, n in counted(restore, text)[0].items():
                        for f in features(restore[token]):
                            found[f] += n
                    toxic += [y] * len(found)
                    names += found
                    ns += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.bool_()), pa.array(names, pa.string()), pa.array(ns, pa.int64())], ["toxic", "feature", "n"])

    by_text = sample.mapInArrow(tidy(count), "toxic boolean, feature string, n bigint")
    y = F.col("toxic")
    table = by_text.groupBy("feature").agg(F.sum(F.when(y, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(y, 0).otherwise(F.col("n"))).alias("b"), F.count_if(y).alias("da"), F.count_if(~y).alias("db"))
    n = {r["toxic"]: (r["texts"], r["tokens"]) for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size(F.split("text", r"\s+"))).alias("tokens")).collect()}
    (docs_a, n_a), (docs_b, n_b) = n.get(True, (0, 0)), n.get(False, (0, 0))
    if not docs_a or not docs_b:
        return unlearned(lm, docs_b)
    # only features that can pass; their number is bounded by the sample's
    table = table.filter((F.col("da") >= 3) & (F.col("a") / n_a >= ratio * F.col("b") / n_b)).toPandas()
    lexicon = frozenset(select(table, n_a, n_b, docs_a, docs_b, least_gain, ratio, max_features))
    if not lexicon:
        return unlearned(lm, docs_b)

    def measure(batches):
        hits = _hits(lm, lexicon)
        for batch in batches:
            m = [hits(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in m], pa.int64()), pa.array([k for _, k in m], pa.int64())], ["toxic", "hits", "n"])

    seen = sample.mapInArrow(tidy(measure), "toxic boolean, hits bigint, n bigint").toPandas()
    x = np.array([measures(h, k) for h, k in zip(seen["hits"], seen["n"], strict=True)])
    *slopes, intercept = map(float, logistic(x[:, :2], seen["toxic"].to_numpy(float)))
    return Model(lm, (*slopes, min(intercept, math.log(0.5))), lexicon)


def unlearned(lm: list[float], clean: int) -> Model:
    """A model without a lexicon: one score for all texts, 1/3 or less, lower with more clean labels."""
    return Model(lm, (0.0, 0.0, math.log(0.5 / (clean + 1))))


def lowest_hashes(scratch: Scratch, items: DataFrame, most: int) -> DataFrame:
    """The rows of different items with the lowest hashes of the item, `most` at most.

    The hash is cut at a share of its range that holds them all but for one case in some thousands,
    so that what is sorted in the end is about `most` rows, however many there are.
    """
    items = scratch.save(items.withColumn("_hash", F.xxhash64("item")))
    n = items.count()
    share = (most + 4 * math.sqrt(most) + 16) / n if n > most else 1.0
    if share < 1:
        below = items.filter(F.col("_hash") < int(-(2**63) + share * 2**64))
        items = below if below.count() >= most else items
    return items.orderBy("_hash", "item").limit(most).drop("_hash")


class _Alike(dict):
    """Code point -> one letter for all that it may be decoded to, nothing for a separator. Letters that
    share a sign are one letter."""

    same = {x: letters[0] for letters in LOOKALIKES.values() for x in letters[1:]}

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        x = LOOKALIKES.get(c, c if c.isalpha() else "")[:1]
        self[cp] = out = self.same.get(x, x)
        return out


#: Letters of a lexicon's words, runs as one, that may_spell() compares.
_HEAD = 8


def _any_head(heads: set[str]) -> str:
    """A regular expression for each of the heads, with every letter once or more."""
    if not heads:
        return "(?!)"
    if "" in heads:
        return ""
    tails: dict[str, set[str]] = {}
    for h in heads:
        tails.setdefault(h[0], set()).add(h[1:])
    return "(?:" + "|".join(f"{re.escape(c)}{re.escape(c)}*+{_any_head(t)}" for c, t in sorted(tails.items())) + ")"


def may_spell(lexicon: frozenset[str]):
    """stripped token -> False only if no path through its lattice spells a word of the lexicon.

    A path's word takes its letters, in order, from neighbouring places but for separators, one or two
    from a run of the same letter. So with separators left out, letters that share a sign taken as one
    and runs as one, the token holds the word's letters in a row. It begins with them if it consists of
    letters, as these give no boundaries. A star may be any vowel: such tokens are all decoded.
    """
    alike = _Alike()
    heads = {"".join(c for c, _ in groupby(f.removesuffix("-").translate(alike)))[:_HEAD] for f in lexicon}
    head = re.compile(_any_head(heads))

    def may(core: str) -> bool:
        found = (head.match if core.isalpha() else head.search)(core.translate(alike))
        return found is not None or bool(lexicon) and "*" in core

    return may


def _hits(lm: list[float], lexicon: frozenset[str]):
    """text -> (toxic words, tokens), for a worker."""
    restore = Restorer(lm)
    may = may_spell(lexicon)

    class Toxic(dict):
        """token -> how many of its restored words are in the lexicon"""

        def __missing__(self, token: str) -> int:
            if len(self) >= MEMO:
                self.clear()
            out = sum(not lexicon.isdisjoint(features([w])) for w in restore.decode(token)) if may(stripped(token)) else 0
            if len(token) <= 64:
                self[token] = out
            return out

    toxic = Toxic().__getitem__

    def one(text: str | None) -> tuple[int, int]:
        low = (text or "").lower()
        tokens = low.split()
        return sum(map(toxic, tokens)) + sum(map(toxic, _SPACED.findall(low))), len(tokens)

    return one


def _scorer(model: Model):
    """text -> score, for a worker."""
    hits = _hits(model.lm, model.lexicon)

    def one(text: str | None) -> float:
        z = sum(w * m for w, m in zip(model.weights, measures(*hits(text)), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    return one


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, score[, restored]) for every row of docs."""

    def run(batches):
        one, restore = _scorer(model), Restorer(model.lm)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            arrays = [batch.column(0), pa.array(map(one, texts), pa.float64())]
            if with_text:
                arrays.append(pa.array([restore.text(t or "") for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "restored"][: len(arrays)])

    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return slim.mapInArrow(tidy(run), "doc_id bigint, score double" + ", restored string" * with_text)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        one = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([one(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
