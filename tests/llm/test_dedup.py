"""Exact dedup, line dedup and SimHash against brute force."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.llm import common, exact, lines, simhash
from sparloom.llm.common import UPPER, ascii_lower, components

LOWER = str.maketrans(UPPER, UPPER.lower())


def test_ascii_lower_of_every_character(spark):
    # all of the basic plane but surrogates, in one text and one by one in small texts
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chars), *("aB" + "".join(chars[i : i + 50]) + "Cd" for i in range(0, len(chars), 50)), "", "ÀB", "BÀ", "À"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ascii_lower(df.t)).collect()] == [t.translate(LOWER) for t in texts]


def test_texts_that_share_a_digest_stay_apart(spark):
    rows = spark.createDataFrame([(1, "a", "d"), (2, "b", "d"), (3, "a", "d"), (4, "c", "e"), (5, "c", "e")], "doc_id bigint, norm string, digest string")
    whole = rows.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    twice = whole.groupBy("digest").count().filter("count > 1").select("digest")
    got = exact._met(rows, whole.drop("norm"), whole, twice)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 5, 2), (5, 5, 2)]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        g = groups[(t or "").translate(LOWER)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    return Counter(out)


def test_exact(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = exact.exact_duplicates(spark, odd.repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == brute_exact(rows)
    assert exact.exact_duplicates(spark, empty).collect() == []


def test_exact_groups_compare_content(spark, odd):
    """Different texts under one digest stay apart: the groups are by content."""
    got = exact.groups(odd, salts=2)
    assert got.count() == len({(r.text or "").translate(LOWER) for r in odd.collect()})


def brute_lines(rows, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    df = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and df[key(x)] >= min_docs)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return Counter(out)


LINES = ["Header", " header\t", "a", "b", "", "É", "é", "c\x0b", "\x0cHEADER"]


def test_lines(spark, odd, empty):
    rng = np.random.default_rng(1)
    rows = [(int(i), "\n".join(rng.choice(LINES, rng.integers(1, 6)))) for i in range(60)]
    rows += [(3, None), (None, None), (7, ""), (8, "Header"), (8, "Header")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for min_docs, batches in ((10, 3), (2, 1), (1, 4), (30, 7)):
        got = lines.drop_common_lines(spark, df, min_docs=min_docs, batches=batches)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute_lines(rows, min_docs)
    out = lines.drop_common_lines(spark, odd, min_docs=2)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == brute_lines([(r.doc_id, r.text) for r in odd.collect()], 2)
    assert lines.drop_common_lines(spark, empty).collect() == []


def test_runs_are_compacted_and_settled_keys_stay_out(spark):
    store = lines.LineRuns(spark, min_docs=2, fan_in=2, buckets=2)
    batch = lambda *ks: spark.createDataFrame([(k, k) for k in ks], "key_hi bigint, key_lo bigint")
    store.add(batch(1, 1, 2))  # 1 is settled at once
    assert store.unsettled(batch(1, 2, 3)).count() == 2
    store.add(batch(1, 2, 3))
    assert [len(x) for x in store.levels] == [0, 1]
    store.add(batch(3, 4))
    assert sorted(r[0] for r in store.settled().collect()) == [1, 2, 3]
    assert spark.table(store.levels[0][0]).count() == 2
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.prefix)]


def brute_fingerprint(text, n=3):
    words = (text or "").translate(LOWER)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    sh = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB éÉ\t\nx ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_bit_counts():
    h = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert simhash.bit_counts(h).tolist() == [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


@pytest.mark.parametrize("m", [1, 2, 40, 300])
def test_local_links_match_brute_force(m):
    rng = np.random.default_rng(m)
    base = int(rng.integers(0, 2**62))
    fps = np.array(sorted({base ^ (int(rng.integers(0, 2**16)) & (0xFF if m < 100 else 0xFFFF)) for _ in range(m)}), dtype=np.uint64)
    rng.shuffle(fps)
    want = brute_components(range(len(fps)), lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 2)
    to = simhash.local_links(fps)
    got = {}
    for i in range(len(fps)):
        j = i
        while to[j] != j:
            j = int(to[j])
        got[i] = j
    part = lambda d: Counter(frozenset(k for k in d if d[k] == r) for r in set(d.values()))
    assert part(want) == part(got)


@pytest.mark.parametrize("most", [3, 1024])
def test_links_by_tally_match_brute_force(spark, monkeypatch, most):
    """Random fingerprints, chains, crowds, and fingerprints that share bytes without being near."""
    rng = np.random.default_rng(most)
    fps = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for f in fps[:40]:
        x = f
        for _ in range(int(rng.integers(1, 5))):
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps += [fps[0] ^ (a | b << 9) for a in range(8) for b in range(8)]  # a crowd
    fps += [fps[1] ^ (int(a) << 40) for a in rng.integers(0, 2**24, 60)]  # five bytes shared
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "LIST", most)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    pairs = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)).collect()}
    linked = lambda a, b: (a, b) in pairs or (b, a) in pairs
    assert brute_components(signed, linked) == brute_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)


def test_simhash_components(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(40):
        base = list(rng.choice(words, 400))
        rows.append((100 + 3 * i, " ".join(base)))
        for k in (1, 2):
            base[int(rng.integers(400))] = "other"
            rows.append((100 + 3 * i + k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for (i, _), f in zip(rows, fps, strict=True):
        least[comp[f]].append(i)
    want = Counter((i, f - 2**64 if f >= 2**63 else f, min((x for x in least[comp[f]] if x is not None), default=None)) for (i, _), f in zip(rows, fps, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(spark, df).collect()) == want
    assert any(len(v) > 2 for v in least.values())
    assert simhash.near_duplicates(spark, empty).collect() == []
    assert simhash.near_duplicates(spark, odd).count() == odd.count()


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "IN_ONE_TASK", at_once)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    linked = {frozenset(e) for e in edges}
    nodes = sorted({n for e in edges for n in e})
    want = brute_components(nodes, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.root for r in components(spark, df).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert components(spark, df.limit(0)).collect() == []


def test_similar_texts(spark, odd, empty):
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(60):
        base = list(rng.choice(words, 200))
        for k in range(4):
            i = len(rows)
            rows.append((i, " ".join(base), "s", "extra"))
            group[i] = g
            # two changed words of 200 leave nine tenths of the five-word shingles
            base = list(base)
            base[int(rng.integers(200))] = f"new{i}"
            if k > 1:
                base[int(rng.integers(200))] = f"more{i}"
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, keeper string")
    kept = simhash.drop_similar(spark, df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [min(i for i in group if group[i] == g) for g in range(60)]
    got = [(r.doc_id, r.text) for r in simhash.drop_similar(spark, odd).collect()]
    # equal words and empty texts are copies; the smallest known id stays
    assert sorted(i for i, _ in got) == [1, 3, 5, 6, 7, 10]
    assert simhash.drop_similar(spark, empty).collect() == []


def test_similar_texts_are_named_by_the_fingerprint_index(spark, monkeypatch):
    """Pairs come from the index first; those whose sets are not similar are not tied by it."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1000, 120)) for _ in range(6)]
    copies = [x + " end" for x in texts]
    df = spark.createDataFrame(list(enumerate([*texts, *copies, "one", "two"])), "doc_id bigint, text string")
    seen, found = [], simhash._by_fingerprint
    monkeypatch.setattr(simhash, "_by_fingerprint", lambda *a: (seen.append(found(*a)), seen[-1])[1])
    kept = {r.doc_id for r in simhash.drop_similar(spark, df).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 12, 13}
    n_linked = sum(bin(simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).count("1") <= 2 for a, b in zip(texts, copies, strict=True))
    assert len(seen) == 1 and n_linked > 0 and seen[0].count() >= n_linked


def test_similar_texts_with_the_same_filler_are_not_copies(spark):
    """One shingle makes up most of each text and all of its fingerprint; the rest is different."""
    rows = [(i, " ".join(["-"] * 200 + [f"w{i}x{j}" for j in range(60)])) for i in range(6)]
    kept = simhash.drop_similar(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))


def crowds(tag, members=12):
    """(id, text): two crowds of close copies that one pair alone ties together, at 180 of 220 shingles."""
    base = [f"{tag}w{j}" for j in range(204)]
    other = base[:-20] + [f"{tag}o{j}" for j in range(20)]
    texts = [base, other]
    for c in range(2):
        texts += [[f"{tag}c{c}m{i}x{j}" for j in range(10)] + texts[c][10:] for i in range(members)]
    return [" ".join(t) for t in texts]


def test_similar_crowds_tied_by_one_pair(spark):
    """All nearest partners of both texts of the pair are of their own crowd."""
    df = spark.createDataFrame(list(enumerate(crowds("a"))), "doc_id bigint, text string")
    assert [r.doc_id for r in simhash.drop_similar(spark, df).collect()] == [0]


def test_similar_texts_miss_no_pair_at_the_threshold(spark):
    """Lone pairs at exactly 0.8 and just below: 160 of 200 shingles and 159 of 201."""
    rows, want = [], []
    for g in range(80):
        n, changed = (180, 20) if g % 2 else (180, 21)
        base = [f"g{g}w{j}" for j in range(n + 4)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:-changed] + [f"g{g}o{j}" for j in range(changed)]))]
        want += [2 * g] if g % 2 else [2 * g, 2 * g + 1]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_similar(spark, df).collect()) == want


def test_similar_crowds_are_all_tied(spark):
    texts = [t for g in range(10) for t in crowds(f"k{g}", members=9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_similar(spark, df).collect()) == list(range(0, len(texts), 20))


def test_sets_travel_only_for_pairs_that_bounds_leave(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = [f"s{k}" for k in range(60)]
    texts = [" ".join([*shared, *(f"w{i}x{k}" for k in rng.integers(0, 1000, 200))]) for i in range(12)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0] + " end"])), "doc_id bigint, text string")
    left, possible = [], simhash._possible
    monkeypatch.setattr(simhash, "_possible", lambda *a: (left.append(r := possible(*a)), [left.append(r.count()), r][1])[1])
    assert sorted(r.doc_id for r in simhash.drop_similar(spark, df).collect()) == list(range(12))
    assert max(n for n in left if isinstance(n, int)) == 1


def test_shingle_sets_are_equal_where_words_are():
    """The quick hashes against sets of the shingles themselves."""
    rng = np.random.default_rng(21)
    words = [b"a", b"A", b"ab", b"b" * 8, b"b" * 9, b"\0", b"\0\0", b"c" * 64, b"c" * 65, b"D" * 200, "é".encode(), b"abcdefgh", b"abcdefghi", b"12345678i"]
    spaces = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"  \n"]
    texts = [None, b"", b" \n", b"A b", b"a B", b"a", b"A b c d e", b"a b c d e f"]
    for _ in range(200):
        texts.append(b"".join(words[int(rng.integers(len(words)))] + spaces[int(rng.integers(len(spaces)))] for _ in range(int(rng.integers(0, 30)))))
    for n in (1, 3, 5):
        want = [set(simhash.shingles_of(simhash.words_of(t or b""), n)) for t in texts]
        got = [set(s.tolist()) for s in simhash.shingle_sets(texts, n)]
        assert [len(x) for x in got] == [len(x) for x in want]
        assert all(len(a & b) == len(x & y) for a, x in zip(got, want, strict=True) for b, y in zip(got, want, strict=True))
        assert [set(simhash.shingle_sets([t], n)[0].tolist()) for t in texts] == got  # whatever the neighbours
    assert simhash.shingle_sets([], 5) == []


def test_wide_maps_bound_the_difference():
    rng = np.random.default_rng(22)
    for n in (600, 1000, 1030, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert simhash._apart(simhash._wide(a), simhash._wide(a)) == 0
        for m in (0, 1, 50, n):  # so many more, besides as many of a's less
            b = np.unique(np.concatenate([a[m // 2 :], rng.integers(0, 2**64, m, dtype=np.uint64)]))
            apart = simhash._apart(simhash._wide(a), simhash._wide(b)) if len(b) > 512 else 0
            assert apart <= len(np.setxor1d(a, b))
        b = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert simhash._apart(simhash._wide(a), simhash._wide(b)) > 2 * n / 9  # what 0.8 allows
    assert simhash._wide(a[:512]) is None


def test_similar_texts_take_little_disk(spark, monkeypatch):
    """No table is larger than the texts; long texts that share a passage only do not travel to be compared."""
    rng = np.random.default_rng(23)
    passage = [f"p{k}" for k in range(60)]
    rows, same = [], 20
    for i in range(60):
        base = [f"w{k}" for k in rng.integers(0, 200, 1500)]
        rows.append(" ".join([*base[:700], *passage, *base[700:]]))
    for i in range(same):
        rows.append(rows[i] + " and an end")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    sizes, pairs, save, narrowed = [], [], common.Scratch.save, simhash._narrowed

    def spy(self, *a, **k):
        out = save(self, *a, **k)
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(out.saved_at.removeprefix("file:")) for f in names if f.endswith(".parquet")))
        return out

    def spy_narrowed(scratch, found, t):
        before = found.count()
        pairs.append((before, (out := narrowed(scratch, found, t)).count()))
        return out

    def run():
        sizes.clear()
        pairs.clear()
        return {r.doc_id for r in simhash.drop_similar(spark, df).collect()}

    monkeypatch.setattr(common.Scratch, "save", spy)
    monkeypatch.setattr(simhash, "_narrowed", spy_narrowed)
    monkeypatch.setattr(simhash, "COUNTERS", 1)  # nothing is known to be rare, so the passage is met under
    assert run() == set(range(60))
    assert 0 < max(sizes) < sum(map(len, rows))
    assert pairs[-1][0] > 1000 and sum(p[1] for p in pairs) <= 4 * same
    whole = len(sizes)
    monkeypatch.setattr(simhash, "TURN_ROWS", 10_000)  # more turns find the same, and joins without broadcasts
    monkeypatch.setattr(simhash, "FEW", 1)
    assert run() == set(range(60)) and len(sizes) > whole + 10
