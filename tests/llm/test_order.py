"""Packing, mixing and sharding."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.llm import mixing, packing, sharding
from sparloom.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def memo():
    return packing.word_ids(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("abC 'sDÉß12.<|>\n\t")), max_size=40))
def test_word_ids_are_the_library_s(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY) if not hasattr(test_word_ids_are_the_library_s, "t") else test_word_ids_are_the_library_s.t
    test_word_ids_are_the_library_s.t = whole
    got = np.frombuffer(packing.word_ids(VOCABULARY).text(text.encode()), "<u4").tolist()
    assert got == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["It's John's 3rd <|endoftext|> x<|startoftext|>", "naïve ﬁne Σίσυφος İstanbul", "日本語 한국어", "a\u00a0b\x85c\x1cd", "don't'll"])
def test_special_words(tokenizer, memo, text):
    assert np.frombuffer(memo.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 10_000), st.sampled_from([(2048, 64), (8, 2), (64, 1), (100, 7)]))
def test_cut(n, how):
    capacity, floor = how
    parts = packing.cut(n, capacity, floor)
    assert sum(parts) == n and all(0 < p <= capacity for p in parts)


def test_spellings_share_an_entry_and_new_words_are_cut_at_once():
    memo = packing.WordIds(VOCABULARY)
    asked, cuts = [], []
    piece, learn = memo._piece, memo._learn
    memo.pieces.ids_of = lambda p: asked.append(p) or piece(p)
    memo._learn = lambda words: cuts.append(len(words)) or learn(words)
    text = "Ente ENTE ente, Öl ÖL öl don'T zzq zzq! " + " ".join(f"wort{i}x" for i in range(300))
    got = np.frombuffer(memo.text(text.encode()), "<u4").tolist()
    assert got == memo.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and len(cuts) == 1 and cuts[0] < len(set(text.split()))
    odd = "H\u0331 h\u0331 <|ENDOFTEXT|> <|endoftext|> A\x1cB ɏ ɐ ΑΣ"  # spelled exactly, or composed, or not plain
    got = np.frombuffer(memo.text(odd.encode()), "<u4").tolist()
    assert got == [i for w in odd.split(" ") for i in memo.tokenizer.encode(w, add_special_tokens=False).ids]



def check_packing(spark, docs, tokenizer, capacity):
    out = packing.pack(spark, docs, VOCABULARY, capacity=capacity, floor=max(2, capacity // 32), with_ids=True)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = out.collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, tuple(ids)] += 1
    # pieces put together again give each document, as often as it was there
    got = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got[r.doc_id, r.doc_tokens].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
    assert sum(len(i) for v in got.values() for _, i in v) == sum(len(k[1]) * n for k, n in want.items())
    for (doc, ids), n in want.items():
        if len([1 for d, _ in want if d == doc]) == 1:
            by_start = Counter(got[doc, len(ids)])
            assert set(by_start.values()) == {n}
            assert tuple(x for _, i in sorted(by_start) for x in i) == ids
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_pack(spark, odd, empty, tokenizer):
    check_packing(spark, odd, tokenizer, 2048)
    many = spark.range(300).selectExpr("id doc_id", "repeat('lorem ipsum dolor ', cast(id % 97 as int)) text").repartition(7)
    sequences = check_packing(spark, many, tokenizer, 256)
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used >= 0.97 * 256 * len(sequences)
    assert packing.pack(spark, empty, VOCABULARY).collect() == []
    whole = packing.sequences(packing.pack(spark, many, VOCABULARY, capacity=256, floor=8, with_ids=True)).collect()
    assert sum(r.n_tokens for r in whole) == used


def brute_targets(sizes, weights, share, cap):
    target, capped = [Fraction(0)] * len(sizes), set()
    total = share * sum(sizes)
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [Fraction(cap * sizes[i]) if i in capped else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and target[i] > cap * sizes[i]}
        if not over:
            return target
        capped |= over
        if len(capped) == len(sizes):
            return [Fraction(cap * s) for s in sizes]


def test_targets(spark):
    """Against targets worked out source by source, names in any order, one of them null."""
    rng = np.random.default_rng(9)
    for k in range(6):
        sizes = [int(x) for x in rng.integers(0, 10 ** int(rng.integers(1, 5)), int(rng.integers(1, 12)))]
        names = sorted({str(rng.integers(10**9)) + "é\U0001F600ￜ"[int(rng.integers(3))] for _ in sizes})
        names = [*names[: len(sizes) - 1], None] if k % 2 else names[: len(sizes)]
        sizes = sizes[: len(names)]
        rows = spark.createDataFrame([(n, s) for n, s in zip(names, sizes, strict=True)] + [(names[0], 0)], "source string, size bigint").repartition(3)
        got = {r.s: r for r in mixing.planned(Scratch(spark, "t"), rows, (3, 1, 2), Fraction(3, 2), 2).collect()}
        want = brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], Fraction(3, 2), 2) if any(sizes) else [0] * len(sizes)
        assert [got[i].name for i in range(len(names))] == names
        assert [(got[i].source_size, got[i].target, got[i].words) for i in range(len(names))] == [(s, pytest.approx(float(t)), int(t)) for s, t in zip(sizes, want, strict=True)]


def test_more_sources_than_the_tree_has_units(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 13)), f"s{i % 300}") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    monkeypatch.setattr(mixing, "CELLS", 64)
    drawn = mixing.draw(spark, df, shards=8).collect()
    taken, target, shards = Counter(), {}, Counter()
    for r in drawn:
        taken[rows[r.doc_id][2]] += sum(t.words for t in r.takes)
        target[rows[r.doc_id][2]] = r.target
        shards.update(t.shard for t in r.takes)
    assert all(abs(taken[s] - target[s]) < 1 for s in target) and len(target) == 300
    assert set(shards) == set(range(8)) and max(shards.values()) < 1.3 * min(shards.values())


def test_splitting_tree():
    tree = mixing.splitting_tree([100, 3, 0, 57], 8, seed=1)
    assert tree.sum(0).tolist() == [100, 3, 0, 57]
    assert tree.sum(1).max() - tree.sum(1).min() <= 1
    assert (tree == mixing.splitting_tree([100, 3, 0, 57], 8, seed=1)).all()


def test_draw_and_mix(spark, odd, empty):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 91)), "big" if i % 3 else f"s{i % 12}") for i in range(600)] + [(900, None, None), (901, "a b", None), (902, "", "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    for docs in (df, odd):
        drawn = mixing.draw(spark, docs, shards=4).collect()
        assert Counter(r.doc_id for r in drawn) == Counter(r.doc_id for r in docs.collect())
        size, taken, target = Counter(), Counter(), {}
        for r, words in ((r, sum(t.words for t in r.takes)) for r in drawn):
            assert words <= 2 * r.size
            key = (r.source_size, r.target)
            size[key] += r.size
            taken[key] += words
        by_target = {k: n for k, n in taken.items()}
        for (source_size, target), n in by_target.items():
            same = round(size[source_size, target] / source_size) if source_size else 1
            assert abs(n - same * target) <= same
    again = {(r.doc_id, str(r.takes)) for r in mixing.draw(spark, df.repartition(3), shards=4).collect()}
    assert again == {(r.doc_id, str(r.takes)) for r in mixing.draw(spark, df, shards=4).collect()}
    mixed = mixing.mix(spark, df, shards=4)
    assert mixed.columns == df.columns
    drawn = mixing.draw(spark, df, shards=4).collect()
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(t.words for r in drawn for t in r.takes)
    assert mixed.count() == sum(len(r.takes) for r in drawn)
    assert mixing.mix(spark, odd).columns == odd.columns and mixing.mix(spark, odd).count() > 0
    assert mixing.draw(spark, empty).collect() == [] and mixing.mix(spark, empty).collect() == []


def test_shards(spark, odd, empty, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=40_000, fan_in=3, small_bytes=10_000)
    assert store.read(schema=odd.schema).collect() == []
    base = spark.range(4000).selectExpr("id", "sha2(cast(id as string), 256) s")
    for i in range(7):
        store.append(base.filter(f"id % 7 = {i}").coalesce(3))
        before = store.version()
        store.compact()
        assert sorted(r.id for r in store.read().select("id").collect()) == sorted(j for j in range(4000) if j % 7 <= i)
        assert store.version() >= before
    assert store.append(base.limit(0)) is None
    tiers = Counter(r.tier(store.small_bytes, store.fan_in) for r in store.manifest())
    assert max(tiers.values()) < 3 and len(store.manifest()) < 7
    live = {r.path for r in store.manifest()}
    old = store.read(version=0)
    assert store.vacuum() == 0 and old.count() == len(range(0, 4000, 7))  # all are younger than the retention
    assert store.vacuum(keep_seconds=0) > 0
    assert {str(p) for p in (tmp_path / "store" / "runs").iterdir()} == {p.removeprefix("file:") for p in live}
    assert sorted(r.id for r in store.read().select("id").collect()) == list(range(4000))
    # a writer that has read an older version can't commit over a newer one
    with pytest.raises(RuntimeError):
        store.commit([], store.version() - 1)
    mine = sharding.ShardStore(spark, str(tmp_path / "odd"))
    mine.append(odd)
    assert Counter(map(str, mine.read().collect())) == Counter(map(str, odd.collect()))
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, str(tmp_path / "none")).read()


def test_a_merge_that_never_commits_changes_nothing(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fan_in=2)
    store.append(spark.range(10).toDF("id"))
    store.append(spark.range(10, 20).toDF("id"))
    version = store.version()
    store._merge(store.manifest())  # and then the driver is lost
    assert store.version() == version and store.read().count() == 20
    assert store.compact() == 1 and store.read().count() == 20 and len(store.manifest()) == 1


def test_interleaved_writers(spark, tmp_path):
    """Two writers: neither a vacuum nor a merge takes what the other has yet to commit."""
    root = str(tmp_path / "two")
    one, two = (sharding.ShardStore(spark, root, fan_in=2) for _ in range(2))
    one.append(spark.range(10).toDF("id"))
    spark.range(100, 110).toDF("id").write.parquet(f"{root}/runs/late")
    late = two._run(f"{root}/runs/late")  # written, not committed
    one.append(spark.range(10, 20).toDF("id"))
    assert one.compact() == 1
    one.vacuum(keep_seconds=0)
    two._add([late], spark.range(1).toDF("id").schema)
    assert sorted(r.id for r in one.read().collect()) == [*range(20), *range(100, 110)]
    # a writer that finds its version taken tries again on top of the newer one
    at = two.version()
    one.append(spark.range(200, 203).toDF("id"))
    with pytest.raises(sharding.Conflict):
        two.commit(two.manifest(at), at)
    # a merge that another writer was quicker to do is not committed twice
    runs = two.manifest()
    merged = two._merge(runs)
    assert one.compact() >= 1
    assert two._replace(runs, merged) is False
    assert sorted(r.id for r in two.read().collect()) == [*range(20), *range(100, 110), *range(200, 203)]


def test_columns_added_later_outlive_merges(spark, tmp_path):
    for k in range(3):
        store = sharding.ShardStore(spark, str(tmp_path / f"s{k}"), fan_in=2)
        store.append(spark.range(5).toDF("id"))
        store.append(spark.range(5, 8).selectExpr("id AS ID", "concat('x', id) more", "array(id) many"))
        store.append(spark.range(0).selectExpr("id", "1 AS never"))
        assert store.compact() == 1 and len(store.manifest()) == 1
        store.append(spark.range(8, 9).selectExpr("'z' more", "id"))
        got = {r.id: (r.more, r.many) for r in store.read().collect()}
        assert got == {**{i: (None, None) for i in range(5)}, **{i: (f"x{i}", [i]) for i in range(5, 8)}, 8: ("z", None)}
        version = store.version()
        with pytest.raises(ValueError, match="more is bigint, in the store string"):
            store.append(spark.range(1).selectExpr("id", "id AS more"))
        assert store.version() == version and store.read().columns == ["id", "more", "many"]


def test_one_pass_of_arrivals(spark, odd, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "each"), fan_in=3)
    store.append_each(odd, F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    assert store.version() >= 3 and store.read().columns == odd.columns
    assert Counter(map(str, store.read().collect())) == Counter(map(str, odd.collect()))


def test_a_taken_name_is_not_overwritten(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "r"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in "ab":
        (tmp_path / name).write_text(name)
    store._rename(path(f"file:{tmp_path}/a"), path(f"file:{tmp_path}/c"))
    with pytest.raises(Exception, match="exists"):
        store._rename(path(f"file:{tmp_path}/b"), path(f"file:{tmp_path}/c"))
    assert (tmp_path / "c").read_text() == "a"
