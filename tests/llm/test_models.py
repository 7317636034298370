"""Toxicity, language model, URL filter and embeddings."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparloom.llm import embedding, lm, toxicity, urls
from sparloom.llm.common import Scratch, crc_remainder


def crc(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def test_crc_remainder(spark):
    df = spark.createDataFrame([(i,) for i in (None, 0, 1, 99, -5)], "i bigint")
    assert [r[0] for r in df.select(crc_remainder(F.col("i"), 5)).collect()] == [crc(i, 5) for i in (None, 0, 1, 99, -5)]


# toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    clean = ["river", "stone", "bread", "window", "garden", "yellow", "morning", "letter", "forest", "table", "gentle", "market"]
    bad = ["stupid", "idiot", "moron"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 60))
        toxic = i % 4 == 0
        if toxic:
            for w in rng.choice(bad, 4):
                words[int(rng.integers(60))] = str(w)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "item bigint, toxic boolean")


@pytest.fixture(scope="module")
def model(spark, corpus):
    return toxicity.fit(spark, *corpus)


def test_lexicon_and_held_out_scores(spark, corpus, model):
    docs, labels = corpus
    half = toxicity.fit(spark, docs, labels.filter("item % 2 = 1 or item % 8 = 0"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, half).collect()}
    held = [i for i in range(400) if not (i % 2 == 1 or i % 8 == 0)]
    assert np.mean([(scores[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert any(f.startswith(("stu", "idi", "mor")) for f in model.lexicon)


@pytest.mark.parametrize("word", ["stup1d", "s.t.u.p.i.d", "stuuupid", "!diot", "1d1ot", "m0r0n", "mmoorroonn", "$tupid", "stu-pid", "idi*t"])
def test_restores_disguised_words(model, word):
    assert toxicity.Restorer(model.lm)[word][0] in ("stupid", "idiot", "moron")


def test_restores_spaced_words_and_leaves_others(model):
    r = toxicity.Restorer(model.lm)
    assert r.text("You  m o r o n !\ngo") == "you moron\ngo"
    assert "idiot" in r.words("such an i d i o t")
    assert r.words("Garden window, 12 !!") == ["garden", "window"]


def brute_viterbi(places, lm_):
    paths = [("", 0.0)]
    for options in places:
        paths = [(p + t, c + k) for p, c in paths for t, k in options]

    def total(text, cost):
        s = 0
        for ch in text + (" " if text and text[-1] != " " else ""):
            x = toxicity.symbol(ch)
            if x == 0 and s & 31 == 0:
                continue
            cost += lm_[s << 5 | x]
            s = (s & 31) << 5 | x
        return cost

    return max(total(p, c) for p, c in paths), total


@pytest.mark.parametrize("token", ["st1", "a-b", "oo0", "$$a!", "aaab", "p a t h", "x*y"])
def test_viterbi_is_exact(model, token):
    places = toxicity.lattice(token)
    best, total = brute_viterbi(places, model.lm)
    # cost of the path found: the best cost among lattice paths with its text
    text = toxicity.viterbi(places, model.lm)
    paths = [("", 0.0)]
    for options in places:
        paths = [(p + t, c + k) for p, c in paths for t, k in options]
    assert max(total(p, c) for p, c in paths if p == text) == pytest.approx(best)


def test_toxicity_of_odd_rows(spark, odd, empty, model):
    got = toxicity.score(odd, model, with_text=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.keep_clean(odd, model).count() == odd.count()
    no_labels = spark.createDataFrame([], "item bigint, toxic boolean")
    assert toxicity.fit(spark, empty, no_labels).lexicon == frozenset()


@pytest.mark.parametrize("kinds", ["none", "clean only", "toxic only", "untellable"])
def test_without_usable_labels_nothing_is_rejected(spark, corpus, odd, kinds):
    docs, labels = corpus
    some = {"none": labels.limit(0), "clean only": labels.filter("not toxic"), "toxic only": labels.filter("toxic"), "untellable": labels.select("item", (F.xxhash64("item") % 3 != 0).alias("toxic"))}[kinds]
    m = toxicity.fit(spark, docs, some)
    assert m.lexicon == frozenset()
    scores = {r.score for r in toxicity.score(docs, m).collect()}
    assert len(scores) == 1 and scores.pop() <= 1 / 3
    assert toxicity.keep_clean(docs, m).count() == docs.count() and toxicity.keep_clean(odd, m).count() == odd.count()


def test_mostly_toxic_labels_dont_reject_plain_texts(spark, corpus):
    docs, labels = corpus
    m = toxicity.fit(spark, docs, labels.filter("toxic or item < 40"))
    kept = {r.doc_id for r in toxicity.keep_clean(docs, m).collect()}
    assert {i for i in range(400) if i % 4} <= kept and m.lexicon
    assert toxicity.score(docs.limit(1).selectExpr("doc_id", "'' AS text"), m).first().score < 0.5


def test_labels_of_the_lowest_hashes(spark):
    items = spark.range(5000).selectExpr("id AS item", "id % 2 = 0 AS toxic")
    want = sorted(r.item for r in items.orderBy(F.xxhash64("item"), "item").limit(300).collect())
    assert sorted(r.item for r in toxicity.lowest_hashes(Scratch(spark, "t"), items, 300).collect()) == want
    assert toxicity.lowest_hashes(Scratch(spark, "t"), items, 5000).count() == 5000


def test_scores_against_brute_force(spark, corpus, model):
    """Every token decoded by trying all paths, then words counted one by one."""
    docs, _ = corpus
    texts = ["you st1pid m0ron", "river  stone\nbread", "", "an 1diot, an idi*t!", "st.one bre-ad", "moron " * 9 + "table"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}

    def restored(token):
        core = token.lstrip(toxicity._STARTS).rstrip(toxicity._ENDS)
        best, total = brute_viterbi(toxicity.lattice(core), model.lm) if core else (0.0, None)
        paths = [("", 0.0)]
        for options in toxicity.lattice(core):
            paths = [(p + t, c + k) for p, c in paths for t, k in options]
        return next((p.split() for p, c in paths if total(p, c) == best), []) if core else []

    for i, text in enumerate(texts):
        hits = 0
        for token in text.split():
            for w in restored(token):
                starts = {w[:n] + "-" for n in range(3, 8) if len(w) >= n}
                hits += bool(({w} | starts) & model.lexicon)
        z = np.dot(model.weights, [np.log(1 + hits), np.log(1 + 1000 * hits / (len(text.split()) + 20)), 1.0])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))
    assert got[0] > 0.5 > got[1]


def test_only_lattices_that_may_spell_a_lexicon_word_are_searched(monkeypatch):
    searched = []
    monkeypatch.setattr(toxicity, "viterbi", lambda places, lm_: searched.append(places) or "loser")
    hits = toxicity._hits([], frozenset({"loser", "stupi-"}))
    assert hits("coffee b00k ball. 555-8046 a.b 3.1$$$ unlooser x y z Loser") == (1, 11) and not searched
    assert hits("1oser looser. l0-ser l*ser a|oser " + "l o s e r") == (6, 10) and len(searched) == 6
    assert toxicity._hits([], frozenset())("l00ser l*ser") == (0, 2) and len(searched) == 6


def test_no_word_that_a_lattice_spells_is_left_out():
    """Against all paths of lattices made from the words and of others."""
    rng = np.random.default_rng(5)
    letters, signs = list("ilosgetabzué"), [*toxicity.LOOKALIKES, *"*-._ ßx"]
    spelt = 0
    for _ in range(1500):
        words = ["".join(rng.choice(letters, int(rng.integers(1, 5)))) for _ in range(2)]
        lexicon = frozenset({words[0], words[1] + "-"})
        token = str(rng.choice(["", "", "x", "-", "0"]))
        for c in words[int(rng.integers(2))] if rng.random() < 0.7 else rng.choice(letters + signs, 4):
            token += str(rng.choice([c, *(s for s, of in toxicity.LOOKALIKES.items() if c in of), *"*" * (c in "aeiou")])) * int(rng.integers(1, 4))
            token += str(rng.choice(["", "", "", "-", " "]))
        core = toxicity.stripped(token)
        paths = {""}
        for options in toxicity.lattice(core):
            paths = {p + t for p in paths for t, _ in options}
        if any(not lexicon.isdisjoint(toxicity.features([w])) for p in paths for w in p.split()):
            spelt += 1
            assert toxicity.may_spell(lexicon)(core), (token, lexicon)
    assert spelt > 300


# language model


def test_counts_and_scores(spark, odd, empty):
    rng = np.random.default_rng(4)
    # two kinds of words that follow their own kind
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{k}" for k in range(12)], 30))) for i in range(200)]
    docs = spark.createDataFrame(rows + [(500, None), (None, "zz Zz")], "doc_id bigint, text string")
    train = docs.filter(crc_remainder(F.col("doc_id"), 5) != 1)
    size = lm.Size(head=12, known=16, classes=4, rounds=4)
    model = lm.fit(spark, train, size=size)
    counts, n = Counter(), 0
    for r in train.collect():
        t = [w.lower() for w in (r.text or "").split()] + ["\n"]
        counts.update(t)
        n += len(t)
    assert (model.n, model.v) == (n, len(counts))
    out = lm.score(spark, docs, model).collect()
    assert len(out) == docs.count()
    by_id = {r.doc_id: r for r in out}
    for i, text in [*rows, (500, None), (None, "zz Zz")]:
        t = [w.lower() for w in (text or "").split()] + ["\n"]
        r = by_id[i]
        assert (r.n_tokens, r.n_known) == (len(t), sum(counts[w] > 0 for w in t))
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in t))
    # the score, word by word, from the classes of all words
    table = dict(model.known) | {bytes(r.word): (r.c, r["class"]) for r in model.vocabulary.collect()}
    assert {w.decode(): c for w, (c, _) in table.items() if c} == counts and len(model.known) <= 17 < len(table)
    unseen = set()
    for i, text in [*rows, (500, None), (None, "zz Zz")]:
        before, want = table[lm.END][1], 0.0
        for w in [w.lower() for w in (text or "").split()] + ["\n"]:
            if w.encode() not in table:
                unseen.add(i)
            c, d = table.get(w.encode(), (0, 0))
            want += model.step[before, d] + np.log10(c + 0.5) - model.total[d]
            before = d
        assert i in unseen or by_id[i].score == pytest.approx(want)
    # words follow their own kind, and so their classes do
    kinds = Counter((d, w[:1]) for w, (c, d) in table.items() if w[:1] in (b"a", b"b"))
    assert sum(max(kinds[d, b"a"], kinds[d, b"b"]) for d in range(4)) >= 22
    held = [r for r in out if crc(r.doc_id, 5) == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(spark, empty, model).collect() == [] and len(lm.score(spark, odd, model).collect()) == odd.count()
    nothing = lm.fit(spark, empty, size=size)
    assert all(np.isfinite(r.score) for r in lm.score(spark, odd, nothing).collect())


def test_model_sums_to_one(spark):
    docs = spark.createDataFrame([(i, "a b c a b d e" + " f g" * (i % 2)) for i in range(5)], "doc_id bigint, text string")
    m = lm.fit(spark, docs, size=lm.Size(head=4, known=6, classes=3, rounds=2))
    assert np.allclose((10.0**m.step).sum(1), 1)
    mass = np.zeros(3)
    for c, d in [*m.known.values(), *((r.c, r["class"]) for r in m.vocabulary.collect())]:
        mass[d] += c + 0.5
    assert np.allclose(mass + 0.5, 10.0**m.total)  # one entry of each class is that of unknown words


@pytest.mark.parametrize("flush", [8, 1_000_000])
def test_every_transition_is_counted(spark, monkeypatch, flush):
    """Also those between two words outside the head, known to workers or not."""
    monkeypatch.setattr(lm, "FLUSH", flush)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{'ab'[(i + j) % 2]}{int(rng.zipf(1.3)) % 40}" for j in range(30))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None)], "doc_id bigint, text string")
    m = lm.fit(spark, docs, size=lm.Size(head=5, known=12, classes=3, rounds=2))
    table = dict(m.known) | {bytes(r.word): (r.c, r["class"]) for r in m.vocabulary.collect()}
    want = np.zeros((3, 3))
    for _, text in [*rows, (100, "")]:
        path = [table[w][1] for w in [lm.END, *text.encode().split(), lm.END]]
        np.add.at(want, (path[:-1], path[1:]), 1)
    assert len(table) > 20 and np.allclose(m.step, lm.transitions(want))


def test_unknown_words_take_the_likeliest_class(spark):
    docs = spark.createDataFrame([(i, "a b c a b d e f g h i j") for i in range(5)], "doc_id bigint, text string")
    m = lm.fit(spark, docs, size=lm.Size(head=4, known=6, classes=3, rounds=2))
    table = dict(m.known) | {bytes(r.word): (r.c, r["class"]) for r in m.vocabulary.collect()}
    got = {r.doc_id: r for r in lm.score(spark, spark.createDataFrame([(1, "a new b"), (2, "new a new"), (3, "new")], "doc_id bigint, text string"), m).collect()}
    for i, text in ((1, "a new b"), (2, "new a new"), (3, "new")):
        words = [*text.encode().split(), lm.END]
        best = -np.inf
        for d in range(3):  # one class for all places of the word
            path = [table[lm.END][1], *(table[w][1] if w in table else d for w in words)]
            p = sum(m.step[x, y] for x, y in zip(path, path[1:], strict=False))
            best = max(best, p + sum(np.log10(table.get(w, (0, 0))[0] + 0.5) - m.total[c] for w, c in zip(words, path[1:], strict=True)))
        assert got[i].score == pytest.approx(best) and got[i].n_known == sum(w in table for w in words)


@pytest.mark.parametrize("most", [0, 20, 1000])
def test_words_are_numbered_as_python_cuts_them(most):
    rng = np.random.default_rng(6)
    parts = [b"a", b"B", b"Ab", b"\xc3\x89", b"\xc2\xa0", b"\x85", b"\xff\xfe", b"\x1c", b"\0", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"]
    texts = [None, b"", b" \n", *(b"".join(parts[i] for i in rng.integers(0, len(parts), 12)) for _ in range(200))]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 9], pa.binary())], ["text"]) for i in range(0, len(texts), 9)]
    got = []
    for words, t, lengths in lm.in_numbers([batches[0].slice(0, 0), *batches], most=most):
        words = words.to_pylist()
        assert words[t[0]] == lm.END and len(set(words)) == len(words) and len(t) == 1 + lengths.sum()
        at = 1 + np.cumsum(lengths) - lengths
        got += [[words[x] for x in t[i : i + n]] for i, n in zip(at, lengths, strict=True)]
    lower = bytes(range(256)).lower()
    assert got == [[*(x or b"").translate(lower).split(), lm.END] for x in texts]
    assert list(lm.in_numbers([])) == []


def test_count_limit(spark):
    counts = spark.createDataFrame([(int(c),) for c in [1] * 50 + [2] * 20 + [7] * 5 + list(range(40, 2000, 7))], "c bigint")
    of = Counter(r.c for r in counts.collect())
    for most in (0, 3, 100, 285, 305, 10_000):
        limit = lm.count_limit(counts, most)
        above = sum(n for c, n in of.items() if c >= limit)
        assert above <= most and (above >= 0.8 * min(most, sum(of.values())) or most < 20)
    assert lm.count_limit(counts.limit(0), 5) == 1


def test_every_word_goes_where_it_raises_the_likelihood_most():
    rng = np.random.default_rng(5)
    m = rng.integers(20, 500, (4, 4)).astype(float)
    words, slots, n = np.array([0, 0, 0, 1, 2, 2]), np.array([0, 3, 5, 7, 2, 4]), np.array([3, 1, 20, 2, 1, 11.0])
    f = lambda x: np.sum(x * np.log(x))

    def likelihood(w, d):
        x, little = m.copy(), 1e-4
        for s, k in zip(slots[words == w], n[words == w], strict=True):
            x[(s, d) if s < 4 else (d, s - 4)] += k * little
        # margins of the classes a word can go to; those of its neighbours don't depend on its class
        return f(x[:, :3]) + f(x[:3, :]) - f(x[:3, :3]) - f(x[:, :3].sum(0)) - f(x[:3, :].sum(1))

    assert lm.best_classes(words, slots, n, m).tolist() == [int(np.argmax([likelihood(w, d) for d in range(3)])) for w in range(3)]


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 40, 4000)
    b = (a // 10 * 10 + rng.integers(0, 10, 4000) + 10 * (rng.random(4000) < 0.2)) % 40
    u, n = np.unique(a * 40 + b, return_counts=True)

    def likelihood(of):
        m = np.zeros((4, 4))
        np.add.at(m, (of[u // 40], of[u % 40]), n)
        f = lambda x: np.sum(x * np.log(np.maximum(x, 1)))
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    def run(rounds):
        return lm.exchange(u // 40, u % 40, n.astype(float), 40, 4, rounds)

    assert likelihood(run(8)) > likelihood(run(1)) > likelihood(np.arange(40) % 4)
    assert likelihood(run(8)) >= likelihood(np.arange(40) // 10) - 1e-6  # the classes that the counts were drawn from


# URLs

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for what, rule in RULES:
        on, below = rule.split("/", 1)
        if (host == on or host.endswith("." + on)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best


def test_rules(spark):
    cases = [None, "", "no scheme", "http://a.NET/x", "http://example.net/en/1", "https://m.example.net/de/", "http://xexample.net/en/", "http://example.com/de/?q=/de/", "http://example.com?x=/de/", "http://net", "http://net/", "http://a.org/fr/1#x", "http://a.org/FR/", "ftp://u@h.net:80/", "http://É.Org/fr/", "a://b://c.net/x", "http://a.net\n/x"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*cases, *cases])], "page_id bigint, url string, host string, tokens string")
    labels = spark.createDataFrame([], "item bigint, unwanted boolean")
    got = {r.page_id: r for r in urls.filter_urls(spark, pages, labels, RULES).collect()}
    for i, u in enumerate([*cases, *cases]):
        host, path, best = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[1], best[0] if best else "allow")
    assert urls.filter_urls(spark, pages.limit(0), labels, RULES).collect() == []


def test_mined_rules(spark):
    rows = []
    for i in range(300):
        host, bad = (("spam.biz", True) if i % 3 == 0 else ("fine.info", False))
        rows.append((i, f"http://www.{host}/{'ads' if i % 2 else 'news'}/{i}"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    # only spam.biz with ads is unwanted
    labels = spark.createDataFrame([(i, i % 3 == 0 and i % 2 == 1) for i in range(200)] + [(5, None), (201, None)], "item bigint, unwanted boolean")
    out = {r.page_id: r.verdict for r in urls.filter_urls(spark, pages, labels, RULES, min_support=0.02, min_pages=1, min_confidence=0.9).collect()}
    assert all((v == "block") == (i % 3 == 0 and i % 2 == 1) for i, v in out.items())


def test_rules_of_deep_segments_and_many_tokens(spark):
    """What tells pages apart is in the third segment or later, or in four tokens together."""
    rows, bad = [], {}
    for i in range(320):
        deep = "casino" if i % 4 == 0 else "garden"
        rows.append((i, f"http://a.info/x/y{i % 3}/{deep}/p{i}/" + "/".join(f"s{i}x{j}" for j in range(25))))
        bad[i] = i % 4 == 0
    for i in range(320, 640):
        rows.append((i, "http://b.info/q?" + "&".join(k for j, k in enumerate("klmn") if i >> j & 1)))
        bad[i] = i % 16 == 15
    rows.append((700, "http://c.info/1/2/3/4/5/casino"))
    bad[700] = True
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, b) for i, b in bad.items() if i < 300 or 320 <= i < 600], "item bigint, unwanted boolean")
    out = {r.page_id: r.verdict for r in urls.filter_urls(spark, pages, labels, [], min_support=0.002, min_pages=1, min_confidence=0.9).collect()}
    assert {i for i, v in out.items() if v == "block"} == {i for i, b in bad.items() if b}


def test_matching_is_that_of_subsets(spark):
    rules = [("a", "b"), ("c",), ("a", "d", "e")]
    sets = [["a", "b"], ["a"], ["c", "x"], ["a", "d"], ["e", "d", "a"], [], ["b", "d"], ["a", "alias"], ["alias"]]
    index = Scratch(spark, "t").save(spark.createDataFrame([(t, i, t, len(r)) for i, r in enumerate(rules) for t in r] + [("alias", 0, "b", 2)], "token string, rule bigint, item string, items int"))
    df = spark.createDataFrame(list(enumerate(sets)), "key bigint, tokens array<string>")
    want = {i for i, s in enumerate(sets) if any(set(r) <= {"b" if x == "alias" else x for x in s} for r in rules)}
    assert {r.key for r in urls.fired(df, index).collect()} == want


def test_rules_against_brute_force(spark):
    """All token sets up to four tokens, tried one by one."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(400):
        keys = [k for k in "abcde" if rng.random() < 0.5]
        host = ["one.com", "two.com", "x.one.com"][int(rng.integers(3))]
        bad = rng.random() < (0.95 if "a" in keys and "b" in keys else 0.9 if host == "two.com" and "c" in keys else 0.15)
        rows.append((i, f"http://{host}/p{int(rng.integers(4))}?" + "&".join(keys)))
        labels.append((i, bool(bad)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    half = spark.createDataFrame(labels[:300], "item bigint, unwanted boolean")
    url = F.col("url")
    sets = {r.page_id: frozenset(r.t) for r in pages.select("page_id", urls.tokens_of(url, urls.host_of(url), urls.path_of(url)).alias("t")).collect()}
    tokens = sorted(set().union(*sets.values()))
    rules = []
    for size in (1, 2, 3, 4):
        for some in map(frozenset, combinations(tokens, size)):
            on = [b for i, b in labels[:300] if some <= sets[i]]
            if sum(on) >= 20 and sum(on) >= 0.8 * len(on):
                rules.append(some)
    want = {i for i in sets if any(r <= sets[i] for r in rules)}
    got = {r.page_id for r in urls.filter_urls(spark, pages, half, []).collect() if r.verdict == "block"}
    assert rules and got == want


def test_few_labelled_pages_teach_nothing_and_long_baskets_end(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/{'ads' if i < 19 else 'x'}") for i in range(60)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i < 19) for i in range(60)], "item bigint, unwanted boolean")
    assert {r.verdict for r in urls.filter_urls(spark, pages, labels, []).collect()} == {"allow"}
    # forty query keys on every page, none of them telling
    rng = np.random.default_rng(2)
    rows = [(i, "http://a.com/?" + "&".join(f"k{j}" for j in range(40) if rng.random() < 0.9) + ("&bad" if i % 5 == 0 else "")) for i in range(400)]
    out = urls.filter_urls(spark, spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame([(i, i % 5 == 0) for i in range(400)], "item bigint, unwanted boolean"), [])
    assert {r.page_id for r in out.collect() if r.verdict == "block"} == {i for i in range(400) if i % 5 == 0}


def minimal_rules(has, bad, least, confidence):
    found = []
    for n in range(1, has.shape[1] + 1):
        for some in map(frozenset, combinations(range(has.shape[1]), n)):
            if not any(r <= some for r in found):
                on = has[:, list(some)].all(1)
                if (on & bad).sum() >= least and (on & bad).sum() >= confidence * on.sum():
                    found.append(some)
    return set(found)


@pytest.mark.parametrize("seed", range(12))
def test_branch_and_bound_finds_all_minimal_rules(seed):
    rng = np.random.default_rng(seed)
    has = rng.random((int(rng.integers(60, 160)), 8)) < rng.uniform(0.4, 0.95)
    bad = rng.random(len(has)) < rng.uniform(0.2, 0.6)
    bad |= has[:, 0] & has[:, 1] & (rng.random(len(has)) < 0.7)
    got = [frozenset(s) for s in urls.branch_and_bound(has, bad.astype(np.int64), (~bad).astype(np.int64), 5, 0.8)]
    got = {s for s in got if not any(r < s for r in got)}
    assert got == minimal_rules(has, bad, 5, 0.8)


@pytest.mark.parametrize("cells", [1 << 22, 400])
def test_rules_of_long_baskets_below_the_raised_support(spark, monkeypatch, cells):
    monkeypatch.setattr(urls, "MAX_CELLS", cells)
    rng = np.random.default_rng(4)
    # 18 keys on most pages, so that FP-growth's support is raised; two rarer ones tell on 24 unwanted pages, together only
    keys = [{f"k{j}" for j in range(18) if rng.random() < 0.93} | {x for x, on in (("a", i < 24 or 100 <= i < 160), ("b", i < 24 or 160 <= i < 220)) if on} for i in range(400)]
    bad = [i < 24 or i % 7 == 0 for i in range(400)]
    pages = spark.createDataFrame([(i, "http://h.com/?" + "&".join(sorted(k))) for i, k in enumerate(keys)], "page_id bigint, url string")
    labels = spark.createDataFrame(list(enumerate(bad)), "item bigint, unwanted boolean")
    out = urls.filter_urls(spark, pages, labels, [], min_confidence=0.9)
    assert {r.page_id for r in out.collect() if r.verdict == "block"} == {i for i, k in enumerate(keys) if {"a", "b"} <= k}


# embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vecs = []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            vecs.append((base + 0.05 * rng.standard_normal(16)).tolist())
    vecs += [vecs[0], vecs[0], [0.0] * 16, None, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [-0.0, 1.0] + [0.0] * 14, [0.0, 1.0] + [0.0] * 14, []]
    # one crowd larger than any window
    crowd = rng.standard_normal(16)
    vecs += [(crowd + 0.02 * rng.standard_normal(16)).tolist() for _ in range(90)]
    rows = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, 1, 5) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, class bigint").repartition(4)
    good = {i: np.array(v, dtype=float) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    links = defaultdict(set)
    for i, x in good.items():
        for j, y in good.items():
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[i].add(j)
    root = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in root}
        if new == root:
            break
        root = new
    got = embedding.near_duplicates(spark, df, passes=12, window=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, len(links[i]), root[i], root[i] == i) for i in sorted(root)]


def test_embeddings_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None)], "vec_id bigint, embedding array<float>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(spark, df, passes=2).collect())
    assert got == Counter([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)])
    assert embedding.near_duplicates(spark, df.limit(0), passes=1).collect() == []
