"""The registered queries and the pipeline on the smallest driver tables."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sparloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [got.columns.index(c) for c in want.columns]
    assert Counter(tuple(r[i] for i in order) for r in got.collect()) == Counter(want.fetchall())


def test_contract_columns(spark):
    want = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
        "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op8_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    }
    rows = {n: queries.QUERIES[n](spark, SF) for n in want}
    for n, columns in want.items():
        assert rows[n].columns == columns
    assert len(rows["op8_lm_scoring"].collect()) == 200
    assert all(len(r.fingerprint) == 16 for r in rows["op5_simhash_near_dedup"].collect())
    assert all(r.taken <= 2 * r.size for r in rows["op7_mixing"].collect())


def test_embedding_query_against_all_pairs(spark, tmp_path):
    """The driver's vectors have no pair at the threshold, so lone pairs, a crowd and a dense region of
    vectors just below it are planted beside them."""
    rng = np.random.default_rng(6)
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()], dtype=float)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)

    def near(v, cosine):
        r = rng.standard_normal(v.shape)
        r -= (r * v).sum(-1, keepdims=True) * v
        return cosine * v + np.sqrt(1 - cosine**2) * unit(r)

    x = unit(x)
    centre = unit(rng.standard_normal(x.shape[1]))
    x = np.concatenate([x, near(x[:150], 0.951), near(np.tile(x[200], (60, 1)), 0.98), near(np.tile(centre, (300, 1)), 0.96)]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = unit(x.astype(float))
    hit = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in queries.QUERIES["op9_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    assert hit.sum() > 300 and sum(r.n_links for r in got.values()) >= 0.9 * hit.sum()
    assert all(got[i].n_links <= hit[i].sum() for i in got)
    pairs = np.argwhere(hit)
    assert np.mean([got[i].component_id == got[j].component_id for i, j in pairs]) >= 0.9
    # nothing is tied together that links do not reach
    root = list(range(len(x)))
    for i, j in pairs:
        while root[i] != root[root[i]] or root[j] != root[root[j]]:
            root[i], root[j] = root[root[i]], root[root[j]]
        root[max(root[i], root[j])] = min(root[i], root[j])
    find = lambda i: i if root[i] == i else find(root[i])
    assert all(find(r.component_id) == find(i) and r.component_id >= find(i) for i, r in got.items())


def test_near_copies_of_a_driver_table_against_all_pairs(spark):
    """Which documents stay, by comparing the shingle sets of all documents of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = [frozenset(simhash.shingle_hashes(simhash.words_of(t.encode()), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for h in s:
            by_shingle.setdefault(h, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for h in s for j in by_shingle[h] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        if not s:  # texts without words are copies of each other
            j = next(k for k, other in enumerate(sets) if not other)
            root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id for r in simhash.drop_similar(spark, docs).collect()}
    assert got == {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_pipeline_of_empty_and_odd_tables(spark, odd, tmp_path):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    some = odd.select(*columns)
    for name, docs in (("empty", some.limit(0)), ("odd", some)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(out) == 0) == (name == "empty")
        assert all(0 < r.length <= 2048 for r in out)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        n.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "line_dedup":
            assert n[-1] == n[-2]
        if name == "simhash_near_dedup":
            # no two of the texts that stay are similar, by brute force over five-word shingles
            sets = [set(simhash.shingle_hashes(simhash.words_of((r.text or "").encode()), 5).tolist()) for r in docs.collect()]
            close = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
            assert close == 0
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    assert n[1] <= n[0] and n[3] < n[2] and n[4] > 0 and n[5] > n[4]
    assert docs.agg({"length": "max"}).first()[0] <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"
    assert len(corpus_pipeline.STAGES) == 5
