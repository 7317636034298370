import random

import pytest
from pyspark.sql import functions as F

from sparloom.operators import graph as G


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d"), (5, 5, "self"), (6, 5, "e"), (7, None, "f")]
    return spark.createDataFrame(rows, "id int, parent int, name string")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_children(tree):
    assert sorted(rows(G.get_children(tree, "id", "parent", 1), "sort_order", "id", "level")) == [(0, 2, 0), (1, 4, 1), (2, 3, 0)]
    by_name = G.get_children(tree, "id", "parent", 1, base_level=5, sort=[F.desc("name")])
    assert sorted(rows(by_name, "sort_order", "id", "level")) == [(0, 3, 5), (1, 2, 5), (2, 4, 6)]
    assert sorted(rows(G.get_children(tree, "id", "parent", 1, only_leaf=True), "sort_order", "id")) == [(0, 4), (1, 3)]
    assert rows(G.get_children(tree, "id", "parent", None), "id") == []
    assert rows(G.get_children(tree, "id", "parent", 5), "id") == [(6,)]


def test_children_of_a_cycle_end(spark):
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, parent int")
    assert sorted(rows(G.get_children(ring, "id", "parent", 1), "id")) == [(2,), (3,)]


def test_parents(tree):
    assert rows(G.get_parents(tree, "id", "parent", 4, "name"), "level", "id", "info") == [(1, 4, "d"), (2, 2, "b"), (3, 1, "a")]
    assert len(rows(G.get_parents(tree, "id", "parent", 5, depth=7), "id")) == 7
    assert rows(G.get_parents(tree, "id", "parent", 99), "id") == []


def test_hierarchy_is_reversed(tree):
    h = sorted(rows(G.prepare_hierarchy(tree.filter("id <> 5"), "id", "name", "parent"), "order_index", "indented"))
    assert h == [(1, "f"), (2, "e"), (3, "a"), (4, "|_c"), (5, "|_b"), (6, "|  |_d")]


def test_dependencies(spark):
    e = spark.createDataFrame([("A", 5, "B", None, 5), ("B", 5, "C", "x", 0), ("A", 5, "C", "x", 0), ("C", 0, "A", None, 5), ("B", 5, "SKIP", None, 5)], "dependent_name string, dependent_type int, name string, column string, type int")
    s = spark.createDataFrame([("A", None, 5)], "name string, column string, type int")
    assert sorted(rows(G.get_dependencies(e, s, exclude="^SKIP"), "depth", "name")) == [(0, "A"), (1, "B"), (1, "C")]
    assert sorted(rows(G.get_dependencies(e, s, exclude_types=[0]), "depth", "name")) == [(0, "A"), (1, "B"), (2, "SKIP")]
    assert sorted(rows(G.nested_dependencies(e, s), "type", "names", "n")) == [(0, "C", 1), (5, "B,SKIP", 2)]


def test_order_with_a_cycle(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("D", "A"), ("E", "A"), ("F", "F"), ("G", "F")], "name string, required string")
    n = spark.createDataFrame([(x,) for x in "ABCDEFGH"], "name string")
    got = {r["name"]: (r["order_index"], r["loop_type"]) for r in G.get_order(e, n).collect()}
    assert [got[x][0] for x in "FHG"] == [1, 2, 3] or got["G"][0] > got["F"][0]
    assert [got[x][1] for x in "ABCDEFGH"] == [2, 2, 2, 2, 0, 1, 0, 0]
    assert min(got[x][0] for x in "ABCDE") > got["G"][0]


def test_cycles_against_brute_force(spark):
    """Random graphs: a node is on a cycle if it reaches itself; order never breaks a requirement."""
    rng = random.Random(3)
    for n, m in ((8, 9), (14, 22)):
        names = [f"n{i:02}" for i in range(n)]
        pairs = {(rng.choice(names), rng.choice(names)) for _ in range(m)}
        got = {r["name"]: r for r in G.get_order(spark.createDataFrame(sorted(pairs), "name string, required string"), spark.createDataFrame([(x,) for x in names], "name string")).collect()}
        reach = {x: {b for a, b in pairs if a == x and b != x} for x in names}
        for _ in names:
            reach = {x: reach[x].union(*(reach[y] for y in reach[x])) for x in names}
        assert {x: r["loop_type"] for x, r in got.items()} == {x: ((x, x) in pairs) + 2 * (x in reach[x]) for x in names}
        ends = {x for x in names if x not in reach[x] and not any(y in reach[y] for y in reach[x])}
        assert all(got[b]["order_index"] < got[a]["order_index"] for a, b in pairs if a in ends and a != b)


def test_drop_statements(spark):
    e = spark.createDataFrame([("B", "A"), ("C", "B"), ("X", "Y")], "name string, required string")
    n = spark.createDataFrame([(x,) for x in "ABCXY"], "name string")
    assert [r[1] for r in sorted(rows(G.drop_statements(e, n, "A"), "step", "stmt"))] == ["drop procedure C;", "drop procedure B;", "drop procedure A;"]


def test_call_stack(spark):
    f = spark.createDataFrame([(1, None, 7, "A", 3, 4), (2, 1, 7, "B", 5, None)], "call_id int, caller_id int, statement_id int, object_name string, source_line int, source_column int")
    assert rows(G.call_stack_text(f), "call_stack") == [("2:B[5:]<1\n1:A[3:4]<",)]


def test_order_sends_no_table_through_the_driver(spark, monkeypatch):
    """No step of the order joins by a broadcast, but for the table of partitions that numbers the rows."""
    plans, keep = [], G._keep
    monkeypatch.setattr(G, "_keep", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "e")], "name string, required string")
    got = G.get_order(edges, edges.select("name"))
    assert {r["name"]: r["loop_type"] for r in got.collect()} == {"a": 2, "b": 2, "c": 0, "d": 1, "e": 0, "f": 0}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)
