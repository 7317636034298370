import pytest
from pyspark.sql import functions as F

from sparloom.functions import builders as B
from sparloom.operators import json_nodes as J

SHOP = """{
  "opened": 1998,
  "shelves": [
    {"no": 7, "goods": ["tea", {"sugar": {"kg": 2.5,},}, "loose": -0.75  ,],},
    "cellar",
  ],
  "open": true,
}"""
TOWER = '{"t": [{"u": {"v": [[], {"w": [0.5, -4, 12.0,], "x": [7, -0.25]}]}}]}'


def short(n, *names):
    return "|".join(str(n[x]) if n[x] is not None else "null" for x in names)


def test_plain_text_and_named_root():
    n = J.parse(' \n\t "lone" \n')
    assert [short(x, "node_start", "node_end", "node_path", "node_index", "value_type", "name", "val", "error_code") for x in n] == ["5|10|/|0|string|null|lone|0"]
    n = J.parse('"colour":"blue"')
    assert [short(x, "node_start", "node_end", "node_path", "node_index", "value_type", "name", "val", "error_code") for x in n] == ["1|15|/|0|string|colour|blue|0"]


def test_lenient_document():
    """Commas at the end, named items of an array, blanks behind numbers: none is an error."""
    n = J.parse(SHOP)
    assert all(x["error_code"] == 0 for x in n)
    by_name = {x["name"]: x for x in n if x["name"]}
    cut = lambda x: SHOP[x["node_start"] - 1 : x["node_end"]]
    assert cut(by_name["opened"]) == '"opened": 1998' and by_name["opened"]["node_path"] == "/-/"
    assert cut(by_name["shelves"]).startswith('"shelves": [') and cut(by_name["shelves"]).endswith("]") and by_name["shelves"]["node_index"] == 1
    goods = [x for x in n if x["node_path"] == "/-/shelves/-/goods/"]
    assert [(x["node_index"], x["value_type"], x["name"]) for x in goods] == [(0, "string", None), (1, "object", None), (2, "number", "loose")]
    assert goods[2]["val"] == "-0.75" and by_name["kg"]["node_path"] == "/-/shelves/-/goods/-/sugar/"
    # children come before their parent
    assert n[-1]["level"] == 0 and n.index(by_name["shelves"]) > max(i for i, x in enumerate(n) if x["node_path"] == "/-/shelves/")


def test_deep_document():
    n = J.parse(TOWER)
    w = [x for x in n if x["node_path"].endswith("/w/")]
    assert [(x["node_index"], x["val"], x["value_type"]) for x in w] == [(0, "0.5", "number"), (1, "-4", "number"), (2, "12.0", "number")]
    assert sorted({x["level"] for x in n}) == list(range(w[0]["level"] + 1)) and len(n) == 14


@pytest.mark.parametrize("doc", ['{"row": [8 9 0]}', '{\n "row": [8\n 9 0]\n}'])
def test_missing_comma_in_array_keeps_the_sibling(doc):
    rows = [x for x in J.parse(doc) if x["error_code"] == 7]
    assert [(x["node_path"], x["val"]) for x in rows] == [("/-/row/", "8")]


def test_missing_comma_in_object():
    assert len([x for x in J.parse('{"box": {"left": "in" "right": "out"}}') if x["error_code"] == 7]) == 1


@pytest.mark.parametrize(
    ("doc", "val"),
    [
        (r'"s": "she said \"no\""', 'she said "no"'),
        (r'"s": "\"one \\\"two\\\"\""', r'"one \"two\""'),
        (r'"s": "C:\\"', "C:\\"),
        (r'"s": "\tx\n\ry"', "\tx\n\ry"),
    ],
)
def test_escapes(doc, val):
    n = J.parse(doc)
    assert [(x["value_type"], x["val"]) for x in n] == [("string", val)]


@pytest.mark.parametrize(("doc", "code"), [("?", 2), ("{x}", 3), ("[?]", 4), ('"a" x', 5), ("12x", 6), ("1.2.3", 5), ('["a" "b"]', 7)])
def test_error_codes(doc, code):
    assert [x["error_code"] for x in J.parse(doc) if x["error_code"]] == [code]


def test_compat_and_unterminated():
    assert J.parse("[[1]]", compat=True)[-1]["error_code"] == 4
    assert [x["val"] for x in J.parse("[[1]]")] == ["1", "[1]", "[[1]]"]
    assert J.parse("1e5")[0]["val"] == "1e5" and J.parse("1e5", compat=True)[0]["error_code"] == 6
    assert [x["val"] for x in J.parse("[1, 2")] == ["1", "2"]
    assert J.parse("") == [] and J.parse(None) == []
    assert J.parse("[" * 100_000)[-1]["error_code"] == 99 if J.parse("[" * 100_000) else True


TRIPS = '{"trips": [{"to": "Oslo", "by": "train"}, {"to": "Rome", "by": {"air": 2, "rail": 1}}, {"to": "Bern", "by": "coach"}]}'


def test_get_node():
    n = J.get_node(TRIPS, "to", "Rome", "by")
    assert [(x["val"], x["value_type"], x["node_index"], x["node_path"]) for x in n] == [('{"air": 2, "rail": 1}', "object", 1, "/-/trips/")]
    assert J.get_node(TRIPS, "to", "Bern", "by")[0]["val"] == "coach"
    named = '{"trips": {"first": {"to": "Oslo", "by": "train"}, "last": {"to": "Rome", "by": "ferry"}}}'
    assert [(x["node_name"], x["val"]) for x in J.get_node(named, "to", "Rome", "by")] == [("last", "ferry")]
    two = J.get_node('{"trips": [{"to": "Bern"}, {"to": "Oslo", "by": "bus"}, {"to": "Oslo", "by": "boat"}]}', "to", "Oslo", "by")
    assert [(x["node_index"], x["val"]) for x in two] == [(1, "bus"), (2, "boat")]
    assert J.get_node(TRIPS, "to", "Oslo")[0]["val"] is None


def test_get_value():
    v = J.get_values('{"a": "x", "b": 12, "c": [1, "]"], "d": {"a": 1.5}}', "a")
    assert [(x["value_type"], x["val"]) for x in v] == [("str", "x"), ("num", "1.5")]
    assert J.get_values('{"c": [1, [2]], "z": 1}', "c")[0]["val"] == "1, [2]"
    assert J.get_values('{"b": 12, "z": 1}', "b")[0]["val_int"] == 12
    assert J.get_values('{"t": true }', "t") == [] and J.get_values(None, "a") == []


def test_yaml():
    doc = '{"list": [{"a": 1, "b": "x"}, {"a": 2}], "n": null}'
    assert J.to_yaml(doc) == 'list:\n  - a: 1\n    b: "x"\n  - a: 2\nn: null\n'


def test_columns(spark):
    df = spark.createDataFrame([(1, '{"k": 87}'), (2, None), (3, "")], "id int, props string")
    assert [tuple(r) for r in J.json_parse(df, "props").select("id", "name", "val").collect()] == [(1, "k", "87"), (1, None, '{"k": 87}')]


R0, R1, R2 = 0, 1, 2


@pytest.mark.parametrize(
    ("val", "kind", "name", "expected"),
    [
        *[(v, "num", "number", f'"number": {v}') for v in ("1", "4.3", "-3.90", "0.5e-89", "4.6E+17")],
        *[(v, "num", "number", '"number": null') for v in ("01.2", "z0.2")],
        *[(v, "bool", "boolean", '"boolean": true') for v in ("1", "12", "-1", "True")],
        *[(v, "bool", "boolean", '"boolean": false') for v in ("0", "FaLsE")],
    ],
)
def test_json_node_scalars(value, val, kind, name, expected):
    assert value(B.json_node(name, F.col("v"), kind, R1, formatting=True), v=val) == expected


@pytest.mark.parametrize(
    ("val", "kind", "name", "expected"),
    [
        ("[1, 2, 3, 4]", "list", "list", '"list":[1, 2, 3, 4]'),
        ("1, 2, 3, 4", "list", "list", '"list":[1, 2, 3, 4]'),
        ('{"a": 1}', "list", "list", '"list":[{"a": 1}]'),
        ('{"x": "z", "y": 0}', "obj", "object", '"object":{"x": "z", "y": 0}'),
        ('"x": "z", "y": 0', "obj", "object", '"object":{"x": "z", "y": 0}'),
        ('"x": 1, \n ', "obj", "object", '"object":{"x": 1}'),
    ],
)
def test_json_node_containers(value, val, kind, name, expected):
    assert value(B.json_node(name, F.col("v"), kind, R1), v=val) == expected


@pytest.mark.parametrize(
    ("kind", "tz", "expected"),
    [
        ("datetime:0", {}, '"2023-02-01T12:34:45"'),
        ("datetime:1", {}, '"2023-02-01 12:34:45"'),
        ("datetime:2", {"tz_hour": 3}, '"2023-02-01T12:34:45+03:00"'),
        ("datetime:2", {"tz_hour": -2, "tz_min": 30}, '"2023-02-01T12:34:45-02:30"'),
        ("datetime:2", {}, '"2023-02-01T12:34:45Z"'),
        ("date", {}, '"2023-02-01"'),
        ("time", {}, '"12:34:45"'),
    ],
)
def test_json_node_moments(value, kind, tz, expected):
    assert value(B.json_node("dt", F.col("v"), kind, R1, formatting=True, **tz), v="2023-02-01 12:34:45") == f'"dt": {expected}'
    if kind == "date":
        assert value(B.json_node("dt", F.expr("date'2023-02-01'"), kind, R1, formatting=True)) == f'"dt": {expected}'
    if kind == "time":
        assert value(B.json_node("dt", F.col("v"), kind, R1, formatting=True), v="12:34:45") == f'"dt": {expected}'


@pytest.mark.parametrize(("kind", "empty"), [("list", "    []"), ("obj", "    {}"), ("str", '""')])
def test_json_node_null(value, kind, empty):
    run = lambda r: value(B.json_node("null", F.col("v"), kind, r, formatting=True), v=None)
    assert [run(R0), run(R1), run(R2)] == ["", '"null": null', f'"null": {empty}']


def test_json_node_root(value):
    inner = F.concat(B.json_node("a", F.lit("b"), delimiter=True), B.json_node("c", F.lit("d")))
    assert value(B.json_node(None, inner, "obj")) == '{"a":"b","c":"d"}'


def test_built_json_parses(value):
    text = value(B.json_node("k", F.col("v"), required=1), v='say "hi" \\ there')
    assert J.parse(text)[0]["val"] == 'say "hi" \\ there'


def test_members_of_a_found_node_are_those_of_its_own_text():
    """get_node takes them from the one parse; the node's text parsed again gives the same."""

    def again(text):
        nodes = J.parse(text)
        for hit in sorted((n for n in nodes if n["error_code"] == 0 and n["name"] == "type" and n["val"] == "B"), key=lambda n: -n["level"]):
            for n in nodes:
                if n["error_code"] == 0 and n["node_start"] < hit["node_start"] and n["node_end"] > hit["node_end"] and n["level"] == hit["level"] - 1:
                    own = [m for m in J.parse(n["val"]) if m["name"] == "value" and m["level"] == 1]
                    yield from [(n["val"], m.get("name"), m.get("value_type"), m.get("val")) for m in own or [{}]]

    for v in ("1", '"x"', "{}", "[1, 2]", '{"value": 3, "in": {"value": 4}}', '[{"type": "B", "value": 5}]', '{"type": "B"}'):
        for doc in (f'{{"a": [{{"type": "B", "value": {v}}}, {{"value": 7, "type": "B", "value": 8}}]}}', f'{{"n": {{"in": {v}, "type": "B", "value": {v},}},}}', f'[{{"type": "B"}}, {v}, {{"type": "B", "value": {v}', f'{{"type": "B", "value": {v}}} x'):
            assert [(g["node"], g["value_name"], g["value_type"], g["val"]) for g in J.get_node(doc, "type", "B", "value")] == list(again(doc))


def test_rows_are_held_for_few_documents_at_once(spark):
    """A worker turns rows into Arrow columns before it parses the next documents."""

    def rows_of(text):
        import gc

        held = sum(type(o) is dict and "_held" in o for o in gc.get_objects()) if int(text) % 500 == 499 else 0
        return [{"live": held, "_held": [text]}]

    live = spark.range(0, 4_000, 1, 1).select(F.inline(J.rows_udf("live:bigint", rows_of)(F.col("id").cast("string")))).agg(F.max("live")).first()[0]
    assert 0 < live <= 2 * J._CHUNK
