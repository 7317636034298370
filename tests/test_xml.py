import pytest
from pyspark.sql import functions as F

from sparloom.functions import builders as B
from sparloom.operators import xml_nodes as X


def test_nodes_and_positions():
    text = ' <a><b x="1">t</b><b/><n:a>u</n:a></a>'
    n = X.nodes(text)
    assert [(x["path"], x["name"], x["level"], x["content"]) for x in n] == [("/", "a", 0, text[4:-4]), ("/a", "b", 1, "t"), ("/a", "b", 1, ""), ("/a", "a", 1, "u")]
    assert all(text[x["startpos"] - 1] == "<" and text[x["endpos"] - 1] == ">" for x in n)
    assert n[1]["attributes"] == 'x="1"' and n[3]["ns_alias"] == "n"


def test_same_name_inside():
    n = X.nodes("<a><a>1</a><a/><a k=\"v\">2</a></a><a>3</a>")
    assert [(x["level"], x["content"]) for x in n] == [(0, '<a>1</a><a/><a k="v">2</a>'), (1, "1"), (1, ""), (1, "2"), (0, "3")]
    with pytest.raises(X.UnclosedNode):
        X.nodes("<a><b></b>")
    assert X.nodes("1 < 2 <? x ?>") == [] and X.nodes(None) == []


def test_values():
    text = '<r><v a="1">x</v><v/><v></v><v i:nil="true"/><w><w>in</w></w></r>'
    v = X.values(text, "v", index=0)
    assert [(x["node_number"], x["val"]) for x in v] == [(1, "x"), (2, ""), (3, ""), (4, "")]
    assert X.values(text, "v", index=2)[0]["val"] == "" and X.values(text, "v", is_node=True, index=2)[0]["val"] is None
    assert X.values(text, "w")[0]["val"] == "<w>in</w>"
    assert X.values('<v xsi:nil="true">x</v>', "v")[0]["val"] is None
    assert X.values("<vv>1</vv>", "v") == []
    codes = [X.values(t, n, required=True)[-1]["error_code"] for t, n in [("<a/>", ""), ("<a/>", "b"), ("<b>1", "b"), ("<b <c>", "b")]]
    assert codes == [1, 2, 3, 4]


def test_typed_values(spark):
    df = spark.createDataFrame([("<n>12</n>",), ("<n>x</n>",), (None,)], "x string")
    rows = X.xml_get_value(df, "x", "n", "int").select("val", "val_int", "error_code").collect()
    assert [tuple(r) for r in rows] == [("12", 12, 0), ("x", None, 1)]


def test_builders(value):
    run = lambda *a, v="x", **k: value(B.xml_node("a", F.col("v"), *a, **k), v=v)
    assert run(v="1<2 & 3>2") == "<a>1&lt;2 &amp; 3&gt;2</a>\n"
    assert run("str:escaped", v="a\r\nb\x1c") == "<a>a&#13;&#10;b</a>\n"
    assert run("node", v="<b/>") == "<a>\n<b/></a>\n"
    assert [run(v=None), run(req=1, v=None), run(req=2, v=None), run(req=2, v="")] == ["", "<a/>\n", '<a xsi:nil="true"/>\n', "<a/>\n"]
    assert run("bool", v="F") == "<a>false</a>\n" and run("bool", v=None) == ""
    assert run("datetime", v="2023-02-01 12:34:45") == "<a>2023-02-01T12:34:45</a>\n"
    assert run("time", v="1:02") == "<a>01:02:00</a>\n" or run("time", v="01:02") == "<a>01:02:00</a>\n"
    assert value(B.xml_attr("n", "v"), v='a"<b>\n') == 'n="a&quot;&lt;b&gt;&#10;" '


def test_escape_and_unescape(value):
    s = "<a b='1' c=\"2\">&x;</a>"
    assert value(B.xml_unescape(B.xml_escape("v")), v=s) == s
    assert value(B.xml_escape("v", compat=True), v="<") == "&amp;lt;"
    assert value(B.xml_unescape("v"), v="a&#x41;b&#xe9;c&#x1;&amp;") == "aAbéc&#x1;&"


def test_attributes(value):
    rows = value(B.xml_attributes("v"), v='a="1" n:b-2 = " x " c=""')
    assert [tuple(r) for r in rows] == [(None, "a", "1", 'a="1"'), ("n", "b", "x", 'n:b="x"'), (None, "c", "", 'c=""')]


def test_built_xml_is_read_back(value):
    text = value(B.xml_node("a", F.col("v")), v="x < y & z")
    assert X.values(text, "a")[0]["val"] == "x &lt; y &amp; z"
