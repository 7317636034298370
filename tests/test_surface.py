from pyspark.sql import functions as F

from sparloom.functions import text as T
from sparloom.plans.surface import register


def test_sql_functions(spark):
    assert "aux_json_parse" in register(spark)
    one = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert one("SELECT aux_norm_name(' iVAN '), aux_int_to_bin(5, 4), aux_int_to_bin(-5, 4), aux_xml_escape('<&'), aux_obfuscate('AB')") == [("Ivan", "0101", "00-5", "&lt;&amp;", "65,66,")]
    assert one(r"SELECT aux_ci_replace('xAB.y', 'ab.', '$1\\')") == [("x$1\\y",)]
    assert one("SELECT idx, part FROM VALUES ('a, b,') v(s), LATERAL aux_split_text(s, ',', 1)") == [(1, "a"), (2, "b")]
    assert one("SELECT idx, part FROM aux_split_text('', ',', 1)") == [(1, "")]
    assert one("SELECT name, val FROM VALUES ('{\"k\": 1}') v(s), LATERAL aux_json_parse(s) WHERE level = 1") == [("k", "1")]
    assert one("SELECT val FROM aux_json_get_node('{\"i\": [{\"t\": \"A\", \"v\": \"x\"}]}', 't', 'A', 'v')") == [("x",)]
    assert one("SELECT val_int FROM aux_json_get_value('{\"k\": 12 }', 'k')") == [(12,)]
    assert one("SELECT path, name FROM aux_xml_all_nodes('<a><b/></a>')") == [("/", "a"), ("/a", "b")]
    assert one("SELECT val FROM aux_xml_get_value('<a>x</a>', 'a')") == [("x",)]


def test_inflection_by_an_engine(spark):
    def engine(name, case, sex):
        return (0, f"{name}/{case}/{sex}") if name != "bad" else (-3, "")

    df = spark.createDataFrame([("Ann", 2), ("Bob", 1), ("x", None), ("bad", 1), (None, 1)], "n string, s int")
    got = [r[0] for r in df.select(T.inflect_name("n", 4, F.col("s"), engine)).collect()]
    assert got == ["Ann/4/0", "Bob/4/1", "x/4/None", "-3 (4)", None]
