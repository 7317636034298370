"""Queries over the driver's tables, each with the same result as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.functions import builders as B
from sparloom.functions import text as T
from sparloom.functions import typed as TY
from sparloom.operators import catalog as M
from sparloom.operators import cdc as C
from sparloom.operators import graph as G
from sparloom.operators import json_nodes as J
from sparloom.operators import relational as R
from sparloom.operators import xml_nodes as X

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """sf_dir's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Splitting and stripping


@query("SELECT p_partkey AS k, CAST(i AS BIGINT) AS idx, trim(l[i], ' ') AS part FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def split_text(t):
    return T.explode_parts(t.part.select(F.col("p_partkey").alias("k"), "p_name"), T.split_text("p_name", " ")).select("k", "idx", "part")


@query("SELECT doc_id AS k, CAST(i AS BIGINT) AS idx, trim(l[i], ' ') AS part FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def split_text_multi(t):
    return T.explode_parts(t.documents.select(F.col("doc_id").alias("k"), "text"), T.split_text("text", ". ")).select("k", "idx", "part")


@query("SELECT o_orderkey AS k, CAST(i AS BIGINT) AS idx, l[i] AS part FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS l FROM orders), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def split_text_untrimmed(t):
    return T.explode_parts(t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority"), T.split_text("o_orderpriority", "-", trim_part=False)).select("k", "idx", "part")


def _stripped(df: DataFrame, key: str, column: str, *how) -> DataFrame:
    return df.select(F.col(key).alias("k"), T.strip_text(column, *how).alias("s")).select("k", "s.result", "s.affected")


@query("SELECT c_custkey AS k, regexp_replace(c_name, '[0-9]', '', 'g') AS result, CAST(length(c_name) - length(regexp_replace(c_name, '[0-9]', '', 'g')) AS BIGINT) AS affected FROM customer")
def strip_remove(t):
    return _stripped(t.customer, "c_custkey", "c_name", "0123456789", T.DROP)


@query("SELECT o_orderkey AS k, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS result, CAST(length(regexp_replace(o_orderpriority, '[A-Z]', '', 'g')) AS BIGINT) AS affected FROM orders")
def strip_keep(t):
    return _stripped(t.orders, "o_orderkey", "o_orderpriority", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", T.KEEP)


@query("""WITH c AS (SELECT doc_id, text, string_split(text, '') AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS c FROM c), q AS (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM p)
SELECT doc_id AS k, string_agg(CASE WHEN c = b AND strpos('aeiouy', c) > 0 THEN '?' ELSE c END, '' ORDER BY i) AS result, CAST(count(*) FILTER (WHERE c = b AND strpos('aeiouy', c) > 0) AS BIGINT) AS affected FROM q GROUP BY doc_id""")
def strip_repeat(t):
    return _stripped(t.documents, "doc_id", "text", "aeiouy", T.SQUEEZE, "?")


# Scalars


@query("SELECT p_partkey AS k, regexp_replace(p_name, 'widget', 'X', 'gi') AS v FROM part")
def ci_replace(t):
    return t.part.select(F.col("p_partkey").alias("k"), T.ci_replace("p_name", "WidGet", "X").alias("v"))


@query("SELECT c_custkey AS k, upper(left(trim(c_mktsegment, ' '), 1)) || lower(substr(trim(c_mktsegment, ' '), 2)) AS v FROM customer")
def norm_name(t):
    return t.customer.select(F.col("c_custkey").alias("k"), T.norm_name("c_mktsegment").alias("v"))


@query("SELECT doc_id AS k, regexp_matches(lower(text), '(^|[^A-Za-z0-9А-ЯЁа-яё])the([^A-Za-z0-9А-ЯЁа-яё]|$)')::INT AS does_contain FROM documents")
def contains_word(t):
    return t.documents.select(F.col("doc_id").alias("k"), T.contains_word("text", "The", case_sensitive=False)["does_contain"].alias("does_contain"))


@query("SELECT c_custkey AS k, regexp_replace(c_name, '[^A-Z0-9]', '', 'g') AS v FROM customer")
def abbreviate(t):
    """Customer names are a capitalised word and digits, so capitals and digits are all that stays."""
    return t.customer.select(F.col("c_custkey").alias("k"), T.abbreviate("c_name").alias("v"))


@query("SELECT c_custkey AS k, regexp_extract(c_name, '[0-9]+') AS match, CAST(length(regexp_extract(c_name, '^[^0-9]*')) + 1 AS BIGINT) AS startpos FROM customer WHERE regexp_matches(c_name, '[0-9]')")
def regexp_search_first(t):
    return T.explode_parts(t.customer.select(F.col("c_custkey").alias("k"), "c_name"), T.regexp_search("c_name", r"\d+", 1)).select("k", "match", "startpos")


@query("SELECT c_custkey AS k, regexp_extract(substr(c_name, i), '^[0-9]+') AS match, CAST(i AS BIGINT) AS startpos FROM customer, LATERAL (SELECT unnest(range(1, length(c_name) + 1)) AS i) WHERE regexp_matches(substr(c_name, i), '^[0-9]')")
def regexp_search_all(t):
    return T.explode_parts(t.customer.select(F.col("c_custkey").alias("k"), "c_name"), T.regexp_search("c_name", "[0-9]+", only_first=False)).select("k", "match", "startpos")


@query("""WITH p AS (SELECT o_orderkey AS k, o_orderpriority AS a, o_orderstatus || substr(o_orderpriority, 2) AS b FROM orders),
q AS (SELECT k, a, b, coalesce(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1], 0) AS pos FROM p)
SELECT k, substr(a, greatest(1, pos - 32)::BIGINT) AS t1, substr(b, greatest(1, pos - 32)::BIGINT) AS t2, CAST(pos AS BIGINT) AS pos FROM q""")
def first_diff(t):
    other = F.concat("o_orderstatus", F.substr("o_orderpriority", F.lit(2)))
    return t.orders.select(F.col("o_orderkey").alias("k"), T.first_diff("o_orderpriority", other).alias("d")).select("k", "d.*")


@query("SELECT o_orderkey AS k, lpad(bin(o_orderkey)::VARCHAR, (4 * ((length(bin(o_orderkey)) - 1) // 4 + 1))::INT, '0') AS v FROM orders")
def int_to_bin(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), T.int_to_bin("o_orderkey").alias("v"))


@query("SELECT p_partkey AS k, array_to_string([unicode(c) FOR c IN string_split(p_name, '')], ',') || ',' AS v, p_name AS back FROM part")
def obfuscate(t):
    coded = t.part.select(F.col("p_partkey").alias("k"), T.obfuscate("p_name").alias("v"))
    return coded.withColumn("back", T.obfuscate("v", 1))


_POLICY = """WITH n AS (SELECT o_orderkey AS k, lpad(CAST((o_orderkey * 7919 + o_custkey * 104729) AS VARCHAR), 16, '0') AS s FROM orders),
d AS (SELECT k, s, string_split(reverse(left(s, 15)), '') AS l FROM n),
e AS (SELECT k, s, array_to_string(list_filter(l, lambda x, i: i % 2 = 0), '') AS even, array_to_string(list_filter(l, lambda x, i: i % 2 = 1), '') AS odd FROM d),
f AS (SELECT *, even || CAST(CAST(odd AS BIGINT) * 2 AS VARCHAR) AS chk FROM e),
g AS (SELECT *, list_sum([CAST(x AS INT) FOR x IN string_split(chk, '')]) AS total FROM f),
h AS (SELECT *, right(CAST(10 - total % 10 AS VARCHAR), 1) AS digit FROM g)
SELECT k, right(s, 1) = digit AS is_correct, CASE WHEN right(s, 1) = digit THEN 0 ELSE 2 END::BIGINT AS error_code, left(s, 15) || digit AS correct_policy_number, CAST(total AS BIGINT) AS check_value FROM h"""


@query(_POLICY)
def policy_check(t):
    number = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729).cast("string"), 16, "0")
    return t.orders.select(F.col("o_orderkey").alias("k"), T.validate_policy_number(number).alias("p")).select("k", "p.is_correct", "p.error_code", "p.correct_policy_number", "p.check_value")


@query("SELECT event_id AS k, strftime(ts, '%-d.%m.%y %H:%M:%S') AS v, strftime(ts, '%d/%-m/%Y') || ' ' || CAST(hour(ts) AS VARCHAR) || 'h+03:00' AS z FROM events")
def format_date(t):
    return t.events.select(F.col("event_id").alias("k"), TY.format_date("ts", "d.MM.yy hh:mm:ss").alias("v"), F.concat(TY.format_date("ts", "dd/M/yyyy h"), F.lit("h"), TY.format_date("ts", "tz", 3)).alias("z"))


def _typed(column, vtype: str, *fields: str):
    return lambda df, key: df.select(F.col(key).alias("k"), TY.string_to_type(column, vtype).alias("s")).select("k", *[f"s.{f}" for f in fields], "s.error_code")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderkey END AS val_int, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS error_code FROM orders")
def string_to_type_int(t):
    s = F.when(F.startswith("o_orderpriority", F.lit("1")), F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    return _typed(s, "int", "val_int")(t.orders, "o_orderkey").withColumn("error_code", F.col("error_code").cast("int"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS val_double, 0 AS error_code FROM lineitem")
def string_to_type_double(t):
    typed = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), TY.string_to_type(F.col("l_quantity").cast("string"), "double").alias("s"))
    return typed.select("k", "n", "s.val_double", F.col("s.error_code").cast("int").alias("error_code"))


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 0 END::BIGINT AS val_int, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 3 END AS error_code FROM orders")
def string_to_type_bool(t):
    return _typed("o_orderstatus", "bool", "val_int")(t.orders, "o_orderkey").withColumn("error_code", F.col("error_code").cast("int"))


@query("SELECT event_id AS k, date_trunc('second', ts) AS val_datetime, CAST(ts AS DATE) AS val_date, strftime(ts, '%H:%M:%S') AS val_time, 3 AS time_zone, 0 AS error_code FROM events")
def string_to_type_datetime(t):
    s = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    out = _typed(s, "datetime", "val_datetime", "val_date", "val_time", "time_zone")(t.events, "event_id")
    return out.select("k", "val_datetime", "val_date", "val_time", F.col("time_zone").cast("int").alias("time_zone"), F.col("error_code").cast("int").alias("error_code"))


@query("SELECT c_custkey AS k, regexp_extract(c_name, '^[A-Za-z-]+') AS lastname, 'Ann' AS firstname, 'B. C.' AS midname FROM customer")
def split_person_name(t):
    full = F.concat(F.regexp_replace("c_name", "#", " "), F.lit(" Ann B. C. (x)"))
    return t.customer.select(F.col("c_custkey").alias("k"), T.split_person_name(full).alias("n")).select("k", "n.*")


@query("SELECT n_nationkey AS k, 'Ёлка и ' || n_name || ' Яхта' AS v FROM nation")
def fix_encoding(t):
    wrong = dict((b, a) for a, b in T.misread_cyrillic())
    garbled = lambda s: "".join(wrong.get(c, c) for c in s)
    return t.nation.select(F.col("n_nationkey").alias("k"), T.fix_encoding(F.concat(F.lit(garbled("Ёлка и ")), "n_name", F.lit(garbled(" Яхта")))).alias("v"))


@query("SELECT n_nationkey AS k, 0::BIGINT AS error_code, 'FFFE' || array_to_string([hex(c) || '00' FOR c IN string_split(n_name, '')], '') AS data, length(n_name)::BIGINT AS len FROM nation")
def utf8_to_utf16(t):
    return t.nation.select(F.col("n_nationkey").alias("k"), T.utf8_to_utf16(F.col("n_name").cast("binary")).alias("u")).select("k", "u.error_code", F.hex("u.data").alias("data"), "u.len")


@query("SELECT n_nationkey AS k, n_name AS found_value, 'new' AS after_update FROM nation")
def hash_dict(t):
    made = t.nation.select(F.col("n_nationkey").alias("k"), T.hash_dict(F.lit(""), F.lit("a"), F.lit("x"))["updated_dict"].alias("d"), "n_name")
    made = made.withColumn("d", T.hash_dict("d", F.lit("b"), F.col("n_name"))["updated_dict"])
    changed = made.withColumn("e", T.hash_dict("d", F.lit("b"), F.lit("new"))["updated_dict"])
    return changed.select("k", T.hash_dict("d", F.lit("b"))["found_value"].alias("found_value"), T.hash_dict("e", F.lit("b"))["found_value"].alias("after_update"))


# JSON and XML


@query("""SELECT event_id AS k, x.* FROM events, LATERAL (SELECT '/-/' AS node_path, 0::BIGINT AS node_index, 'number' AS value_type, 'k' AS name, json_extract_string(props, '$.k') AS val, 1::BIGINT AS level, 2::BIGINT AS node_start, length(props)::BIGINT - 1 AS node_end
UNION ALL SELECT '/', 0, 'object', NULL, props, 0, 1, length(props)) x""")
def json_parse_nodes(t):
    nodes = J.json_parse(t.events.select(F.col("event_id").alias("k"), "props"), "props")
    return nodes.select("k", "node_path", "node_index", "value_type", "name", "val", "level", "node_start", "node_end")


@query("SELECT event_id AS k, 2::BIGINT AS node_pos, 'num' AS value_type, json_extract_string(props, '$.k') AS val, CAST(json_extract_string(props, '$.k') AS BIGINT) AS val_int FROM events")
def json_get_value(t):
    rows = t.events.select(F.col("event_id").alias("k"), "props").withColumn("v", J.json_get_value("props", "k"))
    return rows.select("k", F.inline("v")).select("k", "node_pos", "value_type", "val", "val_int")


@query("SELECT event_id AS k, '{\"type\": \"B\", \"value\": ' || props || '}' AS node, '/-/items/' AS node_path, 1::BIGINT AS node_index, props AS val, 'object' AS value_type FROM events")
def json_get_node(t):
    doc = F.concat(F.lit('{"items": [{"type": "A", "value": 1}, {"type": "B", "value": '), "props", F.lit("}]}"))
    rows = t.events.select(F.col("event_id").alias("k"), doc.alias("doc")).withColumn("v", J.json_get_node("doc", "type", "B", "value"))
    return rows.select("k", F.inline("v")).select("k", "node", "node_path", "node_index", "val", "value_type")


@query("SELECT event_id AS k, 'k: ' || json_extract_string(props, '$.k') || chr(10) AS yaml FROM events")
def json_to_yaml(t):
    return t.events.select(F.col("event_id").alias("k"), J.json_to_yaml("props")["yaml"].alias("yaml"))


@query("""SELECT n_nationkey AS k, '{"name":"' || n_name || '","region":' || n_regionkey || ',"big":' || CASE WHEN n_nationkey > 12 THEN 'true' ELSE 'false' END || ',"tags":["' || n_name || '"]}' AS v FROM nation""")
def json_build(t):
    member = lambda name, c, kind, d=True: B.json_node(name, c, kind, required=1, delimiter=d)
    parts = F.concat(member("name", F.col("n_name"), "str"), member("region", F.col("n_regionkey"), "num"), member("big", F.when(F.col("n_nationkey") > 12, "1").otherwise("0"), "bool"), member("tags", B.json_node(None, F.col("n_name")), "list", False))
    return t.nation.select(F.col("n_nationkey").alias("k"), B.json_node(None, parts, "obj").alias("v"))


@query("""SELECT doc_id AS k, '<n a="' || doc_id || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</n>' || chr(10) AS v FROM documents""")
def xml_build(t):
    return t.documents.select(F.col("doc_id").alias("k"), B.xml_node("n", F.col("text"), attr=F.btrim(B.xml_attr("a", F.col("doc_id")))).alias("v"))


@query("""SELECT doc_id AS k, 'text="' || replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(13), '&#13;'), chr(10), '&#10;') || '" ' AS v FROM documents""")
def xml_attr(t):
    return t.documents.select(F.col("doc_id").alias("k"), B.xml_attr("text", "text").alias("v"))


@query("""SELECT page_id AS k, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS v FROM pages""")
def xml_escape(t):
    return t.pages.select(F.col("page_id").alias("k"), B.xml_escape("html").alias("v"))


@query("SELECT page_id AS k, html AS v FROM pages")
def xml_unescape_of_escape(t):
    """Unescaping what was escaped gives the page again, unless it holds hex entities itself."""
    return t.pages.select(F.col("page_id").alias("k"), B.xml_unescape(B.xml_escape("html")).alias("v"))


@query("""SELECT page_id AS k, replace(replace(replace(replace(replace(html, '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS v FROM pages""")
def xml_unescape(t):
    return t.pages.select(F.col("page_id").alias("k"), B.xml_unescape("html").alias("v"))


_CUSTOMER_XML = "'<c id=\"' || c_custkey || '\"><name>' || c_name || '</name><seg>' || c_mktsegment || '</seg></c>'"


def _customer_xml():
    inner = F.concat(F.lit("<name>"), "c_name", F.lit("</name><seg>"), "c_mktsegment", F.lit("</seg>"))
    return F.concat(F.lit('<c id="'), F.col("c_custkey").cast("string"), F.lit('">'), inner, F.lit("</c>"))


@query(f"""WITH x AS (SELECT c_custkey AS k, c_name, c_mktsegment, {_CUSTOMER_XML} AS v, length('<c id="' || c_custkey || '">') AS h FROM customer)
SELECT k, '/' AS path, 'c' AS name, substr(v, h + 1, length(v) - h - 4) AS content, 'id="' || k || '"' AS attributes, 1::BIGINT AS startpos, length(v)::BIGINT AS endpos, 0 AS level FROM x
UNION ALL SELECT k, '/c', 'name', c_name, NULL, h + 1, h + 13 + length(c_name), 1 FROM x
UNION ALL SELECT k, '/c', 'seg', c_mktsegment, NULL, h + 14 + length(c_name), h + 13 + length(c_name) + 11 + length(c_mktsegment), 1 FROM x""")
def xml_nodes(t):
    nodes = X.xml_all_nodes(t.customer.select(F.col("c_custkey").alias("k"), _customer_xml().alias("v")), "v")
    return nodes.select("k", "path", "name", "content", "attributes", "startpos", "endpos", "level")


@query(f"SELECT c_custkey AS k, c_mktsegment AS val, 1::BIGINT AS node_number, strpos({_CUSTOMER_XML}, '<seg>')::BIGINT AS node_start, 0 AS error_code FROM customer")
def xml_value(t):
    found = X.xml_get_value(t.customer.select(F.col("c_custkey").alias("k"), _customer_xml().alias("v")), "v", "seg")
    return found.select("k", "val", "node_number", "node_start", "error_code")


@query("SELECT page_id AS k, regexp_extract(html, '<title>([^<]*)</title>', 1) AS val FROM pages WHERE regexp_matches(html, '<title>[^<]*</title>')")
def xml_value_title(t):
    found = X.xml_get_value(t.pages.select(F.col("page_id").alias("k"), "html"), "html", "title")
    return found.filter("error_code = 0").select("k", "val")


@query("SELECT c_custkey AS k, NULL AS alias, 'id' AS name, c_custkey::VARCHAR AS val, 'id=\"' || c_custkey || '\"' AS full_attribute FROM customer UNION ALL SELECT c_custkey, 'x', 'seg', c_mktsegment, 'x:seg=\"' || c_mktsegment || '\"' FROM customer")
def xml_attributes(t):
    text = F.concat(F.lit('id="'), F.col("c_custkey").cast("string"), F.lit('" x:seg="'), "c_mktsegment", F.lit('"'))
    return t.customer.select(F.col("c_custkey").alias("k"), F.inline(B.xml_attributes(text)))


# Hierarchies and graphs: part n hangs below part n div 3


def _parts(t) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("parent"), F.col("p_name").alias("name"))


_BELOW = """WITH RECURSIVE t(id, pid, lvl, pth) AS (SELECT p_partkey, p_partkey // 3, 0, [p_partkey] FROM part WHERE p_partkey // 3 = 0 AND p_partkey <> 0
UNION ALL SELECT p.p_partkey, t.id, t.lvl + 1, list_append(t.pth, p.p_partkey) FROM t JOIN part p ON p.p_partkey // 3 = t.id AND p.p_partkey <> t.id) """


@query(_BELOW + "SELECT id, pid AS parent, lvl AS level, row_number() OVER (ORDER BY pth) - 1 AS sort_order FROM t")
def children(t):
    return G.get_children(_parts(t), "id", "parent", 0)


@query(_BELOW + "SELECT id, pid AS parent, lvl AS level, row_number() OVER (ORDER BY pth) - 1 AS sort_order FROM t WHERE id NOT IN (SELECT p_partkey // 3 FROM part)")
def children_leaf(t):
    return G.get_children(_parts(t), "id", "parent", 0, only_leaf=True)


@query("WITH RECURSIVE t(id, lvl) AS (SELECT CAST(150 AS BIGINT), 1 UNION ALL SELECT id // 3, lvl + 1 FROM t WHERE id > 0) SELECT p.p_partkey AS id, p.p_partkey // 3 AS parent, p.p_name AS info, lvl AS level FROM t JOIN part p ON p.p_partkey = t.id WHERE t.id > 0")
def parents(t):
    """Part 0 is its own parent, so it is left out."""
    return G.get_parents(_parts(t).filter("id <> 0"), "id", "parent", 150, "name")


@query("""WITH RECURSIVE roots AS (SELECT a.p_partkey AS id FROM part a WHERE a.p_partkey // 3 NOT IN (SELECT p_partkey FROM part WHERE p_partkey <> 0) AND a.p_partkey <> 0),
t(id, pid, lvl, pth) AS (SELECT p_partkey, p_partkey // 3, 0, [-p_partkey] FROM part JOIN roots ON roots.id = p_partkey
UNION ALL SELECT p.p_partkey, t.id, t.lvl + 1, list_append(t.pth, -p.p_partkey) FROM t JOIN part p ON p.p_partkey // 3 = t.id AND p.p_partkey <> t.id)
SELECT t.id, pid AS parent, p_name AS name, lvl AS level, CASE WHEN lvl > 0 THEN repeat('|  ', lvl - 1) || '|_' ELSE '' END || p_name AS indented, row_number() OVER (ORDER BY pth) AS order_index FROM t JOIN part ON p_partkey = t.id""")
def hierarchy(t):
    return G.prepare_hierarchy(_parts(t).filter("id <> 0"), "id", "name", "parent")


_EDGES = "SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 AND p_partkey // 3 > 0"


def _edges(t) -> DataFrame:
    p = t.part
    return p.filter("p_partkey > 1").selectExpr("p_partkey a", "p_partkey div 2 b").union(p.filter("p_partkey > 2 and p_partkey div 3 > 0").selectExpr("p_partkey", "p_partkey div 3")).distinct()


@query(f"""WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT max(p_partkey) AS m FROM part), t(id, d) AS (SELECT m, 0 FROM s UNION SELECT e.b, t.d + 1 FROM t JOIN e ON e.a = t.id)
SELECT CAST(id AS VARCHAR) AS name, min(d) AS depth FROM t GROUP BY id""")
def dependencies_bfs(t):
    e = _edges(t).selectExpr("cast(a as string) dependent_name", "5 dependent_type", "cast(b as string) name", "cast(null as string) column", "5 type")
    start = t.part.agg(F.max("p_partkey").cast("string").alias("name")).selectExpr("name", "cast(null as string) column", "5 type")
    return G.get_dependencies(e, start).select("name", "depth")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT p_partkey AS id FROM part WHERE p_partkey > 0), t(id, d) AS (SELECT id, 0 FROM n UNION SELECT e.a, t.d + 1 FROM t JOIN e ON e.b = t.id),
r AS (SELECT id, max(d) AS round FROM t GROUP BY id), c AS (SELECT a, count(*) AS cnt FROM e GROUP BY a)
SELECT row_number() OVER (ORDER BY round, coalesce(cnt, 0), id::VARCHAR) AS order_index, id::VARCHAR AS name, coalesce(cnt, 0)::BIGINT AS required_count, 0 AS loop_type FROM r LEFT JOIN c ON c.a = r.id""")
def topo_order(t):
    e = _edges(t).selectExpr("cast(a as string) name", "cast(b as string) required")
    nodes = t.part.filter("p_partkey > 0").selectExpr("cast(p_partkey as string) name")
    return G.get_order(e, nodes).select("order_index", "name", "required_count", "loop_type")


# Relational operators


@query("SELECT c_custkey, o_orderkey, n_name, r_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", "o_orderkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000")
def join_left_on(t):
    return t.customer.join(t.orders, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, n_name FROM (SELECT c_custkey, c_nationkey AS k FROM customer) JOIN (SELECT n_nationkey AS k, n_name FROM nation) USING (k)")
def join_using(t):
    return t.customer.select("c_custkey", F.col("c_nationkey").alias("k")).join(t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("c_custkey", "n_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.crossJoin(t.region).select("n_name", "r_name")


@query("SELECT n_name, w FROM nation LEFT JOIN (VALUES ('an'), ('ia'), ('zz')) v(w) ON contains(lower(n_name), w) OR (w = 'zz' AND n_nationkey < 3)")
def join_theta(t):
    words = t.rows("w string", ("an",), ("ia",), ("zz",))
    return t.nation.join(words, F.contains(F.lower("n_name"), F.col("w")) | ((F.col("w") == "zz") & (F.col("n_nationkey") < 3)), "left").select("n_name", "w")


@query("SELECT o_orderkey, p FROM orders JOIN (VALUES ('F', 1), ('*', 2), ('O', 3)) r(s, p) ON s = o_orderstatus OR s = '*'")
def join_wildcard(t):
    return R.equi_or_wildcard(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("s")), t.rows("s string, p int", ("F", 1), ("*", 2), ("O", 3)), "s").select("o_orderkey", "p")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(t):
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def join_semi(t):
    return t.customer.join(t.orders.filter("o_totalprice > 150000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT a.n_name AS name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def join_self_dup(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("name"), F.col("b.n_name").alias("other"))


@query("SELECT p_partkey, CAST(i AS BIGINT) AS idx, n_name FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) JOIN nation ON n_nationkey = length(l[i]) % 25")
def join_table_function(t):
    parts = T.explode_parts(t.part.select("p_partkey", "p_name"), T.split_text("p_name", " "))
    return parts.join(t.nation, F.length("part") % 25 == F.col("n_nationkey")).select("p_partkey", "idx", "n_name")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS cnt, min(ts) AS first_ts FROM events GROUP BY event_type")
def agg_count_min(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"), F.min("ts").alias("first_ts"))


@query("SELECT event_type, count(DISTINCT CASE WHEN value > 100 THEN user_id END) AS high, count(DISTINCT CASE WHEN value <= 100 THEN user_id END) AS low, count(DISTINCT CASE WHEN value = 0 THEN user_id END) AS zero FROM events GROUP BY event_type")
def agg_cond_distinct(t):
    some = lambda c: F.count_distinct(F.when(c, F.col("user_id")))
    return t.events.groupBy("event_type").agg(some(F.col("value") > 100).alias("high"), some(F.col("value") <= 100).alias("low"), some(F.col("value") == 0).alias("zero"))


@query("SELECT n_regionkey, string_agg(trim(n_name), ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_list(t):
    return R.listed(t.nation, ["n_regionkey"], F.trim("n_name"), F.col("n_name"), ",", "names")


@query("SELECT c_nationkey, string_agg(c_mktsegment, chr(13) || chr(10) ORDER BY c_mktsegment) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey")
def agg_list_distinct(t):
    return R.listed(t.customer.select("c_nationkey", "c_mktsegment").distinct(), ["c_nationkey"], F.col("c_mktsegment"), F.col("c_mktsegment"), "\r\n", "segments")


@query("SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1")
def agg_having_unique(t):
    """The flag of the orders of one line item; an order of two with the same flag has none."""
    return R.unique_or_nothing(t.lineitem, ["l_orderkey"], "l_returnflag").select("l_orderkey", F.col("l_returnflag").alias("flag"))


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_partkey")
def agg_mean(t):
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(t):
    return R.latest(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "ts"])


@query("SELECT 'c' AS kind, c_name AS name FROM customer UNION ALL SELECT 's', s_name FROM supplier")
def set_union_all(t):
    return t.customer.select(F.lit("c").alias("kind"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_name").alias("name")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select(F.col("s_nationkey"))).distinct()


@query("SELECT c_custkey AS k, c_mktsegment AS stmt, s_name AS other FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_mktsegment IS DISTINCT FROM s_name")
def set_diff_left(t):
    return t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left").filter(~F.col("c_mktsegment").eqNullSafe(F.col("s_name"))).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("stmt"), F.col("s_name").alias("other"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def top1(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM (SELECT *, sum(length(n_name) + 1) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS used FROM nation) WHERE used <= 25 GROUP BY n_regionkey")
def budgeted_list(t):
    return R.listed(R.within_budget(t.nation, ["n_regionkey"], "n_name", F.length("n_name") + 1, 25), ["n_regionkey"], F.col("n_name"), F.col("n_name"), "|", "names")


@query("SELECT o_orderkey FROM orders WHERE ',F,P,' LIKE '%,' || o_orderstatus || ',%' AND o_totalprice BETWEEN 1000 AND 200000 AND starts_with(o_orderpriority, '1')")
def csv_member(t):
    return t.orders.filter(R.in_list("o_orderstatus", "F,P") & F.col("o_totalprice").between(1000, 200000) & F.startswith("o_orderpriority", F.lit("1"))).select("o_orderkey")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS state, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'medium' END AS size FROM orders")
def code_labels(t):
    size = F.when(F.col("o_totalprice") > 200000, "big").when(F.col("o_totalprice") > 100000, "medium")
    return t.orders.select("o_orderkey", M.label("o_orderstatus", {"F": "finished", "O": "open"}).alias("state"), size.alias("size"))


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, '[A-Za-z]+#?[0-9]+') AND contains(lower(p_type), 'st')")
def similar_filter(t):
    return t.part.filter(R.similar("p_brand", "[[:ALPHA:]]+#?[[:DIGIT:]]+") & R.containing("p_type", "ST")).select("p_partkey")


@query("SELECT o_orderkey, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS most FROM orders WHERE o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def scalar_subquery(t):
    most = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("most"))
    return t.orders.join(most, "o_orderkey", "left").filter((F.col("o_orderstatus") == "F") | (F.col("most") > 40)).select("o_orderkey", "most")


# Catalog analytics


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS cnt FROM {n} HAVING count(*) > 0" for n in TABLES))
def table_counts(t):
    return M.table_counts({n: getattr(t, n) for n in TABLES})


@query("SELECT '(' || coalesce(string_agg(n, '|' ORDER BY n), '') || ')' AS skip_data FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS n, count(*) AS c FROM {n}" for n in TABLES) + ") WHERE c > 10000")
def big_tables(t):
    return M.big_tables(M.table_counts({n: getattr(t, n) for n in TABLES}))


#: The text fields of all tables; embeddings has none.
_TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"],
    "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}


def _searched(value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS field_name, count(*) AS cnt FROM {n} WHERE upper({c}) = '{value}' HAVING count(*) > 0" for n, cs in _TEXT_COLUMNS.items() for c in cs)


@query(_searched("BUILDING"))
def search_all_fields(t):
    return M.search_all_fields({n: getattr(t, n) for n in TABLES}, "Building", ignore_case=True, types=M.TEXT_TYPES)


@query(_searched("FR"))
def search_short_value(t):
    return M.search_all_fields({n: getattr(t, n) for n in TABLES}, "fr", ignore_case=True, types=M.TEXT_TYPES)


_CATALOG = "(VALUES ('ORDERS', 0, 0), ('EVENTS', 0, 0), ('V1', 1, 0), ('SYS', 0, 1)) r(relation_name, relation_type, system_flag)"


def _relations(t):
    return t.rows("relation_name string, relation_type int, system_flag int", ("ORDERS", 0, 0), ("EVENTS", 0, 0), ("V1", 1, 0), ("SYS", 0, 1))


@query(f"SELECT relation_name FROM {_CATALOG} WHERE system_flag = 0 AND relation_type = 0 AND relation_name NOT IN ('ORDERS')")
def tables_without_pk(t):
    return M.tables_without_key(_relations(t), t.rows("relation_name string, constraint_type string", ("ORDERS", "PRIMARY KEY"), ("EVENTS", "CHECK")))


@query("""SELECT u AS user_name, k AS type_name, n AS name, p AS privilege, replace(replace(s, '<obj>', n), '<user>', u) AS stmt
FROM (VALUES ('ANN'), ('BOB')) a(u), (VALUES ('table', 'ORDERS'), ('procedure', 'P1')) o(k, n), (VALUES ('GRANT SELECT ON <obj> TO USER <user>;', 'table', 'S'), ('GRANT INSERT ON <obj> TO USER <user>;', 'table', 'I'), ('GRANT UPDATE ON <obj> TO USER <user>;', 'table', 'U'), ('GRANT EXECUTE PROCEDURE <obj> TO USER <user>;', 'procedure', 'X')) g(s, gk, p)
WHERE gk = k AND NOT (u = 'ANN' AND n = 'ORDERS' AND p IN ('S', 'I'))""")
def missing_grants(t):
    have = t.rows("user string, relation_name string, privilege string", ("ANN", "ORDERS", "S"), ("ANN", "ORDERS", "I "))
    return M.missing_grants(t.rows("user_name string", ("ANN",), ("BOB",)), t.rows("type_name string, name string", ("table", "ORDERS"), ("procedure", "P1")), have)


def _indices(t):
    i = t.rows("index_name string, relation_name string, unique_flag int, index_inactive int, index_type int, segment_count int, statistics double, expression_source string, system_flag int", ("I1", "ORDERS", 1, 0, 0, 2, 0.1, None, 0), ("I2", "ORDERS", 1, 0, None, 2, 0.2, None, 0), ("I3", "ORDERS", 0, 0, 0, 1, 0.2, None, 0), ("I4", "EVENTS", 0, 0, 0, 0, 0.5, "(UPPER(A))", 0))
    s = t.rows("index_name string, field_name string, field_position int, statistics double", ("I1", "A", 0, 0.1), ("I1", "B", 1, 0.3), ("I2", "A", 0, 0.2), ("I2", "B", 1, 0.4), ("I3", "A", 0, 0.2))
    return i, s


@query("SELECT 'ORDERS' AS table_name, 'I1' AS index_name, 'A,B' AS fields_list, 'I2' AS d_index_name, CAST(0.2 AS DOUBLE) AS index_statistics, CAST(0.3 AS DOUBLE) AS d_index_statistics")
def dup_indices(t):
    return M.duplicated_indices(*_indices(t)).select("table_name", "index_name", "fields_list", "d_index_name", F.round("index_statistics", 6).alias("index_statistics"), F.round("d_index_statistics", 6).alias("d_index_statistics"))


@query("SELECT 'T1' AS object_name, 'create table T1(' || chr(10) || 'ID bigint not null' || chr(10) || '    , NAME varchar(20) ' || chr(10) || '    , SUM numeric(18, 2) default 0' || chr(10) || '    , constraint PK_T1 primary key (ID)' || chr(10) || ');' AS stmt")
def create_statement(t):
    rf = t.rows("relation_name string, field_name string, field_source string, field_position int, null_flag int, default_source string", ("T1", "ID", "RDB$1", 0, 1, None), ("T1", "NAME", "RDB$2", 1, None, None), ("T1", "SUM", "RDB$3", 2, None, "default 0"))
    f = t.rows("field_name string, field_type int, field_sub_type int, field_scale int, field_length int", ("RDB$1", 16, 0, 0, 8), ("RDB$2", 37, 0, 0, 20), ("RDB$3", 16, 1, -2, 8))
    c = t.rows("relation_name string, constraint_name string, constraint_type string, index_name string", ("T1", "PK_T1", "PRIMARY KEY", "PK_T1"))
    return M.create_table(rf, f, c, t.rows("index_name string, field_name string, field_position int", ("PK_T1", "ID", 0)))


@query("SELECT event_type AS \"user\", date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') AS days_old, count(*) AS cnt, min(ts) AS min_timestamp FROM events GROUP BY 1, 2")
def connection_ages(t):
    a = t.events.select(F.col("event_type").alias("user"), F.col("ts").alias("timestamp"), F.lit(0).alias("system_flag"))
    return M.connection_ages(a, F.lit("2030-01-01").cast("date"))


@query("SELECT c_custkey AS attachment_id FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR (ends_with(upper(c_name), '7') AND upper(c_mktsegment) = 'MACHINERY'))")
def whitelist_denied(t):
    a = t.customer.select(F.col("c_custkey").alias("attachment_id"), F.col("c_name").alias("remote_process"), F.col("c_mktsegment").alias("user"), F.lit("10.0.0.1").alias("remote_address"), F.lit(0).alias("system_flag"))
    rules = t.rows("allowed_process string, allowed_user string, allowed_address string", (None, "building", None), ("7", "Machinery", "10.0.0.1"))
    return M.denied_connections(a, rules).select("attachment_id")


# Change capture: orders against themselves, statuses, priorities and rows changed by key


_CHANGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0"
_LOG = f"""SELECT coalesce(o.o_orderkey, n.o_orderkey)::VARCHAR AS primary_key_1, CASE WHEN n.o_orderkey IS NULL THEN 'DELETE' WHEN o.o_orderkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS change_type, f AS changed_field_name,
CASE f WHEN 'o_orderstatus' THEN o.o_orderstatus ELSE o.o_orderpriority END AS old_value, CASE f WHEN 'o_orderstatus' THEN n.o_orderstatus ELSE n.o_orderpriority END AS new_value
FROM orders o FULL JOIN ({_CHANGED}) n ON n.o_orderkey = o.o_orderkey CROSS JOIN (VALUES ('o_orderstatus'), ('o_orderpriority')) v(f)"""


def _snapshots(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = old.filter("o_orderkey % 13 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return old, new


@query(f"SELECT * FROM ({_LOG}) WHERE old_value IS DISTINCT FROM new_value")
def cdc_changelog(t):
    log = C.snapshot_diff(*_snapshots(t), ["o_orderkey"], table="orders")
    return log.select("primary_key_1", "change_type", "changed_field_name", "old_value", "new_value")


@query(f"""WITH l AS (SELECT * FROM ({_LOG}) WHERE old_value IS DISTINCT FROM new_value)
SELECT primary_key_1, 'update orders set o_orderkey = o_orderkey' || string_agg(', ' || changed_field_name || ' = ''' || old_value || ''' /* old: ' || coalesce(new_value, 'null') || '*/', '' ORDER BY changed_field_name DESC) || ' where o_orderkey = ''' || primary_key_1 || ''';' AS restore_stmt FROM l WHERE change_type = 'UPDATE' GROUP BY primary_key_1
UNION ALL SELECT primary_key_1, 'insert into orders(o_orderkey' || string_agg(', ' || changed_field_name, '' ORDER BY changed_field_name DESC) || ') values (''' || primary_key_1 || '''' || string_agg(', ''' || old_value || '''', '' ORDER BY changed_field_name DESC) || ');' FROM l WHERE change_type = 'DELETE' GROUP BY primary_key_1""")
def cdc_restore(t):
    log = C.with_change_ids(C.snapshot_diff(*_snapshots(t), ["o_orderkey"], table="orders"))
    return C.restore_statements(log, ["orders"]).select("primary_key_1", "restore_stmt")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def cdc_undo(t):
    """Applying the log to the old snapshot and undoing it: all rows are as they were."""
    old, new = _snapshots(t)
    log = C.with_change_ids(C.snapshot_diff(old, new, ["o_orderkey"], table="orders"))
    after = C.apply_changes(old, log, ["o_orderkey"])
    back = C.with_change_ids(C.snapshot_diff(after, old, ["o_orderkey"], table="orders"))
    return C.apply_changes(after, back, ["o_orderkey"])


@query("""WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 > 0),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 > 0)
SELECT CAST(c_custkey AS VARCHAR) AS primary_key_1, CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
CASE WHEN o.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'c_mktsegment' END AS changed_field_name, o.c_mktsegment AS old_value, n.c_mktsegment AS new_value
FROM o FULL JOIN n USING (c_custkey) WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_mktsegment IS DISTINCT FROM n.c_mktsegment""")
def cdc_rows_of_nulls(t):
    """Inserted and deleted rows that hold nulls only have a row without a field in the log."""
    c = t.customer
    old = c.filter("c_custkey % 5 > 0").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    new = c.filter("c_custkey % 7 > 0").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return C.snapshot_diff(old, new, ["c_custkey"], table="customer").select("primary_key_1", "change_type", "changed_field_name", "old_value", "new_value")


@query("""SELECT 'table' AS object_type, n_name AS object_name, 'v1 ' || n_name AS stmt, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 2 END AS checked FROM nation
UNION ALL SELECT 'table', n_name, 'v2 ' || n_name, 2 FROM nation WHERE n_nationkey % 5 = 0""")
def structure_poll(t):
    n = t.nation.select(F.lit("table").alias("object_type"), F.col("n_name").alias("object_name"), "n_nationkey")
    stored = n.select("object_type", "object_name", F.concat(F.lit("v1 "), "object_name").alias("stmt"), F.lit(1).alias("checked"))
    current = n.select("object_type", "object_name", F.concat(F.when(F.col("n_nationkey") % 5 == 0, "v2 ").otherwise("v1 "), F.col("object_name")).alias("stmt"))
    return C.structure_changes(stored, current, F.lit(2))


from sparloom.plans import catalog_queries  # noqa: E402, F401  registers its queries
