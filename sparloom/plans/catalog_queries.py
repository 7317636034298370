"""Further queries, registered beside those of `queries`: catalog operators over catalogs derived from the
driver's tables, statement generators, monitoring reports, change logs, predicates, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.functions import text as T
from sparloom.functions import typed as TY
from sparloom.operators import catalog as M
from sparloom.operators import cdc as C
from sparloom.operators import graph as G
from sparloom.operators import json_nodes as J
from sparloom.operators import relational as R
from sparloom.operators import xml_nodes as X
from sparloom.plans.queries import query
from sparloom.sources import files as S

# Definitions and statements


@query("""SELECT 'view' AS object_type, n_name AS object_name, 'select ' || n_nationkey AS local_stmt, CASE WHEN n_nationkey % 3 > 0 THEN 'select ' || (n_nationkey - n_nationkey % 2) END AS remote_stmt
FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 1""")
def compare_definitions(t):
    mine = t.nation.select(F.lit("view").alias("object_type"), F.col("n_name").alias("object_name"), F.concat(F.lit("select "), "n_nationkey").alias("stmt"))
    other = t.nation.filter("n_nationkey % 3 > 0").select(F.lit("view").alias("object_type"), F.col("n_name").alias("object_name"), F.expr("concat('select ', n_nationkey - n_nationkey % 2)").alias("stmt"))
    return M.compare_definitions(mine, other)


@query("SELECT c_name AS object_name, 'create view ' || c_name || chr(10) || ' as ' || chr(10) || c_mktsegment || ';' AS stmt FROM customer WHERE c_nationkey % 2 = 1")
def create_views(t):
    return M.create_view(t.customer.select(F.col("c_name").alias("relation_name"), (F.col("c_nationkey") % 2).alias("relation_type"), F.col("c_mktsegment").alias("view_source")))


@query("""SELECT s_name AS object_name, 'set term ^ ;' || chr(10) || 'create or alter trigger ' || s_name || ' for T' || s_nationkey || chr(10) || CASE WHEN s_suppkey % 4 = 1 THEN 'inactive' ELSE 'active' END || ' ' ||
CASE s_suppkey % 4 WHEN 0 THEN 'before insert' WHEN 1 THEN 'after insert' WHEN 2 THEN 'before update' ELSE 'after update' END || ' position ' || s_nationkey || chr(10) || 'as begin end^' || chr(10) || 'set term ; ^' AS stmt FROM supplier WHERE s_suppkey % 5 > 0""")
def create_triggers(t):
    n = F.col("s_suppkey") % 4
    s = t.supplier.select(F.col("s_name").alias("trigger_name"), F.concat(F.lit("T"), "s_nationkey").alias("relation_name"), (n + 1).cast("int").alias("trigger_type"), F.col("s_nationkey").alias("trigger_sequence"), (n == 1).cast("int").alias("trigger_inactive"), F.lit("as begin end").alias("trigger_source"), (F.col("s_suppkey") % 5 == 0).cast("int").alias("system_flag"))
    return M.create_trigger(s)


@query("""SELECT n_name AS object_name, CASE WHEN n_nationkey % 5 <> 4 THEN 'set term ^ ;' || chr(10) || 'create or alter procedure ' || n_name || '(' || chr(10) || '    A ' || CASE n_nationkey % 5 WHEN 0 THEN 'varchar(20)' WHEN 1 THEN 'numeric(18, 2)' WHEN 2 THEN 'D_OWN' ELSE 'type of column T.F' END || chr(10) ||
'    , B integer = 7' || chr(10) || ')' || chr(10) || 'as' || chr(10) || 'begin end^' || chr(10) || 'set term ; ^' END AS stmt, CASE WHEN n_nationkey % 5 = 4 THEN 1 ELSE 0 END AS error_code, CASE WHEN n_nationkey % 5 = 4 THEN 'unsupported field type' ELSE '' END AS error_text FROM nation""")
def create_procedures(t):
    n = t.nation
    own = n.select(F.col("n_name").alias("procedure_name"), F.lit("begin end").alias("procedure_source"), F.lit(None).cast("string").alias("package_name"), F.lit(0).alias("system_flag"))
    kind = F.col("n_nationkey") % 5
    source = F.when(kind == 2, "D_OWN").otherwise(F.concat(F.lit("RDB$"), kind))
    one = n.select(F.col("n_name").alias("procedure_name"), F.lit("A").alias("parameter_name"), F.lit(0).alias("parameter_type"), F.lit(0).alias("parameter_number"), source.alias("field_source"), F.when(kind == 3, "T").alias("relation_name"), F.when(kind == 3, "F").alias("field_name"), F.lit(None).cast("string").alias("default_source"))
    two = one.select("procedure_name", F.lit("B").alias("parameter_name"), "parameter_type", F.lit(1).alias("parameter_number"), F.lit("RDB$9").alias("field_source"), F.lit(None).cast("string").alias("relation_name"), F.lit(None).cast("string").alias("field_name"), F.lit("= 7").alias("default_source"))
    fields = t.rows("field_name string, field_type int, field_sub_type int, field_scale int, field_length int", ("RDB$0", 37, 0, 0, 20), ("RDB$1", 16, 1, -2, 8), ("D_OWN", 8, 0, 0, 4), ("RDB$3", 8, 0, 0, 4), ("RDB$4", 999, 0, 0, 4), ("RDB$9", 8, 0, 0, 4))
    return M.create_procedure(own, one.unionByName(two), fields)


@query("""SELECT p_name || p_partkey AS object_name, 'create domain ' || p_name || p_partkey || ' as varchar(' || p_size || ')' || CASE WHEN p_partkey % 2 = 1 THEN ' default ''x''' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' not null' ELSE '' END || ';' AS stmt FROM part WHERE p_partkey % 4 > 0""")
def create_domains(t):
    k = F.col("p_partkey")
    p = t.part.select(F.concat("p_name", k).alias("field_name"), F.lit(37).alias("field_type"), F.lit(0).alias("field_sub_type"), F.lit(0).alias("field_scale"), F.col("p_size").alias("field_length"), F.when(k % 2 == 1, "default 'x'").alias("default_source"), F.when(k % 3 == 0, 1).alias("null_flag"), (k % 4 == 0).cast("int").alias("system_flag"))
    return M.create_simple("domain", p)


@query("""SELECT r_name AS object_name, 'create or alter exception ' || r_name || ' ''it''''s ' || r_regionkey || ''';' AS stmt FROM region UNION ALL SELECT s_name, 'create sequence ' || s_name || ';' FROM supplier WHERE s_suppkey % 2 = 0""")
def create_exceptions_and_sequences(t):
    e = M.create_simple("exception", t.region.select(F.col("r_name").alias("exception_name"), F.concat(F.lit("it's "), "r_regionkey").alias("message"), F.lit(0).alias("system_flag")))
    s = M.create_simple("sequence", t.supplier.select(F.col("s_name").alias("generator_name"), (F.col("s_suppkey") % 2).cast("int").alias("system_flag")))
    return e.unionByName(s)


@query("SELECT c_mktsegment AS relation_name, string_agg(c_name, ',' ORDER BY c_name) AS fields FROM customer WHERE lower(c_name) LIKE '%1%' GROUP BY c_mktsegment")
def tables_with_field(t):
    return M.tables_with_field(t.customer.select(F.col("c_mktsegment").alias("relation_name"), F.col("c_name").alias("field_name")), "1")


@query("""SELECT CASE p_size % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'view' ELSE 'trigger' END AS master_type, p_name AS master_name, CASE WHEN p_partkey % 7 = 5 THEN 'procedure' WHEN p_partkey % 7 = 0 THEN 'table' WHEN p_partkey % 7 = 1 THEN 'view' WHEN p_partkey % 7 = 2 THEN 'trigger' WHEN p_partkey % 7 = 3 THEN 'computed_field' WHEN p_partkey % 7 = 4 THEN 'validation' END AS slave_type, p_brand AS slave_name, p_type AS field_name FROM part""")
def dependencies_listing(t):
    return M.dependencies_listing(t.part.select(F.col("p_name").alias("dependent_name"), (F.col("p_size") % 3).alias("dependent_type"), F.col("p_brand").alias("depended_on_name"), (F.col("p_partkey") % 7).cast("int").alias("depended_on_type"), F.col("p_type").alias("field_name")))


@query("SELECT s_name AS sequence_name, s_suppkey AS value FROM supplier WHERE s_suppkey % 3 > 0")
def sequence_status(t):
    return M.sequence_status(t.supplier.select(F.col("s_name").alias("generator_name"), (F.col("s_suppkey") % 3 == 0).cast("int").alias("system_flag"), F.col("s_suppkey").alias("value")))


@query("""SELECT kind AS type_name, string_agg('drop ' || kind || ' ' || name || ';', chr(13) || chr(10) ORDER BY name) AS stmts FROM (SELECT 'table' AS kind, n_name AS name FROM nation UNION SELECT 'view', r_name FROM region UNION SELECT 'procedure', s_name FROM supplier) WHERE NOT starts_with(name, 'A') GROUP BY kind""")
def drop_objects(t):
    o = t.nation.select(F.lit("table").alias("type_name"), F.col("n_name").alias("name")).unionByName(t.region.select(F.lit("view").alias("type_name"), F.col("r_name").alias("name"))).unionByName(t.supplier.select(F.lit("procedure").alias("type_name"), F.col("s_name").alias("name")))
    return M.drop_statements(o, "A")


@query("""SELECT 1 AS step, 'create or alter procedure ' || s_name || ' as begin end;' AS stmt FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT 2, 'drop trigger ' || n_name || ';' FROM nation
UNION ALL SELECT 3, 'alter table ' || r_name || ' drop constraint C' || r_regionkey || ';' FROM region UNION ALL SELECT 4, 'drop index I' || n_nationkey || ';' FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 5, 'delete from user_privileges;'""")
def mock_statements(t):
    zero = F.lit(0).alias("system_flag")
    return M.mock_statements(
        t.supplier.select(F.col("s_name").alias("procedure_name"), (F.col("s_suppkey") % 3 == 0).cast("int").alias("system_flag")),
        t.nation.select(F.col("n_name").alias("trigger_name"), zero),
        t.region.select(F.col("r_name").alias("relation_name"), F.concat(F.lit("C"), "r_regionkey").alias("constraint_name"), F.concat(F.lit("I"), "r_regionkey").alias("index_name")),
        t.nation.select(F.concat(F.lit("I"), "n_nationkey").alias("index_name"), zero),
    )


def _two_indices(t) -> tuple[DataFrame, DataFrame]:
    """Each nation has an index N<key> on fields x and y of table T<key>, unique for even keys."""
    k = F.col("n_nationkey")
    i = t.nation.select(F.concat(F.lit("N"), k).alias("index_name"), F.concat(F.lit("T"), k).alias("relation_name"), (k % 2 == 0).cast("int").alias("unique_flag"), F.lit(0).alias("index_inactive"), F.lit(0).alias("index_type"), F.lit(2).alias("segment_count"), F.lit(0.5).alias("statistics"), F.lit(None).cast("string").alias("expression_source"), F.lit(0).alias("system_flag"))
    s = t.nation.select(F.concat(F.lit("N"), k).alias("index_name"), F.explode(F.array(F.struct(F.lit("x").alias("field_name"), F.lit(0).alias("field_position")), F.struct(F.lit("y").alias("field_name"), F.lit(1).alias("field_position")))).alias("f")).select("index_name", "f.*", F.lit(0.5).alias("statistics"))
    return i, s


@query("""SELECT * FROM (VALUES ('same', 'noop', ''), ('taken', 'noop', ''), ('forced', 'drop_create', 'drop index N3;' || chr(10) || 'create unique index N3 on T3 (y, x);'), ('other', 'noop', ''), ('new', 'create', 'create desc index NEW on T5 (x, y);')) v(what, action, stmt)""")
def index_decisions(t):
    i, s = _two_indices(t)
    asked = {
        "same": M.create_or_alter_index(i, s, "N2", "T2", ["x", "y"], unique=True), "taken": M.create_or_alter_index(i, s, "N3", "T3", ["y", "x"], unique=True),
        "forced": M.create_or_alter_index(i, s, "N3", "T3", ["y", "x"], unique=True, force=True), "other": M.create_or_alter_index(i, s, "NEW", "T5", ["x", "y"]), "new": M.create_or_alter_index(i, s, "NEW", "T5", ["x", "y"], descending=True),
    }
    return G._union([df.select(F.lit(what).alias("what"), "action", "stmt") for what, df in asked.items()])


@query("""SELECT * FROM (VALUES ('field there', 'noop', ''), ('field new', 'add', 'alter table orders add o_note varchar(20);' || chr(10) || 'comment on column orders.o_note is ''a customer''''s note'';'), ('key same', 'noop', ''), ('key other', 'change', 'alter table T4 drop constraint PK4;' || chr(10) || 'alter table T4 add constraint pk_T4 primary key (y);')) v(what, action, stmt)""")
def field_and_key_decisions(t):
    f = t.rows("relation_name string, field_name string", *[("ORDERS", x.upper()) for x in t.orders.columns])
    _, s = _two_indices(t)
    c = t.nation.selectExpr("concat('PK', n_nationkey) constraint_name", "'PRIMARY KEY' constraint_type", "concat('T', n_nationkey) relation_name", "concat('N', n_nationkey) index_name")
    asked = {"field there": M.add_field(f, "orders", "o_custkey", "bigint"), "field new": M.add_field(f, "orders", "o_note", "varchar(20)", "a customer's note"), "key same": M.change_primary_key(c, s, "T4", ["x", "y"]), "key other": M.change_primary_key(c, s, "T4", ["y"])}
    return G._union([df.select(F.lit(what).alias("what"), "action", "stmt") for what, df in asked.items()])


# Monitoring reports: customers as attachments, orders as transactions and statements


def _stats(t, names: list[str]) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("stat_id"), *[(F.col("c_custkey") * 10 + i).alias(n) for i, n in enumerate(names)])


_ATTACHED = "c_custkey AS attachment_id, CAST(c_custkey % 2 AS INT) AS state, c_mktsegment AS remote_address, c_name AS remote_process, c_nationkey AS server_pid, c_custkey AS stat_id"
_COUNTERS = ", ".join(f"c_custkey * 10 + {i} AS {n}" for i, n in enumerate(M._RECORDS))


def _attachments(t) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("attachment_id"), (k % 2).cast("int").alias("state"), F.col("c_mktsegment").alias("remote_address"), F.lit("t").alias("timestamp"), F.col("c_name").alias("remote_process"), F.col("c_nationkey").alias("server_pid"), k.alias("stat_id"))


@query(f"""WITH w AS (SELECT o_custkey, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) AS i, count(DISTINCT CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END) AS n, count(DISTINCT CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey END) AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS attachment_id, 'active' AS state, c_mktsegment AS remote_address, 't' AS timestamp, c_name AS remote_process, {_COUNTERS}, coalesce(i, 0) AS infinite_waits, coalesce(n, 0) AS no_waits, coalesce(w, 0) AS waits, 'delete from attachments where attachment_id = ' || c_custkey AS delete_stmt
FROM customer LEFT JOIN w ON o_custkey = c_custkey WHERE c_custkey % 2 = 1""")
def attachments_report(t):
    k = F.col("o_orderkey") % 3
    tr = t.orders.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("attachment_id"), (F.col("o_orderstatus") == "F").cast("int").alias("state"), F.when(k == 0, -1).when(k == 1, 0).otherwise(30).alias("lock_timeout"))
    return M.attachments_report(_attachments(t), _stats(t, M._RECORDS), tr, only_active=True)


@query(f"""SELECT o_orderkey AS transaction_id, o_custkey AS attachment_id, CASE WHEN o_orderstatus = 'F' THEN 'STARTED' ELSE 'FINISHED' END AS state, o_orderpriority AS timestamp, CASE o_orderkey % 4 WHEN 0 THEN 'consistence' WHEN 1 THEN 'concurrency' WHEN 2 THEN 'read committed record version' ELSE 'read committed no record version' END AS isolation_mode,
CASE o_orderkey % 3 WHEN 0 THEN 'Infinite wait' WHEN 1 THEN 'No wait' ELSE 'Timeout 30' END AS lock_timeout, CASE WHEN o_orderkey % 2 = 0 THEN 'No' ELSE 'Yes' END AS read_only, 'Yes' AS auto_commit, 'No' AS auto_undo, {_COUNTERS}, {", ".join(f"c_custkey * 10 + {i} AS {n}" for i, n in enumerate(M._PAGES))} FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def transactions_report(t):
    k = F.col("o_orderkey")
    tr = t.orders.select(k.alias("transaction_id"), F.col("o_custkey").alias("attachment_id"), (F.col("o_orderstatus") == "F").cast("int").alias("state"), (k % 4).cast("int").alias("isolation_mode"), F.when(k % 3 == 0, -1).when(k % 3 == 1, 0).otherwise(30).alias("lock_timeout"), (k % 2).cast("int").alias("read_only"), F.lit(1).alias("auto_commit"), F.lit(0).alias("auto_undo"), F.col("o_orderpriority").alias("timestamp"), F.col("o_custkey").alias("stat_id"))
    return M.transactions_report(tr, _stats(t, M._RECORDS), _stats(t, M._PAGES))


@query(f"""SELECT o_orderkey AS statement_id, o_orderpriority AS sql_text, CASE o_orderkey % 3 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'ACTIVE' ELSE 'STALLED' END AS status, 't' AS timestamp, {_COUNTERS}, o_orderkey AS transaction_id, o_custkey AS attachment_id, right(c_name, 32) AS process_name, {", ".join(f"c_custkey * 10 + {i} AS {n}" for i, n in enumerate(M._PAGES))}, c_name AS remote_process, c_nationkey AS server_pid,
'delete from statements where statement_id = ' || o_orderkey AS delete_stmt FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(o_orderpriority) LIKE '%urgent%' AND c_nationkey = 3""")
def statements_report(t):
    st = t.orders.select(F.col("o_orderkey").alias("statement_id"), F.col("o_orderpriority").alias("sql_text"), (F.col("o_orderkey") % 3).cast("int").alias("state"), F.lit("t").alias("timestamp"), F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("attachment_id"), F.col("o_custkey").alias("stat_id"))
    return M.statements_report(st, _stats(t, M._RECORDS), _attachments(t), _stats(t, M._PAGES), sql_part="Urgent", server_pid=3)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT date_trunc('day', max(o_orderdate)) - INTERVAL 2 HOUR - INTERVAL 365 DAY FROM orders)")
def delete_stale(t):
    """Orders from before 22:00 of the day before the last one, a year on, are deleted by predicate."""
    now = F.lit(t.orders.agg(F.max("o_orderdate")).first()[0]).cast("timestamp") - F.expr("interval 365 days")
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").alias("timestamp"))
    return rows.join(M.stale_connections(rows, now).select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


# Change logs and settings


@query("SELECT upper(n_name) AS table_name, 'F' || n_nationkey AS field_name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS log_insert FROM nation")
def tracking_rules(t):
    return C.normalised_rules(t.nation.select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("table_name"), F.concat(F.lit("f"), "n_nationkey").alias("field_name"), F.when(F.col("n_nationkey") % 2 == 0, 1).alias("log_insert")))


@query("SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'etl') AS client_process, 'tx 5' AS tx, 9 AS changed FROM nation")
def enriched_log(t):
    log = t.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("client_process"))
    return C.enriched(log, {"client_process": "etl", "tx": "tx 5"}, F.lit(9))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation WHERE n_nationkey >= 10 AND (n_nationkey >= 15 OR n_nationkey % 2 = 1)")
def history_import(t):
    n = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    history = n.filter("k >= 10").select("k", F.when(F.col("k") % 2 == 0, F.col("v")).alias("v"))
    return C.import_history(n.filter("k < 15"), history, ["k", "v"])


@query("SELECT n_name AS key, CASE WHEN n_nationkey < 20 THEN CAST(n_nationkey AS VARCHAR) ELSE 'default' END AS val, CASE WHEN n_nationkey >= 5 THEN 'new text' ELSE 'old text' END AS description FROM nation")
def merged_settings(t):
    n = t.nation
    return C.merge_settings(n.filter("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("val"), F.lit("old text").alias("description")), n.filter("n_nationkey >= 5").select(F.col("n_name").alias("key"), F.lit("default").alias("val"), F.lit("new text").alias("description")))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS v FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'added' FROM supplier WHERE s_suppkey % 2 = 0")
def upserted(t):
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    even = s.filter("k % 2 = 0")
    return C.upsert(s, even.select("k", F.lit("new").alias("v")).unionByName(even.select((F.col("k") + 1_000_000).alias("k"), F.lit("added").alias("v"))), ["k"])


# Graphs with cycles, nested dependencies, drop order, call stacks


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 10 < 3 THEN 2 WHEN p_partkey % 10 = 3 THEN 1 ELSE 0 END AS loop_type FROM part")
def order_with_cycles(t):
    """In every ten parts three require each other in a ring, one requires itself, and the rest form a chain
    that starts at the ring."""
    k = F.col("p_partkey")
    e = t.part.select(k.cast("string").alias("name"), F.when(k % 10 < 3, k - k % 10 + (k % 10 + 1) % 3).when(k % 10 == 3, k).otherwise(F.when(k % 10 == 4, k - 4).otherwise(k - 1)).cast("string").alias("required"))
    nodes = t.part.select(k.cast("string").alias("name"))
    return G.get_order(e, nodes).select("name", "loop_type")


@query("SELECT 5 AS type, string_agg(n, ',' ORDER BY n) AS names, count(*) AS n FROM (SELECT DISTINCT unnest(['P1', 'P2', 'P3']) AS n) UNION ALL SELECT 0, string_agg('T' || i, ',' ORDER BY 'T' || i), count(*) FROM range(1, 4) r(i)")
def nested_dependencies(t):
    e = t.rows("dependent_name string, dependent_type int, name string, column string, type int", ("P0", 5, "P1", None, 5), ("P1", 5, "P2", None, 5), ("P2", 5, "P3", None, 5), ("P1", 5, "T1", "A", 0), ("P2", 5, "T2", None, 0), ("P3", 5, "T3", None, 0), ("T3", 0, "T9", None, 0), ("P3", 5, "P1", None, 5))
    return G.nested_dependencies(e, t.rows("name string, column string, type int", ("P0", None, 5)))


@query("WITH RECURSIVE u(id, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT p_partkey, d + 1 FROM u JOIN part ON p_partkey // 4 = id AND p_partkey <> id), m AS (SELECT max(d) AS m FROM u) SELECT id AS name, m - d AS step FROM u, m")
def drop_order(t):
    """What a part is required by is dropped before it: steps fall with the depth below part 1."""
    e = t.part.filter("p_partkey >= 4").selectExpr("cast(p_partkey as string) name", "cast(p_partkey div 4 as string) required")
    s = G.drop_statements(e, t.part.filter("p_partkey > 0").selectExpr("cast(p_partkey as string) name"), "1")
    name = F.regexp_extract("stmt", r"procedure (\d+);", 1).cast("bigint")
    depth = F.floor(F.log(4.0, name.cast("double")) + F.lit(1e-9)).cast("int")
    deepest = s.agg(F.max(depth).alias("m"))
    # the order inside a depth is by name as text; the step counts depths here
    return s.select(name.alias("name"), depth.alias("d")).crossJoin(F.broadcast(deepest)).select("name", (F.col("m") - F.col("d")).alias("step"))


@query("SELECT o_custkey AS statement_id, string_agg(o_orderkey || ':' || o_orderstatus || '[' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END || ':7]<' || coalesce((o_orderkey - 1)::VARCHAR, ''), chr(10) ORDER BY o_orderkey DESC)[1:4096] AS call_stack FROM orders GROUP BY o_custkey")
def call_stacks(t):
    k = F.col("o_orderkey")
    return G.call_stack_text(t.orders.select(k.alias("call_id"), (k - 1).alias("caller_id"), F.col("o_custkey").alias("statement_id"), F.col("o_orderstatus").alias("object_name"), F.when(k % 2 == 0, k).alias("source_line"), F.lit(7).alias("source_column")))


# Predicates


@query("SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS v FROM part WHERE p_name LIKE 'w%' OR contains(lower(p_type), 'steel')")
def searched_case(t):
    return t.part.filter(F.startswith("p_name", F.lit("w")) | R.containing("p_type", "STEEL")).select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("v"))


@query("SELECT c_custkey FROM customer c WHERE c_acctbal BETWEEN 0 AND 1000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)")
def exists_under_or(t):
    """A predicate under OR is a flag from an outer join of the distinct keys, so no row is lost or doubled."""
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has_big")).distinct()
    far = t.nation.filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("near"))
    c = t.customer.join(big, "c_custkey", "left").join(F.broadcast(far), "c_nationkey", "left")
    return c.filter(F.col("c_acctbal").between(0, 1000) | F.coalesce("has_big", F.lit(False)) | ~F.coalesce("near", F.lit(False))).select("c_custkey")


# Text, JSON and XML


@query("""SELECT e.event_id AS k, i AS node_index, CASE WHEN i < 2 THEN 'number' ELSE 'object' END AS value_type, CASE i WHEN 0 THEN (e.event_id)::VARCHAR WHEN 1 THEN '-0.5' ELSE '{"deep": [true, null]}' END AS val, CASE i WHEN 0 THEN NULL WHEN 1 THEN 'named' END AS name FROM events e, LATERAL (SELECT unnest(range(0, 3)) AS i)""")
def json_nested(t):
    """Nested arrays and objects, a named item in an array, commas at the ends."""
    doc = F.concat(F.lit('{"a": {"list": ['), F.col("event_id"), F.lit(', "named": -0.5, {"deep": [true, null]},],},}'))
    nodes = J.json_parse(t.events.select(F.col("event_id").alias("k"), doc.alias("doc")), "doc")
    return nodes.filter("node_path = '/-/a/list/'").select("k", F.col("node_index").cast("bigint").alias("node_index"), "value_type", "val", "name")


@query("SELECT n_nationkey AS k, n_name || ' — ünïcode' AS v FROM nation")
def utf16_round_trip(t):
    text = F.concat("n_name", F.lit(" — ünïcode"))
    return t.nation.select(F.col("n_nationkey").alias("k"), F.decode(F.substr(T.utf8_to_utf16(F.encode(text, "UTF-8"))["data"], F.lit(3)), "UTF-16LE").alias("v"))


@query("SELECT c_custkey AS k, 'ИСК' || regexp_replace(c_name, '[^A-Z0-9]', '', 'g') AS v FROM customer")
def abbreviate_cyrillic(t):
    return t.customer.select(F.col("c_custkey").alias("k"), T.abbreviate(F.concat(F.lit("Иванов СКазов "), "c_name")).alias("v"))


@query("SELECT event_id AS k, strftime(date_trunc('second', ts), '%Y-%m-%d') AS day, CAST(CAST(round(second(ts) + (epoch_us(ts) % 1000000) / 1e6) AS INT) AS VARCHAR) AS secs FROM events")
def format_date_rounded(t):
    return t.events.select(F.col("event_id").alias("k"), TY.format_date("ts", "yyyy-MM-dd", round_seconds=True).alias("day"), TY.format_date("ts", "s", round_seconds=True).alias("secs"))


# Files


@query("SELECT n_nationkey, n_name, 25 AS n FROM nation")
def published(t):
    """Published twice to the same path, read back by readers of the path."""
    path = f"{G.shared_folder(t.spark)}/sparloom-published-{uuid.uuid4().hex}"
    S.publish(t.nation.select("n_nationkey", "n_name").limit(3), path)
    n, _ = S.publish(t.nation.select("n_nationkey", "n_name"), path)
    return t.spark.read.parquet(path).withColumn("n", F.lit(n))


@query("SELECT path FROM (SELECT o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n >= 3")
def expired_by_group(t):
    return S.expired(t.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), F.col("o_custkey").alias("g")), 3, "g").select("path")


@query("SELECT path FROM (SELECT o_orderkey AS path, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n >= 10")
def expired_of_all(t):
    return S.expired(t.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime")), 10).select("path")


@query("SELECT 'T' || n_nationkey AS table_name, n_nationkey * 10 AS records_count, n_nationkey + 1 AS pages_count FROM nation")
def size_report(t):
    n = F.col("n_nationkey")
    lines = F.array(F.concat(F.lit("T"), n, F.lit(" ("), n + 128, F.lit(")")), F.concat(F.lit("    Average record length: 9, total records: "), n * 10), F.concat(F.lit("    Data pages: "), n + 1, F.lit(", average fill: 70%")), F.lit(""))
    return S.size_report_of(t.nation.select(F.lit("r").alias("file"), n.alias("at"), F.posexplode(lines).alias("i", "line")).select("file", (F.col("at") * 10 + F.col("i")).alias("n"), "line"))


@query("SELECT event_id AS k, CAST(event_id AS VARCHAR) AS val FROM events")
def xml_nested_value(t):
    doc = F.concat(F.lit("<a><b><c x=\"1\">"), F.col("event_id"), F.lit("</c></b><c2>no</c2></a>"))
    nodes = X.xml_all_nodes(t.events.select(F.col("event_id").alias("k"), doc.alias("doc")), "doc")
    return nodes.filter("name = 'c'").select("k", F.col("content").alias("val"))
