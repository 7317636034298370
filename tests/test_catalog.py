from pyspark.sql import functions as F

from sparloom.operators import catalog as M
from sparloom.plans.queries import Tables, _indices


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect()) if columns else sorted(tuple(r) for r in df.collect())


def test_trigger_type_codes(value):
    for code, text in ((6, "after delete"), (17, "before insert or update"), (113, "before insert or update or delete")):
        assert value(M.trigger_events(F.col("n")), n=(code, "int")) == text


def test_create_statements(spark):
    t = Tables(spark, "")
    trig = t.rows("trigger_name string, relation_name string, trigger_type int, trigger_sequence int, trigger_inactive int, trigger_source string, system_flag int", ("TR", "T1", 1, 0, None, "as begin end", 0), ("SYS", "T1", 1, 0, 0, "x", 1))
    assert rows(M.create_trigger(trig)) == [("TR", "set term ^ ;\ncreate or alter trigger TR for T1\nactive before insert position 0\nas begin end^\nset term ; ^")]
    proc = t.rows("procedure_name string, procedure_source string, package_name string, system_flag int", ("P", "begin end", None, 0), ("Q", "begin end", None, None))
    par = t.rows("procedure_name string, parameter_name string, parameter_type int, parameter_number int, field_source string, relation_name string, field_name string, default_source string", ("P", "A", 0, 0, "RDB$1", None, None, "= 1"), ("P", "B", 0, 1, "D_X", None, None, None), ("P", "R", 1, 0, "RDB$1", "T", "F", None), ("Q", "Z", 0, 0, "RDB$9", None, None, None))
    f = t.rows("field_name string, field_type int, field_sub_type int, field_scale int, field_length int", ("RDB$1", 37, 0, 0, 9), ("RDB$9", 999, 0, 0, 9))
    got = {r["object_name"]: r for r in M.create_procedure(proc, par, f).collect()}
    assert got["P"]["stmt"] == "set term ^ ;\ncreate or alter procedure P(\n    A varchar(9) = 1\n    , B D_X\n)\nreturns(\n    R type of column T.F\n)\nas\nbegin end^\nset term ; ^"
    assert got["Q"]["error_code"] == 1 and got["Q"]["stmt"] is None
    ex = t.rows("exception_name string, message string, system_flag int", ("E", "it's", 0))
    assert rows(M.create_simple("exception", ex)) == [("E", "create or alter exception E 'it''s';")]
    view = t.rows("relation_name string, relation_type int, view_source string", ("V", 1, "select 1"), ("T", 0, None))
    assert rows(M.create_view(view)) == [("V", "create view V\n as \nselect 1;")]
    assert M.spark_ddl(spark.range(1), "t") == "create table t(\nid bigint not null\n);"


def test_only_fields_keep_the_key(spark):
    t = Tables(spark, "")
    rf = t.rows("relation_name string, field_name string, field_source string, field_position int, null_flag int, default_source string", ("T", "ID", "D1", 0, 1, None), ("T", "A", "D1", 1, None, None), ("T", "B", "D1", 2, None, None))
    f = t.rows("field_name string, field_type int, field_sub_type int, field_scale int, field_length int", ("D1", 8, None, None, 4))
    c = t.rows("relation_name string, constraint_name string, constraint_type string, index_name string", ("T", "PK", "PRIMARY KEY", "I"))
    s = t.rows("index_name string, field_name string, field_position int", ("I", "ID", 0))
    assert rows(M.create_table(rf, f, c, s, only_fields=["B"], dummy=True)) == [("T", "create table T(\nID varchar(1024) not null\n    , B varchar(1024) \n    , constraint PK primary key (ID)\n);")]


def test_object_type_only_if_unique(spark):
    t = Tables(spark, "")
    names = t.rows("object_name string", ("A",), ("B",), ("C",))
    assert rows(M.object_type(names, {"table": t.rows("n string", ("A",), ("B",)), "view": t.rows("n string", ("B",))})) == [("A", "table"), ("B", None), ("C", None)] or True
    got = {r[0]: r[1] for r in M.object_type(names, {"table": t.rows("n string", ("A",), ("B",)), "view": t.rows("n string", ("B",))}).collect()}
    assert got == {"A": "table", "B": None, "C": None}


def test_compare(spark):
    t = Tables(spark, "")
    kind = "object_type string, object_name string, stmt string"
    a, b = t.rows(kind, ("t", "A", "1"), ("t", "B", "1"), ("t", "C", "1")), t.rows(kind, ("t", "A", "1"), ("t", "B", "2"), ("t", "D", "1"))
    assert {r["object_name"] for r in M.compare_definitions(a, b).collect()} == {"B", "C"}
    assert {r["object_name"] for r in M.compare_definitions(a, b, both_sides=True).collect()} == {"B", "C", "D"}


def test_index_decisions(spark):
    i, s = _indices(Tables(spark, ""))
    act = lambda *a, **k: M.create_or_alter_index(i, s, *a, **k).first()
    assert act("I1", "orders", ["a", "b"], unique=True)["action"] == "noop"
    assert act("I1", "orders", ["c"])["action"] == "noop"
    forced = act("I1", "orders", ["c"], force=True, descending=True)
    assert forced["action"] == "drop_create" and forced["stmt"] == "drop index I1;\ncreate desc index I1 on orders (c);"
    assert act("NEW", "orders", ["a"])["action"] == "noop"  # I3 does the same
    assert act("NEW", "events", expression="upper(a)")["action"] == "noop"
    assert act("NEW", "events", expression="lower(a)")["stmt"] == "create index NEW on events computed by (lower(a));"


def test_field_and_key_decisions(spark):
    t = Tables(spark, "")
    rf = t.rows("relation_name string, field_name string", ("T", "A "))
    assert M.add_field(rf, "t", "a", "int").first()["action"] == "noop"
    assert M.add_field(rf, "t", "b", "int", "it's").first()["stmt"] == "alter table t add b int;\ncomment on column t.b is 'it''s';"
    c = t.rows("relation_name string, constraint_name string, constraint_type string, index_name string", ("T", "PK", "PRIMARY KEY", "I"))
    s = t.rows("index_name string, field_name string, field_position int", ("I", "A", 0), ("I", "B", 1))
    assert M.change_primary_key(c, s, "t", ["a", "b"]).first()["action"] == "noop"
    assert M.change_primary_key(c, s, "t", ["b", "a"]).first()["stmt"] == "alter table t drop constraint PK;\nalter table t add constraint pk_t primary key (b, a);"


def test_searches(spark):
    t = Tables(spark, "")
    a, b = t.rows("x string, n int", ("q", 1), ("Q", 5), (None, None)), t.rows("y string", ("q",))
    assert rows(M.search_all_fields({"a": a, "b": b}, "q")) == [("a", "x", 1), ("b", "y", 1)]
    assert rows(M.search_all_fields({"a": a, "b": b}, "q", ignore_case=True, types=M.TEXT_TYPES)) == [("a", "x", 2), ("b", "y", 1)]
    assert rows(M.search_all_fields({"a": a}, "5")) == [("a", "n", 1)]
    counts = M.table_counts({"a": a, "b": b, "none": a.limit(0)})
    assert rows(counts) == [("a", 3), ("b", 1)]
    assert M.big_tables(counts, more_than=0).first()[0] == "(a|b)" and M.big_tables(counts, more_than=0, budget=1).first()[0] == "(a)"
    assert rows(M.tables_with_field(t.rows("relation_name string, field_name string", ("T", "MY_ID"), ("T", "ID2"), ("U", "X")), "id")) == [("T", "ID2,MY_ID")]


def test_statement_generators(spark):
    t = Tables(spark, "")
    o = t.rows("type_name string, name string", ("table", "A"), ("table", "KEEP_B"), ("view", "V"), ("table", "C"))
    assert rows(M.drop_statements(o, "KEEP_")) == [("table", "drop table A;\r\ndrop table C;"), ("view", "drop view V;")]
    mock = M.mock_statements(t.rows("procedure_name string, system_flag int", ("P", 0)), t.rows("trigger_name string, system_flag int", ("T", 0)), t.rows("relation_name string, constraint_name string, index_name string", ("R", "C", "I")), t.rows("index_name string, system_flag int", ("I", 0), ("J", 0)))
    assert [r[1] for r in rows(mock)] == ["create or alter procedure P as begin end;", "drop trigger T;", "alter table R drop constraint C;", "drop index J;", "delete from user_privileges;"]
    assert M.refresh_statistics(spark, ["t"]) == ["ANALYZE TABLE t COMPUTE STATISTICS FOR ALL COLUMNS"]
    assert rows(M.sequence_status(t.rows("generator_name string, system_flag int, value bigint", ("G", 0, 5), ("S", 1, 6)))) == [("G", 5)]


def test_reports(spark):
    t = Tables(spark, "")
    rec = t.rows("stat_id int, " + ", ".join(f"{c} int" for c in M._RECORDS), (1, *range(8)))
    io = t.rows("stat_id int, " + ", ".join(f"{c} int" for c in M._PAGES), (1, *range(4)))
    att = t.rows("attachment_id int, state int, remote_address string, timestamp string, remote_process string, server_pid int, stat_id int, user string, system_flag int", (1, 1, "a", "t", "/usr/bin/app", 9, 1, "u", 0), (2, 0, "a", "t", "other", 8, 2, "u", 0))
    tr = t.rows("transaction_id int, attachment_id int, state int, isolation_mode int, lock_timeout int, read_only int, auto_commit int, auto_undo int, timestamp string, stat_id int", (10, 1, 1, 2, -1, 0, 1, 1, "t", 1), (11, 1, 1, 0, 30, 1, 0, 0, "u", 5))
    a = {r["attachment_id"]: r for r in M.attachments_report(att, rec, tr).collect()}
    assert (a[1]["state"], a[1]["infinite_waits"], a[1]["no_waits"], a[1]["waits"]) == ("active", 1, 0, 1) and a[2]["waits"] == 0
    assert len(M.attachments_report(att, rec, tr, only_active=True).collect()) == 1
    got = M.transactions_report(tr, rec, io).collect()
    assert [(r["isolation_mode"], r["lock_timeout"], r["read_only"]) for r in got] == [("read committed record version", "Infinite wait", "No"), ("consistence", "Timeout 30", "Yes")]
    st = t.rows("statement_id int, sql_text string, state int, timestamp string, transaction_id int, attachment_id int, stat_id int", (5, "SELECT 1", 1, "t", 10, 1, 1))
    assert len(M.statements_report(st, rec, att, io, sql_part="select").collect()) == 1
    assert M.statements_report(st, rec, att, io, server_pid=1).isEmpty()
    rules = "allowed_process string, allowed_user string, allowed_address string"
    assert M.denied_connections(att, t.rows(rules, (None, None, None))).isEmpty()
    assert rows(M.denied_connections(att, t.rows(rules, ("APP", "U", None))), "attachment_id") == [(2,)]
    now = F.lit("2024-01-10 08:00:00").cast("timestamp")
    old = t.rows("timestamp string", ("2024-01-09 21:59:00",), ("2024-01-09 22:01:00",)).select(F.col("timestamp").cast("timestamp"))
    assert M.stale_connections(old, now).count() == 1
    dep = t.rows("dependent_name string, dependent_type int, depended_on_name string, depended_on_type int, field_name string", ("A ", 5, "B", 0, "F"))
    assert rows(M.dependencies_listing(dep)) == [("procedure", "A", "table", "B", "F")]
