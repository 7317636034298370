"""Analytics over catalog tables (plain DataFrames), and statement generators.

Nothing is ever executed: generators return statement text, decisions return an action and text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Type and object codes with their names.
FIELD_TYPES = {7: "smallint", 8: "integer", 10: "float", 12: "date", 13: "time", 14: "char", 16: "bigint", 23: "boolean", 27: "double precision", 35: "timestamp", 37: "varchar", 261: "blob"}
OBJECT_TYPES = {0: "table", 1: "view", 2: "trigger", 3: "computed_field", 4: "validation", 5: "procedure", 7: "exception", 8: "user", 9: "domain", 10: "index", 11: "generator", 14: "External Functions", 15: "Encryption"}
PRIVILEGES = {"S": "SELECT", "D": "DELETE", "I": "INSERT", "U": "UPDATE", "R": "REFERENCE", "T": "DECRYPT", "E": "ENCRYPT", "B": "SUBSCRIBE", "X": "EXECUTE", "Z": "TRUNCATE", "M": "MEMBER OF (for roles)"}
TEXT_TYPES = ("string", "char", "varchar")


def label(code: Column | str, names: dict, otherwise: Column | None = None) -> Column:
    """The name of a code; null, or `otherwise`, for an unknown one."""
    c = F.col(code) if isinstance(code, str) else code
    out = functools.reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])) if acc is None else acc.when(c == kv[0], F.lit(kv[1])), names.items(), None)
    return out if otherwise is None else out.otherwise(otherwise)


def user_rows(df: DataFrame) -> DataFrame:
    """Without system objects."""
    return df.filter(F.coalesce("system_flag", F.lit(0)) == 0)


def type_text(type_code: str = "field_type", length: str = "field_length", sub_type: str = "field_sub_type", scale: str = "field_scale", precision: str | None = None) -> Column:
    """A field's type as DDL, lengths of characters and precision of decimals included."""
    number = F.when(F.col(sub_type) == 1, "numeric").when(F.col(sub_type) == 2, "decimal")
    size = F.lit(18) if precision is None else F.col(precision)
    exact = F.concat(number, F.lit("("), size.cast("string"), F.lit(", "), (-F.coalesce(scale, F.lit(0))).cast("string"), F.lit(")"))
    plain = F.concat(label(type_code, FIELD_TYPES), F.when(F.col(type_code).isin(14, 37), F.concat(F.lit("("), F.col(length).cast("string"), F.lit(")"))).otherwise(""))
    return F.when(F.col(type_code).isin(7, 8, 16) & F.col(sub_type).isin(1, 2), exact).otherwise(plain)


def _listed(value: Column, order: Column, sep: str) -> Column:
    """Values in order, joined; an aggregate over one object's few parts."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def primary_keys(constraints: DataFrame, segments: DataFrame) -> DataFrame:
    """(relation_name, constraint_name, field_name, field_position)."""
    keys = constraints.filter(F.contains(F.lower("constraint_type"), F.lit("primary key")))
    return keys.join(segments, "index_name").select("relation_name", "constraint_name", "field_name", "field_position")


def create_table(relation_fields: DataFrame, fields: DataFrame, constraints: DataFrame, segments: DataFrame, only_fields: list[str] | None = None, dummy: bool = False) -> DataFrame:
    """(object_name, stmt): create table statements. only_fields keeps those and primary-key fields;
    dummy makes every field a varchar(1024)."""
    pk = primary_keys(constraints, segments)
    f = relation_fields.join(fields.select(F.col("field_name").alias("field_source"), "field_type", "field_sub_type", "field_scale", "field_length"), "field_source", "left")
    if only_fields is not None:
        in_pk = f.join(pk.select("relation_name", "field_name"), ["relation_name", "field_name"], "left_semi")
        f = f.filter(F.col("field_name").isin(only_fields)).unionByName(in_pk).distinct()
    own = F.lit("varchar(1024)") if dummy else F.when(F.startswith("field_source", F.lit("RDB$")), type_text()).otherwise(F.col("field_source"))
    line = F.concat(F.trim("field_name"), F.lit(" "), F.trim(own), F.lit(" "), F.trim(F.concat(F.coalesce(F.trim("default_source"), F.lit("")), F.when(F.col("null_flag") == 1, " not null").otherwise(""))), F.lit("\n"))
    body = f.groupBy("relation_name").agg(_listed(line, F.col("field_position"), "    , ").alias("body"))
    keys = pk.groupBy("relation_name", "constraint_name").agg(_listed(F.trim("field_name"), F.col("field_position"), "    , ").alias("names"))
    keys = keys.groupBy("relation_name").agg(F.min(F.concat(F.lit("    , constraint "), F.trim("constraint_name"), F.lit(" primary key ("), "names", F.lit(")\n"))).alias("pk"))
    stmt = F.concat(F.lit("create table "), F.trim("relation_name"), F.lit("(\n"), "body", F.coalesce("pk", F.lit("")), F.lit(");"))
    return body.join(keys, "relation_name", "left").select(F.trim("relation_name").alias("object_name"), stmt.alias("stmt"))


def create_view(relations: DataFrame) -> DataFrame:
    views = relations.filter(F.col("relation_type") == 1)
    return views.select(F.trim("relation_name").alias("object_name"), F.concat(F.lit("create view "), F.trim("relation_name"), F.lit("\n as \n"), "view_source", F.lit(";")).alias("stmt"))


def trigger_events(trigger_type: Column) -> Column:
    """before or after, and up to three events, from the packed type code."""
    packed = trigger_type + 1
    when = F.when(packed.bitwiseAND(1) == 0, "before").otherwise("after")
    events = [label(F.shiftright(packed, 2 * i + 1).bitwiseAND(3), {1: "insert", 2: "update", 3: "delete"}) for i in range(3)]
    return F.concat(when, F.lit(" "), F.concat_ws(" or ", *events))


def create_trigger(triggers: DataFrame, dummy: bool = False) -> DataFrame:
    t = user_rows(triggers)
    head = F.concat(F.lit("create or alter trigger "), F.trim("trigger_name"), F.lit(" for "), F.trim("relation_name"), F.lit("\n"), F.when(F.coalesce("trigger_inactive", F.lit(0)) > 0, "inactive").otherwise("active"), F.lit(" "), trigger_events(F.col("trigger_type")), F.lit(" position "), F.col("trigger_sequence").cast("string"), F.lit("\n"))
    body = F.lit("as\nbegin\nend") if dummy else F.col("trigger_source")
    return t.select(F.trim("trigger_name").alias("object_name"), F.concat(F.lit("set term ^ ;\n"), head, body, F.lit("^\nset term ; ^")).alias("stmt"))


def create_procedure(procedures: DataFrame, parameters: DataFrame, fields: DataFrame, dummy: bool = False) -> DataFrame:
    """(object_name, stmt, error_code, error_text); code 1 for a parameter of unsupported type."""
    own = user_rows(procedures).filter("package_name is null")
    info = fields.select(F.col("field_name").alias("field_source"), "field_type", "field_sub_type", "field_scale", "field_length")
    p = parameters.join(info, "field_source", "left")
    kind = F.coalesce(F.concat(F.lit("type of column "), F.trim("relation_name"), F.lit("."), F.trim("field_name")), F.when(F.startswith("field_source", F.lit("RDB$")), type_text()).otherwise(F.col("field_source")))
    line = F.concat(F.trim("parameter_name"), F.lit(" "), F.coalesce(kind, F.lit("?")), F.coalesce(F.concat(F.lit(" "), F.trim("default_source")), F.lit("")), F.lit("\n"))
    lists = p.groupBy("procedure_name", "parameter_type").agg(_listed(line, F.col("parameter_number"), "    , ").alias("body"), F.max(kind.isNull()).alias("bad"))
    side = lambda t, head: lists.filter(F.col("parameter_type") == t).select("procedure_name", F.concat(F.lit(head + "(\n    "), "body", F.lit(")\n")).alias(f"side{t}"), F.col("bad").alias(f"bad{t}"))
    out = own.join(side(0, ""), "procedure_name", "left").join(side(1, "returns"), "procedure_name", "left")
    bad = F.coalesce("bad0", F.lit(False)) | F.coalesce("bad1", F.lit(False))
    body = F.lit("as\nbegin\nend") if dummy else F.concat(F.lit("as\n"), "procedure_source")
    stmt = F.concat(F.lit("set term ^ ;\ncreate or alter procedure "), F.trim("procedure_name"), F.coalesce("side0", F.lit("\n")), F.coalesce("side1", F.lit("")), body, F.lit("^\nset term ; ^"))
    return out.select(F.trim("procedure_name").alias("object_name"), F.when(~bad, stmt).alias("stmt"), bad.cast("int").alias("error_code"), F.when(bad, "unsupported field type").otherwise("").alias("error_text"))


def create_simple(kind: str, df: DataFrame) -> DataFrame:
    """create exception, sequence or domain statements."""
    if kind == "exception":
        return user_rows(df).select(F.trim("exception_name").alias("object_name"), F.concat(F.lit("create or alter exception "), F.trim("exception_name"), F.lit(" '"), F.replace("message", F.lit("'"), F.lit("''")), F.lit("';")).alias("stmt"))
    if kind == "sequence":
        return user_rows(df).select(F.trim("generator_name").alias("object_name"), F.concat(F.lit("create sequence "), F.trim("generator_name"), F.lit(";")).alias("stmt"))
    own = user_rows(df).filter(~F.startswith("field_name", F.lit("RDB$")))
    return own.select(F.trim("field_name").alias("object_name"), F.concat(F.lit("create domain "), F.trim("field_name"), F.lit(" as "), type_text(), F.coalesce(F.concat(F.lit(" "), F.trim("default_source")), F.lit("")), F.when(F.col("null_flag") == 1, " not null").otherwise(""), F.lit(";")).alias("stmt"))


def object_type(names: DataFrame, catalogs: dict[str, DataFrame]) -> DataFrame:
    """(object_name, object_type): the type of each name that exactly one catalog has, else null.

    catalogs: type -> DataFrame whose first column holds names.
    """
    every = functools.reduce(DataFrame.unionByName, [df.select(F.trim(df.columns[0]).alias("object_name"), F.lit(t).alias("object_type")) for t, df in catalogs.items()])
    one = every.groupBy("object_name").agg(F.max("object_type").alias("object_type"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return names.join(one, "object_name", "left")


def spark_ddl(df: DataFrame, name: str) -> str:
    """The create statement of a DataFrame's schema, in Spark's own types."""
    lines = [f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in df.schema.fields]
    return f"create table {name}(\n" + "    , ".join(x + "\n" for x in lines) + ");"


def compare_definitions(local: DataFrame, remote: DataFrame, both_sides: bool = False) -> DataFrame:
    """(object_type, object_name, local_stmt, remote_stmt) where the definitions differ; objects that
    only the remote has are not visited unless both_sides."""
    key = ["object_type", "object_name"]
    a, b = local.select(*key, F.col("stmt").alias("local_stmt")), remote.select(*key, F.col("stmt").alias("remote_stmt"))
    return a.join(b, key, "full" if both_sides else "left").filter(~F.col("local_stmt").eqNullSafe(F.col("remote_stmt")))


def index_lists(indices: DataFrame, segments: DataFrame) -> DataFrame:
    """Indices with the list of their fields, or their expression, and mean field statistics."""
    s = segments.groupBy("index_name").agg(_listed(F.trim("field_name"), F.col("field_position"), ",").alias("by_fields"), F.avg("statistics").alias("mean"))
    i = indices.join(s, "index_name", "left")
    return i.select(
        F.trim("relation_name").alias("table_name"), F.trim("index_name").alias("index_name"), F.coalesce("unique_flag", F.lit(0)).alias("is_uniq"), F.coalesce("index_inactive", F.lit(0)).alias("is_inactive"),
        F.coalesce("index_type", F.lit(0)).alias("is_desc"), F.coalesce("system_flag", F.lit(0)).alias("system_flag"),
        F.when(F.col("segment_count") == 0, F.col("expression_source")).otherwise(F.col("by_fields")).alias("fields_list"), F.when(F.col("segment_count") == 0, indices["statistics"]).otherwise(F.col("mean")).alias("index_statistics"),
    )


def duplicated_indices(indices: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs of indices of a table with the same fields, uniqueness and direction, where the other's
    statistics are no better (d_ columns)."""
    i = index_lists(indices, segments)
    key = ["table_name", "fields_list", "is_uniq", "is_desc"]
    other = i.select(*key, *[F.col(c).alias(f"d_{c}") for c in ("index_name", "is_inactive", "index_statistics")])
    pairs = i.filter("system_flag = 0").join(other, key).filter("index_name <> d_index_name and d_index_statistics >= index_statistics")
    return pairs.select("table_name", "index_name", "fields_list", "is_uniq", "is_desc", "is_inactive", "index_statistics", "d_index_name", "d_is_inactive", "d_index_statistics")


def tables_without_key(relations: DataFrame, constraints: DataFrame) -> DataFrame:
    """User tables with neither primary key nor unique constraint."""
    keys = constraints.filter(F.upper(F.trim("constraint_type")).isin("PRIMARY KEY", "UNIQUE")).select("relation_name").distinct()
    return user_rows(relations).filter(F.coalesce("relation_type", F.lit(0)) == 0).join(keys, "relation_name", "left_anti").select(F.trim("relation_name").alias("relation_name"))


def tables_with_field(relation_fields: DataFrame, part: str) -> DataFrame:
    """(relation_name, fields): tables with fields whose name contains `part`, whatever its case."""
    f = relation_fields.filter(F.contains(F.lower("field_name"), F.lit(part.lower())))
    return f.groupBy(F.trim("relation_name").alias("relation_name")).agg(_listed(F.trim("field_name"), F.trim("field_name"), ",").alias("fields"))


def dependencies_listing(dependencies: DataFrame) -> DataFrame:
    return dependencies.select(label("dependent_type", OBJECT_TYPES).alias("master_type"), F.trim("dependent_name").alias("master_name"), label("depended_on_type", OBJECT_TYPES).alias("slave_type"), F.trim("depended_on_name").alias("slave_name"), "field_name")


# Grant templates with the object types and privilege they are for.
GRANTS = [
    ("GRANT SELECT ON <obj> TO USER <user>;", ("table", "view"), "S"),
    ("GRANT INSERT ON <obj> TO USER <user>;", ("table",), "I"),
    ("GRANT UPDATE ON <obj> TO USER <user>;", ("table",), "U"),
    ("GRANT EXECUTE PROCEDURE <obj> TO USER <user>;", ("procedure",), "X"),
]


def missing_grants(users: DataFrame, objects: DataFrame, privileges: DataFrame) -> DataFrame:
    """(user_name, type_name, name, privilege, stmt): what each user lacks.

    users: user_name, meant to be few (the product with all objects is the result's own size);
    objects: (type_name, name); privileges: (user, relation_name, privilege).
    """
    templates = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(k).alias("type_name"), F.lit(p).alias("privilege")) for t, kinds, p in GRANTS for k in kinds])
    wanted = objects.select("*", F.explode(F.filter(templates, lambda t: t["type_name"] == F.col("type_name"))).alias("t")).select("type_name", "name", "t.template", "t.privilege")
    every = wanted.crossJoin(users.select("user_name"))
    have = privileges.select(F.trim("user").alias("user_name"), F.trim("relation_name").alias("name"), F.trim("privilege").alias("privilege")).distinct()
    lacking = every.join(have, ["user_name", "name", "privilege"], "left_anti")
    stmt = F.replace(F.replace("template", F.lit("<obj>"), F.trim("name")), F.lit("<user>"), F.trim("user_name"))
    return lacking.select("user_name", "type_name", "name", "privilege", stmt.alias("stmt"))


def table_counts(tables: dict[str, DataFrame], only_filled: bool = True) -> DataFrame:
    """(table_name, cnt), one count per table in one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(n).alias("table_name"), "cnt") for n, df in tables.items()]
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.filter("cnt > 0") if only_filled else out


def big_tables(counts: DataFrame, more_than: int = 10_000, budget: int = 4_000) -> DataFrame:
    """(skip_data): "(A|B)" of the tables with more rows than more_than, by name, ending before the
    first that would exceed the budget of characters. One row per database's tables."""
    w = Window.orderBy("table_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = counts.filter(F.col("cnt") > more_than).withColumn("used", F.sum(F.length("table_name")).over(w) + F.greatest(F.row_number().over(Window.orderBy("table_name")) - 2, F.lit(0)))
    return big.filter(F.col("used") <= budget).agg(F.concat(F.lit("("), _listed(F.col("table_name"), F.col("table_name"), "|"), F.lit(")")).alias("skip_data"))


def search_all_fields(tables: dict[str, DataFrame], value: str, ignore_case: bool = False, types: tuple[str, ...] | None = None) -> DataFrame:
    """(table_name, field_name, cnt): where a value stands, as text, in fields of the given types
    (all if None). One scan per table."""
    out = []
    for name, df in tables.items():
        chosen = [f.name for f in df.schema.fields if types is None or f.dataType.typeName() in types]
        if not chosen:
            continue
        same = lambda c: (F.upper(c) == value.upper()) if ignore_case else (c == value)
        counts = df.agg(*[F.count_if(same(df[c].cast("string"))).alias(c) for c in chosen])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("cnt")) for c in chosen]))
        out.append(counts.select(F.lit(name).alias("table_name"), pairs.alias("x")).select("table_name", "x.field_name", "x.cnt").filter("cnt > 0"))
    return functools.reduce(DataFrame.unionByName, out)


def sequence_status(generators: DataFrame, name: str | None = None) -> DataFrame:
    g = user_rows(generators)
    if name is not None:
        g = g.filter(F.trim("generator_name") == name)
    return g.select(F.trim("generator_name").alias("sequence_name"), "value")


def drop_statements(objects: DataFrame, keep_prefix: str | None = None) -> DataFrame:
    """(type_name, stmts): drop statements by object type, names in order; objects whose name starts
    with keep_prefix stay. objects: (type_name, name)."""
    o = objects.filter(~F.startswith("name", F.lit(keep_prefix))) if keep_prefix else objects
    stmt = F.concat(F.lit("drop "), "type_name", F.lit(" "), F.trim("name"), F.lit(";"))
    return o.distinct().groupBy("type_name").agg(_listed(stmt, F.trim("name"), "\r\n").alias("stmts"))


def mock_statements(procedures: DataFrame, triggers: DataFrame, constraints: DataFrame, indices: DataFrame) -> DataFrame:
    """(step, stmt): what reduces a database to a mock: procedures emptied, then triggers, constraints
    and indices dropped, then grants purged."""
    own = user_rows(procedures).select(F.lit(1).alias("step"), F.concat(F.lit("create or alter procedure "), F.trim("procedure_name"), F.lit(" as begin end;")).alias("stmt"))
    drop = lambda step, df, what, name: df.select(F.lit(step).alias("step"), F.concat(F.lit(what), F.trim(name), F.lit(";")).alias("stmt"))
    kept = constraints.filter("index_name is not null").select("index_name")
    return functools.reduce(
        DataFrame.unionByName,
        [
            own,
            drop(2, user_rows(triggers), "drop trigger ", "trigger_name"),
            constraints.select(F.lit(3).alias("step"), F.concat(F.lit("alter table "), F.trim("relation_name"), F.lit(" drop constraint "), F.trim("constraint_name"), F.lit(";")).alias("stmt")),
            drop(4, user_rows(indices).join(kept, "index_name", "left_anti"), "drop index ", "index_name"),
            procedures.sparkSession.createDataFrame([(5, "delete from user_privileges;")], "step int, stmt string"),
        ],
    )


def refresh_statistics(spark: SparkSession, tables: list[str]) -> list[str]:
    """Statements that refresh the statistics of saved tables."""
    return [f"ANALYZE TABLE {t} COMPUTE STATISTICS FOR ALL COLUMNS" for t in tables]


def create_or_alter_index(indices: DataFrame, segments: DataFrame, name: str, table: str, fields: list[str] | None = None, expression: str | None = None, unique: bool = False, descending: bool = False, force: bool = False) -> DataFrame:
    """(action, stmt): noop if the index exists as asked, if its name is taken and force is off, or
    if another index of the table does the same; else drop and create, or create."""
    listed = ",".join(f.strip().upper() for f in fields) if fields else f"({expression.strip().upper()})"
    existing = index_lists(indices, segments).filter("system_flag = 0").withColumn("same", (F.upper("table_name") == table.upper()) & (F.col("is_uniq") == int(unique)) & (F.col("is_desc") == int(descending)) & (F.upper("fields_list") == listed))
    mine = F.upper("index_name") == name.upper()
    state = existing.agg(F.max(F.when(mine, 1).otherwise(0)).alias("named"), F.max(F.when(mine & F.col("same"), 1).otherwise(0)).alias("equal"), F.max(F.when(~mine & F.col("same"), 1).otherwise(0)).alias("other"))
    words = ["create", *(["unique"] if unique else []), *(["desc"] if descending else []), f"index {name} on {table}", *(["computed by"] if expression else []), f"({expression or ', '.join(fields)})"]
    taken = F.coalesce("named", F.lit(0)) == 1
    noop = (F.coalesce("equal", F.lit(0)) == 1) | (taken & F.lit(not force)) | (F.coalesce("other", F.lit(0)) == 1)
    create = " ".join(words) + ";"
    return state.select(F.when(noop, "noop").when(taken, "drop_create").otherwise("create").alias("action"), F.when(noop, "").when(taken, f"drop index {name};\n{create}").otherwise(create).alias("stmt"))


def add_field(relation_fields: DataFrame, table: str, field: str, type_: str, description: str = "") -> DataFrame:
    """(action, stmt): adds a field unless the table has it."""
    there = relation_fields.filter((F.upper(F.trim("relation_name")) == table.upper()) & (F.upper(F.trim("field_name")) == field.upper())).agg((F.count(F.lit(1)) > 0).alias("there"))
    comment = f"\ncomment on column {table}.{field} is '{description.replace(chr(39), chr(39) * 2)}';" if description else ""
    return there.select(F.when(F.col("there"), "noop").otherwise("add").alias("action"), F.when(F.col("there"), "").otherwise(f"alter table {table} add {field} {type_};{comment}").alias("stmt"))


def change_primary_key(constraints: DataFrame, segments: DataFrame, table: str, fields: list[str], name: str | None = None) -> DataFrame:
    """(action, stmt): replaces a table's primary key unless it has just these fields in this order."""
    pk = primary_keys(constraints, segments).filter(F.upper(F.trim("relation_name")) == table.upper())
    now = pk.agg(_listed(F.upper(F.trim("field_name")), F.col("field_position"), ",").alias("fields"), F.max(F.trim("constraint_name")).alias("name"))
    same = F.col("fields") == ",".join(f.upper() for f in fields)
    drop = F.coalesce(F.concat(F.lit(f"alter table {table} drop constraint "), "name", F.lit(";\n")), F.lit(""))
    add = f"alter table {table} add constraint {name or 'pk_' + table} primary key ({', '.join(fields)});"
    return now.select(F.when(same, "noop").otherwise("change").alias("action"), F.when(same, "").otherwise(F.concat(drop, F.lit(add))).alias("stmt"))


# Reports over monitoring tables

_RECORDS = ["record_seq_reads", "record_idx_reads", "record_inserts", "record_updates", "record_deletes", "record_backouts", "record_purges", "record_expunges"]
_PAGES = ["page_reads", "page_writes", "page_fetches", "page_marks"]


def attachments_report(attachments: DataFrame, record_stats: DataFrame, transactions: DataFrame, only_active: bool = False) -> DataFrame:
    """A row per attachment, with its started transactions counted by how they wait for locks."""
    a = attachments.filter("state = 1") if only_active else attachments
    t = transactions.filter("state = 1").groupBy("attachment_id").agg(
        F.count_distinct(F.when(F.col("lock_timeout") == -1, F.col("transaction_id"))).alias("infinite_waits"), F.count_distinct(F.when(F.col("lock_timeout") == 0, F.col("transaction_id"))).alias("no_waits"), F.count_distinct(F.when(F.col("lock_timeout") > 0, F.col("transaction_id"))).alias("waits")
    )
    out = a.join(record_stats, "stat_id", "left").join(t, "attachment_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("infinite_waits", "no_waits", "waits")]
    stmt = F.concat(F.lit("delete from attachments where attachment_id = "), F.col("attachment_id").cast("string"))
    return out.select("attachment_id", label("state", {0: "idle", 1: "active"}, F.col("state").cast("string")).alias("state"), "remote_address", "timestamp", "remote_process", *_RECORDS, *zero, stmt.alias("delete_stmt"))


def transactions_report(transactions: DataFrame, record_stats: DataFrame, io_stats: DataFrame) -> DataFrame:
    yes = lambda c: label(c, {0: "No", 1: "Yes"}).alias(c)
    wait = F.when(F.col("lock_timeout") == -1, "Infinite wait").when(F.col("lock_timeout") == 0, "No wait").when(F.col("lock_timeout") > 0, F.concat(F.lit("Timeout "), F.col("lock_timeout").cast("string")))
    modes = {0: "consistence", 1: "concurrency", 2: "read committed record version", 3: "read committed no record version"}
    out = transactions.join(record_stats, "stat_id", "left").join(io_stats, "stat_id", "left")
    return out.select("transaction_id", "attachment_id", label("state", {1: "STARTED", 0: "FINISHED"}).alias("state"), "timestamp", label("isolation_mode", modes).alias("isolation_mode"), wait.alias("lock_timeout"), yes("read_only"), yes("auto_commit"), yes("auto_undo"), *_RECORDS, *_PAGES).orderBy("timestamp")


def statements_report(statements: DataFrame, record_stats: DataFrame, attachments: DataFrame, io_stats: DataFrame, sql_part: str = "", server_pid: int | None = None, state: int | None = None) -> DataFrame:
    s = statements
    if sql_part:
        s = s.filter(F.contains(F.lower("sql_text"), F.lit(sql_part.lower())))
    if state is not None:
        s = s.filter(F.col("state") == state)
    a = attachments.select("attachment_id", "remote_process", "server_pid")
    if server_pid is not None:
        a = a.filter(F.col("server_pid") == server_pid)
    out = s.join(record_stats, "stat_id").join(a, "attachment_id").join(io_stats, "stat_id", "left")
    stmt = F.concat(F.lit("delete from statements where statement_id = "), F.col("statement_id").cast("string"))
    return out.select("statement_id", "sql_text", label("state", {0: "IDLE", 1: "ACTIVE", 2: "STALLED"}).alias("status"), "timestamp", *_RECORDS, "transaction_id", "attachment_id", F.right("remote_process", F.lit(32)).alias("process_name"), *_PAGES, "remote_process", "server_pid", stmt.alias("delete_stmt"))


def denied_connections(attachments: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Attachments that no rule allows; without rules all are allowed, system ones always.

    A null field of a rule allows anything; the process has to end with the rule's, whatever the
    case. The whitelist is configuration and meant to be small.
    """
    rules = whitelist.filter("allowed_process is not null or allowed_user is not null or allowed_address is not null")
    fits = (
        (F.col("allowed_process").isNull() | F.endswith(F.upper("remote_process"), F.upper("allowed_process")))
        & (F.col("allowed_user").isNull() | (F.upper("user") == F.upper("allowed_user")))
        & (F.col("allowed_address").isNull() | (F.upper("remote_address") == F.upper("allowed_address")))
    )
    some = rules.agg((F.count(F.lit(1)) > 0).alias("_any"))
    return user_rows(attachments).join(whitelist, F.coalesce(fits, F.lit(False)), "left_anti").crossJoin(some).filter("_any").drop("_any")


def connection_ages(attachments: DataFrame, now: Column) -> DataFrame:
    """(user, days_old, cnt, min_timestamp) of user attachments, by age in days at `now`."""
    a = user_rows(attachments).withColumn("days_old", F.date_diff(now.cast("date"), F.col("timestamp").cast("date")))
    return a.groupBy("user", "days_old").agg(F.count(F.lit(1)).alias("cnt"), F.min("timestamp").alias("min_timestamp"))


def stale_connections(attachments: DataFrame, now: Column) -> DataFrame:
    """Attachments from before 22:00 of the day before `now`."""
    return attachments.filter(F.col("timestamp") < F.date_trunc("day", now) - F.expr("interval 2 hours"))
