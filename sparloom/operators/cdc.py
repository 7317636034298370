"""Change capture by snapshot difference, change logs, and statements that undo changes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.operators.graph import numbered

CHANGE = ["table_name", "change_type", "primary_key_fields", "primary_key_1", "primary_key_2", "primary_key_3", "changed_field_name", "old_value", "new_value"]


def normalised_rules(rules: DataFrame) -> DataFrame:
    """Tracking rules with names in upper case, trimmed, and flags that are null set to 0."""
    return rules.select(*[F.upper(F.trim(c)).alias(c) if c in ("table_name", "field_name") else F.coalesce(c, F.lit(0)).alias(c) if c.startswith("log_") else F.col(c) for c in rules.columns])


def tracked_fields(rules: list[dict], table: str, columns: list[str]) -> dict[str, set[str]]:
    """field -> change types to log. "*" is all fields, a rule for one field adds to it.

    rules: dicts with table_name, field_name, log_insert, log_update, log_delete.
    """
    out: dict[str, set[str]] = {}
    for r in rules:
        if r["table_name"].strip().upper() != table.upper():
            continue
        name = r["field_name"].strip().upper()
        kinds = {k for k in ("INSERT", "UPDATE", "DELETE") if r.get(f"log_{k.lower()}")}
        for c in columns:
            if name in ("*", c.upper()):
                out.setdefault(c, set()).update(kinds)
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str] | None = None, table: str = "", kinds: dict[str, set[str]] | None = None, condition: Column | None = None) -> DataFrame:
    """One row (see CHANGE) per field that differs, null-safely, between two snapshots by key.

    The snapshots are joined once, on the key; the fields of a pair become an array of their own
    differences, so there is no product with the list of fields. kinds limits the change types of a
    field; condition is an extra condition on o and n, the structs of old and new fields. Values are
    whole texts. A row that is inserted or deleted with nothing but nulls has one row in the log, without
    a field. At most three key fields; more raise ValueError.
    """
    if len(keys) > 3:
        raise ValueError("a change log names a row by three fields at most")
    fields = fields or [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(F.lit(1).alias("there"), *[F.col(c).cast("string").alias(c) for c in fields]).alias("o"))
    n = new.select(*keys, F.struct(F.lit(1).alias("there"), *[F.col(c).cast("string").alias(c) for c in fields]).alias("n"))
    both = o.join(n, keys, "full")
    kind = F.when(F.col("n.there").isNull(), "DELETE").when(F.col("o.there").isNull(), "INSERT").otherwise("UPDATE")
    both = both.withColumn("change_type", kind)
    if condition is not None:
        both = both.filter(condition)
    # without a change there is nothing to explode
    changed = F.array(*[
        F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) & (F.col("change_type").isin(*kinds.get(c, set())) if kinds is not None else F.lit(True)), F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").alias("old"), F.col(f"n.{c}").alias("new")))
        for c in fields
    ])
    changed = F.array_compact(changed)
    tracked = F.col("change_type").isin(*set().union(*kinds.values())) if kinds is not None else F.lit(True)
    nothing = F.array(F.struct(*[F.lit(None).cast("string").alias(x) for x in ("field", "old", "new")]))
    # whether a row's fields are all null is told by its structs, as kinds may leave out fields that aren't
    empty = functools.reduce(lambda a, b: a & b, [F.col(f"o.{c}").isNull() & F.col(f"n.{c}").isNull() for c in fields], F.lit(True))
    changed = F.when((F.col("change_type") != "UPDATE") & empty & tracked, nothing).otherwise(changed)
    rows = both.select(*keys, "change_type", F.explode(changed).alias("c"))
    pk = [F.col(k).cast("string") for k in keys] + [F.lit(None).cast("string")] * (3 - len(keys))
    return rows.select(F.lit(table).alias("table_name"), "change_type", F.lit(";".join(keys)).alias("primary_key_fields"), *[p.alias(f"primary_key_{i + 1}") for i, p in enumerate(pk)], F.col("c.field").alias("changed_field_name"), F.col("c.old").alias("old_value"), F.col("c.new").alias("new_value"))


def with_change_ids(log: DataFrame, first: int = 1) -> DataFrame:
    """Adds change_id, counting by key and field from `first`."""
    key = F.struct("table_name", "primary_key_1", "primary_key_2", "primary_key_3", "changed_field_name")
    return numbered(log.withColumn("_key", key), "_key").withColumn("change_id", F.col("place") + first).drop("_key", "place")


def enriched(log: DataFrame, context: dict[str, object], changed: Column) -> DataFrame:
    """Adds the context (user, process, transaction, call stack ...) where the log has no value of
    its own, and the time of the change."""
    out = log
    for name, value in {**context}.items():
        own = F.col(name) if name in log.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(own, F.lit(None if value is None else str(value))))
    return out.withColumn("changed", F.coalesce(F.col("changed"), changed) if "changed" in log.columns else changed)


def apply_changes(base: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """base as it is after the changes of a log; the latest change of a field counts.

    A row whose key is inserted holds the logged fields, all others null.
    """
    fields = [c for c in base.columns if c not in keys]
    pk = [F.col(f"primary_key_{i + 1}").alias(k) for i, k in enumerate(keys)]
    latest = log.groupBy(*pk).agg(
        F.max_by("change_type", "change_id").alias("change_type"),
        *[F.max_by(F.when(F.col("changed_field_name") == c, F.struct(F.lit(1).alias("set"), F.col("new_value").alias("v"))), F.when(F.col("changed_field_name") == c, F.col("change_id"))).alias(f"new_{c}") for c in fields],
    )
    typed = latest.select(*[F.col(k).cast(base.schema[k].dataType).alias(k) for k in keys], "change_type", *[f"new_{c}" for c in fields])
    out = base.join(typed, keys, "full").filter(F.coalesce(F.col("change_type") != "DELETE", F.lit(True)))
    return out.select(*keys, *[F.when(F.col(f"new_{c}.set") == 1, F.col(f"new_{c}.v").cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in fields])


def _text(v: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("null"))


def restore_statements(log: DataFrame, tables: list[str], after: Column | None = None, before: Column | None = None, client: str | None = None, change_types: list[str] | None = None) -> DataFrame:
    """(table_name, primary_key_1..3, restore_stmt): one statement per row that undoes its changes.

    The newest change of a row decides its kind: an update is set back, a deleted row inserted
    again, an inserted one left. A field changed more than once is set to its oldest value. A row's
    changes are folded by key; log: CHANGE with change_id, and changed, client_process if filtered.
    """
    picked = log.filter(F.col("table_name").isin(tables))
    if after is not None or before is not None:
        picked = picked.filter(F.col("changed").between(after, before))
    if client is not None:
        picked = picked.filter(F.contains(F.lower("client_process"), F.lit(client.lower())))
    if change_types is not None:
        picked = picked.filter(F.col("change_type").isin(change_types))
    key = ["table_name", "primary_key_1", "primary_key_2", "primary_key_3"]
    # one row per field first: its oldest value, its newest value, and when it changed last
    by_field = picked.groupBy(*key, "changed_field_name").agg(
        F.min_by("old_value", "change_id").alias("old"), F.max_by("new_value", "change_id").alias("new"), F.max("change_id").alias("last"), F.max_by(F.struct("change_type", "primary_key_fields"), "change_id").alias("newest")
    )
    part = F.struct((-F.col("last")).alias("at"), F.col("changed_field_name").alias("field"), "old", "new")
    by_row = by_field.groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max_by("newest", "last").alias("newest"))
    names = F.split("newest.primary_key_fields", ";")
    pk = [F.col(f"primary_key_{i}") for i in (1, 2, 3)]
    named = [F.get(names, F.lit(i)) for i in range(3)]
    cond = F.concat_ws(" and ", *[F.when(p.isNotNull(), F.concat(n, F.lit(" = "), _text(p))) for n, p in zip(named, pk, strict=True)])
    sets = F.array_join(F.transform("parts", lambda x: F.concat(F.lit(", "), x["field"], F.lit(" = "), _text(x["old"]), F.lit(" /* old: "), F.coalesce(x["new"], F.lit("null")), F.lit("*/"))), "")
    update = F.concat(F.lit("update "), "table_name", F.lit(" set "), named[0], F.lit(" = "), named[0], sets, F.lit(" where "), cond, F.lit(";"))
    others = F.filter("parts", lambda x: x["field"].isNotNull() & ~F.array_contains(names, x["field"]))
    columns = F.concat_ws(", ", F.array_compact(F.array(*[F.when(p.isNotNull(), n) for n, p in zip(named, pk, strict=True)])), F.transform(others, lambda x: x["field"]))
    values = F.concat_ws(", ", F.array_compact(F.array(*[F.when(p.isNotNull(), _text(p)) for p in pk])), F.transform(others, lambda x: _text(x["old"])))
    insert = F.concat(F.lit("insert into "), "table_name", F.lit("("), columns, F.lit(") values ("), values, F.lit(");"))
    stmt = F.when(F.col("newest.change_type") == "UPDATE", update).when(F.col("newest.change_type") == "DELETE", insert)
    return by_row.select(*key, stmt.alias("restore_stmt")).filter("restore_stmt is not null")


def structure_changes(stored: DataFrame, current: DataFrame, checked: Column) -> DataFrame:
    """The structure log after a poll: an object whose definition differs from the latest stored one
    gets a new row, one that is the same has that row's `checked` set.

    stored: (object_type, object_name, stmt, checked); current: (object_type, object_name, stmt).
    """
    key = ["object_type", "object_name"]
    latest = stored.groupBy(*key).agg(F.max("checked").alias("_at"), F.max_by("stmt", "checked").alias("_stmt"))
    joined = current.join(latest, key, "left")
    new = joined.filter(~F.col("stmt").eqNullSafe(F.col("_stmt"))).select(*key, "stmt", checked.alias("checked"))
    same = joined.filter(F.col("stmt").eqNullSafe(F.col("_stmt"))).select(*key, "_at")
    kept = stored.join(same, key, "left").select(*key, "stmt", F.when(F.col("checked") == F.col("_at"), checked).otherwise(F.col("checked")).alias("checked"))
    return kept.unionByName(new)


def import_history(log: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """log with those rows of history that it has no equal of, nulls being equal."""
    same = functools.reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    return log.unionByName(history.alias("h").join(log.alias("l"), same, "left_anti"))


def merge_settings(current: DataFrame, defaults: DataFrame) -> DataFrame:
    """Settings by key: a known key keeps its value and takes the description, a new one is added."""
    c, d = current.select("key", F.col("val").alias("_val"), F.col("description").alias("_old"), F.lit(1).alias("_there")), defaults
    out = c.join(d, "key", "full")
    return out.select("key", F.when(F.col("_there") == 1, F.col("_val")).otherwise(F.col("val")).alias("val"), F.coalesce("description", "_old").alias("description"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same key, others added."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
