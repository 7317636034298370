"""Hierarchies and dependency graphs.

Walks are driver-side loops over DataFrame plans: one join per level, with the rows of finished
levels written to the shared folder, so lineage stays short and a level is never computed twice.
Loops end by themselves on cycles: a walk carries its path or a set of seen nodes.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set where it is unset and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sparloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _keep(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparloom-walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _rank(df: DataFrame, id_col: str, parent_col: str, sort: list[Column]) -> DataFrame:
    """(id, parent, rank): rank orders siblings; a parent's children are few against the table."""
    own = Window.partitionBy(parent_col).orderBy(*sort, F.col(id_col))
    return df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.row_number().over(own).alias("rank"))


def get_children(df: DataFrame, id_col: str, parent_col: str, current, only_leaf: bool = False, base_level: int = 0, sort: list[Column] | None = None, max_depth: int = 10_000) -> DataFrame:
    """(id, parent, level, sort_order): all that lies below `current`, depth first, parents before
    their children; level counts from base_level, sort_order from 0.

    A null `current` has no children. A node that is its own parent is not its own child. only_leaf
    keeps nodes without children, numbered among themselves.
    """
    edges = _keep(_rank(df.filter(~F.col(id_col).eqNullSafe(F.col(parent_col))), id_col, parent_col, sort or []))
    level = edges.filter(F.col("parent") == F.lit(current)).select("id", "parent", F.lit(base_level).alias("level"), F.array("rank").alias("path"), F.array(F.lit(current).cast(edges.schema["id"].dataType), F.col("id")).alias("seen"))
    levels = []
    for _ in range(max_depth):
        level = _keep(level)
        if level.isEmpty():
            break
        levels.append(level)
        up = level.alias("u")
        level = edges.alias("e").join(up, F.col("e.parent") == F.col("u.id")).filter(~F.array_contains("u.seen", F.col("e.id")))
        level = level.select("e.id", "e.parent", (F.col("u.level") + 1).alias("level"), F.array_append("u.path", F.col("e.rank")).alias("path"), F.array_append("u.seen", F.col("e.id")).alias("seen"))
    found = _union(levels) if levels else level
    if only_leaf:
        found = found.join(edges.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    return numbered(found, "path").select("id", "parent", "level", F.col("place").alias("sort_order"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds place, from 0 in the order of key, without bringing all rows into one task.

    Rows are sorted over all tasks; each row's place is its place in its partition plus the rows of
    the partitions before.
    """
    rows = _keep(df.sort(key).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part").orderBy(key)
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.withColumn("_nth", F.row_number().over(local) - 1).join(F.broadcast(before), "_part").withColumn("place", (F.col("_base") + F.col("_nth")).cast("bigint")).drop("_part", "_nth", "_base")


def get_parents(df: DataFrame, id_col: str, parent_col: str, start, info: str | None = None, depth: int = 100) -> DataFrame:
    """(id, parent, info, level): the way up from `start`, which is level 1; ends at a missing row or
    after depth steps, the only guard against a cycle."""
    rows = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), (F.col(info) if info else F.lit(None)).cast("string").alias("info"))
    out, at = [], start
    for level in range(1, depth + 1):
        found = rows.filter(F.col("id") == F.lit(at)).limit(1).collect() if at is not None else []
        if not found:
            break
        out.append((*found[0], level))
        at = found[0]["parent"]
    return df.sparkSession.createDataFrame(out, rows.withColumn("level", F.lit(1)).schema)


def prepare_hierarchy(df: DataFrame, id_col: str, name_col: str, parent_col: str, order: list[Column] | None = None, max_depth: int = 10_000) -> DataFrame:
    """(id, parent, name, level, indented, order_index): the forest depth first, siblings and roots
    in reverse order, names indented by "|  " and "|_"; order_index counts from 1.

    A root has a null parent, or one that is not in the table.
    """
    ids = df.select(F.col(id_col).alias("_p")).distinct()
    roots = df.join(ids, F.col(parent_col) == F.col("_p"), "left_anti").select(F.col(id_col).alias("id"))
    ranked = _rank(df, id_col, parent_col, order or []).join(df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")), "id")
    ranked = _keep(ranked.withColumn("rank", -F.col("rank")))
    top = ranked.join(roots, "id", "left_semi")
    rank_of_root = F.row_number().over(Window.orderBy(*[c for c in (order or [])], F.col(id_col)))
    first = df.join(roots.select(F.col("id").alias("_r")), F.col(id_col) == F.col("_r"), "left_semi").select(F.col(id_col).alias("id"), (-rank_of_root).alias("rank"))
    level = top.drop("rank").join(first, "id").select("id", "parent", "name", F.lit(0).alias("level"), F.array("rank").alias("path"), F.array("id").alias("seen"))
    levels = []
    for _ in range(max_depth):
        level = _keep(level)
        if level.isEmpty():
            break
        levels.append(level)
        level = ranked.alias("e").join(level.alias("u"), F.col("e.parent") == F.col("u.id")).filter(~F.array_contains("u.seen", F.col("e.id")))
        level = level.select("e.id", "e.parent", "e.name", (F.col("u.level") + 1).alias("level"), F.array_append("u.path", F.col("e.rank")).alias("path"), F.array_append("u.seen", F.col("e.id")).alias("seen"))
    found = _union(levels) if levels else level
    indented = F.concat(F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("|  "), F.col("level") - 1), F.lit("|_"))).otherwise(""), F.col("name"))
    return numbered(found, "path").select("id", "parent", "name", "level", indented.alias("indented"), (F.col("place") + 1).alias("order_index"))


def get_dependencies(edges: DataFrame, start: DataFrame, exclude: str | None = None, exclude_types: list[int] | None = None, max_depth: int = 100) -> DataFrame:
    """(name, column, type, depth): everything that the start objects depend on, breadth first, each
    object once at its least depth; the start objects have depth 0.

    edges: (dependent_name, dependent_type, name, column, type); start: (name, column, type).
    exclude is a Java regular expression on names.
    """
    key = ["name", "column", "type"]
    if exclude is not None:
        edges = edges.filter(~F.regexp_like("name", F.lit(exclude)))
    if exclude_types:
        edges = edges.filter(~F.coalesce(F.col("type").isin(exclude_types), F.lit(False)))
    edges = _keep(edges.select("dependent_name", "dependent_type", *key).distinct())
    frontier = _keep(start.select(*key, F.lit(0).alias("depth")).dropDuplicates(key))
    seen, parts = frontier, [frontier]
    for depth in range(1, max_depth + 1):
        nxt = edges.join(frontier.select(F.col("name").alias("dependent_name"), F.col("type").alias("dependent_type")).distinct(), ["dependent_name", "dependent_type"]).select(*key).distinct()
        nxt = nxt.alias("n").join(seen.alias("s"), _same(key, "n", "s"), "left_anti").withColumn("depth", F.lit(depth))
        frontier = _keep(nxt)
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = _union(parts)
    return seen


def _same(key: list[str], a: str, b: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key])


def nested_dependencies(edges: DataFrame, start: DataFrame, through: int = 5, max_depth: int = 32) -> DataFrame:
    """(type, names, n): what the start objects need, directly or through objects of type `through`
    only, as a sorted list by type."""
    reached = get_dependencies(edges.filter(F.col("dependent_type") == through), start, max_depth=max_depth).filter("depth > 0").select("name", "type").distinct()
    return reached.groupBy("type").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


def get_order(edges: DataFrame, nodes: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(order_index, name, required, required_count, loop_type): a topological order of nodes.

    edges: (name, required). Nodes whose requirements have all been placed come next, by the number
    of their requirements and name. Members of cycles, and what needs them, come last; loop_type has
    bit 1 if a node requires itself and bit 2 if it does so through others. Joins are merges: a round's
    tables may be short enough for a broadcast, and the rounds' broadcasts would add up at the driver.
    """
    names = nodes.select("name").distinct()
    edges = edges.select("name", "required").distinct().hint("merge").join(names, "name", "left_semi").hint("merge").join(names.withColumnRenamed("name", "required"), "required", "left_semi").select("name", "required")
    edges = _keep(edges)
    open_ = edges.filter("name <> required")
    listed = open_.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("required")), ",").alias("required"), F.count(F.lit(1)).alias("required_count"))
    # each round places the names that wait for nothing more and takes them off what others wait for
    state = _keep(names.hint("merge").join(listed.select("name", F.col("required_count").alias("waits")), "name", "left").select("name", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(None).cast("int").alias("round")))
    rounds = []
    for i in range(max_rounds):
        ready = state.filter("waits = 0").select(F.col("name").alias("required"))
        met = open_.hint("merge").join(ready, "required", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("met"))
        step = state.hint("merge").join(met, "name", "left").select("name", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"), F.when(F.col("waits") == 0, i).alias("round"))
        step = _keep(step)
        placed = step.filter("round is not null")
        state = step.filter("round is null").select("name", "waits", "round")
        if placed.isEmpty():
            break
        rounds.append(placed.select("name", "round"))
    rest = state.select("name", F.lit(len(rounds)).alias("round"))
    placed = _union([*rounds, rest])
    open_ = _keep(open_.hint("merge").join(rest.select("name"), "name", "left_semi").hint("merge").join(rest.select(F.col("name").alias("required")), "required", "left_semi").select("name", "required"))
    loops = _in_cycles(open_).withColumn("through", F.lit(2))
    own = edges.filter("name = required").select("name", F.lit(1).alias("direct"))
    out = placed.hint("merge").join(listed, "name", "left").hint("merge").join(loops, "name", "left").hint("merge").join(own, "name", "left")
    out = out.select("name", "round", "required", F.coalesce("required_count", F.lit(0)).alias("required_count"), (F.coalesce("direct", F.lit(0)) + F.coalesce("through", F.lit(0))).alias("loop_type"))
    return numbered(out.withColumn("_key", F.struct("round", "required_count", "name")), "_key").select((F.col("place") + 1).alias("order_index"), "name", "required", "required_count", "loop_type")


def _in_cycles(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Names on a cycle of (name, required), the edges that topological order has left over.

    Strongly connected components by colouring: names without an edge in or out are peeled off; every
    name takes the greatest name that leads to it as its colour; the names of a colour that lead back to
    it are the component of that name, on a cycle if there are two or more. Components are taken out, and
    what is left goes on. A round moves along edges once, so its rows never exceed the edges.
    """
    found, n = [], edges.count()
    for _ in range(max_rounds):
        while n:  # what has no edge in, or none out, is on no cycle
            used = edges.select("name").distinct().hint("merge").join(edges.select(F.col("required").alias("name")).distinct(), "name", "left_semi")
            kept = _keep(edges.hint("merge").join(used, "name", "left_semi").hint("merge").join(used.withColumnRenamed("name", "required"), "required", "left_semi").select("name", "required"))
            before, n, edges = n, kept.count(), kept
            if n == before:
                break
        if not n:
            break
        colour = _keep(edges.select("name").distinct().select("name", F.col("name").alias("colour")))
        for _ in range(max_rounds):
            along = edges.hint("merge").join(colour, "name").groupBy(F.col("required").alias("name")).agg(F.max("colour").alias("passed"))
            step = _keep(colour.hint("merge").join(along, "name", "left").select("name", F.greatest("colour", "passed").alias("colour"), (F.col("passed") > F.col("colour")).alias("moved")))
            colour = step.select("name", "colour")
            if step.filter("moved").isEmpty():
                break
        inside = edges.hint("merge").join(colour, "name").hint("merge").join(colour.select(F.col("name").alias("required"), F.col("colour").alias("_c")), "required").filter("colour = _c").select("name", "required", "colour")
        inside = _keep(inside)
        reached = _keep(colour.filter("name = colour"))
        members = [reached]
        while not reached.isEmpty():  # backwards from the name that gave the colour
            back = inside.hint("merge").join(reached.select(F.col("name").alias("required")), "required", "left_semi").select("name", "colour").distinct()
            reached = _keep(back.hint("merge").join(_union(members), "name", "left_anti"))
            members.append(reached)
        component = _keep(_union(members))
        found.append(component.hint("merge").join(component.groupBy("colour").count().filter("count > 1"), "colour", "left_semi").select("name"))
        edges = _keep(edges.hint("merge").join(component, "name", "left_anti").hint("merge").join(component.select(F.col("name").alias("required")), "required", "left_anti").select("name", "required"))
        n = edges.count()
    return _union(found).distinct() if found else edges.select("name").limit(0)


def drop_statements(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(step, stmt): statements that drop what depends on `name`, dependents first, then itself."""
    up = edges.select(F.col("required").alias("dependent_name"), F.lit(5).alias("dependent_type"), F.col("name").alias("name"), F.lit(None).cast("string").alias("column"), F.lit(5).alias("type"))
    start = nodes.sparkSession.createDataFrame([(name, None, 5)], "name string, column string, type int")
    users = get_dependencies(up, start).select("name")
    order = get_order(edges, users)
    last = order.agg(F.max("order_index")).first()[0]
    return order.select((F.lit(last) - F.col("order_index") + 1).alias("step"), F.concat(F.lit("drop procedure "), F.col("name"), F.lit(";")).alias("stmt"))


def call_stack_text(frames: DataFrame, limit: int = 4096) -> DataFrame:
    """(statement_id, call_stack): frames "id:object[line:column]<caller", the innermost first, cut
    at limit characters. frames: call_id, caller_id, statement_id, object_name, source_line, source_column."""
    shown = F.concat(F.col("call_id").cast("string"), F.lit(":"), F.col("object_name"), F.lit("["), F.coalesce(F.col("source_line").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("source_column").cast("string"), F.lit("")), F.lit("]<"), F.coalesce(F.col("caller_id").cast("string"), F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("call_id")).alias("k"), shown.alias("t"))))
    return frames.groupBy("statement_id").agg(F.left(F.array_join(F.transform(listed, lambda x: x["t"]), "\n"), F.lit(limit)).alias("call_stack"))
