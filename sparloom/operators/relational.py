"""Relational helpers that SQL has no single word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions.similar import to_regex
from sparloom.functions.text import col


def similar(text: Column | str, pattern: str, escape: str | None = None) -> Column:
    """text SIMILAR TO pattern."""
    return F.regexp_like(col(text), F.lit(to_regex(pattern, escape)))


def containing(text: Column | str, part: str) -> Column:
    """Whether part is in text, whatever the case."""
    return F.contains(F.lower(col(text)), F.lit(part.lower()))


def in_list(value: Column | str, csv: str) -> Column:
    """Whether the value is one of a comma-separated list; null for null."""
    return col(value).isin(csv.split(","))


def equi_or_wildcard(left: DataFrame, rules: DataFrame, on: str, wildcard: str = "*") -> DataFrame:
    """left with the rules for its value and the rules for any value: an equi join and a product
    with the wildcard rules only, so that Spark need not compare all pairs."""
    exact = left.join(rules.filter(F.col(on) != wildcard), on)
    every = left.crossJoin(rules.filter(F.col(on) == wildcard).drop(on))
    return exact.unionByName(every)


def listed(df: DataFrame, keys: list[str], value: Column, order: Column, sep: str, name: str) -> DataFrame:
    """Values of each key in order, joined. A key's values become one text, as the result asks."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["v"]), sep).alias(name))


def unique_or_nothing(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key that has exactly one row; a key with more rows, even equal ones, has none."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's row with the highest order; one aggregate, no sort of a key's rows."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def within_budget(df: DataFrame, keys: list[str], order: str, cost: Column, budget: int) -> DataFrame:
    """Each key's rows, in order, as long as their costs stay within the budget."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(cost).over(w)).filter(F.col("_used") <= budget).drop("_used")
