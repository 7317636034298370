"""XML text as tables of nodes with positions, without asking for well-formed documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.text import col
from sparloom.functions.typed import string_to_type

_NAME = r"[a-zA-Zа-яА-ЯёЁ][a-zA-Zа-яА-ЯёЁ0-9_.]*"
_FULL = rf"(?:{_NAME}:)*{_NAME}"
_ATTR = rf'{_FULL}\s*=\s*"[^"]*"'
_OPEN = re.compile(rf"<({_FULL})((?:\s+{_ATTR})*)\s*(/?)>")
#: Levels of nodes of the same name inside each other that are followed.
NESTED_LIMIT = 100

NODE = "path:string,ns_alias:string,name:string,content:string,attributes:string,startpos:bigint,endpos:bigint,level:int"


class UnclosedNode(ValueError):
    """A node whose end tag is missing."""


def _close(text: str, name: str, start: int, after: int, stop: int) -> int:
    """Where the end tag that belongs to the open tag at `start` begins, -1 if nowhere before stop."""
    tags = re.compile(rf"</{re.escape(name)}>|<{re.escape(name)}[ >]")
    level = 0
    for m in tags.finditer(text, after, stop):
        if m[0].startswith("</"):
            if level == 0:
                return m.start()
            level -= 1
        elif level < NESTED_LIMIT:
            own = _OPEN.match(text, m.start(), stop)
            level += not (own and own[3])
    return -1


def nodes(text: str | None, parent_path: str = "", level: int = 0) -> list[dict]:
    """Every node, parents first. path is that of the parent; positions count from 1 in the whole
    text. Tags that are not well-formed are passed over; a missing end tag raises UnclosedNode."""
    if not text:
        return []
    root = "/" + parent_path.strip().strip("/")
    out, todo = [], [(0, len(text), root, level)]
    while todo:  # spans still to be searched, the next one last
        at, stop, path, depth = todo.pop()
        while True:
            at = text.find("<", at, stop)
            if at < 0:
                break
            m = _OPEN.match(text, at, stop)
            if not m:
                at += 1
                continue
            full, attributes, empty = m[1], m[2].strip(), m[3]
            alias, _, name = full.rpartition(":")
            inner, end = (m.end(), m.end()), m.end()
            if not empty:
                close = _close(text, full, at, m.end(), stop)
                if close < 0:
                    raise UnclosedNode(f"no end tag for <{full}> at position {at + 1}")
                inner, end = (m.end(), close), close + len(full) + 3
            out.append({"path": path, "ns_alias": alias, "name": name, "content": text[inner[0] : inner[1]], "attributes": attributes or None, "startpos": at + 1, "endpos": end, "level": depth})
            if inner[1] > inner[0]:
                todo.append((end, stop, path, depth))
                todo.append((*inner, path + "/" * (path != "/") + name, depth + 1))
                break
            at = end
    return out


def xml_nodes(text: Column | str, parent_path: str = "") -> Column:
    """array<struct> of a document's nodes, parents before children; see NODE."""

    @F.pandas_udf(f"array<struct<{NODE}>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: nodes(t, parent_path))

    return found(col(text))


def xml_all_nodes(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_nodes", xml_nodes(text)).select(*df.columns, F.inline("_nodes"))


VALUE = "val:string,attributes:string,node_number:bigint,node_start:bigint,node_end:bigint,value_start:bigint,value_end:bigint,error_code:int,error_text:string"
_NIL = re.compile(r'(?:^|[\s\S]*:|[\s\S]* )nil\s*=\s*"true"')


def _fault(code: int, text: str, number: int) -> dict:
    return {"val": None, "attributes": None, "node_number": number, "node_start": None, "node_end": None, "value_start": None, "value_end": None, "error_code": code, "error_text": text}


def values(text: str | None, name: str, is_node: bool = False, required: bool = False, index: int = 1, check_nil: bool = True) -> list[dict]:
    """The values of the index-th node called name, or of all of them from the first if index <= 0.

    An empty node has the value '' (none for type node), a nil node none. Errors are rows: 1 no
    name, 2 a required node is missing, 3 no end tag, 4 no end of the open tag.
    """
    if not name:
        return [_fault(1, "XML node name cannot be empty", max(1, index))]
    every, number, out, at, text = index <= 0, max(1, index), [], 0, text or ""
    tags = re.compile(rf"<{re.escape(name)}(?=/>|[ >])")
    wanted = number
    while True:
        m = None
        for _ in range(wanted):
            m = tags.search(text, m.end() if m else at)
            if not m:
                break
        wanted = 1
        if not m:
            if required and number == 1:
                out.append(_fault(2, f'Required XML node "{name}" with oridnal number "{number}" is not found', number))
            return out
        row = {"val": None, "attributes": None, "node_number": number, "node_start": m.start() + 1, "node_end": None, "value_start": None, "value_end": None, "error_code": 0, "error_text": ""}
        where = f'for node "{name}" (at position "{m.start() + 1}" in source XML) with oridnal number "{number}" '
        tag = re.compile(r"[^<>]*?(/?)>").match(text, m.end())
        if not tag:
            out.append(_fault(4, f"Unable to find end of open tag {where}", number))
            return out
        row["attributes"] = text[m.end() : tag.start(1)].strip() or None
        end = tag.end()
        if tag[1]:
            row["val"] = None if is_node else ""
        elif check_nil and row["attributes"] and _NIL.match(row["attributes"]):
            pass
        else:
            close = _close(text, name, m.start(), end, len(text))
            if close < 0:
                out.append(_fault(3, f"Unable to find end of value {where}", number))
                return out
            row |= {"val": text[end:close], "value_start": end + 1, "value_end": close + 1}
            end = close + len(name) + 3
        row["node_end"] = end
        out.append(row)
        if not every:
            return out
        at, number = end, number + 1


def xml_values(text: Column | str, name: str, vtype: str = "str", required: bool = False, index: int = 1, check_nil: bool = True) -> Column:
    """array<struct> of values() as text."""

    @F.pandas_udf(f"array<struct<{VALUE}>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: values(t, name, vtype == "node", required, index, check_nil))

    return found(col(text))


def xml_get_value(df: DataFrame, text: str, name: str, vtype: str = "str", required: bool = False, index: int = 1, check_nil: bool = True) -> DataFrame:
    """df's columns, and a row per value with val_int to time_zone read as the type.

    A value that is not of the type has that type's error code and text. With required, an error
    raises when the row is used; otherwise it is a row.
    """
    found = df.withColumn("_values", xml_values(text, name, vtype, required, index, check_nil)).select(*df.columns, F.inline_outer("_values")).filter("node_number is not null")
    typed = found.withColumn("_typed", string_to_type("val", vtype))
    parts = [F.col(f"_typed.{n}") for n in ("val_int", "val_float", "val_double", "val_date", "val_time", "val_datetime", "time_zone")]
    code = F.when(F.col("error_code") > 0, F.col("error_code")).otherwise(F.col("_typed.error_code").cast("int"))
    wrong = F.concat(F.lit('Value "'), F.coalesce("val", F.lit("null")), F.lit(f'" of XML node "{name}" is incorrect: '), F.col("_typed.error_text"))
    shown = F.when(F.col("error_code") > 0, F.col("error_text")).when(code > 0, wrong).otherwise("")
    out = typed.select(*df.columns, "val", *parts, "attributes", "node_number", "node_start", "node_end", "value_start", "value_end", code.alias("error_code"), shown.alias("error_text"))
    return out
