"""JSON documents as tables of nodes with positions; lenient where JSON is strict.

One parse per document in an Arrow-fed Python worker; everything built on it reads the same nodes.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.text import col

NODE = "node_start:bigint,node_end:bigint,value_start:bigint,value_end:bigint,node_path:string,node_index:bigint,value_type:string,name:string,val:string,level:bigint,error_code:bigint,error_text:string"
FIELDS = [f.split(":")[0] for f in NODE.split(",")]

_BLANKS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"([^"\\]*(?:\\[\s\S][^"\\]*)*)"')
_NUMBER = re.compile(r"-?[0-9][0-9.]*")
_EXPONENT = re.compile(r"[eE][+-]?[0-9]+")
_ESCAPE = re.compile(r"\\([\s\S])")
# What an escaped letter stands for; any other character stands for itself.
_ESCAPED = {"t": "\t", "n": "\n", "r": "\r"}
# Error codes and their texts.
WHITESPACE, NODE_START, IN_OBJECT, IN_ARRAY, AFTER_STRING, IN_NUMBER, COMMA = 1, 2, 3, 4, 5, 6, 7
ERROR_TEXTS = {
    WHITESPACE: "Unexpected whitespace. ",
    NODE_START: "Unexpected node start symbol. ",
    IN_OBJECT: "Unexpected symbol inside object value. ",
    IN_ARRAY: "Unexpected symbol inside array value. ",
    AFTER_STRING: "Unexpected symbol after string value. ",
    IN_NUMBER: "Unexpected symbol in number value.",
    COMMA: "Missed comma. ",
}
#: State numbers as they appear in error texts.
_STATE = {NODE_START: 0, IN_OBJECT: 1, IN_ARRAY: 4, AFTER_STRING: 3, IN_NUMBER: 5}


class Fault(Exception):
    """A syntax error; `row` holds the columns of the sibling before it, if any."""

    def __init__(self, code: int, at: int, state: int, row: dict | None = None):
        super().__init__(code)
        self.code, self.at, self.state, self.row = code, at, state, row and dict(row)


@dataclass(slots=True)
class Node:
    start: int
    end: int
    kind: str
    val: str
    name: str | None = None
    value_start: int | None = None
    value_end: int | None = None

    def row(self, path: str, index: int, level: int) -> dict:
        return {
            "node_start": self.start, "node_end": self.end, "value_start": self.value_start or self.start, "value_end": self.value_end or self.end,
            "node_path": path, "node_index": index, "value_type": self.kind, "name": self.name, "val": self.val, "level": level, "error_code": 0, "error_text": None,
        }


class Parser:
    """Positions count from 1. Children come before their parent. compat keeps arrays directly inside
    arrays and exponents as errors."""

    def __init__(self, text: str, compat: bool = False):
        self.text, self.compat, self.rows = text, compat, []

    def run(self) -> list[dict]:
        try:
            node = self.node(0, "/", 0)
            if node:
                self.rows.append(node.row("/", 0, 0))
        except Fault as f:
            c = self.text[f.at] if f.at < len(self.text) else ""
            near = self.text[max(0, f.at - 4) : max(0, f.at - 4) + 8]
            text = f'{ERROR_TEXTS.get(f.code, "Unknown error. ")}c: "{c}", pos: "{f.at + 1}", state: "{f.state}", near text (-4, +4): "{near}"'
            self.rows.append(dict.fromkeys(FIELDS) | (f.row or {}) | {"error_code": f.code, "error_text": text})
        except RecursionError:
            self.rows.append(dict.fromkeys(FIELDS) | {"error_code": 99, "error_text": "Nested too deeply."})
        return self.rows

    def skip(self, at: int) -> int:
        return _BLANKS.match(self.text, at).end()

    def node(self, at: int, path: str, level: int, label: str | None = None) -> Node | None:
        """The node at or after `at`; None if the text ends before it does.

        path is that of the node, whose children's is path + (label or "-") + "/".
        """
        text, at = self.text, self.skip(at)
        if at >= len(text):
            return None
        c = text[at]
        if c == '"':
            return self.string(at, path, level)
        if c in "{[":
            return self.container(at, path + (label or "-") + "/", level)
        if c.isascii() and (c.isdigit() or c == "-" and text[at + 1 : at + 2].isdigit()):
            return self.number(at)
        for word in ("true", "false", "null"):
            if text.startswith(word, at):
                return Node(at + 1, at + len(word), word, word)
        raise Fault(NODE_START, at, _STATE[NODE_START])

    def number(self, at: int) -> Node:
        text, end = self.text, _NUMBER.match(self.text, at).end()
        second = text.find(".", text.find(".", at, end) + 1, end) if "." in text[at:end] else -1
        if second >= 0:
            raise Fault(AFTER_STRING, second, _STATE[IN_NUMBER])
        if not self.compat and (m := _EXPONENT.match(text, end)):
            end = m.end()
        if end < len(text) and text[end] not in ",]} \t\n\r":
            raise Fault(IN_NUMBER, end, _STATE[IN_NUMBER])
        return Node(at + 1, end, "number", text[at:end], value_end=end)

    def string(self, at: int, path: str, level: int) -> Node | None:
        """A string, or a name with its value."""
        text, m = self.text, _STRING.match(self.text, at)
        if not m:
            return None
        content, end = _ESCAPE.sub(lambda e: _ESCAPED.get(e[1], e[1]), m[1]), m.end()
        after = self.skip(end)
        c = text[after : after + 1]
        if c == ":":
            first = len(self.rows)
            inner = self.node(after + 1, path, level, content)
            if inner:
                return Node(at + 1, inner.end, inner.kind, inner.val, content, inner.start, inner.end)
            # the value has no end: what it held so far stands for it
            new = self.rows[first:]
            return Node(at + 1, new[-1]["node_end"] if new else after + 1, "string", "", content, new[0]["node_start"] if new else None)
        if c in ('"', "{", "[", "-") or c.isdigit() and c.isascii():
            raise Fault(COMMA, after, _STATE[AFTER_STRING])
        if c and c not in ",]}":
            raise Fault(AFTER_STRING, after, _STATE[AFTER_STRING])
        return Node(at + 1, end, "string", content, value_end=end)

    def container(self, at: int, path: str, level: int) -> Node | None:
        """An object or array; its children are appended to the rows as they end."""
        text = self.text
        is_object = text[at] == "{"
        close, starts = ("}", '"') if is_object else ("]", '{"-tfn0123456789' + "[" * (not self.compat))
        i, index, comma, last = at + 1, 0, False, None
        while (i := self.skip(i)) < len(text):
            c = text[i]
            if c == close:
                return Node(at + 1, i + 1, "object" if is_object else "array", text[at : i + 1], value_end=i + 1)
            if c == ",":
                comma, index, i = False, index + 1, i + 1
            elif c in starts:
                if comma:
                    raise Fault(COMMA, i, _STATE[IN_OBJECT if is_object else IN_ARRAY], last and last | {"level": 1})
                first = len(self.rows)
                try:
                    child = self.node(i, path, level + 1)
                except Fault as f:
                    # an object puts its own path in front of the faulty child's, an array does not
                    if f.row is not None and not is_object:
                        f.row["node_path"] = self.inside(f.row["node_path"], path)
                    raise
                if child:
                    self.rows.append(child.row(path, index, level + 1))
                new = len(self.rows) > first
                last = self.rows[-1] if new else last
                i, comma = last["node_end"] if new else i + 1, True
            else:
                raise Fault(IN_OBJECT if is_object else IN_ARRAY, i, _STATE[IN_OBJECT if is_object else IN_ARRAY], last and last | {"level": 1})
        return None

    @staticmethod
    def inside(path: str | None, outer: str) -> str | None:
        """The faulty row's path without the part that the enclosing array has added."""
        step = outer.rstrip("/").rsplit("/", 1)[-1]
        head = outer[: len(outer) - len(step) - 1]
        return None if path is None else head + path[len(outer) :] if path.startswith(outer) else path


def parse(text: str | None, compat: bool = False) -> list[dict]:
    """All nodes of a document, and one error row if it is faulty. Null or empty text has none."""
    if not text:
        return []
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 20_000))
    try:
        return Parser(text, compat).run()
    finally:
        sys.setrecursionlimit(before)


#: Documents whose rows are held as Python objects at once.
_CHUNK = 256


def rows_udf(kinds: str, rows_of: Callable[[str | None], list[dict]]) -> Callable[[Column], Column]:
    """A function of a text column that gives array<struct<kinds>>; rows_of gives a text's rows by name.

    Rows go into Arrow columns a few documents at a time, so a worker holds few of them as objects.
    """
    fields = [pa.field(name, {"bigint": pa.int64(), "string": pa.string()}[kind]) for name, kind in (f.split(":") for f in kinds.split(","))]
    most = _CHUNK

    def lists(texts: list[str | None]) -> pa.Array:
        found = [rows_of(t) for t in texts]
        ends = [0]
        for rows in found:
            ends.append(ends[-1] + len(rows))
        columns = [pa.array([r[f.name] for rows in found for r in rows], f.type) for f in fields]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))

    @F.arrow_udf(f"array<struct<{kinds}>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([lists(texts.slice(at, most).to_pylist()) for at in range(0, max(1, len(texts)), most)])

    return run


def json_nodes(text: Column | str, compat: bool = False) -> Column:
    """array<struct> of a document's nodes, children before parents; see NODE."""

    return rows_udf(NODE, lambda t: parse(t, compat))(col(text))


def json_parse(df: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """df's columns and those of its documents' nodes, a row per node."""
    return df.withColumn("_nodes", json_nodes(text, compat)).select(*df.columns, F.inline("_nodes"))


def get_node(text: str | None, key: str, value: str, value_param: str | None = None) -> list[dict]:
    """The nodes that hold a member `key` with the value, deepest first, each with the member
    value_param of its own; without such a member val is null."""
    nodes = parse(text)
    out = []
    for hit in sorted((n for n in nodes if n["error_code"] == 0 and n["name"] == key and n["val"] == value), key=lambda n: -n["level"]):
        for n in nodes:
            if n["error_code"] == 0 and n["node_start"] < hit["node_start"] and n["node_end"] > hit["node_end"] and n["level"] == hit["level"] - 1:
                node = f'"{n["val"]}"' if n["value_type"] == "string" else n["val"]
                # the node has ended, so its members are among the nodes
                inside = lambda m: m["error_code"] == 0 and m["level"] == n["level"] + 1 and n["node_start"] < m["node_start"] and m["node_end"] < n["node_end"]  # noqa: B023, E731
                params = [m for m in nodes if m["name"] == value_param and inside(m)] if value_param is not None else []
                out += [
                    {"node": node, "node_path": n["node_path"], "node_index": n["node_index"], "node_type": n["value_type"], "node_start": n["node_start"], "node_end": n["node_end"],
                     "node_level": n["level"], "node_name": n["name"], "value_name": p.get("name"), "value_type": p.get("value_type"), "val": p.get("val")}
                    for p in params or [{}]
                ]
    return out


def json_get_node(text: Column | str, key: str, value: str, value_param: str | None = None) -> Column:
    kinds = "node:string,node_path:string,node_index:bigint,node_type:string,node_start:bigint,node_end:bigint,node_level:bigint,node_name:string,value_name:string,value_type:string,val:string"

    return rows_udf(kinds, lambda t: get_node(t, key, value, value_param))(col(text))


_GAP = "[ \r\n]*"


def get_values(text: str | None, name: str) -> list[dict]:
    """Values of members called name, found by scanning: strings, unsigned numbers, objects, lists.

    The last character of the text is never looked at, and a name at the very start is missed.
    """
    if not text:
        return []
    out, quoted, at = [], f'"{name.strip()}"', 0
    member = re.compile(re.escape(quoted) + f"{_GAP}:{_GAP}")
    limit = len(text) - 1
    while True:
        at = text.find(quoted, at)
        if at < 0 or (at == 0 and not out):
            return out
        m, step = member.match(text, at, limit), at + 1
        c = text[m.end()] if m and m.end() < limit else ""
        if c and c in '{["0123456789':
            start = m.end()
            kind = {"{": "obj", "[": "lst", '"': "str"}.get(c, "num")
            end = {"str": lambda: text.find('"', start + 1), "num": lambda: _number_end(text, start, limit)}.get(kind, lambda: _block_end(text, start, limit))()
            length = None if end is None else end - start + 1 if end >= start else 1 - start
            block = None if length is None else text[start : start + max(length, 0)]
            val = block if kind == "num" or block is None else block[1:-1]
            out.append({"json_length": len(text), "node_pos": at + 1, "value_type": kind, "value_block_pos": start + 1, "value_block": block, "value_block_length": length, "val": val, "val_int": int(val) if kind == "num" and val and "." not in val else None})
            if length and length > 0:
                step = start + length + 1
        at = step


def _number_end(text: str, start: int, limit: int) -> int | None:
    m = re.compile(r"[0-9.]*").match(text, start, limit)
    return None if m[0].count(".") > 1 else m.end() - 1


def _block_end(text: str, start: int, limit: int) -> int | None:
    """Where the bracket at start closes, brackets in strings counting as brackets of the string."""
    stack = []
    for m in re.compile(r'["{}\[\]]').finditer(text, start + 1, limit):
        c = m[0]
        if c == '"':
            stack = stack[:-1] if stack[-1:] == ['"'] else [*stack, c]
        elif c in "{[":
            stack.append(c)
        elif not stack:
            if c == {"{": "}", "[": "]"}[text[start]]:
                return m.start()
        elif {"{": "}", "[": "]"}.get(stack[-1]) == c:
            stack.pop()
    return None


def json_get_value(text: Column | str, name: str) -> Column:
    kinds = "json_length:bigint,node_pos:bigint,value_type:string,value_block_pos:bigint,value_block:string,value_block_length:bigint,val:string,val_int:bigint"

    return rows_udf(kinds, lambda t: get_values(t, name))(col(text))


def to_yaml(text: str | None) -> str | None:
    """The document as YAML, two blanks per level; ends at the first error."""
    if text is None:
        return None
    nodes = parse(text)
    ordered = sorted((n for n in nodes if n["error_code"] == 0), key=lambda n: (n["node_start"], -n["node_end"]))
    out, kinds, joined = [], [], False
    for n in ordered:
        del kinds[n["level"] :]
        in_array = bool(kinds) and kinds[-1] == "array"
        plain = n["value_type"] not in ("object", "array")
        indent = " " if joined else "  " * min(max(n["level"] - 1, 0), 32)
        joined = in_array and n["value_type"] == "object"
        value = (' "' + n["val"] + '"' if n["value_type"] == "string" else " " + n["val"]) if plain else ""
        line = ("-" if in_array else "") + (f" {n['name']}:" if n["name"] is not None else "") + value
        out.append(indent + line.strip(" ") + ("\n" if not joined and (n["name"] or in_array or plain) else ""))
        kinds.append(n["value_type"])
    return "".join(out)


def json_to_yaml(text: Column | str) -> Column:
    def row(t: str | None) -> list[dict]:
        fault = next((n for n in parse(t) if n["error_code"]), {"error_code": 0, "error_text": None})
        return [{"yaml": to_yaml(t), "error_code": fault["error_code"], "error_text": fault["error_text"]}]

    return rows_udf("yaml:string,error_code:bigint,error_text:string", row)(col(text))[0]
