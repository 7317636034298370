"""JSON and XML text builders as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom.functions.text import col

OPTIONAL, AS_NULL, AS_EMPTY = 0, 1, 2
# What is taken for a JSON number, for a date and time, and for a time of day.
_NUMBER = r"\A-?(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][+-]?\d*)?\z"
_STAMP = r"\A\d{4}(?:-\d\d){2}[ T]?\d\d(?::\d\d){2}(?:\.\d+)?\z"
_CLOCK = r"\A\d{1,2}(?::\d{1,2}){1,2}(?:\.\d+)?\z"
#: Longer values of objects and arrays are not indented.
INDENT_LIMIT = 32_000


def _moment(v: Column) -> Column:
    return v.cast("string").try_cast("timestamp_ntz")


def _clock(v: Column) -> Column:
    """HH:mm:ss of a time, or of a date and time; null for any other text."""
    v = v.cast("string")
    parts = [F.lpad(F.coalesce(F.nullif(F.regexp_extract(v, r"^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?", i), F.lit("")), F.lit("0")), 2, "0") for i in (1, 2, 3)]
    return F.when(F.regexp_like(v, F.lit(_STAMP)), F.date_format(_moment(v), "HH:mm:ss")).when(F.regexp_like(v, F.lit(_CLOCK)), F.concat_ws(":", *parts))


def json_node(name: Column | str | None, val: Column, value_type: str = "str", required: int = OPTIONAL, delimiter: bool = False, formatting: bool = False, tz_hour: int | None = None, tz_min: int | None = None) -> Column:
    """A JSON member ("name": value), or a bare value without a name.

    Types: str, obj (node), array (list), num, bool, date, time, datetime[:0 T between, :1 blank,
    :2 with zone]. A null value gives an empty text, null (required 1) or an empty value (2). Objects
    and arrays get their brackets unless the value has them, and lose commas and blanks at the end.
    A null bool is true. A number that is none becomes null. `name` is a Column or a literal text.
    """
    kind, _, fmt = value_type.lower().partition(":")
    kind = {"node": "obj", "list": "array"}.get(kind, kind)
    endl, indent, blank = ("\n", "    ", " ") if formatting else ("", "", "")
    v = val.cast("string")
    if required == AS_EMPTY:
        v = F.coalesce(v, F.lit({"obj": "{}", "array": "[]"}.get(kind, "")))
    if kind in ("obj", "array"):
        if required == OPTIONAL:
            v = F.when(~F.regexp_like(v, F.lit(r"\A[\x20\x09-\x0D]*\z")), v)
        if formatting:
            # the first line stays where it is when others follow it
            lines = F.regexp_replace(v, "\n(?=[\\s\\S])", "\n" + indent)
            v = F.when(F.length(v) < INDENT_LIMIT, F.when(F.contains(v, F.lit("\n")), lines).otherwise(F.concat(F.when(v != "", indent).otherwise(""), v))).otherwise(v)
        v = F.regexp_replace(v, r"[\r\n ,]+\z", "")
        first, last = ("{", "}") if kind == "obj" else ("[", "]")
        has = F.regexp_like(v, F.lit(r"\A[\x20\x09-\x0D]*\%s" % first))
        v = F.when(v.isNull(), F.lit(None)).when(has, v).otherwise(F.concat(F.lit(first + endl + (indent if kind == "obj" else "")), v, F.lit(endl + last)))
    elif kind == "bool":
        v = F.when(F.upper(F.btrim(v)).isin("", "0", "FALSE", "F"), "false").otherwise("true")
    elif kind in ("date", "datetime"):
        zone = ""
        if fmt == "2":
            zone = "'Z'" if tz_hour is None else f"'{'+' if tz_hour > 0 else '-'}{abs(tz_hour):02d}:{tz_min or 0:02d}'"
        pattern = "yyyy-MM-dd" + ({"1": " HH:mm:ss"}.get(fmt, "'T'HH:mm:ss") + zone if kind == "datetime" else "")
        v = F.concat(F.lit('"'), F.date_format(_moment(v), pattern), F.lit('"'))
    elif kind == "time":
        v = F.concat(F.lit('"'), _clock(v), F.lit('"'))
    elif kind == "num":
        v = F.when(F.regexp_like(v, F.lit(_NUMBER)), v)
    else:
        v = F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    label = F.lit("") if name is None else F.lit(name) if isinstance(name, str) else name
    head = F.when(F.coalesce(label, F.lit("")) == "", "").otherwise(F.concat(F.lit('"'), label, F.lit('":' + blank)))
    node = F.concat(head, F.coalesce(v, F.lit("null")), F.lit("," + endl if delimiter else ""))
    return node if required > OPTIONAL else F.when(v.isNotNull(), node).otherwise("")


_CONTROL = "[\x1c-\x1f]"


def _escaped(v: Column, quotes: bool) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))[: 4 if quotes else 3]:
        v = F.replace(v, F.lit(c), F.lit(name))
    return v


def _line_ends(v: Column) -> Column:
    """CR and LF as entities, the separators 28 to 31 left out."""
    return F.regexp_replace(F.replace(F.replace(v, F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;")), _CONTROL, "")


def xml_node(name: str | Column, val: Column, vtype: str = "str", req: int = 0, attr: Column | str | None = None, xsi: str = "xsi") -> Column:
    """An XML element and a line end. Types: str[:escaped], node, bool, date, time, datetime[:1].

    Without a value: nothing (req 0), <a/> (1), or <a/> with a nil attribute if it is null (2).
    """
    kind, _, fmt = vtype.lower().partition(":")
    v = val.cast("string")
    if kind in ("date", "datetime"):
        v = F.date_format(_moment(v), "yyyy-MM-dd" + ({"1": " HH:mm:ss"}.get(fmt, "'T'HH:mm:ss") if kind == "datetime" else ""))
    elif kind == "time":
        v = _clock(v)
    elif kind == "bool":
        v = F.when(v.isNotNull(), F.when(F.upper(F.btrim(v)).isin("", "0", "FALSE", "F"), "false").otherwise("true"))
    elif kind == "str":
        v = _escaped(v, quotes=False)
        v = _line_ends(v) if fmt == "escaped" else v
    tag = F.lit(name) if isinstance(name, str) else name
    a = F.lit("") if attr is None else F.lit(attr) if isinstance(attr, str) else F.coalesce(attr, F.lit(""))
    if req == 2:
        a = F.when(v.isNull(), F.concat(a, F.lit(f' {xsi.strip() or "xsi"}:nil="true"'))).otherwise(a)
    open_ = F.concat(F.lit("<"), tag, F.when(a != "", F.concat(F.lit(" "), F.btrim(a))).otherwise(""))
    empty = F.coalesce(v, F.lit("")) == ""
    full = F.concat(F.lit(">" + "\n" * (kind == "node")), v, F.lit("</"), tag, F.lit(">"))
    node = F.concat(open_, F.when(empty, "/>").otherwise(full), F.lit("\n"))
    return F.when(empty, "").otherwise(node) if req == 0 else node


def xml_attr(name: str | Column, val: Column | str) -> Column:
    """name="value" and a blank, the value escaped."""
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit('="'), _line_ends(_escaped(col(val).cast("string"), quotes=True)), F.lit('" '))


# The five named entities.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def xml_escape(text: Column | str, compat: bool = False) -> Column:
    """The five entities; with compat the ampersand is replaced last, so that it is escaped twice."""
    order = list(ENTITIES)[1:] + ["&"] if compat else list(ENTITIES)
    v = col(text)
    for c in order:
        v = F.replace(v, F.lit(c), F.lit(ENTITIES[c]))
    return v


def xml_unescape(text: Column | str) -> Column:
    """Named entities, the ampersand last, then &#xHH; of exactly two hex digits."""
    v = col(text)
    for c in ['"', "'", "<", ">", "&"]:
        v = F.replace(v, F.lit(ENTITIES[c]), F.lit(c))
    # pieces start at each hex entity, so every piece but the first holds one at its start
    pieces = F.split(v, "(?=&.[xX][0-9A-Fa-f]{2};)")
    one = lambda p: F.when(F.regexp_like(p, F.lit(r"\A&.[xX][0-9A-Fa-f]{2};")), F.concat(F.char(F.conv(F.substr(p, F.lit(4), F.lit(2)), 16, 10).cast("bigint")), F.substr(p, F.lit(7)))).otherwise(p)
    return F.when(F.contains(v, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(v)


def xml_attributes(text: Column | str) -> Column:
    """array<struct<alias, name, val, full_attribute>> of name="value" pairs.

    Names and aliases keep letters and _ only; values are trimmed; no alias is null.
    """
    letters = "[^A-Za-zА-Яа-яЁё_]"
    found = F.regexp_extract_all(col(text), F.lit(r'[^=]*=[^"]*"[^"]*"'), F.lit(0))

    def parts(x: Column) -> Column:
        label = F.substring_index(x, "=", 1)
        alias = F.when(F.contains(label, F.lit(":")), F.regexp_replace(F.substring_index(label, ":", 1), letters, ""))
        name = F.regexp_replace(F.when(F.contains(label, F.lit(":")), F.regexp_replace(label, r"\A[^:]*:", "")).otherwise(label), letters, "")
        val = F.btrim(F.regexp_extract(x, r'\A[^=]*=[^"]*"([^"]*)"', 1))
        full = F.concat(F.coalesce(F.concat(alias, F.lit(":")), F.lit("")), name, F.lit('="'), val, F.lit('"'))
        return F.struct(alias.alias("alias"), name.alias("name"), val.alias("val"), full.alias("full_attribute"))

    return F.transform(found, parts)
