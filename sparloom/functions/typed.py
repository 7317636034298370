"""Typed parsing of text, and date formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom.functions.text import col

NULL = F.lit


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


_DATE = r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,4})"
_TIME = r"[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?(?:\.[0-9]+)?"


def string_to_type(source: Column | str, vtype: str = "str") -> Column:
    """struct of the text read as the type, and error_code (0 none, 1 integer, 2 real, 3 boolean,
    4 date or time) with error_text. Types: str, int, long, float, double, bool, date, time, datetime.

    Times are text HH:mm:ss; time_zone is in whole hours. An empty text is no error, except for bool.
    Dates are yyyy-m-d or d.m.y, a two-digit year being of 1950 to 2049.
    """
    s = col(source)
    kind = vtype.lower()
    fields = {
        "val_string": s, "val_int": _null("bigint"), "val_float": _null("float"), "val_double": _null("double"), "val_date": _null("date"),
        "val_time": _null("string"), "val_datetime": _null("timestamp_ntz"), "time_zone": _null("smallint"), "code": F.lit(0),
    }
    what = ""
    if kind.startswith(("int", "long")):
        ok = F.regexp_like(s, F.lit(r"\A[+-]?[0-9]+\z"))
        n = F.when(ok, s.try_cast("bigint"))
        fields |= {"val_int": n, "val_float": n.cast("float"), "val_double": n.cast("double"), "code": F.when(~ok & (s != ""), 1)}
        what = "integer number"
    elif kind in ("float", "double"):
        ok = F.regexp_like(s, F.lit(r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"))
        fields |= {"val_float": F.when(ok, s.try_cast("float")), "val_double": F.when(ok, s.try_cast("double")), "code": F.when(~ok & (s != ""), 2)}
        what = "real number"
    elif kind in ("bool", "boolean"):
        t = F.lower(F.btrim(s))
        n = F.when(t.isin("true", "t", "1"), 1).when(t.isin("false", "f", "0"), 0).cast("bigint")
        fields |= {"val_int": n, "code": F.when(s.isNotNull() & n.isNull(), 3)}
        what = "boolean"
    elif kind in ("date", "time", "datetime"):
        fields |= _moment(s)
        what = "date or time"
    code = F.coalesce(fields.pop("code"), F.lit(0)).cast("smallint")
    # The wording of errors.
    text = F.when(code == 0, "").otherwise(F.concat(F.lit('Value "'), s, F.lit(f'" is not {what}')))
    return F.struct(*[c.alias(n) for n, c in fields.items()], code.alias("error_code"), F.coalesce(text, F.lit("")).alias("error_text"))


def _moment(s: Column) -> dict[str, Column]:
    whole = F.replace(F.btrim(F.upper(s)), F.lit("T"), F.lit(" "))
    zone = F.regexp_extract(whole, r"([+-][0-9]{2}):[0-9]{2}\z", 1)
    bare = F.regexp_replace(whole, r"(?:Z|[+-][0-9]{2}:[0-9]{2})\z", "")
    dated = F.regexp_like(bare, F.lit(rf"\A{_DATE}(?: (?:{_TIME})?)?\z"))
    timed = F.regexp_like(bare, F.lit(rf"\A{_TIME}\z"))
    part = lambda pattern, i: F.regexp_extract(bare, pattern, i).try_cast("int")
    iso, dotted = r"\A([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", r"\A([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{1,4})"
    short = part(dotted, 3)
    year = F.coalesce(part(iso, 1), F.when(short < 50, short + 2000).when(short < 100, short + 1900).otherwise(short))
    date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.coalesce(part(iso, 2), part(dotted, 2)).cast("string"), 2, "0"), F.lpad(F.coalesce(part(iso, 3), part(dotted, 1)).cast("string"), 2, "0"))
    clock = r"(?:\A|.* )([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?(?:\.[0-9]+)?\z"
    # a fraction without seconds is not a time of day
    odd = F.regexp_like(bare, F.lit(r"[0-9]:[0-9]{1,2}\.[0-9]+\z")) & ~F.regexp_like(bare, F.lit(r":[0-9]{1,2}:[0-9]{1,2}\.[0-9]+\z"))
    time = F.concat_ws(":", *[F.lpad(F.coalesce(part(clock, i), F.lit(0)).cast("string"), 2, "0") for i in (1, 2, 3)])
    stamp = F.when(dated & ~odd, F.concat(date, F.lit(" "), time).try_cast("timestamp_ntz"))
    alone = F.when(timed & ~odd, F.date_format(F.concat(F.lit("2000-01-01 "), time).try_cast("timestamp_ntz"), "HH:mm:ss"))
    return {
        "val_datetime": stamp, "val_date": stamp.cast("date"), "val_time": F.when(stamp.isNotNull(), F.date_format(stamp, "HH:mm:ss")).otherwise(alone),
        "time_zone": F.when(s.isNotNull(), F.coalesce(zone.try_cast("smallint"), F.lit(0).cast("smallint"))),
        "code": F.when((s != "") & stamp.isNull() & alone.isNull(), 4),
    }


def format_date(ts: Column | str, fmt: str, tz_hours: int | None = None, tz_minutes: int | None = None, round_seconds: bool = False) -> Column:
    """fmt with d dd M MM yy yyyy h hh m mm s ss tz replaced, in that order, wherever they stand.

    Hours are 0 to 23. Seconds are cut off, or rounded with round_seconds, which knows no tz.
    """
    t = col(ts)
    second = F.date_format(t, "s").cast("int") + (F.unix_micros(t.cast("timestamp")) % 1_000_000) / 1e6
    values = {
        "d": F.dayofmonth(t), "M": F.month(t), "y": F.year(t), "h": F.hour(t), "m": F.minute(t),
        "s": F.round(second).cast("int") if round_seconds else F.second(t),
    }
    out = F.lit(fmt)
    for letter, value in values.items():
        if letter.lower() not in fmt.lower():
            continue
        v = value.cast("string")
        if letter == "y":
            out = F.replace(F.replace(out, F.lit("yyyy"), v), F.lit("yy"), F.right(v, F.lit(2)))
        else:
            out = F.replace(F.replace(out, F.lit(letter * 2), F.lpad(v, 2, "0")), F.lit(letter), v)
    if "tz" in fmt.lower() and not round_seconds:
        h, m = tz_hours or 0, tz_minutes or 0
        out = F.replace(out, F.lit("tz"), F.lit(f"{'+' if h >= 0 else '-'}{abs(h):02d}:{abs(m):02d}"))
    return F.when(t.isNotNull(), out) if fmt else out
