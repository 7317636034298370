"""Text functions as Column expressions; Python workers only where noted."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.similar import shorthand, to_regex

CYRILLIC_WORD = r"\p{Alpha}0-9А-ЯЁа-яё"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(text: str) -> str:
    """A Java regular expression that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replacement(text: str) -> str:
    """A Java replacement that stands for the text itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def char_class(symbols: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in symbols)


def explode_parts(df: DataFrame, parts: Column) -> DataFrame:
    """df's columns and those of an array of structs, a row per element; no row for none."""
    return df.select("*", F.inline(parts))


def split_text(text: Column | str, delimiter: str = ",", trim_part: bool = True) -> Column:
    """array<struct<idx bigint, part string>>, idx from 1.

    Null text gives null. Empty text or delimiter gives one untrimmed part. A single-character
    delimiter leaves no empty part at the end, a longer one does; other empty parts stay.
    """
    t = col(text)
    parts = F.split(t, quoted(delimiter)) if delimiter else F.array(t)
    if len(delimiter) == 1:
        parts = F.when(F.endswith(t, F.lit(delimiter)), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    if trim_part:
        parts = F.when(t == "", F.array(t)).otherwise(F.transform(parts, lambda p: F.btrim(p))) if delimiter else parts
    rows = F.transform(parts, lambda p, i: F.struct((i + 1).cast("bigint").alias("idx"), p.alias("part")))
    return F.when(t.isNotNull(), rows)


DROP, KEEP, SQUEEZE = 0, 1, 2


def strip_text(source: Column | str, symbols: str = "", rule: int = DROP, substitute: str = "") -> Column:
    """struct<result string, affected bigint>.

    DROP replaces the listed characters, KEEP all others, SQUEEZE the second and later of the same
    listed character in a row; each affected character becomes the substitute.
    """
    s = col(source)
    listed = char_class(symbols or "")
    # Java reads "(?!)" as "nothing matches"
    pattern = {
        DROP: f"[{listed}]" if listed else "(?!)",
        KEEP: f"[^{listed}]" if listed else r"[\s\S]",
        SQUEEZE: f"(?<=([{listed}]))\\1" if listed else "(?!)",
    }[rule]
    result = F.regexp_replace(s, pattern, replacement(substitute or ""))
    return F.struct(result.alias("result"), F.coalesce(F.regexp_count(s, F.lit(pattern)), F.lit(0)).cast("bigint").alias("affected"))


def ci_replace(source: Column | str, what: str, new: str = "") -> Column:
    """Every occurrence of `what`, whatever its case, becomes `new`."""
    if not what:
        return col(source)
    return F.regexp_replace(col(source), "(?iu)" + quoted(what), replacement(new))


#: A class of characters, once or repeated: its greedy match is the longest one.
ONE_RUN = re.compile(r"\(\?:\[[^\[\]\\]+\]\+?\)")


def regexp_search(text: Column | str, pattern: str, syntax: int = 0, only_first: bool = True) -> Column:
    """array<struct<match string, startpos bigint>>: at each start, the longest match of a SIMILAR TO
    pattern; the leftmost only, or one per start, so that matches overlap. An empty match is none.

    syntax 1 accepts backslash shorthands. Leftmost-longest search is not what Java does, so this
    runs in Arrow-fed Python workers, but for the first run of one class of characters, where both agree.
    """
    body = to_regex(shorthand(pattern) if syntax else pattern, whole=False) if pattern else None
    if body and only_first and ONE_RUN.fullmatch(body):
        t = col(text)
        at = F.regexp_instr(t, F.lit(body)).cast("bigint")
        found = F.array(F.struct(F.regexp_extract(t, body, 0).alias("match"), at.alias("startpos")))
        return F.when(t.isNull(), F.lit(None)).when(at > 0, found).otherwise(F.slice(found, 1, 0))

    @F.pandas_udf("array<struct<match:string,startpos:bigint>>")
    def search(texts: pd.Series) -> pd.Series:
        import regex

        if body is None:
            return texts.map(lambda t: None if t is None else [])
        longest = regex.compile(body, regex.POSIX)

        def one(t):
            if t is None:
                return None
            out, at = [], 0
            while at < len(t):
                m = longest.search(t, at)
                if m is None:
                    break
                at = m.start() + 1
                if m.end() > m.start():
                    out.append({"match": m[0], "startpos": at})
                    if only_first:
                        break
            return out

        return texts.map(one)

    return search(col(text))


def contains_word(text: Column | str, word: str, case_sensitive: bool = True) -> Column:
    """struct<text string, does_contain int>: whether the word stands alone; the text is lowered if
    case does not matter. Null text contains nothing."""
    t = col(text) if case_sensitive else F.lower(col(text))
    w = word if case_sensitive else word.lower()
    found = F.regexp_like(t, F.lit(f"(^|[^{CYRILLIC_WORD}]){quoted(w)}([^{CYRILLIC_WORD}]|$)"))
    return F.struct(t.alias("text"), F.coalesce(found, F.lit(False)).cast("int").alias("does_contain"))


def abbreviate(text: Column | str, parts_limit: int | None = None, skip_lower: bool = False) -> Column:
    """First letters of words, all capitals and digits, and a point or comma after a digit.

    A part begins where a taken character is of another kind than the one before it (lower and upper
    Latin, lower and upper Cyrillic, digit, point, other); after parts_limit parts nothing follows.
    """
    trimmed = F.btrim(col(text))
    letters, points = "a-zA-Zа-яёА-ЯЁ", "(?<![a-zA-Zа-яёА-ЯЁ.,])[.,]"
    if parts_limit is not None:
        # up to the character that begins the last part; atomic, so that no part's begin is passed over
        begins = [f"(?<![{k}])[{k}]" for k in ("A-Z", "А-ЯЁ", "0-9")] + [points] + ["(?<![a-zA-Z0-9])[a-z]", "(?<![а-яёА-ЯЁ0-9])[а-яё]"] * (not skip_lower)
        upto = F.regexp_extract(trimmed, f"(?s)^(?>.*?(?:{'|'.join(begins)})){{{max(parts_limit, 1)}}}", 0)
        trimmed = F.when(upto != "", upto).otherwise(trimmed) if parts_limit > 0 else F.left(trimmed, F.lit(0))
    # what is not taken goes, as told by the character before it
    lower = ["[a-zа-яё]"] if skip_lower else ["(?<=[a-zA-Z0-9])[a-z]", "(?<=[а-яёА-ЯЁ0-9])[а-яё]"]
    return F.regexp_replace(trimmed, "|".join([f"[^{letters}0-9.,]", f"(?<=[{letters}.,])[.,]", *lower]), "")


def norm_name(name: Column | str) -> Column:
    """Trimmed, the first letter upper, the rest lower."""
    t = F.btrim(col(name))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))


_L = "[-A-Za-zА-ЯЁа-яё.]"
_CAPITAL = "[A-ZА-ЯЁ]"


def split_person_name(fullname: Column | str, use_case: bool = False) -> Column:
    """struct<lastname, firstname, midname>: parts end at a blank or a point, with use_case also
    before a capital that follows no hyphen; the third part may hold blanks and ends at the first
    foreign character. Foreign characters in the first two are dropped. Empty parts are null."""
    t = F.coalesce(col(fullname), F.lit(""))
    more = f"(?:(?<=-){_CAPITAL}|[^ .A-ZА-ЯЁ])" if use_case else "[^ .]"
    part = rf"((?:\.|[-A-Za-zА-ЯЁа-яё]{more}*\.?))"
    skip = "[^-A-Za-zА-ЯЁа-яё.]*"
    whole = rf"^{skip}{part}?(?:{skip}{part})?(?:{skip}({_L}[-A-Za-zА-ЯЁа-яё. ]*))?"

    def name(i: int) -> Column:
        return F.nullif(F.regexp_replace(F.regexp_extract(t, whole, i), "[^-A-Za-zА-ЯЁа-яё.]", ""), F.lit(""))

    mid = F.nullif(F.rtrim(F.regexp_extract(t, whole, 3)), F.lit(""))
    return F.struct(name(1).alias("lastname"), name(2).alias("firstname"), mid.alias("midname"))


def first_diff(a: Column | str, b: Column | str, context: int = 32) -> Column:
    """struct<t1, t2, pos>: the first place (from 1) where the texts differ within their common
    length, 0 if none, and both texts from `context` characters before it."""
    a, b = col(a), col(b)
    m = F.when(a.isNotNull() & b.isNotNull(), F.least(F.length(a), F.length(b)))
    places = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    # halving would read less; texts compared are short, and this stays one expression
    pos = F.coalesce(F.get(F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), F.lit(0)), F.lit(0))
    start = F.greatest(F.lit(1), pos - context)
    return F.struct(F.substr(a, start).alias("t1"), F.substr(b, start).alias("t2"), pos.cast("bigint").alias("pos"))


def misread_cyrillic() -> list[tuple[str, str]]:
    """Each Cyrillic letter with what its UTF-8 bytes look like in code page 1251, in order."""
    letters = [chr(c) for c in range(0x410, 0x450)]
    letters.insert(6, "Ё")
    letters.insert(39, "ё")
    return [("".join(bytes([b]).decode("cp1251", "replace").replace("�", chr(b)) for b in x.encode()), x) for x in letters]


def fix_encoding(source: Column | str) -> Column:
    """Undoes UTF-8 that was read as code page 1251, letter by letter."""
    out = col(source)
    for wrong, right in misread_cyrillic():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def utf8_to_utf16(data: Column | str) -> Column:
    """struct<error_code bigint, error_text, data binary, len bigint> for UTF-8 bytes.

    data starts with FF FE and is little-endian; at an error it ends before the faulty character.
    Codes: 1 a continuation at the start of a character, 2 no valid first byte, 3 a missing
    continuation, 99 a four-byte character. Null and empty input stay as they are.
    """
    # Error codes and their texts.
    texts = {
        0: "",
        1: "unexpected extra block (10xxxxxx at the begining of character)",
        2: 'unexpected block (for "1" digits at the begining of character)',
        3: "unexpected block (without 10xxxxxx at the begining)",
        99: "32 bit encoding is not yet supported",
    }
    hexed = F.hex(col(data))
    one, cont = "[0-7][0-9A-F]", "[89AB][0-9A-F]"
    two, three = f"[CD][0-9A-F]{cont}", f"E[0-9A-F]{cont}{cont}"
    good = F.regexp_extract(hexed, f"^(?:{one}|{two}|{three})*+", 0)
    bad = F.substr(hexed, F.length(good) + 1)
    code = (
        F.when(bad == "", 0)
        .when(F.regexp_like(bad, F.lit("^[89AB]")), 1)
        .when(F.regexp_like(bad, F.lit("^F[0-7]")), 99)
        .when(F.regexp_like(bad, F.lit("^F[89A-F]")), 2)
        # a character cut off by the end of the data is no error
        .when(F.regexp_like(bad, F.lit(f"^(?:[CD].|E.(?:{cont})?)$")), 0)
        .otherwise(3)
    )
    code = F.when(hexed.isNull(), 0).otherwise(code).cast("bigint")
    utf16 = F.concat(F.unhex(F.lit("FFFE")), F.encode(F.decode(F.unhex(good), "UTF-8"), "UTF-16LE"))
    text = F.element_at(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]), code)
    return F.struct(code.alias("error_code"), text.alias("error_text"), F.when(F.length(hexed) > 0, utf16).otherwise(col(data).cast("binary")).alias("data"), (F.length(hexed) / 2).cast("bigint").alias("len"))


def obfuscate(text: Column | str, direction: int = 0) -> Column:
    """0: the code of each character, each followed by a comma. Else: the text of such codes."""
    t = col(text)
    if direction == 0:
        coded = F.array_join(F.transform(F.split(t, ""), lambda c: F.concat(F.ascii(c).cast("string"), F.lit(","))), "")
        return F.when(t == "", "").otherwise(coded)
    codes = F.filter(F.split(t, ","), lambda c: c != "")
    return F.array_join(F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0")), "UTF-32")), "")


def int_to_bin(n: Column | str, adjust: int = 4) -> Column:
    """Binary digits, left-padded with zeros to a multiple of adjust; a negative number keeps its
    decimal digits and sign."""
    n = col(n)
    digits = F.when(n < 0, n.cast("string")).otherwise(F.bin(n))
    width = (F.floor((F.length(digits) + (adjust - 1)) / adjust) * adjust).cast("int")
    return F.lpad(digits, width, F.lit("0"))


def hash_dict(existing: Column | str, key: Column | str, new_value: Column | str | None = None, item: str = ",", kv: str = ":") -> Column:
    """A text map of hash(key) to value: looked up, and with new_value changed or extended.

    struct<key_hash, found_value, found_key_start, found_value_start, found_value_end, updated_dict,
    updated_value>; positions from 1. The hash is xxhash64 of the key.
    """
    d, new = F.coalesce(col(existing), F.lit("")), F.lit(None).cast("string") if new_value is None else col(new_value)
    h = F.xxhash64(col(key))
    head = F.concat(h.cast("string"), F.lit(kv))
    at = F.position(F.concat(F.lit(item), head), F.concat(F.lit(item), d))
    start = F.when(at > 0, at + F.length(head))
    rest = F.position(F.lit(item), d, start)
    end = F.when(at > 0, F.when(rest > 0, rest - 1).otherwise(F.length(d)))
    found = F.when(at > 0, F.substr(d, start, end - start + 1))
    changed = F.concat(F.substr(d, F.lit(1), start - 1), new, F.substr(d, end + 1))
    added = F.concat(d, F.when(d != "", F.lit(item)).otherwise(F.lit("")), head, new)
    updated = F.when(new.isNull(), d).when(at > 0, changed).otherwise(added)
    return F.struct(
        h.alias("key_hash"), found.alias("found_value"), at.cast("bigint").alias("found_key_start"), start.cast("bigint").alias("found_value_start"),
        end.cast("bigint").alias("found_value_end"), updated.alias("updated_dict"), new.alias("updated_value"),
    )


def dict_put(existing: Column, key: Column, value: Column) -> Column:
    """The same over a MapType column."""
    return F.map_concat(F.map_filter(F.coalesce(existing, F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.create_map(key, value))


def mod10_parts(number: Column) -> tuple[Column, Column, Column, Column]:
    """(even digits, odd digits, check number, check value) of the digits counted from the right."""
    digits = F.split(F.reverse(number), "")
    even = F.array_join(F.filter(digits, lambda x, i: i % 2 == 1), "")
    odd = F.array_join(F.filter(digits, lambda x, i: i % 2 == 0), "")
    check = F.concat(even, (F.try_to_number(odd, F.lit("9" * 18)) * 2).cast("bigint").cast("string"))
    value = F.aggregate(F.split(check, ""), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.try_cast("bigint"), F.lit(0)))
    return even, odd, check, value


def mod10(number: Column | str) -> Column:
    """The Mod10 check digit of a number's digits."""
    *_, value = mod10_parts(col(number))
    return F.right((10 - value % 10).cast("string"), F.lit(1)).cast("int")


def validate_policy_number(number: Column | str) -> Column:
    """Ten fields about a 16-digit policy number whose last digit is a Mod10 check digit.

    Code 1: not 16 digits; code 2: another check digit is right. Further fields are null for code 1.
    """
    t = F.btrim(col(number))
    ok = F.coalesce(F.regexp_like(t, F.lit(r"\A[0-9]{16}\z")), F.lit(False))
    # of exactly 15 digits, counted from the right: plain arithmetic, so that nothing leaves generated code
    digit = lambda i: F.substr(t, F.lit(16 - i), F.lit(1))
    evens, odds = [digit(i) for i in range(2, 16, 2)], [digit(i) for i in range(1, 16, 2)]
    even, odd = F.concat(*evens), F.concat(*odds)
    twice = odd.try_cast("bigint") * 2
    check = F.concat(even, twice.cast("string"))
    value = sum((e.try_cast("bigint") for e in evens), F.lit(0).cast("bigint"))
    for k in range(9):  # the digits of twice a number of eight
        value = value + (twice / 10**k).cast("bigint") % 10
    right = F.right((10 - value % 10).cast("string"), F.lit(1))
    same = F.right(t, F.lit(1)) == right
    code = F.when(~ok, 1).when(~same, 2).otherwise(0).cast("bigint")
    # Error texts.
    text = F.when(~ok, "Полис ОМС единого образца должен содержать только 16 цифр").when(~same, "Неверная контрольная цифра").otherwise("")
    return F.struct(
        (code == 0).alias("is_correct"), code.alias("error_code"), text.alias("error_text"),
        F.when(ok, F.right(t, F.lit(1)).try_cast("int")).alias("current_check_digit"), F.when(ok, right.try_cast("int")).alias("correct_check_digit"),
        F.when(ok, F.concat(F.left(t, F.lit(15)), right)).alias("correct_policy_number"),
        F.when(ok, even).alias("number_by_even_digits"), F.when(ok, odd).alias("number_by_odd_digits"),
        F.when(ok, check).alias("check_number"), F.when(ok, value).alias("check_value"),
    )


def assert_equal(left: Column | str, right: Column | str, prefix: str = "") -> Column:
    """Null if both are the same (null equals null), else an error that shows both."""
    a, b = col(left).cast("string"), col(right).cast("string")
    shown = lambda c: F.coalesce(c, F.lit("null"))
    return F.when(~a.eqNullSafe(b), F.raise_error(F.concat(F.lit(prefix), shown(a), F.lit(" is distinct from "), shown(b))))


def inflect_name(name: Column | str, case: int, sex: Column | int, engine: Callable[[str, int, int | None], tuple[int, str]]) -> Column:
    """A name in one of six grammatical cases, by an engine of the caller's own.

    engine(name, case, sex) gives (state, text); sex is 1 for 1, 0 for 2, and None otherwise, for the
    engine to find out. A state other than 0 gives "state (case)". There are no rules here.
    """

    @F.pandas_udf("string")
    def inflect(names: pd.Series, sexes: pd.Series) -> pd.Series:
        def one(n, s):
            if n is None:
                return None
            state, text = engine(n, case, {1: 1, 2: 0}.get(None if pd.isna(s) else int(s)))
            return text if state == 0 else f"{state} ({case})"

        return pd.Series([one(n, s) for n, s in zip(names, sexes, strict=True)])

    return inflect(col(name), F.lit(sex) if isinstance(sex, int) else sex)
