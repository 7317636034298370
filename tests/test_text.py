import random
import pytest
from pyspark.sql import functions as F

from sparloom.functions import text as T
from sparloom.functions import typed as TY
from sparloom.functions.similar import shorthand, to_regex

# The inputs and results of the parametrised cases for stripping and for person names are
# given from outside; they are kept whole.
NUM = "0123456789"
LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt"


@pytest.mark.parametrize(
    ("source", "symbols", "rule", "substitute", "expected"),
    [
        ("", NUM, 0, None, "0:"),
        ("123abc45-67qwe890rty", NUM, 0, None, "10:abc-qwerty"),
        ("123abc45-67qwe890rty", NUM, 1, None, "10:1234567890"),
        (LOREM, " ", 0, "_", "12:" + LOREM.replace(" ", "_")),
        ("Heeellooo woooorld, I am yoooour frieeeend, BROOO", "aeiouy", 2, None, "13:Hello world, I am your friend, BROOO"),
        ("Heeellooo woooorld, I am yoooour frieeeend, BROOO", "aeiouy", 2, "?", "13:He??llo?? wo???rld, I am yo???ur frie???nd, BROOO"),
        ("Alphabetical text", NUM, 0, "?", "0:Alphabetical text"),
    ],
)
def test_strip_text(value, source, symbols, rule, substitute, expected):
    r = value(T.strip_text("s", symbols, rule, substitute), s=source)
    # the golden count of the drop and keep rules is that of affected characters
    assert f"{r['affected']}:{r['result']}" == expected


def test_strip_text_keeps_null_and_quotes_symbols(value):
    assert value(T.strip_text("s", "ab"), s=None)["result"] is None
    assert value(T.strip_text("s", "]^-\\"), s="a]b^c-d\\e")["result"] == "abcde"
    assert value(T.strip_text("s", ""), s="abc")["affected"] == 0


@pytest.mark.parametrize(
    ("full", "use_case", "expected"),
    [
        ("", False, (None, None, None)),
        ("Lastname Firstname Midname", False, ("Lastname", "Firstname", "Midname")),
        ("LastnameFirstnameMidname", True, ("Lastname", "Firstname", "Midname")),
        ("LastnameFM", True, ("Lastname", "F", "M")),
        ("Lastname F. M.", True, ("Lastname", "F.", "M.")),
        ("Last-Name F. M.", True, ("Last-Name", "F.", "M.")),
        ("Last-Name F. M. (extra data)", True, ("Last-Name", "F.", "M.")),
        ("  Иванов  Пётр Ильич оглы (x)", False, ("Иванов", "Пётр", "Ильич оглы")),
        (None, False, (None, None, None)),
    ],
)
def test_split_person_name(value, full, use_case, expected):
    assert tuple(value(T.split_person_name("s", use_case), s=full)) == expected


@pytest.mark.parametrize(
    ("text", "delimiter", "parts"),
    [
        ("a, b ,,c", ",", ["a", "b", "", "c"]),
        ("a,b,", ",", ["a", "b"]),
        (",", ",", [""]),
        ("a--b--", "--", ["a", "b", ""]),
        ("", ",", [""]),
        (" x ", "", [" x "]),
        ("a.b|c", ".", ["a", "b|c"]),
    ],
)
def test_split_text(value, text, delimiter, parts):
    rows = value(T.split_text("s", delimiter), s=text)
    assert [r["part"] for r in rows] == parts
    assert [r["idx"] for r in rows] == list(range(1, len(parts) + 1))


def test_split_text_of_null(value):
    assert value(T.split_text("s"), s=None) is None


def test_split_then_join_is_identity(value):
    for s in ("a,b", "x", ",a,,b"):
        assert ",".join(r["part"] for r in value(T.split_text("s", ",", trim_part=False), s=s)) == s


def test_ci_replace(value):
    assert value(T.ci_replace("s", "AB.", "$1\\"), s="xab.yAB.z abx") == "x$1\\y$1\\z abx"
    assert value(T.ci_replace("s", "ж", "_"), s="ЖЖж") == "___"


def test_regexp_search(value):
    all_ = value(T.regexp_search("s", "[0-9]+", only_first=False), s="a123")
    assert [(r["match"], r["startpos"]) for r in all_] == [("123", 2), ("23", 3), ("3", 4)]
    # the longest alternative wins, not the first
    assert value(T.regexp_search("s", "a|ab|abc"), s="xabcd")[0]["match"] == "abc"
    assert value(T.regexp_search("s", ""), s="abc") == []
    assert value(T.regexp_search("s", r"\d\d\.\d", 1), s="v12.5")[0]["match"] == "12.5"
    assert value(T.regexp_search("s", "a"), s=None) is None


def test_contains_word(value):
    found = lambda s, w, cs=True: value(T.contains_word("s", w, cs), s=s)["does_contain"]
    assert found("the cat", "cat") == 1
    assert found("concat", "cat") == 0
    assert found("Кот-кит", "кит") == 1
    assert found("A CAT!", "cat", False) == 1
    assert found("a+b", "+") == 1 or found("a + b", "+") == 1
    assert found(None, "x") == 0


@pytest.mark.parametrize("limit", [None, 0, 1, 2, 5])
@pytest.mark.parametrize("skip_lower", [False, True])
def test_abbreviate_character_by_character(spark, limit, skip_lower):
    """Against the rule applied to one character after the other; the expression stays small."""

    def kind(c):
        return next((k for k, of in enumerate(("abcz", "ABCZ", "абяё", "АБЯЁ", "019", ".,")) if c in of), 6)

    def want(text):
        out, before, parts = "", 6, 0
        for c in text.strip(" "):
            k = kind(c)
            starts = not skip_lower and (k == 0 and before not in (0, 1, 4) or k == 2 and before not in (2, 3, 4))
            if (starts or k == 5 and before in (4, 6) or k in (1, 3, 4)) and (limit is None or parts < limit):
                out, parts = out + c, parts + (k != before)
            before = k
        return out

    rng = random.Random(5)
    texts = ["", " ", "..", "1..", *("".join(rng.choice("abzABZабёАБЁ019.,  -\n😀") for _ in range(rng.randrange(1, 25))) for _ in range(500))]
    df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", T.abbreviate("s", parts_limit=limit, skip_lower=skip_lower).alias("v"))
    assert [(r.s, r.v) for r in df.collect()] == [(x, want(x)) for x in texts]
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 1_500


def test_abbreviate(value):
    assert value(T.abbreviate("s"), s="Иванов ИВан-ЮSupov IV именуемый 192.87ым") == "ИИВЮSIVи192.87"
    assert value(T.abbreviate("s", parts_limit=2), s="Ann Bob Carl") == "AB"
    assert value(T.abbreviate("s", skip_lower=True), s="Ann of York") == "AY"
    assert value(T.abbreviate("s"), s=None) is None


def test_norm_name_and_first_diff(value):
    assert value(T.norm_name("s"), s="  iVAN petrov ") == "Ivan petrov"
    assert tuple(value(T.first_diff("a", "b", 1), a="foobar", b="foozom")) == ("obar", "ozom", 4)
    assert value(T.first_diff("a", "b"), a="foo", b="foobar")["pos"] == 0
    assert value(T.first_diff("a", "b"), a="foo", b="")["pos"] == 0


def test_fix_encoding(value):
    garbled = "".join(x for x, _ in T.misread_cyrillic())
    assert value(T.fix_encoding("s"), s=garbled) == "".join(y for _, y in T.misread_cyrillic())
    assert len(T.misread_cyrillic()) == 66


def test_utf8_to_utf16(value):
    run = lambda data: value(T.utf8_to_utf16("b"), b=(data, "binary"))
    assert bytes(run("Źя€a".encode())["data"]) == b"\xff\xfe" + "Źя€a".encode("utf-16-le")
    assert run(b"a\x80b")["error_code"] == 1
    assert run(b"a\xffb")["error_code"] == 2
    assert run(b"\xc5a")["error_code"] == 3
    assert run("😀".encode())["error_code"] == 99
    assert run(b"")["error_code"] == 0
    assert run(None)["data"] is None


def test_obfuscate_round_trip(value):
    for s in ("abc", "Ёлка, €", "a,b"):
        assert value(T.obfuscate(T.obfuscate("s"), 1), s=s) == s
    assert value(T.obfuscate("s"), s="AB") == "65,66,"


def test_int_to_bin(value):
    run = lambda n, a=4: value(T.int_to_bin("n", a), n=(n, "bigint"))
    assert [run(5), run(0), run(16), run(-5)] == ["0101", "0000", "00010000", "00-5"]
    assert run(5, 8) == "00000101"


def test_hash_dict(value):
    d = value(T.hash_dict(F.lit(""), F.lit("k"), F.lit("v"))["updated_dict"])
    found = value(T.hash_dict("d", F.lit("k")), d=d)
    assert found["found_value"] == "v" and d[found["found_value_start"] - 1 : found["found_value_end"]] == "v"
    assert value(T.hash_dict("d", F.lit("other")), d=d)["found_value"] is None
    assert value(T.hash_dict("d", F.lit("k"), F.lit("w"))["updated_dict"], d=d).endswith(":w")


@pytest.mark.parametrize(("number", "digit"), [("12345", 5), ("401", 0), ("9999", 4), ("99999999", 8)])
def test_mod10(value, number, digit):
    assert value(T.mod10("s"), s=number) == digit


def test_policy_number(value):
    run = lambda s: value(T.validate_policy_number("s"), s=s)
    digit = value(T.mod10("s"), s="123456789012345")
    assert run(f" 123456789012345{digit} ")["is_correct"]
    wrong = run(f"123456789012345{(digit + 1) % 10}")
    assert wrong["error_code"] == 2 and wrong["correct_policy_number"] == f"123456789012345{digit}"
    assert run("12x")["error_code"] == 1 and run("12x")["check_value"] is None
    assert run(None)["error_code"] == 1


def test_assert_equal(value):
    assert value(T.assert_equal("a", "b"), a="x", b="x") is None
    assert value(T.assert_equal("a", "b"), a=None, b=None) is None
    with pytest.raises(Exception, match="is distinct from"):
        value(T.assert_equal("a", "b"), a="a", b="a ")


@pytest.mark.parametrize(
    ("text", "kind", "field", "expected", "code"),
    [
        ("42", "int", "val_int", 42, 0),
        ("+7", "long", "val_int", 7, 0),
        ("4.2", "int", "val_int", None, 1),
        ("", "int", "val_int", None, 0),
        ("-.5", "double", "val_double", -0.5, 0),
        ("1.", "float", "val_double", 1.0, 0),
        ("1e5", "double", "val_double", None, 2),
        (" T ", "bool", "val_int", 1, 0),
        ("0", "bool", "val_int", 0, 0),
        ("", "bool", "val_int", None, 3),
        (None, "bool", "val_int", None, 0),
        ("2023-2-1", "date", "val_date", "2023-02-01", 0),
        ("1.2.2023", "date", "val_date", "2023-02-01", 0),
        ("01.02.23", "date", "val_date", "2023-02-01", 0),
        ("2023-02-01T12:34:45.5Z", "datetime", "val_datetime", "2023-02-01 12:34:45", 0),
        ("2023-02-01T12:34:45-05:30", "datetime", "time_zone", -5, 0),
        ("12:34", "time", "val_time", "12:34:00", 0),
        ("2017-10-01 00:01.4444", "datetime", "val_datetime", None, 4),
        ("2023-13-01", "date", "val_date", None, 4),
        ("soon", "date", "val_date", None, 4),
    ],
)
def test_string_to_type(value, text, kind, field, expected, code):
    r = value(TY.string_to_type("s", kind), s=text)
    assert r["error_code"] == code
    assert (r[field] if expected is None or isinstance(expected, (int, float)) else str(r[field])) == expected


def test_format_date(value):
    ts = F.expr("timestamp'2022-03-04 05:06:59.6'")
    assert value(TY.format_date(ts, "d dd M MM yy yyyy h hh m mm s ss")) == "4 04 3 03 22 2022 5 05 6 06 59 59"
    assert value(TY.format_date(ts, "tz", -2, 30)) == "-02:30" and value(TY.format_date(ts, "tz")) == "+00:00"
    assert value(TY.format_date(ts, "s", round_seconds=True)) == "60"
    assert value(TY.format_date(ts, "day")) == "4ay"


def test_similar_patterns():
    import re

    py = lambda p, e=None: re.compile(to_regex(p, e).replace(r"\z", r"\Z"))
    assert py("a%").match("abc\n") and not py("a_").match("abc")
    assert py("($+|$-)?[0-9]+", "$").match("-12") and not py("[0-9].[0-9]").match("1x2")
    assert py("[[:WHITESPACE:]]*&{%", "&").match(" \t{x")
    assert shorthand(r"\d.\.") == "[0-9]_."
