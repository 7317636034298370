"""SQL's SIMILAR TO patterns as Java and Python regular expressions."""

from __future__ import annotations

# Named classes and what they stand for.
CLASSES = {"ALPHA": "A-Za-z", "UPPER": "A-Z", "LOWER": "a-z", "DIGIT": "0-9", "ALNUM": "A-Za-z0-9", "SPACE": " ", "WHITESPACE": r"\x20\x09-\x0D"}
#: Characters with a meaning outside brackets that SIMILAR TO shares with regular expressions.
_SAME = "|*+?{}()"
_QUOTED = r".^$\/&~#-"


def to_regex(pattern: str, escape: str | None = None, whole: bool = True) -> str:
    """A regular expression (valid in Java and Python) that matches what SIMILAR TO pattern does.

    % is any text, _ any character, brackets may hold [:CLASS:] names; with whole, all of the text
    has to match, as SIMILAR TO asks.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            out.append(_literal(pattern[i]))
        elif c == "%":
            out.append(r"[\s\S]*")
        elif c == "_":
            out.append(r"[\s\S]")
        elif c == "[":
            end = i + 1
            while pattern[end] != "]":
                end = pattern.index(":]", end) + 2 if pattern.startswith("[:", end) else end + (2 if escape and pattern[end] == escape else 1)
            out.append(_bracket(pattern[i + 1 : end], escape))
            i = end
        elif c in _SAME:
            out.append(c)
        else:
            out.append(_literal(c))
        i += 1
    body = "".join(out)
    return rf"\A(?:{body})\z" if whole else f"(?:{body})"


def _literal(c: str) -> str:
    return "\\" + c if c in _QUOTED or c in _SAME or c in "[]" else c


def _bracket(body: str, escape: str | None) -> str:
    out, i = [], 0
    if body.startswith("^"):
        out, i = ["^"], 1
    while i < len(body):
        if body.startswith("[:", i):
            end = body.index(":]", i)
            out.append(CLASSES[body[i + 2 : end].upper()])
            i = end + 2
            continue
        if escape and body[i] == escape:
            i += 1
            out.append("\\" + body[i])
        else:
            out.append("\\" + body[i] if body[i] in "[\\&^" else body[i])
        i += 1
    return "[" + "".join(out) + "]"


# What each shorthand stands for in the long form.
SHORTHAND = {
    r"\s": "[[:WHITESPACE:]]",
    r"\S": "[^[:WHITESPACE:]]",
    r"\w": "[a-zA-Zа-яёА-ЯЁ0-9_]",
    r"\W": "[^a-zA-Zа-яёА-ЯЁ0-9_]",
    r"\d": "[0-9]",
    r"\D": "[^0-9]",
    r"\.": ".",
    "\\\\": "\\",
    ".": "_",
}


def shorthand(pattern: str) -> str:
    r"""Rewrites \s \S \w \W \d \D \. and . of a pattern into the form SIMILAR TO knows."""
    out, i = [], 0
    while i < len(pattern):
        key = next((k for k in (pattern[i : i + 2], pattern[i]) if k in SHORTHAND), None)
        out.append(SHORTHAND[key] if key else pattern[i])
        i += len(key or " ")
    return "".join(out)
