"""Regular expressions of log formats and masks, in Java's and in RE2's dialect.

User patterns are written as for Python's re. Spark runs Java regexes and DuckDB runs RE2, whose \\w, \\d and \\s are narrower, so
those classes are spelled out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = {
    "java": r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000",
    "re2": r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
}
_WORD = r"\p{L}\p{N}_"
SPECIAL = set("\\^$.|?*+()[]{}")


def translate(pattern: str, dialect: str = "java") -> str:
    """A Python pattern in another dialect; named groups become plain ones."""
    sets = {"w": _WORD, "d": r"\p{Nd}", "s": SPACES[dialect]}
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            k = pattern[i + 1]
            if k in sets:
                out.append(sets[k] if inside else f"[{sets[k]}]")
            elif k.lower() in sets and not inside:
                out.append(f"[^{sets[k.lower()]}]")
            else:
                out.append(c + k)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            continue
        if c == "[" and inside:
            out.append("\\[")
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif pattern.startswith("(?P<", i) and not inside:
            i = pattern.index(">", i)
            out.append("(")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """For Spark: a dot stops at \\n only, as in Python."""
    return "(?d)" + translate(pattern)


def re2(pattern: str) -> str:
    return translate(pattern, "re2")


def quoted(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


@dataclass(frozen=True)
class Header:
    """A compiled log format: pattern (Python's dialect), fields, the group of each, and the fields in optional parts."""

    pattern: str
    fields: tuple[str, ...]
    groups: tuple[int, ...]
    optional: frozenset[str]


def compile_format(log_format: str) -> Header:
    """``<Field>`` holes become lazy groups, runs of spaces any white space; what stands between is a pattern of its own."""
    out, fields, groups, optional, opened, depth = ["^"], [], [], set(), 0, []
    i = 0
    while i < len(log_format):
        c = log_format[i]
        close = log_format.find(">", i) if c == "<" else -1
        if close > i + 1 and "<" not in log_format[i + 1 : close]:
            opened += 1
            fields.append(log_format[i + 1 : close])
            groups.append(opened)
            for d in depth:
                d.append(fields[-1])
            out.append("(.*?)")
            i = close + 1
        elif c == " ":
            while log_format[i : i + 1] == " ":
                i += 1
            out.append(r"\s+")
        elif c == "\\":
            out.append(log_format[i : i + 2])
            i += 2
        else:
            if c == "(":
                opened += log_format[i + 1 : i + 2] != "?"
                depth.append([])
            elif c == ")":
                held = depth.pop()
                if log_format[i + 1 : i + 2] in ("?", "*"):
                    optional.update(held)
            out.append(c)
            i += 1
    return Header("".join(out) + "$", tuple(fields), tuple(groups), frozenset(optional))


def template_pattern(template: str, dialect: str = "java") -> str:
    """What matches a template in whole: each wildcard, with the white space after it, is any text without a line end."""
    spaces, out, literal, i = SPACES[dialect], [], [], 0
    while i < len(template):
        if template.startswith("<*>", i):
            out.append(quoted("".join(literal)))
            literal = []
            while template.startswith("<*>", i):
                i += 3
                while i < len(template) and template[i].isspace():
                    i += 1
            out.append("[^\\n]*?")
        else:
            literal.append(template[i])
            i += 1
    out.append(quoted("".join(literal)))
    return rf"\A(?:{''.join(out)})\z"


def template_pattern_column(template: Column) -> Column:
    """template_pattern as an expression, for templates that stand in a column."""
    escaped = F.regexp_replace(template, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    wild = F.regexp_replace(escaped, rf"(?:<\\\*>[{SPACES['java']}]*)+", r"[^\\n]*?")
    return F.concat(F.lit(r"\A(?:"), wild, F.lit(r")\z"))
