"""Terms: literal columns, typed views of them, and text patterns as Columns.

A resource is its IRI, a blank node a name that starts with ``_:``. A literal is
kept as ``lex`` (its text), ``num`` (double, for numeric datatypes), ``d`` (the
datatype's IRI) and ``lang``. Numeric criteria look at ``num`` only, so text
never compares as greater than a number.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v

QUAD_OBJ = "c string, s string, p string, o string"
QUAD_DATA = "c string, s string, p string, lex string, num double, d string, lang string"
NUMERIC = (*v.INTEGERS, *v.DECIMALS)

_custom: dict[str, Callable[[Column], Column]] = {}


def declare_datatype(iri: str, parser: Callable[[Column], Column]) -> None:
    """How ``typed`` reads literals of a datatype of one's own: a function of the ``lex`` Column."""
    _custom[iri] = parser


def typed(datatype: str, lex: Column | str = "lex") -> Column:
    """The literal as a value of Spark's own type; malformed text gives null."""
    x = F.col(lex) if isinstance(lex, str) else lex
    if datatype in _custom:
        return _custom[datatype](x)
    if datatype in v.INTEGERS:
        return x.try_cast("decimal(38,0)")
    if datatype in v.DECIMALS:
        return x.try_cast("double")
    if datatype == v.BOOLEAN:
        return x.isin("true", "1")
    if datatype == v.DATETIME:
        return x.try_cast("timestamp")
    if datatype == v.DATE:
        return x.try_cast("date")
    if datatype == v.TIME:
        parts = F.split(x, ":")
        return (F.get(parts, F.lit(0)).try_cast("int") * 3600 + F.get(parts, F.lit(1)).try_cast("int") * 60 + F.get(parts, F.lit(2)).try_cast("int")).cast("long")
    return x


def number(lex: Column, d: Column) -> Column:
    """The ``num`` column of a literal."""
    return F.when(d.isin(*NUMERIC), lex.try_cast("double"))


def literal_lex(value: object) -> tuple[str, str, str | None]:
    """(lex, datatype, lang) that a Python value is stored as."""
    if isinstance(value, Loc):
        return value.text, v.PLAIN, value.lang
    if isinstance(value, bool):
        return str(value).lower(), v.BOOLEAN, None
    if isinstance(value, int):
        return str(value), v.INTEGER, None
    if isinstance(value, float):
        return repr(value), v.XSD + "decimal", None
    if hasattr(value, "isoformat"):
        text = value.isoformat()
        return text, v.DATETIME if "T" in text else v.DATE if "-" in text else v.TIME, None
    return str(value), v.STRING, None


class Loc:
    """Text in a language."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang


def glob_regex(pattern: str) -> str:
    """A pattern with ``*``, ``?`` and ``[...]`` as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1 : j].replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c) if not c.isalnum() else c
        i += 1
    return f"(?s)^{out}$"


def matches_glob(x: Column, pattern: str, case_sensitive: bool = True) -> Column:
    """Glob match; plain prefix, suffix and infix patterns stay simple predicates that scans can use.

    Without a star the text is compared as it is. Without case, only ``*`` is
    special, and ``_`` and ``%`` stand for themselves.
    """
    if "*" not in pattern:
        return x == pattern if case_sensitive else F.lower(x) == pattern.lower()
    if not case_sensitive:
        escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return x.ilike(escaped.replace("*", "%"))
    body = pattern.strip("*")
    if not re.search(r"[*?\[]", body):
        if pattern.startswith("*") and pattern.endswith("*"):
            return x.contains(body)
        return x.endswith(body) if pattern.startswith("*") else x.startswith(body)
    return x.rlike(glob_regex(pattern))


def fold(x: Column) -> Column:
    """Lower case without diacritics: decomposed marks go."""
    return F.lower(_strip_accents(x))


#: Latin letters with marks and their bare letters, by canonical decomposition.
_MARKED = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
_MARKED = {k: x for k, x in _MARKED.items() if x != k and x.isascii()}


def _strip_accents(x: Column) -> Column:
    return F.translate(x, "".join(_MARKED), "".join(_MARKED.values()))


def tokens(x: Column) -> Column:
    """Words of letters and digits after folding; other characters part words."""
    return F.filter(F.split(fold(x), "[^a-z0-9]+"), lambda t: t != "")


def unescape(x: Column) -> Column:
    """N-Triples escapes of quotes, line ends and back slashes."""
    out = F.regexp_replace(x, r"\\\\", "\u0000")
    for mark, plain in (('\\\\"', '"'), ("\\\\n", "\n"), ("\\\\r", "\r"), ("\\\\t", "\t")):
        out = F.regexp_replace(out, mark, plain)
    return F.replace(out, F.lit("\u0000"), F.lit("\\"))


def escape(x: Column) -> Column:
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for plain, mark in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out
