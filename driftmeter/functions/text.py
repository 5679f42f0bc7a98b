"""Column expressions that measure the text of one source file.

The text stays in its own row: every measure is a scan of that one cell by a
precompiled regular expression.  No line is exploded, nothing is shuffled, and
the cost follows the bytes read, so one huge file delays only its own task.
All quantifiers are possessive or run over single characters, hence linear
time and constant stack depth even on files of many megabytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# White space that a line is trimmed of: Unicode white space without the line feed.
_WS = r"[\t\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINE = rf"(?dm)^{_WS}*+"  # d: only \n ends a line; m: ^ and $ work per line

# A block comment opens on a line that starts with the opener and holds no closer;
# it runs through the next line that holds a closer, or to the end of the text.
_BLOCK = r"(?=/\*)(?![^\n]*\*/)[^\n]*+(?:[\s\S]*?\*/[^\n]*|[\s\S]*)"
_CODE_C = rf"{_LINE}(?:{_BLOCK}|(?!//|/\*)([^\n]))"
_CODE_PYTHON = rf"{_LINE}([^\n#])"
_CODE_PLAIN = rf"{_LINE}([^\n])"

_IMPORT_LINES = {
    ("Java",): rf"{_LINE}import [^\n]*;{_WS}*$",
    ("TypeScript", "JavaScript"): rf"(?dm)^(?:{_WS}*+import {_WS}*+[^\n]|[^\n]*?require\(['\"])",
    ("Python",): rf"{_LINE}(?:import|from) {_WS}*+[^\n]",
    ("C", "Cpp"): rf"{_LINE}#include",
    ("Rust",): rf"{_LINE}(?:use|extern crate) {_WS}*+[^\n]",
}
_USING_LINE = rf"{_LINE}using ([^\n]*);{_WS}*$"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_WS}+|{_WS}+$", "")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def _captured(text: Column, pattern: str) -> Column:
    # every hit captures one character or nothing
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), "")).cast("bigint")


def source_lines(text: Column, language: Column) -> Column:
    """Lines that are neither blank nor comment-only."""
    return (
        F.when(language.isin(*fixed.C_STYLE_LANGUAGES), _captured(text, _CODE_C))
        .when(language == "Python", _captured(text, _CODE_PYTHON))
        .otherwise(_captured(text, _CODE_PLAIN))
    )


def _is_namespace_import(raw: Column) -> Column:
    inner = trim_space(raw)
    name = F.when(inner.startswith("static "), F.substring(inner, 8, F.length(inner))).otherwise(inner)
    space = F.instr(name, " ")
    aliased = F.substring(name, space + 1, F.lit(1)) == "="
    return ~inner.startswith("(") & ~inner.startswith("var ") & ((space == 0) | aliased)


def import_lines(text: Column, language: Column) -> Column:
    """Import directives of a file, a proxy for outgoing coupling."""
    usings = F.regexp_extract_all(text, F.lit(_USING_LINE), F.lit(1))
    count = F.when(language == "CSharp", F.size(F.filter(usings, _is_namespace_import)))
    for languages, pattern in _IMPORT_LINES.items():
        count = count.when(language.isin(*languages), F.regexp_count(text, F.lit(pattern)))
    return count.otherwise(F.lit(0)).cast("bigint")
