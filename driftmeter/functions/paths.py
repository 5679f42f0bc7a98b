"""Column expressions over file paths: segments, globs, languages, repository names.

All of them are built-in JVM expressions.  Pattern lists are compiled, when the
plan is built, into one regular expression per list, so a path is looked at
once however many patterns there are and nothing is split into arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_LANGUAGE_MAP = "map({})".format(
    ", ".join(
        f"'{extension}', '{language}'"
        for language, extensions in fixed.LANGUAGE_EXTENSIONS.items()
        for extension in extensions
    )
)
_META = set("\\^$.|?*+()[]{}-&#~")


def escape(text: str) -> str:
    """Quote text for a Java regular expression."""
    return "".join("\\" + c if c in _META else c for c in text)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_ignored_directory(path: Column, names: Sequence[str] = fixed.IGNORED_DIRECTORIES) -> Column:
    """True when a directory segment (never the file name) is one of ``names``, ignoring case."""
    alternatives = "|".join(escape(n) for n in names)
    return path.rlike(f"(?iu)(?:^|/)(?:{alternatives})/+[^/]")


def glob_regex(pattern: str) -> str | None:
    """One glob as a regular expression over a '/'-separated path, matched against any segment.

    Only a single leading or trailing star is a wildcard, a leading dot means a
    suffix, everything else is equality.  A pattern holding '/' matches no segment.
    """
    if pattern == "*":
        return "[^/]"
    if "/" in pattern:
        return None
    body = escape(pattern.strip("*")) if pattern.count("*") == 1 else escape(pattern)
    if pattern.count("*") == 1 and pattern.startswith("*"):
        return f"{body}(?:/|$)"
    if pattern.count("*") == 1 and pattern.endswith("*"):
        return f"(?:^|/){body}"
    if pattern.startswith(".") and "*" not in pattern:
        return f"{body}(?:/|$)"
    return f"(?:^|/){escape(pattern)}(?:/|$)"


def matches_any_segment(path: Column, patterns: Sequence[str]) -> Column:
    """True when any segment, file name included, matches any glob.  No patterns: false."""
    parts = [r for r in (glob_regex(p) for p in patterns) if r is not None]
    if not parts:
        return F.lit(False)
    return path.rlike("(?iu)" + "|".join(f"(?:{p})" for p in parts))


def matches_file_name(path: Column, patterns: Sequence[str] | None) -> Column:
    """True when the list is empty or the file name alone matches a glob."""
    if not patterns:
        return F.lit(True)
    return matches_any_segment(file_name(path), patterns)


def glob_regex_column(pattern: Column) -> Column:
    """``glob_regex`` for patterns held in a column (one pattern per value, no '/')."""
    stars = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit("")))
    body = F.regexp_replace(F.replace(pattern, F.lit("*"), F.lit("")), r"([\\^$.|?*+()\[\]{}\-&#~])", r"\\$1")
    whole = F.regexp_replace(pattern, r"([\\^$.|?*+()\[\]{}\-&#~])", r"\\$1")
    return (
        F.when(pattern == "*", F.lit("[^/]"))
        .when((stars == 1) & pattern.startswith("*"), F.concat(body, F.lit("(?:/|$)")))
        .when((stars == 1) & pattern.endswith("*"), F.concat(F.lit("(?:^|/)"), body))
        .when((stars == 0) & pattern.startswith("."), F.concat(body, F.lit("(?:/|$)")))
        .otherwise(F.concat(F.lit("(?:^|/)"), whole, F.lit("(?:/|$)")))
    )


def parse_patterns(text: str | None) -> list[str]:
    """Comma list of globs, as typed by a user."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def language_of(path: Column) -> Column:
    """Language by the text after the last dot of the file name; '' when unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))
    return F.coalesce(F.try_element_at(F.expr(_LANGUAGE_MAP), extension), F.lit(""))


def kind_of(path: Column, utility_patterns: Sequence[str]) -> Column:
    return F.when(matches_any_segment(path, utility_patterns), F.lit(fixed.UTILITY)).otherwise(
        F.lit(fixed.PRODUCTION)
    )


def repo_name(url: Column) -> Column:
    """'owner/repo' out of an SSH or HTTP(S) remote URL."""
    rest = F.regexp_replace(url, "git@|https://|http://", "")
    colon, slash = F.instr(rest, ":"), F.instr(rest, "/")
    is_ssh = (colon > 0) & ((slash == 0) | (colon < slash))
    cut = F.when(is_ssh, F.substring(rest, colon + 1, F.length(rest))).otherwise(
        F.substring(rest, slash + 1, F.length(rest))
    )
    return F.regexp_replace(cut, r"(?i)\.git$", "")
