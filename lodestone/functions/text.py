"""Scalar expressions over text columns.  All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_source_file(path: Column | str) -> Column:
    """Case-sensitive suffix test."""
    return F.endswith(_c(path), F.lit(".c")) | F.endswith(_c(path), F.lit(".h"))


def tolerant_text(content: Column | str) -> Column:
    """Bytes to text; bad bytes become U+FFFD and line ends become LF (S3)."""
    return unix_lines(F.make_valid_utf8(_c(content).cast("string")))


def unix_lines(text: Column | str) -> Column:
    return F.replace(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def code_hash(text: Column | str) -> Column:
    """md5 of the text with LF line ends."""
    return F.md5(unix_lines(text).cast("binary"))


def line_range(text: Column | str, start: Column, end: Column) -> Column:
    """Lines start..end, 1-based and inclusive, clamped to the text."""
    first = F.greatest(start, F.lit(1))
    lines = F.split(unix_lines(text), r"(?<=\n)")
    return F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "")


def best_summary(refined: Column | str, initial: Column | str) -> Column:
    """The refined summary unless it is missing or empty."""
    return F.coalesce(F.nullif(_c(refined), F.lit("")), _c(initial))


def qualified_name(path: Column | str, name: Column | str) -> Column:
    return F.concat(_c(path), F.lit("::"), _c(name))


def encode_parameters(parameters: Column | str) -> Column:
    return F.to_json(F.coalesce(_c(parameters), F.array().cast("array<string>")))


def decode_parameters(text: Column | str) -> Column:
    """JSON list of strings; anything else gives an empty list."""
    return F.coalesce(F.from_json(_c(text), "array<string>"), F.array().cast("array<string>"))


def is_blank(text: Column | str) -> Column:
    return _c(text).isNull() | ~_c(text).rlike(r"\S")


def repository_name(url: Column | str) -> Column:
    """Last segment of a repository address without ``.git``."""
    return F.replace(F.element_at(F.split(F.rtrim(_c(url), F.lit("/")), "/"), -1), F.lit(".git"), F.lit(""))


def safe_name(name: Column | str) -> Column:
    """Lower-case name of letters, digits, ``-`` and single ``_`` (P10)."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_c(name)), r"\s+", "_"), r"[^a-z0-9_-]+", "_")
    trimmed = F.trim(F.regexp_replace(plain, "_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("project"))


def indented(text: Column | str) -> Column:
    """Four blanks before every line."""
    return F.concat(F.lit("    "), F.replace(_c(text), F.lit("\n"), F.lit("\n    ")))
