"""Cut C text into top-level units: function definitions and declarations.

One input row is one file and everything here is per row, so the stage is
map-only: no shuffle and no sort.  Each file is cut once into coarse pieces; running
sums over small integer codes of the pieces give line, brace depth and unit, with the
places of their texts (:mod:`lodestone.functions.segments`, on Arrow buffers).  A unit row
carries the text that later steps need, so all kinds of records can be derived
from one parsed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexis
from lodestone.functions.arrays import each, struct, those, word_list
from lodestone.functions.segments import text_spans


def _cut(place: str) -> str:
    """Text at a place in bytes."""
    return f"CAST(substring(raw, {place}.at + 1, {place}.n) AS STRING)"


def _text(u: str) -> str:
    """Head of a function, or the whole unit, without later arms of conditionals that begin in it."""
    return f"CASE WHEN size({u}.kept) = 0 THEN {_cut(u)} ELSE array_join({each(f'{u}.kept', _cut)}, '') END"


def _unit(u: str) -> str:
    """Unit record with its texts; a function has head and body, others one text."""
    fn = f"{u}.is_function"
    callee = each(f"{u}.calls", lambda c: struct(line=f"{c}.line", name=_cut(c), shared=f"{c}.shared"))
    return struct(
        unit=f"{u}.unit", is_function=fn, old_style=f"{u}.old_style", start_line=f"{u}.start_line", end_line=f"{u}.end_line",
        text=_text(u), body=f"CASE WHEN {fn} THEN {_cut(f'{u}.body')} END", snippet=_cut(f"{u}.whole_lines"),
        # head of the earlier function that holds the first line of this one
        cover_text=f"CASE WHEN {fn} AND {u}.cover <> {u}.unit THEN {_text(f'get(fold.units, {u}.cover)')} END",
        # words like "if" before "(" are no calls
        calls=those(callee, lambda c: f"{c}.name NOT IN ({word_list(lexis.NOT_CALLED)})"))


def parsed_files(files: DataFrame) -> DataFrame:
    """``(path, content)`` -> one row per file with its units and final depth.

    ``units`` is an array of unit records, ``final_depth`` is not 0 when the
    braces of the file do not balance.
    """
    # texts are cut out of bytes: characters would be counted from the start of the file for each
    raw = files.selectExpr("path", "CAST(content AS BINARY) AS raw")
    folded = raw.select("path", "raw", text_spans("raw").alias("fold"))
    return folded.selectExpr(
        "path", f"{each('fold.units', _unit)} AS units", "fold.depth AS final_depth",
        "size(fold.units) AS n_units")


def units(files: DataFrame) -> DataFrame:
    """One row per top-level unit of every file (see :func:`parsed_files`).

    Columns: path, n_units, unit, is_function, old_style, start_line, end_line, text, body,
    snippet, cover_text, calls.
    """
    exploded = parsed_files(files).selectExpr("path", "n_units", "explode_outer(units) AS u")
    return exploded.where("u IS NOT NULL").select("path", "n_units", "u.*")
