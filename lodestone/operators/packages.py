"""Symbols of Python files and the exports of their folders."""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import settled

# Ship these functions with the job, so that workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names that take no part in exports.
EXCLUDED_FILES = ["__init__.py", "scan.py"]
EXCLUDED_FOLDERS = [".venv", "__pycache__", "build", "dist", ".git"]


def _top_level(text: str) -> tuple[list[tuple[str, str]], str | None]:
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return [], type(problem).__name__
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
    return [(kinds[type(n)], n.name) for n in body if type(n) in kinds], None


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, text in zip(frame["path"], frame["content"]):
            found, error = _top_level(text or "")
            rows += [(path, i, kind, name, None) for i, (kind, name) in enumerate(found)]
            if error:
                rows.append((path, -1, "reject", None, error))
        yield pd.DataFrame(rows, columns=["path", "ordinal", "kind", "name", "error"])


def py_symbols(files: DataFrame) -> DataFrame:
    """Top-level classes and functions; an unparsable file gives one "reject" row.

    Files are dealt out first: parsing costs far more than reading, and a table of few bytes is read by few tasks.
    """
    py = files.where(F.col("path").endswith(".py")).select("path", "content").repartition("path")
    return py.mapInPandas(_scan, "path string, ordinal int, kind string, name string, error string")


def package_exports(symbols: DataFrame) -> DataFrame:
    """What each folder exports (E14): folder, package, kind, module, name.

    ``kind`` is "folder" for a sub-folder with exports of its own, "class" or
    "function" for a symbol of a file in the folder.  One row per export, so a
    folder of any size stays spread over the tasks.
    """
    parts = F.split("path", "/")
    # stored, as it is read twice below and the files would be parsed for each
    own = settled(symbols.where(F.col("kind").isin("class", "function") & (F.lower("name") != "main"))
           .select(parts.alias("parts"), "kind", "name")
           .where(~F.element_at("parts", -1).isin(EXCLUDED_FILES))
           .where(~F.arrays_overlap(F.slice("parts", F.lit(1), F.size("parts") - 1),
                                    F.array(*[F.lit(x) for x in EXCLUDED_FOLDERS]))))
    folder = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/")
    named = own.select(folder.alias("folder"), "kind",
                       F.regexp_replace(F.element_at("parts", -1), r"\.py$", "").alias("module"), "name")
    folders = own.select(F.slice("parts", F.lit(1), F.size("parts") - 1).alias("f")).distinct().where(F.size("f") > 0)
    nested = folders.select("f", F.explode(F.sequence(F.lit(1), F.size("f"))).alias("n")).select(
        F.array_join(F.slice("f", F.lit(1), F.col("n") - 1), "/").alias("folder"), F.lit("folder").alias("kind"),
        F.lit(None).cast("string").alias("module"), F.get("f", F.col("n") - 1).alias("name"))
    rows = named.unionByName(nested).distinct()
    return rows.select("folder", F.replace("folder", F.lit("/"), F.lit(".")).alias("package"), "kind", "module", "name")
