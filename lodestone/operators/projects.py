"""The registry of projects."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import repository_name, safe_name
from lodestone.operators.skew import position_in_group
from lodestone.session import settled

# Ship these functions with the job, so that workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE_FOLDER, STORE_SUFFIX = "database", ".db"  # fixed values


def _gaps(names: DataFrame, taken: DataFrame, base: str) -> DataFrame:
    """Which numbers of each base are in use, as runs: base, _from, _until, _skip.

    The free number of rank k, ``_from <= k < _until``, is ``k + _skip``.
    """
    own = taken.select(F.col("name").alias(base), F.lit(0).cast("bigint").alias("_number"))
    tail = r"^(.*)_([1-9]\d{0,17})$"
    numbered = taken.where(F.col("name").rlike(tail)).select(
        F.regexp_extract("name", tail, 1).alias(base), F.regexp_extract("name", tail, 2).cast("bigint").alias("_number"))
    used = own.unionByName(numbered).distinct().join(names.select(base).distinct(), base, "left_semi")
    ranked = position_in_group(used, base, "_number", "_i")
    runs = ranked.groupBy(base, (F.col("_number") - F.col("_i")).alias("_from")).agg((F.max("_i") + 1).alias("_skip"))
    return runs.withColumn("_until", F.lead("_from").over(Window.partitionBy(base).orderBy("_from")))


class _Numbers:
    """Free names of one stem, as if rows came one by one.

    A name is the number 0 of itself and, if it ends in ``_n``, the number n of what stands before.  Of each
    base the numbers below ``next`` are used; ``ahead`` are those above that other bases took literally.
    Size: one entry per distinct base and per name that was taken ahead, not per row.
    """

    _TAIL = re.compile(r"(.*)_([1-9][0-9]*)", re.DOTALL)

    def __init__(self):
        self.next: dict[str, int] = {}
        self.ahead: dict[str, set[int]] = {}

    def _places(self, name: str) -> list[tuple[str, int]]:
        tail = self._TAIL.fullmatch(name)
        return [(name, 0)] + ([(tail[1], int(tail[2]))] if tail else [])

    def _free(self, name: str) -> bool:
        return all(n >= self.next.get(b, 0) and n not in self.ahead.get(b, ()) for b, n in self._places(name))

    def take(self, name: str) -> None:
        for base, n in self._places(name):
            if n >= self.next.get(base, 0):
                self.ahead.setdefault(base, set()).add(n)

    def name(self, base: str) -> str:
        n = self.next.get(base, 0)
        while True:
            name = base if n == 0 else f"{base}_{n}"
            if self._free(name):
                break
            self.ahead.get(base, set()).discard(n)
            n += 1
        self.next[base] = n + 1
        for other, m in self._places(name):
            if other != base and m >= self.next.get(other, 0):
                self.ahead.setdefault(other, set()).add(m)
        return name


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by stem and place: taken names first, then bases in order."""
    stem, numbers = None, _Numbers()
    for batch in batches:
        names = []
        for at, base, known in zip(*(batch.column(c).to_pylist() for c in ("_stem", "_base", "_known"))):
            if at != stem:
                stem, numbers = at, _Numbers()
            names.append(base if known else numbers.name(base))
            if known:
                numbers.take(base)
        yield pa.RecordBatch.from_arrays([batch.column("_seq"), batch.column("_known"), pa.array(names, pa.string())],
                                         names=["_seq", "_known", "_name"])


def unique_names(rows: DataFrame, base: str, sequence: str, out: str = "name", taken: DataFrame | None = None) -> DataFrame:
    """``x``, ``x_1``, ``x_2``, ... in order of ``sequence``, a unique integer.

    Each row takes the first free name, as if rows came one by one after the names in
    ``taken`` (column ``name``).  Equal bases are numbered at once, and the numbers that
    ``taken`` uses are skipped at once.  Only among the bases of new rows can one that looks
    like a numbered name (``x_1``) meet another; such a stem (``x`` with ``x_1``, ``x_1_1``, ...) is handed
    out in one sorted pass of a task that keeps an entry per distinct base.  The number of jobs
    does not depend on the names.
    """
    # A clash needs a literal base with a numeric tail beside the base without it; all else is numbered at once.
    stem = F.regexp_replace(base, r"(_\d+)+$", "")
    bases = rows.select(base).distinct()
    tails = bases.where(F.col(base).rlike(r"_\d+$")).select(F.regexp_replace(base, r"_\d+$", "").alias(base)).distinct()
    stems = settled(tails.join(bases, base, "left_semi").select(stem.alias("_stem")).distinct())
    marked = rows.withColumn("_stem", stem)
    clear = marked.join(stems, "_stem", "left_anti")
    ranked = position_in_group(clear, base, sequence, "_n")
    if taken is not None:
        r, g = ranked.alias("r"), settled(_gaps(clear, taken, base)).alias("g")
        ranked = r.join(g, (F.col(f"r.{base}") == F.col(f"g.{base}")) & (F.col("r._n") >= F.col("g._from"))
                        & (F.col("g._until").isNull() | (F.col("r._n") < F.col("g._until"))), "left").select(
            *[F.col(f"r.{c}") for c in clear.columns], (F.col("_n") + F.coalesce("_skip", F.lit(0))).alias("_n"))
    ranked = ranked.withColumn(out, F.when(F.col("_n") == 0, F.col(base))
                               .otherwise(F.concat(base, F.lit("_"), F.col("_n").cast("string")))).drop("_n")

    met = marked.join(stems, "_stem", "left_semi")
    line = met.select("_stem", F.col(base).alias("_base"), F.col(sequence).cast("bigint").alias("_seq"), F.lit(False).alias("_known"))
    if taken is not None:
        known = taken.select(F.regexp_replace("name", r"(_\d+)+$", "").alias("_stem"), F.col("name").alias("_base"))
        line = line.unionByName(known.join(stems, "_stem", "left_semi").select(
            "_stem", "_base", F.lit(None).cast("bigint").alias("_seq"), F.lit(True).alias("_known")))
    handed = (line.repartition("_stem").sortWithinPartitions("_stem", F.col("_known").desc(), "_seq")
              .mapInArrow(_one_by_one, "_seq bigint, _known boolean, _name string")).where("NOT _known")
    named = met.join(handed.select(F.col("_seq").alias("_s"), F.col("_name").alias(out)), F.col(sequence) == F.col("_s")).drop("_s")
    return ranked.unionByName(named.select(*ranked.columns)).drop("_stem")


def store_path(name: Column) -> Column:
    return F.concat(F.lit(STORE_FOLDER + "/"), name, F.lit(STORE_SUFFIX))


def register(urls: DataFrame, projects_folder: str, name: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Registry rows for ``(seq, git_url)`` rows (S14): name, path, git_url, last_commit, store_path.

    ``known`` is the registry so far; its names are not given again.
    """
    given = F.nullif(F.col(name), F.lit("")) if name else F.lit(None).cast("string")
    named = urls.withColumn("_base", safe_name(F.coalesce(given, repository_name("git_url"))))
    unique = unique_names(named, "_base", "seq", taken=known)
    return unique.select(
        "name", F.concat(F.lit(projects_folder.rstrip("/") + "/"), "name").alias("path"), "git_url",
        F.lit(None).cast("string").alias("last_commit"), store_path(F.col("name")).alias("store_path"))


def list_projects(projects: DataFrame) -> DataFrame:
    """The registry as typed columns."""
    return projects.select("name", "path", "git_url", "last_commit", "store_path")
