"""A table's profile, kept beside it and brought up to date by the files that came."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from hashlib import sha256
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import require_table_name
from tablemill.metrics import RunResult, run
from tablemill.operators import profiles
from tablemill.sinks import tables

# A profile is of pieces: files of one partition that were read together. Of each of its files a
# piece has a row without a column name, which says that the file has been read.
_SCHEMA = T.StructType([T.StructField("version", T.StringType()), T.StructField("file", T.StringType()), *profiles.SKETCHES])

#: Pieces of a partition; where an append would make more, the partition is read whole into one.
MOST_PIECES = 16


def update_profile(spark: SparkSession, target: str, profile: str, base: str | None = None) -> RunResult:
    """Read the files of ``target`` that were written since the profile was; keep the rest of it.

    ``profile`` names the table that holds the sketches; it is created under ``base`` if missing.
    Appended, rewritten and dropped files are noticed. A partition of which files went is read
    whole, and so is one at its ``MOST_PIECES + 1``-th append. ``rows_read`` counts the table's rows
    that were read, ``rows_inserted`` the partitions read from and ``rows_deleted`` the pieces of the
    profile that went or were replaced. Repeating a run that failed is safe.
    """

    def body(result: RunResult) -> None:
        require_table_name(target)
        if not tables.table_exists(spark, target):
            raise RequestError(f"There is no table '{target}' to profile")
        if base is not None:
            tables.create_table(spark, profile, _SCHEMA, base, keep_not_null=False)
        files = tables.partition_files(spark, target)
        known = _pieces(spark, profile)
        current = _current(known, files)
        holder = {f: v for v in current for f in known[v]}
        new = {}
        for partition, paths in files.items():
            left = [f for f in paths if f not in holder]
            held = {holder[f] for f in paths if f in holder}
            if left and len(held) >= MOST_PIECES:
                current -= held
                left = paths
            if left:
                new[partition] = left
        versions = {p: _version(p, paths) for p, paths in new.items()}
        gone = known.keys() - current - set(versions.values())
        result.rows_inserted, result.rows_deleted = len(new), len(gone)
        if new:
            result.rows_read = _add(spark, target, profile, new, versions)
        if gone:
            kept = spark.table(profile).join(_frame(spark, current | set(versions.values())), "version", "left_semi")
            tables.replace(kept, profile)
        result.rows_written = result.rows_inserted
        result.warn(f"Profiled {len(new)} of {len(files)} partitions")

    return run(target, body)


def table_profile(spark: SparkSession, target: str, profile: str, most_frequent: int = 10) -> DataFrame:
    """One row per column of ``target``, from the sketches in ``profile``; the table is not read.

    A profile that is behind the table is refused: bring it up to date first.
    """
    files = tables.partition_files(spark, target)
    known = _pieces(spark, profile)
    current = _current(known, files)
    read = set().union(*[known[v] for v in current])
    behind = sum(not read.issuperset(paths) for paths in files.values())
    if behind:
        raise RequestError(f"The profile lacks files of {behind} partitions of '{target}'")
    rows = spark.table(profile).where("column_name IS NOT NULL").join(_frame(spark, current), "version", "left_semi")
    return profiles.described(profiles.merged(rows), most_frequent)


def _version(partition: tables.Partition, files: Iterable[str]) -> str:
    return sha256("\n".join([repr(partition), *sorted(files)]).encode()).hexdigest()


def _pieces(spark: SparkSession, profile: str) -> dict[str, set[str]]:
    """The pieces of a profile, and the files of each."""
    if "file" not in spark.table(profile).columns:
        raise RequestError(f"The profile '{profile}' is not by files: drop it, and it will be made anew")
    found: dict[str, set[str]] = {}
    for row in spark.table(profile).where("column_name IS NULL").select("version", "file").collect():
        found.setdefault(row["version"], set()).add(row["file"])
    return found


def _current(pieces: dict[str, set[str]], files: dict[tables.Partition, list[str]]) -> set[str]:
    """The pieces all of whose files the table has; of those that share a file, the largest."""
    left = {f for paths in files.values() for f in paths}
    current = set()
    for version in sorted(pieces, key=lambda v: (-len(pieces[v]), v)):
        if pieces[version] <= left:
            left -= pieces[version]
            current.add(version)
    return current


def _frame(spark: SparkSession, versions: Iterable[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(v,) for v in versions], "version string"))


def _add(
    spark: SparkSession, target: str, profile: str, new: dict[tables.Partition, list[str]], versions: dict[tables.Partition, str]
) -> int:
    """Profile these files, a piece for each partition, and add their rows; the rows of the table that were read."""
    columns = tables.partition_columns(spark, target)
    table = spark.table(target)
    names = [f"__p{i}" for i in range(len(columns))]
    listed = [(*p, unquote(f.rpartition("/")[2]), versions[p]) for p, paths in new.items() for f in paths]
    scope = spark.createDataFrame(listed, ", ".join(f"{n} string" for n in [*names, "__name", "__version"]))
    scope = scope.select(*[F.col(n).cast(table.schema[c].dataType).alias(n) for n, c in zip(names, columns, strict=True)], "__name", "__version")
    # Files are pruned by name; one write names its files alike in all partitions, so both tell.
    rows = table.select("*", F.col("_metadata.file_name").alias("__file")).where(F.col("__file").isin(sorted({r[-2] for r in listed})))
    same = [rows["__file"] == scope["__name"]]
    same += [rows[f"`{c}`"].eqNullSafe(scope[n]) for n, c in zip(names, columns, strict=True)]
    rows = rows.join(F.broadcast(scope), reduce(lambda a, b: a & b, same)).select("__version", *[f"`{c}`" for c in table.columns])
    found = profiles.column_sketches(rows, ["__version"], skip=["__version", tables.BUCKET])
    found = found.withColumnRenamed("__version", "version").withColumn("file", F.lit(None).cast("string"))
    read = spark.createDataFrame([(versions[p], f) for p, paths in new.items() for f in paths], "version string, file string")
    read = read.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in profiles.SKETCHES])
    tables.append(found.select(*_SCHEMA.names).unionAll(read), profile)
    added = spark.table(profile).where("ordinal = 1").join(_frame(spark, versions.values()), "version", "left_semi")
    return added.agg(F.sum("n_rows")).first()[0] or 0
