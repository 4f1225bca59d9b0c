"""Lake tables: catalog entries over Parquet folders, replaced snapshot by snapshot.

A table's location is ``<base>/<name>/snapshot-<tag>``. Replacing its content writes a
new snapshot and then points the catalog at it, so readers see the old rows or
the new ones and a failed write changes nothing. One writer per table is assumed.

Of a partitioned table a snapshot holds the partitions that were rewritten; the catalog points
each partition at the snapshot it was last written to. Old files stay, so a frame that was
opened before goes on reading what it saw. A table without partition columns of its own can
have hidden ones: hash buckets of its key, so that a change rewrites only the buckets it touches.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import quoted, require_columns, require_table_name, resolve
from tablemill.functions.types import table_ddl
from tablemill.session import delete_path, list_path, setting

SNAPSHOT = "snapshot-"

# The hidden partition column of a bucketed table, and the properties that describe it.
BUCKET = "__bucket"
_BUCKETS, _BUCKET_BY = "tablemill.buckets", "tablemill.bucket_by"
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"

# The property that names the columns whose values the files carry Bloom filters of, and how many
# values of such a column are looked up at once: Spark hands them to the files as one condition.
_LOOKUP_BY = "tablemill.lookup_by"
# Each value is found in vain by one filter in 10,000, so that 500 read about 5 % of row groups for nothing.
LOOKUP_VALUES = 500
_FALSE_HITS = "0.0001"
_FILTER_BYTES = str(4 << 20)

# Replaced snapshots stay this long for readers that still use them: well above the longest read.
KEPT_SECONDS = 24 * 3600

# Partitions named in one catalog statement.
_CHUNK = 1000


def table_exists(spark: SparkSession, name: str) -> bool:
    require_table_name(name)
    return spark.catalog.tableExists(name)


def _describe(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").collect()
    return {r["col_name"]: r["data_type"] for r in rows}


def table_location(spark: SparkSession, name: str) -> str:
    return _describe(spark, name)["Location"]


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def _folder(spark: SparkSession, name: str) -> str:
    """The folder that holds this table's snapshots, and nothing else."""
    location = table_location(spark, name).rstrip("/")
    parent, _, leaf = location.rpartition("/")
    return parent if leaf.startswith(SNAPSHOT) else f"{location}-snapshots"


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    base: str,
    partition_by: Sequence[str] = (),
    keep_not_null: bool = True,
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
    lookup_by: Sequence[str] = (),
) -> bool:
    """Create the table if it is missing; TRUE when it was created.

    With ``bucket_by``, key columns of the table, its rows are dealt over ``buckets`` hidden
    partitions by their hash. Choose so many that a bucket takes a task or a few to rewrite.
    With ``lookup_by`` each row group of its files has Bloom filters of these columns, by which a
    sync of few keys skips the row groups that hold none of them.
    """
    require_table_name(name)
    require_columns(schema.names)
    if table_exists(spark, name):
        return False
    properties = {}
    looked_up = [resolve(c, schema.names) for c in lookup_by]
    if set(looked_up) & {resolve(c, schema.names) for c in partition_by}:
        raise RequestError("A partition column is in no file, so there is nothing to look up")
    if bucket_by:
        if partition_by or buckets < 1:
            raise RequestError("Buckets are for tables without partition columns, and at least one is needed")
        keys = [resolve(c, schema.names) for c in bucket_by]
        schema = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        partition_by = [BUCKET]
        properties = {_BUCKETS: str(buckets), _BUCKET_BY: ",".join(keys)}
    if looked_up:
        properties[_LOOKUP_BY] = ",".join(looked_up)
    clause = f"PARTITIONED BY ({', '.join(quoted(c) for c in partition_by)})" if partition_by else ""
    spark.sql(
        f"CREATE TABLE {quoted(name)} ({table_ddl(schema, keep_not_null)}) USING parquet "
        f"{_listed('OPTIONS', _file_options(looked_up))} {clause} "
        f"LOCATION '{base}/{name}/{SNAPSHOT}{uuid.uuid4().hex}' {_listed('TBLPROPERTIES', properties)}"
    )
    return True


def _listed(word: str, pairs: Mapping[str, str]) -> str:
    return f"{word} (" + ", ".join(f"'{k}' = '{v}'" for k, v in pairs.items()) + ")" if pairs else ""


def _file_options(looked_up: Sequence[str]) -> dict[str, str]:
    """What makes Parquet write Bloom filters of these columns, each as large as its values ask for."""
    if not looked_up:
        return {}
    filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in looked_up}
    rates = {f"parquet.bloom.filter.fpp#{c}": _FALSE_HITS for c in looked_up}
    sizes = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": _FILTER_BYTES}
    return {**sizes, **filters, **rates}


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def lookup_columns(spark: SparkSession, name: str) -> list[str]:
    """The columns whose values the table's files have Bloom filters of."""
    found = _properties(spark, name).get(_LOOKUP_BY)
    return found.split(",") if found else []


def having(rows: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that can have a key of ``values``: those with one of its values in each looked-up column.

    A column of which ``values`` has more than ``LOOKUP_VALUES`` tells nothing and leaves the rows
    as they are. Read the result inside ``looking_up``.
    """
    for c in columns:
        few = values.select(c).where(F.col(c).isNotNull()).distinct().limit(LOOKUP_VALUES + 1).collect()
        if len(few) <= LOOKUP_VALUES:
            rows = rows.where(F.col(c).isin([r[0] for r in few]))
    return rows


@contextmanager
def looking_up(spark: SparkSession) -> Iterator[None]:
    """For jobs that start in here, lists of up to ``LOOKUP_VALUES`` values reach the Bloom filters."""
    with setting(spark, "spark.sql.parquet.pushdown.inFilterThreshold", str(LOOKUP_VALUES)):
        yield


def bucket_keys(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """The columns whose hash is the table's bucket, and how many buckets it has; none and 0 if it has none."""
    found = _properties(spark, name)
    return ([*found[_BUCKET_BY].split(",")], int(found[_BUCKETS])) if _BUCKETS in found else ([], 0)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows, without a hidden bucket column."""
    rows = spark.table(name)
    return rows.drop(BUCKET) if BUCKET in rows.columns else rows


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's bucket column, if the table has one."""
    if BUCKET not in df.sparkSession.table(name).columns:
        return df
    keys, buckets = bucket_keys(df.sparkSession, name)
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int"))


def _ready(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns, in its order and types."""
    df = bucketed(df, name)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.sparkSession.table(name).schema])


def arranged(df: DataFrame, name: str) -> DataFrame:
    """Rows gathered by the table's partitions, so that not every task writes to each.

    The rebalance hint aims at files of fair size: AQE cuts a partition that holds
    much of the data and joins small ones. Unpartitioned tables need no shuffle.
    """
    columns = partition_columns(df.sparkSession, name)
    return bucketed(df, name).hint("rebalance", *columns) if columns else df


def append(df: DataFrame, name: str, max_records_per_file: int | None = None) -> None:
    """Add rows; the files appear together when the job commits."""
    require_columns(df.columns)
    spark = df.sparkSession
    if BUCKET not in df.columns:
        df = bucketed(df, name)
    with setting(spark, "spark.sql.files.maxRecordsPerFile", str(max_records_per_file or 0)):
        df.select(*spark.table(name).columns).write.insertInto(name)


def snapshot_path(spark: SparkSession, name: str, tag: str | None = None) -> str:
    """Where the table's next content goes."""
    return f"{_folder(spark, name)}/{SNAPSHOT}{tag or ''}{uuid.uuid4().hex}"


def write_snapshot(
    df: DataFrame, path: str, max_records_per_file: int | None = None, looked_up: Sequence[str] = ()
) -> None:
    """Write new content; what a failed write left is removed."""
    require_columns(df.columns)
    try:
        writer = df.write.options(**_file_options(looked_up))
        writer.option("maxRecordsPerFile", str(max_records_per_file or 0)).parquet(path)
    except Exception:
        delete_path(df.sparkSession, path)
        raise


def publish(spark: SparkSession, name: str, path: str) -> None:
    """Point the table at a finished snapshot."""
    spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)


def replace(
    df: DataFrame,
    name: str,
    tag: str | None = None,
    max_records_per_file: int | None = None,
    gathered: bool = False,
) -> None:
    """Replace the table's content with ``df``, which may read the table itself.

    ``gathered`` says that the rows are ``arranged`` already.
    """
    spark = df.sparkSession
    if partition_columns(spark, name):
        overwrite_partitions(df, name, max_records_per_file, tag, gathered=gathered, whole=True)
    else:
        path = snapshot_path(spark, name, tag)
        write_snapshot(df, path, max_records_per_file, lookup_columns(spark, name))
        publish(spark, name, path)
    remove_old_snapshots(spark, name)


def stored_partition(rows: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Partition values as the table keeps them: empty text is stored as NULL."""
    return [
        F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c)
        for c, t in rows.select(*columns).dtypes
    ]


def in_partitions(rows: DataFrame, scope: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose partition is in ``scope``, however many partitions that names.

    The scope stays a frame. Values are compared by plain equality, which is what Spark prunes
    partitions by at run time where the scope is small enough to broadcast; which columns are
    NULL is a test of its own, of which there are as many as the scope has different ones.
    """
    shapes = scope.select(*[F.col(c).isNull().alias(c) for c in columns]).distinct().collect()
    parts = []
    for shape in shapes:
        empty = [c for c in columns if shape[c]]
        given = [c for c in columns if not shape[c]]
        tests = [F.col(c).isNull() for c in empty] + [F.col(c).isNotNull() for c in given]
        alike = reduce(lambda a, b: a & b, tests)
        part = rows.where(alike)
        if given:
            # Spark prunes only by a side that a comparison has narrowed; this one holds for every row.
            marked = scope.where(alike).select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(given)])
            marked = marked.where(F.hash(*marked.columns) >= -(1 << 31))
            same = [part[c] == F.col(f"__p{i}") for i, c in enumerate(given)]
            part = part.join(marked, reduce(lambda a, b: a & b, same), "left_semi")
        parts.append(part)
    return reduce(DataFrame.unionAll, parts) if parts else rows.limit(0)


Partition = tuple[str | None, ...]

# The property that names the snapshot whose partitions are being switched to, and the partitions
# that go with it, kept beside its folders.
_SWITCH = "tablemill.switch"
_GONE = "_gone"


def partition_texts(rows: DataFrame, columns: Sequence[str]) -> set[Partition]:
    """The different partitions of ``rows``, each by its values as text."""
    found = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).distinct()
    return {tuple(r) for r in found.collect()}


def _named(folder: str) -> str | None:
    """The value in a partition's folder name."""
    value = folder.partition("=")[2]
    return None if value == _NULL_FOLDER else unquote(value, encoding="latin-1")


def _catalog_partitions(spark: SparkSession, name: str) -> set[Partition]:
    shown = spark.sql(f"SHOW PARTITIONS {quoted(name)}").collect()
    return {tuple(_named(part) for part in r[0].split("/")) for r in shown}


def _folder_partitions(spark: SparkSession, path: str, depth: int) -> dict[Partition, str]:
    """The partitions that have a folder under ``path``, and that folder."""
    found: dict[Partition, str] = {(): path}
    for _ in range(depth):
        below = [(p, child) for p, folder in found.items() for child, _ in list_path(spark, folder)]
        leaves = [(p, child, child.rstrip("/").rpartition("/")[2]) for p, child in below]
        found = {(*p, _named(leaf)): child for p, child, leaf in leaves if "=" in leaf}
    return found


def partition_files(spark: SparkSession, name: str) -> dict[Partition, list[str]]:
    """Each partition that has files, and their paths.

    Files are never changed once written, so content that changes is in other files. A table
    without partition columns is one partition.
    """
    depth = len(partition_columns(spark, name))
    spark.catalog.refreshTable(name)
    held: dict[Partition, list[str]] = {}
    for file in spark.table(name).inputFiles():
        folders = unquote(file.rpartition("/")[0]).split("/")
        held.setdefault(tuple(_named(f) for f in folders[len(folders) - depth :]), []).append(file)
    return held


def overwrite_partitions(
    df: DataFrame,
    name: str,
    max_records_per_file: int | None = None,
    tag: str | None = None,
    scope: DataFrame | None = None,
    gathered: bool = False,
    whole: bool = False,
) -> set[Partition]:
    """Replace the partitions that ``df`` has rows for, leave the others; ``df`` may read the table.

    Partitions that ``scope`` names and ``df`` has no rows for are dropped, with ``whole`` all that
    ``df`` has none for. Returns the partitions written. The rows are written once, to a new
    snapshot; then the catalog points each partition at its new folder, one after another, and at
    last the table at the snapshot. A run that fails before changes nothing; one broken off in
    between is ended by ``end_switch``, if it had a ``tag``, and gives the same table when
    repeated, but for rows with NULL keys. Old folders stay for running readers until
    ``remove_old_snapshots``.
    """
    spark = df.sparkSession
    require_columns([c for c in df.columns if c != BUCKET])
    columns = partition_columns(spark, name)
    if not columns:
        raise RequestError(f"Table '{name}' has no partition columns")
    path = snapshot_path(spark, name, tag)
    rows = _ready(df, name)
    writer = (rows if gathered else arranged(rows, name)).write.partitionBy(*columns)
    try:
        writer = writer.options(**_file_options(lookup_columns(spark, name)))
        # A task that has few buckets whole keeps a file of each open rather than sorting its rows by them.
        open_files = bucket_keys(spark, name)[1] if gathered else 0
        with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(open_files)):
            writer.option("maxRecordsPerFile", str(max_records_per_file or 0)).parquet(path)
        written = _folder_partitions(spark, path, len(columns))
        leaving = _catalog_partitions(spark, name) if whole else set()
        if scope is not None:
            leaving |= partition_texts(scope, columns)
        gone = sorted(leaving - written.keys(), key=repr)
        if tag:
            dropped = spark.createDataFrame([(list(p),) for p in gone], "partition array<string>")
            dropped.coalesce(1).write.parquet(f"{path}/{_GONE}")
    except Exception:
        delete_path(spark, path)
        raise
    if tag:
        spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ('{_SWITCH}' = '{path}')")
    else:
        _forget_switch(spark, name)  # what a broken run left must not come back over this one
    _switch(spark, name, columns, path, written, gone)
    return set(written)


def _switch(
    spark: SparkSession, name: str, columns: Sequence[str], path: str, written: dict[Partition, str], gone: Sequence[Partition]
) -> None:
    """Show a finished snapshot: each partition, then the table, whose place says that all is done."""
    _point(spark, name, columns, written)
    drop_partitions(spark, name, gone)
    # New partitions of later appends go to the new snapshot, where no old files are.
    spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION '{path}'")
    _forget_switch(spark, name)
    spark.catalog.refreshTable(name)


def _forget_switch(spark: SparkSession, name: str) -> None:
    spark.sql(f"ALTER TABLE {quoted(name)} UNSET TBLPROPERTIES IF EXISTS ('{_SWITCH}')")


def end_switch(spark: SparkSession, name: str, tag: str) -> bool:
    """Whether the run ``tag`` has been published; if it was broken off while partitions switched, they all do now.

    Its snapshot was whole and named in the table's properties before the first partition switched,
    so nothing is computed or inserted again.
    """
    def is_of_run(path: str) -> bool:
        return path.rstrip("/").rpartition("/")[2].startswith(f"{SNAPSHOT}{tag}")

    if is_of_run(table_location(spark, name)):
        return True
    columns = partition_columns(spark, name)
    shown = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").where(F.col("key") == _SWITCH).first() if columns else None
    if shown is None or not is_of_run(shown["value"]):
        return False
    path = shown["value"]
    gone = spark.read.schema("partition array<string>").parquet(f"{path}/{_GONE}").collect()
    _switch(spark, name, columns, path, _folder_partitions(spark, path, len(columns)), [tuple(r["partition"]) for r in gone])
    return True


def _spec(columns: Sequence[str], partition: Partition) -> str:
    def value(text: str | None) -> str:
        return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return "PARTITION (" + ", ".join(f"{quoted(c)} = {value(v)}" for c, v in zip(columns, partition, strict=True)) + ")"


def _point(spark: SparkSession, name: str, columns: Sequence[str], folders: dict[Partition, str]) -> None:
    """Point the catalog's partitions at these folders; those it hasn't are added."""
    located = [f"{_spec(columns, p)} LOCATION '{folder}'" for p, folder in folders.items()]
    for at in range(0, len(located), _CHUNK):
        spark.sql(f"ALTER TABLE {quoted(name)} ADD IF NOT EXISTS {' '.join(located[at : at + _CHUNK])}")
    for p, folder in folders.items():
        spark.sql(f"ALTER TABLE {quoted(name)} {_spec(columns, p)} SET LOCATION '{folder}'")


def drop_partitions(spark: SparkSession, name: str, partitions: Sequence[Partition]) -> None:
    """Drop partitions given by their values as text, a bounded number per statement; their files stay."""
    columns = partition_columns(spark, name)
    specs = [_spec(columns, p) for p in partitions]
    for at in range(0, len(specs), _CHUNK):
        spark.sql(f"ALTER TABLE {quoted(name)} DROP IF EXISTS {', '.join(specs[at : at + _CHUNK])}")


def remove_old_snapshots(spark: SparkSession, name: str, older_than: float = KEPT_SECONDS) -> list[str]:
    """Delete snapshots the table no longer points at and that are older than so many seconds.

    A snapshot's age counts from when it was written; a reader that began on it while it was
    current is safe for the rest of that time. Of a partitioned table the folders go that no
    partition is in any more and that were replaced so long ago.
    """
    current = table_location(spark, name).rstrip("/").rpartition("/")[2]
    newest_gone = (time.time() - older_than) * 1000
    snapshots = [(p, t) for p, t in list_path(spark, _folder(spark, name)) if p.rpartition("/")[2].startswith(SNAPSHOT)]
    columns = partition_columns(spark, name)
    if columns:
        gone = _replaced_folders(spark, name, len(columns), snapshots, newest_gone)
    else:
        gone = [path for path, modified in snapshots if not path.endswith(current) and modified <= newest_gone]
    for path in gone:
        delete_path(spark, path)
    return gone


def _replaced_folders(
    spark: SparkSession, name: str, depth: int, snapshots: list[tuple[str, int]], newest_gone: float
) -> list[str]:
    """Partition folders without a file of the table, whose successor was written by ``newest_gone``."""
    used = {unquote(f.rpartition("/")[0]).rpartition(f"/{SNAPSHOT}")[2] for f in spark.table(name).inputFiles()}
    held = [(t, _folder_partitions(spark, path, depth)) for path, t in sorted(snapshots, key=lambda x: x[1])]
    gone = []
    for k, (_, folders) in enumerate(held):
        for partition, folder in folders.items():
            # Without a successor it was dropped, at the latest by the newest snapshot.
            replaced = next((t for t, later in held[k + 1 :] if partition in later), held[-1][0])
            if unquote(folder).rpartition(f"/{SNAPSHOT}")[2] not in used and k + 1 < len(held) and replaced <= newest_gone:
                gone.append(folder)
    return gone
