"""Column mapping rules of transfer, sync and document loads."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import is_column_name, resolve
from tablemill.functions.types import CHAR_METADATA


def _source_columns(df: DataFrame, mappings: Mapping[str, str]) -> dict[str, str]:
    """Mapping keyed by the real source column, found ignoring case."""
    found = {}
    for source, target in mappings.items():
        name = resolve(source, df.columns)
        if name is None:
            raise RequestError(f"Mapped column '{source}' not found in source")
        found[name] = target
    return found


def project_mapped(df: DataFrame, mappings: Mapping[str, str] | None) -> DataFrame:
    """Transfer rule: a mapping moves only the columns it names."""
    if not mappings:
        return df
    pairs = _source_columns(df, mappings)
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in pairs.items()])


def rename_mapped(df: DataFrame, mappings: Mapping[str, str] | None) -> DataFrame:
    """Sync rule: every column moves; a mapping only renames."""
    if not mappings:
        return df
    return df.withColumnsRenamed(_source_columns(df, mappings))


def keep_field(
    name: str, include: Collection[str] | None, exclude: Collection[str] | None
) -> bool:
    """Whether a flattened document field is loaded."""
    if name == "_id" and name not in (include or ()):
        return False
    if include and name not in include:
        return False
    return name not in (exclude or ())


def usable_fields(
    names: list[str],
    include: Collection[str] | None = None,
    exclude: Collection[str] | None = None,
    mappings: Mapping[str, str] | None = None,
) -> tuple[dict[str, str], list[str]]:
    """(field -> column name, warnings): fields kept whose column name is valid."""
    kept: dict[str, str] = {}
    warnings: list[str] = []
    for name in names:
        if not keep_field(name, include, exclude):
            continue
        column = (mappings or {}).get(name, name)
        if is_column_name(column):
            kept[name] = column
        else:
            warnings.append(f"Skipping invalid column name: '{column}'")
    return kept, warnings


def _fitted(value: Column, field: T.StructField) -> Column:
    """The value as the field's type; text longer than a declared length is an error."""
    text = value.cast(field.dataType)
    declared = re.search(r"\((\d+)\)", field.metadata.get(CHAR_METADATA, ""))
    if declared is None:
        return text
    message = f"Text too long for column '{field.name}': more than {declared.group(1)} characters"
    too_long = F.length(text) > int(declared.group(1))
    return F.when(too_long, F.raise_error(F.lit(message)).cast("string")).otherwise(text)


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Give ``df`` the target's columns, order and types.

    A target column the source lacks is NULL; a source column the target lacks
    is an error. Casts follow the session: with ANSI on, overflow raises.
    """
    by_name = {c.lower(): c for c in df.columns}
    unknown = set(by_name) - {f.name.lower() for f in target}
    if unknown:
        names = ", ".join(sorted(by_name[u] for u in unknown))
        raise RequestError(f"Source columns not in target: {names}")
    columns = []
    for f in target:
        source = by_name.get(f.name.lower())
        value = F.col(f"`{source}`") if source else F.lit(None)
        columns.append(_fitted(value, f).alias(f.name))
    return df.select(*columns)
