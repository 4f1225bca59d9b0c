"""Identifier rules, as a driver check and as a Column."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from tablemill.errors import RequestError

# The identifier rule.
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"
MAX_NAME_LENGTH = 128

COLUMN_PATTERN = rf"\A{IDENTIFIER}\z"
TABLE_PATTERN = rf"\A{IDENTIFIER}(\.{IDENTIFIER})?\z"

COLUMN_MESSAGE = "Invalid column name: '%s'. Only letters, numbers, and underscores are allowed."
TABLE_MESSAGE = (
    "Invalid table name: '%s'. Only letters, numbers, underscores, "
    "and dots (for schema.table) are allowed."
)

_COLUMN = re.compile(IDENTIFIER)
_TABLE = re.compile(rf"{IDENTIFIER}(\.{IDENTIFIER})?")


def is_column_name(name: str | None) -> bool:
    return bool(name) and len(name) <= MAX_NAME_LENGTH and _COLUMN.fullmatch(name) is not None


def is_table_name(name: str | None) -> bool:
    return bool(name) and len(name) <= MAX_NAME_LENGTH and _TABLE.fullmatch(name) is not None


def column_name_ok(name: Column) -> Column:
    """TRUE where the text is a valid column name; never NULL."""
    # \z, not $: $ would also accept a trailing newline.
    fits = F.length(name) <= MAX_NAME_LENGTH
    return F.coalesce(fits & name.rlike(COLUMN_PATTERN), F.lit(False))


def table_name_ok(name: Column) -> Column:
    """TRUE where the text is a valid ``table`` or ``schema.table`` name; never NULL."""
    fits = F.length(name) <= MAX_NAME_LENGTH
    return F.coalesce(fits & name.rlike(TABLE_PATTERN), F.lit(False))


def require_table_name(name: str) -> None:
    if not is_table_name(name):
        raise RequestError(TABLE_MESSAGE % name)


def require_columns(names: Iterable[str]) -> None:
    """Refuse bad column names, and two columns of one name (case ignored)."""
    seen: set[str] = set()
    for name in names:
        if not is_column_name(name):
            raise RequestError(COLUMN_MESSAGE % name)
        if name.lower() in seen:
            raise RequestError(f"Duplicate column name: '{name}'")
        seen.add(name.lower())


def resolve(name: str, columns: Iterable[str]) -> str | None:
    """The column that ``name`` means, ignoring case; None if there is none."""
    return next((c for c in columns if c.lower() == name.lower()), None)


def quoted(name: str) -> str:
    """A column or dotted table name in backticks for SQL text."""
    return ".".join(f"`{part}`" for part in name.split("."))


def variant_path(names: Iterable[str]) -> str:
    """The path of a field inside a variant, whatever its name."""
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)
