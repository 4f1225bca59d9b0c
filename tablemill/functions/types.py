"""Type maps: source database types to Spark types, and schemas to DDL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

# Text and binary lengths a target column can declare.
MAX_DECLARED_LENGTH = 8000
DOCUMENT_DECIMAL = T.DecimalType(38, 18)

# Digits a double always gives back; a field that may need more, as one that whole numbers
# and fractions share, stays a decimal.
EXACT_DIGITS = 15

CHAR_METADATA = "__CHAR_VARCHAR_TYPE_STRING"

# Source type name -> Spark type. Unsigned bytes need ShortType, 100 ns
# timestamps lose their last digit, and an offset timestamp keeps the instant only.
SOURCE_TYPES: Mapping[str, T.DataType] = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "smallint": T.ShortType(),
    "tinyint": T.ShortType(),
    "bit": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "datetime2": T.TimestampNTZType(),
    "smalldatetime": T.TimestampNTZType(),
    "datetimeoffset": T.TimestampType(),
    "date": T.DateType(),
    "time": T.TimeType(6),
    "float": T.DoubleType(),
    "real": T.FloatType(),
    "uniqueidentifier": T.StringType(),
    "binary": T.BinaryType(),
    "varbinary": T.BinaryType(),
}


def source_type(
    name: str, length: int = 0, precision: int = 0, scale: int = 0
) -> T.DataType:
    """Spark type for a source column; text keeps its declared length."""
    name = name.lower()
    if name in ("decimal", "numeric"):
        return T.DecimalType(precision or 18, scale)
    if name in ("char", "varchar", "nchar", "nvarchar", "text", "ntext"):
        return T.VarcharType(length) if 0 < length <= MAX_DECLARED_LENGTH else T.StringType()
    return SOURCE_TYPES.get(name, T.StringType())


def declared_type(field: T.StructField) -> str:
    """DDL type of a field, with the CHAR/VARCHAR length Spark keeps in metadata."""
    return field.metadata.get(CHAR_METADATA, field.dataType.simpleString())


def quoted_ddl(dt: T.DataType) -> str:
    """DDL of a type with every field name in backticks, so that any name parses."""
    if isinstance(dt, T.StructType):
        fields = [f"`{f.name.replace('`', '``')}`: {quoted_ddl(f.dataType)}" for f in dt]
        return f"struct<{', '.join(fields)}>"
    if isinstance(dt, T.ArrayType):
        return f"array<{quoted_ddl(dt.elementType)}>"
    return dt.simpleString()


def table_ddl(schema: T.StructType, keep_not_null: bool = True) -> str:
    """Column list for CREATE TABLE."""
    parts = []
    for f in schema:
        tail = " NOT NULL" if keep_not_null and not f.nullable else ""
        parts.append(f"`{f.name}` {declared_type(f)}{tail}")
    return ", ".join(parts)


def jdbc_column_types(schema: T.StructType) -> str:
    """``createTableColumnTypes`` text: bounded text columns as VARCHAR(n).

    Without it a database gets its widest text type, which many can't group or index.
    """
    bounded = []
    for f in schema:
        text = declared_type(f)
        if isinstance(f.dataType, T.VarcharType) or text.lower().startswith(("varchar", "char")):
            bounded.append(f"`{f.name}` {text.upper()}")
    return ", ".join(bounded)


def document_type(dt: T.DataType) -> T.DataType | None:
    """Column type for an inferred document field; None for one never typed."""
    if isinstance(dt, T.NullType):
        return None
    if isinstance(dt, T.VariantType):
        return T.StringType()  # seen with conflicting types: keep the JSON text
    if isinstance(dt, T.DecimalType) and dt.scale > 0 and dt.precision <= EXACT_DIGITS:
        return T.DoubleType()  # a plain JSON fraction is a double
    return dt
