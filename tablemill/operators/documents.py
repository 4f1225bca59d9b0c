"""Nested JSON documents to flat columns.

Documents come as one text column. Each is parsed once into a variant; fields
are then read from that binary form. The set of fields is inferred over all
documents by one aggregate, so none is lost for being rare or late.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field as dataclass_field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablemill.functions.names import require_columns, variant_path
from tablemill.functions.types import DOCUMENT_DECIMAL, document_type, quoted_ddl
from tablemill.operators.mapping import usable_fields

DOC = "__doc"
_FRAMED = "__framed"
# What follows a text that is parsed; a whole number, as no other digits in a text give it.
_END = 4098273648172635

# What can be done with an array. Any other mode means Serialize.
SERIALIZE = "serialize"
SKIP = "skip"
FIRST_ELEMENT = "firstelement"


@dataclass(frozen=True)
class DocumentOptions:
    flatten: bool = True
    separator: str = "_"
    array_handling: str = "Serialize"
    include_fields: Collection[str] | None = None
    exclude_fields: Collection[str] | None = None
    field_mappings: Mapping[str, str] | None = None
    drop_group_id: bool = False
    #: Dotted names of fields to read as arrays, for pipelines; others follow ``array_handling``.
    array_fields: Collection[str] = ()

    @property
    def array_mode(self) -> str:
        mode = self.array_handling.lower()
        return mode if mode in (SKIP, FIRST_ELEMENT) else SERIALIZE


@dataclass
class Flattened:
    """Columns to select, what was left out, and when a row fails conversion."""

    columns: list[Column]
    names: list[str]
    warnings: list[str] = dataclass_field(default_factory=list)
    failed: Column | None = None


# --- parsing and quarantine -------------------------------------------------


def parsed(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` with the document as variant DOC: NULL for text that is no JSON object.

    The text is parsed as the first of an array's two elements, the other being ``_END``: Spark's
    parser stops behind the first value, and so would see neither a second document nor what else
    follows. A bracket that follows would close the array early, which then has no ``_END``; texts
    that hold that number themselves are parsed as the one field of an object as well.
    """
    text = F.col(json_col)
    # The plain tests settle all but padded text.
    opens = text.startswith("{") | text.rlike(r"\A\s+\{")
    closes = text.endswith("}") | text.rlike(r"\}\s+\z")
    framed = F.when(opens & closes, F.try_parse_json(F.concat(F.lit("["), text, F.lit(f",{_END}]"))))
    end, more = (F.variant_get(_FRAMED, f"$[{i}]", "variant") for i in (1, 2))
    ended = (F.schema_of_variant(end) == "BIGINT") & (F.try_variant_get(end, "$", "bigint") == _END) & more.isNull()
    broken = text.contains(str(_END)) & F.try_parse_json(F.concat(F.lit('{"d":'), text, F.lit("}"))).isNull()
    found = df.withColumn(_FRAMED, framed)
    return found.withColumn(DOC, F.when(ended & ~broken, F.variant_get(_FRAMED, "$[0]", "variant"))).drop(_FRAMED)


def only_parsed(df: DataFrame, json_col: str) -> DataFrame:
    """Good documents with DOC.

    The count between parse and filter keeps the optimizer from copying the
    parse into the filter, which would parse every text twice.
    """
    name = f"documents-{uuid.uuid4().hex}"
    seen = parsed(df, json_col).observe(name, F.count(DOC).alias("good"))
    return seen.where(F.col(DOC).isNotNull())


def good_documents(df: DataFrame, json_col: str) -> DataFrame:
    return parsed(df, json_col).where(F.col(DOC).isNotNull()).drop(DOC)


def rejected_documents(df: DataFrame, json_col: str) -> DataFrame:
    return parsed(df, json_col).where(F.col(DOC).isNull()).drop(DOC)


# --- schema -----------------------------------------------------------------

# A quoted name, or the keyword that DDL spells STRUCT.
_OBJECT = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<")


def _as_struct(variant_schema: str | None) -> T.StructType:
    """The StructType of a variant schema text."""
    if variant_schema is None or not variant_schema.startswith("OBJECT<"):
        return T.StructType()
    ddl = _OBJECT.sub(
        lambda m: "STRUCT<" if m.group(0) == "OBJECT<" else m.group(0), variant_schema
    )
    return T.DataType.fromDDL(ddl)


def infer_document_schema(df: DataFrame, json_col: str) -> T.StructType:
    """Fields and types over all documents, in name order; types widen where documents differ."""
    return schema_of_parsed(parsed(df, json_col))


def schema_of_parsed(df: DataFrame) -> T.StructType:
    """Fields and types of the documents in DOC, by one aggregate."""
    return _as_struct(df.agg(F.schema_of_variant_agg(DOC).alias("s")).first()["s"])


# Extended-JSON wrappers: a document of such fields stands for a value of this type; where
# documents use several for one field, the type widens. The value of any other field that
# starts with $ is kept as text.
WRAPPERS = {
    "$oid": "string",
    "$date": "timestamp_ntz",
    "$numberInt": "int",
    "$numberLong": "bigint",
    "$numberDouble": "double",
    "$numberDecimal": DOCUMENT_DECIMAL.simpleString(),
    "$binary": "binary",
    "$timestamp": "timestamp_ntz",
}


def _wrappers(dt: T.DataType) -> list[str]:
    """The wrappers a field's documents use: all its names start with $; none for other fields."""
    names = dt.names if isinstance(dt, T.StructType) else []
    return names if all(n.startswith("$") for n in names) else []


def _wrapped_type(wrappers: Sequence[str]) -> str:
    """The type that holds the values of all these wrappers; text where none else does."""
    types = {WRAPPERS.get(w, "string") for w in wrappers}
    if len(types) == 1:
        return types.pop()
    if types <= {"int", "bigint"}:
        return "bigint"
    if types <= {"int", "double"}:
        return "double"
    if types <= {"int", "bigint", "double", DOCUMENT_DECIMAL.simpleString()}:
        return DOCUMENT_DECIMAL.simpleString()
    return "string"


def _utc(instant: Column) -> Column:
    """An instant as UTC wall-clock time, whatever the session's zone."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def _unwrapped(value: Column, wrapper: str) -> Column:
    """The value a wrapper's text stands for; NULL where the text doesn't convert."""
    if wrapper == "$date":
        millis = F.get_json_object(value, "$.$numberLong").try_cast("bigint")
        return _utc(F.coalesce(value.try_cast("timestamp"), F.timestamp_millis(millis)))
    if wrapper == "$binary":
        return F.try_to_binary(F.get_json_object(value, "$.base64"), F.lit("base64"))
    if wrapper == "$timestamp":
        return _utc(F.timestamp_seconds(F.get_json_object(value, "$.t").try_cast("bigint")))
    return value.try_cast(WRAPPERS.get(wrapper, "string"))


def _unwrapped_all(value: Column, wrappers: Sequence[str]) -> tuple[Column, Column]:
    """(the value whichever wrapper holds it, whether there is one that doesn't convert)."""
    data_type = _wrapped_type(wrappers)
    values, failures = [], []
    for w in wrappers:
        raw = value.getField(w)
        found = raw if data_type == "string" else _unwrapped(raw, w).try_cast(data_type)
        values.append(found)
        failures.append(raw.isNotNull() & found.isNull())
    return F.coalesce(*values), reduce(lambda a, b: a | b, failures)


def variant_text(value: Column) -> Column:
    """Text of a value whose type differs between documents: a wrapper's content, else the value."""
    inner = [F.try_variant_get(value, variant_path([w]), "string") for w in WRAPPERS]
    wrapped = F.schema_of_variant(value).startswith("OBJECT<`$") | F.schema_of_variant(value).startswith("OBJECT<$")
    whole = F.try_variant_get(value, "$", "string")
    return F.when(wrapped, F.coalesce(*inner, whole)).otherwise(whole)


def _read_type(dt: T.DataType, options: DocumentOptions, path: str) -> T.DataType | None:
    """Type to read the field at ``path`` as; None for a field that never holds a value."""
    if _wrappers(dt):
        return T.StructType([T.StructField(n, T.StringType()) for n in _wrappers(dt)])
    if isinstance(dt, T.VariantType):
        return dt  # stays what it is in each document until it is flattened
    if isinstance(dt, T.StructType):
        if not options.flatten and path not in options.array_fields:
            return T.StringType()  # JSON text
        fields = [(f.name, _read_type(f.dataType, options, f"{path}.{f.name}")) for f in dt]
        kept = [T.StructField(n, t) for n, t in fields if t is not None]
        return T.StructType(kept) if kept else None
    if isinstance(dt, T.ArrayType):
        element = dt.elementType
        if path in options.array_fields:
            element = T.VariantType() if case_clashes(element) else _read_type(element, options, path)
            return T.ArrayType(element) if element else None
        if options.array_mode == SKIP:
            return None
        if options.array_mode == SERIALIZE:
            return T.StringType()  # JSON text
        if isinstance(element, (T.StructType, T.ArrayType)):
            return T.ArrayType(T.StringType())
        element = document_type(element)
        return T.ArrayType(element) if element else None
    return document_type(dt)


def _same_names(schema: T.StructType) -> list[list[T.StructField]]:
    """Fields in order, those whose names differ only in case together."""
    groups: dict[str, list[T.StructField]] = {}
    for f in schema:
        groups.setdefault(f.name.lower(), []).append(f)
    return list(groups.values())


def case_clashes(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted names that a document also has in another case."""
    if not isinstance(schema, T.StructType):
        return []
    found = []
    for group in _same_names(schema):
        found += [f"{prefix}{f.name}" for f in group[1:]]
        for f in group:
            found += case_clashes(f.dataType, f"{prefix}{f.name}.")
    return found


def _fields(path: list[str], schema: T.StructType, options: DocumentOptions) -> list[Column]:
    """The fields of the document at ``path``; of names that differ only in case the last one.

    Each is read straight from the parsed document, whose names have case; where the document
    has several, the later one wins, and where their types differ their text is kept.
    """
    columns = []
    for group in _same_names(schema):
        types = [(f, _read_type(f.dataType, options, ".".join([*path, f.name]))) for f in group]
        kept = [(f, t) for f, t in types if t is not None]
        if not kept:
            continue
        name = kept[-1][0].name
        if len({quoted_ddl(t) for _, t in kept}) == 1:
            values = [_field_value([*path, f.name], f.dataType, t, options) for f, t in kept]
        else:
            values = [F.try_variant_get(DOC, variant_path([*path, f.name]), "string") for f, _ in kept]
        columns.append((values[0] if len(values) == 1 else F.coalesce(*reversed(values))).alias(name))
    return columns


def _field_value(path: list[str], dt: T.DataType, read_as: T.DataType, options: DocumentOptions) -> Column:
    if isinstance(read_as, T.StructType) and not _wrappers(dt) and case_clashes(dt):
        whole = F.try_variant_get(DOC, variant_path(path), "variant")
        return F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.struct(*_fields(path, dt, options)))
    return F.try_variant_get(DOC, variant_path(path), quoted_ddl(read_as))


def read_documents(
    df: DataFrame,
    json_col: str,
    schema: T.StructType | None = None,
    options: DocumentOptions = DocumentOptions(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Top-level document fields as columns; nested documents stay structs.

    ``df`` may hold DOC already. Bad documents yield NULL fields, so filter first.
    """
    if schema is None:
        schema = infer_document_schema(df, json_col)
    source = df if DOC in df.columns else parsed(df, json_col)
    return source.select(*keep, *_fields([], schema, options))


# --- flattening -------------------------------------------------------------


def _array_value(value: Column, dt: T.ArrayType, mode: str) -> Column:
    if mode == FIRST_ELEMENT:
        first = F.get(value, F.lit(0))
        nested = isinstance(dt.elementType, (T.StructType, T.ArrayType, T.MapType))
        return F.to_json(first) if nested else first
    return F.to_json(value)


def _leaves(
    schema: T.StructType, options: DocumentOptions, prefix: str = "", parent: Column | None = None
):
    """(flattened name, value, type, wrapper failure) in schema order."""
    for f in schema:
        name = f"{prefix}{options.separator}{f.name}" if prefix else f.name
        value = F.col(f"`{f.name.replace('`', '``')}`") if parent is None else parent.getField(f.name)
        dt = f.dataType
        if _wrappers(dt):
            converted, failure = _unwrapped_all(value, _wrappers(dt))
            yield name, converted, failure
        elif isinstance(dt, T.VariantType):
            yield name, variant_text(value), None
        elif isinstance(dt, T.StructType) and options.flatten:
            yield from _leaves(dt, options, name, value)
        elif isinstance(dt, (T.StructType, T.MapType)):
            yield name, F.to_json(value), None
        elif isinstance(dt, T.ArrayType):
            if options.array_mode != SKIP:
                yield name, _array_value(value, dt, options.array_mode), None
        elif not isinstance(dt, T.NullType):
            yield name, value, None


def flatten_plan(
    df: DataFrame, options: DocumentOptions = DocumentOptions(), keep_id: bool = False
) -> Flattened:
    """How to flatten ``df``: the driver walks the schema, the executors run one select."""
    values: dict[str, Column] = {}
    failures: list[Column] = []
    warnings: list[str] = []
    for name, value, failure in _leaves(df.schema, options):
        if failure is not None:
            failures.append(failure)
        known = next((n for n in values if n.lower() == name.lower()), None)
        if known is None:
            values[name] = value
            continue
        # The later field wins, where the document has it.
        warnings.append(f"Field name clash: '{name}'")
        earlier = values.pop(known)
        types = df.select(value.alias("a"), earlier.alias("b")).schema
        if types["a"].dataType != types["b"].dataType:
            value, earlier = value.cast("string"), earlier.cast("string")
        values[name] = F.coalesce(value, earlier)
    include = options.include_fields
    if keep_id and "_id" in values and include:
        include = [*include, "_id"]
    names = list(values)
    kept, skipped = usable_fields(
        [n for n in names if not (keep_id and n == "_id")],
        include,
        options.exclude_fields,
        options.field_mappings,
    )
    if keep_id and "_id" in values:
        kept = {"_id": (options.field_mappings or {}).get("_id", "_id"), **kept}
    require_columns(kept.values())
    columns = [values[n].alias(c) for n, c in kept.items()]
    failed = reduce(lambda a, b: a | b, failures) if failures else None
    return Flattened(columns, list(kept.values()), warnings + skipped, failed)


def flatten(
    df: DataFrame, options: DocumentOptions = DocumentOptions(), keep_id: bool = False
) -> DataFrame:
    """Nested columns as flat ones: ``a.b`` becomes ``a<separator>b``."""
    return df.select(*flatten_plan(df, options, keep_id).columns)


def flatten_documents(
    df: DataFrame,
    json_col: str,
    options: DocumentOptions = DocumentOptions(),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Good documents as flat columns."""
    if schema is None:
        schema = infer_document_schema(df, json_col)
    good = only_parsed(df, json_col)
    return flatten(read_documents(good, json_col, schema, options), options)


def inferred_columns(
    schema: T.StructType, options: DocumentOptions = DocumentOptions()
) -> tuple[list[tuple[str, str]], list[str]]:
    """((field, type), ...) that a load would write, and the warnings. Driver only."""
    rows: dict[str, str] = {}

    def walk(node: T.StructType, prefix: str) -> None:
        for f in node:
            name = f"{prefix}{options.separator}{f.name}" if prefix else f.name
            dt = _read_type(f.dataType, options, "")
            if dt is None:
                continue
            if _wrappers(dt):
                rows[name] = _wrapped_type(_wrappers(dt))
            elif isinstance(dt, T.StructType):
                walk(f.dataType, name)
            elif isinstance(dt, T.ArrayType):
                rows[name] = dt.elementType.simpleString()
            else:
                rows[name] = "string" if isinstance(dt, T.VariantType) else dt.simpleString()

    walk(schema, "")
    kept, warnings = usable_fields(
        list(rows), options.include_fields, options.exclude_fields, options.field_mappings
    )
    return [(column, rows[name]) for name, column in kept.items()], warnings


# --- reading JSON tables back -------------------------------------------------


def json_values(
    df: DataFrame, json_col: str, columns: Mapping[str, tuple[str, str]], keep: Sequence[str] = ()
) -> DataFrame:
    """Typed columns out of a JSON table: name -> (JSON path, type). Bad casts are NULL."""
    doc = F.try_parse_json(json_col)
    picked = [
        F.try_variant_get("__j", path, data_type).alias(name)
        for name, (path, data_type) in columns.items()
    ]
    return df.withColumn("__j", doc).select(*keep, *picked)


def open_json(df: DataFrame, json_col: str, ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON table's documents under a declared schema."""
    return df.select(*keep, F.from_json(json_col, ddl).alias("__j")).select(*keep, "__j.*")


# --- raw JSON -----------------------------------------------------------------

JSON_SUFFIX = "_JSON"


def json_table_name(name: str) -> str:
    return name if name.upper().endswith(JSON_SUFFIX) else f"{name}{JSON_SUFFIX}"
