"""Document filters and staged document queries as Columns and DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import reduce
from numbers import Number
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import variant_path
from tablemill.operators.documents import variant_text

_COMPARE = {
    "$eq": lambda f, v: f == v,
    "$gt": lambda f, v: f > v,
    "$gte": lambda f, v: f >= v,
    "$lt": lambda f, v: f < v,
    "$lte": lambda f, v: f <= v,
}

# Comparisons that null passes when compared with null.
_NULL_PASSES = {"$eq", "$gte", "$lte"}

# Variant kinds that are numbers.
_NUMBER = "^(BIGINT|DECIMAL|DOUBLE)"

# Largest whole number a double holds exactly.
_EXACT_IN_DOUBLE = 2**53

# Sort ranks of a variant's kinds, by what its type's text starts with; null and missing come
# first, and what isn't listed last.
_KIND_RANKS = {"BIGINT": 1, "DECIMAL": 1, "DOUBLE": 1, "STRING": 2, "OBJECT": 3, "ARRAY": 4, "BOOLEAN": 5}


# --- fields -----------------------------------------------------------------------


def _child(column: Column, kind: T.StructType, name: str) -> tuple[Column, T.DataType] | None:
    same = [f for f in kind if f.name == name] or [f for f in kind if f.name.lower() == name.lower()]
    return (column.getField(same[0].name), same[0].dataType) if same else None


Place = tuple[Column, T.DataType, list[str]]


def _walk(column: Column, kind: T.DataType, names: Sequence[str]) -> Place | None:
    """The column at the path ``names`` below ``column``, its type, and the names that lie in a variant.

    Below an array of documents it is the array of their fields. None where no document has it.
    """
    for i, name in enumerate(names):
        if isinstance(kind, T.VariantType):
            return column, kind, list(names[i:])
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        found = _child(column, inner, name) if isinstance(inner, T.StructType) else None
        if found is None:
            return None
        column, kind = found[0], T.ArrayType(found[1]) if isinstance(kind, T.ArrayType) else found[1]
    return column, kind, []


class ColumnFields:
    """Document fields that are columns of a frame. Tests on them reach the scan.

    A column doesn't tell null from missing.
    """

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def place(self, path: str) -> Place | None:
        head, *rest = path.split(".")
        same = [f for f in self.schema if f.name == head] or [f for f in self.schema if f.name.lower() == head.lower()]
        return _walk(F.col("`" + same[0].name.replace("`", "``") + "`"), same[0].dataType, rest) if same else None


class VariantFields:
    """Fields of a parsed document, whose types differ from row to row."""

    def __init__(self, doc: str):
        self.doc = doc

    def place(self, path: str) -> Place | None:
        return F.col(self.doc), T.VariantType(), path.split(".")


class ElementFields:
    """Fields of an array's element; the path ``""`` is the element itself."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind

    def place(self, path: str) -> Place | None:
        return _walk(self.column, self.kind, path.split(".") if path else [])


Fields = ColumnFields | VariantFields | ElementFields


def _inside(value: Column, names: Sequence[str], data_type: str = "variant") -> Column:
    return F.try_variant_get(value, variant_path(names), data_type)


def _field(df: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    """A field and its type; None when no document has it."""
    found = ColumnFields(df).place(path)
    if found is None:
        return None
    value, kind, rest = found
    return (_inside(value, rest) if rest else value), kind


def _variant_like(value: Column, wanted: Any) -> Column | None:
    """A variant as a value of ``wanted``'s kind; NULL where it is of another."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    if isinstance(wanted, str):
        return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    if isinstance(wanted, Number):
        big = isinstance(wanted, int) and abs(wanted) > _EXACT_IN_DOUBLE
        number = F.try_variant_get(value, "$", "decimal(38,0)" if big else "double")
        return F.when(kind.rlike(_NUMBER), number)
    return None


def _like(value: Column, kind: T.DataType, wanted: Any) -> Column | None:
    """``value`` to compare with ``wanted``; None where its type never matches."""
    if isinstance(kind, T.VariantType):
        return _variant_like(value, wanted)
    kinds = {
        bool: T.BooleanType,
        str: T.StringType,
        Number: T.NumericType,
        date: (T.DateType, T.TimestampType, T.TimestampNTZType),
    }
    types = next((t for k, t in kinds.items() if isinstance(wanted, k)), ())
    return value if isinstance(kind, types) else None


def _missing(value: Column, kind: T.DataType) -> Column:
    missing = value.isNull()
    return missing | F.is_variant_null(value) if isinstance(kind, T.VariantType) else missing


# --- filters ----------------------------------------------------------------------
# A test is NULL or false where it fails; only what is negated is made two-valued, so that
# plain comparisons stay in a form that scans can take.

Test = Callable[[Column, T.DataType], Column]


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _reaches(base: Column, names: Sequence[str], test: Test, done: Sequence[str] = ()) -> Column:
    """Whether any value at ``names`` passes: an array on the way stands for each of its elements."""
    kind = T.VariantType()
    done = [*done, *names[:1]]
    value = _inside(base, done) if done else base
    elements = _inside(base, done, "array<variant>")
    if len(names) <= 1:
        return test(value, kind) | F.exists(elements, lambda e: test(e, kind))
    through = F.exists(elements, lambda e: F.schema_of_variant(e).startswith("OBJECT") & _reaches(e, names[1:], test))
    return F.when(elements.isNull(), _reaches(base, names[1:], test, done)).otherwise(through)


def _passes(fields: Fields, path: str, test: Test, absent: bool = False) -> Column:
    """Whether the field, or one of its elements, passes; ``absent`` is what no field gives."""
    found = fields.place(path)
    if found is None:
        return F.lit(absent)
    value, kind, rest = found
    if isinstance(kind, T.VariantType):
        return _reaches(value, rest, test)
    if isinstance(kind, T.ArrayType):
        some = F.exists(value, lambda e: test(e, kind.elementType))
        return some | value.isNull() if absent else some
    return test(value, kind)


def _elements(fields: Fields, path: str) -> tuple[Column, T.DataType] | None:
    """The array at ``path`` and its elements' type; NULL in rows where it is none."""
    found = fields.place(path)
    if found is None:
        return None
    value, kind, rest = found
    if isinstance(kind, T.VariantType):
        return _inside(value, rest, "array<variant>"), kind
    return (value, kind.elementType) if isinstance(kind, T.ArrayType) else None


def _compared(op: str, value: Any) -> Test:
    if isinstance(value, (Mapping, list, tuple)):
        raise RequestError(f"'{op}' compares with single values only")
    if value is None:
        return _missing if op in _NULL_PASSES else lambda c, k: F.lit(False)

    def test(column: Column, kind: T.DataType) -> Column:
        like = _like(column, kind, value)
        return F.lit(False) if like is None else _COMPARE[op](like, F.lit(value))

    return test


def _whole(op: str, value: Any, least: int | None = None) -> int:
    """``value`` if it is a whole number, and at least ``least``."""
    if isinstance(value, bool) or not isinstance(value, Number) or value != int(value) or (least is not None and value < least):
        raise RequestError(f"'{op}' needs a whole number" + (f" of at least {least}" if least is not None else ""))
    return int(value)


def _listed(op: str, value: Any) -> list[Any]:
    if not isinstance(value, (list, tuple, set, frozenset)):
        raise RequestError(f"'{op}' needs a list")
    return list(value)


def _pattern(pattern: Any, flags: str) -> Test:
    if not isinstance(pattern, str) or set(flags) - set("ims"):
        raise RequestError("'$regex' needs a text, and '$options' of i, m and s")

    def test(column: Column, kind: T.DataType) -> Column:
        like = _like(column, kind, "")
        return F.lit(False) if like is None else like.rlike(f"(?{flags}){pattern}" if flags else pattern)

    return test


def _test(fields: Fields, path: str, op: str, value: Any, flags: str = "") -> Column:
    if op in _COMPARE:
        return _passes(fields, path, _compared(op, value), absent=value is None and op in _NULL_PASSES)
    if op == "$ne":
        return ~_sure(_test(fields, path, "$eq", value))
    if op == "$in":
        tests = [_compared("$eq", v) for v in _listed(op, value)]
        return _passes(fields, path, lambda c, k: _any([t(c, k) for t in tests]), absent=None in value)
    if op == "$nin":
        return ~_sure(_test(fields, path, "$in", value))
    if op == "$all":
        return _all([_test(fields, path, "$eq", v) for v in _listed(op, value)]) if value else F.lit(False)
    if op == "$not":
        if not isinstance(value, Mapping):
            raise RequestError("'$not' needs operators")
        return ~_sure(_condition(fields, path, value))
    if op == "$exists":
        there = _sure(_passes(fields, path, lambda c, k: c.isNotNull()))
        return there if value else ~there
    if op == "$regex":
        return _passes(fields, path, _pattern(value, flags))
    if op == "$mod":
        divisor, rest = (_whole(op, v) for v in _listed(op, value))
        if not divisor:
            raise RequestError("'$mod' needs a divisor other than 0")

        def divides(column: Column, kind: T.DataType) -> Column:
            like = _like(column, kind, 0)
            return F.lit(False) if like is None else (F.floor(F.abs(like)) * F.signum(like)) % divisor == rest

        return _passes(fields, path, divides)
    if op in ("$size", "$elemMatch"):
        found = _elements(fields, path)
        if op == "$size":
            size = _whole(op, value, 0)
            return F.lit(False) if found is None else F.size(found[0]) == size
        if not isinstance(value, Mapping):
            raise RequestError("'$elemMatch' needs a filter")
        if found is None:
            return F.lit(False)
        array, kind = found
        on_value = value and all(k.startswith("$") and k not in _TREES for k in value)
        if on_value:
            return F.exists(array, lambda e: _condition(ElementFields(e, kind), "", value))
        return F.exists(array, lambda e: document_predicate(ElementFields(e, kind), value))
    raise RequestError(f"Unsupported filter operator: '{op}'")


def _condition(fields: Fields, path: str, condition: Any) -> Column:
    if not isinstance(condition, Mapping):
        return _test(fields, path, "$eq", condition)
    flags = condition.get("$options", "")
    return _all([_test(fields, path, op, value, flags) for op, value in condition.items() if op != "$options"])


_TREES = ("$and", "$or", "$nor")


def document_predicate(fields: Fields, spec: Mapping[str, Any]) -> Column:
    """A filter such as ``{"status": "active", "age": {"$gt": 18}}`` as one Column.

    A value of another kind never matches, rather than being cast. A field that is an array
    passes with any of its elements, and so does a field of documents in an array. Negations are
    true of what lacks the field. ``$and``, ``$or`` and ``$nor`` take lists of filters.
    """
    if not isinstance(spec, Mapping):
        raise RequestError("A filter maps fields to conditions")
    tests = []
    for path, condition in spec.items():
        if path in _TREES:
            inner = [document_predicate(fields, f) for f in _listed(path, condition)]
            if not inner:
                raise RequestError(f"'{path}' needs at least one filter")
            tests.append({"$and": _all, "$or": _any, "$nor": lambda t: ~_sure(_any(t))}[path](inner))
        elif path.startswith("$"):
            raise RequestError(f"Unsupported filter operator: '{path}'")
        else:
            tests.append(_condition(fields, path, condition))
    return _all(tests)


def filter_paths(spec: Mapping[str, Any]) -> set[str]:
    """The fields a filter asks for, without those of elements."""
    found = set()
    for path, condition in spec.items():
        found |= set().union(*map(filter_paths, condition)) if path in _TREES else {path}
    return found


def document_filter(df: DataFrame, spec: Mapping[str, Any] | None) -> DataFrame:
    return df.where(document_predicate(ColumnFields(df), spec)) if spec else df


# --- expressions ------------------------------------------------------------------

_ARITHMETIC = {
    "$add": lambda a, b: a + b,
    "$subtract": lambda a, b: a - b,
    "$multiply": lambda a, b: a * b,
    "$divide": lambda a, b: a / b,
    "$mod": lambda a, b: a % b,
}
# How many operands an operator takes, where it isn't any number.
_PAIRED = {"$subtract", "$divide", "$mod"}


def _typed(df: DataFrame, value: Any) -> tuple[Column, T.DataType]:
    column = _expression(df, value)
    return column, df.select(column.alias("f")).schema["f"].dataType


def _number(df: DataFrame, op: str, value: Any) -> Column:
    column, kind = _typed(df, value)
    if isinstance(kind, T.VariantType):
        return _variant_like(column, 0.0)
    if isinstance(kind, T.NullType):
        return column.cast("double")
    if not isinstance(kind, T.NumericType):
        raise RequestError(f"'{op}' needs numbers")
    return column


def _text(df: DataFrame, op: str, value: Any) -> Column:
    column, kind = _typed(df, value)
    if isinstance(kind, T.VariantType):
        return _variant_like(column, "")
    if not isinstance(kind, (T.StringType, T.NullType)):
        raise RequestError(f"'{op}' needs texts")
    return column.cast("string")


def _operation(df: DataFrame, op: str, given: Any) -> Column:
    """What an operator makes of a row; NULL where an operand of a sum or a text is NULL."""
    if op == "$literal":
        return F.lit(given)
    if op in ("$toUpper", "$toLower"):
        return F.coalesce((F.upper if op == "$toUpper" else F.lower)(_text(df, op, given)), F.lit(""))
    if op == "$size":
        found = _elements(ColumnFields(df), given[1:]) if isinstance(given, str) and given.startswith("$") else None
        if found is None:
            raise RequestError("'$size' needs an array field")
        return F.size(found[0])
    if op == "$cond":
        parts = [given[k] for k in ("if", "then", "else")] if isinstance(given, Mapping) else _listed(op, given)
        if len(parts) != 3:
            raise RequestError("'$cond' needs a test and two values")
        return F.when(_truth(df, parts[0]), _expression(df, parts[1])).otherwise(_expression(df, parts[2]))
    operands = _listed(op, given)
    if op in _ARITHMETIC:
        if len(operands) < 1 or (op in _PAIRED and len(operands) != 2):
            raise RequestError(f"'{op}' has {len(operands)} operands")
        return reduce(_ARITHMETIC[op], [_number(df, op, v) for v in operands])
    if op == "$concat":
        return F.concat(*[_text(df, op, v) for v in operands])
    if op == "$ifNull":
        values = [_typed(df, v) for v in operands]
        return F.coalesce(*[F.when(~_missing(c, k), c) for c, k in values])
    raise RequestError(f"Unsupported expression: '{op}'")


def _truth(df: DataFrame, given: Any) -> Column:
    """A test inside an expression: a comparison of a field with a constant, or a tree of them."""
    if not isinstance(given, Mapping) or len(given) != 1:
        raise RequestError("A test is one operator and its operands")
    (op, operands), = given.items()
    if op in ("$and", "$or"):
        return (_all if op == "$and" else _any)([_truth(df, t) for t in _listed(op, operands)])
    if op == "$not":
        return ~_sure(_truth(df, _listed(op, operands)[0] if isinstance(operands, (list, tuple)) else operands))
    operands = _listed(op, operands)
    if len(operands) != 2 or not (isinstance(operands[0], str) and operands[0].startswith("$")):
        raise RequestError(f"'{op}' compares a field with a constant")
    if op not in (*_COMPARE, "$ne", "$in"):
        raise RequestError(f"Unsupported test: '{op}'")
    return _test(ColumnFields(df), operands[0][1:], op, operands[1])


def _expression(df: DataFrame, value: Any) -> Column:
    """``"$a.b"`` is a field, a mapping an operator or a document, anything else a constant."""
    if isinstance(value, str) and value.startswith("$"):
        found = _field(df, value[1:])
        return found[0] if found else F.lit(None)
    if isinstance(value, Mapping):
        if any(k.startswith("$") for k in value):
            if len(value) != 1:
                raise RequestError("An expression has one operator")
            (op, given), = value.items()
            return _operation(df, op, given)
        return F.struct(*[_expression(df, v).alias(k) for k, v in value.items()])
    return F.lit(value)


# --- stages -----------------------------------------------------------------------


def _included(df: DataFrame, paths: Sequence[str], prefix: str = "") -> list[Column]:
    """Named fields, with nested ones under their parents."""
    columns = []
    for head in dict.fromkeys(p.split(".")[0] for p in paths):
        full = f"{prefix}{head}"
        below = [p[len(head) + 1 :] for p in paths if p.startswith(f"{head}.")]
        found = _field(df, full)
        if found is None:
            continue
        if head in paths or not below:
            columns.append(found[0].alias(head))
            continue
        inner = _included(df, below, f"{full}.")
        if inner:
            columns.append(F.when(found[0].isNotNull(), F.struct(*inner)).alias(head))
    return columns


def _without(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """``df`` without the fields at ``paths``; a document that loses all its fields goes as well."""
    for path in paths:
        parent, _, name = path.rpartition(".")
        if not parent:
            df = df.drop(name)
            continue
        found, parent_field = _field(df, path), _field(df, parent)
        if found is None:
            continue
        if not isinstance(parent_field[1], T.StructType):
            raise RequestError(f"'{path}' lies in no document")
        if len(parent_field[1]) == 1:
            df = _without(df, [parent])
            continue
        head, *rest = path.split(".")
        df = df.withColumn(head, F.col(f"`{head}`").dropFields(".".join("`" + n.replace("`", "``") + "`" for n in rest)))
    return df


def _project(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    def is_flag(v: Any, on: bool) -> bool:
        return isinstance(v, (bool, int, float)) and bool(v) is on

    dropped = [k for k, v in spec.items() if is_flag(v, False)]
    if len(dropped) == len(spec):
        return _without(df, dropped)
    if any(k != "_id" for k in dropped):
        raise RequestError("$project can't mix included and excluded fields")
    wanted = [k for k, v in spec.items() if is_flag(v, True)]
    if "_id" in df.columns and "_id" not in spec:
        wanted.insert(0, "_id")
    computed = [
        _expression(df, v).alias(k)
        for k, v in spec.items()
        if not is_flag(v, True) and not is_flag(v, False)
    ]
    return df.select(*_included(df, wanted), *computed)


def _total(df: DataFrame, value: Any) -> Column:
    """Sum of a field's numbers; other values and missing fields count as 0, as does a text."""
    if isinstance(value, str):
        found = _field(df, value[1:]) if value.startswith("$") else None
        if found is None:
            return F.lit(0)
        number, kind = found
        if isinstance(kind, T.VariantType):
            # Of a field that is text in some documents, the numbers of the others.
            number = _variant_like(number, 0.0)
        elif not isinstance(kind, T.NumericType):
            return F.lit(0)
        return F.coalesce(F.sum(number), F.lit(0))
    if value == 1:
        return F.count(F.lit(1))
    return F.coalesce(F.sum(F.lit(value)), F.lit(0))


def _ordering(value: Column, kind: T.DataType, largest: bool = False) -> Column | None:
    """What values are ordered by, NULL for null: their kind's rank, then the value. None if they can't be.

    An array stands for its least element, or its ``largest``.
    """
    if isinstance(kind, T.VariantType):
        name = F.schema_of_variant(value)
        rank = F.coalesce(*[F.when(name.startswith(k), F.lit(r)) for k, r in _KIND_RANKS.items()], F.lit(9))
        number = F.when(name.rlike(_NUMBER), _inside(value, [], "double"))
        return F.when(~_missing(value, kind), F.struct(rank.alias("rank"), number.alias("n"), _inside(value, [], "string").alias("s")))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.VariantType, T.MapType)):
            return None
        return (F.array_max if largest else F.array_min)(value)
    return None if isinstance(kind, T.MapType) else value


def _accumulated(df: DataFrame, op: str, value: Any) -> Column:
    """One accumulator as an aggregate that Spark merges from partial states."""
    if op == "$sum":
        return _total(df, value)
    if op == "$count":
        return F.count(F.lit(1))
    column, kind = _typed(df, value)
    if op == "$avg":
        # Other values than numbers don't count.
        if isinstance(kind, T.VariantType):
            return F.avg(_variant_like(column, 0.0))
        return F.avg(column) if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    if op in ("$min", "$max"):
        order = _ordering(column, kind, op == "$max")
        if order is None or isinstance(kind, T.ArrayType):
            raise RequestError(f"'{op}' can't order {kind.simpleString()}")
        return (F.min_by if op == "$min" else F.max_by)(column, order)
    if op == "$addToSet":
        if isinstance(kind, T.VariantType):
            column = variant_text(column)
        return F.array_sort(F.collect_set(column))
    raise RequestError(f"Unsupported accumulator: '{op}'")


def _group(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    key = spec.get("_id")
    totals = []
    for name, accumulator in spec.items():
        if name == "_id":
            continue
        (op, value), = accumulator.items()
        totals.append(_accumulated(df, op, value).alias(name))
    value = _expression(df, key).alias("_id")
    if isinstance(df.select(value).schema["_id"].dataType, T.VariantType):
        value = variant_text(value).alias("_id")  # variants can't be compared
    return df.groupBy(value).agg(*totals) if totals else df.select(value).distinct()


def _path(op: str, value: Any) -> str:
    if not isinstance(value, str) or not value.startswith("$") or len(value) < 2:
        raise RequestError(f"'{op}' needs a field such as '$a.b'")
    return value[1:]


def _with(df: DataFrame, path: str, value: Column) -> DataFrame:
    """``df`` with the field at ``path`` set, within its document where the path has parents."""
    head, *rest = path.split(".")
    if not rest:
        return df.withColumn(head, value)
    found = _field(df, ".".join([head, *rest[:-1]]))
    if found is None or not isinstance(found[1], T.StructType):
        raise RequestError(f"'{path}' lies in no document")
    inner = ".".join("`" + n.replace("`", "``") + "`" for n in rest)
    return df.withColumn(head, F.col(f"`{head}`").withField(inner, value))


_AT, _ELEMENT = "__at", "__element"


def _unwind(df: DataFrame, spec: Any) -> DataFrame:
    """A row per element, in the array's place. What is no array counts as its only element.

    Rows whose array is missing, null or empty go, unless ``preserveNullAndEmptyArrays``.
    """
    spec = spec if isinstance(spec, Mapping) else {"path": spec}
    unknown = set(spec) - {"path", "preserveNullAndEmptyArrays", "includeArrayIndex"}
    if unknown:
        raise RequestError(f"Unsupported option of $unwind: '{min(unknown)}'")
    path = _path("$unwind", spec.get("path"))
    outer, index = bool(spec.get("preserveNullAndEmptyArrays")), spec.get("includeArrayIndex")
    found = _field(df, path)
    if found is None:
        out = df if outer else df.where(F.lit(False))
        return out.withColumn(index, F.lit(None).cast("bigint")) if index else out
    value, kind = found
    if isinstance(kind, T.ArrayType):
        array, single = value, F.lit(False)
    else:
        several = _inside(value, [], "array<variant>") if isinstance(kind, T.VariantType) else None
        alone = F.when(~_missing(value, kind), F.array(value))
        array, single = (alone, F.lit(True)) if several is None else (F.coalesce(several, alone), several.isNull())
    generator = (F.posexplode_outer if outer else F.posexplode)(array)
    rows = df.withColumn("__single", single).select("*", generator.alias(_AT, _ELEMENT))
    rows = _with(rows, path, F.col(_ELEMENT))
    if index:
        rows = rows.withColumn(index, F.when(~F.col("__single"), F.col(_AT).cast("bigint")))
    return rows.drop(_AT, _ELEMENT, "__single")


def _sort(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """By the given fields, null and missing before all else; with ``$limit`` behind it, Spark takes a top-k."""
    order = []
    for path, way in spec.items():
        if way not in (1, -1):
            raise RequestError("'$sort' takes 1 or -1")
        found = _field(df, path)
        if found is None:
            continue
        key = _ordering(*found, largest=way < 0)
        if key is None:
            raise RequestError(f"'$sort' can't order '{path}'")
        order.append(key.asc_nulls_first() if way > 0 else key.desc_nulls_last())
    return df.orderBy(*order) if order else df


def _add_fields(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """All fields from the row as it came, then set together."""
    fresh = {f"__set{i}": (path, _expression(df, value)) for i, (path, value) in enumerate(spec.items())}
    out = df.select("*", *[v.alias(n) for n, (_, v) in fresh.items()])
    for name, (path, _) in fresh.items():
        out = _with(out, path, F.col(name))
    return out.drop(*fresh)


def _unset(df: DataFrame, spec: Any) -> DataFrame:
    return _project(df, dict.fromkeys([spec] if isinstance(spec, str) else _listed("$unset", spec), 0))


def _count(df: DataFrame, name: str) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias(name))
    return counted.where(F.col(f"`{name}`") > 0)


def _sort_by_count(df: DataFrame, value: Any) -> DataFrame:
    return _sort(_group(df, {"_id": value, "count": {"$sum": 1}}), {"count": -1})


_STAGES = {
    "$match": document_filter,
    "$project": _project,
    "$group": _group,
    "$unwind": _unwind,
    "$sort": _sort,
    "$limit": lambda df, n: df.limit(_whole("$limit", n, 1)),
    "$skip": lambda df, n: df.offset(_whole("$skip", n, 0)),
    "$addFields": _add_fields,
    "$set": _add_fields,
    "$unset": _unset,
    "$count": _count,
    "$sortByCount": _sort_by_count,
}


def _stage(stage: Mapping[str, Any]) -> tuple[str, Any]:
    if not isinstance(stage, Mapping) or len(stage) != 1:
        raise RequestError("A pipeline stage has one name")
    return next(iter(stage.items()))


def apply_pipeline(df: DataFrame, stages: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Fold the stages over ``df``, each into DataFrame steps that Catalyst plans together."""
    for name, spec in map(_stage, stages):
        if name not in _STAGES:
            raise RequestError(f"Unsupported pipeline stage: '{name}'")
        df = _STAGES[name](df, spec)
    return df


def split_leading_matches(
    stages: Sequence[Mapping[str, Any]],
) -> tuple[list[Mapping[str, Any]], list[Mapping[str, Any]]]:
    """(filters of the leading $match stages, the stages after them)."""
    n = next((i for i, s in enumerate(stages) if "$match" not in s), len(stages))
    return [s["$match"] for s in stages[:n]], list(stages[n:])


def _sized(value: Any) -> set[str]:
    """Fields whose elements an expression counts."""
    if isinstance(value, Mapping):
        own = {v[1:] for k, v in value.items() if k == "$size" and isinstance(v, str)}
        return own.union(*map(_sized, value.values()))
    return set().union(*map(_sized, value)) if isinstance(value, (list, tuple)) else set()


def array_paths(stages: Sequence[Mapping[str, Any]]) -> set[str]:
    """Fields that the stages need as arrays, where they are arrays, and not as text."""
    found = set()
    for name, spec in map(_stage, stages):
        if name == "$unwind":
            found.add(_path(name, spec.get("path") if isinstance(spec, Mapping) else spec))
        elif name == "$match":
            found |= filter_paths(spec)
        elif name == "$sort":
            found |= set(spec)
        else:
            found |= _sized(spec)
    return found


def deciding_stages(stages: Sequence[Mapping[str, Any]]) -> list[Mapping[str, Any]]:
    """The stages that decide whether there is any row: grouping alone never drops the last."""
    dropping = {"$match", "$unwind", "$skip"}
    last = max((i for i, s in enumerate(stages) if dropping & set(s)), default=-1)
    return list(stages[: last + 1])


def makes_groups(stages: Sequence[Mapping[str, Any]] | None) -> bool:
    return any({"$group", "$sortByCount"} & set(stage) for stage in stages or ())


def keeps_documents(stages: Sequence[Mapping[str, Any]]) -> bool:
    """Whether each row out is one document in, and every document is read."""
    return all(set(stage) <= {"$match", "$project", "$addFields", "$set", "$unset", "$sort"} for stage in stages)
