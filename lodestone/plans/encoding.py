"""How terms stand in columns.

A position has a plain Spark type wherever it can; constants and strings then are the same
strings.  Positions that mix kinds of terms or may hold labelled nulls have the TERM struct: kind, value,
datatype, language, all strings, so equality, hashing and grouping are those of terms.
"""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.terms import Const, Func, Lit, Null, Term, unparse

TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("k", "v", "dt", "lang")])
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)

_DATATYPE = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "binary": "hexBinary"}


class PlanError(ValueError):
    """The query cannot be planned as it stands."""


def is_term(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == TERM.names


def term_struct(kind: str, value: Column, datatype: Column | str = "", lang: Column | str = "") -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("k"), value.cast("string").alias("v"), text(datatype).alias("dt"), text(lang).alias("lang"))


def to_term(col: Column, t: T.DataType) -> Column:
    """A column of any type as TERM; strings become constants."""
    if is_term(t):
        return col
    if isinstance(t, T.StringType):
        return term_struct("c", col)
    kind = _DATATYPE.get(t.simpleString(), "decimal" if isinstance(t, T.DecimalType) else t.simpleString())
    return term_struct("l", col if not isinstance(t, T.BinaryType) else F.hex(col), kind)


def term_value(term: Term) -> tuple[str, str, str, str]:
    """TERM fields of a ground term."""
    if isinstance(term, Const):
        return "c", term.name, "", ""
    if isinstance(term, Null):
        return "n", term.name, "", ""
    if isinstance(term, Lit):
        return ("c", str(term.value), "", "") if term.datatype == "string" and not term.lang else ("l", unparse(term), term.datatype, term.lang or "")
    if isinstance(term, Func):
        return "f", str(term), "", ""
    raise PlanError(f"{term} is no ground term")


def native(term: Term) -> tuple[object, T.DataType]:
    """Python value and natural type of a ground term."""
    if isinstance(term, Const):
        return term.name, T.StringType()
    if isinstance(term, Lit):
        v = term.value
        if isinstance(v, bool):
            return v, T.BooleanType()
        if isinstance(v, int):
            return (v, T.LongType()) if -(2**63) <= v < 2**63 else (decimal.Decimal(v), T.DecimalType(38, 0))
        if isinstance(v, float):
            return v, T.DoubleType()
        if isinstance(v, decimal.Decimal):
            return v, T.DecimalType(38, 18)
        if isinstance(v, datetime.datetime):
            return v, T.TimestampType()
        if isinstance(v, datetime.date):
            return v, T.DateType()
        if isinstance(v, bytes):
            return v, T.BinaryType()
        if isinstance(v, str) and not term.lang:
            return v, T.StringType()
    return term_value(term), TERM


def literal_column(term: Term, target: T.DataType | None = None) -> tuple[Column, T.DataType]:
    """The term as a column, in the target's type if that has it."""
    value, t = native(term)
    if target is not None and is_term(target) or is_term(t):
        k, v, dt, lang = term_value(term)
        return term_struct(k, F.lit(v), dt, lang), TERM
    return F.lit(value).cast(t), t


def same(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Equality of terms; types that never agree are never equal."""
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
        return F.lit(False)
    if is_term(ta) or is_term(tb):
        return to_term(a, ta).eqNullSafe(to_term(b, tb))
    if isinstance(ta, NUMERIC) and isinstance(tb, NUMERIC):
        return a == b
    if ta.simpleString() != tb.simpleString():
        dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
        if isinstance(ta, dates) and isinstance(tb, dates):
            return a.cast("timestamp") == b.cast("timestamp")
        return F.lit(False)
    return a.eqNullSafe(b)


def common(ta: T.DataType, tb: T.DataType) -> T.DataType:
    """The type in which two positions of one variable meet."""
    if ta.simpleString() == tb.simpleString() or isinstance(tb, T.NullType):
        return ta
    if isinstance(ta, T.NullType):  # positions of predicates that nobody fills
        return tb
    if isinstance(ta, INTEGRAL) and isinstance(tb, INTEGRAL):
        return T.LongType()
    if isinstance(ta, NUMERIC) and isinstance(tb, NUMERIC):
        return T.DoubleType()
    return TERM


def convert(col: Column, t: T.DataType, target: T.DataType) -> Column:
    if t.simpleString() == target.simpleString():
        return col
    if isinstance(t, T.NullType):
        return col.cast(target)
    return to_term(col, t) if is_term(target) else col.cast(target)


def number(col: Column, t: T.DataType) -> Column | None:
    """A double where the value is numeric."""
    if isinstance(t, NUMERIC):
        return col.cast("double")
    if is_term(t):
        return F.when((col["k"] == "l") & col["dt"].isin("integer", "decimal", "double", "float", "long", "int", "short", "byte"), col["v"].try_cast("double"))
    return None


def compare(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Comparison of values: never an error, false if incomparable, but != is true there."""
    ops = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "!=": lambda x, y: x != y}
    apply = ops[op]
    missing = F.lit(op == "!=")
    na, nb = number(a, ta), number(b, tb)
    if not is_term(ta) and not is_term(tb):
        if isinstance(ta, NUMERIC) and isinstance(tb, NUMERIC):
            return apply(a, b)
        dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
        if isinstance(ta, dates) and isinstance(tb, dates) and type(ta) is not type(tb):
            return F.coalesce(apply(a.cast("timestamp"), b.cast("timestamp")), missing)
        if isinstance(ta, dates) and isinstance(tb, T.StringType):
            return F.coalesce(apply(a, b.try_cast(ta)), missing)
        if isinstance(tb, dates) and isinstance(ta, T.StringType):
            return F.coalesce(apply(a.try_cast(tb), b), missing)
        return apply(a, b) if ta.simpleString() == tb.simpleString() else missing
    x, y = to_term(a, ta), to_term(b, tb)
    numeric = apply(na, nb) if na is not None and nb is not None else F.lit(None).cast("boolean")
    texts = F.when((x["k"] == y["k"]) & (x["dt"] == y["dt"]) & ~x["k"].isin("n", "f"), apply(x["v"], y["v"]))
    if op == "!=":
        return F.coalesce(numeric, ~x.eqNullSafe(y))
    return F.coalesce(numeric, texts, missing)


def from_row(value: object) -> Term:
    """The term that a collected value stands for."""
    if hasattr(value, "asDict") and set(value.asDict()) == {"k", "v", "dt", "lang"}:
        if value.k == "c":
            return Const(value.v)
        if value.k == "n":
            return Null(value.v)
        if value.k == "f":
            return Func(value.v, (), evaluable=False)
        from lodestone.terms import literal

        return literal(value.v, value.dt, value.lang or None)
    if isinstance(value, str):
        return Const(value)
    from lodestone.terms import from_python

    return from_python(value)
