"""The standard functions as JVM-side column expressions.

A function gets typed columns and gives one column; NULL means that it has no
value there, and the row goes.  No expression can raise: arithmetic is try_*, casts are
try_cast.  Collections are arrays (sets sorted and distinct), dictionaries are
arrays of (key, value) entries sorted by key, because Spark cannot compare maps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FunctionError(ValueError):
    """The call can have no value: unknown name, wrong number or types of inputs."""


@dataclass(frozen=True)
class Arg:
    col: Column
    type: T.DataType


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _is_dict(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and t.elementType.names == ["key", "value"]


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise FunctionError(why)


def _whole(args: list[Arg]) -> bool:
    return all(isinstance(a.type, _INTEGRAL) for a in args)


def _number(a: Arg, whole: bool) -> Column:
    _need(isinstance(a.type, (*_INTEGRAL, *_REAL, T.StringType, T.NullType)), "numbers are needed")
    kind = "bigint" if whole else "double"
    value = a.col.try_cast(kind)
    return F.when(~F.isnan(value), value) if not whole and isinstance(a.type, T.StringType) else value


def _spread(args: list[Arg], build: Callable[[Column, bool], Column]) -> Column:
    """The numbers as one array: a single collection, or the arguments."""
    if len(args) == 1 and isinstance(args[0].type, T.ArrayType):
        inner = Arg(args[0].col, args[0].type.elementType)
        whole = isinstance(inner.type, _INTEGRAL)
        values = F.transform(args[0].col, lambda x: _number(Arg(x, inner.type), whole))
    else:
        whole = _whole(args)
        values = F.array(*(_number(a, whole) for a in args))
    sound = (F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull())
    return F.when(sound, build(values, whole))


def _fold(step: Callable[[Column, Column], Column], real: bool = False):
    def build(values: Column, whole: bool) -> Column:
        if real:
            values = F.transform(values, lambda x: x.cast("double"))
        first = F.get(values, F.lit(0))
        return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), first, step)

    return lambda args: _spread(args, build)


def _power(args: list[Arg]) -> Column:
    whole = _whole(args)
    base, exponent = (_number(a, False) for a in args)
    value = F.pow(base, exponent)
    value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if not whole:
        return value
    base, exponent = (_number(a, True) for a in args)
    # exact products, NULL on overflow; beyond 64 factors only -1, 0 and 1 have a value, and only parity counts
    turns = F.when(exponent > 64, 64 + exponent % 2).otherwise(exponent).cast("int")
    product = F.aggregate(F.sequence(F.lit(1), turns), F.lit(1).cast("bigint"), lambda a, _: F.try_multiply(a, base))
    # a negative exponent would give a fraction and keeps its column whole only if integral
    return F.when(exponent > 0, product).when(exponent == 0, F.lit(1).cast("bigint")).otherwise(F.when(value == F.floor(value), value.try_cast("bigint")))


def _average(values: Column, whole: bool) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return total / F.size(values)


def _median(values: Column, whole: bool) -> Column:
    s = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    n = F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _weighted(args: list[Arg]) -> Column:
    """(v, w) entries from pairs or a flat list."""
    if len(args) == 1 and isinstance(args[0].type, T.ArrayType) and isinstance(args[0].type.elementType, T.ArrayType):
        t = args[0].type.elementType.elementType
        return F.transform(args[0].col, lambda p: F.struct(_number(Arg(F.get(p, F.lit(0)), t), False).alias("v"), _number(Arg(F.get(p, F.lit(1)), t), False).alias("w")))
    if len(args) > 1 and all(isinstance(a.type, T.ArrayType) for a in args):
        return F.array(*(F.struct(_number(Arg(F.get(a.col, F.lit(0)), a.type.elementType), False).alias("v"), _number(Arg(F.get(a.col, F.lit(1)), a.type.elementType), False).alias("w")) for a in args))
    if len(args) == 1 and isinstance(args[0].type, T.ArrayType):
        flat = F.transform(args[0].col, lambda x: _number(Arg(x, args[0].type.elementType), False))
    else:
        _need(len(args) % 2 == 0, "values and weights come in pairs")
        flat = F.array(*(_number(a, False) for a in args))
    pairs = F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1)
    entries = F.transform(pairs, lambda i: F.struct(F.get(flat, 2 * i).alias("v"), F.get(flat, 2 * i + 1).alias("w")))
    return F.when((F.size(flat) > 0) & (F.size(flat) % 2 == 0), entries)


def _sound_weights(p: Column) -> Column:
    return (F.size(p) > 0) & ~F.exists(p, lambda x: x["v"].isNull() | x["w"].isNull() | (x["w"] < 0))


def _weighted_average(args: list[Arg]) -> Column:
    p = _weighted(args)
    up = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["v"] * x["w"])
    down = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["w"])
    return F.when(_sound_weights(p), F.try_divide(up, down))


def _weighted_median(args: list[Arg]) -> Column:
    p = F.array_sort(_weighted(args))
    half = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["w"]) / 2
    sums = F.transform(p, lambda x, i: F.struct(F.aggregate(F.slice(p, F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["w"]).alias("s"), x["v"].alias("v"), i.alias("i")))
    at = F.get(F.filter(sums, lambda x: x["s"] >= half), F.lit(0))
    follow = F.get(p, at["i"].cast("int") + 1)["v"]
    return F.when(_sound_weights(p) & (half > 0), F.when(at["s"] == half, (at["v"] + F.coalesce(follow, at["v"])) / 2).otherwise(at["v"]))


def _int(a: Arg) -> Column:
    """As an integer; fractions are cut off."""
    if isinstance(a.type, _INTEGRAL):
        return a.col.cast("bigint")
    return _number(a, False).try_cast("bigint")


def _prime(args: list[Arg]) -> Column:
    n = _int(args[0])
    root = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
    none = ~F.exists(F.sequence(F.lit(2).cast("bigint"), F.greatest(root, F.lit(2).cast("bigint"))), lambda d: n % d == 0)
    return F.when(n < 2, F.lit(False)).when(n < 4, F.lit(True)).otherwise(none)


def _compare(op: Callable[[Column, Column], Column]):
    return lambda args: op(_number(args[0], False), _number(args[1], False))


def _lexical(op: Callable[[Column, Column], Column]):
    def build(args: list[Arg]) -> Column:
        _need(all(isinstance(a.type, T.StringType) for a in args), "strings are needed")
        return op(args[0].col, args[1].col)

    return build


def _string(build: Callable[..., Column]):
    def check(args: list[Arg]) -> Column:
        _need(all(isinstance(a.type, T.StringType) for a in args), "strings are needed")
        return build(*(a.col for a in args))

    return check


def _equals(args: list[Arg]) -> Column:
    if len({a.type.simpleString() for a in args}) > 1:
        return F.lit(False)
    out = F.lit(True)
    for a, b in zip(args, args[1:], strict=False):
        out &= a.col.eqNullSafe(b.col)
    return out


def _concat(args: list[Arg]) -> Column:
    both = [isinstance(a.type, T.StringType) for a in args]
    _need(all(both) or args[0].type == args[1].type and isinstance(args[0].type, T.ArrayType), "two strings or two lists are needed")
    return F.concat(args[0].col, args[1].col)


def _contains(args: list[Arg]) -> Column:
    a, b = args
    if isinstance(a.type, T.StringType):
        _need(isinstance(b.type, T.StringType), "a string is needed")
        return F.contains(a.col, b.col)
    _need(isinstance(a.type, T.ArrayType), "a collection is needed")
    if a.type.elementType.simpleString() != b.type.simpleString():
        return F.lit(False)
    return F.coalesce(F.array_contains(a.col, b.col), F.lit(False))


def _empty(args: list[Arg]) -> Column:
    a = args[0]
    _need(isinstance(a.type, (T.StringType, T.ArrayType)), "a string or collection is needed")
    return a.col == "" if isinstance(a.type, T.StringType) else F.size(a.col) == 0


def _numeric(args: list[Arg]) -> Column:
    a = args[0]
    if isinstance(a.type, (*_INTEGRAL, *_REAL, T.BooleanType)):
        return F.lit(True)
    if not isinstance(a.type, T.StringType):
        return F.lit(False)
    v = F.trim(a.col).try_cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def _shown(a: Arg) -> Column:
    if isinstance(a.type, T.StringType):
        return F.concat(F.lit('"'), a.col, F.lit('"'))
    if isinstance(a.type, T.ArrayType):
        inner = a.type.elementType
        return F.concat(F.lit("["), F.array_join(F.transform(a.col, lambda x: _shown(Arg(x, inner))), ", "), F.lit("]"))
    return a.col.cast("string")


_KIND = {"string": "string", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}


def _to_int(args: list[Arg]) -> Column:
    a = args[0]
    if isinstance(a.type, T.StringType):
        return F.when(a.col.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(a.col).try_cast("bigint"))
    _need(not isinstance(a.type, (T.DecimalType, T.ArrayType)), "no integer")
    return a.col.cast("int").cast("bigint") if isinstance(a.type, T.BooleanType) else a.col.try_cast("bigint")


def _to_float(args: list[Arg]) -> Column:
    _need(not isinstance(args[0].type, T.ArrayType), "no number")
    return args[0].col.cast("int").cast("double") if isinstance(args[0].type, T.BooleanType) else args[0].col.try_cast("double")


def _to_boolean(args: list[Arg]) -> Column:
    a = args[0]
    if isinstance(a.type, T.BooleanType):
        return a.col
    if isinstance(a.type, T.StringType):
        return ~F.lower(F.trim(a.col)).isin("", "false", "0")
    return F.size(a.col) > 0 if isinstance(a.type, T.ArrayType) else a.col != 0


def _list(args: list[Arg]) -> Column:
    kinds = {a.type.simpleString() for a in args}
    _need(len(kinds) <= 1, "members of one type are needed")
    return F.array(*(a.col for a in args)) if args else F.array().cast("array<string>")


def _as_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def _collections(args: list[Arg]) -> list[Column]:
    if len(args) == 1 and isinstance(args[0].type, T.ArrayType) and isinstance(args[0].type.elementType, T.ArrayType):
        return [args[0].col]
    _need(all(isinstance(a.type, T.ArrayType) for a in args) and len({a.type.simpleString() for a in args}) == 1, "collections of one type are needed")
    return [F.array(*(a.col for a in args))]


def _union(args: list[Arg]) -> Column:
    return _as_set(F.flatten(_collections(args)[0]))


def _intersection(args: list[Arg]) -> Column:
    many = _collections(args)[0]
    return _as_set(F.aggregate(F.slice(many, F.lit(2), F.greatest(F.size(many) - 1, F.lit(0))), F.get(many, F.lit(0)), lambda a, x: F.array_intersect(a, x)))


def _subset(strict: bool):
    def build(args: list[Arg]) -> Column:
        _need(args[0].type == args[1].type and isinstance(args[0].type, T.ArrayType), "two sets are needed")
        a, b = args[0].col, args[1].col
        inside = F.size(F.array_except(a, b)) == 0
        return inside & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b))) if strict else inside

    return build


def _array(build: Callable[[Column], Column]):
    def check(args: list[Arg]) -> Column:
        _need(isinstance(args[0].type, T.ArrayType), "a collection is needed")
        return build(args[0].col)

    return check


def _entries(pairs: Column) -> Column:
    """Sorted entries; of equal keys the last stays."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"].eqNullSafe(x["key"])))
    return F.array_sort(last)


def _dict(args: list[Arg]) -> Column:
    if not args:
        return F.array().cast("array<struct<key:string,value:string>>")
    if len(args) == 1 and isinstance(args[0].type, T.ArrayType) and isinstance(args[0].type.elementType, T.ArrayType):
        pairs = F.transform(args[0].col, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))
        sound = ~F.exists(args[0].col, lambda p: F.size(p) != 2)
        return F.when(sound, _entries(pairs))
    _need(all(isinstance(a.type, T.ArrayType) for a in args) and len({a.type.simpleString() for a in args}) == 1, "pairs are needed")
    sound = F.lit(True)
    for a in args:
        sound &= F.size(a.col) == 2
    return F.when(sound, _entries(F.array(*(F.struct(F.get(a.col, F.lit(0)).alias("key"), F.get(a.col, F.lit(1)).alias("value")) for a in args))))


def _on_dict(build: Callable[..., Column]):
    def check(args: list[Arg]) -> Column:
        _need(_is_dict(args[0].type), "a dictionary is needed")
        return build(*(a.col for a in args))

    return check


def _merge(args: list[Arg]) -> Column:
    _need(_is_dict(args[0].type) and args[0].type == args[1].type, "two dictionaries are needed")
    return _entries(F.concat(args[0].col, args[1].col))


def _get(args: list[Arg]) -> Column:
    a, key = args
    if _is_dict(a.type):
        found = F.filter(a.col, lambda x: x["key"].eqNullSafe(key.col))
        value = F.get(found, F.lit(0))["value"]
        return F.when(F.size(found) > 0, value).otherwise(F.lit("null") if isinstance(a.type.elementType["value"].dataType, T.StringType) else F.lit(None))
    _need(isinstance(a.type, T.ArrayType) and isinstance(key.type, _INTEGRAL), "a list and an index are needed")
    return F.get(a.col, key.col.cast("int"))


_MANY = 10**6
# Names and numbers of inputs.
_TABLE: dict[str, tuple[int, int, Callable[[list[Arg]], Column]]] = {
    "sum": (1, _MANY, _fold(F.try_add)),
    "min": (1, _MANY, lambda args: _spread(args, lambda v, w: F.array_min(v))),
    "max": (1, _MANY, lambda args: _spread(args, lambda v, w: F.array_max(v))),
    "minus": (1, _MANY, _fold(F.try_subtract)),
    "product": (1, _MANY, _fold(F.try_multiply)),
    "divide": (2, _MANY, _fold(F.try_divide, real=True)),
    "power": (2, 2, _power),
    "average": (1, _MANY, lambda args: _spread(args, _average)),
    "median": (1, _MANY, lambda args: _spread(args, _median)),
    "weightedAverage": (1, _MANY, _weighted_average),
    "weightedMedian": (1, _MANY, _weighted_median),
    "isEven": (1, 1, lambda args: _int(args[0]) % 2 == 0),
    "isOdd": (1, 1, lambda args: _int(args[0]) % 2 != 0),
    "isPrime": (1, 1, _prime),
    "isGreaterThan": (2, 2, _compare(lambda a, b: a > b)),
    "isGreaterOrEqualsTo": (2, 2, _compare(lambda a, b: a >= b)),
    "isSmallerThan": (2, 2, _compare(lambda a, b: a < b)),
    "isSmallerOrEqualsTo": (2, 2, _compare(lambda a, b: a <= b)),
    "isLexicographicallyGreaterThan": (2, 2, _lexical(lambda a, b: a > b)),
    "isLexicographicallyGreaterOrEqualsTo": (2, 2, _lexical(lambda a, b: a >= b)),
    "isLexicographicallySmallerThan": (2, 2, _lexical(lambda a, b: a < b)),
    "isLexicographicallySmallerOrEqualsTo": (2, 2, _lexical(lambda a, b: a <= b)),
    "equals": (2, _MANY, _equals),
    "concat": (2, 2, _concat),
    "toLowerCase": (1, 1, _string(F.lower)),
    "toUpperCase": (1, 1, _string(F.upper)),
    "replace": (3, 3, _string(lambda s, a, b: F.when(a == "", F.regexp_replace(s, "(?s)(?=.)|$", F.regexp_replace(b, r"([\\$])", r"\\$1"))).otherwise(F.replace(s, a, b)))),
    "length": (1, 1, _string(lambda s: F.char_length(s).cast("bigint"))),
    "contains": (2, 2, _contains),
    "isEmpty": (1, 1, _empty),
    "isBlank": (1, 1, _string(lambda s: s.rlike(r"(?U)^\s*$"))),
    "isNumeric": (1, 1, _numeric),
    "toString": (1, 1, lambda args: _shown(args[0])),
    "toStringWithDatatype": (1, 1, lambda args: F.concat(F.lit(f"Literal<{_KIND.get(args[0].type.simpleString(), 'collection')}> "), _shown(args[0]))),
    "toInt": (1, 1, _to_int),
    "toFloat": (1, 1, _to_float),
    "toBoolean": (1, 1, _to_boolean),
    "tuple": (0, _MANY, _list),
    "toTuple": (1, 1, _array(lambda a: a)),
    "set": (0, _MANY, lambda args: _as_set(_list(args))),
    "toSet": (1, 1, _array(_as_set)),
    "union": (1, _MANY, _union),
    "intersection": (1, _MANY, _intersection),
    "isSubset": (2, 2, _subset(False)),
    "isStrictSubset": (2, 2, _subset(True)),
    "size": (1, 1, _array(lambda a: F.size(a).cast("bigint"))),
    "dict": (0, _MANY, _dict),
    "mergeDicts": (2, 2, _merge),
    "dictKeys": (1, 1, _on_dict(lambda d: _as_set(F.transform(d, lambda x: x["key"])))),
    "dictValues": (1, 1, _on_dict(lambda d: F.transform(d, lambda x: x["value"]))),
    "get": (2, 2, _get),
    "containsKey": (2, 2, _on_dict(lambda d, k: F.exists(d, lambda x: x["key"].eqNullSafe(k)))),
    "containsValue": (2, 2, _on_dict(lambda d, v: F.exists(d, lambda x: x["value"].eqNullSafe(v)))),
}


def names() -> list[str]:
    return list(_TABLE)


def arity(name: str) -> tuple[int, int]:
    if name not in _TABLE:
        raise FunctionError(f"no function {name}")
    return _TABLE[name][0], _TABLE[name][1]


def evaluate(name: str, args: list[Arg]) -> Column:
    """The function's value; NULL where it has none."""
    least, most = arity(name)
    _need(least <= len(args) <= most, f"{name} takes {least} to {most} inputs")
    return _TABLE[name][2]([_wide(a) for a in args])


def _wide(a: Arg) -> Arg:
    """Integers of any width as bigint, fractions as double, inside collections too."""
    def widened(t: T.DataType) -> T.DataType:
        if isinstance(t, _INTEGRAL):
            return T.LongType()
        if isinstance(t, T.FloatType):
            return T.DoubleType()
        return T.ArrayType(widened(t.elementType)) if isinstance(t, T.ArrayType) else t

    kind = widened(a.type)
    return a if kind.simpleString() == a.type.simpleString() else Arg(a.col.cast(kind), kind)


INVERTIBLE = frozenset(["sum", "minus", "product", "divide", "average"])


def invert(name: str, args: list[Arg | None], output: Arg) -> Column:
    """The one unknown input from the others and the output; NULL where there is none.

    The caller evaluates the function forward again and compares, so that
    truncated or overflowing solutions go.
    """
    _need(name in INVERTIBLE and sum(a is None for a in args) == 1, f"{name} cannot be solved here")
    at = args.index(None)
    known = [a for a in args if a is not None]
    whole = _whole([*known, output])
    out = _number(output, False)
    values = [None if a is None else _number(a, False) for a in args]
    rest = [v for v in values if v is not None]
    total, times = F.lit(0.0), F.lit(1.0)
    for v in rest:
        total, times = total + v, times * v
    if name == "sum":
        x = out - total
    elif name == "average":
        x = out * len(args) - total
    elif name == "product":
        x = F.try_divide(out, times)
    elif name == "minus":
        x = out + total if at == 0 else values[0] - (total - values[0]) - out
    elif at == 0:
        x = F.when(times != 0, out * times)
    else:
        x = F.try_divide(values[0], out * F.try_divide(times, values[0])) if len(args) > 2 else F.try_divide(values[0], out)
    return F.when(x == F.floor(x), x.try_cast("bigint")) if whole and name != "divide" else x
