"""Python functions as computed predicates: scalar and table-valued, by pandas batches."""

from __future__ import annotations

import importlib
import importlib.util
import inspect
import json
import typing
from collections import abc
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

#: Variadic arguments carry no hints, so the kind of UDF is named.
_SCALAR = PandasUDFType.SCALAR
_TYPES = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def _spark_type(hint: object, default: T.DataType) -> T.DataType:
    if typing.get_origin(hint) in (list, tuple, set, abc.Iterator, abc.Iterable):
        inner = typing.get_args(hint)
        return T.ArrayType(_spark_type(inner[0] if inner else str, T.StringType()))
    return _TYPES.get(hint, default)


def _fits(value: object, hint: object) -> bool:
    if hint in (inspect.Parameter.empty, typing.Any, None) or not isinstance(hint, type):
        return True
    if hint is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, hint) and not (hint is int and isinstance(value, bool))


@dataclass
class PythonFunction:
    """A user function; mode "python" passes native values and enforces type hints, mismatch meaning no row.

    `many` functions give an iterable of outputs, one row each.  `solver` gets all positions with None at
    the unknown ones and gives complete tuples; it serves calls with at least `min_bound` known positions.
    """

    name: str
    function: Callable
    input_arity: int | None = None
    many: bool = False
    returns: str | T.DataType | None = None
    mode: str = "python"
    output_position: int | None = None
    min_bound: int | None = None
    solver: Callable | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("python", "terms"):
            raise ValueError("mode is python or terms")
        if self.min_bound is not None and self.solver is None:
            raise ValueError("min_bound needs a solver")
        hints = typing.get_type_hints(self.function) if callable(self.function) else {}
        parameters = list(inspect.signature(self.function).parameters)
        if self.input_arity is None:
            self.input_arity = len(parameters)
        self.hints = [hints.get(p, inspect.Parameter.empty) for p in parameters]
        if self.returns is None:
            self.returns = _spark_type(hints.get("return"), T.StringType())
            if self.many and isinstance(self.returns, T.ArrayType):
                self.returns = self.returns.elementType
        elif isinstance(self.returns, str):
            self.returns = T._parse_datatype_string(self.returns)

    def column(self, args: list[Column]) -> Column:
        """The output column; of many outputs the array of them."""
        function, hints, many = self.function, self.hints, self.many
        strict = self.mode == "python"

        def one(values: tuple) -> object:
            native = [v.item() if hasattr(v, "item") else v for v in values]
            if strict and any(h is not inspect.Parameter.empty and not _fits(v, h) for v, h in zip(native, hints, strict=False)):
                return [] if many else None
            try:
                out = function(*native)
            except Exception:  # noqa: BLE001  a failing function has no value
                return [] if many else None
            return list(out) if many else out

        def batch(*columns: pd.Series) -> pd.Series:
            return pd.Series([one(v) for v in zip(*columns, strict=True)], dtype=object)

        kind = T.ArrayType(self.returns) if many else self.returns
        wrapped = F.pandas_udf(batch, returnType=kind, functionType=_SCALAR)
        return wrapped(*args) if args else wrapped(F.lit(0))

    def solve(self, known: list[Column | None], types: list[T.DataType]) -> Column:
        """An array of complete tuples (as structs p0, p1, ...) from the known positions."""
        solver, places = self.solver, [i for i, c in enumerate(known) if c is not None]
        size = len(known)
        kind = T.ArrayType(T.StructType([T.StructField(f"p{i}", t) for i, t in enumerate(types)]))

        def batch(*columns: pd.Series) -> pd.Series:
            out = []
            for row in zip(*columns, strict=True):
                full = [None] * size
                for place, value in zip(places, row, strict=True):
                    full[place] = value.item() if hasattr(value, "item") else value
                try:
                    out.append([dict(zip((f"p{i}" for i in range(size)), t, strict=True)) for t in solver(*full)])
                except Exception:  # noqa: BLE001
                    out.append([])
            return pd.Series(out, dtype=object)

        return F.pandas_udf(batch, returnType=kind, functionType=_SCALAR)(*(known[i] for i in places))


def _module(config: dict, base: Path):
    if "path" in config and str(config["path"]).endswith(".py"):
        path = (base / config["path"]).resolve()
        spec = importlib.util.spec_from_file_location(config.get("module") or path.stem, path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module
    name = config.get("module") or config["package"]
    if "path" in config:
        path = (base / config["path"] / f"{name.rsplit('.', 1)[-1]}.py").resolve()
        spec = importlib.util.spec_from_file_location(name, path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module
    return importlib.import_module(name)


def load_computed(path: str | Path, prefix: str) -> dict[str, PythonFunction]:
    """Functions of a JSON configuration (schema_version 1), named prefix:name."""
    path = Path(path)
    config = json.loads(path.read_text(encoding="utf-8"))
    if config.get("schema_version", 1) != 1:
        raise ValueError("schema_version must be 1")
    default = config.get("default", {})
    providers = default.get("providers", {}).get("python") or []
    providers = providers if isinstance(providers, list) else [providers]
    if "functions" in default:
        providers = [*providers, default["functions"]]
    found = {}
    for p in providers:
        if "module" not in p and "package" not in p:
            raise ValueError("a provider names a module or a package")
        holder = _module(p, path.parent)
        holder = getattr(holder, p["class"]) if "class" in p else holder
        for name, value in vars(holder).items():
            value = value.__func__ if isinstance(value, staticmethod) else value
            if not name.startswith("_") and inspect.isfunction(value):
                found[f"{prefix}:{name}"] = PythonFunction(f"{prefix}:{name}", value)
    return found


def register_all(into: dict[str, PythonFunction], functions: dict[str, PythonFunction]) -> None:
    for name, f in functions.items():
        if name in into:
            raise ValueError(f"{name} is registered already")
        into[name] = f
