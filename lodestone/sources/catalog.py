"""Predicates and where their rows come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.python import PythonFunction
from lodestone.plans.encoding import TERM, PlanError, common, native, term_value
from lodestone.syntax import Atom
from lodestone.terms import Func, Null, Var

Key = tuple[str, int]


@dataclass
class Source:
    """Rows of one predicate, columns c0 .. cn-1.

    `fetch` serves a source that needs bindings: it gets the distinct values of the mandatory positions as
    a DataFrame with these columns and gives whole rows.
    """

    load: Callable[[], DataFrame] | None
    schema: T.StructType
    mandatory: frozenset[int] = frozenset()
    fetch: Callable[[DataFrame], DataFrame] | None = None
    writable: bool = False
    origin: str = "memory"
    #: Takes rows that are to be added, if the source keeps them elsewhere than in a plan.
    write: Callable[[DataFrame], None] | None = None

    def rows(self) -> int | None:
        """Number of rows; Parquet counts from its footers.  Unknown where bindings are needed."""
        return None if self.load is None else self.frame().count()

    def frame(self) -> DataFrame:
        if self.load is None:
            raise PlanError("this source needs bindings")
        return self.load()


class Store(Protocol):
    """Facts kept in a database: a source per predicate, and idempotent insertion."""

    def source(self, key: Key) -> Source | None: ...

    def add(self, key: Key, df: DataFrame) -> None: ...


def positional(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def frame_source(df: DataFrame, origin: str = "frame", writable: bool = False) -> Source:
    df = positional(df)
    return Source(lambda: df, df.schema, writable=writable, origin=origin)


def facts_frames(spark: SparkSession, facts: Iterable[Atom]) -> dict[Key, DataFrame]:
    """Parsed facts as frames; a position is native if all its terms share one type, else TERM."""
    rows: dict[Key, dict] = {}
    for a in facts:
        if any(isinstance(t, Var) for t in a.terms):
            raise PlanError(f"{a} holds a query variable")
        rows.setdefault(a.key, {})[a.terms] = None
    out = {}
    for key, found in rows.items():
        columns, fields = [], []
        for i in range(key[1]):
            terms = [r[i] for r in found]
            kinds = {native(t)[1].simpleString() for t in terms if not isinstance(t, (Null, Func))}
            plain = len(kinds) == 1 and not any(isinstance(t, (Null, Func)) for t in terms)
            columns.append([native(t)[0] if plain else term_value(t) for t in terms])
            fields.append(T.StructField(f"c{i}", native(terms[0])[1] if plain else TERM))
        data = list(zip(*columns, strict=True)) if key[1] else [()]
        out[key] = spark.createDataFrame(data, T.StructType(fields)) if key[1] else spark.range(1).select(F.lit(True).alias("c_any")).drop("c_any")
    return out


@dataclass
class Catalog:
    """Every predicate has exactly one source; dynamic sources are asked for unknown predicates."""

    spark: SparkSession
    sources: dict[Key, Source] = field(default_factory=dict)
    functions: dict[str, PythonFunction] = field(default_factory=dict)
    versions: dict[tuple[Key, str], DataFrame] = field(default_factory=dict)
    dynamic: list[Callable[[Key], Source | None]] = field(default_factory=list)
    default_sink: bool = True
    aliases: dict[Key, Callable[[], DataFrame]] = field(default_factory=dict)
    #: Where predicates without a source of their own are read from and written to.
    store: Store | None = None

    # reading
    def add(self, name: str, source: Source | DataFrame, arity: int | None = None) -> Catalog:
        source = source if isinstance(source, Source) else frame_source(source)
        key = name, len(source.schema) if arity is None else arity
        if key in self.sources:
            raise PlanError(f"{name}/{key[1]} has a source already")
        self.sources[key] = source
        return self

    def add_facts(self, facts: Iterable[Atom]) -> Catalog:
        for key, df in facts_frames(self.spark, facts).items():
            self.insert(key, df)
        return self

    def parquet(self, folder: str, *names: str) -> Catalog:
        """Natural layout: one table per predicate, columns by position."""
        for name in names:
            df = positional(self.spark.read.parquet(f"{folder}/{name}.parquet"))
            self.add(name, Source(lambda df=df: df, df.schema, origin=f"{folder}/{name}.parquet"))
        return self

    def tables(self, mapping: dict[str, str] | None = None, discover: bool = True) -> Catalog:
        """Natural layout over the session's tables and views, by mapping or discovered."""
        names = dict(mapping or {})
        if discover:
            names |= {t.name: t.name for t in self.spark.catalog.listTables() if t.name not in names}
        for pred, table in names.items():
            if not any(k[0] == pred for k in self.sources):
                self.add(pred, frame_source(self.spark.table(table), origin=f"table {table}"))
        return self

    def find(self, key: Key) -> Source | None:
        if key not in self.sources:
            for ask in self.dynamic:
                if found := ask(key):
                    self.sources[key] = found
                    break
        if key not in self.sources and self.store is not None and (found := self.store.source(key)):
            self.sources[key] = found
        return self.sources.get(key)

    def schema(self, atom: Atom) -> T.StructType | None:
        if atom.version:
            df = self.versions.get((atom.key, atom.version))
            return df.schema if df is not None else None
        source = self.find(atom.key)
        return source.schema if source else None

    def frame(self, atom: Atom) -> DataFrame | None:
        if atom.version:
            return self.versions.get((atom.key, atom.version))
        source = self.find(atom.key)
        return source.frame() if source else None

    def domain(self, kind: T.DataType, cap: int | None = None) -> DataFrame:
        """Distinct values of one type in all positions of all sources: the active domain, column d."""
        out = None
        for source in list(self.sources.values()):
            if source.load is None:
                continue
            df = source.frame()
            for f in source.schema.fields:
                if common(f.dataType, kind).simpleString() == kind.simpleString():
                    part = df.select(F.col(f.name).cast(kind).alias("d") if f.dataType != kind else F.col(f.name).alias("d"))
                    out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField("d", kind)]))
        return out.where("d IS NOT NULL").distinct()

    # writing
    def insert(self, key: Key, df: DataFrame) -> None:
        """Add rows that are not there yet; the sink is the predicate's own source or a new frame."""
        df = positional(df).distinct() if key[1] else df.limit(1)
        source = self.find(key)
        if source is None and self.store is not None and key[1]:
            self.store.add(key, df)
            return
        if source is None:
            if not self.default_sink:
                raise KeyError(f"{key[0]}/{key[1]} has no sink")
            self.sources[key] = Source(lambda: df, df.schema, writable=True)
            return
        if not source.writable:
            raise TypeError(f"{key[0]}/{key[1]} is read-only")
        if not key[1]:
            return
        if source.write:
            source.write(df)
            return
        old, new = align(source.frame(), df)
        both = old.unionByName(new).distinct()
        self.sources[key] = Source(lambda: both, both.schema, writable=True)

    def remove(self, key: Key, df: DataFrame) -> None:
        source = self.find(key)
        if source is None:
            return
        if not source.writable:
            raise TypeError(f"{key[0]}/{key[1]} is read-only")
        rest = without(source.frame(), df)
        self.sources[key] = Source(lambda: rest, rest.schema, writable=True)

    def hide(self, key: Key, df: DataFrame) -> None:
        """Virtual delete: the rows vanish from reads, the source itself stays."""
        source = self.sources[key]
        load = source.load
        self.sources[key] = Source(lambda: without(load(), df), source.schema, origin=source.origin)

    def accepts(self, atom: Atom) -> str | None:
        """Why an atom cannot be written, None if it can."""
        source = self.find(atom.key)
        if source is None:
            other = sorted(k[1] for k in self.sources if k[0] == atom.pred)
            if other:
                return f"{atom.pred} has arity {other[0]}"
            return None if self.default_sink else f"{atom.pred}/{len(atom.terms)} is not mapped"
        if not source.writable:
            return f"{atom.pred}/{len(atom.terms)} is read-only"
        return next((f"{t} is a variable" for t in atom.terms if isinstance(t, Var)), None)

    def copy(self) -> Catalog:
        return Catalog(self.spark, dict(self.sources), dict(self.functions), dict(self.versions), list(self.dynamic), self.default_sink, dict(self.aliases), self.store)

    def count(self) -> int:
        return sum(s.frame().count() for s in self.sources.values() if s.load)


def align(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with the positions' common types."""
    from lodestone.plans.encoding import convert

    kinds = [common(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema, strict=True)]
    cast = lambda df: df.select(*(convert(F.col(f.name), f.dataType, k).alias(f"c{i}") for i, (f, k) in enumerate(zip(df.schema, kinds, strict=True))))
    return cast(a), cast(b)


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of df that are not in gone."""
    if not df.columns:
        return df.join(gone.limit(1), F.lit(True), "left_anti")
    left, right = align(df, positional(gone))
    left, right = left.alias("l"), right.alias("r")
    on = [F.col(f"l.c{i}").eqNullSafe(F.col(f"r.c{i}")) for i in range(len(df.columns))]
    return left.join(right, on, "left_anti")
