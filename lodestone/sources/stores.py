"""Database stores: predicates as tables, read as sources and written without repetition.

A layout names the table of a predicate.  Three kinds of store share one interface: tables of the Spark
session, SQLite files (through a Python data source that reads ranges of row ids in parallel and pushes
equalities down), and JDBC databases.  Insertion leaves rows alone that are there already.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from lodestone.plans.encoding import PlanError, is_term
from lodestone.sources.catalog import Catalog, Key, Source, positional, without

#: Rows sent to a database in one statement batch.
BATCH = 10_000


# layouts
class Layout(Protocol):
    def table(self, key: Key) -> str: ...

    def key(self, table: str) -> Key | None: ...


class AdHocLayout:
    """p_<name>_<arity>, other characters than letters and digits as underscores; names that meet are refused."""

    def __init__(self) -> None:
        self.given: dict[str, Key] = {}

    def table(self, key: Key) -> str:
        name = f"p_{re.sub(r'[^A-Za-z0-9]', '_', key[0]).lower()}_{key[1]}"
        if self.given.setdefault(name, key) != key:
            raise PlanError(f"{key[0]}/{key[1]} and {self.given[name][0]}/{key[1]} have one table name")
        return name

    def key(self, table: str) -> Key | None:
        return self.given.get(table)


class EncodedLayout:
    """e_<hexadecimal UTF-8 of the name>_<arity>: one to one, also where identifiers ignore case."""

    def table(self, key: Key) -> str:
        return f"e_{key[0].encode().hex()}_{key[1]}"

    def key(self, table: str) -> Key | None:
        m = re.fullmatch(r"e_((?:[0-9a-f]{2})*)_(\d+)", table)
        return (bytes.fromhex(m[1]).decode(), int(m[2])) if m else None


@dataclass
class NaturalLayout:
    """A predicate is the table of its name, or of the name that the mapping gives."""

    mapping: dict[str, str] = field(default_factory=dict)

    def table(self, key: Key) -> str:
        return self.mapping.get(key[0], key[0])

    def key(self, table: str) -> Key | None:
        return None


LAYOUTS = {"adhoc": AdHocLayout, "encoded": EncodedLayout, "natural": NaturalLayout}


def insert_statement(dialect: str, table: str, columns: list[str], quote: str = '"') -> str:
    """An insertion that passes over rows that are there, in the dialect's words."""
    named = ", ".join(f"{quote}{c}{quote}" for c in columns)
    values = ", ".join("?" for _ in columns)
    into = {"sqlite": "INSERT OR IGNORE INTO", "mysql": "INSERT IGNORE INTO"}.get(dialect, "INSERT INTO")
    end = " ON CONFLICT DO NOTHING" if dialect == "postgresql" else ""
    return f"{into} {quote}{table}{quote} ({named}) VALUES ({values}){end}"


def _checked(key: Key, df: DataFrame) -> DataFrame:
    df = positional(df)
    if len(df.columns) != key[1]:
        raise PlanError(f"{key[0]} has arity {key[1]}, the rows have {len(df.columns)}")
    mixed = [f.name for f in df.schema.fields if is_term(f.dataType) or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if mixed:
        raise PlanError(f"{key[0]}/{key[1]}: {', '.join(mixed)} hold terms of several kinds, which tables do not keep")
    return df.distinct()


# Spark tables
@dataclass
class SparkStore:
    """Tables of the session's catalog."""

    spark: SparkSession
    layout: Layout
    database: str = "default"

    def name(self, key: Key) -> str:
        return f"`{self.database}`.`{self.layout.table(key)}`"

    def source(self, key: Key) -> Source | None:
        name = self.name(key)
        if not self.spark.catalog.tableExists(name):
            return None
        schema = positional(self.spark.table(name)).schema
        if len(schema) != key[1]:
            return None
        return Source(lambda: positional(self.spark.table(name)), schema, writable=True, origin=f"table {name}", write=lambda df: self.add(key, df))

    def add(self, key: Key, df: DataFrame) -> None:
        df, name = _checked(key, df), self.name(key)
        if not self.spark.catalog.tableExists(name):
            df.write.saveAsTable(name)
            return
        there = self.spark.table(name)
        new = without(df, positional(there)).toDF(*there.columns)
        new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in there.schema.fields)).write.insertInto(name)


# SQLite
_SQLITE_TYPES = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "BOOLEAN", "float": "REAL", "double": "REAL"}


def _spark_type(declared: str) -> T.DataType:
    declared = declared.upper()
    if "BOOL" in declared:
        return T.BooleanType()
    if "INT" in declared:
        return T.LongType()
    if any(x in declared for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in declared else T.StringType()


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def sqlite_schema(path: str, table: str) -> T.StructType | None:
    if not Path(path).exists():
        return None
    with _open(path) as db:
        found = db.execute(f'PRAGMA table_info("{table}")').fetchall()
    return T.StructType([T.StructField(c[1], _spark_type(c[2])) for c in found]) if found else None


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.fields, self.path, self.table = schema, options["path"], options["dbtable"]
        self.splits = int(options.get("numpartitions", 8))
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        """Equalities run inside the database."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.where.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[_Rows]:
        with _open(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.splits))
        return [_Rows(at, at + step) for at in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.fields.fields)
        extra = "".join(f' AND "{n}" = ?' for n, _ in self.where)
        flags = [isinstance(f.dataType, T.BooleanType) for f in self.fields.fields]
        with _open(self.path) as db:
            query = f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?{extra}'
            for row in db.execute(query, [partition.first, partition.last, *(v for _, v in self.where)]):
                yield tuple(bool(v) if flag and v is not None else v for v, flag in zip(row, flags, strict=True))


class SqliteTable(DataSource):
    """spark.read.format("lodestone_sqlite").option("path", file).option("dbtable", table)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_sqlite"

    def schema(self) -> T.StructType:
        return sqlite_schema(self.options["path"], self.options["dbtable"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


@dataclass
class SqliteStore:
    """Tables of a SQLite file, which executors that read it must share; one writer, as SQLite has it."""

    spark: SparkSession
    layout: Layout
    path: str

    def __post_init__(self) -> None:
        self.spark.dataSource.register(SqliteTable)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def source(self, key: Key) -> Source | None:
        table = self.layout.table(key)
        schema = sqlite_schema(self.path, table)
        if schema is None or len(schema) != key[1]:
            return None
        load = lambda: positional(self.spark.read.format("lodestone_sqlite").option("path", self.path).option("dbtable", table).load())
        fields = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
        return Source(load, fields, writable=True, origin=f"{self.path}:{table}", write=lambda df: self.add(key, df))

    def add(self, key: Key, df: DataFrame) -> None:
        """Rows go in batches through the driver to the file's one writer; a row that is there is passed over."""
        df, table = _checked(key, df), self.layout.table(key)
        known = sqlite_schema(self.path, table)
        columns = known.names if known else df.columns
        df = df.select(*(F.col(f.name) if f.dataType.simpleString() in _SQLITE_TYPES or isinstance(f.dataType, T.BinaryType) else F.col(f.name).cast("string") for f in df.schema.fields))
        with sqlite3.connect(self.path) as db:
            if not known:
                kinds = [_SQLITE_TYPES.get(f.dataType.simpleString(), "BLOB" if isinstance(f.dataType, T.BinaryType) else "TEXT") for f in df.schema.fields]
                named = ", ".join(f'"{c}" {k}' for c, k in zip(columns, kinds, strict=True))
                unique = ", ".join(f'"{c}"' for c in columns)
                db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({named}, UNIQUE ({unique}))')
            statement = insert_statement("sqlite", table, columns)
            rows = (tuple(r) for r in df.toLocalIterator(prefetchPartitions=True))
            while batch := list(islice(rows, BATCH)):
                db.executemany(statement, batch)
                db.commit()


# JDBC
@dataclass
class JdbcStore:
    """Tables of a database with a JDBC driver on the class path; options as views.jdbc_options gives them."""

    spark: SparkSession
    layout: Layout
    options: dict[str, str]

    def _reader(self, table: str):
        return self.spark.read.format("jdbc").options(**self.options, dbtable=table)

    def source(self, key: Key) -> Source | None:
        table = self.layout.table(key)
        try:
            schema = positional(self._reader(table).load()).schema
        except Exception as problem:  # a missing table is no source; anything else is the caller's
            if "not exist" in str(problem) or "not found" in str(problem):
                return None
            raise
        return Source(lambda: positional(self._reader(table).load()), schema, writable=True, origin=f"jdbc {table}", write=lambda df: self.add(key, df))

    def add(self, key: Key, df: DataFrame) -> None:
        df, source = _checked(key, df), self.source(key)
        new = df if source is None else without(df, source.frame()).toDF(*self._reader(self.layout.table(key)).load().columns)
        new.write.format("jdbc").options(**self.options, dbtable=self.layout.table(key)).mode("append").save()


class MemoryStore:
    """Facts as frames of the session."""

    def __init__(self, spark: SparkSession):
        self.catalog = Catalog(spark)

    def source(self, key: Key) -> Source | None:
        found = self.catalog.sources.get(key)
        return found and Source(lambda: self.catalog.sources[key].frame(), found.schema, writable=True, write=lambda df: self.add(key, df))

    def add(self, key: Key, df: DataFrame) -> None:
        self.catalog.insert(key, df)


class TripleStore:
    """Facts of arity 2 (and 1, as types) in one frame of triples, in memory."""

    def __init__(self, spark: SparkSession):
        self.spark, self.triples = spark, spark.createDataFrame([], "s string, p string, o string")

    def source(self, key: Key) -> Source | None:
        if key[1] not in (1, 2):
            return None
        columns = ["s", "o"][: key[1]]
        name = key[0] if key[1] == 2 else f"{key[0]}/1"
        load = lambda: positional(self.triples.where(F.col("p") == name).select(*columns))
        return Source(load, load().schema, writable=True, write=lambda df: self.add(key, df))

    def add(self, key: Key, df: DataFrame) -> None:
        if key[1] not in (1, 2):
            raise PlanError("a triple store has predicates of arity 1 and 2")
        df = _checked(key, df)
        name = key[0] if key[1] == 2 else f"{key[0]}/1"
        rows = df.select(F.col("c0").cast("string").alias("s"), F.lit(name).alias("p"), (F.col("c1").cast("string") if key[1] == 2 else F.lit("")).alias("o"))
        self.triples = self.triples.unionByName(rows).distinct()


class StorageBuilder:
    """Choose a store and its layout step by step; the encoded layout is the usual one."""

    def __init__(self) -> None:
        self._kind, self._given, self._layout = "memory", {}, None

    def _use(self, kind: str, **given) -> StorageBuilder:
        self._kind, self._given = kind, given
        return self

    def use_memory(self) -> StorageBuilder:
        return self._use("memory")

    def use_triples(self) -> StorageBuilder:
        return self._use("triples")

    def use_spark(self, database: str = "default") -> StorageBuilder:
        return self._use("spark", database=database)

    def use_sqlite(self, path: str) -> StorageBuilder:
        return self._use("sqlite", path=str(path))

    def use_jdbc(self, protocol: str, parameters: dict) -> StorageBuilder:
        from lodestone.sources.views import jdbc_options

        return self._use("jdbc", options=jdbc_options(protocol, parameters))

    def layout(self, layout: str | Layout) -> StorageBuilder:
        if isinstance(layout, str) and layout not in LAYOUTS:
            raise PlanError(f"layout is one of {', '.join(LAYOUTS)}")
        self._layout = LAYOUTS[layout]() if isinstance(layout, str) else layout
        return self

    def build(self, spark: SparkSession):
        if self._kind in ("memory", "triples"):
            if self._layout is not None:
                raise PlanError(f"a {self._kind} store has no layout")
            return MemoryStore(spark) if self._kind == "memory" else TripleStore(spark)
        kinds = {"spark": SparkStore, "sqlite": SqliteStore, "jdbc": JdbcStore}
        return kinds[self._kind](spark, self._layout or EncodedLayout(), **self._given)
