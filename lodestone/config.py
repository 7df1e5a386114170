"""What a session is made of: how it reads files, and the parts that a caller can put in its own place."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import SparkSession

from lodestone.operators.homomorphism import CQ
from lodestone.operators.rewriting import rewrite
from lodestone.parser import Document, parse
from lodestone.sources.catalog import Catalog
from lodestone.sources.files import CsvOptions
from lodestone.syntax import Query, Rule


@dataclass(frozen=True)
class IOConfig:
    """How files become facts."""

    rdf_mode: str = "natural_full"
    csv: CsvOptions = CsvOptions()
    #: Header rows of the files that a manifest names.
    manifest_header_rows: int = 0

    def with_rdf_mode(self, mode: str) -> IOConfig:
        return replace(self, rdf_mode=mode)

    def with_csv(self, **options) -> IOConfig:
        return replace(self, csv=replace(self.csv, **options))

    @property
    def manifest(self) -> CsvOptions:
        return replace(self.csv, header_rows=self.manifest_header_rows)


class ParserProvider(Protocol):
    def __call__(self, text: str) -> Document: ...


class CatalogProvider(Protocol):
    def __call__(self, spark: SparkSession) -> Catalog: ...


class RewritingProvider(Protocol):
    def __call__(self, query: Query, rules: Iterable[Rule], step_limit: int | None) -> list[CQ]: ...


@dataclass(frozen=True)
class Providers:
    """Parser, empty catalog and rewriting of an engine."""

    parser: ParserProvider = parse
    catalog: CatalogProvider = Catalog
    rewriting: RewritingProvider = rewrite
    io: IOConfig = field(default_factory=IOConfig)


@dataclass
class Registry:
    """Handlers by class; an object's own class first, then its bases in order."""

    handlers: dict[type, Callable] = field(default_factory=dict)

    def register(self, kind: type, handler: Callable | None = None):
        """Put a handler in; as a decorator without one."""
        if handler is None:
            return lambda f: self.register(kind, f)
        self.handlers[kind] = handler
        return handler

    def find(self, value: object) -> Callable | None:
        return next((self.handlers[c] for c in type(value).__mro__ if c in self.handlers), None)

    def __call__(self, value: object, *rest):
        handler = self.find(value)
        if handler is None:
            raise TypeError(f"nothing is registered for {type(value).__name__}")
        return handler(value, *rest)
