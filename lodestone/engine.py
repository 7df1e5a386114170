"""The session facade: parse, evaluate, saturate, rewrite."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.config import Providers, Registry
from lodestone.functions.python import PythonFunction, load_computed, register_all
from lodestone.operators import chase as chasing
from lodestone.operators.homomorphism import CQ
from lodestone.operators.rewriting import union_query
from lodestone.operators.ruleset import Compiled, analyse, compile_rules
from lodestone.operators.union import UnionQuery
from lodestone.parser import Document, parse
from lodestone.plans.compiler import Compiler, upper_bound
from lodestone.plans.encoding import PlanError
from lodestone.runtime import drop_saved, saved_so_far
from lodestone.sources import files, views
from lodestone.sources.catalog import Catalog
from lodestone.syntax import Query


@dataclass(frozen=True)
class CleanupStats:
    """What closing an engine has removed."""

    sources: int
    rules: int
    constraints: int
    queries: int
    tables: int


class Engine:
    """A catalog, its rules and constraints, and what can be asked of them."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, providers: Providers | None = None):
        self.spark = spark
        self.providers = providers or Providers()
        self.catalog = catalog or self.providers.catalog(spark)
        #: Answers by the query's class; a caller's own classes can be registered.
        self.evaluators = Registry()
        self.evaluators.register(str, lambda q, *rest: self.evaluators(self.parse_query(q), *rest))
        self.evaluators.register(Query, lambda q, names, bindings: Compiler(self.catalog).query(q, names, bindings))
        self.evaluators.register(CQ, lambda q, names, bindings: self.evaluators(q.query(), names, bindings))
        self.evaluators.register(UnionQuery, lambda q, names, bindings: self.evaluators(q.query(), names or [v.name for v in q.members[0].answers] or None, bindings))
        self.rules: list = []
        self.constraints: list = []
        self.queries: list[Query] = []
        self.since = saved_so_far()

    @classmethod
    def over(cls, spark: SparkSession, folder: str, *tables: str) -> Engine:
        """An engine over a folder of parquet tables, one predicate each."""
        return cls(spark, Catalog(spark).parquet(folder, *tables))

    # input
    def load(self, text: str) -> Document:
        """Parse a text and take in its facts, rules, queries and constraints."""
        return self.take(self.providers.parser(text))

    def load_file(self, path: str) -> Document:
        """A document with its imports, computed functions and views; other formats by their parser."""
        last = Document()
        for file in files.resolve_imports(str(path)):
            kind = files.detect_format(file)
            if kind == "dlgpe":
                last = self.take(self.providers.parser(Path(file).read_text(encoding="utf-8")), str(Path(file).parent))
            elif kind == "views":
                views.add_views(self.catalog, views.read_document(Path(file).read_text(encoding="utf-8"), str(Path(file).parent)), str(Path(file).parent))
            else:
                self._read_as(kind, file)
        return last

    def _read_as(self, kind: str, file: str) -> None:
        io = self.providers.io
        if kind == "csv":
            files.add_csv(self.catalog, file, options=io.csv)
        elif kind == "rls":
            files.add_manifest(self.catalog, file, io.manifest)
        elif kind == "rdf":
            files.add_rdf(self.catalog, files.read_rdf(self.spark, file), io.rdf_mode)
        else:
            files.parser(kind)(self.catalog, file)

    def take(self, doc: Document, base: str = ".") -> Document:
        if doc.una or doc.top:
            warnings.warn("@una and @top are recorded only", stacklevel=2)
        for prefix, target in doc.computed.items():
            if target not in ("stdfct", "stdfct:"):
                register_all(self.catalog.functions, load_computed(Path(base) / target, prefix))
        for prefix, target in doc.views.items():
            path = Path(base) / target
            views.add_views(self.catalog, views.read_document(path.read_text(encoding="utf-8"), str(path.parent)), str(path.parent), prefix)
        self.catalog.add_facts(doc.facts)
        self.rules += doc.rules
        self.constraints += doc.constraints
        self.queries += doc.queries
        return doc

    def function(self, name: str, f: Callable, **options) -> PythonFunction:
        """Register a Python function as computed predicate `name`, which has a prefix."""
        if ":" not in name:
            raise PlanError("a computed predicate has a prefix")
        made = PythonFunction(name, f, **options)
        register_all(self.catalog.functions, {name: made})
        return made

    def parse_query(self, text: str) -> Query:
        """A query whose computed prefixes are those of the registered functions."""
        prefixes = {n.split(":")[0] for n in self.catalog.functions}
        head = "".join(f"@computed {p}: <registered>.\n" for p in sorted(prefixes))
        return parse(head + text).queries[0]

    # output
    def ask(self, query: Query | UnionQuery | str, names: list[str] | None = None, bindings: DataFrame | None = None) -> DataFrame:
        """Distinct answers, one column per answer variable."""
        return self.evaluators(query, names, bindings)

    def count(self, query: Query | UnionQuery | str) -> int:
        """How many answers there are; none of them leaves the executors."""
        return self.ask(query).count()

    def estimate(self, query: Query | str) -> int | None:
        """An upper bound of the number of answers from the sources' sizes; None if a source has no known size."""
        query = self.parse_query(query) if isinstance(query, str) else query
        return upper_bound(self.catalog, query.body)

    def prepare(self, query: Query | str, names: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
        """The query as a function of a bindings frame."""
        query = self.parse_query(query) if isinstance(query, str) else query
        return lambda bindings: Compiler(self.catalog).query(query, names, bindings)

    def chase(self, options: chasing.Options | None = None, **settings) -> chasing.Result:
        """Saturate a copy of the catalog under the engine's rules."""
        return chasing.chase(self.catalog, self.rules, options or chasing.Options(**settings))

    def saturated(self, **settings) -> Engine:
        """An engine over the saturated catalog."""
        out = Engine(self.spark, self.chase(**settings).catalog)
        out.constraints = list(self.constraints)
        return out

    def rewrite(self, query: Query | str, step_limit: int | None = None) -> list[CQ]:
        query = self.parse_query(query) if isinstance(query, str) else query
        return self.providers.rewriting(query, self.rules, step_limit)

    def ask_rewritten(self, query: Query | str, names: list[str] | None = None, step_limit: int | None = None) -> DataFrame:
        """Answers under the rules by rewriting: one plan over the stored facts."""
        query = self.parse_query(query) if isinstance(query, str) else query
        names = names or [v.name for v in query.answers] or None
        return Compiler(self.catalog).query(union_query(self.rewrite(query, step_limit)), names)

    def ask_compiled(self, query: Query | str, kind: str = "id", names: list[str] | None = None) -> DataFrame:
        """Answers under the compilable rules: every scan becomes the union of what entails it."""
        query = self.parse_query(query) if isinstance(query, str) else query
        compiled: Compiled = compile_rules(self.rules, kind)
        return Compiler(self.catalog).query(Query(query.answers, compiled.evaluate(query.body), query.label, query.bound), names)

    def violations(self) -> list:
        return [c for c, broken in chasing.violations(self.catalog, self.constraints) if broken]

    def properties(self, wanted: Iterable[str] | None = None) -> dict[str, bool]:
        return analyse(self.rules, wanted)

    def explain(self, query: Query | str) -> str:
        return self.ask(query)._jdf.queryExecution().toString()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *problem) -> None:
        self.close()

    def close(self) -> CleanupStats:
        """Forget all sources, rules and saved tables of this engine; what went."""
        stats = CleanupStats(len(self.catalog.sources), len(self.rules), len(self.constraints), len(self.queries), drop_saved(self.spark, self.since))
        self.catalog.sources.clear()
        self.catalog.versions.clear()
        for kept in (self.rules, self.constraints, self.queries):
            kept.clear()
        return stats
