"""Forward chaining: semi-naive saturation of predicates as DataFrames.

Every round runs one plan per head predicate and writes the new rows to the shared
folder.  A predicate is the union of its written parts; parts of like size are merged into one (as in a
log-structured store), so there are logarithmically many and plans stay short however many rounds there
are.  A body that several rules share is planned and run once.  Labelled nulls are deterministic: hashes of the
rule, the variable and the values that the chosen renamer keys them by.

Semi-naive triggers are anchored on one atom's new rows; the derived atoms before it read all rows and those behind
it the old ones, so no trigger is found twice.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import standard
from lodestone.functions.standard import Arg, FunctionError
from lodestone.operators.ruleset import dependencies, negative_atoms, positive_atoms, split, strata, weakly_acyclic
from lodestone.plans.compiler import Compiler, Rel, UnsafeNegationWarning, column_name
from lodestone.plans.encoding import PlanError, literal_column, term_struct, to_term
from lodestone.runtime import saved
from lodestone.sources.catalog import Catalog, Key, Source, align, without
from lodestone.syntax import And, Atom, Constraint, Exists, Not, Query, Rule, conjuncts, dnf, free, normal
from lodestone.terms import Func, Term, Var, variables_of

COMPUTERS = ("semi_naive", "naive", "two_steps", "restricted")
CHECKERS = ("always_true", "oblivious", "semi_oblivious", "restricted", "equivalent", "so_restricted")
RENAMERS = ("fresh", "body", "frontier", "frontier_by_piece", "body_true", "frontier_true", "frontier_by_piece_true")
SCHEDULERS = ("naive", "by_predicate", "grd")
APPLIERS = ("parallel", "breadth_first", "multi_thread", "source_delegated")


class MayNotTerminate(PlanError):
    """The rules are not weakly acyclic and no limit is given."""


@dataclass(frozen=True)
class Options:
    computer: str = "semi_naive"
    checker: str = "semi_oblivious"
    renamer: str = "frontier"
    scheduler: str = "by_predicate"
    applier: str = "parallel"
    stratification: str = "minimal_evaluation"
    split_rules: bool = True
    #: Compute the core of the nulls: "none", "end" or "step".
    core: str = "none"
    max_steps: int | None = None
    max_atoms: int | None = None
    timeout: float | None = None
    stop: threading.Event | None = None
    #: Predicates to keep at the end; None keeps all.
    keep: frozenset[str] | None = None
    lineage: bool = False
    debug: Callable[[str], None] | None = None
    #: Disjunctive heads assert every disjunct instead of being refused.
    all_disjuncts: bool = False
    #: Run although the rules may not terminate.
    unchecked: bool = False

    def __post_init__(self) -> None:
        for name, allowed in (("computer", COMPUTERS), ("checker", CHECKERS), ("renamer", RENAMERS), ("scheduler", SCHEDULERS), ("applier", APPLIERS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")


@dataclass
class Result:
    catalog: Catalog
    steps: int = 0
    created: dict[Key, int] = field(default_factory=dict)
    stopped: str = "no new facts"
    derivations: DataFrame | None = None
    applied: list[list[str]] = field(default_factory=list)
    #: Rules of each stratum, and the options that are not the usual ones.
    strata: list[list[str]] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    #: The rules as they were run, and the predicates that were dropped at the end of a stratum.
    rules: list[Rule] = field(default_factory=list)
    forgotten: set[Key] = field(default_factory=set)

    def frame(self, name: str, arity: int) -> DataFrame:
        """Rows of a predicate; a head predicate for which no rule has made a fact is empty."""
        key = name, arity
        source = self.catalog.find(key)
        if source is not None:
            return source.frame()
        if key in self.forgotten or not any(a.key == key for r in self.rules for a in r.head_atoms):
            raise KeyError(f"{name}/{arity}")
        return self.catalog.spark.createDataFrame([], _empty_heads(self.catalog, self.rules)[key])

    def describe(self) -> dict:
        return {"steps": self.steps, "stopped": self.stopped, "created": {f"{k[0]}/{k[1]}": n for k, n in self.created.items()}, "applied": self.applied, "strata": self.strata, "options": self.settings}

    def describe_json(self) -> str:
        return json.dumps(self.describe(), indent=1, default=str)


def _json(cols: list[Column]) -> Column:
    return F.to_json(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(cols)))) if cols else F.lit("{}")


class _Round:
    """State of a saturation: written deltas of each predicate."""

    def __init__(self, catalog: Catalog, options: Options, names: dict[int, str]):
        self.catalog, self.options, self.names = catalog, options, names
        self.parts: dict[Key, list[DataFrame]] = {}
        #: Rows of each part; a predicate's first rows count as without bound.
        self.sizes: dict[Key, list[float]] = {}
        self.delta: dict[Key, DataFrame] = {}
        self.old: dict[Key, DataFrame] = {}
        self.derivations: list[DataFrame] = []
        #: Frontiers that a rule has fired for, where the renamer would tell their bodies apart.
        self.log: dict[int, DataFrame] = {}
        self.shared: dict[tuple, Rel] = {}
        self.begin()

    # plans
    def body(self, rule: Rule, extra: list, version_of: dict[int, str], wanted: set[Var]) -> Rel:
        parts, i = [], 0
        for p in self.flat(rule):
            if isinstance(p, Atom):
                parts.append(replace(p, version=version_of.get(i, "")))
                i += 1
            else:
                parts.append(p)
        return Compiler(self.catalog).conjunction([*parts, *extra], Rel(None), wanted)

    @staticmethod
    def flat(rule: Rule) -> list:
        out: list = []
        work = conjuncts(normal(rule.body))
        while work:
            p = work.pop(0)
            work = [*conjuncts(p.part), *work] if isinstance(p, Exists) else work
            if not isinstance(p, Exists):
                out.append(p)
        return out

    def by_body(self) -> bool:
        """Whether nulls are told apart by the whole body's values."""
        return self.options.renamer in ("body", "body_true", "fresh")

    def wanted(self, rule: Rule) -> set[Var]:
        """Body variables that heads, nulls or lineage need."""
        every = rule.existentials and self.by_body() or self.options.lineage
        return set(rule.frontier) | (set(free(rule.body)) if every else set())

    def triggers(self, rule: Rule, number: int, first: bool, layer: list[Rule]) -> list[Rel]:
        o = self.options
        extra: list = []
        if o.computer == "restricted" or o.checker in ("restricted", "equivalent", "so_restricted"):
            if rule.existentials:
                extra = [Not(Exists(tuple(rule.existentials), And(rule.head_atoms)))]
        atoms = [p for p in self.flat(rule) if isinstance(p, Atom)]
        if first or o.computer in ("naive", "restricted") or not atoms:
            versions = [{}] if first or atoms or o.computer != "semi_naive" else []
        else:
            versions = []
            for i, a in enumerate(atoms):
                if a.key in self.delta:
                    late = {j: "old" for j in range(i + 1, len(atoms)) if atoms[j].key in self.old} if o.computer == "semi_naive" else {}
                    versions.append({i: "delta"} | late)
        sharers = [r for r in layer if r.body == rule.body] if not extra else []
        if len(sharers) < 2:
            rels = [self.body(rule, extra, v, self.wanted(rule)) for v in versions]
        else:
            rels = [self.common(rule, sharers, v) for v in versions]
        return [self.unfired(rule, number, rel) for rel in rels]

    def common(self, rule: Rule, sharers: list[Rule], version: dict[int, str]) -> Rel:
        """The triggers of a body that several rules of the layer share: planned and written once a round."""
        key = (rule.body, tuple(sorted(version.items())))
        if key not in self.shared:
            rel = self.body(rule, [], version, set().union(*(self.wanted(r) for r in sharers)))
            self.shared[key] = Rel(saved(rel.df, "triggers"), rel.vars) if rel.df is not None and rel.vars else rel
        return self.shared[key]

    def unfired(self, rule: Rule, number: int, rel: Rel) -> Rel:
        """Once for each frontier under the semi-oblivious checkers, whatever the renamer keys nulls by."""
        keyed = rule.existentials and self.by_body() and self.options.checker in ("semi_oblivious", "so_restricted")
        frontier = [v for v in rel.vars if v in rule.frontier]
        if not keyed or rel.df is None or len(frontier) == len(rel.vars):
            return rel
        names, rest = [column_name(v) for v in frontier], [column_name(v) for v in rel.vars if v not in frontier]
        one = rel.df.groupBy(*names).agg(F.min(F.struct(*rest)).alias("own")).select(*names, *(F.col(f"own.{c}").alias(c) for c in rest))
        if number in self.log:
            past = self.log[number].alias("past")
            on = [one[c].eqNullSafe(F.col(f"past.{c}")) for c in names]
            one = one.join(past, on, "left_anti") if names else one.limit(0)
        one = saved(one, "triggers")
        fired = one.select(*names) if names else one.limit(1)
        self.log[number] = fired if number not in self.log else self.log[number].unionByName(fired)
        return Rel(one, [*frontier, *(v for v in rel.vars if v not in frontier)])

    def heads(self, rule: Rule, rel: Rel, number: int, step: int) -> list[tuple[Key, DataFrame]]:
        """Head rows of the triggers, computed head terms without value dropped."""
        o, out = self.options, []
        name = self.names[number]
        df = rel.df if rel.df is not None else self.catalog.spark.range(1).select(F.lit(True).alias("v_unit"))
        rel = Rel(df, rel.vars)
        nulls = {e: self.null(rule, rel, e, name, step) for e in rule.existentials}
        for a in rule.head_atoms:
            if not a.terms:
                out.append((a.key, df.limit(1).select(F.lit(True).alias("c_any"))))
                continue
            columns = [self.head_term(t, rel, nulls) for t in a.terms]
            made = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), *([self.body_rows(rule, rel).alias("body")] if o.lineage else []))
            for i, t in enumerate(a.terms):
                if isinstance(t, Func):
                    made = made.where(F.col(f"c{i}").isNotNull())
            if o.lineage:
                facts = made.select(_fact(a.pred, [F.col(f"c{i}") for i in range(len(a.terms))]).alias("head"), F.lit(name).alias("rule"), F.explode_outer("body").alias("body"), F.lit(step).alias("step"))
                self.derivations.append(saved(facts.distinct(), "lineage"))
                made = made.drop("body")
            out.append((a.key, made))
        return out

    def body_rows(self, rule: Rule, rel: Rel) -> Column:
        atoms = [p for p in self.flat(rule) if isinstance(p, Atom)]
        value = lambda t: rel.col(t) if isinstance(t, Var) else literal_column(t)[0]
        return F.array(*(_fact(a.pred, [value(t) for t in a.terms]) for a in atoms))

    def null(self, rule: Rule, rel: Rel, e: Var, name: str, step: int) -> Column:
        o = self.options
        kind = o.renamer.removesuffix("_true")
        if kind in ("body", "fresh"):
            keys = [v for v in sorted(free(rule.body), key=lambda v: v.name) if v in rel.vars]
        elif kind == "frontier_by_piece":
            from lodestone.operators.ruleset import pieces

            piece = next(p for p in pieces(rule.head_atoms, set(rule.existentials)) if any(e in a.terms for a in p))
            keys = sorted({v for a in piece for t in a.terms for v in variables_of(t)} & set(rule.frontier), key=lambda v: v.name)
        else:
            keys = sorted(rule.frontier, key=lambda v: v.name)
        columns = [to_term(rel.col(v), rel.type(v)) for v in keys]
        tag = f"{name}|{e.name}" + (f"|{step}" if kind == "fresh" and o.checker == "always_true" else "")
        if o.renamer.endswith("_true"):
            return term_struct("f", F.concat(F.lit(f"sk_{kind}_{name}_{e.name}("), _json(columns), F.lit(")")))
        return term_struct("n", F.concat(F.lit(tag + "|"), F.sha2(_json(columns), 256)))

    def head_term(self, t: Term, rel: Rel, nulls: dict[Var, Column]) -> Column:
        if isinstance(t, Var):
            return nulls[t] if t in nulls else rel.col(t)
        if isinstance(t, Func) and t.evaluable:
            return self.function(t, rel).col
        return literal_column(t)[0]

    def function(self, t: Func, rel: Rel) -> Arg:
        args = []
        for x in t.args:
            if isinstance(x, Func) and x.evaluable:
                args.append(self.function(x, rel))
            else:
                args.append(Arg(rel.col(x), rel.type(x)) if isinstance(x, Var) else Arg(*literal_column(x)))
        user = self.catalog.functions.get(t.name)
        try:
            value = user.column([a.col for a in args]) if user else standard.evaluate(t.name.rpartition(":")[2], args)
        except FunctionError:
            value = F.lit(None).cast("string")
        base = rel.df if rel.df is not None else self.catalog.spark.range(1)
        return Arg(value, base.select(value.alias("x")).schema["x"].dataType)

    # storage
    def store(self, key: Key, candidates: list[DataFrame]) -> int:
        """Write the rows that are new; their number."""
        made = candidates[0]
        for df in candidates[1:]:
            a, b = align(made, df) if key[1] else (made, df)
            made = a.unionByName(b)
        source = self.catalog.find(key)
        if not key[1]:
            if source is not None or made.isEmpty():
                return 0
            self.catalog.sources[key] = Source(lambda: made.limit(1), made.schema, writable=True)
            return 1
        # positions without any type are of empty plans
        made = made.select(*(F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "void" else F.col(f.name) for f in made.schema.fields)).distinct()
        if source is not None:
            made = without(made, source.frame())
        new = saved(made, f"delta-{re.sub(r'[^A-Za-z0-9]', '_', key[0])}")
        n = new.count()
        if n:
            if source is not None:
                self.old_rows[key] = source.frame()
            self.fresh[key] = new
            parts, sizes = self.parts.setdefault(key, []), self.sizes.setdefault(key, [])
            if not parts and source is not None:
                parts.append(source.frame())
                sizes.append(float("inf"))
            parts.append(new)
            sizes.append(n)
            merged = len(parts)
            while merged > 1 and 2 * sum(sizes[merged - 1 :]) >= sizes[merged - 2]:
                merged -= 1
            if merged < len(parts):
                parts[merged - 1 :] = [saved(_union(parts[merged - 1 :]), "merged")]
                sizes[merged - 1 :] = [sum(sizes[merged - 1 :])]
        return n

    def publish(self) -> None:
        """Make this round's rows readable: all of them, as the delta, and those that were there before."""
        for key in self.fresh:
            whole = _union(self.parts[key])
            self.catalog.sources[key] = Source(lambda df=whole: df, whole.schema, writable=True)
        self.delta = dict(self.fresh)
        self.old = {k: self.old_rows[k] if k in self.old_rows else df.limit(0) for k, df in self.delta.items()}
        self.catalog.versions = {(k, "delta"): df for k, df in self.delta.items()} | {(k, "old"): df for k, df in self.old.items()}
        self.shared = {}

    def begin(self) -> None:
        self.fresh, self.old_rows = {}, {}



def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        a, b = align(whole, part)
        whole = a.unionByName(b)
    return whole


def _empty_heads(catalog: Catalog, rules: list[Rule]) -> dict[Key, T.StructType]:
    """Schemas of the head predicates without facts, by their rules' plans over empty tables; what no plan types is a string."""
    spark, missing = catalog.spark, {a.key for r in rules for a in r.head_atoms if catalog.find(a.key) is None}
    blank = lambda schema: Source(lambda: spark.createDataFrame([], schema), schema)
    plans = catalog.copy()
    plans.versions, plans.sources = {}, {k: blank(s.schema) for k, s in catalog.sources.items()}
    state = _Round(plans, Options(), {i: r.label or "" for i, r in enumerate(rules)})
    found: dict[Key, T.StructType] = {}
    for _ in range(len(missing) + 1):  # a body may read predicates that are empty too
        made: dict[Key, DataFrame] = {}
        for i, r in enumerate(rules):
            if any(a.key in missing for a in r.head_atoms):
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", UnsafeNegationWarning)  # the chase has warned
                    rel = state.body(r, [], {}, set(free(r.body)))
                for key, df in state.heads(r, rel, i, 0):
                    made[key] = align(made[key], df)[0] if key in made and key[1] else df
        before, found = found, {k: df.schema for k, df in made.items() if k in missing}
        if found == before:
            break
        plans.sources |= {k: blank(schema) for k, schema in found.items()}
    text = lambda f: T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType)
    return {k: T.StructType([text(f) for f in schema]) for k, schema in found.items()}


def _fact(pred: str, columns: list[Column]) -> Column:
    return F.concat(F.lit(f"{pred}("), F.concat_ws(", ", *(F.to_json(F.struct(c.alias("v"))) for c in columns)), F.lit(")"))


def _prepared(rules: Iterable[Rule], o: Options) -> list[Rule]:
    out = []
    for i, r in enumerate(rules):
        r = replace(r, label=r.label or f"r{i}")
        if len(r.head) > 1:
            if not o.all_disjuncts:
                raise PlanError(f"{r}: a disjunctive head can be rewritten, not chased")
            r = replace(r, head=(r.head_atoms,))
        if o.split_rules:
            out += split(r)
        else:
            out += [replace(r, body=b[0] if len(b) == 1 else And(tuple(b))) for b in dnf(normal(r.body))]
    return out


def _layers(rules: list[Rule], o: Options) -> list[list[Rule]]:
    if o.stratification == "none" and not any(negative_atoms(r.body) for r in rules):
        return [rules]
    found = strata(dependencies(rules, "predicate"), o.stratification if o.stratification != "none" else "minimal_evaluation")
    if found is None:
        raise PlanError("a cycle runs through negation, or the chosen strata do not exist")
    return found


def chase(catalog: Catalog, rules: Iterable[Rule], options: Options | None = None, layers: list[list[Rule]] | None = None, changed: dict[Key, DataFrame] | None = None) -> Result:
    """Saturate the catalog under the rules; the given catalog stays as it is.

    With `changed`, rows that the catalog holds but that no saturation has seen yet, only their
    consequences are computed; that needs rules without negation.
    """
    o = options or Options()
    rules = list(rules)
    prepared = _prepared(rules, o)
    limited = o.max_steps is not None or o.max_atoms is not None or o.timeout is not None or o.stop is not None
    if not (limited or o.unchecked) and not weakly_acyclic(prepared):
        raise MayNotTerminate("the rules are not weakly acyclic: give a limit, or unchecked=True")
    catalog = catalog.copy()
    result = Result(catalog)
    began = time.monotonic()
    total = catalog.count() if o.max_atoms is not None else 0
    if changed is not None:
        if any(negative_atoms(r.body) for r in prepared):
            raise PlanError("new rows can take back what negation derived: saturate from the start")
        layers = [rules]
    strata_ = [_prepared(layer, o) for layer in layers] if layers is not None else _layers(prepared, o)
    lineage: list[DataFrame] = []
    result.strata = [[r.label or "" for r in layer] for layer in strata_]
    result.rules = [r for layer in strata_ for r in layer]
    result.settings = {f.name: getattr(o, f.name) for f in fields(o) if getattr(o, f.name) != f.default}
    for depth, layer in enumerate(strata_):
        names = {i: f"{r.label}.{depth}.{i}" for i, r in enumerate(layer)}
        state = _Round(catalog, o, names)
        graph = dependencies(layer, "unifier") if o.scheduler == "grd" else None
        last: set[int] | None = None
        step = 0
        if changed is not None:
            state.delta = dict(changed)
            state.old = {k: without(catalog.find(k).frame(), df) for k, df in changed.items()}
            catalog.versions = {(k, "delta"): df for k, df in changed.items()} | {(k, "old"): df for k, df in state.old.items()}
        while True:
            if o.max_steps is not None and result.steps >= o.max_steps:
                result.stopped = "step limit"
                break
            if o.max_atoms is not None and total >= o.max_atoms:
                result.stopped = "atom limit"
                break
            if o.timeout is not None and time.monotonic() - began > o.timeout:
                result.stopped = "timeout"
                break
            if o.stop is not None and o.stop.is_set():
                result.stopped = "interrupted"
                break
            due = _due(layer, o, last, graph, state)
            state.begin()
            if not due:
                result.stopped = "no rules to apply" if not layer else "no new facts"
                break
            fired: dict[Key, set[int]] = {}
            try:
                with _cancelled_by(o.stop, catalog):
                    counts = _apply(state, layer, due, step == 0 and changed is None, result.steps, fired)
            except Exception:
                if o.stop is None or not o.stop.is_set():
                    raise
                # the round's rows were not published: the catalog is that of the round before
                result.stopped = "interrupted"
                break
            result.steps += 1
            step += 1
            state.publish()
            for key, n in counts.items():
                result.created[key] = result.created.get(key, 0) + n
                total += n
            last = {i for key, n in counts.items() if n for i in fired[key]}
            result.applied.append(sorted({layer[i].label or "" for i in last}))
            if o.debug:
                o.debug(f"step {result.steps}: " + ", ".join(f"{k[0]}/{k[1]} +{n}" for k, n in counts.items() if n))
            if o.core == "step" or o.checker == "equivalent" and any(layer[i].existentials for i in last):
                _core(catalog)
            if not last:
                result.stopped = "no new facts"
                break
        catalog.versions = {}
        lineage += state.derivations
        if result.stopped not in ("no new facts", "no rules to apply"):
            break
        if o.keep is not None:
            result.forgotten |= _forget(catalog, strata_[depth + 1 :], o.keep, {a.key for r in prepared for a in r.head_atoms})
    if o.core == "end":
        _core(catalog)
    if lineage:
        every = lineage[0]
        for df in lineage[1:]:
            every = every.unionByName(df)
        result.derivations = every
    return result


def _apply(state: _Round, layer: list[Rule], due: list[int], first: bool, step: int, fired: dict[Key, set[int]]) -> dict[Key, int]:
    """One round: the number of new rows of each head predicate."""
    made: dict[Key, list[DataFrame]] = {}
    for i in due:
        for rel in state.triggers(layer[i], i, first, layer):
            for key, df in state.heads(layer[i], rel, i, step):
                made.setdefault(key, []).append(df)
                fired.setdefault(key, set()).add(i)
    if state.options.applier == "multi_thread" and len(made) > 1:
        with ThreadPoolExecutor(min(32, len(made))) as pool:
            return dict(zip(made, pool.map(inheritable_thread_target(state.catalog.spark)(lambda k: state.store(k, made[k])), made), strict=True))
    return {key: state.store(key, dfs) for key, dfs in made.items()}


@contextmanager
def _cancelled_by(stop: threading.Event | None, catalog: Catalog) -> Iterator[None]:
    """Cancels the running jobs of this thread once the event is set."""
    if stop is None:
        yield
        return
    context = catalog.spark.sparkContext
    group, done = f"lodestone-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not done.wait(0.1):
            if stop.is_set():
                context.cancelJobGroup(group)

    thread = threading.Thread(target=watch, daemon=True)
    context.setJobGroup(group, "chase", interruptOnCancel=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)


def _core(catalog: Catalog) -> None:
    from lodestone.operators.cores import fold_catalog

    fold_catalog(catalog)


def _forget(catalog: Catalog, later: list[list[Rule]], keep: frozenset[str], derived: set[Key]) -> set[Key]:
    """Drop derived predicates that no later layer reads and nobody wants; their keys."""
    needed = {a.key for layer in later for r in layer for a in (*positive_atoms(r.body), *negative_atoms(r.body), *r.head_atoms)}
    gone = {key for key in derived - needed if key[0] not in keep}
    for key in gone:
        catalog.sources.pop(key, None)
    return gone


def _due(layer: list[Rule], o: Options, last: set[int] | None, graph, state: _Round) -> list[int]:
    """Rules that may have new triggers."""
    if last is None:
        return list(range(len(layer)))
    if not last:
        return []
    if o.scheduler == "naive" and o.computer != "semi_naive":
        return list(range(len(layer)))
    if o.scheduler == "grd":
        return sorted({j for i in last for j in graph.positive[i]})
    changed = set(state.delta)
    return [i for i, r in enumerate(layer) if any(a.key in changed for a in positive_atoms(r.body))]


def violations(catalog: Catalog, constraints: Iterable[Constraint]) -> list[tuple[Constraint, bool]]:
    """Each constraint and whether its body holds."""
    out = []
    for c in constraints:
        row = Compiler(catalog).query(Query((), c.body, c.label)).first()
        out.append((c, bool(row[0])))
    return out


def fact_text(pred: str, values: Iterable) -> Column:
    """The lineage name of a fact with the given columns or Python values."""
    return _fact(pred, [v if isinstance(v, Column) else F.lit(v) for v in values])


def ancestors(result: Result | Iterable[Result], facts: DataFrame, prime: bool = False) -> DataFrame:
    """(fact, ancestor) for the facts in column `fact`; prime keeps only ancestors that nothing derives.

    Of several results, as of federated sources saturated apart, the derivations are followed together.
    """
    known = [r.derivations for r in ([result] if isinstance(result, Result) else result)]
    if not known or any(d is None for d in known):
        raise PlanError("the chase kept no lineage")
    edges = _union([d.where("body IS NOT NULL").select("head", "body") for d in known]).toDF("head", "body").distinct()
    reach = saved(facts.select(F.col("fact").cast("string")).distinct().join(edges, F.col("fact") == F.col("head")).select("fact", F.col("body").alias("ancestor")).distinct(), "ancestors")
    front = reach
    while True:
        more = front.join(edges, F.col("ancestor") == F.col("head")).select("fact", F.col("body").alias("ancestor")).distinct()
        front = saved(more.join(reach, ["fact", "ancestor"], "left_anti"), "ancestors")
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    return reach.join(edges.select(F.col("head").alias("ancestor")).distinct(), "ancestor", "left_anti").select("fact", "ancestor") if prime else reach


def certain(df: DataFrame) -> DataFrame:
    """Answers without labelled nulls."""
    from lodestone.plans.encoding import is_term

    for f in df.schema.fields:
        if is_term(f.dataType):
            df = df.where(~F.col(f"`{f.name}`.k").isin("n", "f"))
    return df


__all__ = ["MayNotTerminate", "Options", "Result", "ancestors", "certain", "chase", "fact_text", "violations"]
