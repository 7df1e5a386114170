"""First-order formulas to DataFrames.

compile gives a relation whose columns are the free variables.  A conjunction is
planned greedily: comparisons, computed predicates and safe negations as soon as their
variables are bound, else the generator that shares the most variables, a cross
join only if nothing is connected.  Join strategies and orders inside stay with Catalyst.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import standard
from lodestone.functions.standard import Arg, FunctionError
from lodestone.plans.encoding import PlanError, common, compare, convert, is_term, literal_column, same
from lodestone.sources.catalog import Catalog
from lodestone.syntax import And, Apply, Atom, Cmp, Eq, Exists, Not, Or, Query, atoms_of, free, fresh, normal, substitute
from lodestone.terms import Func, Term, Var, is_ground, variables_of


class UnsafeNegationWarning(UserWarning):
    """A negated formula or quantifier ranges over the active domain."""


def column_name(v: Var) -> str:
    """A column of its own for every variable, although Spark ignores case."""
    flags = int("1" + "".join(str(int(c.isupper())) for c in v.name), 2)
    return f"v_{v.name.replace('#', 'anon')}_{flags:x}"


@dataclass
class Rel:
    """df is None for the relation with one empty row."""

    df: DataFrame | None
    vars: list[Var] = field(default_factory=list)

    def col(self, v: Var) -> Column:
        return F.col(column_name(v))

    def type(self, v: Var) -> T.DataType:
        return self.df.schema[column_name(v)].dataType

    def keep(self, wanted: list[Var]) -> Rel:
        kept = [v for v in self.vars if v in wanted]
        if self.df is None or kept == self.vars:
            return self
        if not kept:
            return Rel(self.df.limit(1).select(F.lit(True).alias("v_unit")), [])
        return Rel(self.df.select(*(self.col(v) for v in kept)), kept)


class Compiler:
    def __init__(self, catalog: Catalog, domain_cap: int | None = None):
        self.catalog, self.spark, self.domain_cap = catalog, catalog.spark, domain_cap
        self._used: set[Var] = set()
        #: Anonymous variables under their new names: a NULL there hides no row.
        self._anonymous: set[Var] = set()

    # entry
    def query(self, query: Query, names: list[str] | None = None, bindings: DataFrame | None = None, distinct: bool = True) -> DataFrame:
        """Answers of a query; a boolean query gives one row with column ok.

        `bindings` has a column per pre-bound variable, by name.
        """
        fixed = dict(query.bound)
        body = normal(substitute(query.body, fixed))
        start = Rel(None)
        if bindings is not None:
            given = [Var(c) for c in bindings.columns]
            start = Rel(bindings.distinct().toDF(*(column_name(v) for v in given)), given)
        rel = self.conjunction([body], start, set(query.answers))
        if not query.answers:
            df = self.spark.range(1).select(F.lit(True).alias("x")) if rel.df is None else rel.df
            return df.limit(1).agg((F.count(F.lit(1)) > 0).alias((names or ["ok"])[0]))
        names = names or _distinct_names([v.name for v in query.answers])
        if len(names) != len(query.answers):
            raise PlanError("one name for each answer variable is needed")
        rel = self.expand(rel, [v for v in query.answers if v not in fixed], body)
        df = rel.df if rel.df is not None else self.spark.range(1).select(F.lit(True).alias("v_unit"))
        columns = [(literal_column(fixed[v])[0] if v in fixed else rel.col(v)).alias(n) for v, n in zip(query.answers, names, strict=True)]
        out = df.select(*columns)
        return out.distinct() if distinct else out

    def formula(self, f) -> Rel:
        return self.conjunction([normal(f)], Rel(None), set(free(f)))

    def anonymous(self, v: Var) -> bool:
        return v.name.startswith("_#") or v in self._anonymous

    # conjunctions
    def conjunction(self, parts: list, rel: Rel, wanted: set[Var]) -> Rel:
        self._used |= {v for p in parts for v in free(p)} | set(rel.vars)
        flat, merged = self.prepare(parts, set(rel.vars))
        if flat is None:
            return self.nothing(rel, parts)
        pending = flat
        while pending:
            later = {v for p in pending for v in free(p)} | wanted | set(merged)
            chosen = self.choose(pending, rel)
            if chosen is None:
                blocked = [p for p in pending if isinstance(p, Not)]
                if not blocked:
                    raise PlanError("nothing binds the inputs of " + "; ".join(map(str, pending)))
                chosen = blocked[0]
                rel = self.expand(rel, [v for v in free(chosen) if v not in rel.vars], chosen)
            pending = [p for p in pending if p is not chosen]
            rel = self.extend(rel, chosen)
            later = {v for p in pending for v in free(p)} | wanted | {v for t in merged.values() for v in variables_of(t)}
            rel = rel.keep([v for v in rel.vars if v in later])
        for v, term in merged.items():
            if v in wanted and v not in rel.vars:
                rel = self.with_column(rel, v, term)
        return rel

    def prepare(self, parts: list, bound: set[Var]) -> tuple[list | None, dict[Var, Term]]:
        """Flat conjuncts with equalities merged and function terms taken out; the merged variables' terms."""
        work, flat, eqs = list(parts), [], []
        while work:
            p = work.pop(0)
            if isinstance(p, And):
                work = [*p.parts, *work]
            elif isinstance(p, Exists):
                renamed = {}
                for v in p.variables:
                    new = fresh(v.name.replace("#", "anon"), self._used)
                    self._used.add(new)
                    if self.anonymous(v):
                        self._anonymous.add(new)
                    renamed[v] = new
                work.insert(0, substitute(p.part, renamed))
            elif isinstance(p, Eq):
                eqs.append(p)
            else:
                flat.append(p)
        merged: dict[Var, Term] = {}
        look = lambda t: look(merged[t]) if isinstance(t, Var) and t in merged else t
        for e in eqs:
            a, b = look(e.left), look(e.right)
            if a == b:
                continue
            evaluable = [isinstance(t, Func) and t.evaluable for t in (a, b)]
            if any(evaluable):
                func, other = (a, b) if evaluable[0] else (b, a)
                flat.append(Apply(func.name, func.args, other))
            elif isinstance(a, Var) and a not in bound:
                merged[a] = b
            elif isinstance(b, Var) and b not in bound:
                merged[b] = a
            elif isinstance(a, Var) or isinstance(b, Var):
                flat.append(Cmp("==", a, b))
            else:
                return None, {}
        map_ = {v: look(v) for v in merged}
        flat = [substitute(p, map_) for p in flat]
        out: list = []
        for p in flat:
            out += self.unnest(p)
        return out, map_

    def unnest(self, p) -> list:
        """A literal whose evaluable function terms have become computed predicates before it."""
        extra: list = []

        def plain(t: Term) -> Term:
            if not isinstance(t, Func) or not t.evaluable:
                return t
            v = fresh("F", self._used)
            self._used.add(v)
            extra.append(Apply(t.name, tuple(plain(a) for a in t.args), v))
            return v

        if isinstance(p, Atom):
            return [Atom(p.pred, tuple(map(plain, p.terms)), p.version), *extra] if any(isinstance(t, Func) for t in p.terms) else [p]
        if isinstance(p, Cmp):
            q = Cmp(p.op, plain(p.left), plain(p.right))
            return [*extra, q]
        if isinstance(p, Apply):
            q = Apply(p.name, tuple(plain(t) for t in p.inputs), plain(p.output))
            return [*extra, q]
        if isinstance(p, Not) and isinstance(p.part, (Atom, Cmp, Apply)):
            inner = self.unnest(p.part)
            if len(inner) == 1:
                return [Not(inner[0])]
            core, calls = [x for x in inner if x not in extra], [x for x in inner if x in extra]
            return [*calls, Not(core[0])] if extra and core else [Not(And(tuple(inner)))]
        return [p]

    def choose(self, pending: list, rel: Rel):
        bound = set(rel.vars)
        for p in pending:
            if isinstance(p, Cmp) and set(free(p)) <= bound:
                return p
            if isinstance(p, Apply) and self.ready(p, bound):
                return p
            if isinstance(p, Not) and set(free(p)) <= bound and rel.df is not None:
                return p
        generators = [p for p in pending if isinstance(p, (Atom, Or))]
        best, score = None, None
        for p in generators:
            if isinstance(p, Atom):
                source = None if p.version else self.catalog.find(p.key)
                if source and any(isinstance(p.terms[i], Var) and p.terms[i] not in bound for i in source.mandatory):
                    continue
            shared = len(set(free(p)) & bound)
            fixed = sum(is_ground(t) for t in p.terms) if isinstance(p, Atom) else 0
            mine = (shared > 0 or not free(p), p.version != "" if isinstance(p, Atom) else False, shared, fixed, isinstance(p, Atom))
            if score is None or mine > score:
                best, score = p, mine
        if best is not None:
            return best
        return next((p for p in pending if isinstance(p, Not) and not free(p)), None)

    def ready(self, p: Apply, bound: set[Var]) -> bool:
        open_ = [i for i, t in enumerate(p.inputs) if any(v not in bound for v in variables_of(t))]
        out_known = all(v in bound for v in variables_of(p.output))
        user = self.catalog.functions.get(p.name)
        if user is not None:
            if not open_:
                return True
            known = len(p.inputs) + 1 - len(open_) - (not out_known)
            return user.solver is not None and known >= (user.min_bound or 1)
        if not open_:
            return True
        return len(open_) == 1 and out_known and p.name.rpartition(":")[2] in standard.INVERTIBLE

    # extension by one literal
    def extend(self, rel: Rel, p) -> Rel:
        if isinstance(p, Atom):
            return self.join(rel, self.atom(p, rel))
        if isinstance(p, Cmp):
            return self.filter(rel, self.condition(rel, p))
        if isinstance(p, Apply):
            return self.apply(rel, p)
        if isinstance(p, Not):
            return self.negation(rel, p)
        if isinstance(p, Or):
            return self.disjunction(rel, p)
        raise PlanError(f"cannot plan {p}")

    def condition(self, rel: Rel, p: Cmp) -> Column:
        (a, ta), (b, tb) = self.value(rel, p.left), self.value(rel, p.right)
        return same(a, ta, b, tb) if p.op == "==" else compare(p.op, a, ta, b, tb)

    def value(self, rel: Rel, term: Term) -> tuple[Column, T.DataType]:
        if isinstance(term, Var):
            return rel.col(term), rel.type(term)
        return literal_column(term)

    def filter(self, rel: Rel, condition: Column) -> Rel:
        df = rel.df if rel.df is not None else self.spark.range(1).select(F.lit(True).alias("v_unit"))
        return Rel(df.where(condition), rel.vars)

    def with_column(self, rel: Rel, v: Var, term: Term) -> Rel:
        col, _ = self.value(rel, term)
        df = rel.df if rel.df is not None else self.spark.range(1).select(F.lit(True).alias("v_unit"))
        return Rel(df.withColumn(column_name(v), col), [*rel.vars, v])

    def nothing(self, rel: Rel, parts: list) -> Rel:
        """The empty relation over all variables."""
        found = list(dict.fromkeys([*rel.vars, *(v for p in parts for v in free(p))]))
        fields = [T.StructField(column_name(v), rel.type(v) if v in rel.vars else self.type_in(v, And(tuple(parts)), T.NullType())) for v in found] or [T.StructField("v_unit", T.BooleanType())]
        return Rel(self.spark.createDataFrame([], T.StructType(fields)), found)

    def atom(self, a: Atom, rel: Rel) -> Rel:
        found = list(dict.fromkeys(v for t in a.terms for v in variables_of(t)))
        source = None if a.version else self.catalog.find(a.key)
        if source is not None and source.mandatory:
            df = self.bound_rows(source, a, rel)
        else:
            df = self.catalog.frame(a)
        if df is None:
            return self.nothing(Rel(None), [a])
        if not a.terms:
            return Rel(df.limit(1).select(F.lit(True).alias("v_unit")), [])
        kinds = [f.dataType for f in df.schema.fields]
        columns = [F.col(f"c{i}") for i in range(len(a.terms))]
        conditions, seen = [], {}
        for i, t in enumerate(a.terms):
            if isinstance(t, Var):
                if t in seen:
                    j = seen[t]
                    conditions.append(same(columns[j], kinds[j], columns[i], kinds[i]))
                else:
                    seen[t] = i
                    # a missing value is no term: its row does not hold
                    if not self.anonymous(t):
                        conditions.append(columns[i].isNotNull())
            else:
                value, kind = literal_column(t, kinds[i])
                conditions.append(same(columns[i], kinds[i], value, kind) if is_term(kind) or is_term(kinds[i]) else self.constant(columns[i], kinds[i], value, kind))
        for c in conditions:
            df = df.where(c)
        out = df.select(*(columns[i].alias(column_name(v)) for v, i in seen.items())) if seen else df.limit(1).select(F.lit(True).alias("v_unit"))
        return Rel(out, found)

    @staticmethod
    def constant(col: Column, kind: T.DataType, value: Column, value_kind: T.DataType) -> Column:
        """Equality with a constant in the column's own type, so that scans can push it down."""
        numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
        if isinstance(kind, numeric) and isinstance(value_kind, numeric):
            return col == value
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(value_kind, (T.StringType, T.DateType, T.TimestampType)):
            return col == value.try_cast(kind)
        return col == value if kind.simpleString() == value_kind.simpleString() else F.lit(False)

    def bound_rows(self, source, a: Atom, rel: Rel) -> DataFrame:
        """Rows of a source with mandatory positions for the bindings at hand: a dependent join."""
        wanted = sorted(source.mandatory)
        unknown = [a.terms[i] for i in wanted if isinstance(a.terms[i], Var) and a.terms[i] not in rel.vars]
        if unknown:
            raise PlanError(f"{a.pred} needs a value at {', '.join(map(str, unknown))}")
        base = rel.df if any(isinstance(a.terms[i], Var) for i in wanted) else self.spark.range(1)
        values = [self.value(rel, a.terms[i])[0].cast(source.schema[i].dataType).alias(f"c{i}") for i in wanted]
        return source.fetch(base.select(*values).distinct())

    def join(self, left: Rel, right: Rel) -> Rel:
        if left.df is None:
            return right
        if right.df is None:
            return left
        shared = [v for v in left.vars if v in right.vars]
        if not shared:
            lefts, rights = left.df.drop("v_unit"), right.df
            if not right.vars:
                return Rel(left.df.join(right.df.limit(1), F.lit(True), "left_semi"), left.vars)
            if not left.vars:
                return Rel(rights.join(left.df.limit(1), F.lit(True), "left_semi"), right.vars)
            return Rel(lefts.crossJoin(rights), [*left.vars, *right.vars])
        left, right = self.meet(left, right, shared)
        df = left.df.join(right.df, [column_name(v) for v in shared])
        return Rel(df, [*left.vars, *(v for v in right.vars if v not in shared)])

    def meet(self, left: Rel, right: Rel, shared: list[Var]) -> tuple[Rel, Rel]:
        """Both sides with the shared variables in common types."""
        for v in shared:
            kind = common(left.type(v), right.type(v))
            left, right = self.cast(left, v, kind), self.cast(right, v, kind)
        return left, right

    def cast(self, rel: Rel, v: Var, kind: T.DataType) -> Rel:
        if rel.type(v).simpleString() == kind.simpleString():
            return rel
        return Rel(rel.df.withColumn(column_name(v), convert(rel.col(v), rel.type(v), kind)), rel.vars)

    # computed predicates
    def apply(self, rel: Rel, p: Apply) -> Rel:
        if rel.df is None:
            rel = Rel(self.spark.range(1).select(F.lit(True).alias("v_unit")), [])
        user = self.catalog.functions.get(p.name)
        unknown = [i for i, t in enumerate(p.inputs) if any(v not in rel.vars for v in variables_of(t))]
        if user is not None:
            return self.user(rel, p, user, unknown)
        name = p.name.rpartition(":")[2]
        try:
            if unknown:
                return self.solve(rel, p, name, unknown[0])
            value = standard.evaluate(name, [Arg(*self.value(rel, t)) for t in p.inputs])
        except FunctionError as problem:
            if name not in standard.names():
                raise PlanError(str(problem)) from None
            return self.nothing(rel, [And(tuple([*(Eq(v, v) for v in rel.vars), p]))])
        return self.output(rel, p.output, value)

    def output(self, rel: Rel, output: Term, value: Column) -> Rel:
        tmp = "v_value"
        df = rel.df.withColumn(tmp, value)
        kind = df.schema[tmp].dataType
        df = df.where(F.col(tmp).isNotNull())
        if isinstance(output, Var) and output not in rel.vars:
            return Rel(df.withColumnRenamed(tmp, column_name(output)), [*rel.vars, output])
        known, known_kind = self.value(Rel(df, rel.vars), output)
        equal = same(F.col(tmp), kind, known, known_kind) if _typed_alike(kind, known_kind) else F.lit(False)
        return Rel(df.where(equal).drop(tmp), rel.vars)

    def solve(self, rel: Rel, p: Apply, name: str, at: int) -> Rel:
        args = [None if i == at else Arg(*self.value(rel, t)) for i, t in enumerate(p.inputs)]
        solution = standard.invert(name, args, Arg(*self.value(rel, p.output)))
        rel = self.output(rel, p.inputs[at], solution)
        forward = standard.evaluate(name, [Arg(*self.value(rel, t)) for t in p.inputs])
        known, _ = self.value(rel, p.output)
        return self.filter(rel, F.abs(forward.cast("double") - known.cast("double")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(known.cast("double"))))

    def user(self, rel: Rel, p: Apply, f, unknown: list[int]) -> Rel:
        if f.input_arity is not None and f.input_arity != len(p.inputs):
            raise PlanError(f"{p.name} takes {f.input_arity} inputs")
        if not unknown:
            value = f.column([self.value(rel, t)[0] for t in p.inputs])
            if f.many:
                rel = Rel(rel.df.withColumn("v_many", F.explode(value)), rel.vars)
                out = self.output(rel, p.output, F.col("v_many"))
                return Rel(out.df.drop("v_many"), out.vars)
            return self.output(rel, p.output, value)
        terms = [*p.inputs, p.output]
        known = [self.value(rel, t)[0] if all(v in rel.vars for v in variables_of(t)) else None for t in terms]
        kinds = [self.value(rel, t)[1] if k is not None else f.returns for t, k in zip(terms, known, strict=True)]
        df = rel.df.withColumn("v_many", F.explode(f.solve(known, kinds)))
        out = Rel(df, rel.vars)
        for i, t in enumerate(terms):
            if known[i] is None and t not in out.vars:
                out = Rel(out.df.withColumn(column_name(t), F.col(f"v_many.p{i}")), [*out.vars, t])
        return Rel(out.df.drop("v_many"), out.vars)

    # negation, disjunction, domains
    def negation(self, rel: Rel, p: Not) -> Rel:
        inner = p.part
        if isinstance(inner, Cmp):
            return self.filter(rel, ~F.coalesce(self.condition(rel, inner), F.lit(False)))
        shared = [v for v in free(inner) if v in rel.vars]
        if self.self_contained(inner):
            found = self.conjunction([inner], Rel(None), set(shared)).keep(shared)
        else:
            seed = rel.keep(shared)
            seed = Rel(seed.df.distinct(), seed.vars) if seed.df is not None and seed.vars else seed
            found = self.conjunction([inner], seed, set(shared)).keep(shared)
        base = rel.df if rel.df is not None else self.spark.range(1).select(F.lit(True).alias("v_unit"))
        if found.df is None:
            return Rel(base.limit(0), rel.vars)
        if not shared:
            return Rel(base.join(found.df.limit(1), F.lit(True), "left_anti"), rel.vars)
        found = Rel(found.df, found.vars)
        for v in shared:
            kind = common(rel.type(v), found.type(v))
            found = self.cast(found, v, kind)
            base_rel = self.cast(Rel(rel.df, rel.vars), v, kind)
            rel = Rel(base_rel.df, rel.vars)
        return Rel(rel.df.join(found.df, [column_name(v) for v in shared], "left_anti"), rel.vars)

    def self_contained(self, f) -> bool:
        """Whether positive atoms without mandatory positions bind every variable of the formula."""
        if isinstance(f, Exists):
            return self.self_contained(f.part)
        if isinstance(f, Or):
            return all(self.self_contained(p) and set(free(p)) == set(free(f)) for p in f.parts)
        parts = f.parts if isinstance(f, And) else (f,)
        plain = [q for p in parts for q in (p.part.parts if isinstance(p, Exists) and isinstance(p.part, And) else (p.part,) if isinstance(p, Exists) else (p,))]
        bound = set()
        for p in plain:
            if isinstance(p, Atom):
                source = None if p.version else self.catalog.find(p.key)
                if source is None or not source.mandatory:
                    bound |= {v for t in p.terms if isinstance(t, Var) for v in variables_of(t)}
            elif isinstance(p, Or) and self.self_contained(p):
                bound |= set(free(p))
        return all(set(free(p)) <= bound for p in plain)

    def disjunction(self, rel: Rel, p: Or) -> Rel:
        wanted = free(p)
        contained = self.self_contained(p)
        branches = []
        for part in p.parts:
            start = Rel(None) if contained else rel
            branch = self.conjunction([part], start, set(wanted) | set(start.vars))
            branches.append(self.expand(branch, [v for v in wanted if v not in branch.vars], p))
        if not branches:
            return self.nothing(rel, [p])
        columns = [v for v in (branches[0].vars) if all(v in b.vars for b in branches)]
        for v in columns:
            kind = branches[0].type(v)
            for b in branches[1:]:
                kind = common(kind, b.type(v))
            branches = [self.cast(b, v, kind) for b in branches]
        unit = self.spark.range(1).select(F.lit(True).alias("v_unit"))
        frames = [(b.df if b.df is not None else unit).select(*(b.col(v) for v in columns)) if columns else (b.df if b.df is not None else unit).limit(1).select(F.lit(True).alias("v_unit")) for b in branches]
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other)
        union = Rel(df.distinct(), columns)
        return self.join(rel, union) if contained else union

    def expand(self, rel: Rel, missing: list[Var], context) -> Rel:
        """Variables that nothing binds range over the active domain of their type."""
        missing = [v for v in missing if v not in rel.vars]
        if missing:
            warnings.warn(f"{', '.join(map(str, missing))} range over the active domain", UnsafeNegationWarning, stacklevel=2)
        for v in missing:
            kind = self.type_in(v, context)
            domain = self.catalog.domain(kind).withColumnRenamed("d", column_name(v))
            if self.domain_cap is not None and domain.limit(self.domain_cap + 1).count() > self.domain_cap:
                raise PlanError(f"the active domain of {v} has more than {self.domain_cap} values")
            rel = self.join(rel, Rel(domain, [v]))
        return rel

    def type_in(self, v: Var, f, unknown: T.DataType | None = None) -> T.DataType:
        """The type of a variable: that of a position where it stands."""
        for a in atoms_of(f):
            schema = self.catalog.schema(a)
            for i, t in enumerate(a.terms):
                if t == v and schema is not None:
                    return schema[i].dataType
        return unknown or T.StringType()


def _typed_alike(a: T.DataType, b: T.DataType) -> bool:
    """Whether a function's output can equal a bound one: integers never equal doubles."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    real = (T.FloatType, T.DoubleType, T.DecimalType)
    return not (isinstance(a, whole) and isinstance(b, real) or isinstance(a, real) and isinstance(b, whole))


def _distinct_names(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        new, k = n, 1
        while new.lower() in {x.lower() for x in out}:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def upper_bound(catalog: Catalog, f) -> int | None:
    """Upper bound of a formula's answers: a conjunction multiplies and 0 wins, a disjunction adds,
    negations, comparisons and functions count as 1; None where a part has no known size."""
    if isinstance(f, Atom):
        source = catalog.find(f.key)
        return 0 if source is None else source.rows()
    if isinstance(f, Exists):
        return upper_bound(catalog, f.part)
    if isinstance(f, And):
        parts = [upper_bound(catalog, p) for p in f.parts]
        return 0 if 0 in parts else None if None in parts else math.prod(parts)
    if isinstance(f, Or):
        parts = [upper_bound(catalog, p) for p in f.parts]
        return None if None in parts else sum(parts)
    return 1
