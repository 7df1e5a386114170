"""Formulas, queries, rules and constraints."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from lodestone.terms import Const, Func, Term, Var, variables_of


@dataclass(frozen=True)
class Atom:
    pred: str
    terms: tuple[Term, ...]
    #: Which version of the predicate to read: all of it, or a delta of the chase.
    version: str = field(default="", compare=False)

    @property
    def key(self) -> tuple[str, int]:
        return self.pred, len(self.terms)

    def __str__(self) -> str:
        return f"{self.pred}({', '.join(map(str, self.terms))})"


@dataclass(frozen=True)
class Eq:
    left: Term
    right: Term

    def __str__(self) -> str:
        return f"{self.left} = {self.right}"


@dataclass(frozen=True)
class Cmp:
    op: str
    left: Term
    right: Term

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Apply:
    """A computed predicate: function, inputs and output."""

    name: str
    inputs: tuple[Term, ...]
    output: Term

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, (*self.inputs, self.output)))})"


@dataclass(frozen=True)
class And:
    parts: tuple

    def __str__(self) -> str:
        return ", ".join(f"({p})" if isinstance(p, Or) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Or:
    parts: tuple

    def __str__(self) -> str:
        return " | ".join(f"({p})" if isinstance(p, And) and len(p.parts) > 1 else str(p) for p in self.parts)


@dataclass(frozen=True)
class Not:
    part: object

    def __str__(self) -> str:
        return f"not {self.part}" if isinstance(self.part, Atom) else f"not ({self.part})"


@dataclass(frozen=True)
class Exists:
    variables: tuple[Var, ...]
    part: object

    def __str__(self) -> str:
        return str(self.part)


@dataclass(frozen=True)
class Forall:
    variables: tuple[Var, ...]
    part: object

    def __str__(self) -> str:
        return f"forall {', '.join(map(str, self.variables))}: {self.part}"


TRUE, FALSE = And(()), Or(())


def terms_of(f) -> tuple[Term, ...]:
    if isinstance(f, Atom):
        return f.terms
    if isinstance(f, (Eq, Cmp)):
        return f.left, f.right
    return (*f.inputs, f.output) if isinstance(f, Apply) else ()


def free(f) -> list[Var]:
    """Free variables in order of first occurrence."""
    if isinstance(f, (And, Or)):
        found = [v for p in f.parts for v in free(p)]
    elif isinstance(f, Not):
        found = free(f.part)
    elif isinstance(f, (Exists, Forall)):
        found = [v for v in free(f.part) if v not in f.variables]
    else:
        found = [v for t in terms_of(f) for v in variables_of(t)]
    return list(dict.fromkeys(found))


def atoms_of(f) -> list[Atom]:
    """All atoms, negated ones too."""
    if isinstance(f, Atom):
        return [f]
    if isinstance(f, (And, Or)):
        return [a for p in f.parts for a in atoms_of(p)]
    return atoms_of(f.part) if isinstance(f, (Not, Exists, Forall)) else []


def put(term: Term, map_: dict) -> Term:
    if isinstance(term, Func):
        return replace(term, args=tuple(put(a, map_) for a in term.args))
    return map_.get(term, term)


def substitute(f, map_: dict):
    """Capture-avoiding substitution of terms for free variables."""
    if not map_:
        return f
    if isinstance(f, Atom):
        return replace(f, terms=tuple(put(t, map_) for t in f.terms))
    if isinstance(f, Eq):
        return Eq(put(f.left, map_), put(f.right, map_))
    if isinstance(f, Cmp):
        return Cmp(f.op, put(f.left, map_), put(f.right, map_))
    if isinstance(f, Apply):
        return Apply(f.name, tuple(put(t, map_) for t in f.inputs), put(f.output, map_))
    if isinstance(f, (And, Or)):
        return type(f)(tuple(substitute(p, map_) for p in f.parts))
    if isinstance(f, Not):
        return Not(substitute(f.part, map_))
    inner = {k: v for k, v in map_.items() if k not in f.variables}
    taken = {v for t in inner.values() for v in variables_of(t)}
    renamed = {v: fresh(v.name, taken | set(free(f.part))) for v in f.variables if v in taken}
    return type(f)(tuple(renamed.get(v, v) for v in f.variables), substitute(substitute(f.part, renamed), inner))


def fresh(name: str, taken: Iterable[Var]) -> Var:
    used, n = {v.name for v in taken}, 1
    while f"{name}_{n}" in used:
        n += 1
    return Var(f"{name}_{n}")


@dataclass(frozen=True)
class Query:
    """A first-order query; bound gives answer variables a fixed term."""

    answers: tuple[Var, ...]
    body: object
    label: str | None = None
    bound: tuple[tuple[Var, Term], ...] = ()

    def __str__(self) -> str:
        return f"?({', '.join(map(str, self.answers))}) :- {self.body}."


@dataclass(frozen=True)
class Rule:
    """Body to head; the head is a tuple of disjuncts, each a tuple of atoms."""

    head: tuple[tuple[Atom, ...], ...]
    body: object
    label: str | None = None

    @property
    def head_atoms(self) -> tuple[Atom, ...]:
        return tuple(a for d in self.head for a in d)

    @property
    def frontier(self) -> list[Var]:
        body = set(free(self.body))
        return [v for v in dict.fromkeys(v for a in self.head_atoms for t in a.terms for v in variables_of(t)) if v in body]

    @property
    def existentials(self) -> list[Var]:
        body = set(free(self.body))
        return [v for v in dict.fromkeys(v for a in self.head_atoms for t in a.terms for v in variables_of(t)) if v not in body]

    def __str__(self) -> str:
        head = " | ".join(f"({', '.join(map(str, d))})" if len(d) > 1 and len(self.head) > 1 else ", ".join(map(str, d)) for d in self.head)
        return f"{'[' + self.label + '] ' if self.label else ''}{head} :- {self.body}."


@dataclass(frozen=True)
class Constraint:
    body: object
    label: str | None = None

    def __str__(self) -> str:
        return f"{'[' + self.label + '] ' if self.label else ''}! :- {self.body}."


def localise(f, outside: set):
    """Quantify the variables that occur in one negation or disjunction only inside it."""
    if isinstance(f, And):
        others = lambda i: {v for j, q in enumerate(f.parts) if j != i for v in free(q)}
        return And(tuple(localise(p, outside | others(i)) for i, p in enumerate(f.parts)))
    if isinstance(f, Or):  # a quantifier distributes over the disjuncts
        out = []
        for p in f.parts:
            inner = localise(p, outside)
            local = tuple(v for v in free(inner) if v not in outside)
            out.append(Exists(local, inner) if local else inner)
        return Or(tuple(out))
    if isinstance(f, Not):
        inner = localise(f.part, outside)
        local = tuple(v for v in free(inner) if v not in outside)
        return Not(Exists(local, inner)) if local else Not(inner)
    return f


def conjuncts(f) -> list:
    """Parts of nested conjunctions; quantifiers over a positive body are dropped as its variables are join variables."""
    if isinstance(f, And):
        return [c for p in f.parts for c in conjuncts(p)]
    return [f]


def dnf(f) -> list[list]:
    """Disjunctive normal form of a formula over literals; negations and quantified parts count as literals."""
    if isinstance(f, Or):
        return [c for p in f.parts for c in dnf(p)]
    if isinstance(f, And):
        out: list[list] = [[]]
        for p in f.parts:
            out = [a + b for a in out for b in dnf(p)]
        return out
    return [[f]]


def normal(f):
    """Negations pushed inward over and, or and the universal quantifier; bodies flattened."""
    if isinstance(f, And):
        parts = [q for p in f.parts for q in conjuncts(normal(p))]
        return parts[0] if len(parts) == 1 else And(tuple(parts))
    if isinstance(f, Or):
        parts = [normal(p) for p in f.parts]
        flat = [q for p in parts for q in (p.parts if isinstance(p, Or) else (p,))]
        return flat[0] if len(flat) == 1 else Or(tuple(flat))
    if isinstance(f, Exists):
        inner = normal(f.part)
        keep = tuple(v for v in f.variables if v in free(inner))
        return Exists(keep, inner) if keep else inner
    if isinstance(f, Forall):
        return normal(Not(Exists(f.variables, Not(f.part))))
    if isinstance(f, Not):
        g = f.part
        if isinstance(g, Not):
            return normal(g.part)
        if isinstance(g, And) and g.parts:
            return normal(Or(tuple(Not(p) for p in g.parts))) if len(g.parts) == 1 else Not(normal(g))
        if isinstance(g, Or):
            return normal(And(tuple(Not(p) for p in g.parts)))
        if isinstance(g, Forall):
            return normal(Exists(g.variables, Not(g.part)))
        return Not(normal(g))
    return f


class FormulaBuilder:
    """Left-associative builder; a first letter in upper case makes a variable."""

    def __init__(self) -> None:
        self._parts: list = []
        self._ops: list[Callable] = []
        self._wrap: list[Callable] = []
        self._negate = False

    @staticmethod
    def term(x: object) -> Term:
        if isinstance(x, str):
            return Var(x) if x[:1].isupper() else Const(x)
        from lodestone.terms import from_python

        return from_python(x)

    def _add(self, part) -> FormulaBuilder:
        part = Not(part) if self._negate else part
        self._negate = False
        self._parts = [self._ops.pop()(self._parts.pop(), part)] if self._ops else [*self._parts, part]
        return self

    def atom(self, pred: str, *terms) -> FormulaBuilder:
        return self._add(Atom(pred, tuple(map(self.term, terms))))

    def formula(self, part) -> FormulaBuilder:
        return self._add(part)

    def not_(self) -> FormulaBuilder:
        self._negate = not self._negate
        return self

    def and_(self) -> FormulaBuilder:
        self._ops.append(lambda a, b: And((a, b)))
        return self

    def or_(self) -> FormulaBuilder:
        self._ops.append(lambda a, b: Or((a, b)))
        return self

    def exists(self, *names: str) -> FormulaBuilder:
        self._wrap.append(lambda f: Exists(tuple(map(Var, names)), f))
        return self

    def forall(self, *names: str) -> FormulaBuilder:
        self._wrap.append(lambda f: Forall(tuple(map(Var, names)), f))
        return self

    def build(self):
        if len(self._parts) != 1 or self._ops or self._negate:
            raise ValueError("the formula is not complete")
        out = self._parts[0]
        for wrap in reversed(self._wrap):
            out = wrap(out)
        return out
