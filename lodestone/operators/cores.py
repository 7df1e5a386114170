"""Cores: fact sets without foldable labelled nulls.

A piece is a set of atoms connected through nulls; only pieces can fold, ground atoms
stay.  Query-sized sets fold on the driver.  Of a catalog, pieces of one fact, however many there are, fold by
joins on the executors; larger pieces that are left are read in (below a cap)
and each fold is looked for by one Spark query over all facts.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.homomorphism import Map, homomorphisms, maps_into, moves
from lodestone.operators.ruleset import pieces
from lodestone.plans.encoding import PlanError, from_row, is_term
from lodestone.runtime import saved
from lodestone.sources.catalog import Catalog, Source, facts_frames, without
from lodestone.syntax import Atom, substitute
from lodestone.terms import Null, Term, Var

VARIANTS = ("naive", "by_specialisation", "by_piece_exhaustive", "by_piece_deletion", "by_piece_specialisation", "by_piece_and_variable", "multi_thread")
CAP = 100_000


def nulls_of(atoms: Iterable[Atom]) -> list[Term]:
    return list(dict.fromkeys(t for a in atoms for t in a.terms if moves(t)))


def _image(atoms: Iterable[Atom], map_: Map) -> list[Atom]:
    return list(dict.fromkeys(substitute(a, map_) for a in atoms))


def _drop_one(atoms: list[Atom], null: Term, piece: list[Atom], frozen: set[Term]) -> Map | None:
    """A map of the piece that avoids the atoms of one null."""
    rest = [a for a in atoms if null not in a.terms]
    return next(homomorphisms(piece, rest, {t: t for t in frozen}), None)


def core(atoms: Iterable[Atom], variant: str = "by_piece_deletion", frozen: Iterable[Term] = (), workers: int = 8) -> list[Atom]:
    """An equivalent smallest subset; frozen terms stay as they are."""
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {', '.join(VARIANTS)}")
    now, fixed = list(dict.fromkeys(atoms)), set(frozen)
    if variant == "by_specialisation":
        while True:
            best = min((_image(now, m) for m in homomorphisms(now, now, {t: t for t in fixed})), key=len, default=now)
            if len(best) == len(now):
                return now
            now = best
    if variant == "naive":
        done = False
        while not done:
            done = True
            for n in nulls_of(now):
                if n not in fixed and (m := _drop_one(now, n, now, fixed)) is not None:
                    now, done = _image(now, m), False
                    break
        return now
    active = {t for t in nulls_of(now) if t not in fixed}
    groups = [g for g in pieces(now, active) if set(nulls_of(g)) & active]

    def fold(group: list[Atom]) -> list[Atom]:
        mine, around = list(group), [a for a in now if a not in group]
        done = False
        while not done:
            done = True
            if variant == "by_piece_exhaustive" or variant == "by_piece_specialisation":
                images = [_image(mine, m) for m in homomorphisms(mine, [*mine, *around], {t: t for t in fixed})]
                kept = [[a for a in i if a not in around] for i in images]
                best = min(kept, key=len, default=mine)
                if len(best) < len(mine):
                    mine, done = best, False
                continue
            for n in nulls_of(mine):
                if n not in fixed and (m := _drop_one([*mine, *around], n, mine, fixed)) is not None:
                    mine, done = [a for a in _image(mine, m) if a not in around], False
                    break
        return mine

    # one piece may serve another as target, so folded pieces are put back one after the other
    if variant == "multi_thread" and len(groups) > 1:
        with ThreadPoolExecutor(workers) as pool:
            inner = list(pool.map(lambda g: core(g, "by_piece_deletion", fixed), groups))
        now = list(dict.fromkeys([a for a in now if not any(a in g for g in groups)] + [a for g in inner for a in g]))
        return core(now, "by_piece_deletion", fixed)
    for group in sorted(groups, key=len):
        folded = fold(group)
        now = [a for a in now if a not in group] + [a for a in folded if a not in now or a in group]
        now = list(dict.fromkeys(now))
    return now


def is_core(atoms: Iterable[Atom]) -> bool:
    atoms = list(dict.fromkeys(atoms))
    return not any(_drop_one(atoms, n, atoms, set()) is not None for n in nulls_of(atoms)) and not any(
        maps_into(atoms, [b for b in atoms if b != a]) for a in atoms
    )


def collect(catalog: Catalog, keys: Iterable | None = None, cap: int = CAP) -> list[Atom]:
    """Facts of the catalog as atoms, for small catalogs."""
    out = []
    for key in keys or list(catalog.sources):
        source = catalog.sources[key]
        if source.load is None:
            continue
        rows = source.frame().limit(cap + 1).collect() if key[1] else [()]
        if len(rows) > cap:
            raise PlanError(f"{key[0]}/{key[1]} has more than {cap} rows")
        out += [Atom(key[0], tuple(from_row(v) for v in r)) for r in rows]
    return out


def _null_atoms(catalog: Catalog, cap: int) -> list[Atom]:
    """Facts of pieces that can still fold: those with a null that another fact has too."""
    held: dict = {}
    for key, source in list(catalog.sources.items()):
        if source.load is not None and key[1] and (names := _null_names(source)):
            held[key] = (source, F.array_distinct(F.array_compact(F.array(*names.values()))))
    if not held:
        return []
    counts = None
    for key, (source, nulls) in held.items():
        part = source.frame().select(F.explode(nulls).alias("null"), F.xxhash64(F.lit(f"{key[0]}/{key[1]}"), *source.schema.names).alias("fact"))
        counts = part if counts is None else counts.unionByName(part)
    shared = saved(counts.groupBy("null").agg(F.min("fact").alias("a"), F.max("fact").alias("b")).where("a <> b").select("null"), "shared-nulls")
    out = []
    for key, (source, nulls) in held.items():
        tied = source.frame().withColumn("null", F.explode(nulls)).join(shared, "null", "left_semi").select(*source.schema.names).distinct()
        rows = tied.limit(cap + 1).collect()
        if len(rows) > cap:
            raise PlanError(f"more than {cap} facts with shared nulls in {key[0]}/{key[1]}")
        out += [Atom(key[0], tuple(from_row(v) for v in r)) for r in rows]
    return out


def _null_names(source: Source) -> dict[str, Column]:
    """For each position that can hold nulls, the null's name."""
    return {f.name: F.when(F.col(f"{f.name}.k") == "n", F.col(f"{f.name}.v")) for f in source.schema.fields if is_term(f.dataType)}


def _fold_single_facts(catalog: Catalog) -> int:
    """Remove every fact whose nulls stand in no other fact and that another fact of its predicate covers.

    A fact covers another if it agrees wherever that one has no null, and is equal to itself wherever
    that one repeats a null.  Of facts that cover each other the one with the smallest hash stays.
    """
    found = {key: (s, _null_names(s)) for key, s in catalog.sources.items() if s.load is not None and key[1]}
    found = {key: (s, names) for key, (s, names) in found.items() if names}
    if not found:
        return 0
    row = lambda key, s: F.xxhash64(F.lit(f"{key[0]}/{key[1]}"), *s.schema.names)
    places = [s.frame().select(row(key, s).alias("fact"), F.explode(F.array_distinct(F.array_compact(F.array(*names.values())))).alias("null")) for key, (s, names) in found.items()]
    every = places[0]
    for p in places[1:]:
        every = every.unionByName(p)
    shared = saved(every.groupBy("null").agg(F.min("fact").alias("a"), F.max("fact").alias("b")).where("a <> b").select("null"), "shared-nulls")
    gone = 0
    for key, (s, names) in found.items():
        marked = s.frame().withColumn("fact", row(key, s)).withColumn("nulls", F.array(*names.values()))
        marked = marked.withColumn("own", F.array_distinct(F.array_compact("nulls")))
        marked = saved(marked.withColumn("mask", F.concat(*(F.when(c.isNotNull(), "1").otherwise("0") for c in names.values()))), "marked")
        tied = marked.where("size(own) > 0").select("fact", F.explode("own").alias("null")).join(shared, "null", "left_semi").select("fact").distinct()
        # facts of larger pieces stay here, so they come before single ones of the same form
        alone = tied.withColumn("kept", F.lit(0))
        marked = marked.join(alone, "fact", "left").withColumn("rank", F.struct(F.size(F.array_compact("nulls")).alias("n"), F.size("own").alias("d"), F.coalesce("kept", F.lit(1)).alias("s"), F.col("fact").alias("h")))
        single = marked.where("size(own) > 0 AND kept IS NULL")
        covered = None
        # at most one mask for each set of positions
        for (mask,) in single.select("mask").distinct().collect():
            open_ = [n for n, m in zip(names, mask, strict=True) if m == "1"]
            left, right = single.where(F.col("mask") == mask).alias("l"), marked.alias("r")
            on = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in s.schema.names if n not in open_]
            on += [(F.col(f"l.{a}") != F.col(f"l.{b}")) | (F.col(f"r.{a}") == F.col(f"r.{b}")) for i, a in enumerate(open_) for b in open_[:i]]
            part = left.join(right, [*on, F.col("r.rank") < F.col("l.rank")], "left_semi").select(*s.schema.names)
            covered = part if covered is None else covered.unionByName(part)
        if covered is None:
            continue
        covered = saved(covered, "covered")
        n = covered.count()
        if n:
            rest = saved(without(s.frame(), covered), "folded").toDF(*s.schema.names)
            catalog.sources[key] = Source(lambda rest=rest: rest, rest.schema, writable=True)
            gone += n
    return gone


def fold_catalog(catalog: Catalog, cap: int = CAP) -> int:
    """Fold the catalog's null pieces in place; the number of facts that went."""
    return _fold_single_facts(catalog) + _fold_pieces(catalog, cap)


def _fold_pieces(catalog: Catalog, cap: int) -> int:
    """Fold the pieces of several facts.

    The pieces are on the driver (below the cap); whether one folds onto the rest of the data is a
    query with the nulls as variables.
    """
    from lodestone.plans.compiler import Compiler
    from lodestone.syntax import And, Query

    atoms = _null_atoms(catalog, cap)
    active = set(nulls_of(atoms))
    gone: list[Atom] = []
    left = list(atoms)
    for group in sorted(pieces(atoms, active), key=len):
        smaller = core(group)
        removed = [a for a in group if a not in smaller]
        names = {n: Var(f"N{i}") for i, n in enumerate(nulls_of(smaller))}
        body = And(tuple(Atom(a.pred, tuple(names.get(t, t) if isinstance(t, Null) else t for t in a.terms)) for a in smaller))
        trial = catalog.copy()
        for key, df in facts_frames(catalog.spark, [*gone, *removed, *smaller]).items():
            source = trial.sources[key]
            frame = without(source.frame(), df)
            trial.sources[key] = Source(lambda frame=frame: frame, frame.schema)
        if smaller and Compiler(trial).query(Query((), body)).first()[0]:
            removed = list(group)
        gone += removed
        left = [a for a in left if a not in removed]
    for key, df in facts_frames(catalog.spark, gone).items():
        source = catalog.sources[key]
        frame = without(source.frame(), df)
        catalog.sources[key] = Source(lambda frame=frame: frame, frame.schema, writable=True)
    return len(gone)
