"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of one label link at a cosine of `threshold` or more, that is at a squared distance
of at most 2 - 2 * threshold.

1. Equal vectors of a label collapse into one class with a weight.
2. Vectors are rotated onto the principal directions of a bounded sample, which are dealt to low-dimensional
   blocks, the strongest first.  A linked pair has a block whose squared distance is at most its
   proportional share of the budget.  The number of blocks is the one of least cost for the sample: the share of
   its pairs that would meet, times a meeting's work.
3. Range join of each block: the leading coordinates of a block make grid cells as wide as the
   block's radius, so partners are in the same or an adjoining cell.  Cells are
   split into tiles by hash, and every pair of tiles of adjoining cells is one bounded task.
4. A task filters its pairs by block distance and verifies the rest in double precision on the
   whole vectors.  A linked pair counts in the first block that proposes it only, so the union needs no
   shuffle of pairs; tasks emit counts and a local spanning forest.
5. Components of the forest give component_id.

Work: vectors spread evenly over all directions (random ones) meet once a pair in one block at 64 dimensions, as
the radius of 0.37 is three standard deviations of a coordinate; directions with more spread than the radius prune.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows
without a label, link with nothing (component_id is vec_id, kept); rows that share a vec_id
are one vector with the links of either, counted for each; a null vec_id has null component_id, no links and is kept; labels of any type
are compared as they are; other columns are
ignored; vectors of different lengths never link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.ngram_join import least_reachable
from lodestone.runtime import saved

#: Numbers of blocks to choose from.
BLOCKS = (1, 2, 4, 8)
#: Leading coordinates of a block that make its cells.
GRID = 2
#: Vectors of a tile; two tiles meet in one task at a time.
TILE = 1024
#: Vectors of the sample that the rotation and the blocks are fitted on, and their components in all, at most.
SAMPLE, SAMPLE_VALUES = 2000, 1 << 20
#: Dimensions up to which vectors are rotated and cut into blocks.
MAX_TURN = 512
#: Work of bringing a pair together, in coordinates of a block's distance.
MEETING = 16
#: Added to every block's budget against rounding.
SLACK = 1e-9

_FOUND = "rep long, n_links long, low long"


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


@dataclass(frozen=True)
class Split:
    """A rotation and the bounds of the blocks of its coordinates."""

    #: The rotation; of longer vectors only the directions of the cells, and then one block holds all coordinates.
    turn: np.ndarray
    bounds: np.ndarray

    @property
    def whole(self) -> bool:
        return self.turn.shape[1] < self.turn.shape[0]

    @classmethod
    def of(cls, directions: np.ndarray, blocks: int) -> Split:
        """Blocks of directions dealt in turn, so that each leads with strong ones."""
        dim = len(directions)
        blocks = min(blocks, dim)
        order = [i for b in range(blocks) for i in range(b, dim, blocks)]
        sizes = [len(range(b, dim, blocks)) for b in range(blocks)]
        return cls(directions[:, order], np.concatenate([[0], np.cumsum(sizes)]))

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors, rotated; a row's result does not depend on the rows beside it."""
        unit = _unit(vectors)
        if self.whole:
            return unit
        out = np.zeros_like(unit)
        for j in range(unit.shape[1]):
            out += unit[:, j : j + 1] * self.turn[j]
        return out

    def limits(self, budget: float) -> np.ndarray:
        return budget * np.diff(self.bounds) / self.bounds[-1] + SLACK

    def cells(self, x: np.ndarray, block: int, budget: float) -> np.ndarray:
        first, last = self.bounds[block : block + 2]
        lead = x @ self.turn if self.whole else x[:, first : min(first + GRID, last)]
        cell = np.floor(lead / np.sqrt(self.limits(budget)[block])).astype(np.int32)
        return np.concatenate([cell, np.zeros((len(x), GRID - cell.shape[1]), dtype=np.int32)], axis=1)


def meetings(split: Split, x: np.ndarray, label: np.ndarray, budget: float) -> np.ndarray:
    """Of each block, the share of pairs of one label whose cells adjoin."""
    met, pairs = np.zeros(len(split.bounds) - 1), 0
    for value in np.unique(label):
        own = x[label == value]
        pairs += len(own) * (len(own) - 1)
        for b in range(len(met)):
            cell = split.cells(own, b, budget)
            near = (np.abs(cell[:, None, :] - cell[None, :, :]) <= 1).all(axis=2)
            met[b] += near.sum() - len(own)
    return met / max(pairs, 1)


def choose(vectors: np.ndarray, label: np.ndarray, threshold: float, blocks: tuple[int, ...] = BLOCKS) -> Split:
    """The principal directions of the sample and the number of blocks of least cost; long vectors are one block."""
    unit, budget = _unit(vectors), 2 - 2 * threshold
    if unit.shape[1] > MAX_TURN:
        return Split(np.linalg.svd(unit, full_matrices=False)[2][:GRID].T, np.array([0, unit.shape[1]]))
    _, directions = np.linalg.eigh(unit.T @ unit)
    splits = [Split.of(directions[:, ::-1], b) for b in blocks]
    cost = [float((meetings(s, s.rotated(vectors), label, budget) * (np.diff(s.bounds) + MEETING)).sum()) for s in splits]
    return splits[int(np.argmin(cost))]


def _splits(nodes: DataFrame, threshold: float, blocks: tuple[int, ...]) -> dict[int, Split]:
    """A split for each dimension of the table, fitted on a sample by hash."""
    out = {}
    # one row for each vector length
    for row in nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():
        many = max(2, min(SAMPLE, SAMPLE_VALUES // row.dim))
        own = nodes.where(F.size("embedding") == row.dim).orderBy(F.xxhash64("rep"), "rep").limit(many).select("embedding", F.xxhash64("label").alias("label"))
        sample = own.toArrow()
        vectors = sample.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, row.dim)
        out[row.dim] = choose(vectors, sample.column("label").to_numpy(), threshold, blocks)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _cells(splits: dict[int, Split], budget: float):
    """One row per vector and block: block, dimension and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                split = splits[int(dim)]
                x = split.rotated(_matrix(part.column("embedding"), int(dim)))
                for b in range(len(split.bounds) - 1):
                    cell = split.cells(x, b, budget)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("label"), part.column("rep"), part.column("h1"), pa.array(np.full(n, dim, dtype=np.int32)), pa.array(np.full(n, b, dtype=np.int32)), pa.array(cell[:, 0].copy()), pa.array(cell[:, 1].copy())],
                        names=["label", "rep", "h1", "dim", "block", "x", "y"],
                    )

    return run


def _verify(splits: dict[int, Split], threshold: float):
    budget = 2 - 2 * threshold

    def links(same: bool, block: int, side: np.ndarray, rep: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
        """Links between the two tiles, or inside the one tile, of a task."""
        split = splits[vectors.shape[1]]
        x, bounds, limits = split.rotated(vectors), split.bounds, split.limits(budget)
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        left = np.arange(len(rep)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        own = slice(bounds[block], bounds[block + 1])
        count = np.zeros(len(rep), dtype=np.int64)
        low = np.arange(len(rep))
        edges_a, edges_b = [], []
        square = np.einsum("ij,ij->i", x[:, own], x[:, own])
        for first in range(0, len(left), 256):
            part = left[first : first + 256]
            near = square[part][:, None] + square[right][None, :] - 2 * (x[part, own] @ x[right, own].T) <= limits[block] + 1e-9
            if same:
                near &= right[None, :] > part[:, None]
            a, b = np.nonzero(near)
            for at in range(0, len(a), 50_000):
                i, j = part[a[at : at + 50_000]], right[b[at : at + 50_000]]
                cosine = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norm[i] * norm[j])
                good = (cosine >= threshold) & (rep[i] != rep[j])
                i, j = i[good], j[good]
                if len(limits) > 1:
                    apart = (x[i] - x[j]) ** 2
                    part_sums = np.stack([apart[:, p:q].sum(1) for p, q in zip(bounds[:-1], bounds[1:], strict=True)], axis=1)
                    mine = np.argmax(part_sums <= limits, axis=1) == block
                    i, j = i[mine], j[mine]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                edges_a.append(i)
                edges_b.append(j)
        if edges_a:
            low = least_reachable(len(rep), np.concatenate(edges_a), np.concatenate(edges_b))
        some = np.flatnonzero(count > 0)
        return [rep[some], count[some], rep[low[some]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, pieces = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if sum(len(p[3]) for p in pieces) > 1:
                side, rep, weight, vectors = (np.concatenate([p[k] for p in pieces]) for k in (2, 3, 4, 5))
                order = np.argsort(rep)
                found = links(pieces[0][0], pieces[0][1], side[order], rep[order], weight[order], vectors[order].astype(np.float64))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["rep", "n_links", "low"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tasks, block, side, rep, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "block", "side", "rep", "weight"))
            same = batch.column("same").to_pylist()
            vectors = batch.column("embedding")
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))])
            cut = np.concatenate([[0], np.flatnonzero(tasks[1:] != tasks[:-1]) + 1, [len(tasks)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if tasks[a] != task:
                    yield from close()
                    task, pieces = tasks[a], []
                pieces.append((same[a], int(block[a]), side[a:b].copy(), rep[a:b].copy(), weight[a:b].copy(), flat[ends[a] : ends[b]].copy().reshape(b - a, -1)))
        yield from close()

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.93, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Links and components of rows(vec_id, embedding, label); see the module."""
    # floats widen to the same doubles in the tasks
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(kind).alias("embedding"))
    label = rows.schema["label"].dataType.simpleString()
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).distinct()
    # equal vectors: two independent hashes of all components stand for the vector
    hashed = usable.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2"))
    classes = hashed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    nodes = saved(hashed.join(classes.withColumnRenamed("rep", "vec_id"), ["label", "h1", "h2", "vec_id"]).select("label", F.col("vec_id").alias("rep"), "h1", "weight", "embedding"), "vectors")
    splits = _splits(nodes, threshold, blocks)
    cells = nodes.select("label", "rep", "h1", "embedding").mapInArrow(_cells(splits, 2 - 2 * threshold), f"label {label}, rep long, h1 long, dim int, block int, x int, y int")
    cells = saved(cells, "cells")
    where = ["label", "dim", "block", "x", "y"]
    sizes = cells.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n_tiles"))
    # adjoining cells once: the own cell and the half of the neighbours that comes after it
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    ahead = sizes.withColumn("d", F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps)))).select(
        "label", "dim", "block", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("n_tiles").alias("n0"), (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")
    )
    meet = ahead.join(sizes.withColumnRenamed("n_tiles", "n1"), where)
    own = (F.col("x") == F.col("x0")) & (F.col("y") == F.col("y0"))
    # a visit: one tile of a cell with one tile of its partner
    pairs = (
        meet.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n0") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
        .where(~own | (F.col("i") <= F.col("j")))
        .withColumn("task", F.xxhash64("label", "dim", "block", "x0", "y0", "x", "y", "i", "j")).withColumn("same", own & (F.col("i") == F.col("j")))
    )
    here = pairs.select("label", "dim", "block", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("i").alias("tile"), "task", "same", F.lit(0).alias("side"))
    there = pairs.where("NOT same").select("label", "dim", "block", "x", "y", F.col("j").alias("tile"), "task", "same", F.lit(1).alias("side"))
    routes = here.unionByName(there).groupBy(*where, "tile").agg(F.collect_list(F.struct("task", "same", "side")).alias("visits"))
    tiled = cells.join(sizes, where).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("n_tiles")).cast("int"))
    visits = tiled.join(routes, [*where, "tile"]).select("label", "rep", "h1", "block", F.explode("visits").alias("v")).select("label", "rep", "h1", "block", "v.task", "v.same", "v.side")
    tasks = visits.join(nodes, ["label", "rep", "h1"]).select("task", "side", "same", "block", "rep", "weight", "embedding").repartition("task").sortWithinPartitions("task")
    found = saved(tasks.mapInArrow(_verify(splits, threshold), _FOUND), "links")
    counted = found.groupBy("rep").agg(F.sum("n_links").alias("n"))
    copies = hashed.join(classes, ["label", "h1", "h2"]).where("vec_id > rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    reached = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")).unionByName(copies)).withColumnRenamed("node", "vec_id")
    # repeated vec_ids: links of either of their vectors
    links = hashed.join(classes, ["label", "h1", "h2"]).join(counted, "rep", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = rows.select("vec_id").join(links, "vec_id", "left").join(reached, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
