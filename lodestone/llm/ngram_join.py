"""N-gram Jaccard self-join by a MinHash LSH forest and exact verification.

1. Profile: texts with equal word sequences (128-bit digests) form one class.  A class has the set of its
   five-word shingles (a shorter text is one shingle) and, per tree of the forest, a signature: a path of
   minima.  The signatures of a tree are a prefix trie; a node is a prefix.
2. Descent: prefixes begin at `longest` minima.  Classes that share a node are candidates.
3. Groups: every node is led by its smallest class; classes of one leader meet once instead of
   once per tree.  A group is split into tiles, and pairs of tiles are spread over tasks, so a
   group of any size has bounded tasks.
4. Verification: a task intersects whole shingle sets of its tiles (64-bit shingles).  A pair is counted
   in the group of its smallest common leader only; tasks emit counts per class and a local spanning
   forest, never the pairs.
5. Recall: the trees are independent captures of one pair, so the linked pairs that one tree and that two trees
   have at this length tell how many none has (Chao's estimate).  While the recall measured so is
   below `target_recall`, every prefix is shortened by one minimum and the join goes on with the shorter prefixes.
6. Components of the forest edges give the class ids.

At 40 trees and 7 minima a pair at a similarity of exactly 0.8 is missed with a chance of 8e-5, one at 0.85 of
2e-7.

Result: one row per document: class_id, the smallest doc_id reachable by links, itself included;
n_links, the other documents linked directly, copies included; text_id, the smallest doc_id with the
same words; kept, whether doc_id is class_id.

Defined results: a text without words (or null) links with nothing and is its own class; a
null doc_id has null ids, no links and is kept; rows sharing a doc_id count as one document, and of its texts
the one with the smallest hash meets others than its copies; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkernel as tk
from lodestone.llm.components import components
from lodestone.llm.sampling import quoted, unused
from lodestone.runtime import saved

SHINGLE = 5
TREES, LONGEST = 40, 7
#: Classes and shingles of a tile; two tiles meet in one task at a time.
TILE_ROWS, TILE_SHINGLES = 128, 200_000

_PROFILE = "doc_id long, key long, t1 long, t2 long, n_shingles int, prefixes array<long>"
_FOUND = "rep long, n_links long, low long, pairs long, once long, twice long"
_FOUND_NAMES = ["rep", "n_links", "low", "pairs", "once", "twice"]


def measured_recall(pairs: int, once: int, twice: int) -> float:
    """Chao's estimate: the share of all pairs that some tree has, of which `once` are in one tree and `twice` in two."""
    missed = once * (once - 1) / (2 * (twice + 1))
    return pairs / (pairs + missed) if pairs else 1.0


def shingles(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted inside each row, and the row bounds."""
    hashes = words.hashes(0)
    first, bounds = tk.grams(words.rows, SHINGLE)
    n = words.counts()
    grams = tk.spans_hash(hashes, first, first + SHINGLE, 1)
    row = np.repeat(np.arange(len(n)), np.diff(bounds))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        grams = np.concatenate([grams, tk.spans_hash(hashes, words.rows[short], words.rows[short] + n[short], 1)])
        row = np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    once = np.ones(len(grams), dtype=bool)
    once[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[once], row[once]
    return grams, np.searchsorted(row, np.arange(len(n) + 1))


def _signatures(grams: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Prefix hash of each row (all with shingles) in each tree."""
    rng = np.random.default_rng(5)
    scale = rng.integers(0, 1 << 31, size=(trees, depth), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, size=(trees, depth), dtype=np.int64).astype(np.uint32)
    x = (grams >> tk.U64(32)).astype(np.uint32)
    starts = bounds[:-1]
    out = np.empty((len(starts), trees), dtype=tk.U64)
    work = np.empty_like(x)
    for t in range(trees):
        label = np.full(len(starts), 1 + t, dtype=tk.U64)
        for d in range(depth):
            np.multiply(x, scale[t, d], out=work)
            np.add(work, shift[t, d], out=work)
            # linear hashes keep order relations between trees; a shift-xor breaks them
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            np.multiply(work, np.uint32(0x85EBCA6B), out=work)
            label = tk.mix(label * tk.U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, starts).astype(tk.U64))
        out[:, t] = label
    return out


def _profile(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(*tk.string_buffer(part.column("text")))
                grams, bounds = shingles(words)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                labels = np.zeros((0, trees), dtype=tk.U64)
                if len(full):
                    labels = _signatures(grams, np.append(bounds[full], bounds[-1]), trees, depth)
                many = np.zeros(len(n) + 1, dtype=np.int32)
                many[1:][full] = trees
                one, two = words.digests(words.rows[:-1], words.rows[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array(tk.signed(one)),
                        pa.array(tk.signed(two)),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(many).astype(np.int32)), pa.array(tk.signed(labels.reshape(-1)))),
                    ],
                    names=["doc_id", "key", "t1", "t2", "n_shingles", "prefixes"],
                )

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]], dtype=np.int64)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    row, column = row[common], column[common]
    out = np.zeros((n, n), dtype=np.float64)
    if len(row):
        column = np.cumsum(np.append(0, column[1:] != column[:-1]))
        width = max(1, 4_000_000 // n)
        for first in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [first, first + width])
            block = np.zeros((n, min(width, int(column[-1]) + 1 - first)), dtype=np.float32)
            block[row[a:b], column[a:b] - first] = 1
            out += block @ block.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def least_reachable(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    low = np.arange(n)
    while len(left):
        before = low.copy()
        np.minimum.at(low, left, low[right])
        np.minimum.at(low, right, low[left])
        low = low[low]
        if np.array_equal(before, low):
            break
    return low


def _smallest_common(lists: list[list[int]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest value that lists[x] and lists[y] share, for each pair; they share one."""
    values, at = np.unique(np.concatenate([np.asarray(v, dtype=np.int64) for v in lists]), return_inverse=True)
    held = np.zeros((len(lists), len(values)), dtype=bool)
    held[np.repeat(np.arange(len(lists)), [len(v) for v in lists]), at] = True
    step = max(1, 8_000_000 // len(values))
    return np.concatenate([values[np.argmax(held[x[i : i + step]] & held[y[i : i + step]], axis=1)] for i in range(0, len(x), step)])


def _verify(threshold: float):
    def links(group: tuple, members: list[tuple]) -> list[list[int]]:
        leader, i, j = group
        members.sort(key=lambda m: m[0])
        reps = np.array([m[0] for m in members])
        tile = np.array([m[1] for m in members])
        weight = np.array([m[2] for m in members])
        sizes = np.array([len(m[5]) for m in members])
        shared = _overlaps([m[5] for m in members])
        near = np.triu(shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9, 1)
        if i != j:
            near &= tile[:, None] != tile[None, :]
        x, y = np.nonzero(near)
        if not len(x):
            return [[] for _ in _FOUND_NAMES]
        low = least_reachable(len(reps), x, y)
        if any(len(m[3]) > 1 for m in members):
            mine = _smallest_common([m[3] for m in members], x, y) == leader
            x, y = x[mine], y[mine]
        trees = _overlaps([np.sort(np.asarray(m[4], dtype=np.int64)) for m in members])[x, y]
        count = np.bincount(x, weight[y], len(reps)) + np.bincount(y, weight[x], len(reps))
        of_pairs = [np.bincount(x[k], minlength=len(reps)) for k in (trees > 0, trees == 1, trees == 2)]
        some = np.flatnonzero((count > 0) | (low != np.arange(len(reps))))
        return [c[some].astype(np.int64).tolist() for c in (reps, count, reps[low], *of_pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, out = None, [], [[] for _ in _FOUND_NAMES]

        def close() -> None:
            if len(members) > 1:
                for into, values in zip(out, links(group, members), strict=True):
                    into.extend(values)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=_FOUND_NAMES)

        for batch in batches:
            for part in tk.chunks(batch):
                grams, bounds = shingles(tk.Words(*tk.string_buffer(part.column("text"))))
                columns = [part.column(c).to_pylist() for c in ("leader", "i", "j", "rep", "tile", "weight", "leaders", "nodes")]
                for k, (leader, i, j, rep, tile, weight, leaders, nodes) in enumerate(zip(*columns, strict=True)):
                    if (leader, i, j) != group:
                        close()
                        group, members, seen = (leader, i, j), [], set()
                    if rep not in seen:
                        seen.add(rep)
                        members.append((rep, tile, weight, leaders, nodes, grams[bounds[k] : bounds[k + 1]].copy()))
                if len(out[0]) > 10_000:
                    yield flush()
                    out = [[] for _ in _FOUND_NAMES]
        close()
        yield flush()

    return run


def _links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Verified links of the classes that share a trie node, as counts and spanning edges."""
    placed = nodes.select("rep", F.explode("prefixes").alias("node"))
    led = placed.groupBy("node").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").drop("last")
    matched = saved(placed.join(led, "node"), "matched")
    member = matched.select("leader", "rep").distinct()
    size = member.join(nodes.select("rep", "n_shingles"), "rep").groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    # only groups of several tiles are listed, so that a large group meets one row of a plain table in a join that can be split
    tiles = size.select("leader", F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int").alias("n_tiles"))
    tiles = saved(tiles.where("n_tiles > 1"), "tiles")
    own_tile = F.pmod(F.xxhash64("rep", "leader"), F.col("n_tiles")).cast("int")
    visits = F.transform(
        F.sequence(F.lit(0), F.col("n_tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j"))
    )
    # a class has at most one node in each tree
    routes = (
        matched.join(tiles, "leader", "left").withColumn("n_tiles", F.coalesce("n_tiles", F.lit(1))).withColumn("tile", own_tile)
        .groupBy("rep").agg(F.collect_set(F.struct("leader", "tile", "n_tiles")).alias("routes"), F.collect_list("node").alias("nodes"))
    )
    wanted = nodes.select("rep", "key", "weight").join(routes, "rep")
    pairs = (
        docs.withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "key"])
        .select("rep", "weight", "text", "nodes", F.transform("routes", lambda r: r["leader"]).alias("leaders"), F.explode("routes").alias("r"))
        .select("rep", "weight", "text", "nodes", "leaders", "r.leader", "r.tile", "r.n_tiles")
        .withColumn("visit", F.explode(visits))
        .select("leader", "visit.i", "visit.j", "rep", "tile", "weight", "leaders", "nodes", "text")
        .repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    )
    return saved(pairs.mapInArrow(_verify(threshold), _FOUND), "links")


def join(docs: DataFrame, threshold: float = 0.8, trees: int = TREES, longest: int = LONGEST, target_recall: float = 0.9999) -> DataFrame:
    """Links and classes of docs(doc_id, text); see the module for the result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    for depth in range(longest, 0, -1):
        profile = saved(docs.mapInArrow(_profile(trees, depth), _PROFILE), "profiles")
        named = profile.where("doc_id IS NOT NULL AND n_shingles > 0")
        classes = named.select("doc_id", "t1", "t2").distinct().groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
        nodes = named.withColumnRenamed("doc_id", "rep").join(classes, ["t1", "t2", "rep"]).groupBy("rep").agg(F.min(F.struct("key", "weight", "n_shingles", "prefixes")).alias("own")).select("rep", "own.*")
        found = _links(docs, nodes, threshold)
        seen = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "once", "twice"))).first()
        if measured_recall(seen.pairs, seen.once, seen.twice) >= target_recall:
            break
    counted = found.groupBy("rep").agg(F.sum("n_links").alias("n"))
    reached = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v"))).withColumnRenamed("node", "rep")
    settled = classes.join(counted, "rep", "left").join(reached, "rep", "left").select(
        "t1", "t2", F.col("rep").alias("text_id"), F.coalesce("component", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    alone = profile.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("text_id")
    )
    joined = named.join(settled, ["t1", "t2"]).select("doc_id", "key", "class_id", "n_links", "text_id")
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, once; columns as given."""
    names = docs.columns
    own_id, own_key = unused(names, "__id"), unused(names, "__key")
    kept = join(docs, **options).where("kept").select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).distinct()
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    # repeated rows of a kept document: one of them stays; rows without id stay
    rows = docs.join(kept, own).select(*map(quoted, names))
    return rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(rows.where("doc_id IS NULL"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "text_id", "kept")
