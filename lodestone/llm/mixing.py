"""Mixing to target weights with soft domain membership.

1. A classifier fitted on the labelled table predicts each document's posterior over the
   domains: clean, low (quality 0) and toxic.
2. Every document gets a nonnegative rate x.  The expected tokens of domain k are the sum over
   documents of tokens * posterior_k * x; projected-gradient least squares brings these totals
   to the targets, starting from rate 1 (the input as it is).  In the metric of a document's tokens
   the step is x <- max(0, x - sum_k posterior_k * (total_k - target_k) / base_k), which cannot overshoot.
3. Every step is one distributed sum of a few numbers.  The driver keeps only the residuals of
   the steps, from which tasks rebuild any document's rate; no table is rewritten.  Steps go on until
   the targets are met or no total moves any more.

Rates become whole copies by a hash of doc_id: the floor, and one more with the
chance of the rest.

Defined results: tokens are words; documents without words keep rate 1 and no
influence; a domain without labels or tokens is left out and the other targets keep their
proportions; null doc_ids and repeated rows get rates each.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import linear
from lodestone.llm import textkernel as tk
from lodestone.llm.sampling import bounded_rows, quoted, unused
from lodestone.runtime import saved

DOMAINS = ("clean", "low", "toxic")
#: Share of all tokens that each domain shall have.
TARGETS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}
#: Labelled rows of each domain that the classifier is fitted on, at most.
MAX_PER_DOMAIN = 2500
#: Steps end where every domain is this near to its target, or where no total moves any more; they are an error beyond MAX_STEPS.
TOLERANCE, STILL, MAX_STEPS = 1e-6, 1e-9, 1000

_MEMBERS = "doc_id long, key long, n_tokens long, posteriors array<double>"


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) with one domain per document; the worst of repeated labels."""
    toxic, quality = F.col("toxic").cast("int"), F.col("quality").cast("int")
    domain = F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


@dataclass
class Membership:
    """Word odds learnt on one half of the sample, a softmax on the other, and the prior shift to the labelled table."""

    words: linear.Lexicon
    softmax: linear.Softmax
    there: list[int]
    shift: np.ndarray

    def posteriors(self, x: linear.Texts) -> np.ndarray:
        z = self.softmax.scores(self.words.with_odds(x)).astype(np.float64) + self.shift
        z = np.exp(z - z.max(1, keepdims=True))
        out = np.zeros((len(x), len(DOMAINS)))
        out[:, self.there] = z / z.sum(1, keepdims=True)
        return out


def train(docs: DataFrame, labels: DataFrame) -> Membership:
    """The domain classifier, fitted on a bounded sample of labelled rows."""
    known, chosen = _labelled(labels), None
    counts = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}  # three numbers
    for k in range(len(DOMAINS)):
        part = known.where(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_DOMAIN)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = bounded_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen)
    y = rows.column("domain").to_numpy().astype(np.int64)
    parts = [linear.read(p.column("text")) for b in rows.combine_chunks().to_batches() for p in tk.chunks(b)]
    x = linear.join_texts(parts or [linear.read(pa.array([], pa.string()))])
    there = sorted(set(y.tolist())) or [0]
    y = np.searchsorted(there, y)
    half = tk.mix(rows.column("doc_id").to_numpy().astype(np.int64).view(tk.U64)) % tk.U64(2) == 0
    first, second = np.flatnonzero(half), np.flatnonzero(~half)
    words = linear.lexicon(x.take(first), y[first], len(there))
    softmax = linear.fit(words.with_odds(x.take(second)), y[second], len(there))
    # the softmax weighs its classes alike; the labelled table tells how common they are
    share = np.array([counts.get(k, 1) for k in there])
    return Membership(words, softmax, there, np.log(share / share.sum()))


def _posteriors(model: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                x = linear.read(part.column("text"))
                p = model.posteriors(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(DOMAINS)), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(np.diff(x.bounds).astype(np.int64)), lists], names=["doc_id", "key", "n_tokens", "posteriors"])

    return run


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    x = np.ones(len(p))
    for step in steps:
        x = np.maximum(0.0, x - p @ step)
    return x


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _totals(steps: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(DOMAINS))
        for batch in batches:
            p = _matrix(batch.column("posteriors"), len(DOMAINS))
            total += (batch.column("n_tokens").to_numpy() * _rates(p, steps)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=list(DOMAINS))

    return run


def _with_rates(steps: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rates(_matrix(batch.column("posteriors"), len(DOMAINS)), steps)
            x[batch.column("n_tokens").to_numpy() == 0] = 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*batch.schema.names, "rate"])

    return run


def solve(members: DataFrame, targets: dict[str, float]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Residual steps of the projected gradient, the totals reached and the targets in tokens."""
    sums = ", ".join(f"{d} double" for d in DOMAINS)

    def total(steps: list[np.ndarray]) -> np.ndarray:
        row = members.mapInArrow(_totals(steps), sums).agg(*(F.coalesce(F.sum(d), F.lit(0.0)).alias(d) for d in DOMAINS)).first()
        return np.array(list(row))

    base = total([])
    there = base > 1e-9
    share = np.array([targets.get(d, 0.0) for d in DOMAINS]) * there
    goal = base.sum() * share / share.sum() if share.sum() else base
    steps: list[np.ndarray] = []
    now, moved = base, np.inf
    while there.any():
        gap = np.where(there, (now - goal) / np.where(there, base, 1), 0.0)
        if np.abs(gap).max() < TOLERANCE or moved < STILL:
            break
        if len(steps) == MAX_STEPS:
            raise RuntimeError(f"the totals {now.tolist()} still move towards {goal.tolist()} after {MAX_STEPS} steps")
        steps.append(gap)
        before, now = now, total(steps)
        moved = float(np.abs(np.where(there, (now - before) / np.where(there, base, 1), 0.0)).max())
    return steps, now, goal


@dataclass
class Totals:
    """Expected tokens of each domain: of the input's targets, and as the rates have them."""

    goal: dict[str, float]
    reached: dict[str, float]
    steps: int

    @property
    def missed(self) -> float:
        """Largest difference of a domain as a share of all tokens; above TOLERANCE only where no rates can meet the targets."""
        return max(abs(self.goal[d] - self.reached[d]) for d in DOMAINS) / max(1.0, sum(self.goal.values()))


def mix_with_totals(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, Totals]:
    """Posteriors, rate and whole copies of every row of docs(doc_id, text), and the totals that the rates reach."""
    model = train(docs, labels)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    members = saved(plain.mapInArrow(_posteriors(model), _MEMBERS), "members")
    steps, now, goal = solve(members, targets or TARGETS)
    rated = members.mapInArrow(_with_rates(steps), f"{_MEMBERS}, rate double")
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "key"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    totals = Totals(*(dict(zip(DOMAINS, x.tolist(), strict=True)) for x in (goal, now)), len(steps))
    return rated.withColumn("copies", copies), totals


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Posteriors, rate and whole copies of every row of docs(doc_id, text); warns if the targets cannot be met."""
    rated, totals = mix_with_totals(docs, labels, targets)
    if totals.missed > 10 * TOLERANCE:
        warnings.warn(f"no rates meet the targets {totals.goal}; reached {totals.reached}", stacklevel=2)
    return rated


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with every row as often as its copies say; columns as given."""
    names = docs.columns
    own_id, own_key, copies, copy = (unused(names, n) for n in ("__id", "__key", "__copies", "__copy"))
    rated = mix(docs, labels, targets).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("copies").cast("int").alias(copies)).dropDuplicates([own_id, own_key])
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    often = docs.join(rated.where(F.col(copies) > 0), own)
    return often.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*map(quoted, names))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    shares = [F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return mix(docs, labels).select("doc_id", "n_tokens", *shares, "rate", "copies")
