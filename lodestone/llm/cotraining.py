"""Quality classifier by co-training.

Two views of a document are learnt apart: its content (hashed words and text statistics) and its
page metadata (source, language, size, compressed size, line layout).  In every round
each view scores all unlabelled documents in one distributed pass, and the rows that it is surest of join, as
pseudo-labels, the training set of the other view.  Both views are then calibrated on labelled rows that neither
has seen, and a weighted mean of their calibrated log odds scores all documents in one pass.

Fitting uses samples bounded in rows and bytes: labelled rows, and of each round the surest rows of each class
and view among all unlabelled documents, found by a distributed top-k.

Defined results: null text is empty; null source or language is its own value; labels with
nulls are ignored, of repeated labels the smaller counts; without labels of both classes every score is the
share of class 1 (0.5 if there is none); null or repeated doc_ids are scored each, a null one gives no
pseudo-label.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import linear
from lodestone.llm import textkernel as tk
from lodestone.llm.sampling import bounded_rows
from lodestone.runtime import saved

#: Labelled rows of each class at most.
MAX_LABELLED = 2000
ROUNDS = 3
#: Pseudo-labels that a view gives per round, split by the class shares: a share of all unlabelled documents, and at most.
SHARE, PER_ROUND = 0.05, 400
CUT = 0.4

_SOURCES = 64
_LANGS = 8


def metadata(columns: dict[str, pa.Array]) -> linear.Texts:
    """Metadata of rows as statistics; no words."""
    texts = columns["text"]
    raw, offsets = tk.string_buffer(texts)
    size = np.diff(offsets)
    data = memoryview(np.ascontiguousarray(raw))
    packed = np.fromiter((len(zlib.compress(data[a:b], 1)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), dtype=np.float64, count=len(size))
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    out = [np.log1p(size), np.log1p(packed), packed / np.maximum(size, 1), np.log1p(lines), np.log1p(size / lines), (packed / np.maximum(size, 1) < 0.35), size < 60]
    for name, slots in (("source", _SOURCES), ("lang", _LANGS)):
        values = [zlib.crc32((x or "").encode()) % slots for x in columns[name].to_pylist()]
        out += list(np.eye(slots, dtype=np.float32)[np.array(values, dtype=np.int64)].T) if len(values) else [np.zeros(0)] * slots
    return linear.Texts(np.stack(out, axis=1).astype(np.float32), np.zeros(0, dtype=tk.U64), np.zeros(len(size) + 1, dtype=np.int64))


def views(batch: pa.RecordBatch) -> tuple[linear.Texts, linear.Texts]:
    return linear.read(batch.column("text")), metadata({n: batch.column(n) for n in ("text", "source", "lang")})


def log_odds(model: linear.Softmax, x: linear.Texts) -> np.ndarray:
    z = model.scores(x).astype(np.float64)
    return z[:, 1] - z[:, 0]


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z))))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt scaling: gradient steps on the mean loss, with Platt's smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    size = max(1e-6, float(np.sqrt(np.mean(z**2))))
    u, slope, shift = z / size, 1.0, 0.0
    for _ in range(2000):
        gap = 1 / (1 + np.exp(-np.clip(slope * u + shift, -40, 40))) - t
        slope, shift = max(1e-3, slope - 2 * float(np.mean(gap * u))), shift - 2 * float(np.mean(gap))
    return slope / size, shift


def balance(z: list[np.ndarray], y: np.ndarray) -> float:
    """Weight of the first view in the mean of two calibrated log odds that has the least loss."""
    shares = np.linspace(0, 1, 21)
    return float(min(shares, key=lambda w: _loss(w * z[0] + (1 - w) * z[1], y)))


@dataclass
class CoTrained:
    models: tuple[linear.Softmax, linear.Softmax] | None
    scaling: tuple[tuple[float, float], ...] = ()
    weight: float = 0.5
    prior: float = 0.5
    exchanged: tuple[int, ...] = ()

    def score(self, both: tuple[linear.Texts, linear.Texts]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata scores."""
        n = len(both[0])
        if self.models is None:
            return (np.full(n, self.prior),) * 3
        z = [log_odds(m, x) * a + b for m, x, (a, b) in zip(self.models, both, self.scaling, strict=True)]
        both_views = self.weight * z[0] + (1 - self.weight) * z[1]
        return tuple(1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (both_views, z[0], z[1]))


Views = tuple[linear.Texts, linear.Texts]
#: Given the two models, the rows each view is surest of: per view (its rows as views, their classes).
Surest = Callable[[tuple[linear.Softmax, linear.Softmax]], list[tuple[Views, np.ndarray]]]


def fit(both: Views, y: np.ndarray, held: np.ndarray, surest: Surest, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on labelled rows that are not held, with the pseudo-labels that `surest` finds each round."""
    prior = float(y.mean()) if len(y) else 0.5
    train = np.flatnonzero(~held)
    if not len(train) or len(set(y[train].tolist())) < 2:
        return CoTrained(None, prior=prior)
    sets = [(both[v].take(train), y[train]) for v in (0, 1)]
    exchanged, models = [], None
    for turn in range(rounds + 1):
        models = tuple(linear.fit(x, t, 2, with_words=v == 0) for v, (x, t) in enumerate(sets))
        if turn == rounds:
            break
        given = surest(models)
        exchanged.append(sum(len(t) for _, t in given))
        if not exchanged[-1]:
            break
        for v, (rows, t) in enumerate(given):
            if len(t):
                other = 1 - v
                sets[other] = (linear.join_texts([sets[other][0], rows[other]]), np.concatenate([sets[other][1], t]))
    check = np.flatnonzero(held)
    if not len(check) or len(set(y[check].tolist())) < 2:
        check = train
    odds = [log_odds(m, both[v].take(check)) for v, m in enumerate(models)]
    scaling = tuple(calibrate(z, y[check]) for z in odds)
    weight = balance([z * a + b for z, (a, b) in zip(odds, scaling, strict=True)], y[check])
    return CoTrained(models, scaling, weight, prior, tuple(exchanged))


def _read(rows: pa.Table) -> Views:
    parts = [views(p) for b in rows.combine_chunks().to_batches() for p in tk.chunks(b)]
    if not parts:
        none = pa.array([], pa.string())
        parts = [views(pa.RecordBatch.from_arrays([none] * 3, names=["text", "source", "lang"]))]
    return tuple(linear.join_texts([p[v] for p in parts]) for v in (0, 1))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


def _odds(models: tuple[linear.Softmax, linear.Softmax]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                z = [log_odds(m, x) for m, x in zip(models, views(part), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.float64()) for x in z)], names=["doc_id", "z0", "z1"])

    return run


def _chooser(docs: DataFrame, known: DataFrame, prior: float) -> Surest:
    """Scores all of docs(doc_id, ..) each round; a document that known(doc_id) lacks gives a pseudo-label, and once."""
    spark, used = docs.sparkSession, []

    def surest(models: tuple[linear.Softmax, linear.Softmax]) -> list[tuple[Views, np.ndarray]]:
        # texts stay where they are: ids with two numbers are dealt
        odds = docs.mapInArrow(_odds(models), "doc_id long, z0 double, z1 double").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1"))
        odds = saved(odds.join(known.select("doc_id"), "doc_id", "left_anti"), "odds")
        each = min(PER_ROUND, SHARE * odds.count())
        many = {0: max(1, round(each * (1 - prior))), 1: max(1, round(each * prior))}
        # bounded: PER_ROUND labels of two views in each round
        odds = odds.join(F.broadcast(spark.createDataFrame([(d,) for d in used], "doc_id long")), "doc_id", "left_anti")
        found = None
        for v in (0, 1):
            z = F.col(f"z{v}")
            for c in (0, 1):
                part = odds.where(z > 0 if c else z < 0).orderBy(z.desc() if c else z.asc(), "doc_id").limit(many[c]).select("doc_id", F.lit(v).alias("view"), F.lit(c).alias("quality"))
                found = part if found is None else found.unionByName(part)
        rows = found.collect()
        # a row of which both views are sure teaches each the other's verdict
        used.extend({r.doc_id for r in rows})
        texts = bounded_rows(docs, spark.createDataFrame([(d,) for d in sorted({r.doc_id for r in rows})], "doc_id long"))
        where = {d: i for i, d in enumerate(texts.column("doc_id").to_pylist())}
        both, out = _read(texts), []
        for v in (0, 1):
            own = sorted((where[r.doc_id], r.quality) for r in rows if r.view == v and r.doc_id in where)
            at = np.array([i for i, _ in own], dtype=np.int64)
            out.append((tuple(x.take(at) for x in both), np.array([c for _, c in own], dtype=np.int64)))
        return out

    return surest


def train(docs: DataFrame, labels: DataFrame) -> CoTrained:
    docs = _plain(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = bounded_rows(docs, chosen)
    quality = rows.column("quality").to_numpy().astype(np.int64)
    held = tk.mix(rows.column("doc_id").to_numpy().astype(np.int64).view(tk.U64)) % tk.U64(4) == 0
    return fit(_read(rows), quality, held, _chooser(docs, known, float(quality.mean()) if len(quality) else 0.5))


def _score(model: CoTrained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                scores = model.score(views(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s) for s in scores)], names=["doc_id", "score", "content_score", "metadata_score"])

    return run


def classify(docs: DataFrame, model: CoTrained) -> DataFrame:
    """Scores of every row of docs(doc_id, text, source, lang); kept at a score of CUT or more."""
    scored = _plain(docs).mapInArrow(_score(model), "doc_id long, score double, content_score double, metadata_score double")
    return scored.withColumn("kept", F.col("score") >= CUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
