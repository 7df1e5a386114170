"""Toxicity by a small convolutional text classifier, trained in numpy.

A token is the sum of two hashed embeddings, its lower-cased word and the word's first bytes.
Filters of widths 1, 2 and 3 slide over the whole text, max pooling keeps the strongest place of
each, and a logistic layer makes the score.  Everything is learnt from all labelled rows that may be learnt
from: words are counted by an aggregation; rows are dealt by hash to parts of about PART_ROWS, in every epoch each
part goes through its mini-batches from the shared model, and the mean of the parts' parameters is the next one (a
vector's over the parts that moved it).  Parts depend on ids and texts only, and the means are sums of integers, so the model
does not depend on how tables are split.  Scoring is one pass over all texts without a shuffle, where a
filter's response to a token is looked up instead of multiplied out.

The score sees the text only.  Thresholds are calibrated on a held-back quarter of the labelled rows:
the one of best F1 is mapped to a score of 0.7, and every language has its own threshold beside
it (column `lang_threshold`, used by `flagged` only).

Defined results: texts without words (or null) score as the bias says; without labels of both
classes every score is 0; without a word in three training rows scores are constant; labels with nulls are ignored, of repeated labels the larger counts; all rows
of a repeated doc_id have its label, and null or repeated doc_ids are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lodestone.llm import textkernel as tk

#: Labelled ids in a part that trains by itself within an epoch, about.
PART_ROWS = 4096
#: Labelled ids that go to the driver and to each executor at most, nine bytes each, to find their rows; more are joined by a shuffle.
BROADCAST_IDS = 1 << 24
EPOCHS, RATE, BATCH = 4, 0.02, 32
#: A word is known from so many training rows on.
LEAST = 3
#: Entries of word counts that a task gathers before it sends them on.
COUNTED = 1 << 20
#: Parameters are averaged as integers, of which one is this many.
FIXED = 2.0**36
DIM, FILTERS, WIDTHS = 8, 4, (1, 2, 3)
STEM_BYTES = 5
SLOTS_BITS = 22

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lower(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, whose second byte follows 0xC3."""
    out = _LOWER[raw]
    second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[second] += 32
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, hashes of their stems, and the row bounds."""
    raw, offsets = tk.string_buffer(column)
    words = tk.Words(_lower(raw) if len(raw) else raw, offsets, _SEPARATORS)
    stem_end = np.minimum(words.end, words.start + STEM_BYTES)
    return words.hashes(0), tk.bytes_hash(words.raw, words.start, stem_end, 1) | tk.U64(1), words.rows


def all_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens() of many rows, in pieces of bounded size."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [tokens(part.column("text")) for part in tk.chunks(batch)] or [tokens(texts)]
    counts = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Model:
    """Embeddings of the known hashes (row 0: unknown), filters and the logistic layer."""

    known: np.ndarray
    vectors: np.ndarray
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    biases: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    lang_thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding rows; a slot table leads to the first of the sorted hashes that begin alike, the others follow it."""
        if not hasattr(self, "_slots"):
            self._slots = np.zeros(1 << SLOTS_BITS, dtype=np.int32)
            self._slots[(self.known >> tk.U64(64 - SLOTS_BITS)).astype(np.int64)[::-1]] = np.arange(len(self.known), 0, -1, dtype=np.int32)
        if not len(self.known):
            return np.zeros(len(hashes), dtype=np.int64)
        found = self._slots[(hashes >> tk.U64(64 - SLOTS_BITS)).astype(np.int64)]
        out = np.where(self.known[found - 1] == hashes, found, 0)
        rest = np.flatnonzero((out == 0) & (found > 0))
        at = found[rest].astype(np.int64)  # the next one's place in known
        while len(rest):
            inside = at < len(self.known)
            rest, at = rest[inside], at[inside]
            inside = (self.known[at] >> tk.U64(64 - SLOTS_BITS)) == (hashes[rest] >> tk.U64(64 - SLOTS_BITS))
            rest, at = rest[inside], at[inside]
            same = self.known[at] == hashes[rest]
            out[rest[same]] = at[same] + 1
            rest, at = rest[~same], at[~same] + 1
        return out

    def pooled(self, words: np.ndarray, stems: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Strongest response of every filter in each row."""
        if not hasattr(self, "_responses"):
            self._responses = np.concatenate([self.vectors @ self.filters[w][o] for w in WIDTHS for o in range(w)], axis=1)
        full = np.flatnonzero(np.diff(bounds))
        out = np.zeros((len(bounds) - 1, len(WIDTHS) * FILTERS), dtype=np.float32)
        if not len(full):
            return out
        starts = bounds[full]
        response = self._responses[self.rows(words)] + self._responses[self.rows(stems)]
        ends = bounds[1:][full]
        column = 0
        for k, width in enumerate(WIDTHS):
            total = response[:, column : column + FILTERS].copy()
            for o in range(1, width):
                part = response[o:, column + o * FILTERS : column + (o + 1) * FILTERS]
                shifted = np.zeros_like(total)
                shifted[: len(part)] = part
                for back in range(o):  # a row's last words have no o-th word after them
                    inside = ends - 1 - back >= starts
                    shifted[ends[inside] - 1 - back] = 0
                total += shifted
            column += width * FILTERS
            out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(total, starts, axis=0)
        for k, width in enumerate(WIDTHS):
            out[full, k * FILTERS : (k + 1) * FILTERS] += self.biases[width]
        return np.maximum(out, 0)

    def raw_score(self, words, stems, bounds) -> np.ndarray:
        return self.pooled(words, stems, bounds) @ self.weights + self.bias

    def score(self, words, stems, bounds) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(bounds) - 1)
        z = self.raw_score(words, stems, bounds).astype(np.float64) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gather(parts: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, stems, bounds = parts
    n = np.diff(bounds)[rows]
    at = np.repeat(bounds[:-1][rows], n) + tk.ragged(n)
    return words[at], stems[at], np.concatenate([[0], np.cumsum(n)])


def _row_counts(hashes: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the numbers of rows, and of rows of class 1, that have them."""
    order = np.lexsort((doc, hashes))
    own, docs = hashes[order], doc[order]
    once = np.ones(len(own), dtype=bool)
    once[1:] = (own[1:] != own[:-1]) | (docs[1:] != docs[:-1])
    own, docs = own[once], docs[once]
    known, first, count = np.unique(own, return_index=True, return_counts=True)
    return known, count, np.add.reduceat(y[docs], first) if len(first) else np.zeros(0)


def _known(parts: tuple, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and stems in LEAST rows or more, in order, with their counts."""
    words, stems, bounds = parts
    doc = np.repeat(np.arange(len(y)), np.diff(bounds))
    found = [tuple(x[k >= LEAST] for x in (h, k, t)) for h, k, t in (_row_counts(own, doc, y) for own in (words, stems))]
    known, count, toxic = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(known, kind="stable")
    return known[order], count[order], toxic[order]


def _start(known: np.ndarray, count: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int, rng: np.random.Generator) -> Model:
    """A model of known hashes with log odds of class 1 as first coordinate."""
    odds = np.log((toxic + 0.1) / n_toxic) - np.log((count - toxic + 0.5) / (n - n_toxic))
    vectors = rng.normal(0, 0.05, (len(known) + 1, DIM)).astype(np.float32)
    vectors[1:, 0] = np.clip(odds, -1, 6) / 3
    vectors[0] = 0
    model = Model(known, vectors)
    for width in WIDTHS:
        model.filters[width] = rng.normal(0, 0.1, (width, DIM, FILTERS)).astype(np.float32)
        model.filters[width][:, 0, 0] = 1.0 / width
        model.biases[width] = np.zeros(FILTERS, dtype=np.float32)
    model.weights = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    model.weights[::FILTERS] = 1.0
    model.bias = -2.0
    return model


def _step(model: Model, parts: tuple, y: np.ndarray, weight: np.ndarray, rate: float, memory: dict) -> np.ndarray:
    """One mini-batch; Adagrad on every parameter.  The rows of the vectors that it has moved."""
    step = lambda name, value, grad: _adagrad(memory, name, value, grad, rate)
    words, stems, bounds = parts
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return np.zeros(0, dtype=np.int64)
    w_rows, s_rows = model.rows(words), model.rows(stems)
    x = model.vectors[w_rows] + model.vectors[s_rows]
    pooled = np.zeros((len(y), len(WIDTHS) * FILTERS), dtype=np.float32)
    place = np.zeros((len(y), len(WIDTHS) * FILTERS), dtype=np.int64)
    for k, width in enumerate(WIDTHS):
        for d in full:
            own = x[bounds[d] : bounds[d + 1]]
            z = own @ model.filters[width][0]
            for o in range(1, width):
                if len(own) > o:
                    z[:-o] += own[o:] @ model.filters[width][o]
            at = z.argmax(0)
            pooled[d, k * FILTERS : (k + 1) * FILTERS] = z[at, np.arange(FILTERS)] + model.biases[width]
            place[d, k * FILTERS : (k + 1) * FILTERS] = at + bounds[d]
    active = pooled > 0
    pooled = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
    g = ((p - y) * weight).astype(np.float32) / len(y)
    back = g[:, None] * model.weights[None, :] * active
    grads_x: dict[int, np.ndarray] = {}
    for k, width in enumerate(WIDTHS):
        grad_f = np.zeros_like(model.filters[width])
        for d in full:
            for f in range(FILTERS):
                b = back[d, k * FILTERS + f]
                if b:
                    at = place[d, k * FILTERS + f]
                    for o in range(min(width, bounds[d + 1] - at)):
                        grad_f[o, :, f] += b * x[at + o]
                        gx = b * model.filters[width][o][:, f]
                        grads_x[at + o] = grads_x[at + o] + gx if at + o in grads_x else gx
        model.filters[width] = step(("f", width), model.filters[width], grad_f)
        model.biases[width] = step(("b", width), model.biases[width], back[:, k * FILTERS : (k + 1) * FILTERS].sum(0))
    model.weights = step("w", model.weights, pooled.T @ g)
    model.bias = float(step("c", np.array([model.bias], dtype=np.float32), g.sum(keepdims=True))[0])
    moved = [np.zeros(0, dtype=np.int64)]
    if "e" not in memory:
        memory["e"] = np.full(model.vectors.shape, 1e-4, dtype=np.float32)
    if grads_x:
        at = np.fromiter(grads_x, dtype=np.int64)
        gx = np.stack(list(grads_x.values()))
        for rows in (w_rows[at], s_rows[at]):
            some = rows > 0
            old = memory["e"]
            np.add.at(old, rows[some], gx[some] ** 2)
            np.add.at(model.vectors, rows[some], -rate * gx[some] / np.sqrt(old[rows[some]]))
            moved.append(rows[some])
    return np.concatenate(moved)


def _epoch(model: Model, parts: tuple, y: np.ndarray, weight: np.ndarray, order: np.ndarray, rate: float, memory: dict) -> None:
    """One pass of mini-batches."""
    for first in range(0, len(order), BATCH):
        pick = order[first : first + BATCH]
        _step(model, _gather(parts, pick), y[pick], weight[pick], rate, memory)


def _adagrad(memory: dict, name, value: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
    memory[name] = (memory[name] if name in memory else np.full(value.shape, 1e-4, dtype=np.float32)) + grad**2
    return value - rate * grad / np.sqrt(memory[name])


def best_threshold(z: np.ndarray, y: np.ndarray) -> float | None:
    """The middle between the two scores where F1 is best."""
    if not y.any() or y.all():
        return None
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(z[order][1:] != z[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    return float((z[order][k] + below) / 2)


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, langs: np.ndarray) -> None:
    """Map the raw score of best F1 to 0.7, and find the threshold of each language with 20 rows of class 1."""
    cut = best_threshold(z, y)
    spread = max(1e-3, float(z[y == 1].mean() - z[y == 0].mean()))
    model.slope = 6.0 / spread
    model.shift = float(np.log(0.7 / 0.3) - cut * model.slope)
    score = 1 / (1 + np.exp(-np.clip(z * model.slope + model.shift, -40, 40)))
    for lang in sorted(set(langs)):
        inside = langs == lang
        if y[inside].sum() >= 20:
            model.lang_thresholds[lang] = best_threshold(score[inside], y[inside])


def _blank() -> Model:
    return Model(np.zeros(0, dtype=tk.U64), np.zeros((1, DIM), dtype=np.float32))


def fit(texts: pa.Array, y: np.ndarray, langs: list[str], held: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Train on the given rows that are not held, calibrate on those that are; train() does so for tables."""
    rng = np.random.default_rng(11)
    y = np.asarray(y, dtype=np.float64)
    if not len(y) or y.all() or not y.any() or not y[~held].any() or y[~held].all():
        return _blank()
    parts = all_tokens(texts)
    train, check = np.flatnonzero(~held), np.flatnonzero(held)
    model = _start(*_known(_gather(parts, train), y[train]), len(train), int(y[train].sum()), rng)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    memory: dict = {}
    for _ in range(epochs):
        _epoch(model, parts, y, weight, rng.permutation(train), rate, memory)
    check = check if len(check) and y[check].any() and not y[check].all() else train
    z = model.raw_score(*_gather(parts, check)).astype(np.float64)
    _calibrate(model, z, y[check], np.array([x or "" for x in langs], dtype=object)[check])
    return model


def _labelled(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt, one for each doc_id, and whether a row is held back for the thresholds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            held = tk.mix(ids.view(tk.U64)) % tk.U64(4) == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held)], names=["doc_id", "toxic", "held"])

    return known.mapInArrow(hold, "doc_id long, toxic int, held boolean")


_COUNTS = ["kind", "hash", "n", "toxic"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, and rows of class 1, that have each word (kind 0) and stem (kind 1)."""
    gathered: list[list[tuple]] = [[], []]

    def sent() -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(gathered):
            if parts:
                hashes, count, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
                known, place = np.unique(hashes, return_inverse=True)
                sums = [np.bincount(place, x, len(known)).astype(np.int64) for x in (count, toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), kind, dtype=np.int32)), pa.array(known.view(np.int64)), *map(pa.array, sums)], names=_COUNTS)
            parts.clear()

    for batch in batches:
        for part in tk.chunks(batch):
            words, stems, bounds = tokens(part.column("text"))
            y = part.column("toxic").to_numpy().astype(np.float64)
            doc = np.repeat(np.arange(len(y)), np.diff(bounds))
            for kind, own in enumerate((words, stems)):
                gathered[kind].append(_row_counts(own, doc, y))
            if sum(len(x[0]) for parts in gathered for x in parts) >= COUNTED:
                yield from sent()
    yield from sent()


def _mini_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BATCH rows of one part at a time, of rows sorted by part; wherever the given batches end."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        part, first = rows.column("part").to_numpy(), 0
        while first < rows.num_rows:
            end = int(np.searchsorted(part, part[first], side="right"))
            last = min(end, first + BATCH)
            if last == rows.num_rows and last < first + BATCH:
                break  # more rows of this part may follow
            yield rows.slice(first, last - first)
            first = last
        rest = rows.slice(first) if first < rows.num_rows else None
    if rest is not None:
        yield rest


#: Parameters that all words share; filters and biases are kept by width.
_SHARED = [*(("f", w) for w in WIDTHS), *(("b", w) for w in WIDTHS), "w", "c"]
_FIELDS = [f"{kind}{i}" for kind in "vm" for i in range(DIM)]


def _get(model: Model, name) -> np.ndarray:
    if isinstance(name, tuple):
        return (model.filters if name[0] == "f" else model.biases)[name[1]]
    return model.weights if name == "w" else np.array([model.bias], dtype=np.float32)


def _put(model: Model, name, value: np.ndarray) -> None:
    if isinstance(name, tuple):
        (model.filters if name[0] == "f" else model.biases)[name[1]] = value
    elif name == "w":
        model.weights = value
    else:
        model.bias = float(value[0])


def _lines(values: list[np.ndarray]) -> np.ndarray:
    """Shared parameters as rows of DIM."""
    flat = np.concatenate([v.ravel() for v in values])
    return np.concatenate([flat, np.zeros(-len(flat) % DIM, dtype=flat.dtype)]).reshape(-1, DIM)


def _learn(begin, weights: tuple[float, float], rate: float):
    """Each part's parameters after one pass over its rows: its moved vectors by row, shared ones as rows -1, -2, ..; as integers.

    begin is the broadcast model and Adagrad sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = begin.value
        own = Model(model.known, model.vectors.copy())
        past = memory["e"].copy()
        part, state, moved = None, {}, []

        def ended() -> pa.RecordBatch:
            rows = np.unique(np.concatenate(moved))
            shared = [_lines([_get(own, name) for name in _SHARED]), _lines([state[name] for name in _SHARED])]
            values = np.concatenate([np.concatenate([own.vectors[rows], past[rows]], axis=1), np.concatenate(shared, axis=1)])
            fixed = np.rint(values.astype(np.float64) * FIXED).astype(np.int64)
            names = np.concatenate([rows, -1 - np.arange(len(shared[0]))])
            own.vectors[rows], past[rows] = model.vectors[rows], memory["e"][rows]
            return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(np.ascontiguousarray(x)) for x in fixed.T)], names=["row", *_FIELDS])

        for rows in _mini_batches(batches):
            if part != (part := rows.column("part")[0].as_py()):
                if moved:
                    yield ended()
                moved = [np.zeros(0, dtype=np.int64)]
                for name in _SHARED:
                    _put(own, name, _get(model, name).copy())
                state = {**memory, "e": past}
            y = rows.column("toxic").to_numpy().astype(np.float64)
            moved.append(_step(own, all_tokens(rows.column("text")), y, np.where(y == 1, weights[1], weights[0]), rate, state))
        if moved:
            yield ended()

    return run


def _learn_once(rows: DataFrame, model: Model, memory: dict, weights: tuple[float, float], rate: float) -> None:
    """One epoch: the mean of the parts' parameters and Adagrad sums."""
    begin = rows.sparkSession.sparkContext.broadcast((model, memory))
    made = rows.mapInArrow(_learn(begin, weights, rate), "row long, " + ", ".join(f"{f} long" for f in _FIELDS))
    # sums of integers are the same in any order
    mean = made.groupBy("row").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in _FIELDS))
    found = mean.select("row", *((F.col(f) / F.col("n") / FIXED).cast("float").alias(f) for f in _FIELDS)).toArrow().sort_by("row")
    begin.destroy()  # else its files stay on every executor's disk
    at = found.column("row").to_numpy()
    values = np.stack([found.column(f).to_numpy() for f in _FIELDS], axis=1).reshape(-1, 2, DIM)
    vectors = at >= 0
    model.vectors[at[vectors]], memory["e"][at[vectors]] = values[vectors, 0], values[vectors, 1]
    flat, first = values[~vectors][::-1], 0
    flat = [flat[:, k].ravel() for k in (0, 1)]
    for name in _SHARED:
        old = _get(model, name)
        new, past = (x[first : first + old.size].reshape(old.shape) for x in flat)
        _put(model, name, new.copy())
        memory[name] = past.copy()
        first += old.size


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                z = model.raw_score(*tokens(part.column("text"))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(z)], names=["lang", "toxic", "z"])

    return run


def _among(given):
    """Rows whose doc_id is given, with their label and whether they are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks = given.value
        for batch in batches:
            own = batch.column("doc_id").to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            found = ids[at] == own
            mark = marks[at[found]]
            columns = [*batch.filter(pa.array(found)).columns, pa.array((mark & 1).astype(np.int32)), pa.array(mark > 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "lang", "toxic", "held"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all labelled rows that may be learnt and are not held, calibrate on all that are held."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    docs = docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    known = _labelled(labels)
    n_ids, given = known.count(), None
    if not n_ids:
        return _blank()
    if n_ids <= BROADCAST_IDS:
        table = known.toArrow().sort_by("doc_id")
        marks = table.column("toxic").to_numpy().astype(np.uint8) + 2 * table.column("held").to_numpy().astype(np.uint8)
        given = docs.sparkSession.sparkContext.broadcast((table.column("doc_id").to_numpy(), marks))
        rows = docs.mapInArrow(_among(given), "doc_id long, text string, lang string, toxic int, held boolean")
    else:
        rows = docs.join(known, "doc_id")
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text")).withColumn("part", F.pmod("place", F.lit(-(-n_ids // PART_ROWS))))
    rows = rows.repartition("part").sortWithinPartitions("part", "place", "doc_id").select("part", "text", "lang", "toxic", "held").persist(StorageLevel.DISK_ONLY)
    try:
        return _trained(rows)
    finally:
        rows.unpersist()
        if given is not None:
            given.destroy()


def _trained(rows: DataFrame) -> Model:
    sizes = {r.held: (r.n, r.toxic) for r in rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).collect()}
    n, n_toxic = sizes.get(False, (0, 0))
    n_held, held_toxic = sizes.get(True, (0, 0))
    if not 0 < n_toxic < n:
        return _blank()
    taught = rows.where("NOT held")
    counts = taught.select("text", "toxic").mapInArrow(_count, "kind int, hash long, n long, toxic long")
    counts = counts.groupBy("kind", "hash").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST).toArrow()
    kind, hashes, count, toxic = (counts.column(c).to_numpy() for c in _COUNTS)
    hashes = hashes.astype(np.int64).view(tk.U64)
    order = np.lexsort((kind, hashes))
    model = _start(hashes[order], count[order], toxic[order], n, n_toxic, np.random.default_rng(11))
    every, positive = n + n_held, n_toxic + held_toxic
    weights = every / (2 * (every - positive)), every / (2 * positive)
    memory = {name: np.full(_get(model, name).shape, 1e-4, dtype=np.float32) for name in _SHARED} | {"e": np.full(model.vectors.shape, 1e-4, dtype=np.float32)}
    for _ in range(EPOCHS):
        _learn_once(taught.select("part", "text", "toxic"), model, memory, weights, RATE)
    check = rows.where("held") if 0 < held_toxic < n_held else taught
    found = check.select("text", "lang", "toxic").mapInArrow(_raw(model), "lang string, toxic int, z double").toArrow()
    z, y = found.column("z").to_numpy(), found.column("toxic").to_numpy()
    langs = np.array([x or "" for x in found.column("lang").to_pylist()], dtype=object)
    order = np.lexsort((y, z))
    _calibrate(model, z[order], y[order], langs[order])
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                scores = model.score(*tokens(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(scores)], names=["doc_id", "lang", "score"])

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Score, prediction and the verdict under the language's own threshold of docs(doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    scored = docs.mapInArrow(_score(model), "doc_id long, lang string, score double")
    limit = F.lit(model.threshold)
    for lang, value in model.lang_thresholds.items():
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return scored.withColumn("predicted", (F.col("score") >= model.threshold).cast("int")).withColumn("lang_threshold", limit).withColumn("flagged", F.col("score") >= F.col("lang_threshold"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return classify(docs, model).select("doc_id", held_out, "score", "predicted", "lang_threshold", "flagged")
