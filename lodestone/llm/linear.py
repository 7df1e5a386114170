"""Text features and a softmax regression over them, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lodestone.llm import textkernel as tk
from lodestone.llm.quality_rules import _prefix, _repeated, lines_of

BUCKET_BITS = 15
SLOT_BITS = 20
_ALNUM = np.ones(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Texts:
    """Dense statistics and word hashes of some rows."""

    stats: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def buckets(self) -> np.ndarray:
        return (self.hashes >> tk.U64(64 - BUCKET_BITS)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Texts:
        n = np.diff(self.bounds)[rows]
        at = np.repeat(self.bounds[:-1][rows], n) + tk.ragged(n)
        return Texts(self.stats[rows], self.hashes[at], np.concatenate([[0], np.cumsum(n)]))


def join_texts(parts: list[Texts]) -> Texts:
    counts = np.concatenate([np.diff(p.bounds) for p in parts])
    return Texts(np.concatenate([p.stats for p in parts]), np.concatenate([p.hashes for p in parts]), np.concatenate([[0], np.cumsum(counts)]))


def read(column: pa.Array) -> Texts:
    """Features of whole texts; null counts as empty."""
    words = tk.Words(*tk.string_buffer(column))
    raw, rows, n = words.raw, words.rows, words.counts()
    hashes = words.hashes(0)
    length = words.end - words.start
    kinds = {name: _prefix(flag) for name, flag in (("upper", (raw >= 65) & (raw <= 90)), ("lower", (raw >= 97) & (raw <= 122)), ("digit", (raw >= 48) & (raw <= 57)), ("symbol", np.isin(raw, np.frombuffer(b"#*$%&<>", np.uint8))))}
    held = {k: v[words.end] - v[words.start] for k, v in kinds.items()}
    last = raw[words.end - 1] if len(raw) else raw[:0]
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    start, _ = lines_of(raw, words.offsets)
    breaks = _prefix(raw == 10)
    n_lines = breaks[words.offsets[1:]] - breaks[words.offsets[:-1]] + 1
    per_word = [length, (held["upper"] > 0) & (held["lower"] == 0) & (length > 3), held["symbol"] > 0, last == 33, (length == 1) & (last == 124), same, _repeated(words, hashes), held["digit"] > 0]
    least = np.maximum(n, 1)
    mean = [(p[rows[1:]] - p[rows[:-1]]) / least for p in map(_prefix, per_word)]
    stats = np.stack([np.log1p(n), *mean, np.log1p(n_lines), np.log1p(n / n_lines), n < 10], axis=1).astype(np.float32)
    plain = tk.Words(_LOWER[raw], words.offsets, _ALNUM)
    return Texts(stats, plain.hashes(0), plain.rows)


@dataclass
class Lexicon:
    """Log odds of each class for known words; strangers have none."""

    known: np.ndarray
    odds: np.ndarray

    def __getstate__(self):
        return {"known": self.known, "odds": self.odds}

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, 0 for strangers: a slot table that compares whole hashes."""
        if not hasattr(self, "_slots"):
            self._slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
            # of words that share a slot the one with the strongest odds stays
            order = np.argsort(np.abs(self.odds[1:]).max(1), kind="stable")
            self._slots[(self.known[order] >> tk.U64(64 - SLOT_BITS)).astype(np.int64)] = order + 1
            self._whole = np.concatenate([np.zeros(1, dtype=tk.U64), self.known])
        found = self._slots[(hashes >> tk.U64(64 - SLOT_BITS)).astype(np.int64)]
        return np.where(self._whole[found] == hashes, found, 0)

    def strongest(self, x: Texts) -> np.ndarray:
        """Largest log odds of each class among a row's words."""
        out = np.zeros((len(x), self.odds.shape[1]), dtype=np.float32)
        full = np.flatnonzero(np.diff(x.bounds))
        if len(full):
            out[full] = np.maximum.reduceat(self.odds[self.rows(x.hashes)], x.bounds[full], axis=0)
        return out

    def with_odds(self, x: Texts) -> Texts:
        return Texts(np.concatenate([x.stats, self.strongest(x)], axis=1), x.hashes, x.bounds)


def lexicon(x: Texts, y: np.ndarray, classes: int, least: int = 4) -> Lexicon:
    """Log odds of the words in `least` rows or more."""
    doc = np.repeat(np.arange(len(x)), np.diff(x.bounds))
    order = np.lexsort((doc, x.hashes))
    words, doc = x.hashes[order], doc[order]
    once = np.ones(len(words), dtype=bool)
    once[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    known, inverse = np.unique(words[once], return_inverse=True)
    held = np.stack([np.bincount(inverse, y[doc[once]] == k, len(known)) for k in range(classes)], axis=1) if len(known) else np.zeros((0, classes))
    keep = held.sum(1) >= least
    known, held = known[keep], held[keep]
    size = np.bincount(y, minlength=classes)
    odds = [np.log((held[:, k] + 0.1) / (size[k] + 1)) - np.log((held.sum(1) - held[:, k] + 0.5) / (size.sum() - size[k] + 1)) for k in range(classes)]
    table = np.stack(odds, axis=1) if len(known) else held
    return Lexicon(known, np.concatenate([np.zeros((1, classes)), np.clip(table, -1, 5)]).astype(np.float32))


@dataclass
class Softmax:
    """Class scores: statistics and the sum of word weights over the root of their number."""

    center: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    words: np.ndarray
    bias: np.ndarray

    def scores(self, x: Texts) -> np.ndarray:
        n = np.diff(x.bounds)
        out = np.clip((x.stats - self.center) / self.scale, -5, 5) @ self.dense + self.bias
        full = np.flatnonzero(n)
        if len(full) and len(self.words):
            out[full] += np.add.reduceat(self.words[x.buckets], x.bounds[full], axis=0) / np.sqrt(n[full])[:, None]
        return out

    def posteriors(self, x: Texts) -> np.ndarray:
        z = self.scores(x).astype(np.float64)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(x: Texts, y: np.ndarray, classes: int, epochs: int = 6, rate: float = 0.1, with_words: bool = True) -> Softmax:
    """Adagrad on mini-batches in a fixed random order, classes weighted alike; 300 batches at least."""
    epochs = max(epochs, -(-300 * 64 // max(64, len(y)))) if len(y) else 0
    rng = np.random.default_rng(7)
    center, scale = (x.stats.mean(0), x.stats.std(0) + 1e-3) if len(x) else (np.zeros(x.stats.shape[1]), np.ones(x.stats.shape[1]))
    zeros = lambda *s: np.zeros(s, dtype=np.float32)
    model = Softmax(center, scale, zeros(x.stats.shape[1], classes), zeros(1 << BUCKET_BITS if with_words else 0, classes), zeros(classes))
    share = np.bincount(y, minlength=classes) / max(1, len(y))
    weight = (1 / np.maximum(share, 1e-6) / classes).astype(np.float32)[y]
    old = {k: np.full(getattr(model, k).shape, 1e-3, dtype=np.float32) for k in ("dense", "words", "bias")}
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), 64):
            pick = order[first : first + 64]
            part = x.take(pick)
            g = model.posteriors(part).astype(np.float32)
            g[np.arange(len(pick)), y[pick]] -= 1
            g *= weight[pick][:, None] / len(pick)
            stats = np.clip((part.stats - center) / scale, -5, 5).astype(np.float32)
            for name, grad in (("dense", stats.T @ g + 1e-4 * model.dense), ("bias", g.sum(0))):
                old[name] += grad**2
                setattr(model, name, getattr(model, name) - rate * grad / np.sqrt(old[name]))
            n = np.diff(part.bounds)
            if with_words and len(part.buckets):
                rows, inverse = np.unique(part.buckets, return_inverse=True)
                each = np.repeat(g / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
                grad = np.stack([np.bincount(inverse, each[:, k], len(rows)) for k in range(classes)], axis=1).astype(np.float32)
                old["words"][rows] += grad**2
                model.words[rows] -= rate * grad / np.sqrt(old["words"][rows])
    return model
