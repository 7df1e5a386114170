"""Packing by concatenating and cutting.

Pass one tokenises every whole text, ends it with EOS and writes the ids with each document's
place in its task and the task's token total.  A prefix sum over the totals, one row per task,
gives every task its global offset; pass two joins it and cuts the token stream into windows of
`length` tokens.  A document over a border becomes several boundary pieces.  Only the last
sequence can be padded.

Tokenising: byte-level BPE works on the pieces of a fixed split, so equal pieces have equal
ids.  The split runs vectorised; each distinct piece of a chunk is encoded once by the
`tokenizers` library and found again by hash, and its bytes are compared with those of the known piece.  Rows with
an apostrophe (contractions), with "<|" (special tokens), with characters beyond the first plane or with a
piece whose hash names other bytes go to the library whole, and so does every row of a vocabulary with
another split or normaliser; its ids are always the ones returned.

Defined results: null text is empty and still has its EOS id; repeated rows are packed
each; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textkernel as tk
from lodestone.runtime import saved

EOS = 1
#: Distinct pieces a worker remembers between chunks; a full table starts anew.
REMEMBERED = 500_000
#: Bytes of text handled at once: the larger, the fewer pieces are looked up again.
CHUNK_BYTES = 1 << 20
#: Characters encoded at once, a text at least; encodings take far more memory than their ids.
AT_ONCE = 1 << 17

_TOKENS = "doc_id long, task int, before long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _known_split(path: str) -> bool:
    """Whether the vocabulary is byte-level BPE with the split that Encoder makes itself."""
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    split, model = about.get("pre_tokenizer") or {}, about.get("model") or {}
    plain = not any(about.get(k) for k in ("normalizer", "truncation", "padding")) and model.get("type") == "BPE" and not model.get("dropout")
    return plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and all("<|" in t["content"] for t in about.get("added_tokens", []))


def _character_classes() -> np.ndarray:
    """For each character of the first plane: 1 letter, 2 number, 3 white space, 4 other."""
    table = np.full(0x10000, 4, dtype=np.uint8)
    for code in range(0x10000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = 1
        elif kind == "N":
            table[code] = 2
        elif kind == "Z" or chr(code) in "\t\n\x0b\x0c\r\x85":
            table[code] = 3
    return table


class Encoder:
    """Token ids of whole texts; one per Python worker."""

    _one: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.classes = _character_classes() if _known_split(path) else None
        self.forget()

    def forget(self) -> None:
        """Known pieces: sorted hashes and their rows; ids and bytes of the rows."""
        self.known_hash = np.zeros(0, dtype=tk.U64)
        self.known_row = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.bounds = np.zeros(1, dtype=np.int64)
        self.bytes = np.zeros(0, dtype=np.uint8)
        self.byte_bounds = np.zeros(1, dtype=np.int64)

    @classmethod
    def shared(cls, path: str) -> Encoder:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        group = np.cumsum([len(t) for t in texts]) // AT_ONCE
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        parts = (texts[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
        return [np.array(e.ids, dtype=np.uint32) for part in parts for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]

    def _split(self, points: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """First character of every piece: runs of one class, a run taking a space before it along;
        of white space before another run, the last character goes with that run if it is a space
        and is a piece of its own if not."""
        kind = self.classes[points]
        change = edge[:-1].copy()
        change[1:] |= kind[1:] != kind[:-1]
        change[0] = True
        space = kind == 3
        after = np.zeros(len(points), dtype=bool)  # the next character is in this row and no white space
        after[:-1] = ~space[1:] & ~edge[1:-1]
        last = space & after
        begin = change.copy()
        begin |= last
        taken = np.flatnonzero(last & (points == 0x20)) + 1
        begin[taken] = False
        return np.flatnonzero(begin)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the row bounds."""
        raw, offsets = tk.string_buffer(column)
        if self.classes is None:
            odd = np.ones(len(column), dtype=bool)
        else:
            quoted = np.zeros(len(raw) + 1, dtype=np.int64)
            strange = (raw == 0x27) | (raw >= 0xF0)
            strange[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
            np.cumsum(strange, out=quoted[1:])
            odd = quoted[offsets[1:]] > quoted[offsets[:-1]]
            del quoted, strange
        while True:
            plain_ids, plain_counts, mistaken = self._plain(raw, offsets, odd)
            if not mistaken.any():
                break
            odd = odd | mistaken
        if not odd.any():
            return plain_ids, np.concatenate([[0], np.cumsum(plain_counts)])
        slow = self.encode([column[int(i)].as_py() or "" for i in np.flatnonzero(odd)])
        counts = plain_counts.copy()
        counts[odd] = [len(x) for x in slow]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], dtype=np.uint32)
        fast = np.repeat(~odd, counts)
        out[fast] = plain_ids
        if slow:
            out[~fast] = np.concatenate(slow)
        return out, bounds

    def _plain(self, raw: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their numbers of the rows that are not odd, and which rows have a piece whose hash is another's."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        none = np.zeros(n, dtype=bool)
        if odd.any():
            raw = raw[np.repeat(~odd, lengths)]
            lengths = np.where(odd, 0, lengths)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not len(raw):
            return np.zeros(0, dtype=np.uint32), np.zeros(n, dtype=np.int64), none
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-16-le"), dtype=np.uint16)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        edge = np.zeros(len(points) + 1, dtype=bool)
        row_first = np.searchsorted(at, offsets)
        edge[row_first] = True
        start = at[self._split(points, edge)]
        del at, edge, points, row_first
        end = np.append(start[1:], len(raw))
        rows = np.searchsorted(start, offsets)
        distinct, first, inverse = np.unique(tk.bytes_hash(raw, start, end, 0), return_index=True, return_inverse=True)
        table = self._look_up(distinct, raw, start[first], end[first])
        # a piece is the one that its hash names only if the bytes agree
        true = tk.equal_bytes(self.bytes, self.byte_bounds[table], self.byte_bounds[table + 1], raw, start[first], end[first])[inverse]
        true &= tk.equal_bytes(raw, start, end, raw, start[first][inverse], end[first][inverse])
        if not true.all():
            none[np.searchsorted(rows, np.flatnonzero(~true), side="right") - 1] = True
        many = np.diff(self.bounds)[table]
        each = many[inverse]
        prefix = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(self.bounds[:-1][table][inverse], each) + tk.ragged(each)
        return self.flat[source], prefix[rows[1:]] - prefix[rows[:-1]], none

    def _look_up(self, distinct: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row of each distinct hash in the table of known pieces; new ones are encoded."""
        if len(self.known_hash) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known_hash, distinct)
        inside = place < len(self.known_hash)
        known = inside.copy()
        known[inside] = self.known_hash[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            pieces = [data[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            ids = self.encode([p.decode("utf-8") for p in pieces])
            rows = len(self.bounds) - 1 + np.arange(len(new))
            self.flat = np.concatenate([self.flat, *ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids])])
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), dtype=np.uint8)])
            self.byte_bounds = np.concatenate([self.byte_bounds, self.byte_bounds[-1] + np.cumsum(end[new] - start[new])])
            self.known_hash = np.insert(self.known_hash, place[new], distinct[new])
            self.known_row = np.insert(self.known_row, place[new], rows)
            place = np.searchsorted(self.known_hash, distinct)
        return self.known_row[place]


def _tokenise(path: str, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(path)
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in tk.chunks(batch, limit=CHUNK_BYTES):
                ids, bounds = encoder.rows(part.column("text"))
                counts = np.diff(bounds) + 1
                ends = np.cumsum(counts)
                out = np.empty(ends[-1], dtype="<u4")
                mark = np.zeros(ends[-1], dtype=bool)
                mark[ends - 1] = True
                out[mark] = eos
                out[~mark] = ids
                width = np.dtype("<u2") if out.max() < 1 << 16 else np.dtype("<u4")
                data = out.astype(width)
                # the first byte names the width of the ids
                blobs = [bytes([width.itemsize]) + data[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.full(len(counts), task, dtype=np.int32)),
                        pa.array(total + ends - counts),
                        pa.array(counts),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "task", "before", "n_tokens", "ids"],
                )
                total += int(ends[-1])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = batch.column("base").to_numpy() + batch.column("before").to_numpy()
            n = batch.column("n_tokens").to_numpy()
            pieces = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = begin[row] // length + tk.ragged(pieces)
            first = np.maximum(begin[row], sequence * length)
            last = np.minimum(begin[row] + n[row], (sequence + 1) * length)
            start = first - begin[row]
            blobs = batch.column("ids")
            crc, at, ids = np.empty(len(row), dtype=np.int64), -1, None
            for j, (r, a, size) in enumerate(zip(row.tolist(), start.tolist(), (last - first).tolist(), strict=True)):
                if r != at:
                    blob, at = memoryview(blobs[r].as_buffer()), r
                    ids = np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1)
                crc[j] = zlib.crc32(ids[a : a + size].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (start, last - first, crc, n[row], sequence, first - sequence * length))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, length: int = 2048, vocabulary: str | None = None, eos: int = EOS) -> DataFrame:
    """One row per piece of docs(doc_id, text) in sequences of `length` tokens.

    `vocabulary` is a file of the `tokenizers` library that every executor can open.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = saved(docs.mapInArrow(_tokenise(_vocabulary(vocabulary), eos), _TOKENS), "tokens")
    # one row per input split; the join broadcasts them while their table is small and shuffles beyond
    totals = tokens.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(totals.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "offsets")
    return tokens.join(offsets, "task").select("doc_id", "base", "before", "n_tokens", "ids").mapInArrow(_cut(length), _PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
