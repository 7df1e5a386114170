"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against all documents with a smaller id.  The
reference is cut into content-defined blocks: the word window of `span` words
picks as its anchor the smallest hash among the `ANCHOR`-word grams it holds, and
consecutive windows with one anchor form one block of `span` to
2 * `span` - `ANCHOR` words.  Equal passages are cut alike wherever they stand.

1. Index: each distinct block (128-bit digest of its words) with its first place, that is the smallest
   doc_id and there the first word; partial aggregation merges copies before the shuffle.
2. Parse: a document looks all its blocks up at once.  From left to right a factor takes the next
   block for as long as its place in the reference continues the factor's; then a new one begins.
3. Factor boundaries: a new block may share some windows with other blocks of its anchor.  Every such window
   holds the block's head (the anchor and the words before it, half of those that a window has beside the anchor) or its
   tail (the anchor and the words behind it).  Only windows whose head or tail also stands in
   other blocks are looked up singly (digests again), and they lengthen the factors beside them or make factors of their own.
4. Every factor has `span` words or more and becomes a duplicate span.

Hot passages: every aggregation has a map-side part, and both lookups are plain
equi-joins whose large partitions adaptive execution splits; no task gathers a
group.  Shuffles: the merged index, both times one exchange, and its heads and tails; the blocks' digests; the texts,
one exchange for both joins; the single windows.  A word goes if and only if a window over it also starts in a document with a
smaller doc_id, judged on the input; digests are of the words themselves, so no texts but equal ones meet
(chance of 2**-128 a pair).

Defined results: null text has no words; a null doc_id neither is deduplicated nor
serves as reference; rows that share a doc_id are no references for one another; texts
shorter than the span stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkernel as tk
from lodestone.runtime import collect_garbage, saved

#: Words of an anchor gram; longer anchors make more blocks, shorter ones more boundary lookups.
ANCHOR = 10

# digests are never null: else filters for that would make plans differ that share an exchange
_BLOCK = "s1 long not null, s2 long not null, head long, tail long, split int, doc_id long not null, key long not null, first int, n_windows int, place decimal(38,0)"
_HALF = "half long not null, s1 long not null, s2 long not null, side int"
_FIRST_PLACE = "s1 long not null, s2 long not null, ref_doc long, ref_first int"
_WINDOW = "s1 long not null, s2 long not null, doc_id long, key long, first int, place decimal(38,0)"
_FACTOR = [("first", pa.int32()), ("n_words", pa.int32()), ("ref_doc", pa.int64()), ("ref_first", pa.int32())]
_RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>, "
    "factors array<struct<first:int,n_words:int,ref_doc:bigint,ref_first:int>>, kept_text string"
)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    have, best = 1, values
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return best


def _blocks(words: tk.Words, span: int) -> dict[str, np.ndarray]:
    """Blocks of a chunk: digests, hashes of head and tail, how many windows hold the head (the others hold the tail), row, first window's word and number of windows."""
    anchor = min(ANCHOR, span)
    wide = span - anchor + 1
    hashes = words.hashes(0)
    window, _ = tk.grams(words.rows, span)
    if not len(window):
        return {}
    every = np.arange(len(hashes) - anchor + 1)
    gram = tk.spans_hash(hashes, every, every + anchor, 1)
    at = _leftmost(gram, window, wide)
    row = np.searchsorted(words.rows, window, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.append(cut, len(window)))
    first = window[cut]
    last = first + n - 1 + span
    one, two = words.digests(first, last)
    mid, before = at[cut], wide // 2
    split = np.clip(mid - before - first + 1, 0, n)
    start, end = np.concatenate([mid - before, mid]), np.concatenate([mid + anchor, mid + span - before + 1])
    there = np.concatenate([split > 0, split < n])
    halves = np.zeros(len(there), dtype=tk.U64)
    halves[there] = tk.spans_hash(hashes, start[there], end[there], 2)
    head, tail = (pa.array(tk.signed(x), mask=~y) for x, y in zip(np.split(halves, 2), np.split(there, 2), strict=True))
    return {"s1": one, "s2": two, "head": head, "tail": tail, "split": split, "row": row[cut], "first": first - words.rows[row[cut]], "n": n}


def _places(doc_id: np.ndarray, first: np.ndarray) -> pa.Array:
    """doc_id * 2**32 + first as decimals, so that the smallest is the first place."""
    both = np.empty((len(doc_id), 2), dtype=np.int64)
    both[:, 0] = (doc_id << 32) | first
    both[:, 1] = doc_id >> 32
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc_id), [None, pa.py_buffer(both)])


def _leftmost(gram: np.ndarray, window: np.ndarray, wide: int) -> np.ndarray:
    """Place of the leftmost smallest (by its high bits) of gram[window : window + wide]."""
    bits = tk.U64(26)
    places = np.arange(len(gram), dtype=tk.U64)
    if len(gram) <= 1 << 26:
        packed = (gram >> bits << bits) | places
        return (_sliding_min(packed, wide)[window] & tk.U64((1 << 26) - 1)).astype(np.int64)
    order = np.argsort(gram >> bits, kind="stable")
    rank = np.empty(len(gram), dtype=np.int64)
    rank[order] = places
    return order[_sliding_min(rank, wide)[window]]


def _emit_blocks(span: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(*tk.string_buffer(part.column("text")))
                found = _blocks(words, span)
                if found:
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False)[found["row"]]
                    keys = part.column("key").to_numpy(zero_copy_only=False)[found["row"]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(tk.signed(found["s1"])),
                            pa.array(tk.signed(found["s2"])),
                            found["head"],
                            found["tail"],
                            pa.array(found["split"].astype(np.int32)),
                            pa.array(ids),
                            pa.array(keys),
                            pa.array(found["first"].astype(np.int32)),
                            pa.array(found["n"].astype(np.int32)),
                            _places(ids, found["first"]),
                        ],
                        names=["s1", "s2", "head", "tail", "split", "doc_id", "key", "first", "n_windows", "place"],
                    )

    return emit


def _emit_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads (side 1) and tails (side 2) of the blocks of the index."""
    for batch in batches:
        for side, name in ((1, "head"), (2, "tail")):
            part = batch.filter(batch.column(name).is_valid())
            yield pa.RecordBatch.from_arrays(
                [part.column(name), part.column("s1"), part.column("s2"), pa.array(np.full(part.num_rows, side, dtype=np.int32))],
                names=["half", "s1", "s2", "side"],
            )


def _emit_first_places(*more: str):
    """Digests with their first place, and the columns named in more.

    All columns of merged blocks come in here as in `_emit_halves`, so both read one exchange; what goes out is
    dealt anew for a lookup, so adaptive execution can split a hot passage there.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place")
            both = np.frombuffer(place.buffers()[1], dtype="<i8").reshape(-1, 2)[place.offset : place.offset + len(place)] if len(place) else np.zeros((0, 2), dtype=np.int64)
            low, high = both[:, 0], both[:, 1]
            ref = [pa.array((high << 32) | ((low >> 32) & 0xFFFFFFFF)), pa.array((low & 0xFFFFFFFF).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("s1"), batch.column("s2"), *ref, *(batch.column(x) for x in more)], names=["s1", "s2", "ref_doc", "ref_first", *more])

    return emit


def _lists(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields and lengths of a column of lists of structs; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten()], column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _emit_windows(span: int):
    """Digests of the single windows of the boundary blocks."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(*tk.string_buffer(part.column("text")))
                (firsts, lengths), many = _lists(part.column("edges"))
                row = np.repeat(np.repeat(np.arange(part.num_rows), many), lengths)
                at = np.repeat(firsts, lengths) + tk.ragged(lengths)
                start = words.rows[row] + at
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                keys = part.column("key").to_numpy(zero_copy_only=False)[row]
                one, two = words.digests(start, start + span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tk.signed(one)), pa.array(tk.signed(two)), pa.array(ids), pa.array(keys), pa.array(at.astype(np.int32)), _places(ids, at)],
                    names=["s1", "s2", "doc_id", "key", "first", "place"],
                )

    return emit


def _factors(part: pa.RecordBatch, span: int) -> tuple[np.ndarray, ...]:
    """The greedy parse: row, first word, words, reference document and its first word of each factor."""
    found = [_lists(part.column(name)) for name in ("full", "inner")]
    row = np.concatenate([np.repeat(np.arange(part.num_rows), many) for _, many in found])
    first, n, ref_doc, ref_first = (np.concatenate([fields[k] for fields, _ in found]).astype(np.int64) for k in range(4))
    order = np.lexsort((first, row))
    row, first, n, ref_doc, ref_first = (x[order] for x in (row, first, n, ref_doc, ref_first))
    # a piece continues the factor before it if both places do; every piece is the first place of its words
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + n[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_first[1:] != ref_first[:-1] + n[:-1])
    at = np.flatnonzero(new)
    windows = np.add.reduceat(n, at) if len(at) else n
    return row[at], first[at], windows - 1 + span, ref_doc[at], ref_first[at]


def _cut(span: int, with_text: bool):
    """Factors each document, removes the covered words and digests the rest."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(*tk.string_buffer(part.column("text")))
                rows = words.rows
                row, first, n, ref_doc, ref_first = _factors(part, span)
                cover = np.zeros(len(words.start) + 1, dtype=np.int64)
                np.add.at(cover, first + rows[row], 1)
                np.add.at(cover, first + rows[row] + n, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                n_removed = removed[rows[1:]] - removed[rows[:-1]]
                digests, spans, kept_texts = [], [], []
                raw = words.raw.tobytes()
                for i in range(part.num_rows):
                    own = raw[words.offsets[i] : words.offsets[i + 1]].split()
                    if n_removed[i]:
                        mask = gone[rows[i] : rows[i + 1]]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
                        spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                        own = [own[j] for j in np.flatnonzero(~mask)]
                    else:
                        spans.append([])
                    kept = b" ".join(own)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode("utf-8", "replace") if with_text else None)
                bounds = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                factors = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip((first, n, ref_doc, ref_first), _FACTOR, strict=True)], [f for f, _ in _FACTOR])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(words.counts().astype(np.int64)),
                        pa.array(n_removed.astype(np.int64)),
                        pa.array(digests, pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                        pa.ListArray.from_arrays(bounds, factors),
                        pa.array(kept_texts, pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors", "kept_text"],
                )

    return emit


def remove_repeated_spans(docs: DataFrame, span: int = 50, with_text: bool = True) -> DataFrame:
    """One row per document of docs(doc_id, text): word counts, removed spans, factors, kept text and its digest.

    A factor says that its words stand in document ref_doc from word ref_first on.
    """
    # an alias where none is needed would keep the plans below from sharing the exchange of the texts
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(doc_id, "text").withColumn("key", F.xxhash64("text"))
    blocks = docs.where("doc_id IS NOT NULL").mapInArrow(_emit_blocks(span), _BLOCK)
    ends = F.min("place").alias("place"), F.max("doc_id").alias("last_doc")
    in_later = "place < CAST(last_doc AS DECIMAL(38,0)) * 4294967296"  # the first place is in a document before the last one
    # equal blocks have equal heads, tails and splits
    merged = blocks.groupBy("s1", "s2").agg(*ends, F.max("head").alias("head"), F.max("tail").alias("tail"), F.max("split").alias("split"))
    halves = merged.mapInArrow(_emit_halves, _HALF)
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n_blocks")).where("n_blocks > 1").select("half")
    edge = halves.join(shared, "half").groupBy("s1", "s2").agg(F.bit_or("side").alias("edge"))
    index = merged.join(edge, ["s1", "s2"], "left").where(f"edge IS NOT NULL OR {in_later}").mapInArrow(_emit_first_places("edge", "split"), f"{_FIRST_PLACE}, edge int, split int")
    hits = blocks.select("s1", "s2", "doc_id", "key", "first", "n_windows").join(index, ["s1", "s2"]).where("doc_id > ref_doc OR edge IS NOT NULL")
    lookup = F.struct(F.expr("IF(edge = 2, first + split, first)").alias("first"), F.expr("CASE edge WHEN 1 THEN split WHEN 2 THEN n_windows - split ELSE n_windows END").alias("n_windows"))
    per_doc = saved(
        hits.groupBy("doc_id", "key").agg(
            F.collect_list(F.when(F.col("doc_id") > F.col("ref_doc"), F.struct("first", "n_windows", "ref_doc", "ref_first"))).alias("full"),
            F.collect_list(F.when(F.col("doc_id") == F.col("ref_doc"), lookup)).alias("edges"),
        ),
        "factors",
    )
    collect_garbage(docs.sparkSession)
    # both joins below need the texts dealt by document: the same filter and columns let Spark reuse that exchange
    named = docs.where("doc_id IS NOT NULL")
    edges = named.join(per_doc.where("size(edges) > 0").select("doc_id", "key", "edges"), ["doc_id", "key"])
    windows = edges.mapInArrow(_emit_windows(span), _WINDOW)
    earliest = windows.groupBy("s1", "s2").agg(*ends).where(in_later).mapInArrow(_emit_first_places(), _FIRST_PLACE)
    piece = F.struct("first", F.lit(1).alias("n_windows"), "ref_doc", "ref_first")
    inner = (
        windows.select("s1", "s2", "doc_id", "key", "first").join(earliest, ["s1", "s2"]).where("doc_id > ref_doc")
        .groupBy("doc_id", "key").agg(F.collect_set(piece).alias("inner"))
    )
    full = per_doc.where("size(full) > 0").select("doc_id", "key", "full")
    found = full.join(inner, ["doc_id", "key"], "full")
    none = F.lit(None).cast(found.schema["full"].dataType)
    nameless = docs.where("doc_id IS NULL").select("doc_id", "key", "text", none.alias("full"), none.alias("inner"))
    return named.join(found, ["doc_id", "key"], "left").unionByName(nameless).mapInArrow(_cut(span, with_text), _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_spans(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
