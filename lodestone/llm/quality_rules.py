"""Quality rules: per-text heuristics and cross-document line frequency.

One pass over whole texts gives the base figures and a hash of every normalised
line (ASCII lower case, white space collapsed).  Per host (column `source`) the distinct
documents of each line are counted, documents with equal text once; lines of more
than max(`min_docs`, `max_share` of the host's distinct documents) documents are removed, and with
`max_docs` those of more than max(`min_docs`, `max_docs`) however large the host is.  A
document is rejected if a base rule fails, or if less than `min_left` of its words are left.

The counts aggregate before each shuffle, so a line or host of a third of all rows
costs one row per task; the lookup of frequent lines is an equi-join that adaptive
execution splits.

Defined results: null or empty text has no words and fails the base rules; a null
host is the host ""; rows with equal (doc_id, text) share figures; other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkernel as tk
from lodestone.llm.sampling import quoted, unused
from lodestone.runtime import saved

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_FIGURES = (
    "doc_id long, host string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line:long,words:int>>"
)


def _prefix(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the lines of all rows."""
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    return start, end


def _repeated(words: tk.Words, hashes: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that the row holds twice or more."""
    first, bounds = tk.grams(words.rows, WINDOW)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(tk.U64)
    gram = tk.mix(tk.spans_hash(hashes, first, first + WINDOW, 1) + row * tk.U64(0x9E3779B97F4A7C15))
    order = np.argsort(gram)
    equal = gram[order][1:] == gram[order][:-1]
    twice = np.zeros(len(gram), dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    return np.cumsum(cover)[:-1] > 0


def line_hashes(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: byte start, byte end, first word, words, normalised hash."""
    start, end = lines_of(words.raw, words.offsets)
    first = np.searchsorted(words.start, start)
    last = np.searchsorted(words.start, end)
    full = last > first
    start, end, first, last = start[full], end[full], first[full], last[full]
    lowered = tk.Words(_LOWER[words.raw], words.offsets).hashes(2)
    return start, end, first, last - first, tk.spans_hash(lowered, first, last, 3)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        for part in tk.chunks(batch):
            words = tk.Words(*tk.string_buffer(part.column("text")))
            raw, offsets, rows = words.raw, words.offsets, words.rows
            points = _prefix((raw & 0xC0) != 0x80)
            in_words = _prefix(points[words.end] - points[words.start])
            symbols = _prefix(symbol[raw])
            repeated = _prefix(_repeated(words, words.hashes(0)))
            start, end, first, n, normal = line_hashes(words)
            row = np.searchsorted(offsets, start, side="right") - 1
            exact = tk.mix(tk.bytes_hash(raw, start, end, 1) + row.astype(tk.U64) * tk.U64(0x9E3779B97F4A7C15))
            _, once = np.unique(exact, return_index=True)
            per_row = np.bincount(row, minlength=part.num_rows)
            distinct = np.bincount(row[once], minlength=part.num_rows)
            lines = pa.StructArray.from_arrays([pa.array(tk.signed(normal)), pa.array(n.astype(np.int32))], ["line", "words"])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("host"),
                    part.column("key"),
                    pa.array(words.counts().astype(np.int64)),
                    pa.array(in_words[rows[1:]] - in_words[rows[:-1]]),
                    pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]]),
                    pa.array((per_row - distinct).astype(np.int64)),
                    pa.array(repeated[rows[1:]] - repeated[rows[:-1]]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), lines),
                ],
                names=["doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def judge(docs: DataFrame, min_docs: int = 20, max_share: float = 0.1, min_left: float = 0.5, max_docs: int | None = None) -> DataFrame:
    """One row per document of docs(doc_id, text, source): figures, removed lines and verdict."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.xxhash64("text").alias("key"), "text"
    )
    figures = saved(docs.mapInArrow(_figures, _FIGURES), "line-figures")
    hosts = figures.select("host", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    lines = figures.select("doc_id", "host", "key", F.explode("lines").alias("l")).select("doc_id", "host", "key", "l.line", "l.words")
    often = F.col("n_seen") > F.col("n_docs") * max_share
    if max_docs is not None:
        often |= F.col("n_seen") > max_docs
    frequent = (
        lines.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_seen"))
        .where(F.col("n_seen") > min_docs)
        .join(hosts, "host")
        .where(often)
        .select("host", "line")
    )
    # copies hold the same lines: one row per text and host joins, not one per copy
    removed = (
        lines.dropDuplicates(["doc_id", "key", "host", "line"]).select("doc_id", "key", "host", "line")
        .join(frequent, ["host", "line"])
        .groupBy("doc_id", "key", "host")
        .agg(F.collect_set("line").alias("removed_lines"))
    )
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.key") == F.col("b.key"), F.col("a.host") == F.col("b.host")]
    gone = F.aggregate(
        F.filter("lines", lambda x: F.array_contains("removed_lines", x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["words"]
    )
    judged = (
        figures.alias("a").join(removed.alias("b"), same, "left").select("a.*", F.coalesce("b.removed_lines", F.array().cast("array<long>")).alias("removed_lines"))
        .withColumn("n_line_words", gone)
        .drop("lines")
        .withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    )
    left = F.col("n_words") - F.col("n_line_words")
    return judged.withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * min_left))


def _without_lines(mark: str):
    """Drops each row's lines listed in column `mark` from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                removed = part.column(mark).to_pylist()
                words = tk.Words(*tk.string_buffer(part.column("text")))
                start, end, _, _, normal = line_hashes(words)
                row = np.searchsorted(words.offsets, start, side="right") - 1
                texts = part.column("text").to_pylist()
                raw = words.raw.tobytes()
                by_row = np.searchsorted(row, np.arange(part.num_rows + 1))
                for i, lines in enumerate(removed):
                    own = slice(by_row[i], by_row[i + 1])
                    drop = np.isin(tk.signed(normal[own]), np.array(lines, dtype=np.int64))
                    kept, at = [], int(words.offsets[i])
                    for a, b in zip(start[own][drop], end[own][drop], strict=True):
                        kept.append(raw[at:a])
                        at = int(min(b + 1, words.offsets[i + 1]))
                    kept.append(raw[at : words.offsets[i + 1]])
                    texts[i] = b"".join(kept).decode("utf-8", "replace")
                columns = {**dict(zip(part.schema.names, part.columns, strict=True)), "text": pa.array(texts, pa.string())}
                names = [n for n in part.schema.names if n != mark]
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents with their frequent lines removed; columns as given."""
    names = docs.columns
    own_id, own_key, own_host, mark = (unused(names, n) for n in ("__id", "__key", "__host", "removed_lines"))
    verdict = judge(docs, **limits).where("kept").select(
        F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("host").alias(own_host), F.col("removed_lines").alias(mark)
    ).dropDuplicates([own_id, own_key, own_host])
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    own &= F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(own_host)
    kept = docs.join(verdict, own).select(*map(quoted, names), mark)
    plain = kept.where(F.size(mark) == 0).drop(mark)
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    edited = kept.where(F.size(mark) > 0).mapInArrow(_without_lines(mark), fields)
    if "n_chars" in names:
        edited = edited.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return plain.unionByName(edited)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words"
    )
