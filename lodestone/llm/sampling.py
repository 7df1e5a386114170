"""Names that no input column has, and samples of bounded rows and bytes for the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a sample may bring to the driver.
MAX_BYTES = 32 << 20


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def column(name: str):
    """A column by its whole name, whatever characters it has."""
    return F.col(quoted(name))


def bounded_rows(docs: DataFrame, chosen: DataFrame, max_bytes: int = MAX_BYTES) -> pa.Table:
    """One row of docs(doc_id, text, ..) for each doc_id of chosen(doc_id, ..), sorted by doc_id.

    chosen has a bounded number of rows and one per doc_id.  Of rows that share a doc_id the one with the smallest
    text hash counts.  In the order of the ids' hashes, rows are taken while their texts fit into max_bytes
    together; a text that alone would not fit is passed over.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("key", F.xxhash64("text"))
    # chosen is bounded by its caller
    sized = keyed.join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min(F.struct("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("row"))
    rows = sized.select("doc_id", "row.key", "row.size").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken, total = [], 0
    for r in rows:
        if total + r.size <= max_bytes:
            total += r.size
            taken.append((r.doc_id, r.key))
    wanted = spark.createDataFrame(taken, "doc_id long, key long")
    own = [c for c in docs.columns if c != "doc_id"]
    one = keyed.join(F.broadcast(wanted), ["doc_id", "key"]).groupBy("doc_id").agg(F.min(F.struct(*own)).alias("row")).select("doc_id", "row.*")
    return one.join(F.broadcast(chosen), "doc_id").toArrow().sort_by("doc_id")
