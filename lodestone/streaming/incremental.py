"""Keep a catalog saturated while facts arrive: every micro-batch adds its rows and their consequences only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chase import Options, chase
from lodestone.runtime import exists, saved
from lodestone.sources.catalog import Catalog, positional, without
from lodestone.syntax import Rule


class Saturation:
    """A catalog and rules without negation; `attach` feeds one predicate from a stream.

    A batch and its consequences become visible together, after the chase has ended: a batch
    that fails leaves the catalog as it was, and its repetition finds nothing done.  `attach` writes every batch
    under its number into the stream's checkpoint folder before it is used; a new Saturation that attaches to the same
    checkpoint takes these rows in again, so a restarted driver loses none.
    """

    def __init__(self, catalog: Catalog, rules: Iterable[Rule], options: Options | None = None):
        self.rules, self.options = list(rules), options
        self.catalog = chase(catalog, self.rules, options).catalog

    def add(self, name: str, rows: DataFrame) -> int:
        """Take in rows of a predicate; the number that were new."""
        key = name, len(rows.columns)
        rows = positional(rows).distinct()
        source = self.catalog.find(key)
        new = saved(rows if source is None else without(rows, source.frame()), "arrived")
        n = new.count()
        if n:
            staged = self.catalog.copy()
            staged.insert(key, new)
            self.catalog = chase(staged, self.rules, self.options, changed={key: new}).catalog
        return n

    def attach(self, name: str, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        spark, folder = stream.sparkSession, f"{checkpoint.rstrip('/')}-facts/{name}"
        schema = stream.schema

        def take(batch: DataFrame, number: int) -> None:
            # a repeated batch replaces its own rows
            path = f"{folder}/batch={number}"
            batch.write.mode("overwrite").parquet(path)
            self.add(name, spark.read.schema(schema).parquet(path))

        if exists(spark, folder):
            self.add(name, spark.read.schema(schema).parquet(folder).select(*schema.names))
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
        return (writer.trigger(availableNow=True) if once else writer).start()
