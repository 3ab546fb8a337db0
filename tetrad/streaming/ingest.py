"""Streams of N-Quads files into a store: every micro-batch is one delta, which holds what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Store
from ..sources.rdf import parse_lines


def quad_stream(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Quads of the files that arrive in a folder."""
    return parse_lines(spark.readStream.text(path), strict)


def ingest(spark: SparkSession, source: str, store_path: str, checkpoint: str, now: str | None = None) -> StreamingQuery:
    """Insert what arrives into the store of a folder. A batch that is run again inserts nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            store = Store.open(spark, store_path)
        except FileNotFoundError:
            store = Store(spark)
        store.add(batch, now)
        store.save(store_path)

    return quad_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
