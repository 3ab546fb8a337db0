"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits; rows are sorted by their cell's place on the curve, then by text and id, and
the sorted run is cut into shards of equal row counts, so every shard's files cover a compact box of the metadata.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, checkpointed, ship

BITS = 6


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each point. cells: one array of integers below 2**bits for each dimension.

    The transform of J. Skilling (Programming the Hilbert curve, 2004): undo excess work from the high bits down, then
    Gray-encode; the transposed bits, interleaved, are the index.
    """
    x = [c.astype(np.int64).copy() for c in cells]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def quantised(c: Column, bits: int = BITS) -> Column:
    """A hash cell for a name (equal names share a cell); a null is cell 0."""
    return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit((1 << bits) - 1)) + 1).cast("int")


def log_cell(c: Column, bits: int = BITS) -> Column:
    """Four cells to each doubling of a size, up to the last cell."""
    return F.least(F.lit((1 << bits) - 1), F.floor(2.5 * F.log2(F.coalesce(c, F.lit(0)).cast("double") + 1))).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = BITS) -> DataFrame:
    """Assign every document a shard and a slot; counts of shards differ by one at most (law ``rows``).

    Dimensions: language, source and size. Copies (equal texts) take the language and source of the copy of least id, so
    that they lie next to each other on the curve and are parted only where a shard's cut falls among them. A null text has
    size 8 and is its own text; null names have a cell; repeated rows and null ids are rows of their own; an empty table
    gives no rows; other columns are ignored, and a text of any length counts whole.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null), hilbert. Shuffles: of narrow rows to give copies
    their representative, which deals a large group to several tasks, and one range sort of narrow rows; texts are not
    moved. A value that many rows share is split, because the sort key ends in the id. The driver gets one count for each sorted partition.
    """
    spark = docs.sparkSession
    ship(spark)

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit("\0null"))).alias("key"),
        quantised(F.col("lang"), bits).alias("lang_cell"), quantised(F.col("source"), bits).alias("source_cell"),
    )
    same = ["size", "text_crc32", "key"]
    least = F.min(F.struct("doc_id", "lang_cell", "source_cell")).alias("first")
    placed = (
        attached(rows, same, ["doc_id", "lang_cell", "source_cell"], [least, F.count("*").alias("copies")], [F.min("first").alias("first"), F.sum("copies").alias("copies")], "left", "copies > 1")
        .select("doc_id", *same, F.coalesce("first.lang_cell", "lang_cell").alias("a"), F.coalesce("first.source_cell", "source_cell").alias("b"))
        .withColumn("hilbert", curve("a", "b", log_cell(F.col("size"), bits)))
    )
    order = ["hilbert", *same, "doc_id"]
    ranged = checkpointed(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", *same, "hilbert", F.spark_partition_id().alias("part")))
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, before, starts = sum(counts.values()), 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    start = F.create_map(*[F.lit(x) for s in starts for x in s])[F.col("part")] if starts else F.lit(0)
    rank = (start.cast("long") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("rank")
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    return (
        ranged.select("*", rank)
        .withColumn("shard", shard.cast("int"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            F.expr(f"rank - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write the documents, all columns and rows, with a folder for each shard, sorted along the curve within files.

    Rows find their shard by id and text, null-safely; rows that agree in both are given their places in any order.
    """
    key = lambda df: df.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__null", F.col("doc_id").isNull())
    numbered = lambda df, *by: df.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__null", "__size", "__crc").orderBy(*by)))
    assigned = key(hilbert_shards(docs, shards)).withColumnsRenamed({"size": "__size", "text_crc32": "__crc"})
    assigned = numbered(assigned, "shard", "slot").select("__id", "__null", "__size", "__crc", "__n", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    text = F.col("text").cast("string")
    own = key(docs).withColumn("__size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).withColumn("__crc", F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    placed = numbered(own, F.lit(0)).join(assigned, ["__id", "__null", "__size", "__crc", "__n"]).select(*[F.col(f"`{c}`") for c in docs.columns], "__shard", "__slot")
    placed.repartition("__shard").sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(path)
