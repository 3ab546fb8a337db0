"""Bitemporal writes as whole-set operations.

A batch of inserts or deletes makes a delta: the keys that it touches, and all rows that these then have. The quad table
after it is what other keys had, and the delta's rows; nothing else is read into a write or written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quads import OPEN_FROM

KEY = ["g", "s", "p", "o"]
FIELDS = [*KEY, "valid_from", "valid_to", "tx_time"]

#: Keys that a write touches, and the rows that they have after it.
Delta = tuple[DataFrame, DataFrame]


def merged(quads: DataFrame, delta: Delta) -> DataFrame:
    """The table after a delta."""
    keys, rows = delta
    return quads.join(keys.select(*KEY), KEY, "left_anti").select(*quads.columns).union(rows.select(*quads.columns))


def merged_all(quads: DataFrame, deltas: list[Delta]) -> DataFrame:
    """The table after several deltas, the later above the earlier: one join with the last delta that touches each key."""
    if not deltas:
        return quads
    touched = reduce(lambda a, b: a.union(b), [k.select(*KEY, F.lit(i).alias("__last")) for i, (k, _) in enumerate(deltas, 1)]).groupBy(*KEY).agg(F.max("__last").alias("__last"))
    rows = reduce(lambda a, b: a.union(b), [r.select(*quads.columns, F.lit(i).alias("__of")) for i, r in enumerate([quads, *[r for _, r in deltas]])])
    return rows.join(touched, KEY, "left").where("__last IS NULL OR __of = __last").select(*quads.columns)


def insert(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Quads after inserting new ones."""
    return merged(quads, insert_delta(quads, new))


def delete(quads: DataFrame, keys: DataFrame, valid_from=None, valid_to=None) -> DataFrame:
    """Quads after soft deletion."""
    return merged(quads, delete_delta(quads, keys, valid_from, valid_to))


def insert_versioned(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Quads after an insert of the profile without validity."""
    return merged(quads, versioned_delta(quads, new))


def clear(quads: DataFrame, where) -> DataFrame:
    """Quads after soft deletion of graphs."""
    return merged(quads, clear_delta(quads, where))


def insert_delta(quads: DataFrame, new: DataFrame) -> Delta:
    """The delta of inserting new quads (of the same columns).

    A fact that is open-ended and already held open-ended is not inserted again; an exact repetition is left out; a live
    fact that the next insert of the same quad overlaps ends where that begins. The result does not depend on the order of
    the batch. Quads that the batch does not touch are passed through.
    """
    mine = quads.join(new.select(*KEY).distinct(), KEY, "left_semi").select(*quads.columns)
    open_now = mine.where(~F.col("is_deleted") & (F.col("valid_to") >= F.lit(OPEN_FROM).cast("timestamp"))).select(*KEY).distinct()
    is_open = F.col("valid_to") >= F.lit(OPEN_FROM).cast("timestamp")
    fresh = new.where(~is_open).union(new.where(is_open).join(open_now, KEY, "left_anti").select(*new.columns))
    touched = fresh.select(*KEY).distinct()
    inside = mine.join(touched, KEY, "left_semi").select(*quads.columns).withColumn("new", F.lit(False)).union(fresh.select(*quads.columns).withColumn("new", F.lit(True)))
    inside = inside.repartition(*KEY)  # the one shuffle that both windows need
    # what is there already comes first among equal rows
    again = F.row_number().over(Window.partitionBy(*FIELDS).orderBy("new", "is_deleted"))
    inside = inside.withColumn("again", again).where("again = 1")
    by_time = Window.partitionBy(*KEY, "is_deleted").orderBy("valid_from", "valid_to", "tx_time")
    after, by_new = F.lead("valid_from").over(by_time), F.lead("new").over(by_time)
    cut = ~F.col("is_deleted") & by_new & (F.col("valid_to") > after) & (F.col("valid_from") < after)
    inside = inside.withColumn("valid_to", F.when(cut, after).otherwise(F.col("valid_to")))
    return touched, inside.select(*quads.columns)


def delete_delta(quads: DataFrame, keys: DataFrame, valid_from=None, valid_to=None) -> Delta:
    """The delta of soft deletion of the first live fact of each key that overlaps [valid_from, valid_to) (default: any)."""
    keys = keys.select(*KEY).distinct()
    overlaps = ~F.col("is_deleted")
    if valid_to is not None:
        overlaps &= F.col("valid_from") < valid_to
    if valid_from is not None:
        overlaps &= F.col("valid_to") > valid_from
    inside = quads.join(keys, KEY, "left_semi").select(*quads.columns).withColumn("live", overlaps)
    first = F.row_number().over(Window.partitionBy(*KEY, "live").orderBy("valid_from", "valid_to", "tx_time"))
    inside = inside.withColumn("gone", F.col("live") & (first == 1))
    inside = inside.withColumn("is_deleted", F.col("is_deleted") | F.col("gone")).withColumn("version", F.col("version") + F.col("gone").cast("int"))
    return keys, inside.select(*quads.columns)


def versioned_delta(quads: DataFrame, new: DataFrame) -> Delta:
    """The delta of an insert without validity: a live fact stays, a deleted one lives again with its version raised."""
    keys = new.select(*KEY).distinct()
    back = quads.join(keys, KEY, "left_semi").select(*quads.columns)
    back = back.withColumn("version", F.col("version") + F.col("is_deleted").cast("int")).withColumn("is_deleted", F.lit(False))
    return keys, back.union(new.dropDuplicates(KEY).join(back.select(*KEY).distinct(), KEY, "left_anti").select(*quads.columns))


def clear_delta(quads: DataFrame, where) -> Delta:
    """The delta of soft deletion of all live facts whose graph satisfies a condition; it has the graphs' rows alone."""
    inside = quads.where(where)
    live = ~F.col("is_deleted")
    rows = inside.withColumn("version", F.when(live, F.col("version") + 1).otherwise(F.col("version"))).withColumn("is_deleted", F.lit(True))
    return inside.select(*KEY).distinct(), rows
