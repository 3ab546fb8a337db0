"""Filtered copies of a store: which graphs and predicates stay, and how much of their history."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quads import OPEN, ProfileCapabilityError, as_of

HISTORY = ("flatten_to_current", "preserve_versions", "preserve_all")


@dataclass
class PruneOptions:
    """Empty inclusions keep everything; exclusions win. include_default: whether the default graph counts as included."""

    history: str = "flatten_to_current"
    include_graphs: tuple[str, ...] = ()
    exclude_graphs: tuple[str, ...] = ()
    include_predicates: tuple[str, ...] = ()
    exclude_predicates: tuple[str, ...] = ()
    include_default: bool = True


def condition(o: PruneOptions) -> Column:
    terms = lambda names: [f"<{n}>" for n in names]
    parts: list[Column] = [F.lit(True)]
    if o.include_graphs:
        parts.append(F.col("g").isin(terms(o.include_graphs)) | (F.lit(o.include_default) & (F.col("g") == "")))
    if o.exclude_graphs:
        parts.append(~F.col("g").isin(terms(o.exclude_graphs)))
    if o.include_predicates:
        parts.append(F.col("p").isin(terms(o.include_predicates)))
    if o.exclude_predicates:
        parts.append(~F.col("p").isin(terms(o.exclude_predicates)))
    return reduce(lambda a, b: a & b, parts)


def prune(quads: DataFrame, options: PruneOptions, now: str, profile: str = "cognitive") -> DataFrame:
    """The quads of a filtered copy. Flattened, facts that hold now hold from now on; versions leave out deleted rows."""
    if profile == "reference":
        raise ProfileCapabilityError("a reference store is not pruned")
    kept = quads.where(condition(options))
    if options.history == "preserve_all":
        return kept
    if options.history == "preserve_versions":
        return kept.where("not is_deleted")
    flat = as_of(kept, F.lit(now).cast("timestamp")).dropDuplicates(["g", "s", "p", "o"])
    return flat.withColumn("valid_from", F.lit(now).cast("timestamp")).withColumn("valid_to", F.lit(OPEN).cast("timestamp")).withColumn("version", F.lit(1))


def checksum(quads: DataFrame) -> DataFrame:
    """rows and an order-free checksum of (g, s, p, o, validity)."""
    return quads.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64("g", "s", "p", "o", "valid_from", "valid_to").cast("decimal(38,0)")), F.lit(0)).alias("checksum"))


def dry_run(quads: DataFrame, options: PruneOptions, now: str) -> DataFrame:
    """How many quads would stay of how many, by graph."""
    kept = prune(quads, options, now).groupBy("g").agg(F.count("*").alias("kept"))
    return quads.groupBy("g").agg(F.count("*").alias("total")).join(kept, "g", "left").select("g", "total", F.coalesce("kept", F.lit(0)).alias("kept"))


def verified(quads: DataFrame, copy: DataFrame, options: PruneOptions, now: str) -> Column:
    """Whether a copy holds what pruning its source gives, by rows and checksum; both are read."""
    a, b = checksum(prune(quads, options, now)).first(), checksum(copy).first()
    return F.lit(a == b)


def audit(quads: DataFrame, copy: DataFrame, options: PruneOptions, now: str) -> DataFrame:
    """One row that tells what was pruned when and how: time, options as JSON, rows before and after, and the checksum."""
    kept = checksum(copy).select(F.col("rows").alias("kept"), "checksum")
    return quads.agg(F.count("*").alias("total")).crossJoin(kept).select(F.lit(now).cast("timestamp").alias("time"), F.lit(json.dumps(asdict(options), sort_keys=True)).alias("options"), "total", "kept", "checksum")
