"""The quad table: its schema and profiles, temporal views, and the patterns that are matched against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import algebra as A
from ..plans.solutions import Solutions, name_of

SCHEMA = "g string, s string, p string, o string, valid_from timestamp, valid_to timestamp, tx_time timestamp, is_deleted boolean, version int"
#: The open end of a validity, and from when on an end counts as open.
OPEN, OPEN_FROM = "9999-12-31 23:59:59.999", "9000-01-01 00:00:00"
BEGIN = "0001-01-01 00:00:00"

#: What each profile keeps: graphs, validity, versions; and whether it takes session writes.
PROFILES = {
    "cognitive": {"graph": True, "temporal": True, "versioned": True, "writable": True},
    "graph": {"graph": True, "temporal": False, "versioned": True, "writable": True},
    "reference": {"graph": True, "temporal": False, "versioned": False, "writable": False},
    "minimal": {"graph": False, "temporal": False, "versioned": False, "writable": False},
}


class ProfileCapabilityError(ValueError):
    """A store's profile does not have what an operation needs."""


def timestamp(text: str) -> Column:
    """An xsd:dateTime or xsd:date text in UTC, or the earliest time if it is neither."""
    return F.coalesce(F.lit(text).try_cast("timestamp"), F.lit(BEGIN).cast("timestamp"))


def as_of(quads: DataFrame, t: Column) -> DataFrame:
    """Live facts valid at t: from is included, to is not."""
    return quads.where(~F.col("is_deleted") & (F.col("valid_from") <= t) & (F.col("valid_to") > t))


def during(quads: DataFrame, a: Column, b: Column) -> DataFrame:
    """Live facts whose validity overlaps [a, b)."""
    return quads.where(~F.col("is_deleted") & (F.col("valid_from") < b) & (F.col("valid_to") > a))


def view(quads: DataFrame, temporal: A.Temporal, now: str, profile: str = "cognitive") -> DataFrame:
    """The facts that a query's temporal clause sees; all versions include deleted ones."""
    if temporal.mode != "current" and not PROFILES[profile]["temporal"]:
        raise ProfileCapabilityError(f"the {profile} profile keeps no validity")
    if not PROFILES[profile]["temporal"]:
        return quads.where(~F.col("is_deleted"))
    if temporal.mode == "as_of":
        return as_of(quads, timestamp(temporal.start))
    if temporal.mode == "during":
        return during(quads, timestamp(temporal.start), timestamp(temporal.end))
    return quads if temporal.mode == "all" else as_of(quads, timestamp(now))


def changes(quads: DataFrame, a: str, b: str) -> DataFrame:
    """Facts that begin or end to hold within [a, b)."""
    x, y = timestamp(a), timestamp(b)
    return quads.where(((F.col("valid_from") >= x) & (F.col("valid_from") < y)) | ((F.col("valid_to") >= x) & (F.col("valid_to") < y)))


def evolution(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str = "") -> DataFrame:
    """Every version of the facts of a pattern, deleted ones too, by time."""
    wanted = [F.col(c) == v for c, v in (("g", g), ("s", s), ("p", p), ("o", o)) if v is not None]
    return quads.where(reduce(lambda x, y: x & y, wanted)).orderBy("s", "p", "valid_from", "o")


def from_triples(df: DataFrame, graph: str = "", valid_from: str = BEGIN, tx_time: str = BEGIN) -> DataFrame:
    """Quads that hold from a time on, from columns s, p, o and perhaps g."""
    return df.select(
        (F.coalesce("g", F.lit("")) if "g" in df.columns else F.lit(graph)).alias("g"), "s", "p", "o",
        F.lit(valid_from).cast("timestamp").alias("valid_from"), F.lit(OPEN).cast("timestamp").alias("valid_to"), F.lit(tx_time).cast("timestamp").alias("tx_time"),
        F.lit(False).alias("is_deleted"), F.lit(1).alias("version"),
    )


class QuadSource:
    """Matches patterns against a quad DataFrame (g, s, p, o) whose temporal view has been taken."""

    def __init__(self, df: DataFrame, predicate_counts: dict[str, int] | None = None):
        self.df, self.predicate_counts = df, predicate_counts or {}

    def estimate(self, iri: str) -> float | None:
        """How many triples a predicate has, as far as that has been counted."""
        return self.predicate_counts.get(iri, 0 if self.predicate_counts else None)

    def _scoped(self, ctx) -> DataFrame:
        """Quads of the active graph; the merge of FROM's graphs holds each triple once."""
        q = self.df
        if ctx.graph is None:
            if ctx.default_graphs:
                return q.where(F.col("g").isin([f"<{g}>" for g in ctx.default_graphs])).dropDuplicates(["s", "p", "o"])
            return q.where(F.lit(False)) if ctx.named_graphs and ctx.default_graphs is not None else q.where("g = ''")
        named = q.where("g <> ''")
        if ctx.named_graphs is not None or ctx.default_graphs is not None:
            named = named.where(F.col("g").isin([f"<{g}>" for g in ctx.named_graphs or ()]))
        return named.where(F.col("g") == ctx.graph.text) if isinstance(ctx.graph, A.Term) else named

    def quads(self, ctx) -> DataFrame:
        return self._scoped(ctx)

    def graphs(self, ctx) -> DataFrame:
        from dataclasses import replace

        return self._scoped(replace(ctx, graph=A.Var("g"))).select("g").distinct()

    def match(self, s: A.Node, p: A.Node, o: A.Node, ctx) -> Solutions:
        df, columns = self._scoped(ctx), {}
        places = [("s", s), ("p", p), ("o", o)] + ([("g", ctx.graph)] if isinstance(ctx.graph, A.Var) else [])
        for c, n in places:
            if isinstance(n, A.Term):
                df = df.where(F.col(c) == n.text)
            elif n.name in columns:
                df = df.where(F.col(c) == F.col(columns[n.name]))
            else:
                columns[n.name] = c
        if not columns:
            return Solutions(df.select(F.lit(0).alias("?\0")).limit(1), {"\0": ("integer", None)})
        return Solutions(df.select(*[F.col(c).alias(name_of(n)) for n, c in columns.items()]), {n: ("term", None) for n in columns})


def named_graphs(quads: DataFrame) -> DataFrame:
    """Names of graphs that hold live facts; the default graph has none."""
    return quads.where("g <> '' and not is_deleted").select(F.col("g").alias("graph")).distinct()


def statistics(quads: DataFrame) -> DataFrame:
    """Counts of quads, live quads, graphs and distinct terms."""
    terms = reduce(lambda a, b: a.union(b), [quads.select(F.col(c).alias("t")) for c in "spo"]).distinct()
    return quads.agg(F.count("*").alias("quads"), F.sum((~F.col("is_deleted")).cast("long")).alias("live"), F.count_distinct(F.nullif("g", F.lit(""))).alias("graphs")).crossJoin(terms.agg(F.count("*").alias("terms")))


def predicate_statistics(quads: DataFrame) -> DataFrame:
    """Triples, distinct subjects and distinct objects of each predicate."""
    return quads.where("not is_deleted").groupBy("p").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def read_store_layout(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows clustered for scans by predicate: ranges of (p, s), sorted within, so that file statistics prune both."""
    ranged = df.repartitionByRange(partitions, "p", "s") if partitions else df.repartitionByRange("p", "s")
    return ranged.sortWithinPartitions("p", "s", "o")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
