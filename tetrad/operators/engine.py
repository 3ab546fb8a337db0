"""The engine: SPARQL queries and updates over a store of quads, or queries over tables seen as a graph."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, fields, is_dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans import algebra as A
from ..plans import compiler as C
from ..plans.parser import parse_query, parse_update
from ..plans.paths import checkpointed
from . import quads as Q
from . import writes as W


def _context(spark: SparkSession, source, q, **more) -> C.Context:
    clause = bool(q.from_graphs or q.from_named)
    return C.Context(spark, source, None, tuple(q.from_graphs) if clause else None, tuple(q.from_named) if clause else None, **more)


def run_query(q: A.Query, ctx: C.Context, terms: bool = False) -> DataFrame:
    """The result of a parsed query: variables of SELECT, one boolean of ASK, triples of CONSTRUCT and DESCRIBE."""
    if q.form == "ASK":
        return C.ask(q, ctx)
    if q.form == "DESCRIBE":
        return C.describe(q, ctx)
    if q.form == "CONSTRUCT":
        return C.construct(q.template, C._full(C.group(q.where, ctx), ctx) if not (q.limit or q.offset or q.order_by) else C.select(replace(q, projection=[]), ctx), ctx)
    sol = C.select(q, ctx)
    return C.term_columns(sol) if terms else C.typed_columns(sol)


def explain(q: A.Query, df: DataFrame, depth: int = 0) -> str:
    """The algebra by operator, then the physical plan."""
    lines: list[str] = []

    def walk(x: object, d: int) -> None:
        pad = "  " * d
        if isinstance(x, A.Group):
            lines.append(f"{pad}Group")
            for e in x.elements:
                walk(e, d + 1)
            for f in x.filters:
                lines.append(f"{pad}  {'Exists' if isinstance(f, A.Exists) else 'Filter'} {f}")
        elif isinstance(x, A.Bgp):
            for t in x.triples:
                lines.append(f"{pad}{'Scan' if isinstance(t.p, (A.Var, A.Link, A.Term)) else 'Path'} {t.s} {t.p} {t.o}")
        elif isinstance(x, A.Union_):
            lines.append(f"{pad}Union")
            for g in x.groups:
                walk(g, d + 1)
        elif isinstance(x, A.SubSelect):
            lines.append(f"{pad}SubSelect")
            walk(x.query.where, d + 1)
        elif isinstance(x, (A.Optional_, A.Minus, A.Graph, A.Service)):
            lines.append(f"{pad}{type(x).__name__.strip('_')}")
            walk(x.group, d + 1)
        else:
            lines.append(f"{pad}{type(x).__name__} {x}")

    lines.append(q.form)
    walk(q.where, 1)
    for name, on in (("GroupBy", q.group_by), ("Having", q.having), ("OrderBy", q.order_by), ("Distinct", q.distinct), ("Limit", q.limit), ("Offset", q.offset)):
        if on:
            lines.append(f"{name} {on}")
    return "\n".join(lines) + "\n\n" + df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def measured(df: DataFrame) -> str:
    """What EXPLAIN ANALYZE adds: the query is run."""
    began = time.monotonic()
    rows = df.count()
    return f"\n\nrows: {rows}\nseconds: {time.monotonic() - began:.3f}\n"


def explain_json(q: A.Query) -> str:
    """The algebra as JSON: operators with their fields, nested as in the query."""

    def told(x: object) -> object:
        if is_dataclass(x) and not isinstance(x, type):
            return {"operator": type(x).__name__.strip("_")} | {f.name: told(getattr(x, f.name)) for f in fields(x) if getattr(x, f.name) not in (None, [], (), False)}
        if isinstance(x, (list, tuple, set)):
            return [told(y) for y in x]
        return x if isinstance(x, (str, int, float, bool)) or x is None else str(x)

    return json.dumps(told(q))


def time_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]


@dataclass
class LoadLimits:
    """What LOAD takes: seconds and bytes of a remote document, and triples of any (None: all)."""

    seconds: float = 30.0
    bytes: int = 100 << 20
    triples: int | None = None


class Store:
    """Quads with queries and updates. An update adds a delta; nothing that a reader holds changes.

    The table is a base and up to MOST_DELTAS deltas (keys touched, rows that they then have), merged when read and put
    together beyond that number. A delta is checkpointed, and costs what it touches. ``save`` and ``open`` keep the same
    parts in a folder of any Hadoop file system.
    """

    MOST_DELTAS = 8

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, profile: str = "cognitive"):
        if profile not in Q.PROFILES:
            raise ValueError(f"no profile {profile}")
        self.spark, self.profile = spark, profile
        self.base, self.deltas = quads if quads is not None else Q.empty(spark), []
        self.services: dict = {}
        self.limits = LoadLimits()
        self.counts: dict[str, int] = {}  # triples by predicate, after analyze()
        self._saved: tuple[str, list[str]] | None = None  # where base and first deltas already lie
        self._before: list[tuple] = []

    @property
    def table(self) -> DataFrame:
        return W.merged_all(self.base, self.deltas)

    @table.setter
    def table(self, quads: DataFrame) -> None:
        self.base, self.deltas, self._saved = quads, [], None

    def _apply(self, delta: W.Delta) -> None:
        keys, rows = map(checkpointed, delta)
        if keys.isEmpty() and rows.isEmpty():
            return
        self.deltas = [*self.deltas, (keys, rows)]
        if len(self.deltas) > self.MOST_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Put base and deltas together to a new base."""
        self.table = checkpointed(self.table)

    # batches

    def begin(self) -> None:
        """From here on updates can be taken back together; batches may be nested."""
        self._before.append((self.base, self.deltas, self._saved))

    def commit(self) -> None:
        if not self._before:
            raise RuntimeError("no batch has begun")
        self._before.pop()

    def rollback(self) -> None:
        """The store as it was when the batch began."""
        if not self._before:
            raise RuntimeError("no batch has begun")
        self.base, self.deltas, self._saved = self._before.pop()

    def analyze(self, most: int = 10_000) -> dict[str, int]:
        """Count the triples of the predicates, the ``most`` frequent of them; queries order their patterns by the counts."""
        rows = Q.predicate_statistics(self.table).orderBy(F.col("triples").desc(), "p").limit(most).collect()
        self.counts = {r["p"][1:-1]: r["triples"] for r in rows}
        return self.counts

    # queries

    def query(self, text: str, now: str | None = None, terms: bool = True) -> DataFrame:
        q = parse_query(text)
        now = now or time_now()
        source = Q.QuadSource(Q.view(self.table, q.temporal, now, self.profile), self.counts)
        df = run_query(q, _context(self.spark, source, q, now=now, services=self.services), terms)
        if q.explain:
            return self.spark.createDataFrame([(explain(q, df) + (measured(df) if q.explain == "ANALYZE" else ""),)], "plan string")
        return df

    def explain(self, text: str) -> str:
        q = parse_query(text)
        source = Q.QuadSource(Q.view(self.table, q.temporal, time_now(), self.profile), self.counts)
        return explain(q, run_query(q, _context(self.spark, source, q)))

    def graphs(self) -> DataFrame:
        return Q.named_graphs(self.table)

    def stats(self) -> DataFrame:
        return Q.statistics(self.table)

    # writes

    def _writable(self) -> None:
        if not Q.PROFILES[self.profile]["writable"]:
            raise Q.ProfileCapabilityError(f"the {self.profile} profile is loaded in bulk and then read only")

    def add(self, rows: DataFrame, now: str | None = None) -> None:
        """Insert quads: columns g, s, p, o, and perhaps valid_from and valid_to (default: now, open)."""
        self._writable()
        now = now or time_now()
        new = rows.select(
            "g", "s", "p", "o", (F.col("valid_from") if "valid_from" in rows.columns else F.lit(now).cast("timestamp")).cast("timestamp").alias("valid_from"),
            (F.col("valid_to") if "valid_to" in rows.columns else F.lit(Q.OPEN).cast("timestamp")).cast("timestamp").alias("valid_to"), F.lit(now).cast("timestamp").alias("tx_time"), F.lit(False).alias("is_deleted"), F.lit(1).alias("version"),
        )
        self._apply((W.insert_delta if Q.PROFILES[self.profile]["temporal"] else W.versioned_delta)(self.touched(new), new))

    def touched(self, keys: DataFrame) -> DataFrame:
        """The part of the table in which keys can lie: the range of their predicates, and of their subjects, which the
        layout of saved files lets a scan skip to."""
        r = keys.agg(*[f(c).alias(f"{n}_{c}") for c in "ps" for n, f in (("least", F.min), ("most", F.max))]).first()
        if r["least_p"] is None:
            return self.table.limit(0)
        inside = lambda df: df.where(F.col("p").between(r["least_p"], r["most_p"]) & F.col("s").between(r["least_s"], r["most_s"]))
        return W.merged_all(inside(self.base), [(inside(k), inside(x)) for k, x in self.deltas])

    def remove(self, keys: DataFrame, valid_from=None, valid_to=None) -> None:
        self._writable()
        self._apply(W.delete_delta(self.touched(keys), keys, valid_from, valid_to))

    def bulk_load(self, rows: DataFrame, now: str | None = None) -> None:
        """Append quads without regard to what is there, each once: the only way into read-only profiles."""
        keys = ["s", "p", "o"] if not Q.PROFILES[self.profile]["graph"] else W.KEY
        new = Q.from_triples(rows if Q.PROFILES[self.profile]["graph"] else rows.drop("g"), tx_time=now or time_now())
        self.table = checkpointed(self.table.union(new).dropDuplicates(keys))

    def update(self, text: str, now: str | None = None) -> int:
        """Run all operations of an update, each on what the one before left. Returns how many there were."""
        self._writable()
        operations = parse_update(text)
        for u in operations:
            self.apply(u, now or time_now())
        return len(operations)

    def _rows(self, quads: list, sol, ctx: C.Context, default: str) -> DataFrame:
        """Quads of a template over solutions, each once."""
        parts = []
        for g, t in quads:
            if isinstance(g, A.Var):
                whole = sol.df.select(T.term(sol.value(g.name)).alias("g"), *[self._node(n, sol).alias(c) for c, n in (("s", t.s), ("p", t.p), ("o", t.o))])
                parts.append(whole.dropna().select("g", "s", "p", "o"))
            else:
                parts.append(C.construct([t], sol, ctx).select(F.lit(g.text if g else default).alias("g"), "s", "p", "o"))
        return reduce(lambda a, b: a.union(b), parts).distinct()

    @staticmethod
    def _node(n, sol):
        if isinstance(n, A.Var):
            return T.term(sol.value(n.name)) if n.name in sol.kinds else F.lit(None).cast("string")
        return F.lit(f"<{n.iri}>" if isinstance(n, A.Link) else n.text)

    def apply(self, u: A.Update, now: str) -> None:
        spark = self.spark
        live = Q.QuadSource(Q.view(self.table, A.Temporal(), now, self.profile))
        ctx = C.Context(spark, live, now=now, services=self.services)
        if u.kind in ("INSERT DATA", "DELETE DATA"):
            rows = self._rows(u.inserts or u.deletes, C.unit(ctx), ctx, "")
            self.add(rows, now) if u.inserts else self.remove(rows)
        elif u.kind == "MODIFY":
            default = f"<{u.with_graph}>" if u.with_graph else ""
            if u.using or u.using_named:
                ctx = replace(ctx, default_graphs=tuple(u.using), named_graphs=tuple(u.using_named))
            elif u.with_graph:
                ctx = replace(ctx, graph=A.Term(default))
            sol = C._full(C.group(u.where, ctx), ctx)
            sol = C.Solutions(checkpointed(sol.df), sol.kinds, sol.maybe)  # evaluated once, before anything changes
            ctx = replace(ctx, graph=None)
            deletes = self._rows(u.deletes, sol, ctx, default) if u.deletes else None
            inserts = self._rows(u.inserts, sol, ctx, default) if u.inserts else None
            if deletes is not None:
                self.remove(deletes)
            if inserts is not None:
                self.add(inserts, now)
        elif u.kind in ("CLEAR", "DROP"):
            where = {"DEFAULT": F.col("g") == "", "NAMED": F.col("g") != "", "ALL": F.lit(True)}.get(u.target, F.col("g") == f"<{u.target}>")
            self._apply(W.clear_delta(self.table, where))
        elif u.kind in ("COPY", "MOVE", "ADD"):
            a, b = ("" if x == "DEFAULT" else f"<{x}>" for x in (u.source, u.target))
            if a == b:
                return
            rows = checkpointed(live.df.where(F.col("g") == a).select(F.lit(b).alias("g"), "s", "p", "o"))
            if u.kind != "ADD":
                self._apply(W.clear_delta(self.table, F.col("g") == b))
            self.add(rows, now)
            if u.kind == "MOVE":
                self._apply(W.clear_delta(self.table, F.col("g") == a))
        elif u.kind == "LOAD":
            from ..sources.rdf import fetched, read_rdf

            try:
                remote = u.source.startswith(("http://", "https://"))
                rows = fetched(spark, u.source, self.limits.seconds, self.limits.bytes) if remote else read_rdf(spark, u.source.removeprefix("file://"))
                if self.limits.triples is not None and rows.limit(self.limits.triples + 1).count() > self.limits.triples:
                    raise ValueError(f"{u.source} has more than {self.limits.triples} triples")
                self.add(rows.select(F.lit(f"<{u.target}>").alias("g") if u.target else F.col("g"), "s", "p", "o"), now)
            except Exception:
                if not u.silent:
                    raise

    # snapshots

    def save(self, path: str) -> str:
        """Write what the folder does not hold yet, and publish it as the current state; earlier states stay.

        What is published is a new file that names the base's folder and those of the deltas. It is only ever created, so a
        crash leaves the state before, and of two writers of one state the later fails.
        """
        fs, hadoop = _file_system(self.spark, path)
        n = 1 + max([int(x.getPath().getName()[5:]) for x in (fs.listStatus(hadoop(path)) if fs.exists(hadoop(path)) else []) if x.getPath().getName().startswith("snap-")], default=0)
        place, names = self._saved if self._saved and self._saved[0].rsplit("/", 1)[0] == path else (f"{path}/base-{n:08d}", None)
        if names is None:
            Q.read_store_layout(self.base).write.mode("overwrite").parquet(place)
            names = []
        for i, (keys, rows) in enumerate(self.deltas[len(names) :], len(names)):
            names = [*names, f"delta-{n:08d}-{i}"]
            keys.write.mode("overwrite").parquet(f"{path}/{names[-1]}/keys")
            Q.read_store_layout(rows).write.mode("overwrite").parquet(f"{path}/{names[-1]}/rows")
        out = fs.create(hadoop(f"{path}/snap-{n:08d}"), False)
        out.write(" ".join([self.profile, place.rsplit("/", 1)[1], *names]).encode())
        out.close()
        self._saved = place, names
        return f"snap-{n:08d}"

    @classmethod
    def open(cls, spark: SparkSession, path: str, published: str | None = None) -> Store:
        """The current state of a folder, or an earlier one by name. FileNotFoundError if none has been published."""
        fs, hadoop = _file_system(spark, path)
        there = [x.getPath().getName() for x in (fs.listStatus(hadoop(path)) if fs.exists(hadoop(path)) else [])]
        name = published or max((x for x in there if x.startswith("snap-")), default=None)
        if name not in there:
            raise FileNotFoundError(f"no store in {path}")
        profile, base, *names = spark.read.text(f"{path}/{name}").first()[0].split(" ")
        store = cls(spark, spark.read.schema(Q.SCHEMA).parquet(f"{path}/{base}"), profile)
        keys = ", ".join(f"{c} string" for c in W.KEY)
        store.deltas = [(spark.read.schema(keys).parquet(f"{path}/{d}/keys"), spark.read.schema(Q.SCHEMA).parquet(f"{path}/{d}/rows")) for d in names]
        store._saved = f"{path}/{base}", names
        return store


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


class StorePool:
    """Named stores of a root folder, one of them active."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.stores, self.active = spark, root, {}, None

    def get_or_create(self, name: str, profile: str = "cognitive") -> Store:
        if name not in self.stores:
            try:
                self.stores[name] = Store.open(self.spark, f"{self.root}/{name}")
            except FileNotFoundError:
                self.stores[name] = Store(self.spark, profile=profile)
        self.active = self.active or name
        return self.stores[name]

    def switch(self, name: str) -> Store:
        self.active = name
        return self.get_or_create(name)

    def delete(self, name: str) -> None:
        self.stores.pop(name, None)
        fs, hadoop = _file_system(self.spark, self.root)
        fs.delete(hadoop(f"{self.root}/{name}"), True)
        if self.active == name:
            self.active = next(iter(self.stores), None)

    def save(self, name: str) -> str:
        return self.get_or_create(name).save(f"{self.root}/{name}")


class TableEngine:
    """SPARQL over relational tables seen as a graph; values keep their native types."""

    def __init__(self, spark: SparkSession, source):
        self.spark, self.source, self.services = spark, source, {}

    def query(self, text: str, terms: bool = False, now: str = "2000-01-01T00:00:00") -> DataFrame:
        q = parse_query(text, prefixes={"": "urn:t:"})
        return run_query(q, _context(self.spark, self.source, q, now=now, services=self.services), terms)

    def explain(self, text: str) -> str:
        return explain(parse_query(text, prefixes={"": "urn:t:"}), self.query(text))
