"""Relational tables as a graph: a row is a subject, a column a predicate, a foreign key an edge.

Nothing is copied: a pattern over a predicate is a projection of its table, and patterns that share a subject over one table
become one scan of all their columns. IRIs are templates around native keys, built only where a result shows them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import RDF, Value
from ..plans import algebra as A
from ..plans.solutions import Solutions, name_of

NS = "urn:t:"

_KINDS = {"bigint": "integer", "int": "integer", "double": "double", "float": "double", "string": "string", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "dateTime"}


@dataclass
class Table:
    """A table: its name, the expression of its rows' key, and the columns that are keys of other tables."""

    name: str
    key: str
    links: dict[str, str] = field(default_factory=dict)
    skip: tuple[str, ...] = ()

    @property
    def template(self) -> tuple[str, str]:
        return (f"{NS}{self.name}/", "")


#: The driver's tables. lineitem has no unique key of its own columns but the hash of all.
TABLES = (
    Table("region", "r_regionkey"), Table("nation", "n_nationkey", {"n_regionkey": "region"}), Table("customer", "c_custkey", {"c_nationkey": "nation"}),
    Table("supplier", "s_suppkey", {"s_nationkey": "nation"}), Table("part", "p_partkey"), Table("orders", "o_orderkey", {"o_custkey": "customer"}),
    Table("lineitem", "xxhash64(*)", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}), Table("events", "event_id"),
    Table("documents", "doc_id"), Table("labels", "doc_id"), Table("pages", "page_id"), Table("benchmark", "item_id"),
    Table("conversations", "concat(conv_id, '-', turn)"),
)


class TableSource:
    """Matches patterns against tables; for variable predicates and negated paths, against their quads."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: tuple[Table, ...] = TABLES):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = {t.name: t for t in tables}
        self._frames: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def predicate(self, iri: str) -> tuple[str, str] | None:
        """(table, column) of a predicate: the column's name alone if it says the table, else table.column."""
        if not iri.startswith(NS):
            return None
        name = iri.removeprefix(NS)
        if "." in name:
            table, column = name.split(".", 1)
            return (table, column) if table in self.tables and column in self.frame(table).columns else None
        for t in self.tables.values():
            if name[:2] == f"{t.name[0]}_" and name in self.frame(t.name).columns and t.name not in ("events", "documents", "labels", "pages", "benchmark", "conversations"):
                return t.name, name
        return None

    def estimate(self, iri: str) -> float | None:
        """About how many triples a predicate has: its table's bytes, which Spark knows without reading it, by 16 a cell."""
        found = self.predicate(iri)
        return self.rows(found[0]) if found else None

    def rows(self, table: str) -> float:
        df = self.frame(table)
        return float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) / (16 * len(df.columns))

    def distinct(self, iri: str, subject: bool) -> float | None:
        """About how many different subjects or objects a predicate has: a key's are all, a link's are keys of its table."""
        found = self.predicate(iri)
        if not found:
            return None
        t, column = self.tables[found[0]], found[1]
        if subject or column == t.key:
            return self.rows(t.name)
        return min(self.rows(t.name), self.rows(t.links[column])) if column in t.links else self.rows(t.name) ** 0.5

    def value(self, table: str, column: str) -> Value:
        t = self.tables[table]
        if column in t.links:
            return Value(F.col(column), "iri", self.tables[t.links[column]].template)
        kind = _KINDS.get(dict(self.frame(table).dtypes)[column], "string")
        return Value(F.col(column).cast("string") if kind == "string" else F.col(column).cast("long") if kind == "integer" else F.col(column), kind)

    def subject(self, table: str) -> Value:
        t = self.tables[table]
        return Value(F.expr(t.key.replace("*", ", ".join(self.frame(table).columns))), "iri", t.template)

    def _equals(self, table: str, v: Value, t: str) -> Column:
        """A column that equals a constant term, on native values where it can be."""
        kind, text, _, _ = T.parse_term(t)
        if v.kind == "iri":
            key = text.removeprefix(v.template[0])
            if kind != "iri" or key == text:
                return F.lit(False)
            if self.frame(table).select(v.column.alias("k")).dtypes[0][1] == "string":
                return v.column == key
            # the literal takes the column's type, so that the comparison reaches the files
            return v.column == int(key) if key.lstrip("-").isdecimal() and str(int(key)) == key and abs(int(key)) < 1 << 63 else F.lit(False)
        c = T.constant(t)
        if c.kind == v.kind and c.kind in ("integer", "double", "string", "boolean"):
            return v.column == c.column
        return T.term(v) == t

    def _scan(self, table: str, s: A.Node, columns: list[tuple[str, A.Node]]) -> Solutions:
        """One scan of a table for patterns with one subject. A null cell is no triple."""
        df, wanted = self.frame(table), {}
        conditions: list[Column] = []

        def bind(n: A.Node, v: Value) -> None:
            if isinstance(n, A.Term):
                conditions.append(self._equals(table, v, n.text))
            elif n.name in wanted:
                conditions.append(T.term(wanted[n.name]) == T.term(v))
            else:
                wanted[n.name] = v

        bind(s, self.subject(table))
        for c, o in columns:
            v = self.value(table, c)
            if not isinstance(o, A.Term):
                conditions.append(F.col(c).isNotNull())
            bind(o, v)
        if conditions:
            df = df.where(reduce(lambda x, y: x & y, conditions))
        if not wanted:
            return Solutions(df.select(F.lit(0).alias("?\0")).limit(1), {"\0": ("integer", None)})
        return Solutions(df.select(*[v.column.alias(name_of(n)) for n, v in wanted.items()]), {n: v.signature for n, v in wanted.items()})

    def stars(self, triples: list[A.Triple], ctx) -> list:
        """(patterns, maker) for patterns that one scan answers: one subject, one table, each column once."""
        if ctx.graph is not None:
            return []
        groups: dict = {}
        for t in triples:
            if isinstance(t.p, A.Link) and (found := self.predicate(t.p.iri)):
                groups.setdefault((t.s, found[0]), []).append((t, found[1]))
        out = []
        for (s, table), members in groups.items():
            classes = [t for t in triples if t.s == s and isinstance(t.p, A.Link) and t.p.iri == RDF + "type" and isinstance(t.o, A.Term) and t.o.text == f"<{NS}{table}>"]
            used = [t for t, _ in members] + classes
            out.append((used, lambda s=s, table=table, members=members: self._scan(table, s, [(c, t.o) for t, c in members])))
        return out

    def match(self, s: A.Node, p: A.Node, o: A.Node, ctx) -> Solutions:
        if ctx.graph is not None:
            return Solutions(self.spark.createDataFrame([], ", ".join(f"`?{n}` string" for n in A.variables(A.Triple(s, p, o)) or {"\0"})), {n: ("term", None) for n in A.variables(A.Triple(s, p, o)) or {"\0"}})
        if isinstance(p, A.Term):
            iri = p.text[1:-1]
            if found := self.predicate(iri):
                return self._scan(found[0], s, [(found[1], o)])
            if iri == RDF + "type" and isinstance(o, A.Term) and o.text[1:-1].removeprefix(NS) in self.tables:
                return self._scan(o.text[1:-1].removeprefix(NS), s, [])
        from ..operators.quads import QuadSource

        return QuadSource(self.quads(ctx)).match(s, p, o, ctx)

    def quads(self, ctx=None, names: tuple[str, ...] | None = None) -> DataFrame:
        """The tables as quads of terms, in the default graph."""
        parts = []
        for name in names or tuple(self.tables):
            df, subject = self.frame(name), T.term(self.subject(name))
            cells = [F.struct(F.lit(f"<{RDF}type>").alias("p"), F.lit(f"<{NS}{name}>").alias("o"))]
            for c in df.columns:
                iri = NS + c if self.predicate(NS + c) == (name, c) else f"{NS}{name}.{c}"
                cells.append(F.struct(F.lit(f"<{iri}>").alias("p"), T.term(self.value(name, c)).alias("o")))
            parts.append(df.select(subject.alias("s"), F.explode(F.array(*cells)).alias("c")).select(F.lit("").alias("g"), "s", "c.p", "c.o").where("o is not null"))
        return reduce(lambda a, b: a.union(b), parts)

    def graphs(self, ctx) -> DataFrame:
        return self.spark.createDataFrame([], "g string")
