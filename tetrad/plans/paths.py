"""Property paths: relations (s, o) of terms or of native keys, built from steps; closures are iterated joins.

A closure keeps the pairs found so far and joins only the last round's new ones, so each edge is followed once from each
start. Starts come from the bound side where there is one: a term, or what the patterns before have bound. Every round ends
in a checkpoint of its new pairs; those of earlier rounds are written again only every COMPACT rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import Value
from . import algebra as A
from .solutions import Solutions, name_of

MOST_ROUNDS, COMPACT = 10_000, 16


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder; only a local session that names none gets a folder of its own."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tetrad-"))
    return df.checkpoint()


class Known:
    """A growing set of rows: the rounds' new ones, each checkpointed once, and put together now and then."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    @property
    def df(self) -> DataFrame:
        return reduce(lambda a, b: a.union(b), self.parts)

    def add(self, delta: DataFrame) -> None:
        self.parts.append(delta)
        if len(self.parts) > COMPACT:
            self.parts = [checkpointed(self.df)]


class Relation:
    """Pairs s, o with the kinds of both columns."""

    def __init__(self, df: DataFrame, s: tuple, o: tuple):
        self.df, self.s, self.o = df.select("s", "o"), s, o

    def as_terms(self) -> Relation:
        if self.s[0] == self.o[0] == "term":
            return self
        df = self.df.select(T.term(Value(F.col("s"), *self.s)).alias("s"), T.term(Value(F.col("o"), *self.o)).alias("o"))
        return Relation(df, ("term", None), ("term", None))

    def swapped(self) -> Relation:
        return Relation(self.df.select(F.col("o").alias("s"), F.col("s").alias("o")), self.o, self.s)


def _like(parts: list[Relation]) -> list[Relation]:
    """The relations with each side's kind the same in all of them."""
    s, o = (len({getattr(r, c) for r in parts}) > 1 for c in "so")
    out = []
    for r in parts:
        of = lambda c, kind, turned: (T.term(Value(F.col(c), *kind)) if turned else F.col(c)).alias(c)
        out.append(Relation(r.df.select(of("s", r.s, s), of("o", r.o, o)), ("term", None) if s else r.s, ("term", None) if o else r.o))
    return out


def relation(path: object, ctx) -> Relation:
    """All pairs that a path joins; a bag for sequences and alternatives, a set for repetitions."""
    if isinstance(path, A.Link):
        sol = ctx.source.match(A.Var("s"), A.Term(f"<{path.iri}>"), A.Var("o"), ctx)
        return Relation(sol.df.select(F.col("`?s`").alias("s"), F.col("`?o`").alias("o")), sol.kinds["s"], sol.kinds["o"])
    if isinstance(path, A.Inverse):
        return relation(path.path, ctx).swapped()
    if isinstance(path, A.Sequence):
        out = relation(path.parts[0], ctx)
        for p in path.parts[1:]:
            out = _then(out, relation(p, ctx))
        return out
    if isinstance(path, A.Alternative):
        parts = _like([relation(p, ctx) for p in path.parts])
        return Relation(reduce(lambda a, b: a.union(b), [r.df for r in parts]), parts[0].s, parts[0].o)
    if isinstance(path, A.Negated):
        quads = ctx.source.quads(ctx).select("s", "p", "o")
        parts = []
        if path.forward or not path.inverse:
            parts.append(quads.where(~F.col("p").isin([f"<{x}>" for x in path.forward])).select("s", "o"))
        if path.inverse:
            parts.append(quads.where(~F.col("p").isin([f"<{x}>" for x in path.inverse])).select(F.col("o").alias("s"), F.col("s").alias("o")))
        return Relation(reduce(lambda a, b: a.union(b), parts), ("term", None), ("term", None))
    if isinstance(path, A.Repeat):
        return closure(path, ctx, None, None)
    raise ValueError(f"no plan for {path}")


def _then(a: Relation, b: Relation) -> Relation:
    if a.o != b.s:
        a, b = a.as_terms(), b.as_terms()
    x, y = a.df.select("s", F.col("o").alias("m")), b.df.select(F.col("s").alias("m2"), "o")
    return Relation(x.join(y, F.col("m") == F.col("m2")).select("s", "o"), a.s, b.o)


def nodes(ctx) -> DataFrame:
    """All terms that are subjects or objects of the graph."""
    quads = ctx.source.quads(ctx)
    return quads.select("s").union(quads.select("o")).distinct().toDF("n")


def closure(path: A.Repeat, ctx, start: str | DataFrame | None, end: str | DataFrame | None) -> Relation:
    """p?, p* and p+ as a set of pairs, from a bound start or to a bound end if one is given.

    A bound side is a term in N-Triples, or a DataFrame whose column n has the terms that other patterns bind it to.
    """
    step = relation(path.path, ctx)
    if step.s != step.o or start is not None or end is not None or path.least == 0:
        step = step.as_terms()
    edges = step.df.where("s is not null and o is not null").distinct()
    backward = start is None and end is not None
    if backward:
        edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
    seed = end if backward else start
    from_seed = lambda df, c: df if seed is None else df.where(F.col(c) == seed) if isinstance(seed, str) else df.join(seed.select(F.col("n").alias("~n")), F.col(c) == F.col("~n"), "left_semi")
    if path.many:
        edges = checkpointed(edges)
        delta = from_seed(edges, "s") if seed is None else checkpointed(from_seed(edges, "s"))
        known = Known(delta)
        for _ in range(MOST_ROUNDS):
            hop = delta.select("s", F.col("o").alias("m")).join(edges.select(F.col("s").alias("m2"), F.col("o").alias("t")), F.col("m") == F.col("m2"))
            new = hop.select("s", F.col("t").alias("o")).distinct()
            both = known.df.select(F.col("s").alias("ks"), F.col("o").alias("ko"))
            delta = checkpointed(new.join(both, (F.col("s") == F.col("ks")) & (F.col("o") == F.col("ko")), "left_anti"))
            if delta.isEmpty():
                break
            known.add(delta)
        else:
            raise RuntimeError("a property path did not end")
        pairs = known.df
    else:
        pairs = from_seed(edges, "s")
    if path.least == 0:
        if isinstance(seed, str):
            zero = ctx.spark.createDataFrame([(seed, seed)], "s string, o string")
        else:
            zero = from_seed(nodes(ctx), "n").select(F.col("n").alias("s"), F.col("n").alias("o"))
        pairs = pairs.union(zero).distinct()
    out = Relation(pairs, step.s, step.o)
    return out.swapped() if backward else out


def bound_side(n: A.Node, sol: Solutions | None) -> str | DataFrame | None:
    """What a path's end is bound to: a term, or the terms of a variable that all solutions bind."""
    if isinstance(n, A.Term):
        return n.text
    if sol is None or sol.unit or n.name not in sol.kinds or n.name in sol.maybe:
        return None
    return sol.df.select(T.term(sol.value(n.name)).alias("n")).distinct()


def path_pattern(t: A.Triple, ctx, sol: Solutions | None = None) -> Solutions:
    """The solutions of a pattern with a path. In GRAPH ?g the path is walked in each graph by itself. ``sol``: what the
    patterns before have found, from which repetitions start."""
    if isinstance(ctx.graph, A.Var):
        from dataclasses import replace

        from .solutions import union

        graphs = [r[0] for r in ctx.source.graphs(ctx).collect()]  # names of graphs, one plan each
        parts = [path_pattern(t, replace(ctx, graph=A.Term(g)), sol).extend(ctx.graph.name, Value(F.lit(g), "term"), maybe=False) for g in graphs]
        return reduce(union, parts) if parts else Solutions(ctx.spark.createDataFrame([], ", ".join(f"`?{n}` string" for n in A.variables(t) | {ctx.graph.name})), {n: ("term", None) for n in A.variables(t) | {ctx.graph.name}})
    if isinstance(t.p, A.Sequence) and not isinstance(t.s, A.Term) and not isinstance(t.o, A.Term):
        r = relation(t.p, ctx)
    elif isinstance(t.p, A.Repeat):
        start = bound_side(t.s, sol)
        r = closure(t.p, ctx, start, bound_side(t.o, sol) if start is None or isinstance(t.o, A.Term) else None)
    else:
        r = relation(t.p, ctx)
    df, wanted = r.df, {}
    for node, c, kind in ((t.s, "s", r.s), (t.o, "o", r.o)):
        if isinstance(node, A.Term):
            df = df.where(T.term(Value(F.col(c), *kind)) == node.text)
        elif node.name in wanted:
            other, other_kind = wanted[node.name]
            df = df.where(T.term(Value(F.col(other), *other_kind)) == T.term(Value(F.col(c), *kind)))
        else:
            wanted[node.name] = (c, kind)
    if not wanted:
        return Solutions(df.select(F.lit(0).alias("?\0")), {"\0": ("integer", None)})
    return Solutions(df.select(*[F.col(c).alias(name_of(n)) for n, (c, _) in wanted.items()]), {n: k for n, (_, k) in wanted.items()})
