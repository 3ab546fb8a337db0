"""Algebra to DataFrames.

Each element of a group becomes one DataFrame operator; Catalyst decides what is pushed down, in which order joins' sides
are built and what is broadcast. The compiler orders the patterns of a basic graph pattern, merges patterns with one subject
over one table into one scan, and keeps track of which variables can be unbound.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import terms as T
from ..functions.terms import NUMERIC, RDF, Value
from . import algebra as A
from . import paths
from .solutions import Solutions, col, join, left_join, minus, name_of, semi_join, union


@dataclass
class Context:
    """What patterns are matched against. graph: None for the default graph, or a node."""

    spark: SparkSession
    source: object
    graph: A.Node | None = None
    default_graphs: tuple[str, ...] | None = None  # FROM
    named_graphs: tuple[str, ...] | None = None  # FROM NAMED
    base: str | None = None
    now: str = "2000-01-01T00:00:00"
    services: dict = field(default_factory=dict)


def conjuncts(e: object) -> list:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if isinstance(e, A.Call) and e.name == "&&" else [e]


def unit(ctx: Context) -> Solutions:
    return Solutions(ctx.spark.sql("SELECT 0 AS `?\0`"), {"\0": ("integer", None)})


def has_exists(e: object) -> bool:
    return isinstance(e, A.Exists) or isinstance(e, A.Call) and any(map(has_exists, e.args))


# groups -------------------------------------------------------------------------------------------------------------------


def group(g: A.Group, ctx: Context, keep_filters: bool = True) -> Solutions:
    """The solutions of a group; its filters hold for all of it, wherever they stand."""
    sol = Solutions(None)
    for e in g.elements:
        if isinstance(e, A.Bgp):
            sol = join(sol, basic(e.triples, ctx))
        elif isinstance(e, A.Group):
            sol = join(sol, group(e, ctx))
        elif isinstance(e, A.Union_):
            sol = join(sol, reduce(union, [_full(group(x, ctx), ctx) for x in e.groups]))
        elif isinstance(e, A.Graph):
            sol = join(sol, named(e, ctx))
        elif isinstance(e, A.Values):
            sol = join(sol, inline(e, ctx))
        elif isinstance(e, A.SubSelect):
            sol = join(sol, select(e.query, ctx))
        elif isinstance(e, A.Service):
            sol = join(sol, service(e, sol, ctx))
        elif isinstance(e, A.Optional_):
            inner = _full(group(e.group, ctx, keep_filters=False), ctx)
            plain = [f for f in e.group.filters if not has_exists(f)]
            for f in e.group.filters:
                if has_exists(f):
                    inner = filtered(inner, f, ctx)
            sol = left_join(_full(sol, ctx), inner, lambda values, plain=plain: [S.condition(f, scope(values, ctx)) for f in plain])
        elif isinstance(e, A.Minus):
            sol = minus(sol, _full(group(e.group, ctx), ctx)) if not sol.unit else sol
        elif isinstance(e, A.Bind):
            sol = _full(sol, ctx)
            sol = sol.extend(e.var, S.compile_expression(e.expression, scope(sol.values(), ctx)))
        else:
            raise ValueError(f"no plan for {type(e).__name__}")
    if keep_filters:
        for f in g.filters:
            for part in conjuncts(f):
                sol = filtered(_full(sol, ctx), part, ctx)
    return sol


def _full(s: Solutions, ctx: Context) -> Solutions:
    return unit(ctx) if s.unit else s


def scope(values: dict[str, Value], ctx: Context, exists=None) -> S.Scope:
    return S.Scope({k: v for k, v in values.items() if k != "\0"}, exists, ctx.base, ctx.now)


def filtered(sol: Solutions, f: object, ctx: Context) -> Solutions:
    """FILTER. EXISTS at the top is a semi or anti join; within an expression it is a marker column."""
    if isinstance(f, A.Exists):
        return exists_join(sol, f, ctx)
    if isinstance(f, A.Call) and f.name == "!" and isinstance(f.args[0], A.Exists):
        return exists_join(sol, replace(f.args[0], negated=not f.args[0].negated), ctx)
    if not has_exists(f):
        return sol.filter(S.condition(f, scope(sol.values(), ctx)))
    marked, found = sol, 0

    def marker(e: A.Exists) -> Column:
        """Whether the values that the inner group sees have a solution there: they are looked up, each once, and joined."""
        nonlocal marked, found
        n, found = f"\0m{found}", found + 1
        seen = A.variables(e.group).union(*[A.mentioned(f) for f in e.group.filters if not has_exists(f)])
        names = [k for k in sol.kinds if k in seen] or list(sol.kinds)[:1]
        keys = Solutions(sol.df.select(*[col(k) for k in names]).distinct(), {k: sol.kinds[k] for k in names}, sol.maybe & set(names))
        hits = exists_join(keys, replace(e, negated=False), ctx)
        hits = hits.df.select(*[col(k).alias(f"~{k}") for k in names], F.lit(True).alias(name_of(n)))
        df = marked.df.join(hits, reduce(lambda x, y: x & y, [col(k).eqNullSafe(F.col(f"`~{k}`")) for k in names]), "left").drop(*[f"~{k}" for k in names])
        marked = Solutions(df, marked.kinds | {n: ("boolean", None)}, marked.maybe)
        return col(n).isNull() if e.negated else col(n).isNotNull()

    c = S.condition(f, scope(sol.values(), ctx, marker))
    return Solutions(marked.df.filter(c).select(*[col(n) for n in sol.kinds]), sol.kinds, sol.maybe)


def exists_join(sol: Solutions, e: A.Exists, ctx: Context) -> Solutions:
    """A filter of the inner group that mentions outer variables is a condition of the join."""
    own = A.variables(e.group)
    outer = [f for f in e.group.filters if not has_exists(f) and not A.mentioned(f) <= own]
    inner = A.Group(e.group.elements, [f for f in e.group.filters if f not in outer])
    right = _full(group(inner, ctx), ctx)
    right = Solutions(right.df, right.kinds, right.maybe)
    if "\0" in right.kinds and "\0" in sol.kinds:
        right = Solutions(right.df.withColumnRenamed("?\0", "?\0\0"), {"\0\0" if k == "\0" else k: v for k, v in right.kinds.items()}, right.maybe)
    return semi_join(sol, right, e.negated, lambda values: [S.condition(f, scope(values, ctx)) for f in outer])


def named(e: A.Graph, ctx: Context) -> Solutions:
    return _full(group(e.group, replace(ctx, graph=e.name)), ctx)


def inline(v: A.Values, ctx: Context) -> Solutions:
    """VALUES: terms in a local relation; a column of one native kind stays native."""
    kinds, columns = {}, []
    for i, n in enumerate(v.names):
        bound = [T.constant(r[i]) for r in v.rows if r[i] is not None]
        same = bound and all(b.signature == bound[0].signature for b in bound) and bound[0].kind in ("integer", "string", "iri", "double", "decimal")
        kinds[n] = bound[0].signature if same else ("term", None)
        columns.append(n)
    if not v.rows:
        return Solutions(ctx.spark.createDataFrame([], ", ".join(f"`?{n}` string" for n in v.names)), {n: ("term", None) for n in v.names})

    def cell(n: str, t: str | None):
        if t is None:
            return None
        kind = kinds[n][0]
        if kind == "term":
            return t
        text = T.parse_term(t)[1]
        return int(text) if kind == "integer" else float(text) if kind in ("double", "decimal") else text

    types = {"integer": "long", "double": "double", "decimal": "double"}
    rows = [tuple(cell(n, t) for n, t in zip(v.names, r)) for r in v.rows]
    df = ctx.spark.createDataFrame(rows, ", ".join(f"`?{n}` {types.get(kinds[n][0], 'string')}" for n in v.names))
    return Solutions(df, kinds, {n for i, n in enumerate(v.names) if any(r[i] is None for r in v.rows)})


def service(e: A.Service, sol: Solutions, ctx: Context) -> Solutions:
    """SERVICE: one call of a registered endpoint; with a variable, one for each of the endpoints bound so far."""
    names = sorted(n for n in A.variables(e.group) if not n.startswith(" "))

    def fetch(iri: str) -> list[dict]:
        try:
            f = ctx.services[iri]
            return f(f"{e.prologue}SELECT * WHERE {e.text}" if getattr(f, "whole", False) else e.text, names)
        except Exception:
            if not e.silent:
                raise
            return [{}]

    def given(rows: list[dict], names: list[str]) -> Solutions:
        data = [tuple(r.get(n) for n in names) for r in rows]
        df = ctx.spark.createDataFrame(data, ", ".join(f"`?{n}` string" for n in names))
        return Solutions(df, {n: ("term", None) for n in names}, {n for i, n in enumerate(names) if any(r[i] is None for r in data)})

    if isinstance(e.endpoint, A.Term):
        return given(fetch(e.endpoint.text[1:-1]), names)
    own = e.endpoint.name
    ends = sol.df.select(T.lexical(sol.value(own))).distinct().toLocalIterator()  # every one, each a network call
    return given([{**r, own: f"<{iri}>"} for (iri,) in ends for r in fetch(iri)], sorted({*names, own}))


# basic graph patterns -----------------------------------------------------------------------------------------------------


def _weight(t: A.Triple, source: object) -> float:
    """An estimate of a pattern's matches: the source's count of the predicate if it has one."""
    estimate = getattr(source, "estimate", lambda iri: None)
    total = 1e6
    if isinstance(t.p, (A.Link, A.Term)):
        total = estimate(t.p.iri if isinstance(t.p, A.Link) else t.p.text[1:-1])
        total = 1e4 if total is None else total
    elif not isinstance(t.p, A.Var):
        total = 1e7
    return total / (1e3 if isinstance(t.s, A.Term) else 1) / (1e2 if isinstance(t.o, A.Term) else 1)


@dataclass
class Part:
    """Patterns that one scan or path answers. weight orders what costs the same; distinct: about how many values a variable has."""

    weight: float
    rows: float
    distinct: dict[str, float]
    make: object


def part(triples: list[A.Triple], source: object, make: object) -> Part:
    """Its estimates. Where nothing is known, values of a predicate are taken for different, those of a path for repeated."""
    known = getattr(source, "distinct", lambda iri, subject: None)
    counted = [t for t in triples if t.p != A.Link(f"{RDF}type")] or triples  # in a star a class says nothing of its own
    rows, distinct = max(1.0, min(_weight(t, source) for t in counted)), {}
    for t in triples:
        iri = t.p.iri if isinstance(t.p, A.Link) else t.p.text[1:-1] if isinstance(t.p, A.Term) else None
        for n, subject in ((t.s, True), (t.p, False), (t.o, False)):
            if isinstance(n, A.Var):
                values = rows**0.5 if iri is None else known(iri, subject)
                distinct[n.name] = max(1.0, min(distinct.get(n.name, rows), rows if values is None else values))
    return Part(min(_weight(t, source) for t in triples), rows, distinct, make)


#: So many unfinished orders of as many parts are followed; up to seven parts these are all.
ORDERS = 64


def ordered(parts: list[Part]) -> list[Part]:
    """The order whose intermediate results are smallest in sum, always along shared variables where there are any.

    A join has the product of its sides' rows by the values of each shared variable: along a key it keeps its size, along a
    variable of few values (a nation shared by suppliers and customers) it grows with the square.
    """
    # by the parts used: cost, weights, rows, distinct values, order
    found: dict = {frozenset(): (0.0, (), 1.0, {}, [])}
    for _ in parts:
        longer: dict = {}
        for used, (cost, weights, rows, distinct, order) in sorted(found.items(), key=lambda x: x[1][:2])[:ORDERS]:
            left = [i for i in range(len(parts)) if i not in used]
            for i in [i for i in left if distinct.keys() & parts[i].distinct] or left:
                p = parts[i]
                size = rows * p.rows
                for n in distinct.keys() & p.distinct:
                    size /= max(distinct[n], p.distinct[n])
                both = {n: max(1.0, min(size, distinct.get(n, size), p.distinct.get(n, size))) for n in distinct | p.distinct}
                new = (float(f"{cost + size:.6g}"), (*weights, p.weight), size, both, [*order, p])
                if (k := used | {i}) not in longer or new[:2] < longer[k][:2]:
                    longer[k] = new
        found = longer
    return next(iter(found.values()))[-1]


def basic(triples: list[A.Triple], ctx: Context) -> Solutions:
    """Join of patterns, in the order that their estimates ask for."""
    if not triples:
        return Solutions(None)
    rest, parts = list(triples), []
    stars = ctx.source.stars(rest, ctx) if hasattr(ctx.source, "stars") else []
    for used, make in stars:
        rest = [t for t in rest if t not in used]
        parts.append(part(used, ctx.source, lambda sol, make=make: make()))
    for t in rest:
        parts.append(part([t], ctx.source, lambda sol, t=t: pattern(t, ctx, sol)))
    return reduce(lambda sol, p: join(sol, p.make(sol)), ordered(parts), Solutions(None))


def pattern(t: A.Triple, ctx: Context, sol: Solutions) -> Solutions:
    """A pattern's solutions; a path that repeats starts from what ``sol`` already binds."""
    if isinstance(t.p, (A.Var, A.Link, A.Term)):
        p = t.p if isinstance(t.p, (A.Var, A.Term)) else A.Term(f"<{t.p.iri}>")
        return ctx.source.match(t.s, p, t.o, ctx)
    return paths.path_pattern(t, ctx, sol)


# aggregation --------------------------------------------------------------------------------------------------------------


def _aggregates(e: object, out: list) -> None:
    if isinstance(e, A.Aggregate):
        if e not in out:
            out.append(e)
    elif isinstance(e, A.Call):
        for x in e.args:
            _aggregates(x, out)


def _replaced(e: object, by: dict) -> object:
    for k, v in by.items():
        if k == e:
            return v
    if isinstance(e, A.Call):
        return A.Call(e.name, tuple(_replaced(x, by) for x in e.args))
    return e


def aggregate(a: A.Aggregate, sol: Solutions, ctx: Context) -> Value:
    """The aggregate as a value over grouped rows."""
    if a.name == "COUNT" and a.arg is None:
        if not a.distinct:
            return Value(F.count(F.lit(1)), "integer")
        names = [n for n in sol.kinds if n != "\0"]
        return Value(F.count_distinct(F.struct(*[F.coalesce(T.term(sol.value(n)), F.lit("")) for n in names])), "integer")
    v = S.compile_expression(a.arg, scope(sol.values(), ctx))
    key = v.column if v.kind != "term" and v.lang is None and v.datatype is None else T.term(v)
    if a.name == "COUNT":
        return Value(F.count_distinct(key) if a.distinct else F.count(key), "integer")
    if a.name == "SAMPLE":
        return v.on(F.min(v.column)) if v.kind != "term" and v.lang is None and v.datatype is None else Value(F.min(key), "term")
    if a.name == "GROUP_CONCAT":
        text = T.lexical(v)
        items = F.collect_set(text) if a.distinct else F.collect_list(text)
        return Value(F.array_join(F.array_sort(items), a.separator), "string")
    if a.name in ("MIN", "MAX"):
        if v.kind != "term" and v.lang is None and v.datatype is None:
            return v.on((F.min if a.name == "MIN" else F.max)(v.column))
        return Value((F.min_by if a.name == "MIN" else F.max_by)(key, F.when(key.isNotNull(), F.struct(*S.sort_keys(Value(key, "term"))))), "term")
    total = F.sum_distinct if a.distinct else F.sum
    if v.kind in NUMERIC:
        if a.name == "SUM":
            return Value(F.coalesce(total(v.column), F.lit(0).cast("long" if v.kind == "integer" else "double")), v.kind)
        count = F.count_distinct(v.column) if a.distinct else F.count(v.column)
        return Value(F.coalesce(total(v.column.cast("double")) / F.nullif(count, F.lit(0)), F.lit(0.0)), "double" if v.kind == "double" else "decimal")
    n, kind = T.number(v), T.numeric_kind(v)
    wrong = F.max((key.isNotNull() & n.isNull()).cast("int"))
    worst = F.max(F.when(kind == "double", 2).when(kind == "decimal", 1).otherwise(0))
    exact = F.when(kind != "double", T.lexical(v).try_cast("decimal(38,18)"))
    count = F.count_distinct(n) if a.distinct else F.count(n)
    double, decimal = total(n), total(exact)
    if a.name == "AVG":
        double, decimal, worst = double / F.nullif(count, F.lit(0)), (decimal / F.nullif(count, F.lit(0)).cast("decimal(20,0)")).cast("decimal(38,18)"), F.greatest(worst, F.when(count > 0, 1).otherwise(0))
    integer = T.typed(F.coalesce(decimal.cast("decimal(38,0)").cast("string"), F.lit("0")), "integer")
    text = F.when(worst == 2, T.typed(T.double_text(double), "double")).when(worst == 1, T.typed(T.number_text(decimal, "decimal"), "decimal")).otherwise(integer)
    return Value(F.when(F.coalesce(wrong, F.lit(0)) == 0, text), "term")


def grouped(q: A.Query, sol: Solutions, ctx: Context) -> tuple[Solutions, A.Query]:
    """GROUP BY, with keys and aggregates as variables of the result and the query's expressions rewritten to them."""
    wanted: list = []
    for e in [e for _, e in q.projection if e is not None] + q.having + [e for e, _ in q.order_by]:
        _aggregates(e, wanted)
    by, keys = {}, {}
    for i, (e, n) in enumerate(q.group_by):
        n = n or (e.name if isinstance(e, A.Var) else f"\0k{i}")
        v = S.compile_expression(e, scope(sol.values(), ctx))
        keys[n] = v if v.lang is None and v.datatype is None else Value(T.term(v), "term")
        by[e] = A.Var(n)
    found = {}
    for i, a in enumerate(wanted):
        found[f"\0a{i}"] = aggregate(a, sol, ctx)
        by[a] = A.Var(f"\0a{i}")
    columns = [v.column.alias(name_of(n)) for n, v in found.items()] or [F.count(F.lit(1)).alias("?\0a")]
    df = sol.df.groupBy(*[v.column.alias(name_of(n)) for n, v in keys.items()]).agg(*columns) if keys else sol.df.agg(*columns)
    out = Solutions(df, {n: v.signature for n, v in (keys | found).items()}, set(keys) | set(found))
    return out, replace(
        q, projection=[(n, _replaced(e, by) if e is not None else None) for n, e in q.projection],
        having=[_replaced(e, by) for e in q.having], order_by=[(_replaced(e, by), d) for e, d in q.order_by], group_by=[],
    )


# queries ------------------------------------------------------------------------------------------------------------------


def select(q: A.Query, ctx: Context) -> Solutions:
    """SELECT with its modifiers: group, having, expressions, order, projection, distinct, slice."""
    from .parser import has_aggregate

    sol = _full(group(q.where, ctx), ctx)
    if q.group_by or q.having or any(has_aggregate(e) for _, e in q.projection if e is not None) or any(has_aggregate(e) for e, _ in q.order_by):
        sol, q = grouped(q, sol, ctx)
    for n, e in q.projection:
        if e is not None:
            sol = sol.extend(n, S.compile_expression(e, scope(sol.values(), ctx)))
    for h in q.having:
        sol = sol.filter(S.condition(h, scope(sol.values(), ctx)))
    names = [n for n, _ in q.projection] or [n for n in sol.kinds if not n.startswith((" ", "\0"))]
    values = {n: sol.values().get(n) or S.unbound() for n in names}
    order: list[Column] = []

    def sort_columns(s: Solutions) -> list[Column]:
        out = []
        for e, descending in q.order_by:
            for k in S.sort_keys(S.compile_expression(e, scope(s.values(), ctx))):
                out.append(k.desc_nulls_last() if descending else k.asc_nulls_first())
        return out

    late = q.order_by and (q.distinct or q.reduced) and all(A.mentioned(e) <= set(names) for e, _ in q.order_by)
    if q.order_by and not late:
        order = sort_columns(sol)
        sol = Solutions(sol.df.orderBy(*order), sol.kinds, sol.maybe)
    out = sol.select(values, {n for n in names if n not in sol.kinds}) if names else sol
    if q.distinct or q.reduced:
        out = Solutions(out.df.distinct(), out.kinds, out.maybe)
        if late:
            out = Solutions(out.df.orderBy(*sort_columns(out)), out.kinds, out.maybe)
    df = out.df
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return Solutions(df, out.kinds, out.maybe)


def ask(q: A.Query, ctx: Context) -> DataFrame:
    """One row: whether there is a solution. One solution is looked for."""
    sol = _full(group(q.where, ctx), ctx)
    return sol.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))


def construct(template: list[A.Triple], sol: Solutions, ctx: Context) -> DataFrame:
    """s, p, o of the template's triples over all solutions, as a set; what is unbound or no triple is left out."""
    blank = [n for n in set().union(*map(A.variables, template)) if n.startswith(" ")] if template else []
    salt = F.concat_ws("\1", *[F.coalesce(T.term(v), F.lit("")) for n, v in sorted(sol.values().items()) if n != "\0"])
    sol = reduce(lambda s, n: s.extend(n, Value(F.concat(F.lit("_:c"), F.hex(F.xxhash64(salt, F.lit(n)))), "term"), maybe=False), [n for n in blank if n not in sol.kinds], sol)

    def of(n) -> Column:
        if isinstance(n, A.Var):
            return T.term(sol.value(n.name)) if n.name in sol.kinds else F.lit(None).cast("string")
        return F.lit(f"<{n.iri}>" if isinstance(n, A.Link) else n.text)

    if not template:
        return ctx.spark.createDataFrame([], "s string, p string, o string")
    triples = F.array(*[F.struct(of(t.s).alias("s"), of(t.p).alias("p"), of(t.o).alias("o")) for t in template])
    return sol.df.select(F.explode(triples).alias("t")).select("t.*").where("s is not null and p is not null and o is not null and not startswith(s, '\"') and startswith(p, '<')").distinct()


def describe(q: A.Query, ctx: Context) -> DataFrame:
    """Triples with one of the resources as subject or object."""
    sol = _full(group(q.where, ctx), ctx) if q.where.elements else unit(ctx)
    nodes = q.describe or [A.Var(n) for n in sol.kinds if not n.startswith((" ", "\0"))]
    parts = [sol.df.select((T.term(sol.value(n.name)) if isinstance(n, A.Var) else F.lit(n.text)).alias("r")) for n in nodes]
    wanted = reduce(lambda a, b: a.union(b), parts).distinct()
    quads = ctx.source.quads(ctx).select("s", "p", "o")
    return quads.join(wanted, quads.s == wanted.r, "left_semi").union(quads.join(wanted, quads.o == wanted.r, "left_semi")).distinct()


def typed_columns(sol: Solutions) -> DataFrame:
    """The result's columns by variable: native values, IRIs as text, everything else as terms."""
    out = []
    for n, v in sol.values().items():
        if n != "\0":
            out.append((T.lexical(v) if v.kind == "iri" else v.column).alias(n))
    return sol.df.select(*out)


def term_columns(sol: Solutions) -> DataFrame:
    return sol.df.select(*[T.term(v).alias(n) for n, v in sol.values().items() if n != "\0"])


def types_predicate(p: A.Node) -> bool:
    return isinstance(p, A.Term) and p.text == f"<{RDF}type>"
