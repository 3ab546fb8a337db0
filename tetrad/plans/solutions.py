"""Solution sequences: a DataFrame with a column for each variable, and the joins of SPARQL over them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import Value


def name_of(var: str) -> str:
    return f"?{var}"


def col(var: str) -> Column:
    return F.col(f"`?{var}`")


@dataclass
class Solutions:
    """df: columns named ?x; kinds: (kind, template) of each variable; maybe: variables that may be unbound.

    unit: the one solution without variables, from which joins start.
    """

    df: DataFrame | None
    kinds: dict[str, tuple] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)

    @property
    def unit(self) -> bool:
        return self.df is None

    def value(self, var: str) -> Value:
        kind, template = self.kinds[var]
        return Value(col(var), kind, template)

    def values(self) -> dict[str, Value]:
        return {v: self.value(v) for v in self.kinds}

    def select(self, wanted: dict[str, Value], maybe: set[str] | None = None) -> Solutions:
        """New columns from values; values with a language or datatype of their own become terms."""
        plain = {n: v if v.lang is None and v.datatype is None else Value(T.term(v), "term") for n, v in wanted.items()}
        df = self.df.select(*[v.column.alias(name_of(n)) for n, v in plain.items()])
        return Solutions(df, {n: v.signature for n, v in plain.items()}, (self.maybe & set(plain)) | (maybe or set()))

    def extend(self, var: str, v: Value, maybe: bool = True) -> Solutions:
        return self.select(self.values() | {var: v}, {var} if maybe else set())

    def as_terms(self, names: set[str]) -> Solutions:
        """The same with some variables turned into terms."""
        if not any(self.kinds[n][0] != "term" for n in names):
            return self
        return self.select({n: Value(T.term(v), "term") if n in names else v for n, v in self.values().items()})

    def filter(self, c: Column) -> Solutions:
        return Solutions(self.df.filter(c), self.kinds, self.maybe)


def aligned(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions, list[str]]:
    """Both sides with shared variables of the same kind, and those variables."""
    shared = [n for n in a.kinds if n in b.kinds]
    differ = {n for n in shared if a.kinds[n] != b.kinds[n]}
    return a.as_terms(differ), b.as_terms(differ), shared


def _right(b: Solutions, shared: list[str]) -> DataFrame:
    return b.df.select(*[col(n).alias(f"~{n}" if n in shared else name_of(n)) for n in b.kinds])


def _other(n: str) -> Column:
    return F.col(f"`~{n}`")


def _compatible(a: Solutions, b: Solutions, shared: list[str]) -> list[Column]:
    return [(col(n) == _other(n)) if n not in a.maybe | b.maybe else (col(n).isNull() | _other(n).isNull() | (col(n) == _other(n))) for n in shared]


def _merged(df: DataFrame, a: Solutions, b: Solutions, shared: list[str], outer: bool = False) -> Solutions:
    kinds = a.kinds | b.kinds
    columns = [(F.coalesce(col(n), _other(n)) if n in shared and n in a.maybe else col(n)).alias(name_of(n)) for n in kinds]
    maybe = {n for n in kinds if (n in a.maybe if n in a.kinds else True) and (n in b.maybe or n not in b.kinds or (outer and n not in a.kinds) or (outer and n in a.maybe))}
    maybe = {n for n in maybe if n in a.maybe or n in b.maybe or (outer and n not in a.kinds)}
    return Solutions(df.select(*columns), kinds, maybe)


def join(a: Solutions, b: Solutions) -> Solutions:
    """Natural join of compatible solutions. Variables that are bound on both sides are keys of an equi-join.

    Without a certain key the sides are split by which of a variable is bound, so that only pairs with an unbound side
    are formed without a key.
    """
    if a.unit:
        return b
    if b.unit:
        return a
    a, b, shared = aligned(a, b)
    certain = [n for n in shared if n not in a.maybe | b.maybe]
    if shared and not certain:
        n = shared[0]
        parts = []
        sides = [[(s.filter(col(n).isNotNull()), True), (s.filter(col(n).isNull()), False)] if n in s.maybe else [(s, True)] for s in (a, b)]
        for x, bound_x in sides[0]:
            for y, bound_y in sides[1]:
                x2, y2 = (Solutions(s.df, dict(s.kinds), s.maybe - {n}) for s in (x, y))
                if bound_x and bound_y:
                    parts.append(join(x2, y2))
                else:  # one side leaves the variable open: the other's value stands
                    keep, drop = (x2, y2) if bound_x or not bound_y else (y2, x2)
                    rest = Solutions(drop.df.drop(name_of(n)), {k: v for k, v in drop.kinds.items() if k != n}, drop.maybe)
                    keep = Solutions(keep.df, keep.kinds, keep.maybe | ({n} if not bound_x and not bound_y else set()))
                    parts.append(join(keep, rest if rest.kinds else Solutions(rest.df.select(F.lit(0).alias("?\0")), {"\0": ("integer", None)})))
        return reduce(union, [_without(p, "\0") for p in parts])
    right = _right(b, shared)
    if not shared:
        return _merged(a.df.crossJoin(right), a, b, shared)
    return _merged(a.df.join(right, reduce(lambda x, y: x & y, _compatible(a, b, shared)), "inner"), a, b, shared)


def _without(s: Solutions, n: str) -> Solutions:
    if n not in s.kinds:
        return s
    return Solutions(s.df.drop(name_of(n)), {k: v for k, v in s.kinds.items() if k != n}, s.maybe - {n})


def _certain(a: Solutions, b: Solutions, shared: list[str]) -> bool:
    """Whether a join has a key, or needs none: a shared variable that is bound on both sides."""
    return not shared or any(n not in a.maybe | b.maybe for n in shared)


def _halves(s: Solutions, n: str) -> tuple[Solutions, Solutions | None]:
    """The solutions that bind n; and those that do not (None if all do), where n is out of sight."""
    if n not in s.maybe:
        return s, None
    bound = Solutions(s.df.filter(col(n).isNotNull()), s.kinds, s.maybe - {n})
    hidden = {f"\0{n}" if k == n else k: v for k, v in s.kinds.items()}
    return bound, Solutions(s.df.filter(col(n).isNull()).withColumnRenamed(name_of(n), name_of(f"\0{n}")), hidden, (s.maybe - {n}) | {f"\0{n}"})


def _shown(s: Solutions, n: str) -> Solutions:
    """The solutions of the second half with n again, unbound."""
    kinds = {n if k == f"\0{n}" else k: v for k, v in s.kinds.items()}
    return Solutions(s.df.withColumnRenamed(name_of(f"\0{n}"), name_of(n)), kinds, {n if k == f"\0{n}" else k for k in s.maybe})


def _together(parts: list[Solutions], like: Solutions) -> Solutions:
    df = reduce(lambda x, y: x.unionByName(y), [p.df.select(*[col(n) for n in like.kinds]) for p in parts])
    return Solutions(df, like.kinds, like.maybe)


def left_join(a: Solutions, b: Solutions, on) -> Solutions:
    """OPTIONAL. on: a function from the visible values to further conditions of the join.

    Without a certain key it is the inner join, which is split by boundness, and what has no partner.
    """
    a, b, shared = aligned(a, b)
    if not _certain(a, b, shared):
        both = join(a, b)
        return union(reduce(Solutions.filter, on(both.values()), both), semi_join(a, b, True, on))
    right = _right(b, shared)
    conditions = _compatible(a, b, shared) + on(a.values() | {n: v for n, v in b.values().items() if n not in shared})
    c = reduce(lambda x, y: x & y, conditions, F.lit(True))
    return _merged(a.df.join(right, c, "left"), a, b, shared, outer=True)


def semi_join(a: Solutions, b: Solutions, negated: bool, on=lambda values: []) -> Solutions:
    """EXISTS and NOT EXISTS over the shared variables and further conditions.

    Without a certain key both sides are split by which of them binds a variable: solutions that bind it meet by it, then
    those that leave it open, and only these, meet by what else they share. Where nothing is shared and no condition is
    left, one solution of the right side decides.
    """
    a, b, shared = aligned(a, b)
    if not _certain(a, b, shared):
        n = shared[0]
        (a1, a0), (b1, b0) = _halves(a, n), _halves(b, n)
        if negated:
            parts = [semi_join(a1, b1, True, on)]
            parts = [semi_join(parts[0], b0, True, on)] if b0 else parts
        else:
            parts = [semi_join(a1, b1, False, on)]
            if b0:
                parts.append(semi_join(semi_join(a1, b1, True, on), b0, False, on))
        if a0:
            parts.append(_shown(semi_join(a0, b, negated, on), n))
        return _together(parts, a)
    conditions = _compatible(a, b, shared) + on(a.values() | {n: v for n, v in b.values().items() if n not in shared})
    how, right = "left_anti" if negated else "left_semi", _right(b, shared)
    if not conditions:
        conditions, right = [F.lit(True)], right.limit(1)
    return Solutions(a.df.join(right, reduce(lambda x, y: x & y, conditions), how), a.kinds, a.maybe)


def minus(a: Solutions, b: Solutions) -> Solutions:
    """MINUS: solutions go that are compatible with one of b and have a bound variable in common with it.

    Without a certain key the sides are split as in semi_join; what shares no bound variable stays.
    """
    a, b, shared = aligned(a, b)
    if not shared or a.unit:
        return a
    if not _certain(a, b, shared):
        n = shared[0]
        (a1, a0), (b1, b0) = _halves(a, n), _halves(b, n)
        parts = [minus(a1, b1)]
        if b0:
            parts = [minus(parts[0], b0)]
        if a0:
            parts.append(_shown(minus(a0, b), n))
        return _together(parts, a)
    conditions = _compatible(a, b, shared)
    right = _right(b, shared).select(*[_other(n) for n in shared]).distinct()
    return Solutions(a.df.join(right, reduce(lambda x, y: x & y, conditions), "left_anti"), a.kinds, a.maybe)


def union(a: Solutions, b: Solutions) -> Solutions:
    """Bag union; a variable that one side lacks is unbound there."""
    a, b, _ = aligned(a, b)
    kinds = a.kinds | b.kinds
    maybe = a.maybe | b.maybe | (set(a.kinds) ^ set(b.kinds))

    def whole(s: Solutions) -> DataFrame:
        other = b if s is a else a
        types = dict(other.df.dtypes)
        return s.df.select(*[(col(n) if n in s.kinds else F.lit(None).cast(types[name_of(n)])).alias(name_of(n)) for n in kinds])

    return Solutions(whole(a).unionByName(whole(b)), kinds, maybe)
