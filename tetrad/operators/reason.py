"""Forward chaining of RDFS and OWL rules, semi-naive: a round joins only what the last one found with all that is known."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import OWL, RDF, RDFS
from ..plans.paths import Known, checkpointed

TYPE, SUB_CLASS, SUB_PROPERTY = f"<{RDF}type>", f"<{RDFS}subClassOf>", f"<{RDFS}subPropertyOf>"
DOMAIN, RANGE, INVERSE, SAME = f"<{RDFS}domain>", f"<{RDFS}range>", f"<{OWL}inverseOf>", f"<{OWL}sameAs>"
EQUAL_CLASS, EQUAL_PROPERTY = f"<{OWL}equivalentClass>", f"<{OWL}equivalentProperty>"
TRANSITIVE, SYMMETRIC = f"<{OWL}TransitiveProperty>", f"<{OWL}SymmetricProperty>"


def _with(df: DataFrame, p: str, prefix: str) -> DataFrame:
    return df.where(F.col("p") == p).select(F.col("s").alias(prefix + "s"), F.col("o").alias(prefix + "o"))


def _all(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in "spo"])


def _out(df: DataFrame, s, p, o) -> DataFrame:
    f = lambda x: x if not isinstance(x, str) else F.lit(x) if x.startswith("<") else F.col(x)
    return df.select(f(s).alias("s"), f(p).alias("p"), f(o).alias("o"))


def _chain(a: DataFrame, b: DataFrame, p: str) -> DataFrame:
    """x p y, y p z gives x p z, with y from the ends of a and the starts of b."""
    return _out(_with(a, p, "a").join(_with(b, p, "b"), F.col("ao") == F.col("bs")).where("`as` <> bo"), "as", p, "bo")


# Each rule takes (a, b) and joins premises of a with premises of b; it is called with (new, all) and (all, new).
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def _typed(p: str, class_of: str):
    def rule(a: DataFrame, b: DataFrame) -> DataFrame:
        facts, schema = _all(b, "f"), _with(a, p, "a")
        rows = facts.join(schema, F.col("fp") == F.col("as"))
        return _out(rows if class_of == "fs" else rows.where("not startswith(fo, '\"')"), class_of, TYPE, "ao")

    return rule


def _characterised(kind: str):
    return lambda a: a.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias("q"))


def _transitive(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    q = _characterised(TRANSITIVE)(c)
    x = _all(a, "a").join(q, F.col("ap") == F.col("q"), "left_semi")
    return _out(x.join(_all(b, "b"), (F.col("ap") == F.col("bp")) & (F.col("ao") == F.col("bs"))).where("`as` <> bo"), "as", "ap", "bo")


RULES: dict[str, Rule] = {
    "sub_class_chain": lambda a, b: _chain(a, b, SUB_CLASS),
    "type_by_class": lambda a, b: _out(_with(a, TYPE, "a").join(_with(b, SUB_CLASS, "b"), F.col("ao") == F.col("bs")), "as", TYPE, "bo"),
    "sub_property_chain": lambda a, b: _chain(a, b, SUB_PROPERTY),
    "property_inheritance": lambda a, b: _out(_all(a, "f").join(_with(b, SUB_PROPERTY, "b"), F.col("fp") == F.col("bs")), "fs", "bo", "fo"),
    "domain": _typed(DOMAIN, "fs"),
    "range": _typed(RANGE, "fo"),
    "symmetric": lambda a, b: _out(_all(a, "f").join(_characterised(SYMMETRIC)(b), F.col("fp") == F.col("q")).where("fs <> fo and not startswith(fo, '\"')"), "fo", "fp", "fs"),
    "inverse": lambda a, b: _out(_all(a, "f").join(_with(b, INVERSE, "b"), F.col("fp") == F.col("bs")).where("not startswith(fo, '\"')"), "fo", "bo", "fs").union(
        _out(_all(a, "f").join(_with(b, INVERSE, "b"), F.col("fp") == F.col("bo")).where("not startswith(fo, '\"')"), "fo", "bs", "fs")
    ),
    "same_subject": lambda a, b: _out(_all(a, "f").join(_with(b, SAME, "b"), F.col("fs") == F.col("bs")), "bo", "fp", "fo"),
    "same_object": lambda a, b: _out(_all(a, "f").join(_with(b, SAME, "b"), F.col("fo") == F.col("bs")), "fs", "fp", "bo"),
}
#: Rules of one premise.
SINGLE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "same_symmetry": lambda a: _out(_with(a, SAME, "a"), "ao", SAME, "as"),
    "equivalent_class": lambda a: reduce(lambda x, y: x.union(y), [_out(_with(a, EQUAL_CLASS, "a"), *t) for t in (("as", SUB_CLASS, "ao"), ("ao", SUB_CLASS, "as"), ("ao", EQUAL_CLASS, "as"))]),
    "equivalent_property": lambda a: reduce(lambda x, y: x.union(y), [_out(_with(a, EQUAL_PROPERTY, "a"), *t) for t in (("as", SUB_PROPERTY, "ao"), ("ao", SUB_PROPERTY, "as"), ("ao", EQUAL_PROPERTY, "as"))]),
}
ALL_RULES = (*RULES, *SINGLE, "transitive")


def materialize(triples: DataFrame, rules: tuple[str, ...] = ALL_RULES, most_rounds: int = 100) -> DataFrame:
    """The triples (s, p, o) that the rules add, each once and none that was there; stops after ``most_rounds``."""
    start = delta = checkpointed(triples.select("s", "p", "o").distinct())
    every = Known(start)
    for _ in range(most_rounds):
        known = every.df
        parts = [SINGLE[r](delta) for r in rules if r in SINGLE]
        for r in rules:
            if r in RULES:
                parts += [RULES[r](delta, known), RULES[r](known, delta)]
        if "transitive" in rules:
            parts += [_transitive(delta, known, known), _transitive(known, delta, known), _transitive(known, known, delta)]
        found = reduce(lambda a, b: a.union(b), parts).where("not startswith(s, '\"') and not (s = o and p in ('" + SUB_CLASS + "', '" + SUB_PROPERTY + "', '" + SAME + "'))").distinct()
        delta = checkpointed(_minus(found, known))
        if delta.isEmpty():
            break
        every.add(delta)
    return _minus(every.df, start)


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*[F.col(c).alias("x" + c) for c in "spo"])
    return a.join(b, (F.col("s") == F.col("xs")) & (F.col("p") == F.col("xp")) & (F.col("o") == F.col("xo")), "left_anti")
