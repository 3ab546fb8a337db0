"""SPARQL expressions to columns. An error is a null; FILTER drops nulls, as it drops errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import algebra as A
from . import terms as T
from .terms import NUMERIC, RDF, XSD, Value


class UnknownFunction(ValueError):
    """A function that neither SPARQL nor this engine has."""


@dataclass
class Scope:
    """What an expression can see: values of variables, EXISTS columns, a row identity for BNODE, the base IRI."""

    values: dict[str, Value]
    exists: Callable[[A.Exists], Column] | None = None
    base: str | None = None
    now: str = "2000-01-01T00:00:00"


def null() -> Column:
    return F.lit(None)


def unbound() -> Value:
    return Value(F.lit(None).cast("string"), "term")


def compile_expression(e: object, scope: Scope) -> Value:
    """The value of an expression; an unknown variable is unbound."""
    if isinstance(e, A.Var):
        return scope.values.get(e.name) or unbound()
    if isinstance(e, A.Term):
        return T.constant(e.text)
    if isinstance(e, A.Exists):
        if scope.exists is None:
            raise ValueError("EXISTS is not allowed here")
        return Value(scope.exists(e), "boolean")
    if isinstance(e, A.Call):
        return call(e, scope)
    raise ValueError(f"cannot evaluate {e}")


def condition(e: object, scope: Scope) -> Column:
    """The effective boolean value of an expression."""
    return T.effective(compile_expression(e, scope))


def string(c: Column) -> Value:
    return Value(c, "string")


def like(v: Value, c: Column) -> Value:
    """A string result that keeps the language or datatype of an argument."""
    if v.kind == "term":
        return Value(c, "string", lang=F.nullif(T.language(v), F.lit("")), datatype=F.when(T.language(v) != "", null()).otherwise(T.datatype(v)))
    return Value(c, "string", lang=v.lang, datatype=v.datatype)


def text(v: Value) -> Column:
    """The text of a string literal (plain, tagged or xsd:string); null for anything else."""
    if v.kind == "string":
        return v.column
    if v.kind == "term":
        return F.when(T.datatype(v).isin(XSD + "string", RDF + "langString"), T.lexical(v))
    return null().cast("string")


# comparison ---------------------------------------------------------------------------------------------------------------


def _timestamp(v: Value) -> Column:
    return v.column if v.kind == "dateTime" else F.when(T.datatype(v).isin(XSD + "dateTime", XSD + "date"), T.lexical(v).try_cast("timestamp"))


def _number(v: Value) -> bool:
    return v.kind in NUMERIC or v.kind == "num"


def equal(a: Value, b: Value) -> Column:
    if _number(a) and _number(b):
        return a.column == b.column
    if _number(a) or _number(b):
        other = b if _number(a) else a
        if other.kind == "term":
            p, q = (a.column, T.number(other)) if _number(a) else (T.number(other), b.column)
            return F.when(T.number(other).isNotNull(), p == q).when(~T.is_literal(other), False)
    if "dateTime" in (a.kind, b.kind) and {a.kind, b.kind} <= {"dateTime", "term"}:
        return _timestamp(a) == _timestamp(b)
    if a.kind == b.kind == "iri":
        return a.column == b.column if a.template == b.template else T.lexical(a) == T.lexical(b)
    if a.kind == b.kind and a.kind != "term" and a.lang is None and b.lang is None:
        return a.column == b.column
    if a.kind != "term" and b.kind != "term" and a.kind != b.kind:
        return F.when(a.column.isNotNull() & b.column.isNotNull(), False)
    x, y = T.term(a), T.term(b)
    p, q = T.number(a), T.number(b)
    both = T.boolean(a).isNotNull() & T.boolean(b).isNotNull()
    known = lambda v: T.datatype(v).isin(XSD + "string", RDF + "langString", XSD + "boolean", XSD + "dateTime") | T.number(v).isNotNull()
    return F.when(p.isNotNull() & q.isNotNull(), p == q).when(x == y, True).when(both, T.boolean(a) == T.boolean(b)).when(T.is_literal(a) & T.is_literal(b) & ~(known(a) & known(b)), null()).when(x.isNotNull() & y.isNotNull(), False)


def less(a: Value, b: Value, op: Callable[[Column, Column], Column]) -> Column:
    if _number(a) and _number(b):
        return op(a.column, b.column)
    if a.kind in ("dateTime", "term") and b.kind in ("dateTime", "term") and "dateTime" in (a.kind, b.kind):
        return op(_timestamp(a), _timestamp(b))
    if a.kind == b.kind and a.kind in ("string", "boolean"):
        return op(a.column, b.column)
    if _number(a) or _number(b):
        return op(T.number(a), T.number(b))
    same = T.datatype(a) == T.datatype(b)
    p, q = T.number(a), T.number(b)
    return F.when(p.isNotNull() & q.isNotNull(), op(p, q)).when(T.is_literal(a) & T.is_literal(b) & same & p.isNull() & q.isNull(), op(T.lexical(a), T.lexical(b)))


# arithmetic ---------------------------------------------------------------------------------------------------------------


def numeric(c: Column, kinds: list[Column]) -> Value:
    """A number whose kind is known only by row: double if an operand is one, then decimal, then integer."""
    worst = reduce(lambda x, y: F.when((x == "double") | (y == "double"), "double").when((x == "decimal") | (y == "decimal"), "decimal").otherwise("integer"), kinds)
    return Value(c, "num", datatype=F.when(c.isNotNull(), worst))


def arithmetic(name: str, a: Value, b: Value) -> Value:
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}
    if a.kind in NUMERIC and b.kind in NUMERIC:
        kind = "double" if "double" in (a.kind, b.kind) else "decimal" if "decimal" in (a.kind, b.kind) or name == "/" else "integer"
        x, y = (a.column, b.column) if name != "/" else (a.column.cast("double"), b.column.cast("double"))
        return Value(ops[name](x, y), kind)
    x, y = T.number(a), T.number(b)
    out = ops[name](x, y)
    kinds = [T.numeric_kind(a), T.numeric_kind(b)] + ([F.lit("decimal")] if name == "/" else [])
    return numeric(out, kinds)


def _unary(v: Value, f: Callable[[Column], Column]) -> Value:
    if v.kind in NUMERIC:
        return Value(f(v.column), v.kind)
    return numeric(f(T.number(v)), [T.numeric_kind(v), T.numeric_kind(v)])


# dates: by the lexical form, without shifting time zones -----------------------------------------------------------------

_DATE = r"^(-?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$"


def _date_part(v: Value, n: int) -> Value:
    if v.kind == "dateTime":
        f = (F.year, F.month, F.day, F.hour, F.minute)
        return Value(f[n - 1](v.column).cast("long"), "integer") if n < 6 else Value(F.date_format(v.column, "s.SSSSSS").cast("double"), "decimal")
    part = F.nullif(F.regexp_extract(T.lexical(v), _DATE, n), F.lit(""))
    return Value(part.try_cast("long"), "integer") if n < 6 else Value(part.try_cast("double"), "decimal")


def _zone(v: Value) -> Column:
    c = T.lexical(v)
    return F.when(c.rlike(_DATE), F.regexp_extract(c, _DATE, 7))


def _timezone(v: Value) -> Value:
    z = _zone(v)
    h, m = F.regexp_extract(z, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(z, r":(\d\d)", 1).try_cast("int")
    body = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when((m > 0) | (h == 0), F.concat(m.cast("string"), F.when(m > 0, "M").otherwise("S"))).otherwise(""))
    return Value(F.when(z == "Z", T.typed(F.lit("PT0S"), "dayTimeDuration")).when(z != "", T.typed(body, "dayTimeDuration")), "term")


# casts --------------------------------------------------------------------------------------------------------------------


def cast(name: str, v: Value) -> Value:
    s, n, b = T.lexical(v), T.number(v), T.boolean(v)
    s = F.when(T.is_literal(v), F.trim(s))
    if name == "string":
        return string(T.lexical(v))
    if name == "boolean":
        return Value(F.when(b.isNotNull(), b).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(s.isin("true", "1"), True).when(s.isin("false", "0"), False), "boolean")
    number = F.when(b.isNotNull(), b.cast("int").cast("double")).when(n.isNotNull(), n)
    if name in ("integer", "int", "long"):
        return Value(F.when(number.isNotNull() & ~F.isnan(number), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long")).when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long")), "integer")
    if name == "decimal":
        return Value(F.when(number.isNotNull(), number).when(s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), s.try_cast("double")), "decimal")
    if name in ("double", "float"):
        plain = s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
        return Value(F.when(number.isNotNull(), number).when(s == "INF", F.lit(float("inf"))).when(s == "-INF", F.lit(float("-inf"))).when(s == "NaN", F.lit(float("nan"))).when(plain, s.try_cast("double")), "double")
    raise UnknownFunction(f"no cast to xsd:{name}")


# functions ----------------------------------------------------------------------------------------------------------------


def _choice(options: list[Value], pick: Callable[[list[Column]], Column]) -> Value:
    """One of several values: native if all are of one kind, otherwise a term."""
    first = options[0]
    if all(o.signature == first.signature for o in options) and not any(o.lang is not None or o.datatype is not None for o in options):
        return first.on(pick([o.column for o in options]))
    return Value(pick([T.term(o) for o in options]), "term")


def _agree(a: Value, b: Value) -> Column:
    """Whether two string arguments may be used together: the second is plain, or tagged like the first."""
    if a.kind == b.kind == "string" and a.lang is None and b.lang is None:
        return F.lit(True)
    x, y = T.language(a), T.language(b)
    return (y == "") | (x == y)


_HASHES = {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512)}


def call(e: A.Call, scope: Scope) -> Value:
    name = e.name
    if name.startswith("http") and name.startswith(XSD):
        return cast(name.removeprefix(XSD), compile_expression(e.args[0], scope))
    if name == "BOUND":
        v = compile_expression(e.args[0], scope)
        return Value(v.column.isNotNull(), "boolean")
    a = [compile_expression(x, scope) for x in e.args]
    if name in ("IN", "NOT IN"):
        hit = reduce(lambda x, y: x | y, [equal(a[0], x) for x in a[1:]], F.lit(False))
        return Value(hit if name == "IN" else ~hit, "boolean")
    if name in ("+", "-", "*", "/"):
        return arithmetic(name, *a)
    b = _BOOLEANS.get(name)
    if b:
        return Value(b(*a), "boolean")
    f = _FUNCTIONS.get(name)
    if f:
        return f(*a)
    if name == "COALESCE":
        return _choice(a, lambda cs: F.coalesce(*cs))
    if name == "IF":
        c = T.effective(a[0])
        return _choice(a[1:], lambda cs: F.when(c, cs[0]).when(~c, cs[1]))
    if name == "CONCAT":
        return _concat(a)
    if name in ("REGEX", "REPLACE"):
        return _regex(name, e, a)
    if name in ("IRI", "URI"):
        return _iri(e, a[0], scope)
    if name == "NOW":
        return Value(F.lit(scope.now).cast("timestamp"), "dateTime")
    if name == "BNODE":
        row = [T.lexical(a[0])] if a else [F.uuid()]
        salt = F.concat_ws("\1", *[T.term(v) for _, v in sorted(scope.values.items())]) if scope.values else F.lit("")
        return Value(F.concat(F.lit("_:b"), F.hex(F.xxhash64(salt, *row))), "term")
    raise UnknownFunction(f"unknown function {name}")


def _concat(a: list[Value]) -> Value:
    texts = [text(v) for v in a]
    joined = reduce(lambda x, y: F.concat(x, y), texts) if texts else F.lit("")
    if all(v.kind == "string" and v.lang is None for v in a):
        return string(joined)
    tag = T.language(a[0])
    for v in a[1:]:
        tag = F.when(tag == T.language(v), tag)
    return Value(joined, "string", lang=F.nullif(F.coalesce(tag, F.lit("")), F.lit("")))


def _constant_text(e: object) -> str:
    if isinstance(e, A.Term):
        kind, t, _, _ = T.parse_term(e.text)
        if kind == "literal":
            return t
    raise ValueError("a regular expression's flags must be a constant")


def _regex(name: str, e: A.Call, a: list[Value]) -> Value:
    at = 2 if name == "REGEX" else 3
    flags = "".join(c for c in _constant_text(e.args[at]) if c in "ismx") if len(a) > at else ""
    pattern = F.concat(F.lit(f"(?{flags})" if flags else ""), text(a[1]))
    if name == "REGEX":
        return Value(F.rlike(text(a[0]), pattern), "boolean")
    return like(a[0], F.regexp_replace(text(a[0]), pattern, text(a[2])))


def _iri(e: A.Call, v: Value, scope: Scope) -> Value:
    if isinstance(e.args[0], A.Term) and scope.base:
        return Value(F.lit(urljoin(scope.base, T.parse_term(e.args[0].text)[1])), "iri", ("", ""))
    s = T.lexical(v)
    if scope.base:
        s = F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), s).otherwise(F.concat(F.lit(scope.base.rsplit("/", 1)[0] + "/"), s))
    return Value(s, "iri", ("", ""))


def _substr(v: Value, start: Value, length: Value | None = None) -> Value:
    s = T.number(start).cast("int")
    first = F.greatest(F.lit(1), s)
    n = F.lit(1 << 30) if length is None else F.greatest(F.lit(0), T.number(length).cast("int") + F.least(F.lit(0), s - 1))
    return like(v, text(v).substr(first, n))


def _before(v: Value, w: Value) -> Value:
    s, t = text(v), text(w)
    at = F.instr(s, t)
    return like(v, F.when(_agree(v, w) & s.isNotNull() & t.isNotNull(), F.when(at > 0, s.substr(F.lit(1), at - 1)).otherwise("")))


def _after(v: Value, w: Value) -> Value:
    s, t = text(v), text(w)
    at = F.instr(s, t)
    return like(v, F.when(_agree(v, w) & s.isNotNull() & t.isNotNull(), F.when(at > 0, s.substr(at + F.length(t), F.lit(1 << 30))).otherwise("")))


def _lang_matches(tag: Value, wanted: Value) -> Column:
    t, w = F.lower(T.lexical(tag)), F.lower(T.lexical(wanted))
    return F.when(w == "*", t != "").otherwise((t == w) | t.startswith(F.concat(w, F.lit("-"))))


def _or(a: Value, b: Value) -> Column:
    return T.effective(a) | T.effective(b)


_BOOLEANS: dict[str, Callable[..., Column]] = {
    "||": _or,
    "&&": lambda a, b: T.effective(a) & T.effective(b),
    "!": lambda a: ~T.effective(a),
    "=": equal,
    "!=": lambda a, b: ~equal(a, b),
    "<": lambda a, b: less(a, b, lambda x, y: x < y),
    ">": lambda a, b: less(a, b, lambda x, y: x > y),
    "<=": lambda a, b: less(a, b, lambda x, y: x <= y),
    ">=": lambda a, b: less(a, b, lambda x, y: x >= y),
    "ISIRI": T.is_iri,
    "ISURI": T.is_iri,
    "ISBLANK": T.is_blank,
    "ISLITERAL": T.is_literal,
    "ISNUMERIC": lambda v: F.when(v.column.isNotNull(), T.number(v).isNotNull()),
    "SAMETERM": lambda a, b: T.term(a) == T.term(b),
    "LANGMATCHES": _lang_matches,
    "CONTAINS": lambda a, b: F.when(_agree(a, b), F.contains(text(a), text(b))),
    "STRSTARTS": lambda a, b: F.when(_agree(a, b), F.startswith(text(a), text(b))),
    "STRENDS": lambda a, b: F.when(_agree(a, b), F.endswith(text(a), text(b))),
    "TEXT:MATCH": lambda a, b: F.contains(F.lower(T.lexical(a)), F.lower(T.lexical(b))),
    "MATCH": lambda a, b: F.contains(F.lower(T.lexical(a)), F.lower(T.lexical(b))),
}

_FUNCTIONS: dict[str, Callable[..., Value]] = {
    "STR": lambda v: string(T.lexical(v)),
    "LANG": lambda v: string(T.language(v)),
    "DATATYPE": lambda v: Value(T.datatype(v), "iri", ("", "")),
    "STRDT": lambda v, dt: Value(text(v), "string", datatype=T.lexical(dt)),
    "STRLANG": lambda v, tag: Value(text(v), "string", lang=T.lexical(tag)),
    "UUID": lambda: Value(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri", ("", "")),
    "STRUUID": lambda: string(F.uuid()),
    "RAND": lambda: Value(F.rand(), "double"),
    "STRLEN": lambda v: Value(F.length(text(v)).cast("long"), "integer"),
    "SUBSTR": _substr,
    "UCASE": lambda v: like(v, F.upper(text(v))),
    "LCASE": lambda v: like(v, F.lower(text(v))),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "ENCODE_FOR_URI": lambda v: string(F.replace(F.replace(F.replace(F.url_encode(text(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    **{n: (lambda v, f=f: string(f(T.lexical(v)))) for n, f in _HASHES.items()},
    **{n: (lambda v, i=i: _date_part(v, i)) for i, n in enumerate(("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"), 1)},
    "TZ": lambda v: string(_zone(v)),
    "TIMEZONE": _timezone,
    "ABS": lambda v: _unary(v, F.abs),
    "ROUND": lambda v: _unary(v, lambda c: F.round(c)),
    "CEIL": lambda v: _unary(v, lambda c: F.ceil(c).cast("double")) if v.kind != "integer" else v,
    "FLOOR": lambda v: _unary(v, lambda c: F.floor(c).cast("double")) if v.kind != "integer" else v,
    "unary-": lambda v: _unary(v, lambda c: -c),
    "unary+": lambda v: v,
}


def sort_keys(v: Value) -> list[Column]:
    """Columns that order values: unbound, blank nodes, IRIs, literals; numbers by value, others by text."""
    if v.kind in (*NUMERIC, "num", "string", "boolean", "dateTime"):
        return [v.column]
    rank = F.when(v.column.isNull(), 0).when(T.is_blank(v), 1).when(T.is_iri(v), 2).otherwise(3)
    if v.kind == "iri":
        return [v.column]
    return [rank, T.number(v), F.coalesce(T.lexical(v), v.column)]
