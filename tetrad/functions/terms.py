"""RDF terms as columns.

A value of a solution is a column and a static kind. Values from tables keep their native columns (numbers, strings,
timestamps, keys behind an IRI template) and become N-Triples terms only where something needs the term; values from quads
are N-Triples strings, whose lexical form, datatype, language and number are expressions over the string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

#: Kinds: term (N-Triples string), iri (native key under a template), integer, double, decimal, string, boolean, dateTime,
#: and num: a number whose type (integer, decimal or double) is a column, in datatype. Null columns are unbound.
NUMERIC = ("integer", "decimal", "double")

_INTEGER_TYPES = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")


@dataclass(frozen=True)
class Value:
    """A column with its kind. template: (before, after) of an IRI's native key; lang: a language tag column of a string."""

    column: Column
    kind: str
    template: tuple[str, str] | None = None
    lang: Column | None = None
    datatype: Column | None = None

    def on(self, column: Column) -> Value:
        return replace(self, column=column)

    @property
    def signature(self) -> tuple:
        """Values of one signature are equal exactly if their columns are."""
        return (self.kind, self.template)


def escaped(c: Column) -> Column:
    """The lexical form as it stands between quotes in N-Triples."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    """Undo escaped(); a backslash pair is set aside first."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\ue000"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("\ue000"), F.lit("\\"))


def typed(lex: Column, name: str) -> Column:
    return F.concat(F.lit('"'), lex, F.lit(f'"^^<{XSD}{name}>'))


def double_text(c: Column) -> Column:
    """A double's canonical text: whole numbers below 10^15 with one decimal place, others as the platform prints them."""
    return c.cast("string")


def number_text(c: Column, kind: str) -> Column:
    if kind == "integer":
        return c.cast("long").cast("string")
    if kind == "decimal":
        text = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1")
        return F.regexp_replace(text, r"\.$", ".0")
    return double_text(c)


def term(v: Value) -> Column:
    """The N-Triples form of a value; null where it is unbound."""
    c = v.column
    if v.kind == "term":
        return c
    if v.kind == "iri":
        before, after = v.template or ("", "")
        return F.concat(F.lit("<" + before), c.cast("string"), F.lit(after + ">"))
    if v.kind == "string":
        plain = F.concat(F.lit('"'), escaped(c), F.lit('"'))
        out = plain
        if v.datatype is not None:
            out = F.when(v.datatype.isNull() | (v.datatype == XSD + "string"), plain).otherwise(F.concat(plain, F.lit("^^<"), v.datatype, F.lit(">")))
        if v.lang is not None:
            out = F.when(F.coalesce(v.lang, F.lit("")) != "", F.concat(plain, F.lit("@"), v.lang)).otherwise(out)
        return out
    if v.kind == "boolean":
        return typed(c.cast("string"), "boolean")
    if v.kind == "dateTime":
        return typed(date_text(c), "dateTime")
    if v.kind == "num":
        return F.when(c.isNotNull(), F.concat(F.lit('"'), lexical(v), F.lit(f'"^^<{XSD}'), v.datatype, F.lit(">")))
    return typed(number_text(c, v.kind), v.kind)


def date_text(c: Column) -> Column:
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), r"\.000$", "")


# Lanes -----------------------------------------------------------------------------------------------------------------


def is_iri(v: Value) -> Column:
    if v.kind == "iri":
        return F.when(v.column.isNotNull(), True)
    return v.column.startswith("<") if v.kind == "term" else F.when(v.column.isNotNull(), False)


def is_blank(v: Value) -> Column:
    return v.column.startswith("_:") if v.kind == "term" else F.when(v.column.isNotNull(), False)


def is_literal(v: Value) -> Column:
    if v.kind == "iri":
        return F.when(v.column.isNotNull(), False)
    return v.column.startswith('"') if v.kind == "term" else F.when(v.column.isNotNull(), True)


def lexical(v: Value) -> Column:
    """STR(): the IRI without brackets, or the literal's text; null for blank nodes."""
    c = v.column
    if v.kind == "term":
        body = F.regexp_extract(c, r'(?s)^"(.*)"[^"]*$', 1)
        return F.when(c.startswith('"'), F.when(F.contains(body, F.lit("\\")), unescaped(body)).otherwise(body)).when(c.startswith("<"), F.substring(c, 2, 1 << 30).substr(F.lit(1), F.length(c) - 2))
    if v.kind == "iri":
        before, after = v.template or ("", "")
        return F.concat(F.lit(before), c.cast("string"), F.lit(after))
    if v.kind == "string":
        return c
    if v.kind == "boolean":
        return c.cast("string")
    if v.kind == "dateTime":
        return date_text(c)
    if v.kind == "num":
        return F.when(v.datatype == "integer", number_text(c, "integer")).when(v.datatype == "decimal", number_text(c, "decimal")).otherwise(double_text(c))
    return number_text(c, v.kind)


def language(v: Value) -> Column:
    """LANG(): the tag, or an empty string for other literals; null for what is no literal."""
    if v.kind == "term":
        return F.when(v.column.startswith('"'), F.regexp_extract(v.column, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1))
    if v.kind == "iri":
        return F.lit(None).cast("string")
    tag = F.coalesce(v.lang, F.lit("")) if v.lang is not None else F.lit("")
    return F.when(v.column.isNotNull(), tag)


def datatype(v: Value) -> Column:
    """DATATYPE() as a bare IRI; null for what is no literal."""
    if v.kind == "term":
        own = F.regexp_extract(v.column, r'(?s)^".*"\^\^<([^>]*)>$', 1)
        tagged = F.regexp_extract(v.column, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1) != ""
        return F.when(v.column.startswith('"'), F.when(own != "", own).when(tagged, RDF + "langString").otherwise(XSD + "string"))
    if v.kind == "iri":
        return F.lit(None).cast("string")
    name = F.lit(XSD + v.kind)
    if v.kind == "num":
        name = F.concat(F.lit(XSD), v.datatype)
    elif v.datatype is not None:
        name = F.coalesce(v.datatype, F.lit(XSD + "string"))
    if v.lang is not None:
        name = F.when(F.coalesce(v.lang, F.lit("")) != "", RDF + "langString").otherwise(name)
    return F.when(v.column.isNotNull(), name)


_NUMERIC_TERM = rf'^"([^"]*)"\^\^<{re.escape(XSD)}(' + "|".join([*_INTEGER_TYPES, "decimal", "double", "float"]) + ")>$"


def number(v: Value) -> Column:
    """The numeric value as a double; null for what is not numeric."""
    if v.kind in NUMERIC or v.kind == "num":
        return v.column.cast("double")
    if v.kind == "term":
        text = F.regexp_extract(v.column, _NUMERIC_TERM, 1)
        return F.when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).otherwise(F.nullif(text, F.lit("")).try_cast("double"))
    return F.lit(None).cast("double")


def numeric_kind(v: Value) -> Column:
    """integer, decimal or double; null for what is not numeric."""
    if v.kind in NUMERIC:
        return F.when(v.column.isNotNull(), v.kind)
    if v.kind == "num":
        return v.datatype
    if v.kind == "term":
        name = F.regexp_extract(v.column, _NUMERIC_TERM, 2)
        return F.when(name == "", F.lit(None)).when(name.isin("double", "float"), "double").when(name == "decimal", "decimal").otherwise("integer")
    return F.lit(None).cast("string")


def boolean(v: Value) -> Column:
    """The value of an xsd:boolean; null for what is none."""
    if v.kind == "boolean":
        return v.column
    if v.kind == "term":
        text = F.regexp_extract(v.column, rf'^"(true|false|1|0)"\^\^<{re.escape(XSD)}boolean>$', 1)
        return F.when(text != "", text.isin("true", "1"))
    return F.lit(None).cast("boolean")


def effective(v: Value) -> Column:
    """The effective boolean value: of booleans, numbers and plain strings; null (an error) for others."""
    if v.kind == "boolean":
        return v.column
    if v.kind in NUMERIC or v.kind == "num":
        return (v.column != 0) & ~F.isnan(v.column.cast("double"))
    if v.kind == "string":
        return F.length(v.column) > 0
    if v.kind == "term":
        n = number(v)
        plain = datatype(v).isin(XSD + "string", RDF + "langString")
        return F.when(boolean(v).isNotNull(), boolean(v)).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(plain, F.length(lexical(v)) > 0)
    return F.lit(None).cast("boolean")


# Constants -------------------------------------------------------------------------------------------------------------

_UNESCAPE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def read_escapes(s: str) -> str:
    """A literal's or IRI's text with its escapes resolved."""

    def one(m: re.Match) -> str:
        x = m[0]
        return chr(int(x[2:], 16)) if x[1] in "uU" else _UNESCAPE[x[1]]

    return re.sub(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[tbnrf\"'\\]", one, s)


def write_escapes(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def literal(lex: str, lang: str | None = None, dt: str | None = None) -> str:
    """The canonical N-Triples form of a literal; xsd:string is left out."""
    body = f'"{write_escapes(lex)}"'
    if lang:
        return f"{body}@{lang}"
    return body if dt in (None, XSD + "string") else f"{body}^^<{dt}>"


def parse_term(t: str) -> tuple[str, str, str | None, str | None]:
    """(kind, text, language, datatype) of an N-Triples term; kind: iri, bnode or literal."""
    if t.startswith("<"):
        return "iri", t[1:-1], None, None
    if t.startswith("_:"):
        return "bnode", t[2:], None, None
    end = t.rindex('"')
    rest = t[end + 1 :]
    return "literal", read_escapes(t[1:end]), rest[1:] if rest.startswith("@") else None, rest[3:-1] if rest.startswith("^^") else None


def constant(t: str) -> Value:
    """A constant term as a value of the narrowest native kind."""
    kind, text, lang, dt = parse_term(t)
    if kind == "iri":
        return Value(F.lit(text), "iri", ("", ""))
    if kind == "literal" and not lang:
        name = (dt or XSD + "string").removeprefix(XSD)
        try:
            if name in _INTEGER_TYPES and re.fullmatch(r"[+-]?\d+", text):
                return Value(F.lit(int(text)).cast("long"), "integer")
            if name == "decimal" and re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", text):
                return Value(F.lit(float(text)), "decimal")
            if name in ("double", "float"):
                return Value(F.lit(float(text.replace("INF", "inf"))), "double")
        except ValueError:
            pass
        if name == "string":
            return Value(F.lit(text), "string")
        if name == "boolean" and text in ("true", "false", "1", "0"):
            return Value(F.lit(text in ("true", "1")), "boolean")
    return Value(F.lit(t), "term")
