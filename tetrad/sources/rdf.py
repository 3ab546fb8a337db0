"""Readers of RDF files: line formats split by Spark, documents parsed file by file on the executors."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, XSD, literal
from ..plans import algebra as A
from ..plans.parser import Parser, SparqlSyntaxError

QUAD = "g string, s string, p string, o string"

#: Formats by file extension and by media type.
EXTENSIONS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "turtle": "turtle", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "jsonld": "jsonld", "json": "jsonld"}
MEDIA_TYPES = {"application/n-triples": "ntriples", "application/n-quads": "nquads", "text/turtle": "turtle", "application/trig": "trig", "application/rdf+xml": "rdfxml", "application/ld+json": "jsonld"}


def format_of(path: str) -> str:
    """The format that a file's name tells, below any compression."""
    name = re.sub(r"\.(gz|bz2)$", "", path.rstrip("/*").lower())
    ext = name.rsplit(".", 1)[-1]
    if ext not in EXTENSIONS:
        raise ValueError(f"no RDF format for {path}")
    return EXTENSIONS[ext]


def negotiate(accept: str, default: str = "turtle") -> str:
    """The format of the acceptable media type of highest quality."""
    offers = []
    for i, part in enumerate(accept.split(",")):
        kind, *params = [x.strip() for x in part.split(";")]
        q = next((float(p[2:]) for p in params if p.startswith("q=")), 1.0)
        if kind in MEDIA_TYPES or kind == "*/*":
            offers.append((-q, i, MEDIA_TYPES.get(kind, default)))
    return min(offers)[2] if offers else default


_IRI, _BLANK = r"<[^<>\"{}|^`\\\x00-\x20]*>", r"_:[^\s<>\".,;]+(?:\.[^\s<>\".,;]+)*"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


def read_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """N-Triples or N-Quads, split by line. A line that is no statement is an error, or left out if not strict."""
    return parse_lines(spark.read.text(path), strict)


def parse_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    c = F.col("value")
    rows = lines.where(~c.rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract(c, _LINE, i)
    bad = F.raise_error(F.concat(F.lit("no N-Quads statement: "), c))
    out = rows.select(part(4).alias("g"), (F.when(part(2) != "", part(1)).otherwise(bad.cast("string")) if strict else part(1)).alias("s"), part(2).alias("p"), part(3).alias("o"))
    out = out if strict else out.where("p <> ''")
    plain = F.regexp_replace("o", r"\^\^<" + re.escape(XSD) + "string>$", "")
    escaped = F.expr("reflect('org.apache.commons.text.StringEscapeUtils', 'unescapeJava', substring(o, 2, length(o) - 1 - length(regexp_extract(o, '\"([^\"]*)$', 1)) - 1))")
    again = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.replace(escaped, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.regexp_extract("o", '("[^"]*)$', 1))
    return out.withColumn("o", F.when(F.col("o").startswith('"') & F.contains("o", F.lit("\\u")), again).otherwise(plain))


class TurtleParser(Parser):
    """Turtle and TriG documents to quads of terms. Blank nodes are told apart by the document's name."""

    def __init__(self, text: str, base: str | None, scope: str):
        super().__init__(text, base)
        self.scope = scope
        self.out: list[tuple[str, str, str, str]] = []

    def verb(self, triples):
        return A.Link(self.predicate())

    def _starts_verb(self) -> bool:
        return self.kind in ("iri", "name") or (self.kind == "word" and self.toks[self.i][1] == "a")

    def term(self, n) -> str:
        if isinstance(n, A.Var):
            return "_:" + ("n" + n.name[2:] if n.name.startswith(" _") else "a" + n.name[2:]) + self.scope
        return f"<{n.iri}>" if isinstance(n, A.Link) else n.text

    def emit(self, triples: list[A.Triple], graph: str) -> None:
        self.out += [(graph, self.term(t.s), self.term(t.p), self.term(t.o)) for t in triples]

    def block(self, graph: str) -> None:
        self.need("{")
        while not self.take("}"):
            triples: list[A.Triple] = []
            self.triples_block(triples)
            self.emit(triples, graph)

    def document(self) -> list[tuple[str, str, str, str]]:
        while self.kind != "end":
            kind, t, _ = self.toks[self.i]
            if kind == "lang" and t in ("@prefix", "@base") or self.peek("PREFIX", "BASE"):
                self.i += 1
                if t.strip("@").upper() == "BASE":
                    self.base = self.iri()
                else:
                    name = self.next()
                    self.prefixes[name[:-1]] = self.iri()
                if kind == "lang":
                    self.need(".")
            elif kind == "lang" and t == "@version" or self.peek("VERSION"):
                self.i += 2
                if kind == "lang":
                    self.need(".")
            elif self.peek("{"):
                self.block("")
            elif self.peek("GRAPH") or (kind in ("iri", "name", "blank") and self.toks[self.i + 1][1] == "{"):
                self.take("GRAPH")
                self.block(self.term(self.node([])))
            else:
                triples: list[A.Triple] = []
                bracket = self.peek("[", "(", "<<", "<<(")
                s = self.node(triples)
                if not (bracket and triples and self.peek(".")):
                    self.properties(s, triples)
                self.need(".")
                self.emit(triples, "")
        return self.out

    def node(self, triples):
        if self.take("<<("):
            s, p = self.node(triples), self.verb(triples)
            o = self.node(triples)
            self.need(")>>")
            v = self.new_var()
            for q, n in (("subject", s), ("predicate", A.Term(f"<{p.iri}>")), ("object", o)):
                triples.append(A.Triple(v, A.Link(RDF + q), n))
            return v
        return super().node(triples)


def parse_turtle(text: str, base: str | None = None, scope: str = "") -> list[tuple[str, str, str, str]]:
    return TurtleParser(text, base, scope).document()


# RDF/XML --------------------------------------------------------------------------------------------------------------------

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


class XmlParser:
    """RDF/XML: nodes and properties in turn, with reification, containers and the three parse types."""

    def __init__(self, base: str | None, scope: str):
        self.base, self.scope, self.n, self.out, self.ids = base or "", scope, 0, [], set()

    def blank(self) -> str:
        self.n += 1
        return f"_:x{self.n}{self.scope}"

    def iri(self, text: str, base: str) -> str:
        from urllib.parse import urljoin

        return f"<{urljoin(base, text) if base else text}>"

    def triple(self, s: str, p: str, o: str, reify: str | None = None) -> None:
        self.out.append(("", s, p, o))
        if reify:
            for q, x in (("type", f"<{RDF}Statement>"), ("subject", s), ("predicate", p), ("object", o)):
                self.out.append(("", reify, f"<{RDF}{q}>", x))

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def identified(self, text: str, base: str) -> str:
        at = self.iri("#" + text, base)
        if at in self.ids:
            raise ValueError(f"rdf:ID {text} is used twice")
        self.ids.add(at)
        return at

    def subject(self, e, base: str) -> str:
        if _R + "about" in e.attrib:
            return self.iri(e.attrib[_R + "about"], base)
        if _R + "ID" in e.attrib:
            return self.identified(e.attrib[_R + "ID"], base)
        return f"_:n{e.attrib[_R + 'nodeID']}{self.scope}" if _R + "nodeID" in e.attrib else self.blank()

    def attributes(self, s: str, e, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k.startswith(_XML) or k in {_R + x for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype")}:
                continue
            self.triple(s, f"<{self.name(k)}>", f"<{v}>" if k == _R + "type" else literal(v, lang))

    def node(self, e, base: str, lang: str | None) -> str:
        base, lang = e.attrib.get(_XML + "base", base), e.attrib.get(_XML + "lang", lang)
        s = self.subject(e, base)
        if e.tag != _R + "Description":
            self.triple(s, f"<{RDF}type>", f"<{self.name(e.tag)}>")
        self.attributes(s, e, lang)
        self.properties(s, e, base, lang)
        return s

    def properties(self, s: str, e, base: str, lang: str | None) -> None:
        import xml.etree.ElementTree as ET

        count = 0
        for c in e:
            base_c, lang_c = c.attrib.get(_XML + "base", base), c.attrib.get(_XML + "lang", lang)
            if c.tag == _R + "li":
                count += 1
                p = f"<{RDF}_{count}>"
            else:
                p = f"<{self.name(c.tag)}>"
            reify = self.identified(c.attrib[_R + "ID"], base_c) if _R + "ID" in c.attrib else None
            kind = c.attrib.get(_R + "parseType")
            if kind == "Resource":
                o = self.blank()
                self.triple(s, p, o, reify)
                self.properties(o, c, base_c, lang_c)
            elif kind == "Collection":
                items = [self.node(x, base_c, lang_c) for x in c]
                cells = [self.blank() for _ in items]
                self.triple(s, p, cells[0] if cells else f"<{RDF}nil>", reify)
                for i, x in enumerate(items):
                    self.triple(cells[i], f"<{RDF}first>", x)
                    self.triple(cells[i], f"<{RDF}rest>", cells[i + 1] if i + 1 < len(cells) else f"<{RDF}nil>")
            elif kind is not None:
                body = (c.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in c)
                self.triple(s, p, literal(body, None, RDF + "XMLLiteral"), reify)
            elif len(c):
                self.triple(s, p, self.node(c[0], base_c, lang_c), reify)
            elif _R + "resource" in c.attrib or _R + "nodeID" in c.attrib:
                o = self.iri(c.attrib[_R + "resource"], base_c) if _R + "resource" in c.attrib else f"_:n{c.attrib[_R + 'nodeID']}{self.scope}"
                self.triple(s, p, o, reify)
                self.attributes(o, c, lang_c)
            elif any(not k.startswith(_XML) and k not in (_R + "ID", _R + "datatype") for k in c.attrib):
                o = self.blank()
                self.triple(s, p, o, reify)
                self.attributes(o, c, lang_c)
            else:
                dt = c.attrib.get(_R + "datatype")
                self.triple(s, p, literal(c.text or "", None if dt else lang_c, dt), reify)


def parse_rdfxml(text: str, base: str | None = None, scope: str = "") -> list[tuple[str, str, str, str]]:
    import xml.etree.ElementTree as ET

    root, p = ET.fromstring(text), XmlParser(base, scope)
    base = root.attrib.get(_XML + "base", base) or ""
    for e in root if root.tag == _R + "RDF" else [root]:
        p.node(e, base, root.attrib.get(_XML + "lang"))
    return p.out


# JSON-LD --------------------------------------------------------------------------------------------------------------------


class JsonLd:
    """JSON-LD to quads: contexts with terms, prefixes, vocabularies, coercions and containers; graphs, lists, reverses."""

    def __init__(self, base: str | None, scope: str):
        self.base, self.scope, self.n, self.out = base, scope, 0, []

    def blank(self, label: str | None = None) -> str:
        self.n += label is None
        return f"_:{'n' + label if label else f'j{self.n}'}{self.scope}"

    def context(self, active: dict, given: object) -> dict:
        if given is None:
            return {"@base": self.base}
        if isinstance(given, list):
            for g in given:
                active = self.context(active, g)
            return active
        if isinstance(given, str):
            raise ValueError(f"no resolver for the remote context {given}")
        active = dict(active)
        for k in ("@vocab", "@base", "@language"):
            if k in given:
                active[k] = given[k]
        for k, v in given.items():
            if not k.startswith("@"):
                active[k] = {"@id": v} if isinstance(v, str) else (v if v is not None else {"@id": None})
        return active

    def iri(self, ctx: dict, text: str, vocab: bool = False, depth: int = 0) -> str | None:
        """An absolute IRI, a keyword or a blank node label; None for what the context takes away or leaves relative."""
        from urllib.parse import urljoin

        if text.startswith("@"):
            return text
        if vocab and text in ctx and depth < 8:
            target = ctx[text].get("@id", text) if isinstance(ctx[text], dict) else ctx[text]
            return None if target is None else target if target == text else self.iri(ctx, target, True, depth + 1)
        if ":" in text:
            prefix, local = text.split(":", 1)
            if prefix == "_" or local.startswith("//"):
                return text
            if isinstance(ctx.get(prefix), dict) and depth < 8:
                return (self.iri(ctx, ctx[prefix].get("@id") or "", True, depth + 1) or "") + local
            return text
        if vocab:
            return ctx["@vocab"] + text if ctx.get("@vocab") is not None else None
        return urljoin(ctx.get("@base") or "", text) if ctx.get("@base") else text

    def term(self, ctx: dict, text: str, vocab: bool = False) -> str | None:
        x = self.iri(ctx, text, vocab)
        return None if x is None else self.blank(x[2:]) if x.startswith("_:") else f"<{x}>"

    def value(self, ctx: dict, v: object, definition: dict, g: str) -> str | None:
        import json

        kind = definition.get("@type")
        if isinstance(v, dict):
            ctx = self.context(ctx, v["@context"]) if "@context" in v else ctx
            keys = {self.iri(ctx, k, True): k for k in v}
            if "@value" in keys:
                x = v[keys["@value"]]
                dt = v.get(keys.get("@type", ""), None)
                if dt == "@json":
                    return literal(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None, RDF + "JSON")
                return None if x is None else self.scalar(x, v.get(keys.get("@language", "")), dt and self.iri(ctx, dt, True))
            if "@list" in keys:
                return self.list(ctx, v[keys["@list"]], definition, g)
            return self.node(ctx, v, g)
        if kind == "@json":
            return literal(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None, RDF + "JSON")
        if kind in ("@id", "@vocab") and isinstance(v, str):
            return self.term(ctx, v, kind == "@vocab")
        lang = definition["@language"] if "@language" in definition else ctx.get("@language")
        return self.scalar(v, lang if not kind else None, self.iri(ctx, kind, True) if kind and kind not in ("@none", "@id", "@vocab") else None)

    @staticmethod
    def scalar(x: object, lang: str | None, dt: str | None) -> str:
        if isinstance(x, bool):
            return literal("true" if x else "false", None, dt or XSD + "boolean")
        if isinstance(x, int) or isinstance(x, float) and x.is_integer() and abs(x) < 1e21 and dt != XSD + "double":
            return literal(str(int(x)) if dt != XSD + "double" else f"{float(x):.15E}", None, dt or XSD + "integer")
        if isinstance(x, float):
            mantissa, exponent = f"{x:.15E}".split("E")
            return literal(f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa else mantissa}{'' if '.' in mantissa.rstrip('0').rstrip('.') else '.0'}E{int(exponent)}", None, dt or XSD + "double")
        return literal(str(x), lang, dt)

    def list(self, ctx: dict, items: object, definition: dict, g: str) -> str:
        terms = [t for t in (self.value(ctx, x, definition, g) for x in (items if isinstance(items, list) else [items])) if t]
        head = f"<{RDF}nil>"
        for t in reversed(terms):
            cell = self.blank()
            self.out += [(g, cell, f"<{RDF}first>", t), (g, cell, f"<{RDF}rest>", head)]
            head = cell
        return head

    def node(self, ctx: dict, v: dict, g: str) -> str:
        ctx = self.context(ctx, v["@context"]) if "@context" in v else ctx
        keys = {}
        for k in v:
            keys.setdefault(self.iri(ctx, k, True), []).append(k)
        ident = v[keys["@id"][0]] if "@id" in keys else None
        s = self.term(ctx, ident) if isinstance(ident, str) else self.blank()
        for k in keys.get("@type", []):
            for x in v[k] if isinstance(v[k], list) else [v[k]]:
                if t := self.term(ctx, x, True):
                    self.out.append((g, s, f"<{RDF}type>", t))
                    inner = ctx.get(x)
                    if isinstance(inner, dict) and "@context" in inner:
                        ctx = self.context(ctx, inner["@context"])
        for k in keys.get("@graph", []):
            for x in v[k] if isinstance(v[k], list) else [v[k]]:
                self.node(ctx, x, s if len(v) > 1 + ("@context" in v) else g)
        for k in keys.get("@included", []):
            for x in v[k] if isinstance(v[k], list) else [v[k]]:
                self.node(ctx, x, g)
        for k in keys.get("@reverse", []):
            for p, xs in v[k].items():
                for x in xs if isinstance(xs, list) else [xs]:
                    if (o := self.value(ctx, x, {"@type": "@id"}, g)) and (q := self.term(ctx, p, True)):
                        self.out.append((g, o, q, s))
        for k in keys.get("@nest", []):
            for x in v[k] if isinstance(v[k], list) else [v[k]]:
                self.properties(ctx, s, x, g)
        self.properties(ctx, s, v, g)
        return s

    def properties(self, ctx: dict, s: str, v: dict, g: str) -> None:
        for k, x in v.items():
            p = self.iri(ctx, k, True)
            if p is None or p.startswith("@") or ":" not in p or x is None:
                continue
            d = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            inner = self.context(ctx, d["@context"]) if "@context" in d else ctx
            container = d.get("@container", [])
            container = container if isinstance(container, list) else [container]
            if "@reverse" in d:
                q = self.term(ctx, d["@reverse"], True)
                for y in x if isinstance(x, list) else [x]:
                    self.out.append((g, self.value(inner, y, {"@type": "@id"}, g), q, s))
                continue
            values: list = []
            if "@list" in container and not (isinstance(x, dict) and "@list" in x):
                values = [self.list(inner, x, d, g)]
            elif "@language" in container and isinstance(x, dict):
                values = [literal(str(y), None if lang == "@none" else lang) for lang, ys in x.items() for y in (ys if isinstance(ys, list) else [ys])]
            elif {"@index", "@id", "@type", "@graph"} & set(container) and isinstance(x, dict):
                for key, ys in x.items():
                    for y in ys if isinstance(ys, list) else [ys]:
                        if isinstance(y, dict) and key != "@none" and "@id" in container:
                            y = {"@id": key} | y
                        if isinstance(y, dict) and key != "@none" and "@type" in container:
                            y = {"@type": key} | y
                        values.append(self.value(inner, y, d, g))
            else:
                for y in x if isinstance(x, list) else [x]:
                    if isinstance(y, dict) and "@set" in y:
                        values += [self.value(inner, z, d, g) for z in (y["@set"] if isinstance(y["@set"], list) else [y["@set"]])]
                    elif y is not None:
                        values.append(self.value(inner, y, d, g))
            self.out += [(g, s, self.blank(p[2:]) if p.startswith("_:") else f"<{p}>", o) for o in values if o]


def parse_jsonld(text: str, base: str | None = None, scope: str = "") -> list[tuple[str, str, str, str]]:
    import json

    p = JsonLd(base, scope)
    doc = json.loads(text)
    for x in doc if isinstance(doc, list) else [doc]:
        p.node({"@base": base}, x, "")
    return list(dict.fromkeys(p.out))


_PARSERS = {"turtle": parse_turtle, "trig": parse_turtle, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld}


def decompressed(path: str, data: bytes) -> bytes:
    import bz2
    import gzip

    return gzip.decompress(data) if path.endswith(".gz") else bz2.decompress(data) if path.endswith(".bz2") else data


def read_documents(spark: SparkSession, path: str, kind: str, base: str | None = None) -> DataFrame:
    """Quads of Turtle, TriG, RDF/XML or JSON-LD files. A file is one task's work; many files run side by side."""
    import pandas as pd

    parse = _PARSERS[kind]

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                scope = "." + hashlib.md5(name.encode()).hexdigest()[:8]
                rows = parse(decompressed(name, bytes(content)).decode(), base, scope)
                yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, QUAD)


def read_rdf(spark: SparkSession, path: str, kind: str | None = None, base: str | None = None, limit: int | None = None) -> DataFrame:
    """Quads (g, s, p, o) of RDF files in any of the six formats, compressed or not; the name tells the format."""
    kind = kind or format_of(path)
    df = read_lines(spark, path) if kind in ("ntriples", "nquads") else read_documents(spark, path, kind, base)
    return df.limit(limit) if limit else df


def parse_text(spark: SparkSession, text: str, kind: str, base: str | None = None) -> DataFrame:
    """Quads of a text on the driver."""
    if kind in ("ntriples", "nquads"):
        return parse_lines(spark.createDataFrame([(x,) for x in text.splitlines()] or [("",)], "value string"))
    return spark.createDataFrame(_PARSERS[kind](text, base), QUAD)


def fetched(spark: SparkSession, url: str, seconds: float, most_bytes: int) -> DataFrame:
    """Quads of a remote document, read by the driver; its type, or else its name, tells the format."""
    import urllib.request

    asked = urllib.request.Request(url, headers={"Accept": ", ".join(MEDIA_TYPES)})
    with urllib.request.urlopen(asked, timeout=seconds) as r:
        data = r.read(most_bytes + 1)
        kind = MEDIA_TYPES.get(r.headers.get("Content-Type", "").split(";")[0].strip()) or format_of(url.split("?")[0])
    if len(data) > most_bytes:
        raise ValueError(f"{url} has more than {most_bytes} bytes")
    return parse_text(spark, decompressed(url, data).decode(), kind, url)


__all__ = ["SparqlSyntaxError", "fetched", "format_of", "negotiate", "parse_jsonld", "parse_lines", "parse_rdfxml", "parse_text", "parse_turtle", "read_documents", "read_lines", "read_rdf"]
