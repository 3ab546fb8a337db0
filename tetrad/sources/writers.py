"""Writers of RDF files and of query results. Lines and subject blocks are made by Spark and written in parallel."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF, XSD, parse_term


def lines(df: DataFrame) -> DataFrame:
    """N-Quads lines (value) of quads; triples of the default graph are N-Triples."""
    graph = F.when(F.col("g") == "", "").otherwise(F.concat(F.lit(" "), F.col("g"))) if "g" in df.columns else F.lit("")
    return df.select(F.concat(F.concat_ws(" ", "s", "p", "o"), graph, F.lit(" .")).alias("value"))


def _shortened(c: Column, prefixes: dict[str, str]) -> Column:
    """Terms with the prefixes' names where what follows is a plain local name."""
    out = c
    for name, iri in prefixes.items():
        local = F.regexp_extract(c, "^<" + _quoted(iri) + r"([A-Za-z_][A-Za-z0-9_\-]*)>$", 1)
        out = F.when(local != "", F.concat(F.lit(name + ":"), local)).otherwise(out)
    return out


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def blocks(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """One Turtle block for each graph and subject: g, value."""
    p = F.when(F.col("p") == f"<{RDF}type>", "a").otherwise(_shortened(F.col("p"), prefixes))
    rows = df.select(F.col("g") if "g" in df.columns else F.lit("").alias("g"), _shortened(F.col("s"), prefixes).alias("s"), p.alias("p"), _shortened(F.col("o"), prefixes).alias("o"))
    objects = rows.groupBy("g", "s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("o"))
    pairs = objects.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ").alias("body"))
    return pairs.select("g", F.concat_ws(" ", "s", "body", F.lit(".")).alias("value"))


def header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {n}: <{i}> .\n" for n, i in sorted(prefixes.items()))


def turtle(df: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Turtle blocks; every partition's file needs header() once, so it is put before each block's file by write_rdf."""
    return blocks(df, prefixes or {}).select("value")


def trig(df: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    b = blocks(df, prefixes or {})
    return b.select(F.when(F.col("g") == "", F.col("value")).otherwise(F.concat(F.col("g"), F.lit(" { "), F.col("value"), F.lit(" }"))).alias("value"))


def _with_frame(df: DataFrame, before: str, between: str, after: str) -> DataFrame:
    """Values with a text before, between and after those of each partition, so that each file is a document."""

    def run(batches):
        import pandas as pd

        first = True
        for b in batches:
            values = b["value"].tolist()
            if values:
                yield pd.DataFrame({"value": [before + values[0] if first else between + values[0], *[between + v for v in values[1:]]]})
                first = False
        if not first and after:
            yield pd.DataFrame({"value": [after]})

    return df.mapInPandas(run, "value string")


def jsonld_nodes(df: DataFrame) -> DataFrame:
    """Expanded JSON-LD node objects (value), one for each graph and subject."""
    lex = F.expr("regexp_extract(o, '^\"(?s)(.*)\"[^\"]*$', 1)")
    lang, dt = F.regexp_extract("o", '"@([A-Za-z0-9-]+)$', 1), F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1)
    text = F.concat(F.lit('"'), lex, F.lit('"'))
    ref = F.to_json(F.struct(F.regexp_replace("o", "^<|>$", "").alias("@id")))
    value = F.when(~F.col("o").startswith('"'), ref).otherwise(F.concat(F.lit('{"@value":'), text, F.when(lang != "", F.concat(F.lit(',"@language":"'), lang, F.lit('"'))).when(dt != "", F.concat(F.lit(',"@type":"'), dt, F.lit('"'))).otherwise(""), F.lit("}")))
    rows = df.select(F.col("g") if "g" in df.columns else F.lit("").alias("g"), F.regexp_replace("s", "^<|>$", "").alias("s"), F.regexp_replace("p", "^<|>$", "").alias("p"), value.alias("v"))
    fields = rows.groupBy("g", "s", "p").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("v")), ","), F.lit("]")).alias("v"))
    nodes = fields.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("p"), F.lit('":'), F.col("v")))), ",").alias("body"))
    node = F.concat(F.lit('{"@id":"'), F.col("s"), F.lit('",'), F.col("body"), F.lit("}"))
    return nodes.select(F.when(F.col("g") == "", node).otherwise(F.concat(F.lit('{"@id":"'), F.regexp_replace("g", "^<|>$", ""), F.lit('","@graph":['), node, F.lit("]}"))).alias("value"))


def rdfxml_nodes(df: DataFrame) -> DataFrame:
    """rdf:Description elements, one for each triple's subject and predicate."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for s, p, o in zip(b["s"], b["p"], b["o"]):
                iri = p[1:-1]
                cut = max(iri.rfind("#"), iri.rfind("/"), iri.rfind(":")) + 1
                about = f"rdf:about={quoteattr(s[1:-1])}" if s.startswith("<") else f"rdf:nodeID={quoteattr(s[2:].replace('.', '-'))}"
                kind, text, lang, dt = parse_term(o)
                if kind == "iri":
                    body = f" rdf:resource={quoteattr(text)}/>"
                elif kind == "bnode":
                    body = f" rdf:nodeID={quoteattr(text.replace('.', '-'))}/>"
                else:
                    body = (f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}" if dt else "") + f">{escape(text)}</ns:{iri[cut:]}>"
                out.append(f"<rdf:Description {about}><ns:{iri[cut:]} xmlns:ns={quoteattr(iri[:cut])}{body}</rdf:Description>")
            yield pd.DataFrame({"value": out})

    return df.select("s", "p", "o").mapInPandas(run, "value string")


def documents(df: DataFrame, kind: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Lines (value) whose every partition is a document of the format."""
    prefixes = prefixes or {}
    if kind in ("ntriples", "nquads"):
        return lines(df if kind == "nquads" else df.select("s", "p", "o"))
    if kind in ("turtle", "trig"):
        return _with_frame((turtle if kind == "turtle" else trig)(df, prefixes), header(prefixes), "", "")
    if kind == "jsonld":
        return _with_frame(jsonld_nodes(df), "[", ",", "]")
    if kind == "rdfxml":
        return _with_frame(rdfxml_nodes(df), f'<rdf:RDF xmlns:rdf="{RDF}">', "", "</rdf:RDF>")
    raise ValueError(f"no writer for {kind}")


def write_rdf(df: DataFrame, path: str, kind: str, prefixes: dict[str, str] | None = None) -> None:
    documents(df, kind, prefixes).write.text(path)


def convert(spark, source: str, target: str, kind: str, prefixes: dict[str, str] | None = None) -> None:
    """Read files of one format and write them in another."""
    from .rdf import read_rdf

    write_rdf(read_rdf(spark, source), target, kind, prefixes)


# results --------------------------------------------------------------------------------------------------------------------


def csv_lines(df: DataFrame) -> DataFrame:
    """SPARQL CSV rows of terms: plain texts, quoted where needed."""
    cells = []
    for c in df.columns:
        v = F.col(c)
        text = F.when(v.startswith("<"), F.regexp_replace(v, "^<|>$", "")).when(v.startswith('"'), F.regexp_replace(F.regexp_extract(v, r'(?s)^"(.*)"[^"]*$', 1), r'\\(["\\])', "$1")).otherwise(F.coalesce(v, F.lit("")))
        cells.append(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    """SPARQL TSV rows: terms as they are."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns]).alias("value"))


def _json_cell(t: str) -> dict:
    kind, text, lang, dt = parse_term(t)
    out = {"type": {"iri": "uri", "bnode": "bnode", "literal": "literal"}[kind], "value": text}
    return out | ({"xml:lang": lang} if lang else {"datatype": dt} if dt and dt != XSD + "string" else {})


def results(df: DataFrame, kind: str):
    """The text of a result (json, xml, csv or tsv) as pieces, row by row through the driver. A boolean ``ask`` is an answer."""
    ask = df.columns == ["ask"] and dict(df.dtypes)["ask"] == "boolean"
    if kind in ("csv", "tsv"):
        yield (",".join(df.columns) if kind == "csv" else "\t".join("?" + c for c in df.columns)) + "\n"
        for r in (csv_lines if kind == "csv" else tsv_lines)(df).toLocalIterator():
            yield r[0] + "\n"
    elif kind == "json":
        if ask:
            yield json.dumps({"head": {}, "boolean": df.first()[0]})
            return
        yield json.dumps({"head": {"vars": df.columns}})[:-1] + ', "results": {"bindings": ['
        for i, r in enumerate(df.toLocalIterator()):
            yield (", " if i else "") + json.dumps({c: _json_cell(r[c]) for c in df.columns if r[c] is not None}, ensure_ascii=False)
        yield "]}}"
    elif kind == "xml":
        yield '<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f"<variable name={quoteattr(c)}/>" for c in df.columns if not ask) + "</head>"
        if ask:
            yield f"<boolean>{str(df.first()[0]).lower()}</boolean></sparql>"
            return
        yield "<results>"
        for r in df.toLocalIterator():
            cells = []
            for c in df.columns:
                if r[c] is not None:
                    x, text, lang, dt = parse_term(r[c])
                    tag = {"iri": "uri", "bnode": "bnode", "literal": "literal"}[x]
                    more = f" xml:lang={quoteattr(lang)}" if lang else f" datatype={quoteattr(dt)}" if dt else ""
                    cells.append(f"<binding name={quoteattr(c)}><{tag}{more}>{escape(text)}</{tag}></binding>")
            yield "<result>" + "".join(cells) + "</result>"
        yield "</results></sparql>"
    else:
        raise ValueError(f"no result format {kind}")


def parse_results(text: str, kind: str) -> tuple[list[str], list[dict[str, str]] | bool]:
    """(variables, rows of terms) or (…, answer) from a JSON, XML or TSV result."""
    from ..functions.terms import literal

    if kind == "json":
        told = json.loads(text)
        if "boolean" in told:
            return [], told["boolean"]
        cell = lambda x: f"<{x['value']}>" if x["type"] == "uri" else f"_:{x['value']}" if x["type"] == "bnode" else literal(x["value"], x.get("xml:lang"), x.get("datatype"))
        return told["head"]["vars"], [{k: cell(v) for k, v in b.items()} for b in told["results"]["bindings"]]
    if kind == "xml":
        import xml.etree.ElementTree as ET

        ns = "{http://www.w3.org/2005/sparql-results#}"
        root = ET.fromstring(text)
        if (answer := root.find(f"{ns}boolean")) is not None:
            return [], answer.text == "true"
        rows = []
        for r in root.iter(f"{ns}result"):
            row = {}
            for b in r:
                x = b[0]
                tag = x.tag.removeprefix(ns)
                row[b.attrib["name"]] = f"<{x.text}>" if tag == "uri" else f"_:{x.text}" if tag == "bnode" else literal(x.text or "", x.attrib.get("{http://www.w3.org/XML/1998/namespace}lang"), x.attrib.get("datatype"))
            rows.append(row)
        return [v.attrib["name"] for v in root.iter(f"{ns}variable")], rows
    head, *rest = text.splitlines()
    names = [c.lstrip("?") for c in head.split("\t")]
    return names, [{n: t for n, t in zip(names, line.split("\t")) if t} for line in rest]
