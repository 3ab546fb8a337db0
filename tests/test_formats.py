"""RDF readers against known triples, and round trips through every writer."""

import pytest

from tetrad.sources import rdf, writers

TTL = """@prefix ex: <http://e/> . @base <http://b/> .
ex:a a ex:T ; ex:n 1, 2.5, 1e3, true, "x\\ty"@en, "d"^^ex:dt ; ex:l ( ex:b "c" ) ; ex:k [ ex:v <rel> ] . # note
_:q ex:p \"\"\"long "text\" \"\"\" .
"""


def test_turtle():
    got = rdf.parse_turtle(TTL)
    assert len(got) == 15
    assert ("", "<http://e/a>", "<http://e/n>", '"x\\ty"@en') in got
    assert any(o == "<http://b/rel>" for _, _, _, o in got)
    assert any(s == "_:nq" for _, s, _, _ in got)


def test_turtle_of_rdf_1_2():
    got = rdf.parse_turtle('VERSION "1.2" @version "1.2" . PREFIX ex: <http://e/> ex:s ex:p ex:o {| ex:by ex:me ; ex:at 1 |}, ex:q ~ ex:r {| ex:by ex:you |} ~ ex:t .')
    spo = {(s, p, o) for _, s, p, o in got}
    assert {("<http://e/s>", "<http://e/p>", "<http://e/o>"), ("<http://e/s>", "<http://e/p>", "<http://e/q>"), ("<http://e/r>", "<http://e/by>", "<http://e/you>")} <= spo
    who = next(s for s, p, o in spo if o == "<http://e/me>")
    assert (who, f"<{rdf.RDF}subject>", "<http://e/s>") in spo and (who, f"<{rdf.RDF}object>", "<http://e/o>") in spo and any(s == who and p == "<http://e/at>" for s, p, _ in spo)
    assert all((x, f"<{rdf.RDF}object>", "<http://e/q>") in spo for x in ("<http://e/r>", "<http://e/t>"))


def test_negotiation():
    assert rdf.negotiate("text/turtle;q=0.5, application/n-quads;q=0.9, text/html") == "nquads" and rdf.negotiate("text/html", "trig") == "trig" and rdf.negotiate("*/*") == "turtle"
    assert rdf.format_of("a/b.nq.gz") == "nquads" and rdf.format_of("x.TTL") == "turtle"


def test_trig():
    got = rdf.parse_turtle("@prefix ex: <http://e/> . ex:a ex:p ex:b . ex:g { ex:c ex:p ex:d } GRAPH ex:h { ex:e ex:p 1 } { ex:f ex:p 2 }")
    assert sorted(g for g, *_ in got) == ["", "", "<http://e/g>", "<http://e/h>"]


def test_rdfxml():
    got = rdf.parse_rdfxml("""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://e/" xml:base="http://b/x">
      <ex:T rdf:about="#a" ex:attr="v"><ex:p rdf:resource="c"/><ex:q xml:lang="de">w</ex:q><ex:r rdf:parseType="Resource"><ex:s rdf:datatype="http://e/d">1</ex:s></ex:r>
      <ex:l rdf:parseType="Collection"><rdf:Description rdf:about="http://e/1"/></ex:l><rdf:li>one</rdf:li></ex:T></rdf:RDF>""")
    assert ("", "<http://b/x#a>", f"<{rdf.RDF}type>", "<http://e/T>") in got and ("", "<http://b/x#a>", "<http://e/p>", "<http://b/c>") in got
    assert ("", "<http://b/x#a>", "<http://e/q>", '"w"@de') in got and ("", "<http://b/x#a>", f"<{rdf.RDF}_1>", '"one"') in got and len(got) == 10


def test_jsonld():
    got = rdf.parse_jsonld("""{"@context": {"ex": "http://e/", "name": "ex:name", "knows": {"@id": "ex:knows", "@type": "@id"}, "tags": {"@id": "ex:tags", "@container": "@list"}, "label": {"@id": "ex:label", "@container": "@language"}},
      "@id": "ex:a", "@type": "ex:T", "name": "A", "knows": ["ex:b"], "tags": ["x"], "label": {"en": "hi"}, "ex:n": 3, "@reverse": {"knows": {"@id": "ex:z"}}}""")
    assert ("", "<http://e/a>", "<http://e/knows>", "<http://e/b>") in got and ("", "<http://e/z>", "<http://e/knows>", "<http://e/a>") in got
    assert ("", "<http://e/a>", "<http://e/label>", '"hi"@en') in got and ("", "<http://e/a>", "<http://e/n>", '"3"^^<http://www.w3.org/2001/XMLSchema#integer>') in got and len(got) == 9


QUADS = [("", "<http://e/a>", "<http://e/p>", '"x \\"q\\" \\n"'), ("", "<http://e/a>", "<http://e/p>", "<http://e/b>"), ("", "_:b1", "<http://e/p>", '"v"@en'), ("", "<http://e/a>", "<http://e/q>", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>')]


@pytest.mark.parametrize("kind,ext", [("ntriples", "nt"), ("nquads", "nq"), ("turtle", "ttl"), ("trig", "trig"), ("rdfxml", "rdf"), ("jsonld", "jsonld")])
def test_round_trips(spark, tmp_path, kind, ext):
    df = spark.createDataFrame(QUADS, rdf.QUAD).coalesce(1)
    writers.documents(df, kind, {"ex": "http://e/"}).coalesce(1).write.text(str(tmp_path / f"x.{ext}"))
    got = {(s if s[0] == "<" else "_", p, o) for _, s, p, o in rdf.read_rdf(spark, str(tmp_path / f"x.{ext}" / "part-*"), kind).collect()}
    assert got == {(s if s[0] == "<" else "_", p, o) for _, s, p, o in QUADS}


def test_line_errors_and_negotiation(spark):
    lines = spark.createDataFrame([("<a:s> <a:p> \"\\u0041\" . # c",), ("",), ("# only",)], "value string")
    assert rdf.parse_lines(lines).first().o == '"A"'
    bad = spark.createDataFrame([("<a:s> nonsense",)], "value string")
    with pytest.raises(Exception):
        rdf.parse_lines(bad).collect()
    assert rdf.parse_lines(bad, strict=False).count() == 0
    assert rdf.negotiate("text/html, application/ld+json;q=0.8, text/turtle;q=0.9") == "turtle" and rdf.format_of("x/y.nq.gz") == "nquads"


@pytest.mark.parametrize("kind", ["json", "xml", "tsv"])
def test_results(spark, kind):
    df = spark.createDataFrame([("<http://e/a>", '"x"@en'), (None, '"1"^^<http://www.w3.org/2001/XMLSchema#integer>')], "a string, b string").coalesce(1)
    names, got = writers.parse_results("".join(writers.results(df, kind)), kind)
    assert names == ["a", "b"] and got == [{"a": "<http://e/a>", "b": '"x"@en'}, {"b": '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'}]
    assert "".join(writers.results(df, "csv")).splitlines() == ["a,b", "http://e/a,x", ",1"]
