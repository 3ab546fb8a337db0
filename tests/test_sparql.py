"""Operators over a seven-triple store, temporal edges, updates, paths and reasoning, with hand-computed answers."""

import pytest

from tetrad.functions.terms import parse_term
from tetrad.operators import quads as Q
from tetrad.operators import reason
from tetrad.operators.engine import Store
from tetrad.plans.parser import SparqlSyntaxError, parse_query, parse_update

P = "PREFIX ex: <http://e/> PREFIX foaf: <http://f/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
DATA = """INSERT DATA { ex:Alice foaf:name "Alice" ; foaf:age 30 ; foaf:knows ex:Bob . ex:Bob foaf:name "Bob" ; foaf:age 25 . ex:Charlie foaf:name "Charlie" ; foaf:age 35 }"""


@pytest.fixture(scope="module")
def foaf(spark):
    s = Store(spark)
    s.update(P + DATA, "2024-01-01 00:00:00")
    return s


def text(t):
    return None if t is None else parse_term(t)[1].removeprefix("http://e/") if isinstance(t, str) else t


def rows(store, q, **more):
    return sorted((tuple(text(c) for c in r) for r in store.query(P + q, **more).collect()), key=str)


@pytest.mark.parametrize(
    "q,expected",
    [
        ("SELECT ?s ?p ?o WHERE { ?s ?p ?o }", 7),
        ("SELECT ?p ?o WHERE { ex:Alice ?p ?o }", 3),
        ("SELECT ?s WHERE { ?s foaf:age ?a FILTER(?a > 25) }", [("Alice",), ("Charlie",)]),
        ("SELECT ?s WHERE { ?s foaf:age 30.0 }", []),
        ("SELECT ?s WHERE { ?s foaf:age ?a FILTER(?a = 30.0) }", [("Alice",)]),
        ("SELECT ?n ?k WHERE { ?s foaf:name ?n OPTIONAL { ?s foaf:knows ?k } }", [("Alice", "Bob"), ("Bob", None), ("Charlie", None)]),
        ("SELECT ?n WHERE { ?s foaf:name ?n FILTER NOT EXISTS { ?x foaf:knows ?s } }", [("Alice",), ("Charlie",)]),
        ("SELECT ?n WHERE { ?s foaf:name ?n MINUS { ?s foaf:knows ?k } }", [("Bob",), ("Charlie",)]),
        ("SELECT ?n WHERE { ?s foaf:name ?n MINUS { ?x foaf:knows ?k } }", [("Alice",), ("Bob",), ("Charlie",)]),
        ("SELECT ?x WHERE { { ?x foaf:age 30 } UNION { ?x foaf:age 25 } }", [("Alice",), ("Bob",)]),
        ("SELECT (COUNT(*) AS ?n) (AVG(?a) AS ?m) WHERE { ?s foaf:age ?a }", [("3", "30.0")]),
        ("SELECT (MIN(?a) AS ?x) (MAX(?n) AS ?y) WHERE { ?s foaf:age ?a ; foaf:name ?n }", [("25", "Charlie")]),
        ("SELECT (COUNT(?z) AS ?n) (SUM(?z) AS ?s) WHERE { ?s foaf:none ?z }", [("0", "0")]),
        ("SELECT ?s WHERE { ?s foaf:age ?a } ORDER BY DESC(?a) LIMIT 1", [("Charlie",)]),
        ("SELECT ?s WHERE { ?s foaf:age ?a } LIMIT 0", []),
        ("SELECT ?x WHERE { VALUES ?x { ex:Bob UNDEF } ?x foaf:age ?a }", [("Alice",), ("Bob",), ("Bob",), ("Charlie",)]),
        ("SELECT ?u WHERE { ex:Bob foaf:name ?n BIND(UCASE(SUBSTR(?n, 2)) AS ?u) }", [("OB",)]),
        ("SELECT ?v WHERE { ex:Bob foaf:age ?a BIND(?a / 2 AS ?v) }", [("12.5",)]),
        ("SELECT ?s WHERE { ?s foaf:name ?n FILTER(!(?missing = 1)) }", []),
        ("SELECT ?s WHERE { ?s foaf:name ?n FILTER(REGEX(?n, '^b', 'i')) }", [("Bob",)]),
        ("SELECT ?n WHERE { ?s foaf:name ?n FILTER(text:match(?n, 'ALI')) }", [("Alice",)]),
        ("SELECT ?n (COUNT(*) AS ?c) WHERE { ?s ?p ?o . ?s foaf:name ?n } GROUP BY ?n HAVING (COUNT(*) > 2)", [("Alice", "3")]),
    ],
)
def test_queries(foaf, q, expected):
    got = rows(foaf, q)
    assert len(got) == expected if isinstance(expected, int) else got == expected


def test_lexical_functions(foaf):
    q = """SELECT (STRLANG("a", "en") AS ?a) (DATATYPE(?n) AS ?d) (LANGMATCHES("en-GB", "en") AS ?l) (STRBEFORE("abc", "b") AS ?b) (STRAFTER("abc", "z") AS ?c) (YEAR("2011-01-10T14:45:13Z"^^xsd:dateTime) AS ?y)
      (TZ("2011-01-10T14:45:13Z"^^xsd:dateTime) AS ?z) (ENCODE_FOR_URI("a b~*") AS ?e) (ROUND(-2.5) AS ?r) WHERE { ex:Bob foaf:name ?n }"""
    r = foaf.query(P + q).first()
    assert r.a == '"a"@en' and r.d == "<http://www.w3.org/2001/XMLSchema#string>" and text(r.l) == "true" and (text(r.b), text(r.c)) == ("a", "") and text(r.y) == "2011"
    assert text(r.z) == "Z" and text(r.e) == "a%20b~%2A" and float(text(r.r)) == -3


def test_ask_construct_describe(foaf):
    assert foaf.query(P + "ASK { ex:Alice foaf:knows ex:Bob }").first()[0] is True
    assert foaf.query(P + "CONSTRUCT { ?k ex:by ?s } WHERE { ?s foaf:knows ?k }").count() == 1
    assert foaf.query(P + "DESCRIBE ex:Bob").count() == 3
    assert "GroupBy" in foaf.explain(P + "SELECT ?s (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?s")


def test_paths_on_a_cycle(spark):
    s = Store(spark)
    s.update(P + "INSERT DATA { ex:a ex:p ex:b . ex:b ex:p ex:c . ex:c ex:p ex:a . ex:c ex:q ex:d }", "2024-01-01 00:00:00")
    assert rows(s, "SELECT ?x WHERE { ex:a ex:p+ ?x }") == [("a",), ("b",), ("c",)]
    assert rows(s, "SELECT ?x WHERE { ?x ex:p* ex:b }") == [("a",), ("b",), ("c",)]
    assert rows(s, "SELECT ?x ?y WHERE { ?x ex:p/ex:q ?y }") == [("b", "d")]
    assert rows(s, "SELECT ?y WHERE { ex:c (ex:p|ex:q) ?y }") == [("a",), ("d",)]
    assert rows(s, "SELECT ?y WHERE { ex:d ^ex:q ?y }") == [("c",)]
    assert rows(s, "SELECT ?y WHERE { ex:c !ex:p ?y }") == [("d",)]
    assert rows(s, "SELECT ?y WHERE { ex:d ex:p? ?y }") == [("d",)]
    assert len(rows(s, "SELECT ?x ?y WHERE { ?x ex:p+ ?y }")) == 9


@pytest.fixture(scope="module")
def employed(spark):
    df = spark.createDataFrame(
        [("alice", "Acme", "2020-01-01", "2023-06-30"), ("alice", "Next", "2023-07-01", "9999-12-31 23:59:59.999"), ("bob", "Acme", "2019-01-01", "2022-12-31"), ("eve", "Zero", "2021-01-01", "2021-01-01")], "s string, o string, a string, b string"
    ).selectExpr("'' g", "concat('<http://e/', s, '>') s", "'<http://e/worksFor>' p", "concat('<http://e/', o, '>') o", "cast(a as timestamp) valid_from", "cast(b as timestamp) valid_to", "timestamp'2024-01-01' tx_time", "false is_deleted", "1 version")
    return Store(spark, df)


@pytest.mark.parametrize(
    "clause,expected",
    [
        ('AS OF "2021-06-15"^^xsd:date', [("alice", "Acme"), ("bob", "Acme")]),
        ('AS OF "2020-01-01"^^xsd:date', [("alice", "Acme"), ("bob", "Acme")]),
        ('AS OF "2022-12-31"^^xsd:date', [("alice", "Acme")]),
        ('AS OF "2023-08-01"^^xsd:date', [("alice", "Next")]),
        ('DURING ["2023-01-01"^^xsd:date, "2023-12-31"^^xsd:date]', [("alice", "Acme"), ("alice", "Next")]),
        ('DURING ["2018-01-01"^^xsd:date, "2019-01-01"^^xsd:date]', []),
        ('DURING ["2020-12-31"^^xsd:date, "2021-01-02"^^xsd:date]', [("alice", "Acme"), ("bob", "Acme"), ("eve", "Zero")]),
        ("ALL VERSIONS", [("alice", "Acme"), ("alice", "Next"), ("bob", "Acme"), ("eve", "Zero")]),
    ],
)
def test_temporal_edges(employed, clause, expected):
    assert rows(employed, "SELECT ?s ?o WHERE { ?s ex:worksFor ?o } " + clause) == expected


def test_updates_and_graphs(spark):
    s = Store(spark)
    now = "2024-01-01 00:00:00"
    s.update(P + DATA + "; INSERT DATA { GRAPH ex:g { ex:Z foaf:name 'Z' } }", now)
    s.update(P + "DELETE { ?s foaf:age ?a } INSERT { ?s foaf:age ?b } WHERE { ?s foaf:age ?a BIND(?a + 1 AS ?b) }", "2024-02-01 00:00:00")
    assert rows(s, "SELECT ?a WHERE { ?s foaf:age ?a }") == [("26",), ("31",), ("36",)]
    s.update(P + "COPY ex:g TO ex:h; DELETE WHERE { ex:Bob foaf:name ?n }", "2024-03-01 00:00:00")
    assert rows(s, "SELECT ?g WHERE { GRAPH ?g { ?s foaf:name ?n } }") == [("g",), ("h",)]
    assert rows(s, "SELECT ?n WHERE { ?s foaf:name ?n }") == [("Alice",), ("Charlie",)]
    assert len(rows(s, "SELECT * WHERE { ex:Bob foaf:name ?n } ALL VERSIONS")) == 1
    s.update(P + "MOVE ex:h TO DEFAULT; CLEAR GRAPH ex:g", "2024-04-01 00:00:00")
    assert rows(s, "SELECT ?n WHERE { ?s foaf:name ?n }") == [("Z",)] and s.graphs().count() == 0
    with pytest.raises(Q.ProfileCapabilityError):
        Store(spark, profile="reference").update(P + DATA)


def test_snapshots(spark, tmp_path):
    s = Store(spark)
    s.update(P + DATA, "2024-01-01 00:00:00")
    s.save(str(tmp_path))
    s.update(P + "DELETE WHERE { ex:Bob ?p ?o }")
    assert s.save(str(tmp_path)) == "snap-00000002"
    assert len(rows(Store.open(spark, str(tmp_path)), "SELECT * WHERE { ?s ?p ?o }")) == 5
    assert len(rows(Store.open(spark, str(tmp_path), "snap-00000001"), "SELECT * WHERE { ?s ?p ?o }")) == 7


def test_datasets(spark):
    s = Store(spark)
    s.update(P + "INSERT DATA { ex:d ex:p 0 . GRAPH ex:g { ex:x ex:p 1 } GRAPH ex:h { ex:x ex:p 1 . ex:y ex:p 2 } }", "2024-01-01 00:00:00")
    assert rows(s, "SELECT ?s FROM ex:g FROM ex:h WHERE { ?s ex:p ?o }") == [("x",), ("y",)]
    assert rows(s, "SELECT ?g ?s FROM NAMED ex:h WHERE { GRAPH ?g { ?s ex:p ?o } }") == [("h", "x"), ("h", "y")]
    assert rows(s, "SELECT ?s FROM ex:g WHERE { GRAPH ex:h { ?s ex:p ?o } }") == []


def test_service(spark, foaf):
    foaf.services["http://far/"] = lambda text, names: [{"s": "<http://e/Bob>", "x": '"far"'}]
    assert rows(foaf, "SELECT ?n ?x WHERE { ?s foaf:name ?n SERVICE <http://far/> { ?s ex:x ?x } }") == [("Bob", "far")]
    assert len(rows(foaf, "SELECT ?n WHERE { ?s foaf:name ?n SERVICE SILENT <http://none/> { ?s ex:x ?x } }")) == 3


def test_service_asks_every_endpoint(spark):
    s, n = Store(spark), 1200
    s.services = {f"http://far/{i}": lambda text, names, i=i: [{"x": f'"far{i}"'}] for i in range(n)}
    assert rows(s, "SELECT ?x WHERE { VALUES ?ep { " + " ".join(f"<{e}>" for e in s.services) + " } SERVICE ?ep { ?any ex:x ?x } }") == sorted([(f"far{i}",) for i in range(n)], key=str)


@pytest.mark.parametrize("q", ["SELECT WHERE { ?s ?p ?o }", "SELECT ?s { ?s ?p }", "SELECT ?s ?s { ?s ?p ?o }", "SELECT ?s (COUNT(?o) AS ?n) { ?s ?p ?o } GROUP BY ?p", "SELECT * { ?s none:p ?o }", "SELECT * { ?s ?p ?o BIND(1 AS ?o) }"])
def test_syntax_errors(q):
    with pytest.raises((SparqlSyntaxError, IndexError)):
        parse_query(q)


def test_update_sequences_parse():
    assert [u.kind for u in parse_update("CREATE GRAPH <a:b> ; DROP SILENT ALL ; LOAD <file:///x> INTO GRAPH <a:g>")] == ["CREATE", "DROP", "LOAD"]


T = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


@pytest.mark.parametrize(
    "facts,expected",
    [
        ([("<Fido>", T, "<Dog>"), ("<Dog>", reason.SUB_CLASS, "<Mammal>"), ("<Mammal>", reason.SUB_CLASS, "<Animal>")], {("<Fido>", T, "<Mammal>"), ("<Fido>", T, "<Animal>"), ("<Dog>", reason.SUB_CLASS, "<Animal>")}),
        ([("<a>", "<p>", "<b>"), ("<p>", reason.SUB_PROPERTY, "<q>")], {("<a>", "<q>", "<b>")}),
        ([("<a>", "<p>", '"x"'), ("<p>", reason.RANGE, "<C>"), ("<p>", reason.DOMAIN, "<D>")], {("<a>", T, "<D>")}),
        ([("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<p>", T, reason.TRANSITIVE)], {("<a>", "<p>", "<c>")}),
        ([("<a>", "<p>", "<b>"), ("<p>", T, reason.SYMMETRIC)], {("<b>", "<p>", "<a>")}),
        ([("<a>", "<p>", "<b>"), ("<p>", reason.INVERSE, "<q>"), ("<c>", "<q>", "<d>")], {("<b>", "<q>", "<a>"), ("<d>", "<p>", "<c>")}),
        ([("<a>", reason.SAME, "<b>"), ("<a>", "<p>", "<x>"), ("<y>", "<p>", "<a>")], {("<b>", reason.SAME, "<a>"), ("<b>", "<p>", "<x>"), ("<y>", "<p>", "<b>")}),
        ([("<A>", reason.EQUAL_CLASS, "<B>"), ("<x>", T, "<A>")], {("<A>", reason.SUB_CLASS, "<B>"), ("<B>", reason.SUB_CLASS, "<A>"), ("<B>", reason.EQUAL_CLASS, "<A>"), ("<x>", T, "<B>")}),
    ],
)
def test_reasoning(spark, facts, expected):
    got = {tuple(r) for r in reason.materialize(spark.createDataFrame(facts, "s string, p string, o string")).collect()}
    assert expected <= got
    assert got.isdisjoint(facts)
