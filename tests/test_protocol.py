"""The SPARQL protocol on this machine: queries, updates, errors, services and remote documents."""

import json
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tetrad.operators import quads as Q
from tetrad.operators.engine import Store
from tetrad.sources import protocol, writers


@pytest.fixture
def store(spark):
    rows = [(f"<n:{i}>", "<p:name>", f'"name {i}"@en') for i in range(5)]
    return Store(spark, Q.from_triples(spark.createDataFrame(rows, "s string, p string, o string")))


def call(server, path="/", data=None, **headers):
    url = f"http://127.0.0.1:{server.server_port}{path}"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data.encode() if data else None, {k.replace("_", "-"): v for k, v in headers.items()}), timeout=60) as r:
            return r.status, r.headers.get("Content-Type"), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type"), e.read().decode()


def test_queries_updates_and_errors(store):
    closed, opened = protocol.serve(store), protocol.serve(store, updates=True)
    ask = "/?query=" + urllib.parse.quote("SELECT ?s ?o WHERE { ?s <p:name> ?o }")
    status, kind, body = call(closed, ask)
    assert status == 200 and kind.startswith("application/sparql-results+json") and len(json.loads(body)["results"]["bindings"]) == 5
    for accept, name in (("text/csv", "csv"), ("application/sparql-results+xml;q=0.9, text/csv;q=0.1", "xml"), ("text/tab-separated-values", "tsv")):
        assert call(closed, ask, Accept=accept)[2] == "".join(writers.results(store.query("SELECT ?s ?o WHERE { ?s <p:name> ?o }"), name))
    assert json.loads(call(closed, data="ASK { <n:1> ?p ?o }", Content_Type="application/sparql-query")[2])["boolean"] is True
    status, kind, body = call(closed, "/?query=" + urllib.parse.quote("CONSTRUCT { ?o0 <p:of> ?s } WHERE { ?s <p:name> ?o BIND(IRI(CONCAT('x:', STR(?s))) AS ?o0) }"))
    assert kind.startswith("application/n-triples") and len(body.splitlines()) == 5
    assert call(closed, "/?query=SELEKT")[0] == 400 and call(closed, data="x=1")[0] == 400
    assert call(closed, data="CLEAR ALL", Content_Type="application/sparql-update")[0] == 403 and call(opened, "/?update=CLEAR%20ALL")[0] == 403
    assert call(opened, data='INSERT DATA { <n:9> <p:name> "nine" }', Content_Type="application/sparql-update")[0] == 200
    assert json.loads(call(closed, data="query=" + urllib.parse.quote("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }"), Content_Type="application/x-www-form-urlencoded")[2])["results"]["bindings"][0]["n"]["value"] == "6"
    assert "SPARQL11Update" in call(opened)[2] and "SPARQL11Update" not in call(closed)[2] and call(opened)[1].startswith("text/turtle")
    closed.shutdown(), opened.shutdown()


def test_endpoints_are_services_and_documents(spark, store):
    server = protocol.serve(store)
    url = f"http://127.0.0.1:{server.server_port}/"
    mine = Store(spark, Q.from_triples(spark.createDataFrame([("<n:2>", "<p:age>", '"7"'), ("<n:8>", "<p:age>", '"8"')], "s string, p string, o string")))
    mine.services = protocol.Services()
    got = mine.query(f"PREFIX p: <p:> SELECT ?s ?a ?o WHERE {{ ?s p:age ?a SERVICE <{url}> {{ ?s p:name ?o }} }}").collect()
    assert [(r.s, r.o) for r in got] == [("<n:2>", '"name 2"@en')]
    with pytest.raises(KeyError):
        mine.query("SELECT * WHERE { SERVICE <urn:none> { ?s ?p ?o } }")
    document = url + "?query=" + urllib.parse.quote("CONSTRUCT WHERE { ?s <p:name> ?o }", safe="")
    mine.update(f"LOAD <{document}> INTO GRAPH <g:loaded>")
    assert mine.query("SELECT * WHERE { GRAPH <g:loaded> { ?s ?p ?o } }").count() == 5
    mine.limits.triples = 4
    with pytest.raises(ValueError, match="more than 4 triples"):
        mine.update(f"LOAD <{document}> INTO GRAPH <g:again>")
    mine.limits.triples, mine.limits.bytes = None, 10
    with pytest.raises(ValueError, match="more than 10 bytes"):
        mine.update(f"LOAD <{document}> INTO GRAPH <g:again>")
    mine.update(f"LOAD SILENT <{document}> INTO GRAPH <g:again>")
    assert mine.query("SELECT * WHERE { GRAPH <g:again> { ?s ?p ?o } }").count() == 0
    server.shutdown()
