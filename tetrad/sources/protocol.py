"""The SPARQL protocol over HTTP: a store as an endpoint, and endpoints as services of a query."""

from __future__ import annotations

import threading
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..plans.parser import SparqlSyntaxError, parse_query, parse_update
from . import writers
from .rdf import MEDIA_TYPES, negotiate

#: Media types of results.
RESULT_TYPES = {"application/sparql-results+json": "json", "application/json": "json", "application/sparql-results+xml": "xml", "application/xml": "xml", "text/csv": "csv", "text/tab-separated-values": "tsv"}
DESCRIPTION = """@prefix sd: <http://www.w3.org/ns/sparql-service-description#> .
[] a sd:Service ; sd:supportedLanguage sd:SPARQL11Query%s ;
  sd:resultFormat <http://www.w3.org/ns/formats/SPARQL_Results_JSON>, <http://www.w3.org/ns/formats/SPARQL_Results_XML>, <http://www.w3.org/ns/formats/SPARQL_Results_CSV>, <http://www.w3.org/ns/formats/SPARQL_Results_TSV> .
"""


def result_type(accept: str) -> tuple[str, str]:
    """(media type, format) of a result; JSON where nothing known is accepted."""
    offers = []
    for i, part in enumerate(accept.split(",")):
        kind, *params = [x.strip() for x in part.split(";")]
        if kind in RESULT_TYPES:
            offers.append((-next((float(p[2:]) for p in params if p.startswith("q=")), 1.0), i, kind))
    kind = min(offers)[2] if offers else "application/sparql-results+json"
    return kind, RESULT_TYPES[kind]


def answer(store, query: str, accept: str, seconds: float) -> tuple[str, Iterable[str]]:
    """(media type, pieces) of a query's result. Spark's jobs for it are cancelled after ``seconds``."""
    form, sc, group = parse_query(query).form, store.spark.sparkContext, str(uuid.uuid4())

    def pieces(make) -> Iterable[str]:
        sc.setJobGroup(group, "query", interruptOnCancel=True)
        timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
        timer.start()
        try:
            yield from make()
        finally:
            timer.cancel()

    if form in ("SELECT", "ASK"):
        kind, name = result_type(accept)
        return kind, pieces(lambda: writers.results(store.query(query), name))
    name = negotiate(accept, "ntriples")
    name = name if name in ("turtle", "ntriples") else "ntriples"
    kind = next(k for k, v in MEDIA_TYPES.items() if v == name)
    rows = lambda: (writers.turtle if name == "turtle" else writers.lines)(store.query(query).select("s", "p", "o"))
    return kind, pieces(lambda: (r[0] + "\n" for r in rows().toLocalIterator()))


def serve(store, port: int = 0, updates: bool = False, seconds: float = 60.0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serve a store until shutdown() of the returned server; updates only if they are asked for. Port 0 takes a free one."""
    writing = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a) -> None:
            pass

        def told(self, status: int, kind: str, pieces: Iterable[str]) -> None:
            body = "".join(pieces).encode()
            self.send_response(status)
            for k, v in {"Content-Type": kind + "; charset=utf-8", "Content-Length": str(len(body)), "Access-Control-Allow-Origin": "*"}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for k, v in {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type, Accept"}.items():
                self.send_header(k, v)
            self.end_headers()

        def do_GET(self) -> None:
            self.run(urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query), False)

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            kind = self.headers.get("Content-Type", "").split(";")[0].strip()
            asked = {"application/sparql-query": {"query": [body]}, "application/sparql-update": {"update": [body]}}.get(kind)
            self.run(asked if asked is not None else urllib.parse.parse_qs(body), True)

        def run(self, asked: dict[str, list[str]], may_write: bool) -> None:
            try:
                if "update" in asked:
                    if not updates or not may_write:
                        return self.told(403, "text/plain", ["updates are off\n"])
                    parse_update(asked["update"][0])
                    with writing:
                        store.update(asked["update"][0])
                    return self.told(200, "text/plain", ["done\n"])
                if "query" in asked:
                    kind, pieces = answer(store, asked["query"][0], self.headers.get("Accept", ""), seconds)
                    return self.told(200, kind, list(pieces))
                if may_write:
                    return self.told(400, "text/plain", ["neither query nor update\n"])
                self.told(200, "text/turtle", [DESCRIPTION % (", sd:SPARQL11Update" if updates else "")])
            except SparqlSyntaxError as e:
                self.told(400, "text/plain", [f"{e}\n"])
            except Exception as e:
                self.told(503 if "cancelled" in str(e) else 500, "text/plain", [f"{type(e).__name__}: {str(e)[:500]}\n"])

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class Services(dict):
    """Services of a query by their IRI: registered functions, and any endpoint that speaks HTTP."""

    def __init__(self, *a, seconds: float = 30.0, most_bytes: int = 100 << 20, **k):
        super().__init__(*a, **k)
        self.seconds, self.most_bytes = seconds, most_bytes

    def __missing__(self, iri: str):
        if not iri.startswith(("http://", "https://")):
            raise KeyError(iri)

        def ask(query: str, names: list[str]) -> list[dict[str, str]]:
            return self.asked(iri, query)

        ask.whole = True  # it is given a whole query, with prefixes
        return ask

    def asked(self, iri: str, query: str) -> list[dict[str, str]]:
        body = urllib.parse.urlencode({"query": query}).encode()
        with urllib.request.urlopen(urllib.request.Request(iri, body, {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"}), timeout=self.seconds) as r:
            data = r.read(self.most_bytes + 1)
        if len(data) > self.most_bytes:
            raise ValueError(f"{iri} answered more than {self.most_bytes} bytes")
        return writers.parse_results(data.decode(), "json")[1]
