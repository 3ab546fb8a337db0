"""N3 patches: a condition, deletions and insertions on one graph, applied together or not at all."""

from __future__ import annotations

from ..plans import algebra as A
from ..plans import compiler as C
from ..plans.parser import Parser, SparqlSyntaxError
from . import quads as Q
from .engine import Store, time_now

#: The vocabulary of patches.
SOLID = "http://www.w3.org/ns/solid/terms#"


class PatchConflict(ValueError):
    """The condition does not hold exactly once, or what is to be deleted is not there."""


def parse_patch(text: str) -> A.Update:
    """An update with the patch's where, deletes and inserts."""
    p = Parser(text)
    found: dict[str, list[A.Triple]] = {}
    while p.kind != "end":
        kind, t, _ = p.toks[p.i]
        if (kind == "lang" and t == "@prefix") or p.peek("PREFIX"):
            p.i += 1
            name = p.next()
            p.prefixes[name[:-1]] = p.iri()
            p.take(".")
        elif kind in ("name", "iri"):
            iri = p.iri()
            if p.peek("{"):
                part = iri.removeprefix(SOLID)
                if part not in ("where", "deletes", "inserts") or part in found:
                    raise SparqlSyntaxError(f"unexpected formula of {iri}")
                found[part] = p.template()
        else:
            p.i += 1
    if not {"deletes", "inserts"} & set(found):
        raise SparqlSyntaxError("the patch neither deletes nor inserts")
    quads = lambda part: [(None, t) for t in found.get(part, [])]
    return A.Update("MODIFY", quads("inserts"), quads("deletes"), A.Group([A.Bgp(found["where"])] if found.get("where") else []))


def apply_patch(store: Store, text: str, graph: str | None = None, now: str | None = None) -> None:
    """Apply a patch to a graph (None: the default graph). A conflict leaves the store as it was."""
    u, now = parse_patch(text), now or time_now()
    u.with_graph = graph
    live = Q.QuadSource(Q.view(store.table, A.Temporal(), now, store.profile))
    ctx = C.Context(store.spark, live, A.Term(f"<{graph}>") if graph else None, now=now)
    sol = C._full(C.group(u.where, ctx), ctx)
    if u.where.elements and sol.df.limit(2).count() != 1:
        raise PatchConflict("the condition does not hold exactly once")
    if u.deletes:
        gone = store._rows(u.deletes, sol, ctx, f"<{graph}>" if graph else "")
        if not gone.join(live.df.select("g", "s", "p", "o"), ["g", "s", "p", "o"], "left_anti").isEmpty():
            raise PatchConflict("a triple to delete is not there")
    store.apply(u, now)
