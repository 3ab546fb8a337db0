"""SPARQL 1.1 queries and updates, with temporal clauses, to algebra: a recursive descent over a list of tokens."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from ..functions.terms import RDF, XSD, literal, read_escapes
from . import algebra as A


class SparqlSyntaxError(ValueError):
    """The text is no query or update."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n\r]*)
      |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
      |(?P<string>\"{3}(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
      |(?P<var>[?$]\w+)
      |(?P<blank>_:\w(?:[\w.\-]*[\w\-])?)
      |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
      |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?)
      |(?P<name>(?:\w(?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
      |(?P<word>[A-Za-z_]\w*)
      |(?P<mark>\^\^|<<\(|\)>>|<<|>>|<=|>=|!=|&&|\|\||\{\||\|\}|[{}()\[\].;,=<>!+\-*/^|?@~])""",
    re.X | re.S,
)

AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlSyntaxError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    out.append(("end", "", at))
    return out


class Parser:
    def __init__(self, text: str, base: str | None = None):
        self.text, self.toks, self.i = text, tokens(text), 0
        self.prefixes: dict[str, str] = {}
        self.base, self.fresh = base, 0

    # tokens

    def peek(self, *words: str) -> bool:
        kind, t, _ = self.toks[self.i]
        return kind in ("word", "mark") and t.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> str:
        if not self.peek(*words):
            raise SparqlSyntaxError(f"expected {' or '.join(words)} but found {self.toks[self.i][1]!r} at {self.toks[self.i][2]}")
        self.i += 1
        return self.toks[self.i - 1][1]

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    def next(self) -> str:
        self.i += 1
        return self.toks[self.i - 1][1]

    def new_var(self) -> A.Var:
        self.fresh += 1
        return A.Var(f" b{self.fresh}")  # a space: no variable of the text has it

    # terms

    def iri(self) -> str:
        kind, t, at = self.toks[self.i]
        if kind == "iri":
            self.i += 1
            t = read_escapes(t[1:-1])
            return urljoin(self.base, t) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", t) else t
        if kind == "name":
            self.i += 1
            prefix, local = t.split(":", 1)
            if prefix not in self.prefixes:
                raise SparqlSyntaxError(f"unknown prefix {prefix!r} at {at}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SparqlSyntaxError(f"expected an IRI but found {t!r} at {at}")

    def string(self) -> str:
        t = self.next()
        q = 3 if t[:3] in ('"""', "'''") and len(t) >= 6 else 1
        return read_escapes(t[q:-q])

    def literal(self) -> A.Term | None:
        kind, t, _ = self.toks[self.i]
        if kind == "string":
            text = self.string()
            if self.kind == "lang":
                return A.Term(literal(text, self.next()[1:]))
            return A.Term(literal(text, None, self.iri())) if self.take("^^") else A.Term(literal(text))
        sign = ""
        if kind == "mark" and t in "+-" and self.toks[self.i + 1][0] == "number":
            sign, self.i = t, self.i + 1
            kind, t, _ = self.toks[self.i]
        if kind == "number":
            self.i += 1
            return A.Term(literal(sign + t, None, XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer")))
        if self.peek("TRUE", "FALSE"):
            return A.Term(literal(self.next().lower(), None, XSD + "boolean"))
        return None

    def node(self, triples: list[A.Triple]) -> A.Node:
        """A term or variable of a pattern; blank nodes become variables, collections and lists add triples."""
        kind, t, at = self.toks[self.i]
        if kind == "var":
            self.i += 1
            return A.Var(t[1:])
        if kind == "blank":
            self.i += 1
            return A.Var(" _" + t[2:])
        if self.take("["):
            v = self.new_var()
            if not self.take("]"):
                self.properties(v, triples)
                self.need("]")
            return v
        if self.take("("):
            return self.collection(triples)
        if self.take("<<"):
            s, p = self.node(triples), self.verb(triples)
            o = self.node(triples)
            self.need(">>")
            v = self.new_var()
            self.reify(v, A.Triple(s, p, o), triples)
            return v
        if (x := self.literal()) is not None:
            return x
        return A.Term(f"<{self.iri()}>")

    @staticmethod
    def reify(v: A.Node, t: A.Triple, triples: list[A.Triple]) -> None:
        """Triples that say that v stands for a triple."""
        for q, n in (("type", A.Term(f"<{RDF}Statement>")), ("subject", t.s), ("predicate", A.Term(f"<{t.p.iri}>") if isinstance(t.p, A.Link) else t.p), ("object", t.o)):
            triples.append(A.Triple(v, A.Link(RDF + q), n))

    def annotations(self, t: A.Triple, triples: list[A.Triple]) -> None:
        """~ names what stands for the triple before, {| |} says something about it."""
        while self.peek("~", "{|"):
            v = self.node(triples) if self.take("~") and self._starts_node() else self.new_var()
            self.reify(v, t, triples)
            if self.take("{|"):
                self.properties(v, triples)
                self.need("|}")

    def collection(self, triples: list[A.Triple]) -> A.Node:
        items = []
        while not self.take(")"):
            items.append(self.node(triples))
        head: A.Node = A.Term(f"<{RDF}nil>")
        for x in reversed(items):
            v = self.new_var()
            triples += [A.Triple(v, A.Link(RDF + "first"), x), A.Triple(v, A.Link(RDF + "rest"), head)]
            head = v
        return head

    # triples and paths

    def verb(self, triples: list[A.Triple]):
        if self.kind == "var":
            return A.Var(self.next()[1:])
        return self.path()

    def properties(self, s: A.Node, triples: list[A.Triple]) -> None:
        while True:
            p = self.verb(triples)
            while True:
                triples.append(A.Triple(s, p, self.node(triples)))
                self.annotations(triples[-1], triples)
                if not self.take(","):
                    break
            more = False
            while self.take(";"):
                more = True
            if not more or self.peek(".", "]", "}", ")", "|}") or self.kind == "end" or not self._starts_verb():
                break

    def _starts_verb(self) -> bool:
        return self.kind in ("var", "iri", "name") or self.peek("A", "^", "!", "(")

    def triples_block(self, triples: list[A.Triple]) -> None:
        while True:
            before = len(triples)
            bracket = self.peek("[", "(", "<<")
            s = self.node(triples)
            if not (bracket and len(triples) > before and not self._starts_verb()):
                self.properties(s, triples)
            if not self.take(".") or not self._starts_node():
                break

    def _starts_node(self) -> bool:
        return self.kind in ("var", "iri", "name", "blank", "string", "number") or self.peek("[", "(", "<<", "TRUE", "FALSE", "+", "-")

    def path(self):
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.Alternative(tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.take("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else A.Sequence(tuple(parts))

    def path_step(self):
        if self.take("^"):
            return A.Inverse(self.path_repeat())
        return self.path_repeat()

    def path_repeat(self):
        p = self.path_primary()
        if self.take("*"):
            return A.Repeat(p, 0, True)
        if self.take("+"):
            return A.Repeat(p, 1, True)
        return A.Repeat(p, 0, False) if self.take("?") else p

    def path_primary(self):
        if self.take("("):
            p = self.path()
            self.need(")")
            return p
        if self.take("!"):
            forward, inverse = [], []
            several = self.take("(")
            while not (several and self.take(")")):
                (inverse if self.take("^") else forward).append(self.predicate())
                if not several:
                    break
                if not self.take("|"):
                    self.need(")")
                    break
            return A.Negated(tuple(forward), tuple(inverse))
        return A.Link(self.predicate())

    def predicate(self) -> str:
        if self.kind == "word" and self.toks[self.i][1] == "a":
            self.i += 1
            return RDF + "type"
        return self.iri()

    # patterns

    def group(self) -> A.Group:
        self.need("{")
        if self.peek("SELECT"):
            g = A.Group([A.SubSelect(self.select())])
            self.need("}")
            return g
        g = A.Group()
        while not self.take("}"):
            if self.take("."):
                continue
            if self._starts_node():
                triples: list[A.Triple] = []
                self.triples_block(triples)
                if g.elements and isinstance(g.elements[-1], A.Bgp):
                    g.elements[-1].triples += triples
                else:
                    g.elements.append(A.Bgp(triples))
            elif self.take("FILTER"):
                g.filters.append(self.constraint())
            elif self.take("OPTIONAL"):
                g.elements.append(A.Optional_(self.group()))
            elif self.take("MINUS"):
                g.elements.append(A.Minus(self.group()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                name = self.variable()
                self.need(")")
                if name in A.variables(A.Group(g.elements)):
                    raise SparqlSyntaxError(f"BIND of ?{name}, which is already bound in the group")
                g.elements.append(A.Bind(e, name))
            elif self.take("VALUES"):
                g.elements.append(self.values())
            elif self.take("GRAPH"):
                name = A.Var(self.next()[1:]) if self.kind == "var" else A.Term(f"<{self.iri()}>")
                g.elements.append(A.Graph(name, self.group()))
            elif self.take("SERVICE"):
                silent = self.take("SILENT")
                name = A.Var(self.next()[1:]) if self.kind == "var" else A.Term(f"<{self.iri()}>")
                start = self.toks[self.i][2]
                body = self.group()
                g.elements.append(A.Service(name, body, silent, self.text[start : self.toks[self.i - 1][2] + 1], "".join(f"PREFIX {k}: <{v}> " for k, v in self.prefixes.items())))
            elif self.peek("{"):
                groups = [self.group()]
                while self.take("UNION"):
                    groups.append(self.group())
                if len(groups) > 1:
                    g.elements.append(A.Union_(groups))
                elif len(groups[0].elements) == 1 and isinstance(groups[0].elements[0], A.SubSelect) and not groups[0].filters:
                    g.elements.append(groups[0].elements[0])
                else:
                    g.elements.append(groups[0])
            else:
                raise SparqlSyntaxError(f"unexpected {self.toks[self.i][1]!r} at {self.toks[self.i][2]}")
        return g

    def variable(self) -> str:
        if self.kind != "var":
            raise SparqlSyntaxError(f"expected a variable but found {self.toks[self.i][1]!r}")
        return self.next()[1:]

    def values(self) -> A.Values:
        if self.take("("):
            names = []
            while not self.take(")"):
                names.append(self.variable())
            several = True
        else:
            names, several = [self.variable()], False
        rows = []
        self.need("{")
        while not self.take("}"):
            row = []
            if several:
                self.need("(")
            while len(row) < len(names):
                row.append(None if self.take("UNDEF") else self.node([]).text)
            if several:
                self.need(")")
            rows.append(row)
        return A.Values(names, rows)

    # expressions

    def constraint(self):
        if self.peek("("):
            self.need("(")
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        e = self.conjunction()
        while self.take("||", "OR"):
            e = A.Call("||", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.relation()
        while self.take("&&", "AND"):
            e = A.Call("&&", (e, self.relation()))
        return e

    def relation(self):
        e = self.sum()
        if self.peek("=", "!=", "<", ">", "<=", ">="):
            return A.Call(self.next(), (e, self.sum()))
        negated = self.peek("NOT") and self.toks[self.i + 1][1].upper() == "IN"
        if negated:
            self.i += 1
        if self.take("IN"):
            items = self.arguments()
            return A.Call("NOT IN" if negated else "IN", (e, *items))
        return e

    def sum(self):
        e = self.product()
        while self.peek("+", "-"):
            e = A.Call(self.next(), (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while self.peek("*", "/"):
            e = A.Call(self.next(), (e, self.unary()))
        return e

    def unary(self):
        if self.take("!"):
            return A.Call("!", (self.unary(),))
        if self.peek("NOT") and self.toks[self.i + 1][1].upper() != "EXISTS":
            self.i += 1
            return A.Call("!", (self.unary(),))
        if self.peek("-", "+") and self.toks[self.i + 1][0] != "number":
            return A.Call("unary" + self.next(), (self.unary(),))
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(","):
                self.need(")")
                break
        return out

    def primary(self):
        kind, t, at = self.toks[self.i]
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if kind == "var":
            self.i += 1
            return A.Var(t[1:])
        if self.peek("EXISTS"):
            self.i += 1
            return A.Exists(self.group(), False)
        if self.peek("NOT"):
            self.i += 1
            self.need("EXISTS")
            return A.Exists(self.group(), True)
        if kind == "word" and t.upper() in AGGREGATES:
            return self.aggregate()
        if (x := self.literal()) is not None:
            return x
        if kind == "word":
            self.i += 1
            return A.Call(t.upper(), tuple(self.arguments()))
        if kind == "name" and t.split(":", 1)[0] not in self.prefixes and t.lower() == "text:match":
            self.i += 1
            return A.Call("TEXT:MATCH", tuple(self.arguments()))
        iri = self.iri()
        if self.peek("("):
            return A.Call("TEXT:MATCH" if iri.endswith(("text#match", "text/match")) else iri, tuple(self.arguments()))
        return A.Term(f"<{iri}>")

    def aggregate(self):
        name = self.next().upper()
        self.need("(")
        distinct = self.take("DISTINCT")
        arg = None if self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.string()
        self.need(")")
        return A.Aggregate(name, arg, distinct, separator)

    # queries

    def prologue(self) -> None:
        while self.peek("PREFIX", "BASE"):
            if self.next().upper() == "BASE":
                self.base = self.iri()
            else:
                name = self.next()
                self.prefixes[name[:-1]] = self.iri()

    def query(self) -> A.Query:
        explain = None
        if self.take("EXPLAIN"):
            explain = "ANALYZE" if self.take("ANALYZE") else "PLAN"
        self.prologue()
        if self.peek("SELECT"):
            q = self.select(True)
        elif self.take("ASK"):
            q = A.Query("ASK", A.Group())
            self.dataset(q)
            self.take("WHERE")
            q.where = self.group()
            self.modifiers(q)
        elif self.take("CONSTRUCT"):
            q = A.Query("CONSTRUCT", A.Group())
            if self.peek("{"):
                q.template = self.template()
                self.dataset(q)
                self.take("WHERE")
                q.where = self.group()
            else:
                self.dataset(q)
                self.need("WHERE")
                q.where = self.group()
                q.template = [t for e in q.where.elements if isinstance(e, A.Bgp) for t in e.triples]
            self.modifiers(q)
        elif self.take("DESCRIBE"):
            q = A.Query("DESCRIBE", A.Group())
            if not self.take("*"):
                while self.kind in ("var", "iri", "name"):
                    q.describe.append(A.Var(self.next()[1:]) if self.kind == "var" else A.Term(f"<{self.iri()}>"))
            self.dataset(q)
            if self.take("WHERE") or self.peek("{"):
                q.where = self.group()
            self.modifiers(q)
        else:
            raise SparqlSyntaxError(f"no query form at {self.toks[self.i][1]!r}")
        q.explain = explain
        if self.kind != "end":
            raise SparqlSyntaxError(f"unexpected {self.toks[self.i][1]!r} after the query")
        return q

    def template(self) -> list[A.Triple]:
        self.need("{")
        triples: list[A.Triple] = []
        while not self.take("}"):
            if not self.take("."):
                self.triples_block(triples)
        return triples

    def dataset(self, q: A.Query) -> None:
        while self.take("FROM"):
            (q.from_named if self.take("NAMED") else q.from_graphs).append(self.iri())

    def select(self, top: bool = False) -> A.Query:
        self.need("SELECT")
        q = A.Query("SELECT", A.Group())
        q.distinct, q.reduced = self.take("DISTINCT"), self.take("REDUCED")
        if not self.take("*"):
            while self.kind == "var" or self.peek("("):
                if self.take("("):
                    e = self.expression()
                    self.need("AS")
                    q.projection.append((self.variable(), e))
                    self.need(")")
                else:
                    q.projection.append((self.variable(), None))
            if not q.projection:
                raise SparqlSyntaxError("nothing is selected")
        if len({n for n, _ in q.projection}) < len(q.projection):
            raise SparqlSyntaxError("a variable is projected twice")
        if top:
            self.dataset(q)
        self.take("WHERE")
        q.where = self.group()
        self.modifiers(q)
        grouped = q.group_by or any(has_aggregate(e) for _, e in q.projection if e is not None)
        if grouped:
            keys = {n or (e.name if isinstance(e, A.Var) else None) for e, n in q.group_by}
            for name, e in q.projection:
                if e is None and name not in keys:
                    raise SparqlSyntaxError(f"?{name} is neither a group key nor aggregated")
        return q

    def modifiers(self, q: A.Query) -> None:
        if self.take("GROUP"):
            self.need("BY")
            while self.kind == "var" or self.peek("(") or self.kind in ("word", "iri", "name") and not self.peek("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES", "AS", "DURING", "ALL"):
                if self.kind == "var":
                    q.group_by.append((A.Var(self.next()[1:]), None))
                elif self.take("("):
                    e = self.expression()
                    q.group_by.append((e, self.variable() if self.take("AS") else None))
                    self.need(")")
                else:
                    q.group_by.append((self.primary(), None))
        if self.take("HAVING"):
            while self.peek("(") or self.kind in ("word", "iri", "name") and not self.peek("ORDER", "LIMIT", "OFFSET", "VALUES", "AS", "DURING", "ALL"):
                q.having.append(self.constraint())
        if self.take("ORDER"):
            self.need("BY")
            while self.kind == "var" or self.peek("ASC", "DESC", "(") or self.kind in ("word", "iri", "name") and not self.peek("LIMIT", "OFFSET", "VALUES", "AS", "DURING", "ALL"):
                descending = self.peek("DESC")
                self.take("ASC", "DESC")
                q.order_by.append((self.constraint(), descending))
        while self.peek("LIMIT", "OFFSET"):
            word = self.next().upper()
            n = int(self.next())
            if word == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.take("AS"):
            self.need("OF")
            q.temporal = A.Temporal("as_of", self.time())
        elif self.take("DURING"):
            self.need("[")
            a = self.time()
            self.need(",")
            q.temporal = A.Temporal("during", a, self.time())
            self.need("]")
        elif self.peek("ALL"):
            self.next()
            self.need("VERSIONS")
            q.temporal = A.Temporal("all")
        if self.take("VALUES"):
            q.where = A.Group([q.where, self.values()])

    def time(self) -> str:
        from ..functions.terms import parse_term

        return parse_term(self.literal().text)[1]

    # updates

    def updates(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out.append(self.update())
            if not self.take(";"):
                if self.kind != "end":
                    raise SparqlSyntaxError(f"unexpected {self.toks[self.i][1]!r} after an update")
                return out

    def quads(self) -> list[tuple[A.Node | None, A.Triple]]:
        out: list = []
        self.need("{")
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("GRAPH"):
                g = A.Var(self.next()[1:]) if self.kind == "var" else A.Term(f"<{self.iri()}>")
                out += [(g, t) for t in self.template()]
            else:
                triples: list[A.Triple] = []
                self.triples_block(triples)
                out += [(None, t) for t in triples]
        return out

    def graph_ref(self) -> str:
        """DEFAULT, NAMED, ALL or a graph's IRI."""
        if self.peek("DEFAULT", "NAMED", "ALL"):
            return self.next().upper()
        self.take("GRAPH")
        return self.iri()

    def update(self) -> A.Update:
        if self.peek("WITH"):
            self.next()
            u = A.Update("MODIFY", with_graph=self.iri())
            return self.modify(u)
        if self.peek("INSERT", "DELETE"):
            if self.toks[self.i + 1][1].upper() == "DATA":
                kind = self.next().upper()
                self.next()
                quads = self.quads()
                return A.Update(f"{kind} DATA", **{"inserts" if kind == "INSERT" else "deletes": quads})
            if self.peek("DELETE") and self.toks[self.i + 1][1].upper() == "WHERE":
                self.i += 2
                deletes = self.quads()
                where = A.Group()
                for g, t in deletes:
                    where.elements.append(A.Bgp([t]) if g is None else A.Graph(g, A.Group([A.Bgp([t])])))
                return A.Update("MODIFY", deletes=deletes, where=where)
            return self.modify(A.Update("MODIFY"))
        kind = self.need("CLEAR", "DROP", "CREATE", "COPY", "MOVE", "ADD", "LOAD").upper()
        u = A.Update(kind, silent=self.take("SILENT"))
        if kind == "LOAD":
            u.source = self.iri()
            if self.take("INTO"):
                self.need("GRAPH")
                u.target = self.iri()
        elif kind in ("COPY", "MOVE", "ADD"):
            u.source = self.graph_ref()
            self.need("TO")
            u.target = self.graph_ref()
        else:
            u.target = self.graph_ref()
        return u

    def modify(self, u: A.Update) -> A.Update:
        if self.take("DELETE"):
            u.deletes = self.quads()
        if self.take("INSERT"):
            u.inserts = self.quads()
        while self.take("USING"):
            (u.using_named if self.take("NAMED") else u.using).append(self.iri())
        self.need("WHERE")
        u.where = self.group()
        return u


def has_aggregate(e: object) -> bool:
    return isinstance(e, A.Aggregate) or isinstance(e, A.Call) and any(map(has_aggregate, e.args))


def parse_query(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> A.Query:
    p = Parser(text, base)
    p.prefixes |= prefixes or {}
    return p.query()


def parse_update(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> list[A.Update]:
    p = Parser(text, base)
    p.prefixes |= prefixes or {}
    return p.updates()
