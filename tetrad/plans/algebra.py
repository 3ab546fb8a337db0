"""The algebra that SPARQL texts are parsed to and DataFrames are compiled from."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    """A constant in N-Triples form."""

    text: str


Node = Var | Term


# Property paths


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """least 0 or 1; many: any number of times, else at most once."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class Negated:
    """Predicates that forward and inverse steps must not have."""

    forward: tuple
    inverse: tuple


# Patterns


@dataclass
class Triple:
    s: Node
    p: object  # Node or path
    o: Node


@dataclass
class Bgp:
    triples: list[Triple]


@dataclass
class Filter:
    condition: object


@dataclass
class Bind:
    expression: object
    var: str


@dataclass
class Optional_:
    group: Group


@dataclass
class Minus:
    group: Group


@dataclass
class Union_:
    groups: list[Group]


@dataclass
class Graph:
    name: Node
    group: Group


@dataclass
class Service:
    endpoint: Node
    group: Group
    silent: bool
    text: str
    prologue: str = ""


@dataclass
class Values:
    names: list[str]
    rows: list[list[str | None]]


@dataclass
class SubSelect:
    query: Query


@dataclass
class Group:
    """Elements in textual order; filters hold for the whole group."""

    elements: list = field(default_factory=list)
    filters: list = field(default_factory=list)


# Expressions


@dataclass(frozen=True)
class Call:
    """A function, operator or cast by upper-case name, or by IRI for casts."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    group: object
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object  # None: *
    distinct: bool = False
    separator: str = " "


@dataclass
class Temporal:
    """mode: current, as_of, during or all; times as ISO texts."""

    mode: str = "current"
    start: str | None = None
    end: str | None = None


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    where: Group
    projection: list = field(default_factory=list)  # (name, expression or None); empty: *
    distinct: bool = False
    reduced: bool = False
    group_by: list = field(default_factory=list)  # (expression, name or None)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    template: list[Triple] = field(default_factory=list)
    describe: list[Node] = field(default_factory=list)
    from_graphs: list[str] = field(default_factory=list)
    from_named: list[str] = field(default_factory=list)
    temporal: Temporal = field(default_factory=Temporal)
    explain: str | None = None


@dataclass
class Update:
    kind: str  # INSERT DATA, DELETE DATA, DELETE WHERE, MODIFY, CLEAR, DROP, CREATE, COPY, MOVE, ADD, LOAD
    inserts: list = field(default_factory=list)  # (graph node or None, Triple)
    deletes: list = field(default_factory=list)
    where: Group | None = None
    with_graph: str | None = None
    using: list[str] = field(default_factory=list)
    using_named: list[str] = field(default_factory=list)
    source: str | None = None
    target: str | None = None
    silent: bool = False


def variables(x: object) -> set[str]:
    """Variables that a pattern can bind."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Triple):
        return {n.name for n in (x.s, x.p, x.o) if isinstance(n, Var)}
    if isinstance(x, Bgp):
        return set().union(*map(variables, x.triples)) if x.triples else set()
    if isinstance(x, Group):
        return set().union(*(variables(e) for e in x.elements if not isinstance(e, Minus))) if x.elements else set()
    if isinstance(x, Bind):
        return {x.var}
    if isinstance(x, Optional_):
        return variables(x.group)
    if isinstance(x, Union_):
        return set().union(*map(variables, x.groups))
    if isinstance(x, (Graph, Service)):
        return variables(x.group) | (variables(x.name) if isinstance(x, Graph) else set())
    if isinstance(x, Values):
        return set(x.names)
    if isinstance(x, SubSelect):
        q = x.query
        return {n for n, _ in q.projection} or variables(q.where)
    return set()


def mentioned(e: object) -> set[str]:
    """Variables that an expression mentions."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*map(mentioned, e.args)) if e.args else set()
    if isinstance(e, Aggregate):
        return mentioned(e.arg)
    if isinstance(e, Exists):
        return variables(e.group) | set().union(*(mentioned(f) for f in e.group.filters))
    return set()
