"""What the plans must and must not hold, and joins on variables that may be unbound against plain loops."""

import itertools

import pytest
from pyspark.sql import functions as F

from tetrad.operators import quads as Q
from tetrad.operators.engine import Store, TableEngine, explain_json
from tetrad.plans import paths
from tetrad.plans.catalog import QUERIES
from tetrad.plans.compiler import Part, ordered
from tetrad.plans.parser import parse_query
from tetrad.plans.solutions import Solutions, join, left_join, minus, semi_join
from tetrad.sources.tables import TableSource


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROWS_A = [(a, b, c) for a, b, c in itertools.product((None, "1", "2"), (None, "1", "3"), ("x", "y"))]
ROWS_B = [(a, b, d) for a, b, d in itertools.product((None, "1"), (None, "3", "1"), ("u", "v"))]


def compatible(x, y):
    return all(x.get(k) is None or y.get(k) is None or x[k] == y[k] for k in set(x) & set(y))


def merge(x, y):
    return {k: x.get(k) if x.get(k) is not None else y.get(k) for k in {*x, *y}}


def as_set(rows, names):
    return sorted(str([r.get(n) for n in names]) for r in rows)


@pytest.mark.parametrize("shared", [("a",), ("a", "b")])
def test_joins_of_open_variables(spark, shared):
    """Every combination of bound and unbound, by SPARQL's definitions."""
    a = [dict(zip("abc", r)) for r in ROWS_A]
    b = [{k: v for k, v in zip("abd", r) if k in (*shared, "d")} for r in ROWS_B]

    def solutions(rows, names, maybe):
        return Solutions(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`?{n}` string" for n in names)), {n: ("term", None) for n in names}, set(maybe))

    x, y = solutions(a, "abc", "ab"), solutions(b, (*shared, "d"), shared)

    def got(s, names):
        return as_set([{n: r[f"?{n}"] for n in names} for r in s.df.select(*[F.col(f"`?{n}`") for n in names]).collect()], names)

    assert got(join(x, y), "abcd") == as_set([merge(p, q) for p in a for q in b if compatible(p, q)], "abcd")
    for on, test in ((lambda values: [], lambda m: True), (lambda values: [(values["c"].column == "x") & (values["a"].column == "1")], lambda m: m["c"] == "x" and m["a"] == "1")):
        hits = lambda p: [merge(p, q) for q in b if compatible(p, q) and test(merge(p, q))]  # noqa: E731, B023
        assert got(left_join(x, y, on), "abcd") == as_set([m for p in a for m in hits(p) or [p]], "abcd")
        assert got(semi_join(x, y, False, on), "abc") == as_set([p for p in a if hits(p)], "abc")
        assert got(semi_join(x, y, True, on), "abc") == as_set([p for p in a if not hits(p)], "abc")
    gone = lambda p: any(compatible(p, q) and any(p.get(k) is not None and q.get(k) is not None for k in shared) for q in b)
    assert got(minus(x, y), "abc") == as_set([p for p in a if not gone(p)], "abc")


@pytest.mark.parametrize("name", ["minus_after_optional", "exists_in_expression", "exists_twice_in_expression", "optional_filter", "minus_rows", "star_join_lineitem", "path_closure_from_bound"])
def test_no_nested_loops(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "NestedLoop" not in text and "CartesianProduct" not in text and "monotonically" not in text


@pytest.mark.parametrize("name", ["exists_after_optional", "not_exists_after_optional"])
def test_only_open_solutions_meet_without_a_key_and_one_row_decides(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert text.count("NestedLoop") <= 1 and "CartesianProduct" not in text and "LocalLimit 1" in text or "GlobalLimit 1" in text or "CollectLimit 1" in text


def test_keys_reach_the_files(spark, sf):
    for name, column in (("scan_key", "o_orderkey"), ("scan_foreign_key", "o_custkey")):
        assert f"EqualTo({column},7)" in plan(QUERIES[name](spark, sf)), name
    engine = TableEngine(spark, TableSource(spark, sf))
    for no_key in ("07", "x", "7.0", "99999999999999999999999", ""):
        assert engine.query(f"SELECT ?p WHERE {{ <urn:t:orders/{no_key}> :o_totalprice ?p }}").count() == 0


def chains(spark, n=6, length=8):
    rows = [(f"<c:{k}/{i}>", "<p:next>", f"<c:{k}/{i + 1}>") for k in range(n) for i in range(length)] + [(f"<c:{k}/0>", "<p:name>", f'"n{k}"') for k in range(n)]
    return Store(spark, Q.from_triples(spark.createDataFrame(rows, "s string, p string, o string")))


def test_closures_start_from_what_is_bound(spark, monkeypatch):
    store, seen = chains(spark), []
    plain = paths.Known.add
    monkeypatch.setattr(paths.Known, "add", lambda self, delta: (seen.append(delta.select("s").distinct().count()), plain(self, delta))[1])
    got = store.query('SELECT ?y WHERE { ?x <p:name> "n2" ; <p:next>+ ?y }').collect()
    assert sorted(r.y for r in got) == [f"<c:2/{i}>" for i in range(1, 9)] and seen and set(seen) == {1}
    back = store.query('SELECT ?x WHERE { ?y <p:name> "n3" . ?x <p:next>* ?y }').collect()
    assert [r.x for r in back] == ["<c:3/0>"]
    assert store.query("SELECT ?x ?y WHERE { ?x <p:next>+ ?y }").count() == 6 * 36


def test_long_closures_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(paths, "COMPACT", 3)
    assert chains(spark, 2, 12).query("SELECT ?x ?y WHERE { ?x <p:next>+ ?y }").count() == 2 * 78


def test_counts_order_patterns(spark):
    store = chains(spark)
    assert store.analyze() == {"p:next": 48, "p:name": 6}
    text = store.explain("SELECT * WHERE { ?x <p:next> ?y ; <p:name> ?n }")
    assert text.index("p:name>", text.index("Physical Plan") if "Physical Plan" in text else 0) > 0
    assert store.query("SELECT * WHERE { ?x <p:next> ?y ; <p:name> ?n }").count() == 6


def test_suppliers_and_customers_do_not_meet_by_nation_alone(spark, tmp_path):
    """Many of either in few nations: their pairs grow with the square, so orders and lineitem come between."""
    n = 20_000
    tables = {
        "region": "SELECT CAST(id AS int) AS r_regionkey, if(id = 0, 'ASIA', 'EUROPE') AS r_name FROM range(2)",
        "nation": "SELECT CAST(id AS int) AS n_nationkey, concat('N', id) AS n_name, CAST(id % 2 AS int) AS n_regionkey FROM range(4)",
        "customer": f"SELECT id AS c_custkey, concat('C', id) AS c_name, CAST(id % 4 AS int) AS c_nationkey, 1.0D AS c_acctbal FROM range({n})",
        "supplier": f"SELECT id AS s_suppkey, concat('S', id) AS s_name, CAST(id % 4 AS int) AS s_nationkey, 1.0D AS s_acctbal FROM range({n})",
        "orders": f"SELECT id AS o_orderkey, (id * 7) % {n} AS o_custkey, 1.0D AS o_totalprice FROM range({2 * n})",
        "lineitem": f"SELECT id % {2 * n} AS l_orderkey, (id * 3) % {n} AS l_suppkey, CAST(id % 100 AS double) AS l_extendedprice, 0.5D AS l_discount FROM range({3 * n})",
    }
    for name, sql in tables.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["six_way_join"](spark, str(tmp_path))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    at = {t: text.index(f"Relation [{t}") for t in ("c_custkey", "s_suppkey", "l_orderkey")}
    assert at["l_orderkey"] < max(at["c_custkey"], at["s_suppkey"]) and "Cross" not in text
    want = dict.fromkeys(("N0", "N2"), 0.0)
    for i in range(3 * n):
        nation = ((i % (2 * n)) * 7) % n % 4
        if nation % 2 == 0 and nation == (i * 3) % n % 4:
            want[f"N{nation}"] += (i % 100) * 0.5
    assert {r.nation: r.revenue for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_orders_of_patterns():
    """Keys keep a join's size, few values square it; what costs the same comes by weight; nothing is left out where nothing is shared."""
    made = lambda weight, **distinct: Part(weight, weight, distinct, None)
    nation, supplier, customer, line = made(5, n=5), made(1e4, s=1e4, n=5), made(1e5, c=1e5, n=5), made(1e6, s=1e4, c=1e5)
    order = ordered([customer, line, supplier, nation])
    assert order.index(line) < max(order.index(customer), order.index(supplier)) and len(order) == 4
    small, large, other = made(3, x=3), made(9, x=9), made(5, y=5)
    assert ordered([other, large, small]) == [small, large, other]
    assert ordered([]) == [] and len(ordered([made(i + 1, x=i + 1) for i in range(30)])) == 30


def test_explained(spark):
    store = chains(spark)
    text = store.query("EXPLAIN ANALYZE SELECT ?x WHERE { ?x <p:next> ?y }").first()[0]
    assert "rows: 48" in text and "seconds: " in text and "rows:" not in store.query("EXPLAIN SELECT ?x WHERE { ?x <p:next> ?y }").first()[0]
    told = explain_json(parse_query("SELECT ?x WHERE { ?x <p:next> ?y OPTIONAL { ?y <p:name> ?n } FILTER(?x != ?y) }"))
    assert '"operator": "Optional"' in told and '"operator": "Query"' in told


def test_a_store_of_deltas_is_the_store_that_is_put_together(spark, tmp_path):
    store, other = chains(spark), chains(spark)
    store.MOST_DELTAS = 4
    updates = [f'INSERT DATA {{ <u:{i}> <p:name> "v{i}" . <u:{i % 3}> <p:of> <c:{i}/0> }} ; DELETE WHERE {{ <c:{i}/{i}> <p:next> ?o }} ; DELETE DATA {{ <u:{i - 1}> <p:name> "v{i - 1}" }}' for i in range(3)]
    for i, u in enumerate(updates):
        store.update(u, f"2024-01-0{i + 1} 00:00:00")
        other.update(u, f"2024-01-0{i + 1} 00:00:00")
        other.compact()
        store.save(str(tmp_path))
        assert len(store.deltas) <= store.MOST_DELTAS and not other.deltas
    key = lambda s: sorted(map(str, s.table.select("g", "s", "p", "o", *[F.col(c).cast("string") for c in ("valid_from", "valid_to")], "is_deleted", "version").collect()))
    assert key(store) == key(other) == key(Store.open(spark, str(tmp_path)))
    with pytest.raises(FileNotFoundError):
        Store.open(spark, str(tmp_path / "none"))


def test_batches(spark):
    store = chains(spark)
    store.begin()
    store.update("CLEAR ALL")
    store.begin()
    store.update('INSERT DATA { <u:x> <p:name> "x" }')
    store.commit()
    assert store.query("SELECT * WHERE { ?s ?p ?o }").count() == 1
    store.rollback()
    assert store.query("SELECT * WHERE { ?s ?p ?o }").count() == 54
    with pytest.raises(RuntimeError):
        store.rollback()


def test_services_of_no_endpoint(spark):
    store = chains(spark)
    store.services["e:1"] = lambda text, names: []
    assert store.query("SELECT * WHERE { ?e <p:none> ?x SERVICE ?e { ?s <p:q> ?o } }").count() == 0
    assert store.query("SELECT * WHERE { SERVICE <e:1> { ?s <p:q> ?o } }").count() == 0
    many = Store(spark, Q.from_triples(spark.range(1200).selectExpr("concat('<e:', id, '>') AS s", "'<p:at>' AS p", "concat('<v:', id, '>') AS o")))
    many.services = {f"e:{i}": (lambda text, names, i=i: [{"z": f'"{i}"'}]) for i in range(1200)}
    assert many.query("SELECT ?e ?z WHERE { ?e <p:at> ?v SERVICE ?e { ?y <p:q> ?z } }").count() == 1200
