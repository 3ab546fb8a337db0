"""Queries over quad stores made of the driver's tables: updates, reasoning, readers and writers, results, access, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, patch, prune, quads, reason
from ..operators.engine import Store, TableEngine
from ..sources import rdf, writers
from ..sources.tables import TableSource
from ..streaming import ingest
from . import catalog
from .catalog import by_source, event_quads, query
from .paths import checkpointed

_LANG = "'<urn:d/' || doc_id || '>' AS s, '<urn:lang>' AS p, '\"' || lang || '\"' AS o"
_GRAPH = f"SELECT '<urn:g/' || source || '>' AS g, {_LANG} FROM documents"


def scratch(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which driver and executors share."""
    checkpointed(spark.range(1))  # sets the folder where it is not set
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4()}"


def iri(name: str, key: str) -> Column:
    return F.concat(F.lit(f"<urn:{name}/"), F.col(key), F.lit(">"))


def text(key: str) -> Column:
    return F.concat(F.lit('"'), F.col(key), F.lit('"'))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> Store:
    """Names and regions of the nations."""
    n = table(spark, sf_dir, "nation")
    cells = F.array(F.struct(F.lit("<urn:name>").alias("p"), text("n_name").alias("o")), F.struct(F.lit("<urn:region>").alias("p"), iri("r", "n_regionkey").alias("o")))
    return Store(spark, quads.from_triples(n.select(iri("n", "n_nationkey").alias("s"), F.explode(cells).alias("c")).select("s", "c.*")))


def facts(store: Store) -> DataFrame:
    return store.query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }")


_NATIONS = """SELECT '<urn:n/' || n_nationkey || '>' AS s, '<urn:name>' AS p, '"' || n_name || '"' AS o, n_regionkey AS r FROM nation UNION ALL SELECT '<urn:n/' || n_nationkey || '>', '<urn:region>', '<urn:r/' || n_regionkey || '>', n_regionkey FROM nation"""


# patterns ---------------------------------------------------------------------------------------------------------------------


@query("SELECT '<urn:k/' || o_orderkey || '>' AS x FROM orders WHERE o_orderkey = o_custkey")
def repeated_variable_in_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return Store(spark, quads.from_triples(o.select(iri("k", "o_orderkey").alias("s"), F.lit("<urn:of>").alias("p"), iri("k", "o_custkey").alias("o")))).query("SELECT ?x WHERE { ?x <urn:of> ?x }")


@query("SELECT n_name AS name, 'R' || n_regionkey AS label FROM nation")
def service_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered endpoint, joined along a shared variable."""
    engine = TableEngine(spark, TableSource(spark, sf_dir))
    engine.services["urn:labels"] = lambda asked, names: [{"r": f"<urn:t:region/{i}>", "l": f'"R{i}"'} for i in range(10)]
    return engine.query("SELECT (?n AS ?name) (STR(?l) AS ?label) WHERE { ?x :n_name ?n ; :n_regionkey ?r SERVICE <urn:labels> { ?r <urn:label> ?l } }")


@query("SELECT '<urn:g/' || source || '>' AS g, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1")
def graph_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USING NAMED: what is found in the graphs goes to the default graph."""
    store = Store(spark, by_source(spark, sf_dir))
    names = " ".join(f"USING NAMED <{r[0][1:-1]}>" for r in store.graphs().collect())
    store.update(f'INSERT {{ ?d <urn:in> ?g }} {names} WHERE {{ GRAPH ?g {{ ?d <urn:lang> "fr" }} }}')
    return store.query("SELECT ?g (COUNT(*) AS ?n) WHERE { ?d <urn:in> ?g } GROUP BY ?g", terms=False)


@query("SELECT '<urn:u/' || user_id || '>' AS s, '<urn:event/' || event_id || '>' AS o, ts AS valid_from FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def temporal_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was ever held about one subject."""
    user = table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return quads.evolution(event_quads(spark, sf_dir), s=f"<urn:u/{user}>").select("s", "o", "valid_from")


# updates ----------------------------------------------------------------------------------------------------------------------


@query(f"SELECT s, p, o FROM ({_NATIONS}) WHERE r <> 1")
def update_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.update("DELETE WHERE { ?n <urn:region> <urn:r/1> ; <urn:region> ?r ; <urn:name> ?x }")
    return facts(store)


@query(f"""SELECT s, p, o FROM ({_NATIONS}) WHERE s <> '<urn:n/3>' UNION ALL SELECT '<urn:new>', '<urn:name>', '"Newland"'""")
def update_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of INSERT DATA and DELETE DATA; what is not there is not deleted, what is there not inserted again."""
    store = nations(spark, sf_dir)
    store.update("""INSERT DATA { <urn:new> <urn:name> "Newland" . <urn:n/2> <urn:name> "NATION_2" } ;
        DELETE DATA { <urn:n/3> <urn:name> "NATION_3" . <urn:n/4> <urn:name> "no such name" } ; DELETE WHERE { <urn:n/3> ?p ?o }""")
    return facts(store)


@query("""SELECT g, count(*) AS n FROM (SELECT source AS g FROM documents WHERE source <> 'src2' UNION ALL SELECT 'copy' FROM documents WHERE source = 'src1' UNION ALL SELECT 'moved' FROM documents WHERE source = 'src2'
 UNION ALL SELECT 'src4' FROM documents WHERE source = 'src3') GROUP BY 1""")
def update_copy_move_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, by_source(spark, sf_dir))
    store.update("COPY <urn:g/src1> TO <urn:g/copy> ; MOVE <urn:g/src2> TO <urn:g/moved> ; ADD <urn:g/src3> TO <urn:g/src4>")
    return store.query("SELECT (STRAFTER(STR(?x), \"urn:g/\") AS ?g) (COUNT(*) AS ?n) WHERE { GRAPH ?x { ?d ?p ?l } } GROUP BY ?x", terms=False)


@query("SELECT '<urn:g/' || source || '>' AS g, count(*) AS n FROM documents WHERE source NOT IN ('src5', 'src6') GROUP BY 1")
def update_clear_drop_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, by_source(spark, sf_dir))
    store.update("CREATE SILENT GRAPH <urn:g/new> ; CLEAR GRAPH <urn:g/src5> ; DROP GRAPH <urn:g/src6> ; DROP SILENT GRAPH <urn:g/none> ; CLEAR DEFAULT")
    return store.query("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?d ?p ?l } } GROUP BY ?g", terms=False)


@query(f"SELECT {_LANG} FROM documents")
def update_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD of files into a graph."""
    path = scratch(spark) + ".nt"
    writers.write_rdf(by_source(spark, sf_dir).select("s", "p", "o"), path, "ntriples")
    store = Store(spark)
    store.update(f"LOAD <{path}> INTO GRAPH <urn:loaded>")
    return store.query("SELECT ?s ?p ?o WHERE { GRAPH <urn:loaded> { ?s ?p ?o } }")


@query(f"""SELECT s, p, CASE WHEN s = '<urn:n/3>' AND p = '<urn:name>' THEN '"Third"' ELSE o END AS o FROM ({_NATIONS})""")
def patch_n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    patch.apply_patch(store, """@prefix solid: <http://www.w3.org/ns/solid/terms#>. _:p a solid:InsertDeletePatch ;
        solid:where { ?n <urn:name> "NATION_3" . } ; solid:deletes { ?n <urn:name> "NATION_3" . } ; solid:inserts { ?n <urn:name> "Third" . } .""")
    return facts(store)


@query(f"""SELECT s, p, o FROM ({_NATIONS}) WHERE r <> 2 UNION ALL SELECT '<urn:kept>', '<urn:name>', '"kept"'""")
def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is taken back, and one that stays."""
    store = nations(spark, sf_dir)
    store.begin()
    store.update('INSERT DATA { <urn:lost> <urn:name> "lost" } ; CLEAR ALL')
    store.rollback()
    store.begin()
    store.update('INSERT DATA { <urn:kept> <urn:name> "kept" } ; DELETE WHERE { ?n <urn:region> <urn:r/2> ; ?p ?o }')
    store.commit()
    return facts(store)


@query(f"""SELECT s, p, o FROM ({_NATIONS}) WHERE r <> 2 UNION ALL SELECT '<urn:kept>', '<urn:name>', '"kept"'""")
def store_saved_and_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base and two deltas, written one after another and read back."""
    path, store = scratch(spark), nations(spark, sf_dir)
    store.save(path)
    store.update('INSERT DATA { <urn:kept> <urn:name> "kept" }')
    store.save(path)
    store = Store.open(spark, path)
    store.update("DELETE WHERE { ?n <urn:region> <urn:r/2> ; ?p ?o }")
    store.save(path)
    return facts(Store.open(spark, path))


# reasoning ----------------------------------------------------------------------------------------------------------------------

_TYPE = "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'"
_C, _N = "'<urn:c/' || c_custkey || '>'", "'<urn:n/' || c_nationkey || '>'"


def living(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers live in nations."""
    return table(spark, sf_dir, "customer").select(iri("c", "c_custkey").alias("s"), F.lit("<urn:lives>").alias("p"), iri("n", "c_nationkey").alias("o"))


def reasoned(spark: SparkSession, rows: DataFrame, schema: list[tuple], *rules: str) -> DataFrame:
    return reason.materialize(rows.union(spark.createDataFrame(schema, "s string, p string, o string")), rules)


@query(f"""SELECT '<urn:lives>' AS s, '<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>' AS p, '<urn:related>' AS o UNION ALL SELECT {_C}, p, {_N} FROM customer, (SELECT unnest(['<urn:located>', '<urn:related>']) AS p)
 UNION ALL SELECT {_C}, {_TYPE}, '<urn:Person>' FROM customer""")
def reason_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of properties, their facts, and a domain."""
    schema = [("<urn:lives>", reason.SUB_PROPERTY, "<urn:located>"), ("<urn:located>", reason.SUB_PROPERTY, "<urn:related>"), ("<urn:lives>", reason.DOMAIN, "<urn:Person>")]
    return reasoned(spark, living(spark, sf_dir), schema, "sub_property_chain", "property_inheritance", "domain")


@query(f"SELECT {_N} AS s, '<urn:home>' AS p, {_C} AS o FROM customer")
def reason_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoned(spark, living(spark, sf_dir), [("<urn:lives>", reason.INVERSE, "<urn:home>")], "inverse")


@query(f"SELECT {_N} AS s, '<urn:lives>' AS p, {_C} AS o FROM customer")
def reason_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoned(spark, living(spark, sf_dir), [("<urn:lives>", reason.TYPE, reason.SYMMETRIC)], "symmetric")


@query("""SELECT '<urn:c/' || c_custkey || '>' AS s, '<http://www.w3.org/2002/07/owl#sameAs>' AS p, '<urn:s/' || c_custkey || '>' AS o FROM customer JOIN supplier ON s_suppkey = c_custkey
 UNION ALL SELECT '<urn:s/' || c_custkey || '>', '<urn:lives>', '<urn:n/' || c_nationkey || '>' FROM customer JOIN supplier ON s_suppkey = c_custkey""")
def reason_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are the customers of their numbers: sameness goes both ways, and facts go over."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    same = s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "left_semi").select(iri("s", "s_suppkey").alias("s"), F.lit(reason.SAME).alias("p"), iri("c", "s_suppkey").alias("o"))
    return reasoned(spark, living(spark, sf_dir).union(same), [("<urn:x>", "<urn:y>", "<urn:z>")], "same_symmetry", "same_subject", "same_object")


@query(f"""SELECT {_C} AS s, '<urn:dwells>' AS p, {_N} AS o FROM customer UNION ALL SELECT {_C}, {_TYPE}, '<urn:Customer>' FROM customer
 UNION ALL SELECT a, '<http://www.w3.org/2000/01/rdf-schema#subClassOf>', b FROM (VALUES ('<urn:Client>', '<urn:Customer>'), ('<urn:Customer>', '<urn:Client>')) v(a, b)
 UNION ALL SELECT a, '<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>', b FROM (VALUES ('<urn:lives>', '<urn:dwells>'), ('<urn:dwells>', '<urn:lives>')) v(a, b)
 UNION ALL SELECT '<urn:Customer>', '<http://www.w3.org/2002/07/owl#equivalentClass>', '<urn:Client>' UNION ALL SELECT '<urn:dwells>', '<http://www.w3.org/2002/07/owl#equivalentProperty>', '<urn:lives>'""")
def reason_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent classes and properties."""
    types = table(spark, sf_dir, "customer").select(iri("c", "c_custkey").alias("s"), F.lit(reason.TYPE).alias("p"), F.lit("<urn:Client>").alias("o"))
    schema = [("<urn:Client>", reason.EQUAL_CLASS, "<urn:Customer>"), ("<urn:lives>", reason.EQUAL_PROPERTY, "<urn:dwells>")]
    return reasoned(spark, living(spark, sf_dir).union(types), schema, "equivalent_class", "equivalent_property", "type_by_class", "property_inheritance")


# files --------------------------------------------------------------------------------------------------------------------------


def _files(kind: str, ending: str, graphs: bool) -> None:
    """Files of a format, written in parallel and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark)}.{ending}"
        rows = by_source(spark, sf_dir).select("g", "s", "p", "o")
        writers.write_rdf(rows if graphs else rows.drop("g"), path, kind)
        back = rdf.read_rdf(spark, path)
        return back if graphs else back.select("s", "p", "o")

    name = f"{kind}_files"
    run.__name__ = name
    catalog.QUERIES[name], catalog.ORACLE_SQL[name] = run, _GRAPH if graphs else f"SELECT {_LANG} FROM documents"


for _kind, _ending, _graphs in (("ntriples", "nt", False), ("nquads", "nq", True), ("turtle", "ttl", False), ("trig", "trig", True), ("rdfxml", "rdf", False), ("jsonld", "jsonld", True)):
    _files(_kind, _ending, _graphs)


@query(_GRAPH)
def convert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Quads to TriG to JSON-LD."""
    path = scratch(spark)
    writers.write_rdf(by_source(spark, sf_dir), f"{path}.nq", "nquads")
    writers.convert(spark, f"{path}.nq", f"{path}.trig", "trig")
    writers.convert(spark, f"{path}.trig", f"{path}.jsonld", "jsonld")
    return rdf.read_rdf(spark, f"{path}.jsonld")


@query(_GRAPH)
def compressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip files of N-Quads and bzip2 files of N-Triples; the codec is told by the name."""
    path, rows = scratch(spark), by_source(spark, sf_dir)
    writers.lines(rows).write.option("compression", "gzip").text(f"{path}/a.nq")
    writers.lines(rows).write.option("compression", "bzip2").text(f"{path}/b.nq")
    return rdf.read_rdf(spark, f"{path}/a.nq").intersect(rdf.read_rdf(spark, f"{path}/b.nq"))


@query("SELECT '<urn:n/' || n_nationkey || '>' AS s, '<urn:name>' AS p, '\"' || n_name || '\"' AS o FROM nation")
def parse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle text on the driver."""
    rows = table(spark, sf_dir, "nation").select(F.concat(iri("n", "n_nationkey"), F.lit(" :name "), text("n_name"), F.lit(" .")).alias("value"))
    return rdf.parse_text(spark, "PREFIX : <urn:>\n" + "\n".join(r[0] for r in rows.toLocalIterator()), "turtle").select("s", "p", "o")


def _results(kind: str) -> None:
    """A result's text, parsed again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = nations(spark, sf_dir).query('SELECT ?n ?name ?none WHERE { ?n <urn:name> ?name OPTIONAL { ?n <urn:no> ?none } }')
        names, rows = writers.parse_results("".join(writers.results(df, kind)), kind)
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"{c} string" for c in names))

    name = f"results_{kind}"
    run.__name__ = name
    catalog.QUERIES[name], catalog.ORACLE_SQL[name] = run, "SELECT '<urn:n/' || n_nationkey || '>' AS n, '\"' || n_name || '\"' AS name, NULL::VARCHAR AS none FROM nation"


for _kind in ("json", "xml", "tsv"):
    _results(_kind)


@query("SELECT 'urn:n/' || n_nationkey || ',' || n_name AS line FROM nation UNION ALL SELECT 'n,name'")
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nations(spark, sf_dir).query("SELECT ?n ?name WHERE { ?n <urn:name> ?name }")
    return spark.createDataFrame([(x,) for x in "".join(writers.results(df, "csv")).splitlines()], "line string")


@query(_GRAPH)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a stream reads into a store."""
    path = scratch(spark)
    writers.write_rdf(by_source(spark, sf_dir), f"{path}/in", "nquads")
    ingest.ingest(spark, f"{path}/in", f"{path}/store", f"{path}/progress").awaitTermination()
    return Store.open(spark, f"{path}/store").query("SELECT ?g ?s ?p ?o WHERE { GRAPH ?g { ?s ?p ?o } }")


# access and pruning ---------------------------------------------------------------------------------------------------------------


@query("SELECT '<urn:g/' || source || '>' AS g, count(*) AS n FROM documents WHERE source IN ('src1', 'src3') GROUP BY 1")
def access_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some policy allows and none denies."""
    rows = [("<urn:g/src1>", "<urn:me>", "read", "allow"), ("<urn:g/src2>", access.EVERYBODY, "read", "allow"), ("<urn:g/src2>", "<urn:me>", "read", "deny"), ("<urn:g/src3>", access.KNOWN, "read", "allow"), ("<urn:g/src4>", "<urn:me>", "write", "allow"), ("<urn:g/src5>", "<urn:you>", "read", "allow")]
    policies = spark.createDataFrame(rows, "resource string, subject string, mode string, effect string")
    return access.readable(by_source(spark, sf_dir), access.acp_allowed(policies, "<urn:me>")).groupBy("g").agg(F.count("*").alias("n"))


@query(f"SELECT '<urn:u/' || user_id || '>' AS s, '<urn:e/' || event_type || '>' AS p, '<urn:event/' || event_id || '>' AS o FROM {catalog._FACTS}, {catalog._MID} WHERE ts <= a AND vt > a AND event_type <> 'click'")
def prune_to_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What held at a time, without a predicate."""
    a, _ = catalog._middle(spark, sf_dir)
    return prune.prune(event_quads(spark, sf_dir), prune.PruneOptions(exclude_predicates=("urn:e/click",)), f"{a} 00:00:00").select("s", "p", "o")


@query("SELECT 'preserve_versions' AS history, count(*) FILTER (event_type <> 'click') AS n FROM events UNION ALL SELECT 'preserve_all', count(*) FROM events")
def prune_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, with and without what has been deleted."""
    q = event_quads(spark, sf_dir).withColumn("is_deleted", F.col("p") == "<urn:e/click>")
    parts = [prune.prune(q, prune.PruneOptions(history=h), "2024-01-01 00:00:00").agg(F.lit(h).alias("history"), F.count("*").alias("n")) for h in prune.HISTORY[1:]]
    return parts[0].union(parts[1])


@query("SELECT count(*) FILTER (source = 'src1') AS kept, count(*) AS total, true AS same FROM documents")
def prune_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with its audit row; the copy is held against the source once more."""
    q, options, now = by_source(spark, sf_dir), prune.PruneOptions(include_graphs=("urn:g/src1",), include_default=False), "2024-01-01 00:00:00"
    copy = checkpointed(prune.prune(q, options, now))
    return prune.audit(q, copy, options, now).select("kept", "total", prune.verified(q, copy, options, now).alias("same"))
