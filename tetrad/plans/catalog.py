"""Queries over the driver's tables, by operator, each with the SQL that gives the same rows.

Most are SPARQL texts over the tables seen as a graph; the SQL is written over the tables themselves, so that the two agree
only if parser, compiler and mapping are right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, prune, quads, reason, textsearch, writes
from ..operators.engine import TableEngine
from ..sources import rdf, writers
from ..sources.tables import TableSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sparql(name: str, text: str, sql: str | None, **columns: str) -> None:
    """Register a SPARQL query; columns: casts or roundings of result columns, as Spark SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = TableEngine(spark, TableSource(spark, sf_dir)).query(text)
        return df.select(*[F.expr(columns.get(c, f"`{c}`")).alias(c) for c in df.columns])

    run.__name__ = run.__qualname__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# patterns, joins, modifiers ---------------------------------------------------------------------------------------------------

sparql("bgp_group_order", "SELECT ?nation (SUM(?price) AS ?total) WHERE { ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_name ?nation . ?o :o_totalprice ?price } GROUP BY ?nation ORDER BY DESC(?total)",
       "SELECT n_name AS nation, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", total="round(total, 2)")
sparql("scan_constant_object", 'SELECT ?c ?bal WHERE { ?c :c_mktsegment "BUILDING" ; :c_acctbal ?bal }', "SELECT 'urn:t:customer/' || c_custkey AS c, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("scan_constant_subject", "SELECT ?p ?o WHERE { <urn:t:nation/7> ?p ?o }",
       "SELECT * FROM (SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<urn:t:nation>' AS o UNION ALL SELECT '<urn:t:n_nationkey>', '\"7\"^^<http://www.w3.org/2001/XMLSchema#integer>' UNION ALL SELECT '<urn:t:n_name>', '\"' || n_name || '\"' FROM nation WHERE n_nationkey = 7 UNION ALL SELECT '<urn:t:n_regionkey>', '<urn:t:region/' || n_regionkey || '>' FROM nation WHERE n_nationkey = 7)")
sparql("scan_variable_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a <urn:t:region> } GROUP BY ?p",
       "SELECT p, count(*) AS n FROM (SELECT unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:t:r_regionkey>', '<urn:t:r_name>']) AS p FROM region) GROUP BY p")
sparql("repeated_variable", "SELECT ?c WHERE { ?o :o_custkey ?c . ?c :c_custkey ?k . ?o :o_orderkey ?k }", "SELECT 'urn:t:customer/' || o_custkey AS c FROM orders WHERE o_custkey = o_orderkey AND o_custkey IN (SELECT c_custkey FROM customer)")
sparql("object_lists", 'SELECT ?k WHERE { ?o :o_orderpriority "1-URGENT" ; :o_orderstatus "F" ; :o_orderkey ?k . ?o :o_custkey [ :c_mktsegment "MACHINERY" ] }',
       "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND c_mktsegment = 'MACHINERY'")
sparql("star_join_lineitem", "SELECT ?k ?n ?price ?disc WHERE { ?l :l_orderkey ?o ; :l_linenumber ?n ; :l_extendedprice ?price ; :l_discount ?disc ; :l_quantity ?q . ?o :o_orderkey ?k FILTER(?q >= 49 && ?disc > 0.08) }",
       "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_extendedprice AS price, l_discount AS disc FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 AND l_discount > 0.08")
sparql("six_way_join", """SELECT ?nation (SUM(?price * (1 - ?disc)) AS ?revenue) WHERE { ?l :l_orderkey ?o ; :l_suppkey ?s ; :l_extendedprice ?price ; :l_discount ?disc . ?o :o_custkey ?c .
 ?c :c_nationkey ?n . ?s :s_nationkey ?n . ?n :n_name ?nation ; :n_regionkey ?r . ?r :r_name "ASIA" } GROUP BY ?nation""",
       "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1", revenue="round(revenue, 2)")
sparql("cross_product", "SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b FILTER(?a < ?b) }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name")
sparql("theta_join", "SELECT ?p ?q WHERE { ?a :s_suppkey ?p ; :s_acctbal ?x ; :s_nationkey ?n . ?b :s_suppkey ?q ; :s_acctbal ?y ; :s_nationkey ?n FILTER(?x < ?y) }",
       "SELECT a.s_suppkey AS p, b.s_suppkey AS q FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
sparql("optional_filter", "SELECT ?k ?price WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?price FILTER(?price > 400000) } }",
       "SELECT c_custkey AS k, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
sparql("optional_then_join_whole", "SELECT ?k ?o ?name WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus \"P\" } ?c :c_nationkey ?n . ?n :n_name ?name }",
       "SELECT c_custkey AS k, 'urn:t:orders/' || o_orderkey AS o, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sparql("optional_outer_filter", "SELECT ?k ?s WHERE { ?c :c_custkey ?k ; :c_acctbal ?b OPTIONAL { ?s :s_suppkey ?m ; :s_acctbal ?t FILTER(?t > ?b && ?m = ?k) } }",
       "SELECT c_custkey AS k, 'urn:t:supplier/' || s_suppkey AS s FROM customer LEFT JOIN supplier ON s_acctbal > c_acctbal AND s_suppkey = c_custkey")
sparql("union_branches", "SELECT ?name ?bal WHERE { { ?x :c_name ?name ; :c_acctbal ?bal FILTER(?bal < 0) } UNION { ?x :s_name ?name ; :s_acctbal ?bal FILTER(?bal < 0) } }",
       "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal < 0")
sparql("minus_shared", "SELECT ?k WHERE { ?c :c_custkey ?k MINUS { ?o :o_custkey ?c } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sparql("minus_nothing_shared", "SELECT ?n WHERE { ?r :r_name ?n MINUS { ?x :n_name ?y } }", "SELECT r_name AS n FROM region")
sparql("filter_exists", "SELECT ?k WHERE { ?c :c_custkey ?k FILTER EXISTS { ?o :o_custkey ?c ; :o_orderstatus \"P\" } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sparql("filter_not_exists", "SELECT ?k WHERE { ?p :p_partkey ?k FILTER NOT EXISTS { ?l :l_partkey ?p ; :l_quantity ?q FILTER(?q > 45) } }", "SELECT p_partkey AS k FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
sparql("exists_correlated", "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t < ?b * 10) } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 10)")
sparql("exists_in_expression", "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o :o_custkey ?c ; :o_orderstatus \"P\" }) }", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_P_ORDERS = "(SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P')"
_URGENT = "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"
_OPEN = "SELECT k, 'urn:t:orders/' || o AS o FROM " + _P_ORDERS
sparql("optional_chain", 'SELECT ?k ?o ?p WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus "P" } OPTIONAL { ?l :l_orderkey ?o ; :l_linenumber 7 ; :l_quantity ?q ; :l_extendedprice ?p FILTER(?q >= 50) } }',
       f"SELECT k, 'urn:t:orders/' || coalesce(o, l_orderkey) AS o, l_extendedprice AS p FROM {_P_ORDERS} LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity >= 50 AND l_linenumber = 7) ON o IS NULL OR o = l_orderkey")
sparql("minus_after_optional", 'SELECT ?k ?o WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus "P" } MINUS { ?o :o_orderpriority "1-URGENT" } }', f"{_OPEN} WHERE o IS NULL OR o NOT IN {_URGENT}")
sparql("exists_after_optional", 'SELECT ?k ?o WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus "P" } FILTER EXISTS { ?o :o_orderpriority "1-URGENT" } }', f"{_OPEN} WHERE o IS NULL OR o IN {_URGENT}")
sparql("not_exists_after_optional", 'SELECT ?k ?o WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus "P" } FILTER NOT EXISTS { ?o :o_orderpriority "1-URGENT" } }', f"{_OPEN} WHERE o IS NOT NULL AND o NOT IN {_URGENT}")
sparql("minus_rows", 'SELECT ?k WHERE { ?c :c_custkey ?k MINUS { ?o :o_custkey ?c ; :o_orderstatus "P" ; :o_orderpriority "1-URGENT" } }', "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
sparql("exists_twice_in_expression", 'SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER(IF(EXISTS { ?o :o_custkey ?c ; :o_orderstatus "P" }, ?b > 5000, NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 90) })) }',
       "SELECT c_custkey AS k FROM customer WHERE CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN c_acctbal > 5000 ELSE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 90) END")
sparql("scan_key", "SELECT ?p ?d WHERE { <urn:t:orders/7> :o_totalprice ?p ; :o_orderdate ?d }", "SELECT o_totalprice AS p, o_orderdate AS d FROM orders WHERE o_orderkey = 7")
sparql("scan_foreign_key", "SELECT ?k WHERE { ?o :o_custkey <urn:t:customer/7> ; :o_orderkey ?k }", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 7")
sparql("values_join", 'SELECT ?k ?w WHERE { VALUES (?seg ?w) { ("BUILDING" 1) ("HOUSEHOLD" 2) } ?c :c_mktsegment ?seg ; :c_custkey ?k }', "SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 1::BIGINT ELSE 2::BIGINT END AS w FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")
sparql("values_undef", 'SELECT ?r ?n ?w WHERE { ?x :r_regionkey ?r ; :r_name ?n . VALUES (?r ?w) { (1 10) (UNDEF 20) } }', "SELECT r_regionkey::BIGINT AS r, r_name AS n, w::BIGINT AS w FROM region JOIN (VALUES (1, 10), (NULL, 20)) v(k, w) ON k IS NULL OR k = r_regionkey")
sparql("sub_select", "SELECT ?name ?m WHERE { { SELECT ?n (MAX(?b) AS ?m) WHERE { ?c :c_nationkey ?n ; :c_acctbal ?b } GROUP BY ?n } ?n :n_name ?name }", "SELECT n_name AS name, m FROM nation JOIN (SELECT c_nationkey, max(c_acctbal) AS m FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
sparql("sub_select_limit", "SELECT ?k ?c WHERE { { SELECT ?o ?k ?c WHERE { ?o :o_totalprice ?t ; :o_orderkey ?k ; :o_custkey ?cu . ?cu :c_custkey ?c } ORDER BY DESC(?t) ?k LIMIT 10 } }", "SELECT o_orderkey AS k, o_custkey AS c FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sparql("nested_group_scope", "SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_custkey ?c . { ?c :c_acctbal ?b FILTER(?b < -900) } }", "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -900")
sparql("bind_and_filter", "SELECT ?k ?v WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p BIND(?p * 2 AS ?v) FILTER(?v > 900000) }", "SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_totalprice * 2 > 900000")
sparql("in_and_not_in", 'SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_orderpriority ?p ; :o_orderstatus ?s FILTER(?p IN ("1-URGENT", "2-HIGH") && ?s NOT IN ("O", "P")) }', "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('O', 'P')")
sparql("distinct_projection", "SELECT DISTINCT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
sparql("reduced_projection", "SELECT REDUCED ?s WHERE { ?o :o_orderstatus ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders")
sparql("order_limit_offset", "SELECT ?k ?p WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20 OFFSET 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 10")
sparql("order_expression", "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b } ORDER BY DESC(ABS(?b)) ?k LIMIT 15", "SELECT c_custkey AS k FROM customer ORDER BY abs(c_acctbal) DESC, k LIMIT 15")
sparql("limit_zero", "SELECT ?k WHERE { ?c :c_custkey ?k } LIMIT 0", "SELECT c_custkey AS k FROM customer LIMIT 0")
sparql("ask_true", "ASK { ?c :c_acctbal ?b FILTER(?b > 9000) }", "SELECT count(*) > 0 AS ask FROM customer WHERE c_acctbal > 9000")
sparql("ask_false", "ASK { ?c :c_acctbal ?b FILTER(?b > 1e9) }", "SELECT count(*) > 0 AS ask FROM customer WHERE c_acctbal > 1e9")
sparql("construct_template", "CONSTRUCT { ?r <urn:t:customers> ?c } WHERE { ?c :c_nationkey ?n . ?n :n_regionkey ?r }", "SELECT DISTINCT '<urn:t:region/' || n_regionkey || '>' AS s, '<urn:t:customers>' AS p, '<urn:t:customer/' || c_custkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
sparql("describe_resource", "DESCRIBE <urn:t:region/2>",
       "SELECT '<urn:t:region/2>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<urn:t:region>' AS o UNION ALL SELECT '<urn:t:region/2>', '<urn:t:r_regionkey>', '\"2\"^^<http://www.w3.org/2001/XMLSchema#integer>' UNION ALL SELECT '<urn:t:region/2>', '<urn:t:r_name>', '\"' || r_name || '\"' FROM region WHERE r_regionkey = 2 UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', '<urn:t:n_regionkey>', '<urn:t:region/2>' FROM nation WHERE n_regionkey = 2")

# aggregation --------------------------------------------------------------------------------------------------------------------

sparql("aggregates_all", "SELECT ?s (COUNT(*) AS ?n) (COUNT(DISTINCT ?c) AS ?d) (SUM(?q) AS ?sum) (AVG(?q) AS ?avg) (MIN(?q) AS ?low) (MAX(?q) AS ?high) WHERE { ?o :o_orderstatus ?s ; :o_custkey ?c ; :o_totalprice ?q } GROUP BY ?s",
       "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS d, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1", sum="round(sum, 2)", avg="round(avg, 4)")
sparql("aggregate_global_empty", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?s) (AVG(?b) AS ?a) (GROUP_CONCAT(?m) AS ?g) WHERE { ?c :c_acctbal ?b ; :c_mktsegment ?m FILTER(?b > 1e9) }", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, '' AS g")
sparql("aggregate_distinct", "SELECT (SUM(DISTINCT ?s) AS ?t) (COUNT(DISTINCT *) AS ?n) WHERE { ?p :p_size ?s }", "SELECT sum(DISTINCT p_size)::BIGINT AS t, count(*) AS n FROM part")
sparql("group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=\", \") AS ?names) WHERE { ?x :n_regionkey ?y ; :n_name ?n . ?y :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("sample_value", "SELECT ?r (SAMPLE(?n) AS ?one) WHERE { ?x :n_regionkey ?y ; :n_name ?n . ?y :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, min(n_name) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("aggregate_expression", "SELECT ?f (SUM(?p * (1 - ?d) * (1 + ?t)) AS ?charge) (SUM(IF(?q > 25, 1, 0)) AS ?big) WHERE { ?l :l_returnflag ?f ; :l_extendedprice ?p ; :l_discount ?d ; :l_tax ?t ; :l_quantity ?q } GROUP BY ?f",
       "SELECT l_returnflag AS f, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS big FROM lineitem GROUP BY 1", charge="round(charge, 2)")
sparql("expression_over_aggregates", "SELECT ?b ((MIN(?p) + MAX(?p)) / 2 AS ?mid) WHERE { ?x :p_brand ?b ; :p_retailprice ?p } GROUP BY ?b", "SELECT p_brand AS b, round((min(p_retailprice) + max(p_retailprice)) / 2, 4) AS mid FROM part GROUP BY 1", mid="round(mid, 4)")
sparql("having_alias_and_hidden", "SELECT ?n (COUNT(*) AS ?c) WHERE { ?x :c_nationkey ?y ; :c_acctbal ?b . ?y :n_name ?n } GROUP BY ?n HAVING (?c > 2) (AVG(?b) > 4000)", "SELECT n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 2 AND avg(c_acctbal) > 4000")
sparql("group_by_expression", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("group_unbound_key", "SELECT ?st (COUNT(?k) AS ?n) WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus ?st FILTER(?st = \"P\") } } GROUP BY ?st", "SELECT o_orderstatus AS st, count(c_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")

# functions ----------------------------------------------------------------------------------------------------------------------

sparql("functions_strings", """SELECT ?k (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (SUBSTR(?n, 2, 4) AS ?sub) (CONCAT(?n, "-", ?m) AS ?cat) (STRBEFORE(?n, "#") AS ?bef) (STRAFTER(?n, "_") AS ?aft) (REPLACE(?n, "[0-9]", "x") AS ?rep) (ENCODE_FOR_URI(?n) AS ?enc)
 WHERE { ?c :c_custkey ?k ; :c_name ?n ; :c_mktsegment ?m FILTER(STRSTARTS(?m, "B") || STRENDS(?m, "Y") || CONTAINS(?m, "HOLD")) }""",
       """SELECT c_custkey AS k, length(c_name) AS len, upper(c_name) AS up, lower(c_name) AS low, substr(c_name, 2, 4) AS sub, c_name || '-' || c_mktsegment AS cat, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS bef,
 CASE WHEN contains(c_name, '_') THEN substr(c_name, instr(c_name, '_') + 1) ELSE '' END AS aft, regexp_replace(c_name, '[0-9]', 'x', 'g') AS rep, replace(replace(c_name, '#', '%23'), ' ', '%20') AS enc FROM customer WHERE c_mktsegment LIKE 'B%' OR c_mktsegment LIKE '%Y' OR contains(c_mktsegment, 'HOLD')""")
sparql("functions_numbers", "SELECT ?k (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (-?b AS ?neg) (?b / 0 AS ?none) WHERE { ?x :c_custkey ?k ; :c_acctbal ?b }", "SELECT c_custkey AS k, abs(c_acctbal) AS a, round(c_acctbal) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, -c_acctbal AS neg, NULL::DOUBLE AS none FROM customer")
sparql("functions_dates", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) WHERE { ?o :o_orderkey ?k ; :o_orderdate ?d FILTER(?d >= \"1997-01-01T00:00:00\"^^<http://www.w3.org/2001/XMLSchema#dateTime>) }",
       "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
sparql("functions_hashes", "SELECT ?k (MD5(?n) AS ?m) (SHA1(?n) AS ?s1) (SHA256(?n) AS ?s2) WHERE { ?x :n_nationkey ?k ; :n_name ?n }", "SELECT n_nationkey::BIGINT AS k, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
sparql("functions_terms", "SELECT ?k (STR(?x) AS ?iri) (isIRI(?x) AS ?i) (isLiteral(?n) AS ?l) (isNumeric(?k) AS ?num) (isBlank(?x) AS ?b) (DATATYPE(?k) AS ?dt) (LANG(?n) AS ?la) (sameTerm(?n, ?n) AS ?same) WHERE { ?x :n_nationkey ?k ; :n_name ?n }",
       "SELECT n_nationkey::BIGINT AS k, 'urn:t:nation/' || n_nationkey AS iri, true AS i, true AS l, true AS num, false AS b, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, '' AS la, true AS same FROM nation")
sparql("functions_control", "SELECT ?k (IF(?b < 0, \"debt\", \"credit\") AS ?w) (COALESCE(?none, ?k) AS ?c) (BOUND(?b) AS ?bo) WHERE { ?x :c_custkey ?k ; :c_acctbal ?b }", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS w, '\"' || c_custkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS c, true AS bo FROM customer")
sparql("functions_casts", "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) (xsd:boolean(?k) AS ?t) (COALESCE(xsd:integer(\"1.5\"), -1) AS ?bad) WHERE { ?x :c_custkey ?k ; :c_acctbal ?b }", "SELECT c_custkey AS k, trunc(c_acctbal)::BIGINT AS i, c_custkey::VARCHAR AS s, c_custkey::DOUBLE AS d, c_custkey <> 0 AS t, -1::BIGINT AS bad FROM customer")
sparql("functions_regex", 'SELECT ?k WHERE { ?p :p_partkey ?k ; :p_type ?t FILTER(REGEX(?t, "^(small|large).*brass", "i") || REGEX(?t, "STEEL$")) }', "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_type, '^(small|large).*brass', 'i') OR regexp_matches(p_type, 'STEEL$')")
sparql("functions_regex_rows", 'SELECT ?d WHERE { ?x :documents.doc_id ?d ; :documents.source ?s FILTER(REGEX(?s, "^SRC1[0-9]$", "i")) }', "SELECT doc_id AS d FROM documents WHERE regexp_matches(source, '^src1[0-9]$')")
sparql("functions_constructors", """SELECT ?k (IRI(CONCAT("urn:x:", ?n)) AS ?iri) (isBlank(BNODE()) AS ?blank) (STRDT(?n, <urn:dt>) AS ?typed) (STRLANG(?n, "en-GB") AS ?tagged) (LANG(STRLANG(?n, "en-GB")) AS ?tag) (LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "en") AS ?match)
 (STRLEN(STRUUID()) AS ?u) (STRSTARTS(STR(UUID()), "urn:uuid:") AS ?uu) (RAND() >= 0 && RAND() < 1 AS ?r) (YEAR(NOW()) AS ?now) WHERE { ?x :n_nationkey ?k ; :n_name ?n }""",
       """SELECT n_nationkey::BIGINT AS k, 'urn:x:' || n_name AS iri, true AS blank, '"' || n_name || '"^^<urn:dt>' AS typed, '"' || n_name || '"@en-GB' AS tagged, 'en-GB' AS tag, true AS match, 36 AS u, true AS uu, true AS r, 2000 AS now FROM nation""")
sparql("functions_time", """PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> SELECT ?k (SECONDS(?d) AS ?s) (TZ("2011-01-10T14:45:13.815-05:00"^^xsd:dateTime) AS ?tz) (STR(TIMEZONE("2011-01-10T14:45:13.815-05:00"^^xsd:dateTime)) AS ?zone) (TZ("2011-01-10T14:45:13Z"^^xsd:dateTime) AS ?utc) WHERE { ?e :events.event_id ?k ; :events.ts ?d }""",
       "SELECT event_id AS k, round(extract(microseconds FROM ts) / 1e6, 3) AS s, '-05:00' AS tz, '-PT5H' AS zone, 'Z' AS utc FROM events", s="round(CAST(s AS double), 3)")
sparql("functions_long_hashes", "SELECT ?k (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) (SUBSTR(SHA384(\"abc\"), 1, 16) AS ?c) (SUBSTR(SHA512(\"abc\"), 1, 16) AS ?d) WHERE { ?x :n_nationkey ?k ; :n_name ?n }", "SELECT n_nationkey::BIGINT AS k, 96 AS a, 128 AS b, 'cb00753f45a35e8b' AS c, 'ddaf35a193617aba' AS d FROM nation")
sparql("filter_logic_errors", "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER(?missing > 1 || ?b > 5000) }", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000")
sparql("text_match", 'SELECT ?d WHERE { ?x :documents.text ?t ; :documents.doc_id ?d FILTER(text:match(?t, "THE THE")) }', "SELECT doc_id AS d FROM documents WHERE contains(lower(text), 'the the')")

# paths --------------------------------------------------------------------------------------------------------------------------

sparql("path_sequence_inverse", "SELECT ?r ?k WHERE { ?x :r_name ?r . ?x ^:n_regionkey/^:s_nationkey ?s . ?s :s_suppkey ?k }", "SELECT r_name AS r, s_suppkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
sparql("path_alternative_whole", "SELECT ?k ?n WHERE { ?x (:s_suppkey|:c_custkey) ?k ; (:s_nationkey|:c_nationkey)/:n_name ?n }", "SELECT s_suppkey AS k, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
sparql("path_closure", "SELECT ?r WHERE { <urn:t:customer/1> (:c_nationkey|:n_regionkey)+ ?r }", "SELECT '<urn:t:nation/' || c_nationkey || '>' AS r FROM customer WHERE c_custkey = 1 UNION SELECT '<urn:t:region/' || n_regionkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
sparql("path_closure_from_bound", 'SELECT ?k ?r WHERE { ?c :c_mktsegment "BUILDING" ; :c_custkey ?k ; (:c_nationkey|:n_regionkey)+ ?r }',
       "SELECT c_custkey AS k, '<urn:t:nation/' || c_nationkey || '>' AS r FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, '<urn:t:region/' || n_regionkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
sparql("path_closure_to_bound", 'SELECT ?x ?n WHERE { ?r :r_name ?n . ?x (:s_nationkey|:n_regionkey)* ?r }',
       "SELECT '<urn:t:region/' || r_regionkey || '>' AS x, r_name AS n FROM region UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '<urn:t:supplier/' || s_suppkey || '>', r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("path_closure_to_end", "SELECT ?x WHERE { ?x (:s_nationkey|:n_regionkey)+ <urn:t:region/3> }", "SELECT '<urn:t:nation/' || n_nationkey || '>' AS x FROM nation WHERE n_regionkey = 3 UNION ALL SELECT '<urn:t:supplier/' || s_suppkey || '>' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3")
sparql("path_zero_or_one", "SELECT ?y WHERE { <urn:t:nation/5> :n_regionkey? ?y }", "SELECT '<urn:t:nation/5>' AS y UNION ALL SELECT '<urn:t:region/' || n_regionkey || '>' FROM nation WHERE n_nationkey = 5")
sparql("path_zero_or_more", "SELECT ?y WHERE { <urn:t:supplier/2> (:s_nationkey|:n_regionkey)* ?y }", "SELECT '<urn:t:supplier/2>' AS y UNION ALL SELECT '<urn:t:nation/' || s_nationkey || '>' FROM supplier WHERE s_suppkey = 2 UNION ALL SELECT '<urn:t:region/' || n_regionkey || '>' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 2")
sparql("path_negated", "SELECT ?o WHERE { <urn:t:nation/3> !(:n_name|:n_nationkey|a) ?o }", "SELECT '<urn:t:region/' || n_regionkey || '>' AS o FROM nation WHERE n_nationkey = 3")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn, turn + 1 AS nxt FROM conversations a WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)),
 r AS (SELECT conv_id, turn, nxt FROM e UNION SELECT r.conv_id, r.turn, e.nxt FROM r JOIN e ON r.conv_id = e.conv_id AND r.nxt = e.turn) SELECT conv_id, turn AS first, nxt AS later FROM r""")
def path_closure_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """next+ over the turns of conversations, both ends open, on a quad store."""
    from ..operators.engine import Store

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    node = lambda t: F.concat(F.lit("<urn:c/"), F.col("conv_id"), F.lit("/"), t, F.lit(">"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = c.join(nxt, ["conv_id", "turn"], "left_semi").select(node(F.col("turn")).alias("s"), F.lit("<urn:next>").alias("p"), node(F.col("turn") + 1).alias("o"))
    df = Store(spark, quads.from_triples(edges)).query("SELECT ?a ?b WHERE { ?a <urn:next>+ ?b }")
    part = lambda x, i: F.regexp_extract(x, r"^<urn:c/(\d+)/(\d+)>$", i).cast("long")
    return df.select(part("a", 1).alias("conv_id"), part("a", 2).alias("first"), part("b", 2).alias("later"))


# time ---------------------------------------------------------------------------------------------------------------------------


def event_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: a user's event of a type holds until the user's next one of that type."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        F.lit("").alias("g"), F.concat(F.lit("<urn:u/"), F.col("user_id"), F.lit(">")).alias("s"), F.concat(F.lit("<urn:e/"), F.col("event_type"), F.lit(">")).alias("p"), F.concat(F.lit("<urn:event/"), F.col("event_id"), F.lit(">")).alias("o"),
        F.col("ts").alias("valid_from"), F.coalesce(F.lead("ts").over(w), F.lit(quads.OPEN).cast("timestamp")).alias("valid_to"), F.col("ts").alias("tx_time"), F.lit(False).alias("is_deleted"), F.lit(1).alias("version"),
    )


_FACTS = "(SELECT *, coalesce(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), TIMESTAMP '9999-12-31 23:59:59.999') AS vt FROM events)"
_NAMES = "'<urn:u/' || user_id || '>' AS s, '<urn:event/' || event_id || '>' AS o"


def _middle(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    r = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.date_format(F.min("ts") + (F.max("ts") - F.min("ts")) / 2, "yyyy-MM-dd").alias("a"), F.date_format(F.min("ts") + (F.max("ts") - F.min("ts")) / 2 + F.expr("interval 2 days"), "yyyy-MM-dd").alias("b")).first()
    return r["a"], r["b"]


def _temporal(name: str, clause: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.engine import Store

        a, b = _middle(spark, sf_dir)
        x = "^^<http://www.w3.org/2001/XMLSchema#date>"
        return Store(spark, event_quads(spark, sf_dir)).query("SELECT ?s ?o WHERE { ?s ?p ?o } " + clause.format(a=f'"{a}"{x}', b=f'"{b}"{x}'))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = sql


_MID = "(SELECT strftime(min(ts) + (max(ts) - min(ts)) / 2, '%Y-%m-%d')::TIMESTAMP AS a, strftime(min(ts) + (max(ts) - min(ts)) / 2 + INTERVAL 2 DAY, '%Y-%m-%d')::TIMESTAMP AS b FROM events)"
_temporal("temporal_as_of", "AS OF {a}", f"SELECT {_NAMES} FROM {_FACTS}, {_MID} WHERE ts <= a AND vt > a")
_temporal("temporal_during", "DURING [{a}, {b}]", f"SELECT {_NAMES} FROM {_FACTS}, {_MID} WHERE ts < b AND vt > a")
_temporal("temporal_all_versions", "ALL VERSIONS", f"SELECT {_NAMES} FROM {_FACTS}")
_temporal("temporal_current", "", f"SELECT {_NAMES} FROM {_FACTS} WHERE vt > TIMESTAMP '9000-01-01'")


@query(f"SELECT {_NAMES}, ts AS valid_from, CASE WHEN vt < TIMESTAMP '9000-01-01' THEN vt END AS valid_to FROM {_FACTS}, {_MID} WHERE (ts >= a AND ts < b) OR (vt >= a AND vt < b)")
def temporal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _middle(spark, sf_dir)
    ended = F.when(F.col("valid_to") < F.lit(quads.OPEN_FROM).cast("timestamp"), F.col("valid_to"))
    return quads.changes(event_quads(spark, sf_dir), a, b).select("s", "o", "valid_from", ended.alias("valid_to"))


# writes -------------------------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT user_id, event_type, ts, min(event_id) AS id FROM events GROUP BY 1, 2, 3),
 w AS (SELECT *, ts + INTERVAL 30 DAY AS vt, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS nxt FROM f)
 SELECT user_id, event_type, ts AS valid_from, CASE WHEN nxt < vt THEN nxt ELSE vt END AS valid_to FROM w""")
def write_insert_truncates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that hold for thirty days; a later insert of the same fact ends the one before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts").distinct()
    new = e.select(
        F.lit("").alias("g"), F.col("user_id").cast("string").alias("s"), F.col("event_type").alias("p"), F.lit("1").alias("o"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("interval 30 days")).alias("valid_to"),
        F.lit(quads.BEGIN).cast("timestamp").alias("tx_time"), F.lit(False).alias("is_deleted"), F.lit(1).alias("version"),
    )
    return writes.insert(quads.empty(spark), new).select(F.col("s").cast("long").alias("user_id"), F.col("p").alias("event_type"), "valid_from", "valid_to")


@query("WITH f AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT user_id, count(*) AS live FROM f WHERE NOT (n = 1 AND event_type = 'click') GROUP BY 1")
def write_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first live click of each user is deleted; what is left is counted."""
    q = event_quads(spark, sf_dir).withColumn("o", F.lit("<urn:done>"))
    q = q.withColumn("valid_from", F.expr("valid_from + make_interval(0, 0, 0, 0, 0, 0, 0)"))
    gone = writes.delete(q, q.where("p = '<urn:e/click>'"))
    return gone.where("not is_deleted").groupBy(F.regexp_extract("s", r"(\d+)", 1).cast("long").alias("user_id")).agg(F.count("*").alias("live"))


@query("SELECT n_name AS name, n_regionkey + 100 AS region FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def write_modify_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE and INSERT with WHERE: one region's number is raised."""
    from ..operators.engine import Store

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = n.select(F.concat(F.lit("<urn:n/"), F.col("n_nationkey"), F.lit(">")).alias("s"), F.explode(F.array(F.struct(F.lit("<urn:name>").alias("p"), F.concat(F.lit('"'), F.col("n_name"), F.lit('"')).alias("o")), F.struct(F.lit("<urn:region>").alias("p"), F.concat(F.lit('"'), F.col("n_regionkey"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>')).alias("o")))).alias("c")).select("s", "c.*")
    store = Store(spark, quads.from_triples(rows))
    store.update("DELETE { ?n <urn:region> ?r } INSERT { ?n <urn:region> ?q } WHERE { ?n <urn:region> ?r FILTER(?r = 1) BIND(?r + 100 AS ?q) }")
    df = store.query("SELECT ?name ?region WHERE { ?n <urn:name> ?name ; <urn:region> ?region }")
    return df.select(F.regexp_extract("name", '"(.*)"', 1).alias("name"), F.regexp_extract("region", r'"(\d+)"', 1).cast("int").alias("region"))


# graphs, text, reasoning, formats -------------------------------------------------------------------------------------------------


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language as a triple in the graph of its source; a source graph's documents also in the default graph's list."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quads.from_triples(d.select(F.concat(F.lit("<urn:g/"), F.col("source"), F.lit(">")).alias("g"), F.concat(F.lit("<urn:d/"), F.col("doc_id"), F.lit(">")).alias("s"), F.lit("<urn:lang>").alias("p"), F.concat(F.lit('"'), F.col("lang"), F.lit('"')).alias("o")))


def _graphs(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.engine import Store

        return Store(spark, by_source(spark, sf_dir)).query(text, terms=False)

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, sql


_graphs("graph_constant", 'SELECT ?d WHERE { GRAPH <urn:g/src3> { ?d <urn:lang> "fr" } }', "SELECT '<urn:d/' || doc_id || '>' AS d FROM documents WHERE source = 'src3' AND lang = 'fr'")
_graphs("graph_variable", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?d <urn:lang> ?l } } GROUP BY ?g", "SELECT '<urn:g/' || source || '>' AS g, count(*) AS n FROM documents GROUP BY 1")
_graphs("graph_from", 'SELECT ?d FROM <urn:g/src1> FROM <urn:g/src2> WHERE { ?d <urn:lang> "de" }', "SELECT '<urn:d/' || doc_id || '>' AS d FROM documents WHERE source IN ('src1', 'src2') AND lang = 'de'")
_graphs("graph_from_named", "SELECT ?g ?d FROM NAMED <urn:g/src4> WHERE { GRAPH ?g { ?d <urn:lang> \"es\" } }", "SELECT '<urn:g/' || source || '>' AS g, '<urn:d/' || doc_id || '>' AS d FROM documents WHERE source = 'src4' AND lang = 'es'")


@query("SELECT DISTINCT '<urn:g/' || source || '>' AS graph FROM documents")
def graph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads.named_graphs(by_source(spark, sf_dir))


@query("SELECT count(*) AS quads, count(*) AS live, count(DISTINCT source) AS graphs, count(DISTINCT doc_id) + count(DISTINCT lang) + 1 AS terms FROM documents")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads.statistics(by_source(spark, sf_dir))


@query("SELECT '<urn:e/' || event_type || '>' AS p, count(*) AS triples, count(DISTINCT user_id) AS subjects, count(DISTINCT event_id) AS objects FROM events GROUP BY 1")
def predicate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads.predicate_statistics(event_quads(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the of')")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return textsearch.search(textsearch.index(d, "doc_id", "text"), d, "doc_id", "text", "The OF").select("doc_id")


@query("""SELECT '<urn:s/' || s_suppkey || '>' AS s, '<urn:in>' AS p, '<urn:r/' || n_regionkey || '>' AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def reason_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers lie in regions, since they lie in nations and nations in regions."""
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    iri = lambda k, c: F.concat(F.lit(f"<urn:{k}/"), F.col(c), F.lit(">"))
    edges = s.select(iri("s", "s_suppkey").alias("s"), F.lit("<urn:in>").alias("p"), iri("n", "s_nationkey").alias("o")).union(n.select(iri("n", "n_nationkey"), F.lit("<urn:in>"), iri("r", "n_regionkey")))
    schema = spark.createDataFrame([("<urn:in>", reason.TYPE, reason.TRANSITIVE)], "s string, p string, o string")
    return reason.materialize(edges.union(schema), ("transitive",))


@query("""SELECT '<urn:p/' || p_partkey || '>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, o FROM part, (SELECT unnest(['<urn:Good>', '<urn:Thing>']) AS o)
 UNION ALL SELECT DISTINCT '<urn:b/' || p_brand || '>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:Brand>' FROM part UNION ALL SELECT '<urn:Part>', '<http://www.w3.org/2000/01/rdf-schema#subClassOf>', '<urn:Thing>'""")
def reason_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by subclass chains and by a property's range."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    iri = lambda k, c: F.concat(F.lit(f"<urn:{k}/"), F.col(c), F.lit(">"))
    facts = p.select(iri("p", "p_partkey").alias("s"), F.lit(reason.TYPE).alias("p"), F.lit("<urn:Part>").alias("o")).union(p.select(iri("p", "p_partkey"), F.lit("<urn:brand>"), iri("b", "p_brand")))
    schema = spark.createDataFrame([("<urn:Part>", reason.SUB_CLASS, "<urn:Good>"), ("<urn:Good>", reason.SUB_CLASS, "<urn:Thing>"), ("<urn:brand>", reason.RANGE, "<urn:Brand>")], "s string, p string, o string")
    return reason.materialize(facts.union(schema), ("sub_class_chain", "type_by_class", "range"))


@query("SELECT '<urn:g/' || source || '>' AS g, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') AND source <> 'src2' GROUP BY 1")
def prune_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = prune.PruneOptions(include_graphs=("urn:g/src1", "urn:g/src2", "urn:g/src3"), exclude_graphs=("urn:g/src2",))
    return prune.prune(by_source(spark, sf_dir), options, "2024-01-01 00:00:00").groupBy("g").agg(F.count("*").alias("n"))


@query("SELECT '<urn:d/' || doc_id || '> <urn:lang> \"' || lang || '\" <urn:g/' || source || '> .' AS value FROM documents")
def write_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.lines(by_source(spark, sf_dir))


@query("SELECT '<urn:g/' || source || '>' AS g, '<urn:d/' || doc_id || '>' AS s, '<urn:lang>' AS p, '\"' || lang || '\"' AS o FROM documents")
def read_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines parsed back to quads."""
    return rdf.parse_lines(writers.lines(by_source(spark, sf_dir)))


@query("SELECT '<urn:g/' || source || '>' AS g, '<urn:d/' || doc_id || '>' AS s, '<urn:lang>' AS p, '\"' || lang || '\"' AS o FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def access_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of the graphs that an agent may read, by its own, its groups' and everybody's grants."""
    grants = spark.createDataFrame([("<urn:g/src1>", "<urn:me>", "read"), ("<urn:g/src2>", "<urn:group>", "read"), ("<urn:g/src3>", access.EVERYBODY, "read"), ("<urn:g/src4>", "<urn:you>", "read")], "resource string, subject string, mode string")
    groups = spark.createDataFrame([("<urn:group>", "<urn:me>")], "group string, member string")
    return access.readable(by_source(spark, sf_dir), access.wac_allowed(grants, "<urn:me>", groups)).select("g", "s", "p", "o")


from . import catalog_stores  # noqa: E402, F401  (registers more queries)
