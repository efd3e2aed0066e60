"""Queries over the test tables as virtual triples, one or more for each operator, with the SQL that says the same."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import terms as T
from ..session import Engine
from ..sources.relational import RelationalSource

PREFIXES = "".join(f"PREFIX {p}: <http://d/{t}#>\n" for p, t in (("r", "region"), ("n", "nation"), ("c", "customer"), ("s", "supplier"), ("p", "part"), ("o", "orders"), ("l", "lineitem"), ("e", "events"), ("x", "documents"), ("lb", "labels"), ("pg", "pages"), ("cv", "conversations"), ("b", "benchmark"))) + "PREFIX d: <http://d/>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"


@dataclass(frozen=True)
class Entry:
    sparql: str
    sql: str
    #: Types of columns that aren't text.
    types: dict[str, str] = field(default_factory=dict)
    options: dict[str, bool] = field(default_factory=dict)


#: R: sums of doubles depend on their order; both sides round them.
N, D, R = "bigint", "double", "4"
IRI = "'http://d/{}/' || CAST({} AS VARCHAR)"


def _iri(table: str, column: str) -> str:
    return IRI.format(table, column)


#: Filters over one string and one number of each part: function name -> (SPARQL, SQL).
FUNCTIONS = {
    "coalesce": ("COALESCE(?none, ?z) > 25", "p_size > 25"),
    "if": ("IF(?z > 25, ?pr < 930, ?pr > 930)", "CASE WHEN p_size > 25 THEN p_retailprice < 930 ELSE p_retailprice > 930 END"),
    "str": ("STR(?z) = \"7\"", "CAST(p_size AS VARCHAR) = '7'"),
    "sameterm": ("SAMETERM(?b, \"Brand#3\")", "p_brand = 'Brand#3'"),
    "strlen": ("STRLEN(?t) > 6", "strlen(p_type) > 6"),
    "ucase": ("UCASE(?b) = \"BRAND#3\"", "upper(p_brand) = 'BRAND#3'"),
    "lcase": ("LCASE(?b) = \"brand#3\"", "lower(p_brand) = 'brand#3'"),
    "contains": ("CONTAINS(?b, \"#1\")", "contains(p_brand, '#1')"),
    "strstarts": ("STRSTARTS(?t, \"S\")", "p_type LIKE 'S%'"),
    "strends": ("STRENDS(?b, \"2\")", "p_brand LIKE '%2'"),
    "substr": ("SUBSTR(?b, 7, 1) = \"4\"", "substr(p_brand, 7, 1) = '4'"),
    "regex": ("REGEX(?t, \"^[a-p]\", \"i\")", "regexp_matches(p_type, '^[a-pA-P]')"),
    "abs": ("ABS(?z - 25) < 5", "abs(p_size - 25) < 5"),
    "ceil": ("CEIL(?pr / 10) = 93", "ceil(p_retailprice / 10) = 93"),
    "floor": ("FLOOR(?pr / 10) = 93", "floor(p_retailprice / 10) = 93"),
    "round": ("ROUND(?pr / 10) = 93", "floor(p_retailprice / 10 + 0.5) = 93"),
}
OPERATORS = {
    "or": ("?z < 5 || ?z > 45", "p_size < 5 OR p_size > 45"),
    "and": ("?z > 5 && ?pr > 940", "p_size > 5 AND p_retailprice > 940"),
    "not": ("!(?z > 5)", "NOT (p_size > 5)"),
    "equal": ("?z = 7", "p_size = 7"),
    "not_equal": ("?b != \"Brand#3\"", "p_brand <> 'Brand#3'"),
    "less": ("?z < 7", "p_size < 7"),
    "less_equal": ("?z <= 7", "p_size <= 7"),
    "greater": ("?pr > 930.0", "p_retailprice > 930"),
    "greater_equal": ("?z >= 45", "p_size >= 45"),
    "text_less": ("?b < \"Brand#3\"", "p_brand < 'Brand#3'"),
    "add": ("?z + 1 = 8", "p_size + 1 = 8"),
    "subtract": ("?z - 1 = 8", "p_size - 1 = 8"),
    "multiply": ("?z * 2 > 90", "p_size * 2 > 90"),
    "divide": ("?z / 2 > 20", "p_size / 2.0 > 20"),
    "negate": ("-?z < -40", "-p_size < -40"),
    "divide_by_zero": ("IF(?z / 0 > 1, ?z < 5, ?z > 45)", "p_size > 45"),
}
_PART = "?k p:p_size ?z ; p:p_brand ?b ; p:p_type ?t ; p:p_retailprice ?pr"


def entries() -> dict[str, Entry]:
    part = lambda f, sql: Entry(f"SELECT ?k ?z ?b {{ {_PART} FILTER ({f}) }}", f"SELECT {_iri('part', 'p_partkey')} AS k, CAST(p_size AS BIGINT) AS z, p_brand AS b FROM part WHERE {sql}", {"z": N})
    found = {f"fn_{n}": part(*x) for n, x in FUNCTIONS.items()} | {f"op_{n}": part(*x) for n, x in OPERATORS.items()}
    cust, order, nation = _iri("customer", "c_custkey"), _iri("orders", "o_orderkey"), _iri("nation", "c_nationkey")
    found |= {
        "bgp_single": Entry("SELECT ?c ?n { ?c c:c_name ?n }", f"SELECT {cust} AS c, c_name AS n FROM customer"),
        "bgp_star": Entry("SELECT ?c ?n ?b ?m { ?c c:c_name ?n ; c:c_acctbal ?b ; c:c_mktsegment ?m ; a d:customer }", f"SELECT {cust} AS c, c_name AS n, c_acctbal AS b, c_mktsegment AS m FROM customer", {"b": D}),
        "bgp_chain": Entry("SELECT ?o ?cn ?nn ?rn { ?o o:o_custkey ?c . ?c c:c_name ?cn ; c:c_nationkey ?n . ?n n:n_name ?nn ; n:n_regionkey ?r . ?r r:r_name ?rn }", f"SELECT {order} AS o, c_name AS cn, n_name AS nn, r_name AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
        "bgp_naive_order": Entry("SELECT ?o ?cn { ?o o:o_custkey ?c . ?c c:c_name ?cn ; c:c_nationkey ?n . ?n n:n_name \"NATION_3\" }", f"SELECT {order} AS o, c_name AS cn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'", options={"naive_join_order": True}),
        "bgp_no_merge": Entry("SELECT ?o ?cn { ?o o:o_custkey ?c . ?c c:c_name ?cn }", f"SELECT {order} AS o, c_name AS cn FROM orders JOIN customer ON o_custkey = c_custkey", options={"enable_merge_join": False}),
        "type_scan": Entry("SELECT ?c { ?c a d:supplier }", f"SELECT {_iri('supplier', 's_suppkey')} AS c FROM supplier"),
        "variable_predicate": Entry("SELECT ?p ?v { <http://d/nation/3> ?p ?v }", f"SELECT 'http://d/nation#n_nationkey' AS p, CAST(n_nationkey AS VARCHAR) AS v FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://d/nation#n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://d/nation#n_regionkey', {_iri('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://d/nation'"),
        "repeated_variable": Entry("SELECT ?l ?x { ?l lb:quality ?x ; lb:toxic ?x }", f"SELECT {_iri('labels', 'doc_id')} AS l, CAST(quality AS BIGINT) AS x FROM labels WHERE quality = toxic", {"x": N}),
        "constant_object": Entry("SELECT ?c ?n { ?c c:c_mktsegment \"BUILDING\" ; c:c_name ?n }", f"SELECT {cust} AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
        "constant_subject": Entry("SELECT ?n { <http://d/customer/7> c:c_name ?n }", "SELECT c_name AS n FROM customer WHERE c_custkey = 7"),
        "unknown_constant": Entry("SELECT ?c ?r { { ?c c:nothing ?n } UNION { ?r r:r_name ?x } UNION { ?c c:c_mktsegment \"no such\" } }", f"SELECT CAST(NULL AS VARCHAR) AS c, {_iri('region', 'r_regionkey')} AS r FROM region"),
        "unit": Entry("SELECT (COUNT(*) AS ?n) { }", "SELECT CAST(1 AS BIGINT) AS n", {"n": N}),
        "cross_product": Entry("SELECT ?a ?b { ?a r:r_name ?x . ?b n:n_name ?y }", f"SELECT {_iri('region', 'r_regionkey')} AS a, {_iri('nation', 'n_nationkey')} AS b FROM region, nation"),
        "object_join": Entry("SELECT ?c ?s { ?c c:c_nationkey ?n . ?s s:s_nationkey ?n ; s:s_acctbal ?b FILTER (?b > 9500) }", f"SELECT {cust} AS c, {_iri('supplier', 's_suppkey')} AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 9500"),
        "filter_numeric": Entry("SELECT ?o ?t { ?o o:o_totalprice ?t FILTER (?t > 100000) }", f"SELECT {order} AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 100000", {"t": D}),
        "filter_join": Entry("SELECT ?o ?c { ?o o:o_totalprice ?t ; o:o_custkey ?c . ?c c:c_acctbal ?b FILTER (?t < ?b * 10) }", f"SELECT {order} AS o, {_iri('customer', 'o_custkey')} AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < c_acctbal * 10"),
        "filter_scope": Entry("SELECT ?c { FILTER (?b > 5000) ?c c:c_acctbal ?b }", f"SELECT {cust} AS c FROM customer WHERE c_acctbal > 5000"),
        "filter_not_bound": Entry("SELECT ?c { ?c c:c_name ?n OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus \"F\" ; o:o_orderpriority \"5-LOW\" } FILTER (!BOUND(?o)) }", f"SELECT {cust} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')"),
        "optional": Entry("SELECT ?c ?o { ?c c:c_name ?n OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus \"F\" } }", f"SELECT {cust} AS c, {order} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'"),
        "optional_condition": Entry("SELECT ?c ?o { ?c c:c_acctbal ?b OPTIONAL { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER (?t > ?b * 20) } }", f"SELECT {cust} AS c, {order} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20"),
        "optional_maybe_unbound": Entry(
            "SELECT ?m ?k ?b { ?n n:n_name ?m OPTIONAL { ?n n:n_regionkey ?k FILTER (?k = <http://d/region/1>) } OPTIONAL { ?s s:s_acctbal ?b FILTER (?b > 5000) OPTIONAL { ?s s:s_nationkey ?z . ?z n:n_regionkey ?k FILTER (?k = <http://d/region/1> || ?k = <http://d/region/2>) } FILTER (BOUND(?k)) } }",
            "WITH a AS (SELECT n_name, CASE WHEN n_regionkey = 1 THEN 'http://d/region/1' END AS k FROM nation), b AS (SELECT s_acctbal, CASE WHEN n_regionkey IN (1, 2) THEN 'http://d/region/' || n_regionkey END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000) "
            "SELECT n_name AS m, coalesce(a.k, b.k) AS k, s_acctbal AS b FROM a LEFT JOIN b ON (a.k = b.k OR a.k IS NULL OR b.k IS NULL) AND coalesce(a.k, b.k) IS NOT NULL",
            {"b": D},
        ),
        "malformed_constants": Entry(
            f"SELECT ?c ?x {{ {{ <http://d/customer/--5> c:c_name ?x }} UNION {{ <http://d/customer/²> c:c_name ?x }} UNION {{ ?c p:p_size \"--5\"^^<{T.INTEGER}> }} UNION {{ ?c p:p_size \"²\"^^<{T.INTEGER}> }} UNION {{ ?c p:p_size 7 ; p:p_brand ?x }} }}",
            f"SELECT {_iri('part', 'p_partkey')} AS c, p_brand AS x FROM part WHERE p_size = 7",
        ),
        "group_by_some_unbound": Entry("SELECT ?k (COUNT(*) AS ?n) { ?n n:n_name ?m OPTIONAL { ?n n:n_regionkey ?k FILTER (?k = <http://d/region/1>) } } GROUP BY ?k", "SELECT CASE WHEN n_regionkey = 1 THEN 'http://d/region/1' END AS k, count(*) AS n FROM nation GROUP BY 1", {"n": N}),
        "optional_twice": Entry("SELECT ?n ?c ?s { ?n n:n_name \"NATION_1\" OPTIONAL { ?c c:c_nationkey ?n ; c:c_mktsegment \"BUILDING\" } OPTIONAL { ?s s:s_nationkey ?n } }", f"SELECT {_iri('nation', 'n_nationkey')} AS n, {cust} AS c, {_iri('supplier', 's_suppkey')} AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_name = 'NATION_1'"),
        "union": Entry("SELECT ?x ?b ?m { { ?x c:c_acctbal ?b ; c:c_mktsegment ?m } UNION { ?x s:s_acctbal ?b } }", f"SELECT {cust} AS x, c_acctbal AS b, c_mktsegment AS m FROM customer UNION ALL SELECT {_iri('supplier', 's_suppkey')}, s_acctbal, NULL FROM supplier", {"b": D}),
        "nested_group": Entry("SELECT ?c ?o { ?c c:c_acctbal ?b { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER (?t > ?b * 30) } }", f"SELECT {cust} AS c, {order} AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 30"),
        "distinct": Entry("SELECT DISTINCT ?s ?p { ?o o:o_orderstatus ?s ; o:o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
        "reduced": Entry("SELECT REDUCED ?s { ?o o:o_orderstatus ?s }", "SELECT o_orderstatus AS s FROM orders"),
        "project_unbound": Entry("SELECT ?r ?none { ?r r:r_name ?n }", f"SELECT {_iri('region', 'r_regionkey')} AS r, CAST(NULL AS VARCHAR) AS none FROM region"),
        "select_star": Entry("SELECT * { ?r r:r_name ?n }", f"SELECT {_iri('region', 'r_regionkey')} AS r, r_name AS n FROM region"),
        "order_by_asc": Entry("SELECT ?c ?b { ?c c:c_acctbal ?b } ORDER BY ?b ?c LIMIT 20", f"SELECT {cust} AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal, {cust} LIMIT 20", {"b": D}),
        "order_by_desc": Entry("SELECT ?o ?t { ?o o:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20", f"SELECT {order} AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, {order} LIMIT 20", {"t": D}),
        "order_by_expression": Entry("SELECT ?k ?z { ?k p:p_size ?z } ORDER BY (ABS(?z - 25)) DESC(?z) ?k LIMIT 30", f"SELECT {_iri('part', 'p_partkey')} AS k, CAST(p_size AS BIGINT) AS z FROM part ORDER BY abs(p_size - 25), p_size DESC, {_iri('part', 'p_partkey')} LIMIT 30", {"z": N}),
        "order_by_multi": Entry("SELECT ?s ?p ?o { ?o o:o_orderstatus ?s ; o:o_orderpriority ?p } ORDER BY ?s DESC(?p) ?o LIMIT 25", f"SELECT o_orderstatus AS s, o_orderpriority AS p, {order} AS o FROM orders ORDER BY o_orderstatus, o_orderpriority DESC, {order} LIMIT 25"),
        "order_by_dropped_distinct": Entry("SELECT DISTINCT ?m { ?c c:c_mktsegment ?m ; c:c_acctbal ?b } ORDER BY DESC(?b) LIMIT 3", "SELECT m FROM (SELECT c_mktsegment AS m, max(c_acctbal) AS b FROM customer GROUP BY c_mktsegment ORDER BY b DESC LIMIT 3)"),
        "limit_offset": Entry("SELECT ?c { ?c c:c_name ?n } ORDER BY ?n LIMIT 10 OFFSET 5", f"SELECT {cust} AS c FROM customer ORDER BY c_name LIMIT 10 OFFSET 5"),
        "limit_zero": Entry("SELECT ?c { ?c c:c_name ?n } LIMIT 0", "SELECT CAST(NULL AS VARCHAR) AS c WHERE false"),
        "group_by": Entry("SELECT ?s (COUNT(?o) AS ?n) (AVG(?t) AS ?a) { ?o o:o_orderstatus ?s ; o:o_totalprice ?t } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus", {"n": N, "a": R}),
        "group_by_keys_only": Entry("SELECT ?s { ?o o:o_orderstatus ?s } GROUP BY ?s", "SELECT DISTINCT o_orderstatus AS s FROM orders"),
        "group_by_unbound": Entry("SELECT ?s (COUNT(*) AS ?n) { ?c c:c_name ?x OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus ?s } } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY o_orderstatus", {"n": N}),
        "group_by_empty": Entry("SELECT ?s (COUNT(*) AS ?n) { ?o o:nothing ?s } GROUP BY ?s", "SELECT CAST(NULL AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS n WHERE false", {"n": N}),
        "group_order_by_alias": Entry("SELECT ?c (COUNT(?o) AS ?n) { ?o o:o_custkey ?c } GROUP BY ?c ORDER BY DESC(?n) ?c LIMIT 10", f"SELECT {_iri('customer', 'o_custkey')} AS c, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, c LIMIT 10", {"n": N}),
        "count_star": Entry("SELECT (COUNT(*) AS ?n) { ?l l:l_quantity ?q }", "SELECT count(*) AS n FROM lineitem", {"n": N}),
        "count_star_empty": Entry("SELECT (COUNT(*) AS ?n) { ?l l:nothing ?q }", "SELECT CAST(0 AS BIGINT) AS n", {"n": N}),
        "count_distinct": Entry("SELECT (COUNT(DISTINCT ?q) AS ?n) (COUNT(?q) AS ?m) { ?l l:l_quantity ?q }", "SELECT count(DISTINCT l_quantity) AS n, count(l_quantity) AS m FROM lineitem", {"n": N, "m": N}),
        "sum": Entry("SELECT ?f (SUM(?q * ?d) AS ?v) { ?l l:l_returnflag ?f ; l:l_extendedprice ?q ; l:l_discount ?d } GROUP BY ?f", "SELECT l_returnflag AS f, round(sum(l_extendedprice * l_discount), 4) AS v FROM lineitem GROUP BY l_returnflag", {"v": R}),
        "sum_of_nothing": Entry("SELECT (SUM(?q) AS ?v) { ?l l:nothing ?q }", "SELECT CAST(0 AS DOUBLE) AS v", {"v": D}),
        "sum_distinct": Entry("SELECT (SUM(DISTINCT ?q) AS ?v) (AVG(DISTINCT ?q) AS ?a) { ?l l:l_quantity ?q }", "SELECT sum(DISTINCT l_quantity) AS v, avg(DISTINCT l_quantity) AS a FROM lineitem", {"v": D, "a": D}),
        "avg": Entry("SELECT ?m (AVG(?b) AS ?a) { ?c c:c_mktsegment ?m ; c:c_acctbal ?b } GROUP BY ?m", "SELECT c_mktsegment AS m, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment", {"a": R}),
        "min": Entry("SELECT ?m (MIN(?b) AS ?a) (MIN(?n) AS ?t) { ?c c:c_mktsegment ?m ; c:c_acctbal ?b ; c:c_name ?n } GROUP BY ?m", "SELECT c_mktsegment AS m, min(c_acctbal) AS a, min(c_name) AS t FROM customer GROUP BY c_mktsegment", {"a": D}),
        "max": Entry("SELECT ?m (MAX(?b) AS ?a) (MAX(?n) AS ?t) { ?c c:c_mktsegment ?m ; c:c_acctbal ?b ; c:c_name ?n } GROUP BY ?m", "SELECT c_mktsegment AS m, max(c_acctbal) AS a, max(c_name) AS t FROM customer GROUP BY c_mktsegment", {"a": D}),
        "sample": Entry("SELECT ?m (SAMPLE(?m) AS ?t) { ?c c:c_mktsegment ?m } GROUP BY ?m", "SELECT DISTINCT c_mktsegment AS m, c_mktsegment AS t FROM customer"),
        "pricing_summary": Entry("SELECT ?f ?s (SUM(?q) AS ?sq) (SUM(?e * (1 - ?d)) AS ?rev) (AVG(?q) AS ?aq) (COUNT(*) AS ?n) { ?l l:l_returnflag ?f ; l:l_linestatus ?s ; l:l_quantity ?q ; l:l_extendedprice ?e ; l:l_discount ?d } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sq, round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev, round(avg(l_quantity), 4) AS aq, count(*) AS n FROM lineitem GROUP BY ALL", {"sq": D, "rev": R, "aq": R, "n": N}),
        "revenue_by_nation": Entry("SELECT ?nn (SUM(?e) AS ?rev) (COUNT(*) AS ?n) { ?l l:l_orderkey ?o ; l:l_extendedprice ?e . ?o o:o_custkey ?c ; o:o_orderstatus \"F\" . ?c c:c_nationkey ?na . ?na n:n_name ?nn } GROUP BY ?nn ORDER BY DESC(?rev)", "SELECT n_name AS nn, round(sum(l_extendedprice), 4) AS rev, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name", {"rev": R, "n": N}),
        "documents_of_label": Entry("SELECT ?src (COUNT(*) AS ?n) { ?doc x:source ?src ; x:lang \"en\" . ?lab lb:doc_id ?doc ; lb:quality 1 } GROUP BY ?src", "SELECT source AS src, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en' AND quality = 1 GROUP BY source", {"n": N}),
        "events_by_type": Entry("SELECT ?t (COUNT(?e) AS ?n) (MAX(?v) AS ?m) { ?e e:event_type ?t ; e:value ?v } GROUP BY ?t", "SELECT event_type AS t, count(*) AS n, max(value) AS m FROM events GROUP BY event_type", {"n": N, "m": D}),
    }
    # functions that tell kinds of terms apart, over variables that hold several
    mixed = "{ ?x c:c_nationkey ?v } UNION { ?x c:c_name ?v } UNION { ?x c:c_mktsegment ?v }"
    sizes = "{ ?x p:p_size ?v } UNION { ?x p:p_type ?v }"
    names = f"SELECT {cust} AS x, c_name AS v FROM customer UNION ALL SELECT {cust}, c_mktsegment FROM customer"
    numbers, types = (f"SELECT {_iri('part', 'p_partkey')} AS x, {c} AS v FROM part" for c in ("CAST(p_size AS VARCHAR)", "p_type"))
    found |= {
        "fn_bound": Entry("SELECT ?c ?o { ?c c:c_name ?n OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus \"F\" } FILTER (BOUND(?o) && BOUND(?n)) }", f"SELECT {cust} AS c, {order} AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"),
        "fn_isiri": Entry(f"SELECT ?x ?v {{ {mixed} FILTER (isIRI(?v)) }}", f"SELECT {cust} AS x, {nation} AS v FROM customer"),
        "fn_isuri": Entry(f"SELECT ?x ?v {{ {mixed} FILTER (!isURI(?v)) }}", names),
        "fn_isliteral": Entry(f"SELECT ?x ?v {{ {mixed} FILTER (isLiteral(?v)) }}", names),
        "fn_isnumeric": Entry(f"SELECT ?x ?v {{ {sizes} FILTER (isNumeric(?v)) }}", numbers),
        "fn_datatype": Entry(f"SELECT ?x ?v {{ {sizes} FILTER (DATATYPE(?v) = xsd:string) }}", types),
        "fn_regex_of_data": Entry("SELECT ?x ?y { ?x r:r_name ?n . ?y n:n_name ?m FILTER (REGEX(?m, SUBSTR(?n, 1, 1)) || REGEX(?n, \"[\")) }", f"SELECT {_iri('region', 'r_regionkey')} AS x, {_iri('nation', 'n_nationkey')} AS y FROM region, nation WHERE regexp_matches(n_name, substr(r_name, 1, 1))"),
        "count_distinct_star": Entry("SELECT (COUNT(DISTINCT *) AS ?n) { { ?o o:o_orderstatus ?s } UNION { ?o o:o_orderpriority ?p } }", "SELECT 2 * count(*) AS n FROM orders", {"n": N}),
        "select_star_hidden": Entry("SELECT * { [] n:n_name ?n ; n:n_regionkey ?r }", f"SELECT {_iri('nation', 'n_nationkey')} AS _bnode_anon0, n_name AS n, {_iri('region', 'n_regionkey')} AS r FROM nation"),
        "sum_distinct_by_group": Entry("SELECT ?f (SUM(DISTINCT ?q) AS ?v) (COUNT(*) AS ?n) (AVG(DISTINCT ?t) AS ?a) { ?l l:l_returnflag ?f ; l:l_quantity ?q ; l:l_tax ?t } GROUP BY ?f", "SELECT l_returnflag AS f, sum(DISTINCT l_quantity) AS v, count(*) AS n, round(avg(DISTINCT l_tax), 4) AS a FROM lineitem GROUP BY l_returnflag", {"v": D, "n": N, "a": R}),
        "join_maybe_unbound": Entry("SELECT ?c ?o ?s { { ?c c:c_mktsegment \"BUILDING\" OPTIONAL { ?o o:o_custkey ?c ; o:o_orderpriority \"5-LOW\" } } { { ?o o:o_orderstatus \"P\" ; o:o_orderpriority ?s } UNION { ?z r:r_name ?s } } }", f"WITH a AS (SELECT {cust} AS c, {order} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '5-LOW' WHERE c_mktsegment = 'BUILDING'), b AS (SELECT {order} AS o, o_orderpriority AS s FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT NULL, r_name FROM region) SELECT a.c, coalesce(a.o, b.o) AS o, b.s FROM a JOIN b ON a.o = b.o OR a.o IS NULL OR b.o IS NULL"),
        "order_by_kinds": Entry("SELECT ?x ?v { { ?x n:n_regionkey ?v } UNION { ?x r:r_name ?v } UNION { ?x r:r_regionkey ?v } } ORDER BY DESC(?v) ?x LIMIT 14", f"SELECT x, v FROM (SELECT {_iri('nation', 'n_nationkey')} AS x, {_iri('region', 'n_regionkey')} AS v, 0 AS kind FROM nation UNION ALL SELECT {_iri('region', 'r_regionkey')}, r_name, 2 FROM region UNION ALL SELECT {_iri('region', 'r_regionkey')}, CAST(r_regionkey AS VARCHAR), 1 FROM region) ORDER BY kind DESC, v DESC, x LIMIT 14"),
    }
    return found


FLAGSHIP = "SELECT ?nn (COUNT(?o) AS ?n) (SUM(?t) AS ?total) { ?o o:o_custkey ?c ; o:o_totalprice ?t . ?c c:c_nationkey ?na . ?na n:n_name ?nn FILTER (?t > 1000) } GROUP BY ?nn ORDER BY DESC(?total) LIMIT 10"


def run_entry(e: Entry, spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = Engine(RelationalSource(spark, sf_dir)).run(PREFIXES + e.sparql, **e.options)
    return outcome.native(**e.types)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_entry(Entry(FLAGSHIP, "", {"n": N, "total": R}), spark, sf_dir)


__all__ = ["FLAGSHIP", "Entry", "T", "entries", "flagship", "run_entry"]
