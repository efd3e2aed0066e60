"""Queries over stored quads made from the test tables: graphs, inference, round trips, saving."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.rdfs import DOMAIN, RANGE, SUB_CLASS, SUB_PROPERTY
from ..operators.store import QuadStore, shared_folder
from ..session import Engine
from ..sources.readers import read_nquads, read_ntriples, read_turtle
from ..sources.relational import RelationalSource
from .catalogue import PREFIXES

PEOPLE = ("region", "nation", "customer", "supplier")


def table_quads(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = PEOPLE) -> DataFrame:
    """The tables' triples, stored as quads of the default graph."""
    source = RelationalSource(spark, sf_dir)
    found = source.triples(tables)
    return found.select(F.lit(None).cast(T.TERM).alias("g"), "s", "p", "o")


def _store(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = PEOPLE) -> QuadStore:
    return QuadStore(table_quads(spark, sf_dir, tables))


def _graphs(spark: SparkSession, sf_dir: str) -> QuadStore:
    """Nations in the default graph, and each again in the graph of its region."""
    quads = table_quads(spark, sf_dir, ("nation",))
    region = quads.where(F.col("p.v") == "http://d/nation#n_regionkey").select(F.col("o").alias("g"), F.col("s").alias("_s"))
    named = quads.drop("g").join(region, F.col("s") == F.col("_s")).select("g", "s", "p", "o")
    return QuadStore(quads.unionByName(named))


def _schema(spark: SparkSession) -> DataFrame:
    d = lambda x: T.iri(f"http://d/{x}")
    facts = [
        (d("customer"), T.iri(SUB_CLASS), d("party")), (d("supplier"), T.iri(SUB_CLASS), d("party")), (d("party"), T.iri(SUB_CLASS), d("agent")),
        (d("customer#c_nationkey"), T.iri(SUB_PROPERTY), d("livesIn")), (d("supplier#s_nationkey"), T.iri(SUB_PROPERTY), d("livesIn")),
        (d("livesIn"), T.iri(RANGE), d("place")), (d("nation#n_regionkey"), T.iri(DOMAIN), d("place")),
    ]
    return QuadStore.of(spark, facts).quads


def _rdfs(spark: SparkSession, sf_dir: str) -> QuadStore:
    return QuadStore(table_quads(spark, sf_dir).unionByName(_schema(spark)))


def _ask(store: QuadStore, text: str, options: dict[str, bool] | None = None, **types: str) -> DataFrame:
    return Engine(store).run(PREFIXES + text, **(options or {})).native(**types)


def store_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(_store(spark, sf_dir), "SELECT ?cn ?rn { ?c c:c_name ?cn ; c:c_nationkey ?n ; c:c_mktsegment \"BUILDING\" . ?n n:n_regionkey ?r . ?r r:r_name ?rn }")


def graph_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(_graphs(spark, sf_dir), "SELECT ?n { GRAPH <http://d/region/1> { ?x n:n_name ?n } }")


def graph_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(_graphs(spark, sf_dir), "SELECT ?g (COUNT(?x) AS ?n) { GRAPH ?g { ?x n:n_name ?m ; n:n_regionkey ?r } } GROUP BY ?g", n="bigint")


def graph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """?g is bound by the default graph and met again in GRAPH ?g."""
    return _ask(_graphs(spark, sf_dir), "SELECT ?a ?g { <http://d/nation/3> n:n_regionkey ?g GRAPH ?g { ?x n:n_name ?a } }")


def graph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir).graphs().select(F.col("g.v").alias("g"))


def rdfs_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _rdfs(spark, sf_dir).materialise_rdfs()
    return _ask(store, "SELECT ?t (COUNT(?x) AS ?n) { ?x a ?t } GROUP BY ?t", n="bigint")


def rdfs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = _rdfs(spark, sf_dir).materialise_rdfs()
    return spark.createDataFrame([(s.before, s.after, s.inferred, s.rounds)], "before bigint, after bigint, inferred bigint, rounds bigint")


def rdfs_query_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(_rdfs(spark, sf_dir), "SELECT ?x { ?x a d:agent }", {"rdfs_query_time": True})


def rdfs_query_time_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(_rdfs(spark, sf_dir), "SELECT ?x ?n { ?x d:livesIn ?n . ?n a d:place }", {"rdfs_query_time": True})


def _by_predicate(quads: DataFrame) -> DataFrame:
    return QuadStore(quads).quads.groupBy(F.col("p.v").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("o")).alias("objects"))


def nt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/nt-{uuid.uuid4().hex}"
    _store(spark, sf_dir, ("nation", "supplier")).write_ntriples(path)
    return _by_predicate(read_ntriples(spark, path, scope=""))


def nq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/nq-{uuid.uuid4().hex}"
    _graphs(spark, sf_dir).write_nquads(path)
    back = QuadStore(read_nquads(spark, path, scope="")).quads
    return back.groupBy(F.col("g.v").alias("g")).agg(F.count(F.lit(1)).alias("n"))


def save_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    _store(spark, sf_dir, ("nation", "supplier")).save(path)
    return _by_predicate(QuadStore.open(spark, path).quads)


def store_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, ("region", "nation")).terms().groupBy(F.col("term.k").cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _tagged(spark: SparkSession, sf_dir: str) -> QuadStore:
    """Each document's source, tagged with its language (a third of them British), on a blank node for even ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null and lang is not null")
    name, even = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("doc_id") % 2 == 0
    node = T.make(F.when(even, T.BLANK).otherwise(T.IRI), F.when(even, name).otherwise(F.concat(F.lit("http://d/documents/"), name)))
    tag = F.concat(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "-gb").otherwise(""))
    o = T.make(F.lit(T.LITERAL), F.col("source"), tag, F.lit(T.LANG_STRING))
    return QuadStore(docs.select(F.lit(None).cast(T.TERM).alias("g"), node.alias("s"), T.constant(T.iri("http://d/documents#source")).alias("p"), o.alias("o")))


def _of_tagged(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return _ask(_tagged(spark, sf_dir), f"SELECT ?t (COUNT(*) AS ?n) {{ ?s x:source ?t FILTER ({condition}) }} GROUP BY ?t", n="bigint")


def fn_isblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_tagged(spark, sf_dir, "isBlank(?s)")


def fn_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_tagged(spark, sf_dir, 'LANG(?t) = "en"')


def fn_langmatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_tagged(spark, sf_dir, 'LANGMATCHES(LANG(?t), "EN") && !LANGMATCHES(LANG(?t), "de")')


def turtle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Triples are Turtle: files of them, read by the Turtle reader in small pieces."""
    path = f"{shared_folder(spark)}/ttl-{uuid.uuid4().hex}"
    _store(spark, sf_dir, ("nation", "supplier")).write_ntriples(path)
    return _by_predicate(read_turtle(spark, path, scope="", chunk=4096))


def append_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations saved, suppliers (and nations again) appended, and all saved once more to the same path."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    store = _store(spark, sf_dir, ("nation",)).save(path).append(table_quads(spark, sf_dir, ("nation", "supplier")))
    return _by_predicate(store.save(path).quads)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (store_chain, graph_iri, graph_var, graph_join, graph_names, rdfs_materialise, rdfs_stats, rdfs_query_time, rdfs_query_time_property, nt_round_trip, nq_round_trip, save_open, store_terms, fn_isblank, fn_lang, fn_langmatches, turtle_files, append_save)
}

_TRIPLE_COUNTS = """
SELECT p, count(*) AS n, count(DISTINCT o) AS objects FROM (
  SELECT 'http://d/nation#n_nationkey' AS p, CAST(n_nationkey AS VARCHAR) AS o FROM nation UNION ALL SELECT 'http://d/nation#n_name', n_name FROM nation
  UNION ALL SELECT 'http://d/nation#n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'http://d/supplier#s_suppkey', CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'http://d/supplier#s_name', s_name FROM supplier UNION ALL SELECT 'http://d/supplier#s_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'http://d/supplier#s_acctbal', CAST(s_acctbal AS VARCHAR) FROM supplier
  UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'nation' FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'supplier' FROM supplier)
GROUP BY p
"""
_AGENTS = "SELECT 'http://d/customer/' || c_custkey AS x FROM customer UNION ALL SELECT 'http://d/supplier/' || s_suppkey FROM supplier"

SQL = {
    "store_chain": "SELECT c_name AS cn, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'",
    "graph_iri": "SELECT n_name AS n FROM nation WHERE n_regionkey = 1",
    "graph_var": "SELECT 'http://d/region/' || n_regionkey AS g, count(*) AS n FROM nation GROUP BY n_regionkey",
    "graph_join": "SELECT n_name AS a, 'http://d/region/' || n_regionkey AS g FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)",
    "graph_names": "SELECT DISTINCT 'http://d/region/' || n_regionkey AS g FROM nation",
    "rdfs_materialise": """
SELECT 'http://d/region' AS t, count(*) AS n FROM region UNION ALL SELECT 'http://d/nation', count(*) FROM nation UNION ALL SELECT 'http://d/customer', count(*) FROM customer
UNION ALL SELECT 'http://d/supplier', count(*) FROM supplier UNION ALL SELECT 'http://d/place', count(*) FROM nation
UNION ALL SELECT 'http://d/party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'http://d/agent', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
""",
    "rdfs_stats": """
SELECT before, before + inferred AS after, inferred, CAST(2 AS BIGINT) AS rounds FROM (
  SELECT 3 * (SELECT count(*) FROM region) + 4 * (SELECT count(*) FROM nation) + 6 * (SELECT count(*) FROM customer) + 5 * (SELECT count(*) FROM supplier) + 7 AS before,
         (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM customer) + 3 * (SELECT count(*) FROM supplier) + 2 AS inferred)
""",
    "rdfs_query_time": _AGENTS,
    "rdfs_query_time_property": "SELECT 'http://d/customer/' || c_custkey AS x, 'http://d/nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'http://d/supplier/' || s_suppkey, 'http://d/nation/' || s_nationkey FROM supplier",
    "nt_round_trip": _TRIPLE_COUNTS,
    "nq_round_trip": "SELECT CAST(NULL AS VARCHAR) AS g, 4 * count(*) AS n FROM nation UNION ALL SELECT 'http://d/region/' || n_regionkey, 4 * count(*) FROM nation GROUP BY n_regionkey",
    "save_open": _TRIPLE_COUNTS,
    "turtle_files": _TRIPLE_COUNTS,
    "append_save": _TRIPLE_COUNTS,
    "fn_isblank": "SELECT source AS t, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 2 = 0 GROUP BY source, lang, doc_id % 3 = 0",
    "fn_lang": "SELECT source AS t, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang = 'en' AND doc_id % 3 <> 0 GROUP BY source",
    "fn_langmatches": "SELECT source AS t, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang = 'en' GROUP BY source, doc_id % 3 = 0",
    "store_terms": "SELECT CAST(1 AS INTEGER) AS kind, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 8 AS n UNION ALL SELECT 3, (SELECT count(DISTINCT k) FROM (SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation)) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)",
}

__all__ = ["QUERIES", "SQL", "table_quads"]
