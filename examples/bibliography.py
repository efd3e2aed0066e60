"""Ten queries over a generated bibliography, with their plans' notes and first solutions.

python examples/bibliography.py [papers]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from quadrille.session import Engine  # noqa: E402
from quadrille.sources.generator import Spec, bibliography  # noqa: E402
from quadrille.sources.readers import load_text  # noqa: E402

#: What each shows, and its text.
QUERIES = {
    "one pattern; LIMIT ends the scan early": "SELECT ?p ?title { ?p ex:title ?title } LIMIT 5",
    "a star; the smaller pattern comes first": "SELECT ?title { ?p ex:title ?title ; ex:venue ex:venue3 } ORDER BY ?title LIMIT 5",
    "a filter over a number and a text": 'SELECT ?title ?year ?name { ?p ex:year ?year ; ex:title ?title ; ex:mainAuthor ?a . ?a ex:name ?name FILTER (?year >= 2024 && CONTAINS(?title, "a")) } LIMIT 5',
    "OPTIONAL: authors without a homepage keep their row": "SELECT ?name ?page { ?a a ex:Author ; ex:name ?name OPTIONAL { ?a ex:homepage ?page } } ORDER BY ?name LIMIT 8",
    "UNION, DISTINCT and an order": "SELECT DISTINCT ?x { { ?x a ex:Venue } UNION { ?x a ex:Topic } } ORDER BY ?x LIMIT 8",
    "DISTINCT, a descending order and OFFSET": "SELECT DISTINCT ?year { ?p ex:year ?year } ORDER BY DESC(?year) LIMIT 6 OFFSET 2",
    "a count by group, sorted by it": "SELECT ?venue (COUNT(?p) AS ?papers) { ?p ex:venue ?venue } GROUP BY ?venue ORDER BY DESC(?papers) ?venue LIMIT 6",
    "several aggregates of one group": "SELECT ?topic (COUNT(*) AS ?n) (AVG(?c) AS ?mean) (MAX(?c) AS ?best) { ?p ex:topic ?topic ; ex:citationCount ?c } GROUP BY ?topic ORDER BY DESC(?mean) LIMIT 6",
    "a join on the object of both patterns": "SELECT ?a ?p ?q { ?p ex:mainAuthor ?a . ?q ex:author ?a } LIMIT 5",
    "a chain of four patterns, for which the order matters most": "SELECT ?title ?org { ?p ex:mainAuthor ?a ; ex:title ?title ; ex:venue ex:venue1 . ?a ex:affiliation ?org } LIMIT 5",
}


def main(papers: int = 2000) -> None:
    spark = SparkSession.builder.master("local[*]").appName("bibliography").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(load_text(spark, bibliography(Spec.sized(papers))).cached())
    for i, (shows, text) in enumerate(QUERIES.items(), 1):
        found = engine.run("PREFIX ex: <http://example.org/> " + text)
        print(f"\nQ{i}: {shows}\n{text}", *found.notes, found.table(8), sep="\n")
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
