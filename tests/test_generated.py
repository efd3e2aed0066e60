"""The generated bibliography: published counts, and answers that must agree with each other."""

import pytest

from quadrille.session import Engine
from quadrille.sources.generator import Spec, bibliography
from quadrille.sources.rdf import parse_turtle
from quadrille.sources.readers import load_text

P = "PREFIX ex: <http://example.org/> "


def test_published_counts():
    triples = set(parse_turtle(bibliography(Spec.sized(1000))))
    assert len(triples) == 10_462 and len({t for x in triples for t in x}) == 2_135


@pytest.fixture(scope="module")
def papers(spark):
    return load_text(spark, bibliography(Spec(200, 50, 8, 10, 12))).cached()


@pytest.mark.parametrize(("name", "n"), [("Paper", 200), ("Author", 50), ("Venue", 8), ("Organisation", 10), ("Topic", 12)])
def test_classes(papers, name, n):
    assert Engine(papers).count(P + f"SELECT ?x {{ ?x a ex:{name} }}") == n


def test_venues_sum_to_papers(papers):
    rows = Engine(papers).run(P + "SELECT ?v (COUNT(?p) AS ?n) { ?p ex:venue ?v } GROUP BY ?v").native(n="bigint").collect()
    assert sum(r.n for r in rows) == 200


@pytest.mark.parametrize("pattern", ["?p ex:title ?t ; ex:year ?y", "?p ex:mainAuthor ?a . ?a ex:affiliation ex:org3 . ?p ex:title ?t", "?p ex:mainAuthor ?a . ?q ex:author ?a", "?p ex:citationCount ?c FILTER(?c > 100)", "?a ex:name ?n OPTIONAL { ?a ex:homepage ?h }"])
def test_plans_agree(papers, pattern):
    e = Engine(papers)
    q = P + f"SELECT * {{ {pattern} }}"
    assert e.count(q) == e.count(q, naive_join_order=True) == e.count(q, enable_merge_join=False)


def test_rdfs(papers):
    store, _ = papers.materialise_rdfs()
    for name, n in (("Agent", 60), ("Work", 200)):
        assert Engine(store).count(P + f"SELECT ?x {{ ?x a ex:{name} }}") == n == Engine(papers).count(P + f"SELECT ?x {{ ?x a ex:{name} }}", rdfs_query_time=True)


def test_limit_is_a_prefix_of_the_order(papers):
    e, q = Engine(papers), P + "SELECT ?p ?c { ?p ex:citationCount ?c } ORDER BY DESC(?c) ?p"
    assert e.run(q + " LIMIT 10").collect() == e.run(q).collect()[:10]
