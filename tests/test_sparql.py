"""The query language: what is accepted, what is rejected, and how it is read."""

import pytest

from quadrille.plans.algebra import Bgp, Distinct, Filter, Group, Join, LeftJoin, Op, OrderBy, Project, Slice, Union, Var, mentioned, show
from quadrille.plans.parser import parse
from quadrille.sources.tokens import ParseError

P = "PREFIX e: <http://e/> "
GOOD = [
    "SELECT ?s { ?s ?p ?o }", "SELECT $s WHERE { $s ?p ?o . }", "SELECT * { }", "SELECT DISTINCT ?s { ?s a e:C }", "select reduced ?s where { ?s e:p e:o, 'x'@en ; e:q 4.5 ; }", "BASE <http://e/> SELECT ?s { ?s <p> <o> }",
    "SELECT ?s { ?s ?p ?o FILTER (?o > 3 && ?o < 9 || !BOUND(?o)) }", "SELECT ?s { ?s ?p ?o FILTER regex(?o, \"^a\", \"i\") }", "SELECT ?s { ?s ?p ?o FILTER(STRLEN(STR(?o)) = 4) . ?s e:q ?z }",
    "SELECT * { ?s ?p ?o OPTIONAL { ?o ?q ?r FILTER(?r > 1) } }", "SELECT * { { ?s a e:A } UNION { ?s a e:B } UNION { ?s a e:C } }", "SELECT * { { ?s ?p ?o } }", "SELECT ?s { ?s ?p ?o } ORDER BY ?o DESC(?s) (?o + 1) LIMIT 5 OFFSET 2",
    "SELECT ?s { ?s ?p ?o } OFFSET 2 LIMIT 5", "SELECT ?p (COUNT(DISTINCT ?o) AS ?n) { ?s ?p ?o } GROUP BY ?p", "SELECT (SUM(?o * 2) AS ?a) (AVG(?o) AS ?b) (MIN(?o) AS ?c) (MAX(?o) AS ?d) (SAMPLE(?o) AS ?f) (COUNT(*) AS ?n) { ?x ?p ?o }",
    "SELECT ?o { [] e:p ?o . _:b e:q ?o }", "SELECT * { GRAPH e:g { ?s ?p ?o } GRAPH ?g { ?s e:p true } }", "SELECT ?s { ?s e:p -1 FILTER(?s<?o && ?o>-2 && -?o < +3) }", "SELECT ?s { ?s e:p ?o } # end",
]
BAD = [
    "WHERE { ?s ?p ?o }", "SELECT WHERE { ?s ?p ?o }", "SELECT * { ?s ?p ?o", "SELECT * { ?s ?p ?o FILTER (?o > 3 }", "SELECT * { ?s ?p ?o FILTER (NOSUCH(?o)) }", "SELECT * { ?s u:q ?o }", "ASK { ?s ?p ?o }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "DESCRIBE <a:b>",
    "SELECT * { SERVICE <a:b> { ?s ?p ?o } }", "SELECT * { ?s ?p ?o BIND (1 AS ?x) }", "SELECT * { VALUES ?s { e:x } }", "SELECT * { ?s ?p ?o MINUS { ?s a e:C } }", "SELECT ?p { ?s ?p ?o } GROUP BY ?p HAVING (COUNT(?o) > 1)", "SELECT * { ?s e:p/e:q ?o }", "SELECT * { ?s ^e:p ?o }",
    "SELECT * { ?s ?p ?o } LIMIT 1 more", "SELECT * { ?s ?p ?o } LIMIT ?x", "SELECT * { ?s ?p ?o } LIMIT -1", "SELECT (COUNT(*)) { ?s ?p ?o }", "SELECT (SUM(*) AS ?n) { ?s ?p ?o }", "SELECT (?x + 1 AS ?y) { ?s ?p ?x }", "SELECT * { ?s ?p ?o } GROUP BY (?s)", "SELECT * { ?s ?p ?o } ORDER BY",
    "SELECT * { ?s ?p ?o FILTER(1 < ?o < 3) }", "SELECT * { \"x\" ?p ?o }", "SELECT * { ?s \"x\" ?o }", "SELECT * { ?s ?p ?o FILTER(EXISTS { ?s a ?o }) }", "SELECT * { ?s ?p ?o FILTER(?o IN (1, 2)) }", "SELECT * { ?s ?p ?o FILTER(CONTAINS(?o)) }", "SELECT * { ?s ?p [ e:q ?o ] }", "SELECT * FROM <a:g> { ?s ?p ?o }",
]


@pytest.mark.parametrize("text", GOOD)
def test_accepted(text):
    assert show(parse(P + text).root)


@pytest.mark.parametrize("text", BAD)
def test_rejected_with_a_place(text):
    with pytest.raises(ParseError) as e:
        parse(P + text)
    assert e.value.line >= 1 and e.value.column >= 1 and e.value.message


def root(text):
    return parse(P + text).root


def test_modifiers_nest():
    r = root("SELECT DISTINCT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p ORDER BY DESC(?n) LIMIT 3")
    assert isinstance(r, Slice) and isinstance(r.child, Distinct) and isinstance(r.child.child, Project)
    assert isinstance(r.child.child.child, OrderBy) and isinstance(r.child.child.child.child, Group)


def test_filters_hold_for_the_whole_group():
    r = root("SELECT * { FILTER(?o > 1) ?s ?p ?o FILTER(?o < 3) ?s e:q ?z }").child
    assert isinstance(r, Filter) and isinstance(r.child, Filter) and isinstance(r.child.child, Bgp) and len(r.child.child.triples) == 2


def test_all_top_filters_of_optional_become_its_condition():
    r = root("SELECT * { ?s ?p ?o OPTIONAL { ?s e:q ?z FILTER(?z > ?o) FILTER(?z < 9) } }").child
    assert isinstance(r, LeftJoin) and len(r.conditions) == 2 and isinstance(r.right, Bgp)


def test_groups_and_unions_join():
    r = root("SELECT * { ?a ?b ?c { ?a e:x ?d } UNION { ?a e:y ?d } OPTIONAL { ?d e:z ?f } }").child
    assert isinstance(r, LeftJoin) and isinstance(r.left, Join) and isinstance(r.left.right, Union)


def test_precedence():
    e = root("SELECT * { FILTER(?a || ?b && ?c = 1 + 2 * 3) }").child.condition
    assert e.name == "||" and e.args[1].name == "&&" and e.args[1].args[1].name == "=" and e.args[1].args[1].args[1].name == "+"
    assert isinstance(e.args[1].args[1].args[1].args[1], Op)


def test_star_takes_what_the_body_mentions():
    q = parse(P + "SELECT * { _:b e:p ?o FILTER(?z > 1) } ORDER BY ?w")
    assert q.projection == ["_bnode_b", "o", "z"] and Var("_bnode_b").hidden
    assert mentioned(q.root) == ["_bnode_b", "o", "z"]
