"""Readers of Turtle, N-Triples and N-Quads, and the writers' lines."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.functions.terms import BLANK, DECIMAL, DOUBLE, INTEGER, LANG_STRING, RDF, Term, iri, literal
from quadrille.sources.rdf import parse_nquads, parse_ntriples, parse_turtle
from quadrille.sources.tokens import ParseError, resolve

P = "@prefix e: <http://e/> .\n"


def lines(text: str, **options) -> list[str]:
    return [" ".join(map(str, t)) for t in parse_turtle(P + text, **options)]


def test_lists_of_predicates_and_objects():
    assert lines("e:s a e:C ; e:p e:a , e:b ; .") == [
        "<http://e/s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/C>",
        "<http://e/s> <http://e/p> <http://e/a>",
        "<http://e/s> <http://e/p> <http://e/b>",
    ]


def test_literals():
    got = [t[2] for t in parse_turtle(P + """e:s e:p "x"@EN-gb, 1, -2.5, 3e4, true, 'q', "7"^^e:t, '''a
b''' .""")]
    assert got[0] == Term(3, "x", "en-gb", LANG_STRING)
    assert [(t.v, t.d) for t in got[1:4]] == [("1", INTEGER), ("-2.5", DECIMAL), ("3e4", DOUBLE)]
    assert got[4].v == "true" and got[5] == literal("q") and got[6].d == "http://e/t" and got[7].v == "a\nb"
    assert got[1].n == 1 and got[2].n == -2.5 and got[3].n == 30000 and got[5].n is None


def test_plain_literal_is_xsd_string():
    assert literal("x") == parse_ntriples('<a:s> <a:p> "x"^^<http://www.w3.org/2001/XMLSchema#string> .')[0][2]
    assert str(literal("x")) == '"x"' and literal("1", datatype=INTEGER) != literal("01", datatype=INTEGER)


def test_escapes():
    t = parse_ntriples(r'<a:s> <a:p> "tab\there \"q\" \\ é \U0001F600" .')[0][2]
    assert t.v == 'tab\there "q" \\ é 😀'
    assert str(Term(3, 'a"\\\n\r\t', "", "")) == r'"a\"\\\n\r\t"'


def test_blank_nodes_and_collections():
    out = parse_turtle(P + "e:s e:p [ e:q ( e:a e:b ) ], () . [ e:x 1 ] .", scope="f")
    assert len(out) == 8 and {t.v for q in out for t in q if t.k == BLANK} == {"f_genid0", "f_genid1", "f_genid2", "f_genid3"}
    assert (iri("http://e/s"), iri("http://e/p"), iri(RDF + "nil")) in out
    assert parse_turtle("_:a <e:p> _:a .", scope="doc")[0][0].v == "doc_a"
    assert parse_turtle("_:a <e:p> _:a .")[0][0].v == "a"


def test_directives_and_names():
    assert lines("BASE <http://b/x/>\nprefix f: <y#>\nf:a.b f:p <../z> . # end")[0] == "<http://b/x/y#a.b> <http://b/x/y#p> <http://b/z>"
    assert lines("e:a:b%20 e:p e:é .")[0] == "<http://e/a:b%20> <http://e/p> <http://e/é>"


@pytest.mark.parametrize(("ref", "want"), [("", "http://a/b/c?q"), ("#f", "http://a/b/c?q#f"), ("?x", "http://a/b/c?x"), ("/r", "http://a/r"), ("d", "http://a/b/d"), ("./d", "http://a/b/d"), ("../d", "http://a/d"), ("../../d", "http://a/d"), ("x:y", "x:y"), ("//h/p", "http://h/p")])
def test_resolving(ref, want):
    assert resolve("http://a/b/c?q", ref) == want


BAD_TURTLE = [
    "e:s e:p e:o", "u:s e:p e:o .", "<http://e/a b> e:p e:o .", 'e:s e:p "open .', 'e:s e:p "a\nb" .', '"s" e:p e:o .', 'e:s "p" e:o .', 'e:s e:p "x"@ .', "@other <x> .", "e:s e:p ( e:a .", "e:s e:p [ e:q e:r .",
    "e:s e:p 1e .", "_: e:p e:o .", "e:s e:p .", "e:s .", r'e:s e:p "\q" .', "e:s e:p <http://e/o .", "@prefix e <http://e/> .", "e:s e:p e:o ; e:q .", "e:s e:p [ .", 'e:s e:p "x"^^ .',
]


@pytest.mark.parametrize("text", BAD_TURTLE)
def test_rejected_with_a_place(text):
    with pytest.raises(ParseError) as e:
        parse_turtle(P + text)
    assert e.value.line >= 1 and e.value.column >= 1 and e.value.message


def test_place_of_an_error():
    with pytest.raises(ParseError) as e:
        parse_turtle("<a:s> <a:p>\n   ; .")
    assert (e.value.line, e.value.column) == (2, 4)


@pytest.mark.parametrize("text", ["@prefix p: <http://a/> .", "<a:s> a <a:o> .", "<a:s> <a:p> <a:o> ; <a:q> <a:r> .", "<a:s> <a:p> <a:o> , <a:r> .", "<a:s> <a:p> 1 .", "<a:s> <a:p> ( ) .", "<a:s> <a:p> [ ] .", "<a:s> <a:p> 'x' .", '<a:s> <a:p> """x""" .', "<a:s> _:p <a:o> ."])
def test_ntriples_has_no_abbreviations(text):
    with pytest.raises(ParseError):
        parse_ntriples(text)


def test_ntriples_statements_need_no_lines():
    assert len(parse_ntriples("<a:s> <a:p> <a:o> . <a:s> <a:p>\n_:b . # c\n")) == 2


def test_nquads():
    out = parse_nquads('<a:s> <a:p> "x"@en <a:g> .\n<a:s> _:p <a:o> .\n_:s <a:p> _:o _:g .', scope="d")
    assert [q[3] for q in out] == [iri("a:g"), None, Term(BLANK, "d_g")] and out[1][1].k == BLANK


texts = st.text(st.characters(blacklist_categories=("Cs",)), max_size=20)


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from(["", "en", "de-at"]))
def test_round_trip_of_literals(text, lang):
    t = literal(text, lang=lang)
    # only these five are escaped on output; the rest of a text is as it is, within one line or not
    assert parse_ntriples(f"<a:s> <a:p> {t} .")[0][2] == t
