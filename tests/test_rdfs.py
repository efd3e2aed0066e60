"""Schemas beyond the driver's bounds, long chains, and row counts of plans."""

import random

import pytest

from quadrille import cli
from quadrille.functions import terms as T
from quadrille.operators import rdfs
from quadrille.operators.store import QuadStore
from quadrille.session import Engine
from quadrille.sources.readers import load_text
from quadrille.storage import settled

H = "@prefix e: <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . "
E = "PREFIX e: <http://e/> "


def iri(x):
    return T.iri(f"http://e/{x}")


def random_schema(rng, classes=12, properties=6):
    name = lambda kind, n: f"e:{kind}{rng.randrange(n)}"
    out = [f"{name('C', classes)} rdfs:subClassOf {name('C', classes)} ." for _ in range(classes)]
    out += [f"{name('p', properties)} rdfs:subPropertyOf {name('p', properties)} ." for _ in range(properties)]
    out += [f"{name('p', properties)} rdfs:{rng.choice(('domain', 'range'))} {name('C', classes)} ." for _ in range(4)]
    out += [f"e:x{i} a {name('C', classes)} ." for i in range(6)] + [f"e:x{i} {name('p', properties)} e:y{i} ." for i in range(6)]
    return out


#: Schemas that speak of themselves: a subproperty of subClassOf, of type, and rules of rdf:type.
OF_THEMSELVES = [
    "e:kind rdfs:subPropertyOf rdfs:subClassOf . e:A e:kind e:B . e:B rdfs:subClassOf e:C . e:x a e:A .",
    "e:isa rdfs:subPropertyOf rdf:type . e:x e:isa e:A . e:A rdfs:subClassOf e:B . e:B rdfs:subClassOf e:A .",
    "rdf:type rdfs:subPropertyOf e:about . rdf:type rdfs:range e:Class . e:x a e:A . e:A rdfs:subClassOf e:B .",
]


@pytest.mark.parametrize("data", [*OF_THEMSELVES, *(" ".join(random_schema(random.Random(i))) for i in range(2))])
def test_closed_on_executors_as_on_the_driver(spark, monkeypatch, data):
    store = load_text(spark, H + data)
    rows = lambda s: sorted(map(str, s.quads.select("s.v", "p.v", "o.v").collect()))
    here, stats = store.materialise_rdfs()
    expected = rows(here)
    monkeypatch.setattr(rdfs, "MAX_PAIRS", 0)
    there, wide = store.materialise_rdfs()
    assert rows(there) == expected and (wide.after, wide.inferred) == (stats.after, stats.inferred)


def test_too_many_statements_close_on_executors(spark, monkeypatch):
    store = load_text(spark, H + "e:A rdfs:subClassOf e:B . e:B rdfs:subClassOf e:C . e:x a e:A .")
    monkeypatch.setattr(rdfs, "MAX_SCHEMA", 1)
    assert store.materialise_rdfs()[1].inferred == 3


def test_transitive_pairs(spark):
    def closed(edges):
        df = spark.createDataFrame([(iri(a).row(), iri(b).row()) for a, b in edges], f"a {T.TERM}, b {T.TERM}")
        return sorted((r[0], r[1]) for r in rdfs.transitive(df, settled).select("a.v", "b.v").collect())

    rng = random.Random(5)
    for edges in ([], [(1, 2), (1, 2), (2, 1), (3, 3)], [(i, i + 1) for i in range(20)] + [(30 + rng.randrange(20), 30 + rng.randrange(20)) for _ in range(30)]):
        above = {}
        for a, b in edges:
            above.setdefault(iri(a), set()).add(iri(b))
        assert closed(edges) == sorted((a.v, b.v) for a in above for b in rdfs.reachable(above, a))


def test_chain_beyond_the_driver(spark, monkeypatch):
    """More pairs than the driver may hold, at the bounds lowered a hundredfold: 300 classes give 44 850."""
    monkeypatch.setattr(rdfs, "MAX_PAIRS", 10_000)
    n = 300
    chain = [(iri(f"C{i}"), T.iri(rdfs.SUB_CLASS), iri(f"C{i + 1}")) for i in range(n - 1)]
    store = QuadStore.of(spark, [*chain, (iri("x"), T.iri(T.TYPE), iri("C0"))])
    full, stats = store.materialise_rdfs()
    assert stats.after == n * (n - 1) // 2 + n and full.count(p=T.iri(T.TYPE)) == n


def test_chain_of_20_000_classes_at_query_time(spark):
    n = 20_000
    chain = [(iri(f"C{i}"), T.iri(rdfs.SUB_CLASS), iri(f"C{i + 1}")) for i in range(n)]
    store = QuadStore.of(spark, [*chain, (iri("x"), T.iri(T.TYPE), iri("C0")), (iri("y"), T.iri(T.TYPE), iri("C9")), (iri("z"), T.iri(T.TYPE), iri(f"C{n}"))])
    ask = lambda c: Engine(store).run(E + f"SELECT ?x {{ ?x a e:{c} }}", rdfs_query_time=True)
    assert ask(f"C{n}").count() == 3 and ask("C9").count() == 2 and ask("C0").count() == 1
    assert sum("scans" in x for x in ask(f"C{n}").notes) == 0


def test_append_to_a_closed_store_beyond_the_driver(spark, monkeypatch, tmp_path):
    store = load_text(spark, H + " ".join(f"e:C{i} rdfs:subClassOf e:C{i + 1} ." for i in range(30)) + " e:x a e:C0 .")
    monkeypatch.setattr(rdfs, "MAX_PAIRS", 20)
    saved = store.materialise_rdfs()[0].save(str(tmp_path / "s"))
    more = saved.append([(iri("y"), T.iri(T.TYPE), iri("C5"))], rdfs=True)
    assert more.quad_count() == saved.quad_count() + 26


DATA = H + "e:a e:p e:b , e:c ; e:q 1 . e:b e:q 2 . e:c e:q 3 ; e:r 4 ."


def test_row_counts(spark):
    out = Engine(load_text(spark, DATA)).run(E + "SELECT ?y ?n { ?x e:p ?y . ?y e:q ?n OPTIONAL { ?y e:r ?m } FILTER(?n > 2) }", row_counts=True)
    found = {what: n for _, what, n in out.counted()}
    assert found["?x http://e/p ?y" if "?x http://e/p ?y" in found else "?x <http://e/p> ?y"] == 2
    assert found["joined"] == 2 and found["LeftJoin"] == 2 and found["Project ?y ?n"] == 1
    assert next(n for what, n in found.items() if what.startswith("Filter")) == 1
    depths = [d for d, _, _ in out.counted()]
    assert depths[0] == 0 and max(depths) >= 4 and out.count() == 1 and len(out.profile().splitlines()) == len(depths)


def test_row_counts_change_no_result(spark):
    store = load_text(spark, DATA)
    for q in ("SELECT ?x { ?x e:q ?n } ORDER BY DESC(?n) LIMIT 2", "SELECT (COUNT(*) AS ?k) { { ?x e:p ?y } UNION { ?x e:r ?y } }", "SELECT DISTINCT ?x { ?x e:p ?y . ?y e:nothing ?z }", "SELECT ?x { ?x e:q ?n OPTIONAL { ?x e:r ?m } FILTER(!BOUND(?m)) }"):
        plain, counted = Engine(store).run(E + q), Engine(store).run(E + q, row_counts=True)
        assert plain.collect() == counted.collect() or sorted(map(str, plain.collect())) == sorted(map(str, counted.collect()))
        rows = counted.counted()
        assert rows[0][2] in (len(plain.collect()), None) and plain.counted() == []


def test_row_counts_of_rows_looked_up(spark):
    out = Engine(load_text(spark, DATA)).run(E + "SELECT * { ?x e:p ?y . ?y e:q ?n }", row_counts=True, lookup_from=0)
    assert any(x.startswith("looked up") for x in out.notes) and [n for _, what, n in out.counted() if what == "joined"] == [2]
    assert None not in [n for _, _, n in out.counted()]


def test_profile_on_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.ttl").write_text(DATA)
    assert cli.main([str(tmp_path / "a.ttl"), "-q", E + "SELECT ?x { ?x e:q ?n }", "--profile"]) == 0
    assert "           3  Project ?x" in capsys.readouterr().out
