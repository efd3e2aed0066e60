"""The command line, streaming ingest, the relational mapping and the driver's entry module."""

import importlib
import re
import subprocess
import sys
from pathlib import Path

import pytest

from quadrille import cli
from quadrille.functions import terms as T
from quadrille.operators.rdfs import RdfsSchema, proposals
from quadrille.operators.store import QuadStore
from quadrille.session import Engine
from quadrille.sources.generator import Spec, bibliography
from quadrille.sources.rdf import parse_piece, parse_turtle, pieces
from quadrille.sources.readers import load_text, read_turtle
from quadrille.sources.relational import RelationalSource
from quadrille.sources.tokens import ParseError
from quadrille.streaming.ingest import stream_into, streamed_store

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . e:x a e:A . e:A r:subClassOf e:B .")
    run = lambda *a: cli.main([*map(str, a)])
    query = "SELECT ?x { ?x a <http://e/B> }"
    assert run(tmp_path / "a.ttl", "-q", query) == 0 and capsys.readouterr().out.count("x") < 3
    assert run(tmp_path / "a.ttl", "-q", query, "--rdfs-query", "--plan", "--naive", "--no-merge") == 0 and "Project ?x" in capsys.readouterr().out
    assert run(tmp_path / "a.ttl", "--rdfs", "--save", tmp_path / "s", "--plain") == 0 and "1 inferred" in capsys.readouterr().out
    assert run("--open", tmp_path / "s", "-q", query) == 0 and "\nx" in capsys.readouterr().out
    assert run("--generate", 20, "-q", "SELECT ?p { ?p a <http://example.org/Paper> }", "--limit", 3) == 0 and "17 more" in capsys.readouterr().out
    assert run(tmp_path / "a.ttl", "-q", "SELECT") == 1 and "line 1" in capsys.readouterr().err
    assert run("--open", tmp_path / "none", "-q", query) == 1 and run() == 2 and run("--nosuch") == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text('<a:s> <a:p> "1" .\n')
    for name in ("", "b"):
        if name:
            (tmp_path / "in/b.nt").write_text('<a:s> <a:p> "1" . <a:s> <a:p> _:x .\n')
        q = stream_into(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    store = streamed_store(spark, str(tmp_path / "out"))
    assert store.triple_count() == 2 and store.count(o=None) == 2 and store.manifest.streams == {str(tmp_path / "cp"): 1}


@pytest.fixture(scope="module")
def tables(spark):
    return Engine(RelationalSource(spark, FOLDER))


def test_star_is_one_scan_without_join(tables):
    out = tables.run("PREFIX c: <http://d/customer#> SELECT ?n ?b { ?c c:c_name ?n ; c:c_acctbal ?b ; a <http://d/customer> FILTER(?b > 5000) }")
    plan = out.native(b="double")._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert physical.count("FileScan") == 1 and "Join" not in physical and "GreaterThan(c_acctbal,5000.0)" in physical and "c_mktsegment" not in physical


def test_rows_without_a_key_stay_apart(tables, spark):
    n = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert tables.run("SELECT DISTINCT ?l { ?l a <http://d/lineitem> }").count() == n


def test_foreign_keys_join(tables, spark):
    q = "PREFIX o: <http://d/orders#> PREFIX l: <http://d/lineitem#> SELECT * { ?x l:l_orderkey ?o . ?o o:o_orderstatus ?s }"
    assert tables.count(q) == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert tables.count("SELECT * { GRAPH ?g { ?s ?p ?o } }") == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_operators(tmp_path):
    """The rest works with the operators' folder and the pipeline gone."""
    for name in ("__spark_entry__.py", "quadrille"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "quadrille/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_operators():
    for f in (ROOT / "quadrille").rglob("*.py"):
        assert "llm" in f.parts or "llm" not in f.read_text().replace("quadrille.llm", "").lower() or f.name == "cli.py"
        if "llm" not in f.parts:
            assert "quadrille.llm" not in f.read_text() and "..llm" not in f.read_text()
    assert importlib.import_module("quadrille.session")


def test_save_to_the_path_of_an_opened_store(spark, tmp_path):
    e = lambda x: T.iri(f"http://e/{x}")
    path = str(tmp_path / "store")
    first = QuadStore.of(spark, [(e("a"), e("p"), e("b")), (e("a"), e("p"), e("b")), (e("a"), e("q"), T.literal("x"), e("g"))])
    assert (first.staged_count(), first.quad_count()) == (3, 2)
    opened = first.save(path)
    more = opened.add([(e("c"), e("p"), e("d"))]).save(path)
    assert (more.quad_count(), more.triple_count(), QuadStore.open(spark, path).quads.count()) == (3, 2, 3)
    assert opened.quads.count() == 2  # what was opened before is still there
    grown = more.append([(e("c"), e("p"), e("d")), (e("c"), e("r"), e("d")), (e("a"), e("q"), T.literal("x"), e("g")), (e("a"), e("q"), T.literal("x"))])
    assert (grown.quad_count(), grown.triple_count(), len(grown.manifest.parts), grown.quads.count()) == (5, 4, 1, 5)
    assert grown.stats["http://e/p"][0] == 2 and grown.size_bytes() > 0
    QuadStore.vacuum(spark, path)
    again = QuadStore.open(spark, path)
    assert again.quads.count() == 5 and again.count(p=e("p")) == 2 and Engine(again).count("SELECT * { ?s <http://e/r> ?o }") == 1
    assert QuadStore.empty(spark).save(str(tmp_path / "none")).quad_count() == 0
    with pytest.raises(ValueError):
        QuadStore.open(spark, str(tmp_path / "nothing"))


def test_documents_cut_into_pieces(spark, tmp_path):
    """Statements with dots in strings, names, numbers, comments, IRIs and brackets; the same triples however small the pieces."""
    body = """e:a e:b "x. y" ; e:c \"\"\"long " .
 text. \"\"\" , 'a\\'. b' , <http://x/a.b.> . # end .
[ e:p e:q ; e:r ( 1 2.5 [ e:z "]. " ] ) ] e:s 1.5e3 .
e:a.b e:c 1 . e:x e:y 'z'@en-gb, "",'' , \"\"\"\"\"\" .
e:l e:m true.
"""
    text = "@prefix e: <http://e/> . # . \n" + body * 12
    plain = lambda triples: [tuple(re.sub("genid.*", "genid", t.v) for t in x) for x in triples]
    want = plain(parse_turtle(text))
    for chunk in (1, 60, 333, 10**6):
        found = list(pieces(text, chunk))
        assert "".join(p.text for p in found) == text[found[0].at :] and plain(t for p in found for t in parse_piece(p)) == want
        assert chunk > 333 or len(found) > 5
    assert len(list(pieces(text + "@prefix e: <http://f/> . e:a e:b e:c .", 60))) == 1
    errors = []
    for chunk in (60, 10**6):
        with pytest.raises(ParseError) as e:
            [parse_piece(p) for p in pieces(text + "e:a e:b\n  ??? .\n", chunk)]
        errors.append((e.value.line, e.value.column))
    assert errors[0] == errors[1]
    path = tmp_path / "doc.ttl"
    path.write_text(text)
    assert QuadStore(read_turtle(spark, str(path), chunk=100)).quad_count() == QuadStore(read_turtle(spark, str(path))).quad_count()


def test_a_round_of_rules_is_one_join(spark):
    quads = load_text(spark, "@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . e:p r:subPropertyOf e:q . e:q r:domain e:C . e:C r:subClassOf e:D . e:x e:p e:y .").quads
    plan = proposals(quads.select("s", "p", "o"), RdfsSchema.collect(quads).closed())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "BroadcastHashJoin" in plan


def test_rules_about_the_vocabulary_itself(spark):
    """rdf:type has a superproperty and a domain; subClassOf has a subproperty."""
    store = load_text(spark, """@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix t: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
        t:type r:subPropertyOf e:is . t:type r:domain e:Thing . e:under r:subPropertyOf r:subClassOf . e:A e:under e:B . e:x a e:A .""")
    closed, stats = store.materialise_rdfs()
    e = lambda x: T.iri(f"http://e/{x}")
    assert closed.count(s=e("x"), p=T.iri(T.TYPE)) == 3 and closed.count(s=e("x"), p=e("is")) == 3 and stats.rounds >= 3
    assert closed.materialise_rdfs()[1].inferred == 0


def test_constant_subjects_reach_the_scan(spark):
    engine = Engine(RelationalSource(spark, "/root/testdata/sf0.001"))
    plan = engine.run("SELECT ?n { <http://d/customer/7> <http://d/customer#c_name> ?n }").plan()
    assert "EqualTo(c_custkey,7)" in plan
    for subject, n in (("customer/7", 1), ("customer/07", 0), ("customer/x", 0), ("customer/", 0), ("nation/7", 0), ("customer/99999999999999999999", 0)):
        assert engine.count(f"SELECT ?n {{ <http://d/{subject}> <http://d/customer#c_name> ?n }}") == n
    assert engine.count("SELECT ?p ?o { <http://d/nation/3> ?p ?o }") == 4


def test_merge_and_hash_are_asked_for(spark):
    engine = Engine(load_text(spark, "@prefix e: <http://e/> . e:a e:p e:b . e:c e:q e:b ."))
    text = "SELECT * { ?x <http://e/p> ?y . ?z <http://e/q> ?y }"
    assert "SortMergeJoin" in engine.run(text, enable_merge_join=True).plan() and "ShuffledHashJoin" in engine.run(text, enable_merge_join=False).plan()
    assert engine.count(text) == engine.count(text, enable_merge_join=True) == 1


def test_joins_on_variables_that_may_be_unbound_have_keys(spark):
    engine = Engine(load_text(spark, "@prefix e: <http://e/> . e:a e:p e:b . e:b e:q 1 . e:a e:q 1 ."))
    found = engine.run("SELECT ?s ?o { { ?s <http://e/p> ?x OPTIONAL { ?s <http://e/r> ?o } } { { ?t <http://e/q> ?o } UNION { ?t <http://e/p> ?x2 } } }")
    assert "Join" in found.plan() and "CartesianProduct" not in found.plan().split("Union")[0] and found.count() == 3


def test_examples(capsys):
    import importlib.util

    spec = importlib.util.spec_from_file_location("bibliography", Path(__file__).parents[1] / "examples/bibliography.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert len(module.QUERIES) == 10


@pytest.mark.parametrize("n", range(10))
def test_example_queries(spark, example_engine, n):
    import runpy

    queries = runpy.run_path(str(Path(__file__).parents[1] / "examples/bibliography.py"))["QUERIES"]
    assert example_engine.run("PREFIX ex: <http://example.org/> " + list(queries.values())[n]).collect()


@pytest.fixture(scope="module")
def example_engine(spark):
    return Engine(load_text(spark, bibliography(Spec(papers=200, authors=50, venues=8, organisations=10, topics=12))).cached())
