"""Saved stores: what appends and look-ups read, parts that grow together, streams that are run again."""

from pathlib import Path

import pytest

from quadrille.functions import terms as T
from quadrille.operators import parts as P
from quadrille.operators.store import QuadStore
from quadrille.session import Engine
from quadrille.sources.relational import RelationalSource


def e(x):
    return T.iri(f"http://e/{x}")


def _spoilt(path: Path, but: set[int]) -> dict[Path, bytes]:
    """Files of all buckets but these, in both orders, overwritten by as many zeros; what they held."""
    files = [f for order in "so" for f in path.glob(f"{order}/part=*/pb=*/*.parquet") if int(f.parent.name[3:]) not in but]
    held = {f: f.read_bytes() for f in files}
    for f in files:
        f.write_bytes(b"\0" * len(held[f]))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    return held


@pytest.fixture(scope="module")
def rows():
    return [(e(f"s{i}"), e(f"p{i % 40}"), T.literal(str(i % 7), datatype=T.INTEGER)) for i in range(400)]


def test_an_append_reads_the_buckets_it_touches(spark, tmp_path, rows):
    path = tmp_path / "store"
    store = QuadStore.of(spark, rows).save(str(path))
    new = [(e("s1"), e("p1"), e("o")), rows[1], (e("zz"), e("p1"), e("o"), e("g"))]
    touched = {r[0] for r in spark.createDataFrame([("http://e/p1",)], "p string").select(P.bucket("p")).collect()}
    held = _spoilt(path, touched)
    assert len(held) > 20
    grown = store.append(new)  # a file that can't be read would stop it
    for f, content in held.items():
        f.write_bytes(content)
    assert (grown.quad_count(), grown.triple_count(), grown.quads.count(), grown.objects.count()) == (402, 401, 402, 402)
    assert [p.quads for p in grown.manifest.parts] == [400, 2] and grown.manifest.parts[1].buckets == list(touched)
    assert grown.stats["http://e/p1"][0] == 12 and grown.stats["http://e/p1"][1] == 11 and store.quads.count() == 400
    assert grown.append(new).manifest.parts[:1] == grown.manifest.parts[:1] and grown.append([]).quad_count() == 402


def test_parts_grow_together(spark, tmp_path, rows):
    """The number of parts follows the logarithm of the appends, and a scan is one scan."""
    store = QuadStore.of(spark, rows).save(str(tmp_path / "store"))
    for i in range(9):
        store = store.append([(e("a"), e("q"), e(f"o{i}"))])
    assert [p.quads for p in store.manifest.parts] in ([400, 9], [400, 7, 2], [400, 8, 1], [400, 6, 3]) and store.count(p=e("q")) == 9
    assert Engine(store).run("SELECT * { ?s <http://e/q> ?o }").plan().count("- Scan parquet") == 1
    QuadStore.vacuum(spark, str(tmp_path / "store"))
    assert QuadStore.open(spark, str(tmp_path / "store")).quads.count() == 409
    assert len(list((tmp_path / "store/s").glob("part=*"))) == len(store.manifest.parts)


@pytest.mark.parametrize("sizes,size,stay", [([], 5, []), ([100, 9], 4, [100, 9]), ([100, 7], 4, [100]), ([100, 30, 10, 3, 1], 2, [100]), ([10, 1], 1000, [])])
def test_absorbed(sizes, size, stay):
    parts = [P.Part(str(n), n, n, [], 1, 1) for n in sizes]
    kept, taken = P.absorbed(parts, size)
    assert [p.quads for p in kept] == stay and kept + taken == parts


def test_a_batch_counts_once(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    store = QuadStore.of(spark, rows[:5]).save(path)
    once = store.append(rows[5:9], stream=("in", 0))
    again = once.append(rows[5:20], stream=("in", 0))
    assert again.quad_count() == 9 and QuadStore.open(spark, path).append(rows[9:12], stream=("in", 1)).manifest.streams == {"in": 1}
    assert QuadStore.open(spark, path).append(rows[:3], stream=("other", 4)).quad_count() == 12
    assert once.append(rows[20:24]).quad_count() == 16  # opened before the others' commits, which stay
    with pytest.raises(FileExistsError):
        P.Manifest(number=store.manifest.number).write(spark, path)


def test_a_damaged_store(spark, tmp_path, rows):
    path = tmp_path / "store"
    QuadStore.of(spark, rows[:50]).save(str(path))
    next(path.glob("o/part=*/pb=*/*.parquet")).unlink()
    with pytest.raises(ValueError, match="damaged"):
        QuadStore.open(spark, str(path))


def _rows_read(df) -> int:
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_look_ups_by_object_and_by_subject_read_few_rows(spark, tmp_path):
    n = 30_000
    quads = spark.range(n).selectExpr(
        f"cast(null as {T.TERM}) as g", "struct(cast(1 as tinyint) as k, concat('http://e/s', id) as v, '' as l, '' as d, cast(null as double) as n) as s",
        "struct(cast(1 as tinyint) as k, concat('http://e/p', id % 2) as v, '' as l, '' as d, cast(null as double) as n) as p",
        "struct(cast(1 as tinyint) as k, concat('http://e/o', xxhash64(id) % 1000) as v, '' as l, '' as d, cast(null as double) as n) as o",
    )
    store = QuadStore(quads).save(str(tmp_path / "store"), row_group=64 << 10)
    want = quads.where("p.v = 'http://e/p1' and o.v = 'http://e/o77'").count()
    by_object = store._matching({"o": e("o77"), "p": e("p1")}, None)
    by_subject = store._matching({"s": e("s77"), "p": e("p1")}, None)
    assert by_object.count() == want > 0 and by_subject.count() == 1
    assert _rows_read(by_object) < n / 20 and _rows_read(by_subject) < n / 20
    assert store.count(o=e("o77")) == quads.where("o.v = 'http://e/o77'").count() and _rows_read(store._matching({"o": e("o77")}, None)) < n / 10


PAPERS = "PREFIX ex: <http://example.org/> SELECT * "
PATTERNS = [
    "{ ?p ex:title ?t ; ex:mainAuthor ?a . ?a ex:name ?n ; ex:affiliation ex:org3 }",
    "{ ?p ex:title ?t ; ex:venue ex:venue2 ; ex:mainAuthor ?a . ?a ex:name ?n ; ex:affiliation ex:org3 }",
    "{ ?p ex:venue ex:venue1 . ?q ex:cites ?p OPTIONAL { ?q ex:year ?y } }",
    "{ ?a ex:affiliation ex:nowhere ; ex:name ?n }",
    "{ ?a ex:affiliation ex:org1 . ?a ?p ?o }",
]


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    from quadrille.sources.generator import Spec, bibliography
    from quadrille.sources.readers import load_text

    return load_text(spark, bibliography(Spec(papers=300, authors=60, venues=6, organisations=8, topics=12))).save(str(tmp_path_factory.mktemp("papers")))


def _solutions(outcome):
    return sorted(map(str, outcome.collect()))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_look_ups_change_no_solution(papers, pattern):
    engine = Engine(papers)
    want = _solutions(engine.run(PAPERS + pattern, naive_join_order=True))
    for rows in (1_000, 3):
        got = engine.run(PAPERS + pattern, lookup_from=1, lookup_rows=rows)
        assert _solutions(got) == want
    assert any("looked up" in n for n in engine.run(PAPERS + pattern, lookup_from=1).notes) and not any("looked up" in n for n in engine.run(PAPERS + pattern).notes)


def test_a_look_up_reaches_the_scan(papers):
    """Few values of a subject or an object stand in the scan of the order in which they lie together; nothing is shuffled."""
    of_objects = Engine(papers).run(PAPERS + "{ ?a ex:affiliation ex:org3 . ?p ex:mainAuthor ?a }", lookup_from=1).plan()
    assert "/o/part=" in of_objects and "In(o.v, [" in of_objects and "SortMergeJoin" not in of_objects
    of_subjects = Engine(papers).run(PAPERS + PATTERNS[0], lookup_from=1).plan()
    assert "/s/part=" in of_subjects and "In(s.v, [" in of_subjects and "SortMergeJoin" not in of_subjects
    tables = Engine(RelationalSource(papers.spark, "/root/testdata/sf0.001"))
    text = 'SELECT * { ?n <http://d/nation#n_nationkey> 3 . ?c <http://d/customer#c_nationkey> ?n ; <http://d/customer#c_name> ?m }'
    found = tables.run(text, lookup_from=1)
    assert "EqualTo(c_nationkey," in found.plan() and found.count() == tables.run(text, naive_join_order=True).count() > 0


def test_fields_of_terms_are_filtered_at_run_time(spark, papers):
    """Joins compare fields, so that Spark puts its own filter of one side's keys before the other side's shuffle."""
    settings = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = Engine(papers).run(PAPERS + PATTERNS[0])
        assert "might_contain" in found.plan() and found.count() == Engine(papers).run(PAPERS + PATTERNS[0], naive_join_order=True).count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


SCHEMA_TEXT = """@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> .
    e:C1 r:subClassOf e:C2 . e:C2 r:subClassOf e:C3 . e:p0 r:subPropertyOf e:q . e:q r:domain e:C1 . e:p1 r:range e:C2 ."""


@pytest.mark.parametrize("more", [[("n1", "p0", "n2"), ("n1", "p1", "n3")], [("q", "http://www.w3.org/2000/01/rdf-schema#range", "C9"), ("n1", "p0", "n2")], [("s1", "p9", "x")]])
def test_inference_after_an_append(spark, tmp_path, rows, more):
    """The same as a full run, where the new quads change the schema, too; else only the buckets of what they touch are read."""
    from quadrille.sources.readers import load_text

    more = [(e(s), T.iri(p) if ":" in p else e(p), e(o)) for s, p, o in more]
    base = load_text(spark, SCHEMA_TEXT).add(rows)
    closed = base.materialise_rdfs()[0].save(str(tmp_path / "store"))
    want = base.add(more).materialise_rdfs()[0]
    held = {}
    if more[0][1].v == "http://e/p9":
        held = _spoilt(tmp_path / "store", {r[0] for r in spark.createDataFrame([("http://e/p9",), *((T.RDFS + x,) for x in ("subClassOf", "subPropertyOf", "domain", "range"))], "p string").select(P.bucket("p")).collect()})
    grown = closed.append(more, rdfs=True)
    for f, content in held.items():
        f.write_bytes(content)
    plain = lambda store: {(r.s.v, r.p.v, r.o.v) for r in store.quads.collect()}
    assert plain(grown) == plain(want) and grown.quad_count() == want.quad_count() > closed.quad_count()
    assert grown.materialise_rdfs()[1].inferred == 0


def test_optional_on_variables_that_may_be_unbound(spark):
    """Against every pair of rows by hand; rows with bound values meet by equality, repeated rows stay as often as they are."""
    from quadrille.sources.readers import load_text

    text = "@prefix e: <http://e/> . " + " ".join(f"e:a{i} e:n {i % 4} ; {f'e:k {i % 3} ;' if i % 2 else ''} e:t 1 . e:b{i} e:m {i} ; {f'e:k {i % 5} ;' if i % 3 else ''} e:u 1 ." for i in range(12))
    engine = Engine(load_text(spark, text))
    for condition in ("", "FILTER (?m > 4)", "FILTER (BOUND(?k) && ?m < ?n + 6)"):
        query = f"PREFIX e: <http://e/> SELECT ?n ?k ?m {{ {{ ?a e:n ?n OPTIONAL {{ ?a e:k ?k }} }} OPTIONAL {{ ?b e:m ?m OPTIONAL {{ ?b e:k ?k }} {condition} }} }}"
        left = [(i % 4, i % 3 if i % 2 else None) for i in range(12)]
        right = [(i, i % 5 if i % 3 else None) for i in range(12)]
        want = []
        for n, k in left:
            fits = [(n, k if k is not None else j, m) for m, j in right if k is None or j is None or k == j]
            fits = [f for f in fits if not condition or ("> 4" in condition and f[2] > 4) or ("BOUND" in condition and f[1] is not None and f[2] < n + 6)]
            want += fits or [(n, k, None)]
        got = [tuple(None if t is None else int(t.v) for t in row) for row in engine.run(query).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    plan = engine.run(query).plan()
    assert plan.count("NestedLoopJoin LeftOuter") == plan.count("NestedLoopJoin LeftAnti") == 0 and ("HashJoin" in plan or "SortMergeJoin" in plan)
