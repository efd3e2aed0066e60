"""Top-k search, tool calls, image copies and the pipeline against brute force."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import images, toolcalls, topk
from quadrille.llm.queries import QUERIES, SQL


# --- top-k ---
def top_by_hand(rows, step=2, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % step == 0:
            score = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(v) == len(w)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(score)]
    return sorted(out)


def top(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 2 = 0"), **options)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def test_top_k(spark):
    rng = np.random.default_rng(8)
    some = [[float(x) for x in rng.normal(0, 1, 6).astype(np.float32)] for _ in range(40)]
    rows = [(int(i), some[int(rng.integers(0, 40))]) for i in rng.permutation(150)]
    rows += [(200, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (206, [float("inf")] * 6), (208, [1.0, 2.0]), (209, [3.0, 4.0]), (210, []), (212, []), (None, some[0])]
    assert top(spark, rows) == top_by_hand(rows)
    assert top(spark, rows, query_block=7, shard=5) == top_by_hand(rows)
    assert top(spark, rows[:3], shard=1) == top_by_hand(rows[:3]) and top(spark, []) == []


def test_top_k_of_a_repeated_candidate(spark):
    """One vector being most of the rows, its copies spread over the cells of the grid."""
    rows = [(7, [1.0, 1.0])] * 300 + [(i, [float(i % 5), 1.0]) for i in range(100, 140)]
    assert top(spark, rows, shard=20) == top_by_hand(rows) and top(spark, rows) == top_by_hand(rows)


def test_top_k_of_large_values(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[3e6, 1.5], [3e6, 1.25], [-3e6, 2.0], [1.0, 1.0], [2.9e6, 0.0]])]
    assert top(spark, rows, k=3) == top_by_hand(rows, k=3)


def test_top_k_of_products_beyond_doubles(spark):
    """Sums beyond 2^53, where doubles round: bounded by 64 bits, and beyond that bound."""
    for size in (5e5, 1.5e6):
        rng = np.random.default_rng(5)
        rows = [(i, [float(np.float32(x)) for x in rng.normal(0, size, 8)]) for i in range(60)]
        assert 1 << 53 < max(abs(s) for _, _, _, s in top_by_hand(rows)) < 1 << 63
        assert top(spark, rows) == top_by_hand(rows)


def test_top_k_repeated_rows(spark):
    got = top(spark, [(2, [1.0]), (2, [2.0]), (3, [1.0]), (3, [1.0]), (5, [-1.0])], k=2)
    assert got == [(2, 1, 3, 256 * 256), (2, 1, 3, 2 * 256 * 256), (2, 2, 3, 256 * 256), (2, 2, 3, 2 * 256 * 256)]


# --- tool calls ---
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"required": ["a", "b"], "properties": {"a": {"type": "number"}, "b": {"type": "integer"}}, "additionalProperties": False}, "say": {"properties": {"x": {"type": "string"}, "y": {"type": "array"}, "z": {"type": "boolean"}}}}


def linked(spark, calls, results):
    rows = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return {(r.conv_id, r.call_id): r for r in rows}, rows


def test_links_and_json(spark):
    by, rows = linked(
        spark,
        [
            (1, "a", 0, "add", '{"b": 2, "a": 1.5}', []), (1, "b", 2, "add", '{"a": "x", "c": 1}', ["a"]), (1, "c", 4, "say", '{"z": true, "y": [2, {"q": 1, "p": null}], "x": "é\\n\\"/"}', None),
            (1, "d", 6, "other", "{}", []), (1, "e", 8, "say", "no json", []), (1, "f", 9, "say", "[1]", []), (1, "g", 10, None, None, [None, "zz"]), (2, "a", 5, "say", "{}", []), (2, "a", 3, "say", '{"x": "1"}', []), (None, "a", 1, "say", "{}", []), (3, None, 1, "say", "{}", []),
        ],
        [(1, "a", 1, "3.5"), (1, "a", 3, "again"), (1, "z", 9, "orphan"), (2, "a", 4, None), (None, None, None, "lost")],
    )
    assert len(rows) == 12
    assert (by[1, "a"].status, by[1, "a"].valid, by[1, "a"].n_results, by[1, "a"].result_turn) == ("linked", True, 2, 1)
    assert by[1, "a"].json == '{"arguments":{"a":1.5,"b":2},"id":"a","name":"add","result":"3.5"}'
    assert by[1, "b"].errors == ["a: not number", "b: missing", "c: unknown"] and by[1, "b"].status == "unanswered"
    assert by[1, "c"].valid and by[1, "c"].json == '{"arguments":{"x":"é\\n\\"/","y":[2,{"p":null,"q":1}],"z":true},"id":"c","name":"say","result":null}'
    assert json.loads(by[1, "c"].json)["arguments"]["y"][1] == {"p": None, "q": 1}
    assert (by[1, "d"].errors, by[1, "e"].errors, by[1, "f"].errors, by[1, "g"].errors) == (["unknown tool"], ["not JSON"], ["not an object"], ["not JSON"])
    assert by[1, "z"].status == "orphan" and not by[1, "z"].valid and (by[2, "a"].n_calls, by[2, "a"].call_turn) == (2, 3)
    assert sorted(r.status for r in rows if r.conv_id is None or r.call_id is None) == ["unidentified"] * 3


def test_order(spark):
    by, _ = linked(
        spark,
        [(1, "a", 9, "say", "{}", []), (1, "b", 2, "say", "{}", ["a"]), (1, "c", 1, "say", "{}", ["b", "a"]), (2, "p", 1, "say", "{}", ["q"]), (2, "q", 2, "say", "{}", ["p"])],
        [(1, "a", 3, "x"), (1, "b", 4, "y"), (2, "p", 5, ""), (2, "q", 6, "")],
    )
    place = lambda c: (by[1, c].order_turn, by[1, c].order_level)
    after = lambda c: (by[1, c].result_order_turn, by[1, c].result_order_level)
    assert place("a") == (9, 0) and place("a") < after("a") < place("b") < after("b") < place("c")
    assert by[2, "p"].cyclic or by[2, "q"].cyclic and not by[1, "a"].cyclic


def test_order_of_a_long_chain_and_of_cycles(spark):
    n = 200
    chain = [(1, f"c{i}", 2 * (n - i), "say", "{}", [f"c{i - 1}"] if i else []) for i in range(n)]
    loops = [(2, "p", 1, "say", "{}", ["q"]), (2, "q", 3, "say", "{}", ["p"]), (2, "s", 0, "say", "{}", ["q"]), (2, "o", 0, "say", "{}", ["lone"]), (3, "self", 4, "say", "{}", ["self"])]
    answers = [(c, i, t + 1, "") for c, i, t, *_ in chain + loops] + [(2, "lone", 7, "")]
    by, _ = linked(spark, chain + loops, answers)
    turn, level, want = 2 * n, 0, []
    for i in range(n):  # all stand behind the first, which has the last turn; its result comes one turn later
        if i:
            turn, level = 2 * n + 1, 2 * i - 1
        want.append((turn, level, False))
    assert [(by[1, f"c{i}"].order_turn, by[1, f"c{i}"].order_level, by[1, f"c{i}"].cyclic) for i in range(n)] == want
    assert {i: by[i].cyclic for i in by if i[0] > 1} == {(2, "p"): True, (2, "q"): True, (2, "s"): False, (2, "o"): False, (2, "lone"): False, (3, "self"): True}
    place = lambda c: (by[2, c].order_turn, by[2, c].order_level)
    assert (place("p"), place("q"), place("s"), place("o")) == ((1, 0), (3, 0), (4, 1), (7, 1))


def order_by_hand(calls, results):
    """Least places by repeated passes; calls that reach themselves need nothing. Other columns of equal names don't matter."""
    answer = {(c, i): t for c, i, t, _ in results}
    called = {(c, i): t for c, i, t, *_ in calls}
    needs = {(c, i): {(c, d) for d in deps if (c, d) in answer} for c, i, _, _, _, deps in calls}

    def reach(x):
        seen, todo = set(), list(needs.get(x, ()))
        while todo:
            if (y := todo.pop()) not in seen:
                seen.add(y)
                todo += needs.get(y, ())
        return seen

    cyclic = {x for x in needs if x in reach(x)}
    place, before = {x: (t, 0) for x, t in called.items()}, None
    while place != before:
        before = dict(place)
        for x in set(needs) - cyclic:
            for y in needs[x]:
                after = max((answer[y], 1), (place[y][0], place[y][1] + 2)) if y in place else (answer[y], 1)
                place[x] = max(place[x], after)
    return place, cyclic


@pytest.mark.parametrize(("seed", "stretch"), [(0, 0), (1, 64), (2, 64), (3, 4)])
def test_order_by_brute_force(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(toolcalls, "STRETCH", stretch)
    rng = np.random.default_rng(seed)
    calls, results = [], []
    for conv in range(12):
        n = int(rng.integers(1, 14))
        turns = rng.permutation(2 * n)[:n]
        for i in range(n):
            deps = sorted({f"c{j}" for j in rng.integers(0, n + 1, int(rng.integers(0, 3)))})
            calls.append((conv, f"c{i}", int(turns[i]), "add", "{}", deps))
            if rng.random() < 0.85:
                results.append((conv, f"c{i}", int(turns[i]) + 1, "x"))
        results.append((conv, f"c{n}", 3, "orphan"))
    place, cyclic = order_by_hand(calls, results)
    df = spark.createDataFrame(calls, CALLS).withColumn("p", F.lit(1)).withColumn("s", F.lit("x")).withColumn("content", F.lit(2))
    rows = toolcalls.link(df, spark.createDataFrame(results, RESULTS).withColumn("name", F.lit(0)), SCHEMAS).where("n_calls > 0").collect()
    got = {(r.conv_id, r.call_id): ((r.order_turn, r.order_level), r.cyclic) for r in rows}
    assert got == {x: (p, x in cyclic) for x, p in place.items()} and any(c for _, c in got.values())


def test_nested_validation(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {
            "a": {"type": "object", "required": ["b", "k"], "additionalProperties": False, "properties": {"b": {"type": "integer"}, "k": {"type": ["string", "null"]}}},
            "c": {"enum": ["x", "y", 3]},
            "d": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}},
            "e": {"type": "array", "items": {"required": ["q"], "properties": {"q": {"enum": [True]}}}},
        },
    }
    cases = {
        '{"a":{"b":1,"k":null},"c":3,"d":[[1],[]],"e":[{"q":true}]}': [],
        '{"a":{"b":"no","k":"s"},"c":"z","d":["q"]}': ["a.b: not integer", "c: not allowed", "d[0]: not array"],
        '{"a":{"k":1,"z":2,"y":2},"d":[[1],[2,"u"]],"w":0}': ["a.k: not string or null", "a.b: missing", "a.y+z: unknown", "d[1][1]: not integer", "w: unknown"],
        '{"a":[1],"e":[{},{"q":false},{"q":true}]}': ["a: not object", "e[0].q: missing", "e[1].q: not allowed"],
        "{}": ["a: missing"],
        "[]": ["not an object"],
        "{": ["not JSON"],
    }
    calls = [(1, str(i), i, "f", text, []) for i, text in enumerate(cases)] + [(1, "u", 99, "g", "{}", []), (1, "n", 98, None, None, [])]
    rows = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"f": schema}).collect()
    got = {r.call_id: r.errors for r in rows}
    assert [got[str(i)] for i in range(len(cases))] == list(cases.values()) and got["u"] == ["unknown tool"] and got["n"] == ["not JSON"]


def test_turns_of_other_roles_give_no_row(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "tool", "t"), (1, 4, None, "n"), (1, 5, "function", "f")]
    calls, results = toolcalls.conversation_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert sorted(r.turn for r in calls.collect()) == [0, 1] and [r.turn for r in results.collect()] == [2]


def test_no_calls(spark):
    assert linked(spark, [], [])[1] == [] and linked(spark, [], [(1, "a", 1, "x")])[1][0].status == "orphan"


# --- images ---
def pgm(x):
    return b"P5\n# c\n%d %d\n255\n" % x.shape[::-1] + x.astype(np.uint8).tobytes()


def png(x, kinds):
    raw, above = b"", np.zeros(x.shape[1], int)
    for y, line in enumerate(x.astype(int)):
        kind, left = kinds[y % len(kinds)], np.r_[0, line[:-1]]
        corner = np.r_[0, above[:-1]]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        raw += bytes([kind]) + ((line - [0, left, above, (left + above) // 2, near][kind]) % 256).astype(np.uint8).tobytes()
        above = line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def texture(rng, h=96, w=96):
    return np.kron(rng.integers(0, 256, (h // 4, w // 4)), np.ones((4, 4))).astype(np.uint8)


def test_decoding():
    x = texture(np.random.default_rng(0), 40, 52)
    assert (images.decode(pgm(x)) == x).all() and (images.decode(png(x, [0, 1, 2, 3, 4])) == x).all()
    assert all(images.decode(b) is None for b in (None, b"", b"P5 9 9 255 x", b"\x89PNG\r\n\x1a\nxx", b"GIF89a", png(x, [0])[:-40]))


def test_copies(spark):
    rng = np.random.default_rng(7)
    base = [texture(rng) for _ in range(12)]
    rows = [(i, pgm(x)) for i, x in enumerate(base)]
    edited = [x.copy() for x in base]
    for e in edited:
        e[30:50, 30:60] = 128
    rows += [(100 + i, pgm(x[12:84, 8:80])) for i, x in enumerate(base)] + [(200 + i, png(x, [2])) for i, x in enumerate(edited)] + [(300 + i, pgm(x)) for i, x in enumerate(base)] + [(400 + i, pgm(np.rot90(x).copy())) for i, x in enumerate(base)]
    rows += [(900, None), (901, b"junk"), (902, pgm(np.zeros((80, 80)))), (903, pgm(np.zeros((3, 3)))), (None, pgm(base[0])), (904, pgm(np.zeros((80, 80))))]
    got = images.copies(images.media_features(spark.createDataFrame(rows, "image_id long, image binary"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = None if r.image_id is None else r.image_id % 100 if r.image_id < 500 else 902 if r.image_id == 904 else r.image_id
        assert r.component_id == (0 if r.image_id is None else want), r
    assert images.copies(images.page_features(spark.createDataFrame([], "page_id long, html string"))).count() == 0


def votes(a, b, scales=images.LADDER, tables=images.TABLES):
    return images.consensus(*(images.corners(x[None], scales)[0] for x in (a, b)), tables=tables)


def resized(x, factor):
    """Bilinear, each pixel's mean first where the copy is smaller."""
    x = x.astype(float)
    if factor < 0.8:
        x = (x + np.roll(x, 1, 0) + np.roll(x, -1, 0)) / 3
        x = (x + np.roll(x, 1, 1) + np.roll(x, -1, 1)) / 3
    ys, xs = (np.clip((np.arange(int(n * factor)) + 0.5) / factor - 0.5, 0, n - 1.001) for n in x.shape)
    y, x0 = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y)[:, None], (xs - x0)[None]
    return ((x[y][:, x0] * (1 - fx) + x[y][:, x0 + 1] * fx) * (1 - fy) + (x[y + 1][:, x0] * (1 - fx) + x[y + 1][:, x0 + 1] * fx) * fy).astype(np.uint8)


def test_recall_of_images():
    """Crops of a quarter of the side, a twentieth of all cells changed, noise, turns, and copies of other sizes; unrelated pictures stay apart."""
    rng, n = np.random.default_rng(5), 10

    def recall(of, side=128, cell=4):
        texture = [np.kron(rng.integers(0, 256, (side // cell, side // cell)), np.ones((cell, cell))).astype(np.uint8) for _ in range(n)]
        return sum(votes(x, of(x)) >= images.LEAST for x in texture) / n

    def edited(x):
        return np.where(np.kron(rng.random((32, 32)) < 0.05, np.ones((4, 4))) > 0, rng.integers(0, 256), x).astype(np.uint8)

    assert recall(lambda x: x[101:165, 86:150], 256) >= 0.9 and recall(edited) >= 0.9 and recall(lambda x: np.rot90(x, 3).copy()) >= 0.9
    assert recall(lambda x: np.clip(x + rng.normal(0, 8, x.shape), 0, 255).astype(np.uint8)) >= 0.9
    for factor in (0.67, 0.8, 0.9, 1.1, 1.25, 1.5):
        assert recall(lambda x: resized(x, factor), 192, 12) >= 0.9, factor
    assert recall(lambda x: texture(rng, 256, 256), 256) == 0


def test_recall_of_pages():
    rng = np.random.default_rng(9)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    seen = lambda a, b: votes(*(images.page_image(" ".join(w)) for w in (a, b)), images.SCALES, images.PAGE_TABLES) >= images.LEAST
    edits = {
        "half": lambda w: w[len(w) // 2 :],
        "changed": lambda w: [x if rng.random() > 0.05 else f"v{rng.integers(3000)}" for x in w],
        "one in front": lambda w: ["new", *w],
        "wrapped": lambda w: [*draw(150), *w[50:250], *draw(150)],
    }
    for name, edit in edits.items():
        assert sum(seen(w, edit(w)) for w in (draw(400) for _ in range(20))) >= 18, name
    assert not any(seen(draw(400), draw(400)) for _ in range(20))


def test_packed_corners_and_blocks(spark):
    found = images.corners(np.stack([texture(np.random.default_rng(i)) for i in range(6)]))
    assert all((a == b).all() for c in found for a, b in zip(c, images.Corners.unpacked(c.packed())))
    rows = [(10 * i, len(c.bits), c.packed()) for i, c in enumerate([*found, found[0], found[2]])]
    df = spark.createDataFrame(rows, "digest long, n_corners long, corners binary")
    for buckets in (1, 7):
        images_ = {(r.a, r.b) for r in images.candidates(df, buckets << 20).collect()}
        assert images_ >= {(0, 60), (20, 70)}
        shared = lambda a, b: np.intersect1d(images.keys(images.Corners.unpacked(rows[a][2]))[0], images.keys(images.Corners.unpacked(rows[b][2]))[0]).size
        assert all(shared(a // 10, b // 10) for a, b in images_)


def test_tiles_and_neighbours_of_many_corners():
    x = texture(np.random.default_rng(6), 700, 560)[None].astype(np.float32)
    whole, tiled = images.describe(x), images.describe_tiled(x)
    assert all((a == b).all() for a, b in zip(whole, tiled)) and whole[0].shape[1] > images.FEW
    yx = whole[1][0]
    away = ((yx[:, None] - yx[None]) ** 2).sum(axis=2) * len(yx) + np.arange(len(yx))
    assert (images.nearest(yx) == np.argsort(away, axis=1)[:, : images.MEMBERS]).all()


def test_images_described_together():
    """Images of several heights, padded to one, have the corners that each has alone."""
    rng = np.random.default_rng(14)
    some = [texture(rng, 4 * int(h), 60) for h in rng.integers(3, 40, 40)] + [texture(rng, 720, 960)]
    features = next(images._features(iter([(list(range(41)), some)])))
    for x, data in zip(some, features.column(4).to_pylist()):
        alone = images.corners(x[None])[0]
        assert all((a == b).all() for a, b in zip(alone, images.Corners.unpacked(data)))


@pytest.mark.parametrize("few", [0, 1 << 13])
def test_rounds_in_one_task_and_in_many(spark, monkeypatch, few):
    """Keys shared by chance with the smallest image don't part two copies, wherever the rounds run."""
    rng = np.random.default_rng(2)
    copies_ = [texture(rng, 96, 96) for _ in range(3)]
    first = [images.corners(x[None])[0] for x in copies_]
    decoy = images.Corners(*(np.concatenate([getattr(c, f)[:3] + (np.array([0, 400 * i]) if f == "yx" else 0) for i, c in enumerate(first)]) for f in images.Corners._fields))
    rows = [(-9, decoy)] + [(10 * i + j, c) for i, c in enumerate(first, 1) for j in (0, 1)]
    df = spark.createDataFrame([(d, len(c.bits), c.packed()) for d, c in rows], "digest long, n_corners long, corners binary")
    monkeypatch.setattr(images, "FEW_PICTURES", few)
    got = {(r.a, r.b) for r in images.links(df).collect()}
    assert got >= {(10, 11), (20, 21), (30, 31)} and not any(a == -9 for a, _ in got)


def test_a_pair_whose_keys_a_smaller_image_holds(spark):
    """The smallest image of all keys that two images share is linked to one of them and not to the other: the two are compared all the same."""
    rng = np.random.default_rng(11)
    g, h = (images.corners(texture(rng)[None], (1.0,))[0] for _ in range(2))
    g = images.Corners(*(f[:14] for f in g))
    near = np.sort(images.keys(g)[1], axis=1)
    apart = [images.Corners(g.scale[t], g.yx[t] + np.array([400 * i, 0]), g.turn[t], g.bits[t]) for i, t in enumerate(np.unique(near, axis=0))]
    far = lambda y: images.Corners(h.scale, h.yx + np.array([y, 0]), h.turn, h.bits)
    some = {1: images.sheet([*apart, far(20000)])[0], 2: images.sheet([g, far(2000)])[0], 3: g}
    held = {d: images.keys(c)[0] for d, c in some.items()}
    assert np.isin(np.intersect1d(held[2], held[3]), held[1]).all()
    df = spark.createDataFrame([(d, len(c.bits), c.packed()) for d, c in some.items()], "digest long, n_corners long, corners binary")
    rows = images.links(df).collect()
    assert {d: sum(r.n for r in rows if r.b == d) for d in some} == {1: 1, 2: 2, 3: 1} and {r.a for r in rows} <= {1, 2} and any(r.b == 3 for r in rows)


@pytest.mark.parametrize("few", [256, 3])
def test_links_are_those_of_all_pairs(spark, monkeypatch, few):
    """Pages with one passage in common, each beside its edited copies: each picture's number of links and its component, in one block and in many."""
    monkeypatch.setattr(images, "FEW_PICTURES", few)
    rng = np.random.default_rng(12)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    passage, texts = draw(60), []
    for _ in range(12):
        words = draw(120) + passage + draw(int(rng.integers(20, 120)))
        texts += [" ".join(words[i:]) for i in (0, 30, 90)]
    features = images.page_features(spark.createDataFrame(list(enumerate(texts)), "page_id long, html string"))
    rows = features.collect()
    found = {r.digest: images.Corners.unpacked(r.corners) for r in rows}
    held = {d: set(images.keys(c, 2)[0].tolist()) for d, c in found.items()}
    pairs = [(a, b) for a in found for b in found if a < b and held[a] & held[b]]
    links = [(a, b) for a, b in pairs if images.consensus(found[a], found[b], tables=2) >= images.LEAST]
    label = {d: d for d in found}
    for a, b in links * len(found):
        label[a] = label[b] = min(label[a], label[b])
    low = {d: min(r.image_id for r in rows if label[r.digest] == label[d]) for d in found}
    got = images.copies(features, tables=2).collect()
    assert all(r.n_links == sum(r.digest in x for x in links) and r.component_id == low[r.digest] for r in got) and len(got) == len(texts)
    assert len(links) > 30 and max(sum(k in x for x in held.values()) for k in held[rows[0].digest]) > 4


def test_page_images():
    assert images.page_image(None).shape == (15, 48) and not images.page_image("<p></p>").any()
    a = images.page_image("<p>one two</p><script>x y</script>")
    assert (a[:3, :3] == zlib.crc32(b"one") % 256).all() and (a[:3, 3:6] == zlib.crc32(b"two") % 256).all() and not a[3:].any() and a[:3, 6:].any()
    assert images.page_image("w " * 5000).any()


def test_copies_of_pages_by_brute_force(spark):
    """Components of all pairs of the table's pages that agree; with repeated, empty and null pages, null ids and a clashing column."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "<p>x</p>"), (9003, "<p>x</p>")], "page_id long, html string")
    pages = pages.unionAll(pages.limit(3)).unionAll(odd).withColumn("digest", F.lit("x")).withColumn("corners", F.lit(1))
    rows = images.page_features(pages).collect()
    found, keys = {r.digest: images.Corners.unpacked(r.corners) for r in rows}, {}
    for d, c in found.items():
        keys[d] = images.keys(c, images.PAGE_TABLES)[0]
    group = {d: {d} for d in found}
    for a in found:
        for b in found:
            if a < b and np.intersect1d(keys[a], keys[b]).size and images.consensus(found[a], found[b], tables=images.PAGE_TABLES) >= images.LEAST and group[a] is not group[b]:
                group[a] |= group[b]
                for d in group[a]:
                    group[d] = group[a]
    want = {d: min((r.image_id for r in rows if r.digest in g and r.image_id is not None), default=None) for d, g in group.items()}
    got = images.copies(images.page_features(pages), tables=images.PAGE_TABLES).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.digest] for r in got)
    assert len(set(want.values())) < len(found)


# --- all queries ---
def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = QUERIES[name](spark, folder)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    """Each stage by itself on what the stage before kept, and run() on all of them."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        docs = stage(spark, before, folder).cache()
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert 0 < sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    out = corpus_pipeline.run(spark, folder)
    want = docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {(r.doc_id, r.n) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {(r.doc_id, r.n) for r in want}


@pytest.mark.parametrize("labelled", [(), (0, 1)])
def test_pipeline_of_odd_tables(spark, tmp_path, labelled):
    """Null and empty texts, null ids and sources, repeated rows, one very long text, columns that stages use themselves, no usable labels; and an empty table."""
    import corpus_pipeline

    words = "stone river cloud people house garden winter letter window paper".split()
    text = lambda i: " ".join(words[(i * 7 + j * (i + 3)) % 10] + str((i * j) % 17) for j in range(40))
    rows = [(i, text(i), "en", "ab"[i % 2]) for i in range(12)] + [(3, text(3), "en", "b"), (3, text(3), "en", "b"), (20, None, None, None), (21, "", "en", "a"), (None, text(40), None, None), (22, "x" * 300_000 + " y" * 5_000, "de", "a"), (23, "\n\n \n", "en", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, score string, key string, row int, component_id string"
    spark.createDataFrame([(*r, 0, "s", "k", 1, "c") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in labelled] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(12)) | {None, 22} and kept.where("doc_id = 3").count() == 1
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(out["doc_id"].dropna()) <= {r[0] for r in rows} and (out.groupby("sequence_id")["length"].sum() <= 4096).all()
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all()
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
