"""Line dedup, mixing, SimHash, packing, quality, toxicity and licenses against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import licenses, linededup, mixing, packing, quality, simhash, toxicity
from quadrille.llm.common import py_held_out
from quadrille.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
LONG = "This line is surely long enough to be a key, is it not?"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- line dedup ---
def lines_by_hand(rows, min_chars=40, min_docs=5):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(-1 if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != (-1 if i is None else i)  # noqa: B023, E731
        kept = [x for x in own if not gone(x)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [
    [],
    [(1, None), (2, ""), (3, "\n\n"), (None, "x")],
    [(i, f"own {i}\n{LONG}\nmore\n{LONG.upper()}\t") for i in range(6)],
    [(i, LONG) for i in (1, 1, 1, 1, 1)],
    [(i, LONG) for i in (None, None, None, None, None)],
    [(i, f"{LONG}\né{LONG}" if (i or 0) % 2 else LONG) for i in (None, 5, 9, 3, 3, 7, 11, 11)],
    [(i, " " + LONG[:39] + "\n" + LONG[:40] + "\r") for i in range(8)],
    [(1, "\n".join(f"{LONG} {k}" for k in range(3000)))] + [(i, f"{LONG} 7\n{LONG} 9\nx") for i in range(2, 8)],
]


@pytest.mark.parametrize("rows", CASES)
def test_line_dedup(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.kept_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == lines_by_hand(rows)


def test_line_dedup_runs_and_columns(spark):
    df = docs(spark, [(i, f"a\n{LONG}\nb", "s") for i in range(5)]).withColumn("keep_runs", F.lit("mine")).withColumn("_row", F.lit(1)).withColumn("pos", F.lit(2))
    out = linededup.without_shared_lines(df)
    assert out.columns == df.columns and {(r.doc_id, r.text, r.n_chars, r.keep_runs) for r in out.collect()} == {(i, "a\nb" if i < 4 else f"a\n{LONG}\nb", 3 if i < 4 else len(LONG) + 4, "mine") for i in range(5)}
    runs = {r.doc_id: r.keep_runs for r in linededup.kept_lines(df.select("doc_id", "text")).collect()}
    assert [tuple(x) for x in runs[0]] == [(0, 1), (2, 1)] and runs[4] is None


# --- mixing ---
def targets_by_hand(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, over = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while over > 1e-9 and left:
        total = sum(w[s] for s in left)
        part, over = {s: over * w[s] / total for s in left}, 0.0
        for s, x in part.items():
            target[s] += x
            if target[s] >= limit * sizes[s]:
                over += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                left.discard(s)
    return target


def mixed(spark, rows):
    return mixing.per_row(mixing.mix(docs(spark, rows))).withColumn("taken", F.col("copies") * F.col("size")).toPandas()


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200 if i % 7 else 2000))), ["a", "b", "c", None, "É", "Z"][min(5, int(rng.exponential(1.2)))]) for i in range(900)]
    got = mixed(spark, rows)
    assert len(got) == 900 and (got.taken <= 2 * got["size"]).all()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_by_hand(sizes)
    for s, part in got.groupby(got.source.fillna("-")):
        s = None if s == "-" else s
        assert part.source_size.iloc[0] == sizes[s] and part.target.iloc[0] == pytest.approx(want[s])
        assert abs(part.taken.sum() - want[s]) <= 20
        assert set(part.copies) <= {0, 1, 2}
    again = mixed(spark, rows[::-1])
    assert dict(zip(got.doc_id, got.copies)) == dict(zip(again.doc_id, again.copies))


def test_mixing_edges(spark):
    assert mixing.mix(empty(spark)).count() == 0
    got = mixed(spark, [(1, None, "a"), (2, "", "b"), (None, " \t", None)])
    assert set(got.taken) == {0} and set(got.target) == {0.0}
    same = mixed(spark, [(1, "x y z", "a")] * 9 + [(2, "u", "b"), (2, "u v", "b"), (None, "q", "a")])
    assert len(same) == 12 and abs(same[same.source == "a"].taken.sum() - same[same.source == "a"].target.iloc[0]) <= 3
    df = docs(spark, [(i, f"word {i} " * 9, "s" if i % 3 else None) for i in range(60)]).withColumn("_c", F.lit(5)).withColumn("size", F.lit(6))
    out = mixing.mixed_documents(df)
    want = {(r.doc_id): r.copies for r in mixing.per_row(mixing.mix(df)).collect()}
    assert out.columns == df.columns and collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({k: v for k, v in want.items() if v})


# --- SimHash ---
def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(ids, fps, radius=2):
    n, parent = len(fps), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(n)]


def test_fingerprints(spark):
    texts = [None, "", " \n\t", "One", "one two", "One TWO three", "a b c d e f g", "É x\x0by z\x0c é", "the " * 500, "x y z w", *(f"text {i} with words {i * i} and more {i}" for i in range(30))]
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == [fingerprint_by_hand(t) for t in texts]


@pytest.mark.parametrize("bucket_rows", [1, 3, 4096])
def test_links_of_fingerprints(spark, bucket_rows):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    for _ in range(160):  # balls, chains and strangers
        f = fps[int(rng.integers(0, len(fps)))]
        for _ in range(int(rng.integers(0, 5))):
            f ^= 1 << int(rng.integers(0, 64))
        fps.append(f)
    fps = sorted(set(fps)) + [2**64 - 1, 2**64 - 2, 0]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.near_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket_rows).collect()
    u = lambda x: x & (2**64 - 1)
    labels = dict(zip(fps, range(len(fps))))
    for _ in range(len(fps)):
        for e in edges:
            labels[u(e.a)] = labels[u(e.b)] = min(labels[u(e.a)], labels[u(e.b)])
    want = components_by_hand(list(range(len(fps))), fps)
    groups = lambda x: sorted(sorted(i for i in range(len(fps)) if x[i] == k) for k in set(x))
    assert groups([labels[f] for f in fps]) == groups(want)


def test_near_duplicates(spark):
    base = "some words that make a document long enough to have many shingles in it and so a steady fingerprint " * 6
    rows = [(9, base), (4, base + "x"), (7, base), (None, base), (1, "quite another text about other things"), (None, ""), (None, None), (3, "solo"), (3, "solo"), (5, "only nulls follow")]
    got = simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    fps = [fingerprint_by_hand(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], components_by_hand([i for i, _ in rows], fps)))
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    df = docs(spark, [(i, t, "s") for i, t in rows]).withColumn("fp", F.lit(1)).withColumn("label", F.lit(2))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len({(c if c is not None else f) for (_, c), f in zip(want, fps)})


# --- packing ---
def test_pivots_discard():
    """Pairs of a bucket that the pivots leave unformed or discard are all beyond the radius; the links are those of all pairs."""
    rng = np.random.default_rng(11)
    fps = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:200] ^ np.uint64(1 << 7), fps[:90] ^ np.uint64((1 << 40) + 2)]))
    keys = np.sort(rng.integers(0, 5, len(fps)))
    counts = {}
    a, b = simhash.bucket_links(keys, fps, counts=counts)
    want, pairs = set(), 0
    for k in range(5):
        own = fps[keys == k]
        pairs += len(own) * (len(own) - 1) // 2
        low = components_by_hand(list(range(len(own))), [int(x) for x in own])
        want |= {frozenset(int(own[i]) for i in range(len(own)) if low[i] == x) for x in set(low)}
    groups = {int(x): {int(x)} for x in fps}
    for x, y in zip(a.tolist(), b.tolist()):
        joined = groups[x] | groups[y]
        for z in joined:
            groups[z] = joined
    assert {frozenset(g) for g in groups.values()} == want
    assert counts["pairs"] == pairs and counts["formed"] < 0.6 * pairs and counts["verified"] < 0.02 * counts["formed"] and counts["discarded"] == counts["formed"] - counts["verified"]


def check_pieces(pieces, rows, window=4096):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary())
    ids = {i: np.array(coder.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    for i, own in pieces.groupby(pieces.doc_id.fillna(-1)):
        own = own.sort_values("start")
        all_ids = ids[None if i == -1 else i]
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(all_ids) and set(own.doc_tokens) == {len(all_ids)}
        for s, n, c in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(all_ids[s : s + n].tobytes()) == c
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= window


def test_packing(spark):
    rng = np.random.default_rng(9)
    words = ["The", "quick,", "bräun", "fox's", "1234", "<|endoftext|>", "don't.", "x y", "naïve", "日本", "é", "..", "\x1c", "A.b", "İ", "😀!"]
    rows = [(i, " ".join(rng.choice(words, int(rng.exponential(300)) + 1)) + ("\n" if i % 2 else "")) for i in range(120)] + [(200, "long " * 30_000), (201, None), (202, ""), (None, "no id"), (203, "the " * 4095)]
    pieces = packing.pack(docs(spark, [(i, t, "s") for i, t in rows]), vocabulary(), group_tokens=40_000).toPandas()
    check_pieces(pieces, rows)
    total = pieces.length.sum()
    assert pieces.sequence_id.nunique() <= total / 4096 + 12
    assert packing.pack(empty(spark), vocabulary()).count() == 0
    twice = packing.pack(docs(spark, [(1, "a b c", "s"), (1, "a b c", "s")]), vocabulary()).toPandas()
    assert len(twice) == 2 and twice.length.tolist() == [4, 4]


def test_packing_keeps_no_long_words(spark):
    """Texts beyond a slice's bytes, words beyond the memo's, and both again: ids are the library's, each in one piece."""
    from tokenizers import Tokenizer

    path = vocabulary()
    texts = ["x" * 300 + " word " + "größe" * 40, "lorem ipsum " * 800_000, None, "", "x" * 300 + " word " + "größe" * 40, "a " * 5_000]
    encode = packing.Encoder(path)
    encode(texts[0]), encode(texts[0])
    assert max(map(len, encode)) <= packing.MEMO_WORD
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        mine = found[found["doc_id"] == i].sort_values("start")
        assert mine["length"].sum() == len(ids) == mine["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine["start"], mine["length"], mine["ids_crc32"]))


def test_packing_of_equal_rows(spark):
    """A third of all rows being equal, or without id and text, they spread over the groups like others."""
    rows = [(5, "same words here " * 60, "s")] * 1500 + [(None, None, "s")] * 1500 + [(i, "other words " * 90, "s") for i in range(10, 1500)]
    pieces = packing.pack(docs(spark, rows), vocabulary(), group_tokens=30_000).toPandas()
    assert len(pieces) >= len(rows) and pieces.groupby("sequence_id").length.sum().max() <= 4096
    own = pieces.assign(group=pieces.sequence_id // 2**32).groupby("group").length.sum()
    assert len(own) >= 10 and own.max() < 2 * own.median()


def test_balanced():
    lengths = sorted((int(x) for x in np.random.default_rng(2).integers(1, 4096, 500)), reverse=True)
    pieces = packing.balanced(lengths)
    n = -(-sum(lengths) // 4096)
    used, cost = np.zeros(n), np.zeros(n)
    for _, _, size, k, offset in pieces:
        assert offset == used[k]
        used[k] += size
        cost[k] += size + size * size / 2048
    assert used.sum() == sum(lengths) and used.max() <= 4096 and len(used) * 4096 - used.sum() < 4096
    assert sum(p[2] for p in pieces) == sum(lengths) and cost.std() < 0.35 * cost.mean()


# --- learned operators ---
def test_quality(spark):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["the", "of", "reading", "words", "plain", "text", "and", "so"], 60)) + "."
    bad = lambda: " ".join(w + "$$$" for w in rng.choice(["BUY", "NOW", "the"], 60))
    rows = [(i, good() if i % 4 else bad(), "s") for i in range(400)] + [(1000, None, "s"), (1001, "", "s"), (None, "x", "s")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs(spark, rows), labels).toPandas()
    assert len(got) == 403 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    own = got[got.doc_id < 400]
    assert (own.predicted == (own.doc_id % 4 > 0)).mean() > 0.99 and (own.held_out == own.doc_id.astype(int).map(py_held_out)).all()
    # labels of the held-out quarter aren't looked at
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.quality(docs(spark, rows), turned).toPandas().sort_values("doc_id").score.tolist() == got.sort_values("doc_id").score.tolist()
    assert quality.quality(empty(spark), labels).count() == 0 and quality.quality(docs(spark, rows), labels.limit(0)).toPandas().score.nunique() == 1


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    plain = ["tree", "house", "river", "cloud", "stone", "people", "group", "they", "run", "blue", "fool"]
    # neither word is toxic alone: only the pair is
    def text(i):
        words = list(rng.choice(plain[:9], 80))
        words[10:10] = [["insulta"], ["groupb"], ["insulta", "groupb"], []][i % 4]
        return " ".join(words)

    rows = [(i, text(i), "s") for i in range(1600)] + [(9000, None, "s"), (9001, "", "s"), (None, "?!", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 2)) for i in range(1600)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).toPandas()
    own = got[(got.doc_id < 1600) & got.held_out]
    assert len(got) == 1603 and ((own.score >= 0.5) == (own.doc_id % 4 == 2)).mean() > 0.97
    df = docs(spark, rows).withColumn("score", F.lit("kept")).withColumn("row", F.lit(1))
    left = toxicity.without_toxic(df, labels)
    assert left.columns == df.columns and {r.score for r in left.collect()} == {"kept"} and left.count() == (got.predicted == 0).sum()
    assert toxicity.toxicity(empty(spark), labels).count() == 0 and toxicity.toxicity(docs(spark, rows[:9]), labels.limit(0)).count() == 9


def test_toxicity_with_a_long_labelled_text_and_without_labels(spark):
    """One labelled text of 10 MB costs no other row; where labels don't hold both classes, all documents stay."""
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        text = list(rng.choice(words, 30))
        if i % 4 == 2:
            text[5:7] = ["grim", "folk"]
        rows.append((i, " ".join(text), "s"))
    rows[1] = (1, " ".join(rng.choice(words, 1_500_000)), "s")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 2)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).toPandas()
    kept = got[got["held_out"] & (got["doc_id"] != 1)]
    assert (kept["predicted"] == (kept["doc_id"] % 4 == 2)).mean() > 0.95
    few = docs(spark, [r for r in rows if r[0] != 1][:40])
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0"), labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic")):
        assert toxicity.without_toxic(few, some).count() == 40
    assert toxicity.toxicity(few, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxic_words_in_a_long_text():
    rng = np.random.default_rng(1)
    clean = lambda n: " ".join(rng.choice([f"w{i}" for i in range(300)], n))
    train = [clean(200) + (" vile scum" * 3 if i % 3 == 0 else "") for i in range(300)]
    machine = toxicity.fit(train, np.array([i % 3 == 0 for i in range(300)], int))
    hasher = toxicity.Hasher(machine.settings.buckets)
    a, b = machine.scores([clean(60_000) + " vile scum vile scum vile scum " + clean(60_000), clean(120_000)], hasher)
    assert a > 0.5 > b


# --- licenses ---
def test_licenses(spark):
    texts = [None, "", "CC BY", "cc-by cc by cc", "GNU General Public License v3", "All rights reserved. ALL RIGHTS RESERVED", "xé all rights reservedé", "General  public\nlicense", "cc_by", "Licensed under the Apache License, Version 2.0", "nothing here", "MIT License " * 3]
    got = licenses.digest(licenses.license_scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))).toPandas().sort_values("doc_id")
    for text, r in zip(texts, got.itertuples()):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(i, label) for p, label in licenses.BASE for p in [p.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(found), ",".join(sorted({x for _, x in found})))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None)) or not found and np.isnan(r.first_word)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "apache-2.0" in got.labels.iloc[9] and "apache," not in got.labels.iloc[9] and "gpl-3.0" in got.labels.iloc[4]
    assert licenses.license_scan(empty(spark)).count() == 0 and len(licenses.rules()) > 300


def test_mixing_keeps_chances_and_targets(spark):
    """Large and small documents get their share on average, and a source ends near its target."""
    rows = [(i, "w " * (1 + 60 * (i % 5)), "ab"[i % 4 == 0]) for i in range(1500)]
    df, copies = docs(spark, rows).cache(), collections.defaultdict(list)
    for seed in range(4):
        got = mixing.mix(df, seed=seed).toPandas()
        ends = got.assign(taken=got.copies * got["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
        assert (abs(ends.taken - ends.target) <= 30).all()  # half the step between two sizes
        per = got.target / got.source_size
        assert ((got.copies == np.floor(per)) | (got.copies == np.ceil(per))).all()
        for key, part in (got.copies - per).groupby([got.source, got["size"]]):
            copies[key] += part.tolist()
    assert all(abs(np.mean(x)) < 0.06 for x in copies.values())


def test_toxicity_scores_by_hand():
    """Windows and logits against loops over words and pairs of terms, of short, long and empty texts."""
    rng = np.random.default_rng(3)
    texts = ["", "?!", *(" ".join(rng.choice(["vile", "Scum", "tree", "river", "house", "of", "él"], int(n))) for n in (1, 3, 7, 8, 9, 12, 16, 17, 40, 200))]
    s = toxicity.Settings(buckets=1 << 10, width=8, least_docs=1, least_z=0.0)
    machine = toxicity.fit(texts, np.arange(len(texts)) % 2, s)
    crc = lambda t: zlib.crc32(t.encode()) % s.buckets

    def score(text):
        words, worst = re.findall(r"\w+", text.lower()), None
        for begin in range(0, max(1, len(words) - 4), 4) if words else []:
            own = words[begin : begin + 8]
            x = collections.Counter(crc(t) for w in own for t in (w, f"4 {w[:4]}", f"6 {w[:6]}"))
            x[crc(f"length {int(np.log2(len(own)))}")] += 1
            x = {t: np.log2(1.0 + n) for t, n in x.items()}
            pairs = sum(x[t] * x[u] * float(machine.v[t].astype(float) @ machine.v[u]) for t in x for u in x if t < u)
            logit = machine.bias + sum(float(machine.w[t]) * n for t, n in x.items()) + pairs
            worst = logit if worst is None else max(worst, logit)
        return 1 / (1 + np.exp(-(machine.bias if worst is None else worst)))

    got = machine.scores(texts, toxicity.Hasher(s.buckets))
    assert np.abs(got - [score(t) for t in texts]).max() < 1e-5 and got.std() > 0.01
    blocks = list(toxicity.windows([texts[-1]], toxicity.Hasher(s.buckets), 8, most=16))
    whole = list(toxicity.windows([texts[-1]], toxicity.Hasher(s.buckets), 8))
    assert len(blocks) > 3 and (np.concatenate([b.term for b in blocks]) == whole[0].term).all()
