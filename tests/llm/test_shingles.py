"""The pipeline's near-duplicate stage against brute force."""

import time
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import queries, shingles, simhash
from quadrille.llm.common import settled

FOLDER = "/root/testdata/sf0.001"


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_hand(rows):
    """The smallest id of each component of pairs of similarity 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if label[i] != label[j] and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return {min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}


def edited(rng, base, at):
    words = base.split()
    for i in at:
        words[i] = f"x{rng.integers(1 << 30)}"
    return " ".join(words)


def test_near_duplicates_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 16)  # a group of many blocks
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(3000)}"
    texts = [None, "", " ", "one two", "One  TWO", "one two three"]
    for _ in range(30):
        base = " ".join(word() for _ in range(200))
        texts += [base, *(edited(rng, base, rng.choice(200, n, replace=False)) for n in (1, 2, 3, 4, 5, 8))]
    crowd = " ".join(word() for _ in range(300))
    texts += [edited(rng, crowd, rng.choice(300, 6, replace=False)) for _ in range(80)]
    rows = list(enumerate(texts))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert {r.doc_id for r in got.collect()} == kept_by_hand(rows)


def test_near_duplicates_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(got) == sorted(kept_by_hand(rows))


def test_similar_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 15)).astype(np.uint64)) for _ in range(60)]
    label = shingles.similar(sets)
    want = shingles.least_rows(60, *np.array([(i, j) for i, j in combinations(range(60), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]).T)
    assert (label == want).all() and len(set(label)) < 60


def test_simhash_proposes_pairs_of_the_pipeline(spark, monkeypatch):
    """Without a candidate of min-hash's: pairs within two bits are found if, and only if, their shingles are similar enough."""
    rng = np.random.default_rng(8)
    texts, sims = [], []
    for i in range(40):
        base = " ".join(f"w{x}" for x in rng.integers(0, 5000, 1500))
        texts += [base, edited(rng, base, [int(rng.integers(5, 1490))])]
    sims = [simhash.majority(shingles.shingles(t)) for t in texts]
    near = [i for i in range(0, 80, 2) if (sims[i] ^ sims[i + 1]).bit_count() <= 2]
    assert 10 < len(near)
    monkeypatch.setattr(shingles, "candidates", lambda classes: classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert {r.doc_id for r in got.collect()} == set(range(80)) - {i + 1 for i in near}
    monkeypatch.setattr(shingles, "similar", lambda sets, similarity: np.arange(len(sets)))
    assert corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).count() == 80


def test_simhash_edges(spark):
    rng = np.random.default_rng(9)
    sims = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    sims += [s ^ (1 << int(rng.integers(63))) for s in sims[:20]] + [s ^ 3 for s in sims[20:30]] + sims[:5] + [sims[5] ^ 7]
    n = len(sims)
    links = [(i, j) for i, j in combinations(range(n), 2) if ((sims[i] ^ sims[j]) & (1 << 64) - 1).bit_count() <= 2]
    rows = [(r.a, r.b) for r in shingles.simhash_edges(spark.createDataFrame(list(enumerate(sims)), "fp long, sim long")).collect()]
    label = [shingles.least_rows(n, *np.array(x).T) for x in (links, rows)]
    assert (label[0] == label[1]).all() and len(set(label[0])) < n


def test_near_copies(spark, monkeypatch, tmp_path):
    """op8's classes of near copies against all pairs; a group of many copies with edits is one class, where fingerprints leave many."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = np.random.default_rng(12)
    base = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "one two three four", "a b a b a b", "b a b a b a b", "a b a b a b a b a b"]
    for n in (30, 60, 100, 200) * 3:
        one = base(n)
        texts += [one, one.upper(), *(edited(rng, one, rng.choice(n, max(1, round(n * x)), replace=False)) for x in (0.01, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3))]
    crowd = base(300)
    first = len(texts)
    texts += [edited(rng, crowd, rng.choice(300, 15, replace=False)) for _ in range(80)]
    ids = [*rng.permutation(len(texts) - 4).tolist(), 7, None, None, 3]
    texts[20] = texts[-3]  # a null id in a class of others
    grams3 = lambda t: [tuple(w[i : i + 3]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 2)) if w]
    sets, fps = [frozenset(grams3(t)) for t in texts], [simhash.fingerprint(t) for t in texts]
    n, near, wide = len(texts), [], []
    for i, j in combinations(range(n), 2):
        both = len(sets[i] & sets[j])
        near += [(i, j)] * ((fps[i] ^ fps[j]).bit_count() <= 2)
        wide += [(i, j)] * (2 * both >= len(sets[i]) + len(sets[j]) - both)
    low = lambda label: [min((ids[k] for k in range(n) if label[k] == label[i] and ids[k] is not None), default=None) for i in range(n)]
    narrow, whole = (shingles.least_rows(n, *np.array(x).T) for x in (near, near + wide))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_simhash(spark, str(tmp_path)).collect()
    want = zip(ids, [f"{f:016x}" for f in fps], low(narrow), low(whole))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(set(whole[first:].tolist())) == 1 and len(set(narrow[first:].tolist())) > 40
    assert shingles.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_settled_frames_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    frame = spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count()
    got = settled(settled(frame).groupBy("count").agg(F.sum("k").alias("s")))
    for _ in range(100):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert [tuple(r) for r in got.collect()] == [(100, 4950)]
    assert frame.count() == 100  # what was settled can be used again


def test_texts_are_exchanged_once_where_one_of_each_is_kept(spark):
    """Repeated and null ids too; besides the join and the window, nothing may deal the rows again."""
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, "c"), (None, "c"), (0, "d"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.one_of_each(docs, lambda d: d.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("label")))
    assert sorted(kept.collect(), key=str) == sorted([(1, "a b"), (None, "c"), (0, "d"), (2, None)], key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # rows, and ids to keep
