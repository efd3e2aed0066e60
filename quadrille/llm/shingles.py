"""Near-duplicates by word shingles: Jaccard similarity of SIMILARITY or more, checked exactly.

Documents with equal sets of shingles are merged first. Each distinct set has a SimHash, and
sets whose SimHashes differ in at most two bits are candidates, found by op8's pivot tables (simhash.near_edges). Pairs at
0.8 often differ in more bits, which no table of 64 bits can look up; for these each set gets 32 keys of
4 min-hashes; a pair of similarity s shares a key but for (1 - s^4)^32 of the cases
(5 in 10^8 at 0.8). Within a key, pairs whose sketches (a byte of every min-hash) agree too
rarely for the similarity are discarded; the others and SimHash's are joined to clusters, and within a
cluster all pairs that aren't linked yet are compared by their shingles themselves. Groups
of any size are dealt out by pairs of blocks, so no task holds more than two blocks.

`near_copies` finds op8's classes of near copies the same way: over its own three-word shingles, pairs of half or
more in common, which differ in far more bits than op8's fingerprints link at. Min-hash alone proposes them, with more keys of fewer hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, settled, with_group_min

SIZE, SIMILARITY = 5, (4, 5)
#: Rows of a block: the least and the most, and how many blocks a group has between these.
BLOCK, MOST_BLOCK, BLOCKS = 256, 4096, 16


@dataclass(frozen=True)
class Scheme:
    """`bands` keys of `rows` min-hashes each; of the bands * rows bytes of two sketches `least` agree at least, else the pair isn't looked at."""

    bands: int
    rows: int
    least: int

    @cached_property
    def factors(self) -> list[np.ndarray]:
        rng = np.random.default_rng(5)
        return [rng.integers(0, 1 << 63, self.bands * self.rows, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]


#: For a similarity of 0.8 or more. So many bytes are 6.7 standard deviations below the mean at 0.8.
CLOSE = Scheme(32, 4, 72)
#: op8's near copies: half of the shingles in common or more. A pair at 0.5 shares no key in 2 of 10^4 cases, at 0.6 in 2 of 10^7; so many bytes are 4.5 standard deviations below the mean at 0.5.
COPY_SIZE, COPY_SIMILARITY, COPIES = 3, (1, 2), Scheme(64, 3, 65)


def hashed(text: str | None, size: int = SIZE) -> np.ndarray:
    """The 64-bit hashes of the text's word shingles, repeats included. No word: none; fewer than `size`: one shingle of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both work on ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    line, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in zip((ends - lens)[:n].tolist(), ends[-n:].tolist())), np.uint64, n)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted."""
    return np.unique(hashed(text, size))


def sketch(found: np.ndarray, scheme: Scheme = CLOSE) -> tuple[np.ndarray, bytes]:
    """A set's keys (signed, none for an empty set) and its sketch."""
    if not len(found):
        return np.empty(0, np.int64), b""
    a, b = scheme.factors
    low = np.full(scheme.bands * scheme.rows, ~np.uint64(0))
    for at in range(0, len(found), 2048):
        low = np.minimum(low, (found[at : at + 2048, None] * a + b).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(scheme.bands, scheme.rows))]
    return np.array(keys, np.uint64).view(np.int64), ((low >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) to (doc_id, th, fp, sim, keys, sketch): fp stands for the set of shingles, sim is its SimHash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(2)]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            sim = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            keys, marks = zip(*map(sketch, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(sim), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(marks), pa.binary())], names=["doc_id", "th", "fp", "sim", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("string"))
    return rows.mapInArrow(of, "doc_id long, th long, fp long, sim long, keys array<long>, sketch binary")


def least_rows(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least row number of each row's component under the links (i, j), beyond those that label has."""
    label = np.arange(n) if label is None else label
    while True:
        new = label.copy()
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        for at in (i, j, a, b):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def alike(groups: np.ndarray, fps: np.ndarray, marks: np.ndarray, least: int = CLOSE.least) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group, with their sketches: a tree (a, b) of fingerprints for each component of rows whose sketches agree."""
    n = len(groups)
    begins = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    last = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n]))
    label, rows, apart = np.arange(n), np.arange(n), 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows := rows[rows + apart < last[rows]]):
        some = rows[label[rows] != label[rows + apart]]
        some = some[(marks[some] == marks[some + apart]).sum(axis=1) >= least]
        held.append((some, some + apart))
        if sum(len(x) for x, _ in held) > n:
            label, held = least_rows(n, *map(np.concatenate, zip(*held)), label), []
        apart += 1
    if held:
        label = least_rows(n, *map(np.concatenate, zip(*held)), label)
    moved = np.flatnonzero(label != np.arange(n))
    return fps[label[moved]], fps[moved]


def similar(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The least row number of each set's component, links being pairs of at least that similarity."""
    n, (up, down) = len(sets), similarity
    label = np.arange(n)
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int32)
    for i in range(n - 1):
        if (label[i:] == label[i]).all():
            continue
        own = ids[ends[i] - size[i] : ends[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[ids[ends[i] :]], ends[i:-1] - ends[i])
        mark[own] = 0
        near = i + 1 + np.flatnonzero(common * down >= (size[i] + size[i + 1 :] - common) * up)
        joined = np.unique(label[np.r_[i, near]])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def dealt(rows: DataFrame, group: str, n: Column) -> DataFrame:
    """Rows (group, fp, ...) of groups of n rows, for each pair of blocks of their group: any two rows of a group meet in one pair at least."""
    size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(n / BLOCKS)))
    blocks = F.ceil(n / size).cast("bigint")
    cut = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_n")))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda x: F.xxhash64(group, F.least(x, F.col("_b")), F.greatest(x, F.col("_b"))))
    # two pairs of one hash would only meet as well
    return cut.withColumn("pair", F.explode(pairs)).drop("_n", "_b").repartition("pair").sortWithinPartitions("pair", "fp")


def _by_group(found: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over a partition sorted by its first column: found(whole groups), holding one batch and one unfinished group."""

    def edges(table: pa.Table) -> pa.RecordBatch:
        a, b = found(table)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != keys[0]):
                yield edges(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield edges(pa.Table.from_batches(held))

    return of


def _alike(scheme: Scheme, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pair, fp = (table.column(c).to_numpy() for c in ("pair", "fp"))
    marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(fp), scheme.bands * scheme.rows)
    return alike(pair, fp, marks, scheme.least)


def simhash_edges(classes: DataFrame) -> DataFrame:
    """classes (fp, sim) to edges (a, b); any two whose SimHashes differ in at most simhash.RADIUS bits are in one component."""
    firsts = settled(classes.groupBy(F.col("sim").alias("_s")).agg(F.min("fp").alias("low")))
    same = classes.join(firsts, F.col("sim") == F.col("_s")).where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    near = simhash.near_edges(firsts.select(F.col("_s").alias("fp")))
    for end in ("a", "b"):
        near = near.join(firsts.select(F.col("_s").alias(end), F.col("low").alias(f"low_{end}")), end)
    return same.unionAll(near.select(F.col("low_a").alias("a"), F.col("low_b").alias("b")))


def candidates(classes: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """classes (fp, keys, sketch) to edges (a, b), repeated ones too, by min-hash; any two that share a key and whose sketches agree are in one component."""
    keyed = classes.select(F.explode("keys").alias("key"), "fp")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("key").alias("_h"), F.col("key").alias("_k"), "n")
    met = settled(keyed.join(shared, (F.xxhash64("key") == F.col("_h")) & (F.col("key") == F.col("_k"))).select("key", "fp", "n"))
    marked = met.join(classes.select(F.col("fp").alias("_f"), "sketch"), F.col("fp") == F.col("_f")).select("key", "fp", "n", "sketch")
    return dealt(marked, "key", F.col("n")).select("pair", "fp", "sketch").mapInArrow(_by_group(partial(_alike, scheme)), "a long, b long")


def near_edges(classes: DataFrame, docs: DataFrame, size: int = SIZE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """classes (fp, th, sim, keys, sketch) to edges (a, b), repeated ones too, whose components are those of all candidates of at least that similarity."""
    return checked(settled(components(simhash_edges(classes.select("fp", "sim")).unionAll(candidates(classes)))), classes, docs, size, similarity)


def checked(clusters: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Components (node, label) of candidates among classes (fp, th) to edges (a, b) of pairs within them, whose components are those of all such pairs of at least that similarity."""

    def of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        pair, fp, text = table.column("pair").to_numpy(), table.column("fp").to_numpy(), table.column("text")
        begins = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        a, b = [fp[:0]], [fp[:0]]
        for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(pair)]):
            label = similar([shingles(t.as_py(), size) for t in text[s:e]], similarity)
            moved = np.flatnonzero(label != np.arange(e - s))
            a.append(fp[s:e][label[moved]])
            b.append(fp[s:e][moved])
        return np.concatenate(a), np.concatenate(b)

    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("label").alias("_h"), F.col("label").alias("_l"), "n")
    members = clusters.join(sizes, (F.xxhash64("label") == F.col("_h")) & (F.col("label") == F.col("_l"))).select("label", "node", "n")
    members = settled(members.join(classes.select("fp", F.col("th").alias("_t")), F.col("node") == F.col("fp")).select("label", "fp", "n", "_t"))
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("string").alias("text"))
    texts = texts.join(members.select(F.col("_t").alias("_u")).distinct(), F.col("th") == F.col("_u")).groupBy("th").agg(F.min("text").alias("text"))
    whole = members.join(texts, F.col("_t") == F.col("th")).select("label", "fp", "n", "text")
    return dealt(whole, "label", F.col("n")).select("pair", "fp", "text").mapInArrow(_by_group(of), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs (doc_id, text) to (doc_id, th, fp, label, component_id): a row for each row of docs.

    label is the component's smallest fp, component_id the smallest doc_id that links reach
    from the document, links joining documents of at least that similarity. Words are read as
    in op8. Texts without a word have one empty set in common and link to each other alone. A
    null doc_id is reached and linked but never the smallest, unless all of the component are
    null: then component_id is null. Repeated ids and rows count as rows. An empty table gives no row.
    """
    if similarity[0] * SIMILARITY[1] < similarity[1] * SIMILARITY[0]:
        raise ValueError("keys and sketches are made for a similarity of 0.8 or more")
    found = settled(sketches(docs.select("doc_id", "text"), size))
    classes = settled(found.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("th").alias("th"), F.first("sim").alias("sim"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    labels = components(near_edges(classes, docs, size, similarity)).withColumnRenamed("node", "_n")
    known = classes.select("fp", "low").join(labels, F.col("fp") == F.col("_n"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    ids = settled(with_group_min(known, "label", "low", "component_id").select(F.col("fp").alias("_f"), "label", "component_id"))
    return found.join(ids, F.col("fp") == F.col("_f")).select("doc_id", "th", "fp", "label", "component_id")


def copy_marks(docs: DataFrame, size: int = COPY_SIZE, scheme: Scheme = COPIES) -> DataFrame:
    """docs (doc_id, text) to (doc_id, th, fp, set, keys, sketch): fp is op8's fingerprint, set stands for the set of shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids, keys, marks = [], [], [], []
            for t in batch.column(2):
                found = hashed(t.as_py(), size)
                fps.append(simhash.majority(found))
                found = np.unique(found)
                ids.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
                for kept, x in zip((keys, marks), sketch(found, scheme)):
                    kept.append(x)
            fp, one = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, one, pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "th", "fp", "set", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("string"))
    return rows.mapInArrow(of, "doc_id long, th long, fp long, set long, keys array<long>, sketch binary")


def near_copies(docs: DataFrame, size: int = COPY_SIZE, similarity: tuple[int, int] = COPY_SIMILARITY) -> DataFrame:
    """docs (doc_id, text) to simhash.near_duplicates' rows with near_component_id: a row for each row of docs.

    near_component_id is the smallest doc_id that links of two kinds reach from the document: fingerprints that
    differ in at most simhash.RADIUS bits, and texts whose sets of shingles have at least that similarity. So its
    classes are joined of those of component_id. Texts without a word, null and repeated ids and an empty table are as there.
    """
    if similarity[0] * COPY_SIMILARITY[1] < similarity[1] * COPY_SIMILARITY[0]:
        raise ValueError("keys and sketches are made for a similarity of 0.5 or more")
    found = settled(copy_marks(docs.select("doc_id", "text"), size))
    ids = simhash.classes(found)
    sets = settled(found.groupBy(F.col("set").alias("fp")).agg(F.min("th").alias("th"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    clusters = settled(components(candidates(sets, COPIES)))
    alike_sets = components(checked(clusters, sets.select("fp", "th"), docs, size, similarity)).withColumnRenamed("label", "low_set")
    known = found.select(F.col("fp").alias("_p"), "set").distinct().join(ids.select("_f", "label"), F.col("_p") == F.col("_f")).select("set", "label").distinct()
    known = settled(known.join(alike_sets, F.col("set") == F.col("node"), "left").select("label", F.coalesce("low_set", "set").alias("group")).distinct())
    # classes of fingerprints that hold texts of one group are one
    joined = components(with_group_min(known, "group", "label", "low").select(F.col("label").alias("a"), F.col("low").alias("b"))).withColumnRenamed("label", "low")
    whole = ids.join(joined, F.col("label") == F.col("node"), "left").select("_f", "label", "component_id", F.coalesce("low", "label").alias("near"))
    whole = settled(with_group_min(whole, "near", "component_id", "near_component_id"))
    return found.join(whole, F.col("fp") == F.col("_f")).select("doc_id", "th", "fp", "label", "component_id", "near_component_id")
