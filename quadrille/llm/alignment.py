"""Alignment of two tokenizers over one corpus.

A text is encoded by both; byte offsets where tokens of both end cut it into groups, and the
two tokens that end at such an offset are a link. Both tokenizers break between anything but
white space and a space behind it, so texts are encoded stretch by stretch between such
places, and the ids of a stretch that a worker knows it doesn't work out again. Offsets, groups
and links are then taken of many documents' tokens at once.

Counts are taken in stripes of B's ids. Links go to the task of their stripe, packed for each
batch of documents; there `np.add.at` adds them into a dense block of one row for each of
the stripe's B ids and one column for each A id, and a row's maximum is its id's best count.
The same links then meet the finished block, in the same stripe, for their scores. A stripe
with many links is dealt over several tasks, whose blocks are added in a tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, settled
from .packing import BYTE_CHARS, pack_ids

#: Stretches that a worker keeps, about, and their characters; beyond that it starts anew. It changes speed only.
MEMO, MEMO_CHARS = 400_000, 48
#: Where a space doesn't cut a text: behind white space, at its beginning or with nothing behind it.
SPACES = re.compile(r"\s(?: |\Z)|\A ")
#: Stretches that are encoded together; bytes and stretches of texts that are aligned at once, about.
TOGETHER, AT_ONCE, STRETCHES = 4096, 1 << 22, 1 << 19
TYPES = "row long, n_best long, count_sum long"


@dataclass(frozen=True)
class Sizes:
    #: B ids of a stripe; links of a task of counting or scoring, about; blocks added at a time.
    stripe: int = 32
    per_task: int = 1 << 19
    fan_in: int = 8
    #: Links of a batch, about, and its documents at most.
    batch_links: int = 1 << 20
    batch_docs: int = 1 << 15
    #: Stretches that a worker keeps, about.
    memo: int = MEMO


#: The ids of a stretch by A and by B, as int32; none where B's bytes aren't the text's.
Ids = tuple[bytes, bytes] | None


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Aligner(dict):
    """A byte-level tokenizer (A) and a sentencepiece model (B); as a dict, stretch without its first space -> its ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        super().__init__()
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        byte_of = {chr(c): bytes([b]) for b, c in BYTE_CHARS.items()}
        self.bytes_a: list[bytes] = [b""] * self.n_a
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = added[i] if i in added else b"".join(byte_of[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(n_b))]
        self.size_a, self.size_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        #: An id as it stands within a group, and at the end of the group's A or B ids.
        self.text_a = np.array([f"{i}{end}" for end in ",|" for i in range(self.n_a)], object)
        self.text_b = np.array([f"{i}{end}" for end in ",;" for i in range(n_b)], object)

    def learn(self, stretches: list[str]) -> list[Ids]:
        """Of stretches without their first spaces."""
        found: list[Ids] = []
        size_a, size_b = self.size_a.tolist().__getitem__, self.size_b.tolist().__getitem__
        for at in range(0, len(stretches), TOGETHER):
            part = stretches[at : at + TOGETHER]
            of_a = self.a.encode_batch_fast([f" {s}" for s in part], add_special_tokens=False)
            for s, a, b in zip(part, [x.ids for x in of_a], self.b.encode(part, num_threads=1)):
                # pieces give a text back but for U+2581, which becomes a space of fewer bytes: so lengths tell
                same = sum(map(size_a, a)) == sum(map(size_b, b)) == 1 + len(s.encode())
                found.append((pack_ids(a), pack_ids(b)) if same else None)
        return found

    def stretches(self, text: str) -> list[str]:
        """A text cut before each space that stands behind anything but white space, without these spaces: places that no token of either tokenizer spans."""
        parts = text.split(" ")
        if not SPACES.search(text):
            return parts
        out, held = [], []
        for p in parts:
            held.append(p)
            if p and not p[-1].isspace():
                out.append(" ".join(held))
                held = []
        if held:  # white space at the text's end goes with what stands before it: B gives an empty text no piece
            out[-1:] = [" ".join([*out[-1:], *held])]
        return out

    def all_of(self, texts: list[list[str]], most: int = MEMO) -> list[list[Ids]]:
        """The ids of some texts' stretches; those that are new are encoded together."""
        new = list({s for t in texts for s in t if s not in self})
        self.update(zip(new, self.learn(new)))
        found = [list(map(self.__getitem__, t)) for t in texts]
        for s in [s for s in new if len(s) > MEMO_CHARS]:
            del self[s]
        if len(self) > most:
            self.clear()
        return found

    def aligned(self, units: list[list[tuple[bytes, bytes]]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, str]]]:
        """Of units of stretches: the links' units and codes, and of each unit its A ids, B ids, groups, and the groups' text with an end mark."""
        parts_a, parts_b = ([b"".join([p[side] for p in u]) for u in units] for side in (0, 1))
        a, b = (np.frombuffer(b"".join(p), "<u4").astype(np.int64) for p in (parts_a, parts_b))
        to_a, to_b = (np.cumsum([len(x) // 4 for x in p]) for p in (parts_a, parts_b))
        # every unit has as many bytes by A as by B, so offsets may run on from unit to unit
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        mark = np.zeros((int(ends_a[-1]) if len(a) else 0) + 1, np.int8)
        mark[ends_a] = 1
        mark[ends_b] += 2
        last_a, last_b = mark[ends_a] == 3, mark[ends_b] == 3
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # in the text a group's A ids stand before its B ids
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.r_[0, at_b + 1][group_a]] = self.text_a[a + self.n_a * last_a]
        words[np.arange(len(b)) + (at_a + 1)[group_b]] = self.text_b[b + len(self.size_b) * last_b]
        words, out = words.tolist(), []
        from_a, from_b, groups = np.r_[0, to_a[:-1]], np.r_[0, to_b[:-1]], np.searchsorted(at_a, to_a)
        for lo_a, hi_a, lo_b, hi_b, lo, hi in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), [0, *groups[:-1].tolist()], groups.tolist()):
            out.append((hi_a - lo_a, hi_b - lo_b, hi - lo, "".join(words[lo_a + lo_b : hi_a + hi_b])))
        return np.searchsorted(to_a, at_a, "right"), b[at_b] * self.n_a + a[at_a], out


class Batch:
    """Links of some documents, until they leave packed by stripe. Links of one document stay in one batch."""

    def __init__(self, number: int, sizes: Sizes) -> None:
        self.number, self.sizes, self.docs, self.n = number, sizes, 0, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.summed: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc: np.ndarray, code: np.ndarray) -> None:
        self.held.append((doc, code))
        self.n += len(code)
        if self.n >= 2 * self.sizes.batch_links:  # within a very long document
            self._settle()

    def _settle(self) -> None:
        """Each pair of a document once, with how often the document holds it."""
        doc, code = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        self.summed.append(np.unique(code * self.sizes.batch_docs + doc, return_counts=True))  # ids are below 2^24
        self.held, self.n = [], 0
        if len(self.summed) > 1:
            both, at = np.unique(np.concatenate([k for k, _ in self.summed]), return_inverse=True)
            times = np.zeros(len(both), np.int64)
            np.add.at(times, at, np.concatenate([t for _, t in self.summed]))
            self.summed = [(both, times)]

    def packed(self, n_a: int) -> Iterator[tuple[int, int, bytes]]:
        """(stripe, links, blob of (code within the stripe, document, times))."""
        if self.held:
            self._settle()
        both, times = self.summed[0] if self.summed else (np.empty(0, np.int64), np.empty(0, np.int64))
        code, doc = both // self.sizes.batch_docs, both % self.sizes.batch_docs
        width = n_a * self.sizes.stripe
        stripe = code // width
        ends = np.flatnonzero(np.r_[stripe[1:] != stripe[:-1], True]) + 1 if len(code) else np.empty(0, int)
        for lo, hi in zip(np.r_[0, ends[:-1]], ends):
            yield int(stripe[lo]), int(hi - lo), pack(code[lo:hi] - stripe[lo] * width, doc[lo:hi], times[lo:hi])


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, of one length, as bytes; the first ascends."""
    first = np.diff(columns[0], prepend=0)
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in (first, *columns[1:])]
    raw = b"".join(c.tobytes() for c in narrow)
    head = np.array([len(raw), len(first), *(c.itemsize for c in narrow)], np.int64).tobytes()
    return bytes([len(narrow)]) + head + _ZSTD.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = 2 + blob[0]
    size, rows, *widths = np.frombuffer(blob, np.int64, n, 1).tolist()
    raw, at, out = _ZSTD.decompress(blob[1 + 8 * n :], size, asbytes=True), 0, []
    for w in widths:
        out.append(np.frombuffer(raw, f"<u{w}", rows, at).astype(np.int64))
        at += w * rows
    out[0] = np.cumsum(out[0])
    return out


def encoded(docs: DataFrame, path_a: str, path_b: str, sizes: Sizes) -> DataFrame:
    """Two kinds of rows: of a document (row, doc_id, n_a, n_b, n_groups, groups_sha256), and of a batch's links in a stripe (batch, stripe, n, blob)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "batch", "stripe", "n", "blob"]
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 3 + [pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, held, out = aligner(path_a, path_b), Batch(TaskContext.get().partitionId() << 31, sizes), []

        def leave() -> None:
            nonlocal held
            out.extend((None,) * 6 + (held.number, stripe, n, blob) for stripe, n, blob in held.packed(both.n_a))
            held = Batch(held.number + 1, sizes)

        def full() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(out), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 1024]), kinds)], names=names)
            out.clear()

        for batch in by_bytes(batches, 1, min(256, sizes.batch_docs), AT_ONCE):
            texts = both.all_of([both.stretches(t) if t else [] for t in batch.column(1).to_pylist()], sizes.memo)
            # B's bytes can only be fewer than the text's, so a later stretch doesn't make up for one that differs
            texts = [[] if None in t else t for t in texts]
            units = [(i, t[at : at + STRETCHES]) for i, t in enumerate(texts) for at in range(0, len(t), STRETCHES)]
            if held.docs + len(texts) > sizes.batch_docs:
                leave()
            first, totals, digests = held.docs, np.zeros((len(texts), 3), np.int64), [hashlib.sha256() if t else None for t in texts]
            held.docs += len(texts)
            for some in ([units] if len(units) <= len(texts) else [[u] for u in units]):  # a text of many units is aligned unit by unit
                unit, code, found = both.aligned([u for _, u in some])
                held.add(np.array([first + i for i, _ in some], np.int64)[unit], code)
                for (i, _), (*counts, text) in zip(some, found):
                    digests[i].update(((";" if totals[i].any() else "") + text[:-1]).encode())
                    totals[i] += counts
            rows = zip(batch.column(0).to_pylist(), range(held.number * sizes.batch_docs + first, 1 << 62), totals.tolist(), digests)
            out.extend((doc_id, row, *counts, digest.hexdigest() if digest else "", None, None, None, None) for doc_id, row, counts, digest in rows)
            if held.n >= sizes.batch_links or held.summed:
                leave()
            yield from full()
        leave()
        yield from full()

    return rows.mapInArrow(read, "doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, batch long, stripe long, n long, blob binary")


def align(docs: DataFrame, path_a: str, path_b: str, sizes: Sizes = Sizes()) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row.

    path_a: a byte-level tokenizer's file, path_b: a sentencepiece model's, which every node has.
    A encodes a space and the text, B the text (it adds the space); special tokens' strings are
    plain text. A null or empty text, and one that B's pieces don't give back byte by byte (it
    holds U+2581), has no tokens: zeros and ''. Texts of any length are encoded whole. A link
    counts as often as its pair is linked in all rows; of several A ids with an id's highest
    count each is best. Equal rows, equal and null ids are rows of their own; other columns
    play no part. An empty table gives no row.
    """
    found = settled(encoded(docs, path_a, path_b, sizes))
    n_a = aligner(path_a, path_b).n_a
    links = found.where("stripe is not null").select("batch", "stripe", "n", "blob")
    of = found.where("stripe is null").select("doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256")
    # a row for each stripe: bounded by B's vocabulary
    tasks = settled(links.groupBy("stripe").agg(F.ceil(F.sum("n") / sizes.per_task).alias("tasks")))
    most = tasks.agg(F.coalesce(F.max("tasks"), F.lit(1))).first()[0]
    links = links.join(F.broadcast(tasks), "stripe").withColumn("salt", F.pmod(F.xxhash64("batch"), F.col("tasks"))).select("stripe", "salt", "batch", "blob")

    def block(blobs: list[bytes]) -> np.ndarray:
        found = np.zeros(n_a * sizes.stripe, np.int64)
        for blob in blobs:
            code, *_, times = unpack(blob)
            np.add.at(found, code, times)
        return found

    def count(rows: pa.Table) -> pa.Table:
        found = block(rows["blob"].to_pylist())
        code = np.flatnonzero(found)
        return pa.table({"stripe": rows["stripe"][:1], "salt": rows["salt"][:1], "blob": pa.array([pack(code, found[code])], pa.binary())})

    counts = links.groupBy("stripe", "salt").applyInArrow(count, "stripe long, salt long, blob binary")
    while most > 1:
        counts = counts.withColumn("salt", F.floor(F.col("salt") / sizes.fan_in)).groupBy("stripe", "salt").applyInArrow(count, "stripe long, salt long, blob binary")
        most = -(-most // sizes.fan_in)
    counts = settled(counts.select("stripe", F.col("blob").alias("counts")))

    def score(rows: pa.Table, finished: pa.Table) -> pa.Table:
        total = block(finished["counts"].to_pylist())
        best = total.reshape(sizes.stripe, n_a).max(axis=1)
        out = []
        for batch, blob in zip(rows["batch"].to_pylist(), rows["blob"].to_pylist()):
            code, doc, times = unpack(blob)
            there, at = np.unique(doc, return_inverse=True)
            n_best, count_sum = np.zeros((2, len(there)), np.int64)
            np.add.at(n_best, at, times * (total[code] == best[code // n_a]))
            np.add.at(count_sum, at, times * total[code])
            out.append((batch, pack(there, n_best, count_sum)))
        return pa.table({"batch": pa.array([b for b, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    spread = counts.join(F.broadcast(tasks), "stripe").select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"), "counts")
    scores = links.groupBy("stripe", "salt").cogroup(spread.groupBy("stripe", "salt")).applyInArrow(score, "batch long, blob binary")

    def gather(rows: pa.Table) -> pa.Table:
        """A batch's documents with the sums over all stripes."""
        sums = np.zeros((3, sizes.batch_docs), np.int64)
        for blob in rows["blob"].to_pylist():
            doc, n_best, count_sum = unpack(blob)
            sums[:, doc] += np.stack([np.ones_like(doc), n_best, count_sum])
        doc = np.flatnonzero(sums[0])
        return pa.table({"row": rows["batch"][0].as_py() * sizes.batch_docs + doc, "n_best": sums[1, doc], "count_sum": sums[2, doc]})

    of = of.join(scores.groupBy("batch").applyInArrow(gather, TYPES), "row", "left")
    return of.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


__all__ = ["Aligner", "Sizes", "align", "aligner", "pack", "unpack"]
