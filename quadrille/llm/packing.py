"""Cost-balanced packing of documents into training sequences.

A document is its token ids and an end id. Pieces of a full sequence's length leave it at
once: nothing can stand beside them. The rest of each document goes to a group of some
`group_tokens` tokens; within a group the rests, longest first, go to the sequence of
lowest cost so far that has room, a document's cost being linear (its tokens) plus
quadratic (its attention). A group opens just as many sequences as its tokens fill; what
fits nowhere whole is cut into the room that is left, so a group's padding is less than
one sequence.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, settled

WINDOW, END = 4096, 2
#: Cost of a document of n tokens in a sequence: LINEAR x n + QUADRATIC x n x n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Groups of a task, about.
GROUPS = 8
#: Words whose ids a worker keeps, and the bytes of the longest; beyond that it starts anew, and longer ones are encoded each time. It changes speed only.
MEMO, MEMO_WORD = 300_000, 64
#: How byte-level models write bytes as characters: printable Latin-1 as it is, the rest from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _SHOWN} | {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: Marks, but for apostrophes, right behind a letter and before white space.
POINT = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[ \n])")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


@cache
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder(dict):
    """Token ids of whole texts, word by word; as a dict, word -> its ids.

    Where no token spans white space and the tokenizer drops it, ignores case and parts a
    word from a mark behind it, the ids of a text are those of its parts between ASCII white
    space; each part is then encoded once. Any other tokenizer gets the whole text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.by_word = self._ids("Ab cd,\n\t eF.$$ \u00c9") == b"".join(map(self._ids, ("ab", "cd", ",", "ef", ".$$", "\u00e9")))
        self.by_word = self.by_word and all(pack_ids([t.id for t in self.merges(w.encode().decode("latin-1").translate(BYTE_CHARS))]) == self._ids(w) for w in ("word", "größe", "語"))

    def _ids(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        """uint32 ids, little-endian."""
        if not self.by_word:
            return self._ids(text)
        if "<|" in text:  # it may be a special token, for which case counts
            data = text.encode()
        else:
            data = POINT.sub(rb" \g<0>", (text if _beyond_latin(text) else text.lower()).encode().lower())
        return b"".join(map(self.__getitem__, data.split()))  # bytes are split at ASCII white space alone

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        if word.isalpha():  # ASCII letters: nothing but case and merges is left to do
            found = pack_ids([t.id for t in self.merges(word.decode().lower())])
        elif (text := word.decode()).isalpha() and text == text.lower() and is_normalized("NFC", text):
            found = pack_ids([t.id for t in self.merges(word.decode("latin-1").translate(BYTE_CHARS))])
        else:
            found = self._ids(text)
        if len(word) <= MEMO_WORD:
            self[word] = found
        return found


def pack_ids(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


def _beyond_latin(text: str) -> bool:
    """Whether case is more than a table: Latin-1 letters have one lower case each, whatever stands around."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def tokenized(docs: DataFrame, path: str, end: int = END, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) to (doc_id, key, start, length, ids_crc32, doc_tokens, ids): full pieces, without ids, and what is left of each document, with its ids. key: a hash of the row's place in the input."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, last, row = encoder(path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, 1, 1024):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), map(encode, batch.column(1).to_pylist())):
                row += 1
                key = xxhash.xxh64_intdigest(row.to_bytes(8, "little")) - (1 << 63)
                ids += last
                n = len(ids) // 4
                full = n - n % window
                rows += [(doc, key, at, window, zlib.crc32(ids[4 * at : 4 * (at + window)]), n, None) for at in range(0, full, window)]
                if full < n:
                    rows.append((doc, key, full, n - full, zlib.crc32(ids[4 * full :]), n, ids[4 * full :]))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, key long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def balanced(lengths: list[int], window: int = WINDOW, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """lengths, descending, to pieces (which, start, length, sequence, offset) in as many sequences as they fill."""
    n = -(-sum(lengths) // window)
    cost, room = np.zeros(n), np.full(n, window)
    out = []
    for which, size in enumerate(lengths):
        at = 0
        while at < size:
            fits = room >= size - at
            if not fits.any():
                fits = room > 0
            k = int(np.where(fits, cost, np.inf).argmin())
            take = int(min(size - at, room[k]))
            out.append((which, at, take, k, window - int(room[k])))
            cost[k] += linear * take + quadratic * take * take
            room[k] -= take
            at += take
    return out


def _group(rows: pd.DataFrame, window: int, linear: float, quadratic: float) -> pd.DataFrame:
    group = int(rows["group"].iloc[0]) << 32
    rows = rows.sort_values(["length", "key", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
    full, rest = rows[rows["ids"].isna()], rows[rows["ids"].notna()]
    done = [(d, s, n, c, t, group + k, 0) for k, (d, s, n, c, t) in enumerate(zip(full["doc_id"], full["start"], full["length"], full["ids_crc32"], full["doc_tokens"]))]
    doc, start, size, crc, tokens, ids = (rest[c].tolist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))
    for i, at, n, k, offset in balanced(size, window, linear, quadratic):
        done.append((doc[i], start[i] + at, n, crc[i] if n == size[i] else zlib.crc32(ids[i][4 * at : 4 * (at + n)]), tokens[i], group + len(full) + k, offset))
    return pd.DataFrame(done, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, path: str, window: int = WINDOW, group_tokens: int = 1 << 19, linear: float = LINEAR, quadratic: float = QUADRATIC, end: int = END) -> DataFrame:
    """docs (doc_id, text) to pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null text is empty: the end id alone. Every row is packed, equal rows and repeated
    ids too. sequence_id is the group's number x 2^32 plus the sequence within it. Rows are
    dealt to groups by a hash of their place in the input, so equal rows spread like
    others, and reruns over the same files agree. Of equal lengths in a group the lower hash goes
    first, and of sequences of one cost the first. A text of any length is encoded whole, by
    one task, in memory of its size; at most 8 MB of texts, or one text, are encoded at
    once. Its full pieces leave their ids behind. An empty table gives no row.
    """
    pieces = settled(tokenized(docs, path, end, window))
    left = pieces.where("ids is not null").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-left // group_tokens))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS))
    pieces = pieces.withColumn("group", F.pmod("key", F.lit(groups))).repartition(tasks, "group")

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        return _group(rows, window, linear, quadratic)

    return pieces.groupBy("group").applyInPandas(step, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
