"""Token counts by a tokenizer compiled to a deterministic transducer.

A byte-pair encoding is fixed by its neighbours: a row of pieces is the encoding of a text just
where every two that stand together are the encoding of their own joint text. So of every
prefix the last piece is known from the last pieces of the prefixes up to a piece's length
before it, and that is all a state holds: what may still become a piece, where it began, the
last piece before that, and how many tokens of it aren't sure yet. Reading a character leads to
the next state and emits the tokens that have become sure. States are made when they are first
reached and kept, so a character costs one look-up; a space behind anything else leads to one
state always, so what a word emits from there is kept too, as one transition.

A short text is read through at once. A longer one is cut into chunks that many tasks read: for
each start state that the characters before a chunk allow, the chunk's map has the state at its
end and the tokens emitted. Maps are composed in a tree, as in a parallel prefix scan. Where a
map lacks the state that it is entered with, the text is read through once more from the front.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, settled

LIMIT = 4096
#: Characters of a chunk, and before it those that tell which states it may be entered with.
CHUNK, CONTEXT = 1 << 16, 256
#: Maps composed at a time.
FAN_IN = 16
#: States and words that a worker keeps, and characters of such a word; beyond that it starts anew. It changes speed only.
STATES, WORDS, WORD_CHARS = 250_000, 300_000, 64
SPACE = "▁"

#: A state: what was read since the earliest open beginning, and of each open beginning how far back it is, the last piece before it (None: any piece may follow) and its tokens beyond those emitted.
Key = tuple[str, tuple[tuple[int, str | None, int], ...]]
START: Key = ("", ((0, None, 0),))


class State(dict):
    """Character -> (next state, tokens emitted)."""

    __slots__ = ("machine", "key", "rest")

    def __init__(self, machine: Transducer, key: Key) -> None:
        super().__init__()
        self.machine, self.key = machine, key
        #: Tokens still to come if the text ends here.
        self.rest = key[1][-1][2]

    def __missing__(self, char: str) -> tuple[State, int]:
        key, emitted = self.machine.step(self.key, SPACE if char == " " else char)
        found = self[char] = self.machine.state(key), emitted
        return found

    def __reduce__(self):
        raise TypeError("states are named by their keys")


class Words(dict):
    """Word -> tokens of it behind a space, from the state that a space behind a word leads to."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        state, n = self.machine.run(self.machine.behind_space, word)
        n += state.rest
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = n
        return n


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


class Transducer:
    """Of a sentencepiece model: byte-pair encoding with byte fallback that takes texts as they are."""

    def __init__(self, path: str, states: int = STATES) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kinds = model.normalizer_spec, model.SentencePiece
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not plain or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only byte-pair encodings with byte fallback that leave texts as they are can be compiled")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: pieces of the user's and unused ones can't be compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        #: Beginnings of pieces that something may follow, and what stands side by side within pieces.
        self.open = {p[:n] for p in self.score for n in range(len(p))}
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.library = SentencePieceProcessor(model_file=path)
        self.most = states
        self.states: dict[Key, State] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words = Words(self)

    @cached_property
    def behind_space(self) -> State:
        return self.state(START)[" "][0]

    def state(self, key: Key) -> State:
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= self.most:
                self.states.clear()  # those still held go on working; what they lead to is made anew
                self.fits.clear()
            found = self.states[key] = State(self, key)
        return found

    def together(self, a: str, b: str) -> bool:
        """Whether the pieces a and b are the encoding of their joint text: no merge crosses their border."""
        if a[-1] + b[0] not in self.pairs:
            return True
        found = self.fits.get((a, b))
        if found is None:
            parts, ends = list(a + b), list(range(1, len(a) + len(b) + 1))
            found = True
            while found:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    score = self.score.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                found = ends[at] != len(a)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del ends[at]
            self.fits[a, b] = found = found and parts == [a, b]
        return found

    def step(self, key: Key, char: str) -> tuple[Key, int]:
        read, opened = key
        last = tokens = None
        if char not in self.score:  # it goes by its bytes, and nothing merges with them
            return START, opened[-1][2] + len(char.encode("utf-8", "replace"))
        for back, before, n in opened:
            piece = read[len(read) - back :] + char
            if piece in self.score and (before is None or self.together(before, piece)) and self._whole(piece):
                last, tokens = piece, n + 1
                break
        kept = []
        for back, before, n in opened:
            piece = read[len(read) - back :] + char
            if piece in self.open:
                free = before is None or (before[-1] + piece[0]) not in self.pairs
                kept.append((back + 1, None if free else before, n))
        kept.append((0, last, tokens))
        sure = min(n for _, _, n in kept)
        longest = kept[0][0]
        return ((read + char)[len(read) + 1 - longest :], tuple((back, before, n - sure) for back, before, n in kept)), sure

    def _whole(self, piece: str) -> bool:
        """Whether a piece is its own encoding."""
        found = self.fits.get((piece, ""))
        if found is None:
            found = self.fits[piece, ""] = self.merged(piece) == [piece]
        return found

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [s for s in scores if s is not None]
            if not known:
                break
            at = scores.index(max(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state behind the text, and the tokens emitted."""
        n = 0
        for char in text:
            state, emitted = state[char]
            n += emitted
        return state, n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:  # spaces that stand together belong to the word behind them
            words, gap = [], 0
            for word in text.replace(SPACE, " ").split(" "):
                if word:
                    words.append(" " * gap + word)
                    gap = 0
                else:
                    gap += 1
            if gap:
                words.append(" " * (gap - 1))  # the space before each word is read already
        return sum(map(self.words.__getitem__, words))

    def starts(self, context: str) -> list[State]:
        """States that a chunk behind this context may be entered with: those of readings that begin within its first characters. Most often they have become one."""
        return list({self.run(self.state(START), context[at:])[0].key: None for at in range(min(len(context), 2 * 16) + 1)})

    def state_map(self, first: bool, context: str, chunk: str, step: int = 512) -> dict[Key, tuple[Key, int]]:
        """Start state -> (end state, tokens emitted) over the chunk. Readings that have come to one state go on as one."""
        begin = [self.behind_space.key] if first else self.starts(context)
        live = {key: (self.state(key), 0) for key in begin}
        for at in range(0, len(chunk), step):
            part = chunk[at : at + step]
            reached: dict[Key, tuple[State, int]] = {}
            for key, (state, n) in live.items():
                if state.key not in reached:
                    reached[state.key] = self.run(state, part)
                end, more = reached[state.key]
                live[key] = end, n + more
        return {key: (state.key, n) for key, (state, n) in live.items()}


def named(key: Key) -> str:
    return json.dumps(key)


def composed(maps: list[dict[str, tuple[str, int]]]) -> dict[str, tuple[str, int]]:
    """Of maps one behind the other; a start that leads to a state the next one lacks has no place in the result."""
    out = {start: (start, 0) for start in maps[0]}
    for one in maps:
        out = {start: (one[at][0], n + one[at][1]) for start, (at, n) in out.items() if at in one}
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, context: int = CONTEXT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit), a row for each row; path: a sentencepiece model that every node has.

    n_tokens is the library's for the whole text without tokens for its begin and end; strings of
    special tokens are plain text. A null or empty text has no bytes and no tokens. A text of
    any length is counted whole, beyond `chunk` characters by many tasks. Equal rows, equal or
    null ids are rows of their own; other columns play no part. An empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "n_bytes", "n_tokens", "row", "part", "before", "chunk"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        machine, row = transducer(path), TaskContext.get().partitionId() << 33
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in by_bytes(batches, 1):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if len(text) <= chunk:
                    out.append((doc, len(text.encode()), machine.count(text), None, None, None, None))
                    continue
                row += 1
                out.append((doc, len(text.encode()), None, row, None, None, None))
                for part, at in enumerate(range(0, len(text), chunk)):
                    out.append((None, None, None, row, part, text[max(0, at - context) : at], text[at : at + chunk]))
                    if len(out) >= 64:
                        yield pack(out)
                        out = []
            if out:
                yield pack(out)

    found = settled(rows.mapInArrow(read, "doc_id long, n_bytes long, n_tokens long, row long, part long, before string, chunk string"))
    short = found.where("row is null").select("doc_id", "n_bytes", "n_tokens")
    long = found.where("row is not null and part is null").select("doc_id", "n_bytes", "row")
    last = found.agg(F.max("part")).first()[0]
    if last is None:
        return _limited(short, limit)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row, part, before, text = (batch.column(c)[i].as_py() for c in range(4))
                of = machine.state_map(part == 0, before, text)
                yield _map_rows(row, part, {named(a): (named(b), n) for a, (b, n) in of.items()})

    schema = "row long, part long, begin array<string>, end array<string>, n array<long>"
    parts = found.where("part is not null").select("row", "part", "before", "chunk")
    maps_of = parts.repartition(F.col("row"), F.col("part")).mapInArrow(maps, schema)

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        each = [dict(zip(b, zip(e, n))) for b, e, n in zip(*(rows[c].to_pylist() for c in ("begin", "end", "n")))]
        return pa.Table.from_batches([_map_rows(rows["row"][0].as_py(), rows["group"][0].as_py(), composed(each))])

    left = last + 1
    while True:
        left = -(-left // FAN_IN)
        maps_of = maps_of.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("row", "group").applyInArrow(compose, schema)
        if left <= 1:
            break

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens that the last state still holds back."""
        machine = transducer(path)
        for batch in batches:
            ends, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            total = [n[0] + machine.state(_key(e[0])).rest if n else None for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], names=["row", "n_tokens"])

    totals = settled(maps_of.select("row", "end", "n").mapInArrow(rest, "row long, n_tokens long"))
    if totals.where("n_tokens is null").limit(1).count():
        totals = totals.where("n_tokens is not null").unionByName(_read_through(parts.join(totals.where("n_tokens is null").select("row"), "row", "left_semi"), path))
    return _limited(short.unionByName(long.join(totals, "row").select("doc_id", "n_bytes", "n_tokens")), limit)


def _read_through(parts: DataFrame, path: str) -> DataFrame:
    """(row, n_tokens) of texts in chunks, one chunk after the other; a text was one row of the input, so one task may hold it."""

    def read(rows: pa.Table) -> pa.Table:
        machine, rows = transducer(path), rows.sort_by("part")
        state, n = machine.behind_space, 0
        for text in rows["chunk"]:
            state, more = machine.run(state, text.as_py())
            n += more
        return pa.table({"row": rows["row"][:1], "n_tokens": pa.array([n + state.rest], pa.int64())})

    return parts.select("row", "part", "chunk").groupBy("row").applyInArrow(read, "row long, n_tokens long")


def _map_rows(row: int, part: int, of: dict[str, tuple[str, int]]) -> pa.RecordBatch:
    strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())
    columns = [pa.array([row], pa.int64()), pa.array([part], pa.int64()), pa.array([list(of)], strings), pa.array([[e for e, _ in of.values()]], strings), pa.array([[n for _, n in of.values()]], longs)]
    return pa.RecordBatch.from_arrays(columns, names=["row", "part", "begin", "end", "n"])


def _key(name: str) -> Key:
    read, opened = json.loads(name)
    return read, tuple(map(tuple, opened))


def _limited(counts: DataFrame, limit: int) -> DataFrame:
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


__all__ = ["Transducer", "composed", "named", "token_counts", "transducer"]
