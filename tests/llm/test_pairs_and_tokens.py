"""Token counts, alignment and hard negatives against the libraries and against loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quadrille.llm import alignment, negatives, tokencounts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "   ", "a  b ", " a", "a \n b\n\n  c", "\n", "x\x00y\ty", "▁ a▁b", "<s>a</s><unk><0x41>", "<|endoftext|> x", "①② é 語言模型🙂 ﬁ", "é     b 　c", "aaaa" * 40, "0123 456,789.-" * 9, "don't  we'll", "​ ​", "\x1c \x1d x", "a\u0085 b", "tab\t space \t x"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pieces = [p.replace("▁", " ") for p in tokencounts.transducer(PIECES).score]
    some = ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(120)]
    return HARD + some + ["".join(rng.choices("aeinst h \n", k=rng.randint(1, 60))) for _ in range(120)] + [c * n for c in " a=-\n①" for n in (1, 2, 3, 7, 16, 17, 33)]


# --- token counts ---
def counts(spark, rows, **options):
    got = tokencounts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row int"), PIECES, **options).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got)


def counted(rows, limit=4096):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sizes = [(-1 if i is None else i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows]
    return sorted((*s, s[2] > limit) for s in sizes)


def test_token_counts(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, None, None), (None, "no id", None, 2), (1, "twice", "", 3), (1, "twice", "", 3)]
    assert counts(spark, rows) == counted(rows)
    assert counts(spark, rows, limit=12) == counted(rows, 12)
    assert counts(spark, []) == []


def test_token_counts_of_chunks(spark, texts):
    """Chunks of a few characters, so that most texts are maps composed in a tree; and long texts without any place to cut."""
    long = ["ab" * 4000, " " * 5000, "a" * 5001, "words and words " * 700, "①" * 3000, "".join(texts)]
    rows = [(i, t, None, i) for i, t in enumerate(texts + long)]
    assert counts(spark, rows, chunk=37, context=64) == counted(rows)
    rows = rows[-len(long) :]
    assert counts(spark, rows, chunk=1000) == counted(rows)


def test_a_map_without_the_state_is_read_through(spark):
    """With no context the maps know one start state only, and texts are read from the front where another comes in."""
    rows = [(i, t, None, None) for i, t in enumerate(["a" * 400, " " * 300, "words of some length " * 20, "unaffable" * 50])]
    assert counts(spark, rows, chunk=23, context=0) == counted(rows)


def test_states_made_anew():
    machine, library = tokencounts.Transducer(PIECES, states=50), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("some words that lead to many states, more than are kept", "other words again", "a" * 99):
        assert machine.count(text) == len(library.encode(text)) and len(machine.states) <= 50


# --- alignment ---
def by_hand(rows):
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    shown = {chr(c): x for x, c in alignment.BYTE_CHARS.items()}
    docs, pairs = [], Counter()
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        of_a = [bytes(shown[c] for c in a.id_to_token(x)) for x in ids_a]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, b.id_to_piece(x)) for x in ids_b)]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            docs.append((i, [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]), np.cumsum([len(x) for x in of_b])
        at_a, at_b = ({e: n + 1 for n, e in enumerate(ends.tolist())} for ends in (ends_a, ends_b))
        both = [0, *sorted({*at_a} & {*at_b})]
        links = [(ids_a[at_a[e] - 1], ids_b[at_b[e] - 1]) for e in both[1:]]
        cut = lambda ids, at, lo, hi: ",".join(map(str, ids[at.get(lo, 0) : at[hi]]))
        groups = [cut(ids_a, at_a, lo, hi) + "|" + cut(ids_b, at_b, lo, hi) for lo, hi in zip(both, both[1:])]
        pairs.update(links)
        docs.append((i, ids_a, ids_b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(n, best.get(y, 0))
    return sorted((-1 if i is None else i, len(x), len(y), len(k), len(k), sum(pairs[p] == best[p[1]] for p in k), sum(pairs[p] for p in k), h) for i, x, y, k, h in docs)


def aligned(spark, rows, sizes=alignment.Sizes()):
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS stripe"), BYTES, PIECES, sizes).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)


def test_alignment(spark, texts):
    rows = [*enumerate(texts), (None, "no id"), (900, None), (1, "twice the same"), (1, "twice the same")]
    assert aligned(spark, rows) == by_hand(rows)
    assert aligned(spark, []) == []


def test_alignment_of_many_batches(spark, texts):
    """Small batches and tasks: links of a stripe dealt over tasks, blocks added in a tree, memory of stretches begun anew, a document larger than a batch."""
    rows = [*enumerate(texts * 2), (999, " ".join(texts))]
    assert aligned(spark, rows, alignment.Sizes(stripe=128, per_task=20, fan_in=2, batch_links=300, batch_docs=64, memo=100)) == by_hand(rows)


def test_blobs():
    for columns in ([[0, 0, 5, 1 << 40], [7, 0, 300, 2]], [[], []], [[3], [1 << 62]]):
        got = alignment.unpack(alignment.pack(*(np.array(c, np.int64) for c in columns)))
        assert [g.tolist() for g in got] == columns


# --- hard negatives ---
def negatives_by_hand(rows, step=5, low=50, high=95):
    ok = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, v in ok:
        if i % step == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in ok if len(v) == len(w) and (j != i or z != y))
            for p, j, _ in [s for s in score if s[2] == y and s[1] != i][:5]:
                fits = [(s, n) for s, n, z in score if z != y and -low * p <= -100 * s <= -high * p][:3]
                out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "0 AS row", "'x' AS e")
    got = negatives.hard_negatives(df, df.where("vec_id % 5 = 0"), **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def vectors(n, d, seed, classes=4, noise=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (classes, d)) * np.linspace(1.5, 0.1, d)
    label = rng.integers(0, classes, n)
    x = (0.6 * centre[label] + centre[rng.integers(0, classes, n)] + noise * rng.normal(0, 0.4, (n, d))).astype(np.float32)
    return [(int(i), [float(v) for v in x[i]], int(label[i])) for i in rng.permutation(n)]


def test_hard_negatives(spark):
    rows = vectors(160, 16, 3)
    odd = [(500, None, 1), (505, [1.0] + [None] * 15, 1), (510, [float("nan")] * 16, 2), (515, [float("inf")] * 16, 0), (520, [1.0] * 16, None), (525, [1.0, 2.0], 1), (526, [1.0, 2.5], 1), (527, [0.75, 1.5], 2), (530, [], 1), (531, [], 2), (532, [], 1), (None, rows[0][1], 1)]
    want = negatives_by_hand(rows + odd)
    assert len(want) > 100 and mined(spark, rows + odd) == want
    assert mined(spark, rows + odd, shard=20, block=7) == want
    assert mined(spark, []) == []


def test_hard_negatives_of_ties_and_repeats(spark):
    """Half of all rows are one vector under many ids; labels differ; whole numbers far beyond doubles."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 1.0], i % 2) for i in range(120)] + [(200 + i, [float(rng.integers(0, 3)), 0.7], int(rng.integers(0, 3))) for i in range(80)]
    assert mined(spark, rows, shard=30) == negatives_by_hand(rows)
    large = [(i, [float(np.float32(x)) for x in rng.normal(0, 2e6, 3)], i % 3) for i in range(60)]
    assert mined(spark, large) == negatives_by_hand(large)
    twice = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.5], 2), (2, [0.75, 0.5], 2)]
    assert len(mined(spark, twice)) == 4


def test_bounds_discard_early_and_lose_nothing():
    rng = np.random.default_rng(2)
    d = 32
    x = np.floor(256 * (rng.normal(0, 1, (400, d)) * np.geomspace(1, 0.01, d)) @ np.linalg.qr(rng.normal(0, 1, (d, d)))[0])
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    side = negatives.Side.of(np.arange(400), np.zeros(400, int), x, turn, negatives.cuts_of(d))
    a = side.part(0, 50)
    allowed = a.ids[:, None] != side.ids[None, :]
    ends = [np.full(50, e, np.int64) for e in (negatives.LOWEST, negatives.HIGHEST)]
    i, j, work = negatives.survivors(a, side, allowed, 5, *ends, negatives.cuts_of(d))
    exact = np.where(allowed, a.vectors @ side.vectors.T, -np.inf)
    kept = set(zip(i.tolist(), j.tolist()))
    for r in range(50):
        best = np.sort(exact[r])[-5]
        assert all((r, c) in kept for c in np.flatnonzero(exact[r] >= best))
    assert len(kept) < 0.05 * allowed.size and work < 0.5 * allowed.size * d
