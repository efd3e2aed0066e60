"""Hashed terms of texts in windows, for the toxicity model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np

TERM = re.compile(r"\w+")
#: A word's terms: itself and its beginnings of so many characters.
HEADS = (4, 6)
TERMS = 1 + len(HEADS)


class Hasher(dict):
    """word -> row of a table of its hashed terms; keeps what it has met, up to a size (it changes speed only)."""

    def __init__(self, buckets: int, most: int = 200_000) -> None:
        super().__init__()
        self.buckets, self.most = buckets, most
        self.rows = np.empty((1024, TERMS), np.int32)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        if row == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        terms = [word, *(f"{n} {word[:n]}" for n in HEADS)]
        self.rows[row] = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % self.buckets for t in terms]
        return row

    def terms(self, words: list[str]) -> np.ndarray:
        """The terms of words, a row for each."""
        if len(self) >= self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at]


@dataclass
class Windows:
    """The distinct hashed terms of windows of some texts."""

    term: np.ndarray
    #: log2(1 + count) of each term.
    x: np.ndarray
    #: Where each window begins in term and x.
    first: np.ndarray
    #: Each window's text.
    doc: np.ndarray

    def only(self, active: np.ndarray) -> Windows:
        """Without the terms that take no part."""
        keep = active[self.term]
        return Windows(self.term[keep], self.x[keep], np.r_[0, np.cumsum(keep)][self.first], self.doc)


def slices(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and where each range begins in them."""
    size = ends - begins
    at = np.cumsum(size) - size
    return np.repeat(begins - at, size) + np.arange(int(size.sum())), at


def words_of(text: str) -> Iterator[str]:
    text = text.lower()
    return iter(TERM.findall(text)) if len(text) < 1 << 20 else (m[0] for m in TERM.finditer(text))


def windows(texts: list[str], hasher: Hasher, width: int, most: int = 1 << 16) -> Iterator[Windows]:
    """All windows of `width` words of whole texts, one beginning at each half width, about `most` words at a time, so that memory doesn't follow a text's length.

    A window has one term more, which tells its length in words by powers of two. A text
    without words has no window.
    """
    half = width // 2
    step = half * max(2, most // half)
    parts: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        words, carry = words_of(text), np.empty((0, TERMS), np.int32)
        while block := list(islice(words, step)):
            terms = np.concatenate([carry, hasher.terms(block)])
            parts.append((i, terms))
            carry = terms[-half:] if len(block) == step else carry[:0]  # the next block's first window begins here
            held += len(terms)
            if held >= most:
                yield _windows(parts, hasher.buckets, half)
                parts, held = [], 0
    if parts:
        yield _windows(parts, hasher.buckets, half)


def _windows(parts: list[tuple[int, np.ndarray]], buckets: int, half: int) -> Windows:
    sizes = np.array([len(x) for _, x in parts])
    per_part = np.maximum(1, -(-sizes // half) - 1)
    total = int(per_part.sum())
    begins = np.cumsum(per_part) - per_part
    at = (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // half
    terms = np.concatenate([x for _, x in parts])
    # a word stands in the window that begins with its half and in the one before, where there are such
    own, before = at < np.repeat(per_part, sizes), at > 0
    window = np.repeat(begins, sizes) + at
    window = np.concatenate([window[own], window[before] - 1])
    length = np.log2(np.bincount(window, minlength=total)).astype(np.int64)
    kind = np.array([length_term(i, buckets) for i in range(int(length.max()) + 1)])[length]
    keys = np.concatenate([(window[:, None] * buckets + np.concatenate([terms[own], terms[before]])).ravel(), np.arange(total) * buckets + kind])
    both, count = np.unique(keys, return_counts=True)
    first = np.searchsorted(both, np.arange(total) * buckets)
    return Windows(both % buckets, np.log2(1.0 + count).astype(np.float32), first, np.repeat([i for i, _ in parts], per_part))


def length_term(power: int, buckets: int) -> int:
    return zlib.crc32(b"length %d" % power) % buckets
