"""Copies of images, cropped or edited, by local descriptors.

On each of several scales all corners of an image get a 64-bit descriptor: binary
intensity tests around the corner, turned by its orientation. A corner and its nearest
neighbours form a constellation. Hamming tables are keyed by one block of the bits of all its
descriptors and by where its members lie in the corner's own frame; images that share a key
are candidates. Their constellations are then compared bit by bit, each gives a transform,
and the corners that one transform puts in their places are counted: images are linked by
this consensus, not by a key.

A key's smallest image is its hub, and the images that share keys with a hub are its star. All pairs of a star's
images that share keys and can have enough corners in common are compared, a pair of several stars in the first of them; so no pair that shares
a key is left out, and an image's corners are sent once for each of its stars, not for each partner. Large stars are dealt to
tasks by pairs of blocks. Tasks return a row for each image, not its pairs.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled, with_group_min
from .shingles import least_rows

#: Scales by which a picture of a page is shrunk (these are never resized), and other images, by steps of 2^(1/6): two match where a factor leads from one's scale to the other's.
SCALES, LADDER = (1.0, 2.0), tuple(round(2 ** (i / 6), 2) for i in range(13))
#: Members of a constellation. All corners of an image are described.
MEMBERS = 3
#: Pixels of a cell in which a member's place is told; bits in which descriptors of one corner may differ.
PLACE, RADIUS = 2, 16
#: Corners that must agree on one transform; by how many pixels, and by what share of their distance, they may miss their places.
LEAST, TOLERANCE, DRIFT = 5, 2.5, 0.15
#: Keys that a block of images holds about, and keys of a bucket of the join.
BLOCK_KEYS, BUCKET_KEYS = 1 << 19, 1 << 20
#: Pictures of a block of a star: the least and the most, and how many blocks a star has between these; corners of a block, corners unpacked at once and matches compared at once, about.
FEW_PICTURES, MANY_PICTURES, BLOCKS, BLOCK_CORNERS, SHEET, MATCHES = 256, 4096, 16, 1 << 19, 1 << 17, 1 << 18
#: Repeated digests, and rows of images in stars, of which so many are broadcast at most; more are joined by shuffle.
BROADCAST_ENDS = 1 << 18
#: Pixels described at once; side of a tile of a larger image, and what a corner's descriptor reaches beyond it.
AT_ONCE, TILE, HALO = 1 << 19, 512, 16
#: Pixels of small images described together.
TOGETHER = 1 << 17
#: Heights are padded to these pixels, to describe images together.
PAD = 24
#: Up to so many corners all distances are taken at once.
FEW = 256
BORDER, TURNS, TESTS = 6, 16, 64
#: A corner is the strongest place within the sum of these pixels.
SPREAD = (1, 3)
#: Hamming tables, 16 bits of each descriptor a table: for images that may be resized, and for pages' pictures.
TABLES, PAGE_TABLES = 4, 2
_rng = np.random.default_rng(64)
_pairs = np.clip(_rng.normal(0, 2.2, (TESTS, 2, 2)), -4, 4)
_angles = 2 * np.pi * np.arange(TURNS) / TURNS
_turn = np.stack([np.stack([np.cos(_angles), -np.sin(_angles)], -1), np.stack([np.sin(_angles), np.cos(_angles)], -1)], -2)
#: Offsets (turn, test, end, xy) of the binary tests.
_OFFSETS = np.clip(np.rint(np.einsum("tij,nej->tnei", _turn, _pairs)), 1 - BORDER, BORDER - 1).astype(np.int64)


# --- pixels ---
def decode(data: bytes | None) -> np.ndarray | None:
    """Gray pixels of a binary PGM or PPM or of a PNG (8 bits, not interlaced); else None."""
    if not data:
        return None
    if data[:2] in (b"P5", b"P6"):
        m = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+255\s", data)
        if not m:
            return None
        depth, (w, h) = 1 if m[1] == b"5" else 3, (int(m[2]), int(m[3]))
        raw = np.frombuffer(data, np.uint8, offset=m.end())
        if len(raw) < w * h * depth:
            return None
        return raw[: w * h * depth].reshape(h, w, depth).mean(axis=2).astype(np.uint8)
    return _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else None


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", None
    try:
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            head, body = (struct.unpack(">IIBBBBB", part), body) if kind == b"IHDR" else (head, body + part if kind == b"IDAT" else body)
            at += 12 + size
        w, h, bits, color, _, _, interlaced = head
        depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
        if bits != 8 or interlaced or depth is None:
            return None
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * depth)
    except (struct.error, zlib.error, ValueError, TypeError):
        return None
    out = np.zeros((h, w * depth), np.int64)
    above = np.zeros(w * depth, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind:
            line = _unfilter(int(kind), line, above, depth)
        out[y] = above = line
    out = out.reshape(h, w, depth)
    return out[:, :, : 3 if depth > 2 else 1].mean(axis=2).astype(np.uint8)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    done = line.tolist()
    up = above.tolist()
    for i in range(len(done)):
        a, b, c = (done[i - depth] if i >= depth else 0), up[i], (up[i - depth] if i >= depth else 0)
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        done[i] = (done[i] + guess) & 255
    return np.array(done, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)
#: A page's picture: pixels of a word's cell, words of a row at most, one of how many words ends a row, and rows at least.
CELL, ROW, STOP, ROWS = 3, 16, 8, 5


def page_image(html: str | None) -> np.ndarray:
    """A page's words as a picture, ROW cells wide: each word a shade by its hash.

    A row ends behind a word whose hash says so, or when it is full; the cells behind its last word
    get shades by that word, as blank ones would look alike on all pages. So a word more, less or
    changed alters the rows next to it alone, and a part of a page shows the same rows. The
    picture grows down with the page, from ROWS rows, so every word has a cell of its own.
    """
    words = _TAG.sub(" ", html or "").encode("utf-8", "surrogatepass").split()  # at ASCII white space
    shade = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    ends = np.unique(np.r_[np.flatnonzero((shade >> 8) % STOP == 0) + 1, len(words)])
    begins = np.r_[0, ends[:-1]]
    rows = -(-(ends - begins) // ROW)
    place = np.arange(len(words)) - np.repeat(begins, ends - begins)
    out = np.zeros((max(ROWS, int(rows.sum())), ROW), np.uint8)
    if words:
        behind = _mix(shade[ends - 1, None].astype(np.uint64) * np.uint64(ROW) + np.arange(ROW, dtype=np.uint64)).astype(np.uint8)
        out[np.cumsum(rows) - 1] = behind
    out[np.repeat(np.cumsum(rows) - rows, ends - begins) + place // ROW, place % ROW] = shade & 255
    return np.repeat(np.repeat(out, CELL, axis=0), CELL, axis=1)


# --- descriptors ---
def _spread(x: np.ndarray, d: int, axis: int, of: np.ufunc) -> np.ndarray:
    """Each place with those d before and behind it along an axis; ends keep what they have."""
    out = x.copy()
    n, at = x.shape[axis], [slice(None)] * 3
    low, high = at.copy(), at.copy()
    low[axis], high[axis] = slice(0, max(0, n - d)), slice(d, n)
    low, high = tuple(low), tuple(high)
    of(out[high], x[low], out=out[high])
    of(out[low], x[high], out=out[low])
    return out


def _box(x: np.ndarray) -> np.ndarray:
    return _spread(_spread(x, 1, 1, np.add), 1, 2, np.add)


def _size(n: int, scale: float) -> int:
    """Pixels that _scaled makes of n."""
    whole = int(scale) if scale >= 2 else 1
    return int(n // whole / (scale / whole))


def _scaled(images: np.ndarray, scale: float) -> np.ndarray:
    h, w = images.shape[1:]
    if scale >= 2:  # whole pixels are averaged, so that none is left out
        whole = int(scale)
        h, w, scale = h // whole, w // whole, scale / whole
        rows = sum(images[:, i : h * whole : whole] for i in range(whole))
        images = sum(rows[:, :, i : w * whole : whole] for i in range(whole)) / np.float32(whole * whole)
    if scale == 1:
        return images
    ys, xs = (np.minimum((np.arange(int(n / scale)) * scale), n - 1) for n in (h, w))
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None].astype(np.float32), (xs - x0)[None, :].astype(np.float32)
    top = images[:, y0][:, :, x0] * (1 - fx) + images[:, y0][:, :, x1] * fx
    low = images[:, y1][:, :, x0] * (1 - fx) + images[:, y1][:, :, x1] * fx
    return top * (1 - fy) + low * fy


def describe(images: np.ndarray, heights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Images of one size (n, h, w) to corners: found (n, k) boolean, yx (n, k, 2), turn (n, k), bits (n, k) of 64.

    heights: the rows that belong to each image, where it was padded. No corner lies within BORDER
    pixels of the end, and nothing of it reaches further, so padding changes nothing.
    """
    x = images.astype(np.float32)
    n, h, w = x.shape
    if h <= 2 * BORDER + 1 or w <= 2 * BORDER + 1:
        return np.zeros((n, 0), bool), np.zeros((n, 0, 2), int), np.zeros((n, 0), int), np.zeros((n, 0), np.uint64)
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    np.subtract(x[:, 2:], x[:, :-2], out=gy[:, 1:-1])
    np.subtract(x[:, :, 2:], x[:, :, :-2], out=gx[:, :, 1:-1])
    a, b, c = _box(gx * gx), _box(gy * gy), _box(gx * gy)
    strength = a * b - c * c
    a += b
    a *= a
    a *= np.float32(0.06)
    strength -= a
    peak = strength
    for d in SPREAD:
        peak = _spread(_spread(peak, d, 1, np.maximum), d, 2, np.maximum)
    inner = np.zeros((h, w), bool)
    inner[BORDER:-BORDER, BORDER:-BORDER] = True
    value = (strength >= peak) & (strength > 1e4) & inner
    if heights is not None:
        value &= np.arange(h)[None, :, None] < np.where(heights > 2 * BORDER + 1, heights - BORDER, 0)[:, None, None]
    row, place = np.nonzero(value.reshape(n, -1))
    count = np.bincount(row, minlength=n)
    k = int(count.max())
    if not k:
        return np.zeros((n, 0), bool), np.zeros((n, 0, 2), int), np.zeros((n, 0), int), np.zeros((n, 0), np.uint64)
    # in the order of their places: the same in any copy
    found = np.arange(k) < count[:, None]
    y, x0 = place // w, place % w
    smooth = _box(x).ravel()
    own = row * (h * w) + place
    reach = np.arange(-3, 4)
    patch = smooth[own[:, None] + (reach[:, None] * w + reach).ravel()].astype(np.float64)
    my, mx = patch @ np.repeat(reach, 7).astype(np.float64), patch @ np.tile(reach, 7).astype(np.float64)
    turned = np.rint(np.arctan2(my, mx) * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
    # the turned tests' places in the flat image, one end and the other
    one, other = (smooth[own[:, None] + (_OFFSETS[..., e, 1] * w + _OFFSETS[..., e, 0])[turned]] for e in (0, 1))
    yx, turn, bits = np.full((n, k, 2), BORDER), np.zeros((n, k), np.int64), np.zeros((n, k), np.uint64)
    yx[found], turn[found] = np.stack([y, x0], axis=-1), turned
    bits[found] = np.packbits(one < other, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return found, yx, turn, bits


def describe_tiled(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As describe, of one image (1, h, w), tile by tile: memory follows a tile and the corners."""
    _, h, w = image.shape
    parts = []
    for y in range(0, h, TILE):
        for x in range(0, w, TILE):
            top, left = max(0, y - HALO), max(0, x - HALO)
            tile = image[:, top : y + TILE + HALO, left : x + TILE + HALO]
            found, yx, turn, bits = describe(tile)
            yx = yx + (top, left)
            own = found & (yx >= (y, x)).all(axis=2) & (yx < (y + TILE, x + TILE)).all(axis=2)
            parts.append((yx[own], turn[own], bits[own]))
    yx, turn, bits = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((yx[:, 1], yx[:, 0]))
    return np.ones((1, len(order)), bool), yx[order][None], turn[order][None], bits[order][None]


def nearest(yx: np.ndarray) -> np.ndarray:
    """Of corners of one scale, ordered by place, each one's MEMBERS nearest (k, MEMBERS): itself first, ties by place."""
    return _nearest_of(yx, np.array([0, len(yx)]))


def _nearest_of(yx: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As nearest, of several images and scales, each from one of `ends` to the next; runs of about one length are taken together."""
    out = np.zeros((len(yx), MEMBERS), np.int64)
    begin, size = ends[:-1], np.diff(ends)
    for r in np.flatnonzero(size > FEW):
        out[begin[r] : ends[r + 1]] = begin[r] + _nearest(yx[begin[r] : ends[r + 1]])
    wide = np.where((size > 0) & (size <= FEW), -(-size // 8) * 8, 0)
    for p in np.unique(wide[wide > 0]).tolist():
        same, step = np.flatnonzero(wide == p), max(1, (1 << 16) // (p * p))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            here = np.arange(p) < size[some, None]
            y, x = (yx[np.minimum(begin[some, None] + np.arange(p), len(yx) - 1), i] for i in (0, 1))
            span = max(int(np.ptp(y)), int(np.ptp(x))) + 1
            kind = np.int32 if 2 * span * span * p < 1 << 31 else np.int64
            y, x = y.astype(kind), x.astype(kind)
            away = (y[:, :, None] - y[:, None]) ** 2 + (x[:, :, None] - x[:, None]) ** 2
            away *= kind(p)
            away += np.arange(p, dtype=kind)
            np.copyto(away, np.iinfo(kind).max, where=~here[:, None])
            near = (_least(away) % p).astype(np.int64)
            out[(begin[some, None] + np.arange(p))[here]] = (begin[some, None, None] + near)[here]
    return out


def _least(away: np.ndarray) -> np.ndarray:
    """The MEMBERS least of the last axis, whose values differ, in order; they are overwritten there."""
    out = np.empty((*away.shape[:-1], MEMBERS), away.dtype)
    for m in range(MEMBERS):
        out[..., m] = away.min(axis=-1)
        if m < MEMBERS - 1:
            np.copyto(away, np.iinfo(away.dtype).max, where=away == out[..., m, None])
    return out


def _nearest(yx: np.ndarray) -> np.ndarray:
    """Of corners ordered by place, some at a time against those in rows about them; more rows where a neighbour may lie beyond."""
    k, out = len(yx), np.zeros((len(yx), MEMBERS), np.int64)
    y = yx[:, 0]
    for at in range(0, k, 128):
        own, reach = yx[at : at + 128], 16
        while True:
            low, high = np.searchsorted(y, own[0, 0] - reach), np.searchsorted(y, own[-1, 0] + reach, side="right")
            if high - low >= MEMBERS:
                away = ((own[:, None, 0] - yx[low:high, 0]) ** 2 + (own[:, None, 1] - yx[low:high, 1]) ** 2) * k + np.arange(low, high)
                best = _least(away)
                if (low == 0 and high == k) or (best[:, -1] // k <= reach * reach).all():
                    break
            reach *= 2
        out[at : at + 128] = best % k
    return out


# --- constellations ---
class Corners(NamedTuple):
    """All corners of one image on all scales, ordered by scale and place. yx counts pixels of the scale."""

    scale: np.ndarray
    yx: np.ndarray
    turn: np.ndarray
    bits: np.ndarray

    def packed(self) -> bytes:
        """Descriptors as they are, places compressed."""
        places = np.concatenate([self.yx.T.ravel(), self.turn, np.round(self.scale * 100).astype(np.int64)]).astype("<i4")
        return struct.pack("<I", len(self.bits)) + self.bits.astype("<u8").tobytes() + zlib.compress(places.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Corners:
        n = struct.unpack_from("<I", data)[0]
        bits = np.frombuffer(data, "<u8", n, 4).astype(np.uint64)
        places = np.frombuffer(zlib.decompress(data[4 + 8 * n :]), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)
        return cls(places[3 * n :] / 100, places[: 2 * n].reshape(2, n).T, places[2 * n : 3 * n], bits)


def corners(images: np.ndarray, scales: tuple[float, ...] = LADDER, heights: np.ndarray | None = None) -> list[Corners]:
    """The corners of each image, all images being of one size, padded below their `heights` if need be."""
    n = len(images)
    parts: list[list[tuple]] = [[] for _ in range(n)]
    for scale in scales:
        if min(_size(x, scale) for x in images.shape[1:]) <= 2 * BORDER + 1:
            break  # no corner has room, nor has one on the scales to come
        shrunk = _scaled(images.astype(np.float32), scale)
        own_heights = None if heights is None else np.array([_size(int(x), scale) for x in heights])
        found, yx, turn, bits = describe_tiled(shrunk) if n == 1 and heights is None and shrunk.size > AT_ONCE else describe(shrunk, own_heights)
        for i in np.flatnonzero(found.sum(axis=1) >= MEMBERS):
            own = found[i]
            parts[i].append((np.full(int(own.sum()), scale), yx[i][own], turn[i][own], bits[i][own]))
    none = Corners(np.empty(0), np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    return [Corners(*(np.concatenate([p[j] for p in some]) for j in range(4))) if some else none for some in parts]


def sheet(found: list[Corners]) -> tuple[Corners, np.ndarray]:
    """The corners of several images in one, and the image of each."""
    return Corners(*(np.concatenate([c[j] for c in found]) for j in range(4))), np.repeat(np.arange(len(found)), [len(c.bits) for c in found])


def constellations(found: Corners, image: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sheet's corners the constellation (k, MEMBERS) that each begins and its keys (tables, k)."""
    fresh = np.flatnonzero(np.r_[True, (image[1:] != image[:-1]) | (found.scale[1:] != found.scale[:-1])]) if len(image) else np.empty(0, np.int64)
    near = _nearest_of(found.yx, np.r_[fresh, len(image)])
    step = found.yx[near[:, 1:]] - found.yx[:, None]
    own = np.einsum("kij,kmj->kmi", _turn[(-found.turn) % TURNS], step[..., ::-1].astype(np.float64))
    place = np.rint(own / PLACE).astype(np.int64) & 0xFF
    turned = (found.turn[near[:, 1:]] - found.turn[:, None]) % TURNS
    words = found.bits[near]
    key = np.full(len(near), 0x9E3779B97F4A7C15, np.uint64)
    for m in range(MEMBERS - 1):
        key = _mix(key ^ (place[:, m, 0] | place[:, m, 1] << 8 | (turned[:, m] // 2) << 16).astype(np.uint64))
    out = np.empty((tables, len(near)), np.uint64)
    for t in range(tables):
        own_key = _mix(key ^ np.uint64(t + 1))
        for m in range(MEMBERS):
            own_key = _mix(own_key ^ ((words[:, m] >> np.uint64(16 * t)) & np.uint64(0xFFFF)))
        out[t] = own_key
    return near, out


def keys(found: Corners, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """The Hamming tables' keys of an image's constellations (m) and the corners (m, MEMBERS) each speaks of; every key once, at its first place."""
    near, out = constellations(found, np.zeros(len(found.bits), np.int64), tables)
    distinct, at = np.unique(out.ravel(), return_index=True)
    return distinct, near[at % max(1, len(near))]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of equal neighbours."""
    ends = np.flatnonzero(np.r_[x[1:] != x[:-1], True]) + 1 if len(x) else np.empty(0, int)
    return list(zip([0, *ends[:-1].tolist()], ends.tolist()))


def consensus(a: Corners, b: Corners, least: int = LEAST, tables: int = TABLES) -> int:
    """How many corners of a lie in b where one similarity transform puts them: 0 without a common constellation. See agreements."""
    (ka, ma), (kb, mb) = keys(a, tables), keys(b, tables)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both, _ = sheet([a, b])
    return int(agreements(both, np.zeros(len(ia), np.int64), ma[ia], len(a.bits) + mb[ib], 1, least)[0])


def agreements(found: Corners, pair: np.ndarray, ma: np.ndarray, mb: np.ndarray, n: int, least: int) -> np.ndarray:
    """Votes of n pairs of images, by their constellations ma and mb (m, MEMBERS; corners of a sheet) that share a key; `pair` tells whose.

    Constellations are compared bit by bit: each member's descriptors differ in RADIUS
    bits at most. Each of them then gives a transform (least squares over its members), and
    corners of all the pair's constellations vote for it that lie within TOLERANCE pixels, and a
    share DRIFT of their distance from it. The transform with most votes counts; once one has `least`, no more are tried for that
    pair. Pairs with fewer than `least` corners in such constellations have 0.
    """
    close = (np.bitwise_count(found.bits[ma] ^ found.bits[mb]) <= RADIUS).all(axis=1)
    pair, ma, mb = pair[close], ma[close], mb[close]
    order = np.lexsort((mb[:, 0], ma[:, 0], pair))  # a constellation is told by its first corner
    pair, ma, mb = pair[order], ma[order], mb[order]
    new = np.r_[np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]) | (ma[1:, 0] != ma[:-1, 0]) | (mb[1:, 0] != mb[:-1, 0])]
    pair, ma, mb = pair[new], ma[new], mb[new]
    kept = (np.bincount(pair, minlength=n) * MEMBERS >= least)[pair]
    pair, ma, mb = pair[kept], ma[kept], mb[kept]
    lp, la, lb = np.repeat(pair, MEMBERS), ma.ravel(), mb.ravel()
    order = np.lexsort((lb, la, lp))
    lp, la, lb = lp[order], la[order], lb[order]
    fresh = np.r_[np.ones(min(1, len(lp)), bool), (lp[1:] != lp[:-1]) | (la[1:] != la[:-1])]
    enough = np.bincount(lp[fresh], minlength=n) >= least
    new = (fresh | np.r_[np.ones(min(1, len(lp)), bool), lb[1:] != lb[:-1]]) & enough[lp]
    lp, la, lb = lp[new], la[new], lb[new]
    kept = enough[pair]
    pair, ma, mb = pair[kept], ma[kept], mb[kept]
    at = (found.yx * found.scale[:, None]) @ np.array([1j, 1])  # x + iy in pixels of the image itself
    qa, qb = at[ma], at[mb]
    ca, cb = qa.mean(axis=1), qb.mean(axis=1)
    za, zb = qa - ca[:, None], qb - cb[:, None]
    turn = (zb * za.conj()).sum(axis=1) / np.maximum((abs(za) ** 2).sum(axis=1), 1e-9)  # rotation and scale as one number
    xa, xb = at[la], at[lb]
    first, links = np.searchsorted(lp, np.arange(n)), np.bincount(lp, minlength=n)
    begin, end = np.searchsorted(pair, np.arange(n)), np.searchsorted(pair, np.arange(n), side="right")
    best, tried, step = np.zeros(n, np.int64), 0, 1
    while len(open_ := np.flatnonzero((begin + tried < end) & (best < least))):
        count = np.minimum(end[open_] - begin[open_] - tried, step)
        some = np.repeat(begin[open_] + tried - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        wide = np.cumsum(links[pair[some]])
        for s, e in _slices(wide, MATCHES):
            which = some[s:e]
            which = which[best[pair[which]] < least]
            size = links[pair[which]]
            t = np.repeat(np.arange(len(which)), size)
            link = np.repeat(first[pair[which]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(which) else t
            away = abs(cb[which][t] + turn[which][t] * (xa[link] - ca[which][t]) - xb[link])
            fits = away <= TOLERANCE * np.maximum(1, abs(turn[which]))[t] + DRIFT * abs(xb[link] - cb[which][t])
            t, corner = t[fits], la[link[fits]]
            votes = np.bincount(t[np.r_[np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (corner[1:] != corner[:-1])]], minlength=len(which))
            np.maximum.at(best, pair[which], votes)
        tried, step = tried + step, min(16, 2 * step)
    return best


def _slices(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches whose running totals grow by at most so much, but for single ones."""
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


# --- features ---
FEATURES = "image_id long, digest long, pixels long, n_corners long, corners binary"


def _features(rows: Iterator[tuple[list, list[np.ndarray | None]]], scales: tuple[float, ...] = LADDER) -> Iterator[pa.RecordBatch]:
    for ids, images in rows:
        digest = [None if x is None else xxhash.xxh3_64_intdigest(repr(x.shape).encode() + x.tobytes()) - (1 << 63) for x in images]
        found: list[Corners | None] = [None] * len(ids)
        by: dict[tuple[int, int], list[int]] = {}
        for i, x in enumerate(images):
            if x is not None:  # images of about one height are described together
                by.setdefault((-(-x.shape[0] // PAD) * PAD, x.shape[1]), []).append(i)
        for (high, wide), same in by.items():
            step = min(64, max(1, TOGETHER // max(1, high * wide)))
            for at in range(0, len(same), step):
                some = same[at : at + step]
                if step == 1:
                    found[some[0]] = corners(images[some[0]][None], scales)[0]
                    continue
                padded, heights = np.zeros((len(some), high, wide), np.float32), np.array([images[j].shape[0] for j in some])
                for k, j in enumerate(some):
                    padded[k, : heights[k]] = images[j]
                for i, own in zip(some, corners(padded, scales, heights)):
                    found[i] = own
        columns = (ids, digest, [0 if x is None else x.size for x in images], [0 if c is None else len(c.bits) for c in found])
        packed = [None if c is None else c.packed() for c in found]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(packed, pa.binary())], names=["image_id", "digest", "pixels", "n_corners", "corners"])


def media_features(media: DataFrame) -> DataFrame:
    """media (image_id, image: encoded bytes) to FEATURES. What isn't a readable image has a null digest and no corners. A null id is kept; every row counts."""
    rows = media.select(F.col("image_id").cast("bigint"), F.col("image").cast("binary"))
    return rows.mapInArrow(lambda batches: _features((b.column(0).to_pylist(), [decode(x) for x in b.column(1).to_pylist()]) for b in batches), FEATURES)


def page_features(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) to FEATURES of their pictures. Null html is an empty page: a blank picture, equal to those of all other empty pages."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("html").cast("string"))
    return rows.mapInArrow(lambda batches: _features(((b.column(0).to_pylist(), [page_image(x) for x in b.column(1).to_pylist()]) for b in batches), SCALES), FEATURES)


# --- joins ---
def _key_blocks(batches: Iterator[pa.RecordBatch], buckets: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(digest, corners) to rows (bucket, images, block) for the Hamming-table join: every key of every image, once.

    Some images at a time, so that keys lie close and compress. A block lists its images; each key takes 5 bytes beside its
    bucket, and 1 to 4 for its image.
    """

    def flush() -> pa.RecordBatch:
        digests, which = np.unique(np.array(ids, np.int64), return_index=True)
        found, image = sheet([held[i] for i in which])
        key, image = constellations(found, image, tables)[1].ravel(), np.tile(image, tables)
        bucket, rest = (key % np.uint64(buckets)).astype(np.int64), key // np.uint64(buckets) & np.uint64((1 << 40) - 1)
        order = np.lexsort((image, rest, bucket))
        bucket, rest, image = bucket[order], rest[order], image[order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1]) | (image[1:] != image[:-1])]
        bucket, rest, image = bucket[new], rest[new], image[new]
        rows: list[tuple] = []
        for begin, end in _runs(bucket):
            mine, which = np.unique(image[begin:end], return_inverse=True)
            steps = np.diff(rest[begin:end], prepend=np.uint64(0))
            block = _columns(steps, 5) + _columns(which, _width(len(mine)))
            rows.append((int(bucket[begin]), digests[mine].astype("<i8").tobytes(), zlib.compress(block, 1)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["bucket", "images", "block"])

    ids: list[int] = []
    held: list[Corners] = []
    total = 0
    for batch in batches:
        for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = Corners.unpacked(data)
            if len(own.bits):
                ids.append(digest)
                held.append(own)
                total += len(own.bits) * tables
            if total >= BLOCK_KEYS:
                yield flush()
                ids, held, total = [], [], 0
    if held:
        yield flush()


def _width(n: int) -> int:
    """Bytes of an index below n."""
    return 1 if n <= 1 << 8 else 2 if n <= 1 << 16 else 4


def _columns(x: np.ndarray, wide: int) -> bytes:
    """The lower `wide` bytes of whole numbers, the first bytes of all, then the second: these compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _uncolumned(raw: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw) // max(1, n)] = raw.reshape(-1, n).T
    return out.view("<u8").ravel()


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, as _key_blocks wrote them, to pairs (a, b): of each key the smallest image with every other."""
    keys_, images = [np.empty((0, 2), np.uint64)], [np.empty(0, np.int64)]
    for batch in batches:
        for bucket, listed, block in zip(*(c.to_pylist() for c in batch.columns)):
            mine = np.frombuffer(listed, "<i8")
            wide = _width(len(mine))
            raw = np.frombuffer(zlib.decompress(block), np.uint8)
            n = len(raw) // (5 + wide)
            rest = np.cumsum(_uncolumned(raw[: 5 * n], n))
            keys_.append(np.stack([np.full(n, bucket, np.uint64), rest], axis=1))
            images.append(mine[_uncolumned(raw[5 * n :], n).astype(np.int64)])
    key, image = np.concatenate(keys_), np.concatenate(images)
    order = np.lexsort((image, key[:, 1], key[:, 0]))
    key, image = key[order], image[order]
    first = np.r_[np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]).any(axis=1)]
    hub = image[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else image
    whole = np.unique(np.stack([hub, image], axis=1)[hub != image], axis=0)
    for at in range(0, len(whole), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(whole[at : at + (1 << 16), i]) for i in range(2)], names=["a", "b"])


def candidates(pictures: DataFrame, n_keys: int, tables: int = TABLES) -> DataFrame:
    """pictures (digest, corners), each digest once, to distinct pairs (a, b) of digests: of each key's images, the smallest with the others."""
    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    blocks = pictures.select("digest", "corners").mapInArrow(lambda b: _key_blocks(b, buckets, tables), "bucket long, images binary, block binary")
    return blocks.repartition(buckets, "bucket").mapInArrow(_bucket_pairs, "a long, b long").distinct()


class Member(NamedTuple):
    """An image of a star: its block there, the smaller hubs whose stars hold it too."""

    digest: int
    block: int
    before: list[int]
    corners: Corners


def _matches(cells: list[tuple[tuple[int, int, int], list[Member]]], least: int, tables: int) -> pa.RecordBatch:
    """Cells ((hub, i, j), members), pairs of blocks i and j of a star, to a row for each linked image: (a, b, n), b having n links there, a the smallest image they lead to."""
    rows = sorted(((c, m) for c, (_, some) in enumerate(cells) for m in some), key=lambda r: (r[0], r[1].digest))
    cell, digest, block = (np.array(x, np.int64) for x in ([c for c, _ in rows], [m.digest for _, m in rows], [m.block for _, m in rows]))
    inner = np.array([i == j for (_, i, j), _ in cells])
    before = {r: set(m.before) for r, (_, m) in enumerate(rows) if m.before}
    shared = np.isin(np.arange(len(rows)), list(before))
    found, image = sheet([m.corners for _, m in rows])
    near, key = constellations(found, image, tables)
    key, image, corner = key.ravel(), np.tile(image, tables), np.tile(np.arange(len(image)), tables)
    order = np.lexsort((image, key, cell[image]))
    key, image, corner = key[order], image[order], corner[order]
    group = np.r_[np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (cell[image[1:]] != cell[image[:-1]])]
    new = group | np.r_[np.ones(min(1, len(key)), bool), image[1:] != image[:-1]]  # a key once in an image, at its first place
    group = np.cumsum(group)[new]
    image, corner = image[new], corner[new]
    ends = np.searchsorted(group, group, side="right")
    order = np.argsort(image, kind="stable")  # image by image, each with those behind it in its keys
    partners = (ends - np.arange(len(ends)) - 1)[order]
    begin = np.searchsorted(image[order], np.arange(len(rows) + 1))
    total = np.cumsum(np.bincount(image[order], weights=partners, minlength=len(rows)).astype(np.int64))
    n_links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for s, e in _slices(total, MATCHES):
        left, count = order[begin[s] : begin[e]], partners[begin[s] : begin[e]]
        right = np.repeat(left + 1 - np.cumsum(count) + count, count) + np.arange(count.sum())
        left = np.repeat(left, count)
        a, b = image[left], image[right]
        meant = inner[cell[a]] | (block[a] != block[b])
        left, right, code = left[meant], right[meant], (a * len(rows) + b)[meant]
        pairs, pair, n = np.unique(code, return_inverse=True, return_counts=True)
        a, b = pairs // len(rows), pairs % len(rows)
        own = n > 1 if least > MEMBERS else n > 0  # one constellation has too few corners
        for i in np.flatnonzero(own & shared[a] & shared[b]):
            own[i] = before[int(a[i])].isdisjoint(before[int(b[i])])
        some = own[pair]
        good = agreements(found, pair[some], near[corner[left[some]]], near[corner[right[some]]], len(pairs), least) >= least
        a, b = a[good], b[good]
        n_links += np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        label = least_rows(len(rows), a, b, label)
    linked = n_links > 0
    return pa.RecordBatch.from_arrays([pa.array(x[linked], pa.int64()) for x in (digest[label], digest, n_links)], names=["a", "b", "n"])


def _verified(batches: Iterator[pa.RecordBatch], least: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(hub, i, j, block, before, digest, corners), sorted by cell (hub, i, j), to (a, b, n) of _matches, some whole cells at a time."""
    cells: list[tuple[tuple[int, int, int], list[Member]]] = []
    total = 0
    for batch in batches:
        for hub, i, j, block, before, digest, data in zip(*(c.to_pylist() for c in batch.columns)):
            if not cells or cells[-1][0] != (hub, i, j):
                if total >= SHEET:
                    yield _matches(cells, least, tables)
                    cells, total = [], 0
                cells.append(((hub, i, j), []))
            own = Corners.unpacked(data)
            cells[-1][1].append(Member(digest, block, before, own))
            total += len(own.bits)
    if cells:
        yield _matches(cells, least, tables)


def links(pictures: DataFrame, least: int = LEAST, tables: int = TABLES) -> DataFrame:
    """pictures (digest, n_corners, corners), each digest once, to rows (a, b, n): n links of b, with `least` votes, and a smallest image that they lead to in one task.

    All pairs that share keys are looked at, each in one cell: its images' smallest common hub, and their blocks there. Summed
    over the rows of b, n counts all its links; a and b are in one component, and rows join all images of a component.
    """
    n_keys = pictures.agg(F.coalesce(F.sum("n_corners"), F.lit(0))).first()[0] * tables
    stars = settled(candidates(pictures, n_keys, tables))
    stars = stars.unionAll(stars.select("a", F.col("a").alias("b")).distinct()).select(F.col("a").alias("hub"), F.col("b").alias("digest"))
    sized = stars.join(pictures.select("digest", "n_corners"), "digest").groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("n_corners").alias("m"))
    size = F.least(F.lit(MANY_PICTURES), F.greatest(F.lit(max(1, FEW_PICTURES)), F.ceil(F.col("n") / BLOCKS)))
    sized = sized.select(F.col("hub").alias("_g"), F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("m") / BLOCK_CORNERS)).cast("bigint").alias("blocks"))
    hubs = stars.groupBy(F.col("digest").alias("_d")).agg(F.collect_set("hub").alias("hubs"))
    cells = stars.join(sized, F.col("hub") == F.col("_g")).join(hubs, F.col("digest") == F.col("_d"))
    cells = cells.select("hub", "digest", F.pmod(F.xxhash64("digest"), F.col("blocks")).alias("block"), F.filter("hubs", lambda h: h < F.col("hub")).alias("before"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("x"))
    cells = settled(cells.select("hub", F.least("x", "block").alias("i"), F.greatest("x", "block").alias("j"), "block", "before", "digest"))
    sent = F.broadcast(cells) if cells.count() <= BROADCAST_ENDS else cells
    sent = pictures.select("digest", "corners").join(sent, "digest").select("hub", "i", "j", "block", "before", "digest", "corners")
    sent = sent.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return sent.mapInArrow(lambda b: _verified(b, least, tables), "a long, b long, n long")


def _first_of_each(real: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each digest. Few repeated digests are broadcast: then no picture's corners are shuffled for this."""
    repeated = classes.where("rows > 1")
    if repeated.count() <= BROADCAST_ENDS:
        repeated = F.broadcast(repeated)
    firsts = repeated.select(F.col("digest").alias("_d"), "first")
    return real.join(firsts, F.col("digest") == F.col("_d"), "left").where("first is null or first = row")


def copies(features: DataFrame, least: int = LEAST, tables: int = TABLES) -> DataFrame:
    """FEATURES to (image_id, digest, n_corners, component_id, n_links).

    component_id is the smallest image_id that links reach, the image itself included; n_links counts the
    links of its picture, all of them (see links). Rows of one digest (64 bits of size and pixels) are one picture. Unreadable images (null digest) stay
    by themselves: their component_id is their own id. A null id is linked like any other
    but never the smallest, unless all ids of a component are null. Repeated rows stay rows. An
    empty table gives no row; other columns take no part.
    """
    features = settled(features.select("image_id", "digest", "n_corners", "corners").withColumn("row", F.monotonically_increasing_id()))
    real = features.where("digest is not null")
    classes = settled(real.groupBy("digest").agg(F.min("image_id").alias("low"), F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")))
    found = settled(links(_first_of_each(real, classes).select("digest", "n_corners", "corners"), least, tables))
    labels = components(found.select("a", "b")).select(F.col("node").alias("_n"), "label")
    counts = found.groupBy(F.col("b").alias("_d")).agg(F.sum("n").alias("n_links"))
    known = classes.join(labels, F.col("digest") == F.col("_n"), "left").join(counts, F.col("digest") == F.col("_d"), "left").select("digest", "low", F.coalesce("label", "digest").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = settled(with_group_min(known, "label", "low", "component_id").select(F.col("digest").alias("_g"), "component_id", "n_links"))
    out = real.select("image_id", "digest", "n_corners").join(known, F.col("digest") == F.col("_g")).drop("_g")
    lone = features.where("digest is null").select("image_id", "digest", F.lit(0).cast("bigint").alias("n_corners"), F.col("image_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(lone)
