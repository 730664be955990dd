"""Character n-grams of many texts at a time, numbered inside a task.

The n-grams of a batch get numbers from tables of codes, so an occurrence costs a few array
accesses, and only distinct n-grams become texts. Which n-grams there are, :mod:`tarnish.functions.text` says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

# Characters laid out at a time; a longer text is a portion by itself.
CHARACTERS = 1 << 20

# Codes up to this number are looked up in a table, larger ones sorted.
TABLE = 1 << 22


def portions(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of neighbouring rows whose lengths add up to at most ``most``, one row at least."""
    ends = np.cumsum(lengths)
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(a, b)
        a = b


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gapless number of each code, and a place of every number."""
    if size > TABLE:
        _, places, ranks = np.unique(codes, return_index=True, return_inverse=True)
        return ranks.astype("int64"), places
    at = np.full(size, -1)
    at[codes] = np.arange(len(codes))
    held = np.flatnonzero(at >= 0)
    places = at[held]
    at[held] = np.arange(len(held))
    return at[codes], places


def char_ngrams(texts: list[str], lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Per size: row of each occurrence, ascending, number of its n-gram, and the n-grams by number."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("int64")
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if not len(points):
        return
    symbols, places = _numbered(points, int(points.max()) + 1)
    n_symbols, starts, ranks = len(places), np.arange(len(points)), symbols
    for n in range(1, hi + 1):
        if n > 1:
            # only where the text goes on
            more = starts + n - 1 < len(points)
            more[more] = rows[starts[more]] == rows[starts[more] + n - 1]
            starts = starts[more]
            if not len(starts):
                return
            ranks, found = _numbered(ranks[more] * n_symbols + symbols[starts + n - 1], len(places) * n_symbols)
            places = starts[found]
        if n >= lo:
            spelt = np.stack([points[places + j] for j in range(n)], 1).astype("<u4").tobytes().decode("utf-32-le")
            yield rows[starts], ranks, [spelt[i:i + n] for i in range(0, len(spelt), n)]


# --------------------------------------------------------------------------- hashes

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def seeded_hashes(grams: list[str], n: int) -> np.ndarray:
    """``xxhash64(c, gram)`` as Spark has it, for the integers ``c < n``: a row per ``c``. N-grams of
    up to seven characters."""
    seeds = np.full(n, 42, "uint64") + _P5 + np.uint64(4)
    seeds = _mixed(_rotated(seeds ^ (np.arange(n, dtype="uint64") * _P1), 23) * _P2 + _P3)
    coded = [g.encode() for g in grams]
    lengths = np.array([len(c) for c in coded])
    out = np.empty((n, len(grams)), "uint64")
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        raw = np.frombuffer(b"".join(coded[i] for i in rows), "uint8").reshape(len(rows), length)
        h = np.repeat((seeds + _P5 + np.uint64(length))[:, None], len(rows), 1)
        at = 0
        while length - at >= 8:
            word = np.ascontiguousarray(raw[:, at:at + 8]).view("<u8").ravel()
            h = _rotated(h ^ (_rotated(word * _P2, 31) * _P1), 27) * _P1 + _P4
            at += 8
        if length - at >= 4:
            word = np.ascontiguousarray(raw[:, at:at + 4]).view("<u4").ravel().astype("uint64")
            h = _rotated(h ^ (word * _P1), 23) * _P2 + _P3
            at += 4
        for i in range(at, length):
            h = _rotated(h ^ (raw[:, i].astype("uint64") * _P5), 11) * _P1
        out[:, rows] = _mixed(h)
    return out


def md5_dimensions(grams: list[str], dimensions: int) -> np.ndarray:
    """The first eight hex digits of each n-gram's md5 as a number, modulo ``dimensions``."""
    heads = [int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "big") for g in grams]
    return np.array(heads, "int64") % dimensions
