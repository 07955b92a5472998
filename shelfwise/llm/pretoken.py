"""Splitting whole batches of texts into the pieces that byte-level BPE merges within.

The pieces are those of the public pattern: contractions, runs of letters, numbers or other
signs with one blank before them, and white space. They follow from the classes of neighbouring
characters, so a batch is cut with array operations instead of a match per piece.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from shelfwise.llm.common import string_bytes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
BLANK, APOSTROPHE = 0x20, 0x27


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    alphabet = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, alphabet):
            out[m.start() : m.end()] = kind
    return out


MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd multiplier and of its inverse modulo 2 to the 64, for
    short windows over words that are hashed already."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many spans of bytes, equal for equal spans wherever they lie.

    Spans are taken in eight bytes at a time, through two states that are mixed differently, so
    that no pattern of bytes cancels out as it does in a polynomial; long ones through BLAKE2.
    """
    sizes = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded.data, 0, (1,))
    one = mix(sizes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    two = ~one
    at, left, rows = starts, sizes, None
    for _ in range(LONG_SPAN // 8):
        if not len(at):
            break
        value = eights[at] & LOW_BYTES[np.minimum(left, 8)]
        x, y = (one, two) if rows is None else (one[rows], two[rows])
        x = mix((x ^ value) * np.uint64(0x9E3779B97F4A7C15))
        y = (y + value) * np.uint64(0xC2B2AE3D27D4EB4F)
        y ^= (y >> np.uint64(29)) + x
        if rows is None:
            one, two = x, y
        else:
            one[rows], two[rows] = x, y
        more = left > 8
        rows = np.flatnonzero(more) if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    out = mix(one + two * np.uint64(0x165667B19E3779F9))
    for i in np.flatnonzero(sizes > LONG_SPAN):
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start; ``first`` are the starts of the texts that have characters."""
    n = len(points)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    space = kind == SPACE
    start = begins[:n].copy()
    # a run of white space, and its last character when a text goes on after it
    start[1:] |= space[1:] & ~space[:-1]
    start[:-1] |= space[:-1] & ~space[1:] & ~begins[1:n]
    # another class, unless a blank has been taken into the piece already
    start[1:] |= ~space[1:] & (kind[1:] != kind[:-1]) & (points[:-1] != BLANK)
    marks = np.flatnonzero((points == APOSTROPHE) & start)
    if len(marks):
        near = np.concatenate([points, np.zeros(3, points.dtype)])
        closed = np.concatenate([begins, np.ones(3, bool)])
        a, b = near[marks + 1], near[marks + 2]
        inside = ~closed[marks + 1]
        short = inside & np.isin(a, [ord(c) for c in "stmd"])
        pair = np.zeros(len(marks), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (a == ord(x)) & (b == ord(y))
        pair &= inside & ~closed[marks + 2]
        for chosen, length in ((marks[short], 2), (marks[pair], 3)):
            start[chosen + 1] = False
            after = chosen + length
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Pieces:
    """The pieces of a slice of texts: ``codes`` number the different ones."""

    def __init__(self, texts: pa.Array):
        raw, offsets = string_bytes(texts)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        at = np.searchsorted(begins, offsets)
        starts = piece_starts(points, at[:-1][np.diff(at) > 0])
        self.raw = raw
        self.starts = begins[starts]
        self.ends = np.append(self.starts[1:], len(raw))[: len(starts)]
        self.doc_ends = np.searchsorted(starts, at)  # pieces before each text and in all
        self.codes, _ = pd.factorize(span_hashes(raw, self.starts, self.ends))
        self.first = self._first()
        self._part_unequal()

    def _first(self) -> np.ndarray:
        count = int(self.codes.max(initial=-1)) + 1
        out = np.empty(count, np.int64)
        out[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        return out

    def _part_unequal(self) -> None:
        """Give pieces that share a hash but not their bytes codes of their own."""
        if not len(self.codes):
            return
        sizes = self.ends - self.starts
        like = self.first[self.codes]
        other = sizes != sizes[like]
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.raw) + 1, "<u8", padded.data, 0, (1,))
        rows, done = np.arange(len(like)), 0
        while len(rows) and done < LONG_SPAN:
            mask = LOW_BYTES[np.minimum(sizes[rows] - done, 8)]
            here, there = eights[self.starts[rows] + done], eights[self.starts[like[rows]] + done]
            other[rows] |= ((here ^ there) & mask) != 0
            done += 8
            rows = rows[(sizes[rows] > done) & ~other[rows]]
        for i in rows:  # long ones
            other[i] |= self.bytes_of(i) != self.bytes_of(like[i])
        if other.any():
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(other):
                self.codes[i] = seen.setdefault(self.bytes_of(i), len(self.first) + len(seen))
            self.first = self._first()

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()

    def words(self) -> list[bytes]:
        """The bytes of the different pieces, in the order of their codes."""
        raw = self.raw.tobytes()
        first = self.first
        return [raw[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)]
