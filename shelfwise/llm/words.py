"""Words of many texts as spans and 64-bit hashes, found with array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shelfwise.llm.common import string_bytes
from shelfwise.llm.pretoken import span_hashes

WHITE = [0x20, *range(0x09, 0x0E)]


def byte_set(excluded: list[int]) -> np.ndarray:
    out = np.ones(256, bool)
    out[excluded] = False
    return out


#: Bytes of words between ASCII white space.
PLAIN = byte_set(WHITE)
#: Bytes of words of letters and digits; bytes beyond ASCII count as letters.
LETTERS = byte_set([b for b in range(128) if not chr(b).isalnum()])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of a slice of texts: spans of bytes, hashes, and the words before each text."""

    def __init__(self, texts: pa.Array, inside: np.ndarray = PLAIN, lower: bool = False):
        self.raw, self.offsets = string_bytes(texts)
        if lower:
            self.raw = LOWER[self.raw]
        n = len(self.raw)
        within = np.zeros(n + 2, bool)
        within[1:-1] = inside[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        word = within[1:-1]
        self.starts = np.flatnonzero(word & (~within[:-2] | edge[:n]))
        self.ends = np.flatnonzero(word & (~within[2:] | edge[1:])) + 1
        self.hashes = span_hashes(self.raw, self.starts, self.ends)
        self.doc_ends = np.searchsorted(self.starts, self.offsets)

    def of(self, row: int) -> slice:
        return slice(self.doc_ends[row], self.doc_ends[row + 1])
