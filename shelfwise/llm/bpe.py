"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct pieces of a slice of texts are encoded together: an inverted index leads from each
token pair, named by the token that it merges into, to the places where it occurs in any piece;
the merges are replayed in rank order, each at all of its places, and only the neighbours of a
merged place are looked up again. Pieces met lately are kept, up to a fixed number.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shelfwise.llm.common import gathered, text_slices, texts_of
from shelfwise.llm.pretoken import Pieces

#: Encoded pieces in each of the two generations that a Python worker keeps between slices. When
#: the young one is full the old one goes, so that pieces which come again are not replayed again.
MOST_KEPT = 150_000
#: Bytes of text whose new pieces are encoded together; a longer text stands alone.
TOGETHER = 16 << 20
#: Bytes of text that are cut into pieces together.
CUT_TOGETHER = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in vocabulary files written as JSON."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a ``.tiktoken`` file or a tokenizer's JSON file."""
    with open(path, "rb") as f:
        if not path.endswith(".json"):
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    to_byte = byte_alphabet()
    return {
        bytes(to_byte[c] for c in token): i
        for token, i in model["model"]["vocab"].items()
        if token not in special
    }


def read_added(path: str) -> dict[bytes, int]:
    """The added tokens of a tokenizer's JSON file and their ids; they are found in texts before
    pieces are cut. A ``.tiktoken`` file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, "rb") as f:
        return {t["content"].encode(): t["id"] for t in json.load(f).get("added_tokens", ())}


class Replay:
    """Merge replay over many distinct pieces.

    Symbols are places of one long array; ``after`` and ``before`` link those that are left of
    a piece, with place n as the end. Rank and id of a token are the same number.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        table = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    table[left << 32 | right] = rank
        self.keys = np.array(sorted(table), np.int64)
        self.into = np.array([table[k] for k in self.keys.tolist()], np.int64)
        self.nothing = np.int64(max(ranks.values()) + 1)
        # Merges after which an earlier one may come up: those go through a piece one by one.
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.single_file = set(left[self.into < left].tolist())
        self.single_file |= set(right[self.into < right].tolist())

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that pairs merge into, -1 for none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.into[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit numbers."""
        whole = [self.ranks.get(w, -1) for w in words]
        rest = [w for w, rank in zip(words, whole, strict=True) if rank < 0]
        parts = iter(self.replay(rest) if rest else ())
        return [next(parts) if r < 0 else r.to_bytes(4, "little") for r in whole]

    def replay(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        piece = np.repeat(np.arange(len(words)), sizes)
        token = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], self.nothing)
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n)
        after[ends - 1] = n
        before[ends - sizes] = n
        alive = np.ones(n, bool)
        rank_at = self.merged(token, token[after])
        order = np.argsort(rank_at[:n], kind="stable")
        ranks, lows = np.unique(rank_at[order], return_index=True)
        highs = np.append(lows[1:], n)
        first = {r: (a, b) for r, a, b in zip(ranks.tolist(), lows.tolist(), highs.tolist(), strict=True) if r >= 0}
        index: dict[int, list[int]] = {r: [] for r in first}
        due = list(index)
        heapq.heapify(due)
        while due:
            rank = heapq.heappop(due)
            more = index.pop(rank)
            low, high = first.pop(rank, (0, 0))
            places = order[low:high]
            if more:
                places = np.unique(np.concatenate([places, np.array(more, np.int64)]))
            places = places[rank_at[places] == rank]
            if not len(places):
                continue
            if len(places) > 1:
                if rank in self.single_file:
                    _, one = np.unique(piece[places], return_index=True)
                    if len(one) < len(places):
                        index[rank] = np.delete(places, one).tolist()
                        heapq.heappush(due, rank)
                        places = places[one]
                shared = after[places[:-1]] == places[1:]
                if shared.any():  # of overlapping places every second one, from the left
                    k = np.arange(len(places))
                    opens = np.append(True, ~shared)
                    places = places[(k - np.maximum.accumulate(np.where(opens, k, 0))) % 2 == 0]
            right = after[places]
            beyond = after[right]
            token[places] = rank
            after[places] = beyond
            before[beyond] = places
            rank_at[right] = -1
            alive[right] = False
            ahead = before[places]
            for at, pair in (
                (places, self.merged(token[places], token[beyond])),
                (ahead, self.merged(token[ahead], token[places])),
            ):
                rank_at[at] = pair
                hit = pair >= 0
                for p, r in zip(at[hit].tolist(), pair[hit].tolist(), strict=True):
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(due, r)
            rank_at[n] = -1
        left = np.add.reduceat(alive, ends - sizes, dtype=np.int64)
        stops = np.cumsum(left) * 4
        ids = token[:n][alive].astype("<i4").tobytes()
        return [ids[b - 4 * k : b] for b, k in zip(stops.tolist(), left.tolist(), strict=True)]


class Encoder:
    """Texts to ids and back, with the ids of pieces met before."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.words = Replay(self.ranks)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.added = read_added(path)
        longest = sorted((t.decode() for t in self.added), key=len, reverse=True)
        self.mark = "|".join(map(re.escape, longest))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices (first row, end) of the texts: all ids, and the offsets of each row's."""
        for low, high in text_slices(texts, TOGETHER):
            own = texts.slice(low, high - low)
            if any(pc.any(pc.match_substring(own, t.decode())).as_py() for t in self.added):
                yield low, high, *self.around_added(own)
            else:
                for a, b, ids, ends in self.ordinary(own):
                    yield low + a, low + b, ids, ends

    def around_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the offsets of each row's, of texts cut at the added tokens in them."""
        cut = re.compile(f"({self.mark})")
        parts = [cut.split(t) for t in texts.to_pylist()]  # every second one is an added token
        between = pa.array([x for own in parts for x in own[::2]], pa.string())
        found = []
        for a, b, ids, ends in self.ordinary(between):
            found += [ids[ends[i] : ends[i + 1]] for i in range(b - a)]
        found = iter(found)
        out, sizes = [], [0]
        for own in parts:
            ids = [
                np.array([self.added[x.encode()]], "<i4") if k % 2 else next(found) for k, x in enumerate(own)
            ]
            out += ids
            sizes.append(sum(map(len, ids)))
        return np.concatenate(out), np.cumsum(sizes)

    def ordinary(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``encode`` for texts whose added tokens, if they hold any, are ordinary characters."""
        for low, high in text_slices(texts, TOGETHER, trim=False):
            slices, own = [], {}
            for a, b in text_slices(texts.slice(low, high - low), CUT_TOGETHER, trim=False):
                pieces = Pieces(texts.slice(low + a, b - a))
                words = pieces.words()
                own.update(dict.fromkeys(words))
                slices.append((low + a, low + b, pieces.codes, pieces.doc_ends, words))
            self.fill(own)
            for a, b, codes, doc_ends, words in slices:
                yield a, b, *self.spread(codes, doc_ends, [own[w] for w in words])

    def fill(self, own: dict[bytes, bytes]) -> None:
        """Put the ids of each piece; those not met lately are replayed together."""
        new = []
        for word in own:
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    new.append(word)
                    continue
                self.young[word] = ids
            own[word] = ids
        for word, ids in zip(new, self.words.encode(new), strict=True):
            own[word] = self.young[word] = ids
        if len(self.young) > MOST_KEPT:
            self.old, self.young = self.young, {}

    @staticmethod
    def spread(codes: np.ndarray, doc_ends: np.ndarray, found: list[bytes]):
        """The ids of a row of pieces from the ids of the distinct ones."""
        sizes = np.fromiter((len(x) >> 2 for x in found), np.int64, len(found))
        flat = np.frombuffer(b"".join(found), "<i4")
        begins = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        shift = np.repeat(begins[codes] - ends[:-1], counts)
        return flat[shift + np.arange(ends[-1])], ends[doc_ends]

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        known = self.ranks | self.added
        out = [b""] * (max(known.values()) + 1)
        for t, i in known.items():
            out[i] = t
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every whole text; a null or empty text has no ids.

    ``path`` names the ranks, a file that every executor has. Repeated rows are encoded each;
    null ids stay null; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in gathered(batches, TOGETHER):
            texts = texts_of(batch)
            for a, b, ids, ends in coder.encode(texts):
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` (bytes) from ``doc_id, ids``; null or empty ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Token count, hash of the ids and hash of the bytes decoded from them, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        digits = [str(i) for i in range(len(coder.token_bytes))]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in gathered(batches, TOGETHER):
            texts = texts_of(batch)
            for a, b, ids, ends in coder.encode(texts):
                written, decoded = [], []
                for i in range(b - a):
                    own = ids[ends[i] : ends[i + 1]]
                    line = " ".join(map(digits.__getitem__, own.tolist()))
                    written.append(hashlib.sha256(line.encode()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(written, pa.string()),
                        pa.array(decoded, pa.string()),
                    ],
                    names,
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
