"""Document fingerprints by spot signatures.

A signature is an anchor, a very common word, with the chain of the next content words after it.
A fingerprint is the set of a text's signatures, so furniture without common words hardly counts.
Fingerprints are compared by Jaccard similarity; sets whose sizes differ too much are never
compared, since the smaller size over the larger bounds the similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import linking
from shelfwise.llm.common import text_slices, texts_of, written
from shelfwise.llm.pretoken import mix, span_hashes
from shelfwise.llm.words import LETTERS, Words

#: Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "the of and to in is that by for with on as at from it be are was or an "
    "le la les un une des du de et en au aux par pour que qui est dans sur avec pas "
    "der die das und zu den von mit ist nicht ein eine auf dem im sich als auch für "
    "el los las del y con para no es su lo al se por"
).split()
#: Content words in a chain.
CHAIN = 2
#: Rows that are ordered together, and the most units they are dealt over.
UNIT_ROWS, MOST_UNITS = 500, 1 << 16
COARSE = 64


def word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def signatures(texts: pa.Array, anchors: tuple[str, ...] = tuple(ANCHORS)) -> list[np.ndarray]:
    """The sorted signature set of each text of a slice, as 32-bit numbers.

    A chain may be shorter at the end of a text. A text without anchors followed by content words
    takes every word as an anchor, one without words has the checksum of its bytes.
    """
    words = Words(texts, LETTERS, lower=True)
    n = len(words.hashes)
    common = np.sort(np.array([word_hash(a) for a in anchors], np.uint64))
    near = np.minimum(np.searchsorted(common, words.hashes), len(common) - 1)
    anchor = common[near] == words.hashes
    text = np.repeat(np.arange(len(texts)), np.diff(words.doc_ends))
    has = np.zeros(len(texts), bool)
    content = np.flatnonzero(~anchor)
    spot = np.flatnonzero(anchor)

    def chains(spots: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and signatures of the spots that have a word after them."""
        at = np.searchsorted(among, spots, side="right")
        out = words.hashes[spots].copy()
        found = np.zeros(len(spots), bool)
        for step in range(CHAIN):
            k = at + step
            inside = k < len(among)
            k = np.where(inside, k, 0)
            nxt = among[k] if len(among) else k
            inside &= text[nxt] == text[spots] if n else inside
            found |= inside
            out = mix(out * np.uint64(31) + np.where(inside, words.hashes[nxt] if n else 0, 0).astype(np.uint64))
        return text[spots[found]], out[found]

    owner, signs = chains(spot, content)
    has[owner] = True
    alone = np.flatnonzero(~has[text]) if n else np.zeros(0, np.int64)
    more, other = chains(alone, np.arange(n))
    last = alone[np.append(text[alone][1:] != text[alone][:-1], True)] if len(alone) else alone
    # the last word of such a text has none after it, but a text of one word needs a signature
    owner = np.concatenate([owner, more, text[last]])
    signs = np.concatenate([signs, other, mix(words.hashes[last])])
    short = (signs >> np.uint64(32)).astype(np.uint64)
    keyed = np.unique((owner.astype(np.uint64) << np.uint64(32)) | short)
    ends = np.searchsorted(keyed, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    small = keyed.astype(np.uint32)
    out = [small[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for i in np.flatnonzero(np.diff(ends) == 0):
        raw = words.raw[words.offsets[i] : words.offsets[i + 1]].tobytes()
        digest = hashlib.sha256(raw).digest()[:4]
        out[i] = np.frombuffer(digest, ">u4").astype(np.uint32)
    return out


def written_form(signs: np.ndarray) -> str:
    return signs.astype(">u4").tobytes().hex()


def read_form(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 if their sizes rule out ``least``."""
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def units_of(ids: Column, bounds: list[int], fine: int) -> Column:
    """A number that grows with the id: the coarse range between bounds, cut into equal parts."""

    def among(low: int, high: int) -> Column:
        if high - low == 1:
            width = max(bounds[high] - bounds[low], 1)
            part = F.floor((ids.cast("decimal(38,0)") - F.lit(bounds[low])) * fine / F.lit(width))
            return F.lit(low * fine) + F.greatest(F.lit(0), F.least(F.lit(fine - 1), part))
        mid = (low + high) // 2
        return F.when(ids < F.lit(bounds[mid]), among(low, mid)).otherwise(among(mid, high))

    return among(0, len(bounds) - 1).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (unit, key, doc_id, text, tail) of which each unit, in order, is followed by the
    first document of the next one (tail), and the last unit by the very first document.

    Units are ranges of ids; they are cut with the quantiles of the ids, and at most
    ``MOST_UNITS`` first ids are sent to all tasks.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    seen = ids.agg(
        F.count("*"), F.percentile_approx("key", [i / COARSE for i in range(COARSE + 1)], 10_000)
    ).first()
    n, cuts = seen[0], sorted(set(seen[1] or [0]))
    bounds = cuts if len(cuts) > 1 else [cuts[0], cuts[0] + 1]
    fine = max(1, min(MOST_UNITS // COARSE, math.ceil(n / UNIT_ROWS / (len(bounds) - 1))))
    unit = units_of(F.col("key"), bounds, fine)
    firsts = ids.groupBy(unit.alias("unit")).agg(F.min("key").alias("key"))
    rows = sorted((r["unit"], r["key"]) for r in firsts.collect())
    tails = [(k, rows[i - 1][0]) for i, (_, k) in enumerate(rows)]
    before = docs.sparkSession.createDataFrame(tails, "key long, tail_of long")
    own = F.struct(unit.alias("unit"), F.lit(False).alias("tail"))
    also = F.when(
        F.col("tail_of").isNotNull(),
        F.struct(F.col("tail_of").alias("unit"), F.lit(True).alias("tail")),
    )
    joined = docs.select(key.alias("key"), "doc_id", "text").join(F.broadcast(before), "key", "left")
    return joined.select(
        F.inline(F.array_compact(F.array(own, also))), "key", "doc_id", "text"
    )


FINGERPRINTS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint next to that of its edited text and of the next document.

    Next is by ascending doc_id, null ids first, equal ids by their texts; after the last comes
    the first, and a single document is its own next one. Null texts are empty; other columns are
    ignored; an empty table gives no rows.
    """
    dealt = with_next(docs).repartition("unit").sortWithinPartitions("unit", "tail", "key", "text")

    def results(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        ids, texts, following = zip(*rows, strict=True)
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        sets = []
        for group in (texts, changed, following):
            column = pa.array(group, pa.string())
            sets.append([s for a, b in text_slices(column) for s in signatures(column.slice(a, b - a))])
        columns = [
            ids,
            [len(t) for t in texts],
            [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            [written_form(s) for s in sets[0]],
            [written_form(s) for s in sets[1]],
            [likeness(a, b) for a, b in zip(sets[0], sets[1], strict=True)],
            [likeness(a, b) for a, b in zip(sets[0], sets[2], strict=True)],
        ]
        kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
        names = [f.split()[0] for f in FINGERPRINTS.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row, rows, size = None, [], 0
        for batch in batches:
            texts = texts_of(batch)
            at = zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            )
            for i, (unit, tail, doc_id) in enumerate(at):
                text = texts[i].as_py()
                if open_row and open_row[0] == unit:
                    rows.append((open_row[1], open_row[2], text))
                    size += len(open_row[2])
                open_row = None if tail else (unit, doc_id, text)
                if size > 1 << 20:
                    yield results(rows)
                    rows, size = [], 0
        if rows:
            yield results(rows)

    return dealt.select("unit", "tail", "doc_id", "text").mapInArrow(run, FINGERPRINTS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, signs`` (sorted array of signature numbers) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in text_slices(texts):
                found = [s.astype(np.int64) for s in signatures(texts.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.int64()))],
                    ["doc_id", "signs"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, signs array<long>")


def size_part(n: Column, least: float) -> Column:
    """The class of a set's length; sets similar enough lie in the same or a neighbouring one."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1 / least))).cast("int")


def similar_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, component_id``: documents whose signature sets have ``percent`` of their union
    in common are linked; component_id is the smallest doc_id that links reach.

    Equal sets are one, that of the smallest doc_id. Sets are partitioned by their length and
    meet in their own and the next partition through one of the signatures that two similar
    sets must share: the first of each set in one common order, rarest first. Lengths prune
    before Jaccard decides. Rows without a doc_id have no component.
    """
    least = percent / 100
    rows = written(fingerprints(docs))
    sets = written(
        rows.where("doc_id is not null").groupBy("signs").agg(F.min("doc_id").alias("id"))
        .select("id", F.col("signs").alias("items"))
    )
    single = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("sign"))
    often = single.groupBy("sign").agg(F.count("*").alias("freq"))
    order = Window.partitionBy("id").orderBy("freq", "sign")
    ranked = single.join(often, "sign").withColumn("rank", F.row_number().over(order))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    part = size_part(F.col("n"), least)
    members = prefix.select(
        "id", "n", "sign", F.explode(F.array(part, part + 1)).alias("part")
    ).select(F.xxhash64("part", "sign").alias("key"), "id", "n").distinct()
    alike = lambda a, b: F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * percent
    roots = linking.link(written(members), sets, percent, alike)
    by_set = sets.join(roots, "id", "left").select(
        F.col("items").alias("signs"), F.coalesce("root", "id").alias("component_id")
    )
    found = rows.where("doc_id is not null").join(by_set, "signs").select("doc_id", "component_id")
    none = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(none)
