"""Near duplicates, repeated passages and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from llm_fixtures import corpus, documents, empty, messy, messy_rows

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from shelfwise.llm import linking, neardup, spotsigs, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def linked(sets, percent=80):
    """The smallest id that links reach, for each id; sets without members are alone."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_components_match_brute_force(spark, size):
    rows = corpus(220, seed=size)
    sets = {i: shingle_set(t, size) for i, t in rows}
    want = linked(sets)
    got = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, rows), size).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert len(set(want.values())) < len(rows) - 20


def test_near_duplicates_of_awkward_rows(spark):
    got = Counter(tuple(r) for r in neardup.near_duplicates(messy(spark), 4).collect())
    sets = Counter()
    component = {1: 1, 5: 1, 6: 6, 7: 6, 8: 8, 9: 8}
    for i, t, *_ in messy_rows():
        own = component.get(i, i)
        sets[(i, len(shingle_set(t, 4)), own, i is None or own == i)] += 1
    assert got == sets
    assert neardup.near_duplicates(empty(spark), 4).count() == 0


def test_one_row_of_each_component_stays(spark):
    left = neardup.keep_one(messy(spark), 4)
    assert left.columns == messy(spark).columns
    kept = Counter(r.doc_id for r in left.collect())
    assert kept == Counter([1, 2, 3, 4, None, None, 6, 8, 10, 11, -3, 12])
    twice = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "z")])
    assert Counter(r.doc_id for r in neardup.keep_one(twice).collect()) == Counter([1, 2])


def test_texts_of_one_id_join_their_components(spark):
    rows = [(1, "a b c d e"), (2, "k l m n o"), (3, "a b c d e"), (3, "k l m n o"), (4, "x y z u v")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows), 4).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_sketch_estimates_follow_the_similarity():
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    for edits, low, high in ((0, 0, 0), (5, 0, 30), (22, 12, 67), (800, 72, 128)):
        for _ in range(10):
            other = list(base)
            for i in rng.sample(range(800), edits):
                other[i] = f"x{rng.randrange(10**6)}"
            values, ends = neardup.shingles(pa.array([" ".join(base), " ".join(other)]), 4)
            a, b = neardup.odd_sketches(neardup.minima(values, ends))
            assert low <= int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= high
    assert neardup.most_different_bits(0.5) == 67


@pytest.mark.parametrize("rounds", [0, 4])
def test_links_of_a_chain_and_a_hot_group(spark, monkeypatch, rounds):
    """One group holds every set; neighbours in a chain are similar, its ends are not."""
    monkeypatch.setattr(linking, "ROUNDS", rounds)
    sets = {i: set(range(10 * i, 10 * i + 200)) for i in range(40)}
    sets |= {100 + i: {5000 + i} | set(range(9000, 9050)) for i in range(60)}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")
    members = spark.createDataFrame([(k, i) for i in sets for k in (1, 2)], "key long, id long")
    same = lambda a, b: F.lit(True)
    got = {r.id: r.root for r in linking.link(members, frame, 80, same).collect()}
    assert got == linked(sets)


def test_sketches_of_a_hot_group_meet_once(spark, monkeypatch):
    """Pairs of different labels come from one of their groups, those of one label from none."""
    monkeypatch.setattr(linking, "BLOCK_ROWS", 7)
    sets = {i: {5000 + i} | set(range(2000)) for i in range(40)}
    sets |= {100 + i: {9000 + i} | set(range(3000, 3050)) for i in range(30)}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")
    label = lambda i: 0 if i < 40 else i
    rows = [(k, i, label(i), 0 if i < 100 else 255) for i in sets for k in (1, 2, 3)]
    known = spark.createDataFrame(rows, "key long, id long, label long, s0 long")
    units = linking._units(known, frame, ["s0"]).toArrow().to_pylist()
    pairs = Counter()
    for unit in {(r["key"], r["x"], r["y"]) for r in units}:
        own = pa.Table.from_pylist([r for r in units if (r["key"], r["x"], r["y"]) == unit])
        for i, j in linking.near_pairs(own, ["s0"], 80, 4):
            names = own["id"].to_numpy()
            pairs.update((min(a, b), max(a, b)) for a, b in zip(names[i].tolist(), names[j].tolist()))
    assert pairs == Counter((100 + i, 100 + j) for j in range(30) for i in range(j))


def test_rows_of_a_hot_group_follow_its_members(spark, monkeypatch):
    """No centre reaches these near copies and all sketches are near: pairs are not written."""
    monkeypatch.setattr(linking, "ROUNDS", 0)
    monkeypatch.setattr(linking, "BLOCK_ROWS", 512)
    n = 2000
    kinds = {i: i % 40 for i in range(n)}  # sets of one kind are similar, of two kinds are not
    sets = [(i, sorted({10_000 + i} | set(range(100 * k, 100 * k + 50)))) for i, k in kinds.items()]
    frame = spark.createDataFrame(sets, "id long, items array<long>")
    members = spark.createDataFrame([(k, i, 0) for i in kinds for k in (1, 2)], "key long, id long, s0 long")
    known = members.withColumn("label", F.col("id"))
    near = linking._promising(linking._units(known, frame, ["s0"]), 80, ["s0"], 4)
    found = linking._connecting(near, frame, 80, ["s0"], 4)
    assert near.count() <= 10 * n and found.count() <= 10 * n
    same = lambda a, b: F.lit(True)
    got = {r.id: r.root for r in linking.link(members, frame, 80, same, (["s0"], 4)).collect()}
    assert got == kinds


def test_words_of_equal_polynomial_hash_are_different(spark):
    text = "a"
    while len(text) < 2048:
        text = "".join({"a": "ab", "b": "ba"}[c] for c in text)
    other = text.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"c{i}" for i in range(19))
    rows = documents(spark, [(1, text), (2, other), (3, f"{common} {text}"), (4, f"{common} {other}")])
    assert all(r.kept for r in neardup.near_duplicates(rows, 4).where("doc_id < 3").collect())
    assert {r.n_removed for r in substrings.dedup_digest(rows).collect()} == {0}
    prints = {r.doc_id: r.fingerprint for r in spotsigs.compare_neighbours(rows).collect()}
    assert prints[1] != prints[2]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7), (300, 301)]
    names = list(range(400))
    rng.shuffle(names)
    pairs = [(names[a], names[b]) for a, b in pairs]
    got = {r.id: r.root for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    sets = {}
    for a, b in pairs:
        if a != b:
            sets.setdefault(a, set()).add(frozenset((a, b)))
            sets.setdefault(b, set()).add(frozenset((a, b)))
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# ---- passages ------------------------------------------------------------------------------
def removal(rows, length=20):
    """(words, removed, kept text) of each row, ordered by id and place; equal ids not covered."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def digests(found):
    return {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in found.items()}


@pytest.mark.parametrize("anchor_rows, shard_rows", [(5000, 20_000), (2, 15)])
def test_passages_match_brute_force(spark, monkeypatch, anchor_rows, shard_rows):
    monkeypatch.setattr(substrings, "ANCHOR_ROWS", anchor_rows)
    monkeypatch.setattr(substrings, "SHARD_ROWS", shard_rows)
    rows = corpus(160, seed=9) + [(500, "la " * 70), (501, "a b " * 40), (502, "la " * 19), (503, "la " * 20)]
    got = {r[0]: tuple(r)[1:] for r in substrings.dedup_digest(documents(spark, rows)).collect()}
    want = digests(removal(rows))
    assert got == want and sum(r[1] for r in want.values()) > 1000


def test_copies_of_a_common_passage_are_one_window(spark, monkeypatch):
    """A line in every document, with other words (and white space) around and in it."""
    monkeypatch.setattr(substrings, "ANCHOR_ROWS", 10)
    signs = " \t\n"
    rows = []
    for i in range(200):
        line = signs[i % 3].join(f"common{k}" for k in range(30))
        own = [" ".join(f"u{i}x{part}x{k}" for k in range(25)) for part in range(2)]
        rows.append((i, f"{own[0]} {line} {own[1]}"))
    docs = substrings.keyed(documents(spark, rows))
    found = substrings.anchors(docs, 20)
    marked = docs.join(found.select("d", "anchors"), "d")
    stretches = substrings.repeated_stretches(marked, 20)
    windows = Counter()
    for r in substrings.pieces(stretches, 20).collect():
        words = WORD.findall(r.words)
        windows.update(tuple(words[k : k + 20]) for k in range(len(words) - 19))
    passage = tuple(f"common{k}" for k in range(30))
    # a stretch that lies in the passage as a whole comes once from each of the 4 partitions
    assert all(1 <= windows[passage[k : k + 20]] <= 4 for k in range(11))
    got = {r[0]: tuple(r)[1:] for r in substrings.dedup_digest(documents(spark, rows)).collect()}
    assert got == digests(removal(rows))


def test_passages_of_awkward_rows(spark):
    got = substrings.dedup_digest(messy(spark)).collect()
    alone = {i: (t or "") for i, t, *_ in messy_rows() if i is not None}
    want = digests(removal([(i, t) for i, t in alone.items()]))
    assert len(got) == len(messy_rows())
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    assert substrings.dedup_digest(empty(spark)).count() == 0


def test_repeated_ids_and_nulls_have_an_order(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = [(None, text), (1, text), (1, text), (2, "x " + text), (3, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_digest(documents(spark, rows)).collect())
    assert got == [(0, 0), (1, 30), (1, 30), (2, 30), (3, 0)]


def test_removal_keeps_columns_and_untouched_texts(spark):
    rows = messy(spark)
    out = substrings.remove_repeats(rows)
    assert out.schema.simpleString() == rows.schema.simpleString()
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    for i, t, *_ in messy_rows():
        if i in (2, 3, 4, 6, 7, 8, 12):
            assert got[i].text == t
    assert got[9].text == "+1 (555) 555-0199 and one more".split(" ", 3)[3] or got[9].n_chars < 100


def test_wavelet_ranks_match_counting():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 37, 500)
    tree = substrings.Wavelet(symbols, 6)
    zero = np.zeros(37, np.int64)
    base, _ = tree.range(np.arange(37), zero, zero)
    for at in (0, 1, 63, 64, 65, 250, 500):
        a, b = tree.range(np.arange(37), zero, np.full(37, at))
        assert (b - a == np.bincount(symbols[:at], minlength=37)).all() and (a == base).all()


@pytest.mark.parametrize("length", [2, 3, 7, 20])
def test_first_places_match_a_dictionary(length):
    rng = random.Random(length)
    parts = [[rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 60]))] for _ in range(30)]
    symbols, ends = [], []
    for p in parts:
        symbols += [*p, 0]
        ends.append(len(symbols) - 1)
    got = substrings.first_places(np.array(symbols), np.array(ends), length)
    seen = {}
    begin = 0
    for end in ends:
        for k in range(begin, end + 1):
            window = tuple(symbols[k : k + length])
            if k + length <= end:
                assert got[k] == seen.setdefault(window, k)
            else:
                assert got[k] == -1
        begin = end + 1


# ---- fingerprints --------------------------------------------------------------------------
def test_fingerprints_of_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "UNIT_ROWS", 7)
    rows = corpus(90, seed=2) + [(1000 + 7 * i, "dès le 🙂 " * i) for i in range(9)]
    got = {r.doc_id: r for r in spotsigs.compare_neighbours(documents(spark, rows)).collect()}
    order = sorted(rows)
    prints = {}
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        r, half = got[i], len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        a, b = (set(spotsigs.read_form(f).tolist()) for f in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b))
        c = set(spotsigs.read_form(got[order[(k + 1) % len(order)][0]].fingerprint).tolist())
        assert r.near_next == pytest.approx(len(a & c) / len(a | c))
    assert len(got) == len(rows) and len(set(prints.values())) > 60


def test_fingerprints_of_awkward_rows(spark):
    got = spotsigs.compare_neighbours(messy(spark)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t, *_ in messy_rows())
    empties = {r.fingerprint for r in got if r.n_chars == 0}
    assert len(empties) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert spotsigs.compare_neighbours(empty(spark)).count() == 0
    one = spotsigs.compare_neighbours(documents(spark, [(4, "the only one")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(4, 1.0)]


def test_signatures_are_chains_after_anchors():
    same = spotsigs.signatures(pa.array(["Buy The red, fox now", "the red fox", "x the red fox is here", "zz yy"]))
    assert set(same[1].tolist()) < set(same[2].tolist()) or len(set(same[1]) & set(same[2])) == 1
    assert len(same[0]) == 1 and set(same[0]) == set(same[1])
    assert len(same[3]) == 2


def test_similar_documents_match_brute_force(spark):
    rows = corpus(140, seed=12)
    got = {r.doc_id: r.component_id for r in spotsigs.similar_documents(documents(spark, rows)).collect()}
    column = pa.array([t for _, t in rows])
    sets = {i: set(s.tolist()) for (i, _), s in zip(rows, spotsigs.signatures(column), strict=True)}
    assert got == linked(sets)


# ---- the pipeline --------------------------------------------------------------------------
def test_stages_have_their_order_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near-duplicate removal", "substring dedup", "personal data", "best-fit packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf))
        assert out.columns == docs.columns and 0 < out.count() <= before
        docs, before = out, out.count()


def test_pipeline_matches_its_stages_one_by_one(spark, sf):
    """Each stage against its rule in plain Python, on the rows that the one before kept."""
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = corpus_pipeline.written(corpus_pipeline.keep_quality(spark, rows, sf))
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    texts = {r.doc_id: r.text for r in good.collect()}
    roots = linked({i: shingle_set(t, 5) for i, t in texts.items()})
    single = corpus_pipeline.written(corpus_pipeline.drop_near_duplicates(spark, good, sf))
    assert {r.doc_id for r in single.collect()} == set(roots.values())
    left = {i: texts[i] for i in set(roots.values())}
    want = removal(left.items())
    cut = corpus_pipeline.written(corpus_pipeline.drop_repeated_passages(spark, single, sf))
    assert {r.doc_id: r.text for r in cut.collect()} == {
        i: left[i] if not gone else text for i, (_, gone, text) in want.items()
    }
    clean = corpus_pipeline.written(corpus_pipeline.redact_personal_data(spark, cut, sf))
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(mail.search(r.text or "") for r in cut.collect())
    assert not any(mail.search(r.text or "") for r in clean.collect())
    packed = corpus_pipeline.pack_sequences(spark, clean, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
