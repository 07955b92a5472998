"""The prefix trie of conversations next to brute force, and the z-fast trie by itself."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfwise.llm import prefixes as px

SCHEMA = "conv_id long, turn int, role string, text string, depth string, key long, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()[:32]
    own = {c: [r[2:] for r in sorted(v, key=lambda r: (r[0], r[1], digest(r)))] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        words = len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * words
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), children.get(node, 0),
            leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def result(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def table(n=160, seed=2):
    rng = random.Random(seed)
    rows, made = [], []
    for c in range(n):
        kind = rng.random()
        if made and kind < 0.6:
            seq = list(rng.choice(made))[: rng.randrange(1, 9)]
        else:
            seq = [("user", "hello there")] if kind < 0.9 else []
        seq += [(rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d  e\tf"])) for _ in range(rng.randrange(0, 5))]
        made.append(seq)
        rows += [(c * 3 - 30, None if k == 0 else k * 2, *t) for k, t in enumerate(seq)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    rows = table() + [(9000 + i, k, "user", "same turn") for i in range(60) for k in range(3)]
    if small:
        for name, value in (("SEGMENT", 2), ("SLICE", 3), ("UNIT_SEGMENTS", 20), ("BATCH", 4), ("CHUNK", 5), ("HOT_SHARE", 20)):
            monkeypatch.setattr(px, name, value)
    assert result(px.prefix_trie(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "u", "x"), (0, None, None, None), (0, None, "u", "t"), (0, 1, "u", "t"), (0, 1, "u", "t")]
    rows += [(20 + k, i, "r", f"turn {i}") for k in range(3) for i in range(200 + 30 * k)]
    rows += [(-5, 3, "u", "a " * 200_000), (7, 0, "12:u", "x"), (8, 0, "1", "2:ux"), (61, 0, "u", "only")]
    assert result(px.prefix_trie(frame(spark, rows))) == brute(rows)
    assert px.prefix_trie(frame(spark, [])).count() == 0


def test_fat_binary_search_finds_the_deepest_node(spark):
    assert [px.two_fattest(a, b) for a, b in ((0, 1), (0, 7), (4, 7), (6, 7), (3, 8), (8, 13))] == [1, 4, 6, 7, 8, 12]
    rng = random.Random(4)
    strings = {tuple(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(400)}
    name = lambda s, d: repr(s[:d]).encode()
    trie, there = px.ZFastTrie(), set()
    for s in sorted(strings, key=lambda s: rng.random()):
        names = [name(s, d) for d in range(len(s) + 1)]
        stops = [d for d in range(len(s) + 1) if d == 0 or (d, names[d]) in trie.ends]
        assert trie.locate(0, names, 0) == stops[-1]
        trie.insert([(0, names, 1, len(there))])
        there.add(s)
        f = [px.two_fattest(lo, hi) for lo, hi in zip(trie.low, trie.high)]
        assert len(trie.handles) == len(f) == len(trie.begins) == len(trie.ends)
    inner = {s[:d] for s in there for d in range(1, 41) if len({t[d] for t in there if t[:d] == s[:d] and len(t) > d}) > 1}
    assert {n for _, n in trie.ends} == {repr(s).encode() for s in inner | there}
