"""Hard negatives next to brute force."""

import math
import random

from shelfwise.llm import negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, keys string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "k", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    taking = {}
    for i, v, label in sorted(rows, key=lambda r: repr(r)):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        own = (label, [math.floor(256 * x) for x in v])
        taking[i] = min(taking.get(i, own), own)
    out = []
    for a, (label, v) in taking.items():
        if a % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), i, kind == label) for i, (kind, w) in taking.items() if i != a
        ]
        scored.sort()
        for down, p, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and -80 * down <= -100 * s[0] <= -100 * down][:5]
            out += [(a, p, k + 1, n, -down, -score) for k, (score, n, _) in enumerate(fits)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def table(n, seed=1, width=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.75, 1.0]) for _ in range(width)], rng.randrange(4)) for i in range(-100, n)]
    return [(i, [1.0] * width, k) if i % 3 == 0 else (i, v, k) for i, v, k in rows]


def test_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch):
    rows = table(900)
    want = brute(rows)
    assert len(want) > 100 and len({r[0] for r in want}) == 10
    assert result(hn.hard_negatives(frame(spark, rows))) == want
    for name, value in (("BLOCK_ROWS", 90), ("BLOCK_ANCHORS", 4), ("TILE", 2), ("PARTITION_KEYS", 50)):
        monkeypatch.setattr(hn, name, value)
    assert result(hn.hard_negatives(frame(spark, rows))) == want


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.5], 2), (3, None, 1), (4, [1.0, None], 1),
        (5, [nan, 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0, 2.0], 0), (8, [1.0, 2.0], None),
        (None, [1.0, 2.0], 1), (100, [], 3), (101, [], 3), (102, [1.0], 2), (200, [-1.0, 0.0], 5),
        (201, [1.0, 0.0], 5), (202, [-1.0, 0.0, 9.0], 6), (2, [9.0, 1.5], 3), (1, [1.0, 2.0], 1),
        (300, [1e6, 3e7], 1), (301, [1e6, 3e7], 1), (302, [1e6, 2.9e7], 2),
    ]
    got = result(hn.hard_negatives(frame(spark, rows)))
    assert got == brute(rows) and any(r[0] == 100 for r in got) and any(r[0] == 300 for r in got)
    assert hn.hard_negatives(frame(spark, [])).count() == 0
    assert hn.hard_negatives(frame(spark, rows[1:3])).count() == 0


def test_keys_of_a_block_follow_its_windows_and_not_its_copies():
    import numpy as np

    ids, labels = np.arange(5000), np.r_[np.zeros(100, int), np.ones(4900, int)]
    scores = np.r_[np.arange(100, 0, -1), np.full(4900, 99)]
    keys = hn.block_keys(0, 0, scores, ids, labels)
    assert len(keys) == (hn.POSITIVES + hn.NEGATIVES) * hn.KEY.itemsize
