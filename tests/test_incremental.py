"""Clusters kept up to date by batches next to those of the whole history, and rules of all splits."""

import itertools
import random

import pytest

from shelfwise.operators import baskets, coldstart
from shelfwise.plans import incremental


def rows_of(df):
    return sorted(map(tuple, df.select("target", "bucket", "rank", "candidate", "freq").collect()), key=repr)


def history(seed=4):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(25)}", f"p{rng.randrange(30)}") for _ in range(200)]
    rows += [("hot", f"p{i}") for i in range(30)] + [(None, "lost"), ("alone", "single"), ("s1", None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_session string, product_id string")


def test_batches_add_up_to_the_whole_history(spark, tmp_path):
    """Torn sessions, repeated events, a batch that comes twice and one without anything new."""
    rows, root = history(), str(tmp_path / "state")
    cuts = [rows[:90], rows[90:140] + rows[:10], rows[140:]]
    for number, part in enumerate(cuts):
        assert incremental.update_clusters(frame(spark, part), root, f"b{number}", chunk=7, bucket_rows=20)
        so_far = frame(spark, [r for p in cuts[: number + 1] for r in p])
        want = rows_of(coldstart.coldstart_clusters(so_far.where("product_id is not null")))
        assert rows_of(incremental.current_clusters(spark, root)) == want
    assert not incremental.update_clusters(frame(spark, rows), root, "b1")
    assert incremental.update_clusters(frame(spark, rows[:50]), root, "late")
    assert rows_of(incremental.current_clusters(spark, root)) == want
    incremental.compact(spark, root)
    assert rows_of(incremental.current_clusters(spark, root)) == want
    assert len(incremental._live(incremental.log(spark, root))) == 1
    more = [("s1", "p99"), ("new", "p1"), ("new", "p99")]
    assert incremental.update_clusters(frame(spark, more), root, "after")
    want = rows_of(coldstart.coldstart_clusters(frame(spark, rows + more).where("product_id is not null")))
    assert rows_of(incremental.current_clusters(spark, root)) == want


def test_a_batch_that_failed_changes_nothing(spark, tmp_path, monkeypatch):
    rows, root = history(7)[:80], str(tmp_path / "state")
    incremental.update_clusters(frame(spark, rows[:40]), root, "a")
    before = rows_of(incremental.current_clusters(spark, root))
    write = incremental._write_log
    monkeypatch.setattr(incremental, "_write_log", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        incremental.update_clusters(frame(spark, rows[40:]), root, "b")
    assert rows_of(incremental.current_clusters(spark, root)) == before
    monkeypatch.setattr(incremental, "_write_log", write)
    assert incremental.update_clusters(frame(spark, rows[40:]), root, "b")
    want = rows_of(coldstart.coldstart_clusters(frame(spark, rows).where("product_id is not null")))
    assert rows_of(incremental.current_clusters(spark, root)) == want


def test_only_touched_products_are_written(spark, tmp_path):
    root = str(tmp_path / "state")
    incremental.update_clusters(frame(spark, [(f"s{i}", f"p{i}{k}") for i in range(50) for k in "ab"]), root, "a")
    incremental.update_clusters(frame(spark, [("s3", "p3c")]), root, "b")
    name = incremental.log(spark, root)[-1].name
    lists = incremental.read_keyed(spark, f"{root}/clusters/{name}")
    assert {r.target for r in lists.collect()} == {"p3a", "p3b", "p3c"}
    counts = incremental.read_keyed(spark, f"{root}/counts/{name}")
    assert sorted((r.target, r.candidate) for r in counts.collect()) == [
        ("p3a", "p3c"), ("p3b", "p3c"), ("p3c", "p3a"), ("p3c", "p3b"),
    ]
    assert incremental.current_clusters(spark, str(tmp_path / "none")).count() == 0


def test_rules_of_all_splits(spark):
    rng = random.Random(9)
    sold = [{x for x in "abcdef" if rng.random() < 0.55} for _ in range(60)]
    freq = {}
    for size in range(1, 7):
        for s in itertools.combinations("abcdef", size):
            n = sum(set(s) <= b for b in sold)
            if n >= 4:
                freq[s] = n
    want = set()
    for s, n in freq.items():
        for size in range(1, len(s)):
            for c in itertools.combinations(s, size):
                a = tuple(x for x in s if x not in c)
                if n / freq[a] >= 0.45:
                    leverage = n / 60 - freq[a] / 60 * freq[c] / 60
                    lift = n / freq[a] / (freq[c] / 60)
                    want.add((a, c, round(n / 60, 9), round(n / freq[a], 9), round(lift, 9), round(leverage, 9)))
    sets = spark.createDataFrame([(list(reversed(s)), n) for s, n in freq.items()], "items array<string>, freq long")
    got = baskets.all_rules(sets, 60, 0.45).collect()
    assert len(got) == len(want) > 50 and any(len(c) > 1 for _, c, *_ in want)
    found = {(tuple(r[0]), tuple(r[1]), *[round(x, 9) for x in r[2:]]) for r in got}
    assert found == want
    assert baskets.all_rules(sets.limit(0), 60).count() == 0
