import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import coldstart as cold
from shelfwise.operators.pairs import pair_sums


def sessions(spark, groups):
    rows = [(s, p) for s, products in groups.items() for p in products]
    return spark.createDataFrame(rows, "user_session string, product_id string")


SMALL = {"1": "ABC", "2": "AB", "3": "D"}


def test_golden_cooccurrence(spark):
    got = {(r["target"], r["candidate"]): r["freq"] for r in cold.cooccurrence(sessions(spark, SMALL)).collect()}
    assert got == {
        ("A", "B"): 2, ("A", "C"): 1, ("B", "A"): 2, ("B", "C"): 1, ("C", "A"): 1, ("C", "B"): 1
    }


def test_product_without_partner_keeps_an_entry(spark):
    rows = cold.coldstart_clusters(sessions(spark, SMALL)).where("target = 'D'").collect()
    assert [(r["bucket"], r["candidate"]) for r in rows] == [(None, None)]


def random_rows(seed, keys=30, items=25):
    r = random.Random(seed)
    rows = []
    for k in range(keys):
        for i in r.sample(range(items), r.choice([1, 2, 3, 20, 25])):
            rows.append((f"k{k}", f"i{i}", round(r.uniform(0.1, 5), 3)))
    return rows


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_pair_sums_of_small_and_large_groups(spark, chunk):
    rows = random_rows(chunk)
    by_key = defaultdict(dict)
    for k, i, v in rows:
        by_key[k][i] = v
    want = defaultdict(lambda: [0, 0.0, 0.0, 0.0, 0.0])
    for group in by_key.values():
        for a, b in itertools.permutations(group, 2):
            x, y = group[a], group[b]
            w = want[a, b]
            for j, add in enumerate((1, x, y, x * y, (x - y) ** 2)):
                w[j] += add
    df = spark.createDataFrame(rows, "k string, i string, v double")
    got = {
        (r["a"], r["b"]): [r["n"], r["sx"], r["sy"], r["sxy"], r["sd2"]]
        for r in pair_sums(df, "k", "i", "v", chunk=chunk).collect()
    }
    assert got.keys() == want.keys()
    for key, sums in want.items():
        assert got[key] == pytest.approx(sums, abs=1e-9)


def test_left_side_restricts_targets(spark):
    rows = [(k, i) for k, i, _ in random_rows(5)]
    df = spark.createDataFrame(rows, "k string, i string")
    left = df.where(F.col("i").isin("i1", "i2"))
    whole = {(r["a"], r["b"]): r["n"] for r in pair_sums(df, "k", "i", chunk=5).collect()}
    part = {(r["a"], r["b"]): r["n"] for r in pair_sums(df, "k", "i", left=left, chunk=5).collect()}
    assert part == {p: n for p, n in whole.items() if p[0] in ("i1", "i2")}


def test_one_key_with_many_items_on_one_side(spark):
    """50,000 items of one key against three: as many pairs, and no unit with many of them."""
    many = spark.range(50_000).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("i"))
    few = many.where(F.col("i").isin("1", "2", "3"))
    got = pair_sums(many, "k", "i", left=few, chunk=500)
    assert got.count() == 3 * 49_999
    assert got.agg(F.max("n")).first()[0] == 1


def test_only_large_keys_need_their_sizes(spark, monkeypatch):
    from shelfwise.operators import pairs

    sizes = []

    def spy(df):
        if "ca" in df.columns:
            sizes.append(sorted(tuple(r) for r in df.select("k", "ca", "cb").collect()))
        return df

    monkeypatch.setattr(pairs, "cut", spy)
    rows = [("large", f"i{i}") for i in range(9)] + [(f"k{k}", f"i{i}") for k in range(20) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i string")
    left = df.where("i = 'i1'")
    got = {tuple(r) for r in pair_sums(df, "k", "i", left=left, chunk=4).select("a", "b", "n").collect()}
    assert got == {("i1", f"i{i}", 21.0 if i in (0, 2) else 1.0) for i in range(9) if i != 1}
    assert pair_sums(df, "k", "i", chunk=9).count() == 72
    assert sizes == [[("large", 1, 3)], []]


@pytest.mark.parametrize("chunk", [2, 64])
def test_cluster_lists_match_a_full_sort(spark, chunk):
    rows = random_rows(9, 40, 30)
    groups = defaultdict(list)
    for k, i, _ in rows:
        groups[k].append(i)
    freq = Counter()
    for g in groups.values():
        freq.update(itertools.permutations(set(g), 2))
    assert all(freq[a, b] == freq[b, a] for a, b in freq)
    got = cold.coldstart_clusters(sessions(spark, groups), 4, 3, chunk=chunk).collect()
    for target in {i for _, i, _ in rows}:
        ranked = sorted((c for t, c in freq if t == target), key=lambda c: (-freq[target, c], c))
        mine = [r for r in got if r["target"] == target]
        top = [r["candidate"] for r in sorted(mine, key=lambda r: r["rank"]) if r["bucket"] == "top"]
        others = {r["candidate"] for r in mine if r["bucket"] == "others"}
        assert top == ranked[:4] and target not in top
        assert others <= set(ranked[4:]) and len(others) == min(3, len(ranked[4:]))


def test_cluster_choice(spark):
    clusters = spark.createDataFrame(
        [("A", "B"), ("A", "X"), ("B", "A"), ("C", "X")], "target string, candidate string"
    )
    asked = spark.createDataFrame([("A",), ("X",), ("Z",)], "product_id string")
    got = {r["target"]: r["cluster"] for r in cold.cluster_for_target(clusters, asked).collect()}
    assert got == {"A": "A", "X": "A", "Z": None}
