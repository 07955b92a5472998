import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators.knn import knn_join, unit_vectors
from shelfwise.operators.names import similar_names
from shelfwise.operators.vectors import find_vector, hashed_vectors, vector_truncate
from shelfwise.plans.content import content_neighbors, content_recommend
from shelfwise.schemas import CATALOG


def points(spark, seed, n=150, dim=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim)) * 4
    rows = centers[rng.integers(0, 5, n)] + rng.normal(size=(n, dim))
    rows[3] = 0.0  # a zero vector
    rows[10:40] = rows[10]  # copies
    data = [(f"v{i}", [float(x) for x in v]) for i, v in enumerate(rows)]
    return rows, spark.createDataFrame(data, "point_id string, embedding array<double>")


def brute(ids, rows, k):
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
    sims = np.round(unit @ unit.T, 6) + 0.0
    out = {}
    for i, a in enumerate(ids):
        best = sorted(range(len(ids)), key=lambda j: (-sims[i, j], ids[j]))[:k]
        out[a] = [(ids[j], round(float(sims[i, j]), 6)) for j in best]
    return out


@pytest.mark.parametrize("chunk", [7, 40, 1000])
def test_knn_join_is_exact(spark, chunk):
    rows, df = points(spark, chunk)
    data = unit_vectors(df, "point_id", "embedding")
    got = {}
    for r in knn_join(data, data, 5, chunk).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbor"], round(r["similarity"], 6)))
    assert got == brute([f"v{i}" for i in range(len(rows))], rows, 5)


def catalog(spark, n=60):
    r = random.Random(3)
    words = ["red", "blue", "old", "ring", "bolt", "gear"]
    rows = []
    for i in range(n):
        name = f"{r.choice(words)} {r.choice(words)}"
        rows.append((f"{i:03d}", name, "tools", "T", r.choice(["X1", "Y1"]), 5.0, None))
    return rows, spark.createDataFrame(rows, CATALOG)


def tfidf(texts, min_df, max_df):
    docs = [re.findall(r"\w{2,}", t.lower()) for t in texts]
    n = len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    vocab = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if min_df <= c <= max_df * n}
    out = []
    for d in docs:
        w = {t: d.count(t) * vocab[t] for t in set(d) if t in vocab}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        out.append({t: x / norm for t, x in w.items()})
    return out


@pytest.mark.parametrize("chunk", [6, 2048])
def test_content_neighbors_with_many_copies(spark, chunk):
    rows, df = catalog(spark)
    texts = [f"{r[1]} {r[0]} {r[2]} {r[4]} {r[5]} {r[3]}" for r in rows]
    vectors = tfidf(texts, 2, 0.8)
    got = {}
    for r in content_neighbors(df, 4, chunk, min_df=2).orderBy("product_id", "rank").collect():
        got.setdefault(r["product_id"], []).append((r["rec_product_id"], round(r["similarity"], 6)))
    for i, row in enumerate(rows):
        sims = [
            (-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 6), rows[j][0])
            for j in range(len(rows))
            if j != i
        ]
        assert got[row[0]] == [(p, round(-s, 6) + 0.0) for s, p in sorted(sims)[:4]]


def test_content_lookup_reports_unknown_products(spark):
    model = spark.createDataFrame(
        [("a", i, f"r{i}", 0.5) for i in range(1, 13)],
        "product_id string, rank int, rec_product_id string, similarity double",
    )
    asked = spark.createDataFrame([("a",), ("zz",), ("a",)], "product_id string")
    got = content_recommend(model, asked).collect()
    assert len([r for r in got if r["product_id"] == "a" and r["found"]]) == 10
    assert [r["found"] for r in got if r["product_id"] == "zz"] == [False]


def test_similar_names_leave_out_excluded_products(spark):
    r = random.Random(4)
    words = ["red", "blue", "old", "the", "ring", "bolt", "gear", "x"]
    rows = [
        (f"{i:02d}", " ".join(r.choices(words, k=r.choice([0, 1, 2, 3]))), r.choice(["c1", "c2"]), "b")
        for i in range(60)
    ]
    details = spark.createDataFrame(rows, "product_id string, name string, category_code string, brand string")
    by_id = {row[0]: row for row in rows}
    asked, want = [], {}
    for target in ("00", "07", "13", "25", "44"):
        excluded = r.sample(sorted(by_id), 25)
        excluded = [x for x in excluded if x != target]
        needed = r.choice([1, 4, 10])
        asked.append((target, excluded, needed))
        group = [d for d in rows if d[2] == by_id[target][2]]
        corpus = [by_id[target]] + [d for d in group if d[0] != target and d[0] not in excluded]
        texts = [" ".join(w for w in d[1].split() if w != "the") for d in corpus]
        v = tfidf(texts, 0, 1.0)
        sims = [
            (-round(sum(x * v[j].get(t, 0) for t, x in v[0].items()), 6), corpus[j][0])
            for j in range(1, len(corpus))
        ]
        want[target] = [(p, round(-s, 6) + 0.0) for s, p in sorted(sims)[:needed]]
    targets = spark.createDataFrame(asked, "target string, excluded array<string>, needed int")
    got = {}
    for row in similar_names(targets, details).orderBy("target", "rank").collect():
        got.setdefault(row["target"], []).append((row["product_id"], round(row["similarity"], 6)))
    assert got == want


def test_vector_helpers(spark):
    _, df = points(spark, 1)
    assert vector_truncate(df, 7).count() == 0
    assert vector_truncate(df, 2).select(F.size("embedding")).distinct().collect()[0][0] == 2
    assert find_vector(df, "point_id", "v9").count() == 1
    _, products = catalog(spark)
    v = hashed_vectors(products).first()["embedding"]
    assert len(v) == 128 and math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-5)
