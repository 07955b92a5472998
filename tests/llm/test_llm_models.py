"""Neighbours, personal data and the quality classifier."""

import hashlib
import random
import re
from collections import Counter

import pytest
from llm_fixtures import documents, empty, messy, messy_rows

import numpy as np
import pyarrow as pa
from shelfwise.llm import curves, pii, quality
from pyspark.sql import functions as F


# ---- neighbours ----------------------------------------------------------------------------
def exact_neighbours(rows, every, k):
    """Brute force over the valid vectors, one for each id."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = v
    out = {}
    for q in good:
        if q % every == 0:
            found = [(-curves.exact_score(np.array(good[q], float), np.array(v, float)), i) for i, v in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def clusters(n, size=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, size))
    rows = centres[rng.integers(0, 30, n)] + 0.3 * rng.standard_normal((n, size))
    return [(int(i), v) for i, v in enumerate(rows.astype(np.float32).tolist())]


def test_one_range_gives_exact_neighbours(spark):
    rows = clusters(400)
    got = {}
    for r in curves.nearest(frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == exact_neighbours(rows, 50, 5)


def test_recall_over_many_ranges(spark):
    rows = clusters(4000)
    want = exact_neighbours(rows, 50, 5)
    got = curves.nearest(frame(spark, rows), range_rows=100).collect()
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert Counter(r.query_id for r in got) == Counter({q: 5 for q in want})


@pytest.mark.parametrize("range_rows", [20, 2000])
def test_hot_vectors_and_ties(spark, range_rows):
    """A third of all vectors are equal; ties go to the smaller ids."""
    rows = [(i, [1.0, 2.0, 0.5]) if i % 3 == 0 else (i, [float(i), 1.0, -2.0]) for i in range(400)]
    got = curves.nearest(frame(spark, rows), range_rows=range_rows).collect()
    first = sorted((r.rank, r.vec_id) for r in got if r.query_id == 150)
    assert first == [(1, 0), (2, 3), (3, 6), (4, 9), (5, 12)]


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (50, [inf, 1.0])]
    rows += [(5, [1.0, None]), (None, [1.0, 0.0]), (6, []), (7, [1.0]), (0, [1.0, 0.0]), (100, [3e38, 3e38]), (150, [1e-40, 0.0])]
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in curves.nearest(frame(spark, rows)).collect()}
    assert {q for q, _ in got} == {0, 100, 150}
    assert got[0, 1] == (150, 1.0) and got[0, 2][0] == 1 and got[0, 3][0] == 100 and (0, 4) not in got
    assert curves.nearest(frame(spark, [])).count() == 0
    assert curves.nearest(frame(spark, [(0, [1.0])])).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ---- personal data -------------------------------------------------------------------------
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check_base(rows, got):
    want = Counter()
    for i, text in rows:
        spans = base(text or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(i, *[sum(k == kind for k, _, _ in spans) for kind in RULES], hashlib.sha256(line.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None and sum(i == r.doc_id for i, _ in rows) == 1:
            spans = [s for s in r.spans.split(",") if s]
            assert {f"{k}:{a}:{b}" for k, a, b in base(texts[r.doc_id] or "")} <= set(spans)
            order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
            assert order == sorted(order)


def test_exact_rules_match_regular_expressions(spark):
    rng = random.Random(5)
    parts = ["a", "Z", "9", "4", "0", "12", "255", " ", "-", ".", "@", "+", "(", ")", "_", "%", "é", "🙂", "\x01", "\n"]
    parts += ["4539 1488 0343 6467", "+49 89 1234567", "a@b.co", "10.0.0.1", "password=ab12cd34"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(9001, "a." * 9000 + "@b" + ".c" * 9000), (9002, "9" * 20_000), (9003, "+" + "1 " * 9000), (9004, "x@" * 9000)]
    check_base(rows, pii.find_personal_data(documents(spark, rows)).collect())


@pytest.mark.parametrize(
    "text", [("9" * 100 + ".1.1 ") * 9_500, "user.name@mail.example.com " * 37_000, "+1 " * 330_000]
)
def test_texts_of_a_megabyte(spark, text):
    rows = documents(spark, [(1, text), (2, "a@b.co")]).select("doc_id", pii.base_spans(F.col("text")).alias("b"))
    got = {r.doc_id: [(pii.KINDS[x.kind], x.s, x.e) for x in r.b] for r in rows.collect()}
    assert got == {1: base(text), 2: [("email", 0, 6)]}


def test_all_of_a_chain_of_overlapping_spans_is_redacted(spark):
    """The middle one of three overlapping secrets is the best: what the others cover goes, too."""
    span = lambda s, e, gen: {"s": s, "e": e, "gen": gen, "secret": True, "clear": True} | {
        f: 0 for f in pii.FEATURES if f != "gen"
    }
    model = pii.Model(least=[0.0] * 5)
    spans = [span(0, 10, 3), span(8, 30, 4), span(28, 38, 3), span(30, 36, 4)]
    kinds = ", ".join(f"{f}: int" for f in pii.FEATURES)
    schema = (
        "doc_id long, base array<struct<kind:int,s:int,e:int>>, "
        f"proposed array<struct<s:int, e:int, {kinds}, secret: boolean, clear: boolean>>"
    )
    rows = spark.createDataFrame([(1, [], spans)], schema)
    got = pii.with_spans(rows, model).first().spans
    assert [(x.s, x.e) for x in got] == [(0, 10), (8, 30), (28, 38)]


def test_personal_data_of_awkward_rows(spark):
    check_base([(i, t) for i, t, *_ in messy_rows()], pii.find_personal_data(messy(spark)).collect())
    assert pii.find_personal_data(empty(spark)).count() == 0


def secrets(n=600):
    rng = random.Random(6)
    rows, wanted = [], {}
    for i in range(n):
        words = [rng.choice("the of plain words verylongwordwithoutdigits v2 s3x chapter7".split()) for _ in range(30)]
        if i % 4 == 0:
            key = "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16))
            words[5:5] = [key]
            wanted[i] = key
        if i % 5 == 0:
            words[9:9] = ["mail", f"u{i}@mail.example.com"]
        rows.append((i, " ".join(words)))
    return rows, wanted


def test_secrets_are_added_and_clean_texts_left_alone(spark):
    rows, wanted = secrets()
    got = {r.doc_id: r.spans for r in pii.find_personal_data(documents(spark, rows)).collect()}
    texts = dict(rows)
    for i, spans in got.items():
        added = [s.split(":") for s in spans.split(",") if s and s.startswith("secret")]
        assert [texts[i][int(a) : int(b)] for _, a, b in added] == ([wanted[i]] if i in wanted else [])
        if i % 5 and i not in wanted:
            assert spans == ""


def test_redaction_replaces_spans_and_keeps_columns(spark):
    rows, wanted = secrets(200)
    docs = documents(spark, rows).withColumn("n_chars", F.length("text")).withColumn("spans", F.lit("mine"))
    docs = docs.withColumn("base", F.lit(1)).withColumn("new", F.lit(2))
    model = pii.fit(pii.found_spans(documents(spark, rows)))
    out = pii.redact(docs, model)
    assert out.dtypes == docs.dtypes
    for r in out.collect():
        text = dict(rows)[r.doc_id]
        want = re.sub(RULES["email"], "[EMAIL]", text.replace(wanted.get(r.doc_id, "\x00"), "[SECRET]"))
        assert r.text == want and r.spans == "mine" and r.n_chars == len(r.text)
    left = pii.redact(messy(spark), model)
    assert left.count() == len(messy_rows()) and left.columns == messy(spark).columns


def test_boosted_trees_separate_counted_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (300, len(pii.FEATURES)))
    good = ((x[:, 2] > 1) & (x[:, 5] <= 1)) | (x[:, 7] > 2)
    total = rng.integers(1, 50, 300).astype(float)
    model = pii.boost(x, np.where(good, total, 0), total)
    assert ((model.margins(x) > 0) == good).mean() > 0.97


# ---- quality -------------------------------------------------------------------------------
def labelled(n=400):
    rng = random.Random(9)
    good = [f"{a}{b}" for a in "re ti on an".split() for b in "shed ther ing ly".split()]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(5, 60))]
        bad = i % 5 in (1, 3) and i % 3 == 0
        if bad:
            kind = i % 4
            words = [w + "&&&" for w in words] if kind == 0 else [w for w in words for _ in range(8)] if kind == 1 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (7, dict(labels)[7])], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert all(got[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    right = [got[i].predicted == dict(labels)[i] for i in held]
    assert sum(right) >= 0.95 * len(right) and len(held) > 40
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_labels_are_read_outside_the_held_out_part_only(spark):
    rows, labels = labelled(200)
    docs = documents(spark, rows)
    import zlib

    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = quality.fit(docs, spark.createDataFrame(other, "doc_id long, quality int"))
    assert np.allclose(a.vectors, b.vectors) and np.allclose(a.layer, b.layer)


def test_scores_of_awkward_rows_and_of_a_neutral_model(spark):
    model = quality.fit(messy(spark), spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score(messy(spark), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in messy_rows())
    assert {r.score for r in got} == {0.5}
    assert quality.score(empty(spark), model).count() == 0
    kept = quality.keep_good(messy(spark), model)
    assert kept.count() == len(messy_rows()) and kept.schema == messy(spark).schema


def test_batch_scores_equal_the_features_of_each_text():
    rows, _ = labelled(60)
    texts = pa.array([t for _, t in rows] + ["", "é 🙂 x"])
    rng = np.random.default_rng(1)
    model = quality.Model(rng.standard_normal((quality.BUCKETS, quality.SIZE)), rng.standard_normal((quality.SIZE, 2)), np.array([0.1, 0.3]))
    per_bucket, bias = model.margins()
    want = [bias + float((per_bucket[b] * w).sum()) for b, w in quality.features(texts)]
    assert np.allclose(quality.margins(texts, per_bucket, bias), want, atol=1e-4)
