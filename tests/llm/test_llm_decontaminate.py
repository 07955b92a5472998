"""Benchmark windows in texts, next to brute force on word lists."""

import hashlib
import random
import re

from llm_fixtures import corpus, documents, empty, messy, messy_rows

from shelfwise.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own is not None:
                    hit.update(range(i, i + n))
                    found |= own - {None}
        names = ",".join(sorted(map(str, found)))
        digest = hashlib.sha256(names.encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def planted(n=120):
    docs = corpus(n, seed=11)
    rng = random.Random(5)
    items = []
    for k in range(30):
        words = rng.choice(docs)[1].split(" ")
        at = rng.randrange(len(words))
        items.append((k * 7, " ".join(words[at : at + rng.choice([6, 10, 25])]).upper()))
    return docs, [*items, (7, items[3][1]), (None, items[4][1]), (900, None), (901, " ... "), (902, "nowhere")]


def test_equals_brute_force_in_one_part_and_in_several(spark):
    docs, items = planted()
    want = brute(docs, items)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert result(dc.hit_report(documents(spark, docs), benchmark(spark, items))) == want
    many = dc.hit_report(documents(spark, docs), benchmark(spark, items), part_bytes=1500)
    assert len(dc.window_sets(benchmark(spark, items), 10, 1500)) > 2 and result(many) == want


def test_awkward_rows_and_empty_tables(spark):
    items = [(1, "two three FOUR five"), (2, "w100 w101 w102 w103 w104 w105 w106 w107 w108 w109 w110"), (2, "word")]
    rows = [(r[0], r[1]) for r in messy_rows()]
    assert result(dc.hit_report(messy(spark), benchmark(spark, items))) == brute(rows, items)
    assert result(dc.hit_report(messy(spark), benchmark(spark, []))) == brute(rows, [])
    assert dc.hit_report(empty(spark), benchmark(spark, items)).count() == 0


def test_long_texts_and_colliding_words(spark):
    thue = "a"
    while len(thue) < 4096:
        thue = "".join({"a": "ab", "b": "ba"}[c] for c in thue)
    other = thue.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"c{i}" for i in range(9))
    docs = [(1, f"{common} {thue}"), (2, f"{common} {other}"), (3, "p q " * 250_000)]
    items = [(5, f"{common} {thue}"), (6, "q p q p q p q p q p q p")]
    assert result(dc.hit_report(documents(spark, docs), benchmark(spark, items))) == brute(docs, items)


def test_documents_and_spans_are_removed(spark):
    items = benchmark(spark, [(1, "alpha beta gamma")])
    docs = [(1, "x, Alpha, beta\ngamma! y"), (2, "alpha beta"), (None, None), (4, "alpha beta gamma"), (5, "é alpha beta gamma alpha beta gamma é")]
    rows = documents(spark, docs).withColumnRenamed("doc_id", "doc_id")
    assert sorted(r.doc_id or 0 for r in dc.drop_documents(rows, items).collect()) == [0, 2]
    clean = {r.doc_id: r.text for r in dc.drop_spans(rows, items).collect()}
    assert clean == {1: "x, ! y", 2: "alpha beta", None: None, 4: "", 5: "é  é"}
    assert dc.drop_spans(messy(spark), items).columns == messy(spark).columns
