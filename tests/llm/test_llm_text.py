"""Sharding, URL rules, tokens and packing."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import tiktoken
from llm_fixtures import corpus, documents, empty, messy, messy_rows
from tokenizers import Tokenizer

import public_tokenizers
import pyarrow as pa
from shelfwise.llm import bpe, packing, ring, urls

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


# ---- sharding ------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 7, 8, 150])
def test_shards_differ_by_one_row_at_most(spark, n):
    rows = ring.shard_documents(documents(spark, corpus(n) if n else [])).collect()
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(8)]
    assert len(rows) == n and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_of_awkward_rows(spark):
    rows = ring.shard_documents(messy(spark)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in messy_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_one_more_shard_moves_little_and_one_key_may_hold_most(spark):
    rows = documents(spark, [(i if i % 3 else 0, str(i)) for i in range(900)])
    spread = ring.assign(rows, ["doc_id"], 8, load=1.0).groupBy("shard").count().collect()
    assert {r["count"] for r in spread} == {112, 113}
    many = spark.range(4000).withColumnRenamed("id", "k")
    a = {r.k: r.shard for r in ring.assign(many, ["k"], 8, load=1.3).collect()}
    b = {r.k: r.shard for r in ring.assign(many, ["k"], 9, load=1.3).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)


# ---- URLs ----------------------------------------------------------------------------------
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url, listed=()):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if url in listed else "allow"


def test_urls_match_the_rules(spark):
    rng = random.Random(4)
    hosts = ["a.net", "NET", "net", "b.example.net", "example.net", "x.org", "q.example.com", "xexample.net", "a.b.c.d.org", "", "é.com", "a.net:80", "net."]
    paths = ["", "/", "/en/1", "/en", "/de/x", "/fr/", "/fr", "//en/", "/EN/", "/d?e", "/fr/#x"]
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "://"), (904, "http://x.com/" + "a." * 20_000)]
    rows += [(905, "http://bad.com/x"), (905, "http://bad.com/x"), (None, "http://bad.com/x")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("http://bad.com/x",), (None,), ("junk",)], "url string")
    got = urls.filter_urls(pages, urls.contract_rules(spark), listed).collect()
    want = Counter((i, *judged(u, {"http://bad.com/x"})) for i, u in rows)
    assert Counter(tuple(r) for r in got) == want


def test_urls_of_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(none, urls.contract_rules(spark), none.select("url")).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    no_rules = urls.contract_rules(spark).limit(0)
    assert urls.filter_urls(one, no_rules, one.select("url").limit(0)).first().verdict == "allow"


def test_a_full_filter_still_gives_exact_verdicts(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 0)
    rows = [(i, f"http://h{i}.com/p") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.filter_urls(pages, urls.contract_rules(spark), pages.where("page_id < 100").select("url"))
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(100))


# ---- tokens --------------------------------------------------------------------------------
def test_encoding_equals_the_libraries_and_decodes_back(spark, library):
    rng = random.Random(8)
    signs = " \n\t'stmdrevlaé1²½x!?,.  日本🙂ñ\r\x1c\x85"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for i in range(3000)]
    rows += [(5000 + i, t) for i, (_, t) in enumerate(corpus(60))]
    rows += [(9000, "a" * 4000), (9001, "'s's 'll'x don't I'll''s"), (9002, " " * 700), (9003, "<|endoftext|>")]
    encoded = bpe.encode_documents(documents(spark, rows), RANKS)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    for i, text in rows:
        assert got[i] == library.encode_ordinary(text)
        assert got[i] == plain.encode(text, add_special_tokens=False).ids
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(encoded, RANKS).collect()}
    assert back == {i: t.encode() for i, t in rows}


def test_added_tokens_of_the_vocabulary_file():
    """The library in its default setting, as the query for packing uses the file."""
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark} don't", "plain text", "", f"x\n {mark}", "<|endoftext|", f"é{mark}日本"]
    coder, plain = bpe.Encoder(JSON), Tokenizer.from_file(JSON)
    got = []
    for a, b, ids, ends in coder.encode(pa.array(texts)):
        got += [ids[ends[i] : ends[i + 1]] for i in range(b - a)]
    assert got[0].tolist() == [64, 220, 50256, 275]
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [coder.decode(x) for x in got] == [t.encode() for t in texts]


def test_digest_of_awkward_rows(spark, library):
    got = Counter(tuple(r) for r in bpe.digest_documents(messy(spark), RANKS).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, *_ in messy_rows():
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert got == want
    assert bpe.digest_documents(empty(spark), RANKS).count() == 0


def test_vocabulary_files_agree():
    assert bpe.read_ranks(RANKS) == bpe.read_ranks(JSON)


# ---- packing -------------------------------------------------------------------------------
def test_patterns_use_every_piece_once_and_fill_well():
    rng = random.Random(2)
    for n in (0, 1, 40, 3000):
        counts = Counter(min(2048, int(rng.lognormvariate(6, 1.1)) + 1) for _ in range(n))
        used = Counter()
        patterns = packing.plan_patterns(counts)
        for lengths, times in patterns:
            assert sum(lengths) <= 2048 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
        least = -(-sum(k * v for k, v in counts.items()) // 2048)
        assert sum(t for _, t in patterns) <= max(least, 1) * 1.05 + 1


def test_exact_complements_are_found_before_best_fit():
    # 1000 + 1048 fills, as do 2000 + 20 + 28; the longest that fits would be 30
    patterns = packing.plan_patterns({1000: 1, 1048: 1, 2000: 1, 20: 1, 28: 1, 30: 1})
    assert sorted(sorted(p) for p, _ in patterns) == [[20, 28, 2000], [30], [1000, 1048]]


@pytest.mark.parametrize("unit_rows", [10, 200_000])
def test_packing_of_documents(spark, library, monkeypatch, unit_rows):
    monkeypatch.setattr(packing, "UNIT_ROWS", unit_rows)
    rows = corpus(80) + [(200, None), (201, ""), (None, "x"), (202, "word " * 9000), (202, "word " * 9000)]
    got = packing.pack_documents(documents(spark, rows), JSON, keep_ids=True).collect()
    by_doc = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        by_doc[r.doc_id].append(r)
    for i, text in rows:
        ids = [*library.encode_ordinary(text or ""), 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        times = sum(1 for j, _ in rows if j == i)
        assert len(own) == times * -(-len(ids) // 2048)
        if times == 1:
            assert [x for r in own for x in r.ids] == ids
            assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert all(r.length == 2048 for r in own[times:])
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + 1
    assert packing.pack_documents(empty(spark), JSON).count() == 0


# ---- words that collide in polynomial hashes -----------------------------------------------
def thue_morse(n):
    text = "a"
    while len(text) < n:
        text = "".join({"a": "ab", "b": "ba"}[c] for c in text)
    return text, text.translate(str.maketrans("ab", "ba"))


def test_pieces_of_equal_polynomial_hash_keep_their_ids(spark, library):
    texts = [t for n in (1024, 2048, 4096, 8192) for t in thue_morse(n)]
    got = bpe.digest_documents(documents(spark, list(enumerate(texts))), RANKS).collect()
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_each_piece_is_replayed_once_while_it_is_kept():
    coder = bpe.Encoder(RANKS)
    replayed = []
    old = coder.words.replay
    coder.words.replay = lambda words: replayed.extend(words) or old(words)
    for _ in range(3):
        for _ in coder.encode(pa.array([t for _, t in corpus(120)])):
            pass
    assert replayed and len(replayed) == len(set(replayed))
