"""Small tables with every awkward case, and texts with planted copies."""

import random

MESSY = (
    "doc_id long, text string, lang string, source string, n_chars long, d long, h string, "
    "unit int, shard int, row string, length string, base string, kept string"
)
LONG = " ".join(f"w{i}" for i in range(30_000)) + " mail me at a.b@mail.example.com or +1 (555) 555-0199"


def messy_rows():
    texts = [
        (1, "One two three four five six seven"),
        (2, None),
        (3, ""),
        (4, "   \t\n "),
        (5, "one TWO three four five six seven"),
        (5, "one TWO three four five six seven"),
        (None, "one two three four five six seven"),
        (None, None),
        (6, "word"),
        (7, "word"),
        (8, LONG),
        (9, LONG + " and one more"),
        (10, "x" * 50_000),
        (11, "1 " * 20_000),
        (-3, "ünïcödé 🙂 tèxt with ÀÉ and 日本 words"),
        (12, "card 4539 1488 0343 6467 ip 10.0.0.1 and 999.1.1.1 mail x@y.co.uk"),
    ]
    return [
        (i, t, "en", "s", len(t or ""), 0, "h", 7, 9, "r", "len", "b", "k") for i, t in texts
    ]


def messy(spark):
    return spark.createDataFrame(messy_rows(), MESSY).repartition(3)


def empty(spark):
    return spark.createDataFrame([], MESSY)


def corpus(n=150, seed=3):
    """(doc_id, text) with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "the on re st ing er an".split() for b in "ti ha nd es or ly wh".split()]
    vocabulary += ["the", "of", "and", "is", "le", "la"] * 4
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 60))] for _ in range(4)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.25:
            words = rng.choice(out)[1].split(" ")
            if rng.random() < 0.7:
                words = list(words)
                for _ in range(max(1, len(words) // 60)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 25, 80, 300]))]
            if kind > 0.7:
                at = rng.randrange(len(words) + 1)
                words[at:at] = rng.choice(passages)
        out.append((i, " ".join(words)))
    return out


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
