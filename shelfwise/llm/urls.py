"""URL filter: a blocked Bloom filter lets possible hits pass, an exact hash join decides.

The list holds rules (host and path prefix with a verdict) and canonical URLs to block. A URL
asks for the keys that a listed entry could have: the last labels of its host with the first
characters of its path, in the shapes that occur in the list, and its canonical form. Each key
is looked up in the filter; keys that pass meet the list in a hash join, which removes the false
positives of the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
#: The filter has at most this many blocks of 256 bits (2 MB); a longer list only lets more
#: keys pass to the exact join.
MOST_BLOCKS = 1 << 16
WORDS = 4
PROBES = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract, as (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Host labels of the sites whose pages the production query lists.
LISTED_LABELS = ("adult", "adult-x", "bets", "free-bets", "casino", "poker", "xxx")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(_after(url), F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www, path without query, ending slash and .html; empty: null."""
    short = F.regexp_replace(path, "(?:\\.html)?/*$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, "^www\\.", ""), short))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in its block, as one long for each 64 bits."""
    h = F.xxhash64(key, F.lit(1))
    spots = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]
    out = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for s in spots:
            inside = F.shiftright(s, 6) == w
            bit = F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), s % 64))
            mask = mask.bitwiseOR(F.coalesce(bit, F.lit(0).cast("long")))
        out.append(mask)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(blocks)).cast("int")


def bloom_blocks(keys: DataFrame, n_keys: int, most: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter as a table of at most ``most`` rows (block, w0 .. w3) and its block count."""
    blocks = 1
    while blocks < most and blocks * 64 * WORDS < n_keys * BITS_PER_KEY:
        blocks *= 2
    marked = keys.select(
        _block(F.col("key"), blocks).alias("block"),
        *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))],
    )
    return marked.groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    ), blocks


def may_hold(probes: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``probes`` whose ``key`` the filter may hold; the filter's size is bounded."""
    asked = probes.withColumn("block", _block(F.col("key"), blocks))
    found = asked.join(F.broadcast(bits), "block")
    for i, m in enumerate(_masks(F.col("key"))):
        found = found.where(F.col(f"w{i}").bitwiseAND(m) == m)
    return found.select(*probes.columns)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """One table of keys: rules (host, path, verdict) and listed canonical URLs (url).

    Of a repeated rule the blocking one counts. Null hosts, paths or URLs are no entries.
    """
    rule = F.concat("host", "path")
    prefixes = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(
            F.concat(F.lit("r:"), rule).alias("key"),
            rule.alias("rule"),
            "verdict",
            F.size(F.split("host", "\\.")).alias("labels"),
            F.length("path").alias("chars"),
        )
        .groupBy("key", "rule", "labels", "chars")
        .agg(F.max("verdict").alias("verdict"))
    )
    exact = listed.where(F.col("url").isNotNull()).select(
        F.concat(F.lit("u:"), canonical(host_of(F.col("url")), path_of(F.col("url")))).alias("key")
    )
    exact = exact.where(F.col("key").isNotNull()).distinct()
    return prefixes.unionByName(exact, allowMissingColumns=True)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    The longest rule that fits decides; without one, a listed canonical URL is blocked and all
    others are allowed. Null URLs and those without ``://`` have an empty host and path and are
    allowed. Repeated rows and URLs are judged once and all returned; other columns are ignored.
    """
    listed_keys = entries(rules, listed)
    shapes = [
        (r[0], r[1])
        for r in listed_keys.where("rule is not null").select("labels", "chars").distinct().collect()
    ]
    bits, blocks = bloom_blocks(listed_keys, listed_keys.count())
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    keys = [F.concat(F.lit("u:"), canonical(F.col("h"), F.col("p")))]
    for labels, chars in sorted(shapes):
        tail = F.substring_index("h", ".", -labels)
        key = F.concat(F.lit("r:"), tail, F.substring("p", 1, chars))
        keys.append(F.when((F.length("p") >= chars) & (F.col("h") != ""), key))
    probes = urls.select("url", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    passed = may_hold(probes, bits, blocks)
    hits = passed.join(listed_keys, "key")
    judged = hits.groupBy("url").agg(
        F.max(
            F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))
        ).alias("best"),
        F.max(F.col("rule").isNull()).alias("is_listed"),
    )
    other = F.when(F.col("is_listed"), "block").otherwise("allow")
    return (
        pages.select("page_id", "url")
        .join(judged, "url", "left")
        .select(
            "page_id",
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.verdict"), other).alias("verdict"),
        )
    )


def contract_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def listed_sites(pages: DataFrame) -> DataFrame:
    """The URLs of pages whose host has one of the listed labels."""
    labels = F.split(host_of(F.col("url")), "\\.")
    return pages.where(
        F.arrays_overlap(labels, F.array(*[F.lit(x) for x in LISTED_LABELS]))
    ).select("url")
