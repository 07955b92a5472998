"""Catalog text and its TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import tokens
from ..storage import cut, spread

# Vocabulary size and document frequency limits.
MAX_FEATURES = 5000
MIN_DF = 5
MAX_DF = 0.8

# Characters of text whose terms one task counts.
TASK_CHARS = 16_000_000


def concat_features(catalog: DataFrame) -> DataFrame:
    """product_id, text: the product's fields in one text. A missing cast field reads ``nan``."""

    def cast(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("nan"))

    parts = [cast(c) for c in ("name", "product_id", "category", "brand", "price")]
    parts += [F.coalesce(F.col(c), F.lit("")) for c in ("description", "type")]
    return catalog.select("product_id", F.concat_ws(" ", *parts).alias("text"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def vocabulary(counts: DataFrame, n: int, max_features: int, min_df: float, max_df: float) -> DataFrame:
    """term, idx, idf of the most frequent admissible terms: at most ``max_features`` rows."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    terms = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    kept = terms.orderBy(F.desc("total"), "term").limit(max_features)
    listed = kept.agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("t"))
    return listed.select(F.posexplode("t").alias("idx", "t")).select(
        "t.term", "idx", idf(F.lit(float(n)), F.col("t.df")).alias("idf")
    )


def dealt(docs: DataFrame, doc: str, text: Column) -> tuple[DataFrame, int]:
    """(texts, number of rows): ``doc`` and its ``text`` in parts of bounded size, a document's in one.

    A file of short rows is one task however many terms they have, and terms take more room than
    their texts. What is counted by document needs no shuffle after this one.
    """
    texts = docs.select(doc, text.alias("text"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    return spread(texts, doc, least=-(-(size["chars"] or 0) // TASK_CHARS)), size["n"]


def tfidf_weights(
    docs: DataFrame,
    doc: str = "product_id",
    max_features: int = MAX_FEATURES,
    min_df: float = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """doc, term, idx, tf, weight with unit length per document.

    Texts are dealt out by document, once for the vocabulary and once for the weights, which costs
    less than to write or to shuffle their terms. The vocabulary has a fixed largest size and is
    broadcast.
    """
    texts, n = dealt(docs, doc, F.col("text"))
    words = texts.select(doc, F.explode(tokens(F.col("text"))).alias("term"))
    counts = words.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = cut(vocabulary(counts, n, max_features, min_df, max_df))
    raw = counts.join(F.broadcast(vocab), "term").withColumn("w", F.col("tf") * F.col("idf"))
    terms = F.collect_list(F.struct("term", "idx", "tf", "w")).alias("terms")
    per_doc = raw.groupBy(doc).agg(terms, F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return per_doc.select(doc, "norm", F.inline("terms")).select(
        doc, "term", "idx", "tf", (F.col("w") / F.col("norm")).alias("weight")
    )
