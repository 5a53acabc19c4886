"""Ranked retrieval over many queries at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


#: Queries that one block holds at most, about.
BLOCK = 256


def nearest(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """J18. (query, rank, item, score) of the k most similar items of every query.

    ``queries`` (query, qvec) is a stated set held against all of ``items`` (item, vec).  The queries are packed
    into one array per block of 256, so a task scores an item against a block at a time; each block keeps its top k per partition
    before anything is shuffled.
    """
    n_blocks = max(1, -(-queries.count() // BLOCK))
    blocks = queries.select(F.struct("query", "qvec", norm(F.col("qvec")).alias("qn")).alias("q"), F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("_block"))
    packed = blocks.groupBy("_block").agg(F.collect_list("q").alias("qs"))  # a block holds about BLOCK queries whatever their number
    sized = items.select("item", "vec", norm(F.col("vec")).alias("vn"))
    scored = sized.join(packed, how="cross").select("item", "vec", "vn", F.explode("qs").alias("q"))
    score = dot(F.col("vec"), F.col("q.qvec")) / F.greatest(F.col("vn") * F.col("q.qn"), F.lit(1e-12))
    hits = scored.select(F.col("q.query").alias("query"), "item", F.round(score, 6).alias("score"))
    if exclude_self:
        hits = hits.where("query <> item")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # becomes a partial limit per partition


def sparse_scores(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """J18, sparse leg. Inner product of term weights: (query, term, weight) against (item, term, weight)."""
    q = queries.select("query", "term", F.col("weight").alias("qw")).where("qw > 0")
    d = postings.where("weight > 0")
    return d.join(q, "term").groupBy("query", "item").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def ranked(hits: DataFrame, leg: str) -> DataFrame:
    """W1. 0-based rank of each item in its list, ties by item."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return hits.select("query", "item", F.lit(leg).alias("leg"), (F.row_number().over(w) - 1).alias("rank"))


def fuse(legs: list[tuple[DataFrame, float]], k: int = 60, p: float = 1.0, top: int = 20) -> DataFrame:
    """J7, V5, L1. Power mean of weighted reciprocal ranks; p = 1 adds them up, p = inf takes the best, ties by their sum, then by first appearance."""
    if p < 1 or any(w < 0 for _, w in legs):
        raise ValueError("p must be at least 1, and weights not negative")
    parts = [df.select("query", "item", (F.lit(w) / (F.col("rank") + k + 1)).alias("term"), (F.lit(i * 10**9) + F.col("rank")).alias("pos")) for i, (df, w) in enumerate(legs)]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    score = F.max("term") if math.isinf(p) else F.pow(F.sum(F.pow("term", F.lit(p))), F.lit(1.0 / p))
    out = both.groupBy("query", "item").agg(F.round(score, 12).alias("score"), F.round(F.sum("term"), 12).alias("sum_terms"), F.min("pos").alias("pos"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("sum_terms"), "pos", "item")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query", "item", "rank", "score")


def first_seen(hits: DataFrame, key: str) -> DataFrame:
    """W2-W4. Distinct non-empty keys of each query in hit order, with their rank among distinct keys."""
    first = hits.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy("query", key).agg(F.min("rank").alias("hit_rank"))
    return first.withColumn("distinct_rank", F.row_number().over(Window.partitionBy("query").orderBy("hit_rank", key)))


def expand_threads(hits: DataFrame, chunks: DataFrame, thread: str) -> DataFrame:
    """J4. All chunks of the threads that were hit, in the order of the threads' best hits."""
    return chunks.join(first_seen(hits, thread).select("query", thread, "distinct_rank"), thread)


#: Words of 64 bits that a filter by hash has.
WORDS = 1 << 18


def perhaps_among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """J4. All rows of ``df`` whose ``key`` is among ``keys``, and a few others: those whose hash falls on a bit that a key of ``keys`` has set.

    At most ``WORDS`` rows are broadcast, whatever the number of keys; many keys only let more other rows through.
    """
    h = F.xxhash64(key)
    word, bit = F.pmod(h, F.lit(WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    bits = keys.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"))
    return df.join(F.broadcast(bits), (word == F.col("_word")) & (F.getbit(F.col("_bits"), bit) == 1), "left_semi")


def recall_at(hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """A11, J16. Hits of (query, item, rank) against (query, category, gold): recall at k and mean reciprocal rank, overall and per category."""
    best = gold.join(hits.select("query", F.col("item").alias("gold"), "rank"), ["query", "gold"], "left").groupBy("query", "category").agg(F.min("rank").alias("r"))
    values = [F.round(F.avg((F.coalesce(F.col("r") <= k, F.lit(False))).cast("int")), 6).alias(f"recall_{k}") for k in ks]
    out = best.groupingSets([[], [F.col("category")]], F.col("category")).agg(F.grouping("category").alias("_all"), F.count("*").alias("n"), *values, F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category").cast("string")).alias("category"), "n", *[f"recall_{k}" for k in ks], "mrr")
