"""Search over a chunk table as one plan for many queries (V1-V4, J18, J7, L1, J4, A2, F26), with a deterministic encoder in place of a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import numeric_tokens
from threadloom.operators import retrieval as R
from threadloom.operators.products import best
from threadloom.runtime import default_parallelism, materialise

DIM = 64


def sparse_terms(text: Column) -> Column:
    """V1, V3. Word weights of a text: 1 + ln(tf), canonical figures included; nothing at or below 0."""
    words = F.concat(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}]{2,}"), F.lit(0)), numeric_tokens(text))
    return words


def encode(df: DataFrame, key: str, text: str) -> DataFrame:
    """V1. (key, term, weight), a row per different word."""
    words = df.select(key, F.explode(sparse_terms(F.col(text))).alias("term"))
    return words.groupBy(key, "term").agg((1 + F.log(F.count("*"))).alias("weight"))


def dense(terms: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """V1. Signed feature hashing of the word weights into ``dim`` places, unit length; stands in for a model's vectors."""
    h = F.xxhash64("term")
    places = terms.select(key, F.pmod(h, F.lit(dim)).cast("int").alias("p"), (F.col("weight") * F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("w"))
    summed = places.groupBy(key, "p").agg(F.sum("w").alias("w"))
    vec = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("p", "w"))).alias("m"))  # at most ``dim`` entries
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return vec.select(key, raw.alias("vec"))


def hybrid(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", per_leg: int = 20, top: int = 20, p: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """V4. (query, item, rank, score): ``queries`` (query, text) against ``chunks`` (item, text); terms are weighed within a row, so no posting is shuffled."""
    if mode not in ("dense", "sparse", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    words = sparse_terms(F.col("text"))
    legs = []
    if mode != "sparse":
        hashes = F.transform(words, lambda w: F.xxhash64(w)).alias("terms")
        near = best(queries.select("query", hashes), chunks.select("item", hashes), per_leg, dim=DIM)
        legs.append((near.select("query", "item", "rank"), 1.0))
    if mode != "dense":
        hits = best(queries.select("query", words.alias("terms")), chunks.select("item", words.alias("terms")), per_leg)
        legs.append((hits.select("query", "item", "rank"), sparse_weight))
    return R.fuse(legs, p=p, top=top)


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], texts: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """V6, L2. Hits again in the order of a scorer over (query text, chunk text); equal scores keep their order."""
    # queries first: a hit's text, often a long one, moves once
    rows = hits.join(queries.select("query", F.col("text").alias("_q")), "query").join(texts.select("item", F.col("text").alias("_t")), "item")
    scored = rows.select("query", "item", "rank", scorer(F.col("_q"), F.col("_t")).alias("_s"))
    w = Window.partitionBy("query").orderBy(F.desc("_s"), "rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query", "item", "rank", F.col("_s").alias("score"))


def threads_of(hits: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """J4, A2, W10, F26. (query, thread_rank, thread_id, n_emails, text): whole conversations of the best hits, oldest message first, undated last.

    ``chunks`` has item, thread_id, message_id, ordinal, sent_at, sender, text.
    """
    found = hits.join(chunks.select("item", "thread_id"), "item")
    seen = materialise(R.first_seen(found, "thread_id").where(F.col("distinct_rank") <= top).select("query", "distinct_rank", "thread_id"), "seen")
    # only texts of conversations that were hit move; each is put together once and goes out with every query, so parts that come in small are not merged
    wide = R.perhaps_among(chunks, seen, "thread_id").select("thread_id", "message_id", "ordinal", "sent_at", "sender", "text").repartition(default_parallelism(hits.sparkSession), "thread_id")
    mails = wide.groupBy("thread_id", "message_id").agg(
        F.min("sent_at").alias("sent_at"), F.min_by("sender", "ordinal").alias("sender"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("body")
    )
    line = F.concat(F.lit("["), F.coalesce(F.date_format("sent_at", "yyyy-MM-dd HH:mm"), F.lit("?")), F.lit("] "), F.coalesce("sender", F.lit("?")), F.lit("\n"), F.col("body"))
    order = F.array_sort(F.collect_list(F.struct(F.col("sent_at").isNull().alias("u"), "sent_at", "message_id", line.alias("line"))))
    texts = mails.groupBy("thread_id").agg(F.count("*").alias("n_emails"), F.array_join(F.transform(order, lambda x: x["line"]), "\n\n").alias("text"))
    return texts.join(seen, "thread_id").select("query", F.col("distinct_rank").alias("thread_rank"), "thread_id", "n_emails", "text")
