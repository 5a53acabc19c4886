"""Chunks under a token budget, their ids and the index table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.identity import uuid5
from threadloom.functions.text import estimate_tokens
from threadloom.operators.mail import first_copies, upsert

#: Fixed value: name space of chunk ids.
NAMESPACE = "6f1d2a3e9c474b8a9f1e2d5c7a840b13"


def pack_units(units: Column, budget: int, size=estimate_tokens, joint: str = "\n") -> Column:
    """W14. Units (lines, rows, sentences) joined in order while their sizes fit; one over the budget stands alone.  A fold over the row's own array."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).cast("int").alias("used"))

    def step(acc: Column, unit: Column) -> Column:
        n = size(unit).cast("int")
        fits = (acc["used"] + n <= budget) & (acc["open"] != "")
        empty = acc["open"] == ""
        return F.struct(
            F.when(fits | empty, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits, F.concat(acc["open"], F.lit(joint), unit)).otherwise(unit).alias("open"),
            F.when(fits, acc["used"] + n).otherwise(n).alias("used"),
        )

    return F.aggregate(units, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def chunks(docs: DataFrame, key: str, text: str, budget: int = 512) -> DataFrame:
    """V7, W6. (doc_key, ordinal, point_id, text, content_hash); ids are given before any deduplication."""
    units = F.filter(F.split(F.col(text), "\n"), lambda l: F.trim(l) != "")
    rows = docs.select(F.col(key).cast("string").alias("doc_key"), F.posexplode(pack_units(units, budget)).alias("ordinal", "text"))
    return rows.select("doc_key", "ordinal", uuid5(NAMESPACE, F.concat_ws(":", "doc_key", "ordinal")).alias("point_id"), "text", F.sha2(F.trim("text"), 256).alias("content_hash"))


def row_chunks(docs: DataFrame, key: str, text: str, budget: int = 512) -> DataFrame:
    """V8. Tables: the first line is repeated at the head of every chunk."""
    lines = F.split(F.col(text), "\r?\n")
    body = F.filter(F.slice(lines, 2, 1 << 30), lambda l: F.trim(l) != "")
    room = pack_units(body, budget)
    return docs.select(F.col(key).cast("string").alias("doc_key"), F.element_at(lines, 1).alias("head"), F.posexplode(room).alias("ordinal", "rows")).select("doc_key", "ordinal", F.concat_ws("\n", "head", "rows").alias("text"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """W5. The first chunk of every content."""
    return first_copies(rows, F.trim("text"), [F.col("doc_key"), F.col("ordinal")])


def replace_documents(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """K4, K5. Chunks of the documents in ``fresh`` replace theirs in ``index``."""
    return upsert(index, fresh, ["doc_key"])


def check_policy(stored: str | None, wanted: str) -> None:
    """K6. Appending under another policy is refused."""
    if stored is not None and stored != wanted:
        raise ValueError(f"the table was built under policy {stored}, not {wanted}")
