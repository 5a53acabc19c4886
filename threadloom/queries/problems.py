"""Queries of the general problems 1 and 4 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.deliveries import repeated_deliveries
from threadloom.operators.timestamps import InstantDictionary, account_zones, normalise_instants
from threadloom.runtime import new_path, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables in one pass: one dictionary update, one join back."""
    accounts = table(spark, sf, "accounts").select("account_id", "tz_name", "locale")
    rows = (
        table(spark, sf, "thread_emails")
        .select(F.lit("thread_emails").alias("src_table"), F.col("email_id").alias("row_id"), "account_id", F.col("date_text").alias("raw"))
        .unionByName(
            table(spark, sf, "messages").select(
                F.lit("messages").alias("src_table"), F.col("delivery_id").alias("row_id"), "account_id", F.col("internal_date").alias("raw")
            )
        )
    )
    dictionary = InstantDictionary(spark, new_path(spark, "instants"), account_zones(accounts))
    read = normalise_instants(rows.join(accounts, "account_id", "left"), "raw", "tz_name", "locale", dictionary, keep_unread=False)
    return read.select("src_table", "row_id", "utc_micros")


def p1_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary kept over two deliveries of data: what each table adds to it, and how many of its rows it serves."""
    accounts = table(spark, sf, "accounts").select("account_id", "tz_name", "locale")
    dictionary = InstantDictionary(spark, new_path(spark, "instants"), account_zones(accounts))
    out = None
    for name, col in (("thread_emails", "date_text"), ("messages", "internal_date")):
        rows = table(spark, sf, name).select("account_id", F.col(col).alias("raw")).join(accounts, "account_id", "left")
        read = normalise_instants(rows, "raw", "tz_name", "locale", dictionary)
        part = read.agg(F.lit(name).alias("src_table"), F.count("*").alias("n_rows"), F.count("utc_micros").alias("n_instants"))
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    ledger = table(spark, sf, "messages").select("delivery_id", "batch_id", "account_id", "content_sha256", "message_id", "fetched_at")
    return repeated_deliveries(ledger)


def queries() -> dict:
    return {"p1_found": p1_found, "p1_incremental": p1_incremental, "p4_found": p4_found}


#: Sameness closed transitively over the identifiers: nodes are Message-IDs and those digests under which some delivery has no id.
_P4 = r"""
WITH RECURSIVE ids AS (
  SELECT delivery_id, account_id, fetched_at, content_sha256 AS sha,
         trim(regexp_replace(trim(coalesce(message_id, ''), chr(9) || chr(10) || chr(13) || ' '), '^<(.*)>$', '\1'), chr(9) || chr(10) || chr(13) || ' ') AS mid
  FROM messages),
active AS (SELECT DISTINCT account_id, sha FROM ids WHERE mid = '' AND coalesce(sha, '') <> ''),
node AS (
  SELECT i.delivery_id, i.fetched_at, i.account_id, CASE WHEN mid <> '' THEN 'm' || mid ELSE 's' || i.sha END AS own,
         CASE WHEN mid <> '' AND a.sha IS NOT NULL THEN 's' || i.sha END AS other
  FROM ids i LEFT JOIN active a ON a.account_id = i.account_id AND a.sha = i.sha
  WHERE mid <> '' OR coalesce(i.sha, '') <> ''),
edge AS (SELECT DISTINCT account_id, own AS a, other AS b FROM node WHERE other IS NOT NULL
         UNION SELECT DISTINCT account_id, other, own FROM node WHERE other IS NOT NULL),
reach AS (SELECT account_id, a, a AS b FROM edge UNION SELECT r.account_id, r.a, e.b FROM reach r JOIN edge e ON e.account_id = r.account_id AND e.a = r.b),
root AS (SELECT account_id, a, min(b) AS root FROM reach GROUP BY ALL),
ranked AS (
  SELECT n.delivery_id, row_number() OVER (PARTITION BY n.account_id, coalesce(r.root, n.own) ORDER BY n.fetched_at NULLS LAST, n.delivery_id) AS k
  FROM node n LEFT JOIN root r ON r.account_id = n.account_id AND r.a = n.own)
SELECT delivery_id FROM ranked WHERE k > 1"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _P4}
