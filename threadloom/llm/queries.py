"""Queries of the llm problems over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.conversations import conversation_threads, conversation_turns
from threadloom.llm.email_lines import label_lines, new_text
from threadloom.llm.encodings import repair_fields
from threadloom.llm.mixing import budget_tree, mixture, shares
from threadloom.llm.packing import pack
from threadloom.llm.personal import find_personal, redact_personal
from threadloom.llm.splitting import profiles_in_force, split_oversized
from threadloom.llm.tokens import token_counts
from threadloom.llm.truncation import cut_documents
from threadloom.operators.timestamps import InstantDictionary, account_zones, normalise_instants
from threadloom.runtime import materialise, new_path, table


def _dated_emails(spark: SparkSession, sf: str) -> DataFrame:
    """Thread e-mails that have a thread id, with the instant of date_text."""
    accounts = table(spark, sf, "accounts").select("account_id", "tz_name", "locale")
    emails = table(spark, sf, "thread_emails").select("email_id", "account_id", "thread_id", "message_id", "in_reply_to", "sender", "date_text", "body")
    emails = emails.withColumn("body", F.when(F.col("body").rlike(r"(?U)[^\s\x1c-\x1f]"), "x"))  # only blank or not matters below
    dictionary = InstantDictionary(spark, new_path(spark, "instants"), account_zones(accounts))
    return normalise_instants(emails.where("thread_id <> ''").join(accounts, "account_id", "left"), "date_text", "tz_name", "locale", dictionary)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_turns(_dated_emails(spark, sf), table(spark, sf, "account_addresses"))


def p2_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Every thread with its number of messages, turns, gaps and merged paths, and whether it is sound."""
    return conversation_threads(_dated_emails(spark, sf), table(spark, sf, "account_addresses"))


def _pieces(spark: SparkSession, sf: str, with_text: bool) -> DataFrame:
    emails = table(spark, sf, "thread_emails").select("email_id", "account_id", "body")
    limits = profiles_in_force(table(spark, sf, "corpus_profiles"))
    return split_oversized(emails.join(limits, "account_id", "left"), "email_id", "body", "chunk_size", "chunk_overlap", with_text)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """An e-mail that exceeds its limit is one that came out in more than one piece."""
    return _pieces(spark, sf, False).where("piece_no = 2").select("email_id")


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, True)


_REPLY = ("account_id", "message_id", "in_reply_to")


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "thread_emails").select("email_id", "body", *_REPLY)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return label_lines(_bodies(spark, sf), reply=_REPLY).select("email_id", "line_no")


def p3_new_text(spark: SparkSession, sf: str) -> DataFrame:
    return new_text(_bodies(spark, sf), reply=_REPLY)


def _mails(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "thread_emails").select("email_id", "body", "to_text", "cc_text", "sender")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_personal(_mails(spark, sf))


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact_personal(_mails(spark, sf))


def _repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repair_fields(table(spark, sf, "thread_emails").select("email_id", "subject", "body", "sender"), "email_id", ["subject", "body", "sender"])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _repaired(spark, sf).select("email_id", "field_name")


def p7_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _repaired(spark, sf)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source", "content_kind")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their number of tokens."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang", "content_kind")
    return materialise(docs.drop("text").join(token_counts(docs, "doc_id", "text"), "doc_id"), "sized")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in containers of every capacity of pack_limits (a table of three rows)."""
    sized = _sized(spark, sf)
    wanted = table(spark, sf, "pack_limits").orderBy("limit_id").collect()
    # each capacity plans on the driver between its jobs: side by side they fill the cluster
    with ThreadPoolExecutor(len(wanted) or 1) as pool:
        parts = list(pool.map(lambda r: pack(sized, "doc_id", "n_tokens", r["capacity_tokens"]).withColumn("limit_id", F.lit(r["limit_id"])), wanted))
    return reduce(DataFrame.unionByName, parts).select("limit_id", "container_id", "doc_id", "part_no", "token_start", "n_tokens")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of each capacity, and how full they are."""
    limits = table(spark, sf, "pack_limits").select("limit_id", "capacity_tokens")
    per = p8_containers(spark, sf).groupBy("limit_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    room = F.col("n_containers") * F.col("capacity_tokens")
    return per.join(limits, "limit_id").select("limit_id", "capacity_tokens", "n_containers", "n_tokens", F.round(F.col("n_tokens") / room, 6).alias("fill"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return shares(mixture(_sized(spark, sf), targets), targets)


def p9_full_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of every plan's tree where all tokens of its sources are asked for once: what each falls short of, and its budget once that is redistributed."""
    return budget_tree(_sized(spark, sf), table(spark, sf, "mix_targets"), total="all")


def p9_full_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached by mixtures as large as all tokens of their sources: scarce sources fall short."""
    targets = table(spark, sf, "mix_targets")
    return shares(mixture(_sized(spark, sf), targets, total="all"), targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return cut_documents(_documents(spark, sf)).where("is_cut").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts."""
    docs = _documents(spark, sf)
    scored = docs.select("doc_id", "source").join(cut_documents(docs).select("doc_id", "is_cut"), "doc_id", "left")
    cut = F.coalesce(F.col("is_cut"), F.lit(False))
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(cut).alias("n_cut"), F.round(F.avg(cut.cast("int")), 6).alias("cut_share"))


def queries() -> dict:
    return {
        "p2_found": p2_found, "p2_threads": p2_threads, "p3_found": p3_found, "p3_new_text": p3_new_text,
        "p5_found": p5_found, "p5_pieces": p5_pieces, "p7_found": p7_found, "p7_restored": p7_restored,
        "p6_found": p6_found, "p6_redacted": p6_redacted,
        "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
        "p9_full_budgets": p9_full_budgets, "p9_full_shares": p9_full_shares,
        "p10_found": p10_found, "p10_rates": p10_rates,
    }


_P5 = """
WITH p AS (
  SELECT account_id, chunk_size, row_number() OVER (PARTITION BY account_id ORDER BY updated_at DESC NULLS LAST, profile_id DESC) AS k
  FROM corpus_profiles)
SELECT e.email_id FROM thread_emails e LEFT JOIN p ON p.account_id = e.account_id AND p.k = 1
WHERE length(e.body) > CASE WHEN coalesce(p.chunk_size, 0) < 1 THEN 512 ELSE p.chunk_size END"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _P5}
