"""Selection, coverage and reporting operators (P17, P18, P24, P25, P27, J17, J19, A13, A17, A24, L7, K7, S6, S20) and small text rules."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.identity import strip
from threadloom.runtime import materialise

#: Sparse-text rule, characters per MB, and the size from which it holds.
SPARSE_CHARS_PER_MB, SPARSE_FROM = 10_000, 50_000
#: Room for a summary beside a chunk, and the encoder's ceiling.
SUMMARY_ROOM, ENCODE_MAX = 256, 8192


def suspects(clusters: DataFrame, least: float) -> DataFrame:
    """P17. Paths of clusters (score, members array<struct<paths>>) scored at least ``least``, each once with its best score."""
    paths = clusters.where(F.col("score") >= least).select("score", F.explode("members").alias("m")).select("score", F.explode("m.paths").alias("path"))
    return paths.groupBy("path").agg(F.max("score").alias("score"))


def candidate_domains(counts: DataFrame, least: int, covered: DataFrame, allowed: DataFrame) -> DataFrame:
    """P18. Frequent domains that no rule covers and nobody allowed, most frequent first."""
    return counts.where(F.col("n") >= least).join(covered, "domain", "left_anti").join(allowed, "domain", "left_anti").orderBy(F.desc("n"), "domain")


def warnings(hours_since_success: Column, last_status: Column, limit: float = 24) -> Column:
    """P24. Array of what is wrong with an account; empty when healthy."""
    found = F.array(
        F.when(hours_since_success.isNull(), "never succeeded"),
        F.when(hours_since_success > limit, F.format_string("no success for %d hours", hours_since_success.cast("int"))),
        F.when(last_status == "error", "the last run failed"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def completeness(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """P25. Rows, rows without text, and rows without each field."""
    empty = lambda c: F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    return df.agg(F.count("*").alias("n_rows"), empty(text).alias("n_empty"), *[empty(f).alias(f"without_{f}") for f in fields])


def sparse_text(chars: Column, size: Column, mime: Column) -> Column:
    """P27. Whether a large file that is no text gave hardly any."""
    return (size >= SPARSE_FROM) & ~F.startswith(F.lower(F.coalesce(mime, F.lit(""))), F.lit("text/")) & (chars / (size / 1e6) < SPARSE_CHARS_PER_MB)


def slice_with_gold(threads: DataFrame, gold: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """J17. Gold threads, all of them, and others in seeded order while the number of e-mails stays within ``cap``.

    ``threads`` has thread_id and n_emails.  The others are cut by 4,096 hash buckets first; only the bucket where the cap falls is ordered by row.
    """
    kept = threads.join(gold.select("thread_id").distinct(), "thread_id", "left_semi")
    rest = threads.join(gold.select("thread_id").distinct(), "thread_id", "left_anti").withColumn("_h", F.pmod(F.xxhash64("thread_id", F.lit(seed)), F.lit(1 << 40)))
    room = cap - (kept.agg(F.sum("n_emails")).first()[0] or 0)
    sums = rest.groupBy(F.floor(F.col("_h") / (1 << 28)).alias("_b")).agg(F.sum("n_emails").alias("s"))
    edge = sums.withColumn("_to", F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))  # 4,096 rows
    last = edge.where(F.col("_to") > room).agg(F.min(F.struct("_b", (F.col("_to") - F.col("s")).alias("before")))).first()[0]
    if last is None:
        return kept.unionByName(rest.drop("_h"))
    b = F.floor(F.col("_h") / (1 << 28))
    run = F.sum("n_emails").over(Window.partitionBy(b).orderBy("_h", "thread_id").rowsBetween(Window.unboundedPreceding, 0)) + last["before"]
    at_edge = rest.where(b == last["_b"]).withColumn("_run", run).where(F.col("_run") <= room).drop("_run", "_h")
    return kept.unionByName(rest.where(b < last["_b"]).drop("_h")).unionByName(at_edge)


def coverage(files: DataFrame, claims: DataFrame) -> DataFrame:
    """A17, J19. Files and unclaimed files per label of at most two folder levels; ``files`` has path, ``claims`` has path and profile."""
    parts = F.split("path", "/")
    label = F.when(F.size(parts) <= 1, "(root)").otherwise(F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/"))
    marked = files.select("path").distinct().join(claims.select("path").distinct().withColumn("_c", F.lit(True)), "path", "left")
    return marked.groupBy(label.alias("label")).agg(F.count("*").alias("total"), F.count_if(F.col("_c").isNull()).alias("unclaimed"))


def lower_percentile(df: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """A13. Element floor(q*(n-1)) of the sorted values, from a histogram."""
    w = Window.partitionBy(*group)
    run = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c")).withColumns({"_to": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("c").over(w)})
    return run.groupBy(*group).agg(*[F.min(F.when(F.col("_to") > F.floor((F.col("_n") - 1) * q), F.col(value))).alias(f"q{round(q * 100)}") for q in qs])


def obvious_noise(clusters: DataFrame, least: float = 0.6) -> DataFrame:
    """A24. Share of members in clusters scored at least ``least``."""
    return clusters.agg(F.coalesce(F.sum(F.when(F.col("score") >= least, F.col("size")).otherwise(0)) / F.sum("size"), F.lit(0.0)).alias("obvious_noise"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """L7. n rows in the order of a seeded hash; the same rows for the same seed, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def append_new(path: str, new: DataFrame, key: str) -> int:
    """K7. Append what a set table lacks; gives the number of new members."""
    spark = new.sparkSession
    fresh = new.select(key).distinct()
    try:
        fresh = fresh.join(spark.read.parquet(path), key, "left_anti")
    except AnalysisException:  # no table yet
        pass
    fresh = materialise(fresh, "fresh")
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def header_record(text: Column) -> Column:
    """S6. Struct (sender, subject, date_raw, message_id, body) of a raw message text: header lines up to the first blank line."""
    head = F.split_part(F.regexp_replace(text, "\r\n", "\n"), F.lit("\n\n"), F.lit(1))
    field = lambda n: F.trim(F.regexp_extract(head, rf"(?im)^{n}:[ \t]*(.*)$", 1))
    body = F.substring(F.regexp_replace(text, "\r\n", "\n"), F.length(head) + 3, F.length(text))
    return F.struct(field("From").alias("sender"), field("Subject").alias("subject"), field("Date").alias("date_raw"), field("Message-ID").alias("message_id"), body.alias("body"))


def table_rows(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """S20. Cells of a delimited file without a header, all strings."""
    return spark.read.option("header", False).option("sep", separator).option("inferSchema", False).csv(path)


def embed_text(summary: Column, text: Column) -> Column:
    """F22, F23. The stripped summary above the text, if there is one."""
    s = strip(F.coalesce(summary, F.lit("")))
    return F.when(s != "", F.concat(s, F.lit("\n\n"), text)).otherwise(text)


def encode_limit(chunk: Column, with_summary: bool = True, override: int | None = None) -> Column:
    """F22. Tokens the encoder may take: room for a summary only where one is embedded; a stated limit wins; never above the ceiling."""
    wanted = F.lit(override) if override is not None else chunk + SUMMARY_ROOM if with_summary else chunk
    return F.least(wanted, F.lit(ENCODE_MAX))


def combine_query(mode: str, query: Column, draft: Column) -> Column:
    """F24. The stripped draft ("pure"), the query above it ("augment"); without a draft or in any other mode the query as it is."""
    d = strip(F.coalesce(draft, F.lit("")))
    if mode not in ("pure", "augment"):
        return query
    return F.when(d == "", query).otherwise(d if mode == "pure" else F.concat(query, F.lit("\n"), d))


def sanitized_query(c: Column) -> Column:
    """F50. ASCII letters and digits, with single spaces where anything else stood."""
    return F.trim(F.regexp_replace(c, "[^0-9A-Za-z]+", " "))
