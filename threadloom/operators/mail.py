"""Relational operators over mail tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- selection


def selection(path: Column, rules: list[dict]) -> Column:
    """P1, P2. Whether a path is claimed by one of the rules."""

    def one(rule: dict) -> Column:
        root = rule.get("value", "")
        root = root if not root or root.endswith("/") else root + "/"
        kind = rule["type"]
        if kind == "prefix":
            return path.startswith(root)
        if kind == "direct-root-files":
            return path.startswith(root) & ~F.contains(F.substring(path, len(root) + 1, 1 << 20), F.lit("/"))
        if kind == "container-root":
            return ~F.contains(path, F.lit("/"))
        raise ValueError(f"unknown rule type {kind!r}")

    return reduce(or_, [one(r) for r in rules], F.lit(False))


def first_category(rules: list[tuple[str, str, str]], sender: Column, subject: Column) -> Column:
    """P4. Category of the first matching rule (category, kind, pattern), in order; null without one."""
    out = None
    low = F.lower(F.coalesce(sender, F.lit("")))
    for category, kind, pattern in rules:
        if kind == "domain":
            hit = F.contains(low, F.lit("@" + pattern)) | F.contains(low, F.lit("." + pattern))
        else:
            hit = F.coalesce((sender if kind == "sender_re" else subject).rlike("(?i)" + pattern), F.lit(False))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.lit(None).cast("string") if out is None else out


def folder_counts(df: DataFrame, path: str) -> DataFrame:
    """A16. Files at and below every folder of '/'-separated paths."""
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, i), "/")).otherwise(""))
    rows = df.select(F.explode(F.array_distinct(folders)).alias("folder"), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise("").alias("_own"))
    return rows.groupBy("folder").agg(F.count("*").alias("total"), F.count_if(F.col("folder") == F.col("_own")).alias("direct"))


# ---------------------------------------------------------------- judgments and joins


def keep_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """K8, K11. The last row of each key, as one aggregation over structs (map-side combined)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K3-K5. Rows of ``old`` whose key is not replaced, and all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def prioritised(df: DataFrame, lookups: list[tuple[DataFrame, str, str]], value: str) -> DataFrame:
    """J2. Value of the first lookup (table, own key, its key) that knows the row; every lookup is unique by its key."""
    for i, (table, mine, theirs) in enumerate(lookups):
        one = table.where(F.col(theirs).isNotNull() & (F.col(theirs) != "")).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.max(value).alias(f"_v{i}"))
        df = df.join(one, df[mine] == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    names = [f"_v{i}" for i in range(len(lookups))]
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def either_key(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """J14. Rows that meet on one key or another, each pair of ``columns`` once: a union of equi-joins, not an OR join."""
    parts = [left.join(right, left[a] == right[b]).select(*columns) for a, b in keys]
    return reduce(DataFrame.unionByName, parts).distinct()


# ---------------------------------------------------------------- threads


def thread_meta(df: DataFrame, thread: str, sender: str, order: str, tag: str) -> DataFrame:
    """A1. Size, dominant sender (the first seen of equals), its share, senders and tagged share of every thread."""
    by_sender = df.groupBy(thread, sender).agg(F.count("*").alias("c"), F.min(order).alias("first"), F.count_if(F.col(tag)).alias("t"))
    return by_sender.groupBy(thread).agg(
        F.sum("c").alias("n_emails"), F.max_by(sender, F.struct("c", -F.col("first"))).alias("dominant_sender"), F.round(F.max("c") / F.sum("c"), 4).alias("top_sender_share"),
        F.count("*").alias("n_senders"), F.round(F.sum("t") / F.sum("c"), 4).alias("tag_fraction"),
    )


def preceding(df: DataFrame, thread: str, order: list[str], value: str, n: int = 6) -> Column:
    """W7. Values of up to n earlier messages of the thread."""
    return F.collect_list(value).over(Window.partitionBy(thread).orderBy(*order).rowsBetween(-n, -1))


def render_thread(df: DataFrame, thread: str, order: list[Column], line: Column) -> DataFrame:
    """A2, F26. One text per thread, lines in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return df.groupBy(thread).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def first_copies(df: DataFrame, content: Column, order: list[Column]) -> DataFrame:
    """W5. The first row of every different content, by hash; min_by keeps the shuffle to one row per task and content."""
    cols = df.columns
    return df.groupBy(F.sha2(content, 256).alias("_h")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_v")).select("_v.*")


# ---------------------------------------------------------------- attachments

#: Fixed values of the decoration rule.
TEXT_RICH, TEXT_POOR, DECOR_THREADS, UBIQUITOUS = 100, 30, 5, 20


def decoration(status: Column, calibrated: Column, chars: Column, threads: Column, inline: Column) -> Column:
    """P14. True, false, or null where the signals cannot tell."""
    return (
        F.when(~F.coalesce(status.isin("extracted", "empty") & calibrated, F.lit(False)), F.lit(None).cast("boolean"))
        .when(inline & (threads >= UBIQUITOUS), True)
        .when((chars >= TEXT_RICH) | ~inline, False)
        .when((chars < TEXT_POOR) & (threads >= DECOR_THREADS), True)
    )


# ---------------------------------------------------------------- ledger

#: T6, event -> {state: next state}; other pairs leave a state as it is.
TRANSITIONS = {
    "judged": {"new": "judged", "indexed_unjudged": "judged", "done": "judged"},
    "indexed": {"new": "indexed_unjudged", "judged": "done"},
    "abandoned": {"new": "abandoned", "indexed_unjudged": "abandoned", "judged": "abandoned"},
    "requeued": {"abandoned": "new"},
}


def next_state(state: Column, event: Column) -> Column:
    """T6."""
    table = F.create_map(*[F.lit(x) for e, m in TRANSITIONS.items() for s, t in m.items() for x in (f"{s}|{e}", t)])
    return F.coalesce(F.element_at(table, F.concat_ws("|", state, event)), state)


def fold_events(df: DataFrame, key: list[str], order: str, event: str, start: str = "new") -> DataFrame:
    """T7. State of every key after its events in order.  The machine has five states, so each event is a function on five values and
    functions compose: pre-aggregation needs no order across partitions, only the final fold of a key's events does."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(event).alias("e")))), lambda x: x["e"])
    return df.groupBy(*key).agg(F.aggregate(seq, F.lit(start), lambda s, e: next_state(s, e)).alias("state"), F.count("*").alias("n_events"))


def pending(state: Column, stage: str, judge_configured: bool = True) -> Column:
    """P22."""
    if stage == "judged":
        return state.isin("new", "indexed_unjudged")
    if stage == "indexed":
        return state.isin(*(["judged"] if judge_configured else ["new", "judged"]))
    raise ValueError(f"unknown stage {stage!r}")


# ---------------------------------------------------------------- percentiles


def nearest_rank(values: Column, p: int) -> Column:
    """A12. Element floor(n*p/100), at most the last, of the sorted values."""
    s, n = F.array_sort(values), F.size(values)
    return F.element_at(s, F.least(n, F.floor(n * p / 100).cast("int") + 1))


def percentile_from_counts(df: DataFrame, group: list[str], value: str, ps: list[int]) -> DataFrame:
    """A12 at any scale: a histogram of values instead of a collected list; integer-valued columns have few different ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group)
    run = counts.withColumns({"_to": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("c").over(w)})
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * p / 100))
    return run.groupBy(*group).agg(*[F.min(F.when(F.col("_to") > at(p), F.col(value))).alias(f"p{p}") for p in ps])
