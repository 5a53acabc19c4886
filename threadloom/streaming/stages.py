"""Stages of the message ledger as batch steps for ``foreachBatch`` or a scheduler: T7-T10, K15, K16.

The ledger has a row per (account_id, message_key) with state, judged_at, indexed_at, error and attempts.  A stage takes the rows that
wait for it and the outcomes of its work, and gives events; only ``apply_events`` changes a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.mail import next_state, pending
from threadloom.runtime import materialise

#: Fixed value: failures of a message's judgment after which it is given up.
MAX_ATTEMPTS = 3
#: Fixed value: longest reason kept.
REASON_CHARS = 2000
KEY = ["account_id", "message_key"]
EVENTS = "account_id int, message_key string, order_no bigint, event string, reason string"
STATES = ("new", "judged", "indexed_unjudged", "done", "abandoned")


def effects(row: Column, event: Column, reason: Column, now: Column) -> Column:
    """T7. A ledger row (struct of state, judged_at, indexed_at, error, attempts) after one event.

    A stage that succeeded stamps its time and clears the error; giving up keeps the reason; putting back in play clears everything; a failure
    ('failed') counts an attempt and keeps its reason, a deferral ('deferred') only the reason.  An abandonment or a requeue that the state
    does not allow changes nothing.
    """
    state, none = row["state"], F.lit(None)
    new = next_state(state, event)
    refused = (new == state) & event.isin("abandoned", "requeued")
    why = F.substring(F.coalesce(F.nullif(reason, F.lit("")), event), 1, REASON_CHARS)
    stamped = lambda column, name: F.when(event == name, now).when(event == "requeued", none).otherwise(row[column])
    return F.when(refused, row).otherwise(
        F.struct(
            new.alias("state"), stamped("judged_at", "judged").alias("judged_at"), stamped("indexed_at", "indexed").alias("indexed_at"),
            F.when(event.isin("judged", "indexed", "requeued"), none).when(event.isin("abandoned", "failed", "deferred"), why).otherwise(row["error"]).alias("error"),
            F.when(event == "requeued", 0).when(event == "failed", row["attempts"] + 1).otherwise(row["attempts"]).cast("int").alias("attempts"),
        )
    )


def apply_events(ledger: DataFrame, events: DataFrame, now: Column | None = None) -> DataFrame:
    """T7. The ledger after ``events`` (account_id, message_key, order_no, event, reason); events of unknown keys are ignored.  A batch has few events a key."""
    now = F.current_timestamp() if now is None else now
    seq = F.array_sort(F.collect_list(F.struct("order_no", "event", F.coalesce("reason", F.lit("")).alias("reason")))).alias("_e")
    facts = F.struct("state", F.col("judged_at").cast("timestamp").alias("judged_at"), F.col("indexed_at").cast("timestamp").alias("indexed_at"), F.col("error").cast("string").alias("error"), F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"))
    rest = [c for c in ledger.columns if c not in ("state", "judged_at", "indexed_at", "error", "attempts")]
    rows = ledger.join(events.groupBy(*KEY).agg(seq), KEY, "left")
    done = F.aggregate(F.coalesce("_e", F.array().cast("array<struct<order_no:bigint,event:string,reason:string>>")), facts, lambda r, e: effects(r, e["event"], e["reason"], now))
    return rows.select(*rest, done.alias("_r")).select(*rest, "_r.*")


def fold_in_blocks(events: DataFrame, key: list[str], order: str, event: str, start: str = "new", block: int = 10_000) -> DataFrame:
    """T7. State of every key after its events, for keys with any number of them: a block of ``block`` order numbers becomes one function on the five states, and functions are
    composed in order, so no task collects more than a block of events or one row a block."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(event).alias("e")))), lambda x: x["e"])
    own = F.aggregate(seq, F.array(*map(F.lit, STATES)), lambda m, e: F.transform(m, lambda s: next_state(s, e)))
    parts = events.groupBy(*key, F.floor(F.col(order) / block).alias("_b")).agg(own.alias("_m"), F.count("*").alias("_n"))
    maps = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_m"))), lambda x: x["_m"])
    names = F.array(*map(F.lit, STATES))
    return parts.groupBy(*key).agg(F.aggregate(maps, F.lit(start), lambda s, m: F.element_at(m, F.array_position(names, s).cast("int"))).alias("state"), F.sum("_n").alias("n_events"))


def _events(df: DataFrame, event: Column | str, reason: Column | str = "", order: int = 0) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(*KEY, F.lit(order).cast("bigint").alias("order_no"), lit(event).alias("event"), lit(reason).alias("reason"))


def work(ledger: DataFrame, stage: str, since: Column | None = None, judge_configured: bool = True) -> DataFrame:
    """P22, T11. Rows that wait for a stage; undated ones always do."""
    rows = ledger.where(pending(F.col("state"), stage, judge_configured))
    return rows if since is None else rows.where(F.col("internal_date").isNull() | (F.col("internal_date") >= since))


def judge_stage(waiting: DataFrame, outcomes: DataFrame, endpoint_up: Callable[[], bool]) -> DataFrame:
    """T8. Events of a judging sweep.  ``waiting``: work with ``eml_exists`` and ``attempts``; ``outcomes``: key and outcome (done, cached, unavailable, error).

    Files that are gone are abandoned.  Where every one of several messages failed and the endpoint does not answer, it was an outage: nobody is charged.  Else a failure
    counts, and the third gives the message up.  Messages the endpoint was unavailable for, or without an outcome, wait on.
    """
    gone = _events(waiting.where(~F.col("eml_exists")), "abandoned", "spooled file is missing")
    rows = materialise(waiting.where("eml_exists").select(*KEY, "attempts").join(outcomes, KEY, "left"), "judged")
    n, ok, bad = rows.agg(F.count("*"), F.count_if(F.col("outcome").isin("done", "cached")), F.count_if(F.col("outcome") == "error")).first()
    failed = rows.where("outcome = 'error'")
    outage = n > 1 and bad == n and not endpoint_up()
    out = gone.unionByName(_events(rows.where(F.col("outcome").isin("done", "cached")), "judged")).unionByName(_events(failed, "deferred" if outage else "failed", "judging failed"))
    if not outage:
        spent = failed.where(F.coalesce("attempts", F.lit(0)) + 1 >= MAX_ATTEMPTS)
        out = out.unionByName(_events(spent, "abandoned", f"judging failed {MAX_ATTEMPTS} times", 1))
    return out


def index_stage(waiting: DataFrame, attached: DataFrame, indexed: DataFrame) -> DataFrame:
    """T9. Events of an indexing sweep.  ``attached``: key and failure of the attachment step ('' none, 'permanent', 'transient'), which comes first; ``indexed``: keys that reached the index.

    A permanent failure gives a message up, a transient one leaves it waiting; a message that passed both steps and is not in the index is unaccounted for and given up.
    """
    rows = waiting.select(*KEY).join(attached.select(*KEY, "failure"), KEY, "left").join(indexed.select(*KEY, F.lit(True).alias("_in")), KEY, "left")
    failure, there = F.coalesce("failure", F.lit("")), F.coalesce("_in", F.lit(False))
    event = F.when(failure == "permanent", "abandoned").when(failure == "transient", "deferred").when(there, "indexed").otherwise("abandoned")
    reason = F.when(failure == "permanent", "attachments cannot be stored").when(failure == "transient", "attachments failed").when(there, "").otherwise("did not reach the index")
    return _events(rows, event, reason)


def dropped(loaded: DataFrame, reached: DataFrame, key: list[str]) -> DataFrame:
    """U4. What was loaded and did not arrive."""
    return loaded.select(*key).distinct().join(reached.select(*key), key, "left_anti")


def handled(*parts: DataFrame) -> DataFrame:
    """U4. Union of sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# ---------------------------------------------------------------- K15: run log

RUNS = "run_id string, account_id int, at timestamp, status string, fetched bigint, judged bigint, indexed bigint, errors bigint, message string"


def run_row(df_or_spark, run_id: str, account_id: int, status: str, fetched: int = 0, judged: int = 0, indexed: int = 0, errors: int = 0, message: str = "") -> DataFrame:
    """A row for the log, to be appended: 'running' when a run starts, else how it ended."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    row = spark.createDataFrame([(run_id, account_id, None, status, fetched, judged, indexed, errors, message[:REASON_CHARS])], RUNS)
    return row.withColumn("at", F.current_timestamp())


def runs(log: DataFrame) -> DataFrame:
    """K15. The last row of every run; one still 'running' while a later run of its account exists was superseded and counts as failed."""
    last = log.groupBy("run_id").agg(F.max_by(F.struct("account_id", "at", "status", "fetched", "judged", "indexed", "errors", "message"), F.struct("at", F.col("status") != "running")).alias("r"), F.min("at").alias("started_at")).select("run_id", "started_at", "r.*")
    later = F.lead("started_at").over(Window.partitionBy("account_id").orderBy("started_at", "run_id")).isNotNull()
    ghost = (F.col("status") == "running") & later
    return last.withColumns({"message": F.when(ghost, "superseded by a later run").otherwise(F.col("message")), "status": F.when(ghost, "failed").otherwise(F.col("status"))})


# ---------------------------------------------------------------- K16: cursors


def commit_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """K16. Folder rows (account_id, folder, role, generation, cursor, synced_at) with the new ones in their place; an old sync time stays where the new one is null."""
    n = new.select("account_id", "folder", *[F.col(c).alias(f"_{c}") for c in ("role", "generation", "cursor", "synced_at")], F.lit(True).alias("_new"))
    take = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    rows = old.join(n, ["account_id", "folder"], "full")
    return rows.select("account_id", "folder", take("role"), take("generation"), take("cursor"), F.coalesce("_synced_at", "synced_at").alias("synced_at"))


def void_cursors(folders: DataFrame, generations: DataFrame) -> DataFrame:
    """K16. Folders whose generation is not the server's any more lose their cursor; their messages in the ledger stay."""
    g = generations.select("account_id", "folder", F.col("generation").alias("_g"))
    changed = F.col("_g").isNotNull() & ~F.col("_g").eqNullSafe(F.col("generation"))
    rows = folders.join(g, ["account_id", "folder"], "left")
    return rows.withColumns({"cursor": F.when(changed, F.lit(None).cast("string")).otherwise(F.col("cursor")), "generation": F.when(changed, F.col("_g")).otherwise(F.col("generation"))}).drop("_g")


# ---------------------------------------------------------------- T10: one run of an account


def sync_account(ledger: DataFrame, account_id: int, fetch: Callable[[], DataFrame] | None, judge: Callable[[DataFrame], DataFrame] | None, index: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, dict]:
    """T10. Fetch, judge and index, each skippable by None and each over what the stage before left; gives the ledger and the counters of the run.

    ``fetch`` gives new ledger rows, ``judge`` and ``index`` events for the rows that wait.
    """
    counts = {"fetched": 0, "judged": 0, "indexed": 0, "errors": 0}
    mine = F.col("account_id") == account_id
    if fetch is not None:
        fresh = materialise(fetch().join(ledger.select(*KEY), KEY, "left_anti"), "fetched")
        counts["fetched"] = fresh.count()
        ledger = ledger.unionByName(fresh.select(*ledger.columns))
    for name, stage in (("judged", judge), ("indexed", index)):
        if stage is None:
            continue
        events = materialise(stage(work(ledger.where(mine), name, judge_configured=judge is not None)), "events")
        n, bad = events.agg(F.count_if(F.col("event") == name), F.countDistinct(F.when(F.col("event").isin("failed", "abandoned", "deferred"), F.struct(*KEY)))).first()
        counts[name], counts["errors"] = n, counts["errors"] + bad
        ledger = materialise(apply_events(ledger, events), "ledger")
    return ledger, counts
