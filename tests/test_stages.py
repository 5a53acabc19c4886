import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import mail as M
from threadloom.streaming import stages as S

LEDGER = "account_id int, message_key string, state string, judged_at timestamp, indexed_at timestamp, error string, attempts int, internal_date string, eml_exists boolean"
def now():
    return F.lit("2024-05-01").cast("timestamp")


def ledger(spark, rows):
    return spark.createDataFrame([(1, k, s, None, None, e, a, "2024", True) for k, s, e, a in rows], LEDGER)


def events(spark, rows):
    return spark.createDataFrame([(1, k, i, e, r) for i, (k, e, r) in enumerate(rows)], S.EVENTS)


def state(df):
    return {r["message_key"]: (r["state"], r["judged_at"] is not None, r["indexed_at"] is not None, r["error"], r["attempts"]) for r in df.collect()}


def test_events_and_their_effects(spark):
    start = ledger(spark, [("a", "new", "old error", 2), ("b", "done", None, 0), ("c", "abandoned", "x", 3), ("d", "new", None, 0), ("e", "new", None, 1)])
    got = state(S.apply_events(start, events(spark, [("a", "judged", None), ("a", "indexed", None), ("b", "requeued", None), ("b", "abandoned", "no"), ("c", "requeued", None), ("d", "abandoned", ""), ("e", "failed", "boom"), ("zz", "judged", None)]), now()))
    assert got == {"a": ("done", True, True, None, 2), "b": ("done", False, False, None, 0), "c": ("new", False, False, None, 0), "d": ("abandoned", False, False, "abandoned", 0), "e": ("new", False, False, "boom", 2)}


def test_blocks_of_events_compose(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(list(M.TRANSITIONS))) for i in range(400) for k in ("a", "b", "c") if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, o int, e string")
    want = {tuple(r) for r in M.fold_events(df, ["k"], "o", "e").select("k", "state", "n_events").collect()}
    for block in (1, 7, 10_000):
        assert {tuple(r) for r in S.fold_in_blocks(df, ["k"], "o", "e", block=block).select("k", "state", "n_events").collect()} == want


def outcomes(spark, rows):
    return spark.createDataFrame([(1, k, o) for k, o in rows], "account_id int, message_key string, outcome string")


def told(df):
    return sorted((r["message_key"], r["order_no"], r["event"]) for r in df.collect())


def test_judge_stage(spark):
    w = ledger(spark, [("a", "new", None, 0), ("b", "new", None, 2), ("c", "new", None, 0), ("d", "new", None, 0)]).withColumn("eml_exists", F.col("message_key") != "d")
    mixed = outcomes(spark, [("a", "done"), ("b", "error"), ("c", "unavailable")])
    assert told(S.judge_stage(w, mixed, lambda: False)) == [("a", 0, "judged"), ("b", 0, "failed"), ("b", 1, "abandoned"), ("d", 0, "abandoned")]
    all_bad = outcomes(spark, [(k, "error") for k in "abc"])
    assert told(S.judge_stage(w, all_bad, lambda: False)) == [("a", 0, "deferred"), ("b", 0, "deferred"), ("c", 0, "deferred"), ("d", 0, "abandoned")]
    assert ("b", 1, "abandoned") in told(S.judge_stage(w, all_bad, lambda: True))
    one = w.where("message_key = 'b'")
    assert told(S.judge_stage(one, outcomes(spark, [("b", "error")]), lambda: False)) == [("b", 0, "failed"), ("b", 1, "abandoned")]
    after = state(S.apply_events(w, S.judge_stage(w, mixed, lambda: True), now()))
    assert after["b"][0] == "abandoned" and after["b"][4] == 3 and after["c"][0] == "new"
    assert S.judge_stage(w.limit(0), mixed.limit(0), lambda: True).count() == 0


def test_index_stage(spark):
    w = ledger(spark, [(k, "judged", None, 0) for k in "abcd"])
    attached = spark.createDataFrame([(1, "a", ""), (1, "b", "permanent"), (1, "c", "transient")], "account_id int, message_key string, failure string")
    got = S.index_stage(w, attached, w.where("message_key in ('a', 'b')"))
    assert told(got) == [("a", 0, "indexed"), ("b", 0, "abandoned"), ("c", 0, "deferred"), ("d", 0, "abandoned")]


def test_run_of_an_account(spark):
    start = ledger(spark, [("a", "new", None, 0), ("b", "judged", None, 0)])
    fetch = lambda: ledger(spark, [("a", "new", None, 0), ("n", "new", None, 0)])
    judge = lambda w: S.judge_stage(w, w.select("account_id", "message_key", F.lit("done").alias("outcome")), lambda: True)
    index = lambda w: S.index_stage(w, w.limit(0).select(*S.KEY, F.lit("").alias("failure")), w)
    after, counts = S.sync_account(start, 1, fetch, judge, index)
    assert counts == {"fetched": 1, "judged": 2, "indexed": 3, "errors": 0} and {v[0] for v in state(after).values()} == {"done"}
    after, counts = S.sync_account(start, 1, None, None, index)
    assert counts == {"fetched": 0, "judged": 0, "indexed": 2, "errors": 0} and state(after)["a"][0] == "indexed_unjudged"


def test_run_log_and_cursors(spark):
    t = lambda i: f"2024-01-01 00:00:0{i}"
    rows = [("r1", 1, t(1), "running"), ("r2", 1, t(2), "running"), ("r2", 1, t(3), "ok"), ("r3", 1, t(4), "running"), ("q", 2, t(1), "running")]
    log = spark.createDataFrame([(*r, 0, 0, 0, 0, "") for r in rows], S.RUNS.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))
    assert {r["run_id"]: r["status"] for r in S.runs(log).collect()} == {"r1": "failed", "r2": "ok", "r3": "running", "q": "running"}
    assert S.runs(S.run_row(spark, "x", 1, "ok", 5)).first()["fetched"] == 5
    schema = "account_id int, folder string, role string, generation string, cursor string, synced_at string"
    old = spark.createDataFrame([(1, "in", "inbox", "g1", "5", "mon"), (1, "out", "sent", "g1", "7", "mon")], schema)
    got = S.commit_cursors(old, spark.createDataFrame([(1, "in", "inbox", "g1", "9", None), (2, "in", "inbox", "g1", "1", "tue")], schema))
    assert {(r["account_id"], r["folder"]): (r["cursor"], r["synced_at"]) for r in got.collect()} == {(1, "in"): ("9", "mon"), (1, "out"): ("7", "mon"), (2, "in"): ("1", "tue")}
    void = S.void_cursors(old, spark.createDataFrame([(1, "in", "g2"), (1, "out", "g1")], "account_id int, folder string, generation string"))
    assert {r["folder"]: (r["generation"], r["cursor"]) for r in void.collect()} == {"in": ("g2", None), "out": ("g1", "7")}
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("abc", "bc"))
    assert S.dropped(a, b, ["k"]).collect() == [("a",)] and S.handled(a, b).count() == 3
