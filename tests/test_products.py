"""Best inner products against brute force."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.operators import products
from threadloom.operators import retrieval as R
from threadloom.plans import search


def brute(queries, items, k, log, exclude_self):
    weigh = lambda ts: {t: 1 + math.log(n) if log else float(n) for t, n in Counter(ts).items()}
    d = {i: weigh(ts) for i, ts in items.items()}
    out = set()
    for q, ts in queries.items():
        own = weigh(ts)
        s = {i: round(sum(w * own[t] for t, w in v.items() if t in own), 6) for i, v in d.items() if own.keys() & v.keys() and not (exclude_self and i == q)}
        out |= {(q, i, s[i], r) for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:k])}
    return out


@pytest.mark.parametrize("log, exclude_self, block", [(True, False, 4096), (False, True, 4096), (True, True, 7)])
def test_best_terms_are_those_of_brute_force(spark, monkeypatch, log, exclude_self, block):
    """Ties, equal vectors, frequent and rare terms, items without a common term; one block of queries or several, one partition or several."""
    monkeypatch.setattr(products, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = {i: [words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randrange(0, 9))] for i in range(400)}
    items |= {i: ["same", "same", "other"] for i in range(400, 430)} | {430: ["회의", "é"], 431: ["é"]}
    queries = {i: v for i, v in items.items() if i % 10 == 0}
    frame = lambda rows, key: spark.createDataFrame([*rows.items(), (None, ["w1"]), (900, None)], f"{key} bigint, terms array<string>")
    got = products.best(frame(queries, "query"), frame(items, "item").repartition(5), 6, log, exclude_self=exclude_self)
    assert {tuple(r) for r in got.collect()} == brute(queries, items, 6, log, exclude_self)


def test_rows_of_one_key_count_as_one(spark):
    items = spark.createDataFrame([(1, ["a"]), (1, ["a", "b"]), (2, ["a", "b"]), (3, ["b"])], "item bigint, terms array<string>")
    queries = spark.createDataFrame([(7, ["a"]), (7, ["b"])], "query bigint, terms array<string>")
    got = {tuple(r) for r in products.best(queries, items, 5, log=False).collect()}
    assert got == {(7, 1, 3.0, 0), (7, 2, 2.0, 1), (7, 3, 1.0, 2)}


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], "item bigint, terms array<string>")
    one = spark.createDataFrame([(1, ["a"])], "item bigint, terms array<string>")
    assert products.best(none.withColumnRenamed("item", "query"), one, 5).count() == 0
    assert products.best(one.withColumnRenamed("item", "query"), none, 5).count() == 0


def test_pairs_of_common_terms_are_no_rows(spark):
    """A term that all rows share: equal scores go by item, whatever the partition."""
    items = spark.range(3000).select(F.col("id").alias("item"), F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id") % 50)).alias("terms"))
    got = products.best(items.where("item < 600").withColumnRenamed("item", "query"), items, 3, exclude_self=True)
    assert {r["item"] for r in got.where("query = 57").collect()} == {7, 107, 157} and got.count() == 1800


@pytest.mark.parametrize("mode", ["dense", "sparse"])
def test_a_leg_ranks_as_the_encoded_tables_do(spark, mode):
    """The legs of the search against term weights as rows, hashed vectors and all pairs, each rounded before it is ranked."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("item"), "text")
    q = d.where("item % 10 = 0").select(F.col("item").alias("query"), "text")
    tq, td = search.encode(q, "query", "text"), search.encode(d, "item", "text")
    if mode == "dense":
        hits = R.nearest(search.dense(tq, "query").withColumnRenamed("vec", "qvec"), search.dense(td, "item"), 8, exclude_self=False).withColumn("rank", F.col("rank") - 1)
    else:
        hits = R.ranked(R.sparse_scores(tq, td).withColumn("score", F.round("score", 6)), "sparse").where("rank < 8")
    want = {(r["query"], r["item"], r["rank"]) for r in hits.collect()}
    got = {(r["query"], r["item"], r["rank"] - 1) for r in search.hybrid(q, d, mode, per_leg=8).collect()}
    assert got == want and want


def test_conversations_of_equal_subjects(spark):
    """Queries of one subject are scored once and all get the conversations of its hits."""
    c = spark.sql("select id item, concat('t', id % 4) thread_id, string(id) message_id, id ordinal, timestamp '2024-01-01 00:00:00' sent_at, 'a@x' sender, concat('boiler ', if(id % 4 = 1, 'manual', 'room')) text from range(40)")
    q = spark.createDataFrame([(i, "Boiler manual") for i in range(300)] + [(900, "nothing")], "query bigint, text string")
    got = search.threads_of(search.hybrid(q, c.select("item", "text"), "sparse", top=5), c, 3).collect()
    assert {(r["query"], r["thread_id"], r["n_emails"]) for r in got} == {(i, "t1", 10) for i in range(300)}


def shuffled(spark):
    """Bytes that this application has written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_only_texts_of_conversations_that_were_hit_move(spark):
    """A conversation that 200 queries hit moves once, texts of others stay where they are."""
    rng = random.Random(5)
    rows = [(i, f"t{i % 50}", f"m{i}", i, None, "a@x", rng.randbytes(10_000).hex()) for i in range(200)]
    c = spark.createDataFrame(rows, "item bigint, thread_id string, message_id string, ordinal bigint, sent_at timestamp, sender string, text string")
    hits = spark.createDataFrame([(q, 7, 1) for q in range(200)] + [(q, 8, 2) for q in range(200)], "query bigint, item bigint, rank int")
    before = shuffled(spark)
    got = search.threads_of(hits, c, 1).collect()
    assert shuffled(spark) - before < 1_000_000  # of 4,000,000 bytes of texts, 80,000 of the one conversation
    text = "\n\n".join(f"[?] a@x\n{r[6]}" for r in sorted((r for r in rows if r[1] == "t7"), key=lambda r: r[2]))
    assert {tuple(r) for r in got} == {(q, 1, "t7", 4, text) for q in range(200)}


def test_conversations_are_those_of_brute_force(spark):
    """Repeated message ids, several chunks of a message, no date, sender, text or thread, items that are not there, equal first ranks."""
    rng = random.Random(6)
    stamp = lambda n: datetime(2024, 1, 1 + n, 9, 30)
    rows = [(i, rng.choice([*"abcdefgh", "", None]), rng.choice(["m1", "m2", "m3", None]), i, rng.choice([None, *map(stamp, range(9))]), rng.choice([None, "x", "y"]), rng.choice([None, "one", "two", "three"])) for i in range(120)]
    c = spark.createDataFrame(rows, "item bigint, thread_id string, message_id string, ordinal bigint, sent_at timestamp, sender string, text string")
    hits = sorted({(q, rng.randrange(130)) for q in range(40) for _ in range(6)})
    ranked = [(q, i, 1 + sum(x == q and y < i for x, y in hits) // 2) for q, i in hits]
    of = {r[0]: r[1] for r in rows}
    want = set()
    for q in range(40):
        first = {}
        for x, i, r in ranked:
            if x == q and of.get(i):
                first[of[i]] = min(r, first.get(of[i], r))
        for place, t in enumerate(sorted(first, key=lambda t: (first[t], t))[:2], 1):
            mails = []
            for m in {r[2] for r in rows if r[1] == t}:
                own = sorted((r for r in rows if r[1] == t and r[2] == m), key=lambda r: r[3])
                at = min((r[4] for r in own if r[4]), default=None)
                mails.append(((at is None, at or stamp(0), m is not None, m or ""), f"[{at:%Y-%m-%d %H:%M}] " if at else "[?] ", own[0][5] or "?", "\n".join(r[6] for r in own if r[6] is not None)))
            want.add((q, place, t, len(mails), "\n\n".join(f"{d}{s}\n{b}" for _, d, s, b in sorted(mails))))
    got = search.threads_of(spark.createDataFrame(ranked, "query bigint, item bigint, rank int"), c, 2).collect()
    assert {tuple(r) for r in got} == want and want


def test_a_filter_by_hash_drops_no_row_of_the_keys(spark, monkeypatch):
    """Words and bits at either end, null, and more keys than bits."""
    monkeypatch.setattr(R, "WORDS", 4)
    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    few, many = df.where("k in ('k3', 'k77', 'k2999')"), df.where("k <> 'k5' or k is null")
    kept = R.perhaps_among(df, few, "k")
    assert few.exceptAll(kept).isEmpty() and kept.count() < 200
    assert many.exceptAll(R.perhaps_among(df, many, "k")).isEmpty()
    assert R.perhaps_among(df, few.where("false"), "k").isEmpty()
