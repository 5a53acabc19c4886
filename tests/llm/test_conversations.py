import re

import numpy as np
from pyspark.sql import functions as F

from threadloom.functions.instants import InstantParser
from threadloom.llm.conversations import assemble, assemble_batch, conversation_threads, conversation_turns, fragments
from threadloom.operators.ranking import grouped_row_number

SCHEMA = "email_id bigint, account_id int, thread_id string, message_id string, in_reply_to string, sender string, body string, utc_micros bigint"
OWN = [(1, "me@x.test")]


def norm(m):
    v = (m or "").strip()
    if v.startswith("<") and v.endswith(">"):
        v = v[1:-1]
    return v.strip()


def brute(rows, own):
    threads = {}
    for r in rows:
        if norm(r[2]):
            threads.setdefault((r[1], norm(r[2])), []).append(r)
    out = set()
    for (acc, tid), rs in threads.items():
        messages = {}
        for r in sorted(rs):
            messages.setdefault(norm(r[3]) or r[0], r)
        ids = {norm(r[3]) for r in rs} - {""}
        if any(norm(r[4]) and norm(r[4]) not in ids for r in rs) or not (tid.startswith("subj:") or tid in ids):
            continue
        turns = []
        for m in messages.values():
            if (m[6] or "").strip():
                a = re.search(r'[^\s<>()\[\]",;:]+@[^\s<>()\[\]",;:]+', m[5] or "")
                who = "unknown" if not a else "owner" if (acc, a[0].lower()) in own else "correspondent"
                turns.append(((m[7] is None, m[7] or 0, m[0]), m[0], who))
        if {"owner", "correspondent"} <= {t[2] for t in turns}:
            out |= {(tid, i + 1, e, w) for i, (_, e, w) in enumerate(sorted(turns))}
    return out


def turns(spark, rows, own=OWN):
    """The turns; in one exchange, with all threads as huge ones, and with some as such the same."""
    emails, addresses = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(own, "account_id int, address string")
    got = [conversation_turns(emails, addresses, hot).collect() for hot in (100_000, 0, 5)]
    assert len({frozenset(map(tuple, g)) for g in got}) == 1 and len({len(g) for g in got}) == 1
    threads = [frozenset(map(tuple, conversation_threads(emails, addresses, hot).collect())) for hot in (100_000, 0)]
    assert threads[0] == threads[1]
    return {tuple(r) for r in got[0]}


def test_cases(spark):
    rows = [
        (1, 1, "a", "<a>", None, "Me <ME@x.test>", "hi", 10), (2, 1, "<a>", "b", "<a>", "you@y", "yo", None), (3, 1, "a", "c", " b ", None, "what", 5),
        (4, 1, "a", "b", "a", "other@y", "copy", 1), (5, 1, "a", "d", "c", "me@x.test", " 　\n", 2), (6, 1, "a", None, "d", "you@y", "no id", 7),
        (7, 1, "g", "g", "", "me@x.test", "x", 1), (8, 1, "g", "h", "lost", "you@y", "x", 2),  # gap
        (9, 1, "subj:z", "", "", "me@x.test", "x", 1), (10, 1, "subj:z", "", None, "you@y", "x", 1),
        (11, 1, "r", "q", None, "me@x.test", "x", 1), (12, 1, "r", "s", "q", "you@y", "x", 2),  # no root
        (13, 1, "self", "self", "self", "me@x.test", "x", 1), (14, 1, "self", "t", "u", "you@y", "x", 2), (15, 1, "self", "u", "t", "you@y", "x", 3),
        (16, 1, None, "n", None, "me@x.test", "x", 1), (17, 1, "", "n", None, "you@y", "x", 1), (18, 2, "a", "a", None, "me@x.test", "x", 1),
    ]
    want = brute(rows, set(OWN))
    assert turns(spark, rows) == want
    assert {t[0] for t in want} == {"a", "subj:z", "self"}


def test_empty(spark):
    assert turns(spark, []) == set()


def test_long_chain_merges_into_one_path(spark):
    rows = [(i, 1, "m0", f"m{i}", f"m{i - 1}" if i else None, "me@x.test" if i % 2 else "you@y", "x", 100 - i) for i in range(40)]
    rows += [(100, 1, "m0", "branch", "m5", "you@y", "x", 1)]
    messages, threads = assemble(fragments(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(OWN, "account_id int, address string")))
    by = {r["email_id"]: (r["path_head"], r["path_pos"]) for r in messages.collect()}
    assert by[39][1] == 33 and by[5][1] == 5 and len({by[i][0] for i in range(6, 40)} - {by[6][0]}) <= 1
    assert threads.collect()[0]["n_gaps"] == 0
    assert turns(spark, rows) == brute(rows, set(OWN))


def test_big_groups_are_numbered_by_ranges(spark):
    df = spark.range(500).select(F.lit(7).alias("k"), F.lit(500).alias("n"), (F.col("id") * 7919 % 500).alias("v"))
    got = grouped_row_number(df, "k", "n", [F.col("v")], "no", big=100).collect()
    assert sorted((r["v"], r["no"]) for r in got) == [(i, i + 1) for i in range(500)]


def test_project_table(spark, sf):
    from threadloom.llm.queries import p2_found

    acc = {r["account_id"]: r for r in spark.read.parquet(f"{sf}/accounts.parquet").collect()}
    p = InstantParser([a["tz_name"] for a in acc.values()])
    emails = spark.read.parquet(f"{sf}/thread_emails.parquet").collect()
    rows = [(e["email_id"], e["account_id"], e["thread_id"], e["message_id"], e["in_reply_to"], e["sender"], e["body"], p.parse(e["date_text"], acc[e["account_id"]]["tz_name"], acc[e["account_id"]]["locale"])) for e in emails]
    own = {(r["account_id"], r["address"]) for r in spark.read.parquet(f"{sf}/account_addresses.parquet").collect()}
    assert {tuple(r) for r in p2_found(spark, sf).collect()} == brute(rows, own)


def test_overlapping_runs_merge_by_shared_hashes():
    """Runs 1-2-3, 2-3-4 (an overlap of two) and 4-5 make one path; the answers 7 and 8 of 5 and the run after a lost 9 stay apart."""
    rows = [(0, 1, 1, None), (0, 2, 2, 1), (0, 3, 3, 2), (0, 4, 2, 1), (0, 5, 3, 2), (0, 6, 4, 3), (0, 7, 5, 4), (0, 8, 7, 5), (0, 9, 8, 5), (0, 10, 10, 9), (0, 11, 11, 10), (1, 12, 2, 3)]
    t, email, own, parent = (np.array([r[i] or 0 for r in rows]) for i in range(4))
    g = assemble_batch(t, email, own, parent, np.array([r[3] is not None for r in rows]))
    name = {i: (int(g["thread"][i]), int(own[r]) if (r := g["row"][i]) >= 0 else None) for i in range(len(g["row"]))}
    paths = {}
    for i, (h, d) in enumerate(zip(g["head"], g["depth"])):
        paths.setdefault(int(h), {})[int(d)] = name[i]
    got = sorted([p[k] for k in sorted(p)] for p in paths.values() if None not in {x for _, x in p.values()})
    lost = sorted([p[k] for k in sorted(p)][1:] for p in paths.values() if None in {x for _, x in p.values()})
    assert got == [[(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)], [(0, 7)], [(0, 8)]]
    assert lost == [[(0, 10), (0, 11)], [(1, 2)]]
    assert g["n_gaps"].tolist() == [1, 1] and g["n_paths"].tolist() == [4, 1]
    assert {name[int(i)] for i in np.flatnonzero(g["row"] >= 0)} == {(0, k) for k in (1, 2, 3, 4, 5, 7, 8, 10, 11)} | {(1, 2)}
    assert email[g["row"][[i for i, x in name.items() if x == (0, 2)][0]]] == 2  # the copy with the smallest id
