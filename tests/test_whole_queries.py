"""Queries that do a whole job of which the SQL of their namesake says a part, on fixtures that hold the rest."""

import math
import re
from collections import Counter

import duckdb

from threadloom.queries import catalogue


def test_sparse_terms_of_every_script(spark, tmp_path):
    """Every word of two characters or more counts, in whatever script, and figures do."""
    texts = {0: "회의 자료 회의 Éclusé am Kai 12,500", 1: "회의 일정", 2: "ÉCLUSÉ am 2024", 3: "eclus", 4: "12500 a", 5: None, 100: "am Kai 2024", 101: "a b"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    weights = {}
    for k, t in texts.items():
        terms = re.findall(r"[^\W_]{2,}", (t or "").lower()) + [x.replace(",", "") for x in re.findall(r"\d+,\d{3}", t or "")]
        weights[k] = {w: 1 + math.log(n) for w, n in Counter(terms).items()}
    want = set()
    for q in (0, 100):
        scores = {d: round(sum(v * weights[d][w] for w, v in weights[q].items() if w in weights[d]), 6) for d in texts if d != q and weights[q].keys() & weights[d].keys()}
        want |= {(q, d, scores[d], i) for i, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d)))}
    got = {(r["query"], r["item"], r["score"], r["rank"]) for r in catalogue.queries()["ref_j18_sparse_terms"](spark, str(tmp_path)).collect()}
    assert got == want and {d for q, d, _, _ in want if q == 0} == {1, 2, 4, 100}


def test_grep_finds_messages_by_subject_alone(spark, tmp_path):
    """The first 500 by id of all matches: a subject counts where the body has no match, is null or empty."""
    rows = [(1, "No\nthe PERMIT is here", "x"), (2, None, "Permit 4"), (3, "", "your permit"), (4, "nothing", "permits"), (5, "nothing", None), (6, "permit", "permit"), (7, None, None)]
    rows += [(i, "a permit", None) for i in range(100, 700)]
    spark.createDataFrame(rows, "email_id bigint, body string, subject string").write.parquet(f"{tmp_path}/thread_emails.parquet")
    df = catalogue.queries()["ref_l5_grep_messages"](spark, str(tmp_path))
    got = {r["email_id"]: r["lines"] for r in df.collect()}
    assert len(got) == 500 and max(got) == 594
    assert {k: v for k, v in got.items() if k < 100} == {1: ["the PERMIT is here"], 2: ["Permit 4"], 3: ["your permit"], 4: ["permits"], 6: ["permit"]}
    duck = duckdb.connect()
    duck.execute(f"create view thread_emails as select * from '{tmp_path}/thread_emails.parquet/*.parquet'")
    assert dict(duck.execute(catalogue.oracle_sql()["ref_l5_grep_messages"]).fetchall()) == got


def test_domain_of_empty_subjects_fills_all_characters(spark, tmp_path):
    rows = [(i, "a@x.example", None if i % 2 else "") for i in range(300)]
    spark.createDataFrame(rows, "email_id bigint, sender string, subject string").write.parquet(f"{tmp_path}/thread_emails.parquet")
    joined = catalogue.queries()["ref_a19_domain_regroup"](spark, str(tmp_path)).first()["joined"]
    assert joined == (" | " * 299)[:800]
