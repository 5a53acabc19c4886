import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.functions.rules import prompt
from threadloom.operators import corpora as C
from threadloom.operators.attachments import count_tokens
from threadloom.sources import mail_files as S

from .test_attachments import XLSX


def ids(df, c="k"):
    return sorted(r[c] for r in df.collect())


def test_scope_and_fetches(spark, tmp_path):
    files = spark.createDataFrame([("a/x/1",), ("a/xy/2",), ("b/3",), ("a/x",)], "path string")
    named = spark.createDataFrame([("one", "a/x"), ("two", "b/"), ("two", None)], "collection string, root string")
    assert ids(C.scope(files, named, "one"), "path") == ["a/x", "a/x/1"] and ids(C.scope(files, named, "two"), "path") == ["b/3"]
    with pytest.raises(ValueError):
        C.scope(files, named, "three")
    assert [r["path"] for r in C.first_files(files, 2).collect()] == ["a/x", "a/x/1"]
    with pytest.raises(ValueError):
        C.first_files(files.limit(0))
    rows, manifest = spark.createDataFrame([("p", 1), ("q", 2)], "k string, v int"), spark.createDataFrame([("q", 0), ("p", 1)], "k string, pos int")
    assert [r["v"] for r in C.fetch_in_order(rows, manifest, "k", "pos").orderBy("pos").collect()] == [2, 1]
    with pytest.raises(ValueError, match="z"):
        C.fetch_in_order(rows, spark.createDataFrame([("z", 0)], "k string, pos int"), "k", "pos")
    for i, name in enumerate(("old", "new")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"collection": name}))
        os.utime(tmp_path / f"{name}.json", (1000 + i, 1000 + i))
    assert C.latest_manifest(spark, str(tmp_path)) == "new"
    rows.createOrReplaceTempView("idx_a")
    assert [(r.collection, r.n_rows, r.is_default) for r in C.collection_catalog(spark, "idx_a", "idx_")] == [("idx_a", 2, True)]


def test_bounded_grep(spark):
    mails = spark.createDataFrame([(i, "boiler" if i % 10 == 0 else None, "no\nthe Boiler here" if i % 3 == 0 else "x") for i in range(100)], "email_id bigint, subject string, body string")
    rows, told = C.bounded_grep(mails, "BOILER")
    assert len(rows) == 40 and told == {"scanned": 100, "corpus_rows": 100, "complete": True, "stop_reason": None} and rows[0]["lines"] == ["the Boiler here"] and [r["email_id"] for r in rows] == sorted(r["email_id"] for r in rows)
    rows, told = C.bounded_grep(mails, "boiler", most=5)
    assert [r["email_id"] for r in rows] == [0, 3, 6, 9, 10] and told["stop_reason"] == "max_matches" and not told["complete"] and told["scanned"] < 100
    rows, told = C.bounded_grep(mails, "boiler", max_rows=11)
    assert [r["email_id"] for r in rows] == [0, 3, 6, 9, 10] and (told["stop_reason"], told["scanned"]) == ("max_files", 11)
    assert C.bounded_grep(mails, "boiler", seconds=0.0)[1]["stop_reason"] == "deadline" and C.bounded_grep(mails.limit(0), "x")[0] == []
    with pytest.raises(ValueError):
        C.bounded_grep(mails, "")


def test_documents(spark):
    schema = "sender string, subject string, date_text string, body string, to_text string, cc_text string, message_id string, in_reply_to string, summary string, source_name string"
    d = C.documents(spark.createDataFrame([("s" * 200, "Re: Hi", None, "b", "A <a@x>, a@x", None, "<m>", "<p>", "", "src"), (None,) * 10], schema)).collect()
    assert d[0]["doc_id"] == "body:m" and d[0]["sender"] == "s" * 125 + "..." and d[0]["to"] == "a@x" and d[0]["cc"] is None and d[0]["thread_id"] == "p" and d[0]["date"] == "unknown" and d[0]["summary"] is None
    assert len(d[1]["message_key"]) == 64 and d[1]["text"] == "" and d[1]["is_bulk"] is False


def test_sentence_chunks():
    text = "One two three. Four five! Six seven eight nine? " * 30
    chunks = C.sentence_chunks(text, 40, 10)
    assert all(count_tokens(c) <= 40 for c in chunks) and chunks[0].startswith("One two")
    for a, b in zip(chunks, chunks[1:]):
        head = b[: len(b) // 3].split("?")[0].split("!")[0].split(".")[0]
        assert head in a
    assert C.sentence_chunks("", 5) == [] and C.sentence_chunks("w " * 100, 10, 0) == [" ".join(["w"] * 10)] * 10
    assert C.sentence_chunks("a b. c d. ", 100) == ["a b. c d."]


def test_failed_documents_are_set_aside(spark):
    def fussy(t):
        if "bad" in t:
            raise ValueError("no")
        return len(t.split())

    good, failed = C.split_documents(spark.createDataFrame([(1, "fine text"), (2, "bad text"), (3, None)], "k int, t string"), "k", "t", count=fussy)
    assert [tuple(r) for r in good.collect()] == [("1", 0, "fine text")] and [tuple(r) for r in failed.collect()] == [("2", "ValueError: no")]


def test_bound_threads(spark):
    rows = [("a", i, "x" * 40) for i in range(5)] + [("b", 1, "long " * 50), ("b", 2, "y")] + [("c", 1, "s"), ("c", 2, None), ("c", 3, "t")]
    got = {r["t"]: (r["text"], r["left_out"]) for r in C.bound_threads(spark.createDataFrame(rows, "t string, i int, x string"), ["t"], ["i"], "x", 40).collect()}
    assert got == {"a": ("x" * 40 + "\n[3 messages left out]\n" + "x" * 40, 3), "b": ("long " * 50 + "\ny", 0), "c": ("s\nt", 0)}


def test_tables_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([("promo", "a.x"), ("promo-2", "b.x"), ("list", "c.x")], "rule_key string, domain string")
    got = {r["domain"]: r["rule_key"] for r in C.merge_rules(old, spark.createDataFrame([("promo", "a.x"), ("promo", "d.x"), ("promo", "e.x"), ("new", "f.x")], old.schema)).collect()}
    assert got == {"a.x": "promo", "b.x": "promo-2", "c.x": "list", "d.x": "promo-3", "e.x": "promo-4", "f.x": "new"}
    assert C.merged_profile({"a": 1, "b": 1}, {"a": 2, "b": 1}, {"a": 1, "b": 3, "c": 4}) == {"a": 2, "b": 3, "c": 4}
    with pytest.raises(ValueError, match="a"):
        C.merged_profile({"a": 1}, {"a": 2}, {"a": 3})
    C.save_json(str(tmp_path / "r.json"), {"b": 1})
    assert json.loads((tmp_path / "r.json").read_text()) == {"b": 1} and os.listdir(tmp_path) == ["r.json"]
    C.log_call(str(tmp_path / "u.jsonl"), "grep", {"q": "x", "n": None}, 0.5, True, {"matches": [1, 2], "complete": False, "scanned": 9, "stop_reason": "deadline"})
    C.log_call("/nowhere/at/all", "grep", {}, 0.5, True)
    line = json.loads((tmp_path / "u.jsonl").read_text())
    assert (line["args"], line["result_count"], line["complete"], line["duration_ms"]) == ({"q": "x"}, 2, False, 500.0)
    k = spark.createDataFrame([(i,) for i in range(5)], "k int")
    assert ids(C.without_ids(k, k.where("k < 3"), "k")) == [3, 4]
    C.emptied(k, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0
    C.write_fixture(k, k.where("k = 1"), "k", str(tmp_path / "f"))
    with pytest.raises(ValueError):
        C.write_fixture(k, spark.createDataFrame([(9,)], "k int"), "k", str(tmp_path / "f"))
    C.write_layout(k.withColumn("thread_id", F.lit("t")), str(tmp_path / "l"), ["k"])
    assert spark.read.parquet(str(tmp_path / "l")).count() == 5
    v = spark.createDataFrame([("body:1", 1), ("att:2", 1)], "doc_key string, sparse int")
    assert C.index_variant(v, "body").count() == 1 and C.index_variant(v, "dense").columns == ["doc_key"] and C.index_variant(v, "full").count() == 2
    h = spark.createDataFrame([(1, 7, "b", 1), (1, 7, "a", 5), (1, 8, "b", 2), (1, 7, "a", 3)], "query int, item int, arm string, rank int")
    assert sorted(map(tuple, C.pooled(h).collect())) == [(1, 7, "a", 3), (1, 8, "b", 2)]


def test_judgment_tables(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "k int, g int"), spark.createDataFrame([(1, 2), (2, 0), (3, None), (9, 1)], "k int, g int")
    assert tuple(C.agreement(a, b, ["k"], "g").first()) == (3, pytest.approx(2 / 3)) and tuple(C.agreement(a.limit(0), b, ["k"], "g").first()) == (0, 0.0)
    assert tuple(C.judgment_counts(spark.createDataFrame([(True,), (False,), (None,)], "is_noise boolean")).first()) == (3, 1, 2)
    r = spark.createDataFrame([("d", "terse", True), ("d", "long", False), ("s", None, True)], "arm string, category string, hit boolean")
    assert {tuple(x) for x in C.recall_counts(r, ["hit"]).collect()} == {("d", "terse", 1, 1), ("d", "long", 1, 0), ("d", "ALL", 2, 1), ("s", None, 1, 1), ("s", "ALL", 1, 1)}
    hits = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4), (1, "d", 5), (2, "d", 1)], "query int, thread_id string, rank int")
    gold = spark.createDataFrame([(1, "c"), (2, "x"), (3, "y")], "query int, thread_id string")
    assert tuple(C.coverage_at(hits, gold).first()) == (3, pytest.approx(1 / 3))
    assert tuple(C.over_budget(spark.createDataFrame([(9,), (11,)], "n int"), "n", 10).first()) == (2, 50.0)
    assert {tuple(x) for x in C.mean_grades(spark.createDataFrame([("x", 3), ("x", 1), ("y", None)], "setup string, grade int")).collect()} == {("x", 2, 2.0), ("y", 0, None)}
    m = C.spanning_members(gold.limit(1), spark.createDataFrame([("c", "m2"), ("c", "m1"), ("z", "m3")], "thread_id string, message_id string")).first()
    assert (m["n_messages"], m["message_ids"]) == (2, ["m1", "m2"])
    assert [x["k"] for x in C.aligned(a.withColumn("p", -F.col("k")), b.select("k"), "k", "p").collect()] == [3, 2, 1]
    rows, told = C.counted(spark.createDataFrame([("ok",), ("bad",), ("ok",)], "o string"), "o", ["ok", "bad"])
    assert rows.count() == 3 and told.get == {"total": 3, "ok": 2, "bad": 1}


def test_model_passes(spark):
    work = spark.createDataFrame([("a", "text a"), ("b", "text b"), ("c", "")], "key string, body string")
    ask = F.col("body")
    replies, outcomes = C.model_pass(work, None, ask, C.echo_model)
    assert ids(replies, "key") == ["a", "b"] and {tuple(r) for r in outcomes.collect()} == {("a", "done"), ("b", "done"), ("c", "error")}
    replies, outcomes = C.model_pass(work, replies.where("key = 'a'"), ask, C.echo_model)
    assert ids(replies, "key") == ["a", "b"] and {r["outcome"] for r in outcomes.where("key = 'a'").collect()} == {"cached"}
    with pytest.raises(RuntimeError):
        C.guarded_pass(work, None, ask, C.echo_model)
    assert C.guarded_pass(work.where("key < 'c'"), None, ask, C.echo_model)[0].count() == 2
    with pytest.raises(RuntimeError, match="answer"):
        C.guarded_pass(work.where("key = 'c'"), None, ask, C.echo_model)
    threads = spark.createDataFrame([(2, "t2", "second"), (1, "t1", "first")], "rank int, thread_id string, text string")
    got = C.answer_question("who?", threads, C.echo_model, 1)
    assert got["sources"] == ["t1"] and "who?" in got["answer"] and C.answer_question("q", threads.limit(0), C.echo_model) == {"answer": None, "sources": []}
    counts, samples = spark.createDataFrame([("x", 9), ("y", 1)], "domain string, n int"), spark.createDataFrame([("x", "s"), ("y", "s")], "domain string, sample string")
    assert ids(C.discovered_rules(counts, samples, C.echo_model, 5), "key") == ["x"]
    assert C.newest_judgments(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "key string, created_at int, v string")).first()["v"] == "y"


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("From: a@x\nTo: b@y\nSubject: S\n\n" + "=" * 10 + "\n" + "long body " * 6,), ("Subject: T\nshort\n=====\nx",), (None,)], "email string")
    got = S.enron_rows(rows).collect()
    assert (got[0]["sender"], got[0]["recipients"], got[0]["subject"], got[0]["body"]) == ("a@x", "b@y", "S", ("long body " * 6).strip()) and got[1]["body"].startswith("Subject: T") and got[2]["subject"] == ""
    (tmp_path / "q.jsonl").write_text('{"query": "a"}\n\n{"query": "b"}\n')
    assert ids(S.json_lines(spark, str(tmp_path / "q.jsonl"), "query string"), "query") == ["a", "b"]
    (tmp_path / "r.tsv").write_text("t1\td1\t2\n")
    (tmp_path / "t.json").write_text('{"t1": "why",\n "t2": "how"}')
    assert S.relevance_judgments(spark, str(tmp_path / "r.tsv")).collect() == [("t1", "d1", 2)] and ids(S.topics(spark, str(tmp_path / "t.json")), "topic") == ["t1", "t2"]
    (tmp_path / "x.xlsx").write_bytes(XLSX)
    (tmp_path / "y.xlsx").write_bytes(b"none")
    sheets = S.sheet_rows(spark.read.format("binaryFile").load(str(tmp_path / "*.xlsx")).select("path", "content")).collect()
    assert [r["cells"] for r in sheets if r["sheet"] == "Q1"] == [["name", "", "5"], ["bolt", "x"]] and sum(r["error"] is not None for r in sheets) == 1
    (tmp_path / "m").mkdir()
    for n in "ba":
        (tmp_path / "m" / f"{n}.eml").write_bytes(f"Subject: {n}\n\nx".encode())
    assert ids(S.load_emails(spark, "eml", str(tmp_path / "m"), 1), "subject") == ["a"]
    (tmp_path / "l.mbox").write_bytes(b"From a\nSubject: caf\xe9\n\n>From here\nFromage\n\nFrom b\nSubject: 2\n\ny\n")
    assert sorted(bytes(r["content"]) for r in S.mbox_messages(spark, str(tmp_path / "l.mbox")).collect()) == [b"Subject: 2\n\ny\n", b"Subject: caf\xe9\n\nFrom here\nFromage\n"]
    with pytest.raises(ValueError):
        S.load_emails(spark, "carrier pigeon", "x")
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("rules:\n  promo: {domain: a.x}\n  list: {domain: b.x}\n")
    assert ids(S.yaml_rows(spark, str(tmp_path / "c.yaml"), "rules", "name string, domain string"), "domain") == ["a.x", "b.x"]
    assert prompt("valid", context=F.lit("c"), query=F.lit("q")) is not None
