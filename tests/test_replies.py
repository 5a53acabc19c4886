import pytest
from pyspark.sql import functions as F

from threadloom.functions import replies as R
from threadloom.plans.pipeline import build_index, get_thread, grep, judged, run_recipe, work_bounded
from threadloom.plans.search import hybrid, rerank, threads_of
from threadloom.functions.text import lexical_overlap


@pytest.mark.parametrize(
    "text, want",
    [
        ("New.\n\nOn Mon, Oct 21, 2024 at 04:49, A wrote:\n> old", "New."),
        ("New.\n-----Original Message-----\nFrom: a\nold", "New."),
        ("On 2024-01-01 10:00 A <a@b> wrote:\n> old\n\nBelow.", "Below."),
        ("Am 1 Jan 2024 10:00 schrieb A\n<a@b>:\n> x", None),
        ("Text\nFrom: a\nSent: b\n\nold", "Text"),
        ("Just text", "Just text"), ("> only quoted", "> only quoted"), (None, None), ("", ""),
    ],
)
def test_reply_chain(text, want):
    got = R.without_reply_chain(text)
    assert got == want or want is None and (text is None or got is not None)


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_replies(spark):
    v = one(spark, R.json_reply(F.lit('```json\n{"summary": "s", "is_noise": true, "confidence": 7}\n```')))
    assert (v["summary"], v["is_noise"], v["confidence"]) == ("s", True, 1.0)
    v = one(spark, R.json_reply(F.lit('{"summary": "a b", "is_noise": false, "confidence": 0.5, ')))
    assert (v["summary"], v["is_noise"], v["confidence"]) == ("a b", False, 0.5)
    assert one(spark, R.grade(F.lit("Grade: 9"))) == 3 and one(spark, R.grade(F.lit("none"))) == 0
    assert one(spark, R.valid(F.lit('ok {"valid": true}'))) and not one(spark, R.valid(F.lit("yes")))
    assert one(spark, R.endpoint_source(F.lit("http://localhost:80/v1"))) == "local"
    for text, want in (("10", 1), ("Grade: 12", 1), ("grade is 2 of 5", 2), ("8", 3), ('{"grade": 0, "n": 3}', 0), (None, 0)):
        assert one(spark, R.grade(F.lit(text).cast("string"))) == want, text
    none, no = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    for name, flags, own, want in (
        ("INBOX", none, None, "inbox"), ("Work/Inbox", no, None, "other"), ("[Gmail]/Sent Mail", none, None, "other"), (" Junk E-mail ", no, None, "junk"), ("Posteingang", no, None, "other"),
        ("x", F.array(F.lit("\\Noselect"), F.lit("\\Trash")), None, "trash"), ("Sent", F.array(F.lit("\\All")), None, "archive"), ("Sent", F.array(F.lit("\\All")), {"sent": "Drafts"}, "drafts"),
    ):
        assert one(spark, R.folder_role(F.lit(name), flags, own)) == want, name
    with pytest.raises(ValueError):
        R.folder_role(F.lit("x"), no, {"x": "nowhere"})


def test_bulk(spark):
    own, group = ("Delivered-To", "<a@corp.example>"), ("List-Id", "Team <team.corp.example>")
    rows = [
        ([("Precedence", "bulk")], True), ([("Subject", "x")], False), ([("precedence", " List ")], True), ([("Precedence", "junk")], False), ([], False),
        ([own, ("Received", "x"), ("Precedence", "list"), group], False), ([("Received", "x"), own, ("Precedence", "list"), group], True),
        ([own, ("List-Unsubscribe", "<mailto:leave@corp.example>, <https://groups.google.com/x>"), group], False), ([own, ("List-Unsubscribe", "<https://news.example/u>"), group], True),
        ([own, ("List-Unsubscribe", "see below"), group], True), ([own, ("Precedence", "list"), ("Precedence", "Bulk"), group], True), ([own, ("Precedence", "list"), ("List-Id", "<team.notcorp.example>")], True),
        ([own, ("Precedence", "normal"), ("Precedence", "list"), ("List-Id", "<x.other.example>")], False), ([("List-Unsubscribe", None)], True),
    ]
    df = spark.createDataFrame(rows, "headers array<struct<name:string,value:string>>, want boolean")
    assert df.where(R.is_bulk(F.col("headers")) != F.col("want")).count() == 0


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(1, "<a@x>", None, "Jo <j@x>", "Plan", "The boiler manual is at the mill."), (2, "<b@x>", "<a@x>", "Al <a@x>", "Re: Plan", "Invoice over 210,000 for tile samples."), (3, "<c@x>", None, "Gate <gate@y>", "Alert", "The boiler manual is at the mill."), (4, None, None, None, None, None)]
    return spark.createDataFrame(rows, "email_id bigint, message_id string, in_reply_to string, sender string, subject string, body string")


def test_index_and_tools(spark, mails, tmp_path):
    path = str(tmp_path / "index")
    policy = build_index(mails, path)
    first = spark.read.parquet(path)
    assert first.count() == 2 and get_thread(first, "a@x").count() == 2
    assert build_index(mails.where("email_id = 2").withColumn("body", F.lit("New text.")), path, policy) == policy
    texts = {r["text"] for r in spark.read.parquet(path).collect()}
    assert texts == {"The boiler manual is at the mill.", "New text."}
    with pytest.raises(ValueError):
        build_index(mails, path, "other")
    assert [tuple(r["lines"]) for r in grep(mails, "INVOICE").collect()] == [("Invoice over 210,000 for tile samples.",)]


def test_search(spark, mails):
    d = mails.where("body is not null").select(F.col("email_id").alias("item"), F.col("body").alias("text"))
    q = spark.createDataFrame([(100, "boiler manual"), (101, "210000")], "query bigint, text string")
    for mode in ("dense", "sparse", "hybrid"):
        hits = hybrid(q, d, mode)
        assert {r["item"] for r in hits.where("query = 100 and rank <= 2").collect()} == {1, 3}
    assert hybrid(q, d, "sparse").where("query = 101 and rank = 1").first()["item"] == 2
    assert rerank(hybrid(q, d), lexical_overlap, d, q, 1).where("query = 100").first()["item"] == 1
    c = mails.where("body is not null").select(F.col("email_id").alias("item"), F.lit("t").alias("thread_id"), "message_id", F.col("email_id").alias("ordinal"), F.lit(None).cast("timestamp").alias("sent_at"), "sender", F.col("body").alias("text"))
    t = threads_of(hybrid(q, d), c, 1).collect()
    assert len(t) == 2 and all(r["n_emails"] == 3 for r in t)
    with pytest.raises(ValueError):
        hybrid(q, d, "other")


def test_steps(spark):
    j = spark.createDataFrame([("a", 1)], "message_key string, v int")
    e = spark.createDataFrame([("a",), ("b",)], "message_key string")
    got = judged(e, j, lambda w: w.withColumn("v", F.lit(9)))
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 9)}
    df = spark.range(10)
    assert [r["id"] for r in work_bounded(df, ["id"], F.col("id") % 2 == 1, 2).orderBy("id").collect()] == [0, 1, 2, 3]
    assert run_recipe({"a": lambda s: s | {"x": 1}}, ["a"], {}) == {"x": 1}
    with pytest.raises(ValueError):
        run_recipe({}, ["a"], {})
