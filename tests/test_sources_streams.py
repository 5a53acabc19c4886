import os
import subprocess
import sys
from pathlib import Path

import pytest

from threadloom.operators import mail as M
from threadloom.operators.chunking import check_policy, chunks, deduplicated, pack_units, replace_documents
from threadloom.operators.retrieval import fuse, ranked
from threadloom.sources.mail_files import attachments, eml_files, hash_list, mbox_messages, parse_emails, spool, strip_preamble
from threadloom.sources.maildir import MaildirSource
from threadloom.streaming.ledger import lifecycle, table_writer, windowed_counts
from pyspark.sql import functions as F

ONE = b"""From x Mon Jan 1\n123\nFrom: =?utf-8?q?J=C3=B6rg?= <j@x>\nTo: a@b\nSubject: Hi\nMessage-ID: <1@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html; charset=utf-8\n\n<p>caf\xc3\xa9</p>\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=n.txt\n\nabc\n--B--\n"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.eml").write_bytes(ONE)
    (tmp_path / "a/2.EML").write_bytes(b"Subject: two\n\nbody\n")
    (tmp_path / "a/x.txt").write_bytes(b"no")
    return tmp_path


def test_eml(spark, folder):
    files = eml_files(spark, str(folder))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in parse_emails(files).collect()}
    assert set(rows) == {"1.eml", "2.EML"} and eml_files(spark, str(folder), any_case=False).count() == 1
    assert rows["1.eml"]["sender"] == "Jörg <j@x>" and rows["1.eml"]["body"] == "café" and rows["1.eml"]["n_attachments"] == 1
    a = attachments(files).collect()
    assert [(x["filename"], bytes(x["data"]).strip()) for x in a] == [("n.txt", b"abc")]
    assert strip_preamble(b"plain") == b"plain"


def test_mbox_hashes_spool(spark, tmp_path):
    (tmp_path / "m.mbox").write_bytes(b"From a@b Mon Jan  1 00:00:00 2024\nSubject: 1\n\nx\n\nFrom a@b Mon Jan  1 00:00:00 2024\nSubject: 2\n\ny\n")
    got = parse_emails(mbox_messages(spark, str(tmp_path / "m.mbox")))
    assert sorted(r["subject"] for r in got.collect()) == ["1", "2"]
    (tmp_path / "h.txt").write_text("# c\n\nabc # d\nabc\n")
    assert [r[0] for r in hash_list(spark, str(tmp_path / "h.txt")).collect()] == ["abc"]
    df = spark.createDataFrame([("k1", None), ("k2", "2024-03-01")], "message_key string, t string").withColumn("ts", F.to_timestamp("t"))
    for _ in range(2):
        spool(df, str(tmp_path / "spool"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "spool")).select("message_key", F.col("year").cast("string"), "month").collect())[1][1] == "2024"
    assert spark.read.parquet(str(tmp_path / "spool")).count() == 2


def test_maildir_stream_resumes(spark, tmp_path):
    box = tmp_path / "box"
    (box / "new").mkdir(parents=True)
    (box / "new/1").write_bytes(b"Subject: 1\n\nx")
    spark.dataSource.register(MaildirSource)

    def run():
        q = spark.readStream.format("maildir").option("path", str(box)).load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 1
    (box / "new/2").write_bytes(b"Subject: 2\n\ny")
    os.utime(box / "new/2", (4_000_000_000, 4_000_000_000))
    assert run() == 2


def test_lifecycle_stream_equals_batch_fold(spark, tmp_path):
    rows = [(1, "k", 1, "indexed"), (1, "k", 2, "judged"), (1, "k", 3, "indexed"), (1, "m", 1, "abandoned"), (1, "m", 2, "judged"), (1, "m", 3, "requeued"), (2, "k", 1, "requeued")]
    schema = "account_id int, message_key string, order_no int, event string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = lifecycle(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("lc").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["account_id"], r["message_key"]): r["state"] for r in spark.table("lc").collect()}
    batch = M.fold_events(spark.createDataFrame(rows, schema), ["account_id", "message_key"], "order_no", "event")
    assert got == {(r["account_id"], r["message_key"]): r["state"] for r in batch.collect()} == {(1, "k"): "done", (1, "m"): "new", (2, "k"): "new"}


def test_table_writer_is_idempotent(spark, tmp_path):
    write = table_writer(str(tmp_path / "t"), ["k"], "v")
    write(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, v int"), 0)
    for _ in range(2):
        write(spark.createDataFrame([(1, 9), (3, 3)], "k int, v int"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/version=1")).collect())) == [(1, 9), (2, 1), (3, 3)]


def test_windowed_counts_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = windowed_counts(s, "ts", "1 hour", None, "2 hours", ["k"]).writeStream.outputMode("complete").format("memory").queryName("wc").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.table("wc").collect()) == [("a", 2), ("b", 1)]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "a" * 30 + "\n" + "b" * 30 + "\n\n" + "c" * 300), (2, ""), (3, None)], "id int, t string")
    rows = chunks(docs, "id", "t", 20).orderBy("doc_key", "ordinal").collect()
    assert [(r["doc_key"], r["ordinal"], len(r["text"])) for r in rows] == [("1", 0, 61), ("1", 1, 300)]
    assert spark.range(1).select(pack_units(F.array().cast("array<string>"), 5)).first()[0] == []
    again = chunks(docs, "id", "t", 1000)
    assert deduplicated(again.unionByName(again)).count() == again.count()
    assert replace_documents(again, again.limit(0)).count() == again.count()
    with pytest.raises(ValueError):
        check_policy("a", "b")


def test_fusion_and_selection(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.5)], "query int, item string, score double")
    r = ranked(hits, "d")
    assert [(x["item"], x["rank"]) for x in r.orderBy("rank").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    top = fuse([(r, 1.0), (r.where("item = 'c'").withColumn("rank", F.lit(0)), 1.0)], top=2).orderBy("rank").collect()
    assert [x["item"] for x in top] == ["c", "a"] and top[0]["score"] == pytest.approx(1 / 63 + 1 / 61)
    with pytest.raises(ValueError):
        fuse([(r, 1.0)], p=0.5)
    with pytest.raises(ValueError):
        M.selection(F.col("p"), [{"type": "nope"}])


def test_core_does_not_import_the_subpackage():
    root = Path(__file__).resolve().parents[1]
    names = [".".join(p.relative_to(root).with_suffix("").parts) for p in (root / "threadloom").rglob("*.py") if "llm" not in p.parts and p.stem != "__init__"]
    code = f"import sys, importlib\nfor n in {names!r}: importlib.import_module(n)\nassert not any(n.startswith('threadloom.llm') for n in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
