import pytest
from pyspark.sql import functions as F

from threadloom.operators import reporting as R


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_suspects_and_noise(spark):
    c = spark.createDataFrame([(0.9, 3, [(["a", "b"],), (["b"],)]), (0.7, 1, [(["b", "c"],)]), (0.1, 6, [(["d"],)])], "score double, size int, members array<struct<paths:array<string>>>")
    assert {tuple(r) for r in R.suspects(c, 0.5).collect()} == {("a", 0.9), ("b", 0.9), ("c", 0.7)}
    assert R.obvious_noise(c).first()[0] == 0.4 and R.obvious_noise(c.limit(0)).first()[0] == 0.0


def test_small_rules(spark):
    assert one(spark, R.warnings(F.lit(30.0), F.lit("error"))) == ["no success for 30 hours", "the last run failed"]
    assert one(spark, R.warnings(F.lit(None).cast("double"), F.lit("ok"))) == ["never succeeded"]
    assert one(spark, R.sparse_text(F.lit(10), F.lit(100_000), F.lit("image/png"))) and not one(spark, R.sparse_text(F.lit(10), F.lit(100_000), F.lit("Text/plain")))
    assert one(spark, R.embed_text(F.lit("s"), F.lit("t"))) == "s\n\nt" and one(spark, R.embed_text(F.lit(None).cast("string"), F.lit("t"))) == "t"
    assert one(spark, R.encode_limit(F.lit(512))) == 768 and one(spark, R.encode_limit(F.lit(9000))) == 8192
    assert one(spark, R.combine_query("augment", F.lit("q"), F.lit("d"))) == "q\nd" and one(spark, R.combine_query("pure", F.lit("q"), F.lit(" "))) == "q"
    assert one(spark, R.combine_query("pure", F.lit("q"), F.lit(" d\n"))) == "d" and one(spark, R.combine_query("x", F.lit("q"), F.lit("d"))) == "q"
    assert one(spark, R.encode_limit(F.lit(512), False)) == 512 and one(spark, R.encode_limit(F.lit(512), True, 100)) == 100 and one(spark, R.encode_limit(F.lit(1), False, 9999)) == 8192
    assert one(spark, R.embed_text(F.lit(" s \n"), F.lit("t"))) == "s\n\nt" and one(spark, R.embed_text(F.lit(" "), F.lit("t"))) == "t"
    assert one(spark, R.sanitized_query(F.lit(" a_b, Ünï-c\n1 "))) == "a b n c 1"
    r = one(spark, R.header_record(F.lit("From: a@b\r\nSubject: Hi\r\n\r\nbody\n\nmore")))
    assert (r["sender"], r["subject"], r["body"]) == ("a@b", "Hi", "body\n\nmore")


def test_slice_keeps_gold(spark):
    t = spark.createDataFrame([(f"t{i}", 1 + i % 3) for i in range(300)], "thread_id string, n_emails int")
    gold = t.where("thread_id in ('t1', 't2', 't299')")
    got = R.slice_with_gold(t, gold, 100).collect()
    assert {"t1", "t2", "t299"} <= {r["thread_id"] for r in got} and 95 <= sum(r["n_emails"] for r in got) <= 100
    assert R.slice_with_gold(t, gold, 10_000).count() == 300 and R.slice_with_gold(t, gold, 1).count() == 3


def test_sample_and_set(spark, tmp_path):
    df = spark.range(100)
    a = [r[0] for r in R.seeded_sample(df, "id", 10, 1).collect()]
    assert a == [r[0] for r in R.seeded_sample(df.repartition(7), "id", 10, 1).collect()] and len(a) == 10
    p = str(tmp_path / "set")
    assert R.append_new(p, df.where("id < 5"), "id") == 5 and R.append_new(p, df.where("id < 8"), "id") == 3
    (tmp_path / "x.csv").write_text("a,1\nb,2\n")
    assert [tuple(r) for r in R.table_rows(spark, str(tmp_path / "x.csv")).collect()] == [("a", "1"), ("b", "2")]
