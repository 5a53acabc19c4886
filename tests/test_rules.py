import pytest
from pyspark.sql import functions as F

from threadloom.functions import rules as R


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def n(x):
    return F.lit(x).cast("int")


def test_misses(spark):
    for ranks, want in (((2, 0, 0, 0), "covered"), ((3, 9, None, None), "budget"), ((None, 10, 19, None), "fusion"), ((None, None, None, 19), "fusion"), ((None, 10, 20, None), "hard"), ((None,) * 4, "hard")):
        assert one(spark, R.miss_bucket(*map(n, ranks))) == want
    assert one(spark, R.root_cause(n(9))) == "vocab_gap" and one(spark, R.root_cause(n(10))) == one(spark, R.root_cause(n(None))) == "index_or_chunking"
    assert one(spark, R.bad_query(n(None), F.lit(0.14))) and not one(spark, R.bad_query(n(None), F.lit(0.15))) and not one(spark, R.bad_query(n(0), F.lit(0.0)))


def test_decisions():
    gains = {"t": {"terse": 0.5, "spanning": 0.6, "content": 0.7}, "c": {"terse": 0.52, "spanning": 0.5, "content": 0.7}}
    assert R.decisions(gains, "t", ["c"]) == {"retire": True, "bound": False}
    assert R.decisions(gains | {"c": {"content": 0.71}}, "t", ["c"], 10.1) == {"retire": False, "bound": True}
    assert R.decisions({}, "t", [], 10.0) == {"retire": True, "bound": False}
    assert [R.default_clusters(x) for x in (2, 8, 200, 10**6)] == [2, 2, 10, 50] and R.default_clusters(100, 7) == 7 and R.default_clusters(5, 90) == 5
    assert R.recommended_persona(0.3, 0.2) == "llm-verify" and R.recommended_persona(0.1, 0.2) == "llm-all"


def test_predicates(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, R.false_noise(F.lit(True), s("Your Receipt"), s(None), s(None))) and not one(spark, R.false_noise(F.lit(None).cast("boolean"), s("receipt"), s(None), s(None)))
    assert one(spark, R.false_keep(F.lit(False), s("Big SALE"), s("order"), s(None))) and not one(spark, R.false_keep(F.lit(False), s("sale receipt"), s(None), s(None)))
    q = F.array(F.lit("q"))
    assert one(spark, R.usable(q, F.lit("x" * 121))) and not one(spark, R.usable(q, F.lit("x" * 120))) and not one(spark, R.usable(F.array(), F.lit("x" * 200)))
    assert not one(spark, R.wanted_role(F.lit("junk"), ["junk"], ["junk"])) and one(spark, R.wanted_role(F.lit("a"), [], ["junk"])) and not one(spark, R.wanted_role(F.lit("a"), ["b"], []))
    now = F.lit("2024-01-01 04:00:00").cast("timestamp")
    for last, want in (("2024-01-01 00:24:00", True), ("2024-01-01 00:25:00", False), (None, True), ("never", True)):
        assert one(spark, R.is_due(F.lit(14400), s(last), now)) is want
    df = spark.createDataFrame([(0,), (7200,), (3600,), (None,)], "c int")
    assert R.shortest_cadence(df, "c") == 3600
    with pytest.raises(ValueError):
        R.shortest_cadence(df.where("c = 0"), "c")


def test_texts(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, R.address_preview(s('"B, A" <a@x>, b@y; a@x'))) == "a@x, b@y" and one(spark, R.address_preview(s("nobody"))) == "nobody" and one(spark, R.address_preview(s(None))) == ""
    assert one(spark, R.payload_body(s('{"text": "", "_node_content": "{\\"text\\": \\"inner\\"}"}'))) == "inner" and one(spark, R.payload_body(s("no json"))) == "" and one(spark, R.payload_body(s('{"text": "t"}'))) == "t"
    assert one(spark, R.storable(s("a\0bcd"), 3)) == "a�b" and one(spark, R.storable(s(None), 3)) == ""
    p = one(spark, R.prompt("judge", query=s("why {x}?"), body=s(None)))
    assert "why {x}?" in p and "{" not in p.replace("{x}", "")
    lines = F.array(*map(F.lit, "abcd"))
    assert one(spark, R.bounded_thread(lines, 3, F.length)) == ["a", "[2 messages left out]", "d"] and one(spark, R.bounded_thread(lines, 4, F.length)) == list("abcd")


def test_failures_and_arguments():
    wrapped = RuntimeError("x")
    wrapped.__cause__ = ConnectionResetError()
    assert R.failure_class(wrapped) == R.failure_class(TimeoutError()) == "unavailable" and R.failure_class(ValueError()) == R.failure_class(FileNotFoundError()) == "error"
    assert R.failure_is_permanent(PermissionError()) and not R.failure_is_permanent(ValueError())
    assert R.argument_summary({"a": None, "b": "x" * 201, "c": 3, "d": [1]}) == {"b": "x" * 200 + "…", "c": 3, "d": "<list>"} and R.argument_summary({"b": "x"}, True) == {"b": "<str>"}
