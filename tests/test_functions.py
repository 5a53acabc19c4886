import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.functions import evaluation as E
from threadloom.functions import identity as I
from threadloom.functions import text as X


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("<a@b>", "a@b"), (" \t<a@b>\r\n", "a@b"), ("< a@b >", "a@b"), ("<a", "<a"), ("<>", ""), (None, ""), ("<<a>>", "<a>"), ("　a ", "a")])
def test_message_id(spark, raw, want):
    assert one(spark, I.normalize_message_id(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("s, want", [("Re: Fwd: FW:  Hello   World ", "hello world"), ("RE : x", "x"), (None, ""), ("regarding", "regarding"), ("re:re:", "")])
def test_slug(spark, s, want):
    assert one(spark, I.subject_slug(F.lit(s).cast("string"))) == want


@pytest.mark.parametrize("args, want", [(("<m>", "<p> <q>", "<r1> <r2>", "s"), "r1"), (("<m>", "<p> <q>", "", "s"), "p"), (("<m>", None, None, "s"), "m"), ((None, None, None, "Re: Plan"), "subj:plan"), ((None, "", " ", None), ""), (("m", " ", "", "s"), "subj:s")])
def test_thread_id(spark, args, want):
    assert one(spark, I.thread_id(*[F.lit(a).cast("string") for a in args])) == want


def test_hashes(spark):
    got = one(spark, I.content_sha256(F.lit(" A  b "), F.lit("s"), F.lit("2024-01-01"), F.lit("x \r\ny\t\n\n")))
    assert got == hashlib.sha256(b"A b\0s\x002024-01-01\0x\ny").hexdigest()
    long = "m" * 1000
    assert one(spark, I.message_key(F.lit(long), F.lit("h"))) == "mid-sha256:" + hashlib.sha256(long.encode()).hexdigest()
    ns = uuid.NAMESPACE_URL
    assert one(spark, I.uuid5(ns.hex, F.lit("body:é:0"))) == str(uuid.uuid5(ns, "body:é:0"))


@pytest.mark.parametrize(
    "t, want",
    [("$210,000,000 or 210M", ["210000000"]), ("5MM and 1.5 billion", ["5000000", "1500000000"]), ("in 2024 we had 12 people", []), ("1,234 and 1,234", ["1234"]), ("v1.2.3", []), ("0.5k", ["500"]), ("3.14", []), ("12.50 million", ["12500000"])],
)
def test_numeric_tokens(spark, t, want):
    assert one(spark, X.numeric_tokens(F.lit(t))) == want


def test_cleaning_is_idempotent(spark):
    body = "Hello there, this is a body long enough to stay in place.  \n\n\n\nSee https://x.example/a?utm_source=1&id=2.\n-- \nJo\n"
    once = one(spark, X.clean_body(F.lit(body)))
    assert once.endswith("https://x.example/a?id=2.") and one(spark, X.clean_body(F.lit(once))) == once
    assert one(spark, X.strip_encoded_blobs(F.lit("a " + "A" * 250 + " b"))) == "a   b"
    assert one(spark, X.strip_signature(F.lit("short\n--\nJ"))) == "short\n--\nJ"


def test_html():
    assert X.html_text("<p>a&amp;b</p><script>x()</script><div>c<br>d</div>") == "a&b\n\nc\nd"


def test_small_text_functions(spark):
    assert one(spark, X.cadence_seconds(F.lit("12h"))) == 43200 and one(spark, X.cadence_seconds(F.lit("soon"))) is None
    assert one(spark, X.mime_base(F.lit("Text/HTML; charset=x"))) == "text/html"
    assert one(spark, X.line_snippets(F.lit("a\nthe Cat sat\nb"), "cat")) == ["the Cat sat"]
    assert one(spark, X.lexical_overlap(F.lit("red fox"), F.lit("a Red dog"))) == 0.5


def test_measures(spark):
    g = F.array(*[F.lit(x) for x in (0, 2, 1)])
    dcg = 2 / math.log2(3) + 1 / 2
    assert one(spark, E.ndcg(g, 3)) == pytest.approx(dcg / (2 + 1 / math.log2(3)))
    assert one(spark, E.precision(g, 5, 1)) == 0.4 and one(spark, E.reciprocal_rank(g, 1)) == 0.5
    assert one(spark, E.mcnemar_exact(F.lit(11), F.lit(2))) == pytest.approx(0.0225, abs=1e-4)
    assert one(spark, E.mcnemar_exact(F.lit(12), F.lit(0))) == pytest.approx(0.0005, abs=1e-4)
    hits = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "q int, r int, h boolean")
    assert {x["q"]: x["ap"] for x in E.average_precision(hits, "q", "r", "h").collect()} == {1: pytest.approx((1 + 2 / 3) / 2), 2: 0.0}


def test_tracking_parameters(spark):
    cases = [
        ("see https://example.com/post?utm_source=news&utm_medium=email", "see https://example.com/post"), ("https://example.com/x?fbclid=abc&gclid=def", "https://example.com/x"),
        ("https://shop.example.com/order?order_id=ABC123&utm_campaign=spring", "https://shop.example.com/order?order_id=ABC123"), ("https://example.com/x?UTM_Source=news&keep=1", "https://example.com/x?keep=1"),
        ("Go to https://example.com/x?utm_id=9.", "Go to https://example.com/x."), ("https://example.com/a/b/c", "https://example.com/a/b/c"), ("no links here at all", "no links here at all"),
        ("https://billing.example.com/invoice?ref=INV-2024-001", "https://billing.example.com/invoice?ref=INV-2024-001"), ("https://example.com/x?ref_src=twsrc&utm_id=9&keep=1", "https://example.com/x?keep=1"),
        ("https://e.example/?ref_src=tw&twclid=1&spm=2", "https://e.example/"), ("https://e.example/?q=a%20b", "https://e.example/?q=a+b"), ("http://[foo?utm_source=b", "http://[foo?utm_source=b"), (None, None), ("", ""),
    ]
    df = spark.createDataFrame(cases, "t string, want string")
    assert df.where(~X.strip_tracking(F.col("t")).eqNullSafe(F.col("want"))).collect() == []


def test_measured_transcriptions(spark):
    rows = [("  Hi hi a 42٣ x1y\n", (17 - 2, 2, 1, 4)), ("DESCRIPTION: a red box\nTEXT:  Sale now", (8, 2, 2, 0)), (None, (0, 0, 0, 0)), ("한국 é", (4, 0, 0, 0))]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [tuple(r["m"]) for r in df.select(X.measure(F.col("t")).alias("m")).collect()] == [w for _, w in rows]


def test_long_runs_of_blanks_are_trimmed_in_linear_time(spark):
    t = "a" + " " * 300_000 + "b \t\n  c  \n"
    assert spark.createDataFrame([(t,)], "t string").select(X.normalize_whitespace(F.col("t"))).first()[0] == "a b\n c"
