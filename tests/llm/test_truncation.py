import random

import numpy as np
import pytest

from threadloom.llm.linear import HashedLogistic, slot
from threadloom.llm.truncation import _fitted, cut_documents, ending, features, last_line, last_word, limits, strip_notice, vocabulary


@pytest.mark.parametrize("text, want", [("so let us ho\n\n[View entire message]", ("so let us ho", "notice")), ("the mil...", ("the mil", "dots")), ("done. …", ("done.", "spaced dots")), ("ok.\n(TK-75759)", ("ok.\n(TK-75759)", "")), ("", ("", ""))])
def test_notices(text, want):
    assert strip_notice(text) == want


def test_ends():
    assert last_word("the Mil...") == "mil" and last_word("end.") == "" and last_word("l’écluse") == "l’écluse"
    assert last_line("a\n3. la pieza ") == "la pieza" and last_line("x" * 200) == ""


def test_logistic_learns():
    rng = random.Random(1)
    rows = [np.array([slot(f"a{y}"), slot(f"n{rng.randrange(50)}")]) for y in (0, 1) * 200]
    m = HashedLogistic().fit(rows, np.array([0.0, 1.0] * 200))
    assert ((m.score(rows) > 0.5) == np.array([False, True] * 200)).all()


def test_made_cuts_are_found_and_intact_texts_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "content_kind")
    rows = [tuple(r) for r in docs.collect()]
    closed = [r for r in rows if r[1].rstrip().endswith(".") and not r[1].endswith("..") and len(r[1]) > 120]
    cut = [(10**6 + r[0], r[1][: len(r[1]) * 2 // 3].rstrip(" .,!?:;\n\r"), r[2], r[3]) for r in closed[:100]]
    odd = [(-1, None, None, None), (-2, "", None, None), (-3, " \n", "s", "k")]
    df = spark.createDataFrame(rows + cut + odd, "doc_id bigint, text string, source string, content_kind string")
    got = {r["doc_id"]: r["is_cut"] for r in cut_documents(df).collect()}
    assert not {-1, -2, -3} & set(got) and len(got) == len(rows) + len(cut)
    assert np.mean([got[c[0]] for c in cut]) > 0.85
    assert np.mean([got[r[0]] for r in closed]) < 0.02


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string, content_kind string")
    assert cut_documents(df).count() == 0


def test_vocabulary_of_odd_and_very_long_texts(spark):
    long_line, blanks = "ab cd " * 60_000, "x" + " " * 200_000 + "y"
    texts = ["one two\n- three four\nlast word ", "one’s -", "a\n\n2) b \n \n", "", None, " \n", long_line, blanks, "x" * 100_000 + "\nend"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["item"]: r["count"] for r in vocabulary(df, "text").collect()}
    want = {"one": 1, "\none two": 1, "three": 1, "four": 1, "two": 1, "\nthree four": 1, "last": 1, "one’s": 1, "a": 1, "2": 1, "\na": 1, "ab": 60_000, "cd": 59_999, "x": 1, "x" * 100_000: 1}
    assert got == want


@pytest.mark.parametrize("text", ["a\nb\nc\nd\ne...", "x\n\n\n[View entire message]", "w\nv [truncated]", "one", "a\n\n\nb  \n"])
def test_an_ending_reads_like_its_text(text):
    assert strip_notice(ending(text))[1] == strip_notice(text)[1]
    assert (features(ending(text), False, False, "k", 3, 0) == features(text, False, False, "k", 3, 0)).all()


def test_a_cut_word_before_a_notice_is_no_word_inside_a_text(spark):
    texts = ["so let us ho\n\n[View entire message]", "the mil...", "a barn <more> ", "x\nend of li …\n", "see [1] now", "....", "\n[…]"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["item"]: r["count"] for r in vocabulary(df, "text").collect()}
    assert got == {"so": 1, "let": 1, "us": 1, "the": 1, "a": 1, "x": 1, "\nx": 1, "end": 1, "of": 1, "see": 1, "1": 1}


def test_copies_of_a_text_make_no_limit(spark):
    rows = [("s", "x" * 90)] * 50 + [("s", f"{i:02}" + "y" * 48) for i in range(9)]
    df = spark.createDataFrame(rows, "src string, text string").selectExpr("*", "length(text) _c", "octet_length(text) _b")
    assert {(r["unit"], r["n"]) for r in limits(df).collect()} == {("c", 50), ("b", 50)}


def test_every_document_is_fitted_on(spark):
    """Each row has a slot of its own beside its class's: all of them get a weight, in one shard or in many."""
    rows = [(k, y, [10 + y, 1000 + 2 * k + y]) for k in range(3000) for y in (0, 1)]
    df = spark.createDataFrame(rows, "_key bigint, y int, x array<int>")
    for shard in (1000, 5000):
        m = _fitted(df, 3000, shard)
        assert m.w[10] < -0.5 and m.w[11] > 0.5
        assert (m.w[1000:7000] != 0).all() and np.flatnonzero(m.w).size == 6002


def test_shards_find_what_one_fit_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, many = ({r[0] for r in cut_documents(docs, shard=n).where("is_cut").select("doc_id").collect()} for n in (20_000, 350))
    assert len(one & many) > 0.9 * len(one | many)
