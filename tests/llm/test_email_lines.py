import numpy as np

from threadloom.llm.email_lines import HEADED, INTRO, NEW, NOTICE, QUOTED, SIGNATURE, Lines, copied, evidence_agreement, fit, heuristic, label, label_lines, new_text, portions

MAIL = """[EXTERNAL] This mail comes from outside. Be careful with links.\r
\r
Hi Rose,\r
\r
Two of the 48 pallets were fragile.\r
-----\r
From: the mill to pier C is 5 minutes on foot.\r
\r
Best regards,\r
Will\r
-- \r
Will Halcroft | Buyer\r
+1 878 555 0193\r
\r
Sent from my handset\r
\r
On Mon, Oct 21, 2024 at 04:49, Rose Lodwick\r
<rose@x.example> wrote:\r
> Hello Will,\r
>\r
> Thanks,\r
> Rose"""


def roles(text):
    x = Lines([text])
    return dict(zip(x.number.tolist(), heuristic(x).tolist()))


def test_annotation_of_a_typical_mail():
    r = roles(MAIL)
    assert [r[i] for i in (1, 3, 5, 6, 7)] == [NOTICE, NEW, NEW, NEW, NEW]
    assert [r[i] for i in (9, 10, 11, 12, 13, 15)] == [SIGNATURE] * 5 + [NOTICE]
    assert [r[i] for i in (17, 18, 19, 20, 21, 22)] == [INTRO, INTRO, QUOTED, QUOTED, QUOTED, QUOTED]
    assert 2 not in r


def test_headed_quote_runs_to_the_end():
    r = roles("Ok.\n\n-----Original Message-----\nFrom: A B <a@b>\nSent: 2022-01-27 10:17\n\nplain text\n\nmore")
    assert r[1] == NEW and all(r[i] == HEADED for i in (3, 4, 5, 7, 9))


def test_replies_between_quotes_are_new():
    r = roles("A B <a@b> writes:\n> one\n\nmy answer.\n\n> two\n\nnext answer.")
    assert r == {1: INTRO, 2: QUOTED, 4: NEW, 6: QUOTED, 8: NEW}


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/thread_emails.parquet").select("body").collect()
    bodies = [r["body"] for r in rows]
    a, b = Lines(bodies[: len(bodies) // 2]), Lines(bodies[len(bodies) // 2 :])
    model = fit(a, heuristic(a))
    _, got = label(model, bodies[len(bodies) // 2 :])
    want = heuristic(b)
    assert ((got != NEW) == (want != NEW)).mean() > 0.995


def test_operator_and_edges(spark):
    df = spark.createDataFrame([(1, MAIL, 9), (2, None, 9), (3, "", 9), (4, " \n\r\n\t\n", 9), (1, MAIL, 9), (5, "word " * 60_000, 9)], "email_id bigint, body string, line_no int")
    got = [tuple(r) for r in label_lines(df).select("email_id", "line_no").collect()]
    assert {e for e, _ in got} <= {1} and len(got) == 2 * len(set(got))
    texts = {r["email_id"]: r["new_text"] for r in new_text(df).collect()}
    assert texts[2] == texts[3] == texts[4] == "" and len(texts[5]) == 300_000 - 1
    assert label_lines(df.limit(0)).count() == 0


def test_decoding_equals_exhaustive_search():
    from itertools import product

    from threadloom.llm.email_lines import LineModel, STATES

    rng = np.random.default_rng(0)
    m = LineModel([4])
    m.t = rng.normal(size=m.t.shape).astype(np.float32)
    e = rng.normal(size=(9, len(STATES))).astype(np.float32)
    first = np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    got = m.decode(e, first)
    for a, z in ((0, 4), (4, 5), (5, 9)):
        def total(s):
            t = m.t[-1, s[0]] + sum(e[a + i, v] for i, v in enumerate(s))
            return t + sum((-1e6 if p == HEADED and q != HEADED else m.t[p, q]) for p, q in zip(s, s[1:]))

        assert tuple(got[a:z]) == max(product(range(len(STATES)), repeat=z - a), key=total)


def test_copies_of_the_answered_message():
    x = Lines(["New line of my own here, longer than that.\nThe first line of the earlier message.\nAnd the second one of the earlier message.\n\nshort", "The first line of the earlier message.\nMine, and long enough to be telling.", "> The first line of the earlier message.\n> And the second one of the earlier message."])
    parent = "Hello\r\nThe first line of the earlier message.\r\nAnd the second one of the earlier message.\r\nshort"
    assert copied(x, [parent, parent, parent]).tolist() == [False, True, True, False, False, False, True, True]
    assert not copied(x, [None, None, None]).any() and not len(copied(Lines([]), []))


def test_portions():
    assert list(portions(["aa", None, "bbbb", "c", "d" * 9], 4)) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(portions([])) == []


def test_agreement_with_answered_messages(spark):
    """Accuracy on lines that stand word for word in the answered message: evidence the annotation has no part in."""
    emails = spark.read.parquet("/root/testdata/sf0.01/thread_emails.parquet")
    n, share = evidence_agreement(emails, "email_id", "body", ("account_id", "message_id", "in_reply_to"))
    assert n > 1000 and share > 0.995


def test_unmarked_copies_are_taught(spark):
    """A style of quoting that the reading does not know: earlier mail under a row of stars, unmarked.  The answered messages teach it."""
    rows = []
    for i in range(400):
        first = [f"Item {i} of the list was counted by us on floor {i % 7}.", f"Please send the papers for lot {i} to the office.", f"The lid of box {i} does not close any more."]
        rows.append((2 * i, 1, f"m{i}", None, "\n".join(first)))
        rows.append((2 * i + 1, 1, f"r{i}", f"<m{i}>", f"We have sent what you asked for, number {i}.\n\n** ** **\n" + "\n".join(first)))
    df = spark.createDataFrame(rows, "email_id bigint, account_id int, message_id string, in_reply_to string, body string")
    got = {}
    for r in label_lines(df, reply=("account_id", "message_id", "in_reply_to")).where("email_id % 2 = 1").collect():
        got.setdefault(r["email_id"], set()).add(r["line_no"])
    assert np.mean([{4, 5, 6} <= got.get(2 * i + 1, set()) for i in range(400)]) > 0.95
    assert np.mean([1 not in got.get(2 * i + 1, set()) for i in range(400)]) > 0.95
    assert label_lines(df).where("line_no >= 4").count() == 0
