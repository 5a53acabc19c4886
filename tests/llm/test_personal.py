import numpy as np
import pytest

from threadloom.llm.boost import Boosted
from threadloom.llm.encodings import garble
from threadloom.llm.personal import Finder, build_lexicon, find_personal, fit, header_names, mail_candidates, name_candidates, number_candidates, redact_personal, street_candidates


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (3000, 5))
    y = ((x[:, 1] > 3) ^ (x[:, 3] <= 2)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000]).calibrate(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= m.threshold) == (y[2000:] > 0)).mean() > 0.98
    assert Boosted().fit(x[:0], y[:0]).score(x[:3]).max() < 0.5


def test_trees_scored_together_as_one_by_one():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 32, (1100, 6))
    m = Boosted().fit(x, ((x[:, 0] > 9) ^ (rng.random(1100) < 0.2)).astype(float))
    z = np.full(len(x), m.base)
    for feature, cut, leaf in zip(m.feature, m.cut, m.leaf):
        for i, row in enumerate(x):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            z[i] += leaf[node - len(feature)]
    for most in (1, 7, 512, 5000):
        assert np.array_equal(m.score(x, most), 1 / (1 + np.exp(-z)))
    assert len(m.score(x[:0])) == 0


@pytest.mark.parametrize(
    "text", ["1065 Slipway Lane, Tarnstead 00883", "Unit 6, 88 Slipway Lane, Tarnstead 00100", "97 Old Weir Rd., Apt 4B, Osk Harbor 00355", "1765 Quill Street, Marrby MX264", "37 bis, quai de l’Écluse, 00864 Montdreuil", "14 rue des Tisserands, 00807 Valcelle", "Lindenweg 90, 00515 Oberau", "Werkhofstr. 76, 00834 Wolkeder", "Am Mühltor 151, 00245 Grünrath", "Avda. Peñaares, 117, 00133 Olmeda", "Calle del Molino 126, 00030 Villalba del Muelle", "Rua da Eclusa, 111, 00471-000 Serrinho", "솔내구 부두길 155, 814호"]
)
def test_streets(text):
    s = f"See here: {text}, not there"
    assert [s[a:b] for a, b, _ in street_candidates(s)] == [text]


def test_candidates():
    assert [m[:2] for m in mail_candidates("a.b@x.example, c (at) d (dot) test")] == [(0, 13), (15, 34)]
    assert not number_candidates("Version 67.10.76") and len(number_candidates("ring +44 20 7946 0120.")) == 1
    assert [n for n, _, _ in header_names('"Doe, Jo" <j@x>; Al B <a@x>, c@x (Cy D)')] == ["Doe, Jo", "Al B", "Cy D"]
    lex = build_lexicon(["Ines Marrby <i@x>", "피도현 <p@x>"], [])
    text = "Ines Marrby met I. Marrby and 피도현님."
    assert [text[a:b] for a, b, _ in name_candidates(text, lex)] == ["Ines Marrby", "I. Marrby", "피도현"]


@pytest.fixture(scope="module")
def mails(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/thread_emails.parquet").select("email_id", "body", "to_text", "cc_text", "sender").collect()]
    body = "Hi Rose,\n\nMark the crate. Grace period ends. I spoke to Mark about it. Part no. 198-28-2591 fits the box.\nThe permit lists Jörg Wolkhauer with ID 902-84-1133. My new number is +1 866 555 0127, the old one is dead.\nLog line was: Message-ID: <253799094.1663@relay.quarrypost.example>\nWrite to rhalstead1951 [at] ostrelgrow.example\nUnit 6, 88 Slipway Lane, Tarnstead 00100\n"
    extra = [(-1, body, '"Wickwick, Hope" <hope653@alderpost.example>', None, ""), (-2, None, "", None, None), (-3, garble("Gruß an Jürgen Wolkhauer"), None, None, None), (-4, "x " * 100_000 + "call +1 866 555 0127", "", "", "")]
    return spark.createDataFrame(rows + extra, "email_id bigint, body string, to_text string, cc_text string, sender string").cache()


def test_found(mails):
    got = {}
    for r in find_personal(mails).where("email_id < 0").collect():
        got.setdefault(r["email_id"], set()).add((r["field_name"], r["pii_type"], r["pii_text"]))
    assert got[-1] == {
        ("body", "name", "Rose"), ("body", "name", "Mark"), ("body", "name", "Jörg Wolkhauer"), ("body", "id_number", "902-84-1133"), ("body", "phone", "+1 866 555 0127"),
        ("body", "email", "rhalstead1951 [at] ostrelgrow.example"), ("body", "street", "Unit 6, 88 Slipway Lane, Tarnstead 00100"), ("to_text", "name", "Wickwick, Hope"), ("to_text", "email", "hope653@alderpost.example"),
    }
    assert got[-3] == {("body", "name", garble("Jürgen Wolkhauer"))} and got[-4] == {("body", "phone", "+1 866 555 0127")} and -2 not in got


def test_redacted(mails):
    got = {r["email_id"]: r for r in redact_personal(mails).where("email_id < 0").collect()}
    assert got[-1]["body"].startswith("Hi [NAME],\n\nMark the crate.") and got[-1]["to_text"] == '"[NAME]" <[EMAIL]>' and got[-1]["cc_text"] is None
    assert got[-2]["body"] is None


def test_empty(spark):
    df = spark.createDataFrame([], "email_id bigint, body string, to_text string, cc_text string, sender string")
    assert find_personal(df).count() == 0


def test_names_of_every_header_and_body(spark, mails):
    """Far more e-mails than the sample: a surname in one header only, in one sender only, or in bodies only, is found whole."""
    ends = ["arn", "elk", "ist", "orp", "und", "yle", "ask", "eft", "irm", "ond"]
    rare = [f"Zq{a}{b}" for a in ends for b in ends[:3]]
    columns = "email_id bigint, body string, to_text string, cc_text string, sender string"
    rows = []
    for i, last in enumerate(rare):
        header = f"Heike {last} <h{i}@x.example>"
        rows.append((-100 - i, "See below.\n", *[(header, None, "a@x.example"), (None, header, "a@x.example"), (None, None, header)][i % 3]))
        rows.append((-200 - i, f"Yesterday I spoke to Heike {last} about it.\n", "", "", ""))
    rows += [(-300 - i, "Yesterday I spoke to Heike Wrzoldan about it.\n", "", "", "") for i in range(2)]
    got = find_personal(mails.where("email_id > 0").unionByName(spark.createDataFrame(rows, columns)), sample=150).where("email_id < -99 and pii_type = 'name'").collect()
    body = {r["email_id"]: r["pii_text"] for r in got if r["field_name"] == "body"}
    assert body == {-200 - i: f"Heike {last}" for i, last in enumerate(rare)} | {-300: "Heike Wrzoldan", -301: "Heike Wrzoldan"}
    heads = {r["email_id"]: r["pii_text"] for r in got if r["field_name"] != "body"}
    assert heads == {-100 - i: f"Heike {last}" for i, last in enumerate(rare) if i % 3 < 2}


def test_run_of_which_one_word_is_known():
    lex = build_lexicon(["Ines Marrby <i@x>", "피도현 <p@x>", "김서윤 <k@x>"], ["I met Ines Wrzoldan and Xaver Marrby.", "Ines Rechnung", "Die Rechnung, die Rechnung."])
    text = "Then Ines Wrzoldan; Xaver Marrby; Ines Rechnung; Wrzoldan and 김도현님."
    assert [text[a:b] for a, b, _ in name_candidates(text, lex)] == ["Ines Wrzoldan", "Xaver Marrby", "Ines", "Wrzoldan", "김도현"]


def test_names_that_no_header_holds(mails):
    """Where their surroundings show them, names of which no list knows a word are found; plain capitalised runs are not."""
    texts = ["From: Priya Raghunathan <p@x.example>\nSent: today\nTo: Zebulon Quistgaard", "On 3 May 2024 at 10:00, Wei Zhang wrote:\n> hi", "best regards,\nDmitri Volkov\n", "Close Harbor Gate and the Annual Report.\nFalls Gerüst da ist. 221B Baker Street, London NW1 6XE"]
    rows = [(-500 - i, t, None, None, None) for i, t in enumerate(texts)]
    got = find_personal(mails.unionByName(mails.sparkSession.createDataFrame(rows, mails.schema))).where("email_id <= -500").collect()
    assert {(r["email_id"], r["pii_text"]) for r in got if r["pii_type"] == "name"} == {(-500, "Priya Raghunathan"), (-500, "Zebulon Quistgaard"), (-501, "Wei Zhang"), (-502, "Dmitri Volkov")}
    assert {(r["email_id"], r["pii_text"]) for r in got if r["pii_type"] == "street"} == {(-503, "221B Baker Street, London NW1 6XE")}


def test_candidates_are_held_by_portions(mails, monkeypatch):
    """A large batch is searched in portions, with the spans that each text has alone."""
    rows = [tuple(v or "" for v in r) for r in mails.where("email_id > 0").orderBy("email_id").limit(1500).drop("email_id").collect()]
    finder = fit(rows[:300], build_lexicon([h for r in rows for h in r[1:]], [r[0] for r in rows]))
    texts = [r[0] for r in rows]
    alone = [finder.find([t], [frozenset()])[0] for t in texts]
    most, accept = [], Finder._accept
    monkeypatch.setattr(Finder, "_accept", lambda self, kind, wanted: (most.append(len(wanted)), accept(self, kind, wanted))[1])
    assert sum(map(len, texts)) > 4 * 250_000
    assert finder.find(texts, [frozenset()] * len(texts)) == alone and sum(map(len, alone)) > 5000
    assert max(most) < sum(map(len, alone)) // 3


def test_places_that_digits_show():
    """Of a line only digits that may be a house number, a postcode or a unit lead to the search of streets."""
    import threadloom.llm.personal as p

    runs = lambda t: [m[0] for m in p._PLACE.finditer(t)]
    assert runs("on 12 May 2024 at 10:33, INV-48968 and WO-831 of 1200345 pcs, 5 boxes") == ["12", "831"]
    assert runs("97B Old Weir Rd., 00355 Osk; MX264; 814호; 4 Quay St") == ["97", "00355", "264", "814호", "4"]
    assert p._cue(" fax, passport ") == (2, 14) and p._cue(" passport, tel: ") == (1, 15) and p._cue(" my new telefon ") == (1, 15) and p._cue("none") == (0, -1)
