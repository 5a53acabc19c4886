
import pytest

from threadloom.llm.encodings import garble, repair, repair_fields

#: Correct sentences whose letters one-to-one, double-byte or Cyrillic pairs could explain.
FOREIGN = ["Vi ses på måndag", "smørrebrød på bordet", "nový", "það", "Lý Thái", "ПРИВЕТ", "Čeština je krásný jazyk, příliš žluťoučký kůň", "Þetta er á íslensku", "Привет, как дела", "Ærlig talt, jeg går", "Rječnik Рјечник"]

TEXTS = ["Précisions sur l’écluse – déjà vu", "Übergabe für Stückliste", "Não conformidade, situação", "“ready” costs €82 at 40°C ± 2", "월요일에 일정 안내"]


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_misread_is_restored(text, read):
    assert repair(garble(text, "utf-8", read))[0] == text


@pytest.mark.parametrize("text", TEXTS[:3])
def test_twice_garbled(text):
    assert repair(garble(garble(text), "utf-8", "cp1252"))[0] == text


def test_double_byte_and_single_byte():
    assert repair(garble("한지우 <a@b>", "euc_kr", "cp1252"))[0] == "한지우 <a@b>"
    assert repair("Jörg".encode("cp1252").decode("cp850"))[0] == "Jörg"
    assert repair("AurÚlie")[1] == 1


@pytest.mark.parametrize("text", [*TEXTS, "NÃO MEXER: SITUAÇÃO", "CHÂTEAU", "3,5 m² und 2 m³", "Ça va ? À bientôt", "été à l’hôtel", "", "plain", "¿Qué?", "1º e 2ª", "┌──┐"])
def test_correct_text_is_left_alone(text):
    assert repair(text) == (text, 0, False)


def test_mixed_text_changes_only_spans():
    assert repair("déjà and cafÃ©")[0] == "déjà and café"
    assert repair("caf� at dÃ©pÃ´t") == ("caf� at dépôt", 2, True)


def test_operator(spark):
    rows = [(1, "cafÃ©", None, "x"), (2, "", "caf�", "y"), (3, "ok", "été", None), (4, "x" * 100_000 + "Ã©", "fine", "z")]
    df = spark.createDataFrame(rows, "email_id bigint, subject string, body string, text string")
    got = {(r["email_id"], r["field_name"]): (r["restored"], r["lost"]) for r in repair_fields(df, "email_id", ["subject", "body"]).collect()}
    assert set(got) == {(1, "subject"), (2, "body"), (4, "subject")}
    assert got[1, "subject"] == ("café", False) and got[2, "body"] == ("caf�", True)
    assert repair_fields(df.limit(0), "email_id", ["subject"]).count() == 0


def test_every_repaired_single_character_is_suspicious(spark):
    from threadloom.llm.encodings import SINGLE_BYTE, _table, suspicious

    read = sorted({c for _, enc in SINGLE_BYTE for c in _table(enc)[0x80:]})
    beside = ["", " ", "a", "Z", "é", "É", "º", "ﬁ", "5", "²", "."]
    texts = [b + g + a for g in read for b in beside for a in beside]
    assert repair("caf" + "é".encode("cp1252").decode("cp437"))[0] == "café"
    wanted = [t for t in texts + ["caf" + "é".encode("cp1252").decode("cp437")] if repair(t)[1]]
    df = spark.createDataFrame([(t,) for t in wanted], "t string")
    assert [r["t"] for r in df.where(~suspicious(df["t"])).collect()] == []


def test_correct_text_of_other_languages_is_left_alone(spark):
    """Beside a corpus that has none of these languages, and with its garbled texts still restored."""
    emails = spark.read.parquet("/root/testdata/sf0.01/thread_emails.parquet").select("email_id", "subject", "body")
    garbled = {-100: "für die Übergabe".encode("cp1252").decode("cp850"), -101: garble("한지우 연락처", "euc_kr", "cp1252"), -102: garble("25°C ± 2", "utf-8", "cp1251"), -103: "Précisions".encode("cp1252").decode("mac_roman")}
    rows = [(-1 - i, t, None) for i, t in enumerate(FOREIGN)] + [(k, t, "") for k, t in garbled.items()]
    got = {r["email_id"]: r["restored"] for r in repair_fields(emails.unionByName(spark.createDataFrame(rows, emails.schema)), "email_id", ["subject", "body"]).where("email_id < 0").collect()}
    assert got == {-100: "für die Übergabe", -101: "한지우 연락처", -102: "25°C ± 2", -103: "Précisions"}
