from datetime import datetime, timezone

import pytest

from threadloom.functions.instants import InstantParser
from threadloom.operators.timestamps import InstantDictionary, normalise_instants
from threadloom.runtime import new_path

ZONES = ["Europe/Paris", "America/New_York", "America/Chicago", "Europe/London", "Asia/Kolkata", "Australia/Sydney"]
P = InstantParser(ZONES)


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    "raw, tz, locale, want",
    [
        ("Sun, 10 Jan 2021 22:48:20 +0100 (CET)", None, None, us(2021, 1, 10, 21, 48, 20)),
        ("2021-01-15T23:58:54.5Z", None, None, us(2021, 1, 15, 23, 58, 54) + 500_000),
        ("20210211T105329+1100", None, None, us(2021, 2, 10, 23, 53, 29)),
        ("1611594372", None, None, 1611594372_000_000),
        ("1610898007281", None, None, 1610898007281_000),
        ("1615656572.395", None, None, 1615656572_395_000),
        ("06 Feb 21 02:34:21 +0000", None, None, us(2021, 2, 6, 2, 34, 21)),
        ("1/2/2021 3:28 PM", "America/New_York", "en_US", us(2021, 1, 2, 20, 28)),
        ("01/02/2021 15:28", "Europe/London", "en_GB", us(2021, 2, 1, 15, 28)),
        ("12. März 2021 19:11", "Europe/Paris", "de_DE", us(2021, 3, 12, 18, 11)),
        ("15 de outubro de 2021 07:31", "Europe/London", "pt_PT", us(2021, 10, 15, 6, 31)),
        ("2022년 1월 26일 오전 12:29", "Asia/Kolkata", "ko_KR", us(2022, 1, 25, 18, 59)),
        ("Thu Jan 14 23:19:09 2021", "Europe/Paris", None, us(2021, 1, 14, 22, 19, 9)),
        ("2021-03-17T14:33:47[America/New_York]", "Europe/Paris", None, us(2021, 3, 17, 18, 33, 47)),
        ("Tue, 20 Apr 2021 21:58:11 EDT", "Europe/Paris", None, us(2021, 4, 21, 1, 58, 11)),
        ("2021-01-10", "Europe/Paris", None, us(2021, 1, 9, 23)),
        ("2021-03-28 02:40:14", "Europe/Paris", None, None),  # never
        ("2021-11-07 01:30:00", "America/New_York", None, None),  # twice
        ("2023-02-30 10:41:12", "Europe/Paris", None, None),
        ("2022-11-07T25:61:00Z", None, None, None),
        ("31/13/2022 07:15", "Europe/Paris", "fr_FR", None),
        ("2021-01-10 10:00:00", None, None, None),  # no zone known
        ("2021-01-10 10:00:00 XYZ", "Europe/Paris", None, None),
        ("unknown", "Europe/Paris", "fr_FR", None),
        ("", "Europe/Paris", None, None),
        (None, "Europe/Paris", None, None),
        ("9" * 10_000, "Europe/Paris", None, None),
    ],
)
def test_parse(raw, tz, locale, want):
    assert P.parse(raw, tz, locale) == want


def test_ambiguous_abbreviation_states_no_instant():
    assert InstantParser(["Asia/Kolkata", "Europe/Dublin"]).parse("Tue, 20 Jul 2021 10:00:00 IST") is None


def test_rows_are_kept_and_dictionary_grows_once(spark):
    rows = [(1, "2021-01-10T00:00:00Z", "Europe/Paris", "fr_FR", "x"), (2, " 2021-01-10T00:00:00Z ", "Europe/Paris", "fr_FR", "x"), (3, None, None, None, None), (4, "", "Europe/Paris", "", "y"), (5, "n/a", None, None, "z")]
    df = spark.createDataFrame(rows, "id int, raw string, tz string, loc string, _t string")
    d = InstantDictionary(spark, new_path(spark, "instants"), ZONES)
    got = {r["id"]: r["utc_micros"] for r in normalise_instants(df, "raw", "tz", "loc", d).collect()}
    assert got == {1: us(2021, 1, 10), 2: us(2021, 1, 10), 3: None, 4: None, 5: None}
    n = d.read().count()
    normalise_instants(df, "raw", "tz", "loc", d).count()
    assert d.read().count() == n == 2
    only = normalise_instants(df, "raw", "tz", "loc", d, keep_unread=False)
    assert sorted(r["id"] for r in only.collect()) == [1, 2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, raw string, tz string, loc string")
    d = InstantDictionary(spark, new_path(spark, "instants"), ZONES)
    assert normalise_instants(df, "raw", "tz", "loc", d).count() == 0
