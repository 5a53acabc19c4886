"""One text, one instant: exhaustive parsing of the date forms that mail software writes.

``InstantParser.parse`` returns microseconds since 1970-01-01 UTC, or None where a text does
not state exactly one instant (blank, a placeholder, an impossible reading, a wall-clock
reading that its zone has twice or never, a zone nobody knows).
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)

#: Month names by language; the position gives the month.
_MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de_short": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr_short": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es_short": "ene feb mar abr may jun jul ago sept oct nov dic",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "pt_short": "jan fev mar abr mai jun jul ago set out nov dez",
}
MONTHS = {name: i + 1 for names in _MONTHS.values() for i, name in enumerate(names.split())}
MONTHS |= {"jänner": 1, "maerz": 3, "setiembre": 9, "fevrier": 2, "aout": 8, "decembre": 12, "marco": 3}

_ZONE = r"(?P<zone>Z|z|[+-]\d{2}(?::?\d{2})?|\[[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*\]|[A-Z][A-Za-z_]+/[A-Za-z_/]+|(?:GMT|UTC)[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5})"
_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>AM|PM|am|pm|a\.m\.|p\.m\.))?"
_TAIL = rf"(?:\s*{_ZONE})?(?:\s*\[(?P<named>[A-Za-z_]+/[A-Za-z_/]+)\])?(?:\s*\([^()]*\))?"
_WEEKDAY = r"(?:(?P<wd>[^\W\d_]{2,12})\.?,?\s+)?"
_FORMS = [
    # 2021-01-15T23:58:54.123+01:00, 2021/01/18 15:27:45 UTC, 2021-01-15
    re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[T\s]\s*{_TIME}{_TAIL})?"),
    # Sun, 10 Jan 2021 22:48:20 +0100 (CET), 06 Feb 21 02:34:21 +0000, 10-Jan-2021 13:40:30 +0100, 12. März 2021 19:11
    re.compile(rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:er|st|nd|rd|th|º)?\.?(?:\s+de)?[\s-]+(?P<mon>[^\W\d_]{{3,12}})\.?,?(?:\s+de)?[\s-]+(?P<y>\d{{4}}|\d{{2}}),?(?:\s+(?:um|at|à|às|a las)?\s*{_TIME}{_TAIL})?"),
    # Thu Jan 14 23:19:09 2021, with an optional zone before the year
    re.compile(rf"(?P<wd>[A-Za-z]{{3,9}}),?\s+(?P<mon>[A-Za-z]{{3,9}})\s+(?P<d>\d{{1,2}})\s+{_TIME}(?:\s+{_ZONE})?\s+(?P<y>\d{{4}})"),
    # September 11, 2023 5:16 PM
    re.compile(rf"{_WEEKDAY}(?P<mon>[^\W\d_]{{3,12}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?(?:\s+(?:at\s+)?{_TIME}{_TAIL})?"),
    # 20210211T105329+1100
    re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?(?P<ap>)?{_TAIL}"),
    # 13/01/2021 20:18, 1/28/2021 3:28 PM, 21.03.2021 16:28
    re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}),?(?:\s+{_TIME}{_TAIL})?"),
    # 2022년 1월 26일 오전 2:29
    re.compile(r"(?P<y>\d{4})년\s*(?P<m>\d{1,2})월\s*(?P<d>\d{1,2})일(?:\s*[월화수목금토일]요일)?(?:\s*(?P<ap>오전|오후)?\s*(?P<h>\d{1,2})(?::|시\s*)(?P<mi>\d{2})분?(?::?\s*(?P<s>\d{2})초?)?)?"),
]
_EPOCH_FORM = re.compile(r"(\d{9,10})(?:[.,](\d{1,9}))?|(\d{12,13})|(\d{15,16})")
_SPACE = re.compile(r"\s+")
_OFFSET = re.compile(r"(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?")
_PM = {"PM", "pm", "p.m.", "오후"}
_UTC_NAMES = {"Z", "z", "UTC", "UT", "GMT"}
_WEEKDAYS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}
#: Locales whose all-numeric dates put the month first.
MONTH_FIRST = {"en_US"}


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown, empty or malformed name
        return None


def abbreviations(zones: list[str], first_year: int = 2000, last_year: int = 2037) -> dict[str, int | None]:
    """Offset in seconds of each zone abbreviation in use in ``zones``; None where two zones disagree."""
    found: dict[str, set[int]] = {}
    for name in zones:
        if (z := _zone(name)) is None:
            continue
        for year in range(first_year, last_year + 1):
            for month in (1, 4, 7, 10):
                t = datetime(year, month, 15, tzinfo=z)
                if (abbr := t.tzname()) and abbr.isalpha():
                    found.setdefault(abbr, set()).add(int(t.utcoffset().total_seconds()))
    out = {a: next(iter(v)) if len(v) == 1 else None for a, v in found.items()}
    return out | {n: 0 for n in _UTC_NAMES}


class InstantParser:
    """Parses texts given an account's zone and locale.  ``zones``: where abbreviations are looked up."""

    def __init__(self, zones: list[str]):
        self.abbr = abbreviations(zones)

    def _offset(self, zone: str) -> int | None:
        if zone in self.abbr:
            return self.abbr[zone]
        if zone.upper() in self.abbr:
            return self.abbr[zone.upper()]
        if m := _OFFSET.fullmatch(zone):
            hours, minutes = int(m[2]), int(m[3] or 0)
            if hours > 14 or minutes > 59:
                return None
            return (1 if m[1] == "+" else -1) * (hours * 3600 + minutes * 60)
        return None

    @staticmethod
    def _on_clock(local: datetime, name: str | None) -> int | None:
        z = _zone(name) if name else None
        if z is None:
            return None
        early, late = local.replace(tzinfo=z).utcoffset(), local.replace(tzinfo=z, fold=1).utcoffset()
        if early != late:  # twice on that clock, or never
            return None
        return (local - _EPOCH - early) // _US

    def parse(self, raw: str | None, tz: str | None = None, locale: str | None = None) -> int | None:
        if not raw:
            return None
        text = _SPACE.sub(" ", raw).strip()
        if m := _EPOCH_FORM.fullmatch(text):
            if m[1]:
                return int(m[1]) * 1_000_000 + int((m[2] or "0").ljust(6, "0")[:6])
            return int(m[3]) * 1000 if m[3] else int(m[4])
        for form in _FORMS:
            if m := form.fullmatch(text):
                return self._read(m, m.groupdict(), tz, locale)
        return None

    def _read(self, m: re.Match, g: dict, tz: str | None, locale: str | None) -> int | None:
        try:
            year = int(g["y"])
            if len(g["y"]) == 2:
                year += 2000 if year < 50 else 1900
            if g.get("mon"):
                month, day = MONTHS.get(g["mon"].lower().rstrip(".")), int(g["d"])
                if month is None:
                    return None
            elif g.get("a"):
                first, second = int(g["a"]), int(g["b"])
                if not locale:
                    return None
                month, day = (first, second) if locale in MONTH_FIRST and g["sep"] != "." else (second, first)
            else:
                month, day = int(g["m"]), int(g["d"])
            hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
            if ap := g.get("ap"):
                if not 1 <= hour <= 12:
                    return None
                hour = hour % 12 + 12 * (ap in _PM)
            local = datetime(year, month, day, hour, minute, second, int((g.get("f") or "0").ljust(6, "0")[:6]))
        except ValueError:
            return None
        if (wd := g.get("wd")) and (want := _WEEKDAYS.get(wd[:3].lower())) is not None and want != local.weekday():
            return None
        zone = g.get("zone")
        if not zone:
            return self._on_clock(local, g.get("named") or tz)
        if zone[0] == "[":
            return self._on_clock(local, zone[1:-1])
        if "/" in zone:
            return self._on_clock(local, zone)
        offset = self._offset(zone)
        if offset is None:
            return None
        return (local - _EPOCH - timedelta(seconds=offset)) // _US
