"""Reading of times in mixed notations: what a text says, and the instant it is."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

#: Minutes east of UTC of zone names that texts carry (fixed values).
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "JST": 540, "AWST": 480, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}

_REST = (
    r"(?:[T ,]+(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?)?"
    r"(?:\s*(?P<half>[AaPp][Mm]))?\s*(?P<zone>Z|(?:GMT|UTC)?[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}|[A-Z]{2,4})?\Z"
)
_YEAR_FIRST = re.compile(r"(?P<y>[0-9]{4})[-/.](?P<m>[0-9]{1,2}|[A-Za-z]{3})[-/.](?P<d>[0-9]{1,2})" + _REST)
_DIGITS_FIRST = re.compile(r"(?P<a>[0-9]{1,2})[-/.](?P<b>[0-9]{1,2})[-/.](?P<y>[0-9]{4})" + _REST)
_DAY_NAME = re.compile(r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>[0-9]{1,2})[- ](?P<m>[A-Za-z]{3})[a-z]*[- ,]+(?P<y>[0-9]{4})" + _REST)
_NAME_DAY = re.compile(r"(?:[A-Za-z]{3,9},\s+)?(?P<m>[A-Za-z]{3})[a-z]* (?P<d>[0-9]{1,2}),? (?P<y>[0-9]{4})" + _REST)
_COMPACT = re.compile(r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})T?(?P<h>[0-9]{2})(?P<mi>[0-9]{2})(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?(?P<half>)(?P<zone>Z|[+-][0-9]{2}:?[0-9]{2})?\Z")
_COUNT = re.compile(r"([0-9]+)(?:\.([0-9]+))?\Z")
_ODATA = re.compile(r"\\?/?Date\((-?[0-9]+)(?:[+-][0-9]{4})?\)\\?/?\Z")
_DAY0 = date(1970, 1, 1).toordinal()
#: Microseconds from 1601 to 1970, where counters of 100 ns begin.
_SINCE_1601 = 11_644_473_600_000_000
_NEVER = 2**63 - 1
#: Dates that systems write for "never": the first and last of their calendars and the beginnings of their counters (fixed values).
NEVER_DATES = frozenset({(1, 1, 1), (1601, 1, 1), (1970, 1, 1), (9999, 12, 31)})


def _micro(digits: str | None) -> int:
    """Microseconds of the digits after a decimal point; digits beyond them are cut."""
    return int(digits[:6].ljust(6, "0")) if digits else 0


def read(text: str, month_first: bool) -> tuple[int | None, int, int, int | None] | None:
    """`(micros, local, micro, offset)` of a text: `micros` since 1970 if it counts them, else `local` seconds as if UTC,
    the `micro`seconds of its fraction, and the minutes of its zone (None without one). None if it names no time.

    `month_first` settles dates of digits only; a month beyond 12 turns the two round. Counters are told apart by their
    digits: seconds, milliseconds, microseconds, 100 ns since 1601, nanoseconds; 0 and the largest number are "never", as are
    the dates of `NEVER_DATES` without a time of day (9999-12-31 at any).
    """
    t = text.strip()
    c = _COUNT.match(t)
    if c and not (len(c[1]) == 14 and 1900 <= int(c[1][:4]) <= 2200):
        n, many = int(c[1]), len(c[1])
        if n == 0 or n == _NEVER:
            return None
        if 9 <= many <= 11:
            return n * 1_000_000 + _micro(c[2]), 0, 0, 0
        us = {12: n * 1000, 13: n * 1000, 15: n, 16: n, 17: n // 10 - _SINCE_1601, 18: n // 10 - _SINCE_1601, 19: n // 1000}.get(many)
        return None if us is None else (us, 0, 0, 0)
    x = _YEAR_FIRST.match(t)
    if x:
        y, m, d = x["y"], x["m"], x["d"]
    elif x := _DIGITS_FIRST.match(t):
        y, a, b = x["y"], x["a"], x["b"]
        turn = month_first and int(a) <= 12 or int(b) > 12
        m, d = (a, b) if turn else (b, a)
    elif x := _DAY_NAME.match(t) or _NAME_DAY.match(t) or _COMPACT.match(t):
        y, m, d = x["y"], x["m"], x["d"]
    elif x := _ODATA.match(t):
        return int(x[1]) * 1000, 0, 0, 0
    else:
        return None
    month = int(m) if m[0].isdigit() else MONTHS.get(m.lower())
    h, mi, s = int(x["h"] or 0), int(x["mi"] or 0), int(x["s"] or 0)
    half = x["half"]
    if half:
        h = h % 12 + (12 if half[0] in "Pp" else 0)
    if month is None or h > 23 or mi > 59 or s > 59:
        return None
    if (int(y), month, int(d)) in NEVER_DATES and (int(y) == 9999 or not (h or mi or s)):
        return None
    try:
        day = date(int(y), month, int(d)).toordinal() - _DAY0
    except ValueError:
        return None
    offset = None
    if zone := x["zone"]:
        digits = zone.removeprefix("GMT").removeprefix("UTC") if len(zone) > 4 else zone
        if digits[0] in "+-":
            offset = int(digits[1:3]) * 60 + int(digits[3:].lstrip(":") or 0)
            offset = -offset if digits[0] == "-" else offset
        else:
            offset = ZONE_MINUTES.get(zone)
            if offset is None:  # a name that isn't known says nothing certain
                return None
    return None, day * 86400 + h * 3600 + mi * 60 + s, _micro(x["f"]), offset


class Zone:
    """Instants of local times in one zone. Offsets are kept by local quarter of an hour, in which none changes."""

    def __init__(self, name: str):
        self.info = ZoneInfo(name)
        self.known: dict[int, int] = {}

    def utc(self, local: int) -> int:
        """Seconds since 1970; of two instants that fit the earlier, and in a gap as if the clock hadn't been changed yet."""
        q = local // 900
        off = self.known.get(q)
        if off is None:
            if len(self.known) > 500_000:
                self.known.clear()
            try:
                off = int((datetime(1970, 1, 1) + timedelta(seconds=q * 900)).replace(tzinfo=self.info).utcoffset().total_seconds())
            except OverflowError:
                off = 0
            self.known[q] = off
        return local - off
