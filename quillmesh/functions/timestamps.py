"""Parsing one raw timestamp, with its zone and source fields, to one UTC instant.

``parse_instant`` is exhaustive over the formats below and returns None wherever
the fields do not fix exactly one instant: a bare date, a wall time without a
usable zone, or a wall time that its zone has twice or never.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

# Zone words with a fixed offset, in minutes.
FIXED_ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "pst": -480,
    "pdt": -420, "bst": 60, "cet": 60, "cest": 120, "jst": 540,
}
# Zone words for the wall time of a place.
PLACE_ZONES = {"et": "America/New_York", "ct": "America/Chicago", "pt": "America/Los_Angeles"}
# Month names, by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_OFFSET = r"[+\-−]\d{1,2}:\d{2}|[+\-−]\d{4}|[+\-−]\d{1,2}"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap]\.?m\.?))?"
_ZONE = rf"(?:\s*(?P<off>{_OFFSET})|\s*(?P<zone>[a-z]+(?:/[a-z_+\-0-9]+)*)(?P<zoff>{_OFFSET})?|\s*\((?P<pzone>[a-z]+)\))?"


def _shape(date: str, clock: str = _CLOCK, gap: str = r"(?:[t\s]\s*)") -> re.Pattern[str]:
    return re.compile(rf"{date}{gap}{clock}{_ZONE}", re.IGNORECASE)


_DAY_NAME = r"(?:[a-z]{3,9}\.?,?\s+)?"
_SHAPES = [
    _shape(r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})[-/.](?P<d>\d{1,2})"),
    _shape(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})", r"(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?", r"[t\s]?"),
    _shape(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})", gap=r"[t\s]"),
    _shape(rf"{_DAY_NAME}(?P<d>\d{{1,2}})[\s-](?P<mon>[a-z]{{3,9}})\.?,?[\s-](?P<y>\d{{4}}),?", gap=r"\s+(?:at\s+)?"),
    _shape(rf"{_DAY_NAME}(?P<mon>[a-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?", gap=r"\s+(?:at\s+)?"),
    re.compile(
        r"(?P<y>\d{4})\s*年\s*(?P<mo>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*[日号]\s*(?P<half>午前|午後|上午|下午)?\s*"
        rf"(?:(?P<h>\d{{1,2}})\s*[時时点]\s*(?P<mi>\d{{1,2}})\s*分(?:\s*(?P<s>\d{{1,2}})\s*秒)?|{_CLOCK.replace('?P<h>', '?P<h2>').replace('?P<mi>', '?P<mi2>').replace('?P<s>', '?P<s2>')}){_ZONE}",
        re.IGNORECASE,
    ),
]
_NUMERIC = r"(?P<a>\d{1,2})[-/.](?P<b>\d{1,2})[-/.](?P<y>\d{4}),?"
_MONTH_FIRST = _shape(_NUMERIC.replace("?P<a>", "?P<mo>").replace("?P<b>", "?P<d>"), gap=r"\s+(?:at\s+)?")
_DAY_FIRST = _shape(_NUMERIC.replace("?P<a>", "?P<d>").replace("?P<b>", "?P<mo>"), gap=r"\s+(?:at\s+)?")
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    return {name.lower(): name for name in available_timezones()}


@lru_cache(maxsize=4096)
def _offset_minutes(text: str) -> int | None:
    text = text.replace("−", "-")
    digits = text[1:].replace(":", "")
    hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    if hours > 18 or minutes > 59:
        return None
    return (hours * 60 + minutes) * (-1 if text[0] == "-" else 1)


@lru_cache(maxsize=4096)
def zone_of(text: str | None) -> int | ZoneInfo | None:
    """Offset in minutes or place of a zone name, offset or zone word; None for a word that says nothing."""
    word = (text or "").strip().lower()
    if not word:
        return None
    if word in FIXED_ZONES:
        return FIXED_ZONES[word]
    if word in PLACE_ZONES:
        return ZoneInfo(PLACE_ZONES[word])
    lead = re.fullmatch(rf"(?:utc|gmt)?\s*({_OFFSET})", word)
    if lead:
        return _offset_minutes(lead[1])
    name = _zone_names().get(word.replace(" ", "_"))
    return ZoneInfo(name) if name and name.lower() not in ("factory", "localtime") else None


def _micros(wall: datetime, zone: int | ZoneInfo | None) -> int | None:
    """Microseconds since the epoch of a wall time, when its zone has it exactly once."""
    if zone is None:
        return None
    if isinstance(zone, int):
        return (wall - _EPOCH) // _MICRO - zone * 60_000_000
    early, late = (wall.replace(tzinfo=zone, fold=fold).utcoffset() for fold in (0, 1))
    return (wall - _EPOCH - early) // _MICRO if early == late else None


def parse_instant(raw: str | None, zone: str | None, source: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None where the fields fix no single instant.

    A zone or offset inside ``raw`` outranks ``zone``. The sources
    ``gdelt_seendate`` and ``api_epoch`` are always UTC; bare epoch numbers
    count only for the latter. Digits beyond microseconds are cut off.
    """
    text, source = (raw or "").strip(), (source or "").strip().lower()
    if not text:
        return None
    if source == "api_epoch":
        whole = re.fullmatch(r"(\d{9,11}|\d{12,14}|\d{15,17})(?:\.(\d+))?", text)
        if not whole:
            return None
        scale = {True: 1_000_000}.get(len(whole[1]) <= 11, 1000 if len(whole[1]) <= 14 else 1)
        part = int((whole[2] + "000000")[:6]) if whole[2] and scale == 1_000_000 else 0
        return int(whole[1]) * scale + part
    shapes = [*_SHAPES, _MONTH_FIRST] if source == "page_text_us" else _SHAPES
    shapes = [*_SHAPES, _DAY_FIRST] if source == "page_text_eu" else shapes
    for shape in shapes:
        found = shape.fullmatch(text)
        if found:
            return _instant(found.groupdict(), zone, source)
    return None


def _instant(part: dict[str, str | None], zone: str | None, source: str) -> int | None:
    month = int(part["mo"]) if part.get("mo") else MONTHS.get(part["mon"][:3].lower())
    hour, minute, second = (int(part.get(k) or part.get(k + "2") or 0) for k in ("h", "mi", "s"))
    half = (part.get("ap") or "")[:1].lower() or {"午前": "a", "上午": "a", "午後": "p", "下午": "p"}.get(part.get("half"), "")
    if half:
        if not (1 <= hour <= 12 or (part.get("half") and hour == 0)):
            return None
        hour = hour % 12 + (12 if half == "p" else 0)
    try:
        wall = datetime(int(part["y"]), month or 0, int(part["d"]), hour, minute, second, int(((part.get("f") or "") + "000000")[:6]))
    except ValueError:
        return None
    if source == "gdelt_seendate":
        return _micros(wall, 0)
    inner = part.get("zone") or part.get("pzone")
    if part.get("off"):
        return _micros(wall, _offset_minutes(part["off"]))
    if inner and part.get("zoff"):
        base = zone_of(inner)
        offset = _offset_minutes(part["zoff"])
        return _micros(wall, offset) if base == 0 and offset is not None else None
    own = zone_of(inner) if inner else None
    return _micros(wall, own if own is not None else zone_of(zone))
