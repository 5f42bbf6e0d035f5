"""Relative dates: a unit letter, an optional offset, and an end marker, resolved on the driver."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

_TERM = re.compile(r"^([DNWMQYHF])(E)?((?:[+-]\d+[DNWMQYH]?)*)$")


# What abbreviations of time zones stand for.
_ZONES = {"UTC": "UTC", "GMT": "UTC", "Z": "UTC", "EST": "America/New_York", "EDT": "America/New_York", "CST": "America/Chicago", "CDT": "America/Chicago", "MST": "America/Denver", "MDT": "America/Denver", "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "CET": "Europe/Paris", "CEST": "Europe/Paris", "BST": "Europe/London", "IST": "Asia/Kolkata", "JST": "Asia/Tokyo"}


def _months(d: dt.datetime, n: int) -> dt.datetime:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
    return d.replace(year=y, month=m + 1, day=min(d.day, last))


def _shift(d: dt.datetime, unit: str, n: int) -> dt.datetime:
    if unit in "DN":
        return d + dt.timedelta(days=n)
    if unit == "H":
        return d + dt.timedelta(hours=n)
    if unit == "W":
        return d + dt.timedelta(weeks=n)
    return _months(d, n * {"M": 1, "Q": 3, "Y": 12, "F": 12}[unit])


def resolve(text: str | None, now: dt.datetime | None = None, week_start: str = "Monday", fiscal_month: int = 1) -> dt.datetime | None:
    """The time a relative date stands for; an ISO text is itself, anything else null. E after the unit means the period's last day.

    A time zone after it (D-1 EST, D Europe/Paris) resolves it by the clock there.
    """
    if not text or not text.strip():
        return None
    head, _, zone = text.strip().partition(" ")
    m = _TERM.match(head.upper())
    if not m:
        try:
            return dt.datetime.fromisoformat(text.strip())
        except ValueError:
            return None
    if zone:
        there = ZoneInfo(_ZONES.get(zone.strip().upper(), zone.strip()))
        now = (now.astimezone() if now else dt.datetime.now(dt.timezone.utc)).astimezone(there).replace(tzinfo=None)
    now = now or dt.datetime.now()
    unit, end, offsets = m[1], m[2], m[3]
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    names = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
    first = names.index(week_start.upper()) if week_start.upper() in names else 0
    anchor = {
        "D": day,
        "N": now,
        "H": now.replace(minute=0, second=0, microsecond=0),
        "W": day - dt.timedelta(days=(day.weekday() - first) % 7),
        "M": day.replace(day=1),
        "Q": day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1),
        "Y": day.replace(month=1, day=1),
        "F": _months(day.replace(day=1), -((day.month - fiscal_month) % 12)),
    }[unit]
    for sign, n, other in re.findall(r"([+-])(\d+)([DNWMQYH]?)", offsets):
        anchor = _shift(anchor, other or unit, int(sign + n))
    if end:
        anchor = _shift(anchor, unit, 1) - dt.timedelta(days=1)
    return anchor
