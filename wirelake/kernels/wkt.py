"""Text forms of the well-known types, on plain numbers and strings."""

from __future__ import annotations

import re

MIN_SECONDS, MAX_SECONDS = -62_135_596_800, 253_402_300_799
MAX_DURATION = 315_576_000_000


class BadText(ValueError):
    """A text form that isn't valid, or a value that has none."""


def days_to_date(z: int) -> tuple[int, int, int]:
    """Year, month and day of a day number from 1970-01-01 on."""
    z += 719_468
    era, doe = divmod(z, 146_097)
    yoe = (doe - doe // 1460 + doe // 36_524 - doe // 146_096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    month = mp + 3 if mp < 10 else mp - 9
    return yoe + era * 400 + (month <= 2), month, doy - (153 * mp + 2) // 5 + 1


def date_to_days(y: int, m: int, d: int) -> int:
    y -= m <= 2
    era, yoe = divmod(y, 400)
    doy = (153 * (m - 3 if m > 2 else m + 9) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def _fraction(nanos: int) -> str:
    """No digits, or three, six or nine."""
    if not nanos:
        return ""
    for digits, unit in ((3, 1_000_000), (6, 1_000)):
        if nanos % unit == 0:
            return f".{nanos // unit:0{digits}d}"
    return f".{nanos:09d}"


def format_timestamp(seconds: int, nanos: int) -> str:
    if not MIN_SECONDS <= seconds <= MAX_SECONDS:
        raise BadText("timestamp outside the years 1 to 9999")
    if not 0 <= nanos <= 999_999_999:
        raise BadText("timestamp nanos")
    days, rest = divmod(seconds, 86_400)
    y, m, d = days_to_date(days)
    return f"{y:04d}-{m:02d}-{d:02d}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}{_fraction(nanos)}Z"


_TIMESTAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:Z|([+-])(\d\d):(\d\d))", re.ASCII)
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def parse_timestamp(text: str) -> tuple[int, int]:
    """RFC 3339 with capital T and Z or an offset; no leap seconds."""
    found = _TIMESTAMP.fullmatch(text)
    if not found:
        raise BadText(f"timestamp {text!r}")
    y, m, d, hh, mm, ss = map(int, found.groups()[:6])
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if not (1 <= y and 1 <= m <= 12 and 1 <= d <= _MONTHS[m - 1] + (m == 2 and leap) and hh <= 23 and mm <= 59 and ss <= 59):
        raise BadText(f"timestamp {text!r}")
    seconds = date_to_days(y, m, d) * 86_400 + hh * 3600 + mm * 60 + ss
    if found[8]:
        oh, om = int(found[9]), int(found[10])
        if oh > 23 or om > 59:
            raise BadText(f"offset of {text!r}")
        seconds -= (1 if found[8] == "+" else -1) * (oh * 3600 + om * 60)
    if not MIN_SECONDS <= seconds <= MAX_SECONDS:
        raise BadText(f"timestamp {text!r} outside the years 1 to 9999")
    return seconds, int((found[7] or "").ljust(9, "0")) if found[7] else 0


def check_duration(seconds: int, nanos: int) -> None:
    if abs(seconds) > MAX_DURATION or abs(nanos) > 999_999_999 or (seconds > 0 > nanos) or (seconds < 0 < nanos):
        raise BadText(f"duration {seconds} s {nanos} ns")


def format_duration(seconds: int, nanos: int) -> str:
    check_duration(seconds, nanos)
    sign = "-" if seconds < 0 or nanos < 0 else ""
    return f"{sign}{abs(seconds)}{_fraction(abs(nanos))}s"


_DURATION = re.compile(r"(-?)(\d+)(?:\.(\d{1,9}))?s", re.ASCII)


def parse_duration(text: str) -> tuple[int, int]:
    found = _DURATION.fullmatch(text)
    if not found:
        raise BadText(f"duration {text!r}")
    sign = -1 if found[1] else 1
    seconds, nanos = sign * int(found[2]), sign * int((found[3] or "0").ljust(9, "0"))
    check_duration(seconds, nanos)
    return seconds, nanos


def snake_to_camel(path: str) -> str:
    out, up = [], False
    for c in path:
        if c == "_":
            up = True
        else:
            out.append(c.upper() if up else c)
            up = False
    return "".join(out)


def camel_to_snake(path: str) -> str:
    return "".join("_" + c.lower() if "A" <= c <= "Z" else c for c in path)


def path_round_trips(path: str) -> bool:
    return camel_to_snake(snake_to_camel(path)) == path


def format_mask(paths: list[str]) -> str:
    for p in paths:
        if not path_round_trips(p):
            raise BadText(f"field mask path {p!r}")
    return ",".join(map(snake_to_camel, paths))


def parse_mask(text: str) -> list[str]:
    if not text:
        return []
    parts = text.split(",")
    if any("_" in p or not p for p in parts):
        raise BadText(f"field mask {text!r}")
    return [camel_to_snake(p) for p in parts]
