"""Times as epoch milliseconds: reading and writing by pattern and zone."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern letters that Spark refuses or reads otherwise: years as YYYY, week-years xxxx, weeks ww, days of the week e.
_LETTERS = re.compile(r"'[^']*'|x{2,4}|w{1,2}|e{1,2}|Y{1,4}|C{1,2}")


def _parts(pattern: str) -> list[tuple[str, str]]:
    """(kind, text) of a pattern: plain pieces and those that need an expression of their own."""
    out, at = [], 0
    for m in _LETTERS.finditer(pattern):
        if m[0].startswith("'"):
            continue
        if m.start() > at:
            out.append(("plain", pattern[at : m.start()]))
        out.append(("plain", "y" * len(m[0])) if m[0][0] == "Y" else (m[0][0], m[0]))
        at = m.end()
    if at < len(pattern):
        out.append(("plain", pattern[at:]))
    return out


def read(text: Column, pattern: str, zone: str = "UTC") -> Column:
    """Milliseconds since 1970, or null; patterns "native" and "unixmillis" hold them as text, "unixseconds" seconds."""
    if pattern in ("native", "unixmillis"):
        return text.try_cast("bigint")
    if pattern == "unixseconds":
        return text.try_cast("bigint") * 1000
    pattern = pattern.replace("Y", "y")
    stamp = F.try_to_timestamp(text, F.lit(pattern))
    if re.search(r"(?<!y)yy(?!y)", pattern):  # two-digit years are those from 1950 to 2049
        stamp = F.when(F.year(stamp) >= 2050, F.add_months(stamp, -1200).cast("timestamp") + (stamp - F.date_trunc("day", stamp))).otherwise(stamp)
    return F.unix_millis(F.to_utc_timestamp(stamp, zone) if zone != "UTC" else stamp)


def written(millis: Column, pattern: str, zone: str = "UTC") -> Column:
    if pattern in ("native", "unixmillis"):
        return millis.cast("string")
    if pattern == "unixseconds":
        return F.floor(millis / 1000).cast("string")
    stamp = F.timestamp_millis(millis)
    stamp = F.from_utc_timestamp(stamp, zone) if zone != "UTC" else stamp
    pieces = []
    for kind, text in _parts(pattern):
        if kind == "plain":
            pieces.append(F.date_format(stamp, text))
        else:
            value = {"x": F.extract(F.lit("YEAROFWEEK"), stamp), "w": F.weekofyear(stamp), "e": F.extract(F.lit("DAYOFWEEK_ISO"), stamp), "C": F.floor(F.year(stamp) / 100)}[kind]
            pieces.append(F.lpad(value.cast("string"), len(text), "0") if len(text) > 1 else value.cast("string"))
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


#: {{now}}, {{now-1}} (days), {{now+2h}} (hours), each with ::pattern and :zone if wanted.
_NOW = re.compile(r"\{\{now(?:([+-]\d+)(h)?)?(?:::(.+?))?(?::(.+?))?\}\}")
_STRFTIME = {"yyyy": "%Y", "YYYY": "%Y", "yy": "%y", "YY": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "DDD": "%j"}


def expanded(text: str, now: datetime | None = None) -> str:
    """Text with the dates for {{now}}: yyMMdd, with hours yyMMddHH, or as the pattern says; UTC unless a zone is named."""

    def date(m: re.Match) -> str:
        at = (now or datetime.now(ZoneInfo("UTC"))).astimezone(ZoneInfo(m[4] or "UTC"))
        at = (at.astimezone(ZoneInfo("UTC")) + timedelta(hours=int(m[1]))).astimezone(at.tzinfo) if m[2] else at + timedelta(days=int(m[1] or 0))
        pattern = m[3] or ("yyMMddHH" if m[2] else "yyMMdd")

        def piece(letters: re.Match) -> str:
            if letters[0] not in _STRFTIME:
                raise ValueError(f"no date letters {letters[0]!r} in {text!r}")
            return at.strftime(_STRFTIME[letters[0]])

        return re.sub(r"([A-Za-z])\1*", piece, pattern)

    return _NOW.sub(date, text)
