"""MySQL spellings to Spark's. String literals and column names are left alone."""

from __future__ import annotations

import re

NAMES = {
    "NOW": "current_timestamp", "UTC_TIMESTAMP": "current_timestamp", "CURDATE": "current_date", "DATE": "to_date", "ADDDATE": "date_add", "SUBDATE": "date_sub", "STR_TO_DATE": "to_timestamp",
    "IFNULL": "coalesce", "SIGN": "signum", "POW": "power", "FORMAT": "format_number", "JSON_EXTRACT": "get_json_object",
}
TOKENS = dict(Y="yyyy", y="yy", m="MM", d="dd", H="HH", h="hh", i="mm", s="ss", p="a", W="EEEE", M="MMMM", b="MMM", a="EEE", j="DDD", T="HH:mm:ss", r="hh:mm:ss a")
CASTS = {"SIGNED": "BIGINT", "UNSIGNED": "BIGINT", "CHAR": "STRING", "DATETIME": "TIMESTAMP"}
_PIECES = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)")


def date_format(pattern: str) -> str:
    return re.sub(r"%([A-Za-z])", lambda m: TOKENS.get(m[1], m[0]), pattern)


def _arguments(text: str) -> int:
    """How many arguments the call has whose opening bracket text starts with."""
    depth, n = 0, 1
    for c in _PIECES.sub("x", text):
        depth += (c == "(") - (c == ")")
        n += c == "," and depth == 1
        if not depth:
            break
    return n


def to_spark(sql: str) -> str:
    parts = _PIECES.split(sql)
    for i in range(0, len(parts), 2):
        tail = "".join(parts[i:])

        def named(m: re.Match) -> str:
            call = m[1].upper()
            if call == "LOG":  # one argument: natural; two: base first, as in Spark
                return "ln(" if _arguments("(" + tail[m.end() :]) == 1 else "log("  # noqa: B023
            if call in ("ADDDATE", "SUBDATE") and re.match(r"[^()]*,\s*INTERVAL\b", tail[m.end() :], re.I):  # noqa: B023
                return m[0]
            return NAMES.get(call, m[1]) + "("

        parts[i] = re.sub(r"(?<![\w.`])([A-Za-z_]+)\s*\(", named, parts[i])
        parts[i] = re.sub(r"\bAS\s+(SIGNED|UNSIGNED|CHAR|DATETIME)\b(?=\s*(?:\(\d+\))?\s*\))(?:\s*\(\d+\))?", lambda m: f"AS {CASTS[m[1].upper()]}", parts[i], flags=re.I)
    for i in range(1, len(parts), 2):
        before = "".join(parts[:i])
        if parts[i][0] == "'" and re.search(r"(date_format|to_timestamp)\s*\((?:[^()]|\([^()]*\))*,\s*$", before, re.I):
            parts[i] = date_format(parts[i])
    return "".join(parts)


def trigger_aliases(sql: str, new: str, old: str) -> str:
    """NEW.x and OLD.x name the given aliases, outside literals."""
    parts = _PIECES.split(sql)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\bNEW\.", f"{new}.", re.sub(r"\bOLD\.", f"{old}.", parts[i], flags=re.I), flags=re.I)
    return "".join(parts)
