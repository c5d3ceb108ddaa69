"""Pieces of the SQL twins."""

from __future__ import annotations

from quire.functions.spans import BOUND, CLOSE, OPEN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A pattern of the library as an RE2 literal: its word bounds are ASCII already."""
    flag = next((f for f in ("(?iu)", "(?i)") if f in pattern), "")
    plain = pattern.replace(flag, "") if flag else pattern
    for bound in (BOUND, OPEN, CLOSE):
        plain = plain.replace(bound, r"\b")
    return lit(("(?i)" if flag else "") + plain)


def find(source: str, pattern: str, columns: str = "doc_id, page") -> str:
    """columns, body, i, start (0-based) and hit of every match of the source's text."""
    p = rx(pattern)
    return f"""(SELECT {columns}, body, i, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, m[i] AS hit
 FROM (SELECT {columns}, text AS body, m, g, unnest(generate_series(1, len(m))) AS i FROM (SELECT {columns}, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM ({source}))))"""


def first(source: str, key: str, order: str) -> str:
    """Of the rows with one key the first alone."""
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)"
