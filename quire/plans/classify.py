"""Queries of the classification operators."""

from __future__ import annotations

from quire.operators import classify as C

from . import views
from .duck import lit, rx

BIZ, biz = views.BIZ, views.biz_pages
_LINES = "list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)"


def _count(pattern: str, text: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({text}, {rx(pattern)})) AS INTEGER)"


def _keywords(columns: str = "doc_id") -> str:
    words = ", ".join(f"{{c: {lit(c)}, k: {lit(k)}, p: {lit(k.lower())}, r: {rx(C.keyword_pattern(k))}, w: {C.weight(k)}}}" for c, ks in C.KEYWORDS.items() for k in ks)
    return f"""SELECT * FROM (SELECT {columns}, k.c AS category, k.k AS keyword, CAST(len(regexp_extract_all(low, k.r)) AS INTEGER) AS "count", k.w AS weight FROM (SELECT {columns}, low, unnest(list_filter([{words}], lambda k: contains(low, k.p))) AS k FROM (SELECT *, lower(text) AS low FROM ({BIZ})))) WHERE "count" > 0"""


def _pairs(mark: str, regex: str) -> str:
    cells = f"list_transform(string_split(text, chr(10)), lambda x: len(string_split(x, {mark})) >= 3)"
    return f"len(list_filter(range(1, len(string_split(text, chr(10)))), lambda i: ({cells})[i] AND ({cells})[i + 1])) > 0"


_TABLES = f"(({_pairs('chr(9)', '')}) OR ({_pairs(lit('|'), '')}) OR len(list_filter(string_split(text, chr(10))[1:50], lambda x: len(regexp_extract_all(x, '\\s{{3,}}')) >= 2)) >= 5)"
_FLAGS = f"""{_TABLES} AS has_tables, len(list_filter({_LINES}, lambda x: regexp_matches(x, {rx(C.LIST_LINE)}))) > 0 AS has_lists, len(list_filter({_LINES}, lambda x: regexp_matches(x, {rx(C.HEADER_LINE)}))) > 0 AS has_sections,
 regexp_matches(text, {rx(C.SIGNATURE)}) AS has_signature_area, regexp_matches(text, {lit(C.NUMBERED)}) AS has_numbered_items, regexp_matches(text, {rx(C.FORM_FIELD)}) AS has_form_fields"""
_STRUCTURE = f"""SELECT doc_id, {_FLAGS}, CAST(coalesce(floor(list_sum(list_transform({_LINES}, lambda x: length(x))) / nullif(len({_LINES}), 0) + 0.5), 0) AS INTEGER) AS average_line_length,
 CAST(len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: length(trim(x)) > 0)) AS INTEGER) AS paragraph_count FROM ({BIZ})"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN floor(CAST(({a}) AS DOUBLE) / ({b}) * 100 + 0.5) / 100 ELSE 0.0 END"


_U, _L, _D, _W = (_count(p) for p in ("[A-Z]", "[a-z]", "[0-9]", r"\S+"))
_STATS = f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, {_W} AS words, CAST(len({_LINES}) AS INTEGER) AS lines, CASE WHEN len({_LINES}) > 0 THEN floor(CAST({_W} AS DOUBLE) / len({_LINES}) * 10 + 0.5) / 10 ELSE 0.0 END AS words_per_line,
 {_ratio(_U, f'{_U} + {_L}')} AS uppercase_ratio, {_ratio(_D, f'{_U} + {_L} + {_D}')} AS numeric_ratio"""


def _entities(kind: str) -> str:
    patterns, most = C.FEATURES[kind]
    lists = " || ".join(f"regexp_extract_all(text, {rx(p)})[1:{most}]" for p in patterns)
    return f"list_filter({lists}, lambda x, i: list_position({lists}, x) = i)"


_FEATURES = f"SELECT doc_id, {', '.join(f'{_entities(k)} AS {k}' for k in C.FEATURES)} FROM ({BIZ})"
# The same points as the operator's, by condition on the row f.
_POINTS = (
    ("has_signature_area", {"contract": 15, "letter": 10, "form": 10, "legal": 10}),
    ("has_form_fields", {"form": 30}),
    ("has_tables", {"invoice": 15, "financial": 15, "report": 10}),
    ("has_sections", {"report": 10, "academic": 15, "contract": 10}),
    ("has_numbered_items AND has_lists", {"contract": 10, "legal": 10}),
    ("n_amounts >= 3", {"invoice": 20, "financial": 15}),
    ("n_emails >= 1 AND words < 1000", {"letter": 10, "resume": 10}),
    ("uppercase_ratio > 0.3", {"form": 10}),
    ("numeric_ratio > 0.1", {"invoice": 10, "financial": 10}),
    ("true", {"letter": 5, "invoice": 5, "form": 5}),
)


def _classify() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {lit(t)} AS type, {' + '.join([f'CASE WHEN {c} THEN {p[t]} ELSE 0 END' for c, p in _POINTS if t in p] or ['0'])} AS bonus FROM f" for i, t in enumerate(C.TYPES))
    return f"""WITH f AS MATERIALIZED ({_STATS}, {_FLAGS}, len({_entities('amounts')}) AS n_amounts, len({_entities('emails')}) AS n_emails FROM ({BIZ})),
 k AS (SELECT doc_id, category AS type, sum("count" * weight * 10) AS score FROM ({_keywords()}) GROUP BY ALL),
 s AS (SELECT b.doc_id, i, b.type, CAST(bonus + coalesce(score, 0) AS INTEGER) AS raw FROM ({parts}) b LEFT JOIN k ON k.doc_id = b.doc_id AND k.type = b.type),
 m AS (SELECT *, max(raw) OVER (PARTITION BY doc_id) AS top FROM s),
 n AS (SELECT *, CASE WHEN top > 0 THEN CAST(least(100, floor(CAST(raw AS DOUBLE) / top * 100 + 0.5)) AS INTEGER) ELSE 0 END AS scaled FROM m),
 best AS (SELECT doc_id, top, CASE WHEN top > 0 THEN arg_min(type, i) FILTER (raw = top) ELSE 'other' END AS type, list_sort(list(raw), 'DESC')[2] AS second FROM n GROUP BY doc_id, top),
 alt AS (SELECT doc_id, string_agg(type || ':' || scaled, ',' ORDER BY r) AS alternatives FROM (SELECT n.*, row_number() OVER (PARTITION BY n.doc_id ORDER BY scaled DESC, i) AS r FROM n JOIN best b ON b.doc_id = n.doc_id AND b.type <> n.type WHERE n.type <> 'other') WHERE r <= 3 AND scaled >= 20 GROUP BY doc_id)
 SELECT doc_id, type, 100 AS confidence, 'high' AS level, coalesce(alternatives, '') AS alternatives, top AS raw_score, top - second AS margin FROM best LEFT JOIN alt USING (doc_id)"""


def _rule(t: str) -> str:
    if t not in C.RULES:
        return "0"
    w, patterns = C.RULES[t]
    return f"{w} * least(3, {' + '.join(f'CAST(regexp_matches(text, {lit('(?im)' + p)}) AS INTEGER)' for p in patterns)})"


_PATTERNS = f"SELECT doc_id, {', '.join(f'{_rule(t)} AS {t}' for t in C.TYPES)} FROM ({BIZ})"


def _quick() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {lit(t)} AS type, {t} AS points FROM p" for i, t in enumerate(C.TYPES))
    return f"""WITH p AS MATERIALIZED ({_PATTERNS}), k AS (SELECT doc_id, category AS type, sum("count" * weight * 3) AS score FROM ({_keywords()}) GROUP BY ALL),
 s AS (SELECT a.doc_id, i, a.type, points + coalesce(score, 0) AS raw FROM ({parts}) a LEFT JOIN k ON k.doc_id = a.doc_id AND k.type = a.type),
 b AS (SELECT doc_id, arg_min(type, (-raw, i)) AS best, CAST(least(100, floor(max(raw) / 2.0 + 0.5)) AS INTEGER) AS sure FROM s GROUP BY doc_id)
 SELECT doc_id, CASE WHEN sure < 15 THEN 'other' ELSE best END AS type, CASE WHEN sure < 15 THEN 100 - sure ELSE sure END AS confidence FROM b"""


_TYPES = ", ".join(f"({lit(t)})" for t in C.TYPES)
QUERIES = {
    "d1_keyword_matches": lambda s, d: C.keyword_matches(biz(s, d)),
    "d2_structure_features": lambda s, d: C.structure_features(biz(s, d)),
    "d4_text_stats": lambda s, d: C.text_stats(biz(s, d)),
    "d5_classify_documents": lambda s, d: C.classify_documents(biz(s, d)),
    "d6_pattern_scores": lambda s, d: C.pattern_scores(biz(s, d)),
    "d7_quick_classify": lambda s, d: C.quick_classify(biz(s, d)),
    "c13_feature_entities": lambda s, d: C.extract_feature_entities(biz(s, d)),
}
ORACLES = {
    "d1_keyword_matches": _keywords(),
    "d2_structure_features": _STRUCTURE,
    "d4_text_stats": f"{_STATS} FROM ({BIZ})",
    "d5_classify_documents": _classify(),
    "d6_pattern_scores": _PATTERNS,
    "d7_quick_classify": _quick(),
    "c13_feature_entities": _FEATURES,
}
