"""Queries of the layout and form operators.

In the item views lines are 20 apart and items of a line within 2, so in SQL a line's number comes from its height.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import forms as B
from quire.operators import layout as L

from . import views
from .duck import lit

_I, _items = views.TEXT_ITEMS, views.text_items


def _rows(s, d):
    return L.group_rows(_items(s, d))


def _cells(s, d):
    return L.page_cells(L.page_grids(_items(s, d)))


def _tables(s, d):
    return L.extract_tables(_items(s, d))


def _joined(tables):
    """Tables with their rows as text."""
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return tables.withColumn("rows", rows).withColumn("header_rows", F.size("header_rows")).withColumn("confidence", F.round("confidence", 6))


def _edits(s, d):
    rows = views.load(s, d, "lineitem").where("l_linenumber <= 4")
    return rows.selectExpr("l_orderkey AS doc_id", "1 AS page", "0 AS table_idx", "l_linenumber - 1 AS row", "cast(l_partkey % 6 as int) AS col", "l_partkey * 100000 + l_suppkey AS seq", "'edit ' || cast(l_partkey as string) AS value")


def _blocks(s, d):
    return L.heading_blocks(_items(s, d))


def _headings(s, d):
    return L.extract_headings(_blocks(s, d))


_PLACED = f"(SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY floor((702 - y) / 20)) - 1 AS row FROM ({_I}) WHERE length(trim(str)) > 0)"
_ROWS = f"SELECT doc_id, page, CAST(row AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY doc_id, page, row ORDER BY x) - 1 AS INTEGER) AS place, str, x, y, width, height FROM {_PLACED}"
_STARTS = f"(SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) - 1 AS ci FROM (SELECT doc_id, page, CAST(floor(x / 10 + 0.5) * 10 AS INTEGER) AS pos, count(*) AS n, max(max(row)) OVER (PARTITION BY doc_id, page) AS last FROM {_PLACED} GROUP BY doc_id, page, pos) WHERE n >= greatest(2, floor((last + 1) * 0.3)))"
_CELLS = f"""(WITH p AS {_PLACED}, s AS {_STARTS},
 near AS (SELECT * FROM (SELECT p.doc_id, p.page, row, x, str, ci, row_number() OVER (PARTITION BY p.doc_id, p.page, item_idx ORDER BY abs(x - pos), ci) AS rn FROM p JOIN s ON p.doc_id = s.doc_id AND p.page = s.page) WHERE rn = 1),
 texts AS (SELECT doc_id, page, row, ci, string_agg(str, ' ' ORDER BY x) AS t FROM near GROUP BY ALL),
 frame AS (SELECT r.doc_id, r.page, row, ci FROM (SELECT DISTINCT doc_id, page, row FROM near) r JOIN s ON r.doc_id = s.doc_id AND r.page = s.page)
 SELECT f.doc_id, f.page, CAST(f.row AS INTEGER) AS row, list(coalesce(t, '') ORDER BY f.ci) AS cells FROM frame f LEFT JOIN texts t ON t.doc_id = f.doc_id AND t.page = f.page AND t.row = f.row AND t.ci = f.ci GROUP BY ALL)"""
_TABLES = f"""(SELECT t.*, b.x, b.y, b.width, b.height FROM (
 SELECT *, (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(filled) AS v) GROUP BY v)) / CAST(row_count AS DOUBLE) * 0.4 + CASE WHEN row_count >= 3 THEN 0.2 ELSE 0.0 END + CASE WHEN column_count >= 3 THEN 0.2 ELSE 0.0 END + list_sum(filled) / CAST(row_count * column_count AS DOUBLE) * 0.2 AS confidence FROM (
  SELECT doc_id, page, list(cells ORDER BY row) AS rows, CAST(count(*) AS INTEGER) AS row_count, CAST(max(len(cells)) AS INTEGER) AS column_count, list(len(list_filter(cells, lambda c: length(trim(c)) > 0)) ORDER BY row) AS filled FROM {_CELLS} GROUP BY doc_id, page) WHERE row_count >= 2 AND column_count >= 2) t
 JOIN (SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM {_PLACED} GROUP BY doc_id, page) b ON b.doc_id = t.doc_id AND b.page = t.page WHERE confidence >= 0.5)"""
_HEAD = "(len(list_filter(rows[1], lambda c: regexp_matches(trim(c), '(?i)^(no\\.?|#|id|sr\\.?\\s*no\\.?|s\\.?\\s*no\\.?|name|description|item|product|service|date|time|datetime|timestamp|amount|price|cost|total|value|qty|quantity|rate|status|type|category|class)$'))) > 0 OR (list_sum(list_transform(rows[1], lambda c: length(c))) / CAST(len(rows[1]) AS DOUBLE) < 20 AND len(list_filter(rows[1], lambda c: regexp_matches(trim(c), '^[0-9]+([.,][0-9]+)?$'))) = 0))"
_TABLE_CELLS = f"(SELECT doc_id, page, row, CAST(ci AS INTEGER) AS col, rows[row + 1][ci + 1] AS value FROM (SELECT doc_id, page, rows, row, unnest(range(0, column_count)) AS ci FROM (SELECT doc_id, page, rows, column_count, CAST(unnest(range(0, row_count)) AS INTEGER) AS row FROM {_TABLES})))"
_BLOCKS = f"(SELECT doc_id, page, CAST(row + 1 AS INTEGER) AS block, trim(string_agg(str, '' ORDER BY item_idx)) AS text, arg_min(font_size, item_idx) AS font_size, contains(arg_min(font_name, item_idx), 'Bold') AS bold, arg_min(x, item_idx) AS x, arg_max(y, item_idx) AS y, sum(width) AS width FROM {_PLACED} GROUP BY doc_id, page, row)"
_STYLES = f"""(WITH s AS (SELECT doc_id, CAST(floor(font_size + 0.5) AS INTEGER) AS size, count(*) AS n, count(*) FILTER (bold) AS nb, min(page * 1000 + block) AS seen FROM {_BLOCKS} GROUP BY ALL),
 b AS (SELECT doc_id, arg_max(size, n * 1000000 - seen) AS body FROM s GROUP BY doc_id)
 SELECT * FROM (SELECT doc_id, size, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS INTEGER) AS level, nb > n / 2.0 AS bold, n AS blocks FROM s JOIN b USING (doc_id) WHERE size > body OR (nb >= n / 2.0 AND n >= 2)) WHERE level <= 6)"""
_HEADINGS = f"(SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY page, block) - 1 AS INTEGER) AS seq, text AS title, page, level, font_size, x, y, width FROM {_BLOCKS} b JOIN {_STYLES} s ON s.doc_id = b.doc_id AND s.size = CAST(floor(font_size + 0.5) AS INTEGER) WHERE level <= 3 AND font_size >= 12 AND length(text) >= 3 AND NOT regexp_matches(text, '^[0-9]+$'))"
_LINES = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row, x) AS n, lag(row) OVER (PARTITION BY doc_id, page ORDER BY row, x) AS pr, lag(x + width) OVER (PARTITION BY doc_id, page ORDER BY row, x) AS pe FROM {_PLACED})
SELECT doc_id, page, CAST(row + 1 AS INTEGER) AS line_no, string_agg(CASE WHEN pr = row AND x - pe > greatest(2, height * 0.2) THEN ' ' ELSE '' END || trim(str), '' ORDER BY n) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM p GROUP BY doc_id, page, row"""

_F, _P = views.FORM_ITEMS, views.FORM_PAGES


def _fields(s, d):
    return B.detect_form_fields(views.form_items(s, d), views.form_pages(s, d))


def _suggest(text: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, {lit(p)}) THEN {{'type': '{k}', 'confidence': {n}}}" for p, k, n in [(B.label_pattern(k), k, 95) for k in B.LABELS] + list(B.HINTS))
    return f"(CASE {whens} ELSE {{'type': 'text', 'confidence': 50}} END)"


_LABELLED = "trim(regexp_replace(str, '[:*\\s]+$', ''))"
_CANDIDATES = f"""(SELECT doc_id, page, 0 AS family, item_idx, str, x, y - 5 AS y, width, CAST(20 AS DOUBLE) AS height FROM ({_F}) WHERE regexp_matches(trim(str), '^[_\\-]{{5,}}$')
 UNION ALL SELECT doc_id, page, 1, item_idx, str, x, y, greatest(width, 15), greatest(height, 15) FROM ({_F}) WHERE trim(str) = '[ ]'
 UNION ALL SELECT i.doc_id, i.page, 2, item_idx, str, x + width + 8, y - 4, least(240, page_width - x - width - 28), greatest(20, height + 8) FROM ({_F}) i JOIN ({_P}) p ON p.doc_id = i.doc_id AND p.page = i.page WHERE regexp_matches(str, '[:*]\\s*$') AND length({_LABELLED}) >= 2 AND {_suggest(_LABELLED)}.confidence > 50 AND page_width - x - width - 28 >= 72)"""
_NEAR = f"""(SELECT c.doc_id, c.page, c.family, c.item_idx, arg_min(trim(l.str), CASE WHEN l.x + l.width < c.x THEN 0 ELSE 1000 END + l.item_idx) AS label_text FROM {_CANDIDATES} c JOIN ({_F}) l ON l.doc_id = c.doc_id AND l.page = c.page
 WHERE c.family < 2 AND length(trim(l.str)) > 1 AND NOT regexp_matches(trim(l.str), '^[_\\-\\[\\]\\(\\)]+$') AND sqrt(pow(l.x + l.width / 2 - c.x - c.width / 2, 2) + pow(l.y + l.height / 2 - c.y - c.height / 2, 2)) < 150
 AND ((l.x + l.width < c.x AND l.y < c.y + c.height AND l.y + l.height > c.y) OR (l.y > c.y + c.height AND abs(l.x - c.x) < c.width)) GROUP BY ALL)"""
_SLUG = lambda x: f"coalesce(nullif(substring(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50), ''), 'field')"
_FIELDS = f"""(WITH c AS {_CANDIDATES}, n AS {_NEAR},
 r AS (SELECT c.*, nullif(CASE WHEN c.family = 2 THEN {_LABELLED} ELSE trim(regexp_replace(label_text, '[:*\\s]+$', '')) END, '') AS raw, CASE WHEN c.family = 2 THEN str ELSE label_text END AS said FROM c LEFT JOIN n ON n.doc_id = c.doc_id AND n.page = c.page AND n.family = c.family AND n.item_idx = c.item_idx),
 h AS (SELECT *, coalesce(raw, 'Unlabeled field') AS label, {_suggest("coalesce(raw, 'Unlabeled field')")} AS hint FROM r),
 k AS (SELECT *, CASE WHEN family = 1 THEN 'checkbox' ELSE hint.type END AS type, CASE WHEN family = 1 THEN 90 ELSE hint.confidence END AS sure FROM h),
 f AS (SELECT *, CAST(CASE WHEN family = 2 THEN least(92, 60 + (sure - 50) * 0.5) ELSE least(98, 58 + CASE WHEN raw IS NULL THEN 0 ELSE 22 END + (sure - 50) * 0.2) END AS DOUBLE) AS confidence FROM k),
 t AS (SELECT * FROM f a WHERE confidence >= 30 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.family * 1000 + b.item_idx < a.family * 1000 + a.item_idx
   AND greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) > 0.5 * least(a.width * a.height, b.width * b.height)))
 SELECT doc_id, page, type, label, x, y, width, height, confidence, {_SLUG("coalesce(raw, type || '_' || page || '_' || CAST(x AS INTEGER))")} AS name, raw IS NOT NULL AND coalesce(regexp_matches(said, '(?i)\\*\\s*$|required|mandatory'), false) AS required,
  'Enter ' || lower(raw) AS placeholder, CASE WHEN family < 2 AND type = 'email' THEN {lit(B.EMAIL_RULE)} WHEN family < 2 AND type = 'phone' THEN {lit(B.PHONE_RULE)} END AS rule, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, band, x, family, item_idx) - 1 AS INTEGER) AS seq
 FROM (SELECT *, sum(nb) OVER (PARTITION BY doc_id, page ORDER BY y DESC, family, item_idx) AS band FROM (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC, family, item_idx) - y <= 20 THEN 0 ELSE 1 END AS nb FROM t)))"""
_RUNS = f"(SELECT *, sum(nw) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run FROM (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY seq)) < 100 THEN 0 ELSE 1 END AS nw FROM {_FIELDS}))"

QUERIES = {
    "f1_items_to_lines": lambda s, d: L.items_to_lines(_items(s, d)),
    "f2_group_rows": _rows,
    "f3_detect_columns": lambda s, d: L.detect_columns(_rows(s, d)).select("doc_id", "page", F.array_join("starts", ",").alias("starts")),
    "f4_assign_cells": lambda s, d: _cells(s, d).select("doc_id", "page", "row", F.array_join("cells", "|").alias("cells")),
    "f5_table_confidence": lambda s, d: L.extract_tables(_items(s, d), min_confidence=0.0).select("doc_id", "page", F.round("confidence", 6).alias("confidence")),
    "f6_detect_header_rows": lambda s, d: _tables(s, d).select("doc_id", "page", (F.size("header_rows") > 0).alias("has_header")),
    "f7_extract_tables": lambda s, d: _joined(_tables(s, d)),
    "f8_table_counts": lambda s, d: L.table_counts(_tables(s, d)),
    "f10_edit_cells": lambda s, d: L.edit_cells(L.table_cells(_tables(s, d)), _edits(s, d)),
    "f11_heading_blocks": _blocks,
    "f12_heading_styles": lambda s, d: L.heading_styles(_blocks(s, d)),
    "f13_extract_headings": _headings,
    "f14_toc_hierarchy": lambda s, d: L.toc_hierarchy(_headings(s, d)).select("doc_id", "seq", "title", "level", "parent_seq"),
    "f15_toc_page_layout": lambda s, d: L.toc_page_layout(_headings(s, d), page_height=200.0),
    "f16_suggest_field_type": lambda s, d: views.form_items(s, d).select("doc_id", "item_idx", B.suggest_field_type(F.regexp_replace("str", r"[*]\s*$", "")).alias("t")).select("doc_id", "item_idx", "t.type", "t.confidence"),
    "f17_field_candidates": lambda s, d: B.field_candidates(views.form_items(s, d), views.form_pages(s, d)),
    "f18_nearby_labels": lambda s, d: B.nearby_labels(B.field_candidates(views.form_items(s, d), views.form_pages(s, d)).where("family < 2"), views.form_items(s, d)),
    "f19_detect_form_fields": _fields,
    "f20_form_groups": lambda s, d: B.form_groups(_fields(s, d)),
    "f21_form_structure": lambda s, d: B.form_structure(_fields(s, d)).withColumns({"mean_confidence": F.round("mean_confidence", 6), "form_confidence": F.round("form_confidence", 6)}),
    "f21_form_labels": lambda s, d: B.form_labels(_fields(s, d)),
    "f22_unique_field_names": lambda s, d: B.unique_field_names(_fields(s, d).select("doc_id", "seq", F.when(F.col("seq") % 3 == 2, F.lit("name_2")).when(F.col("seq") % 2 == 0, F.lit("name")).otherwise(F.col("name")).alias("name"))),
}
ORACLES = {
    "f1_items_to_lines": _LINES,
    "f2_group_rows": _ROWS,
    "f3_detect_columns": f"SELECT doc_id, page, string_agg(pos, ',' ORDER BY pos) AS starts FROM {_STARTS} GROUP BY ALL",
    "f4_assign_cells": f"SELECT doc_id, page, row, array_to_string(cells, '|') AS cells FROM {_CELLS}",
    "f5_table_confidence": f"SELECT doc_id, page, round(confidence, 6) AS confidence FROM {_TABLES.replace('WHERE confidence >= 0.5', '')}",
    "f6_detect_header_rows": f"SELECT doc_id, page, {_HEAD} AS has_header FROM {_TABLES}",
    "f7_extract_tables": f"SELECT doc_id, page, 0 AS table_idx, array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10)) AS rows, CAST({_HEAD} AS INTEGER) AS header_rows, row_count, column_count, round(confidence, 6) AS confidence, x, y, width, height FROM {_TABLES}",
    "f8_table_counts": f"SELECT doc_id, page, count(*) AS tables FROM {_TABLES} GROUP BY ROLLUP (doc_id, page)",
    "f10_edit_cells": f"SELECT c.doc_id, c.page, 0 AS table_idx, c.row, c.col, coalesce(e.v, c.value) AS value FROM {_TABLE_CELLS} c LEFT JOIN (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS row, l_partkey % 6 AS col, 'edit ' || CAST(max(l_partkey) AS VARCHAR) AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3) e ON c.doc_id = e.doc_id AND c.page = 1 AND c.row = e.row AND c.col = e.col",
    "f11_heading_blocks": f"SELECT * FROM {_BLOCKS}",
    "f12_heading_styles": f"SELECT * FROM {_STYLES}",
    "f13_extract_headings": f"SELECT * FROM {_HEADINGS}",
    "f14_toc_hierarchy": f"WITH h AS {_HEADINGS} SELECT doc_id, seq, title, level, (SELECT max(p.seq) FROM h p WHERE p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level) AS parent_seq FROM h",
    "f15_toc_page_layout": f"WITH h AS {_HEADINGS}, n AS (SELECT doc_id, CAST(ceil(count(*) / 2.0) AS INTEGER) AS toc_pages FROM h GROUP BY doc_id) SELECT doc_id, seq, title, level, toc_pages, page + toc_pages AS shown_page FROM h JOIN n USING (doc_id)",
    "f16_suggest_field_type": f"SELECT doc_id, item_idx, t.type AS type, t.confidence AS confidence FROM (SELECT doc_id, item_idx, {_suggest('str')} AS t FROM (SELECT doc_id, item_idx, trim(regexp_replace(str, '[*]\\s*$', '')) AS str FROM ({_F})))",
    "f17_field_candidates": f"SELECT * FROM {_CANDIDATES}",
    "f18_nearby_labels": f"SELECT c.doc_id, c.page, c.family, c.item_idx, label_text FROM {_CANDIDATES} c LEFT JOIN {_NEAR} n ON n.doc_id = c.doc_id AND n.page = c.page AND n.family = c.family AND n.item_idx = c.item_idx WHERE c.family < 2",
    "f19_detect_form_fields": f"SELECT * FROM {_FIELDS}",
    "f20_form_groups": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, run) AS INTEGER) AS section, page, count(*) AS fields, min(seq) AS first_seq, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM {_RUNS} GROUP BY doc_id, page, run HAVING count(*) > 1",
    "f21_form_structure": f"SELECT doc_id, fields, round(m, 6) AS mean_confidence, fields >= 3 AND m >= 40 AS is_form, round(least(100.0, fields * 5 + m), 6) AS form_confidence, nullif(top, 'Name') AS title FROM (SELECT doc_id, count(*) AS fields, avg(confidence) AS m, arg_max(label, y * 1000 - seq) FILTER (page = 1) AS top FROM {_FIELDS} GROUP BY doc_id)",
    "f21_form_labels": f"SELECT doc_id, page, seq, label AS text, x - 100 AS x, y, CAST(95 AS DOUBLE) AS width, height FROM {_FIELDS}",
}
