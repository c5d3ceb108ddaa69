"""Queries of text conversion, page manifests and request windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import manifest as I
from quire.operators import texts as B

from . import views
from .duck import lit
from .views import load


def _chain(text: str, steps) -> str:
    for pattern, new in steps:
        new = new.replace("\\", "\\\\").replace("$1", "\\1")
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(new)}, 'g')"
    return text


_MD = "'# ' || source || chr(10) || '## part ' || doc_id || chr(10) || chr(10) || '* one **bold** item' || chr(10) || '- two *it* & <x>' || chr(10) || chr(10) || text"
_ITEMS = "SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page, l_linenumber * 10 + 1 AS item_idx, 'part ' || l_partkey AS str, false AS has_eol FROM lineitem UNION ALL SELECT l_orderkey, 1 + l_linenumber % 2, l_linenumber * 10 + 2, l_returnflag || l_suppkey, true FROM lineitem"


def items(s, d):
    rows = load(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "1 + l_linenumber % 2 AS page", "explode(array(named_struct('item_idx', l_linenumber * 10 + 1, 'str', concat('part ', cast(l_partkey as string)), 'has_eol', false), named_struct('item_idx', l_linenumber * 10 + 2, 'str', concat(l_returnflag, cast(l_suppkey as string)), 'has_eol', true))) AS i")
    return rows.select("doc_id", "page", "i.*")


_PAGES = "(SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS page, 500 + 7 * l_partkey % 900 AS byte_size, l_partkey FROM lineitem)"


def pages(s, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("page"), F.expr("500 + 7 * l_partkey % 900").alias("byte_size"), "l_partkey")


_SPEC = "(CASE o_orderkey % 4 WHEN 0 THEN '1-2, 3' WHEN 1 THEN '2' WHEN 2 THEN '3-1' ELSE ' 1 - 1 ,, 2' END)"


def specs(s, d):
    return load(s, d, "orders").selectExpr("o_orderkey AS doc_id", f"{_SPEC} AS spec")


def requests(s, d):
    return load(s, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


_LAST = f"(SELECT doc_id, max(page) AS last FROM {_PAGES} GROUP BY doc_id)"
_ESC = "text"
for _a, _b in B.ESCAPES:
    _ESC = f"replace({_ESC}, {lit(_a)}, {lit(_b)})"

QUERIES = {
    "a2_content_hash": lambda s, d: B.content_hash(load(s, d, "documents")),
    "a3_page_text_lines": lambda s, d: B.assemble_page_text(items(s, d), "lines"),
    "a3_page_text_flat": lambda s, d: B.assemble_page_text(items(s, d), "flat"),
    "a4_full_text": lambda s, d: B.full_text(B.assemble_page_text(items(s, d), "eol")),
    "b1_html_to_text": lambda s, d: load(s, d, "pages").select("page_id", B.html_to_text(F.col("html")).alias("text")),
    "b2_markdown_to_html": lambda s, d: load(s, d, "documents").selectExpr("doc_id", f"{_MD} AS md").select("doc_id", B.markdown_to_html(F.col("md")).alias("html")),
    "b3_escape_html": lambda s, d: load(s, d, "documents").select("doc_id", B.escape_html(F.col("text")).alias("html")),
    "b4_split_paragraphs": lambda s, d: B.split_paragraphs(load(s, d, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ". \n \n").alias("text"))),
    "b5_ocr_fallback": lambda s, d: B.ocr_fallback(views.doc_pages(s, d).withColumn("text", F.expr("CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, 40) ELSE text END")), views.doc_pages(s, d).where("doc_id % 2 = 0")),
    "b6_ocr_languages": lambda s, d: load(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).select("lang", F.col("lang").isin(*B.OCR_LANGUAGES).alias("valid"), "documents"),
    "f9_text_table_rows": lambda s, d: B.text_table_rows(load(s, d, "documents").select("doc_id", F.lit(1).alias("page"), F.regexp_replace("text", ", ", "   ").alias("text"))),
    "i1_parse_page_ranges": lambda s, d: specs(s, d).select("doc_id", F.to_json(I.parse_page_ranges(F.col("spec"), (F.col("doc_id") % 5).cast("int"))).alias("ranges")),
    "i2_split_by_ranges": lambda s, d: I.split_by_ranges(pages(s, d), specs(s, d)),
    "i2_split_every": lambda s, d: I.split_every(pages(s, d), 2),
    "i3_split_by_size": lambda s, d: I.split_by_size(pages(s, d), 2200),
    "i4_split_by_bookmark": lambda s, d: I.split_by_bookmark(pages(s, d), pages(s, d).where("l_partkey % 3 = 1").select("doc_id", "page")),
    "i5_remove_pages": lambda s, d: I.remove_pages(pages(s, d), pages(s, d).where("l_partkey % 4 = 0").select("doc_id", "page")),
    "i6_merge_plan": lambda s, d: I.merge_plan(pages(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count")).selectExpr("doc_id % 300 AS bundle", "doc_id AS position", "doc_id", "page_count")),
    "i7_page_labels": lambda s, d: I.page_labels(pages(s, d), "custom", "p. {page}/{total}"),
    "i9_bates_numbers": lambda s, d: I.bates_numbers(pages(s, d), "B-", "", 7, 5),
    "i13_image_inventory": lambda s, d: I.image_inventory(load(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page", "concat('im', cast(l_partkey % 5 as string)) AS object_name", "l_partkey % 90 AS width", "10 + l_suppkey % 70 AS height"), 10, 10),
    "m3_rate_limit": lambda s, d: I.rate_limit(requests(s, d), 3, 86_400_000),
    "m4_request_counts": lambda s, d: I.request_counts(load(s, d, "events").select("ts", F.col("event_type").alias("kind"), F.col("user_id").alias("client")), "6 hours"),
}
ORACLES = {
    "a2_content_hash": "SELECT doc_id, sha256(text) AS sha256, to_base64(encode(text)) AS base64 FROM documents",
    "a3_page_text_lines": f"SELECT doc_id, page, trim(regexp_replace(string_agg(str || CASE WHEN has_eol THEN chr(10) ELSE ' ' END, '' ORDER BY item_idx, str), ' +\\n', chr(10), 'g')) AS text FROM ({_ITEMS}) GROUP BY ALL",
    "a3_page_text_flat": f"SELECT doc_id, page, string_agg(str, ' ' ORDER BY item_idx, str) AS text FROM ({_ITEMS}) GROUP BY ALL",
    "a4_full_text": f"SELECT doc_id, trim(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS text, CAST(length(trim(string_agg(text, chr(10) || chr(10) ORDER BY page))) AS INTEGER) AS characters FROM (SELECT doc_id, page, string_agg(str || CASE WHEN has_eol THEN chr(10) ELSE '' END, '' ORDER BY item_idx, str) AS text FROM ({_ITEMS}) GROUP BY ALL) GROUP BY doc_id",
    "b1_html_to_text": f"SELECT page_id, regexp_replace({_chain('html', B.HTML_TO_TEXT)}, '^\\s+|\\s+$', '', 'g') AS text FROM pages",
    "b2_markdown_to_html": f"SELECT doc_id, {_chain('md', B.MARKDOWN_TO_HTML)} AS html FROM (SELECT doc_id, {_MD} AS md FROM documents)",
    "b3_escape_html": f"SELECT doc_id, {_ESC} AS html FROM documents",
    "b4_split_paragraphs": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph, regexp_replace(b[i], '(?m)[ \\t]+$', '', 'g') AS text FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(replace(text, '. ', '. ' || chr(10) || ' ' || chr(10)), '\\n\\s*\\n'), lambda x: length(trim(x)) > 0) AS b FROM documents))",
    "b5_ocr_fallback": f"WITH p AS ({views.DOC_PAGES}), q AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, 40) ELSE text END AS t, text AS seen FROM p) SELECT doc_id, page, CASE WHEN length(trim(t)) > 50 OR doc_id % 2 = 1 THEN t ELSE seen END AS text, CASE WHEN length(trim(t)) > 50 OR doc_id % 2 = 1 THEN 'text' ELSE 'ocr' END AS source FROM q",
    "b6_ocr_languages": f"SELECT lang, lang IN ({', '.join(map(lit, B.OCR_LANGUAGES))}) AS valid, count(*) AS documents FROM documents GROUP BY lang",
    "f9_text_table_rows": "SELECT doc_id, 1 AS page, CAST(i - 1 AS INTEGER) AS row, r[i] AS cells FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, ', ', '   '), chr(10)), lambda x: list_filter(string_split_regex(trim(x), '\\t+| {2,}'), lambda c: length(trim(c)) > 0)), lambda c: len(c) >= 2) AS r FROM documents) WHERE len(r) >= 2)",
    "i1_parse_page_ranges": "SELECT doc_id, CASE WHEN k = 0 AND last >= 3 THEN '[{\"start\":1,\"end\":2},{\"start\":3,\"end\":3}]' WHEN k = 1 AND last >= 2 THEN '[{\"start\":2,\"end\":2}]' WHEN k = 3 AND last >= 2 THEN '[{\"start\":1,\"end\":1},{\"start\":2,\"end\":2}]' END AS ranges FROM (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k, o_orderkey % 5 AS last FROM orders)",
    "i2_split_by_ranges": f"""WITH r AS (SELECT doc_id, CAST(part AS INTEGER) AS part, a, b, k, last FROM (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k FROM orders) JOIN {_LAST} USING (doc_id) LEFT JOIN (VALUES (0, 1, 1, 2), (0, 2, 3, 3), (1, 1, 2, 2), (3, 1, 1, 1), (3, 2, 2, 2)) v(kk, part, a, b) ON kk = k),
 g AS (SELECT doc_id, bool_and(a IS NOT NULL AND b <= last) AS good FROM r GROUP BY doc_id)
 SELECT r.doc_id, part, page, CAST(NULL AS VARCHAR) AS error FROM r JOIN g ON g.doc_id = r.doc_id AND good JOIN {_PAGES} p ON p.doc_id = r.doc_id AND page BETWEEN a AND b UNION ALL SELECT doc_id, NULL, NULL, 'INVALID_RANGE' FROM g WHERE NOT good""",
    "i2_split_every": f"SELECT doc_id, CAST(floor((page - 1) / 2) + 1 AS INTEGER) AS part, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM {_PAGES} GROUP BY 1, 2",
    "i3_split_by_size": f"WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, page, byte_size FROM {_PAGES}), r AS (SELECT doc_id, page, 1 AS part, byte_size AS used FROM p WHERE page = 1 UNION ALL SELECT p.doc_id, p.page, CASE WHEN used + byte_size > 2200 THEN part + 1 ELSE part END, CASE WHEN used + byte_size > 2200 THEN byte_size ELSE used + byte_size END FROM r JOIN p ON p.doc_id = r.doc_id AND p.page = r.page + 1) SELECT doc_id, part, page FROM r",
    "i4_split_by_bookmark": f"WITH b AS (SELECT doc_id, page AS start FROM {_PAGES} WHERE l_partkey % 3 = 1), s AS (SELECT DISTINCT doc_id, start FROM (SELECT * FROM b UNION ALL SELECT doc_id, 1 FROM b)) SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS part, start, coalesce(lead(start) OVER w - 1, last) AS \"end\" FROM s JOIN {_LAST} USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)",
    "i5_remove_pages": f"SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS new_page FROM {_PAGES} WHERE l_partkey % 4 <> 0",
    "i6_merge_plan": f"SELECT doc_id % 300 AS bundle, doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id % 300 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset, n AS page_count FROM (SELECT doc_id, count(*) AS n FROM {_PAGES} GROUP BY doc_id)",
    "i7_page_labels": f"SELECT doc_id, page, 'p. ' || page || '/' || count(*) OVER (PARTITION BY doc_id) AS label FROM {_PAGES}",
    "i9_bates_numbers": f"SELECT doc_id, page, 'B-' || CASE WHEN length(CAST(n AS VARCHAR)) < 5 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END AS bates FROM (SELECT doc_id, page, 6 + row_number() OVER (ORDER BY doc_id, page) AS n FROM {_PAGES})",
    "i13_image_inventory": "SELECT doc_id, page, count(*) AS images, CAST(sum(px) AS BIGINT) AS pixels FROM (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey % 5 AS o, max((l_partkey % 90) * (10 + l_suppkey % 70)) AS px FROM lineitem WHERE l_partkey % 90 >= 10 GROUP BY ALL) GROUP BY ALL",
    "m3_rate_limit": """WITH RECURSIVE p AS MATERIALIZED (SELECT user_id AS client, event_id AS request_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
 r AS (SELECT client, request_id, n, t, t + 86400000 AS reset, 1 AS used FROM p WHERE n = 1 UNION ALL SELECT p.client, p.request_id, p.n, p.t, CASE WHEN reset <= p.t THEN p.t + 86400000 ELSE reset END, CASE WHEN reset <= p.t THEN 1 ELSE used + 1 END FROM r JOIN p ON p.client = r.client AND p.n = r.n + 1)
 SELECT client, request_id, used <= 3 AS allowed, CASE WHEN used <= 3 THEN 0 ELSE CAST(ceil((reset - t) / 1000.0) AS BIGINT) END AS retry_after FROM r""",
    "m4_request_counts": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type AS kind, count(*) AS requests, count(DISTINCT user_id) AS clients FROM events GROUP BY ALL",
}
