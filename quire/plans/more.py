"""Queries of the exports, enhanced classes, prompts, page jobs, library, log and stream operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quire.functions.shared import materialised, shared_folder
from quire.operators import classify as D
from quire.operators import geometry as G
from quire.operators import history as K
from quire.operators import layout as L
from quire.operators import library as J
from quire.operators import manifest as I
from quire.operators import retrieval as R
from quire.operators import search as S
from quire.operators import texts as B
from quire.sinks import exports as X
from quire.sources import files as A
from quire.streaming import jobs as M

from . import classify, corpus, entities, layout, pages, records, views
from .duck import find, lit, rx
from .views import load

BIZ, biz = views.BIZ, views.biz_pages
_NL = "chr(10)"


# --- Sources and sinks ---------------------------------------------------------------------------------------------
def _files(s, d):
    return load(s, d, "documents").selectExpr("concat('f', cast(doc_id as string)) AS path", "CASE doc_id % 4 WHEN 0 THEN cast(concat('%PDF-1.4 ', text) as binary) WHEN 1 THEN cast('' as binary) WHEN 2 THEN cast(text as binary) ELSE cast(concat('%PDF-', substring(text, 1, 20)) as binary) END AS content")


def _entities_back(s, d):
    """All kinds written as CSV and read again: the fields of each in their order."""
    path = shared_folder(s, "entities")
    X.write_entities(biz(s, d), path)
    out = None
    for kind, columns in X.CSV_COLUMNS.items():
        rows = s.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(f"{path}/{kind}")
        part = rows.select("doc_id", F.lit(kind).alias("kind"), F.concat_ws("|", *[F.coalesce(F.col(f"`{h}`"), F.lit("")) for h, _ in columns]).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


def _archive(s, d):
    """The library's documents: half in the archive, changed, merged into the whole."""
    docs = records.library(s, d).select("id", "filename", "file_size", "status")
    path = shared_folder(s, "archive")
    X.export_library({"documents": docs.where("id % 2 = 0").withColumn("status", F.lit("restored"))}, path)
    return X.import_library(s, path, {"documents": docs.schema}, {"documents": docs}, merge=True)["documents"]


def _archive_errors(s, d):
    docs = load(s, d, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS current_version_id", "doc_id + 1 AS original_version_id")
    versions = load(s, d, "documents").where("doc_id % 7 > 0").selectExpr("doc_id AS id", "doc_id * 2 AS blob_id")
    blobs = load(s, d, "documents").where("doc_id % 9 > 0").selectExpr("doc_id * 2 AS id")
    artifacts = load(s, d, "events").selectExpr("event_id AS id", "user_id * 2 AS blob_id")
    return X.validate_archive(docs, versions, blobs, artifacts)


def _classes(s, d):
    return materialised(D.classify_documents(biz(s, d)), "classes")


def _exported_classes(s, d):
    files = load(s, d, "orders").selectExpr("o_orderkey AS doc_id", "concat('order ', cast(o_orderkey as string), '.pdf') AS filename")
    manual = load(s, d, "orders").where("o_orderkey % 13 = 0").selectExpr("o_orderkey AS doc_id", "'contract' AS type")
    return X.export_classifications(_classes(s, d), files, D.keyword_matches(biz(s, d)), manual)


def _log(s, d):
    return load(s, d, "events").selectExpr("event_id AS id", "event_type AS type", "ts AS timestamp", "concat(event_type, ' ', cast(user_id as string)) AS description", "user_id", "user_id % 2 = 0 AS can_undo",
        "CASE WHEN event_id % 3 = 0 THEN array(user_id % 10, event_id % 10) ELSE array(user_id % 10) END AS document_ids", "CASE WHEN event_id % 5 > 0 THEN concat('{\"beforeVersionId\": \"v', cast(event_id as string), '\"', CASE WHEN event_id % 5 > 1 THEN ', \"afterVersionId\": \"w\"' ELSE '' END, '}') END AS metadata", "array(concat('file', cast(event_id % 100 as string), '.pdf')) AS file_names")


_LOG = """(SELECT event_id AS id, event_type AS type, ts AS "timestamp", event_type || ' ' || user_id AS description, user_id, user_id % 2 = 0 AS can_undo, CASE WHEN event_id % 3 = 0 THEN [user_id % 10, event_id % 10] ELSE [user_id % 10] END AS document_ids,
 CASE WHEN event_id % 5 > 0 THEN '{"beforeVersionId": "v' || event_id || '"' || CASE WHEN event_id % 5 > 1 THEN ', "afterVersionId": "w"' ELSE '' END || '}' END AS metadata, user_id % 2 = 0 AND event_id % 3 > 0 AND event_id % 5 > 1 AS undo FROM events)"""


# --- Pages ---------------------------------------------------------------------------------------------------------
def _sheets(s, d):
    return load(s, d, "part").selectExpr("p_partkey AS doc_id", "explode(array(1, 2)) AS page", "cast(300 + p_partkey % 500 as double) AS width", "cast(400 + p_size * 11 as double) AS height", "cast(p_size * 45 - 360 as int) AS rotation")


_SHEETS = "(SELECT p_partkey AS doc_id, unnest([1, 2]) AS page, CAST(300 + p_partkey % 500 AS DOUBLE) AS width, CAST(400 + p_size * 11 AS DOUBLE) AS height, p_size * 45 - 360 AS rotation FROM part)"
_BOX = "l_orderkey AS doc_id, l_linenumber AS page, cast(600 + l_partkey % 20 as double) AS page_width, cast(800 as double) AS page_height, cast(10 + l_suppkey % 30 as double) AS x, cast(20 + l_partkey % 40 as double) AS y, cast(400 + l_quantity as double) AS width, cast(500 + l_partkey % 60 as double) AS height"
_ORDER_PAGES = "cast(l_orderkey as bigint) AS doc_id, l_linenumber AS page"


def _ocr(s, d):
    """Recognised pages: the words of an order line, nested in lines by supplier, in one paragraph and block for each flag."""
    words = load(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "1 AS page", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "named_struct('text', concat('w', cast(l_partkey as string)), 'confidence', cast(l_suppkey % 100 as double), 'bbox', named_struct('x0', cast(l_partkey % 500 as double), 'y0', cast(l_suppkey as double), 'x1', cast(l_partkey % 500 + 40 as double), 'y1', cast(l_suppkey + 12 as double))) AS w")
    ordered = lambda key, what, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, what))), lambda x: x[what])
    lines = words.groupBy("doc_id", "page", "l_returnflag", "l_linenumber").agg(ordered("w", "w", "l_partkey", "l_suppkey").alias("words"))
    paragraphs = lines.groupBy("doc_id", "page", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "words"))), lambda x: F.struct(x["words"].alias("words"))).alias("lines"))
    return paragraphs.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "lines"))), lambda x: F.struct(F.array(F.struct(x["lines"].alias("lines"))).alias("paragraphs"))).alias("blocks"))


_WORDS = """(SELECT l_orderkey AS doc_id, 1 AS page, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS INTEGER) AS block, 0 AS paragraph, CAST(dense_rank() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS INTEGER) AS line,
 CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber ORDER BY l_partkey, l_suppkey) - 1 AS INTEGER) AS word, 'w' || l_partkey AS text, CAST(l_suppkey % 100 AS DOUBLE) AS confidence, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y, CAST(40 AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM lineitem)"""


def _redactions(s, d):
    return load(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id", "cast(l_linenumber as int) - 1 AS page", "cast(l_partkey % 700 as double) - 20 AS x", "cast(l_suppkey * 9 as double) AS y", "cast(l_quantity - 1 as double) AS width", "cast(12 as double) AS height", "CASE WHEN l_partkey % 2 = 0 THEN 'text' ELSE 'area' END AS kind", "l_suppkey % 5 = 0 AS applied")


def _redaction_pages(s, d):
    return load(s, d, "orders").selectExpr("o_orderkey AS doc_id", "explode(sequence(1, cast(2 + o_orderkey % 4 as int))) AS page", "612.0D AS page_width", "792.0D AS page_height")


_MARKS = """concat('a, b ,c|signed:{"signerName": "S', cast(doc_id as string), '"', CASE WHEN doc_id % 3 = 0 THEN ', "fieldName": "F1", "pageNumber": 4' ELSE '' END, '}|signed:broken|sig:{"name": "P', cast(doc_id % 10 as string), '", "page": 2', CASE WHEN doc_id % 2 = 0 THEN ', "signed": true' ELSE '' END, '}')"""


def _marked_files(s, d):
    return load(s, d, "documents").selectExpr("doc_id", "cast(concat(text, CASE WHEN doc_id % 6 = 0 THEN ' /Encrypt 7 0 R ' ELSE '' END, substring(text, 1, 9)) as binary) AS content", f"{_MARKS} AS keywords")


# --- Retrieval -----------------------------------------------------------------------------------------------------
def _questions(s, d):
    return corpus._queries(s, d).selectExpr("query_id", "concat('What about ', cast(query_id as string), '?') AS question").unionByName(s.createDataFrame([(-1, "Anything?")], "query_id bigint, question string"))


def _attached(s, d):
    chunks = load(s, d, "documents").selectExpr("doc_id % 97 AS doc_id", "doc_id AS chunk_id", "n_chars")
    vectors = load(s, d, "embeddings").where("vec_id % 3 > 0").selectExpr("vec_id % 97 AS doc_id", "vec_id AS chunk_id", "embedding")
    return R.attach_embeddings(chunks, vectors)


# --- Log and streams -----------------------------------------------------------------------------------------------
def _edits(s, d):
    return load(s, d, "events").selectExpr("user_id AS document_id", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'add' END AS action", "event_id % 7 > 0 AS can_undo")


_OPERATIONS = """event_id AS id, (CASE event_id % 7 WHEN 0 THEN 'security' WHEN 1 THEN 'watermark' WHEN 2 THEN 'split' WHEN 3 THEN 'crop' WHEN 4 THEN 'compress' WHEN 5 THEN 'convert' ELSE 'ocr' END) AS type,
 (CASE event_id % 7 WHEN 0 THEN (CASE user_id % 4 WHEN 0 THEN '{"ownerPassword": " "}' WHEN 1 THEN '{"ownerPassword": "p", "userPassword": "p"}' WHEN 2 THEN '{"ownerPassword": "p", "serverConsent": true}' ELSE '{"ownerPassword": "p"}' END)
 WHEN 1 THEN (CASE WHEN user_id % 2 = 0 THEN '{"text": "DRAFT"}' ELSE '{"text": "  "}' END) WHEN 2 THEN (CASE user_id % 3 WHEN 0 THEN '{"mode": "range"}' WHEN 1 THEN '{"mode": "range", "ranges": "1-2"}' ELSE '{"mode": "single"}' END)
 WHEN 3 THEN (CASE user_id % 4 WHEN 0 THEN '{"cropMode": "percentage", "cropPercent": {"left": 0, "right": 5, "top": 0, "bottom": 0}}' WHEN 1 THEN '{"cropMode": "absolute", "cropBox": {"width": 10, "height": 0}}' WHEN 2 THEN '{"cropMode": "absolute", "cropBox": {"width": 10, "height": 5}}' ELSE '{}' END)
 WHEN 4 THEN (CASE WHEN user_id % 2 = 0 THEN '{"level": "maximum"}' ELSE '{"level": "low"}' END) WHEN 5 THEN (CASE user_id % 3 WHEN 0 THEN '{"format": "docx", "serverConsent": true}' WHEN 1 THEN '{"format": "xlsx"}' ELSE '{"format": "html"}' END) ELSE (CASE WHEN user_id % 2 = 0 THEN '{"engine": "server", "serverConsent": false}' ELSE '{"engine": "browser"}' END) END) AS options"""
_VALID = """CASE WHEN type = 'security' AND k4 = 0 THEN 'Owner password required' WHEN type = 'security' AND k4 = 1 THEN 'Passwords must be different' WHEN type = 'watermark' AND user_id % 2 = 1 THEN 'Watermark text required' WHEN type = 'split' AND user_id % 3 = 0 THEN 'Page range required'
 WHEN type = 'crop' AND k4 IN (1, 3) THEN 'Crop values required' WHEN (type = 'security' AND k4 = 3) OR (type = 'compress' AND user_id % 2 = 0) OR (type = 'convert' AND user_id % 3 = 1) OR (type = 'ocr' AND user_id % 2 = 0) THEN 'Upload consent required' END"""


def _talks(s, d):
    """Conversations with their messages, cited pages and documents."""
    messages = load(s, d, "conversations").selectExpr("conv_id", "turn", "named_struct('role', role, 'text', text, 'citations', CASE WHEN role = 'assistant' THEN transform(sequence(1L, 1 + (conv_id + turn) % 5), i -> named_struct('document_id', (conv_id * i) % 7, 'page', (turn + i) % 3)) END) AS m")
    return messages.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("messages"))


def _talk_heads(s, d):
    return load(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).selectExpr("conv_id", "array(conv_id % 5, conv_id % 3) AS document_ids", "timestamp'2024-01-01 00:00:00' + make_dt_interval(cast((conv_id * 37) % 50 as int)) AS updated_at")


_CITED = "(SELECT conv_id, turn, unnest(range(1, 2 + (conv_id + turn) % 5)) AS i FROM conversations WHERE role = 'assistant')"


def _events(s, d):
    """The events table as a stream."""
    schema = load(s, d, "events").schema
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/events.parque[t]")


def _job_events(s, d):
    return _events(s, d).selectExpr("event_id", "user_id * 1000 + dayofmonth(ts) AS job_id", "ts AS updated_at", f"{records._STATUS} AS status")


_JOBS = f"(SELECT event_id, user_id * 1000 + dayofmonth(ts) AS job_id, ts AS updated_at, {records._STATUS} AS status FROM events)"
_LINE = """CASE WHEN turn % 7 = 6 THEN 'data: {broken' WHEN turn % 5 = 4 THEN ': ping' ELSE 'data: {"id": "c' || cast(conv_id as string) || '", "choices": [{"delta": ' || to_json(named_struct('content', text)) || ', "finish_reason": ' || CASE WHEN turn >= 3 THEN '"stop"' ELSE 'null' END || '}]}' END"""


def _chat_lines(s, d):
    return load(s, d, "conversations").selectExpr("conv_id AS stream_id", "turn AS seq", f"{_LINE} AS line")


def _orders_stream(s, d):
    schema = load(s, d, "orders").schema
    rows = s.readStream.schema(schema).parquet(f"{d}/orders.parque[t]").select("o_orderkey", "o_custkey", "o_totalprice")
    # A file is few splits: the text work of a micro-batch goes over all cores.
    rows = rows.repartition(max(s.sparkContext.defaultParallelism, -(-load(s, d, "orders").count() // views.PAGES_A_TASK)), "o_orderkey")
    return rows.selectExpr(*views._list(views.BIZ_SELECT))


def _streamed_counts(s, d):
    """Documents of each class, as the stream's last update of each."""
    kinds = D.quick_classify(_orders_stream(s, d)).select("type")
    return M.latest(M.replayed(M.type_counts(kinds, "type"), "classes", "update"), "kind")


def _events_now(s, d):
    return load(s, d, "events")


QUERIES = {
    "a1_validated_files": lambda s, d: A.validated(_files(s, d)).select("path", "length", "error", A.image_type(F.col("content")).alias("image_type")),
    "a5_entity_csv_lines": lambda s, d: X.entity_csv_lines(biz(s, d)),
    "a5_write_entities": _entities_back,
    "a6_table_lines": lambda s, d: X.table_lines(layout._tables(s, d), ";", headers=False),
    "a6_table_text": lambda s, d: X.table_text(layout._tables(s, d)),
    "a6_table_objects": lambda s, d: X.table_objects(layout._tables(s, d)),
    "a7_typed_grid": lambda s, d: X.typed_grid(L.table_cells(layout._tables(s, d))),
    "a7_column_widths": lambda s, d: X.table_widths(layout._tables(s, d)),
    "a8_import_library": _archive,
    "a9_validate_archive": _archive_errors,
    "a10_export_classifications": _exported_classes,
    "a11_export_history": lambda s, d: X.export_history(_log(s, d)).withColumn("document_ids", F.array_join(F.col("document_ids").cast("array<string>"), ",")),
    "b3_pages_to_html": lambda s, d: B.pages_to_html(views.doc_pages(s, d), load(s, d, "documents").where("doc_id % 2 = 0").selectExpr("doc_id", "concat('A & ', source) AS title")),
    "b6_valid_ocr_language": lambda s, d: load(s, d, "documents").select("doc_id", B.valid_ocr_language(F.when(F.col("doc_id") % 3 == 0, F.lit("deu")).otherwise(F.col("lang"))).alias("valid")),
    "d3_has_table_layout": lambda s, d: biz(s, d).select("doc_id", D.has_table_layout(F.col("text")).alias("has_table")),
    "d8_classify_enhanced": lambda s, d: D.classify_enhanced(biz(s, d), load(s, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS doc_id", "CASE o_orderkey % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'invoice' ELSE 'contract' END AS ml_type", "cast(50 + o_orderkey % 51 as int) AS ml_confidence")),
    "d9_classification_summary": lambda s, d: D.classification_summary(_classes(s, d)),
    "d9_classification_rollup": lambda s, d: D.classification_rollup(_classes(s, d).withColumn("source", (F.col("doc_id") % 4).cast("int")), "source"),
    "d10_suggest_questions": lambda s, d: D.suggest_questions(biz(s, d)),
    "e3_match_rects": lambda s, d: S.match_rects(S.search_text(B.assemble_page_text(_clean_items(s, d), "eol"), r"\d\d", regex=True), _clean_items(s, d)),
    "h6_build_prompts": lambda s, d: R.build_prompts(_questions(s, d), corpus._hits(s, d), 9000),
    "h7_attach_embeddings": lambda s, d: R.indexed_documents(_attached(s, d)),
    "h8_index_forced": lambda s, d: R.index_incremental(corpus._chunks(s, d).where("doc_id % 5 = 0").select("chunk_id", "doc_id"), corpus._chunks(s, d).where("doc_id % 2 = 0 and chunk_id % 3 = 0").select("chunk_id", "doc_id"), force=True),
    "i2_split_parts": lambda s, d: I.split_plan(pages.pages(s, d), "parts", parts=3, prefix="part"),
    "i2_split_pages": lambda s, d: I.split_plan(pages.pages(s, d), "pages", (3, 1)),
    "i2_split_even": lambda s, d: I.split_plan(pages.pages(s, d), "even"),
    "i2_split_single": lambda s, d: I.split_plan(pages.pages(s, d), "single"),
    "i5_extract_pages": lambda s, d: I.extract_pages(pages.pages(s, d), load(s, d, "orders").selectExpr("o_orderkey AS doc_id", "explode(array(2, 1, 2, cast(1 + o_orderkey % 4 as int))) AS page")),
    "i5_emptied_documents": lambda s, d: I.emptied_documents(pages.pages(s, d), pages.pages(s, d).where("l_partkey % 4 > 0").select("doc_id", "page")),
    "i5_reorder_pages": lambda s, d: I.reorder_pages(pages.pages(s, d), load(s, d, "orders").selectExpr("o_orderkey AS doc_id", "array(3, cast(1 + o_orderkey % 2 as int), 9, 4) AS `order`")),
    "i8_header_footer_text": lambda s, d: G.header_footer_text(pages.pages(s, d), "{page} of {total}", odd="p. {page} ({date})", day="2024-05-06", start_page=2, end_page=6),
    "i10_page_geometry": lambda s, d: _geometry(s, d),
    "i10_units": lambda s, d: load(s, d, "part").select("p_partkey", F.round(G.to_points(F.col("p_size"), "mm"), 6).alias("mm"), F.round(G.to_points(F.col("p_size"), "px"), 6).alias("px"), F.round(G.from_points(F.col("p_size"), "in"), 6).alias("inches")),
    "i11_uniform_trim": lambda s, d: G.uniform_trim(load(s, d, "lineitem").selectExpr(*views._list(_BOX))),
    "i12_compression_estimates": lambda s, d: G.compression_estimates(load(s, d, "orders").selectExpr("o_orderkey AS doc_id", "cast(o_totalprice * 100 as bigint) AS byte_size", "o_custkey % 120 AS page_count")),
    "i12_compression_stats": lambda s, d: G.compression_stats(load(s, d, "lineitem").selectExpr("l_returnflag AS operation", "l_partkey + 1 AS original_size", "l_suppkey * 15 + 1 AS processed_size")).withColumn("mean_ratio", F.round("mean_ratio", 6)),
    "i14_ocr_flatten": lambda s, d: G.ocr_flatten(_ocr(s, d)),
    "i14_ocr_text_layer": lambda s, d: G.ocr_text_layer(G.ocr_flatten(_ocr(s, d)), load(s, d, "orders").selectExpr("o_orderkey AS doc_id", "1 AS page", "cast(700 + o_orderkey % 90 as double) AS page_height"), 4.0).withColumn("font_size", F.round("font_size", 6)),
    "i14_ocr_stats": lambda s, d: G.ocr_stats(load(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page", "l_suppkey % 100 AS confidence", "l_partkey * 1000 AS pixels")).withColumn("mean_confidence", F.round("mean_confidence", 6)),
    "i15_redaction_plan": lambda s, d: G.redaction_plan(_redactions(s, d), _redaction_pages(s, d), 144, most=8),
    "i16_security_scan": lambda s, d: G.security_scan(_marked_files(s, d)).select("doc_id", "encrypted", "may_edit", F.array_join("keywords", "+").alias("keywords")),
    "i16_signature_marks": lambda s, d: G.signature_marks(_marked_files(s, d)),
    "i16_blank_metadata": lambda s, d: G.blank_metadata(load(s, d, "documents").selectExpr("doc_id", "source AS title", "lang AS author", "source AS producer"), "none"),
    "j2_favourites": lambda s, d: J.favourites(records.library(s, d).withColumn("updated_at", F.col("created_at")), 7).select("id", "filename"),
    "j2_top_accessed": lambda s, d: J.top_accessed(_events_now(s, d).where("event_type = 'view'").selectExpr("user_id AS document_id", "ts AS at")),
    "j3_content_stats": lambda s, d: J.content_stats(load(s, d, "documents").selectExpr("CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 50) END AS thumbnail"), load(s, d, "conversations").withColumn("text", F.regexp_replace("text", r'["\\\n\r\t\x00-\x1f]', " ")), load(s, d, "embeddings")),
    "j7_version_history": lambda s, d: J.version_history(records.versions(s, d)),
    "j9_folder_tree": lambda s, d: J.folder_tree(_folders(s, d)),
    "j9_delete_folder": lambda s, d: J.delete_folder(_folders(s, d), _filed(s, d), 3, 1)[1],
    "j11_annotation_counts": lambda s, d: J.annotation_counts(_annotations(s, d)),
    "j11_move_annotations": lambda s, d: J.move_annotations(J.filter_annotations(_annotations(s, d), kind="click"), _events_now(s, d).where("event_id % 6 = 0").selectExpr("event_id AS id", "9 AS to_page"), datetime.datetime(2024, 3, 1)),
    "j12_duration": lambda s, d: load(s, d, "orders").select("o_orderkey", J.duration(F.expr("cast(o_orderkey * o_orderkey * 7 - 3 as bigint)")).alias("duration")),
    "j12_relative_time": lambda s, d: load(s, d, "orders").select("o_orderkey", J.relative_time(F.col("o_orderdate"), F.lit(datetime.datetime(2000, 1, 1)).cast("timestamp")).alias("ago")),
    "j12_file_names": lambda s, d: _names(s, d),
    "j13_chunk_rows": lambda s, d: J.chunk_rows(records.library(s, d).select("folder_id", "id"), 7, "folder_id", "id"),
    "k1_history_labels": lambda s, d: _log(s, d).select("id", K.type_label(F.when(F.col("id") % 3 == 0, F.lit("extract_images")).when(F.col("id") % 3 == 1, F.lit("ocr")).otherwise(F.col("type"))).alias("label")),
    "k3_recent_operations": lambda s, d: K.recent_operations(records.history(s, d), 15).select("id", "type"),
    "k3_clear_range": lambda s, d: K.clear_range(records.history(s, d), 2, 40).select("id", "user_id"),
    "k4_operations_for_document": lambda s, d: K.operations_for_document(_log(s, d), 3).select("id", "user_id"),
    "k4_operations_by_document": lambda s, d: K.operations_by_document(_log(s, d)),
    "k5_history_replay": lambda s, d: K.history_replay(_edits(s, d), 10),
    "k7_validate_operations": lambda s, d: K.validate_operations(_events_now(s, d).selectExpr(*views._list(_OPERATIONS))),
    "l1_explode_conversations": lambda s, d: K.explode_conversations(_talks(s, d)).select("conv_id", "turn", "role", "text"),
    "l2_conversations_for_document": lambda s, d: K.conversations_for_document(_talk_heads(s, d), 1).select("conv_id"),
    "l2_recent_conversations": lambda s, d: K.recent_conversations(_talk_heads(s, d), 12).select("conv_id", "updated_at"),
    "l2_message_counts": lambda s, d: K.message_counts(load(s, d, "conversations")),
    "l4_validate_chat_options": lambda s, d: K.validate_chat_options(_events_now(s, d).selectExpr("event_id AS request_id", "CASE WHEN event_id % 5 = 0 THEN 'a b' ELSE 'org/model:free' END AS model", "CASE WHEN event_id % 7 > 0 THEN value / 20 END AS temperature", "user_id * 500 AS max_tokens")),
    "l6_citation_usage": lambda s, d: K.citation_usage(K.explode_conversations(_talks(s, d))),
    "m1_job_lifecycle_stream": lambda s, d: M.replayed(M.job_lifecycle(_job_events(s, d), "31 days"), "jobs").where("outcome <> 'expired'").select("job_id", "event_id", "status", "outcome"),
    "m2_expire_jobs": lambda s, d: M.expire_jobs(_events_now(s, d).selectExpr("event_id", "user_id * 1000 + dayofmonth(ts) AS job_id", "ts AS updated_at", f"{records._STATUS} AS status"), datetime.datetime(2024, 1, 20), 3600),
    "m2_expire_jobs_stream": lambda s, d: M.replayed(M.job_lifecycle(_job_events(s, d), "0 seconds", 86_400), "expired").where("outcome = 'expired'").select("job_id", "at"),
    "m3_rate_limit_stream": lambda s, d: M.replayed(M.rate_limit(_events(s, d).selectExpr("user_id AS client", "event_id AS request_id", "ts"), 3, 86_400_000, "31 days"), "requests"),
    "m4_request_counts_stream": lambda s, d: M.replayed(M.request_counts(_events(s, d).selectExpr("ts", "event_type AS kind"), "6 hours", late="1 hour"), "counts"),
    "m4_sliding_counts": lambda s, d: M.request_counts(_events_now(s, d).selectExpr("ts", "event_type AS kind"), "6 hours", "2 hours"),
    "m4_session_counts": lambda s, d: M.session_counts(_events_now(s, d).selectExpr("ts", "user_id AS client"), "8 hours"),
    "m5_assemble_chat_stream": lambda s, d: M.assemble_chat_stream(_chat_lines(s, d)),
    "m6_stream_key_information": lambda s, d: M.replayed(entities.E.extract_key_information(_orders_stream(s, d)), "entities"),
    "m6_stream_classify": _streamed_counts,
}


def _clean_items(s, d):
    return views.text_items(s, d).select("doc_id", "page", "item_idx", "str", "x", "y", "width", "height", "has_eol")


def _geometry(s, d):
    rows = G.page_geometry(_sheets(s, d), "A5", True, (10, 5, 2, 3), (36.0, 20.0, 10.0, 5.0), 95)
    flat = [F.round(f"{b}.{f}", 6).alias(f"{b}_{f}") for b, fs in (("crop", "x y width height"), ("inner", "x y width height"), ("sized", "width height scale dx dy")) for f in fs.split()]
    return rows.select("doc_id", "page", *flat, "rotation")


def _folders(s, d):
    """Regions, their nations and those nations' suppliers, as folders of three levels, and a ring of two."""
    regions = load(s, d, "region").selectExpr("cast(r_regionkey as bigint) AS id", "cast(NULL as bigint) AS parent_id")
    nations = load(s, d, "nation").selectExpr("cast(100 + n_nationkey as bigint) AS id", "cast(n_regionkey as bigint) AS parent_id")
    suppliers = load(s, d, "supplier").selectExpr("cast(1000 + s_suppkey as bigint) AS id", "CASE s_suppkey WHEN 3 THEN 1004 WHEN 4 THEN 1003 ELSE cast(100 + s_nationkey as bigint) END AS parent_id")
    return regions.unionByName(nations).unionByName(suppliers)


_FOLDERS = "(SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1000 + s_suppkey, CASE s_suppkey WHEN 3 THEN 1004 WHEN 4 THEN 1003 ELSE 100 + s_nationkey END FROM supplier)"


def _filed(s, d):
    return load(s, d, "part").selectExpr("p_partkey AS id", "cast(CASE p_partkey % 3 WHEN 0 THEN p_partkey % 5 WHEN 1 THEN 100 + p_partkey % 25 ELSE 1000 + p_partkey % 100 END as bigint) AS folder_id")


def _annotations(s, d):
    return _events_now(s, d).selectExpr("event_id AS id", "user_id AS document_id", "cast(event_id % 4 as int) AS page", "event_type AS type", "user_id % 3 = 0 AS locked", "ts AS updated_at")


_NAME = "CASE doc_id % 5 WHEN 0 THEN '..' || source || '?.PDF' WHEN 1 THEN 'a/b:' || source WHEN 2 THEN '.' || lang WHEN 3 THEN source || '.tar.gz..' ELSE substring(text, 1, 40) || '.Docx' END"


def _names(s, d):
    rows = load(s, d, "documents").selectExpr("doc_id", f"{_NAME} AS name")
    n = F.col("name")
    return rows.select("doc_id", J.truncate(n, 12).alias("short"), J.sanitize_filename(n).alias("safe"), J.output_name(n, "_page1", "pdf").alias("output"), J.extension(n).alias("extension"), J.mime_type(J.extension(n)).alias("mime"), J.artifact_name(n).alias("artifact"))


_SANE = lambda x: f"coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace({x}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^\\.+', '_'), '\\.+$', '')), ''), 'unnamed')"
_DOTTED = "regexp_matches(name, '(?s)^.+\\.[^.]*$')"
_MIMES = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in J.MIME_TYPES.items())
_CLASSES = f"({classify.ORACLES['d5_classify_documents']})"
_KEYWORDS = f"({classify._keywords()})"
_HIT = rx(S.query_pattern(r"\d\d", regex=True))
_TEXTS = f"(SELECT doc_id, page, string_agg(str || CASE WHEN has_eol THEN chr(10) ELSE '' END, '' ORDER BY item_idx) AS text FROM ({views.TEXT_ITEMS}) GROUP BY doc_id, page)"
_TOPIC = "CASE " + " ".join(f"WHEN {' + '.join(f'CAST(contains(low, {lit(w)}) AS INTEGER)' for w in ws)} >= 2 THEN {lit(t)}" for t, ws in D.TOPICS.items()) + " ELSE 'general' END"
_ASKED = ", ".join(f"({lit(t)}, {i + 1}, {lit(q)})" for t, qs in D.QUESTIONS.items() for i, q in enumerate(qs))
_CSV = lambda x, sep=",": f"CASE WHEN contains({x}, '{sep}') OR contains({x}, '\"') OR contains({x}, chr(10)) THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
_E = entities
_YES = lambda x: f"CASE WHEN {x} THEN 'Yes' ELSE 'No' END"
#: kind: (entities, title, fields in the order of their export).
_EXPORTS = {
    "date": (_E._dates(), "Date", ("text", "format", "CAST(parsed AS VARCHAR)", "confidence", "page")),
    "amount": (_E._amounts(), "Amount", ("text", "CAST(value AS VARCHAR)", "currency", "confidence", "page")),
    "email": (_E._emails(BIZ), "Email", ("text", "domain", "confidence", "page")),
    "phone": (_E._phones(BIZ), "Phone", ("text", "digits", "format", "confidence", "page")),
    "name": (_E._names(), "Name", ("text", "first", "last", "confidence", "page")),
    "url": (_E._urls(), "URL", ("text", "domain", _YES("secure"), "confidence", "page")),
    "id": (_E._ids(), "ID", ("id_type", "text", _YES("valid"), "confidence", "page")),
    "address": (_E._addresses(), "Address", ("text", "city", "state", "zip", "confidence", "page")),
}
_TEXT = lambda x: f"coalesce(CAST({x} AS VARCHAR), '')"
_CSV_LINES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, concat_ws(',', '{title}', {', '.join(_CSV(_TEXT(x)) for x in fields)}) AS line FROM ({rows})" for k, (rows, title, fields) in _EXPORTS.items())
_WRITTEN = " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, '{k}' AS kind, concat_ws('|', {', '.join(_TEXT(x) for x in fields)}) AS fields FROM ({rows})" for k, (rows, title, fields) in _EXPORTS.items())
_TABLES = layout._TABLES
_LINES = lambda sep: f"(SELECT doc_id, page, header, row, array_to_string(list_transform(rows[row + 1], lambda x: {_CSV('x', sep)}), '{sep}') AS line FROM (SELECT doc_id, page, rows, {layout._HEAD} AS header, CAST(unnest(range(0, row_count)) AS INTEGER) AS row FROM {_TABLES}))"
_GRID = "(SELECT *, CASE WHEN t = '' THEN 'empty' WHEN n <> '' THEN 'number' ELSE 'text' END AS kind, TRY_CAST(nullif(n, '') AS DOUBLE) AS number FROM (SELECT *, trim(value) AS t, regexp_extract(replace(trim(value), ',', ''), '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') AS n FROM " + layout._TABLE_CELLS + "))"
_PLAN = lambda where, part: f"SELECT doc_id, CAST({part} AS INTEGER) AS part, page AS first_page, page AS last_page, CAST(1 AS BIGINT) AS pages, 'split_page' || page || '.pdf' AS filename, CAST(NULL AS VARCHAR) AS error FROM {pages._PAGES} {where}"
_LAST = pages._LAST
_SCALE = "least(w2 / width, h2 / height)"
_NONE = "CAST(NULL AS INTEGER) AS part, CAST(NULL AS INTEGER) AS first_page, CAST(NULL AS INTEGER) AS last_page, CAST(NULL AS BIGINT) AS pages, CAST(NULL AS VARCHAR) AS filename"
_REDACT = "(SELECT l_orderkey AS doc_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id, l_linenumber - 1 AS page, CAST(l_partkey % 700 AS DOUBLE) - 20 AS x, CAST(l_suppkey * 9 AS DOUBLE) AS y, l_quantity - 1 AS width, CASE WHEN l_partkey % 2 = 0 THEN 2.0 ELSE 0.0 END AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_suppkey % 5 <> 0)"
_FINAL = "('succeeded', 'failed', 'cancelled', 'expired')"

ORACLES = {
    "a1_validated_files": "SELECT 'f' || doc_id AS path, CAST(CASE doc_id % 4 WHEN 0 THEN strlen(text) + 9 WHEN 1 THEN 0 WHEN 2 THEN strlen(text) ELSE strlen(substring(text, 1, 20)) + 5 END AS INTEGER) AS length, CASE WHEN doc_id % 4 = 1 OR (doc_id % 4 = 2 AND text = '') THEN 'EMPTY_FILE' WHEN doc_id % 4 = 2 THEN 'INVALID_PDF' END AS error, 'png' AS image_type FROM documents",
    "a5_entity_csv_lines": _CSV_LINES,
    "a5_write_entities": _WRITTEN,
    "a6_table_lines": f"SELECT doc_id, page, 0 AS table_idx, row, line FROM {_LINES(';')} WHERE NOT header OR row >= 1",
    "a6_table_text": f"WITH t AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY row) AS body FROM {_LINES(',')} GROUP BY doc_id, page), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM t) SELECT doc_id, string_agg(CASE WHEN i = 1 THEN body ELSE chr(10) || '--- Table ' || i || ' (Page ' || page || ') ---' || chr(10) || body END, chr(10) ORDER BY i) AS text FROM n GROUP BY doc_id",
    "a7_typed_grid": f"SELECT doc_id, page, 0 AS table_idx, 'Table_Page' || page || '_1' AS sheet, row, col, kind, number, CASE WHEN kind = 'text' THEN t END AS text FROM {_GRID}",
    "a8_import_library": f"SELECT id, filename, file_size, CASE WHEN id % 2 = 0 THEN 'restored' ELSE status END AS status FROM ({records._LIB})",
    "a9_validate_archive": """WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS c, doc_id + 1 AS o FROM documents), v AS (SELECT doc_id AS id, doc_id * 2 AS blob_id FROM documents WHERE doc_id % 7 > 0), b AS (SELECT doc_id * 2 AS id FROM documents WHERE doc_id % 9 > 0)
 SELECT 'document' AS record, id, 'NO_VERSION' AS error FROM d WHERE c IS NULL UNION ALL SELECT 'document', id, 'MISSING_VERSION' FROM d WHERE c IS NOT NULL AND (c NOT IN (SELECT id FROM v) OR o NOT IN (SELECT id FROM v))
 UNION ALL SELECT 'version', id, 'MISSING_BYTES' FROM v WHERE blob_id NOT IN (SELECT id FROM b) UNION ALL SELECT 'artifact', event_id, 'MISSING_BYTES' FROM events WHERE user_id * 2 NOT IN (SELECT id FROM b)""",
    "a10_export_classifications": f"SELECT c.doc_id, 'order ' || c.doc_id || '.pdf' AS filename, CASE WHEN c.doc_id % 13 = 0 THEN 'contract' ELSE type END AS type, confidence, level, CASE WHEN c.doc_id % 13 = 0 THEN 'Yes' ELSE 'No' END AS overridden, coalesce(n, 0) AS keyword_count, coalesce(top, '') AS top_keywords FROM {_CLASSES} c LEFT JOIN (SELECT doc_id, count(*) AS n, array_to_string(list(keyword ORDER BY k.\"count\" * k.weight DESC, keyword, category)[1:5], ',') AS top FROM {_KEYWORDS} k GROUP BY doc_id) k ON k.doc_id = c.doc_id",
    "a11_export_history": f"""SELECT id, type, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor((epoch_us("timestamp") % 1000000) / 1000) AS INTEGER) AS VARCHAR), 3, '0') || 'Z' AS "timestamp", description, undo AS can_undo, array_to_string(document_ids, ',') AS document_ids, metadata FROM {_LOG}""",
    "b3_pages_to_html": f"""WITH p AS (SELECT doc_id, page, count(*) OVER (PARTITION BY doc_id) AS n, {pages._ESC.replace('text', 'trim(text)')} AS body FROM ({views.DOC_PAGES})), t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A &amp; ' || source ELSE 'Converted PDF' END AS title FROM documents)
 SELECT doc_id, {lit(B.HTML_HEAD[0])} || title || {lit(B.HTML_HEAD[1])} || title || {lit(B.HTML_HEAD[2])} || string_agg('  <div class="page">' || chr(10) || '    <div class="page-number">Page ' || page || ' of ' || n || '</div>' || chr(10) || '    <pre>' || body || '</pre>' || chr(10) || '  </div>', chr(10) ORDER BY page) || chr(10) || '</body>' || chr(10) || '</html>' AS html FROM p JOIN t USING (doc_id) GROUP BY doc_id, title""",
    "b6_valid_ocr_language": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'deu' ELSE lang END IN ({', '.join(map(lit, B.OCR_LANGUAGES))}) AS valid FROM documents",
    "d3_has_table_layout": f"SELECT doc_id, {classify._TABLES} AS has_table FROM ({BIZ})",
    "d8_classify_enhanced": f"""WITH k AS (SELECT doc_id, category AS t, sum("count" * weight * 5) AS w FROM {_KEYWORDS} GROUP BY ALL), p AS (UNPIVOT ({classify._PATTERNS}) ON {', '.join(D.TYPES)} INTO NAME t VALUE s),
 c AS (SELECT p.doc_id, p.t, s + coalesce(w, 0) AS s FROM p LEFT JOIN k ON k.doc_id = p.doc_id AND k.t = p.t), m AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'invoice' ELSE 'contract' END AS ml, 50 + o_orderkey % 51 AS sure FROM orders WHERE o_orderkey % 2 = 0),
 r AS (SELECT b.doc_id, b.type, ml, sure, a.s AS mine, o.s AS base FROM {_CLASSES} b LEFT JOIN m ON m.doc_id = b.doc_id LEFT JOIN c a ON a.doc_id = b.doc_id AND a.t = ml LEFT JOIN c o ON o.doc_id = b.doc_id AND o.t = b.type)
 SELECT doc_id, CASE WHEN sure > 70 AND ml <> type AND coalesce(mine, 0) > coalesce(base, 0) * 0.5 THEN ml ELSE type END AS type, CASE WHEN ml IS NOT NULL THEN CAST(floor(100 * (1 - 0.3) + sure * 0.3 + 0.5) AS INTEGER) ELSE 100 END AS confidence, type AS base_type, ml IS NOT NULL AS used_ml FROM r""",
    "d9_classification_summary": f"SELECT t.type, coalesce(n, 0) AS documents, 100 AS mean_confidence, (SELECT count(*) FROM orders) AS high, CAST(0 AS BIGINT) AS low FROM (VALUES {classify._TYPES}) t(type) LEFT JOIN (SELECT type, count(*) AS n FROM {_CLASSES} GROUP BY type) USING (type)",
    "d9_classification_rollup": f"SELECT source, type, count(*) AS documents, 100 AS mean_confidence FROM (SELECT CAST(doc_id % 4 AS INTEGER) AS source, type FROM {_CLASSES}) GROUP BY ROLLUP (source, type)",
    "d10_suggest_questions": f"SELECT doc_id, t.topic, place, question FROM (SELECT doc_id, {_TOPIC} AS topic FROM (SELECT doc_id, lower(text) AS low FROM ({BIZ}))) t JOIN (VALUES {_ASKED}) q(topic, place, question) ON q.topic = t.topic",
    "e3_match_rects": f"""WITH i AS (SELECT *, coalesce(sum(length(str) + CAST(has_eol AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i_start FROM ({views.TEXT_ITEMS}))
 SELECT m.doc_id, m.page, m.start, m.hit AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(height) AS height FROM {find(_TEXTS.strip('()') if False else f'SELECT * FROM {_TEXTS}', S.query_pattern(chr(92) + 'd' + chr(92) + 'd', regex=True))} m JOIN i ON i.doc_id = m.doc_id AND i.page = m.page AND i_start < m.start + length(m.hit) AND i_start + length(str) > m.start GROUP BY ALL""",
    "h7_attach_embeddings": "SELECT doc_id, chunks, embedded, embedded > 0 AS indexed FROM (SELECT doc_id % 97 AS doc_id, count(*) AS chunks, count(embedding) AS embedded FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 > 0) ON vec_id = doc_id GROUP BY 1)",
    "h8_index_forced": "SELECT vec_id AS chunk_id, vec_id % 97 AS doc_id FROM embeddings WHERE vec_id % 97 % 5 = 0 OR (vec_id % 97 % 2 = 0 AND vec_id % 3 = 0)",
    "i2_split_parts": f"SELECT doc_id, part, first_page, last_page, pages, CASE WHEN first_page = last_page OR count(*) OVER (PARTITION BY doc_id) = last THEN 'part_page' || first_page || '.pdf' ELSE 'part_pages' || first_page || '-' || last_page || '.pdf' END AS filename, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, last, CAST(floor((page - 1) / ceil(last / 3.0)) + 1 AS INTEGER) AS part, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM {pages._PAGES} JOIN {_LAST} USING (doc_id) GROUP BY ALL)",
    "i2_split_pages": f"SELECT doc_id, part, first_page, first_page AS last_page, CAST(1 AS BIGINT) AS pages, 'split_page' || first_page || '.pdf' AS filename, CAST(NULL AS VARCHAR) AS error FROM {_LAST}, (VALUES (1, 3), (2, 1)) v(part, first_page) WHERE last >= 3 UNION ALL SELECT doc_id, {_NONE}, 'PAGE_OUT_OF_RANGE' FROM {_LAST} WHERE last < 3",
    "i2_split_even": _PLAN("WHERE page % 2 = 0", "page / 2") + f" UNION ALL SELECT doc_id, {_NONE}, 'NO_PAGES' FROM {_LAST} WHERE last < 2",
    "i2_split_single": _PLAN("", "page"),
    "i5_extract_pages": f"WITH w AS (SELECT DISTINCT doc_id, page, last FROM (SELECT o_orderkey AS doc_id, unnest([2, 1, 1 + o_orderkey % 4]) AS page FROM orders) JOIN {_LAST} USING (doc_id)), g AS (SELECT doc_id, bool_and(page <= last) AS good FROM w GROUP BY doc_id) SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS new_page, CAST(NULL AS VARCHAR) AS error FROM w JOIN g USING (doc_id) WHERE good UNION ALL SELECT doc_id, NULL, NULL, 'PAGE_OUT_OF_RANGE' FROM g WHERE NOT good",
    "i5_emptied_documents": f"SELECT doc_id, 'NO_PAGES_LEFT' AS error FROM {pages._PAGES} GROUP BY doc_id HAVING bool_and(l_partkey % 4 > 0)",
    "i5_reorder_pages": f"SELECT doc_id, page, new_page FROM (SELECT o_orderkey AS doc_id, unnest([3, 1 + o_orderkey % 2, 9, 4]) AS page, unnest([1, 2, 3, 4]) AS new_page FROM orders) JOIN {_LAST} USING (doc_id) WHERE page <= last".replace("SELECT doc_id, page, new_page FROM", "SELECT doc_id, CAST(page AS INTEGER) AS page, new_page FROM", 1),
    "i8_header_footer_text": f"SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN 'p. ' || page || ' (2024-05-06)' ELSE page || ' of ' || last END AS text FROM {pages._PAGES} JOIN {_LAST} USING (doc_id) WHERE page BETWEEN 2 AND 6",
    "i10_page_geometry": f"""SELECT doc_id, page, round(width * 0.1, 6) AS crop_x, round(height * 0.03, 6) AS crop_y, round(width * 0.85, 6) AS crop_width, round(height * 0.95, 6) AS crop_height, 36.0 AS inner_x, 5.0 AS inner_y, width - 56 AS inner_width, height - 15 AS inner_height,
 round(w2, 6) AS sized_width, round(h2, 6) AS sized_height, round({_SCALE}, 6) AS sized_scale, round((w2 - width * {_SCALE}) / 2, 6) AS sized_dx, round((h2 - height * {_SCALE}) / 2, 6) AS sized_dy, CAST(floor((((rotation + 90) % 360 + 360) % 360) / 90.0 + 0.5) * 90 % 360 AS INTEGER) AS rotation
 FROM (SELECT *, CASE WHEN width / height > 595.28 / 419.53 THEN 595.28 ELSE 419.53 * (width / height) END AS w2, CASE WHEN width / height > 595.28 / 419.53 THEN 595.28 / (width / height) ELSE 419.53 END AS h2 FROM {_SHEETS})""",
    "i10_units": "SELECT p_partkey, round(p_size * (72 / 25.4), 6) AS mm, round(p_size * 0.75, 6) AS px, round(p_size / 72.0, 6) AS inches FROM part",
    "i11_uniform_trim": f"WITH b AS (SELECT {_BOX.replace('as double', 'AS DOUBLE')} FROM lineitem), c AS (SELECT doc_id, min(x) AS l, min(y) AS b, min(page_width - x - width) AS r, min(page_height - y - height) AS t FROM b GROUP BY doc_id) SELECT doc_id, page, l AS x, c.b AS y, page_width - l - r AS width, page_height - c.b - t AS height FROM b JOIN c USING (doc_id)",
    "i12_compression_estimates": "SELECT o_orderkey AS doc_id, coalesce(i, false) AS has_images, least(50, CASE WHEN i THEN 20 ELSE 0 END + CASE WHEN o_custkey % 120 > 50 THEN 10 ELSE 0 END) AS estimated_savings FROM (SELECT *, CAST(trunc(o_totalprice * 100) AS BIGINT) / nullif(o_custkey % 120, 0) > 100000 AS i FROM orders)",
    "i12_compression_stats": "SELECT l_returnflag AS operation, count(*) AS runs, count(*) FILTER (p < o) AS smaller, CAST(sum(o) AS BIGINT) AS original_size, CAST(sum(p) AS BIGINT) AS processed_size, round(avg(o / CAST(p AS DOUBLE)) FILTER (p < o), 6) AS mean_ratio FROM (SELECT l_returnflag, l_partkey + 1 AS o, l_suppkey * 15 + 1 AS p FROM lineitem) GROUP BY ROLLUP (l_returnflag)",
    "i14_ocr_flatten": f"SELECT * FROM {_WORDS}",
    "i14_ocr_text_layer": f"SELECT doc_id, page, text, x / 4 AS x, 700 + doc_id % 90 - (y + height) / 4 AS y, round(height / 4 * 0.8, 6) AS font_size FROM {_WORDS}",
    "i14_ocr_stats": "SELECT l_orderkey AS doc_id, count(*) AS pages, round(avg(l_suppkey % 100), 6) AS mean_confidence, CAST(floor(sum(l_partkey * 1000) / 1000000.0 * 1500 + 0.5) AS BIGINT) AS estimated_ms FROM lineitem GROUP BY l_orderkey",
    "i15_redaction_plan": f"""SELECT doc_id, page, id, CASE WHEN e IS NULL THEN CAST(a AS INTEGER) END AS "left", CASE WHEN e IS NULL THEN CAST(b AS INTEGER) END AS top, CASE WHEN e IS NULL THEN CAST(c AS INTEGER) END AS "right", CASE WHEN e IS NULL THEN CAST(f AS INTEGER) END AS bottom, e AS error FROM (
 SELECT *, CASE WHEN n > 8 THEN 'TOO_MANY' WHEN page < 1 THEN 'BAD_PAGE' WHEN x < 0 OR width <= 0 THEN 'BAD_BOX' WHEN page > 2 + doc_id % 4 THEN 'PAGE_OUT_OF_RANGE' WHEN c <= a OR f <= b THEN 'OFF_PAGE' END AS e FROM (
  SELECT *, greatest(0, floor((x - p) * 2 + 0.5)) AS a, greatest(0, floor((y - p) * 2 + 0.5)) AS b, least(1224, floor((x + width + p) * 2 + 0.5)) AS c, least(1584, floor((y + 12 + p) * 2 + 0.5)) AS f FROM {_REDACT}))""",
    "i16_security_scan": f"SELECT doc_id, contains(t, '/Encrypt') AS encrypted, CASE WHEN NOT contains(t, '/Encrypt') THEN true END AS may_edit, array_to_string(list_transform(string_split(k, ','), lambda x: trim(x)), '+') AS keywords FROM (SELECT doc_id, text || CASE WHEN doc_id % 6 = 0 THEN ' /Encrypt 7 0 R ' ELSE '' END AS t, {_MARKS} AS k FROM documents)",
    "i16_signature_marks": "SELECT doc_id, 'stamp' AS kind, CASE WHEN doc_id % 3 = 0 THEN 'F1' ELSE 'Signature_1' END AS name, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 1 END AS page, 'S' || doc_id AS signer, true AS signed FROM documents UNION ALL SELECT doc_id, 'placeholder', 'P' || doc_id % 10, 2, NULL, doc_id % 2 = 0 FROM documents",
    "i16_blank_metadata": "SELECT doc_id, '' AS title, '' AS author, 'none' AS producer FROM documents",
    "j2_favourites": f"SELECT id, filename FROM ({records._LIB}) WHERE is_favorite ORDER BY created_at DESC, id LIMIT 7",
    "j2_top_accessed": "SELECT user_id AS document_id, count(*) AS accesses, max(ts) AS last_accessed_at FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10",
    "j3_content_stats": "SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM conversations) AS messages, (SELECT CAST(sum(strlen('{\"turn\":' || turn || ',\"role\":\"' || role || '\",\"text\":\"' || regexp_replace(text, '[\"\\\\\\x00-\\x1f]', ' ', 'g') || '\"}')) AS BIGINT) FROM conversations) AS conversation_bytes, (SELECT count(*) * 384 * 4 FROM embeddings) AS embedding_bytes, (SELECT CAST(sum(strlen(substring(text, 1, 50))) AS BIGINT) FROM documents WHERE doc_id % 2 = 0) AS thumbnail_bytes",
    "j7_version_history": f"SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY version_number DESC) AS INTEGER) AS place, version_number, blob_id, size FROM ({records._VERSIONS})",
    "j9_folder_tree": f"WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM {_FOLDERS}), r AS (SELECT id AS ancestor, id, 0 AS level FROM f UNION ALL SELECT ancestor, f.id, level + 1 FROM r JOIN f ON f.parent_id = r.id WHERE f.id <> ancestor AND level < 10) SELECT * FROM r",
    "j9_delete_folder": f"WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM {_FOLDERS}), r AS (SELECT CAST(3 AS BIGINT) AS id UNION ALL SELECT f.id FROM r JOIN f ON f.parent_id = r.id) SELECT p.id, CASE WHEN p.folder_id IN (SELECT id FROM r) THEN 1 ELSE p.folder_id END AS folder_id FROM (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 5 WHEN 1 THEN 100 + p_partkey % 25 ELSE 1000 + p_partkey % 100 END AS folder_id FROM part) p",
    "j11_annotation_counts": "SELECT user_id AS document_id, page, type, count(*) AS annotations, count(*) FILTER (user_id % 3 > 0) AS unlocked FROM (SELECT user_id, CAST(event_id % 4 AS INTEGER) AS page, event_type AS type FROM events) GROUP BY GROUPING SETS ((user_id, page, type), (user_id, page), (user_id))",
    "j11_move_annotations": "SELECT event_id AS id, user_id AS document_id, CASE WHEN event_id % 6 = 0 AND user_id % 3 > 0 THEN 9 ELSE CAST(event_id % 4 AS INTEGER) END AS page, event_type AS type, user_id % 3 = 0 AS locked, CASE WHEN event_id % 6 = 0 AND user_id % 3 > 0 THEN TIMESTAMP '2024-03-01' ELSE ts END AS updated_at FROM events WHERE event_type = 'click'",
    "j12_duration": "SELECT o_orderkey, CASE WHEN ms < 0 THEN 'Invalid duration' WHEN ms < 1000 THEN ms || 'ms' WHEN s < 60 THEN printf('%.1fs', floor(ms / 100.0 + 0.5) / 10) WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END ELSE (s // 3600) || 'h' || CASE WHEN s // 60 % 60 > 0 THEN ' ' || (s // 60 % 60) || 'm' ELSE '' END END AS duration FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 7 - 3 AS ms, (o_orderkey * o_orderkey * 7 - 3) // 1000 AS s FROM orders)",
    "j12_relative_time": "SELECT o_orderkey, CASE WHEN d < 60 THEN 'just now' WHEN d < 86400 AND d < 3600 THEN (d // 60) || ' minutes ago' WHEN d < 86400 THEN (d // 3600) || CASE WHEN d // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END WHEN d < 604800 THEN (d // 86400) || CASE WHEN d // 86400 = 1 THEN ' day ago' ELSE ' days ago' END WHEN d < 2419200 THEN (d // 604800) || CASE WHEN d // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END WHEN d < 31104000 THEN (d // 2592000) || CASE WHEN d // 2592000 = 1 THEN ' month ago' ELSE ' months ago' END ELSE (d // 31536000) || CASE WHEN d // 31536000 = 1 THEN ' year ago' ELSE ' years ago' END END AS ago FROM (SELECT o_orderkey, CAST(epoch(TIMESTAMP '2000-01-01') AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT) AS d FROM orders)",
    "j12_file_names": f"SELECT doc_id, CASE WHEN length(name) <= 12 THEN name ELSE substring(name, 1, 9) || '...' END AS short, {_SANE('name')} AS safe, {_SANE(f'''CASE WHEN {_DOTTED} THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END || '_page1.pdf' ''')} AS output, extension, CASE extension {_MIMES} ELSE 'application/octet-stream' END AS mime, CASE WHEN a NOT IN ('', '.', '..') THEN a END AS artifact FROM (SELECT doc_id, name, lower(regexp_extract(name, '(?s)^.+\\.([^.]+)$', 1)) AS extension, regexp_replace(regexp_extract(name, '([^/]*)/*$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS a FROM (SELECT doc_id, {_NAME} AS name FROM documents))",
    "j13_chunk_rows": "SELECT source AS folder_id, doc_id AS id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 7) AS INTEGER) AS chunk FROM documents",
    "k1_history_labels": "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'Extract Images' WHEN 1 THEN 'OCR' ELSE 'Unknown' END AS label FROM events",
    "k3_recent_operations": "SELECT event_id AS id, event_type AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 15",
    "k3_clear_range": "SELECT id, user_id FROM (SELECT event_id AS id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2 OR n > 41",
    "k4_operations_for_document": f"SELECT id, user_id FROM {_LOG} WHERE list_contains(document_ids, 3)",
    "k4_operations_by_document": f"SELECT document_id, count(*) AS operations, count(*) FILTER (undo) AS undoable, max(\"timestamp\") AS last_at FROM (SELECT unnest(list_distinct(document_ids)) AS document_id, \"timestamp\", undo FROM {_LOG}) GROUP BY document_id",
    "k7_validate_operations": f"SELECT id, {_VALID} AS error FROM (SELECT event_id AS id, user_id, user_id % 4 AS k4, ['security', 'watermark', 'split', 'crop', 'compress', 'convert', 'ocr'][event_id % 7 + 1] AS type FROM events)",
    "l1_explode_conversations": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role, text FROM conversations",
    "l2_conversations_for_document": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 1 OR conv_id % 3 = 1",
    "l2_recent_conversations": "SELECT DISTINCT conv_id, TIMESTAMP '2024-01-01' + to_days(CAST((conv_id * 37) % 50 AS INTEGER)) AS updated_at FROM conversations ORDER BY 2 DESC, 1 LIMIT 12",
    "l2_message_counts": "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id",
    "l4_validate_chat_options": "SELECT event_id AS request_id, CASE WHEN event_id % 5 = 0 THEN 'INVALID_MODEL' WHEN event_id % 7 > 0 AND NOT (value / 20 BETWEEN 0 AND 2) THEN 'INVALID_TEMPERATURE' WHEN NOT (user_id * 500 BETWEEN 1 AND 32768) THEN 'INVALID_MAX_TOKENS' ELSE 'ok' END AS code FROM events",
    "l6_citation_usage": f"SELECT document_id, page, count(*) AS citations, count(DISTINCT (conv_id, turn)) AS messages, count(*) FILTER (i <= 3) AS shown FROM (SELECT conv_id, turn, i, (conv_id * i) % 7 AS document_id, (turn + i) % 3 AS page FROM {_CITED}) GROUP BY GROUPING SETS ((document_id, page), (document_id))",
    "m1_job_lifecycle_stream": f"SELECT job_id, event_id, status, CASE WHEN coalesce(max(CAST(status IN {_FINAL} AS INTEGER)) OVER (PARTITION BY job_id ORDER BY epoch_ms(updated_at), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 'accepted' ELSE 'rejected' END AS outcome FROM {_JOBS}",
    "m2_expire_jobs": f"SELECT job_id, CASE WHEN final IS NULL AND created + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE coalesce(final, last) END AS status, created + INTERVAL 1 HOUR AS expires_at, CASE WHEN final IS NULL AND created + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20' THEN 'JOB_EXPIRED' END AS error_code FROM (SELECT job_id, min(updated_at) AS created, arg_max(status, (updated_at, event_id)) AS last, arg_min(status, (updated_at, event_id)) FILTER (status IN {_FINAL}) AS final FROM {_JOBS} GROUP BY job_id)",
    "m3_rate_limit_stream": pages.ORACLES["m3_rate_limit"],
    "m4_request_counts_stream": "SELECT * FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type AS kind, count(*) AS requests FROM events GROUP BY ALL) WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "m4_sliding_counts": "SELECT start, kind, count(*) AS requests FROM (SELECT time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(2 * k AS INTEGER)) AS start, event_type AS kind FROM events, range(0, 3) r(k)) GROUP BY ALL",
    "m4_session_counts": "SELECT client, min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS \"end\", count(*) AS requests FROM (SELECT *, sum(n) OVER (PARTITION BY client ORDER BY ts, event_id) AS g FROM (SELECT user_id AS client, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 8 HOURS THEN 0 ELSE 1 END AS n FROM events)) GROUP BY client, g",
    "m5_assemble_chat_stream": "SELECT 'c' || conv_id AS id, string_agg(delta, '' ORDER BY turn) AS content, count(*) AS chunks, count(*) FILTER (turn >= 3) > 0 AS finished, CASE WHEN count(*) FILTER (turn >= 3) > 0 THEN 'stop' END AS finish_reason FROM (SELECT conv_id, turn, text AS delta FROM conversations WHERE turn % 7 <> 6 AND turn % 5 <> 4) WHERE delta <> '' OR turn >= 3 GROUP BY conv_id",
    "m6_stream_key_information": _E._all(),
    "m6_stream_classify": f"SELECT type AS kind, count(*) AS n FROM ({classify.ORACLES['d7_quick_classify']}) GROUP BY type",
}
ORACLES |= {
    "a6_table_objects": f"""WITH t AS (SELECT doc_id, page, rows, row_count, column_count, {layout._HEAD} AS header FROM {_TABLES}),
 r AS (SELECT doc_id, page, header AND row_count > 1 AS has, rows, column_count, CAST(unnest(range(0, row_count)) AS INTEGER) AS row FROM t),
 c AS (SELECT doc_id, page, has, row, i, coalesce(nullif(trim(rows[1][i]), ''), 'Column_' || i) AS h, rows[row + 1][i] AS v FROM (SELECT *, unnest(range(1, column_count + 1)) AS i FROM r WHERE NOT has OR row > 0)),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, row, CASE WHEN has THEN h ELSE CAST(i AS VARCHAR) END ORDER BY i DESC) AS last FROM c)
 SELECT doc_id, page, 0 AS table_idx, row, CASE WHEN has THEN '{{' || string_agg('"' || h || '":"' || v || '"', ',' ORDER BY i) || '}}' ELSE '[' || string_agg('"' || v || '"', ',' ORDER BY i) || ']' END AS json FROM k WHERE last = 1 GROUP BY doc_id, page, row, has""",
    "a7_column_widths": f"SELECT doc_id, page, 0 AS table_idx, col, CAST(greatest(10, least(50, max(length(CASE kind WHEN 'number' THEN regexp_replace(CAST(CAST(number AS DECIMAL(38, 6)) AS VARCHAR), '\\.?0+$', '') WHEN 'text' THEN t ELSE '' END)) + 2)) AS INTEGER) AS width FROM {_GRID} GROUP BY doc_id, page, col",
    "f22_unique_field_names": f"""WITH RECURSIVE f AS MATERIALIZED (SELECT doc_id, seq, CASE WHEN seq % 3 = 2 THEN 'name_2' WHEN seq % 2 = 0 THEN 'name' ELSE name END AS name FROM {layout._FIELDS}),
 r AS (SELECT doc_id, seq, name, name AS unique_name, [name] AS used FROM f WHERE seq = 0
  UNION ALL SELECT doc_id, seq, name, u, list_append(used, u) FROM (SELECT f.doc_id, f.seq, f.name, used, CASE WHEN list_contains(used, f.name) THEN f.name || '_' || list_filter(range(2, 100), lambda k: NOT list_contains(used, f.name || '_' || k))[1] ELSE f.name END AS u FROM r JOIN f ON f.doc_id = r.doc_id AND f.seq = r.seq + 1))
 SELECT doc_id, seq, name, unique_name FROM r""",
    "h6_build_prompts": f"""WITH q AS (SELECT vec_id AS query_id, 'What about ' || vec_id || '?' AS question FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT -1, 'Anything?'),
 e AS (SELECT query_id, rank, '[Page ' || page || '] ' || content || chr(10) AS entry FROM ({corpus._top(8, -1.0)}) JOIN ({corpus._C}) USING (chunk_id)),
 u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM e),
 k AS (SELECT query_id, string_agg(entry, chr(10) ORDER BY rank) FILTER (used <= 9000) AS body FROM u GROUP BY query_id)
 SELECT query_id, prompt, has_context, CAST(ceil(length(prompt) / 4.0) AS INTEGER) AS tokens FROM (SELECT q.query_id, k.query_id IS NOT NULL AS has_context,
  CASE WHEN k.query_id IS NULL THEN {lit(chr(10).join(R.PROMPT_NO_CONTEXT))} ELSE {lit(chr(10).join(R.PROMPT_CONTEXT))} || coalesce(chr(10) || body, '') END || chr(10) || {lit(chr(10) + '## Question' + chr(10))} || chr(10) || question || chr(10) || {lit(chr(10).join(R.PROMPT_RULES))} AS prompt FROM q LEFT JOIN k USING (query_id))""",
    "k5_history_replay": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS document_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'add' END AS action, event_id % 7 > 0 AS can, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 r AS (SELECT document_id, CAST(0 AS BIGINT) AS seq, '' AS action, CAST(0 AS BIGINT) AS n, CAST([] AS BOOLEAN[]) AS held, -1 AS i, false AS applied FROM (SELECT DISTINCT document_id FROM e)
  UNION ALL SELECT document_id, seq, action, n, held, CASE WHEN action = 'add' THEN len(held) - 1 WHEN action = 'undo' AND applied THEN i - 1 WHEN action = 'redo' AND applied THEN i + 1 ELSE i END, applied FROM (
   SELECT e.document_id, e.seq, e.action, e.n, i, CASE WHEN e.action = 'add' THEN list_reverse(list_reverse(list_append(held[1:i + 1], can))[1:10]) ELSE held END AS held, e.action = 'add' OR (e.action = 'undo' AND i >= 0 AND held[i + 1]) OR (e.action = 'redo' AND i < len(held) - 1) AS applied FROM r JOIN e ON e.document_id = r.document_id AND e.n = r.n + 1))
 SELECT document_id, seq, action, applied, CAST(len(held) AS INTEGER) AS entries, CAST(i AS INTEGER) AS "position", CAST(len(list_filter(held[1:i + 1], lambda x: x)) AS INTEGER) AS undo, CAST(len(held) - 1 - i AS INTEGER) AS redo FROM r WHERE n > 0""",
    "m2_expire_jobs_stream": f"SELECT job_id, make_timestamp((first_ms + 86400000) * 1000) AS \"at\" FROM (SELECT job_id, min(epoch_us(updated_at) // 1000) AS first_ms, count(*) FILTER (status IN {_FINAL}) AS ended FROM {_JOBS} GROUP BY job_id) WHERE ended = 0 AND first_ms + 86400000 < (SELECT max(epoch_us(ts) // 1000) FROM events)",
}
