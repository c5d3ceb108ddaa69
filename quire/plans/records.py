"""Queries of the library, operation history and chat operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quire.operators import history as K
from quire.operators import library as J

from . import views
from .views import load

_LIBRARY = """doc_id AS id, source || '_' || cast(doc_id as string) || '.pdf' AS filename, n_chars AS file_size, cast(floor((n_chars + 999) / 1000) as bigint) AS page_count,
 (CASE doc_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'processing' WHEN 2 THEN 'archived' WHEN 3 THEN 'error' ELSE 'pending' END) AS status, lang, source AS folder_id, doc_id % 3 = 0 AS is_favorite"""
_DAY = "CAST(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 180 AS INTEGER)) AS TIMESTAMP)"
_LIB = f"SELECT {_LIBRARY}, [lang, source] AS tags, {_DAY} AS created_at FROM documents"
_MOMENT = datetime.datetime(1996, 1, 1)


def library(s, d):
    rows = load(s, d, "documents").selectExpr(*views._list(_LIBRARY), "timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 180 as int)) AS created_at")
    return rows.withColumn("tags", F.array("lang", "folder_id"))


_VERSIONS = "SELECT o_custkey AS document_id, o_orderkey AS blob_id, CAST(floor(o_totalprice * 100) AS BIGINT) AS size, o_orderdate AS created_at, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version_number FROM orders"


def versions(s, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return load(s, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("blob_id"), F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("size"), F.col("o_orderdate").alias("created_at"), n.alias("version_number"))


_HISTORY = "SELECT event_id AS id, event_type AS type, ts AS \"timestamp\", user_id, event_type || ' by ' || user_id AS description, value FROM events"


def history(s, d):
    return load(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("timestamp"), "user_id", F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("description"), "value")


_STATUS = "(CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END)"
_RUNS = f"SELECT event_id AS run_id, 'op' || (event_id % 7) AS operation, 'engine' || (user_id % 3) AS engine, {_STATUS} AS status, value AS progress FROM events"
_JOBS = f"SELECT event_id, user_id AS job_id, ts AS updated_at, {_STATUS} AS status FROM events"


def runs(s, d):
    return load(s, d, "events").selectExpr("event_id AS run_id", "concat('op', cast(event_id % 7 as string)) AS operation", "concat('engine', cast(user_id % 3 as string)) AS engine", f"{_STATUS} AS status", "value AS progress")


def artifacts(s, d):
    return load(s, d, "events").where("event_id % 4 > 0").selectExpr("event_id - event_id % 2 AS run_id", "10 * (event_id % 100) AS size")


def jobs(s, d):
    return load(s, d, "events").selectExpr("event_id", "user_id AS job_id", "ts AS updated_at", f"{_STATUS} AS status")


def chats(s, d):
    return load(s, d, "conversations")


def coded(s, d):
    """Messages of which some carry fenced blocks made of their own words."""
    return chats(s, d).selectExpr("conv_id", "turn", "CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('see ```py\n', text, '\n``` and ```', chr(10), text, '```') ELSE text END AS text")


_CODED = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'see ```py' || chr(10) || text || chr(10) || '``` and ```' || chr(10) || text || '```' ELSE text END AS text FROM conversations"
_FENCE = "'(?s)```(\\w*)\\n?(.*?)```'"
_TERMINAL = "('succeeded', 'failed', 'cancelled', 'expired')"

QUERIES = {
    "j1_query_documents": lambda s, d: J.query_documents(library(s, d), status="ready", tags=("en", "fr"), search="src", sort_by="file_size", offset=10, limit=20).drop("tags"),
    "j2_recent_documents": lambda s, d: J.recent_documents(library(s, d), 10).drop("tags"),
    "j3_library_stats": lambda s, d: J.library_stats(library(s, d)),
    "j4_storage_quota": lambda s, d: J.storage_quota(J.library_stats(library(s, d)), 3_000_000),
    "j5_import_documents": lambda s, d: J.import_documents(library(s, d).select("id", F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("file_size")).alias("file_size")), library(s, d).where("id % 2 = 0")),
    "j6_append_versions": lambda s, d: J.append_versions(versions(s, d).where("version_number > 5").select("document_id", F.col("version_number").alias("seq"), "blob_id"), versions(s, d).where("version_number <= 5")),
    "j7_latest_version": lambda s, d: J.latest_version(versions(s, d)),
    "j7_bytes_as_of": lambda s, d: J.bytes_as_of(versions(s, d), _MOMENT),
    "j8_delete_documents": lambda s, d: J.delete_documents(versions(s, d).where("document_id % 3 = 0").select("document_id").distinct(), {"versions": versions(s, d)})["versions"].select("document_id", "blob_id"),
    "j9_folder_counts": lambda s, d: J.folder_counts(library(s, d).where("is_favorite"), library(s, d).select(F.col("folder_id").alias("id")).distinct()),
    "j10_tag_counts": lambda s, d: J.tag_counts(J.change_tags(library(s, d), ("new",), ("de",))),
    "j12_human_size": lambda s, d: library(s, d).select("id", J.human_size(F.col("file_size") * F.col("file_size")).alias("size"), J.extension(F.col("filename")).alias("extension")),
    "j13_distinct_by": lambda s, d: J.distinct_by(library(s, d), "folder_id", "created_at", "id").select("folder_id", "id"),
    "k1_history_filter": lambda s, d: K.history_filter(history(s, d), ("view", "error"), "BY 1"),
    "k2_history_by_day": lambda s, d: K.history_by_day(history(s, d)),
    "k3_cap_history": lambda s, d: K.cap_history(history(s, d), 3).select("id", "user_id"),
    "k6_queue_stats": lambda s, d: K.queue_stats(runs(s, d)),
    "k8_run_outcomes": lambda s, d: K.run_outcomes(runs(s, d), artifacts(s, d)),
    "k9_active_jobs": lambda s, d: K.active_jobs(jobs(s, d)),
    "m1_job_lifecycle": lambda s, d: K.job_lifecycle(jobs(s, d)),
    "l2_messages_by_role": lambda s, d: K.messages_by_role(chats(s, d)),
    "l2_last_message": lambda s, d: K.last_message(chats(s, d)),
    "l3_prompt_history": lambda s, d: K.prompt_history(chats(s, d), 3),
    "l4_validate_chats": lambda s, d: K.validate_chats(chats(s, d), 4, 1500),
    "l5_code_blocks": lambda s, d: K.code_blocks(coded(s, d)),
}
_STATS = f"""SELECT CASE WHEN month IS NOT NULL THEN 'month' WHEN status IS NOT NULL THEN 'status' ELSE 'all' END AS "grouping", coalesce(month, status, '') AS "key", count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT *, strftime(created_at, '%Y-%m') AS month FROM ({_LIB})) GROUP BY GROUPING SETS ((), (status), (month))"""
_UNIT = "CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END"
ORACLES = {
    "j1_query_documents": f"WITH k AS (SELECT * FROM ({_LIB}) WHERE status = 'ready' AND list_has_any(tags, ['en', 'fr']) AND contains(lower(filename), 'src')) SELECT * EXCLUDE (tags), (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k) > 30 AS has_more FROM k ORDER BY file_size DESC, id LIMIT 20 OFFSET 10",
    "j2_recent_documents": f"SELECT * EXCLUDE (tags) FROM ({_LIB}) ORDER BY created_at DESC, id LIMIT 10",
    "j3_library_stats": _STATS,
    "j4_storage_quota": f"SELECT bytes AS used, greatest(0, 3000000 - bytes) AS available, round(bytes / 3000000.0 * 100, 1) AS percent, CASE WHEN bytes / 30000.0 >= 95 THEN 'critical' WHEN bytes / 30000.0 >= 80 THEN 'low' ELSE 'ok' END AS level FROM ({_STATS}) WHERE \"grouping\" = 'all'",
    "j5_import_documents": "SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 OR n_chars <= 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'skipped' ELSE 'imported' END AS outcome FROM documents",
    "j6_append_versions": f"WITH v AS ({_VERSIONS}) SELECT document_id, version_number, blob_id, version_number - 1 AS parent_version, version_number = max(version_number) OVER (PARTITION BY document_id) AS is_current FROM v WHERE version_number > 5",
    "j7_latest_version": f"SELECT document_id, max(version_number) AS version_number, arg_max(blob_id, version_number) AS blob_id, arg_max(size, version_number) AS size FROM ({_VERSIONS}) GROUP BY document_id",
    "j7_bytes_as_of": f"SELECT document_id, max(version_number) AS version_number, arg_max(blob_id, version_number) AS blob_id, arg_max(size, version_number) AS size FROM ({_VERSIONS}) WHERE created_at <= TIMESTAMP '1996-01-01' GROUP BY document_id",
    "j8_delete_documents": "SELECT o_custkey AS document_id, o_orderkey AS blob_id FROM orders WHERE o_custkey % 3 <> 0",
    "j9_folder_counts": "SELECT source AS folder_id, count(*) FILTER (doc_id % 3 = 0) AS documents FROM documents GROUP BY source",
    "j10_tag_counts": f"SELECT tag, count(*) AS documents FROM (SELECT unnest(list_concat(tags, ['new'])) AS tag FROM ({_LIB})) WHERE tag <> 'de' GROUP BY tag",
    "j12_human_size": f"SELECT id, CASE WHEN n <= 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', round(n / pow(1024.0, {_UNIT}), 2)), '\\.?0+$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][{_UNIT} + 1] END AS size, 'pdf' AS extension FROM (SELECT doc_id AS id, n_chars * n_chars AS n FROM documents)",
    "j13_distinct_by": f"SELECT folder_id, arg_min(id, (created_at, id)) AS id FROM ({_LIB}) GROUP BY folder_id",
    "k1_history_filter": f"SELECT * FROM ({_HISTORY}) WHERE type IN ('view', 'error') AND contains(lower(description), 'by 1')",
    "k2_history_by_day": f"SELECT CAST(\"timestamp\" AS DATE) AS day, count(*) AS entries, count(DISTINCT user_id) AS users, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ({_HISTORY}) GROUP BY ALL",
    "k3_cap_history": f"SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY \"timestamp\" DESC, id DESC) AS n FROM ({_HISTORY})) WHERE n <= 3",
    "k6_queue_stats": f"SELECT count(*) AS total, {', '.join(f'count(*) FILTER (status = {chr(39)}{x}{chr(39)}) AS {x}' for x in ('queued', 'running', 'succeeded', 'failed', 'cancelled'))}, CAST(floor(avg(CASE WHEN status IN {_TERMINAL} THEN 100.0 ELSE progress END) + 0.5) AS INTEGER) AS overall_progress FROM ({_RUNS})",
    "k8_run_outcomes": f"WITH a AS (SELECT event_id - event_id % 2 AS run_id, count(*) AS n, sum(10 * (event_id % 100)) AS size FROM events WHERE event_id % 4 > 0 GROUP BY 1) SELECT operation, engine, count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, CAST(sum(coalesce(n, 0)) AS BIGINT) AS artifacts, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM ({_RUNS}) LEFT JOIN a USING (run_id) GROUP BY CUBE (operation, engine)",
    "k9_active_jobs": f"SELECT * FROM (SELECT job_id, arg_max(status, (updated_at, event_id)) AS status, max(updated_at) AS updated_at FROM ({_JOBS}) GROUP BY job_id) WHERE status NOT IN {_TERMINAL}",
    "m1_job_lifecycle": f"SELECT job_id, event_id, status, coalesce(max(CAST(status IN {_TERMINAL} AS INTEGER)) OVER (PARTITION BY job_id ORDER BY updated_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS accepted FROM ({_JOBS})",
    "l2_messages_by_role": "SELECT role, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY role",
    "l2_last_message": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
    "l3_prompt_history": "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id",
    "l4_validate_chats": "SELECT conv_id, CASE WHEN count(*) > 4 THEN 'TOO_MANY_MESSAGES' WHEN count(*) FILTER (role NOT IN ('system', 'user', 'assistant')) > 0 THEN 'INVALID_ROLE' WHEN count(*) FILTER (length(trim(text)) = 0) > 0 THEN 'EMPTY_MESSAGE' WHEN sum(length(text)) > 1500 THEN 'TOO_LONG' ELSE 'ok' END AS code FROM conversations GROUP BY conv_id",
    "l5_code_blocks": f"SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS block, CASE WHEN l[i] = '' THEN 'text' ELSE l[i] END AS language, trim(c[i]) AS code FROM (SELECT conv_id, turn, l, c, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, {_FENCE}, 1) AS l, regexp_extract_all(text, {_FENCE}, 2) AS c FROM ({_CODED})))",
}
