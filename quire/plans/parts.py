"""Queries of the stored index, as-of versions, cascades, imports, bookmarks, page ranges, image metadata, page comparison, prompts and totals."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quire.functions.shared import shared_folder
from quire.operators import compare as C
from quire.operators import entities as E
from quire.operators import history as K
from quire.operators import library as J
from quire.operators import manifest as I
from quire.operators.chunk_index import ChunkIndex
from quire.streaming import state as T

from . import corpus, entities, more, pages, records, views
from .duck import find, lit, rx
from .views import load

_AT = datetime.datetime(2024, 5, 6)


# --- The stored index ----------------------------------------------------------------------------------------------
def _chunks(s, d, where: str, version: int):
    return load(s, d, "documents").where(where).selectExpr("doc_id % 501 AS doc_id", "doc_id AS chunk_id", f"{version} AS version", "text AS content")


def _index(s, d):
    """Half of all documents indexed, all offered, some forced again with fewer chunks, some removed."""
    first = _chunks(s, d, "doc_id % 501 % 2 = 0", 1)
    index = ChunkIndex(s, shared_folder(s, "index"), first.schema, 16)
    index.create(first)
    index.add(_chunks(s, d, "true", 2))
    index.add(_chunks(s, d, "doc_id % 501 % 5 = 0 and doc_id % 3 > 0", 3), force=True)
    index.remove(load(s, d, "documents").where("doc_id % 7 = 0").selectExpr("doc_id % 501 AS doc_id"))
    return index.read()


_INDEX = """WITH c AS (SELECT doc_id % 501 AS doc_id, doc_id AS chunk_id, text AS content FROM documents), forced AS (SELECT DISTINCT doc_id FROM c WHERE doc_id % 5 = 0 AND chunk_id % 3 > 0)
SELECT doc_id, chunk_id, CAST(CASE WHEN doc_id IN (FROM forced) THEN 3 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS version, content FROM c
WHERE NOT (doc_id IN (FROM forced) AND chunk_id % 3 = 0) AND doc_id NOT IN (SELECT doc_id % 501 FROM documents WHERE doc_id % 7 = 0)"""


# --- Versions, cascades, imports -----------------------------------------------------------------------------------
def _points(s, d):
    """Several times for each customer: those of orders, and one before and after each."""
    return load(s, d, "orders").selectExpr("o_custkey AS document_id", "explode(array(o_orderdate, o_orderdate - interval 40 days, o_orderdate + make_dt_interval(cast(o_orderkey % 300 as int)))) AS at")


_POINTS = "(SELECT o_custkey AS document_id, unnest([o_orderdate, o_orderdate - INTERVAL 40 DAY, o_orderdate + to_days(CAST(o_orderkey % 300 AS INTEGER))]) AS at FROM orders)"
_AS_OF = f"""SELECT p.document_id, p.at, version_number, blob_id, size FROM {_POINTS} p ASOF LEFT JOIN
 (SELECT document_id, created_at, max(version_number) AS version_number, arg_max(blob_id, version_number) AS blob_id, arg_max(size, version_number) AS size FROM ({records._VERSIONS}) GROUP BY ALL) v ON p.document_id = v.document_id AND p.at >= v.created_at"""

_TABLES = {
    "documents": ("documents", "doc_id AS id, source"),
    "blobs": ("documents", "doc_id * 2 AS id, doc_id AS document_id"),
    "versions": ("orders", "o_orderkey AS id, o_orderkey % 2000 AS document_id"),
    "runs": ("events", "event_id AS id, event_id % 3000 AS document_id"),
    "artifacts": ("lineitem", "l_orderkey * 10 + l_linenumber AS id, l_partkey % 3000 AS document_id"),
    "embeddings": ("embeddings", "vec_id AS id, vec_id AS document_id"),
    "messages": ("conversations", "conv_id, turn, role"),
}
_IDS = "doc_id % 5 < 2"


def _cascade(table):
    def query(s, d):
        tables = {n: load(s, d, t).selectExpr(*views._list(x)) for n, (t, x) in _TABLES.items()}
        tables["conversations"] = load(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n")).selectExpr("conv_id", "CASE conv_id % 4 WHEN 0 THEN array(conv_id) WHEN 1 THEN array(conv_id, conv_id + 1, conv_id + 2) WHEN 2 THEN array(conv_id - 2, conv_id + 3) ELSE cast(array() as array<bigint>) END AS document_ids", "timestamp'2024-01-01 00:00:00' AS updated_at")
        out = J.delete_documents(load(s, d, "documents").where(_IDS).selectExpr("doc_id AS document_id"), tables, _AT)[table]
        return out.withColumn("document_ids", F.array_join(F.col("document_ids").cast("array<string>"), ",")) if table == "conversations" else out

    return query


_GONE = f"(SELECT doc_id FROM documents WHERE {_IDS})"
_TALKS = f"""(SELECT conv_id, document_ids, list(x ORDER BY i) FILTER (x IS NOT NULL AND NOT gone) AS kept, count(*) FILTER (x IS NOT NULL AND gone) AS lost FROM
 (SELECT conv_id, document_ids, i, document_ids[i] AS x, document_ids[i] IN {_GONE} AS gone FROM (SELECT conv_id, document_ids, unnest(range(1, greatest(2, len(document_ids) + 1))) AS i FROM
 (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN [conv_id] WHEN 1 THEN [conv_id, conv_id + 1, conv_id + 2] WHEN 2 THEN [conv_id - 2, conv_id + 3] ELSE [] END AS document_ids FROM conversations GROUP BY conv_id))) GROUP BY conv_id, document_ids)"""
_CASCADE = {n: f"SELECT * FROM (SELECT {x} FROM {t}) WHERE {'id' if n == 'documents' else 'document_id'} NOT IN {_GONE}" for n, (t, x) in _TABLES.items() if n != "messages"} | {
    "conversations": f"SELECT conv_id, coalesce(array_to_string(kept, ','), '') AS document_ids, CASE WHEN lost > 0 THEN TIMESTAMP '2024-05-06' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM {_TALKS} WHERE lost = 0 OR kept IS NOT NULL",
    "messages": f"SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM {_TALKS} WHERE lost > 0 AND kept IS NULL)",
}

_ARRIVING = """doc_id AS id, source || '.pdf' AS filename, (CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN text ELSE '%PDF-1.7 ' || text END) AS body, (CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'text/html' ELSE 'application/pdf' END) AS mime_type, n_chars % 50 AS page_count, lang AS folder_id"""


def _imported(s, d, table):
    new = load(s, d, "documents").selectExpr(*views._list(_ARRIVING.replace("'%PDF-1.7 ' || text", "concat('%PDF-1.7 ', text)")), "array(lang) AS tags").withColumn("content", F.col("body").cast("binary"))
    return J.import_files(new.drop("body"), load(s, d, "documents").where("doc_id % 11 = 0").selectExpr("doc_id AS id"), _AT)[table]


_ARRIVED = f"""(SELECT *, CASE WHEN id % 11 = 0 THEN 'skipped' WHEN message IS NOT NULL THEN 'error' ELSE 'imported' END AS outcome FROM (SELECT *, CASE WHEN id % 11 = 0 THEN NULL WHEN body = '' THEN 'Cannot import an empty document' WHEN coalesce(mime_type, 'application/pdf') <> 'application/pdf' THEN 'Only application/pdf documents can be imported'
 WHEN substring(body, 1, 5) <> '%PDF-' THEN 'The selected file does not contain a PDF header' END AS message FROM (SELECT {_ARRIVING} FROM documents)))"""
_VERSION = "sha256(id || '/version/1')"


def _sparse_library(s, d):
    return records.library(s, d).withColumn("status", F.when(F.col("status").isin("ready", "error"), F.col("status"))).withColumn("created_at", F.when(F.col("id") % 6 > 0, F.col("created_at")))


_SPARSE = f"""WITH l AS (SELECT CASE WHEN status IN ('ready', 'error') THEN status END AS status, CASE WHEN id % 6 > 0 THEN strftime(created_at, '%Y-%m') END AS month, page_count, file_size FROM ({records._LIB})),
g AS (SELECT 'all' AS "grouping", '' AS "key", page_count, file_size FROM l UNION ALL SELECT 'status', status, page_count, file_size FROM l UNION ALL SELECT 'month', month, page_count, file_size FROM l)
SELECT "grouping", "key", count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(file_size) AS BIGINT) AS bytes FROM g GROUP BY ALL
UNION ALL SELECT 'status', k, 0, 0, 0 FROM (SELECT unnest(['processing', 'archived', 'pending']) AS k)"""


# --- Bookmarks, labels, images -------------------------------------------------------------------------------------
def _outlined(s, d):
    """Four levels of entries in each order: a line, a part of it, one without title, and one below that."""
    lines = load(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS n", "l_partkey", "l_suppkey", """concat('{"title": "', CASE WHEN l_partkey % 6 = 0 THEN '  ' ELSE concat(' Line ', cast(l_linenumber as string), ' ') END, '", "dest": ', cast(l_linenumber - 1 as string),
 ', "items": [{"title": "Part ', cast(l_partkey as string), '", "dest": ', cast(l_partkey % 5 as string), ', "items": [{"title": "", "dest": 0, "items": [{"title": "deep", "dest": ', cast(l_suppkey % 3 as string), ', "items": []}]}]}]}') AS e""")
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "l_partkey", "l_suppkey", "e"))).alias("l")).select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ", "), F.lit("]")).alias("outline"))


def _bundled(s, d):
    return pages.pages(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count")).selectExpr("doc_id % 301 AS bundle", "doc_id AS position", "doc_id", "page_count")


_DOCS = f"(SELECT doc_id % 301 AS bundle, doc_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id % 301 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset FROM (SELECT doc_id, count(*) AS n FROM {pages._PAGES} GROUP BY doc_id))"
_BOOKMARKS = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem), o AS (SELECT l_orderkey AS doc_id, line, 0 AS depth, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'Line ' || l_linenumber END AS title, l_linenumber - 1 AS dest FROM l
 UNION ALL SELECT l_orderkey, line, 1, 'Part ' || l_partkey, l_partkey % 5 FROM l UNION ALL SELECT l_orderkey, line, 3, 'deep', l_suppkey % 3 FROM l)
SELECT bundle, CAST(row_number() OVER (PARTITION BY bundle ORDER BY doc_id, line, depth) - 1 AS INTEGER) AS seq, doc_id, title, page_offset + dest AS page FROM o JOIN {_DOCS} USING (doc_id) WHERE title <> '' AND dest < n"""


def _painted(s, d):
    return load(s, d, "lineitem").selectExpr("l_orderkey % 400 AS doc_id", "cast(l_linenumber as int) AS page", "(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey * 1000 + l_suppkey AS seq", "CASE WHEN l_suppkey % 9 > 0 THEN concat('im', cast(l_partkey % 5 as string)) END AS object_name", "l_partkey % 90 AS width", "10 + l_suppkey % 70 AS height", "CASE l_partkey % 4 WHEN 0 THEN 'DCTDecode' WHEN 1 THEN 'JPXDecode' WHEN 2 THEN 'JBIG2Decode' END AS filter")


_PAINTED = "(SELECT l_orderkey % 400 AS doc_id, l_linenumber AS page, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey * 1000 + l_suppkey AS seq, 'im' || l_partkey % 5 AS object_name, l_partkey % 90 AS width, 10 + l_suppkey % 70 AS height, CASE l_partkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jp2' WHEN 2 THEN 'jbig2' ELSE 'png' END AS format FROM lineitem WHERE l_suppkey % 9 > 0)"
_IMAGES = f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, object_name ORDER BY seq) AS nth FROM {_PAINTED}) WHERE nth = 1 AND width >= 12 AND height >= 12),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, seq, object_name) - 1 AS INTEGER) AS "index", width * height * 3 AS raw FROM f)
SELECT doc_id, "index", CAST(page AS INTEGER) AS page, object_name, format, width, height, CAST(CASE format WHEN 'jpeg' THEN floor(CAST(raw AS DOUBLE) * 0.1::DOUBLE + 0.5::DOUBLE) WHEN 'png' THEN floor(CAST(raw AS DOUBLE) * 0.5::DOUBLE + 0.5::DOUBLE) ELSE raw END AS BIGINT) AS estimated_bytes, 'pic_page' || page || '_' || ("index" + 1) || '.' || format AS filename FROM i"""


# --- Pages against pages -------------------------------------------------------------------------------------------
def _sized(s, d, side):
    """Pages of 40 lines; on the right one fewer in places, one more in others, and other sizes."""
    n = load(s, d, "documents").selectExpr("doc_id AS pair_id", "cast(floor((size(split(text, '\\n')) - 1) / 40) + 1 as int) AS n")
    n = n if side == "left" else n.selectExpr("pair_id", "n - CASE WHEN pair_id % 8 = 0 THEN 1 ELSE 0 END + CASE WHEN pair_id % 6 = 1 THEN 1 ELSE 0 END AS n")
    return n.where("n > 0").selectExpr("pair_id", "explode(sequence(1, n)) AS page", "n").selectExpr("pair_id", "page", "600.0D AS width" if side == "left" else "600.0D + (pair_id + page) % 4 * 0.5D AS width", "800.0D AS height")


_LEFT = "(SELECT doc_id AS pair_id, unnest(range(1, n + 1)) AS page, CAST(600 AS DOUBLE) AS width FROM (SELECT doc_id, CAST(floor((len(string_split(text, chr(10))) - 1) / 40) + 1 AS INTEGER) AS n FROM documents))"
_RIGHT = "(SELECT pair_id, page, 600 + (pair_id + page) % 4 * 0.5::DOUBLE AS width FROM (SELECT doc_id AS pair_id, unnest(range(1, n - CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 0 END + 1)) AS page FROM (SELECT doc_id, CAST(floor((len(string_split(text, chr(10))) - 1) / 40) + 1 AS INTEGER) AS n FROM documents)))"
_PAGE_DIFF = f"SELECT pair_id, page, {corpus._KINDS}, {corpus._SIMILAR} FROM ({corpus._DIFF}) GROUP BY pair_id, page"
_PAGES = f"""(SELECT *, coalesce(CAST(floor((text_similarity + visual_similarity) / 2.0 + 0.5) AS INTEGER), text_similarity) AS similarity FROM (
 SELECT pair_id, CAST(page AS INTEGER) AS page, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'both' END AS presence, coalesce(abs(a - b) < 1, true) AS same_size,
 coalesce(modified + added + removed, 0) + CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(abs(a - b) < 1, true) THEN 0 ELSE 1 END AS differences, coalesce(similarity, 100) AS text_similarity, CASE WHEN pair_id % 3 = 0 AND a IS NOT NULL THEN CAST((pair_id + page) % 101 AS DOUBLE) END AS visual_similarity
 FROM (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, coalesce(l.page, r.page) AS page, l.width AS a, r.width AS b FROM {_LEFT} l FULL JOIN {_RIGHT} r ON l.pair_id = r.pair_id AND l.page = r.page) LEFT JOIN ({_PAGE_DIFF}) USING (pair_id, page)))"""


def _compared(s, d):
    scores = _sized(s, d, "left").where("pair_id % 3 = 0").selectExpr("pair_id", "page", "cast((pair_id + page) % 101 as double) AS score")
    return C.page_comparison(_sized(s, d, "left"), _sized(s, d, "right"), corpus._diff(s, d), scores)


def _page_pairs(s, d):
    choices = _sized(s, d, "left").selectExpr("pair_id", "page AS page_a", "page % 2 + 1 AS page_b")
    return C.compare_page_pairs(choices, corpus._left(s, d), corpus._left(s, d), _sized(s, d, "left"), _sized(s, d, "right"))


_PAGE_PAIRS = f"""WITH l AS (SELECT pair_id, page, row_number() OVER (PARTITION BY pair_id, page ORDER BY line_no) AS n, text FROM ({corpus._L})), c AS (SELECT pair_id, page AS page_a, page % 2 + 1 AS page_b FROM {_LEFT}),
a AS (SELECT c.pair_id, page_a, page_b, n, text FROM c JOIN l ON l.pair_id = c.pair_id AND l.page = page_a), b AS (SELECT c.pair_id, page_a, page_b, n, text FROM c JOIN l ON l.pair_id = c.pair_id AND l.page = page_b),
t AS (SELECT pair_id, page_a, page_b, count(*) FILTER (a.text IS NULL OR b.text IS NULL OR a.text <> b.text) AS changed, count(*) AS n FROM a FULL JOIN b USING (pair_id, page_a, page_b, n) GROUP BY ALL),
f AS (SELECT c.*, coalesce(changed, 0) AS changed, coalesce(CAST(floor(100.0 * (t.n - changed) / t.n + 0.5) AS INTEGER), 100) AS text_similarity, abs(x.width - y.width) < 1 AS same_size FROM c JOIN {_LEFT} x ON x.pair_id = c.pair_id AND x.page = page_a JOIN {_RIGHT} y ON y.pair_id = c.pair_id AND y.page = page_b LEFT JOIN t ON t.pair_id = c.pair_id AND t.page_a = c.page_a AND t.page_b = c.page_b)
SELECT pair_id, CAST(page_a AS INTEGER) AS page_a, CAST(page_b AS INTEGER) AS page_b, changed + CASE WHEN same_size THEN 0 ELSE 1 END AS differences, text_similarity, same_size, CASE WHEN same_size THEN text_similarity ELSE CAST(floor(text_similarity * 0.5 + 0.5) AS INTEGER) END AS similarity FROM f"""


# --- Streams with state ---------------------------------------------------------------------------------------------
_ANSWER = """'data: {"id": "c' || cast(conv_id as string) || '", "choices": [{"delta": ' || to_json(named_struct('content', text)) || ', "finish_reason": ' || CASE WHEN turn % 3 = 2 THEN '"stop"' ELSE 'null' END || '}]}'"""


def _answers(s, d):
    return T.chat_answers(load(s, d, "conversations").selectExpr("conv_id AS stream_id", "turn AS seq", f"{_ANSWER} AS line"))


def _job_lives(s, d):
    return T.job_states_batch(load(s, d, "events").selectExpr("user_id AS job_id", "event_id", f"{records._STATUS} AS status", "ts AS updated_at"), 3 * 86_400)


#: A life is found event by event: the first one begins it, and the first one after its end the next.
_LIVES = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS job_id, event_id, {records._STATUS} AS status, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
l AS (SELECT job_id, n, ms AS began FROM e WHERE n = 1 UNION ALL SELECT e.job_id, e.n, CASE WHEN e.ms >= l.began + 259200000 THEN e.ms ELSE l.began END FROM l JOIN e ON e.job_id = l.job_id AND e.n = l.n + 1),
t AS (SELECT *, coalesce(max(CAST(status IN {records._TERMINAL} AS INTEGER)) OVER (PARTITION BY job_id, began ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e JOIN l USING (job_id, n))
SELECT job_id, event_id, status, make_timestamp(ms * 1000) AS at, make_timestamp(began * 1000) AS began, CASE WHEN ended = 1 THEN 'rejected' ELSE 'accepted' END AS outcome FROM t
UNION ALL SELECT job_id, NULL, 'expired', make_timestamp((began + 259200000) * 1000), make_timestamp(began * 1000), 'expired' FROM t GROUP BY job_id, began HAVING count(*) FILTER (status IN {records._TERMINAL}) = 0"""
_ANSWERED = """SELECT conv_id AS stream_id, 'c' || conv_id AS id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS content, CAST(count(*) AS INTEGER) AS chunks, max(turn % 3) = 2 AS finished, CASE WHEN max(turn % 3) = 2 THEN 'stop' END AS finish_reason
 FROM (SELECT *, coalesce(count(*) FILTER (turn % 3 = 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM conversations WHERE coalesce(text, '') <> '' OR turn % 3 = 2) GROUP BY conv_id, part"""


# --- Runs, prompts, totals -----------------------------------------------------------------------------------------
def _timed_runs(s, d):
    return records.runs(s, d).join(load(s, d, "events").selectExpr("event_id AS run_id", "ts AS created_at", "CASE WHEN event_id % 3 > 0 THEN ts + make_dt_interval(0, 0, 0, event_id % 97) END AS completed_at"), "run_id")


_RUN_STATS = f"""WITH a AS (SELECT event_id - event_id % 2 AS run_id, count(*) AS n, sum(10 * (event_id % 100)) AS size FROM events WHERE event_id % 4 > 0 GROUP BY 1), t AS (SELECT event_id AS run_id, CASE WHEN event_id % 3 > 0 THEN event_id % 97 * 1000.0::DOUBLE END AS ms FROM events)
SELECT operation, engine, status, CAST(grouping(operation, engine, status) AS INTEGER) AS level, count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'succeeded')::DOUBLE / nullif(count(*) FILTER (status IN {records._TERMINAL}), 0) AS success_rate,
 CAST(sum(coalesce(n, 0)) AS BIGINT) AS artifacts, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes, avg(ms) AS mean_ms, max(ms) AS longest_ms FROM ({records._RUNS}) JOIN t USING (run_id) LEFT JOIN a USING (run_id) GROUP BY CUBE (operation, engine, status)"""


def _settings(s, d):
    return load(s, d, "conversations").select("conv_id").distinct().selectExpr("conv_id", "CASE WHEN conv_id % 3 > 0 THEN concat('Answer ', cast(conv_id as string)) WHEN conv_id % 2 = 0 THEN '' END AS system", "CASE WHEN conv_id % 4 = 1 THEN 'what is known' END AS context").where("conv_id % 7 > 0")


def _roles(s, d):
    return load(s, d, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 5 = 2 THEN 'system' ELSE role END AS role", "text")


_SYSTEM = "CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 3 > 0 THEN 'Answer ' || conv_id END"
_PROMPTS = f"""SELECT conv_id, coalesce('System: ' || {_SYSTEM} || chr(10) || chr(10), '') || CASE WHEN conv_id % 4 = 1 AND conv_id % 7 > 0 THEN 'Context:' || chr(10) || 'what is known' || chr(10) || chr(10) ELSE '' END
 || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Assistant:' AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id"""
_CLOUD = f"""SELECT DISTINCT conv_id, 0 AS seq, 'system' AS role, coalesce({_SYSTEM}, '') AS content FROM conversations
UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER), role, text FROM conversations WHERE turn % 5 <> 2 AND role <> 'system'"""

NAMED = {"reference": r"(?<key>[A-Z]{2,4})-(?<year>\d{4})?(\d+)", "bare": r"Total", "mail": r"(\w+)@(?:(?<host>\w+)\.)+(?<top>\w+)"}


def _named() -> str:
    parts = []
    for name, p in NAMED.items():
        names = E.group_names(p)
        plain = p.replace("?<key>", "").replace("?<year>", "").replace("?<host>", "").replace("?<top>", "")
        count = {"reference": 3, "bare": 0, "mail": 3}[name]
        keys = [(f"${k}", k) for k in range(1, count + 1)] + list(names.items())
        value = lambda g: f"nullif(regexp_extract(hit, {rx(plain)}, {g}), '')"  # noqa: E731, B023
        listed = ", ".join(f"{lit(k)} || '=' || {value(g)}" for k, g in sorted(keys))
        parts.append(f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, {lit(name)} AS name, {f'concat_ws({lit(",")}, {listed})' if keys else 'NULL::VARCHAR'} AS groups, 90 AS confidence FROM {find(views.BIZ, plain)}")
    return " UNION ALL ".join(parts)


_AMOUNTS = "SELECT doc_id, split_part(value, ' ', 1) AS currency, count(*) AS amounts, CAST(sum(CAST(floor(CAST(split_part(value, ' ', 2) AS DOUBLE) * 100 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / 100 AS total"


def _amounts(s, d):
    return E.extract_key_information(views.biz_pages(s, d), ("amount",))


QUERIES = {
    "h8_stored_index": _index,
    "j7_versions_as_of": lambda s, d: J.versions_as_of(records.versions(s, d), _points(s, d)),
    **{f"j8_deleted_{n}": _cascade(n) for n in (*_TABLES, "conversations")},
    "j5_import_outcomes": lambda s, d: _imported(s, d, "outcomes"),
    "j5_imported_documents": lambda s, d: _imported(s, d, "documents").withColumn("tags", F.array_join("tags", ",")),
    "j5_imported_versions": lambda s, d: _imported(s, d, "versions"),
    "j5_imported_blobs": lambda s, d: _imported(s, d, "blobs").withColumn("data", F.col("data").cast("string")),
    "j5_import_counts": lambda s, d: _imported(s, d, "counts"),
    "j1_query_root": lambda s, d: J.query_documents(records.library(s, d).withColumn("folder_id", F.when(F.col("id") % 3 > 0, F.col("folder_id"))), root=True, sort_by="filename", descending=False).select("id", "filename", "total", "has_more"),
    "j3_library_stats_sparse": lambda s, d: J.library_stats(_sparse_library(s, d)),
    "j9_folder_subtree": lambda s, d: J.folder_subtree(more._folders(s, d), 2),
    "i6_merge_checks": lambda s, d: I.merge_checks(load(s, d, "orders").selectExpr("o_custkey AS bundle"), load(s, d, "lineitem").selectExpr("l_suppkey * 7 AS bundle").where("bundle % 3 > 0"), 50),
    "i6_merge_bookmarks": lambda s, d: I.merge_bookmarks(_bundled(s, d), _outlined(s, d)),
    "i7_page_range_labels": lambda s, d: I.page_labels(pages.pages(s, d), "x-of-y", start_page=2, end_page=5, start_number=10),
    "i9_bates_range": lambda s, d: I.bates_numbers(pages.pages(s, d), "B-", "x", 7, 3, start_page=2, end_page=4),
    "i13_image_metadata": lambda s, d: I.image_metadata(_painted(s, d), 12, 12, "pic"),
    "i13_image_counts": lambda s, d: I.image_counts(load(s, d, "lineitem").selectExpr("l_orderkey % 400 AS doc_id", "explode(array(1, 2, 3, 4, 5, 6, 7, 8)) AS page"), _painted(s, d)),
    "g3_page_comparison": _compared,
    "g3_comparison_summary": lambda s, d: C.comparison_summary(_compared(s, d), corpus._diff(s, d)),
    "g4_page_pairs": _page_pairs,
    "m1_job_lives": _job_lives,
    "m5_chat_answers": _answers,
    "k8_run_statistics": lambda s, d: K.run_statistics(_timed_runs(s, d), records.artifacts(s, d)).withColumns({c: F.round(c, 6) for c in ("success_rate", "mean_ms")}),
    "l3_local_prompts": lambda s, d: K.local_prompts(load(s, d, "conversations"), _settings(s, d), 4),
    "l3_cloud_messages": lambda s, d: K.cloud_messages(_roles(s, d), _settings(s, d)),
    "c9_custom_named": lambda s, d: E.extract_custom_named(views.biz_pages(s, d), NAMED).withColumn("groups", F.array_join(F.transform(F.array_sort(F.map_entries("groups")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")),
    "c11_currency_totals": lambda s, d: E.currency_totals(_amounts(s, d)),
    "c11_summary_totals": lambda s, d: E.summary_with_totals(_amounts(s, d)).select("doc_id", "total", F.array_join(F.transform(F.array_sort(F.map_entries("totals")), lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.2f", e["value"]))), ",").alias("totals")),
}
ORACLES = {
    "h8_stored_index": _INDEX,
    "j7_versions_as_of": _AS_OF,
    **{f"j8_deleted_{n}": q for n, q in _CASCADE.items()},
    "j5_import_outcomes": f"SELECT id, outcome, message FROM {_ARRIVED}",
    "j5_imported_documents": f"""SELECT id, filename, 'application/pdf' AS mime_type, CAST(strlen(body) AS BIGINT) AS file_size, page_count, 'ready' AS status, folder_id AS tags, folder_id, TIMESTAMP '2024-05-06' AS created_at, TIMESTAMP '2024-05-06' AS updated_at, TIMESTAMP '2024-05-06' AS last_accessed_at,
 sha256(body) AS file_hash, {_VERSION} AS original_version_id, {_VERSION} AS current_version_id, 'local-only' AS sync_status FROM {_ARRIVED} WHERE outcome = 'imported'""",
    "j5_imported_versions": f"SELECT {_VERSION} AS id, id AS document_id, sha256(id || '/blob/1') AS blob_id, CAST(1 AS INTEGER) AS version_number, 'import' AS source, 'Original import' AS label, TIMESTAMP '2024-05-06' AS created_at FROM {_ARRIVED} WHERE outcome = 'imported'",
    "j5_imported_blobs": f"SELECT sha256(id || '/blob/1') AS id, id AS document_id, body AS data, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256, TIMESTAMP '2024-05-06' AS created_at FROM {_ARRIVED} WHERE outcome = 'imported'",
    "j5_import_counts": f"SELECT count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors FROM {_ARRIVED}",
    "j1_query_root": f"WITH k AS (SELECT id, filename FROM ({records._LIB}) WHERE id % 3 = 0) SELECT *, (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k) > 50 AS has_more FROM k ORDER BY filename, id LIMIT 50",
    "j3_library_stats_sparse": _SPARSE,
    "j9_folder_subtree": f"WITH RECURSIVE t AS (SELECT id FROM {more._FOLDERS} WHERE id = 2 UNION SELECT f.id FROM {more._FOLDERS} f JOIN t ON f.parent_id = t.id) SELECT id FROM t",
    "i6_merge_checks": "SELECT bundle, coalesce(n, 0) AS documents, CASE WHEN n IS NULL THEN 'No documents provided for merging' WHEN n > 50 THEN 'Cannot merge more than 50 documents at once' END AS error FROM (SELECT DISTINCT o_custkey AS bundle FROM orders) LEFT JOIN (SELECT l_suppkey * 7 AS bundle, count(*) AS n FROM lineitem WHERE l_suppkey * 7 % 3 > 0 GROUP BY 1) USING (bundle)",
    "i6_merge_bookmarks": _BOOKMARKS,
    "i7_page_range_labels": f"SELECT doc_id, page, (page + 8) || ' of ' || n AS label FROM (SELECT doc_id, page, count(*) OVER (PARTITION BY doc_id) AS n FROM {pages._PAGES}) WHERE page BETWEEN 2 AND 5",
    "i9_bates_range": f"SELECT doc_id, page, 'B-' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || 'x' AS bates FROM (SELECT doc_id, page, 6 + row_number() OVER (ORDER BY doc_id, page) AS n FROM {pages._PAGES} WHERE page BETWEEN 2 AND 4)",
    "i13_image_metadata": _IMAGES,
    "i13_image_counts": f"""SELECT *, CAST(sum(images) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM (SELECT doc_id, CAST(page AS INTEGER) AS page, coalesce(n, 0) AS images FROM (SELECT DISTINCT l_orderkey % 400 AS doc_id, unnest(range(1, 9)) AS page FROM lineitem) LEFT JOIN (SELECT doc_id, page, count(DISTINCT object_name) AS n FROM {_PAINTED} GROUP BY ALL) USING (doc_id, page))""",
    "g3_page_comparison": f"SELECT * FROM {_PAGES}",
    "g3_comparison_summary": f"""SELECT pair_id, pages_a, pages_b, changed_pages, identical_pages, coalesce(added + removed + modified, 0) AS changes, coalesce(added, 0) AS additions, coalesce(removed, 0) AS deletions, coalesce(modified, 0) AS modifications, similarity, visual_similarity FROM
 (SELECT pair_id, count(*) FILTER (presence <> 'added') AS pages_a, count(*) FILTER (presence <> 'removed') AS pages_b, count(*) FILTER (differences > 0) AS changed_pages, count(*) FILTER (differences = 0) AS identical_pages, CAST(floor(avg(similarity) + 0.5) AS INTEGER) AS similarity, CAST(floor(avg(visual_similarity) + 0.5) AS INTEGER) AS visual_similarity FROM {_PAGES} GROUP BY pair_id)
 LEFT JOIN (SELECT pair_id, {corpus._KINDS} FROM ({corpus._DIFF}) GROUP BY pair_id) USING (pair_id)""",
    "g4_page_pairs": _PAGE_PAIRS,
    "m1_job_lives": _LIVES,
    "m5_chat_answers": _ANSWERED,
    "k8_run_statistics": f"SELECT * REPLACE (round(success_rate, 6) AS success_rate, round(mean_ms, 6) AS mean_ms) FROM ({_RUN_STATS})",
    "l3_local_prompts": _PROMPTS,
    "l3_cloud_messages": _CLOUD,
    "c9_custom_named": _named(),
    "c11_currency_totals": f"{_AMOUNTS} FROM ({entities._all()}) WHERE kind = 'amount' GROUP BY doc_id, currency",
    "c11_summary_totals": f"SELECT doc_id, CAST(sum(amounts) AS BIGINT) AS total, string_agg(currency || ':' || printf('%.2f', total), ',' ORDER BY currency) AS totals FROM ({_AMOUNTS} FROM ({entities._all()}) WHERE kind = 'amount' GROUP BY doc_id, currency) GROUP BY doc_id",
}
