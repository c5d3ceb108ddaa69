"""Queries of search, comparison and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import compare as C
from quire.operators import retrieval as R
from quire.operators import search as S

from . import views
from .duck import find, rx

BIZ, biz, load = views.BIZ, views.biz_pages, views.load


def _context(around: int) -> str:
    low, high = f"greatest(0, start - {around})", f"(start + length(hit) + {around})"
    return f"CASE WHEN {low} > 0 THEN '...' ELSE '' END || substring(body, {low} + 1, {high} - {low}) || CASE WHEN {high} < length(body) THEN '...' ELSE '' END"


def _search(source: str, pattern: str, around: int = 30) -> str:
    return f"SELECT doc_id, page, start, hit AS text, {_context(around)} AS context, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, start) - 1 AS INTEGER) AS match_index FROM {find(source, pattern)}"


_WORD, _PLAIN, _RX = S.query_pattern("the", whole_word=True), S.query_pattern("invoice"), S.query_pattern(r"\d{3,}", regex=True)
_COUNT = f"SELECT doc_id, page, len(regexp_extract_all(text, {rx(_WORD)})) AS n FROM ({views.DOC_PAGES})"


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _left(s, d):
    return C.lines_of_documents(load(s, d, "documents"))


def _right(s, d):
    lines = _left(s, d)
    last = lines.groupBy("pair_id").agg(F.max("line_no").alias("last"))
    rows = lines.join(last, "pair_id").where("line_no < last")
    return rows.select("pair_id", "page", "line_no", F.when(F.col("line_no") % 7 == 6, F.translate("text", _SMALL, _SMALL.upper())).otherwise(F.col("text")).alias("text"))


def _diff(s, d):
    return C.line_diff(_left(s, d), _right(s, d))


_L = "SELECT doc_id AS pair_id, CAST(floor(n / 40) + 1 AS INTEGER) AS page, CAST(n AS INTEGER) AS line_no, l[n + 1] AS text FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_DIFF = f"""WITH a AS ({_L}), b AS (SELECT pair_id, page, line_no, CASE WHEN line_no % 7 = 6 THEN translate(text, '{_SMALL}', '{_SMALL.upper()}') ELSE text END AS text FROM (SELECT *, max(line_no) OVER (PARTITION BY pair_id) AS last FROM a) WHERE line_no < last)
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.line_no, b.line_no) AS line_no, coalesce(a.page, b.page) AS page, CASE WHEN a.pair_id IS NULL THEN 'added' WHEN b.pair_id IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'modified' END AS change, a.text AS before, b.text AS after
FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.line_no = b.line_no"""
_KINDS = ", ".join(f"count(*) FILTER (change = '{k}') AS {k}" for k in ("unchanged", "modified", "added", "removed"))
_SIMILAR = "CAST(floor(100.0 * count(*) FILTER (change = 'unchanged') / count(*) + 0.5) AS INTEGER) AS similarity"
_REPORT = f"""SELECT pair_id, 'unchanged ' || unchanged || ' modified ' || modified || ' added ' || added || ' removed ' || removed || coalesce(chr(10) || lines, '') AS report
 FROM (SELECT pair_id, {_KINDS}, string_agg(CASE change WHEN 'added' THEN '+ ' WHEN 'removed' THEN '- ' ELSE '~ ' END || 'line ' || (line_no + 1) || ': ' || coalesce(after, before), chr(10) ORDER BY line_no) FILTER (change <> 'unchanged') AS lines FROM ({_DIFF}) GROUP BY pair_id)"""


def _chunks(s, d):
    """Every row with its whole text."""
    docs = load(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return load(s, d, "embeddings").join(docs, "vec_id", "left").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 97).alias("doc_id"), (F.col("label") + 1).alias("page"), F.coalesce("content", F.lit("")).alias("content"), "embedding")


def _queries(s, d):
    """A twentieth of all rows, so queries grow with the table."""
    return load(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _hits(s, d):
    return R.vector_search(_queries(s, d), _chunks(s, d), 8, -1.0).join(_chunks(s, d).drop("embedding"), "chunk_id")


def _all_scores(s, d):
    return R.vector_scores(_queries(s, d), load(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")).withColumn("score", F.round("score", 6))


def _names(s, d):
    return load(s, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))


_C = "SELECT vec_id AS chunk_id, vec_id % 97 AS doc_id, CAST(label + 1 AS INTEGER) AS page, coalesce(text, '') AS content, embedding FROM embeddings LEFT JOIN documents ON doc_id = vec_id"
_DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))"
_NORM = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def _top(k: int, least: float) -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, c.chunk_id, q.embedding AS a, c.embedding AS b, {_DOT} / ({_NORM('a')} * {_NORM('b')}) AS score FROM embeddings q, ({_C}) c WHERE q.vec_id % 20 = 0) WHERE score >= {least}) WHERE rank <= {k}"""


_CONTEXT = f"""WITH h AS (SELECT query_id, rank, '[Page ' || page || ']: ' || content AS entry FROM ({_top(8, -1.0)}) JOIN ({_C}) USING (chunk_id)),
u AS (SELECT *, coalesce(sum(length(entry) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h),
o AS (SELECT *, used + length(entry) > 900 AS over_, count(*) FILTER (used + length(entry) > 900) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM u)
SELECT query_id, string_agg(CASE WHEN NOT over_ THEN entry WHEN 900 - used > 100 THEN substring(entry, 1, CAST(900 - used AS INTEGER)) || '...' END, chr(10) || chr(10) ORDER BY rank) AS context FROM o WHERE n = 0 OR (over_ AND n = 1) GROUP BY query_id"""

_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Sentences and the words of a first one that is too long, folded by their lengths, then put together chunk by chunk.
_H1 = rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS clean FROM documents WHERE text IS NOT NULL),
 f AS MATERIALIZED (SELECT doc_id, clean, CASE WHEN len(s) = 0 THEN [clean] ELSE s END AS s FROM (SELECT doc_id, clean, regexp_extract_all(clean, '[^.!?]+(?:[.!?]+|$)') AS s FROM d WHERE length(clean) > 512)),
 u AS MATERIALIZED (SELECT doc_id, clean, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS BIGINT) AS n, t, pos, word FROM (
  SELECT doc_id, clean, i, 0 AS j, trim(s[i]) AS t, coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0) AS pos, false AS word FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM f) WHERE i > 1 OR length(trim(s[1])) < 512
  UNION ALL SELECT doc_id, clean, 1, j, w[j], 0, true FROM (SELECT doc_id, clean, w, unnest(range(1, len(w) + 1)) AS j FROM (SELECT doc_id, clean, string_split(trim(s[1]), ' ') AS w FROM f WHERE length(trim(s[1])) >= 512)))),
 r AS (SELECT doc_id, n, length(t) AS held, 0 AS chunk FROM u WHERE n = 1
  UNION ALL SELECT u.doc_id, u.n, CASE WHEN held + length(t) + 1 <= 512 THEN held + CASE WHEN held > 0 THEN 1 ELSE 0 END + length(t) WHEN word OR held = 0 THEN length(t) ELSE least(50, held) + 1 + length(t) END, CASE WHEN held + length(t) + 1 <= 512 OR held = 0 THEN chunk ELSE chunk + 1 END FROM r JOIN u ON u.doc_id = r.doc_id AND u.n = r.n + 1),
 c AS MATERIALIZED (SELECT doc_id, chunk, any_value(clean) AS clean, string_agg(t, ' ' ORDER BY n) AS body, arg_min(pos, n) AS pos, arg_min(word, n) AS word, max(chunk) OVER (PARTITION BY doc_id) AS last FROM u JOIN r USING (doc_id, n) GROUP BY doc_id, chunk),
 x AS (SELECT doc_id, chunk, body AS content, pos AS start_offset FROM c WHERE chunk = 0 UNION ALL SELECT c.doc_id, c.chunk, CASE WHEN word THEN body ELSE right(content, 50) || ' ' || body END, c.pos - CASE WHEN word THEN 0 ELSE length(right(content, 50)) END FROM x JOIN c ON c.doc_id = x.doc_id AND c.chunk = x.chunk + 1),
 y AS (SELECT doc_id, chunk, content, start_offset, last, CASE WHEN chunk = last THEN length(clean) ELSE lead(pos) OVER (PARTITION BY doc_id ORDER BY chunk) END AS end_offset FROM x JOIN c USING (doc_id, chunk)
  UNION ALL SELECT doc_id, 0, clean, 0, 0, length(clean) FROM d WHERE length(clean) BETWEEN 1 AND 512)
 SELECT doc_id, 1 AS page, CAST(chunk AS INTEGER) AS chunk_seq, sha256(doc_id || '|1|' || chunk) AS chunk_id, CASE WHEN chunk = last THEN trim(content) ELSE content END AS content, CAST(start_offset AS INTEGER) AS start_offset, CAST(end_offset AS INTEGER) AS end_offset FROM y"""

QUERIES = {
    "e1_search_text": lambda s, d: S.search_text(views.doc_pages(s, d), "the", whole_word=True, max_results=20),
    "e1_search_regex": lambda s, d: S.search_text(biz(s, d), r"\d{3,}", regex=True),
    "e2_count_matches": lambda s, d: S.count_matches(views.doc_pages(s, d), "the", whole_word=True),
    "e4_replace_all": lambda s, d: S.replace_text(biz(s, d), "invoice", "Bill $1"),
    "e4_replace_second": lambda s, d: S.replace_text(biz(s, d), "o", "0", occurrence=2),
    "e5_preview_replacements": lambda s, d: S.preview_replacements(biz(s, d), "invoice", "Bill"),
    "e6_search_library": lambda s, d: S.search_library(load(s, d, "documents").select("doc_id", "source", "text"), "SRC1", "source", "text").select("doc_id"),
    "g1_line_diff": _diff,
    "g2_text_similarity": lambda s, d: C.text_similarity(_diff(s, d)),
    "g3_compare_documents": lambda s, d: C.compare_documents(_diff(s, d)),
    "g4_compare_pages": lambda s, d: C.compare_pages(_diff(s, d)),
    "g5_identical_documents": lambda s, d: C.identical_documents(load(s, d, "documents")),
    "g6_string_similarity": lambda s, d: _diff(s, d).where("change = 'modified'").select("pair_id", "line_no", C.string_similarity(F.col("before"), F.col("after")).alias("similarity")),
    "g7_diff_report": lambda s, d: C.diff_report(_diff(s, d)),
    "h1_chunk_text": lambda s, d: R.chunk_text(load(s, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")),
    "h2_cosine_similarity": _all_scores,
    "h3_vector_search": lambda s, d: R.vector_search(_queries(s, d), _chunks(s, d), 5, 0.05).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score")),
    "h4_build_context": lambda s, d: R.build_context(_hits(s, d), 900),
    "h5_citations": lambda s, d: R.citations(_hits(s, d), _names(s, d)).withColumn("score", F.round("score", 6)),
    "h8_index_incremental": lambda s, d: R.index_incremental(_chunks(s, d).select("chunk_id", "doc_id"), _chunks(s, d).where("doc_id % 2 = 0 and chunk_id % 3 = 0").select("chunk_id", "doc_id")),
    "h9_index_stats": lambda s, d: R.index_stats(_chunks(s, d)),
}
ORACLES = {
    "e1_search_text": f"SELECT * FROM ({_search(views.DOC_PAGES, _WORD)}) WHERE match_index < 20",
    "e1_search_regex": _search(BIZ, _RX),
    "e2_count_matches": f"SELECT * FROM (SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS matches FROM ({_COUNT}) GROUP BY GROUPING SETS ((doc_id), (doc_id, page))) WHERE matches > 0",
    "e4_replace_all": f"SELECT doc_id, page, regexp_replace(text, '(?i)invoice', 'Bill $1', 'g') AS replaced, CAST(len(regexp_extract_all(text, '(?i)invoice')) AS INTEGER) AS replacements FROM ({BIZ})",
    "e4_replace_second": f"SELECT b.doc_id, b.page, CASE WHEN hit IS NULL THEN text ELSE substring(text, 1, start) || '0' || substring(text, start + 2) END AS replaced, CASE WHEN hit IS NULL THEN 0 ELSE 1 END AS replacements FROM ({BIZ}) b LEFT JOIN (SELECT * FROM {find(BIZ, '(?i)o')} WHERE i = 2) m ON m.doc_id = b.doc_id AND m.page = b.page",
    "e5_preview_replacements": f"SELECT *, regexp_replace(context, '(?i)invoice', 'Bill', 'g') AS preview FROM ({_search(BIZ, _PLAIN)})",
    "e6_search_library": "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'src1')",
    "g1_line_diff": _DIFF,
    "g2_text_similarity": f"SELECT pair_id, {_KINDS}, {_SIMILAR} FROM ({_DIFF}) GROUP BY pair_id",
    "g3_compare_documents": f"SELECT pair_id, count(*) AS pages, count(*) FILTER (modified + added + removed > 0) AS changed_pages, count(*) FILTER (modified + added + removed = 0) AS identical_pages, CAST(sum(modified + added + removed) AS BIGINT) AS changes, CAST(floor(avg(similarity) + 0.5) AS INTEGER) AS mean_similarity FROM (SELECT pair_id, page, {_KINDS}, {_SIMILAR} FROM ({_DIFF}) GROUP BY pair_id, page) GROUP BY pair_id",
    "g4_compare_pages": f"SELECT pair_id, page, {_KINDS}, {_SIMILAR} FROM ({_DIFF}) GROUP BY pair_id, page",
    "g5_identical_documents": "SELECT sha256(text) AS file_hash, CAST(strlen(text) AS INTEGER) AS size, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1",
    "g6_string_similarity": f"SELECT pair_id, line_no, CAST(CASE WHEN before = after THEN 100 WHEN before = '' OR after = '' THEN 0 ELSE floor((1 - levenshtein(before, after) / CAST(greatest(length(before), length(after)) AS DOUBLE)) * 100 + 0.5) END AS INTEGER) AS similarity FROM ({_DIFF}) WHERE change = 'modified'",
    "g7_diff_report": _REPORT,
    "h1_chunk_text": _H1,
    "h2_cosine_similarity": f"SELECT query_id, chunk_id, round({_DOT} / ({_NORM('a')} * {_NORM('b')}), 6) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.embedding AS a, c.embedding AS b FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)",
    "h3_vector_search": f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ({_top(5, 0.05)})",
    "h4_build_context": _CONTEXT,
    "h5_citations": f"SELECT query_id, rank, CASE WHEN c.doc_id % 2 = 0 AND source IS NOT NULL THEN source || '_' || c.doc_id || '.pdf' ELSE 'Unknown' END AS filename, page, substring(content, 1, 200) AS snippet, round(score, 6) AS score FROM ({_top(8, -1.0)}) JOIN ({_C}) c USING (chunk_id) LEFT JOIN documents d ON d.doc_id = c.doc_id",
    "h8_index_incremental": "SELECT vec_id AS chunk_id, vec_id % 97 AS doc_id FROM embeddings WHERE (vec_id % 97 % 2 = 0 AND vec_id % 3 = 0) OR vec_id % 97 NOT IN (SELECT vec_id % 97 FROM embeddings WHERE vec_id % 97 % 2 = 0 AND vec_id % 3 = 0)",
    "h9_index_stats": "SELECT count(DISTINCT vec_id % 97) AS documents, count(*) AS chunks, round(count(*) / CAST(count(DISTINCT vec_id % 97) AS DOUBLE), 2) AS chunks_per_document, count(*) * 384 * 4 AS estimated_bytes FROM embeddings",
}
# The names under which the whole inputs came first.
for _name in ("g6_string_similarity", "h2_cosine_similarity", "h3_vector_search", "h4_build_context", "h5_citations"):
    QUERIES[f"{_name}_whole"], ORACLES[f"{_name}_whole"] = QUERIES[_name], ORACLES[_name]
