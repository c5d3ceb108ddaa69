"""Chunks, vectors and retrieval over a corpus."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lines of a prompt.
PROMPT_CONTEXT = ("## Document Context\n", "Use the following excerpts from the document to answer the question.", "Always cite the page number when referencing specific information.\n")
PROMPT_NO_CONTEXT = ("No relevant context was found in the document for this question.", "Please answer based on your general knowledge, and note that the information may not be from the document.")
PROMPT_RULES = ("\n## Instructions\n", "- Answer the question based on the provided context", "- Include page number citations when referencing specific information", "- If the context does not contain enough information, say so clearly", "- Be concise and accurate")
#: Queries whose scores with a block of chunks are held at a time.
SLICE = 128
CHUNK = "array<struct<content:string,start_offset:int,end_offset:int>>"
#: A sentence with the marks that end it, or what follows the last one.
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+|$)")


def _pieces(clean: str, size: int) -> list[tuple[str, int, bool]]:
    """(text, length of all sentences before, is a word) of what chunks are made of: sentences, and the words of a first one that is too long."""
    found = _SENTENCE.findall(clean) or [clean]
    before = [0, *accumulate(map(len, found))]
    out = [(s.strip(), at, False) for s, at in zip(found, before)]
    if len(out[0][0]) >= size:
        out[:1] = [(w, 0, True) for w in out[0][0].split(" ")]
    return out


def chunk_bounds(pieces: list[tuple[int, bool]], size: int, overlap: int) -> list[int]:
    """The pieces that begin a chunk, from lengths alone: a piece begins one if with a space it doesn't fit. A sentence brings the overlap along, a word doesn't."""
    begins, held = [0], 0
    for i, (n, word) in enumerate(pieces):
        if held + n + 1 <= size:
            held += n + (held > 0)
        elif word or not held:
            begins += [i] * (held > 0)
            held = n
        else:
            begins.append(i)
            held = min(overlap, held) + 1 + n
    return begins


def split_chunks(text: str | None, size: int, overlap: int) -> list[tuple[str, int, int]]:
    """(content, start_offset, end_offset) of a page's chunks; white space is collapsed first.

    A text of at most size characters is one chunk. In others a chunk is the last overlap characters of the one before, a space and
    whole sentences, as many as fit; a sentence that doesn't fit at all is a chunk too. Offsets count the sentences' characters.
    """
    clean = " ".join((text or "").split())
    if len(clean) <= size:
        return [(clean, 0, len(clean))] if clean else []
    pieces = _pieces(clean, size)
    begins = chunk_bounds([(len(s), word) for s, _, word in pieces], size, overlap)
    out: list[tuple[str, int, int]] = []
    for a, b in zip(begins, [*begins[1:], len(pieces)]):
        content = " ".join(s for s, _, _ in pieces[a:b])
        at, tail = pieces[a][1], ""
        if out and not pieces[a][2]:
            tail = out[-1][0][-overlap:] if overlap else ""
            content = f"{tail} {content}"
        end = pieces[b][1] if b < len(pieces) else len(clean)
        out.append((content, at - len(tail), end))
    last = out[-1]
    return [*out[:-1], (last[0].strip(), *last[1:])] if last[0].strip() else out[:-1]


def chunk_text(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """doc_id, page, chunk_seq, chunk_id, content, start_offset, end_offset; blank pages give none."""

    @F.pandas_udf(CHUNK)
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"content": c, "start_offset": a, "end_offset": b} for c, a, b in split_chunks(t, size, overlap)] for t in texts])

    rows = pages.select("doc_id", "page", F.posexplode(chunks("text")).alias("chunk_seq", "c"))
    return rows.select("doc_id", "page", "chunk_seq", F.sha2(F.concat_ws("|", "doc_id", "page", "chunk_seq"), 256).alias("chunk_id"), "c.*")


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product over norms; 0 where a norm is; vectors of unequal length raise an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors must have the same length"))).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """The vectors by their norms, as doubles."""
    x = vectors.flatten().to_numpy(zero_copy_only=False)
    if x.size and len(set(np.diff(vectors.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors must have the same length")
    x = x.astype(np.float64).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _blocked(queries: DataFrame, chunks: DataFrame, query_block: int, chunk_block: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """query_id, chunk_id, score of pairs of a query (query_id, vector) and a chunk (chunk_id, embedding) that keep(scores, chunk_ids) chooses in each row of a block.

    Queries and chunks are dealt to blocks of bounded size by their ids; every pair of blocks meets in one task, as matrix
    products of SLICE queries. A task holds two blocks, a slice's product and what is kept of the pair, whatever the tables'
    sizes. Null vectors take no part. Vectors must have one length.
    """
    q = queries.where("vector is not null").select(F.col("query_id").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v"))
    c = chunks.where("embedding is not null").select(F.col("chunk_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n_q, n_c = max(1, -(-q.count() // query_block)), max(1, -(-c.count() // chunk_block))
    spread = lambda d, own, n_own, other, n_other: d.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, mine = right.column("id").to_numpy(), left.column("id").to_numpy()
            asked, held = _unit(left.column("v").combine_chunks()), _unit(right.column("v").combine_chunks()).T
            for at in range(0, len(mine), SLICE):
                for i, row in enumerate(asked[at : at + SLICE] @ held, at):
                    best = keep(row, ids)
                    for o, x in zip(out, (np.full(len(best), mine[i]), ids[best], row[best])):
                        o.append(x)
        kinds = np.int64, np.int64, np.float64
        return pa.table([pa.array(np.concatenate(o) if o else np.empty(0, t)) for o, t in zip(out, kinds)], names=["query_id", "chunk_id", "score"])

    left = spread(q, "qb", n_q, "cb", n_c).groupBy("qb", "cb")
    right = spread(c, "cb", n_c, "qb", n_q).select("id", "v", "qb", "cb").groupBy("qb", "cb")
    return left.cogroup(right).applyInArrow(score, "query_id bigint, chunk_id bigint, score double")


def vector_scores(queries: DataFrame, chunks: DataFrame, query_block: int = 16_384, chunk_block: int = 64, chunks_a_task: int = 8_192) -> DataFrame:
    """query_id, chunk_id, score: the cosine of every query (query_id, vector) with every chunk (chunk_id, embedding); 0 where a norm is.

    Blocks of query_block queries meet parts of chunks_a_task chunks. A task holds its queries and meets its chunks in streams of chunk_block, whose pairs, a
    million rows, leave at once: vectors are sent once for each block or part of the other side, as they are. Null vectors take no part. Vectors must have one length.
    """
    kind = lambda d, c: d.schema[c].dataType
    wide = kind(queries, "vector") if kind(queries, "vector") == kind(chunks, "embedding") else "array<double>"
    q = queries.where("vector is not null").select(F.col("query_id").alias("id"), F.col("vector").cast(wide).alias("v"))
    c = chunks.where("embedding is not null").select(F.col("chunk_id").alias("id"), F.col("embedding").cast(wide).alias("v"))
    n_q, chunks_held = max(1, -(-q.count() // query_block)), c.count()
    # Few pairs of blocks are cut finer, for the cores there are.
    n_c = max(1, -(-chunks_held // chunks_a_task), min(-(-chunks.sparkSession.sparkContext.defaultParallelism // n_q), -(-chunks_held // chunk_block)))
    spread = lambda d, asked, n_own, n_other: d.select("id", "v", F.lit(asked).alias("asked"), F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias("other"))
    both = spread(q, True, n_q, n_c).unionByName(spread(c, False, n_c, n_q))
    pair = F.when(F.col("asked"), F.col("own") * n_c + F.col("other")).otherwise(F.col("other") * n_c + F.col("own"))
    dealt = both.select(pair.alias("pair"), "asked", "id", "v").repartitionById(n_q * n_c, "pair").sortWithinPartitions("pair", F.desc("asked"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, held = None, [], [], None
        for batch in batches:
            pairs, asks = batch.column("pair").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(pairs) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(pairs)] if len(pairs) else [0]
            for low, high in zip(cuts, cuts[1:]):
                mine, x = batch.column("id")[low:high].to_numpy(), _unit(batch.column("v")[low:high])
                if pairs[low] != now:
                    now, ids, parts, held = pairs[low], [], [], None
                if asks[low]:
                    ids.append(mine)
                    parts.append(x)
                elif parts:
                    if held is None:
                        asked, held = np.concatenate(ids), np.concatenate(parts)
                        ids, parts = ids[:1], [held]
                    for at in range(0, len(mine), chunk_block):
                        some, found = mine[at : at + chunk_block], x[at : at + chunk_block] @ held.T
                        out = np.tile(asked, len(some)), np.repeat(some, len(asked)), found.ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["query_id", "chunk_id", "score"])

    return dealt.mapInArrow(score, "query_id bigint, chunk_id bigint, score double")


def vector_search(queries: DataFrame, chunks: DataFrame, top_k: int = 5, min_similarity: float = 0.3, query_block: int = 4096, chunk_block: int = 4096, document_ids: tuple = ()) -> DataFrame:
    """query_id, rank, chunk_id, score of the top_k chunks (chunk_id, embedding, and doc_id if document_ids are chosen) for each query (query_id, vector).

    Blocks of queries meet blocks of chunks, and each pair of blocks passes on its own top_k a query. Ties go to the smaller chunk_id; a
    chunk_id that stands more than once counts once, with its best score. Chunks without a vector take no part.
    """
    chunks = chunks.where(F.col("doc_id").isin(*document_ids)) if document_ids else chunks

    def best(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        good = np.flatnonzero(row >= min_similarity)
        return good[np.lexsort((ids[good], -row[good]))][:top_k]

    found = _blocked(queries, chunks.dropDuplicates(["chunk_id"]), query_block, chunk_block, best).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "score")


def build_context(hits: DataFrame, max_length: int = 4000) -> DataFrame:
    """query_id, context: the hits' "[Page p]: content" entries by rank until one overflows; of that a part, if over 100 characters fit."""
    entry = F.concat(F.lit("[Page "), F.col("page"), F.lit("]: "), F.col("content"))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("entry", entry).withColumn("used", F.coalesce(F.sum(F.length("entry") + 2).over(before), F.lit(0)))
    rows = rows.withColumn("over", F.col("used") + F.length("entry") > max_length).withColumn("n_over", F.count_if("over").over(up_to))
    room = (max_length - F.col("used")).cast("int")
    part = F.when(~F.col("over"), F.col("entry")).when((F.col("n_over") == 1) & (room > 100), F.concat(F.substring("entry", F.lit(1), room), F.lit("...")))
    kept = rows.withColumn("part", part).where("n_over = 0 or (over and n_over = 1)").groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("rank", "part")))).alias("parts"))
    return kept.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("context"))


def citations(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, rank, filename (Unknown where missing), page, snippet (200 characters), score."""
    return hits.join(docs.select("doc_id", "filename"), "doc_id", "left").select("query_id", "rank", F.coalesce("filename", F.lit("Unknown")).alias("filename"), "page", F.substring("content", 1, 200).alias("snippet"), "score")


def build_prompts(queries: DataFrame, hits: DataFrame, max_length: int = 4000, page_numbers: bool = True, instructions: str = "") -> DataFrame:
    """query_id, prompt, tokens (a quarter of the characters, rounded up), has_context for every query (query_id, question).

    hits (query_id, rank, page, content) become excerpts by rank, whole ones only, until one doesn't fit in max_length. Queries without
    hits get the text for none.
    """
    page = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("] ")) if page_numbers else F.lit("")
    rows = hits.select("query_id", "rank", F.concat(page, F.coalesce("content", F.lit("")), F.lit("\n")).alias("entry"))
    so_far = F.sum(F.length("entry")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    # The sum grows with the rank: entries are taken up to the first that doesn't fit.
    found = rows.withColumn("used", so_far).groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("used") <= max_length, F.struct("rank", "entry")))).alias("kept"), F.count(F.lit(1)).alias("n"))
    asked = queries.select("query_id", "question").join(found, "query_id", "left")
    has = F.coalesce(F.col("n") > 0, F.lit(False))
    context = F.when(has, F.concat(F.array(*map(F.lit, PROMPT_CONTEXT)), F.transform("kept", lambda e: e["entry"]))).otherwise(F.array(*map(F.lit, PROMPT_NO_CONTEXT)))
    parts = F.concat(F.array(F.lit(instructions)) if instructions else F.array().cast("array<string>"), context, F.array(F.lit("\n## Question\n"), F.col("question")), F.array(*map(F.lit, PROMPT_RULES)))
    return asked.select("query_id", F.array_join(parts, "\n", "").alias("prompt"), has.alias("has_context")).withColumn("tokens", F.ceil(F.length("prompt") / 4).cast("int"))


def attach_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunks (doc_id, chunk_id, ...) with their stored vectors (doc_id, chunk_id, embedding), null where there is none."""
    return chunks.join(vectors.select("doc_id", "chunk_id", "embedding"), ["doc_id", "chunk_id"], "left")


def indexed_documents(attached: DataFrame) -> DataFrame:
    """doc_id, chunks, embedded, indexed (at least one chunk has a vector)."""
    return attached.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded")).withColumn("indexed", F.col("embedded") > 0)


def index_incremental(chunks: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """The index with the documents of chunks added: those it has are kept, or with force replaced."""
    if force:
        return index.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(chunks)
    return index.unionByName(chunks.join(index.select("doc_id").distinct(), "doc_id", "left_anti"))


def index_stats(chunks: DataFrame, dimensions: int = 384) -> DataFrame:
    """documents, chunks, chunks_per_document (2 decimals), estimated_bytes of the vectors."""
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.round(F.count(F.lit(1)) / F.countDistinct("doc_id"), 2).alias("chunks_per_document"), (F.count(F.lit(1)) * dimensions * 4).alias("estimated_bytes"))
