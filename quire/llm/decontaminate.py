"""Benchmark decontamination over a positional inverted index.

The training text is cut into segments of whole documents. Each segment stores, for every
term, the sorted positions at which it stands (the postings). A benchmark phrase is looked up
from its rarest term in the segment: that term's postings, shifted by its place in the phrase,
are candidate starts, which are then intersected with the shifted postings of the other terms,
rarest first. Segments are cut by document, so no term's list is ever gathered in one task and
the lookup needs no shuffle; the index is stored in the shared folder between the two jobs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pick, stored

#: Lower-cases A-Z and turns every other ASCII character that is no digit or letter into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT_WORDS = 1_000_000
BLOCK_BYTES = 8_000_000
#: Segments that are written or read at once, and phrases that are looked up at once.
SEGMENTS_HELD, PHRASES_HELD = 4, 65_536
INDEX_SCHEMA = "segment string, doc_ids array<{}>, n_words array<bigint>, terms array<string>, counts array<int>, positions binary"
MATCH_SCHEMA = "segment string, ordinal int, doc_id {}, n_words bigint, runs array<struct<item_id:bigint,start:bigint,stop:bigint>>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8 bytes; null has none."""
    return text.encode().translate(_FOLD).split() if text else []


def build_index(docs: DataFrame, vocabulary: Iterable[str] | None = None) -> DataFrame:
    """Positional postings of (doc_id, text), one row per segment of about SEGMENT_WORDS words.

    vocabulary: keep the postings of these terms alone (None: of all terms). Null and empty texts
    stay as documents without words; repeated rows stay separate documents; other columns are
    not read; an empty table gives no segments.
    """
    known = None if vocabulary is None else {w.encode(): i for i, w in enumerate(sorted(set(vocabulary)))}
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, lens, chunks, size = [], [], [], 0
        ranks = dict(known) if known is not None else {}

        def close() -> pa.RecordBatch:
            nonlocal made
            made += 1
            flat = np.concatenate(chunks) if chunks else np.empty(0, np.int32)
            at = np.flatnonzero(flat >= 0)
            flat = flat[at]
            order = np.argsort(flat, kind="stable")
            present, counts = np.unique(flat, return_counts=True)
            names = list(ranks)
            rows = [f"{part}-{made}"], [ids], [lens], [[names[i].decode() for i in present]], [counts.tolist()], [at[order].astype("<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.list_(arrow_id)), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.string())), pa.array(rows[4], pa.list_(pa.int32())), pa.array(rows[5], pa.binary())], names=["segment", "doc_ids", "n_words", "terms", "counts", "positions"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                if known is None:
                    one = np.fromiter((ranks.setdefault(w, len(ranks)) for w in found), np.int32, len(found))
                else:
                    one = np.fromiter((ranks.get(w, -1) for w in found), np.int32, len(found))
                ids.append(doc)
                lens.append(len(found))
                chunks.append(one)
                size += len(found)
                if size >= SEGMENT_WORDS or len(ids) >= 100_000:
                    yield close()
                    ids, lens, chunks, size = [], [], [], 0
                    if known is None:
                        ranks = {}
        if ids:
            yield close()

    return pick(docs, "doc_id", "text").mapInArrow(segments, INDEX_SCHEMA.format(id_type.simpleString()))


class _Segment:
    """One segment's postings of the vocabulary's terms as sorted keys term * span + position."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: pa.Array):
        column = lambda c: batch.column(c)[row]
        self.name, self.doc_ids = column("segment").as_py(), column("doc_ids").values
        self.lens = column("n_words").values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.lens)
        self.begins = self.ends - self.lens
        self.span = int(self.ends[-1]) + 1 if len(self.ends) else 1
        place = pc.fill_null(pc.index_in(column("terms").values, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = column("counts").values.to_numpy(zero_copy_only=False)
        asked = place >= 0
        spot = np.frombuffer(column("positions").as_buffer(), "<i4")[np.repeat(asked, counts)].astype(np.int64)
        self.keys = np.repeat(place[asked], counts[asked]) * self.span + spot
        if len(self.keys) > 1 and (np.diff(self.keys) < 0).any():
            self.keys.sort()
        bounds = np.searchsorted(self.keys, np.arange(len(vocabulary) + 1) * self.span)
        self.first, self.count = bounds[:-1], np.diff(bounds)

    def has(self, term: np.ndarray, spot: np.ndarray) -> np.ndarray:
        key = term * self.span + spot
        i = np.searchsorted(self.keys, key)
        found = np.zeros(len(key), bool)
        inside = (i < len(self.keys)) & (spot >= 0) & (spot < self.span)
        found[inside] = self.keys[i[inside]] == key[inside]
        return found

    def doc_of(self, spot: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, spot, side="right")

    def rows(self, doc, item, start, stop) -> pa.RecordBatch:
        """A row per document with its matches merged, by item, where they overlap."""
        runs: dict[int, list] = {}
        for i in np.lexsort((start, item, doc)).tolist():
            d, w = int(doc[i]), int(item[i])
            a, b = int(start[i] - self.begins[d]), int(stop[i] - self.begins[d])
            mine = runs.setdefault(d, [])
            if mine and mine[-1]["item_id"] == w and mine[-1]["stop"] >= a:
                mine[-1]["stop"] = max(b, mine[-1]["stop"])
            else:
                mine.append({"item_id": w, "start": a, "stop": b})
        n = len(self.doc_ids)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([self.name] * n, pa.string()), pa.array(range(n), pa.int32()), self.doc_ids, pa.array(self.lens), pa.array([runs.get(d, []) for d in range(n)], kind)], names=["segment", "ordinal", "doc_id", "n_words", "runs"])


def _segments(batches: Iterator[pa.RecordBatch], terms: Iterable[str]) -> Iterator[_Segment]:
    """The segments of an index, one at a time, with the postings of these terms."""
    vocabulary = pa.array(terms, pa.string())
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Segment(batch, row, vocabulary)


def _chunks(load: np.ndarray, most: int = 2_000_000) -> Iterator[np.ndarray]:
    group = np.cumsum(load) // most
    for g in np.unique(group):
        yield np.flatnonzero(group == g)


def _by_length(phrases: list[tuple[int, tuple[str, ...]]], vocabulary: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    lengths = sorted({len(p) for _, p in phrases})
    places = lambda n: np.fromiter((vocabulary[w] for _, p in phrases if len(p) == n for w in p), np.int32).reshape(-1, n)
    return [(np.array([i for i, p in phrases if len(p) == n], np.int64), places(n)) for n in lengths]


def search_phrases(index: DataFrame, phrases: list[tuple[int, tuple[str, ...]]]) -> DataFrame:
    """Exact occurrences of the phrases (item_id, words): a row per indexed document with merged runs.

    Runs are word spans [start, stop) of a document that occurrences of one item cover; documents
    without any keep an empty list. The phrases go to every task: give them in blocks of bounded size.
    """
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, p in phrases for w in p}))}
    shapes = _by_length(sorted(set(phrases)), vocabulary)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in _segments(batches, vocabulary):
            hits = [(np.empty(0, np.int64),) * 4]
            for all_items, all_terms in shapes:
                for low in range(0, len(all_items), PHRASES_HELD):
                    item, terms = all_items[low : low + PHRASES_HELD], all_terms[low : low + PHRASES_HELD]
                    counts = seg.count[terms]
                    alive = np.flatnonzero(counts.min(axis=1) > 0)
                    item, terms, counts = item[alive], terms[alive].astype(np.int64), counts[alive]
                    order = np.argsort(counts, axis=1, kind="stable")
                    width = terms.shape[1]
                    load = np.take_along_axis(counts, order[:, :1], 1)[:, 0]
                    for some in _chunks(load):
                        n = load[some]
                        rare = order[some, 0]
                        which = np.repeat(some, n)
                        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                        rare_term = terms[some, rare]
                        start = seg.keys[np.repeat(seg.first[rare_term], n) + nth] % seg.span - np.repeat(rare, n)
                        for k in range(1, width):
                            shift = order[which, k]
                            kept = seg.has(terms[which, shift], start + shift)
                            which, start = which[kept], start[kept]
                        kept = start >= 0
                        which, start = which[kept], start[kept]
                        doc = seg.doc_of(start)
                        kept = start + width <= seg.ends[doc] if len(doc) else np.empty(0, bool)
                        hits.append((doc[kept], item[which[kept]], start[kept], start[kept] + width))
            yield seg.rows(*(np.concatenate(x) for x in zip(*hits)))

    return index.mapInArrow(look, MATCH_SCHEMA.format(index.schema["doc_ids"].dataType.elementType.simpleString()))


def search_proximity(index: DataFrame, queries: list[tuple[int, tuple[str, ...]]], slop: int) -> DataFrame:
    """Documents in which every word of a query stands within slop words of its rarest one.

    A row per indexed document; each run is the span from the first to the last of the nearest
    occurrences around one position of the segment's rarest query word.
    """
    queries = [(i, tuple(dict.fromkeys(q))) for i, q in queries if q]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, q in queries for w in q}))}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in _segments(batches, vocabulary):
            hits = [(np.empty(0, np.int64),) * 4]
            for item, query in queries:
                terms = sorted((vocabulary[w] for w in query), key=lambda t: seg.count[t])
                if not seg.count[terms[0]]:
                    continue
                list_of = lambda t: seg.keys[seg.first[t] : seg.first[t] + seg.count[t]] - t * seg.span
                spot = list_of(terms[0])
                low, high = spot.copy(), spot.copy()
                for t in terms[1:]:
                    doc = seg.doc_of(spot)
                    there = list_of(t)
                    i = np.searchsorted(there, spot)
                    padded = np.concatenate(([-(10**12)], there, [10**12]))
                    before, after = padded[i], padded[i + 1]
                    before = np.where((before >= seg.begins[doc]) & (spot - before <= slop), before, -(10**12))
                    after = np.where((after < seg.ends[doc]) & (after - spot <= slop), after, 10**12)
                    near = np.where(spot - before <= after - spot, before, after)
                    kept = np.abs(near - spot) <= slop
                    spot, near, low, high = spot[kept], near[kept], low[kept], high[kept]
                    low, high = np.minimum(low, near), np.maximum(high, near)
                hits.append((seg.doc_of(spot), np.full(len(spot), item), low, high + 1))
            yield seg.rows(*(np.concatenate(x) for x in zip(*hits)))

    return index.mapInArrow(look, MATCH_SCHEMA.format(index.schema["doc_ids"].dataType.elementType.simpleString()))


def windows(items: Iterable[tuple[int, str]], size: int) -> list[tuple[int, tuple[str, ...]]]:
    """Every run of size consecutive words of each item; all words of a shorter one."""
    out = []
    for item, text in items:
        w = [x.decode() for x in words(text)]
        out += [(item, tuple(w[i : i + size])) for i in range(max(1, len(w) - size + 1))] if w else []
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, runs (spans of words that benchmark windows cover, by item).

    The index holds the postings of all terms, whatever the benchmark. doc_ids may be of any type.
    benchmark: (item_id, text). It is taken in blocks of at most about block_bytes of text, each of
    which goes to every task; the blocks' runs are united. Null items and texts have no windows; a
    window of repeated items counts for each id; null doc_ids, null and empty texts and repeated rows
    keep a row each; an empty table gives no rows.
    """
    items = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    # Parquet's row groups are written whole from memory and read whole: a segment takes megabytes, so few make one.
    index = stored(build_index(docs), "postings", **{"parquet.block.row.count.limit": SEGMENTS_HELD})
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        one = search_phrases(index, windows(((r[0], r[1]) for r in block.toLocalIterator()), size))
        found = one if found is None else found.unionByName(one)
    if blocks == 1:
        return found.select("segment", "ordinal", "doc_id", "n_words", "runs")
    return found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"))


def covered(runs: Column) -> Column:
    """How many words the runs cover together."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    spans = F.array_sort(F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))))
    grow = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(a["end"], r["start"]))).alias("n"), F.greatest(a["end"], r["stop"]).alias("end"))
    return F.aggregate(spans, start, grow, lambda a: a["n"])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = contamination(read("documents"), read("benchmark"))
    items = F.array_distinct(F.transform("runs", lambda r: r["item_id"].cast("string")))
    out = found.select("doc_id", "n_words", covered(F.col("runs")).alias("n_hit"), F.array_sort(items).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, phrase)),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN it USING (doc_id) LEFT JOIN nh USING (doc_id)
"""
