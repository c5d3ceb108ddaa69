"""Exact removal of long repeated passages, by automata of confirmed passages.

Every window of `size` words is represented by its minimizer, the least of the hashes of the `gram`-word
runs in it; neighbouring windows with one minimizer form a span. Texts are dealt to blocks of bounded size by their
place in the input, and a block keeps one place of each of its distinct spans.
Confirming: a window can only repeat where its minimizer is chosen twice. Spans that occur twice as a whole are
confirmed by their hash; the windows of other spans with a repeated minimizer are compared one by one, by a 128-bit
hash, with those of the distinct spans of that minimizer.
Locating: a block gets the places of the confirmed passages it holds, one place for each. They are read from its texts,
compiled into one Aho-Corasick automaton over words, and all its documents stream through it; the automaton alone
finds where else in the block they stand. Automata are bounded by the block, and every document passes one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pick, spread_join, stored
from .hashing import BASES, Hashes, Powers, mix, rolling

SIZE = 35
GRAM = 8
SHARD_CHARS = 1_000_000
#: Windows worked on at once; longer documents are cut into stretches of so many.
STRETCH = 1 << 22

class _Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _least_at(x: np.ndarray, n: int) -> np.ndarray:
    """The index of the least entry in every run of n entries, by their high bits; the first of equal ones."""
    # Fixed, so that equal windows choose alike anywhere; a stretch has fewer entries.
    bits = np.uint64(28)
    key = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    width = 1
    while width < n:
        step = min(width, n - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    return (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


PAIR = ("minimizer", "span")
_NO_WINDOWS = pa.table({"shard": pa.array([], pa.int64()), "doc": pa.array([], pa.int32()), "first": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "asks": pa.array([], pa.bool_())})
_SPANS = "array<struct<minimizer:bigint,span:bigint,n:int,doc:int,first:int,windows:int>>"


def _split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _sums(h: np.ndarray, powers: Powers) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers.get(len(h) + 1)[0][: len(h)], dtype=np.uint64)))


def _block_spans(h: np.ndarray, owner: np.ndarray, size: int, gram: int, powers: list[Powers]) -> list[np.ndarray]:
    """minimizer, span hash, first window and number of windows of every span of the words h of several documents.

    owner is the document of each word; windows that reach into the next document are none. Long
    inputs are cut into stretches, whose windows choose alike; a span that a cut divides is two.
    """
    found = []
    for low in range(0, len(h) - size + 1, STRETCH):
        part, own = h[low : low + STRETCH + size - 1], owner[low : low + STRETCH + size - 1]
        grams = rolling(part, gram, powers[0])
        at = _least_at(grams, size - gram + 1)
        inside = own[: len(at)] == own[size - 1 :]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | ~inside[:-1]))
        first = np.flatnonzero(new & inside)
        if not len(first):
            continue
        ends = np.concatenate((np.flatnonzero(new | ~inside), [len(at)]))
        after = ends[np.searchsorted(ends, first, "right")]
        sums, down, stop = _sums(part, powers[1]), powers[1].get(len(part) + 1)[1], after - 1 + size
        whole = mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64) * np.uint64(BASES[0]))
        found.append((grams[at[first]].view(np.int64), whole.view(np.int64), first + low, after - first))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4


def _distinct(minimizer: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each run of equal pairs after sorting by a hash of both, and how many there are."""
    order = np.argsort(mix(minimizer.view(np.uint64)) ^ span.view(np.uint64), kind="stable")
    a, b = minimizer[order], span[order]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return order[start], np.diff(np.concatenate((start, [len(order)])))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(n.sum())


def _owners(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The document of each word and the first word of each document."""
    counts = np.array(counts, np.int64)
    return np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts


def repeated_passages(docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, n_words, spans, kept of every row of (doc_id, text).

    spans: disjoint word spans [start, stop) covered by windows of `size` words whose sequence starts
    anywhere else too; kept: the other words, joined by one space. Windows are judged on the input.
    Null and empty texts have no words; repeated rows and equal doc_ids are documents of their own and
    repeat each other; an empty table gives no rows.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, task, count = Hashes(), [Powers(b) for b in BASES], TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            words = [_split(t) for t in texts]
            owner, begins = _owners([len(w) for w in words])
            h = np.concatenate([hashes.of(w) for w in words] or [np.empty(0, np.uint64)])
            a, b, first, n = _block_spans(h, owner, size, gram, powers)
            one, copies = _distinct(a, b) if len(a) else (np.empty(0, np.int64),) * 2
            doc = owner[first[one]] if len(one) else one
            fields = [a[one], b[one], *(x.astype(np.int32) for x in (copies, doc, first[one] - begins[doc], n[one]))]
            spans = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["minimizer", "span", "n", "doc", "first", "windows"])
            spans = pa.ListArray.from_arrays(pa.array([0, len(spans)], pa.int32()), spans)
            columns = [pa.array([task << 32 | count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string())), spans]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "texts", "spans"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= shard_chars or len(texts) >= shard_chars // 16:
                    yield block()
                    ids, texts, held, count = [], [], 0, count + 1
        if texts:
            yield block()

    # One row a block: every text is split and hashed whole here alone. Blocks are numbered by task, and written, so they stay as they are.
    blocks = stored(pick(docs, "doc_id", "text").mapInArrow(choose, f"shard bigint, ids array<bigint>, texts array<string>, spans {_SPANS}"), "blocks")
    spans = blocks.select("shard", F.inline("spans"))
    each = stored(spans.groupBy(*PAIR).agg(F.sum("n").alias("copies"), F.min("shard").alias("speaker"), F.count(F.lit(1)).alias("rows")), "each")
    kinds = stored(each.groupBy("minimizer").agg(F.sum("copies").alias("total"), F.count_if(F.col("copies") == 1).alias("single"), F.count(F.lit(1)).alias("different")).where("total > 1").drop("total"), "kinds")
    compare = (F.col("single") > 0) & (F.col("kinds") > 1)
    marks = spread_join(each, kinds.withColumn("kinds", F.col("different")), ["minimizer"], "different", "span").where((F.col("copies") > 1) | compare)
    marks = stored(marks.select(*PAIR, "copies", "speaker", "rows", compare.alias("compare")), "marks")
    forget(each, kinds)
    sent = spread_join(spans, marks, list(PAIR), "rows", "shard")
    # whole: the span itself repeats; told: its windows are compared, those of a repeated span by one block alone.
    told = F.col("compare") & ((F.col("copies") == 1) | (F.col("shard") == F.col("speaker")))
    sent = sent.select("shard", "doc", "first", "windows", "n", (F.col("copies") > 1).alias("whole"), told.alias("told"))
    sent = stored(sent.where("whole or told"), "sent")
    forget(marks)

    def candidates(key, left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, powers = Hashes(), [Powers(b) for b in BASES]
        doc, first, n = (right.column(c).to_numpy().astype(np.int64) for c in ("doc", "first", "windows"))
        texts = left.column("texts")[0]
        used, place = np.unique(doc, return_inverse=True)
        h = [hashes.of(_split(texts[i].as_py())) for i in used.tolist()]
        begins = _owners([len(x) for x in h])[1]
        at = _ranges(begins[place] + first, n)
        h = np.concatenate(h)
        a, b = (rolling(h, size, p)[at].view(np.int64) for p in powers)
        asks = np.repeat(~right.column("whole").to_numpy(), n)
        columns = [np.full(len(at), key[0].as_py(), np.int64), np.repeat(doc, n).astype(np.int32), _ranges(first, n).astype(np.int32), a, b, asks]
        return pa.table([pa.array(c) for c in columns], names=["shard", "doc", "first", "a", "b", "asks"])

    texts = blocks.select("shard", "ids", "texts").groupBy("shard")
    asking = sent.where("told").select("shard", "doc", "first", "windows", "whole").groupBy("shard")
    windows = texts.cogroup(asking).applyInArrow(lambda key, left, right: candidates(key, left, right) if right.num_rows else _NO_WINDOWS, "shard bigint, doc int, first int, a bigint, b bigint, asks boolean")
    windows = stored(windows, "windows")
    twice = stored(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("asks").alias("asked")).where("rows > 1 and asked").drop("asked"), "twice")
    single = spread_join(windows.where("asks").select("shard", "doc", "first", "a", "b"), twice, ["a", "b"], "rows", "shard", "left_semi")
    single = stored(single.select("shard", "doc", "first"), "single")
    forget(windows, twice)
    confirmed = sent.where("whole").select("shard", "doc", "first", "windows", "n").unionByName(single.select("shard", "doc", "first", F.lit(1).alias("windows"), F.lit(1).alias("n")))

    def locate(key, left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left.column("ids")[0].as_py()
        words = [_split(t.as_py()) for t in left.column("texts")[0]]
        # Words are the letters of the automaton; 0, between documents, is in no passage.
        numbers = _Numbers()
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        letters = np.zeros(begins[-1], np.uint32)
        if right.num_rows:
            for at, w in zip(begins.tolist(), words):
                letters[at : at + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.uint32, len(w))
        gone = np.zeros(len(letters) + 1, np.int64)
        if right.num_rows:
            doc, first, n, copies = (right.column(c).to_numpy().astype(np.int64) for c in ("doc", "first", "windows", "n"))
            start = begins[doc] + first
            order = np.argsort(start, kind="stable")
            start, n, copies = start[order], n[order], copies[order]
            # What one document of the block alone holds is joined to longer passages; what others hold too stays a passage of its own.
            alone = copies == 1
            joined = np.flatnonzero(alone)
            s, e = start[joined], start[joined] + n[joined]
            new = np.concatenate(([True], s[1:] != e[:-1])) if len(s) else np.empty(0, bool)
            runs = [*zip(s[new].tolist(), e[np.concatenate((new[1:], [True]))].tolist())] if len(s) else []
            runs += zip(start[~alone].tolist(), (start + n)[~alone].tolist())
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
            stream = tuple(letters.tolist())
            for x, y in runs:
                automaton.add_word(stream[x : y - 1 + size])
            automaton.make_automaton()
            hits = np.array(list(automaton.iter(stream)), np.int64).reshape(-1, 2)
            gone = np.bincount(hits[:, 0] - hits[:, 1] + 1, minlength=len(gone)) - np.bincount(hits[:, 0] + 1, minlength=len(gone))
        gone = np.concatenate(([0], np.cumsum(gone)[:-1] > 0, [0])).astype(np.int8)
        edges = np.flatnonzero(np.diff(gone))
        spans: list[list[dict]] = [[] for _ in docs]
        for d, x, y in zip((np.searchsorted(begins, edges[::2], "right") - 1).tolist(), edges[::2].tolist(), edges[1::2].tolist()):
            spans[d].append({"start": x - int(begins[d]), "stop": y - int(begins[d])})
        kept = []
        for w, out in zip(words, spans):
            stops = [0, *(s["stop"] for s in out)]
            kept.append(b" ".join(chain.from_iterable(w[x:y] for x, y in zip(stops, [*(s["start"] for s in out), len(w)]))).decode())
        kinds = pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()
        return pa.table([pa.array(a, t) for a, t in zip((docs, [len(w) for w in words], spans, kept), kinds)], names=["doc_id", "n_words", "spans", "kept"])

    return texts.cogroup(confirmed.groupBy("shard")).applyInArrow(locate, "doc_id bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, kept string")


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
gone AS (SELECT doc_id, list(j ORDER BY j) AS js FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE (SELECT string_agg(w[k], ' ' ORDER BY k) FROM (SELECT unnest(range(1, len(w) + 1)) AS k) WHERE NOT list_contains(js, k)) END, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
