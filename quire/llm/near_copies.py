"""Near copies by the exact Jaccard similarity of word shingles, over candidates from SimHash fingerprints and MinHash bands.

Texts whose fingerprints the operator `simhash` links, in steps of at most RADIUS bits, are candidates; copies that differ in more bits come by bands. Every distinct text has 80 minima of its shingles' hashes, cut into 20 bands of four; texts that share a band or
a component of fingerprints are compared by their whole shingle sets. Two texts of similarity 0.8 share no band with a probability of 3 in 100,000,
more similar ones with less. Bands that hold the same texts are compared once. Within a band a text is compared to the
kept ones alone, so a large group of near copies takes no pairs; a band of more texts than PART is cut into parts
first, and what each part keeps is compared again. Where that no longer halves the largest band, its texts are unlike, and parts are compared with parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pick, stored, text_key
from .hashing import BASES, Hashes, Powers, rolling
from .simhash import fingerprint, fingerprint_roots

SHINGLE = 5
LEAST = 0.8
BANDS = 20
ROWS = 4
PART = 256
#: Bits by which linked fingerprints differ at most.
RADIUS = 2
#: Odd factors and offsets of the hash functions.
_FACTORS, _OFFSETS = (np.random.default_rng(n).integers(0, 2**64, BANDS * ROWS, np.uint64) for n in (1, 2))
_FACTORS |= np.uint64(1)
_POWERS = Powers(BASES[0])


def shingles(text: str | None, size: int = SHINGLE, hashes: Hashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) text's word shingles; a shorter text is one shingle, a blank one none."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = (hashes or Hashes()).of(w)
    return np.unique(rolling(h, min(size, len(h)), _POWERS))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set's bands as signed integers; blank texts share one."""
    if not len(hashes):
        return [0]
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS + _OFFSETS).min(axis=0))
    data = least.astype("<u8").tobytes()
    return [xxhash.xxh64_intdigest(data[8 * ROWS * b : 8 * ROWS * (b + 1)], b) - 2**63 for b in range(BANDS)]


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the sets' Jaccard similarity is least or more; two empty sets are alike."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < least * len(large):
        return False
    if not len(large):
        return True
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, text_key, gone for texts in order of (bucket, salt, least_id, null last): those that are near copies of a kept one of their part go.

    Parts stream through; the kept texts of one are held.
    """
    now, kept = None, []
    for batch in batches:
        gone = np.zeros(batch.num_rows, bool)
        sets = batch.column("hashes")
        for i, part in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("salt").to_pylist())):
            if part != now:
                now, kept = part, []
            mine = np.frombuffer(sets[i].as_py(), "<u8")
            gone[i] = any(alike(k, mine) for k in kept)
            if not gone[i]:
                kept.append(mine)
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("text_key"), pa.array(gone)], names=["bucket", "text_key", "gone"])


def keep_distinct(docs: DataFrame, part: int = PART) -> DataFrame:
    """text_key, least_id of the texts of (doc_id, text) that stay: text_key is `common.text_key`, 128 bits of the text, least_id its smallest doc_id.

    A text goes if it is a near copy of one with a smaller (least_id, text_key), null ids last, or of one that goes
    for that reason; of texts that stay no two that share a band or a component of fingerprints are near copies. Null and blank texts are
    copies of each other; an empty table gives no rows.
    """
    keyed = pick(docs, "doc_id", "text").withColumn("text_key", text_key(F.col("text")))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            made = [bands(shingles(t.as_py(), hashes=known)) for t in batch.column(1)]
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(made, pa.list_(pa.int64())), pa.array(fp)], names=["doc_id", "text_key", "bands", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), hashes=known).astype("<u8").tobytes() for t in batch.column(1)], pa.binary())], names=["text_key", "hashes"])

    rows = stored(keyed.mapInArrow(signed, "doc_id bigint, text_key binary, bands array<bigint>, fp bigint"), "signed")
    texts = stored(rows.groupBy("text_key").agg(F.min("doc_id").alias("least_id"), F.any_value("bands").alias("bands"), F.any_value("fp").alias("fp")), "texts")
    forget(rows)
    by_bands = texts.select("text_key", "least_id", F.explode("bands").alias("bucket"))
    # A component of fingerprints is one more bucket; a fingerprint of one text that is linked to none is left out.
    prints = stored(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("texts")), "prints")
    roots = stored(fingerprint_roots(prints, RADIUS), "roots")
    shared = roots.groupBy("root").agg(F.sum("texts").alias("texts")).where("texts > 1")
    by_print = texts.join(roots.join(shared, "root", "left_semi").select("fp", "root"), "fp").select("text_key", "least_id", F.xxhash64(F.lit("print"), "root").alias("bucket"))
    spread = by_bands.unionByName(by_print)
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("text_key")).alias("held"), F.sum(F.xxhash64("text_key").cast("decimal(20,0)")).alias("total")).where("n > 1")
    once = sizes.groupBy("n", "held", "total").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = stored(spread.join(once, "bucket"), "members")
    wanted = members.select("text_key", "least_id").distinct()
    # One row of every wanted text: that of its smallest doc_id.
    found = keyed.join(wanted, (keyed["text_key"] == wanted["text_key"]) & keyed["doc_id"].eqNullSafe(wanted["least_id"])).select(keyed["text_key"], "text")
    found = stored(found.mapInArrow(sets, "text_key binary, hashes binary").dropDuplicates(["text_key"]), "sets")

    kept = "bucket bigint, text_key binary, gone boolean"
    left, dropped = members, []
    before = None
    while True:
        most = left.agg(F.max("n")).first()[0] or 0
        # Parts go on as long as they halve the largest band.
        cut = most > part and (before is None or 2 * most <= before)
        # After that, bands that are still larger are compared part by part with each other.
        small = left if cut else left.where(F.col("n") <= part)
        salt = F.pmod(F.xxhash64("text_key", F.lit(most)), F.greatest(F.lit(1), F.ceil(F.col("n") / part))) if cut else F.lit(0)
        dealt = small.join(found, "text_key").withColumn("salt", salt.cast("int"))
        dealt = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.asc_nulls_last("least_id"), "text_key")
        done = stored(dealt.select("bucket", "salt", "text_key", "hashes").mapInArrow(_sort_out, kept), "sorted_out")
        dropped.append(done.where("gone").select("text_key"))
        if not cut:
            break
        large = left.where(F.col("n") > part)
        stay = large.join(done.where("not gone").select("bucket", "text_key"), ["bucket", "text_key"]).drop("n")
        left = stored(stay.join(stay.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").where("n > 1").select("bucket", "text_key", "least_id", "n"), "members")
        before = most
    dropped.append(stored(_part_by_part(left.where(F.col("n") > part), found, part), "sorted_out"))
    gone = reduce(DataFrame.unionByName, dropped)
    return texts.select("text_key", "least_id").join(gone.distinct(), "text_key", "left_anti")


def _part_by_part(large: DataFrame, found: DataFrame, part: int) -> DataFrame:
    """text_key of the texts of large bands that are near copies of one with a smaller (least_id, text_key), null ids last.

    A band of n unlike texts is n / part parts, each of which meets every other in a task of its own, which holds one of the
    two: memory is bounded by the part, and no pair is left out. A text's row is copied once for each part.
    """
    parts = F.ceil(F.col("n") / part).cast("int")
    rows = large.withColumn("mine", F.pmod(F.xxhash64("text_key", F.lit("part")), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("streams"), "text_key", "least_id").join(found, "text_key")
    keys = ["bucket", "low", "high"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "streams", F.asc_nulls_last("least_id"), "text_key").select(*keys, "streams", "text_key", "least_id", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            gone = []
            keys_ = zip(*[batch.column(c).to_pylist() for c in ("bucket", "low", "high")])
            for key, streams, text, id_, data in zip(keys_, *[batch.column(c).to_pylist() for c in ("streams", "text_key", "least_id", "hashes")]):
                if key != now:
                    now, held = key, []
                mine = np.frombuffer(data, "<u8")
                order = (id_ is None, id_ or 0, text)
                # Texts of one part meet where it meets itself.
                if streams or key[1] == key[2]:
                    gone += [max(order, o)[2] for o, theirs in held if alike(theirs, mine)]
                if not streams:
                    held.append((order, mine))
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.binary())], names=["text_key"])

    return rows.mapInArrow(compare, "text_key binary").distinct()
