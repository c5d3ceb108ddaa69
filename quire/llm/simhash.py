"""Near-duplicates by SimHash fingerprints, compared exactly in tiles.

Distinct fingerprints are laid out in tiles by the set bits of their two halves. Fingerprints
that differ in at most `radius` bits have halves whose counts differ by no more than that in sum, so
all other pairs of tiles are skipped; the rest are compared in full with exclusive-or and bit counts.
A tile holds a bounded number of fingerprints: larger count classes are cut into several tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored
from .components import components

TILE = 16_384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles; 0 without words."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(shingle)))] if len(w) >= shingle else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        total += np.unpackbits(h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed bigint) of every row of (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(made, "doc_id bigint, fp bigint")


class _Forest:
    """Union of links in one task; keeps those that join two parts."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def fingerprint_links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within radius bits, a forest for each tile pair."""
    spark = distinct.sparkSession
    counts = distinct.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.expr("fp & 4294967295L")).alias("lo"))
    # At most 33 x 33 classes, whatever the number of fingerprints.
    sizes = {(r["hi"], r["lo"]): -(-r["n"] // tile) for r in counts.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = [(h, low, sizes[h, low], h2, low2, sizes[h2, low2]) for h, low in sizes for h2, low2 in sizes if abs(h - h2) + abs(low - low2) <= radius]
    if not near:
        return spark.createDataFrame([], "a bigint, b bigint")
    near = spark.createDataFrame(near, "hi int, lo int, own int, hi2 int, lo2 int, others int")
    placed = counts.join(F.broadcast(near), ["hi", "lo"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("own")).cast("int")).withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    code = lambda h, low, p: ((F.col(h) * 64 + F.col(low)).cast("bigint") * (1 << 40) + F.col(p))
    placed = placed.select("fp", code("hi", "lo", "part").alias("mine"), code("hi2", "lo2", "part2").alias("other"))
    pairs = placed.select(F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"), (F.col("mine") <= F.col("other")).alias("left"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        same = table.column("s")[0].as_py() == table.column("t")[0].as_py()
        fp = table.column("fp").to_numpy()
        side = table.column("left").to_numpy()
        left = np.ascontiguousarray(fp[side]).view(np.uint64)
        right = left if same else np.ascontiguousarray(fp[~side]).view(np.uint64)
        forest = _Forest()
        for i in range(0, len(left), 128):
            block = left[i : i + 128]
            first = i if same else 0
            for k in range(first, len(right), TILE):
                away = np.bitwise_count(block[:, None] ^ right[None, k : k + TILE])
                a, b = np.nonzero(away <= radius)
                for x, y in zip(block[a].view(np.int64).tolist(), right[k + b].view(np.int64).tolist()):
                    if x != y:
                        forest.add(x, y)
        a, b = zip(*forest.kept) if forest.kept else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("s", "t").applyInArrow(compare, "a bigint, b bigint")


def fingerprint_roots(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """The rows of distinct (fp, ...) with root, the same for all fingerprints that reach each other by links of at most radius bits."""
    linked = components(fingerprint_links(distinct, radius, tile))
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of every row of (doc_id, text).

    Equal fingerprints are one node, so copies make no pairs. Null and empty texts have fingerprint
    zero and link like any other; repeated rows keep a row each; a null doc_id has the component of its
    fingerprint, null where no row of the component has an id; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = stored(fingerprint_roots(distinct, radius, tile), "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
