"""Packed token-id matrices: best-fit-decreasing with capacities in a segment tree.

Documents are tokenised and cut losslessly into pieces of at most `size` ids; each task packs its pieces
window by window (a bounded number of ids at a time), longest first, each into the fullest row that
still has room, found by descending a segment tree over the rows' capacities. A window's rows become fixed-width
id matrices, with cumulative segment lengths and positions that start again with every segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder
from .tokens import default_json, token_pieces

SIZE = 2048
WINDOW_IDS = 4_000_000
SCHEMA = "matrix string, row int, input_ids binary, position_ids binary, cu_seqlens array<int>, segments array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint>>"


class Capacities:
    """Rows by remaining room: a segment tree over room 0..size counts the rows of each."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """A row of the least room that is at least need, with that room; taken out."""
        i = self.leaves + need
        if not self.count[i]:
            # Up until a right-hand neighbour holds rows, then down to its least room.
            while i > 1 and (i % 2 or not self.count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i //= 2
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indices of the pieces in each row; rows hold size at most."""
    tree, out = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        spot = tree.take(lengths[i])
        if spot:
            row, room = spot
        else:
            row, room = len(out), size
            out.append([])
        out[row].append(i)
        tree.add(row, room - lengths[i])
    return out


def packed_rows(docs: DataFrame, size: int = SIZE, end_id: int = 0, pad_id: int = 0, window_ids: int = WINDOW_IDS, json_path: str | None = None) -> DataFrame:
    """Rows of the matrices of (doc_id, text): matrix, row, input_ids, position_ids, cu_seqlens, segments.

    input_ids and position_ids are little-endian unsigned 32-bit, size of each; cu_seqlens starts at 0 and ends with
    the row's real ids, after which pad_id and positions from 0 follow. Every document ends with end_id, the first
    of several pieces may be the shorter one. Null texts count as empty, repeated rows and null ids are packed like any other; an
    empty table gives no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[dict] = []
        total = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = best_fit_decreasing([p["length"] for p in held], size)
            for lo in range(0, len(rows), 256):
                ids = np.full((len(rows[lo : lo + 256]), size), pad_id, "<u4")
                spots = np.zeros_like(ids)
                ends, segments = [], []
                for r, row in enumerate(rows[lo : lo + 256]):
                    at, cuts = 0, [0]
                    for i in row:
                        n = held[i]["length"]
                        ids[r, at : at + n] = np.frombuffer(held[i]["ids"], "<u4")
                        spots[r, at : at + n] = np.arange(n)
                        at += n
                        cuts.append(at)
                    spots[r, at:] = np.arange(size - at)
                    ends.append(cuts)
                    segments.append([{k: held[i][k] for k in ("doc_id", "piece", "start", "length")} for i in row])
                n = len(ends)
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{made}"] * n), pa.array(range(lo, lo + n), pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in spots], pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array(segments, kind)], names=["matrix", "row", "input_ids", "position_ids", "cu_seqlens", "segments"])
            made += 1

        for batch in batches:
            for piece in batch.to_pylist():
                held.append(piece)
                total += piece["length"]
                if total >= window_ids:
                    yield from close()
                    held, total = [], 0
        if held:
            yield from close()

    return token_pieces(docs, size, end_id, json_path=json_path).mapInArrow(pack, SCHEMA)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """Writes the packed rows of the documents under path (zstd Parquet, a binary row each)."""
    packed_rows(docs, **options).write.option("compression", "zstd").parquet(path)


def op9_matrices(spark, sf_dir: str) -> DataFrame:
    """A row for each packed piece of all documents, from the written matrices: doc_id, piece, start, length, ids_crc32, matrix, row, offset."""
    path = new_folder(spark, "matrices")
    write_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, json_path=default_json())
    rows = spark.read.parquet(path).select("matrix", "row", "input_ids", "cu_seqlens", F.posexplode("segments").alias("i", "s"))
    at = F.get("cu_seqlens", F.col("i"))
    ids = F.substring(F.col("input_ids"), (4 * at + 1).cast("int"), (4 * F.col("s.length")).cast("int"))
    return rows.select("s.doc_id", "s.piece", "s.start", "s.length", F.crc32(ids).alias("ids_crc32"), "matrix", "row", at.alias("offset"))
