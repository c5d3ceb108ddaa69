"""Exact top-k inner products by a Voronoi kNN join.

One more coordinate, sqrt(M - |x|^2) with M the largest squared norm (0 for queries), turns the
largest inner product into the smallest Euclidean distance. Pivots cut space into cells. Each query is first
solved against a bounded block of its home cell, which gives it k distances to beat. From these follows, for each
cell of queries, the ring around every pivot in which their k best must lie; a data row goes to a group of
query cells only if it lies in all the rings of one of them. Groups are solved in blocks of bounded size by
integer-exact products, and a block's k best a query are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

PIVOTS = 64
GROUP_QUERIES = 256
BLOCK_ROWS = 20_000


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v = floor(scale * x) as bigints of (vec_id, embedding).

    A vector that is null or holds a null or non-finite component is left out, as is a null vec_id, and as is one
    whose scaled squared norm reaches 2^124: its components or products may not fit what holds them. Repeated rows stay.
    """
    x = pick(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    x = x.where(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    fits = F.aggregate("embedding", F.lit(0.0), lambda a, e: a + (F.abs(e.cast("double")) * scale + 1) * (F.abs(e.cast("double")) * scale + 1)) < 2.0**124
    return x.where(fits).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """The lists as rows, the shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    out[np.arange(dim)[None, :] < lens[:, None]] = flat
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows (x, extra) to the pivots, whose last coordinate is the extra one."""
    full = np.concatenate((x.astype(np.float64), extra[:, None]), axis=1)
    square = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def solve(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int, exact: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k best rows other than its own; ties go to the smaller vec_id."""
    order = np.lexsort((*x.T[::-1], x_id))
    x_id, x = x_id[order], x[order]
    first = np.concatenate(([True], x_id[1:] != x_id[:-1])) if len(x_id) else np.empty(0, bool)
    x_id, x = x_id[first], x[first].astype(exact)
    out: list[tuple] = []
    for i in range(0, len(q), 256):
        score = q[i : i + 256].astype(exact) @ x.T
        score = score if exact is object else score.astype(np.int64)
        for mine, row in zip(q_id[i : i + 256], score):
            own = x_id != mine
            ids, row = x_id[own], row[own]
            if len(row) > k:
                least = (np.sort(row) if exact is object else np.partition(row, len(row) - k))[len(row) - k]
                best = np.concatenate((np.flatnonzero(row > least), np.flatnonzero(row == least)[:k]))
            else:
                best = np.arange(len(row))
            by_score = sorted(range(len(best)), key=lambda j: (-row[best[j]], ids[best[j]])) if exact is object else np.lexsort((ids[best], -row[best]))
            best = best[by_score][:k]
            out.append((np.full(len(best), mine), ids[best], row[best]))
    return tuple(np.concatenate(a) for a in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS, dealt_only: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row of (vec_id, v) its k largest inner products.

    is_query: a condition on vec_id. Candidates are all rows but those of the query's own vec_id;
    ties go to the smaller vec_id. Repeated vec_ids are reduced to one candidate, with their least vector, before
    anything is counted, so that k + 1 distances are always those of k other candidates; queries of one
    id are answered together. Vectors of unequal length count as padded by zeros.
    Squared norms must be below 2^124, as quantised() sees to; from 2^62 on scores are whole numbers of any length, ranked as
    they are, and null where they don't fit 64 bits. Pivots: a bounded sample of the rows, by hash.
    Empty tables give no rows; columns not named are ignored. dealt_only gives the rows as dealt to groups and blocks
    instead, to count how many copies of the data there are.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = stored(vectors.select("vec_id", "v", is_query.alias("is_query")), "vectors")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("most")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not seen["n"] or not seen["dim"]:
        return spark.createDataFrame([], schema) if not seen["n"] else _ranked(rows.where("is_query").select(F.col("vec_id").alias("query_id")).distinct(), rows, k)
    dim, most, total = seen["dim"], seen["most"], seen["n"]
    exact = np.float64 if most < 2.0**52 else np.int64 if most < 2.0**61 else object
    score_type, score_kind = (pa.decimal128(38, 0), "decimal(38,0)") if exact is object else (pa.int64(), "bigint")
    full = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("v")))
    data = rows.groupBy("vec_id").agg(F.min(full).alias("v")).withColumn("is_query", F.lit(False))
    # A row is a candidate or a query; the query's id has a candidate of its own.
    rows = stored(data.unionByName(rows.where("is_query").select("vec_id", full.alias("v"), "is_query").distinct()), "roles")
    chosen = rows.where("not is_query").select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    at = np.unique(np.array([r["v"] + [0] * (dim - len(r["v"])) for r in chosen], np.float64), axis=0)
    at = at[np.random.default_rng(0).permutation(len(at))[:pivots]]
    at = np.concatenate((at, np.sqrt(np.maximum(most - (at**2).sum(1), 0))[:, None]), axis=1)
    slack = 1e-6 * (1 + most**0.5)

    def near(x: np.ndarray) -> np.ndarray:
        """Distances of data rows to the pivots."""
        return _distances(x, np.sqrt(np.maximum(most - (x.astype(np.float64) ** 2).sum(1), 0)), at)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, asks = _matrix(batch.column("v"), dim), batch.column("is_query").to_numpy(zero_copy_only=False)
            cell = np.empty(len(x), np.int32)
            cell[~asks], cell[asks] = near(x[~asks]).argmin(1), _distances(x[asks], np.zeros(asks.sum()), at).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    rows = stored(rows.select("vec_id", "v", "is_query").mapInArrow(located, "vec_id bigint, v array<bigint>, is_query boolean, cell int"), "cells")
    sizes: dict[bool, dict[int, int]] = {True: {}, False: {}}
    # Two rows for each pivot at most.
    for r in rows.groupBy("is_query", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["is_query"]][r["cell"]] = r["n"]
    asked, filled = sizes[True], sorted(sizes[False])
    if not asked:
        return spark.createDataFrame([], schema)
    # A query's home is the nearest cell that has data. A block of the home's rows gives it k scores to beat.
    home = {c: min(filled, key=lambda d: (np.linalg.norm(at[c] - at[d]), d)) for c in asked}
    crowd: dict[int, int] = {}
    for c, d in home.items():
        crowd[d] = crowd.get(d, 0) + asked[c]
    table = spark.createDataFrame([(c, home.get(c, -1), -(-crowd.get(home.get(c, -1), 0) // (4 * group_queries)), -(-crowd.get(c, 0) // (4 * group_queries)), -(-sizes[False].get(c, 0) // block_rows)) for c in range(len(at))], "cell int, home int, parts int, visits int, blocks int")
    placed = rows.join(F.broadcast(table), "cell")
    pick_one = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    visitors = placed.where("is_query").select("vec_id", "v", "is_query", "cell", "home", pick_one(F.col("parts")).alias("part"))
    hosts = placed.where((~F.col("is_query")) & (F.col("visits") > 0)).where(pick_one(F.greatest(F.col("blocks"), F.lit(1))) == 0)
    hosts = hosts.select("vec_id", "v", "is_query", "cell", F.col("cell").alias("home"), F.explode(F.sequence(F.lit(0), F.col("visits") - 1)).alias("part"))

    def bounds(group: pa.Table) -> pa.Table:
        """cell, pivot, low, high: how near and far from each pivot the k best of the cell's queries can lie."""
        asks = group.column("is_query").to_numpy()
        ids, x, cell = group.column("vec_id").to_numpy(), _matrix(group.column("v"), dim), group.column("cell").to_numpy()
        own, q, of = ids[asks], x[asks], cell[asks]
        who, _, score = solve(own, q, ids[~asks], x[~asks], k, exact)
        worst = {}
        for i, n in zip(*np.unique(who, return_counts=True)):
            if n >= k:
                worst[i] = score[who == i].min()
        norm = (q.astype(np.float64) ** 2).sum(1)
        far = np.array([np.sqrt(max(0.0, n + most - 2.0 * worst[i])) if i in worst else np.inf for i, n in zip(own.tolist(), norm)])
        away = _distances(q, np.zeros(len(q)), at)
        out = [[], [], [], []]
        for c in np.unique(of):
            mine = of == c
            for o, v in zip(out, (np.full(len(at), c), np.arange(len(at)), (away[mine] - far[mine, None]).min(0), (away[mine] + far[mine, None]).max(0))):
                o.append(v)
        kinds = pa.int32(), pa.int32(), pa.float64(), pa.float64()
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds)], names=["cell", "pivot", "low", "high"])

    limits = visitors.unionByName(hosts).groupBy("home", "part").applyInArrow(bounds, "cell int, pivot int, low double, high double")
    low, high = np.full((len(at), len(at)), np.inf), np.full((len(at), len(at)), -np.inf)
    # A row for each pair of pivots at most.
    for r in limits.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"] - slack, r["high"] + slack
    # Groups of cells near each other: from one cell on to the nearest one left.
    chain, left = [], sorted(asked)
    while left:
        chain.append(min(left, key=lambda c: (np.linalg.norm(at[c] - at[chain[-1]]) if chain else 0, c)))
        left.remove(chain[-1])
    units, load, group = [], group_queries, -1
    for c in chain:
        parts = -(-asked[c] // group_queries)
        for part in range(parts):
            if load >= group_queries:
                group, load = group + 1, 0
            units.append((c, group))
            load += asked[c] / parts
    blocks = max(1, -(-total // block_rows))
    group_of: dict[int, list[int]] = {}
    for c, g in units:
        group_of.setdefault(c, []).append(g)
    member = np.zeros((len(at), group + 1), bool)
    for c, gs in group_of.items():
        member[c, gs] = True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, asks, cell = _matrix(batch.column("v"), dim), batch.column("is_query").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            block = np.array([hash(i) % blocks for i in ids.tolist()], np.int32)
            away = near(x)
            reached = np.zeros((len(x), len(at)), bool)
            for c in group_of:
                reached[:, c] = ((away >= low[c]) & (away <= high[c])).all(1)
            row, to = np.nonzero((reached & ~asks[:, None]) @ member)
            parts = [(row, to, block[row], np.zeros(len(row), bool))]
            own = np.flatnonzero(asks)
            g = np.array([group_of[c][i % len(group_of[c])] for c, i in zip(cell[own].tolist(), ids[own].tolist())], np.int64)
            for b in range(blocks):
                parts.append((own, g, np.full(len(own), b), np.ones(len(own), bool)))
            row, to, block, flag = (np.concatenate(p) for p in zip(*parts))
            for i in range(0, len(row), 20_000):
                s = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(to[s].astype(np.int32)), pa.array(block[s].astype(np.int32)), pa.array(flag[s]), batch.column("vec_id").take(pa.array(row[s])), batch.column("v").take(pa.array(row[s]))], names=["group", "block", "is_query", "vec_id", "v"])

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("is_query").to_numpy()
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
        q, v, s = solve(ids[asks], x[asks], ids[~asks], x[~asks], k, exact)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s.tolist(), score_type)})

    dealt = rows.select("vec_id", "v", "is_query", "cell").mapInArrow(deal, "group int, block int, is_query boolean, vec_id bigint, v array<bigint>")
    if dealt_only:
        return dealt
    local = dealt.groupBy("group", "block").applyInArrow(best, f"query_id bigint, vec_id bigint, score {score_kind}")
    return _first(local, k)


def _first(scored: DataFrame, k: int) -> DataFrame:
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").try_cast("bigint").alias("score"))


def _ranked(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """All vectors are empty: every score is 0, and the smallest ids win."""
    few = F.broadcast(rows.select("vec_id").distinct().orderBy("vec_id").limit(k + 1))
    return _first(queries.join(few, F.col("query_id") != F.col("vec_id")).withColumn("score", F.lit(0).cast("bigint")), k)


def op2_knn(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best of every vector whose vec_id is divisible by 50."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
