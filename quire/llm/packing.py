"""Best-fit packing after Martello-Toth dominance reduction, over the histogram of lengths.

Items of one length are interchangeable, so the whole packing problem is a table of at most
`size` counts, however many documents there are. That table goes to the driver, is reduced and
packed in bulk (a run of equal bins is one row of the plan), and the plan, whose rows the
lengths alone bound, goes back as slots: rank r among the items of a length has a fixed bin and
offset. Ranks come from per-shard row numbers and a table of counts by length and shard.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_json, token_pieces

SIZE = 2048


def _fixed(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Martello-Toth reduction: (number of bins, contents), taken out of counts for good.

    For the largest length j left: alone, if nothing fits beside it; with the largest k that fits,
    if the two fill the bin or no two items fit beside j; with the largest a and then b, if no three
    fit beside j and every pair that fits is no larger, item by item, or goes into the place of a.
    Each such set dominates every other feasible set that holds j.
    """
    out: list[tuple[int, list[tuple[int, int]]]] = []
    live = sorted(counts)

    def take(n: int, *lengths: int) -> None:
        kinds = sorted(set(lengths), reverse=True)
        out.append((n, [(x, lengths.count(x)) for x in kinds]))
        for x in lengths:
            counts[x] -= n
        for x in kinds:
            if not counts[x]:
                live.pop(bisect.bisect_left(live, x))

    def fits(room: int, used: tuple[int, ...] = ()) -> int:
        """The largest length of at most room of which an item is left beside those used; 0 if none."""
        i = bisect.bisect_right(live, room) - 1
        while i >= 0 and counts[live[i]] <= used.count(live[i]):
            i -= 1
        return live[i] if i >= 0 else 0

    def smallest(n: int, but: int) -> int:
        """The sum of the n smallest items, leaving one of length but aside; over size if there are fewer."""
        total = 0
        for x in live:
            have = counts[x] - (x == but)
            use = min(n, have)
            total, n = total + use * x, n - use
            if not n:
                return total
        return size + 1

    todo = list(reversed(live))
    for j in todo:
        while counts[j]:
            k = fits(size - j, (j,))
            if not k:
                take(counts[j], j)
                continue
            if j + k == size or j + smallest(2, j) > size:
                take(counts[j] // 2 if k == j else min(counts[j], counts[k]), j, k)
                continue
            if j + smallest(3, j) > size and (b := fits(size - j - k, (j, k))):
                larger = live[bisect.bisect_right(live, b) : bisect.bisect_right(live, k)]
                pairs = [(x, y) for x in larger if (y := fits(min(x, size - j - x), (j, x))) > b]
                if all(x + y <= k for x, y in pairs):
                    use = [j, k, b]
                    take(min(counts[x] // use.count(x) for x in set(use)), *use)
                    continue
            break
    return out


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for all items: (number of equal bins, [(length, items of it in each)]), largest first.

    Dominance reduction first; then best-fit decreasing over what is left, many equal bins at a time.
    """
    counts = {k: n for k, n in histogram.items() if n}
    out = _fixed(counts, size)
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, holds: list[tuple[int, int]]) -> None:
        if n and room not in groups:
            bisect.insort(rooms, room)
        if n:
            groups.setdefault(room, []).append((n, holds))

    for x in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[x]
        while left:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                each = size // x
                put(size - each * x, left // each, [(x, each)])
                put(size - left % each * x, int(left % each > 0), [(x, left % each)])
                break
            room = rooms[i]
            n, holds = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            each = room // x
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each if left - full * each < each else 0
            put(room - each * x, full, [*holds, (x, each)])
            put(room - rest * x, int(rest > 0), [*holds, (x, rest)])
            put(room, n - full - (rest > 0), holds)
            left -= full * each + rest
    return out + [g for room in rooms for g in groups[room]]


def pack(pieces: DataFrame, size: int = SIZE, shards: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to size ids: (doc_id, piece, length, ...).

    Every piece gets a place, repeated rows places of their own; sequences are gapless from offset 0 and hold size
    ids at most. Counts by length and shard are joined by key, and shards grow with the pieces. The driver gets one count
    for each length, size at most; the plan it sends back has at most 64 lengths for each of its groups, which are a
    small multiple of the distinct lengths.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    # Numbers of rows are written with them and so stay: repeated rows go to shards of their own.
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    shards = shards or max(16, pieces.count() // 50_000)
    place = Window.partitionBy("length", "shard").orderBy("_row")
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))
    sums = sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    sums = stored(sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")), "counts")
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence, given = [], 0, dict.fromkeys(histogram, 0)
    for n, holds in plan(histogram, size):
        offset = 0
        for length, each in holds:
            slots.append((length, given[length], given[length] + n * each, each, sequence, offset))
            given[length] += n * each
            offset += length * each
        sequence += n
    table = spark.createDataFrame(slots, "length bigint, low bigint, high bigint, each bigint, first bigint, at bigint")
    ranked = sharded.withColumn("rank", F.row_number().over(place) - 1).join(sums.drop("n"), ["length", "shard"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # Slots by length as arrays, so a piece finds its own by position and not by trying each.
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "each", "first", "at"))).alias("slots"))
    slot = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    joined = ranked.join(F.broadcast(by_length), "length").withColumn("slot", slot)
    nth = F.col("rank") - F.col("slot.low")
    return joined.select(*columns, (F.col("slot.first") + F.floor(nth / F.col("slot.each"))).cast("bigint").alias("sequence_id"), (F.col("slot.at") + nth % F.col("slot.each") * F.col("length")).cast("bigint").alias("offset"))


def op5_pack(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset, ids as the tokenizer file gives them by default; null and empty texts are one piece, repeated rows have pieces of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, json_path=default_json())


def pack_documents(docs: DataFrame, size: int = SIZE, json_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of the documents' token pieces."""
    pieces = token_pieces(docs, size, json_path=json_path)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), size)
