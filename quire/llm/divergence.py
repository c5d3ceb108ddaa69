"""Divergence of sources by exact term shares, over a minimal acyclic transducer as vocabulary.

The terms that enough documents of their language use are sorted; each stretch of SHARD_TERMS of them becomes a
minimal acyclic transducer, whose edges carry numbers that add up to a term's place in the order, its ordinal. The
texts are read again: each task sends the terms of its documents, once each with their number, to the
transducers of their stretch, which stream them and give ordinals to those kept. From then on all is
counted, compared and ranked by ordinals; a tie goes to the smaller one, and the reported ones are spelled by the transducers.
Shares are compared in blocks of ordinals with at most TILE sources on a side, so no task holds a whole vocabulary or language.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, spread_join, stored

LEAST_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
SHARD_TERMS = 200_000
#: Ordinals of a block and sources of a tile.
BLOCK = 4096
TILE = 512
#: Distinct terms a task holds before it sends them on.
HELD = 400_000
#: Rows of a group that are summed before they leave their transducer.
SUMMED = 16
_SPACES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters A-Z, lower-cased, and of characters beyond ASCII, as UTF-8; none of null."""
    return text.encode().lower().translate(_SPACES).split() if text else []


def _prefix(lang: str) -> bytes:
    """Goes before a language's terms: in order of the language's UTF-8 bytes, and no term has a space."""
    return lang.encode().hex().encode() + b" "


# The transducer.


class Transducer:
    """A minimal acyclic transducer: edges in order of (state, byte), each with its target and what it adds to the ordinal."""

    def __init__(self, root: int, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, final: np.ndarray):
        self.root, self.keys, self.targets, self.adds, self.final = root, keys, targets, adds, final

    @classmethod
    def build(cls, words: Iterable[bytes]) -> Transducer:
        """Of sorted distinct words: states that no later word can reach are frozen, equal ones once."""
        known: dict[tuple, int] = {}
        ends: list[int] = []
        path: list[list] = [[False, []]]
        last = b""

        def freeze() -> int:
            final, edges = path.pop()
            mark = (final, tuple(edges))
            if mark not in known:
                known[mark] = len(ends)
                ends.append(final + sum(ends[t] for _, t in edges))
            return known[mark]

        def cut(depth: int) -> None:
            while len(path) > depth + 1:
                state = freeze()
                path[-1][1].append((last[len(path) - 1], state))

        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            cut(shared)
            path += [[False, []] for _ in word[shared:]]
            path[-1][0] = True
            last = word
        cut(0)
        root = freeze()
        keys, targets, adds = [], [], []
        for (final, edges), state in known.items():
            before = int(final)
            for byte, target in edges:
                keys.append(state << 8 | byte)
                targets.append(target)
                adds.append(before)
                before += ends[target]
        # States are numbered as they are frozen, so the keys are sorted as they come.
        return cls(root, np.array(keys, np.int64), np.array(targets, np.int64), np.array(adds, np.int64), np.array([final for final, _ in known], bool))

    def save(self) -> dict[str, object]:
        return {"root": self.root, "keys": self.keys.tobytes(), "targets": self.targets.tobytes(), "adds": self.adds.tobytes(), "final": self.final.tobytes()}

    @classmethod
    def load(cls, row: dict[str, object]) -> Transducer:
        return cls(row["root"], *[np.frombuffer(row[k], np.int64) for k in ("keys", "targets", "adds")], np.frombuffer(row["final"], bool))

    def after(self, prefix: bytes) -> tuple[int, int] | None:
        """The state behind a prefix and what its edges add up to; None where no word begins with it."""
        state, total = self.root, 0
        for byte in prefix:
            key = state << 8 | byte
            edge = int(np.searchsorted(self.keys, key))
            if edge == len(self.keys) or self.keys[edge] != key:
                return None
            state, total = int(self.targets[edge]), total + int(self.adds[edge])
        return state, total

    def ordinals(self, joined: bytes, n: int, prefix: bytes = b"") -> np.ndarray:
        """The places of n words, joined by line breaks and each behind the prefix, among the transducer's; -1 of others. All words go on a byte at a time."""
        if (begins := self.after(prefix)) is None:
            return np.full(n, -1, np.int64)
        text = np.frombuffer(joined + b"\n", np.uint8)
        ends = np.flatnonzero(text == 10)
        at = np.concatenate(([0], ends[:-1] + 1))
        out, state, live = np.full(n, -1, np.int64), np.full(n, begins[0]), np.arange(n)
        sums = np.full(n, begins[1])
        while len(live):
            over = at[live] == ends[live]
            done = live[over]
            out[done] = np.where(self.final[state[done]], sums[done], -1)
            live = live[~over]
            if not len(self.keys):
                break
            key = state[live] << 8 | text[at[live]]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[edge] == key
            live, edge = live[on], edge[on]
            state[live] = self.targets[edge]
            sums[live] += self.adds[edge]
            at[live] += 1
        return out

    def spell(self, ordinal: int) -> bytes:
        """The word at a place."""
        state, out = self.root, bytearray()
        while ordinal or not self.final[state]:
            low, high = np.searchsorted(self.keys, [state << 8, (state + 1) << 8])
            edge = low + int(np.searchsorted(self.adds[low:high], ordinal, "right")) - 1
            out.append(int(self.keys[edge]) & 255)
            ordinal -= int(self.adds[edge])
            state = int(self.targets[edge])
        return bytes(out)


# Vocabulary and counts.


def _clean(docs: DataFrame) -> DataFrame:
    return pick(docs, "lang", "source", "text").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, key (language and term as bytes, in order) of the terms in at least so many documents of their language, stored."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                head = _prefix(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([head + w for w in n], pa.binary()), pa.array(list(n.values()), pa.int64())], names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held.setdefault(lang, Counter()).update(set(terms(text.as_py())))
                if sum(map(len, held.values())) > HELD:
                    yield from send()
        yield from send()

    found = _clean(docs).select("lang", "text").mapInArrow(counted, "lang string, key binary, n bigint")
    return stored(found.groupBy("lang", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "key"), "kept")


_SHARD = "first binary, terms bigint, root bigint, keys binary, targets binary, adds binary, final binary"


def vocabulary(kept: DataFrame) -> DataFrame:
    """The kept terms in order, as one transducer for each stretch of at most SHARD_TERMS, stored: first, terms and the transducer."""
    parts = -(-kept.count() // SHARD_TERMS) or 1

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(words: list[bytes]) -> pa.RecordBatch:
            row = {"first": words[0], "terms": len(words)} | Transducer.build(words).save()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, pa.int64() if n in ("terms", "root") else pa.binary()) for n in row]))

        words: list[bytes] = []
        for batch in batches:
            words += batch.column("key").to_pylist()
            while len(words) >= SHARD_TERMS:
                yield shard(words[:SHARD_TERMS])
                words = words[SHARD_TERMS:]
        if words:
            yield shard(words)

    return stored(kept.select("key").repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(built, _SHARD), "transducers")


class Places:
    """The first term and first ordinal of every shard: one entry for each SHARD_TERMS terms."""

    def __init__(self, shards: DataFrame):
        rows = sorted(shards.select("first", "terms").collect(), key=lambda r: bytes(r["first"]))
        self.firsts = [bytes(r["first"]) for r in rows]
        self.bases = np.concatenate(([0], np.cumsum([r["terms"] for r in rows], dtype=np.int64)))

    def numbered(self, shards: DataFrame, copies: int) -> DataFrame:
        """The shards with their number and first ordinal, once for each of `copies` parts."""
        firsts, bases = self.firsts, self.bases

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [bisect.bisect_left(firsts, f) for f in batch.column("first").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(bases[at] if at else [], pa.int64())], names=[*batch.schema.names, "shard", "base"])

        return shards.mapInArrow(number, f"{_SHARD}, shard int, base bigint").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def _through(shards: DataFrame, places: Places, rows: DataFrame, copies: int, run, out: str) -> DataFrame:
    """Rows with a shard and part stream through the transducer of their shard: run(transducer, base, batch) gives record batches of `out`.

    The transducer comes first in its part and is the only one held.
    """
    asks = [f.name for f in rows.schema.fields if f.name not in ("shard", "part")]
    machine = places.numbered(shards, copies).withColumn("ask", F.lit(0))
    both = machine.unionByName(rows.withColumn("ask", F.lit(1)), allowMissingColumns=True)
    names = [*[f.name for f in shards.schema.fields], "base"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            ask = np.asarray(batch.column("ask"))
            cuts = [*np.flatnonzero(ask == 0).tolist(), len(ask)]
            for low, high in zip([-1, *cuts[:-1]], cuts):
                if low >= 0:
                    row = {n: batch.column(n)[low].as_py() for n in names}
                    now = Transducer.load(row), row["base"]
                if high - low > 1:
                    yield from run(*now, batch.slice(low + 1, high - low - 1).select(asks))

    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "ask").mapInArrow(stream, out)


def _summed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in order, each with its sum of n."""
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    firsts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
    return at[firsts], np.add.reduceat(n, firsts) if len(at) else n


def recount(docs: DataFrame, shards: DataFrame, places: Places) -> DataFrame:
    """lang, source, ordinal, n: how often each kept term stands in the documents of a group, as the transducers tell, stored; ordinal -1 with 0 of every group."""
    firsts = places.firsts

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Counter] = {}
        sending = TaskContext.get().partitionId() << 32

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal sending
            sending += 1
            for (lang, source), n in held.items():
                head = _prefix(lang)
                words = sorted(n)
                # A stretch begins before, among or behind the language's terms.
                cuts = [0, *[bisect.bisect_left(words, f[len(head) :]) if f.startswith(head) else 0 if f < head else len(words) for f in firsts[1:]], len(words)]
                found = [(k, low, high) for k, (low, high) in enumerate(zip(cuts, cuts[1:])) if low < high and firsts]
                numbers = np.fromiter(map(n.__getitem__, words), np.int64, len(words))
                if not len(words) or numbers.max() < 2**31:
                    numbers = numbers.astype(np.int32)
                rows = [(shard, b"\n".join(words[low:high]), numbers[low:high].tobytes(), high - low) for shard, low, high in found] + [(0, b"", b"", 0)]
                shard, text, numbers, sizes = zip(*rows)
                same = [pa.array([x] * len(rows), t) for x, t in ((sending, pa.int64()), (lang, pa.string()), (source, pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *same, pa.array(text, pa.binary()), pa.array(numbers, pa.binary()), pa.array(sizes, pa.int32())], names=["shard", "sending", "lang", "source", "words", "numbers", "size"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                held.setdefault((lang, source), Counter()).update(terms(text.as_py()))
                if sum(map(len, held.values())) > HELD:
                    yield from send()
        yield from send()

    rows = stored(_clean(docs).mapInArrow(sent, "shard int, sending bigint, lang string, source string, words binary, numbers binary, size int"), "words")
    groups = rows.where("size = 0").select("lang", "source", F.lit(-1).cast("bigint").alias("ordinal"), F.lit(0).cast("bigint").alias("n")).distinct()
    n_rows, sendings = rows.agg(F.count(F.lit(1)), F.count_distinct("sending")).first()
    copies = max(1, -(-n_rows // (64 * max(1, len(firsts)))))

    def count(machine: Transducer, base: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of_group: dict[tuple[str, str], list[tuple]] = {}
        for lang, source, *row in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "words", "numbers", "size")]):
            of_group.setdefault((lang, source), []).append(row)
        for (lang, source), asked in of_group.items():
            n = np.concatenate([np.frombuffer(numbers, np.int32 if len(numbers) == 4 * size else np.int64).astype(np.int64) for _, numbers, size in asked])
            at = machine.ordinals(b"\n".join(words for words, *_ in asked), len(n), _prefix(lang))
            at, n = _summed(at[at >= 0] + base, n[at >= 0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(at), pa.array(n)], names=["lang", "source", "ordinal", "n"])

    # A group has one row of a sending and shard at most: about SUMMED of them meet in a part and are summed there, and a large group has many parts.
    meet = F.pmod(F.xxhash64("sending"), F.lit(max(1, -(-sendings // SUMMED))))
    asked = rows.where("size > 0").withColumn("part", F.pmod(F.xxhash64("lang", "source", meet), F.lit(copies)).cast("int")).drop("sending")
    found = _through(shards, places, asked, copies, count, "lang string, source string, ordinal bigint, n bigint")
    return stored(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")).unionByName(groups), "counts")


# Comparison.


def _shares(n: np.ndarray, total: int, kept: int, unit: int) -> np.ndarray:
    """1 + floor(unit * (n + 1) / (total + kept)), exact."""
    if len(n) and (int(n.max()) + 1) * unit >= 2**63:
        return np.array([1 + unit * (int(x) + 1) // (total + kept) for x in n], np.int64)
    return 1 + unit * (n + 1) // (total + kept)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Block:
    """Shares of the sources of two tiles over a block of ordinals of one language."""

    def __init__(self, key: tuple, unit: int, top: int):
        self.key, self.unit, self.top = key, unit, top
        self.sources: tuple[dict, dict] = ({}, {})
        self.known, self.lang, self.rows = 0, [], ([], [])

    def add(self, kind: np.ndarray, side: np.ndarray, source: list, ordinal: np.ndarray, n: np.ndarray, kept: np.ndarray) -> None:
        for k in np.flatnonzero(kind == 0).tolist():
            of_side = self.sources[side[k]]
            of_side[source[k]] = len(of_side), int(n[k])
            self.known = int(kept[k])
        if (whole := kind == 1).any():
            self.lang.append((ordinal[whole], n[whole], kept[whole]))
        for s in (0, 1):
            if (mine := np.flatnonzero((kind == 2) & (side == s))).size:
                at = np.fromiter((self.sources[s][source[k]][0] for k in mine.tolist()), np.int64, len(mine))
                self.rows[s].append((at, ordinal[mine], n[mine]))

    def matrix(self, s: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and shares by source and place."""
        counts = np.zeros((len(self.sources[s]), len(at)), np.int64)
        for i, ordinal, n in self.rows[s]:
            counts[i, np.searchsorted(at, ordinal)] = n
        shares = np.empty_like(counts)
        for i, total in self.sources[s].values():
            shares[i] = _shares(counts[i], total, self.known, self.unit)
        return counts, shares

    def results(self) -> Iterator[tuple]:
        """(source, other, None, value) of every pair; (source, None, ordinal, value) of the block's highest terms of a source."""
        _, _, mine, theirs = self.key
        at, n, total = (np.concatenate(x) for x in zip(*self.lang)) if self.lang else (np.empty(0, np.int64),) * 3
        order = np.argsort(at)
        at, n = at[order], n[order]
        counts, shares = self.matrix(0, at)
        other = 0 if mine == theirs else 1
        q = shares if mine == theirs else self.matrix(1, at)[1]
        for a, (i, _) in self.sources[0].items():
            sums = _distance(shares[i], q).sum(axis=1)
            for b, (j, _) in self.sources[other].items():
                if a != b:
                    yield a, b, None, int(sums[j])
        if mine == theirs and len(at):
            whole = _shares(n, int(total[0]), self.known, self.unit)
            for a, (i, _) in self.sources[0].items():
                over = np.flatnonzero((counts[i] > 0) & (shares[i] > whole))
                f = _distance(shares[i, over], whole[over])
                for k in np.lexsort((over, -f))[: self.top].tolist():
                    yield a, None, int(at[over[k]]), int(f[k])


def _blocks(batches: Iterator[pa.RecordBatch], unit: int, top: int) -> Iterator[pa.RecordBatch]:
    now: _Block | None = None

    def send(block: _Block | None) -> Iterator[pa.RecordBatch]:
        if block and (rows := list(block.results())):
            a, b, ordinal, value = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([block.key[0]] * len(rows), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(ordinal, pa.int64()), pa.array(value, pa.int64())], names=["lang", "source", "other", "ordinal", "value"])

    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("lang", "block", "mine", "theirs")]))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else [0]
        for low, high in zip(cuts, cuts[1:]):
            if now is None or keys[low] != now.key:
                yield from send(now)
                now = _Block(keys[low], unit, top)
            part = batch.slice(low, high - low)
            now.add(*[part.column(c).to_pylist() if c == "source" else np.asarray(part.column(c)) for c in ("kind", "side", "source", "ordinal", "n", "kept")])
    yield from send(now)


def compared(counts: DataFrame, kept: DataFrame, unit: int = UNIT, top: int = TOP) -> DataFrame:
    """lang, source, other, ordinal, value: parts of each pair's sum (ordinal null) and candidates for the highest terms (other null).

    A row (kind 0) tells each block of a language its sources, so absent terms count as 0; one (kind 1) each kept term and its number in the language.
    """
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = stored(counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if(F.col("ordinal") >= 0).alias("rows")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("rows").alias("rows"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).join(sizes, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("bigint"))
    terms_ = counts.where("ordinal >= 0").withColumn("block", F.expr(f"ordinal div {BLOCK}"))
    whole = stored(terms_.groupBy("lang", "block", "ordinal").agg(F.sum("n").alias("n")), "language_counts")
    none = F.lit(None)
    # Every language has a block without terms, which tells its pairs.
    blocks = whole.select("lang", "block").distinct().unionByName(langs.select("lang", F.lit(-1).cast("bigint").alias("block")))
    head = blocks.join(groups.drop("rows").join(langs.select("lang", "tiles", "kept"), "lang"), "lang").select("lang", "block", "tiles", F.lit(0).alias("kind"), "source", none.cast("bigint").alias("ordinal"), "n", "kept")
    body = spread_join(terms_, langs.select("lang", "tiles", "rows"), ["lang"], "rows", "ordinal").select("lang", "block", "tiles", F.lit(2).alias("kind"), "source", "ordinal", "n", F.lit(0).cast("bigint").alias("kept"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    left = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(tile.alias("mine"), x.alias("theirs"), F.lit(0).alias("side")))
    right = F.filter(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(x.alias("mine"), tile.alias("theirs"), F.lit(1).alias("side"))), lambda s: s["mine"] != s["theirs"])
    dealt = head.unionByName(body).withColumn("at", F.explode(F.concat(left, right)))
    lang_rows = spread_join(whole, langs.select("lang", "tiles", "total", "kept"), ["lang"], "kept", "ordinal").select("lang", "block", "tiles", F.lit(1).alias("kind"), none.cast("string").alias("source"), "ordinal", "n", F.col("total").alias("kept"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda y: F.struct(x.alias("mine"), y.alias("theirs"), F.lit(0).alias("side")))))
    rows = dealt.unionByName(lang_rows.withColumn("at", F.explode(every))).select("lang", "block", "at.mine", "at.theirs", "at.side", "kind", "source", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "n", "kept")
    keys = ["lang", "block", "mine", "theirs"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(lambda b: _blocks(b, unit, top), "lang string, source string, other string, ordinal bigint, value bigint")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, unit: int = UNIT, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of the groups (lang, source) of documents (lang, source, text).

    part `pair`: every other source of the language by the sum of (p - q)^2 / q over the language's kept terms; part
    `term`: the `top` kept terms that the group uses more than its language does. Nulls count as ''; repeated rows count each; a
    language without kept terms has pairs of value 0; an empty table gives no rows. Ties go to the smaller
    item in order of UTF-8.
    """
    kept = kept_terms(docs, least_docs)
    shards = vocabulary(kept)
    places = Places(shards)
    counts = recount(docs, shards, places)
    found = stored(compared(counts, kept, unit, top), "compared")
    pairs = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(by_item).alias("rank"))
    by_place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = found.where("ordinal is not null").withColumn("rank", F.row_number().over(by_place)).where(F.col("rank") <= top)
    bases = places.bases

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bases, np.asarray(batch.column("ordinal")), "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(np.zeros(len(at)), pa.int32())], names=[*batch.schema.names, "shard", "part"])

    def spell(machine: Transducer, base: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = [machine.spell(o - base).split(b" ", 1)[1] for o in batch.column("ordinal").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("lang", "source", "value", "rank")], pa.array(words, pa.binary()).cast(pa.string())], names=["lang", "source", "value", "rank", "item"])

    asked = best.select("lang", "source", "value", "rank", "ordinal").mapInArrow(placed, "lang string, source string, value bigint, rank int, ordinal bigint, shard int, part int")
    spelled = _through(shards, places, asked, 1, spell, "lang string, source string, value bigint, rank int, item string")
    return pairs.unionByName(spelled.withColumn("part", F.lit("term")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("lang", "source", "part", "item", "value", "rank")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
filled AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
of_group AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM filled JOIN sizes USING (lang)),
of_lang AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM filled GROUP BY lang, term) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM of_group a JOIN of_group b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM of_group JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
