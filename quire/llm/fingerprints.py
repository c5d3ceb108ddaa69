"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is the bag of its lower-cased words, each weighted by how often it stands there. For each of SAMPLES samples
a word draws r and c from Gamma(2, 1) and b from [0, 1), all from one hash of word and sample; with its weight w it takes
t = floor(ln(w) / r + b) and bids ln(c) - r * (t - b + 1). The least bid wins, and two texts have the same winner
(word and t) with a probability equal to their generalised Jaccard similarity, sum of the smaller weights over
sum of the larger. A fingerprint holds 16 bits of every winning bid, so equal places estimate it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stored

SAMPLES = 64
#: Samples taken from one row: more of them make code that Java compiles late or not at all.
AT_ONCE = 8
#: Characters of a zone of neighbouring documents, and the most zones: their bounds are in the plan.
ZONE_CHARS = 4_000_000
MOST_ZONES = 65_536
_DIGITS = 4
_LAST = 2**63 - 1


def words(text: Column) -> Column:
    """array<string>: the lower-cased words of a text between white space, and empty strings."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _uniform(bits: Column, low: int, width: int) -> Column:
    """The bits as the middle of one of 2^width equal parts of (0, 1)."""
    return (F.shiftrightunsigned(bits, low).bitwiseAND(F.lit(2**width - 1)) + 0.5) * 2.0**-width


def bids(bits: Column, logs: list[Column]) -> list[Column]:
    """The bids of a word in one sample, for each logarithm of a weight; a log of -1e300 bids beyond any other."""
    r = -F.log(_uniform(bits, 0, 13) * _uniform(bits, 13, 13))
    c = F.log(-F.log(_uniform(bits, 26, 13) * _uniform(bits, 39, 13)))
    b = _uniform(bits, 52, 12)
    return [c - r * (F.floor(w / r + b) - b + 1) for w in logs]


def fingerprints(bags: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each column of weights, a fingerprint of the same name: 4 hex digits a sample.

    bags: rows of keys, a word and its weights (numbers; 0 where a text of the group does not hold it), a row a word of a
    group; empty words count as none. A group without words in a text has the empty fingerprint for it. Any distribution
    of the rows by a part of keys is used as it is.
    """
    step = min(samples, AT_ONCE)
    logs = {f"_log{k}": F.when(F.col(w) > 0, F.log(w)).otherwise(-1e300) for k, w in enumerate(weights)}
    rows = bags.withColumns(logs).withColumn("_hash", F.when(F.col("word") != "", F.xxhash64("word")))
    # Without a word there is neither hash nor bid.
    rows = rows.select(*keys, "_hash", *[F.when(F.col("_hash").isNotNull(), F.col(c)).alias(c) for c in logs], F.explode(F.array(*[F.lit(n) for n in range(-(-samples // step))])).alias("_block"))
    won = [F.min(bid).alias(f"_{k}_{i}") for i in range(step) for k, bid in enumerate(bids(F.xxhash64("_hash", F.col("_block") * step + i), [F.col(c) for c in logs]))]
    least = rows.groupBy(*keys, "_block").agg(*won)
    digits = lambda c: F.lpad(F.lower(F.hex(F.xxhash64(c).bitwiseAND(F.lit(16**_DIGITS - 1)))), _DIGITS, "0")
    # A weight of 0 everywhere leaves bids that no word with a weight makes.
    coded = [F.when(F.col(f"_{k}_0") < 1e15, F.concat(*[digits(F.col(f"_{k}_{i}")) for i in range(step)])).otherwise("").alias(w) for k, w in enumerate(weights)]
    blocks = least.select(*keys, "_block", *coded)
    whole = lambda w: F.left(F.concat(*[F.coalesce(F.max(F.when(F.col("_block") == n, F.col(w))), F.lit("")) for n in range(-(-samples // step))]), F.lit(_DIGITS * samples)).alias(w)
    return blocks.groupBy(*keys).agg(*[whole(w) for w in weights])


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints of one length agree: estimates the generalised Jaccard similarity. 1 of two empty ones, 0 of one."""
    part = lambda x, i: F.substring(x, i * _DIGITS + 1, F.lit(_DIGITS))
    places = (F.length(a) / _DIGITS).cast("int")
    same = F.size(F.filter(F.sequence(F.lit(0), places - 1), lambda i: part(a, i) == part(b, i)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / places)


def _zones(docs: DataFrame) -> DataFrame:
    """The rows of (doc_id, text), texts not null, with a zone: neighbours in falling order of doc_id share one, and the first row of each stands as `ghost` behind the zone before it, too."""
    order = lambda df: df.withColumns({"id": F.coalesce(F.bitwise_not(F.col("doc_id").cast("bigint")), F.lit(_LAST)), "key": F.xxhash64("text")})
    rows = order(docs)
    places = stored(rows.select("id", "key", F.length("text").alias("chars")), "places")
    zones = min(MOST_ZONES, max(1, -(-(places.agg(F.sum("chars")).first()[0] or 0) // ZONE_CHARS)))
    firsts = places.repartitionByRange(zones, "id", "key").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "key")).alias("f")).collect()
    bounds = sorted(tuple(r["f"]) for r in firsts)
    if not bounds:
        return rows.withColumns({"zone": F.lit(0), "ghost": F.lit(0)})
    listed = lambda at: F.split(F.lit(",".join(str(b[at]) for b in bounds)), ",").cast("array<bigint>")
    ids, keys = listed(0), listed(1)
    reached = lambda m: (F.get(ids, m) < F.col("id")) | ((F.get(ids, m) == F.col("id")) & (F.get(keys, m) <= F.col("key")))
    steps = F.array(*[F.lit(2**k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    zone = F.aggregate(steps, F.lit(0), lambda low, s: F.when(low + s < len(bounds), F.when(reached(low + s), low + s).otherwise(low)).otherwise(low))
    rows = rows.withColumn("zone", zone)
    first = (F.get(ids, F.col("zone")) == F.col("id")) & (F.get(keys, F.col("zone")) == F.col("key"))
    here = lambda z, ghost: F.struct(z.alias("zone"), F.lit(ghost).alias("ghost"))
    ahead = F.pmod(F.col("zone") - 1, F.lit(len(bounds)))
    both = F.when(first, F.array(here(F.col("zone"), 0), here(ahead, 1))).otherwise(F.array(here(F.col("zone"), 0)))
    return rows.withColumn("at", F.explode(both)).drop("zone").select("*", "at.zone", "at.ghost").drop("at")


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of (doc_id, text).

    The next row is that of the next smaller doc_id, after the last the first; rows of one doc_id go by a hash of their
    text, null doc_ids last. The edited text has its last half replaced by as many characters from the start of the
    next row's. Null texts count as empty; empty ones have an empty fingerprint, like each other and nothing else;
    repeated rows keep a row each; an only row is its own next; an empty table gives no rows.
    """
    rows = _zones(pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    # Both uses below need the same columns, so the texts are shuffled once.
    none = F.col("doc_id").isNull()
    rows = rows.select("zone", "ghost", "id", "key", F.xxhash64(F.lit(1), "text").alias("key2"), none.alias("none"), "text")
    by_order = Window.partitionBy("zone").orderBy("ghost", "id", "key", "key2", "none")
    rows = rows.withColumns({"rn": F.row_number().over(by_order), "next": F.lead("text").over(by_order)})
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, F.concat(F.left("text", F.length("text") - half), F.left("next", half))).otherwise(""))
    texts = rows.select("zone", "rn", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    each = texts.select("zone", "rn", "x.v", F.explode(words(F.col("x.t"))).alias("word"))
    bags = each.groupBy("zone", "rn", "word").agg(F.sum(1 - F.col("v")).alias("fingerprint"), F.sum("v").alias("edited_fingerprint"))
    prints = fingerprints(bags, ["zone", "rn"], ["fingerprint", "edited_fingerprint"])
    known = rows.select("zone", "rn", "ghost", F.when(~F.col("none"), F.bitwise_not("id")).alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    out = known.join(prints, ["zone", "rn"]).withColumn("after", F.lead("fingerprint").over(Window.partitionBy("zone").orderBy("rn"))).where("ghost = 0")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("after").alias("near_next"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
