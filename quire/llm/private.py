"""Personal data by base patterns and by bootstrapped contexts, in DataFrame functions alone.

Base: four kinds by regular expressions and tests. Contexts: every base span is a seed; the words beside
it are lexical patterns of its kind. Other identifier-shaped tokens are candidates with patterns of their
own. Patterns and values form a graph, scored in rounds: a pattern is trusted as far as the values it stands beside
are, and a value as far as its patterns are. Candidates beside patterns that enough distinct
seeds support and whose trust is high become spans of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.spans import let, running

from .common import pick, stored

# The kinds in the order in which their spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Stands for a separator that single characters on both sides hold together; replaced 1:1, so offsets stay.
_JOIN = "\x01"
_LOCAL = r"A-Za-z0-9._%+\-"
# No group is repeated here: such loops recurse in Java and would overflow on long runs. Each expression
# starts at the start of a run or where the last match ended, so long runs are read once.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}{_JOIN}]))[{_LOCAL}{_JOIN}]++@[A-Za-z0-9\-]++{_JOIN}[A-Za-z0-9\-{_JOIN}]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9{_JOIN}]++"
_PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"
CONTEXT_CHARS = 64
#: Characters of a piece of a long text, at least.
SEGMENT = 16_384


def _held(text: Column, between: str, left: str, right: str) -> Column:
    """The text with `between` characters that stand between left and right ones replaced by the join mark."""
    return F.regexp_replace(F.translate(text, _JOIN, "\x02"), f"(?<={left}){between}(?={right})", _JOIN)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(value)
        return F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _tester(kind: str):
    return lambda s: _passes(kind, s["value"])


def _spans(found: Column, gaps: Column) -> Column:
    """Start, stop and value of the matches of a text, from them and the gaps between them."""
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def placed(ps: Column) -> Column:
        at = lambda p, before: (before + F.length(p["g"])).cast("bigint")
        made = lambda p, before: F.struct(at(p, before).alias("start"), (at(p, before) + F.length(p["m"])).alias("stop"), p["m"].alias("value"))
        return F.zip_with(ps, running(F.transform(ps, lambda p: F.length(p["g"]) + F.length(p["m"]))), made)

    return F.when(F.size(found) > 0, let(pairs, placed)).otherwise(F.array().cast(_SPAN))


def segments(text: Column) -> Column:
    """array<struct<at:int,text:string>>: the text in pieces of about SEGMENT characters.

    A piece ends at white space in which no base pattern and no token can stand: a space after a character that numbers don't have, a
    line break or a tab. A text without such places is one piece.
    """
    cut = rf"(?s).{{{SEGMENT}}}.*?(?:[^\x20().0-9\-]\x20|[\t\n\r\f])|.+"
    pieces = let(F.regexp_extract_all(text, F.lit(cut), F.lit(0)), lambda ps: F.zip_with(ps, running(F.transform(ps, lambda x: F.length(x))), lambda x, at: F.struct(at.alias("at"), x.alias("text"))))
    return F.when(F.length(text) > SEGMENT, pieces).otherwise(F.array(F.struct(F.lit(0).alias("at"), text.alias("text"))))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (kind, start, stop) and tokens (kind, start, stop, value, patterns) of every row of (doc_id, text).

    spans: the base matches; tokens: those and the other identifier-shaped tokens, with the patterns beside
    them and kind null for the others. Texts are read once and not kept. Longer texts than SEGMENT go in pieces,
    each with the characters beside it, so the work grows with the length and not with its square.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    nothing = F.lit("")
    whole = _found(rows.where(F.length("text") <= SEGMENT).select("doc_id", "text_key", F.lit(0).alias("at"), "text", nothing.alias("ahead"), nothing.alias("behind"))).drop("at")
    long = rows.where(F.length("text") > SEGMENT)
    cut = long.dropDuplicates(["doc_id", "text_key"]).withColumn("parts", segments(F.col("text"))).select("doc_id", "text_key", "parts", F.posexplode("parts").alias("i", "p"))
    side = lambda k: F.coalesce(F.get("parts", F.col("i") + k)["text"], nothing)
    parts = _found(cut.select("doc_id", "text_key", "p.at", "p.text", F.right(side(-1), F.lit(CONTEXT_CHARS)).alias("ahead"), F.left(side(1), F.lit(CONTEXT_CHARS)).alias("behind")))
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]))
    # A group is one document, in pieces; its row comes back for each repeated row.
    joined = parts.groupBy("doc_id", "text_key").agg(ordered("spans").alias("spans"), ordered("tokens").alias("tokens")).withColumnsRenamed({"doc_id": "long_id", "text_key": "long_key"})
    back = long.select("doc_id", "text_key").join(joined, F.col("doc_id").eqNullSafe(F.col("long_id")) & (F.col("text_key") == F.col("long_key"))).drop("long_id", "long_key")
    return whole.unionByName(back)


def _found(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, at, spans and tokens of pieces (doc_id, text_key, at, text, ahead, behind), placed in the whole text."""
    has_at, has_digit = F.col("text").contains("@"), F.col("text").rlike("[0-9]")
    # Each expression runs only on texts that can match it; the others get an empty text.
    only = lambda test, x: F.when(test, x).otherwise(F.lit(""))
    rows = rows.withColumns({
        "at_email": only(has_at, _held(F.col("text"), r"\.", r"[A-Za-z0-9\-]", r"[A-Za-z0-9\-]")),
        "at_ip": only(has_digit & F.col("text").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.col("text")),
        "at_card": only(F.col("text").rlike(r"(?:[0-9][ \-]?){15}[0-9]"), _held(F.col("text"), r"[ \-]", "[0-9]", "[0-9]")),
        "at_phone": only(F.col("text").rlike(r"\+[0-9]"), F.col("text")),
        "at_token": only(has_at | has_digit, F.col("text")),
    })
    patterns = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "token": _TOKEN}
    rows = rows.withColumns({f"m_{k}": F.regexp_extract_all(f"at_{k}", F.lit(p), F.lit(0)) for k, p in patterns.items()} | {f"g_{k}": F.split(f"at_{k}", p, -1) for k, p in patterns.items()})
    rows = rows.select("doc_id", "text", "text_key", "at", "ahead", "behind", *[F.filter(_spans(F.col(f"m_{k}"), F.col(f"g_{k}")), _tester(k)).alias(k) for k in patterns])
    named = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
    rows = rows.withColumn("spans", F.concat(*[named(k) for k in KINDS]))
    trimmed = F.transform("token", lambda s: F.struct((s["start"] + F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[\"'(<\[]+", ""))).alias("start"), (s["stop"] - F.length(s["value"]) + F.length(F.regexp_replace(s["value"], r"[\"')>\].,;:!?]+$", ""))).alias("stop")))
    others = F.filter(trimmed, lambda t: (t["start"] < t["stop"]) & ~F.exists("spans", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    others = F.transform(others, lambda t: F.struct(F.lit(None).cast("int").alias("kind"), t["start"].alias("start"), t["stop"].alias("stop"), F.substring(F.col("text"), (t["start"] + 1).cast("int"), (t["stop"] - t["start"]).cast("int")).alias("value")))
    others = F.filter(others, lambda t: t["value"].contains("@") | (F.length(_digits(t["value"])) >= 5))
    rows = rows.withColumn("found", F.concat("spans", others))

    def beside(s: Column) -> Column:
        left = F.lower(F.right(F.concat("ahead", F.substring(F.col("text"), F.greatest(F.lit(1), s["start"] + 1 - CONTEXT_CHARS).cast("int"), F.least(s["start"], F.lit(CONTEXT_CHARS)).cast("int"))), F.lit(CONTEXT_CHARS)))
        right = F.lower(F.left(F.concat(F.substring(F.col("text"), (s["stop"] + 1).cast("int"), F.lit(CONTEXT_CHARS)), "behind"), F.lit(CONTEXT_CHARS)))
        last, two = F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_replace(F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1), r"\s+", " ")
        return F.array(F.concat(F.lit("before "), two), F.concat(F.lit("between "), last, F.lit(" | "), F.regexp_extract(right, r"^\s*(\S+)", 1)))

    start, stop = (lambda s: (s["start"] + F.col("at")).alias("start")), (lambda s: (s["stop"] + F.col("at")).alias("stop"))
    tokens = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), start(s), stop(s), F.lower(s["value"]).alias("value"), beside(s).alias("patterns")))
    return rows.select("doc_id", "text_key", "at", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), start(s), stop(s))).alias("spans"), tokens.alias("tokens"))


def _shaped(kind: Column, value: Column) -> Column:
    """Whether a token that no base pattern takes can be of the kind."""
    d = F.length(_digits(value))
    return F.when(kind == 0, value.rlike(r"\S@\S")).when(kind == 1, value.rlike(r"^[0-9a-f:.]{6,}$") & (d >= 4)).when(kind == 2, value.rlike(r"^[0-9\-]+$") & (d >= 12)).otherwise(value.rlike(r"^[0-9().+\-]+$") & d.between(6, 15))


def contextual_spans(base: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.8) -> DataFrame:
    """doc_id, text_key, more: spans (kind, start, stop) that trusted patterns find beside the base ones.

    A pattern's trust in a kind is the mean trust of the distinct values it stands beside (seeds of the kind
    1, others what their best pattern of the last round gives them); only patterns that `support` distinct
    seeds back count. Counts cover all documents.
    """
    at = base.where(F.size("tokens") > 0).select("doc_id", "text_key", F.explode("tokens").alias("t")).select("doc_id", "text_key", "t.kind", "t.start", "t.stop", "t.value", F.explode("t.patterns").alias("pattern"))
    pairs = at.groupBy("pattern", "value").agg(F.max("kind").alias("seed"))
    backed = pairs.where("seed is not null").groupBy("pattern", "seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("pattern", F.col("seed").alias("kind"))
    backed = backed.where("pattern rlike '[^ |] [^ |]|[^ |] [|] '")
    # One row for each pattern, kind it may mean and value beside it.
    graph = stored(pairs.join(backed, "pattern").withColumn("sure", F.col("seed").eqNullSafe(F.col("kind")).cast("double")), "patterns")
    trusted = graph.groupBy("pattern", "kind").agg(F.avg("sure").alias("trust"))
    for _ in range(rounds - 1):
        values = graph.join(trusted, ["pattern", "kind"]).where("seed is null").groupBy("value", "kind").agg(F.max("trust").alias("guess"))
        belief = F.when(F.col("seed").isNull(), F.coalesce("guess", F.lit(0.0)) * F.col("fits").cast("double")).otherwise(F.col("sure"))
        trusted = graph.withColumn("fits", _shaped(F.col("kind"), F.col("value"))).join(values, ["value", "kind"], "left").groupBy("pattern", "kind").agg(F.avg(belief).alias("trust"))
        trusted = stored(trusted, "trust")
    good = trusted.where(F.col("trust") >= trust).select("pattern", F.col("kind").alias("means"))
    new = at.where("kind is null").join(good, "pattern").where(_shaped(F.col("means"), F.col("value")))
    # A token that patterns of several kinds take is of the first of them.
    new = new.groupBy("doc_id", "text_key", "start", "stop").agg(F.min("means").alias("kind"))
    return new.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more"))


def private_spans(docs: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.8) -> DataFrame:
    """doc_id, text_key, base, spans (arrays of kind number, start, stop) of every row of (doc_id, text).

    Offsets are code points, stops exclusive; spans hold the base ones and those found by context, by kind and
    start. Null texts count as empty and have none; repeated rows keep a row each; null doc_ids are kept;
    an empty table gives no rows. text_key is the text's hash, for joining back.
    """
    base = stored(base_spans(docs), "spans")
    more = contextual_spans(base, rounds, support, trust)
    more = more.select(F.col("doc_id").alias("more_id"), F.col("text_key").alias("more_key"), "more")
    joined = base.join(more, F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("text_key") == F.col("more_key")), "left")
    return joined.select("doc_id", "text_key", F.array_sort("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:int,start:bigint,stop:bigint>>")))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; what overlaps an earlier span goes with it.

    Done piece by piece, as spans never reach over the end of one.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(p: Column) -> Column:
        end = p["at"] + F.length(p["text"])
        mine = F.filter(spans, lambda s: (s["start"] >= p["at"]) & (s["start"] < end))
        by_start = F.array_sort(F.transform(mine, lambda s: F.struct((s["start"] - p["at"]).alias("start"), (p["at"] - s["stop"]).alias("back"), s["kind"].alias("kind"))))
        none = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

        def step(a: Column, s: Column) -> Column:
            gap = F.substring(p["text"], (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
            fresh = F.concat(a["out"], gap, F.get(names, s["kind"]))
            return F.struct(F.greatest(a["at"], -s["back"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

        return F.aggregate(by_start, none, step, lambda a: F.concat(a["out"], F.substring(p["text"], (a["at"] + 1).cast("int"), F.length(p["text"]))))

    return F.array_join(F.transform(segments(text), piece), "")


def op8_private(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
