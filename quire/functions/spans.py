"""Matches with offsets, out of built-in functions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An ASCII word bound: Java's own is Unicode-aware.
BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The same before and after a part that begins or ends with a word character, at less cost.
OPEN, CLOSE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Characters that no text may hold: they mark the begin of a match or of a group, and the end of both. One character is split at without a pattern.
_BEGIN, _END = "\ufdd0", "\ufdd2"
_NO_TEXT = "\ufdd0\ufdd1\ufdd2"
MATCH = "array<struct<start:int,text:string,groups:array<string>>>"
STEP = 128


_CLASS = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]")
_RANGE = re.compile(r"(?<![-\\])(?:A-Z|a-z|0-9)(?!-[^\]])")
_SPELT = {"A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a-z": "abcdefghijklmnopqrstuvwxyz", "0-9": "0123456789"}


def spelt(pattern: str) -> str:
    """The pattern with the ranges A-Z, a-z and 0-9 of its classes written out: Java looks single characters up in a table, ranges are tried one by one."""
    return _CLASS.sub(lambda m: _RANGE.sub(lambda r: _SPELT[r[0]], m[0]) if m[0][0] == "[" else m[0], pattern)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column) -> Column:
    """The sums of all entries before each one, of an array of ints.

    Folded in stretches of STEP entries, so a long array costs no more an entry than a short one.
    """

    def sums(part: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, none, step)

    def blocked(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / STEP).cast("int")), lambda k: sums(F.slice(all_, k * STEP + 1, F.lit(STEP))))
        shifted = lambda ps: F.zip_with(ps, sums(F.transform(ps, lambda p: p["at"]))["out"], lambda p, at: F.transform(p["out"], lambda x: x + at))
        return F.flatten(let(parts, shifted))

    return let(lengths, lambda x: F.when(F.size(x) <= STEP, sums(x)["out"]).otherwise(blocked(x)))


def find_all(text: Column, pattern: str, guard: str | None = None, groups: int = 0, needs: tuple[int, ...] = ()) -> Column:
    """start (0-based, code points), text and groups (unmatched ones empty) of every match, as MATCH; none in null.

    The pattern runs once over the text and must not match the empty string. guard: a cheaper pattern without which none
    can match. needs: groups of which one must have matched; the other matches are left out before any is taken apart. Noncharacters U+FDD0 to U+FDD2 in the text count as U+FFFD.
    """
    # Bytes are searched before characters are translated one by one.
    marks = text.contains(_NO_TEXT[0]) | text.contains(_NO_TEXT[1]) | text.contains(_NO_TEXT[2])
    clean = F.when(marks, F.translate(text, _NO_TEXT, "\ufffd" * 3)).otherwise(F.coalesce(text, F.lit("")))
    hay = clean if guard is None else F.when(text.rlike(spelt(guard)), clean).otherwise(F.lit(""))
    marked = F.regexp_replace(hay, spelt(pattern), _BEGIN + "$0" + "".join(f"{_BEGIN}${k + 1}" for k in range(groups)) + _END)
    if needs:
        other = f"[^{_BEGIN}{_END}]*"
        marked = F.regexp_replace(marked, f"{_BEGIN}({other})" + "".join(_BEGIN + ("" if k + 1 in needs else other) for k in range(groups)) + _END, "$1")
    parts = lambda m: F.filter(F.transform(F.split(m, _END, -1), lambda b: F.split(b, _BEGIN, -1)), lambda p: F.size(p) > 1)

    def placed(ps: Column) -> Column:
        # A gap and its match, in turn: the place of a match is the sum of all before it.
        before = running(F.transform(ps, lambda p: F.length(p[0]) + F.length(p[1])))
        return F.zip_with(ps, before, lambda p, at: F.struct((at + F.length(p[0])).alias("start"), p[1].alias("text"), F.slice(p, 3, F.lit(groups)).alias("groups")))

    # Most patterns match in few texts: the others are not taken apart.
    return let(marked, lambda m: F.when(m.contains(_END), let(parts(m), placed)).otherwise(F.array().cast(MATCH)))


def compiled(pattern: str) -> re.Pattern:
    """The pattern as Java reads it: its flags hold for all of it, and without (?u) letters, digits and white space are ASCII's."""
    flags = re.I if "(?i" in pattern else 0
    return re.compile(pattern.replace("(?iu)", "").replace("(?i)", ""), flags if "(?iu)" in pattern else flags | re.A)


_PARTS = re.compile(r"\\x[0-9a-fA-F]{2}|\\.|\[(?:\\.|[^\]\\])*\]|\(\?:|.", re.S)
_ITEMS = re.compile(r"(\\x[0-9a-fA-F]{2}|\\.|[^\\])(?:-(\\.|[^\\]))?", re.S)
_LOOKAHEAD = re.compile(r"\(\?=(?:\\.|\[(?:\\.|[^\]\\])*\]|[^()\[\\])*\)")
_WHITE = r"\t\n\v\f\r "
#: Letters that (?iu) takes for one another besides the two cases.
_ALIKE = {"i": "iIıİ", "s": "sSſ", "k": "kKK"}


def linear(pattern: str) -> str | None:
    """The pattern for Arrow's expressions, which take a text in one pass whatever the pattern; None if it has parts that they lack.

    Word bounds are ASCII's there too. Lookaheads of the library's patterns and possessive signs only hasten what comes to the same; cases are
    written out, as Arrow folds more letters than Java.
    """
    caseless, unicode = "(?i" in pattern, "(?iu)" in pattern
    plain = _LOOKAHEAD.sub("", pattern.replace(BOUND, r"\b").replace(OPEN, r"\b").replace(CLOSE, r"\b").replace("(?iu)", "").replace("(?i)", "").replace("++", "+"))
    if "(?" in plain.replace("(?:", ""):
        return None

    def cases(c: str) -> str:
        if not caseless or not (c.isascii() and c.isalpha()):
            return c
        return _ALIKE.get(c.lower(), c.lower() + c.upper()) if unicode else c.lower() + c.upper()

    def items(m: re.Match) -> str:
        if m[0] == r"\s":
            return _WHITE
        if m[2]:
            return m[0] if not caseless or not m[1].isalpha() else f"{m[1].lower()}-{m[2].lower()}{m[1].upper()}-{m[2].upper()}" + "".join("".join(x[2:]) for k, x in _ALIKE.items() if unicode and m[1].lower() <= k <= m[2].lower())
        return cases(m[0])

    def part(m: re.Match) -> str:
        if m[0][0] == "[":
            at = 2 if m[0][1] == "^" else 1
            return m[0][:at] + _ITEMS.sub(items, m[0][at:-1]) + "]"
        if m[0] == r"\s":
            return f"[{_WHITE}]"
        both = cases(m[0])
        return both if len(both) == 1 or m[0][0] in "\\(" else f"[{both}]"

    return _PARTS.sub(part, plain)


def _matches(texts: pa.Array, rule: str, groups: int, needs: tuple[int, ...]) -> pa.Array:
    """The matches of linear(pattern) in each of the texts, as MATCH."""
    kind = pa.struct([("start", pa.int32()), ("text", pa.string()), ("groups", pa.list_(pa.string()))])
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if pc.any(pc.match_substring_regex(texts, f"[{_NO_TEXT}]")).as_py():
        texts = pc.replace_substring_regex(texts, f"[{_NO_TEXT}]", "�")
    has = np.flatnonzero(pc.match_substring_regex(texts, rule).to_numpy(zero_copy_only=False))
    marked = pc.replace_substring_regex(texts.take(pa.array(has)), rule, f"{_BEGIN}\\0" + "".join(f"{_BEGIN}\\{k + 1}" for k in range(groups)) + _END)
    # What follows the last match of a text is left out, the rest is gaps, matches and groups in turn.
    pieces = pc.split_pattern(marked, _END)
    ends = pieces.offsets.to_numpy()[1:]
    inner = np.ones(ends[-1] if len(ends) else 0, bool)
    inner[ends - 1] = False
    of = np.repeat(has, np.diff(pieces.offsets.to_numpy()) - 1)
    parts = pc.split_pattern(pieces.flatten().filter(pa.array(inner)), _BEGIN).flatten()
    width = 2 + groups
    places = np.arange(len(of)) * width
    hits = parts.take(pa.array(places + 1))
    long = pc.utf8_length(hits).to_numpy(zero_copy_only=False).astype(np.int64)
    after = np.cumsum(pc.utf8_length(parts.take(pa.array(places))).to_numpy(zero_copy_only=False) + long)
    firsts = np.searchsorted(of, of)
    start = after - long - np.concatenate(([0], after))[firsts]
    if needs:
        kept = np.zeros(len(of), bool)
        for k in needs:
            kept |= pc.binary_length(parts.take(pa.array(places + 1 + k))).to_numpy(zero_copy_only=False) > 0
        of, start, places, hits = of[kept], start[kept], places[kept], hits.filter(pa.array(kept))
    own = parts.take(pa.array((places[:, None] + 2 + np.arange(groups)).ravel()))
    held = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * groups), own)
    found = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), hits, held], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)), found)


def find_known(text: Column, pattern: str, words: tuple[str, ...] = (), guard: str | None = None, groups: int = 0, needs: tuple[int, ...] = (), within: str | None = None) -> Column:
    """find_all for the library's own patterns, by Arrow's or Python's expressions over whole batches: all that a query asks for run in one worker pass.

    For Python's, which take what Arrow's can't (linear), words: lower-case texts of which one stands in any match, whatever its case; within: a pattern whose matches
    are searched, each as a text of its own. text is a column outside of lambdas, and the pattern has no \\d or \\s if it has (?iu).
    """
    if plain := linear(pattern):

        @F.arrow_udf(MATCH)
        def told(texts: pa.Array) -> pa.Array:
            return _matches(texts, plain, groups, needs)

        return told(text)
    return find_by_python(text, pattern, words, guard, groups, needs, within)


def find_by_python(text: Column, pattern: str, words: tuple[str, ...] = (), guard: str | None = None, groups: int = 0, needs: tuple[int, ...] = (), within: str | None = None) -> Column:
    """find_known by Python's expressions."""
    rule, outer, test = compiled(pattern), compiled(within) if within else None, compiled(guard) if guard else None
    kind = pa.struct([("start", pa.int32()), ("text", pa.string()), ("groups", pa.list_(pa.string()))])

    @F.arrow_udf(MATCH)
    def found(texts: pa.Array) -> pa.Array:
        ends, starts, hits, parts = [0], [], [], []
        for t in texts.to_pylist():
            low = t.lower() if t and words else ""
            if t and (not words or any(w in low for w in words)) and (test is None or test.search(t)):
                if any(c in t for c in _NO_TEXT):
                    t = t.translate(dict.fromkeys(map(ord, _NO_TEXT), "\ufffd"))
                for at, x in ((m.start(), m[0]) for m in outer.finditer(t)) if outer else ((0, t),):
                    for m in rule.finditer(x):
                        if not needs or any(m[k] for k in needs):
                            starts.append(at + m.start())
                            hits.append(m[0])
                            parts.extend(m.groups(""))
            ends.append(len(starts))
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * groups), pa.array(parts, pa.string()))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(hits, pa.string()), held], fields=list(kind)))

    return found(text)


def group(match: Column, k: int) -> Column:
    """Group k of a match of find_all; null where it is empty or took no part."""
    return F.nullif(F.get(match["groups"], F.lit(k - 1)), F.lit(""))


def first_of_each(hits: Column, key) -> Column:
    """Of hits with equal keys the first alone, in the order of the array: sorted by key, compared with neighbours, sorted back."""
    keyed = F.array_sort(F.transform(hits, lambda h, i: F.struct(key(h).alias("k"), i.alias("i"), h.alias("h"))))
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"]))
    back = F.array_sort(F.transform(let(keyed, firsts), lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"))))
    return F.when(F.size(hits) < 2, hits).otherwise(F.transform(back, lambda x: x["h"]))


def inlined(rows: DataFrame, keys: list[str], hits: Column, field: str) -> DataFrame:
    """The keys and the fields of every struct of hits, whose field is never null.

    Spark tests before a plain inline whether the array is empty, and moves that test below projections and shuffles: the array
    would be computed twice, first by the few tasks that read the file.
    """
    return rows.select(*keys, F.inline_outer(hits)).where(F.col(field).isNotNull())
