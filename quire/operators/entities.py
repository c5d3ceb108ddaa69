"""Key information in page texts: dates, amounts, names, contacts, addresses, links and identifiers.

Every extractor takes pages (doc_id, page, text) and gives a row for each hit: doc_id, page, start, stop
(0-based code points, stop exclusive), text, its own columns and confidence. Pages are independent: repeated
values are dropped within a page, inside the page's array of hits, so nothing is shuffled. Null and empty texts have no hits; repeated
rows have hits of their own; empty tables give no rows; columns not named are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.spans import BOUND, CLOSE, OPEN, find_all, find_known, first_of_each, group, inlined

# Word lists, codes and patterns of the entity kinds.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
_ABBREVIATED = r"Jan\.?|Feb\.?|Mar\.?|Apr\.?|May|Jun\.?|Jul\.?|Aug\.?|Sep\.?|Sept\.?|Oct\.?|Nov\.?|Dec\.?"
DATES = (
    # pattern, format, confidence, groups of year, month, day
    (rf"{OPEN}(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){CLOSE}", "ISO", 95, (1, 2, 3)),
    (rf"(?i){OPEN}({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){CLOSE}", "LONG", 90, (3, 1, 2)),
    (rf"(?i){OPEN}({_ABBREVIATED})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){CLOSE}", "SHORT", 85, (3, 1, 2)),
    (rf"(?i){OPEN}(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\s+(\d{{4}}){CLOSE}", "LONG", 88, (3, 2, 1)),
    (rf"{OPEN}(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{2,4}}){CLOSE}", "US", 70, (3, 1, 2)),
    (rf"{OPEN}(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2,4}}){CLOSE}", "EU", 70, (3, 2, 1)),
)
AMOUNT = r"(?iu)(?:([$€£¥₹]|USD|US\$|EUR|GBP|JPY|INR|Rs\.?|CAD|C\$|AUD|A\$|CHF|CNY|元)\s?)?(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)(?:\s?(USD|EUR|GBP|JPY|INR|CAD|AUD|CHF|CNY))?"
CURRENCIES = {"$": "USD", "USD": "USD", "US$": "USD", "€": "EUR", "EUR": "EUR", "£": "GBP", "GBP": "GBP", "¥": "JPY", "JPY": "JPY", "₹": "INR", "INR": "INR", "Rs": "INR", "CAD": "CAD", "C$": "CAD", "AUD": "AUD", "A$": "AUD", "CHF": "CHF", "CNY": "CNY", "元": "CNY"}
_SUFFIXES = "Jr|Sr|II|III|IV|PhD|MD|Esq|CPA|DDS|DO"
TITLED = rf"{OPEN}(Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Sir|Dame|Lord|Lady)\.?\s+([A-Z][a-z]+)(?:\s+([A-Z][a-z]+))?(?:\s+({_SUFFIXES})\.?)?{BOUND}"
NAMED = rf"{OPEN}([A-Z][a-z]{{1,15}})\s+([A-Z][a-z]{{1,15}})(?:\s+([A-Z][a-z]{{1,15}}))?{CLOSE}"
NO_NAMES = ("The", "This", "That", "These", "Those", "What", "When", "Where", "Which", "Who", "How", "New", "For", "With", "From", "About")
EMAIL = rf"{BOUND}([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}){CLOSE}"
PHONES = (
    (rf"\+(\d{{1,3}})[-.\s]?(\d{{2,4}})[-.\s]?(\d{{3,4}})[-.\s]?(\d{{3,4}}){CLOSE}", "INTERNATIONAL", 90),
    (rf"\((\d{{3}})\)\s*(\d{{3}})[-.]?(\d{{4}}){CLOSE}", "US", 90),
    (rf"{OPEN}(\d{{3}})-(\d{{3}})-(\d{{4}}){CLOSE}", "DASHED", 75),
    (rf"{OPEN}(\d{{3}})\.(\d{{3}})\.(\d{{4}}){CLOSE}", "DOTTED", 75),
    (rf"{OPEN}(\d{{3}})\s(\d{{3}})\s(\d{{4}}){CLOSE}", "UNKNOWN", 75),
)
#: Parts of any match that are found by their first character.
_PHONE_PARTS = {"INTERNATIONAL": r"\+\d", "US": r"\(\d{3}\)", "DASHED": r"-\d{3}-\d{4}", "DOTTED": r"\.\d{3}\.\d{4}", "UNKNOWN": r"\s\d{3}\s\d{4}"}
_ID_PARTS = {"SSN": r"[-\s]\d{2}[-\s]\d{4}", "EIN": r"-\d{7}"}
_STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
STREET = rf"(?i)(\d+\s+[A-Za-z0-9\s,.-]+(?:St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Dr(?:ive)?|Rd|Road|Ln|Lane|Way|Ct|Court|Pl|Place|Cir|Circle)\.?)\s*,?\s*([A-Za-z\s]+),?\s*({_STATES})\s*(\d{{5}}(?:-\d{{4}})?)"
TOWN = rf"(?i){OPEN}([A-Za-z][A-Za-z\s]{{2,25}}),?\s*({_STATES})\s+(\d{{5}}(?:-\d{{4}})?){CLOSE}"
#: Where a street address must end: a stretch of its characters up to its last state with a ZIP. Whole stretches that hold towns, links and addresses.
_UP_TO_ZIP = rf"(?i)(?<![a-z0-9\s,.-])[a-z0-9\s,.-]*(?=[a-z]{{2}}\s*\d{{5}})(?:{_STATES})\s*\d{{5}}(?:-\d{{4}})?"
_ROUND_ZIP = r"(?<![A-Za-z0-9_\s,-])[A-Za-z0-9_\s,-]*[A-Za-z]{2}\s+\d{5}[A-Za-z0-9_\s,-]*"
_ROUND_DOT, _ROUND_AT = r"(?<!\S)\S*\.[A-Za-z]{2}\S*", r"(?<!\S)[^\s@]*@\S*"
URL = BOUND + r"(?i)((?:https?|ftp)://)?(?:www\.)?([a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z]{2,})+)(/[^\s<>\"{}|\\^`\[\]]*)?"
TLD = r"(?i)\.(com|org|net|edu|gov|io|co|me|info|biz|us|uk|ca|de|fr|app|dev|ai|tech|xyz|online)\z"
IDS = (
    (rf"{OPEN}(\d{{3}})[-\s](\d{{2}})[-\s](\d{{4}}){CLOSE}", "SSN"),
    (rf"{OPEN}(\d{{2}})-(\d{{7}}){CLOSE}", "EIN"),
    (rf"(?i){OPEN}(?:Invoice|INV|Inv)[#:\s-]*([A-Z0-9]+-?\d+|\d{{4,}}){CLOSE}", "INVOICE"),
    (rf"(?i){OPEN}(?:Order|ORD|PO)[#:\s-]*([A-Z0-9]+-?\d+|\d{{4,}}){CLOSE}", "ORDER"),
    (rf"(?i){OPEN}(?:Account|Acct|A/C)[#:\s-]*([A-Z0-9-]{{6,}}){BOUND}", "ACCOUNT"),
    (rf"(?i){OPEN}(?:Reference|Ref|REF)[#:\s-]*([A-Z0-9-]{{5,}}){BOUND}", "REFERENCE"),
    (rf"(?i){OPEN}(?:Tracking|Track)[#:\s-]*(\d{{10,}}|[A-Z]{{2}}\d{{9}}[A-Z]{{2}}|1Z[A-Z0-9]{{16}}){BOUND}", "TRACKING"),
    (rf"(?i){OPEN}(?:ID|License|Lic|Passport)[#:\s-]*([A-Z0-9-]{{5,}}){BOUND}", "REFERENCE"),
)


def _begins(pattern: str, characters: str) -> str:
    """The pattern behind a test of the one character its matches begin with, which is cheaper than what stands first in it."""
    return f"(?=[{characters}])" + pattern


def _states_tested(pattern: str) -> str:
    """The pattern with two letters and a ZIP asked for before the states are tried one by one."""
    return pattern.replace(f"({_STATES})", rf"(?=[a-z]{{2}}\s*\d{{5}})({_STATES})")


def _groups(pattern: str) -> int:
    """The number of capturing groups."""
    return re.compile(re.sub(r"\(\?[iu]+\)", "", pattern)).groups


def _hits(text: Column, pattern: str, fields, guard: str | None = None, keep=None, **known) -> Column:
    """The matches of one of the patterns above with their fields: fields(match) gives named columns; keep(match) drops some; known goes to find_known."""
    return _shaped(find_known(text, pattern, guard=guard, groups=_groups(pattern), **known), fields, keep)


def _shaped(found: Column, fields, keep=None) -> Column:
    if keep is not None:
        found = F.filter(found, keep)
    stop = lambda m: (m["start"] + F.length(m["text"])).alias("stop")
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), stop(m), m["text"].alias("text"), *[c.alias(n) for n, c in fields(m).items()]))


def _at(h: Column) -> Column:
    return F.concat_ws("-", h["start"], h["text"])


def _rows(pages: DataFrame, hits: Column, key=None) -> DataFrame:
    """A row for each hit. The hits are bound to a column first, so they are found once."""
    found = pages.select("doc_id", "page", hits.alias("hits"))
    return inlined(found, ["doc_id", "page"], first_of_each(F.col("hits"), key) if key else F.col("hits"), "start")


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date that many months and days on: out-of-range parts roll over."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), (day - 1).cast("int"))


def _date_family(text: Column, pattern: str, name: str, sure: int, places: tuple[int, int, int]) -> Column:
    loose = name in ("US", "EU")
    number = lambda h, k: F.get(h["groups"], F.lit(k - 1))
    names = F.array(*[F.lit(x[:3]) for x in MONTHS])

    def parts(h: Column) -> tuple[Column, Column, Column]:
        y, m, d = (number(h, k) for k in places)
        month = F.array_position(names, F.substring(F.lower(m), 1, 3)).cast("int") if "Jan" in pattern else m.cast("int")
        year = y.cast("int")
        if loose:
            year = F.when(year >= 100, year).when(year > 50, 1900 + year).otherwise(2000 + year)
        return year, month, d.cast("int")

    def good(h: Column) -> Column:
        y, m, d = parts(h)
        return m.between(1, 12) & (d <= 31) & y.between(1900, 2100) & (F.month(_date(y, m, d)) == m)

    # Parts of any match that are found by their first character.
    if name in ("ISO", "US", "EU"):
        guard, words = r"\.\d{1,2}\.\d" if name == "EU" else r"[-/]\d{1,2}[-/]\d", ()
    else:
        guard = r"(?i)\d(?:st|nd|rd|th)?\s+[a-z]{3,9}\s+\d{4}" if places[1] == 2 else r"(?i)\s\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}"
        words = tuple(x[:3] for x in MONTHS) if name == "SHORT" else MONTHS
    return _hits(text, pattern, lambda h: {"format": F.lit(name), "parsed": _date(*parts(h)), "confidence": F.lit(sure)}, guard, good if loose else None, words=words)


def date_hits(text: Column) -> Column:
    return F.concat(*[_date_family(text, *family) for family in DATES])


def extract_dates(pages: DataFrame) -> DataFrame:
    """format (ISO, LONG, SHORT, US, EU), parsed, confidence; the earlier family wins where two match the same text."""
    return _rows(pages, KINDS["date"][0](F.col("text")), KINDS["date"][2])


def amount_hits(text: Column) -> Column:
    prefix = lambda h: group(h, 1)
    number = lambda h: F.get(h["groups"], F.lit(1))
    symbol = lambda h: F.coalesce(prefix(h), group(h, 3))
    value = lambda h: F.replace(number(h), F.lit(","), F.lit("")).cast("double")
    codes = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    code = lambda h: F.coalesce(F.try_element_at(codes, symbol(h)), F.try_element_at(codes, F.regexp_replace(F.upper(symbol(h)), r"\.", "")), F.lit("USD"))
    fields = lambda h: {"value": value(h), "currency": code(h), "symbol": prefix(h), "confidence": F.when(prefix(h).isNotNull(), 90).otherwise(75)}
    keep = lambda h: symbol(h).isNotNull() & (F.length(number(h)) >= 2) & (value(h) != 0)
    # What a match can begin with, tested before its many alternatives.
    # Both cases are written out before the flags, the Turkish i's among them, which they take for an i.
    pattern = "(?=[0-9$€£¥₹元uegjircaUEGJIRCAİı])" + AMOUNT.replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]")
    # Other letters than an i or an s stand in all but INR and Rs in one form alone.
    words = (*"$€£¥₹元", "us", "uſ", "eur", "gbp", "jpy", "nr", "rs", "rſ", "cad", "aud", "chf", "cny")
    found = F.filter(find_known(text, pattern, words, groups=3, needs=(1, 3)), keep)
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.length(F.trim(h["text"]))).alias("stop"), F.trim(h["text"]).alias("text"), *[c.alias(n) for n, c in fields(h).items()]))


def extract_amounts(pages: DataFrame) -> DataFrame:
    """value, currency, symbol, confidence (90 with the currency in front, else 75)."""
    return _rows(pages, KINDS["amount"][0](F.col("text")), KINDS["amount"][2])


def name_hits(text: Column) -> Column:
    titled = _hits(text, TITLED, lambda h: {"first": group(h, 2), "last": group(h, 3), "title": group(h, 1), "suffix": group(h, 4), "confidence": F.lit(85)})
    before = lambda h: F.substring(text, F.greatest(h["start"] - 2, F.lit(1)), F.least(h["start"], F.lit(3)))
    stands = lambda h: F.when(before(h).rlike(r"[.!?]\s*\z"), 50).otherwise(65)
    plain = _hits(
        text,
        NAMED,
        lambda h: {"first": group(h, 1), "last": F.coalesce(group(h, 3), group(h, 2)), "title": F.lit(None).cast("string"), "suffix": F.lit(None).cast("string"), "confidence": stands(h)},
        None,
        lambda h: ~F.get(h["groups"], F.lit(0)).isin(*NO_NAMES) & ~F.get(h["groups"], F.lit(1)).isin(*NO_NAMES),
    )
    return F.concat(titled, plain)


def extract_names(pages: DataFrame) -> DataFrame:
    """first, last, title, suffix, confidence: titled names 85, capitalised runs 65, at a sentence's start 50."""
    return _rows(pages, KINDS["name"][0](F.col("text")), KINDS["name"][2])


def email_hits(text: Column) -> Column:
    # An @ is none of the characters before it: they are never given back.
    return _hits(text, EMAIL.replace("+)@", "++)@", 1), lambda h: {"local": group(h, 1), "domain": group(h, 2), "confidence": F.lit(95)}, words=("@",), within=_ROUND_AT)


def extract_emails(pages: DataFrame) -> DataFrame:
    """local, domain, confidence; an address once a page, whatever its case."""
    return _rows(pages, KINDS["email"][0](F.col("text")), KINDS["email"][2])


def phone_hits(text: Column) -> Column:
    digits = lambda h: F.regexp_replace(h["text"], "[^0-9]", "")
    parts = []
    for pattern, name, sure in PHONES:
        def fields(h, pattern=pattern, name=name, sure=sure):
            code = group(h, 1) if name == "INTERNATIONAL" else F.lit(None).cast("string")
            return {"digits": digits(h), "country_code": code, "format": F.lit(name), "confidence": F.lit(sure)}

        parts.append(_hits(text, pattern, fields, _PHONE_PARTS[name], lambda h: F.length(digits(h)).between(10, 15)))
    return F.concat(*parts)


def extract_phones(pages: DataFrame) -> DataFrame:
    """digits, country_code, format, confidence; a number once a page, the earlier format first."""
    return _rows(pages, KINDS["phone"][0](F.col("text")), KINDS["phone"][2])


def address_hits(text: Column) -> Column:
    trimmed = lambda h, p, k: F.trim(group(h, k))
    street_fields = lambda h: {"street": trimmed(h, STREET, 1), "city": trimmed(h, STREET, 2), "state": F.upper(group(h, 3)), "zip": group(h, 4), "confidence": F.lit(85)}
    # STREET lets every number try the whole text that follows; all it can match lies in these stretches, so it runs in them alone.
    street = _hits(text, _states_tested(STREET), street_fields, r"\d{5}", within=_UP_TO_ZIP)
    town = _hits(text, _states_tested(TOWN), lambda h: {"street": F.lit(None).cast("string"), "city": trimmed(h, TOWN, 1), "state": F.upper(group(h, 2)), "zip": group(h, 3), "confidence": F.lit(70)}, r"\s\d{5}", within=_ROUND_ZIP)
    return F.concat(street, town)


def extract_addresses(pages: DataFrame) -> DataFrame:
    """street, city, state, zip, confidence: with a street 85, town and ZIP alone 70."""
    return _rows(pages, KINDS["address"][0](F.col("text")), KINDS["address"][2])


def url_hits(text: Column) -> Column:
    scheme = lambda h: group(h, 1)
    fields = lambda h: {"scheme": F.replace(scheme(h), F.lit("://"), F.lit("")), "domain": group(h, 2), "path": group(h, 3), "secure": F.coalesce(F.lower(scheme(h)) == "https://", F.lit(False)), "confidence": F.when(scheme(h).isNotNull(), 95).otherwise(80)}
    before = lambda h: F.when(h["start"] > 0, F.substring(text, h["start"], F.lit(1))).otherwise("")
    return _hits(text, URL, fields, r"\.[A-Za-z]{2}", within=_ROUND_DOT, keep=lambda h: (before(h) != "@") & F.get(h["groups"], F.lit(1)).rlike(TLD))


def extract_urls(pages: DataFrame) -> DataFrame:
    """scheme, domain, path, secure, confidence; known top-level domains alone, none after an @."""
    return _rows(pages, KINDS["url"][0](F.col("text")), KINDS["url"][2])


def id_hits(text: Column) -> Column:
    parts = []
    for pattern, kind in IDS:
        def valid(h, kind=kind):
            d = F.regexp_replace(h["text"], "[^0-9]", "")
            return ~(d.startswith("000") | d.startswith("666") | d.startswith("9")) if kind == "SSN" else F.lit(True)

        words = re.search(r"\(\?:([A-Za-z/|]+)\)\[#", pattern)
        begins = "".join(sorted({c for w in words[1].split("|") for c in (w[0].upper(), w[0].lower())})) if words else "0-9"
        parts.append(_hits(text, _begins(pattern, begins), lambda h, kind=kind, valid=valid: {"id_type": F.lit(kind), "normalized": F.regexp_replace(h["text"], "[^A-Za-z0-9]", ""), "valid": valid(h), "confidence": F.when(valid(h), 80).otherwise(50)}, _ID_PARTS.get(kind), words=tuple(words[1].lower().split("|")) if words else ()))
    return F.concat(*parts)


def extract_ids(pages: DataFrame) -> DataFrame:
    """id_type, normalized, valid, confidence; the same text of a type once a page."""
    return _rows(pages, KINDS["id"][0](F.col("text")), KINDS["id"][2])


_NAMED = re.compile(r"\(\?<([A-Za-z][A-Za-z0-9]*)>")
_OPENING = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?<(?=[A-Za-z])|\((?!\?)")


def group_names(pattern: str) -> dict[str, int]:
    """The named groups of a pattern with their numbers: groups are numbered by their opening brackets."""
    opened = [m for m in _OPENING.finditer(pattern) if m[0][0] == "("]
    named = {m.start(): m[1] for m in _NAMED.finditer(pattern)}
    return {named[m.start()]: n for n, m in enumerate(opened, 1) if m.start() in named}


def extract_custom_named(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """name, groups, confidence 90 for the matches of the caller's own patterns; groups is a map of "$1", "$2", ... and of the groups' own names to what they matched.

    Groups that took no part are left out; a match without any has null.
    """
    def hits(name: str, pattern: str) -> Column:
        count = sum(m[0][0] == "(" for m in _OPENING.finditer(pattern))
        keys = [(f"${k}", k) for k in range(1, count + 1)] + list(group_names(pattern).items())

        def fields(h: Column) -> Column:
            pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), group(h, n).alias("v")) for k, n in keys]), lambda p: p["v"].isNotNull()) if keys else F.array().cast("array<struct<k:string,v:string>>")
            return F.struct(h["start"].alias("start"), (h["start"] + F.length(h["text"])).alias("stop"), h["text"].alias("text"), F.lit(name).alias("name"), F.when(F.size(pairs) > 0, F.map_from_entries(pairs)).alias("groups"), F.lit(90).alias("confidence"))

        return F.transform(find_all(F.col("text"), pattern, groups=count), fields)

    return inlined(pages, ["doc_id", "page"], F.concat(*[hits(*x) for x in patterns.items()]), "start")


def extract_custom(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """name, groups, confidence 90 for the matches of the caller's own patterns, by name."""
    parts = []
    for name, pattern in patterns.items():
        n = F.lit(name)
        parts.append(_shaped(find_all(F.col("text"), pattern, groups=_groups(pattern)), lambda h, n=n: {"name": n, "groups": h["groups"], "confidence": F.lit(90)}))
    return _rows(pages, F.concat(*parts))


_LOWER = lambda h: F.lower(h["text"])
#: kind: (hits of a text, value of a hit, key of which a page keeps the first hit).
KINDS = {
    "date": (date_hits, lambda h: h["parsed"].cast("string"), _at),
    "amount": (amount_hits, lambda h: F.format_string("%s %.2f", h["currency"], h["value"]), None),
    "name": (name_hits, lambda h: h["text"], _at),
    "email": (email_hits, lambda h: F.lower(h["domain"]), _LOWER),
    "phone": (phone_hits, lambda h: h["digits"], lambda h: h["digits"]),
    "address": (address_hits, lambda h: h["zip"], lambda h: F.regexp_replace(F.lower(h["text"]), r"\s+", " ")),
    "url": (url_hits, lambda h: F.lower(h["domain"]), _LOWER),
    "id": (id_hits, lambda h: h["normalized"], lambda h: F.concat_ws("-", h["id_type"], F.lower(h["text"]))),
}


def extract_key_information(pages: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), min_confidence: int = 50) -> DataFrame:
    """doc_id, page, kind, start, stop, text, value, confidence of all chosen kinds, in one pass over the pages."""
    found = pages.select("doc_id", "page", *[KINDS[k][0](F.col("text")).alias(k) for k in kinds])

    def of_kind(kind: str) -> Column:
        _, value, key = KINDS[kind]
        row = lambda h: F.struct(F.lit(kind).alias("kind"), h["start"].alias("start"), h["stop"].alias("stop"), h["text"].alias("text"), value(h).alias("value"), h["confidence"].cast("int").alias("confidence"))
        return F.transform(first_of_each(F.col(kind), key) if key else F.col(kind), row)

    found = inlined(found, ["doc_id", "page"], F.concat(*map(of_kind, kinds)), "kind")
    return found.where(F.col("confidence") >= min_confidence)


def entity_summary(entities: DataFrame) -> DataFrame:
    """Per document: total, a count for each kind, first and last date, domains, pages with content."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    domains = F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind").isin("email", "url"), F.col("value")))), ",")
    pages = F.array_join(F.array_sort(F.collect_set(F.col("page").cast("int"))), ",")
    day = F.when(F.col("kind") == "date", F.col("value"))
    return entities.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), *counts, F.min(day).alias("first_date"), F.max(day).alias("last_date"), domains.alias("domains"), pages.alias("pages"))


def summarize_pages(pages: DataFrame, min_confidence: int = 50) -> DataFrame:
    """`entity_summary` of `extract_key_information`: each page's hits are counted in its row, and a row a page is grouped where there was one a hit."""
    found = pages.select("doc_id", "page", *[KINDS[k][0](F.col("text")).alias(k) for k in KINDS])
    sure = lambda k: F.filter(first_of_each(F.col(k), KINDS[k][2]) if KINDS[k][2] else F.col(k), lambda h: h["confidence"].cast("int") >= min_confidence)
    values = lambda k: F.transform(k, KINDS[k][1])
    rows = found.select("doc_id", "page", *[(sure(k) if k in ("date", "email", "url") else F.size(sure(k))).alias(k) for k in KINDS])
    counts = [(F.size(k) if k in ("date", "email", "url") else F.col(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    rows = rows.select("doc_id", F.col("page").cast("int").alias("page"), *counts, values("date").alias("days"), F.concat(values("email"), values("url")).alias("domains"))
    rows = rows.withColumn("total", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)))
    joined = lambda parts: F.array_join(F.array_sort(parts), ",")
    domains = joined(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains")
    days = F.min(F.array_min("days")).alias("first_date"), F.max(F.array_max("days")).alias("last_date")
    told = rows.groupBy("doc_id").agg(F.sum("total").alias("total"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS], *days, domains, joined(F.collect_set(F.when(F.col("total") > 0, F.col("page")))).alias("pages"))
    # Spark would move a test of each page's total below its shuffle, and the few tasks that read the file would look for all hits.
    return told.where("total > 0")


def currency_totals(entities: DataFrame) -> DataFrame:
    """doc_id, currency, amounts, total of the amounts of `extract_key_information`, to the cent."""
    parts = F.split("value", " ")
    cents = F.floor(parts[1].cast("double") * 100 + 0.5).cast("decimal(38,0)")
    rows = entities.where("kind = 'amount'").select("doc_id", parts[0].alias("currency"), cents.alias("cents"))
    return rows.groupBy("doc_id", "currency").agg(F.count(F.lit(1)).alias("amounts"), (F.sum("cents") / 100).cast("double").alias("total"))


def summary_with_totals(entities: DataFrame) -> DataFrame:
    """`entity_summary` and totals: a map of currency to sum, empty for documents without amounts."""
    totals = currency_totals(entities).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency", "total")))).alias("totals"))
    return entity_summary(entities).join(totals, "doc_id", "left").withColumn("totals", F.coalesce("totals", F.create_map().cast("map<string,double>")))


def filter_entities(entities: DataFrame, kinds: tuple[str, ...], query: str = "") -> DataFrame:
    """Entities of the kinds whose text holds the query, whatever its case."""
    kept = entities.where(F.col("kind").isin(*kinds))
    return kept.where(F.lower("text").contains(query.lower())) if query else kept


def find_entities(pages: DataFrame, kinds: tuple[str, ...], query: str = "", min_confidence: int = 50) -> DataFrame:
    """`filter_entities` of `extract_key_information`, for which neither other kinds are looked for nor pages searched that don't hold the query."""
    low = query.lower()
    # An entity's text is a part of its page's, in lower case too but for what depends on neighbours or stands for characters that no text may hold.
    if low and not set(low) & set("σς\ufffd"):
        pages = pages.where(F.lower("text").contains(low))
    return filter_entities(extract_key_information(pages, kinds, min_confidence), kinds, query)


def redact_spans(pages: DataFrame, kinds: tuple[str, ...], token: str = "[REDACTED]", min_confidence: int = 50) -> DataFrame:
    """doc_id, page, redacted, n_spans: the page texts with every hit of the kinds replaced, repeats too, overlapping ones as one."""
    spans = F.concat(*[F.transform(F.filter(KINDS[k][0](F.col("text")), lambda h: h["confidence"] >= min_confidence), lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop"))) for k in kinds])
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(token))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out"), (a["n"] + fresh.cast("int")).alias("n"))

    pages = pages.select("doc_id", "page", "text", F.array_sort(spans).alias("spans"))
    folded = F.aggregate("spans", none, step, lambda a: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))).alias("redacted"), a["n"].alias("n_spans")))
    return pages.select("doc_id", "page", folded.alias("r")).select("doc_id", "page", "r.redacted", "r.n_spans")
