"""Queries of the key-information operators."""

from __future__ import annotations

from quire.operators import entities as E

from . import views
from .duck import find, first, lit, rx

BIZ, biz = views.BIZ, views.biz_pages
CUSTOM = {"reference": r"INV-(\d+)", "point": r"(\d)\. (\w+) point"}


def _group(pattern: str, k: int) -> str:
    return f"nullif(regexp_extract(hit, {rx(pattern)}, {k}), '')"


def _dates() -> str:
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    parts = []
    for n, (pattern, name, sure, (y, m, d)) in enumerate(E.DATES):
        month = f"list_position({months}, substring(lower({_group(pattern, m)}), 1, 3))" if "Jan" in pattern else f"CAST({_group(pattern, m)} AS INTEGER)"
        parts.append(f"SELECT doc_id, page, start, hit, {lit(name)} AS format, {sure} AS confidence, {n} AS family, CAST({_group(pattern, y)} AS INTEGER) AS y0, {month} AS mo, CAST({_group(pattern, d)} AS INTEGER) AS d FROM {find(BIZ, pattern)}")
    year = "CASE WHEN family >= 4 AND y0 < 100 THEN CASE WHEN y0 > 50 THEN 1900 + y0 ELSE 2000 + y0 END ELSE y0 END"
    day = "make_date(CAST(y AS INTEGER), 1, 1) + to_months(CAST(mo - 1 AS INTEGER)) + to_days(CAST(d - 1 AS INTEGER))"
    good = f"(family < 4 OR (mo BETWEEN 1 AND 12 AND d <= 31 AND y BETWEEN 1900 AND 2100 AND month({day}) = mo))"
    rows = f"(SELECT *, CAST({day} AS DATE) AS parsed FROM (SELECT *, {year} AS y FROM ({' UNION ALL '.join(parts)})) WHERE {good})"
    return f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, format, parsed, confidence FROM {first(rows, 'doc_id, page, start, hit', 'family')}"


def _amounts() -> str:
    p = E.AMOUNT
    codes = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in E.CURRENCIES.items()) + "}"
    return f"""SELECT doc_id, page, start, start + length(trim(hit)) AS stop, trim(hit) AS text, value, coalesce({codes}[sym], {codes}[replace(upper(sym), '.', '')], 'USD') AS currency, symbol, CASE WHEN symbol IS NOT NULL THEN 90 ELSE 75 END AS confidence
 FROM (SELECT *, coalesce(symbol, suffix) AS sym, CAST(replace(num, ',', '') AS DOUBLE) AS value FROM (SELECT *, {_group(p, 1)} AS symbol, {_group(p, 2)} AS num, {_group(p, 3)} AS suffix FROM {find(BIZ, p)})) WHERE sym IS NOT NULL AND length(num) >= 2 AND value <> 0"""


def _names() -> str:
    t, n = E.TITLED, E.NAMED
    no = ", ".join(map(lit, E.NO_NAMES))
    plain = f"SELECT doc_id, page, start, hit, {_group(n, 1)} AS first, coalesce({_group(n, 3)}, {_group(n, 2)}) AS last, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS suffix, CASE WHEN regexp_matches(substring(body, greatest(start - 2, 1), least(start, 3)), '[.!?]\\s*$') THEN 50 ELSE 65 END AS confidence, 1 AS family FROM {find(BIZ, n)} WHERE {_group(n, 1)} NOT IN ({no}) AND {_group(n, 2)} NOT IN ({no})"
    titled = f"SELECT doc_id, page, start, hit, {_group(t, 2)} AS first, {_group(t, 3)} AS last, {_group(t, 1)} AS title, {_group(t, 4)} AS suffix, 85 AS confidence, 0 AS family FROM {find(BIZ, t)}"
    return f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, first, last, title, suffix, confidence FROM {first(f'({titled} UNION ALL {plain})', 'doc_id, page, start, hit', 'family')}"


def _emails(source: str) -> str:
    p = E.EMAIL
    return f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, {_group(p, 1)} AS local, {_group(p, 2)} AS domain, 95 AS confidence FROM {first(find(source, p), 'doc_id, page, lower(hit)', 'start')}"


def _phones(source: str) -> str:
    parts = [f"SELECT doc_id, page, start, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, {_group(p, 1) if name == 'INTERNATIONAL' else 'CAST(NULL AS VARCHAR)'} AS country_code, {lit(name)} AS format, {sure} AS confidence, {n} AS family FROM {find(source, p)}" for n, (p, name, sure) in enumerate(E.PHONES)]
    kept = f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE length(digits) BETWEEN 10 AND 15)"
    return f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, digits, country_code, format, confidence FROM {first(kept, 'doc_id, page, digits', 'family, start')}"


def _addresses() -> str:
    s, t = E.STREET, E.TOWN
    parts = f"SELECT doc_id, page, start, hit, trim({_group(s, 1)}) AS street, trim({_group(s, 2)}) AS city, upper({_group(s, 3)}) AS state, {_group(s, 4)} AS zip, 85 AS confidence, 0 AS family FROM {find(BIZ, s)} UNION ALL SELECT doc_id, page, start, hit, CAST(NULL AS VARCHAR), trim({_group(t, 1)}), upper({_group(t, 2)}), {_group(t, 3)}, 70, 1 FROM {find(BIZ, t)}"
    key = r"doc_id, page, regexp_replace(lower(hit), '\s+', ' ', 'g')"
    return f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, street, city, state, zip, confidence FROM {first(f'({parts})', key, 'family, start')}"


def _urls() -> str:
    p = E.URL
    rows = f"(SELECT *, {_group(p, 1)} AS s, {_group(p, 2)} AS domain, {_group(p, 3)} AS path FROM {find(BIZ, p)})"
    kept = f"(SELECT * FROM {rows} WHERE (start = 0 OR substring(body, start, 1) <> '@') AND regexp_matches(domain, {rx(E.TLD)}))"
    return f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, replace(s, '://', '') AS scheme, domain, path, coalesce(lower(s) = 'https://', false) AS secure, CASE WHEN s IS NOT NULL THEN 95 ELSE 80 END AS confidence FROM {first(kept, 'doc_id, page, lower(hit)', 'start')}"


def _ids() -> str:
    d = "regexp_replace(hit, '[^0-9]', '', 'g')"
    parts = [f"SELECT doc_id, page, start, hit, {lit(kind)} AS id_type, {f'NOT regexp_matches({d}, {lit('^(000|666|9)')})' if kind == 'SSN' else 'true'} AS valid, {n} AS family FROM {find(BIZ, p)}" for n, (p, kind) in enumerate(E.IDS)]
    return f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, id_type, regexp_replace(hit, '[^A-Za-z0-9]', '', 'g') AS normalized, valid, CASE WHEN valid THEN 80 ELSE 50 END AS confidence FROM {first(f'({" UNION ALL ".join(parts)})', 'doc_id, page, id_type, lower(hit)', 'family, start')}"


def _custom() -> str:
    parts = []
    for name, p in CUSTOM.items():
        k = 1 if name == "reference" else 2
        parts.append(f"SELECT doc_id, page, start, start + length(hit) AS stop, hit AS text, {lit(name)} AS name, [{', '.join(f'regexp_extract(hit, {rx(p)}, {g + 1})' for g in range(k))}] AS groups, 90 AS confidence FROM {find(BIZ, p)}")
    return " UNION ALL ".join(parts)


def _all() -> str:
    value = {"date": ("_dates", "CAST(parsed AS VARCHAR)"), "amount": ("_amounts", "currency || ' ' || printf('%.2f', value)"), "name": ("_names", "text"), "email": ("_emails", "lower(domain)"), "phone": ("_phones", "digits"), "address": ("_addresses", "zip"), "url": ("_urls", "lower(domain)"), "id": ("_ids", "normalized")}
    made = {"_dates": _dates(), "_amounts": _amounts(), "_names": _names(), "_emails": _emails(BIZ), "_phones": _phones(BIZ), "_addresses": _addresses(), "_urls": _urls(), "_ids": _ids()}
    return " UNION ALL ".join(f"SELECT doc_id, page, {lit(k)} AS kind, start, stop, text, {v} AS value, confidence FROM ({made[f]}) WHERE confidence >= 50" for k, (f, v) in value.items())


_COUNTS = ", ".join(f"count(*) FILTER (kind = {lit(k)}) AS n_{k}" for k in E.KINDS)


def _summary() -> str:
    return f"""SELECT doc_id, count(*) AS total, {_COUNTS}, min(CASE WHEN kind = 'date' THEN value END) AS first_date, max(CASE WHEN kind = 'date' THEN value END) AS last_date,
 coalesce(string_agg(DISTINCT CASE WHEN kind IN ('email', 'url') THEN value END, ',' ORDER BY CASE WHEN kind IN ('email', 'url') THEN value END), '') AS domains, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM ({_all()}) GROUP BY doc_id"""


def _redact() -> str:
    return f"""WITH s AS (SELECT doc_id, page, start, stop FROM ({_emails(BIZ)}) UNION ALL SELECT doc_id, page, start, stop FROM ({_phones(BIZ)})),
 o AS (SELECT doc_id, page, start, stop, row_number() OVER (PARTITION BY doc_id, page ORDER BY start, stop) AS i, coalesce(max(stop) OVER (PARTITION BY doc_id, page ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s),
 p AS (SELECT b.doc_id, b.page, string_agg(CASE WHEN start >= done THEN substring(text, CAST(done AS INTEGER) + 1, start - CAST(done AS INTEGER)) || '[REDACTED]' ELSE '' END, '' ORDER BY i) AS head, max(stop) AS last, count(*) FILTER (start >= done) AS n FROM o JOIN ({BIZ}) b USING (doc_id, page) GROUP BY ALL)
 SELECT doc_id, page, CASE WHEN head IS NULL THEN text ELSE head || substring(text, last + 1) END AS redacted, CAST(coalesce(n, 0) AS INTEGER) AS n_spans FROM ({BIZ}) LEFT JOIN p USING (doc_id, page)"""


QUERIES = {
    "c1_dates": lambda s, d: E.extract_dates(biz(s, d)),
    "c2_amounts": lambda s, d: E.extract_amounts(biz(s, d)),
    "c3_names": lambda s, d: E.extract_names(biz(s, d)),
    "c4_emails": lambda s, d: E.extract_emails(biz(s, d)),
    "c4_emails_documents": lambda s, d: E.extract_emails(views.doc_pages(s, d)),
    "c5_phones": lambda s, d: E.extract_phones(biz(s, d)),
    "c5_phones_documents": lambda s, d: E.extract_phones(views.doc_pages(s, d)),
    "c6_addresses": lambda s, d: E.extract_addresses(biz(s, d)),
    "c7_urls": lambda s, d: E.extract_urls(biz(s, d)),
    "c8_ids": lambda s, d: E.extract_ids(biz(s, d)),
    "c9_custom": lambda s, d: E.extract_custom(biz(s, d), CUSTOM),
    "c10_key_information": lambda s, d: E.extract_key_information(biz(s, d)),
    "c11_entity_summary": lambda s, d: E.summarize_pages(biz(s, d)),
    "c12_filter_entities": lambda s, d: E.find_entities(biz(s, d), ("email", "url"), "MAIL1"),
    "c14_redact_spans": lambda s, d: E.redact_spans(biz(s, d), ("email", "phone")),
}
ORACLES = {
    "c1_dates": _dates(),
    "c2_amounts": _amounts(),
    "c3_names": _names(),
    "c4_emails": _emails(BIZ),
    "c4_emails_documents": _emails(views.DOC_PAGES),
    "c5_phones": _phones(BIZ),
    "c5_phones_documents": _phones(views.DOC_PAGES),
    "c6_addresses": _addresses(),
    "c7_urls": _urls(),
    "c8_ids": _ids(),
    "c9_custom": _custom(),
    "c10_key_information": _all(),
    "c11_entity_summary": _summary(),
    "c12_filter_entities": f"SELECT * FROM ({_all()}) WHERE kind IN ('email', 'url') AND contains(lower(text), 'mail1')",
    "c14_redact_spans": _redact(),
}
