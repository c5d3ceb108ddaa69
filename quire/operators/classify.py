"""Document classes from keywords, structure, entities and text statistics.

All functions take documents with doc_id and text (page_count and title where they are used) and stay narrow:
one row in, one row out, no shuffle. Words are counted in place, without exploding documents by the dictionary. Null texts have null
scores and no matches, empty ones zeros; repeated rows are classified alike; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.shared import materialised
from quire.functions.spans import BOUND, inlined

TYPES = ("invoice", "contract", "report", "resume", "academic", "form", "letter", "legal", "financial", "medical", "other")
# Keywords of each class, their weights where above 1, and pattern rules.
INVOICE = ("invoice", "bill", "payment", "due date", "amount due", "total", "subtotal", "tax", "invoice number", "invoice #", "billing", "remit", "qty", "quantity", "unit price", "line item", "purchase order", "po #", "net", "gross", "vat", "gst", "discount", "balance due", "paid", "overdue")
CONTRACT = ("agreement", "contract", "party", "parties", "whereas", "hereby", "herein", "terms and conditions", "effective date", "termination", "liability", "indemnify", "confidential", "binding", "execute", "witness", "signature", "obligations", "breach", "governing law", "jurisdiction", "arbitration", "amendment", "addendum", "clause", "article", "section")
REPORT = ("report", "summary", "analysis", "findings", "conclusion", "recommendation", "executive summary", "introduction", "methodology", "results", "discussion", "appendix", "figure", "table", "chart", "graph", "data", "statistics", "overview", "assessment", "evaluation", "review", "quarterly", "annual")
RESUME = ("resume", "cv", "curriculum vitae", "experience", "education", "skills", "objective", "career", "employment", "work history", "qualifications", "certifications", "references", "achievements", "accomplishments", "professional", "bachelor", "master", "degree", "university", "college", "intern", "position", "responsibilities", "proficient")
ACADEMIC = ("abstract", "introduction", "methodology", "literature review", "hypothesis", "research", "study", "experiment", "results", "discussion", "conclusion", "references", "bibliography", "citation", "peer-reviewed", "journal", "thesis", "dissertation", "professor", "university", "doi", "issn", "isbn", "et al", "fig.", "vol.", "pp.", "ibid")
FORM = ("form", "please print", "please fill", "check box", "checkbox", "date:", "name:", "address:", "phone:", "email:", "signature:", "sign here", "required", "optional", "applicant", "application", "submit", "complete", "instructions", "field", "blank", "n/a", "yes/no", "select one")
LETTER = ("dear", "sincerely", "regards", "yours truly", "to whom it may concern", "respectfully", "thank you", "best regards", "kind regards", "cordially", "re:", "subject:", "attention:", "enclosed", "please find", "attached", "looking forward", "in response", "further to", "hope this finds")
LEGAL = ("court", "plaintiff", "defendant", "attorney", "counsel", "judge", "case number", "docket", "motion", "petition", "affidavit", "deposition", "testimony", "evidence", "statute", "ordinance", "regulation", "law", "legal", "verdict", "judgment", "appeal", "summons", "subpoena", "notary", "sworn", "certify", "jurisdiction")
FINANCIAL = ("financial", "statement", "balance sheet", "income statement", "cash flow", "assets", "liabilities", "equity", "revenue", "expenses", "profit", "loss", "dividend", "stock", "share", "investment", "portfolio", "interest", "principal", "amortization", "depreciation", "fiscal", "quarter", "audit", "gaap", "ifrs", "cpa", "accountant")
MEDICAL = ("patient", "diagnosis", "treatment", "prescription", "medication", "dose", "symptoms", "medical history", "allergies", "physician", "doctor", "nurse", "hospital", "clinic", "lab results", "blood", "test", "vital signs", "icd", "cpt", "hipaa", "prognosis", "chronic", "acute", "rx", "mg", "ml", "injection", "oral", "referral")
KEYWORDS = dict(zip(TYPES, (INVOICE, CONTRACT, REPORT, RESUME, ACADEMIC, FORM, LETTER, LEGAL, FINANCIAL, MEDICAL)))
THREE = ("invoice number", "invoice #", "curriculum vitae", "cv", "whereas", "hereby", "plaintiff", "defendant", "abstract", "balance sheet", "income statement", "diagnosis", "prescription")
TWO = ("invoice", "contract", "agreement", "resume", "report", "form", "dear", "sincerely", "court", "patient")
RULES = {
    "invoice": (25, (r"invoice\s*(?:#|number|no\.?)\s*[\w-]+", r"amount\s*due[:\s]+[\$\d]", r"payment\s+terms", r"bill\s+to[:\s]", r"remit(?:tance)?\s+(?:to|address)")),
    "contract": (25, (r"this\s+agreement\s+(?:is\s+)?(?:made|entered)", r"parties?\s+(?:hereby|agree)", r"in\s+witness\s+whereof", r"terms\s+and\s+conditions", r"effective\s+date[:\s]")),
    "resume": (25, (r"(?:work|professional)\s+experience", r"education[:\s]+(?:bachelor|master|ph\.?d|degree)", r"skills[:\s]+", r"(?:career\s+)?objective[:\s]", r"references\s+(?:available\s+)?(?:upon|on)\s+request")),
    "academic": (25, (r"abstract[:\s]+", r"(?:literature|related\s+work)\s+review", r"methodology[:\s]+", r"\[\d+\]\s+[A-Z]", r"et\s+al\.?\s*[\[(,]")),
    "form": (20, (r"please\s+(?:fill|complete|print)", r"\[\s*\]\s+", r"____+", r"(?:name|date|signature)[:\s]*_{2,}", r"required\s+field")),
    "letter": (20, (r"^dear\s+(?:mr|mrs|ms|dr|sir|madam)", r"(?:sincerely|regards|respectfully)[,\s]*$", r"to\s+whom\s+it\s+may\s+concern", r"enclosed\s+(?:please\s+find|you\s+will)")),
    "legal": (25, (r"(?:plaintiff|defendant)\s+v\.?\s", r"case\s+(?:#|no\.?|number)\s*[\w-]+", r"motion\s+(?:to|for)\s+", r"(?:hereby\s+)?order(?:ed)?\s+that", r"(?:court|tribunal)\s+of\s+")),
    "financial": (25, (r"(?:balance|income)\s+statement", r"(?:total\s+)?(?:assets|liabilities|equity)", r"(?:net\s+)?(?:income|profit|loss)", r"fiscal\s+(?:year|quarter)", r"(?:gaap|ifrs)\s+(?:compliant|standards)")),
    "medical": (25, (r"patient\s+(?:name|id|dob)", r"diagnosis[:\s]+", r"(?:medical|medication)\s+history", r"(?:dosage|dose)[:\s]+\d+\s*(?:mg|ml)", r"(?:bp|blood\s+pressure)[:\s]+\d+\/\d+")),
}
TOPICS = {
    "financial": ("revenue", "profit", "loss", "balance sheet", "income statement", "fiscal", "quarterly"),
    "contract": ("agreement", "party", "parties", "herein", "whereas", "obligation", "termination"),
    "academic": ("abstract", "methodology", "hypothesis", "conclusion", "references", "citation"),
    "legal": ("court", "plaintiff", "defendant", "jurisdiction", "statute", "legal", "law"),
    "technical": ("api", "documentation", "implementation", "architecture", "system", "configuration"),
    "report": ("report", "findings", "analysis", "recommendation", "executive summary"),
}
QUESTIONS = {
    "general": ("What is the main topic of this document?", "Summarize the key points in this document", "What are the main conclusions?", "List the important dates mentioned"),
    "report": ("What are the main findings of this report?", "Summarize the executive summary", "What recommendations are made?", "What data sources were used?"),
    "contract": ("What are the key terms and conditions?", "When does this contract expire?", "What are the payment terms?", "List all parties involved in this contract"),
    "academic": ("What is the main thesis or argument?", "Summarize the methodology used", "What are the key findings?", "List the main references cited"),
    "financial": ("What is the total revenue reported?", "Summarize the financial highlights", "What are the key financial metrics?", "Compare year-over-year performance"),
    "technical": ("What are the system requirements?", "Explain the architecture described", "List the main features or components", "What are the limitations mentioned?"),
    "legal": ("What are the key legal provisions?", "Summarize the rights and obligations", "Are there any penalties mentioned?", "What jurisdiction applies?"),
}
#: For each rule's patterns the words of which one stands in any match, in lower case.
RULE_WORDS = {
    "invoice": (("invoice",), ("amount",), ("payment",), ("bill",), ("remit",)),
    "contract": (("agreement",), ("part",), ("witness",), ("terms",), ("effective",)),
    "resume": (("experience",), ("education",), ("skills",), ("objective",), ("references",)),
    "academic": (("abstract",), ("review",), ("methodology",), ("[",), ("et",)),
    "form": (("please",), ("[",), ("____",), ("_",), ("required",)),
    "letter": (("dear",), ("sincerely", "regards", "respectfully"), ("whom",), ("enclosed",)),
    "legal": (("plaintiff", "defendant"), ("case",), ("motion",), ("order",), ("court", "tribunal")),
    "financial": (("statement",), ("assets", "liabilities", "equity"), ("income", "profit", "loss"), ("fiscal",), ("gaap", "ifrs")),
    "medical": (("patient",), ("diagnosis",), ("history",), ("dos",), ("bp", "pressure")),
}
LIST_LINE = r"(?i)^[\s]*[-*•]\s|^[\s]*\d+[.)]\s|^[\s]*[a-z][.)]\s"
HEADER_LINE = r"(?i)^[\s]*(?:[A-Z][A-Z\s]+$|(?:chapter|section|article)\s+\d+|^\d+\.\s+[A-Z])"
SIGNATURE = r"(?i)signature[\s:_]|sign here|authorized by|signed[\s:_]|witness[\s:_]|_+\s*date"
NUMBERED = r"(?m)^\s*\d+[.)]\s+"
FORM_FIELD = r"(?i)[a-z]+[\s]*[:_]+[\s]*_*\z|[\[\]]\s*[a-z]+|please (fill|print|complete)"
_MONTHS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: kind: (patterns, most matches taken of each).
FEATURES = {
    "dates": ((r"\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}", rf"(?i){_MONTHS}\s+\d{{1,2}},?\s+\d{{4}}", rf"(?i)\d{{1,2}}\s+{_MONTHS}\s+\d{{4}}"), 20),
    "amounts": ((r"(?i)[\$£€]\s*[\d,]+\.?\d*|\d+\.?\d*\s*(?:USD|EUR|GBP|CAD|AUD)",), 20),
    "emails": ((r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",), 10),
    "phones": ((r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",), 10),
    "organizations": ((BOUND + r"[A-Z][A-Z\s&]+(?:Inc|LLC|Corp|Ltd|Co|Company|Corporation|Limited)\.?" + BOUND,), 10),
    "persons": ((r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+\s+[A-Z][a-z]+",), 10),
    "addresses": ((r"(?i)\d+\s+[A-Za-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct)[,.\s]",), 5),
}


def weight(keyword: str) -> int:
    return 3 if keyword in THREE else 2 if keyword in TWO else 1


def keyword_pattern(keyword: str) -> str:
    return BOUND + "".join("\\" + c if c in r".*+?^${}()|[]\/#" else c for c in keyword.lower()) + BOUND


_TOKEN = re.compile("[a-z0-9_]+")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def _listed(custom: dict[str, tuple[str, ...]] | None) -> list[tuple[str, str]]:
    return [(c, k) for c, ks in KEYWORDS.items() for k in (*ks, *(custom or {}).get(c, ()))]


def keyword_counter(keywords: list[str]) -> Callable[[str], list[tuple[int, int]]]:
    """A function of a lower-cased text: (place in keywords, count) of those that occur, in their order.

    Bounds stand at both ends of a keyword, so one that is a word counts the text's equal words. Of others the first run
    of letters, digits and underscores is a whole word of any text that has it; only where it is, or where there is none, its places are looked at.
    """
    single, begun, always = defaultdict(list), defaultdict(list), []
    for i, k in enumerate(keywords):
        k = k.lower()
        rule = (i, k, k[0] in _WORD, k[-1] in _WORD)
        if _TOKEN.fullmatch(k):
            single[k].append(i)
        elif begins := _TOKEN.search(k):
            begun[begins[0]].append(rule)
        else:
            always.append(rule)
    wanted = single.keys() | begun.keys()

    def places(low: str, k: str, opens: bool, closes: bool) -> int:
        """The matches of keyword_pattern(k): a bound lies where a word character meets another or an end."""
        n, at = 0, low.find(k)
        while at >= 0:
            end = at + len(k)
            good = (low[at - 1 : at] in _WORD) != opens and (low[end : end + 1] in _WORD) != closes
            n += good
            at = low.find(k, end if good else at + 1)
        return n

    def count(low: str) -> list[tuple[int, int]]:
        words = Counter(filter(wanted.__contains__, _TOKEN.findall(low)))
        out = [(i, n) for w, n in words.items() for i in single.get(w, ())]
        rules = always + [r for w in words for r in begun.get(w, ())]
        out += [(i, n) for i, k, opens, closes in rules if k in low and (n := places(low, k, opens, closes))]
        return sorted(out)

    return count


def keyword_matches(docs: DataFrame, custom: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, category, keyword, count, weight of every keyword that occurs as whole words, whatever its case."""
    listed = _listed(custom)

    @F.pandas_udf("array<struct<i:int,n:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = keyword_counter([k for _, k in listed])
        for texts in batches:
            yield pd.Series([[{"i": i, "n": n} for i, n in count(t)] if t is not None else [] for t in texts])

    known = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("keyword"), F.lit(weight(k)).alias("weight")) for c, k in listed])
    rows = docs.select("doc_id", found(F.lower("text")).alias("found"))
    rows = inlined(rows, ["doc_id"], F.col("found"), "i").select("doc_id", F.get(known, F.col("i")).alias("k"), "n")
    return rows.select("doc_id", "k.category", "k.keyword", F.col("n").alias("count"), "k.weight")


def keyword_points(text: Column) -> Column:
    """array<int>: count x weight of the keywords of each class of KEYWORDS, in their order; zeros in null."""
    listed = _listed(None)
    place = {c: i for i, c in enumerate(KEYWORDS)}

    @F.arrow_udf("array<int>")
    def points(texts: pa.Array) -> pa.Array:
        count = keyword_counter([k for _, k in listed])
        rules = [(place[c], weight(k)) for c, k in listed]
        sums = np.zeros((len(texts), len(place)), np.int32)
        for row, t in enumerate(texts.to_pylist()):
            for i, n in count(t) if t is not None else ():
                at, w = rules[i]
                sums[row, at] += n * w
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(place)), pa.array(sums.ravel()))

    return points(F.lower(text))


def lines_of(text: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0)


def has_table_layout(text: Column) -> Column:
    """Two lines in a row with three tab or pipe cells each, or five of the first 50 with two wide gaps."""
    lines = F.split(text, "\n", -1)

    def pairs(mark: str) -> Column:
        cells = F.transform(lines, lambda x: F.size(F.split(x, mark, -1)) >= 3)
        return F.exists(F.arrays_zip(F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0))).alias("x"), F.slice(cells, 2, F.size(cells)).alias("y")), lambda p: p["x"] & p["y"])

    wide = F.size(F.filter(F.slice(lines, 1, 50), lambda x: F.regexp_count(x, F.lit(r"\s{3,}")) >= 2)) >= 5
    return F.when(text.contains("\t"), pairs("\t")).otherwise(False) | F.when(text.contains("|"), pairs(r"\|")).otherwise(False) | wide


def structure_features(docs: DataFrame) -> DataFrame:
    """doc_id and six layout flags, average_line_length, paragraph_count."""
    text = F.col("text")
    lines = docs.withColumn("lines", lines_of(text))
    mean = F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(F.size("lines"), F.lit(0))
    return lines.select(
        "doc_id",
        has_table_layout(text).alias("has_tables"),
        F.exists("lines", lambda x: x.rlike(LIST_LINE)).alias("has_lists"),
        F.exists("lines", lambda x: x.rlike(HEADER_LINE)).alias("has_sections"),
        text.rlike(SIGNATURE).alias("has_signature_area"),
        text.rlike(NUMBERED).alias("has_numbered_items"),
        text.rlike(FORM_FIELD).alias("has_form_fields"),
        F.coalesce(F.floor(mean + 0.5), F.lit(0)).cast("int").alias("average_line_length"),
        F.size(F.filter(F.split(text, r"\n\s*\n", -1), lambda x: F.length(F.trim(x)) > 0)).alias("paragraph_count"),
    )


#: Classes of bytes: 1 A-Z, 2 a-z, 3 digits, 4 white space, 0 all others, those of longer characters among them.
_CLASS = np.zeros(256, np.uint8)
for _n, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32)), 1):
    _CLASS[list(_bytes)] = _n


def class_counts(text: Column) -> Column:
    """How many A-Z, a-z, digits and words (runs without white space) a text holds, counted over the bytes of all texts at once; null in null."""

    @F.arrow_udf("struct<upper:int,lower:int,digits:int,words:int>")
    def counts(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        kinds = _CLASS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        begins = kinds != 4
        begins[1:] &= (kinds[:-1] == 4)
        # A text's first character begins a word whatever stands before it.
        starts = ends[:-1][ends[:-1] < ends[1:]]
        begins[starts] = kinds[starts] != 4

        def counted(marks: np.ndarray) -> pa.Array:
            sums = np.concatenate([[0], np.cumsum(marks)])
            return pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int32))

        names = ["upper", "lower", "digits", "words"]
        return pa.StructArray.from_arrays([*[counted(kinds == k) for k in (1, 2, 3)], counted(begins)], names, mask=texts.is_null())

    return counts(text)


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, chars, words, lines, words_per_line (1 decimal), uppercase_ratio and numeric_ratio (2)."""
    docs = docs.select("doc_id", "text", class_counts(F.col("text")).alias("c"))
    text = F.col("text")
    upper, lower, digits, words = (F.col(f"c.{n}") for n in ("upper", "lower", "digits", "words"))
    lines = F.size(lines_of(text))
    near = lambda x, n: F.floor(x * n + 0.5) / n
    ratio = lambda a, b: F.when(b > 0, near(a / b, 100)).otherwise(0.0)
    return docs.select("doc_id", F.length(text).alias("chars"), words.alias("words"), lines.alias("lines"), F.when(lines > 0, near(words / lines, 10)).otherwise(0.0).alias("words_per_line"), ratio(upper, upper + lower).alias("uppercase_ratio"), ratio(digits, upper + lower + digits).alias("numeric_ratio"))


def feature_entities(text: Column, kind: str) -> Column:
    patterns, most = FEATURES[kind]
    return F.array_distinct(F.concat(*[F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, most) for p in patterns]))


def extract_feature_entities(docs: DataFrame) -> DataFrame:
    """doc_id and, for each light kind, its distinct matches in order, bounded in number by pattern."""
    return docs.select("doc_id", *[feature_entities(F.col("text"), k).alias(k) for k in FEATURES])


def type_scores(docs: DataFrame) -> DataFrame:
    """doc_id and the classes ranked by raw score; page_count (1 where missing) and title (optional) are used."""
    if "page_count" not in docs.columns:
        docs = docs.withColumn("page_count", F.lit(1))
    title = F.lower(F.coalesce("title", F.lit(""))) if "title" in docs.columns else None
    keys = ["doc_id", "text", "page_count", *(["title"] if title is not None else [])]
    rows = docs.select(*keys, keyword_points(F.col("text")).alias("points"), class_counts(F.col("text")).alias("c"), F.size(feature_entities(F.col("text"), "amounts")).alias("amounts"), F.size(feature_entities(F.col("text"), "emails")).alias("emails"))
    text = F.col("text")
    lines = lines_of(text)
    rows = rows.withColumns({
        "has_tables": has_table_layout(text), "has_lists": F.exists(lines, lambda x: x.rlike(LIST_LINE)), "has_sections": F.exists(lines, lambda x: x.rlike(HEADER_LINE)),
        "signed": text.rlike(SIGNATURE), "numbered": text.rlike(NUMBERED), "fields": text.rlike(FORM_FIELD),
        **{n: F.col(f"c.{n}") for n in ("upper", "lower", "digits", "words")},
    })
    two = lambda a, b: F.when(b > 0, F.floor(a / b * 100 + 0.5) / 100).otherwise(0.0)
    rows = rows.withColumns({"shout": two(F.col("upper"), F.col("upper") + F.col("lower")) > 0.3, "numeric": two(F.col("digits"), F.col("upper") + F.col("lower") + F.col("digits")) > 0.1})
    # Fixed values: (condition, points by class).
    bonuses = (
        ("signed", {"contract": 15, "letter": 10, "form": 10, "legal": 10}),
        ("fields", {"form": 30}),
        ("has_tables", {"invoice": 15, "financial": 15, "report": 10}),
        ("has_sections", {"report": 10, "academic": 15, "contract": 10}),
        ("numbered and has_lists", {"contract": 10, "legal": 10}),
        ("amounts >= 3", {"invoice": 20, "financial": 15}),
        ("emails >= 1 and words < 1000", {"letter": 10, "resume": 10}),
        ("shout", {"form": 10}),
        ("numeric", {"invoice": 10, "financial": 10}),
        ("page_count = 1", {"letter": 5, "invoice": 5, "form": 5}),
        ("page_count >= 10", {"report": 10, "academic": 10, "contract": 5}),
    )
    out = []
    for t in TYPES:
        score = F.lit(0)
        if t in KEYWORDS:
            score = F.get("points", F.lit(list(KEYWORDS).index(t))) * 10
        for condition, points in bonuses:
            if t in points:
                score = score + F.when(F.expr(condition), points[t]).otherwise(0)
        if title is not None and t != "other":
            score = score + F.when(title.contains(t), 25).otherwise(0)
        out.append(score.cast("int"))
    return _ranked(rows, F.array(*out))


def _ranked(rows: DataFrame, scores: Column) -> DataFrame:
    """doc_id and ranked: (less = -score, i = place in TYPES), best first, the earlier class first of equal ones."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("less"), i.alias("i")))
    return rows.select("doc_id", F.array_sort(pairs).alias("ranked"))


def _type(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, TYPES)), i)


def classify_documents(docs: DataFrame, alternative_threshold: int = 20, max_alternatives: int = 3) -> DataFrame:
    """doc_id, type, confidence, level, alternatives (type:confidence), raw_score, margin.

    Scores are scaled to a largest of 100; of equal classes the first in order wins; below 15 it is other.
    """
    best = F.get("ranked", F.lit(0))
    rows = type_scores(docs).select("doc_id", "ranked", (-best["less"]).alias("raw_score"), F.when(best["less"] < 0, best["i"]).otherwise(TYPES.index("other")).alias("best"))
    scaled = lambda e: F.when(F.col("raw_score") > 0, F.floor(-e["less"] / F.col("raw_score") * 100 + 0.5)).otherwise(0).cast("int")
    others = F.slice(F.filter("ranked", lambda e: (e["i"] != F.col("best")) & (e["i"] != TYPES.index("other"))), 1, max_alternatives)
    kept = F.filter(others, lambda e: scaled(e) >= alternative_threshold)
    names = F.array_join(F.transform(kept, lambda e: F.concat_ws(":", _type(e["i"]), scaled(e))), ",")
    # Scaled to the largest, the confidence is always 100, and so the level high.
    return rows.select("doc_id", _type(F.col("best")).alias("type"), F.lit(100).alias("confidence"), F.lit("high").alias("level"), names.alias("alternatives"), "raw_score", (F.col("raw_score") + F.get("ranked", F.lit(1))["less"]).alias("margin"))


def rule_points(text: Column, kind: str) -> Column:
    """Weight x min(patterns that match, 3) of a class's rules: a substring test stands before each pattern."""
    if kind not in RULES:
        return F.lit(0)
    low = F.lower(text)
    weight_of, patterns = RULES[kind]
    hits = [(reduce(lambda a, b: a | b, [low.contains(w) for w in words]) & text.rlike("(?im)" + p)).cast("int") for p, words in zip(patterns, RULE_WORDS[kind])]
    return weight_of * F.least(reduce(lambda a, b: a + b, hits), F.lit(3))


def pattern_scores(docs: DataFrame) -> DataFrame:
    """doc_id and, for each class with rules, weight x min(patterns that match, 3)."""
    return docs.select("doc_id", *[rule_points(F.col("text"), t).alias(t) for t in TYPES])


def quick_classify(docs: DataFrame) -> DataFrame:
    """doc_id, type, confidence = min(100, best score / 2); below 15 it is other with the rest of 100."""
    rows = docs.select("doc_id", "text", keyword_points(F.col("text")).alias("points"))

    def points(t: str) -> Column:
        return F.get("points", F.lit(list(KEYWORDS).index(t))) * 3 + rule_points(F.col("text"), t) if t in KEYWORDS else F.lit(0)

    best = F.get("ranked", F.lit(0))
    scored = _ranked(rows, F.array(*[points(t).cast("int") for t in TYPES])).select("doc_id", F.floor(-best["less"] / 2 + 0.5).cast("int").alias("half"), best["i"].alias("i"))
    sure = F.least(F.lit(100), F.col("half"))
    return scored.select("doc_id", F.when(sure < 15, "other").otherwise(_type(F.col("i"))).alias("type"), F.when(sure < 15, 100 - sure).otherwise(sure).alias("confidence"))


def classify_enhanced(docs: DataFrame, ml_scores: DataFrame, ml_weight: float = 0.3) -> DataFrame:
    """doc_id, type, confidence, base_type, used_ml: the base class, blended with a model's (doc_id, ml_type, ml_confidence) where there is one.

    The model's class is taken if it is sure (over 70) and its score by patterns and keywords is over half of the base class's.
    """
    base = materialised(classify_documents(docs).select("doc_id", F.col("type").alias("base_type"), F.col("confidence").alias("base")), "classes")
    points = materialised(combined_scores(docs), "scores")
    by_type = F.create_map(*[x for t in TYPES for x in (F.lit(t), F.col(t))])
    points = points.select("doc_id", by_type.alias("points"))
    rows = base.join(points, "doc_id").join(ml_scores.select("doc_id", "ml_type", "ml_confidence"), "doc_id", "left")
    of = lambda c: F.coalesce(F.try_element_at("points", F.col(c)), F.lit(0))
    switch = F.coalesce((F.col("ml_confidence") > 70) & (F.col("ml_type") != F.col("base_type")) & (of("ml_type") > of("base_type") * 0.5), F.lit(False))
    used = F.col("ml_type").isNotNull()
    blend = F.floor(F.col("base") * (1 - ml_weight) + F.col("ml_confidence") * ml_weight + 0.5).cast("int")
    return rows.select("doc_id", F.when(switch, F.col("ml_type")).otherwise(F.col("base_type")).alias("type"), F.when(used, blend).otherwise(F.col("base")).alias("confidence"), "base_type", used.alias("used_ml"))


def combined_scores(docs: DataFrame) -> DataFrame:
    """doc_id and, for each class, its pattern score and 5 x count x weight of its keywords."""
    rows = docs.select("doc_id", keyword_points(F.col("text")).alias("points"), *[rule_points(F.col("text"), t).alias(t) for t in TYPES])
    return rows.select("doc_id", *[(F.col(t) + (F.get("points", F.lit(list(KEYWORDS).index(t))) * 5 if t in KEYWORDS else F.lit(0))).cast("int").alias(t) for t in TYPES])


def classification_summary(results: DataFrame) -> DataFrame:
    """type, documents for every class (zeros kept), and over all: mean_confidence (rounded), high, low.

    results (type, confidence, level); they are read twice, so pass them stored.
    """
    spark = results.sparkSession
    kinds = spark.createDataFrame([(t,) for t in TYPES], "type string")
    by_type = results.groupBy("type").agg(F.count(F.lit(1)).alias("documents"))
    whole = results.agg(F.coalesce(F.floor(F.avg("confidence") + 0.5), F.lit(0)).cast("int").alias("mean_confidence"), F.count_if(F.col("level") == "high").alias("high"), F.count_if(F.col("level") == "low").alias("low"))
    # Both sides have at most a row for each class.
    return F.broadcast(kinds).join(by_type, "type", "left").fillna(0, ["documents"]).join(F.broadcast(whole), F.lit(True))


def classification_rollup(results: DataFrame, source: str) -> DataFrame:
    """The source column, type, documents, mean_confidence: by source and type, by source, and over all (nulls)."""
    return results.rollup(source, "type").agg(F.count(F.lit(1)).alias("documents"), F.floor(F.avg("confidence") + 0.5).cast("int").alias("mean_confidence"))


def chat_topic(text: Column) -> Column:
    """The first topic of whose words the text holds two; general if there is none."""
    low = F.lower(text)
    hits = lambda words: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])
    out = None
    for topic, words in TOPICS.items():
        test = hits(words) >= 2
        out = F.when(test, topic) if out is None else out.when(test, topic)
    return out.otherwise("general")


def suggest_questions(docs: DataFrame) -> DataFrame:
    """doc_id, topic, place (from 1), question: the questions of each document's topic."""
    rows = docs.select("doc_id", chat_topic(F.col("text")).alias("topic"))
    asked = rows.sparkSession.createDataFrame([(t, i + 1, q) for t, qs in QUESTIONS.items() for i, q in enumerate(qs)], "topic string, place int, question string")
    # A fixed table of four questions for each topic.
    return rows.join(F.broadcast(asked), "topic").select("doc_id", "topic", "place", "question")
