"""Form fields out of positioned text items (doc_id, page, item_idx, str, x, y, width, height) and page widths.

Work is keyed by page, names by document. Null and blank strings are no labels and no fields; repeated rows are items of
their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quire.functions.folds import fold_rows, together, whole_groups

from .layout import PAGE

# Label patterns of each field type, in the order in which they are tried, and marks of required fields.
_END = r"\s*[:.]?$"
LABELS = {
    "text": ("name", r"full\s*name", r"first\s*name", r"last\s*name", "address", "city", "state", r"zip\s*(?:code)?", "country", "company", "organization", "title", "position", "department", "description", "comments?", "notes?", "other"),
    "email": (r"e?-?mail\s*(?:address)?", "email"),
    "phone": (r"(?:phone|tel(?:ephone)?|mobile|cell)\s*(?:number|#|no\.?)?", r"fax\s*(?:number|#|no\.?)?", r"contact\s*(?:number|#|no\.?)?"),
    "date": ("date", r"(?:birth|dob)\s*(?:date)?", r"date\s*of\s*birth", r"start\s*date", r"end\s*date", r"effective\s*date", r"expir(?:y|ation)\s*(?:date)?", r"(?:mm|dd|yyyy|month|day|year)\s*[\/\-]?\s*(?:mm|dd|yyyy|month|day|year)?"),
    "number": (r"(?:amount|quantity|qty|number|#|no\.?)", "(?:age|weight|height)", r"(?:ssn|social\s*security)\s*(?:number|#|no\.?)?", r"(?:id|identification)\s*(?:number|#|no\.?)?"),
    "checkbox": (r"(?:i\s*)?agree", "(?:yes|no)", r"check\s*(?:here|box|if)", "accept"),
    "dropdown": (r"select\s*(?:one)?", "choose", "(?:country|state|province)"),
    "signature": ("(?:sign(?:ature)?|authorized)", r"(?:customer|client|applicant|employee)\s*signature", r"sign\s*(?:here|below)", "x"),
    "textarea": (r"(?:additional\s*)?(?:comments?|notes?|remarks?|description|details?)", "(?:explain|elaborate)"),
}
HINTS = ((r"@", "email", 85), (r"\([0-9]{3}\)|[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}", "phone", 85), (r"[0-9]{1,2}[\/\-][0-9]{1,2}[\/\-][0-9]{2,4}", "date", 85), (r"^\$?[0-9]+[.,]?[0-9]*$", "number", 75))
REQUIRED = r"(?i)\*\s*$|required|mandatory"
LINE_FIELD = r"\A[_\-]{5,}\z"
BOX_FIELD = "\\A(?:\\[[\\s✓✗xX]?\\]|\\(\\s*\\)|[☐☑☒□■◻◼])\\z"
NO_LABEL = r"\A[_\-\[\]\(\)]+\z"
EMAIL_RULE, PHONE_RULE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", r"^[\d\s\-\(\)\+]+$"
RADIUS, FREE_WIDTH, WIDEST, BAND, GROUP_GAP = 150.0, 72.0, 240.0, 20.0, 100.0


def label_pattern(kind: str) -> str:
    """One expression for all label patterns of a type."""
    return "(?i)^(?:" + "|".join(p if (kind, p) != ("signature", "x") else r"x\s*$" for p in LABELS[kind]) + ")" + _END


def suggest_field_type(label: Column) -> Column:
    """struct(type, confidence): 95 for a known label, 75 to 85 for a value's shape, else text with 50."""
    text = F.trim(label)
    rules = [(text.rlike(label_pattern(k)), k, 95) for k in LABELS] + [(text.rlike(p), k, n) for p, k, n in HINTS]
    # One choice for both fields: with one each the patterns are tried twice, and again wherever a field is used.
    made = lambda kind, sure: F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    return reduce(lambda c, r: c.when(r[0], made(*r[1:])), rules, F.when(F.lit(False), made("text", 50))).otherwise(made("text", 50))


def field_name(label: Column) -> Column:
    """A slug of at most 50 characters; "field" where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, 50), F.lit("")), F.lit("field"))


def _candidate() -> Column:
    """struct(family, x, y, width, height) of an item that is a place for a field: 0 lines, 1 boxes, 2 labels with room to their right; null for others."""
    text = F.trim("str")
    right = F.col("x") + F.col("width") + 8
    free = F.col("page_width") - right - 20
    place = lambda family, x, y, width, height: F.struct(F.lit(family).alias("family"), x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))
    out = F.when(text.rlike(LINE_FIELD), place(0, F.col("x"), F.col("y") - 5, F.col("width"), F.lit(20.0)))
    out = out.when(text.rlike(BOX_FIELD), place(1, F.col("x"), F.col("y"), F.greatest("width", F.lit(15.0)), F.greatest("height", F.lit(15.0))))
    # The tests that cost most come last.
    named = F.col("str").rlike(r"[:*]\s*$") & (free >= FREE_WIDTH) & (F.length(_label(F.col("str"))) >= 2)
    named = F.when(named, suggest_field_type(_label(F.col("str")))["confidence"] > 50).otherwise(False)
    return out.when(named, place(2, right, F.col("y") - 4, F.least(F.lit(WIDEST), free), F.greatest(F.lit(20.0), F.col("height") + 8)))


def field_candidates(items: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, family (0 lines, 1 boxes, 2 labels), item_idx, str, x, y, width, height of places for a field, in one pass over the items.

    pages (doc_id, page, page_width) tells how much room a label has to its right; a page without a row has none.
    """
    rows = items.join(pages.select(*PAGE, "page_width"), PAGE, "left").withColumn("c", _candidate()).where("c is not null")
    return rows.select(*PAGE, "c.family", "item_idx", "str", "c.x", "c.y", "c.width", "c.height")


def _label(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[:*\s]+$", ""))


_SPOT = ["x", "y", "width", "height"]


def _is_label() -> Column:
    return (F.length(F.trim("str")) > 1) & ~F.trim("str").rlike(NO_LABEL)


def _nearest(page: pa.Table) -> list[str | None]:
    """For each candidate of a page (kind 0, first) the text of its label (kind 1), by cells of RADIUS points: none that is near enough lies beyond the next cell."""
    kind = page.column("kind").to_numpy()
    n = int((kind == 0).sum())
    x, y, w, h = (page.column(c).to_numpy(zero_copy_only=False) for c in _SPOT)
    cell_x, cell_y = np.floor((x + w / 2) / RADIUS), np.floor((y + h / 2) / RADIUS)
    cells: dict[tuple, list[int]] = {}
    index = page.column("item_idx").to_numpy(zero_copy_only=False)
    good = ~np.isnan(x + y + w + h)
    for i in (n + np.argsort(index[n:], kind="stable")).tolist():
        if good[i]:
            cells.setdefault((cell_x[i], cell_y[i]), []).append(i)
    held = {k: np.array(v) for k, v in cells.items()}
    text, out = page.column("text"), []
    for i in range(n):
        near = [held[k] for a in (-1, 0, 1) for b in (-1, 0, 1) if (k := (cell_x[i] + a, cell_y[i] + b)) in held] if good[i] and page.column("family")[i].as_py() != 2 else []
        if not near:
            out.append(None)
            continue
        j = np.concatenate(near)
        left = x[j] + w[j] < x[i]
        beside = left & (y[j] < y[i] + h[i]) & (y[j] + h[j] > y[i])
        above = (y[j] > y[i] + h[i]) & (np.abs(x[j] - x[i]) < w[i])
        apart = np.sqrt((x[j] + w[j] / 2 - x[i] - w[i] / 2) ** 2 + (y[j] + h[j] / 2 - y[i] - h[i] / 2) ** 2)
        j, left = (v[(apart < RADIUS) & (beside | above)] for v in (j, left))
        out.append(text[int(j[np.lexsort((index[j], ~left))[0]])].as_py() if len(j) else None)
    return out


def _labelled(rows: DataFrame) -> DataFrame:
    """The candidates among rows (doc_id, page, kind, family, item_idx, x, y, width, height, text) with label_text. A page's candidates and labels meet in one task, which holds the page."""
    dealt = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "kind", "family", "item_idx")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for page in whole_groups(batches, PAGE):
            n = int((page.column("kind").to_numpy() == 0).sum())
            if n:
                yield page.slice(0, n).drop_columns(["kind"]).append_column("label_text", pa.array(_nearest(page), pa.string()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return together(met(batches))

    out = StructType([*[f for f in rows.schema.fields if f.name != "kind"], StructField("label_text", StringType())])
    return dealt.mapInArrow(meet, out)


def nearby_labels(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, page, family, item_idx, label_text: the label of each candidate, null where none is near. Label candidates (family 2) need none.

    Near: centres under 150 apart, and left of the place at its height, or above it. Left ones come first, then by item_idx. A range join by
    cells of 150 points: a candidate meets only the labels of its own and the eight cells around it.
    """
    places = candidates.select(*PAGE, F.lit(0).alias("kind"), "family", F.col("item_idx").cast("bigint").alias("item_idx"), *[F.col(c).cast("double").alias(c) for c in _SPOT], F.lit(None).cast("string").alias("text")).distinct()
    labels = items.where(_is_label()).select(*PAGE, F.lit(1).alias("kind"), F.lit(-1).alias("family"), F.col("item_idx").cast("bigint").alias("item_idx"), *[F.col(c).cast("double").alias(c) for c in _SPOT], F.trim("str").alias("text"))
    kind = candidates.schema["item_idx"].dataType
    return _labelled(places.unionByName(labels)).select(*PAGE, "family", F.col("item_idx").cast(kind).alias("item_idx"), "label_text")


def _free_places(page: pa.Table) -> list[tuple[int, int]]:
    """Of a page's fields, in their order, those that overlap none taken before by over half of the smaller, each with its row of BAND points from the top."""
    boxes = list(zip(*[page.column(c).to_pylist() for c in _SPOT]))
    cells: dict[tuple, list[int]] = {}
    taken = []
    for i, (x, y, w, h) in enumerate(boxes):
        spots = [(a, b) for a in range(int(x // RADIUS), int((x + w) // RADIUS) + 1) for b in range(int(y // RADIUS), int((y + h) // RADIUS) + 1)]
        for j in {j for s in spots for j in cells.get(s, ())}:
            a, b, c, d = boxes[j]
            wide, high = min(x + w, a + c) - max(x, a), min(y + h, b + d) - max(y, b)
            if wide > 0 and high > 0 and wide * high > 0.5 * min(w * h, c * d):
                break
        else:
            taken.append(i)
            for s in spots:
                cells.setdefault(s, []).append(i)
    row, anchor, out = -1, None, []
    for i in sorted(taken, key=lambda i: -boxes[i][1]):
        if anchor is None or abs(boxes[i][1] - anchor) > BAND:
            row, anchor = row + 1, boxes[i][1]
        out.append((i, row))
    return out


def detect_form_fields(items: DataFrame, pages: DataFrame, sensitivity: int = 50, min_confidence: float = 30.0, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, page, seq (0-based in the document by page, height in bands of 20, x), type, label, x, y, width, height, confidence, name, required, placeholder, rule.

    Fields are taken in order of family and item_idx; one that overlaps a field already taken by over half of the smaller is
    dropped. item_idx tells a page's items apart; items without a place are left out. Items are read once: a page's candidates meet its labels in one task, and its
    fields each other in another, both by cells of 150 points, so the work grows with the items and their neighbours. A task holds one page.
    """
    meeting = lambda kind, family, spot, text: F.struct(F.lit(kind).alias("kind"), family.alias("family"), *[c.cast("double").alias(n) for n, c in zip(_SPOT, spot)], text.alias("text"))
    own_place = [F.col("x"), F.col("y"), F.col("width"), F.col("height")]
    rows = items.join(pages.select(*PAGE, "page_width"), PAGE, "left").withColumn("c", _candidate())
    place = F.when(F.col("c").isNotNull(), meeting(0, F.col("c.family"), [F.col(f"c.{n}") for n in _SPOT], F.col("str")))
    label = F.when(_is_label(), meeting(1, F.lit(-1), own_place, F.trim("str")))
    rows = rows.select(*PAGE, F.col("item_idx").cast("bigint").alias("item_idx"), F.explode(F.array_compact(F.array(place, label))).alias("m")).select(*PAGE, "m.kind", "m.family", "item_idx", *[f"m.{n}" for n in _SPOT], "m.text")
    rows = _labelled(rows).withColumnRenamed("text", "str").where(" and ".join(f"{c} is not null" for c in _SPOT))
    own = F.col("family") == 2
    raw = F.nullif(F.when(own, _label(F.col("str"))).otherwise(_label(F.col("label_text"))), F.lit(""))
    label = F.coalesce(F.col("raw"), F.lit("Unlabeled field"))
    rows = rows.withColumn("raw", raw).withColumn("hint", suggest_field_type(label)).withColumn("label", label)
    kind = F.when(F.col("family") == 1, "checkbox").otherwise(F.col("hint.type"))
    sure = F.when(F.col("family") == 1, 90).otherwise(F.col("hint.confidence"))
    score = F.when(own, F.least(F.lit(92.0), 60 + (sure - 50) * 0.5 + (sensitivity - 50) * 0.1)).otherwise(F.least(F.lit(98.0), 58 + F.when(F.col("raw").isNull(), 0).otherwise(22) + (sure - 50) * 0.2 + (sensitivity - 50) * 0.2))
    said = F.when(own, F.col("str")).otherwise(F.col("label_text"))
    number = F.regexp_replace(F.col("x").cast("string"), r"\.0$", "")
    rows = rows.select(
        *PAGE, "family", "item_idx", kind.alias("type"), "label", "x", "y", "width", "height", score.cast("double").alias("confidence"),
        field_name(F.coalesce(F.col("raw"), F.concat_ws("_", kind, F.col("page"), number))).alias("name"),
        (F.col("raw").isNotNull() & F.coalesce(said.rlike(REQUIRED), F.lit(False))).alias("required"),
        F.concat(F.lit("Enter "), F.lower("raw")).alias("placeholder"),
        F.when(~own, F.when(kind == "email", EMAIL_RULE).when(kind == "phone", PHONE_RULE)).alias("rule"),
    ).where(F.col("confidence") >= min_confidence)
    if kinds is not None:
        rows = rows.where(F.col("type").isin(*kinds))

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for page in whole_groups(batches, PAGE):
            at, row = zip(*_free_places(page))
            yield page.take(list(at)).append_column("row", pa.array(row, pa.int32()))

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return together(freed(batches))

    dealt = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "family", "item_idx")
    rows = dealt.mapInArrow(free, StructType([*rows.schema.fields, StructField("row", IntegerType())]))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "row", "x", "family", "item_idx")) - 1
    return rows.withColumn("seq", seq).drop("family", "item_idx", "row")


def form_groups(fields: DataFrame) -> DataFrame:
    """doc_id, section (1-based in the document), page, fields, first_seq, x, y, width, height: runs of fields under 100 apart in height; single ones are no group."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    new = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)) >= GROUP_GAP, F.lit(True)).cast("int")
    runs = fields.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = runs.groupBy(*PAGE, "run").agg(F.count(F.lit(1)).alias("fields"), F.min("seq").alias("first_seq"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("top")).where("fields > 1")
    section = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "run"))
    return groups.select("doc_id", section.alias("section"), "page", "fields", "first_seq", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("top") - F.col("y")).alias("height"))


def form_structure(fields: DataFrame) -> DataFrame:
    """doc_id, fields, mean_confidence, is_form (three fields, mean 40), form_confidence, title: the topmost label of page 1 unless it is Name."""
    top = F.max_by(F.when(F.col("page") == 1, F.col("label")), F.when(F.col("page") == 1, F.struct("y", (-F.col("seq")).alias("s"))))
    by_doc = fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"), F.avg("confidence").alias("mean_confidence"), top.alias("top"))
    return by_doc.select("doc_id", "fields", "mean_confidence", ((F.col("fields") >= 3) & (F.col("mean_confidence") >= 40)).alias("is_form"), F.least(F.lit(100.0), F.col("fields") * 5 + F.col("mean_confidence")).alias("form_confidence"), F.nullif(F.col("top"), F.lit("Name")).alias("title"))


def form_labels(fields: DataFrame) -> DataFrame:
    """doc_id, page, seq, text, x, y, width, height: where a field's label is taken to stand."""
    return fields.select(*PAGE, "seq", F.col("label").alias("text"), (F.col("x") - 100).alias("x"), "y", F.lit(95.0).alias("width"), "height")


def unique_field_names(fields: DataFrame) -> DataFrame:
    """The fields (doc_id, seq, name, ...) with unique_name: repeats in a document get _2, _3, ..., passing over names in use."""

    def start():
        used, last = set(), {}

        def step(name: str) -> tuple[str]:
            out, n = name, last.get(name, 1)
            while out in used:
                n += 1
                out = f"{name}_{n}"
            last[name] = n
            used.add(out)
            return (out,)

        return step

    return fold_rows(fields, ["doc_id"], ["seq"], ["name"], "unique_name string", start)
