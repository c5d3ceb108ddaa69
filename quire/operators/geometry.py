"""Page boxes, sizes, recognised words, redactions and file marks: arithmetic on one row a page, word or file.

Null sizes give null boxes; repeated rows are computed alike; empty tables give no rows; other columns than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Paper sizes and units in points.
PAPER = {"A3": (841.89, 1190.55), "A4": (595.28, 841.89), "A5": (419.53, 595.28), "Letter": (612.0, 792.0), "Legal": (612.0, 1008.0), "Tabloid": (792.0, 1224.0)}
UNITS = {"pt": 1.0, "mm": 72 / 25.4, "in": 72.0, "px": 72 / 96}
OCR_MS_PER_MEGAPIXEL = 1500
WORD_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def header_footer_text(manifest: DataFrame, text: str, odd: str | None = None, even: str | None = None, day: str = "", start_page: int = 1, end_page: int | None = None) -> DataFrame:
    """doc_id, page, text of pages in range: {page}, {total} and {date} filled in; odd and even take the place of text where given."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("string")
    template = F.when(F.col("page") % 2 == 1, F.lit(odd or text)).otherwise(F.lit(even or text))
    filled = F.replace(F.replace(F.replace(template, F.lit("{page}"), F.col("page").cast("string")), F.lit("{total}"), total), F.lit("{date}"), F.lit(day))
    rows = manifest.select("doc_id", "page", filled.alias("text")).where(F.col("page") >= start_page)
    return rows if end_page is None else rows.where(F.col("page") <= end_page)


def to_points(value: Column, unit: str) -> Column:
    return value * UNITS[unit]


def from_points(value: Column, unit: str) -> Column:
    return value / UNITS[unit]


def normalize_rotation(angle: Column) -> Column:
    """0, 90, 180 or 270: the nearest quarter turn."""
    turned = F.pmod(angle, F.lit(360))
    return (F.floor(turned / 90 + 0.5) * 90 % 360).cast("int")


def crop_percent(width: Column, height: Column, left: float, right: float, top: float, bottom: float) -> Column:
    """struct(x, y, width, height) of the page without the given hundredths of each side."""
    x, y = width * (left / 100), height * (bottom / 100)
    return F.struct(x.alias("x"), y.alias("y"), (width - x - width * (right / 100)).alias("width"), (height - y - height * (top / 100)).alias("height"))


def margin_box(width: Column, height: Column, left: float, right: float, top: float, bottom: float) -> Column:
    """struct(x, y, width, height) of the page without the margins, in points."""
    return F.struct(F.lit(left).alias("x"), F.lit(bottom).alias("y"), (width - left - right).alias("width"), (height - top - bottom).alias("height"))


def resized(width: Column, height: Column, to_width: float, to_height: float, keep_aspect: bool = True, center: bool = True) -> Column:
    """struct(width, height, scale, dx, dy): the new size, the content's scale and its shift to the middle."""
    wide = width / height > to_width / to_height
    w = F.when(wide, to_width).otherwise(to_height * (width / height)) if keep_aspect else F.lit(to_width)
    h = F.when(wide, to_width / (width / height)).otherwise(to_height) if keep_aspect else F.lit(to_height)
    scale = F.least(w / width, h / height)
    shift = lambda a, b: (a - b * scale) / 2 if center else F.lit(0.0)
    return F.struct(w.alias("width"), h.alias("height"), scale.alias("scale"), shift(w, width).alias("dx"), shift(h, height).alias("dy"))


def paper_size(name: str, landscape: bool = False) -> tuple[float, float]:
    w, h = PAPER[name]
    return (h, w) if landscape else (w, h)


def page_geometry(pages: DataFrame, paper: str = "A4", landscape: bool = False, crop: tuple[float, float, float, float] = (0, 0, 0, 0), margins: tuple[float, float, float, float] = (0, 0, 0, 0), turn: int = 0) -> DataFrame:
    """doc_id, page, crop, inner, sized, rotation of (doc_id, page, width, height, rotation): the boxes after cropping (left, right, top, bottom in hundredths), margins (in points) and resizing, and the rotation after a turn."""
    w, h = F.col("width"), F.col("height")
    return pages.select("doc_id", "page", crop_percent(w, h, *crop).alias("crop"), margin_box(w, h, *margins).alias("inner"), resized(w, h, *paper_size(paper, landscape)).alias("sized"), normalize_rotation(F.coalesce("rotation", F.lit(0)) + normalize_rotation(F.lit(turn))).alias("rotation"))


def uniform_trim(boxes: DataFrame) -> DataFrame:
    """doc_id, page, x, y, width, height: boxes (page_width, page_height, x, y, width, height) widened to the smallest margins of their document; a single page keeps its own."""
    common = boxes.groupBy("doc_id").agg(F.min("x").alias("left"), F.min("y").alias("bottom"), F.min(F.col("page_width") - F.col("x") - F.col("width")).alias("right"), F.min(F.col("page_height") - F.col("y") - F.col("height")).alias("top"))
    rows = boxes.join(common, "doc_id")
    return rows.select("doc_id", "page", F.col("left").alias("x"), F.col("bottom").alias("y"), (F.col("page_width") - F.col("left") - F.col("right")).alias("width"), (F.col("page_height") - F.col("bottom") - F.col("top")).alias("height"))


def compression_estimates(files: DataFrame) -> DataFrame:
    """doc_id, has_images (over 100,000 bytes a page), estimated_savings: 20 for images, 10 for over 50 pages, 50 at most. Files without pages have no estimate."""
    images = F.coalesce(F.col("byte_size") / F.nullif(F.col("page_count"), F.lit(0)) > 100_000, F.lit(False))
    return files.select("doc_id", images.alias("has_images"), F.least(F.lit(50), F.when(images, 20).otherwise(0) + F.when(F.col("page_count") > 50, 10).otherwise(0)).alias("estimated_savings"))


def compression_stats(runs: DataFrame) -> DataFrame:
    """operation (null: all), runs, smaller, original_size, processed_size, mean_ratio of runs (operation, original_size, processed_size): a ratio only where the result is smaller."""
    ratio = F.when(F.col("processed_size") < F.col("original_size"), F.col("original_size") / F.nullif(F.col("processed_size"), F.lit(0)))
    return runs.withColumn("ratio", ratio).rollup("operation").agg(F.count(F.lit(1)).alias("runs"), F.count("ratio").alias("smaller"), F.sum("original_size").alias("original_size"), F.sum("processed_size").alias("processed_size"), F.avg("ratio").alias("mean_ratio"))


def ocr_flatten(pages: DataFrame) -> DataFrame:
    """doc_id, page, block, paragraph, line, word (0-based), text, confidence, x, y, width, height of every word.

    pages: (doc_id, page, blocks: array of struct(paragraphs: array of struct(lines: array of struct(words: array of struct(text, confidence, bbox(x0, y0, x1, y1)))))).
    """
    keys = ["doc_id", "page"]
    rows = pages.select(*keys, F.posexplode("blocks").alias("block", "b"))
    rows = rows.select(*keys, "block", F.posexplode("b.paragraphs").alias("paragraph", "p"))
    rows = rows.select(*keys, "block", "paragraph", F.posexplode("p.lines").alias("line", "l"))
    rows = rows.select(*keys, "block", "paragraph", "line", F.posexplode("l.words").alias("word", "w"))
    box = F.col("w.bbox")
    return rows.select(*keys, "block", "paragraph", "line", "word", "w.text", "w.confidence", box["x0"].alias("x"), box["y0"].alias("y"), (box["x1"] - box["x0"]).alias("width"), (box["y1"] - box["y0"]).alias("height"))


def ocr_text_layer(words: DataFrame, pages: DataFrame, image_scale: float = 2.0) -> DataFrame:
    """doc_id, page, text, x, y, font_size of words in page points (y upwards), given page heights and the scale at which pages were rendered."""
    y = F.col("page_height") - (F.col("y") + F.col("height")) / image_scale
    return words.join(pages.select("doc_id", "page", "page_height"), ["doc_id", "page"]).select("doc_id", "page", "text", (F.col("x") / image_scale).alias("x"), y.alias("y"), F.greatest(F.lit(1.0), F.col("height") / image_scale * 0.8).alias("font_size"))


def ocr_stats(pages: DataFrame) -> DataFrame:
    """doc_id, pages, mean_confidence, estimated_ms (1,500 a megapixel) of (doc_id, page, confidence, pixels)."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.avg("confidence").alias("mean_confidence"), F.floor(F.sum("pixels") / 1_000_000 * OCR_MS_PER_MEGAPIXEL + 0.5).cast("bigint").alias("estimated_ms"))


def redaction_plan(redactions: DataFrame, pages: DataFrame, dpi: int = 150, most: int = 500, pad: float = 2.0) -> DataFrame:
    """doc_id, page, id, left, top, right, bottom, error: pixel boxes of redactions that are still to be made.

    redactions (doc_id, id, page, x, y, width, height, kind, applied); pages (doc_id, page, page_width, page_height) in points. Text hits are
    widened by pad on all sides; boxes are held to their page. Errors: TOO_MANY (over most in a document), BAD_PAGE, BAD_BOX, PAGE_OUT_OF_RANGE, OFF_PAGE.
    """
    if not 72 <= dpi <= 300:
        raise ValueError("dpi must be from 72 to 300")
    todo = redactions.where(~F.coalesce("applied", F.lit(False))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    rows = todo.join(pages.select("doc_id", "page", "page_width", "page_height"), ["doc_id", "page"], "left")
    scale, by = dpi / 72, F.when(F.col("kind") == "text", pad).otherwise(0.0)
    pixel = lambda c: F.floor(c * scale + 0.5)
    left, top = F.greatest(F.lit(0), pixel(F.col("x") - by)), F.greatest(F.lit(0), pixel(F.col("y") - by))
    right = F.least(pixel(F.col("page_width")), pixel(F.col("x") + F.col("width") + by))
    bottom = F.least(pixel(F.col("page_height")), pixel(F.col("y") + F.col("height") + by))
    finite = lambda c: F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) >= 0), F.lit(False))
    good = finite("x") & finite("y") & finite("width") & finite("height") & (F.col("width") > 0) & (F.col("height") > 0)
    error = F.when(F.col("n") > most, "TOO_MANY").when(F.col("page").isNull() | (F.col("page") < 1), "BAD_PAGE").when(~good, "BAD_BOX").when(F.col("page_width").isNull(), "PAGE_OUT_OF_RANGE").when((right <= left) | (bottom <= top), "OFF_PAGE")
    rows = rows.select("doc_id", "page", "id", error.alias("error"), *[F.when(error.isNull(), c).cast("int").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))])
    return rows.select("doc_id", "page", "id", "left", "top", "right", "bottom", "error")


def security_scan(files: DataFrame) -> DataFrame:
    """doc_id, encrypted (the mark stands in the bytes), may_edit (null if encrypted), keywords: array of (doc_id, content, keywords), trimmed at commas."""
    encrypted = F.coalesce(F.col("content").contains(F.lit("/Encrypt").cast("binary")), F.lit(False))
    return files.select("doc_id", encrypted.alias("encrypted"), F.when(~encrypted, True).alias("may_edit"), F.transform(F.split("keywords", ","), lambda k: F.trim(k)).alias("keywords"))


def signature_marks(files: DataFrame) -> DataFrame:
    """doc_id, kind (stamp, placeholder), name, page, signer, signed: the marks among |-separated keywords; unreadable ones are dropped.

    A stamp without a name is Signature_n by its place among the readable stamps; its page is 1 where none is given.
    """
    parts = files.select("doc_id", F.posexplode(F.split("keywords", r"\|")).alias("at", "part"))
    form = "fieldName string, name string, signerName string, pageNumber int, page int, signed boolean, signedDate string"
    kind = F.when(F.col("part").startswith("signed:"), "stamp").when(F.col("part").startswith("sig:"), "placeholder")
    body = F.regexp_replace("part", "^(?:signed|sig):", "")
    rows = parts.withColumn("kind", kind).where("kind is not null").withColumn("whole", F.try_parse_json(body)).where("whole is not null").withColumn("j", F.from_json(body, form))
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("at")).cast("string")
    stamp = F.col("kind") == "stamp"
    return rows.select("doc_id", "kind", F.when(stamp, F.coalesce("j.fieldName", F.concat(F.lit("Signature_"), nth))).otherwise(F.col("j.name")).alias("name"), F.when(stamp, F.coalesce("j.pageNumber", F.lit(1))).otherwise(F.col("j.page")).alias("page"), F.col("j.signerName").alias("signer"), F.when(stamp, True).otherwise(F.coalesce("j.signed", F.lit(False))).alias("signed"))


def blank_metadata(files: DataFrame, producer: str = "") -> DataFrame:
    """The files with title, author, subject, keywords and creator emptied and the producer replaced, where they have such columns."""
    return files.withColumns({c: F.lit(producer if c == "producer" else "") for c in ("title", "author", "subject", "keywords", "creator", "producer") if c in files.columns})
