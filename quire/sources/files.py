"""Files as rows: bytes with their checks, never parsed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of the known formats, the size limit and its error codes.
PDF_MAGIC, PNG_MAGIC, JPEG_MAGIC, ENCRYPT_MARK = "255044462D", "89504E47", "FFD8FF", "2F456E6372797074"
MOST_BYTES = 100 * 1024 * 1024


def file_error(content: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """EMPTY_FILE, FILE_TOO_LARGE or INVALID_PDF; null for a file that may be read."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(size.isNull() | (size == 0), "EMPTY_FILE").when(size > most, "FILE_TOO_LARGE").when(head.isNull() | (head != PDF_MAGIC), "INVALID_PDF")


def image_type(content: Column) -> Column:
    """png or jpg by the first bytes; png for anything else."""
    return F.when(F.hex(F.substring(content, 1, 3)) == JPEG_MAGIC, "jpg").otherwise("png")


def validated(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The files (path, content) with length and error. Null and empty contents are errors, not exceptions."""
    size = F.coalesce(F.length("content"), F.lit(0))
    return files.withColumn("length", size).withColumn("error", file_error(F.col("content"), F.col("length"), most))


def read_pdf_files(spark: SparkSession, path: str, most: int = MOST_BYTES, pattern: str = "*.pdf") -> DataFrame:
    """path, modified, length, error, content of the files below path; contents of files in error are null.

    No file fails the job. Files of no bytes have no row, as Spark's reader leaves them out; in tables of contents they are errors (validated).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    error = file_error(F.col("content"), F.col("length"), most)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content"))
