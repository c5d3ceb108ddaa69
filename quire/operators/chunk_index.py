"""A stored index of document chunks: a Parquet folder partitioned by bucket of the document, changed bucket by bucket.

A change reads and replaces the buckets of its documents alone, by dynamic partition overwrite; other buckets' files stay
as they are. The new rows are written aside first, so a failed change leaves the old rows or can be repeated: every
change gives the same index when done twice. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.functions.shared import materialised

from .retrieval import index_incremental

BUCKETS = 256
_BUCKET = "_bucket"


class ChunkIndex:
    """Chunks (doc_id, ...) of `schema` below `path`. buckets: how many folders, the same for the life of an index.

    Rows without a doc_id take no part. A bucket keeps one row without a doc_id, so that it can be emptied, too.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS):
        if _BUCKET in {f.name.lower() for f in schema.fields}:
            raise ValueError(f"chunks may not have a column {_BUCKET}")
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
        self.columns = [f.name for f in schema.fields]

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.where("doc_id is not null").withColumn(_BUCKET, F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(_BUCKET, IntegerType())])).parquet(self.path)

    def _replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """Writes the buckets of touched (one row each) anew: rows are all they hold from now on."""
        marks = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], _BUCKET)
        aside = materialised(rows.select(*self.columns, _BUCKET).unionByName(marks), "index")
        # A bucket is written by one task: one file.
        aside.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)

    def _touched(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The buckets of the documents, and the index's rows in them. The list of buckets is bounded by their number."""
        found = sorted(r[0] for r in self._keyed(documents).select(_BUCKET).distinct().collect())
        held = self._stored().where(F.col(_BUCKET).isin(found) & F.col("doc_id").isNotNull())
        return self.spark.createDataFrame([(b,) for b in found], f"{_BUCKET} int"), held

    def create(self, chunks: DataFrame) -> None:
        """A new index, in place of one that may be there."""
        self._replace(self._keyed(chunks), self.spark.range(self.buckets).select(F.col("id").cast("int").alias(_BUCKET)))

    def add(self, chunks: DataFrame, force: bool = False) -> None:
        """Documents the index has are passed over, or with force replaced; chunks without a doc_id are ignored."""
        new = chunks.select(*self.columns)
        touched, held = self._touched(new)
        self._replace(index_incremental(self._keyed(new), held, force), touched)

    def remove(self, documents: DataFrame) -> None:
        """Takes out all chunks of the documents (doc_id); unknown ones do no harm."""
        touched, held = self._touched(documents)
        self._replace(held.join(documents.select("doc_id").distinct(), "doc_id", "left_anti"), touched)

    def read(self) -> DataFrame:
        """The chunks as they stand."""
        return self._stored().where("doc_id is not null").select(*self.columns)

    def of_documents(self, documents: DataFrame) -> DataFrame:
        """The chunks of the documents (doc_id); other buckets' files are not read."""
        _, held = self._touched(documents)
        return held.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select(*self.columns)
