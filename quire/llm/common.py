"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, matched by exact case, whatever else the table carries.

    Extra columns never reach an operator, so their names cannot clash with the
    columns it makes; columns that differ from a wanted one only by case are told apart.
    """
    if len({c.lower() for c in df.columns}) < len(df.columns):
        spot = {c: i for i, c in reversed(list(enumerate(df.columns)))}
        df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
        return df.select(*[F.col(f"_c{spot[n]}").alias(n) for n in names])
    return df.select(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session, whose driver is its only executor, gets a temporary folder; a cluster gets an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """The rows written as Parquet in the shared folder, with the writer's options, and read back.

    Cuts the lineage: a lost executor costs its own tasks, not the work before.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again: what was made of them is stored itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """128 bits of a text, as binary: told apart from any other text but for a chance of n^2 / 2^129 among n; null has a key of its own."""
    return F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text)))


def spread_join(rows: DataFrame, marks: DataFrame, on: list[str], counted: str, deal: str, how: str = "inner", least: int = 1_000, most: int = 10_000) -> DataFrame:
    """rows joined to marks (one row for each key, the number of its rows in column counted) without hot tasks.

    A key of over max(least, all rows / most) rows is dealt over several tasks by a hash of the column deal, and its
    mark is repeated for each; as counts add up to all rows there are at most `most` such keys, so they are
    broadcast. counted is dropped. Keys may not be null.
    """
    total = marks.agg(F.sum(counted)).first()[0] or 0
    limit = max(least, total // most)
    hot = marks.where(F.col(counted) > limit).select(*on, F.ceil(F.col(counted) / limit).cast("int").alias("_parts"))
    left = rows.join(F.broadcast(hot), on, "left")
    left = left.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(deal, F.lit("part")), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    parts = F.greatest(F.ceil(F.col(counted) / limit).cast("int"), F.lit(1))
    right = marks.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(counted)
    return left.join(right, [*on, "_part"], how).drop("_part")
