"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents; null doc_ids are kept by the stages that can't name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, text_key
from quire.llm.decontaminate import contamination
from quire.llm.near_copies import keep_distinct
from quire.llm.packing import pack_documents
from quire.llm.private import masked, private_spans
from quire.llm.toxicity import fit_chain, scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic probability stays below the chain's threshold; repeated rows are judged each, null and blank texts stay, long ones are read whole."""
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(F.get(scores(F.col("text"), chain), F.lit(len(chain.categories) - 1)) < chain.thresholds[-1])


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of docs."""
    taken = {c.lower() for c in docs.columns}
    pad = next(n for n in range(1, 2 + len(docs.columns)) if not any(("_" * n + x).lower() in taken for x in names))
    return ["_" * pad + x for x in names]


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 of their five-word shingles the one of the smallest doc_id; copies and repeated rows of it once.

    Rows are told by doc_id and text: different texts of one doc_id are judged apart, and so are rows without a doc_id. Null, empty and
    blank texts are copies of each other; long texts are compared whole; no rows give none.
    """
    mine, stay_id, stay_text = _fresh(docs, "text_key", "stay_id", "stay_text")
    stay = keep_distinct(docs).select(F.col("least_id").alias(stay_id), F.col("text_key").alias(stay_text))
    keyed = docs.withColumn(mine, text_key(F.col("text")))
    kept = keyed.join(stay, (F.col(mine) == F.col(stay_text)) & docs["doc_id"].eqNullSafe(F.col(stay_id)))
    # One row stays of each text.
    return kept.dropDuplicates([mine]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Rows are told by 128 bits of their text, which alone decides; null and empty texts stay."""
    (hit_text,) = _fresh(docs, "hit_text")
    keyed = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("runs") > 0).select(F.col("doc_id").alias(hit_text)).distinct()
    return docs.join(hit, text_key(docs["text"]) == F.col(hit_text), "left_anti").select(*docs.columns)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars that of the new text.

    Repeated rows are masked each, null and empty texts stay as they are, long ones are masked whole.
    """
    span_id, span_key, spans = _fresh(docs, "span_id", "span_key", "spans")
    found = private_spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(span_id), F.col("text_key").alias(span_key), F.col("spans").alias(spans)).dropDuplicates([span_id, span_key])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(span_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(span_key)), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(spans)))
    out = joined.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and offset; null and empty texts have their closing id alone, repeated rows are packed each, long texts are cut."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("private", mask_private), ("packing", pack)]
#: The stages' classifiers, fingerprints and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents; what each keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
