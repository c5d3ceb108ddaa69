"""Form queries deal their forms over tasks and try each label pattern once for an item."""

from pyspark.sql import functions as F

from quire.operators import forms
from quire.plans import views


def test_forms_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    spark.range(1, 101).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(views, "FORMS_A_TASK", 10, raising=False)
    items = views.form_items(spark, str(tmp_path))
    assert items.rdd.getNumPartitions() == 10 and items.count() == 1200


def test_label_patterns_stand_once_in_the_plan(spark):
    rows = spark.createDataFrame([("Email:",), ("x",), (None,), ("1/2/2020",), ("a b",)], "s string")
    found = rows.withColumn("hint", forms.suggest_field_type(F.col("s"))).select("s", "hint.type", "hint.confidence", F.concat("hint.type", F.lit("!")).alias("again"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("|quantity|") <= 1
    assert [(x["type"], x["confidence"], x["again"]) for x in found.collect()] == [("email", 95, "email!"), ("signature", 95, "signature!"), ("text", 50, "text!"), ("date", 85, "date!"), ("text", 50, "text!")]
