"""What a worker gets of requests."""

from pyspark.sql import functions as F

from colmeta.operators import answers


def test_contexts_stay_out_of_workers(spark):
    ctx = spark.range(5).select(F.col("id").cast("string").alias("table_id"), F.lit("p").alias("provider"), F.concat(F.lit("long context "), "id").alias("context"), F.array(F.lit("a")).alias("variables"))
    got = answers.generated(answers.requests(ctx), lambda name, prompt: prompt[-1])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan
    assert plan.count("BatchEvalPython") == 1
    assert {(r.context, r.response, r.error, r.attempts) for r in got.collect()} == {(f"long context {i}", str(i), None, 1) for i in range(5)}
