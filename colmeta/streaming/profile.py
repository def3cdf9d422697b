"""A type profile kept over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colmeta.functions.predicates import type_label
from colmeta.operators.profile import cells, profile_cells


def running_profile(stream: DataFrame, table_id: str) -> DataFrame:
    """The profile of a streaming table so far: the counts are state of constant size, a row for each column."""
    return profile_cells(cells(stream, table_id))


def start_counts(stream: DataFrame, table_id: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's counts to path; total_profile() adds them up."""

    def write(batch: DataFrame, number: int) -> None:
        profile_cells(cells(batch, table_id)).drop("datatype").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_profile(counts: DataFrame) -> DataFrame:
    """The profile of all batches' counts."""
    sums = counts.groupBy("table_id", "ordinal", "name").agg(*(F.sum(c).alias(c) for c in ("n_values", "n_numeric", "n_date")))
    return sums.withColumn("datatype", type_label(F.col("n_values"), F.col("n_numeric"), F.col("n_date")))
