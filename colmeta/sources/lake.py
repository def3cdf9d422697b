"""Columns of many Parquet files of any schemas as counters, in one plan.

A plan with a scan for each table grows with the lake. Here the files are rows: tasks read footers, row groups are dealt to
tasks, and each turns its columns into rows of distinct texts with their numbers. What a text is (number, date or other) is
told by the same expressions as for single tables, in the stage of the scan, and the counts are summed before they are
shuffled. The plan is the same for three tables and for a hundred thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmeta.functions.predicates import type_label
from colmeta.operators.profile import _kind

#: Rows of a row group that are read at once.
BATCH = 1 << 16
_CELLS = "table_id string, ordinal int, name string, kind string, texts array<string>, counts array<long>"


def table_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table_id, path of the Parquet files of tables (name to file or folder)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(sorted(set(paths.values()))).select("path")
    at = spark._jvm.org.apache.hadoop.fs.Path
    whole = {n: at(p).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at(p)).toString() for n, p in paths.items()}
    tables = spark.createDataFrame(sorted(whole.items()), "table_id string, at string")
    names = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/")))  # the file and its folders
    return found.select("path", above.alias("at")).join(tables, "at").select("table_id", "path")


def _opened(path: str):
    from pyarrow import fs, parquet
    from urllib.parse import unquote, urlsplit

    if urlsplit(path).scheme in ("file", ""):
        return parquet.ParquetFile(unquote(urlsplit(path).path))
    files, inside = fs.FileSystem.from_uri(path)
    return parquet.ParquetFile(inside, filesystem=files)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row groups of files, -1 for a file without any."""
    for b in batches:
        for table_id, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = _opened(path).metadata.num_row_groups
            groups = list(range(n)) or [-1]
            yield pa.RecordBatch.from_arrays([pa.array([table_id] * len(groups)), pa.array([path] * len(groups)), pa.array(groups, pa.int32())], names=["table_id", "path", "part"])


def _told(kind: pa.DataType) -> str | None:
    """What a column's type says of its values; None where their text has to be read."""
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        return "n"
    if pa.types.is_date(kind) or pa.types.is_timestamp(kind):
        return "d"
    return "s" if pa.types.is_nested(kind) or pa.types.is_boolean(kind) else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each column of each row group: its kind and number of values where the type tells it, else its distinct texts and their numbers."""
    import pyarrow.compute as pc

    for b in batches:
        for table_id, path, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            file = _opened(path)
            fields = list(file.schema_arrow)
            rows = file.iter_batches(BATCH, row_groups=[part]) if part >= 0 else iter(())
            seen = [(i, f.name, _told(f.type), [], [0]) for i, f in enumerate(fields)]  # a column without values has a row too
            yield _batch(table_id, seen)
            for batch in rows:
                out = []
                for i, f in enumerate(fields):
                    column, told = batch.column(i), _told(f.type)
                    if told:
                        out.append((i, f.name, told, [], [len(column) - column.null_count]))
                        continue
                    column = column.dictionary_decode() if pa.types.is_dictionary(f.type) else column
                    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                        column = pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())
                    each = pc.value_counts(column.cast(pa.string()).drop_null())
                    out.append((i, f.name, None, each.field(0).to_pylist(), each.field(1).to_pylist()))
                yield _batch(table_id, out)


def _batch(table_id: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([table_id] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["table_id", "ordinal", "name", "kind", "texts", "counts"])


def profile_files(files: DataFrame) -> DataFrame:
    """table_id, ordinal, name, n_values, n_numeric, n_date, datatype of every column of the Parquet files (table_id, path).

    As profile() has them of single tables: columns of numbers and dates by their type, all others by their texts. A
    table's files may differ in their columns: those of one name are one, at its smallest place. Files are read where
    Arrow can open their path (file, hdfs, s3, gcs). Row groups are dealt to tasks evenly, however large a file is.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = files.select("table_id", "path").repartition(tasks, "path").mapInArrow(_groups, "table_id string, path string, part int").repartition(tasks, "path", "part")
    cells = parts.mapInArrow(_counted, _CELLS)
    pairs = F.when(F.col("kind").isNull(), F.arrays_zip("texts", "counts")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("texts"), F.col("counts")[0].alias("counts"))))
    each = cells.select("table_id", "ordinal", "name", "kind", F.explode_outer(pairs).alias("x"))
    each = each.select("table_id", "ordinal", "name", F.coalesce("kind", _kind(F.col("x.texts"))).alias("kind"), F.coalesce("x.counts", F.lit(0)).alias("n"))
    total = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0)).cast("long")
    out = each.groupBy("table_id", "name").agg(F.min("ordinal").alias("ordinal"), total(F.col("kind").isNotNull()).alias("n_values"), total(F.col("kind") == "n").alias("n_numeric"), total(F.col("kind") == "d").alias("n_date"))
    out = out.select("table_id", "ordinal", "name", "n_values", "n_numeric", "n_date")
    return out.withColumn("datatype", type_label(F.col("n_values"), F.col("n_numeric"), F.col("n_date")))
