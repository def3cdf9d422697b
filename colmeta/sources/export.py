"""Metadata as CSV, TableSchema and CSVW, a document for each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(c: str) -> Column:
    """The text, null where it is blank: to_json leaves it out."""
    return F.nullif(F.col(c), F.lit(""))


def _uris() -> Column:
    return F.when(F.size("element_uri") > 0, F.col("element_uri"))


def _documents(metadata: DataFrame, entry: Column) -> DataFrame:
    """table_id and the JSON list of its columns' entries, in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(entry).alias("j")))), lambda x: x["j"])
    return metadata.groupBy("table_id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("entries"))


def to_table_schema(metadata: DataFrame) -> DataFrame:
    """table_id, json: fields with what they have of name, type, description, unit, method, title, element_uri; primaryKey null."""
    entry = F.struct(F.col("name"), _given("datatype").alias("type"), _given("description").alias("description"), _given("unit").alias("unit"), _given("method").alias("method"), _given("element").alias("title"), F.to_json(_uris()).alias("element_uri"))
    return _documents(metadata, entry).select("table_id", F.concat(F.lit('{"fields":'), F.col("entries"), F.lit(',"primaryKey":null}')).alias("json"))


def to_csvw(metadata: DataFrame) -> DataFrame:
    """table_id, json: columns with titles and propertyUrl as lists; the url is the table's name."""
    entry = F.struct(F.col("name"), F.when(_given("element").isNotNull(), F.array("element")).alias("titles"), F.map_values(_uris()).alias("propertyUrl"), _given("unit").alias("unit"), _given("method").alias("method"), _given("datatype").alias("datatype"), _given("description").alias("description"))
    url = F.to_json(F.struct(F.col("table_id").alias("url")))
    head = F.concat(F.lit('{"@context":"http://www.w3.org/ns/csvw",'), F.substring(url, 2, 2147483647))
    return _documents(metadata, entry).select("table_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"tableSchema":{"columns":'), F.col("entries"), F.lit("}}")).alias("json"))


def to_csv_rows(metadata: DataFrame) -> DataFrame:
    """Metadata with the uri map as JSON text, empty where there is none."""
    return metadata.withColumn("element_uri", F.coalesce(F.to_json(_uris()), F.lit("")))


def write_csv(metadata: DataFrame, path: str) -> None:
    to_csv_rows(metadata).write.option("header", True).option("escape", '"').csv(path)


def write_json(documents: DataFrame, path: str) -> None:
    """The documents of to_table_schema() or to_csvw(), one a line, in a folder for each table."""
    documents.write.partitionBy("table_id").text(path)


def write_rows(metadata: DataFrame, path: str) -> None:
    """Metadata rows as JSON lines."""
    metadata.write.json(path)
