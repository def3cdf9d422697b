"""Choosing terms for columns: best hits, change groups, summaries, writing back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmeta.sources import store

from .merge import merged


def best_selected(hits: DataFrame, by: tuple[str, ...] = ("header",)) -> DataFrame:
    """Hits with selected, true for the nearest of each header (ties: the smaller id)."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy("distance", "id"))
    return hits.withColumn("selected", first == 1)


def with_description(hits: DataFrame, metadata: DataFrame, on: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Hits with their column's own description as header_description."""
    own = metadata.select(*on, F.col("name").alias("header"), F.col("description").alias("header_description"))
    return hits.join(own, [*on, "header"], "left")


def ordered_first(df: DataFrame, first: list[str]) -> DataFrame:
    """df with these columns before the others."""
    return df.select(*first, *(F.col(f"`{c}`") for c in df.columns if c not in first))


def change_groups(df: DataFrame, value: str, by: list[str], order: list[str | Column]) -> DataFrame:
    """df with group_id, which grows by one where value changes from row to row (from 1; null to null is no change), and marker, which alternates."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = first | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    group = F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("group_id", group.cast("int"))
    return ordered_first(out.withColumn("marker", F.when(F.col("group_id") % 2 == 0, "🔶").otherwise("🔷")), ["marker"])


def change_groups_across(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """As change_groups(), for tables that are too large for one task: a table's rows are cut into ranges of its order.

    Each range counts its own changes; what it begins with is held against what the range before ended with; and its
    groups go on from the changes of all ranges before. What is summed over a whole table is a row for each range. Rows
    equal in `by` and `order` stand in any order, but in one; df is written once, to the shared folder.
    """
    names, keys = df.columns, [F.col(f"`{c}`") for c in by]
    at = F.monotonically_increasing_id()
    by_range = [*(k.asc_nulls_first() for k in keys), *(F.col(f"`{c}`").asc_nulls_first() for c in order), F.col("__at")]
    ranged = df.withColumn("__at", at).repartitionByRange(*by_range).sortWithinPartitions(*by_range).drop("__at")
    ranged = store.written(ranged.withColumns({"__part": F.spark_partition_id(), "__row": at, "__table": F.xxhash64(*keys) if by else F.lit(0)}))
    inside = Window.partitionBy("__part", *keys).orderBy("__row")
    changed = F.row_number().over(inside) > 1
    changed = changed & ~F.col(f"`{value}`").eqNullSafe(F.lag(f"`{value}`").over(inside))
    local = F.sum(F.when(changed, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = ranged.withColumn("__local", local)
    ends = rows.groupBy("__part", *keys).agg(F.min_by(f"`{value}`", "__row").alias("__first"), F.max_by(f"`{value}`", "__row").alias("__last"), F.max("__local").alias("__changes"), F.first("__table").alias("__table"))
    ranges = Window.partitionBy("__table", *keys).orderBy("__part")
    opens = F.when((F.row_number().over(ranges) == 1) | ~F.col("__first").eqNullSafe(F.lag("__last").over(ranges)), 1).otherwise(0)
    ends = ends.withColumn("__opens", opens)
    base = F.sum(F.col("__opens") + F.col("__changes")).over(ranges) - F.col("__changes")
    same = lambda a, b: a.eqNullSafe(b)
    starts = ends.select(F.col("__part").alias("__p"), F.col("__table").alias("__t"), *(k.alias(f"__key{i}") for i, k in enumerate(keys)), base.alias("__base"))
    on = (F.col("__part") == F.col("__p")) & (F.col("__table") == F.col("__t"))
    for i, k in enumerate(keys):
        on = on & same(k, F.col(f"__key{i}"))
    out = rows.join(starts, on).select(*(F.col(f"`{c}`") for c in names), (F.col("__base") + F.col("__local")).cast("int").alias("group_id"))
    return ordered_first(out.withColumn("marker", F.when(F.col("group_id") % 2 == 0, "🔶").otherwise("🔷")), ["marker"])


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each is first seen, in that order."""
    return df.groupBy(value).agg(F.min(order).alias("first_at")).orderBy("first_at", value)


def summary(hits: DataFrame, by: tuple[str, ...] = ("header",)) -> DataFrame:
    """Terms of each header's selected hits: vocab and uri (sorted, distinct), element_uri (label to its smallest uri), first_at."""
    one = hits.where("selected").groupBy(*by, "label").agg(F.min("uri").alias("least"), F.collect_set("uri").alias("uris"), F.min("ordinal").alias("ordinal"))
    out = one.groupBy(*by).agg(
        F.array_sort(F.collect_list("label")).alias("vocab"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("uris")))).alias("uri"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "least")))).alias("element_uri"),
        F.min("ordinal").alias("first_at"),
    )
    return out


def with_unmatched(summed: DataFrame, headers: DataFrame, by: tuple[str, ...] = ("header",)) -> DataFrame:
    """The summary, and empty rows for headers without a selected hit. headers: the keys and first_at."""
    empty = F.array().cast("array<string>")
    rest = headers.join(summed, list(by), "left_anti").select(*by, empty.alias("vocab"), empty.alias("uri"), F.create_map().cast("map<string,string>").alias("element_uri"), "first_at")
    return summed.unionByName(rest)


def written_back(metadata: DataFrame, summed: DataFrame) -> DataFrame:
    """Metadata with each summarised header's terms: element is the labels joined by ||, element_uri the map."""
    new = summed.select("table_id", F.col("header").alias("name"), F.array_join("vocab", " || ").alias("element"), "element_uri", F.lit(0).alias("seq"))
    return merged(metadata, new, "yes_incl_blanks")
