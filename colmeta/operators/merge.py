"""Merging imported metadata into a catalogue, and telling two catalogues apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmeta.functions.predicates import is_blank

#: Fields that an import may change.
WRITTEN = ("datatype", "element", "unit", "method", "description", "element_uri")
MODES = ("no_overwrite", "fill_blanks", "yes", "yes_incl_blanks")


def _blank(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return (c.isNull() | (F.size(c) == 0)) if column.endswith("element_uri") else is_blank(c)


def merged(current: DataFrame, new: DataFrame, mode: str = "no_overwrite") -> DataFrame:
    """current, with what rows of new that name one of its columns bring, by mode.

    no_overwrite changes nothing. fill_blanks writes only where current is blank. yes writes what isn't blank.
    yes_incl_blanks writes the last row's values, blank or not. new: table_id, name, seq (its order) and any of WRITTEN.
    Of rows for one column the last by seq counts: field by field, or as a whole where blanks count. Where names repeat
    in current, the first by ordinal changes. Unknown names and other columns of new are ignored.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    fields = [f for f in WRITTEN if f in new.columns]
    if mode == "no_overwrite" or not fields:
        return current
    if mode == "yes_incl_blanks":
        one = new.groupBy("table_id", "name").agg(F.max_by(F.struct(*fields), "seq").alias("n")).select("table_id", "name", *(F.col(f"n.{f}").alias(f"new_{f}") for f in fields), F.lit(True).alias("found"))
    else:
        one = new.groupBy("table_id", "name").agg(*(F.max_by(f, F.when(~_blank(new, f), F.col("seq"))).alias(f"new_{f}") for f in fields), F.lit(True).alias("found"))
    first = F.row_number().over(Window.partitionBy("table_id", "name").orderBy("ordinal")) == 1
    both = current.withColumn("is_first", first).join(one, ["table_id", "name"], "left")
    hit = F.col("found") & F.col("is_first")
    for f in fields:
        if mode == "yes_incl_blanks":
            write = hit
        elif mode == "yes":
            write = hit & ~_blank(both, f"new_{f}")
        else:
            write = hit & _blank(both, f) & ~_blank(both, f"new_{f}")
        both = both.withColumn(f, F.when(write, F.col(f"new_{f}")).otherwise(F.col(f)))
    return both.select(current.columns)


def difference(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("table_id", "ordinal"), fields: tuple[str, ...] = ("name", *WRITTEN[:-1])) -> DataFrame:
    """Changes from old to new: the key, change (added, removed, changed) and the names of the fields that differ."""
    a = old.select(*key, F.struct(*fields).alias("o"))
    b = new.select(*key, F.struct(*fields).alias("n"))
    both = a.join(b, list(key), "full_outer")
    differ = F.filter(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return both.select(*key, change.alias("change"), F.when(change == "changed", differ).otherwise(F.array().cast("array<string>")).alias("fields")).where((F.col("change") != "changed") | (F.size("fields") > 0))
