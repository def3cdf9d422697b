"""Type profile of columns and the metadata template made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmeta.functions.predicates import is_date, is_number, is_white, stripped, type_label, valid_type

#: Columns of a metadata row after table_id and ordinal.
FIELDS = ("name", "datatype", "element", "unit", "method", "description")
METADATA = "table_id string, ordinal int, name string, datatype string, element string, unit string, method string, description string, element_uri map<string,string>"


def cells(df: DataFrame, table_id: str, row_id: str | None = None) -> DataFrame:
    """Long form of a table: table_id, ordinal, name, row_id, value (text)."""
    names = [c for c in df.columns if c != row_id]
    ordinal = F.create_map(*(x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))))
    key = F.col(f"`{row_id}`").cast("long") if row_id else F.lit(None).cast("long")
    wide = df.select(key.alias("__row"), *(F.col(f"`{c}`").cast("string").alias(c) for c in names))
    long = wide.unpivot(["__row"], [f"`{c}`" for c in names], "name", "value")
    return long.select(F.lit(table_id).alias("table_id"), ordinal[F.col("name")].alias("ordinal"), "name", F.col("__row").alias("row_id"), "value")


def _kind(value: Column) -> Column:
    """What a value is: n(umber), d(ate) or s(tring); null if blank or null. It is told once, below the aggregation."""
    return F.when(is_number(value), "n").when(is_white(value), None).when(is_date(stripped(value)), "d").when(value.isNotNull(), "s")


def _typed_kind(value: Column, kind: T.DataType) -> Column | None:
    """As _kind() where a column's type tells it, as of numbers and dates; None for columns that are to be read as text."""
    if isinstance(kind, T.NumericType):
        return F.when(value.isNotNull(), "n")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(value.isNotNull(), "d")
    return None


def _counts(kind: Column) -> tuple[Column, Column, Column]:
    return F.count(kind), F.count_if(kind == "n"), F.count_if(kind == "d")


def profile_cells(long: DataFrame, sample_size: int | None = None) -> DataFrame:
    """table_id, ordinal, name, n_values, n_numeric, n_date, datatype of every column of a table in long form.

    sample_size: only a column's first so many non-null values by row_id count. The limit is applied before and after
    the shuffle; the counts are mergeable.
    """
    known = long.where(F.col("value").isNotNull())
    if sample_size:
        first = Window.partitionBy("table_id", "ordinal").orderBy("row_id")
        known = known.withColumn("at", F.row_number().over(first)).where(F.col("at") <= sample_size)
    known = (known if sample_size else long).select("table_id", "ordinal", "name", _kind(F.col("value")).alias("kind"))
    total, numbers, dates = _counts(F.col("kind"))
    all_ = long.select("table_id", "ordinal", "name").distinct() if sample_size else None
    out = known.groupBy("table_id", "ordinal", "name").agg(total.alias("n_values"), numbers.alias("n_numeric"), dates.alias("n_date"))
    if sample_size:  # a column without values has a row too
        out = all_.join(out, ["table_id", "ordinal", "name"], "left").fillna(0, ["n_values", "n_numeric", "n_date"])
    return out.withColumn("datatype", type_label(F.col("n_values"), F.col("n_numeric"), F.col("n_date")))


def profile(df: DataFrame, table_id: str) -> DataFrame:
    """As profile_cells() for one table, exactly, in one aggregation: cells are never shuffled.

    Columns of numbers are numeric and columns of dates or timestamps are dates by their type: their values are counted,
    not read as text. nan and the infinities are numbers.
    """
    kinds = [_typed_kind(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    told = [i for i, k in enumerate(kinds) if k is None]
    # one small expression over an array of the texts: written out for each column it would outgrow what the JVM compiles
    texts = F.transform(F.array(*(F.col(f"`{df.columns[i]}`").cast("string") for i in told)), _kind).alias("texts")
    kinds = df.select(*([texts] if told else []), *(k.alias(f"kind_{i}") for i, k in enumerate(kinds) if k is not None))
    kinds = kinds.withColumns({f"kind_{i}": F.col("texts")[at] for at, i in enumerate(told)})
    sums = []
    for i, c in enumerate(df.columns):
        total, numbers, dates = _counts(F.col(f"kind_{i}"))
        sums.append(F.struct(F.lit(table_id).alias("table_id"), F.lit(i).alias("ordinal"), F.lit(c).alias("name"), total.alias("n_values"), numbers.alias("n_numeric"), dates.alias("n_date")))
    out = kinds.agg(F.array(*sums).alias("columns")).select(F.inline("columns"))
    return out.withColumn("datatype", type_label(F.col("n_values"), F.col("n_numeric"), F.col("n_date")))


def template(profiled: DataFrame) -> DataFrame:
    """Metadata rows of profiled columns: name and type, all else blank."""
    blank = F.lit("")
    return profiled.select("table_id", "ordinal", "name", "datatype", *(blank.alias(c) for c in FIELDS[2:]), F.lit(None).cast("map<string,string>").alias("element_uri"))


def validated(metadata: DataFrame) -> DataFrame:
    """Metadata whose types are all of the known ones."""
    return metadata.withColumn("datatype", valid_type(F.col("datatype")))
