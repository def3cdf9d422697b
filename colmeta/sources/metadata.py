"""Metadata files in three formats, and the vocabulary."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colmeta.functions.predicates import NA_TOKENS

from .tables import DELIMITERS, read_delimited, unique_names

#: Schemas of the two JSON forms. A title may be one text or a list of them.
TABLE_SCHEMA = "struct<fields: array<struct<name: string, type: string, description: string, unit: string, method: string, title: string, element_uri: string>>>"
CSVW = "struct<tableSchema: struct<columns: array<struct<name: string, titles: string, propertyUrl: string, unit: string, method: string, datatype: string, description: string, `null`: string, element_uri: string>>>>"
NO_LIST = "no list of fields and no tableSchema with a list of columns"
IMPORT = ("name", "datatype", "element", "unit", "method", "description", "element_uri", "seq")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _list(c: str) -> Column:
    """A text or a JSON list of texts as a list."""
    return F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def _uris(label: Column, uri: Column) -> Column:
    """Map of an imported uri: a JSON object as it is, a plain uri under the element's name, none: null."""
    one = F.filter(uri, lambda u: u.isNotNull() & (u != ""))
    as_map = F.from_json(one[0], "map<string,string>")
    return F.when(F.size(one) == 0, F.lit(None)).when(one[0].startswith("{"), as_map).otherwise(F.create_map(label, one[0]))


def from_table_schema(documents: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Metadata rows of TableSchema documents (column json): keys, the fields and seq, their order in the document."""
    fields = documents.select(*keys, F.posexplode(F.from_json("json", TABLE_SCHEMA)["fields"]).alias("seq", "f")).select(*keys, "seq", "f.*")
    return fields.select(*keys, "name", _text("type").alias("datatype"), _text("title").alias("element"), _text("unit").alias("unit"), _text("method").alias("method"), _text("description").alias("description"), _uris(_text("title"), F.array("element_uri")).alias("element_uri"), "seq")


def from_csvw(documents: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Metadata rows of CSVW documents (column json). The first title is the element; a description may stand under null."""
    columns = documents.select(*keys, F.posexplode(F.from_json("json", CSVW)["tableSchema"]["columns"]).alias("seq", "c")).select(*keys, "seq", "c.*")
    title = F.coalesce(F.try_element_at(_list("titles"), F.lit(1)), F.lit(""))
    url = F.coalesce(F.when(F.col("element_uri").isNotNull(), F.array("element_uri")), F.when(F.col("propertyUrl").isNotNull(), _list("propertyUrl")), F.array().cast("array<string>"))
    return columns.select(*keys, "name", _text("datatype").alias("datatype"), title.alias("element"), _text("unit").alias("unit"), _text("method").alias("method"), F.coalesce("description", "null", F.lit("")).alias("description"), _uris(title, url).alias("element_uri"), "seq")


def from_json(documents: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Metadata rows of documents of either JSON form, told apart by their top-level key."""
    has = lambda k: F.get_json_object("json", f"$.{k}").isNotNull()
    return from_table_schema(documents.where(has("fields")), keys).unionByName(from_csvw(documents.where(~has("fields") & has("tableSchema")), keys))


def json_items(json: Column) -> Column:
    """The columns that a document of either JSON form lists, as structs of IMPORT's fields; null if it is no such document.

    Neither form: no object, no list, an empty list, or a list that holds something else than objects.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    words = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))

    def item(name: Column, datatype: Column, element: Column, c: Column, description: Column, uri: Column) -> Column:
        return F.struct(name.alias("name"), blank(datatype).alias("datatype"), element.alias("element"), blank(c["unit"]).alias("unit"), blank(c["method"]).alias("method"), blank(description).alias("description"), _uris(element, uri).alias("element_uri"))

    def field(c: Column) -> Column:
        return item(c["name"], c["type"], blank(c["title"]), c, c["description"], F.array(c["element_uri"]))

    def column(c: Column) -> Column:
        url = F.when(c["element_uri"].isNotNull(), F.array(c["element_uri"])).when(c["propertyUrl"].isNotNull(), words(c["propertyUrl"])).otherwise(F.array().cast("array<string>"))
        return item(c["name"], c["datatype"], blank(F.try_element_at(words(c["titles"]), F.lit(1))), c, F.coalesce(c["description"], c["null"]), url)

    fields, columns = F.from_json(json, TABLE_SCHEMA)["fields"], F.from_json(json, CSVW)["tableSchema"]["columns"]
    good = lambda x, inside: (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull()) & (F.get_json_object(json, inside).startswith("[{"))
    return F.when(good(fields, "$.fields"), F.transform(fields, field)).when(good(columns, "$.tableSchema.columns"), F.transform(columns, column))


def rejected(documents: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Documents of neither form: the keys and _error."""
    return documents.where(json_items(F.col("json")).isNull()).select(*keys, F.lit(NO_LIST).alias("_error"))


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows of a delimited file, which needs a column `name`; then header names are made lower case.

    A column table_id stays, if there is one.
    """
    df = read_delimited(spark, path)
    if "name" not in df.columns:
        raise ValueError(f"{path} has no column name")
    df = df.toDF(*(c.lower() for c in df.columns)).withColumn("seq", F.monotonically_increasing_id())
    known = [c for c in ("table_id", *IMPORT) if c in df.columns]
    df = df.select(*known)
    if "element_uri" in known:
        df = df.withColumn("element_uri", _uris(F.coalesce(F.col("element") if "element" in known else F.lit(None), F.lit("")), F.array("element_uri")))
    return df


def read_metadata(spark: SparkSession, path: str, table_id: str) -> DataFrame:
    """Metadata rows of a .csv or .json file for one table."""
    if path.lower().endswith(".csv"):
        return read_metadata_csv(spark, path).withColumn("table_id", F.lit(table_id))
    if path.lower().endswith(".json"):
        return from_json(spark.read.text(path, wholetext=True).select(F.lit(table_id).alias("table_id"), F.col("value").alias("json")))
    raise ValueError(f"{path} is neither .csv nor .json")


def _delimiter(lines: list[str]) -> str:
    """The delimiter that most lines have equally often outside quotes, as sniffed() tells it."""
    counts = Counter()
    for line in lines:
        bare = "".join(line.split('"')[::2])
        counts.update((d, bare.count(d)) for d in DELIMITERS if d in bare)
    return min(counts, key=lambda x: (-counts[x], -x[1], DELIMITERS.index(x[0])), default=(",", 0))[0]


def _csv_rows(raw: bytes) -> list[dict[str, str | None]]:
    """Rows of a delimited metadata file; its header names are made lower case."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("cp1252", "replace")
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=_delimiter(text.splitlines())) if r]
    if not rows:
        raise ValueError("no lines")
    head = unique_names([x or f"Unnamed: {i}" for i, x in enumerate(rows[0])])
    if "name" not in head:
        raise ValueError("no column name")
    return [{h.lower(): None if x in NA_TOKENS else x for h, x in zip(head, r, strict=False)} for r in rows[1:]]


_RAW = ("table_id", "name", "datatype", "element", "unit", "method", "description", "element_uri")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (path, content) as rows: those of a delimited file, the text of a JSON file, or what is wrong."""
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows, json, error, kind = [], None, None, path.lower().rpartition(".")[2]
            try:
                if kind == "csv":
                    rows = _csv_rows(raw)
                elif kind == "json":
                    json = raw.decode("utf-8")
                else:
                    error = "neither .csv nor .json"
            except (ValueError, csv.Error) as e:
                error = str(e)
            if json is not None or error:
                rows = [{}]
            n = len(rows)
            columns = [[path] * n, list(range(n)), [json] * n, [error] * n, *([r.get(c) for r in rows] for c in _RAW)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(columns)], names=["path", "seq", "json", "error", *_RAW])


def metadata_of_files(files: DataFrame) -> DataFrame:
    """Metadata rows of many files (path, content) in one job: path, table_id, IMPORT's columns, _error.

    A file's suffix tells its format: .csv (with a column `name`; the rest of its header in any case) or .json of either
    form. A file that can't be imported gives one row with _error and stops no other; the files are read and parsed in
    tasks. table_id is what a .csv says in a column of that name, else null.
    """
    rows = files.select("path", "content").mapInArrow(_opened, "path string, seq long, json string, error string, " + ", ".join(f"{c} string" for c in _RAW))
    own = F.struct(*(F.col(c) for c in IMPORT[:-2]), _uris(F.coalesce("element", F.lit("")), F.array("element_uri")).alias("element_uri"))
    items = F.when(F.col("json").isNotNull(), json_items(F.col("json"))).when(F.col("error").isNull(), F.array(own))
    error = F.when(F.col("json").isNotNull() & F.col("items").isNull(), NO_LIST).otherwise(F.col("error"))
    found = rows.withColumn("items", items).select("path", "table_id", F.col("seq").alias("row"), error.alias("_error"), F.posexplode_outer("items").alias("pos", "item"))
    fields = [F.col(f"item.{c}").alias(c) for c in IMPORT[:-1]]
    return found.select("path", "table_id", *fields, F.when(F.col("_error").isNull(), F.col("row") + F.col("pos")).alias("seq"), "_error")


def read_metadata_files(spark: SparkSession, files: dict[str, str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata rows of many files, and a row for each that can't be imported: table_id, path, _error.

    files: table_id to path, or a table of both. All files are read in one job; a file that is no metadata stops only
    its own import.
    """
    at, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    if isinstance(files, dict):
        files = spark.createDataFrame(sorted(files.items()), "table_id string, path string")
    known, lost = [], []
    for table_id, path in files.select("table_id", "path").collect():  # names only
        system = at(path).getFileSystem(conf)
        size = system.getFileStatus(at(path)).getLen() if system.exists(at(path)) else None
        (known if size else lost).append((table_id, path, system.makeQualified(at(path)).toString() if size else "no such file" if size is None else "no lines"))
    content = spark.read.format("binaryFile").load([p for *_, p in known]) if known else spark.createDataFrame([], "path string, content binary")
    asked = spark.createDataFrame(known, "table_id string, given string, path string")
    named = metadata_of_files(content).drop("table_id").join(asked, "path")
    missing = spark.createDataFrame(lost, "table_id string, path string, _error string")
    errors = named.where("_error is not null").select("table_id", F.col("given").alias("path"), "_error")
    return named.where("_error is null").select("table_id", *IMPORT), errors.unionByName(missing)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Terms: id, uri, label, definition, qc_label, embedding."""
    return spark.read.parquet(path)


def labels(vocabulary: DataFrame) -> DataFrame:
    """Labels of the terms that have one."""
    return vocabulary.where(F.col("label").isNotNull()).select("label")
