"""Tables from delimited text and spreadsheets."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession, Window
from pyspark.sql import functions as F

from colmeta.functions.predicates import without_na

#: Delimiters that are tried.
DELIMITERS = (",", ";", "\t", "|")
#: Spark reads Latin-1; where the two differ, Windows-1252 has these characters (or the replacement character).
_CONTROL, _WINDOWS = bytes(range(128, 160)).decode("latin-1"), bytes(range(128, 160)).decode("cp1252", "replace")
#: Rows of a sheet that may be the header; cells and shared strings that are handled at once.
HEADER_ROWS, CELLS = 10, 10_000


def sniffed(lines: DataFrame) -> DataFrame:
    """file, delimiter, found for lines (file, value): the delimiter that most of all lines have equally often.

    Quoted spans don't count. Of delimiters that serve as many lines, the one with more columns wins, then the order of
    DELIMITERS. Where none occurs the delimiter is a comma and found is false.
    """
    bare = F.regexp_replace("value", r'"[^"]*"', "")
    full = lines.where(F.trim("value") != "").withColumn("bare", bare)
    each = full.select("file", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), (F.length("bare") - F.length(F.replace("bare", F.lit(d), F.lit("")))).alias("n")) for i, d in enumerate(DELIMITERS)))).alias("x")).select("file", "x.*")
    counts = each.groupBy("file", "rank", "delimiter", "n").agg(F.count("*").alias("lines")).where("n > 0")
    best = F.row_number().over(Window.partitionBy("file").orderBy(F.col("lines").desc(), F.col("n").desc(), "rank"))
    top = counts.withColumn("at", best).where("at = 1").select("file", "delimiter")
    out = lines.select("file").distinct().join(top, "file", "left")
    return out.select("file", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), F.col("delimiter").isNotNull().alias("found"))


def unique_names(names: list[str]) -> list[str]:
    """Names made unique: repeats get .1, .2 and so on."""
    out: list[str] = []
    for name in names:
        new, i = name, 0
        while new in out:
            i += 1
            new = f"{name}.{i}"
        out.append(new)
    return out


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files as they are stored: file, at (a line's place in its file, growing), value. Large files are split."""
    mid = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + mid).alias("at"), "value")


def inspected(lines: DataFrame, fallback: str = "windows-1252") -> DataFrame:
    """What files (file, at, value) need to be read: file, encoding, delimiter, found, multiline, head (bytes of the first line).

    encoding is UTF-8 where every line is valid, else the fallback; multiline says that a quoted text holds a line end.
    The counts of lines are mergeable: no task sees a whole file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    whole = lines.groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise(fallback).alias("encoding"),
        F.bool_or(quotes % 2 == 1).alias("multiline"),
        F.min_by(F.col("value").cast("binary"), "at").alias("head"),
    )
    return whole.join(sniffed(lines.withColumn("value", F.make_valid_utf8("value"))), "file")


def _reader(spark: SparkSession, delimiter: str, encoding: str, multiline: bool) -> DataFrameReader:
    windows = encoding == "windows-1252"
    read = spark.read.option("sep", delimiter).option("encoding", "ISO-8859-1" if windows else encoding)
    return read.option("quote", '"').option("escape", '"').option("multiLine", multiline).option("recursiveFileLookup", True)


def _header(read: DataFrameReader, info: Row) -> list[str]:
    """Names of a file's columns."""
    if info["multiline"]:
        names = [x or "" for x in read.option("header", False).csv(unquote(info["file"])).limit(1).first()]
        names = [x.translate(str.maketrans(_CONTROL, _WINDOWS)) for x in names] if info["encoding"] == "windows-1252" else names
    else:
        text = bytes(info["head"]).decode("cp1252" if info["encoding"] == "windows-1252" else info["encoding"], "replace")
        names = next(csv.reader([text.removeprefix("\ufeff").rstrip("\r")], delimiter=info["delimiter"]), [])
    return unique_names([x or f"Unnamed: {i}" for i, x in enumerate(names)])


def read_many(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of many delimited files (or folders of them): file, ordinal, name, row_id, value, as cells() has them of tables.

    Delimiter and charset are told from each file's lines; then files of one kind are read together. A file is read in
    splits, unless a quoted text of its kind holds a line end. row_id grows with a line's place in its file. Words for
    missing values are null, repeated names are made unique. The driver sees one row for each file, never its cells.
    """
    kinds: dict[tuple, list[tuple[str, list[str]]]] = {}
    for info in inspected(file_lines(spark, paths)).collect():
        kind = (info["delimiter"], info["encoding"], info["multiline"])
        kinds.setdefault(kind, []).append((info["file"], _header(_reader(spark, *kind), info)))
    out = spark.createDataFrame([], "file string, ordinal int, name string, row_id long, value string")
    for kind, files in sorted(kinds.items()):
        width = max(len(names) for _, names in files)
        read = _reader(spark, *kind).option("header", True).option("enforceSchema", True).schema(", ".join(f"c{i} string" for i in range(width)))
        mid = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = read.csv([unquote(f) for f, _ in files]).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + mid).alias("row_id"), F.array(*(f"c{i}" for i in range(width))).alias("values"))
        named = rows.join(spark.createDataFrame(files, "file string, names array<string>"), "file")
        cells = named.select("file", "row_id", F.posexplode(F.arrays_zip("names", F.slice("values", F.lit(1), F.size("names")).alias("values"))).alias("ordinal", "c"))
        value = F.translate("c.values", _CONTROL, _WINDOWS) if kind[1] == "windows-1252" else F.col("c.values")
        out = out.unionByName(cells.select("file", "ordinal", F.col("c.names").alias("name"), "row_id", without_na(value).alias("value")))
    return out


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """One delimited file, or a folder of parts with one header, as a wide table of text columns.

    Header on line 1, repeated names made unique, words for missing values null. Without delimiter or encoding they are
    told from the file. Many files: read_many().
    """
    infos = inspected(file_lines(spark, path)).orderBy("file").collect()
    info = Row(**(infos[0].asDict() | {"multiline": any(i["multiline"] for i in infos), "encoding": encoding or max(i["encoding"] for i in infos)}))
    info = Row(**(info.asDict() | {"delimiter": delimiter or info["delimiter"]}))
    read = _reader(spark, info["delimiter"], info["encoding"], info["multiline"])
    names = _header(read, info)
    rows = read.option("header", True).option("enforceSchema", True).schema(", ".join(f"c{i} string" for i in range(len(names)))).csv(path)
    if info["encoding"] == "windows-1252":
        rows = rows.select(*(F.translate(c, _CONTROL, _WINDOWS).alias(c) for c in rows.columns))
    return rows.select(*(without_na(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)))


def cleaned(df: DataFrame) -> DataFrame:
    """df with words for missing values made null in its text columns."""
    return df.select(*(without_na(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


_XLSX = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: Number formats of workbooks that are dates or times.
DATE_FORMAT_IDS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{_XLSX}numFmt")}
    dates = DATE_FORMAT_IDS | {i for i, code in own.items() if re.search(r"[dmyhs]", code, re.I)}
    formats = root.find(f"{_XLSX}cellXfs")
    return {i for i, x in enumerate(formats) if int(x.get("numFmtId") or 0) in dates} if formats is not None else set()


def _as_date(serial: str, start: datetime) -> str:
    """A date serial as text; the time of day only where there is one."""
    seconds = round(float(serial) * 86400)
    at = start + timedelta(seconds=seconds)
    return at.strftime("%Y-%m-%d") if seconds % 86400 == 0 else at.strftime("%Y-%m-%d %H:%M:%S")


def _elements(z: zipfile.ZipFile, name: str, inside: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements `tag` below `inside` of a workbook's part, one at a time; what has been read is forgotten."""
    with z.open(name) as f:
        above = None
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start" and e.tag == f"{_XLSX}{inside}":
                above = e
            elif event == "end" and e.tag == f"{_XLSX}{tag}" and above is not None:
                yield e
                above.clear()


class _Shared:
    """A workbook's shared strings, in Arrow's buffers: their characters and an offset each."""

    def __init__(self, z: zipfile.ZipFile) -> None:
        parts, held = [], []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in _elements(z, "xl/sharedStrings.xml", "sst", "si"):
                held.append("".join(t.text or "" for t in si.iter(f"{_XLSX}t")))
                if len(held) == CELLS:
                    parts.append(pa.array(held, pa.string()))
                    held = []
        self.parts = [*parts, pa.array(held, pa.string())]

    def __getitem__(self, i: int) -> str:
        return self.parts[i // CELLS][i % CELLS].as_py()


def _sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Sheet name, row, column and text of the cells of a workbook: dates as ISO text, booleans as True or False.

    Sheets are read row by row, so a workbook takes its own size and its shared strings, however many cells it has.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _Shared(z)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        dates, book = _date_styles(z), ElementTree.fromstring(z.read("xl/workbook.xml"))
        since_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_XLSX}workbookPr"))
        start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        for sheet in book.iter(f"{_XLSX}sheet"):
            target = targets[sheet.get(_RELATION)].lstrip("/")
            for row in _elements(z, target if target.startswith("xl/") else f"xl/{target}", "sheetData", "row"):
                for c in row.iter(f"{_XLSX}c"):
                    letters, number = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    col = 0
                    for x in letters:
                        col = 26 * col + ord(x) - 64
                    kind, value = c.get("t"), c.find(f"{_XLSX}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_XLSX}t")) if kind == "inlineStr" else "" if value is None else value.text or ""
                    if text and kind == "s":
                        text = shared[int(text)]
                    elif text and kind == "b":
                        text = "True" if text == "1" else "False"
                    elif text and kind in (None, "n") and int(c.get("s") or 0) in dates:
                        text = _as_date(text, start)
                    yield sheet.get("name"), int(number) - 1, col - 1, text


def sheet_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks (path, content) in long form: file, sheet, row, col, value. They leave a task CELLS at a time."""
    names, types = ["file", "sheet", "row", "col", "value"], (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one workbook's bytes at a time
                path, cells = b.column(0)[i].as_py(), _sheet_cells(b.column(1)[i].as_py())
                while part := list(itertools.islice(cells, CELLS)):
                    columns = [[path] * len(part), *zip(*part, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, "file string, sheet string, row int, col int, value string")


def read_sheets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of workbook files, as sheet_cells() gives them."""
    return sheet_cells(spark.read.format("binaryFile").load(paths))


def header_rows(cells: DataFrame) -> DataFrame:
    """file, sheet, header_row: the first of the first rows that is at least half full, else row 0."""
    full = F.count_if(F.trim("value") != "")
    width = cells.groupBy("file", "sheet").agg((F.max("col") + 1).alias("width"))
    rows = cells.where(F.col("row") < HEADER_ROWS).groupBy("file", "sheet", "row").agg(full.alias("filled")).join(width, ["file", "sheet"])
    found = rows.where("filled > 0 and 2 * filled >= width").groupBy("file", "sheet").agg(F.min("row").alias("header_row"))
    return width.select("file", "sheet").join(found, ["file", "sheet"], "left").fillna(0, ["header_row"])


def headers(cells: DataFrame) -> DataFrame:
    """file, sheet, ordinal, name of each column with a cell in the header row or below. A blank header is col_<ordinal>."""
    at = cells.join(header_rows(cells), ["file", "sheet"]).where("row >= header_row")
    trimmed = F.trim("value")
    names = at.groupBy("file", "sheet", F.col("col").alias("ordinal")).agg(F.max(F.when((F.col("row") == F.col("header_row")) & (trimmed != ""), trimmed)).alias("header"))
    return names.select("file", "sheet", "ordinal", F.coalesce("header", F.concat(F.lit("col_"), F.col("ordinal").cast("string"))).alias("name"))


def with_header(cells: DataFrame) -> DataFrame:
    """Data cells below the header row, with names: file, sheet, row_id, ordinal, name, value."""
    at = cells.join(header_rows(cells), ["file", "sheet"]).where("row > header_row")
    data = at.select("file", "sheet", (F.col("row") - F.col("header_row") - 1).alias("row_id"), F.col("col").alias("ordinal"), "value")
    return data.join(headers(cells), ["file", "sheet", "ordinal"]).select("file", "sheet", "row_id", "ordinal", "name", "value")


def as_table(named: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """One sheet's named cells as a wide table. columns (ordinal, name): its headers, for columns without any cell."""
    found = (columns if columns is not None else named).select("ordinal", "name").distinct().orderBy("ordinal").collect()
    wide = named.groupBy("row_id").pivot("ordinal", [r["ordinal"] for r in found]).agg(F.first("value")).orderBy("row_id")
    return wide.select(*(F.col(str(r["ordinal"])).alias(n) for r, n in zip(found, unique_names([r["name"] for r in found]), strict=True)))


def wide_rows(cells: DataFrame) -> DataFrame:
    """All sheets in wide form in one job: file, sheet, row_id, names, values, where values[i] stands under names[i].

    names are a sheet's unique headers in order; a cell that isn't there is null. Rows without a cell have no row.
    """
    heads = headers(cells).groupBy("file", "sheet").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("h"))
    # a name's repeats get .1, .2 and so on, as unique_names() gives them
    unique = F.aggregate(F.col("h")["name"], F.array().cast("array<string>"), lambda seen, n: F.concat(seen, F.array(_free_name(seen, n))))
    heads = heads.select("file", "sheet", F.col("h")["ordinal"].alias("ordinals"), unique.alias("names"))
    at = cells.join(header_rows(cells), ["file", "sheet"]).where("row > header_row")
    rows = at.groupBy("file", "sheet", (F.col("row") - F.col("header_row") - 1).alias("row_id")).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("by"))
    values = F.transform("ordinals", lambda o: F.try_element_at("by", o))
    return rows.join(heads, ["file", "sheet"]).select("file", "sheet", "row_id", "names", values.alias("values"))


def _free_name(seen: Column, name: Column) -> Column:
    """The name, or the first of name.1, name.2, ... that is not among those seen."""
    tried = F.transform(F.sequence(F.lit(1), F.size(seen) + 1), lambda i: F.concat(name, F.lit("."), i.cast("string")))
    return F.when(~F.array_contains(seen, name), name).otherwise(F.filter(tried, lambda t: ~F.array_contains(seen, t))[0])


def sheet_table(cells: DataFrame) -> DataFrame:
    """One sheet's cells as a wide table, with every column that has a header or a cell."""
    return as_table(with_header(cells), headers(cells))
