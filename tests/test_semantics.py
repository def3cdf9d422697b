"""Small literal cases of each decision."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from colmeta.functions import predicates, text, vectors
from colmeta.operators import answers, linking, match, merge, profile, select
from colmeta.plans import pipelines
from colmeta.sources import context, export, metadata, tables
from colmeta.streaming import profile as stream

META = profile.METADATA


def _rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


NUMBERS = ["1", "1,5", "1_000", "1e5", "nan", "inf", "-.5", "+3.", "1.5E-3", "Infinity"]
NOT_NUMBERS = ["1d", "", "1,234.56", "_1", "1__0", "0x1", "1 2", "e5", "--1"]
DATES = ["2024-01-01", "31/12/2024", "12/31/2024", "5-Jan-2024", "2024-01-01 10:30", "2024-01-01T10:30:05", "2024-02-29", "2024/3/4", "2024-03"]
NOT_DATES = ["2024-13-01", "2024-02-30", "10:30", "1-2", "P-1", "jan-20", "x", "a.b.c"]


def test_numbers_and_dates(spark):
    values = [*NUMBERS, *NOT_NUMBERS, *DATES, *NOT_DATES]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", predicates.is_number(F.col("v")).alias("n"), predicates.is_date(F.col("v")).alias("d"))
    got = {r.v: (r.n, r.d) for r in df.collect()}
    for v in NUMBERS:
        assert got[v][0], v
        float(v.replace(",", "."))
    assert not any(got[v][0] for v in NOT_NUMBERS)
    assert [v for v in DATES if not got[v][1]] == []
    assert [v for v in NOT_DATES if got[v][1]] == []


def test_thresholds(spark):
    cols = {"eighty": ["1"] * 8 + ["x"] * 2, "less": ["1"] * 79 + ["x"] * 21, "dates": ["2024-01-01"] * 4 + ["x"], "none": [None], "empty": ["", " "], "spaced": [" 1 ", "2"]}
    long = [("t", i, n, k, v) for i, (n, vs) in enumerate(cols.items()) for k, v in enumerate(vs)]
    df = spark.createDataFrame(long, "table_id string, ordinal int, name string, row_id long, value string")
    want = {"eighty": "numeric", "less": "string", "dates": "date", "none": "string", "empty": "string", "spaced": "numeric"}
    assert {r.name: r.datatype for r in profile.profile_cells(df).collect()} == want
    assert {r.name: r.datatype for r in profile.profile_cells(df, 200).collect()} == want


def test_sample_takes_the_first_values(spark):
    rows = [(i, None if i < 5 else "1" if i < 205 else "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v string")
    one = profile.profile_cells(profile.cells(df, "t", "id"), 200).first()
    assert (one.n_values, one.datatype) == (200, "numeric")


def _meta(spark, rows):
    full = [("t", i, n, "string", e, u, "", d, None) for i, (n, e, u, d) in enumerate(rows)]
    return spark.createDataFrame(full, META)


def test_merge_modes(spark):
    cur = _meta(spark, [("a", "old", "", "d"), ("b", "", "u", ""), ("a", "twin", "", "")])
    new = spark.createDataFrame([("t", "a", 1, "new", "", None), ("t", "a", 2, "", "m", None), ("t", "b", 1, "e", None, " "), ("t", "zzz", 1, "x", "x", "x")], "table_id string, name string, seq int, element string, unit string, description string")
    see = ("ordinal", "element", "unit", "description")
    assert _rows(merge.merged(cur, new), *see) == [(0, "old", "", "d"), (1, "", "u", ""), (2, "twin", "", "")]
    assert _rows(merge.merged(cur, new, "fill_blanks"), *see) == [(0, "old", "m", "d"), (1, "e", "u", " "), (2, "twin", "", "")]
    yes = merge.merged(cur, new, "yes")
    assert _rows(yes, *see) == [(0, "new", "m", "d"), (1, "e", "u", " "), (2, "twin", "", "")]
    assert _rows(merge.merged(yes, new, "yes"), *see) == _rows(yes, *see)
    assert _rows(merge.merged(cur, new, "yes_incl_blanks"), *see) == [(0, "", "m", None), (1, "e", None, " "), (2, "twin", "", "")]
    with pytest.raises(ValueError, match="mode"):
        merge.merged(cur, new, "maybe")
    assert _rows(merge.difference(cur, yes), "ordinal", "change") == [(0, "changed"), (1, "changed")]


def test_linked(spark):
    obs = spark.createDataFrame([("s1", 1), (None, 2), ("s9", 3)], "site string, value int")
    sites = spark.createDataFrame([("s1", "A"), ("s1", "B"), (None, "N")], "site string, value string")
    got = linking.linked(obs, sites, "site", "site")
    assert got.columns == ["site", "value_obs", "value_site"]
    assert _rows(got, *got.columns) == sorted([("s1", 1, "A"), ("s1", 1, "B"), (None, 2, "N"), ("s9", 3, None)], key=str)
    other = linking.linked(obs, sites.withColumnRenamed("site", "id"), "site", "id")
    assert other.columns == ["site", "value_obs", "id", "value_site"]


def test_header_rows(spark):
    def sheet(name, grid):
        return [("f", name, r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)]

    cells = sheet("title", [["T", "", ""], ["a", " b ", ""], ["1", "2", "3"]]) + sheet("top", [["x", "y", "z"], ["1", "", ""]]) + sheet("none", [["", "", ""], ["1", "", ""]])
    df = spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string")
    assert _rows(tables.header_rows(df), "sheet", "header_row") == [("none", 0), ("title", 1), ("top", 0)]
    wide = tables.as_table(tables.with_header(df.where("sheet = 'title'")))
    assert wide.columns == ["a", "b", "col_2"]
    assert _rows(wide, "a", "b", "col_2") == [("1", "2", "3")]


def test_delimiter_below_a_long_preamble(spark, tmp_path):
    text = ["# note, one"] * 60 + [f"a{i};b;c" for i in range(100)]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text)], "file string, line_no long, value string")
    assert _rows(tables.sniffed(lines), "file", "delimiter", "found") == [("f", ";", True)]
    (tmp_path / "b.csv").write_text("\n".join(["x;y;z", *text]))
    assert tables.read_delimited(spark, str(tmp_path / "b.csv")).columns == ["x", "y", "z"]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name;Größe;name\n"x;y";1,5;NA\nz;;3\n'.encode("cp1252"))
    df = tables.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["name", "Größe", "name.1"]
    assert _rows(df, *df.columns) == [("x;y", "1,5", None), ("z", None, "3")]
    lines = spark.createDataFrame([("one", 0, "a"), ("one", 1, "b"), ("tab", 0, "a\tb,c"), ("tab", 1, "d\te")], "file string, line_no long, value string")
    assert _rows(tables.sniffed(lines), "file", "delimiter", "found") == [("one", ",", False), ("tab", "\t", True)]


def test_workbook(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"><c r="A2"><v>4.5</v></c></row></sheetData></worksheet>')
    got = tables.read_sheets(spark, str(tmp_path / "b.xlsx"))
    assert _rows(got, "sheet", "row", "col", "value") == [("S", 0, 0, "head"), ("S", 0, 27, "in"), ("S", 1, 0, "4.5")]


def test_documents(spark, tmp_path):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/></w:document>')
    (tmp_path / "a.docx").write_bytes(body.getvalue())
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    got = context.read_documents(spark, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == ["", "one two\n"]
    more = context.read_documents(spark, str(tmp_path), {".pdf": lambda c: "pdf"})
    assert sorted(r.text for r in more.collect()) == ["one two\n", "pdf"]
    docs = spark.createDataFrame([("t", 2, " b "), ("t", 1, "a")], "table_id string, seq int, text string")
    assert context.assembled(docs).first().context == "a\nb\n"


def test_uri_dedup_and_ties(spark):
    hits = spark.createDataFrame([(1, 10, "u", "altLabel", 0.1), (1, 11, "u", "prefLabel", 0.9), (1, 12, "v", "other", 0.2), (1, 13, "v", "altLabel", 0.5), (1, 15, "w", "altLabel", 0.3), (1, 14, "w", "altLabel", 0.3)], "query long, id long, uri string, qc_label string, distance double")
    assert _rows(match.preferred(hits), "id") == [(11,), (13,), (14,)]


def test_nearest_forms_agree(spark):
    rows = [(i, [float((i * 7) % 11), float((i * 3) % 5), 1.0]) for i in range(60)]
    terms = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = terms.withColumnRenamed("id", "query")
    for metric in ("l2sq", "cosine"):
        a, b = (f(asked, terms, 4, metric).select("query", "rank", F.round("distance", 6).alias("d")) for f in (match.nearest_by_expression, match.nearest))
        assert _rows(a, "query", "rank", "d") == _rows(b, "query", "rank", "d")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], "x"), ([0.0, 0.0], None, " nan ")], "w array<double>, d array<double>, t string")
    got = df.select(vectors.normalised(F.col("w")).alias("n"), vectors.blended(F.col("w"), F.col("d")).alias("b"), vectors.is_definition(F.col("t")).alias("t")).collect()
    assert got[0].n == [0.6, 0.8]
    assert got[0].b == pytest.approx([0.4 * 3 + 0.6, 1.6])
    assert (got[1].n, got[1].b, got[0].t, got[1].t) == ([0.0, 0.0], [0.0, 0.0], True, False)


def test_dates_are_those_of_the_calendar(spark):
    import calendar
    import itertools

    names = [n.lower() for n in calendar.month_abbr]

    def real(y, m, d):
        return len(y) <= 4 and len(m) <= 2 and len(d) <= 2 and 1 <= int(m) <= 12 and 1 <= int(d) <= (29 if int(m) == 2 and calendar.isleap(int(y)) else 28 if int(m) == 2 else calendar.mdays[int(m)])

    values, want = [], []
    for (y, m, d), sep in itertools.product(itertools.product(("0", "4", "99", "100", "0400", "1900", "2000", "2023", "2024"), ("0", "1", "02", "2", "4", "9", "11", "12", "13"), ("0", "1", "09", "28", "29", "30", "31", "32")), "-/."):
        for x in ((y, m, d), (m, d, y), (d, m, y)):
            values.append(sep.join(x))
            want.append(any(real(*o) for o in ((x[0], x[1], x[2]), (x[2], x[0], x[1]), (x[2], x[1], x[0]))))
        if sep == "-" and 1 <= int(m) <= 12:
            values += [f"{d}-{names[int(m)].upper()}-{y}", f"{y}-{m}", f"{m}/{y}", f"{names[int(m)]}-{y}"]
            want += [real(y, m, d), *[len(y) == 4] * 3]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", predicates.is_date(F.col("v")).alias("d")).orderBy("i").collect()
    assert [v for v, g, w in zip(values, got, want, strict=True) if g.d != w] == []


def test_change_groups(spark):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(["b", None, None, "a", "a"])], "table_id string, at int, v string")
    got = select.change_groups(df, "v", ["table_id"], ["at"])
    assert got.columns[0] == "marker"
    assert [r.group_id for r in got.orderBy("at").collect()] == [1, 2, 2, 3, 3]


def test_summary_and_write_back(spark):
    hits = spark.createDataFrame(
        [("t", "a", 0, "l1", "u2", True), ("t", "a", 0, "l1", "u1", True), ("t", "a", 0, "l2", "u1", True), ("t", "b", 1, "l3", "u3", False)],
        "table_id string, header string, ordinal int, label string, uri string, selected boolean",
    )
    got = pipelines.chosen(_meta(spark, [("a", "old", "", ""), ("b", "old", "", ""), ("c", "old", "", "")]), hits)
    assert _rows(got, "name", "element") == [("a", "l1 || l2"), ("b", ""), ("c", "old")]
    maps = {r.name: r.element_uri for r in got.collect()}
    assert maps == {"a": {"l1": "u1", "l2": "u1"}, "b": {}, "c": None}


def test_answers(spark):
    forms = ['{"a": "x", "n": {"k": 1}}', '```json\n{"a": "y"}\n```', 'Well: {"a": "z"} there', "none", '{"a": ']
    got = answers.described(spark.createDataFrame([(str(i), f) for i, f in enumerate(forms)], "table_id string, response string"))
    assert _rows(got, "table_id", "name", "description", "parse_error") == [("0", "a", "x", False), ("0", "n", '{"k":1}', False), ("1", "a", "y", False), ("2", "a", "z", False), ("3", None, None, True), ("4", None, None, True)]


def test_described_asks_only_what_is_new(spark):
    ctx = spark.createDataFrame([("t", "p", "text one", ["a"]), ("s", "p", "text two", ["a"])], "table_id string, provider string, context string, variables array<string>")
    cache = spark.createDataFrame([], answers.CACHE)
    cur = _meta(spark, [("a", "", "", "")])
    done, cache = pipelines.described(cur, ctx.where("table_id = 't'"), cache, lambda name, prompt: '{"a": "from ' + name + '"}')
    assert _rows(done, "name", "description") == [("a", "from p")]
    again, _ = pipelines.described(cur, ctx.where("table_id = 't'"), cache, lambda name, prompt: 1 / 0)
    assert _rows(again, "description") == [("from p",)]
    assert _rows(cache, "version", "context_excerpt") == [(1, "text one")]


def test_cache_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert answers.read_cache(spark, path).count() == 0
    row = ("k", "x", ["a"], "r", 1, None, "p")
    answers.store_cache(spark.createDataFrame([row], answers.CACHE), path)
    old = answers.read_cache(spark, path)
    new = spark.createDataFrame([("k", "c" * 600, ["a"], "again", "p"), ("l", "d", ["a"], "r", "p")], "cache_key string, context string, variables array<string>, response string, provider string")
    answers.store_cache(answers.upserted(old, new), path)
    assert _rows(answers.read_cache(spark, path).withColumn("n", F.length("context_excerpt")), "cache_key", "version", "response", "n") == [("k", 2, "again", 500), ("l", 1, "r", 1)]


def test_export_and_back(spark):
    rows = [("t", 0, "a", "numeric", "E", "m", "", "d", {"E": "http://e"}), ("t", 1, "b", "string", "", "", "", None, None), ("t", 2, "c", "", "F", "", "how", 'q "x"', {"F": "http://f"})]
    cur = spark.createDataFrame(rows, META)
    ts = export.to_table_schema(cur).first().json
    assert ts.endswith('"primaryKey":null}')
    assert '{"name":"b","type":"string"}' in ts
    want = [(r[2], r[3], r[4], r[5], r[6], r[7] or "", r[8]) for r in rows]
    for docs in (export.to_table_schema(cur), export.to_csvw(cur)):
        assert _rows(metadata.from_json(docs), "name", "datatype", "element", "unit", "method", "description", "element_uri") == sorted(want, key=str)
    assert pipelines.exported(cur, "csvw").count() == 1
    assert vectors.model_folder("a/b") == "a--b"
    odd = spark.createDataFrame([("t", '{"fields": [{"name": "a", "title": "E", "element_uri": "http://plain"}]}'), ("w", '{"tableSchema": {"columns": [{"name": "a", "titles": "one", "null": "under null"}]}}'), ("x", "{}")], "table_id string, json string")
    got = {r.table_id: r for r in metadata.from_json(odd).collect()}
    assert got["t"].element_uri == {"E": "http://plain"}
    assert (got["w"].element, got["w"].description) == ("one", "under null")
    assert _rows(metadata.rejected(odd), "table_id") == [("x",)]


def test_metadata_files(spark, tmp_path):
    cur = spark.createDataFrame([("t", 0, "a", "numeric", "E", "m", "", "d", {"E": "http://e"})], META)
    export.write_csv(cur.coalesce(1), str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("*.csv"))
    got = metadata.read_metadata(spark, str(part), "t").first()
    assert (got["name"], got["element"], got["element_uri"]) == ("a", "E", {"E": "http://e"})
    (tmp_path / "bad.csv").write_text("Name,unit\na,b\n")
    with pytest.raises(ValueError, match="no column name"):
        metadata.read_metadata_csv(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="neither"):
        metadata.read_metadata(spark, "x.xls", "t")


def test_links_and_hints(spark):
    df = spark.createDataFrame([("v", "h", ["u1", "u2"]), ("v", "", [])], "n string, h string, u array<string>")
    got = df.select(text.hinted(F.col("n"), F.col("h")).alias("n"), text.links(F.col("u")).alias("l")).collect()
    assert got[0].n == "v (hint: h)"
    assert got[0].l == '<a href="u1" target="_blank">u1</a>, <a href="u2" target="_blank">u2</a>'
    assert (got[1].n, got[1].l) == ("v", "")


def test_hashed_vector_by_a_loop(spark):
    import hashlib
    import math
    import re

    def loop(text):
        v = [0] * 64
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
            v[h % 64] += 1 if h < 32768 else -1
        size = math.sqrt(sum(x * x for x in v))
        return [math.copysign(math.floor(abs(x) / size * 1024 + 0.5), x) / 1024 if size else 0.0 for x in v]

    texts = ["soil depth", "Depth, SOIL", "", None, "12_3 ü ß", "a " * 5000 + "b", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", vectors.hashed_vector(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [loop(t) for t in texts]


def test_matched_by_expression(spark):
    cur = _meta(spark, [("soil depth", "", "", "depth of soil"), ("air", "", "", "nan")])
    voc = spark.createDataFrame([(1, "u1", "soil depth", "d", "prefLabel"), (2, "u2", "air", "d", "prefLabel"), (3, "u1", "depth", "d", "altLabel")], "id long, uri string, label string, definition string, qc_label string")
    got = pipelines.matched(cur, voc.withColumn("embedding", vectors.hashed_vector(F.col("label"))), vectors.hashed_vector, k=3, native=True)
    assert _rows(select.best_selected(got, ("table_id", "header")).where("selected"), "header", "id", "uri") == [("air", 2, "u2"), ("soil depth", 1, "u1")]
    assert len(_rows(got, "header", "uri")) == 4


def test_matched(spark):
    cur = _meta(spark, [("soil depth", "", "", "depth of soil"), ("air", "", "", "")])
    words = [(1, "u1", "soil depth", "d", "prefLabel"), (2, "u2", "air", "d", "prefLabel"), (3, "u1", "depth", "d", "altLabel")]
    voc = spark.createDataFrame(words, "id long, uri string, label string, definition string, qc_label string")
    encoder = vectors.hashing_encoder()
    voc = vectors.encoded(voc, "label", encoder)
    got = pipelines.matched(cur, voc, encoder, k=2)
    best = select.best_selected(got, ("table_id", "header")).where("selected")
    assert _rows(best, "header", "label") == [("air", "air"), ("soil depth", "soil depth")]


def test_streamed_counts_add_up(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "2024-01-01") for i in range(100)], "n string, d string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start_counts(source, "t", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = stream.total_profile(spark.read.parquet(str(tmp_path / "out")))
    assert _rows(got, "name", "n_values", "datatype") == [("d", 100, "date"), ("n", 100, "numeric")]


def test_a_column_without_cells_keeps_its_place(spark):
    cells = [("f", "s", 0, c, v) for c, v in enumerate("abc")] + [("f", "s", 1, 0, "1"), ("f", "s", 1, 2, "3"), ("f", "s", 2, 3, "x")]
    df = spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string")
    wide = tables.sheet_table(df)
    assert wide.columns == ["a", "b", "c", "col_3"]
    assert _rows(wide, *wide.columns) == sorted([("1", None, "3", None), (None, None, None, "x")], key=str)
    bare = tables.as_table(tables.with_header(df))
    assert _rows(bare, "a", "c") == sorted([("1", "3"), (None, None)], key=str)


def test_change_groups_across_ranges(spark):
    import random

    random.seed(1)
    rows = [("big", i, random.choice(["a", "a", "b", None])) for i in range(3000)] + [(t, i, v) for t in (None, "s", "t") for i, v in enumerate("aab")] + [("one", 1, None)]
    rows += [("same", i, "x") for i in range(500)]
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, "k") for r in rows], "t string, `o.1` int, value string, `group` string").repartition(5)
    got = select.change_groups_across(df, "value", ["t"], ["o.1"])
    want = select.change_groups(df.withColumnRenamed("o.1", "o"), "value", ["t"], ["o"]).withColumnRenamed("o", "o.1")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert max(r.group_id for r in got.collect()) > 1000
    assert select.change_groups_across(df.where("false"), "value", ["t"], ["o.1"]).count() == 0


def test_streamed_requests_equal_those_of_whole_contexts(spark):
    wide = "ü€😀 " * 3000
    docs = [("t", 2, " b "), ("t", 1, "\n\t a"), ("t", 3, None), ("t", 4, wide), ("t", 4, wide), ("t", 5, " \n "), ("s", 1, ""), ("s", 2, "\n"), ("v", 1, "not asked"), ("w", None, "x"), ("w", 0, "y"), (None, 1, "no name"), ("long", 1, "z" * 40_000), ("long", 2, wide)]
    asks = [("t", " p ", ["a", "b"]), ("t", None, None), ("s", "p", []), ("u", "p", ["a"]), ("w", "q", ["a"]), (None, "p", ["a"]), ("long", "p", ["a"])]
    documents, asked = spark.createDataFrame(docs, "table_id string, seq int, text string"), spark.createDataFrame(asks, "table_id string, provider string, variables array<string>")
    got = context.streamed_requests(documents, asked)
    whole = asked.alias("q").join(context.assembled(documents).withColumnRenamed("table_id", "k"), F.col("table_id").eqNullSafe(F.col("k")), "left")
    want = answers.requests(whole.select("table_id", "provider", "context", "variables"))
    names = ("table_id", "provider", "variables", "cache_key", "prompt")
    assert _rows(got, *names) == _rows(want, *names)
    assert {r.table_id: len(r.context) for r in got.collect()}["long"] == text.CONTEXT_CHARS
    assert context.streamed_requests(documents.where("false"), asked.where("false")).count() == 0


def test_a_context_of_any_size_takes_bounded_memory():
    """256 MB go through the feed in pieces; what it holds stays below 2 MB."""
    import hashlib
    import tracemalloc

    piece = b"word " * 800
    feed = context._Feed()
    feed.ask("p", ["a"], "p", "a")
    tracemalloc.start()
    for _ in range(64_000):
        feed.add(piece)
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()
    _, _, head, key = next(feed.rows())
    whole = hashlib.sha256(b"p|" + (piece * 64_000)[:-1] + b"|a").hexdigest()
    assert (len(head), key) == (text.CONTEXT_CHARS, whole)


def test_nothing_selected_changes_nothing(spark):
    hits = spark.createDataFrame([("t", "a", 0, "l1", "u1", False), ("s", "a", 0, "l1", "u1", True), ("s", "b", 1, "l2", "u2", False)], "table_id string, header string, ordinal int, label string, uri string, selected boolean")
    cur = _meta(spark, [("a", "old", "", ""), ("b", "old", "", "")])
    both = cur.unionByName(cur.withColumn("table_id", F.lit("s")))
    assert _rows(pipelines.chosen(both, hits), "table_id", "name", "element") == [("s", "a", "l1"), ("s", "b", ""), ("t", "a", "old"), ("t", "b", "old")]


def test_nearest_of_odd_vectors(spark):
    terms = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, []), (7, [float("nan"), 0.0]), (None, [0.0, 1.0])], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (8, None), (9, [1.0, 2.0, 3.0]), (10, [2.0])], "query long, vector array<float>")
    for f in (match.nearest_by_expression, match.nearest):
        assert _rows(f(asked, terms), "query", "id", "distance") == [(1, 1, 0.0), (1, 2, 41.0), (10, 5, 1.0)]
        assert _rows(f(asked, terms, exclude_same_id=True), "query", "id") == [(1, 2), (10, 5)]
        assert f(asked.where("false"), terms).count() == f(asked, terms.where("false")).count() == 0


def test_one_call_for_each_distinct_request(spark, tmp_path):
    ctx = spark.createDataFrame([("t", "p", "same", ["a"]), ("s", "p", "same", ["a"]), ("u", None, None, ["a"]), ("v", None, None, ["a"]), ("w", "p", "known", ["a"])], "table_id string, provider string, context string, variables array<string>").repartition(3)
    calls = tmp_path / "calls"
    calls.mkdir()

    def provider(name, prompt):
        import uuid

        (calls / uuid.uuid4().hex).write_text(prompt)
        return '{"a": "%s"}' % uuid.uuid4().hex

    cache = answers.upserted(spark.createDataFrame([], answers.CACHE), answers.requests(ctx.where("context = 'known'")).withColumn("response", F.lit('{"a": "from the cache"}')))
    cur = spark.createDataFrame([(t, 0, "a", "string", "", "", "", "", None) for t in "tsuvw"], META)
    done, new = pipelines.described(cur, ctx, cache, provider)
    first, second = _rows(done, "table_id", "description"), _rows(done, "table_id", "description")
    kept = _rows(new, "cache_key", "response", "version")
    got = dict(first)
    assert first == second
    assert len(list(calls.iterdir())) == 2
    assert got["t"] == got["s"] != got["u"] == got["v"]
    assert got["w"] == "from the cache"
    assert {got[x] for x in "tuw"} == {r[1].split('"')[3] for r in kept}


def _asked(spark, n, parts=3):
    rows = [(f"t{i}", "p", f"context {i}", ["a"]) for i in range(n)]
    return answers.requests(spark.createDataFrame(rows, "table_id string, provider string, context string, variables array<string>").repartition(parts))


def _counting(folder, every=3, refuses="none", dies=None):
    """A provider that keeps a file for each call. It fails every third call of a task, or for good on what `refuses` says; with dies, its worker goes once after four calls."""
    calls = 0

    def provider(name, prompt):
        import uuid

        nonlocal calls
        if dies and calls == 4 and not dies.exists():
            dies.write_text("")
            raise SystemExit("the worker is gone")
        calls += 1
        (folder / uuid.uuid4().hex).write_text(prompt)
        if refuses in prompt:
            raise ValueError("refused")
        if every and calls % every == 0:
            raise TimeoutError("late")
        return '{"a": "%s"}' % prompt.rsplit("\n", 1)[1]

    return provider


def test_nearest_of_text_ids(spark):
    terms = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [5.0, 5.0]), ("é", [0.0, 1.0]), (None, [1.0, 1.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([("a", [0.0, 1.0]), ("q", [5.0, 4.0])], "query string, vector array<double>")
    for f in (match.nearest_by_expression, match.nearest):
        assert _rows(f(asked, terms, k=2), "query", "id", "rank") == [("a", "a", 1), ("a", "é", 2), ("q", "a", 2), ("q", "b", 1)]
        assert _rows(f(asked, terms, k=1, exclude_same_id=True), "query", "id") == [("a", "é"), ("q", "b")]
        assert _rows(f(asked.select(F.lit(7).alias("query"), "vector").limit(1), terms, k=1), "query", "id") in ([(7, "a")], [(7, "b")])


def test_failing_calls_are_made_again_and_counted(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    got = answers.generated(_asked(spark, 30), _counting(calls, refuses="context 7"), retries=2, journal=f"file://{tmp_path}/kept").select("context", "response", "error", "attempts").collect()
    assert {r.context: r.response for r in got} == {f"context {i}": None if i == 7 else '{"a": "context %d"}' % i for i in range(30)}
    assert [(r.error, r.attempts) for r in got if r.error] == [("ValueError: refused", 3)]
    made = len(list(calls.iterdir()))
    assert made == sum(r.attempts for r in got)
    again = answers.generated(_asked(spark, 30), _counting(calls, every=0), journal=f"file://{tmp_path}/kept").where("error is null").count()
    assert again == 30
    assert len(list(calls.iterdir())) == made + 1  # all but the refused one were kept as they arrived


def test_a_task_that_dies_never_pays_twice(spark, tmp_path):
    """The task fails after some answers have arrived; those are kept, and the next attempt calls for the rest."""
    calls = tmp_path / "calls"
    calls.mkdir()

    asked = _asked(spark, 12, 1)
    with pytest.raises(Exception, match="gone|SystemExit"):
        answers.generated(asked, _counting(calls, every=0, dies=tmp_path / "died"), journal=f"file://{tmp_path}/kept").collect()
    assert len(list(calls.iterdir())) == 4
    got = answers.generated(asked, _counting(calls, every=0, dies=tmp_path / "died"), journal=f"file://{tmp_path}/kept").collect()
    assert len(got) == 12
    assert all(r.response for r in got)
    assert len(list(calls.iterdir())) == 12


def test_errors_of_a_provider_are_rows(spark, tmp_path):
    ctx = spark.createDataFrame([("t", "p", "good", ["a"]), ("s", "p", "bad", ["a"]), ("u", "p", "bad", ["a"]), ("v", "p", "mute", ["a"])], "table_id string, provider string, context string, variables array<string>")

    def provider(name, prompt):
        if prompt.endswith("bad"):
            raise RuntimeError("no such model")
        return "I cannot say." if prompt.endswith("mute") else '{"a": "fine"}'

    cur = spark.createDataFrame([(t, 0, "a", "string", "", "", "", "own", None) for t in "tsuv"], META)
    done, cache, errors = pipelines.described_with_errors(cur, ctx, spark.createDataFrame([], answers.CACHE), provider, f"file://{tmp_path}/out", retries=1)
    assert _rows(done, "table_id", "description") == [("s", "own"), ("t", "fine"), ("u", "own"), ("v", "own")]
    assert _rows(errors, "table_id", "error", "attempts") == [("s", "RuntimeError: no such model", 2), ("u", "RuntimeError: no such model", 2), ("v", "no JSON object in the answer", 1)]
    assert sorted(r.response for r in cache.collect()) == ["I cannot say.", '{"a": "fine"}']


def _answers(spark, keys, response="r"):
    return spark.createDataFrame([(k, f"context {k}", ["a"], response, "p") for k in keys], "cache_key string, context string, variables array<string>, response string, provider string")


def test_writers_keep_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/cache"
    assert answers.cache_version(spark, path) == answers.read_cache(spark, path).count() == 0
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda w: answers.upsert_cache(_answers(spark, [f"k{w}", "all"]), path), range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    assert _rows(answers.read_cache(spark, path), "cache_key", "version") == [("all", 4), ("k0", 1), ("k1", 1), ("k2", 1), ("k3", 1)]


def test_a_base_that_is_no_longer_the_last_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    first = answers.upsert_cache(_answers(spark, "a"), path)
    old = answers.read_cache(spark, path)
    mine = answers.upserted(old, _answers(spark, "b"))
    answers.upsert_cache(_answers(spark, "c"), path)
    with pytest.raises(answers.CacheConflict):
        answers.store_cache(mine, path, first)
    assert _rows(answers.read_cache(spark, path), "cache_key") == [("a",), ("c",)]
    assert old.count() == 1  # a reader's version stays while newer ones come
    for i in range(4):
        answers.upsert_cache(_answers(spark, str(i)), path)
    assert len(list((tmp_path / "cache" / "data").iterdir())) == answers.KEPT + 1
    assert len([p for p in (tmp_path / "cache" / "commits").iterdir() if not p.name.startswith(".")]) == answers.KEPT + 1
    assert answers.cache_version(spark, path) == 6


def test_a_large_sheet_takes_little_memory():
    """200,000 cells, half of them shared strings, pass without a tree of them."""
    import tracemalloc

    space, out = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}">' + "".join(f"<si><r><t>text </t></r><r><t>{i}</t></r></si>" for i in range(50_000)) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData>' + "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i % 50_000}</v></c><c r="AB{i}"><v>{i}.5</v></c></row>' for i in range(1, 100_001)) + "</sheetData></worksheet>")
    content, n, last = out.getvalue(), 0, None
    tracemalloc.start()
    for cell in tables._sheet_cells(content):
        n, last = n + 1, cell
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, last) == (200_000, ("S", 99_999, 27, "100000.5"))
    assert peak < 8_000_000


def test_wide_rows_of_all_sheets(spark):
    cells = [("f", "s", 0, 0, "title"), ("f", "s", 1, 0, "k"), ("f", "s", 1, 1, "v"), ("f", "s", 1, 2, "v"), ("f", "s", 2, 0, "1"), ("f", "s", 2, 2, "3"), ("f", "s", 4, 3, "x"), ("g", "s", 0, 0, "a"), ("g", "s", 1, 0, "b")]
    got = tables.wide_rows(spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string"))
    assert _rows(got, "file", "row_id", "names", "values") == sorted([("f", 0, ["k", "v", "v.1", "col_3"], ["1", None, "3", None]), ("f", 2, ["k", "v", "v.1", "col_3"], [None, None, None, "x"]), ("g", 0, ["a"], ["b"])], key=str)


def test_many_files(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes('name;Größe;name\r\n"x;y";1,5;NA\r\nz;;3\r\n'.encode("cp1252"))
    (tmp_path / "b.csv").write_text('k,t\n1,"two\nlines"\n2,"a ""b"""\n')
    (tmp_path / "c.txt").write_text("only\n1\n2\n")
    (tmp_path / "d.csv").write_text("\ufeffk,t\n9,ü\n")
    got = [(r.file.rsplit("/", 1)[1].replace("%20", " "), r.ordinal, r.name, r.value) for r in tables.read_many(spark, [str(p) for p in tmp_path.iterdir()]).orderBy("file", "row_id", "ordinal").collect()]
    want = [("a b.csv", i, n, v) for row in (("x;y", "1,5", None), ("z", None, "3")) for i, (n, v) in enumerate(zip(("name", "Größe", "name.1"), row, strict=True))]
    want += [("b.csv", 0, "k", "1"), ("b.csv", 1, "t", "two\nlines"), ("b.csv", 0, "k", "2"), ("b.csv", 1, "t", 'a "b"'), ("c.txt", 0, "only", "1"), ("c.txt", 0, "only", "2"), ("d.csv", 0, "k", "9"), ("d.csv", 1, "t", "ü")]
    assert got == want


def test_files_are_split_and_rows_stay_in_order(spark, tmp_path):
    (tmp_path / "big.csv").write_text("k,v\n" + "".join(f"{i},x{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        cells = tables.read_many(spark, str(tmp_path / "big.csv"))
        assert cells.rdd.getNumPartitions() > 4
        assert [r.value for r in cells.where("ordinal = 0").orderBy("row_id").collect()] == [str(i) for i in range(20000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dates_of_workbooks():
    from datetime import datetime

    assert tables._as_date("43831", datetime(1899, 12, 30)) == "2020-01-01"
    assert tables._as_date("43831.5", datetime(1899, 12, 30)) == "2020-01-01 12:00:00"
    assert tables._as_date("42369", datetime(1904, 1, 1)) == "2020-01-01"


def test_bad_metadata_files_stop_only_themselves(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,unit\nx,m\n")
    (tmp_path / "b.csv").write_text("Name,unit\nx,m\n")
    (tmp_path / "c.json").write_text('{"other": 1}')
    (tmp_path / "d.json").write_text('{"fields": [{"name": "y"}]}')
    (tmp_path / "f.csv").write_text("")
    rows, errors = metadata.read_metadata_files(spark, {n: str(tmp_path / n) for n in ("a.csv", "b.csv", "c.json", "d.json", "e.xls", "f.csv") if n == "e.xls" or (tmp_path / n).exists()})
    assert _rows(rows, "table_id", "name", "unit") == [("a.csv", "x", "m"), ("d.json", "y", "")]
    assert [r[0] for r in _rows(errors, "table_id")] == ["b.csv", "c.json", "e.xls", "f.csv"]


def test_metadata_of_odd_files(spark):
    """Every odd file has its own outcome: rows, or one row that says what is wrong."""
    files = {
        "fields.json": b'{"fields": {"name": "a"}}',
        "empty.json": b'{"fields": [], "tableSchema": {"columns": []}}',
        "schema.json": b'{"tableSchema": {}}',
        "both.json": b'{"fields": [], "tableSchema": {"columns": [{"name": "b", "titles": "B", "null": "gone"}]}}',
        "list.json": b'{"fields": ["a", {"name": "b"}]}',
        "number.json": b'{"fields": [{"name": "n", "unit": 3}]}',
        "broken.json": b'{"fields": [',
        "latin.json": '{"fields": [{"name": "ü"}]}'.encode("cp1252"),
        "null.json": b"null",
        "latin.csv": "name;Größe;UNIT\nü;1;m\nv;;NA\n".encode("cp1252"),
        "bom.csv": "\ufeffname|unit\n\"a\nb\"|m\n\n".encode(),
        "head.csv": b"name,unit\n",
        "table.csv": b"table_id,name,element,element_uri\nt,x,E,http://e\nt,y,E,\"{\"\"F\"\": \"\"http://f\"\"}\"\n",
        "case.csv": b"NAME,unit\na,b\n",
        "none.csv": b"",
        "x.CSV": b"name\nq\n",
        "x.ods": b"PK",
    }
    got = metadata.metadata_of_files(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()
    assert all((r["_error"] is None) == (r["seq"] is not None) for r in got)
    bad = {r["path"] for r in got if r["_error"]}
    assert bad == {"fields.json", "empty.json", "schema.json", "list.json", "broken.json", "latin.json", "null.json", "case.csv", "none.csv", "x.ods"}
    good = sorted((r["path"], r["seq"], r["table_id"], r["name"], r["element"], r["unit"], r["description"], r["element_uri"]) for r in got if not r["_error"])
    assert good == [
        ("bom.csv", 0, None, "a\nb", None, "m", None, None),
        ("both.json", 0, None, "b", "B", "", "gone", None),
        ("latin.csv", 0, None, "ü", None, "m", None, None),
        ("latin.csv", 1, None, "v", None, None, None, None),
        ("number.json", 0, None, "n", "", "3", "", None),
        ("table.csv", 0, "t", "x", "E", None, None, {"E": "http://e"}),
        ("table.csv", 1, "t", "y", "E", None, None, {"F": "http://f"}),
        ("x.CSV", 0, None, "q", None, None, None, None),
    ]
    assert metadata.metadata_of_files(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_typed_columns_are_not_read_as_text(spark):
    df = spark.sql("select cast(1 as int) as i, cast('nan' as double) as x, date '2020-01-01' as d, timestamp '2020-01-01 00:00:00' as t, true as b, cast(null as bigint) as z, ' 1,5 ' as s, ' ' as w")
    got = profile.profile(df, "t")
    assert {r.name: (r.n_values, r.datatype) for r in got.collect()} == {"i": (1, "numeric"), "x": (1, "numeric"), "d": (1, "date"), "t": (1, "date"), "b": (1, "string"), "z": (0, "string"), "s": (1, "numeric"), "w": (0, "string")}
    plan = profile.profile(df.select("i", "x", "d", "t", "z"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_scripts_end_at_their_own_tag(spark):
    df = spark.createDataFrame([("a<script>x</style>y</script>b<STYLE>p</STYLE >c",)], "h string")
    assert df.select(text.plain_html(F.col("h"))).first()[0] == "a b c"
