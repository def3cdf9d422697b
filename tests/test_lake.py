"""Profiles of many files against those of single tables."""

import datetime
import decimal

import pyarrow as pa
import pytest
from pyarrow import parquet

from colmeta.operators import profile
from colmeta.plans import pipelines
from colmeta.sources import lake


def _rows(df):
    return sorted((r.table_id, r.ordinal, r.name, r.n_values, r.n_numeric, r.n_date, r.datatype) for r in df.collect())


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A thousand tables, each of its own columns."""
    base = tmp_path_factory.mktemp("lake")
    for i in range(1000):
        columns = {f"a{i}": [str(i), None, " "], f"b{i % 7}": [i, None, 3], f"c {i}": ["2024-01-01", "x", f"0{i % 9 + 1}/02/2024"]}
        parquet.write_table(pa.table(columns), base / f"t{i:04d}.parquet")
    return base


def test_a_plan_of_one_size(spark, many):
    def plan(n):
        files = spark.createDataFrame([(f"t{i:04d}", f"file://{many}/t{i:04d}.parquet") for i in range(n)], "table_id string, path string")
        return lake.profile_files(files)

    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(plan(1000)) == size(plan(3))
    got = _rows(plan(1000))
    assert len(got) == 3000
    for i in (0, 17, 999):
        assert [r for r in got if r[0] == f"t{i:04d}"] == _rows(profile.profile(spark.read.parquet(f"{many}/t{i:04d}.parquet"), f"t{i:04d}"))


def test_every_kind_of_column(spark, tmp_path):
    day, then = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1, 1)
    table = pa.table(
        {
            "text": ["1,5", " 2 ", "", None, "x"],
            "day": pa.array([day, None, day, day, day]),
            "then": pa.array([then, then, None, None, None]),
            "money": pa.array([decimal.Decimal("1.5"), None, None, None, None]),
            "real": [1.0, float("nan"), None, 2.0, float("inf")],
            "flag": [True, False, None, None, None],
            "list": [[1], [], None, [2], [3]],
            "raw": pa.array([b"7", b"8", None, b"9", b"2"], pa.binary()),
            "coded": pa.array(["2024-01", "2024-02", None, "2024-01", "2024-01"]).dictionary_encode(),
            "none": pa.array([None] * 5, pa.string()),
            "a.b": ["1"] * 5,
        }
    )
    parquet.write_table(table, tmp_path / "all kinds.parquet", row_group_size=2)
    files = lake.table_files(spark, {"t": str(tmp_path / "all kinds.parquet")})
    got, want = _rows(lake.profile_files(files)), _rows(profile.profile(spark.read.parquet(str(tmp_path / "all kinds.parquet")), "t"))
    assert got == want
    assert [r.datatype for r in pipelines.lake_metadata(files).orderBy("ordinal").collect()] == [r[-1] for r in want]


def test_files_of_one_table_and_empty_ones(spark, tmp_path):
    parquet.write_table(pa.table({"a": [1, 2], "b": ["x", None]}), tmp_path / "1.parquet")
    parquet.write_table(pa.table({"c": ["2024-01-01"], "a": [3]}), tmp_path / "2.parquet")
    parquet.write_table(pa.table({"a": pa.array([], pa.int64()), "d": pa.array([], pa.string())}), tmp_path / "3.parquet")
    (tmp_path / "notes.txt").write_text("no table")
    got = _rows(lake.profile_files(lake.table_files(spark, {"t": str(tmp_path)})))
    assert got == [("t", 0, "a", 3, 3, 0, "numeric"), ("t", 0, "c", 1, 0, 1, "date"), ("t", 1, "b", 1, 0, 0, "string"), ("t", 1, "d", 0, 0, 0, "string")]
    assert lake.profile_files(spark.createDataFrame([], "table_id string, path string")).count() == 0
