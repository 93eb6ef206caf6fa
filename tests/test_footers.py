"""Time ranges of Parquet files, each chosen and read by the file's own columns."""

import datetime as dt
import decimal

import pyarrow as pa
import pyarrow.parquet as pq

from rootloom.sources import files, footers


def test_each_file_has_its_own_time_column(spark, tmp_path):
    utc = lambda s: dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None)
    tables = {
        "stamp": pa.table({"x": [1, 2, 3], "Timestamp": pa.array([utc(50.5), None, utc(7)], pa.timestamp("ms"))}),
        "nanos": pa.table({"time": pa.array([3_000_000_000, 1], pa.timestamp("ns")), "ts": [1.0, 2.0]}),
        "number": pa.table({"start_time": pa.array([1700000000000, 1600000000000, None], pa.int64())}),
        "nan": pa.table({"ts": [float("nan"), 4.0, -2.0, None]}),
        "text": pa.table({"datetime": ["1970-01-02 00:00:00", "no time", None, "1970-01-01 00:01:00"]}),
        "digits": pa.table({"date": ["12", "1970-01-02", "9.5"]}),
        "day": pa.table({"date": pa.array([dt.date(1970, 1, 3), dt.date(1970, 1, 2)])}),
        "decimal": pa.table({"ts": pa.array([decimal.Decimal("1.50"), decimal.Decimal("-3.25")])}),
        "nulls": pa.table({"ts": pa.array([None, None], pa.float64())}),
        "none": pa.table({"a": [1], "b": ["x"]}),
        "empty": pa.table({"ts": pa.array([], pa.int64())}),
        "nested": pa.table({"time": [[1, 2], [3]], "ts": [1, 2]}),
    }
    (tmp_path / "deep").mkdir()
    for name, table in tables.items():
        pq.write_table(table, tmp_path / "deep" / f"{name}.parquet", row_group_size=2, write_statistics=name != "nanos")
    (tmp_path / "damaged.parquet").write_bytes(b"PAR1 nothing")
    rows = footers.footer_ranges(spark, f"file://{tmp_path}").collect()
    got = {r["path"].rsplit("/", 1)[-1][:-8]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(got) and got == {
        "stamp": (3, "Timestamp", 7.0, 50.5), "nanos": (2, "ts", 1.0, 2.0), "number": (3, "start_time", 1.6e12, 1.7e12), "nan": (4, "ts", -2.0, 4.0),
        "text": (4, "datetime", 60.0, 86400.0), "digits": (3, "date", 9.5, 12.0), "day": (2, "date", 86400.0, 172800.0), "decimal": (2, "ts", -3.25, 1.5),
        "nulls": (2, "ts", None, None), "none": (1, None, None, None), "empty": (0, "ts", None, None), "nested": (2, "ts", 1.0, 2.0), "damaged": (0, None, None, None),
    }
    catalog = files.file_catalog(spark, f"file://{tmp_path}")
    assert {r["path"].rsplit("/", 1)[-1][:-8]: (r["n_rows"], r["time_column"], r["start_time"], r["end_time"]) for r in catalog.collect()} == got
    assert footers.opens(str(tmp_path)) and footers.opens(f"file:{tmp_path}") and not footers.opens("elsewhere://host/folder")
    by_schema = {r["path"].rsplit("/", 1)[-1][:-8]: tuple(r)[1:] for r in files.schema_ranges(spark, catalog).collect()}
    # Files without rows have no row here, nor has what Spark can't read (damaged, nanoseconds); a file of numbers and other texts has both.
    assert by_schema == {k: v for k, v in got.items() if k not in ("empty", "damaged", "digits", "nanos", "nested")} | {"digits": (3, "date", 9.5, 86400.0), "nested": (2, "ts", 1.0, 2.0)}


def test_a_table_of_several_files_is_one_row(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as double) as ts").repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        rows = files.table_catalog(files.file_catalog(spark, folder, "*.parquet"), folder).collect()
        assert {r["name"]: (r["n_rows"], r["time_column"], r["start_time"], r["end_time"]) for r in rows} == {"many.parquet": (10, "ts", 0.0, 9.0), "one.parquet": (4, None, None, None)}
