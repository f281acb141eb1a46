import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import files, readers, sinks
from ledgerlens.streaming import live


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)


def test_formats():
    assert [readers.detect_format(p) for p in ("a.csv", "b.TXT", "c.tsv", "d.json", "e.parquet")] == [
        "csv", "csv", "tsv", "json", "parquet",
    ]
    assert readers.detect_format("x.dat", "csv") == "csv"
    with pytest.raises(ValueError):
        readers.detect_format("book.xlsx")


def test_csv_with_mark_quotes_and_unicode(spark, folder):
    path = f"{folder}/a.csv"
    write(path, '﻿name,value\n"Smith, ""J""\nII",1\nZoë,2\n'.encode(), "wb")
    rows = readers.read_table(spark, path, multiLine=True).collect()
    assert [tuple(r) for r in rows] == [('Smith, "J"\nII', 1), ("Zoë", 2)]
    assert readers.raw_header(spark, path) == ["name", "value"]


def test_repeated_header_and_empty_file(spark, folder):
    write(f"{folder}/d.csv", "id,name,id\n1,a,2\n")
    assert readers.raw_header(spark, f"{folder}/d.csv") == ["id", "name", "id"]
    write(f"{folder}/e.csv", "")
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{folder}/e.csv")


def test_json_array_and_millis(spark, folder):
    write(f"{folder}/a.json", '[\n {"id": 1, "order_date": 1780012800000},\n {"id": 2, "order_date": null}\n]')
    df = readers.read_millis(readers.read_table(spark, f"{folder}/a.json"), "order_date")
    assert [r["order_date"] for r in df.orderBy("id").collect()] == [dt.datetime(2026, 5, 29), None]


def test_nan_becomes_null(spark):
    df = readers.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "x double, y int"))
    assert tuple(df.first()) == (None, 1)


@pytest.mark.parametrize("kind", ["csv", "tsv", "json", "parquet"])
def test_round_trip(spark, folder, kind):
    df = spark.createDataFrame([(1, "a,b", 1.5, dt.date(2026, 1, 1)), (2, None, None, None)], "i int, s string, d double, t date")
    path = sinks.save_table(df, folder, "t", kind, metadata={"by": "me"}, include_timestamp=False)
    assert sorted(sinks.read_back(spark, path, kind, df.schema).collect(), key=lambda r: r["i"]) == df.collect()
    meta = readers.read_table(spark, f"{folder}/t{files.SIDECAR}", "json", multiLine=False).first()
    assert (meta["rows"], meta["columns"], meta["metadata"]) == (2, 4, '{"by": "me"}')
    with pytest.raises(Exception):
        sinks.save_table(df, folder, "t", kind, include_timestamp=False)
    assert sinks.save_table(df, folder, "t", kind, include_timestamp=False, overwrite=True) == path


def test_save_checks(spark, folder):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError):
        sinks.save_table(empty, folder, "e")
    twice = spark.range(1).selectExpr("id as a", "id as a")
    with pytest.raises(ValueError):
        sinks.save_table(twice, folder, "t")
    with pytest.raises(ValueError):
        sinks.save_table(spark.range(1), folder, "t", "xlsx")


def test_files(spark, folder):
    write(f"{folder}/a.csv", "x\n1\n")
    write(f"{folder}/b.json", "[]")
    write(f"{folder}/c.csv", "x,y\n1,2\n")
    write(f"{folder}/empty.csv", "")  # Spark's listing leaves empty files out
    write(f"{folder}/d.bin", "?")
    write(f"{folder}/a_metadata.json", "{}")
    names = [r["file_name"] for r in files.list_processed(spark, folder, sort_by="name").collect()]
    assert names == ["a.csv", "b.json", "c.csv", "d.bin"]
    assert [r["file_name"] for r in files.list_processed(spark, folder, "csv", "size").collect()] == ["c.csv", "a.csv"]
    reasons = {r["file_name"]: r["reason"] for r in files.admitted(files.list_files(spark, folder, "*.*")).collect()}
    assert "empty.csv" not in reasons and reasons["d.bin"] == "unknown format" and reasons["a.csv"] is None
    assert files.admitted(files.list_files(spark, folder, "a.csv"), 0).first()["reason"] == "too large"
    mark = files.fingerprints(spark, folder, "a.csv").first()
    assert mark["sha256"] == hashlib.sha256(b"x\n1\n").hexdigest()
    assert files.file_metadata(readers.read_table(spark, f"{folder}/a.csv")).first()["row_count"] == 1
    with pytest.raises(FileNotFoundError):
        files.latest_file(spark, folder, "*.orc")


def test_content_mark_sees_copies(spark):
    one = spark.createDataFrame([(1,), (2,)], "a int")
    assert sinks.content_mark(one).first() == sinks.content_mark(one.orderBy(F.desc("a"))).first()
    assert sinks.content_mark(one).first() != sinks.content_mark(one.union(one).union(one)).first()
    empty = sinks.content_mark(one.limit(0)).first()
    assert empty["rows"] == 0


def test_land_and_ingest(spark, folder):
    df = spark.createDataFrame([(1, " a "), (2, "b"), (None, None)], "`Order Id` int, `Name` string")
    assert sinks.land_verified(df, f"{folder}/copy").count() == 3
    df.coalesce(1).write.option("header", True).csv(f"{folder}/in")
    report = sinks.ingest_batch(spark, f"{folder}/in", f"{folder}/raw", f"{folder}/out", "o", "csv", df.schema).first()
    saved = spark.read.parquet(report["saved_to"])
    assert saved.columns == ["order_id", "name"]
    assert sorted(tuple(r) for r in saved.collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        sinks.ingest_batch(spark, f"{folder}/in", f"{folder}/r2", f"{folder}/o2", "o", "json")
    write(f"{folder}/in/notes.md", "not a table")
    again = sinks.ingest_batch(spark, f"{folder}/in", f"{folder}/r3", f"{folder}/o3", "o", "csv", df.schema).first()
    assert spark.read.parquet(again["saved_to"]).count() == 2


def test_catalogue_table(spark, tmp_path):
    name = "ledgerlens_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = str(tmp_path / "w")
    spark.sql(f"CREATE TABLE {name} (id BIGINT) USING parquet LOCATION '{path}'")
    sinks.save_to_database(spark.range(3), name)
    assert spark.table(name).count() == 3
    with pytest.raises(Exception):
        sinks.save_to_database(spark.range(3), name, if_exists="fail")
    with pytest.raises(ValueError):
        sinks.save_to_database(spark.range(3), name, if_exists="merge")
    spark.sql(f"DROP TABLE {name}")


def test_stream_takes_each_file_once(spark, folder):
    source, out, log = f"{folder}/in", f"{folder}/out", f"{folder}/log"
    schema = "id bigint, name string"
    for part in (0, 1):
        spark.range(part * 5, part * 5 + 5).selectExpr("id", "' x ' as name").write.mode("append").parquet(source)
        stream = live.file_stream(spark, source, "parquet", schema)
        live.ingest_stream(stream, out, log).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 10 and rows.filter("name = 'x'").count() == 10


def test_running_revenue(spark, folder):
    rows = [("2026-01-01 10:00:00", 5.0), ("2026-01-01 12:00:00", 7.0), ("2026-01-02 10:00:00", 1.0)]
    df = spark.createDataFrame(rows, "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{folder}/in")
    stream = live.file_stream(spark, f"{folder}/in", "parquet", df.schema)
    live.keep_latest(live.period_revenue_stream(stream, "v", "ts"), f"{folder}/out", f"{folder}/log").awaitTermination()
    got = live.latest_snapshot(spark, f"{folder}/out").orderBy("period_start").collect()
    assert [(r["total_revenue"], r["count"]) for r in got] == [(12.0, 2), (1.0, 1)]


def test_closed_periods_are_appended(spark, folder):
    first = [("2026-01-01 10:00:00", 5.0), ("2026-01-01 12:00:00", 7.0), ("2026-01-04 10:00:00", 1.0)]
    schema = "ts timestamp, v double"
    for part, rows in enumerate((first, [("2026-01-01 11:00:00", 9.0), ("2026-01-06 00:00:00", 2.0)])):
        df = spark.createDataFrame(rows, "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = live.period_revenue_stream(live.file_stream(spark, f"{folder}/in", "parquet", schema), "v", "ts")
        live.append_closed(stream, f"{folder}/out", f"{folder}/log").awaitTermination()
    got = {str(r["period_start"])[:10]: r["total_revenue"] for r in spark.read.parquet(f"{folder}/out").collect()}
    # The row of 1 January that came with the second file is later than the watermark allows.
    assert got["2026-01-01"] == 12.0


def test_csv_keeps_every_text(spark, tmp_path):
    rows = [(1, "  lead"), (2, "trail  "), (3, ""), (4, None), (5, 'a "quote", and, commas'), (6, "two\nlines"), (7, "tab\tin")]
    df = spark.createDataFrame(rows, "id int, text string")
    for kind in ("csv", "tsv"):
        path = sinks.save_table(df, str(tmp_path), "t", kind)
        got = sinks.read_back(spark, path, kind, df.schema)
        assert sorted(tuple(r) for r in got.collect()) == rows


def test_dates_as_people_write_them(spark):
    from ledgerlens.functions.text import parse_date

    texts = ["2026-01-05T10:00:00", "2026-01-05T10:00:00.123Z", "2026-01-05 10:00", "2026-01-05 10:00:00.5", "1/5/2026", "oops", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date(F.col("t")).cast("date").cast("string").alias("d"))
    assert [r["d"] for r in df.collect()] == ["2026-01-05"] * 5 + [None, None]
