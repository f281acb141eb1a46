"""Records of files read by block, and snapshots: rows equal to what was written, wherever the files are cut."""

import csv
import json
import random

import pytest

from ledgerlens.sources import files, readers, records, sinks, snapshots

BITS = ["a", 'b "q"', ", ", "\n", "\r\n", "x" * 50, "é🙂", "\n\n", "  "]
BRACES = ["{", "}", "[", "]", '"', "\\", ",", "a", "\n", "é"]


@pytest.fixture(params=["128m", "700", "64k"])
def share(spark, request):
    """Bytes of a file that one task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "100")
    yield request.param
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_quoted_csv_is_cut_anywhere(spark, tmp_path, share):
    rng, path, rows = random.Random(3), str(tmp_path / "a.csv"), []
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "text", "n"])
        for i in range(1500):
            rows.append((i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6))) or "z", rng.random()))
            out.writerow(rows[-1])
    got = readers.read_table(spark, path, schema="id int, text string, n double")
    if share == "700":
        assert records.needs_splitting(spark, path) and records.csv_records(spark, path).rdd.getNumPartitions() > 50
        assert sorted(tuple(r) for r in got.collect()) == rows
        kinds = readers.read_table(spark, path)
        assert kinds.dtypes == [("id", "int"), ("text", "string"), ("n", "double")]
        assert sorted(tuple(r) for r in kinds.collect()) == rows
    by_block = records.read_csv(spark, path, ["id", "text", "n"], "id int, text string, n double", escape='"')
    assert sorted(tuple(r) for r in by_block.collect()) == rows
    # Spark's own reader of whole files turns the line breaks inside quotes into plain ones.
    whole = sorted(tuple(r) for r in readers.read_table(spark, path, schema="id int, text string, n double", multiLine=True).collect())
    assert [(i, t.replace("\r\n", "\n"), n) for i, t, n in rows] == [(i, t.replace("\r\n", "\n"), n) for i, t, n in whole]


def test_csv_of_many_files(spark, tmp_path):
    for name, text in (("a", 'k,v\n1,"x\ny"\n\n2,"open\n'), ("b", "k,v\n"), ("c", '﻿k,v\r\n3,"a ""b"""\r\n4,\r\n')):
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got = {r["k"]: r["v"] for r in records.read_csv(spark, str(tmp_path), ["k", "v"], "k int, v string", escape='"').collect()}
    assert got[1] == "x\ny" and got[3] == 'a "b"' and got[4] is None and set(got) == {1, 2, 3, 4}


def test_types_of_texts(spark):
    rows = [("1", "1.5", "2026-01-05", "2026-01-05 10:00:00", "true", "x", "12345678901234567890", None, "3000000000")]
    df = spark.createDataFrame(rows * 2, "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    assert list(records.text_types(df).values()) == ["int", "double", "date", "timestamp", "boolean", "string", "decimal(38,0)", "string", "bigint"]
    assert records.distinct_names(["id", "x", "ID", ""]) == ["id0", "x", "ID2", "_c3"]


def test_json_is_cut_anywhere(spark, tmp_path, share):
    rng = random.Random(5)
    data = [{"id": i, "t": "".join(rng.choice(BRACES) for _ in range(rng.randint(0, 12))), "n": {"k": [{"v": 1.5}, {}][: rng.randint(0, 2)]}} for i in range(600)]
    schema = "id long, t string, n struct<k:array<struct<v:double>>>"
    forms = {"pretty": json.dumps(data, indent=1), "one": json.dumps(data), "lines": "\n".join(map(json.dumps, data)), "single": json.dumps(data[0]), "empty": "[]"}
    for name, text in forms.items():
        path = str(tmp_path / f"{name}.json")
        with open(path, "w") as f:
            f.write(text)
        want = spark.read.schema(schema).option("multiLine", name != "lines").json(path).collect()
        assert sorted(map(str, records.read_json(spark, path, schema).collect())) == sorted(map(str, want))
    found = records.read_json(spark, str(tmp_path / "pretty.json"))
    assert dict(found.dtypes)["id"] == "bigint" and dict(found.dtypes)["n"].startswith("struct<k:array<struct<v:double")
    if share == "700":
        assert readers.read_table(spark, str(tmp_path / "one.json")).count() == 600
        with pytest.raises(ValueError):
            records.read_json(spark, str(tmp_path / "empty.json"))


def test_json_array_round_trip(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    path = records.write_json_array(docs, str(tmp_path / "arrays"))
    assert sorted(map(str, records.read_json(spark, path, docs.schema).collect())) == sorted(map(str, docs.collect()))
    assert readers.read_table(spark, path, "json", docs.schema).count() == docs.count()
    empty = records.write_json_array(docs.where("false"), str(tmp_path / "none"))
    assert records.read_json(spark, empty, docs.schema).count() == 0


def test_snapshots_are_whole(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS `a.b`").repartition(4)
    first = sinks.save_table(rows.where("id < 300"), folder, "orders", "csv")
    second = sinks.save_table(rows, folder, "orders")
    assert snapshots.load(spark, folder, "orders").count() == 1000
    assert snapshots.load_latest(spark, folder, "orders_*.csv").count() == 300
    assert files.latest_file(spark, folder, "orders_*") == second != first
    found = snapshots.versions(spark, folder, "orders").collect()
    assert [(r["rows"], r["format"]) for r in found] == [(1000, "parquet"), (300, "csv")]
    old = snapshots.load(spark, folder, "orders", found[1]["version"])
    assert old.dtypes == rows.dtypes and sorted(r["id"] for r in old.collect()) == list(range(300))
    listed = files.list_processed(spark, folder, sort_by="name").collect()
    assert [(r["snapshot"], r["rows"]) for r in listed] == [(True, 300), (True, 1000)]


def test_half_written_snapshots_are_invisible(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, folder, "orders")
    spark.range(5).write.parquet(f"{folder}/orders_later.parquet")  # no manifest yet
    assert files.list_processed(spark, folder).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshots.load_latest(spark, folder, "orders_*")
    sinks.save_table(spark.range(7), folder, "orders", include_timestamp=False)
    sinks.save_table(spark.range(9), folder, "orders", include_timestamp=False, overwrite=True)
    assert snapshots.load(spark, folder, "orders").count() == 9
    snapshots.withdraw(spark, folder, "orders")
    assert files.list_processed(spark, folder).count() == 0


def test_damaged_snapshot_is_told(spark, tmp_path):
    folder = str(tmp_path / "t")
    path = sinks.save_table(spark.range(100).repartition(4), folder, "orders")
    spark.range(3).write.mode("append").parquet(path)
    with pytest.raises(IOError):
        snapshots.load(spark, folder, "orders")
    assert snapshots.load(spark, folder, "orders", check=False).count() == 103


def test_single_files_beside_snapshots(spark, tmp_path):
    folder = str(tmp_path / "t")
    sinks.save_table(spark.range(7), folder, "orders")
    with open(f"{folder}/orders_upload.csv", "w") as f:
        f.write("id\n1\n2\n")
    assert snapshots.load_latest(spark, folder, "orders_*").count() == 2
    assert snapshots.load_latest(spark, folder, "orders_2*").count() == 7
    one = files.file_metadata(spark.read.csv(f"{folder}/orders_upload.csv", header=True), with_hash=True).first()
    assert (one["row_count"], one["column_count"], len(one["sha256"])) == (2, 1, 64) and one["path"].endswith("orders_upload.csv")


def test_repeated_headers_stop_an_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.csv").write_text("id,name,id\n1,a,2\n")
    with pytest.raises(ValueError, match="repeated names: id"):
        sinks.ingest_batch(spark, str(tmp_path / "in"), str(tmp_path / "raw"), str(tmp_path / "out"), "d", "csv", "id0 int, name string, id2 int")
