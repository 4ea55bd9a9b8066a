import gzip
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from socialspark.plans.drifting_files import harmonize_folder
from socialspark.sources.heads import read_footers, read_headers, shapes


def heads(frame):
    return {r.file_name: r for r in frame.collect()}


def test_a_damaged_tail_is_not_touched(spark, tmp_path):
    rows = "id,\"two\nlines\",x\n" + "".join(f"{i},{os.urandom(12).hex()},y\n" for i in range(60_000))
    whole = gzip.compress(rows.encode())
    (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    spoilt = bytearray(whole)
    spoilt[len(whole) // 2 :] = bytes(len(whole) - len(whole) // 2)
    (tmp_path / "spoilt.csv.gz").write_bytes(bytes(spoilt))
    with pytest.raises((EOFError, OSError, gzip.zlib.error)):
        gzip.decompress(bytes(spoilt))
    got = heads(read_headers(spark, str(tmp_path)))
    for name in ("cut.csv.gz", "spoilt.csv.gz"):
        assert got[name].columns == ["id", "two\nlines", "x"] and got[name].error is None


def test_causes_and_groups_of_files(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"f{i}.csv").write_text(f"﻿a,b{i}\r\n1,2\r\n" if i else "")
    (tmp_path / "_hidden.csv").write_text("no\n")
    (tmp_path / "bad.csv.gz").write_bytes(b"not gzip at all")
    (tmp_path / "open.csv").write_text('a,"' + "x" * 200_000)
    frame = read_headers(spark, str(tmp_path), "*.csv", files_per_task=2)
    got = heads(frame)
    assert frame.rdd.getNumPartitions() == 4 and len(got) == 8
    assert got["f3.csv"].columns == ["a", "b3"]
    assert got["f0.csv"].cause == "ValueError: the file is empty"
    assert "field larger" in got["open.csv"].cause
    bad = heads(read_headers(spark, str(tmp_path), "*.gz"))["bad.csv.gz"]
    assert (bad.columns, bad.error) == (None, "unreadable or empty") and bad.cause.startswith("BadGzipFile")
    assert read_headers(spark, str(tmp_path), "*.none").count() == 0


@pytest.fixture
def parquet_folder(tmp_path):
    def write(file, **columns):
        pq.write_table(pa.table(columns), tmp_path / file)

    write("a.parquet", id=pa.array([1, 2], pa.int32()), text=["x", None], score=pa.array([1, 2], pa.int64()))
    write("a2.parquet", id=pa.array([7], pa.int32()), text=["w"], score=pa.array([9], pa.int64()))
    write("b.parquet", text=["y"], id=pa.array([3], pa.int64()), score=pa.array([0.5], pa.float64()))
    write("c.parquet", id=["four"], name=["z"], tags=[["t", "u"]])
    (tmp_path / "d.parquet").write_bytes(b"PAR1 but nothing else")
    return str(tmp_path)


def test_footers(spark, parquet_folder):
    found = read_footers(spark, parquet_folder)
    got = heads(found)
    assert got["a.parquet"].columns == ["id", "text", "score"] and got["a.parquet"].types == ["int", "string", "bigint"]
    assert got["c.parquet"].types == ["string", "string", "array<string>"]
    assert got["d.parquet"].columns is None and "ArrowInvalid" in got["d.parquet"].cause
    assert sorted(r.n_files for r in shapes(found).collect()) == [1, 1, 2]


def test_a_footer_is_read_without_the_pages(spark, tmp_path):
    pq.write_table(pa.table({"v": list(range(10_000))}), tmp_path / "p.parquet")
    raw = bytearray((tmp_path / "p.parquet").read_bytes())
    raw[4:2000] = bytes(1996)
    (tmp_path / "p.parquet").write_bytes(bytes(raw))
    assert heads(read_footers(spark, str(tmp_path)))["p.parquet"].columns == ["v"]


def test_parquet_files_of_three_shapes_with_a_type_conflict(spark, parquet_folder):
    known = {"core": ["id", "text", "score"], "other": ["id", "name", "tags"]}
    got = harmonize_folder(
        spark, parquet_folder, ["id", "body", "score", "tags", "none"], renames={"text": "body"}, schemas=known, format="parquet"
    )
    assert [f.dataType.simpleString() for f in got.schema] == [
        "string", "string", "double", "array<string>", "string", "string", "string"
    ]
    assert sorted(map(tuple, got.select("file_name", "schema", "id", "body", "score", "tags", "none").collect()), key=str) == [
        ("a.parquet", "core", "1", "x", 1.0, None, None), ("a.parquet", "core", "2", None, 2.0, None, None),
        ("a2.parquet", "core", "7", "w", 9.0, None, None), ("b.parquet", "core", "3", "y", 0.5, None, None),
        ("c.parquet", "other", "four", None, None, ["t", "u"], None),
    ]
    typed = harmonize_folder(
        spark, parquet_folder, T.StructType().add("id", "long").add("score", "float"), "[ab]*.parquet", schemas=known, format="parquet"
    )
    assert sorted((r.id, r.score) for r in typed.collect()) == [(1, 1.0), (2, 2.0), (3, 0.5), (7, 9.0)]
    with pytest.raises(ValueError, match="no readable files"):
        harmonize_folder(spark, parquet_folder, ["id"], "d*.parquet", format="parquet")
