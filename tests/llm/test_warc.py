import hashlib
import os

import pytest

from socialspark.llm import warc

ROWS = [
    (3, "https://a/3", "x" * 150, 0), (1, "https://a/1", "x" * 150, 0), (2, "https://a/ü 2\r\nEvil: 1", "small", 0), (4, None, "small", 0),
    (5, "https://a/5", None, 0), (6, "https://a/6", "é" * 60, 0), (6, "https://a/6", "é" * 60, 0), (None, None, "x" * 150, 0),
    (7, "https://a/7", "long " * 100_000, 0), (8, "https://a/8", "é" * 60, 0),
]


def digests(folder):
    folder = folder.removeprefix("file:")
    names = sorted(n for n in os.listdir(folder) if n.endswith(".gz"))
    return {n: hashlib.sha256(open(f"{folder}/{n}", "rb").read()).hexdigest() for n in names}


def test_round_trip_with_revisits(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest int")
    manifest = warc.write_archive(pages, f"file:{tmp_path}/a").toPandas()
    got = warc.read_archive(spark, f"file:{tmp_path}/a").toPandas()
    assert len(got) == len(ROWS) == manifest["records"].sum()
    assert not os.path.exists(tmp_path / "a" / "_temporary")
    for _, row in got.iterrows():
        assert len(row["payload_digest"]) == 64
    kinds = sorted((k if k == k else -1, t, f if f == f else -1) for k, t, f in zip(got["key"], got["record_type"], got["refers_to"]))
    assert kinds == [
        (-1, "revisit", 1), (1, "response", -1), (2, "response", -1), (3, "revisit", 1), (4, "response", -1), (5, "response", -1),
        (6, "response", -1), (6, "revisit", 6), (7, "response", -1), (8, "revisit", 6),
    ]
    by_id = dict(zip(got["record_id"], got["key"]))
    for target, key in zip(got["refers_to_id"], got["refers_to"]):
        assert target is None or by_id[target] == key
    payloads = {k: p for k, t, p in zip(got["key"], got["record_type"], got["payload"]) if t == "response"}
    assert payloads[7] == b"long " * 100_000 and payloads[5] == b""
    assert set(got.loc[got["key"] == 8, "payload_bytes"]) == {120}
    assert got.loc[got["key"] == 2, "url"].item() == "https://a/ü%202%0D%0AEvil:%201"


def test_same_files_whatever_the_partitions(spark, tmp_path):
    rows = [(i, f"https://a/{i}", f"page {i % 70} " * (20 + i % 50), 0) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    found = []
    for name, frame in (("a", pages.repartition(3)), ("b", pages.repartition(7))):
        warc.write_archive(frame, f"file:{tmp_path}/{name}", shard_bytes=40_000, roll_bytes=1000)
        found.append(digests(f"file:{tmp_path}/{name}"))
    assert found[0] == found[1] and len(found[0]) > 4
    keys = [r["key"] for r in warc.read_archive(spark, f"file:{tmp_path}/a").orderBy("name").collect()]
    assert sorted(keys) == list(range(400))


def test_damage_is_found_and_empty_is_fine(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string, digest int")
    warc.write_archive(pages, f"file:{tmp_path}/a")
    name = next(n for n in os.listdir(tmp_path / "a") if n.endswith(".gz"))
    import gzip

    data = gzip.decompress((tmp_path / "a" / name).read_bytes()).replace(b"xxx", b"xyx", 1)
    (tmp_path / "a" / name).write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"file:{tmp_path}/a").count()
    warc.write_archive(pages.limit(0), f"file:{tmp_path}/b")
    assert warc.read_archive(spark, f"file:{tmp_path}/b").count() == 0
