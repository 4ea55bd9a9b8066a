import json

import pytest
from pyspark.sql import functions as F

from socialspark.constants import AUTHOR_FIELDS, POST_FIELDS
from socialspark.plans import ingest
from socialspark.sources.readers import read_raw_posts
from socialspark.sources.writers import write_authors, write_flat_posts
from socialspark.streaming.ingest_stream import (
    start_exact_ingest,
    start_managed_ingest,
    stream_posts_bounded,
    stream_raw_posts,
)


def hit(uri, kw_pos=0, page=0, pos=0, did="did:a", created="2024-05-02T00:00:00Z", **more):
    return {
        "keyword": f"kw{kw_pos}", "kw_pos": kw_pos, "page": page, "pos": pos, "uri": uri,
        "author": {"did": did, "handle": "h", "displayName": "Camel"},
        "record": {"text": " a\r\nb  ", "createdAt": created, "langs": ["en", "fr"]},
        "likeCount": 3, **more,
    }


HITS = [
    hit("u1", kw_pos=1), hit("u1", kw_pos=0, page=2), hit("u1", kw_pos=0, page=1, did="did:first"),
    hit("u2", did=None), hit("", pos=5), hit("u3", did=""), hit("u4", kw_pos=2, like_count=9, indexed_at="i1"),
    hit("u5", created="2024-07-01T00:00:00Z"),
]


def land(folder, hits, name):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, hits)))
    return str(folder)


def test_flatten(spark, tmp_path):
    raw = read_raw_posts(spark, land(tmp_path / "raw", HITS, "p.json"))
    posts = {r.uri: r for r in ingest.flatten_posts(raw).collect()}
    assert sorted(posts) == ["u1", "u2", "u3", "u4", "u5"]
    assert list(posts["u1"].asDict()) == POST_FIELDS
    assert posts["u1"].author_did == "did:first" and posts["u1"].keyword == "kw0"
    assert posts["u1"].text == "a  b" and posts["u1"].langs == "en,fr"
    assert posts["u2"].author_did == "" and posts["u2"].replyCount is None and posts["u2"].reply_root_cid == ""
    assert posts["u4"].likeCount == 9 and posts["u4"].indexedAt == "i1" and posts["u1"].likeCount == 3
    authors = {r.did: r for r in ingest.flatten_authors(raw).collect()}
    assert sorted(authors) == ["did:a", "did:first"]
    assert list(authors["did:a"].asDict()) == AUTHOR_FIELDS and authors["did:a"].display_name == "Camel"
    assert tuple(ingest.ingest_totals(raw).first()) == (5, 2)


def test_window_language_and_order(spark, tmp_path):
    raw = read_raw_posts(spark, land(tmp_path / "raw", HITS, "p.json"))
    june = ingest.search_window(raw, "2024-06-01T00:00:00Z", "2024-07-01T00:00:00Z")
    assert june.count() == 0
    july = ingest.search_window(raw, "2024-07-01T00:00:00Z", "2024-07-02T00:00:00Z", language="fr")
    assert [r.uri for r in july.collect()] == ["u5"]
    assert ingest.newest_first(raw).first().uri == "u5"


def test_csv_output(spark, tmp_path):
    raw = read_raw_posts(spark, land(tmp_path / "raw", HITS, "p.json"))
    write_flat_posts(ingest.flatten_posts(raw), str(tmp_path / "posts"))
    write_authors(ingest.flatten_authors(raw), str(tmp_path / "authors"))
    assert spark.read.option("header", True).csv(str(tmp_path / "posts")).columns == POST_FIELDS
    assert spark.read.option("header", True).csv(str(tmp_path / "authors")).columns == AUTHOR_FIELDS


def test_streams_equal_the_batch(spark, tmp_path):
    # Copies of a uri agree in content, as search pages do.
    files = [
        [hit(f"u{i}", pos=i) for i in range(0, 6)],
        [hit(f"u{i}", pos=i) for i in range(4, 9)],
        [hit(f"u{i}", pos=i) for i in (0, 8, 9, 10)],
    ]
    for n, hits in enumerate(files):
        folder = land(tmp_path / "raw", hits, f"{n}.json")
    want = sorted(ingest.flatten_posts(read_raw_posts(spark, folder)).collect(), key=lambda r: r.uri)
    assert len(want) == 11

    exact = start_exact_ingest(
        stream_raw_posts(spark, folder, 1), str(tmp_path / "table"), str(tmp_path / "check1")
    )
    exact.awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.select("run", "batch_id").distinct().count() == 3
    assert sorted(table.select(*POST_FIELDS).collect(), key=lambda r: r.uri) == want

    # A later run only adds what is new.
    land(tmp_path / "raw", [hit("u3"), hit("u99")], "9.json")
    again = start_exact_ingest(
        stream_raw_posts(spark, folder, 1), str(tmp_path / "table"), str(tmp_path / "check1")
    )
    again.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 12

    # A query that lost its checkpoint adds to the table, too.
    land(tmp_path / "raw", [hit("u100")], "10.json")
    fresh = start_exact_ingest(
        stream_raw_posts(spark, folder, 1), str(tmp_path / "table"), str(tmp_path / "check3")
    )
    fresh.awaitTermination(120)
    uris = [r.uri for r in spark.read.parquet(str(tmp_path / "table")).select("uri").collect()]
    assert len(uris) == len(set(uris)) == 13

    bounded = stream_posts_bounded(stream_raw_posts(spark, folder, 1))
    query = (
        bounded.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check2"))
        .trigger(availableNow=True).start(str(tmp_path / "bounded"))
    )
    query.awaitTermination(120)
    got = spark.read.schema(bounded.schema).parquet(str(tmp_path / "bounded"))
    assert got.count() == 13 and got.select(F.countDistinct("uri")).first()[0] == 13


def test_seen_posts_as_managed_state(spark, tmp_path):
    folder = land(tmp_path / "raw", [*HITS, hit("u9", like_count=None, likeCount=None)], "0.json")
    land(tmp_path / "raw", [hit("u3", did=""), hit("u7"), hit("u7", kw_pos=0, page=-1, did="did:top")], "1.json")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "check")

    def run(**more):
        query = start_managed_ingest(stream_raw_posts(spark, folder, 1), table, checkpoint, **more)
        assert query.awaitTermination(60)
        assert query.exception() is None
        return query

    def stored():
        return sorted(spark.read.parquet(table).select(*POST_FIELDS).collect(), key=lambda r: r.uri)

    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == store
    want = sorted(ingest.flatten_posts(read_raw_posts(spark, folder)).collect(), key=lambda r: r.uri)
    # the copies of a uri in other files agree in content
    assert [r.uri for r in stored()] == [r.uri for r in want] and stored() == want

    # after a restart only new uris are added, and the plan reads the landed pages alone
    land(tmp_path / "raw", [hit("u1"), hit("u50"), hit("")], "2.json")
    query = run()
    assert [r.uri for r in stored()] == sorted([*[r.uri for r in want], "u50"])
    plan = query._jsq.explainInternal(True)
    scans = [line for line in plan.splitlines() if "Scan" in line]
    assert "TransformWithState" in plan and scans and not any(table in line for line in scans)
    run()
    assert len(stored()) == len(want) + 1


def test_managed_state_may_expire(spark, tmp_path):
    folder = land(tmp_path / "raw", [hit("u1")], "0.json")
    for n in range(2):
        query = start_managed_ingest(
            stream_raw_posts(spark, folder, 1), str(tmp_path / "table"), str(tmp_path / "check"), keep_for_ms=1
        )
        assert query.awaitTermination(60)
        land(tmp_path / "raw", [hit("u1")], f"{n + 1}.json")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    with pytest.raises(ValueError, match="positive"):
        start_managed_ingest(stream_raw_posts(spark, folder), "t", "c", keep_for_ms=0)
