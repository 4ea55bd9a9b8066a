import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from socialspark.functions.timeutil import format_ts, month_of, next_month, parse_ts
from socialspark.plans.clean_posts import clean_posts, keep_latest
from socialspark.plans import drifting_files
from socialspark.plans.merging import merge_author_files, merge_sources
from socialspark.constants import MERGE_COLUMNS
from socialspark.operators.align import align, compare_embeddings
from socialspark.operators.ranking import number_rows, number_within
from socialspark.operators.skew import hot_keys, skew_join
from socialspark.operators import volumes
from socialspark.operators.volumes import month_counts, month_share, update_month_counts
from socialspark.sources import readers, writers

COLUMNS = "external_id string, url string, author_username string, content string, clean_content string, created_at string, lang string"


def post(i, created="2024-05-10T00:00:00Z", content="some text", url="https://x/1", author="ann", prior="old", lang="en"):
    return (i, url, author, content, prior, created, lang)


def test_times(spark):
    rows = spark.createDataFrame(
        [("2024-05-01T00:00:00.123+02:00",), ("x",), ("May 3, 2024",), ("2024-06-01T00:00:00Z",), (None,)], "t string"
    )
    ts = parse_ts(F.col("t"), ["MMM d, yyyy"])
    got = [tuple(r) for r in rows.select(format_ts(ts), month_of(ts)).collect()]
    assert got == [
        ("2024-04-30T22:00:00Z", "2024-04"), (None, None), ("2024-05-03T00:00:00Z", "2024-05"),
        ("2024-06-01T00:00:00Z", "2024-06"), (None, None),
    ]
    assert next_month("2024-12") == "2025-01"
    with pytest.raises(ValueError):
        next_month("12")


def test_clean_posts_filters_and_cleans(spark):
    rows = [
        post("1"), post("2", created="x"), post("3", created="2024-06-01T00:00:00Z"), post("4", url="ftp://x"),
        post("5", author="\t"), post("6", lang="de"), post("7", content="*** !!!"), post("8", content=None),
        post(None), post("9", content="<b>old</b>"),
        post("9", created="2024-05-11T00:00:00+00:00", content="<i>new</i>"), post("10", prior=None, lang=None),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.external_id: r for r in clean_posts(df, "2024-05").collect()}
    assert sorted(got) == ["1", "10", "9"]
    assert got["9"].clean_content == "new" and got["9"].created_at == "2024-05-11T00:00:00Z"
    assert sorted(clean_posts(df).toPandas().external_id) == ["1", "10", "3", "9"]
    strict = clean_posts(df, "2024-05", require_prior_clean=True).collect()
    assert sorted(r.external_id for r in strict) == ["1", "9"]
    renamed = clean_posts(df.withColumnRenamed("lang", "langs"), "2024-05", renames={"langs": "lang"})
    assert renamed.count() == 3


def test_keep_latest_breaks_ties_the_same_way_every_run(spark):
    rows = [post("1", content=c, url=u) for c in "cba" for u in ("https://x/2", "https://x/1")]
    df = spark.createDataFrame(rows + [post("1", created="bad", content="0")], COLUMNS)
    for parts in (1, 7):
        kept = keep_latest(df.repartition(parts)).collect()
        assert [(r.url, r.content) for r in kept] == [("https://x/1", "a")]


def test_keep_latest_limits_rows_before_the_exchange(spark):
    df = keep_latest(spark.createDataFrame([post("1")], COLUMNS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_merge_sources_keeps_first_and_real_nulls(spark):
    def sheet(rows):
        schema = ", ".join(f"`{c}` string" for c in MERGE_COLUMNS) + ", extra int"
        blank = dict.fromkeys(MERGE_COLUMNS)
        return spark.createDataFrame([tuple({**blank, **r}[c] for c in MERGE_COLUMNS) + (1,) for r in rows], schema)

    first = sheet([{"external_id": "1", "content": "a", "created_at": "2024-05-01T02:00:00+02:00"}, {"content": "n1"}])
    second = sheet([{"external_id": "1", "content": "b"}, {"external_id": "2", "Scraping Date": "d"}, {"content": "n2"}])
    got = merge_sources([first, second]).collect()
    assert got[0].asDict().keys() == dict.fromkeys(MERGE_COLUMNS).keys()
    by_id = {r.external_id: r for r in got}
    assert len(got) == 3 and by_id["1"].content == "a" and by_id[None].content == "n1"
    assert by_id["1"].created_at == "2024-05-01T00:00:00Z" and by_id["2"].content is None


def test_author_files(spark, tmp_path):
    for name, rows in (("bsky_users_05", [("a", 1), ("b", 1)]), ("bsky_users_06", [("b", 2), ("c", 2)]), ("other", [("z", 9)])):
        spark.createDataFrame(rows, "did string, v int").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    got = merge_author_files(spark, str(tmp_path), r"bsky_users_.*\.parquet")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError, match="no files"):
        merge_author_files(spark, str(tmp_path), "nothing")


def test_author_files_that_differ_in_columns(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "did string, v int").toPandas().to_parquet(tmp_path / "users_05.parquet")
    spark.createDataFrame([("a", 2, "x"), ("b", 3, "y")], "did string, v int, w string").toPandas().to_parquet(tmp_path / "users_06.parquet")
    got = merge_author_files(spark, str(tmp_path), r"users_.*\.parquet").orderBy("did").collect()
    assert [(r.did, r.v, r.w) for r in got] == [("a", 1, None), ("b", 3, "y")]


def test_a_folder_of_drifting_files(spark, tmp_path):
    import gzip

    files = {"a": "id,name\n1,x\n", "b": "name,id\ny,2\n", "c": 'id,name,extra\n3,"p,\nq",e\n', "d": "other\n4\n"}
    for name, text in files.items():
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(text)
    (tmp_path / "bad.csv.gz").write_bytes(b"not gzip at all")
    shapes = {"core": ["id", "name"], "more": ["extra", "id", "name"]}
    groups = drifting_files.folder_groups(spark, str(tmp_path), schemas=shapes).collect()
    assert sorted((r.schema, r.n_files, r.n_errors, r.files) for r in groups) == [
        ("core", 2, 0, ["a.csv.gz", "b.csv.gz"]), ("more", 1, 0, ["c.csv.gz"]), ("unknown", 2, 1, ["bad.csv.gz", "d.csv.gz"])
    ]
    got = drifting_files.harmonize_folder(
        spark, str(tmp_path), ["key", "name", "extra"], renames={"id": "key"}, schemas=shapes
    )
    assert got.columns == ["key", "name", "extra", "file_name", "schema"]
    assert sorted(map(tuple, got.select("file_name", "key", "name", "extra", "schema").collect())) == [
        ("a.csv.gz", "1", "x", None, "core"), ("b.csv.gz", "2", "y", None, "core"),
        ("c.csv.gz", "3", "p,\nq", "e", "more"), ("d.csv.gz", None, None, None, "unknown"),
    ]


def test_headers_and_unreadable_files(spark, tmp_path):
    import gzip

    for name, text in (("a", 'id,"x,y",location.1\n1,2,3\n'), ("b", ',0,"q""r"\n9,9,9\n')):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(text)
    (tmp_path / "bad.csv.gz").write_bytes(b"not gzip at all")
    (tmp_path / "skip.txt").write_text("z")
    got = {r.file_name: (r.columns, r.error) for r in readers.read_headers(spark, str(tmp_path)).collect()}
    assert got == {
        "a.csv.gz": (["id", "x,y", "location.1"], None),
        "b.csv.gz": (["", "0", 'q"r'], None),
        "bad.csv.gz": (None, "unreadable or empty"),
    }


def test_posts_round_trip_prunes_months(spark, tmp_path):
    rows = [post("1"), post("2", created="2024-06-02T00:00:00Z"), post("3", prior="  "), post("4", prior=None)]
    path = str(tmp_path / "deep" / "posts")
    writers.write_posts(spark.createDataFrame(rows, COLUMNS), path)
    may = readers.load_posts(spark, path, "2024-05")
    assert [tuple(r) for r in may.collect()] == [("1", "old", "2024-05-10T00:00:00Z")]
    plan = may._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters")[1][:120]
    assert readers.load_posts(spark, path).count() == 2
    writers.write_csv(may, str(tmp_path / "csv"), max_rows_per_file=1)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == may.columns


def test_align_and_compare(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    right = spark.createDataFrame([(2, [1.0, 2.0]), (1, [0.0, float("nan")])], "id int, embedding array<double>")
    assert align(left, right, "id").count() == 2
    with pytest.raises(ValueError, match="not in both"):
        align(left, right.where("id = 1"), "id")
    with pytest.raises(ValueError, match="not in both"):
        align(left, right.union(right), "id")
    near = right.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + 1e-7)))
    assert {r.id: r.matches for r in compare_embeddings(right, near, "id").collect()} == {1: False, 2: True}


def test_volumes(spark):
    rows = [("TS", "2024-05-03T00:00:00Z"), ("TS", "2024-05-09T00:00:00Z"), ("TS", "2024-11-30T23:59:59Z"),
            ("TS", "2024-12-01T00:00:00Z"), ("BS", "bad")]
    df = spark.createDataFrame(rows, "platform string, created_at string")
    whole = {r.month: r.n for r in month_counts(df).collect()}
    assert len(whole) == 7 and whole["2024-05"] == 2 and whole["2024-11"] == 1 and sum(whole.values()) == 3
    shares = month_share(month_counts(df, by=["platform"])).collect()
    assert len(shares) == 14
    assert abs(sum(r.share for r in shares if r.platform == "TS") - 100) < 1e-9
    assert all(r.share is None and r.n == 0 for r in shares if r.platform == "BS")


def test_month_counts_are_updated_by_file(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "posts of a year", str(tmp_path / "state")
    folder.mkdir()
    scanned = []
    read = volumes.read_parquet
    monkeypatch.setattr(volumes, "read_parquet", lambda s, *paths: scanned.append(sorted(p[-9:] for p in paths)) or read(s, *paths))

    def put(name, rows):
        schema = pa.schema([("platform", pa.string()), ("created_at", pa.string())])
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema), folder / name)

    def agrees(by):
        got = update_month_counts(spark, str(folder), f"{state}-{len(by)}", by=by)
        want = month_counts(read(spark, str(folder)), by=by)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema["n"].dataType == want.schema["n"].dataType

    with pytest.raises(ValueError, match="no Parquet files"):
        update_month_counts(spark, str(folder), state)
    put("a.parquet", [("TS", "2024-05-03T00:00:00Z"), ("TS", "2024-06-09T00:00:00Z"), (None, "2024-05-01T00:00:00Z")])
    put("b.parquet", [("BS", "bad"), ("TS", "2024-05-04T00:00:00Z"), ("TS", None)])
    put("e.parquet", [])
    for by in ((), ("platform",)):
        agrees(by)
        agrees(by)
    assert scanned == [["a.parquet", "b.parquet", "e.parquet"]] * 2  # the second calls scan nothing
    scanned.clear()
    put("c.parquet", [("BS", "2024-11-30T23:59:59Z"), ("BS", "2023-01-01T00:00:00Z")])
    put("a.parquet", [("TS", "2024-07-03T00:00:00Z")])
    agrees(("platform",))
    assert scanned == [["a.parquet", "c.parquet"]]
    (folder / "b.parquet").unlink()
    agrees(("platform",))
    assert len(scanned) == 1
    agrees(())
    # counts that no manifest names, as a run leaves that fails between the two, do not count
    spark.read.parquet(f"{state}-1/counts").withColumn("run", F.lit("zz")).write.mode("append").parquet(f"{state}-1/counts")
    agrees(("platform",))


def test_numbering_and_skewed_join(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "hot").otherwise((F.col("id") % 5).cast("string")).alias("key"))
    numbered = {r.id: r.row_index for r in number_rows(df.repartition(5), ["id"]).collect()}
    assert numbered == {i: i for i in range(1000)}
    inside = number_within(df, "key", ["id"]).where("key = 'hot'").collect()
    assert sorted((r.id, r.position) for r in inside) == [(i, i) for i in range(700)]
    sizes = df.groupBy("key").count()
    hot = hot_keys(sizes, ["key"], "count", 1000)
    assert [r.key for r in hot.where("key = 'hot'").collect()] == ["hot"]
    joined = skew_join(df, sizes, ["key"], hot.where("key = 'hot'"))
    assert joined.count() == 1000 and joined.where("key = 'hot' and count = 700").count() == 700
