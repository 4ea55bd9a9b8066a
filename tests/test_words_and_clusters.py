import numpy as np
import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from socialspark.constants import KEYWORD_GROUPS, POST_ID, TAG_KEYWORDS, TS_KEYWORDS, X_COMMON_COLUMNS, X_KEYWORDS, X_SCHEMAS
from socialspark.operators import clusters, embed, keywords, neighbours, schema_drift, word_counts
from socialspark.sources.readers import read_embeddings
from socialspark.sources.writers import write_embeddings


def texts(spark, values, **columns):
    df = spark.createDataFrame(list(enumerate(values)), "external_id long, text string")
    return df.withColumn("clean_content", F.col("text")).withColumns({k: F.expr(v) for k, v in columns.items()})


def test_tagging(spark):
    df = texts(spark, ["Biden 2024", "no la bels", "zzz", None, "biden Biden trump2024"])
    got = [r.keyword for r in keywords.tag_keywords(df).orderBy("external_id").collect()]
    assert got == ["biden", "nolabels", "", None, "biden,biden,trump2024"]
    longest = keywords.tag_keywords(df, longest_first=True).orderBy("external_id").first()
    assert longest.keyword == "biden2024"
    assert len(TAG_KEYWORDS) == 44


def test_groups(spark):
    df = texts(spark, ["The 2024 Elections!", "Joe Biden met Kamala Harris", "bidenesque", "rfkfoo", None, "the GOP."])
    rows = keywords.keyword_groups(df).orderBy("external_id").collect()
    on = [[g for g in KEYWORD_GROUPS if r[g]] for r in rows]
    assert on == [["elections"], ["biden_harris", "harris"], [], ["kennedy"], [], ["organisations"]]
    pair = keywords.keyword_groups(df, {"both": [("joe biden", "kamala harris")]}).orderBy("external_id").collect()
    assert [r.both for r in pair] == [False, True, False, False, False, False]


def test_keyword_lists(spark):
    def table(values):
        return spark.createDataFrame([(v,) for v in values], "keyword string")

    def normal(values):
        return {v.replace(" ", "").lower() for v in values}

    got = {}
    for r in keywords.compare_keyword_lists(table(X_KEYWORDS), table(TS_KEYWORDS)).collect():
        got.setdefault(r.side, set()).add(r.keyword)
    x, ts = normal(X_KEYWORDS), normal(TS_KEYWORDS)
    assert got == {"both": x & ts, "left": x - ts, "right": ts - x}
    assert "cornelwest" in got["left"] and "cornellwest" in got["right"]


def test_schemas(spark):
    assert {n: len(c) for n, c in X_SCHEMAS.items()} == {
        "schema_1": 32, "schema_2": 32, "schema_3": 33, "schema_4": 36, "schema_5": 35, "schema_6": 32,
    }
    assert len(X_COMMON_COLUMNS) == 23
    known = schema_drift.schema_table(spark)
    headers = spark.createDataFrame(
        [(n, list(reversed(c)) + c[:1]) for n, c in X_SCHEMAS.items()] + [("odd", ["id"])],
        "file_name string, columns array<string>",
    )
    matched = schema_drift.match_schemas(headers, known)
    assert all(r.schema == (r.file_name if r.file_name != "odd" else "unknown") for r in matched.collect())
    assert schema_drift.schema_group_counts(matched).count() == 7
    diff = {r.column: r.schemas for r in schema_drift.schema_diff(schema_drift.schema_columns(known)).collect()}
    assert diff["_type"] == ["schema_1"] and diff["0"] == ["schema_3", "schema_6"]
    assert diff["username"] == [f"schema_{i}" for i in range(2, 7)]
    assert not set(diff) & set(X_COMMON_COLUMNS)
    odd = spark.createDataFrame([(1, 2, 3)], ["location.1", "a`b", "x"])
    got = schema_drift.harmonize(odd, ["a`b", "new", "location.1"]).first()
    assert tuple(got) == (2, None, 1)


def test_monthly_words(spark):
    rows = [("a b cat cat the", "2024-05-01")] * 3 + [("cat dog", "2024-06-01")] * 2 + [("cat", "2023-01-01"), (None, "2024-05-01")]
    df = spark.createDataFrame(rows, "clean_content string, created_at string")
    got = {(r.month, r.word): (r.n, r.freq) for r in word_counts.monthly_word_freq(df, min_df=2).collect()}
    assert got[("2024-05", "cat")] == (6, 1.0) and got[("2024-06", "cat")] == (2, 0.5)
    assert got[("2024-06", "dog")] == (2, 0.5) and got[("2024-07", "cat")] == (0, None)
    assert len(got) == 14
    both = word_counts.monthly_word_freq(
        df.withColumn("platform", F.lit("TS")).unionByName(df.where("clean_content = 'cat dog'").withColumn("platform", F.lit("BS"))),
        ["platform"], min_df=2,
    )
    top = word_counts.top_words_overall(both, ["TS", "BS"], n=1).collect()
    assert {r.word for r in top} == {"cat"} and len(top) == 14
    assert abs(top[0].total - 2.0) < 1e-12


def test_cluster_words_samples_and_prompts(spark):
    values = ["tax tax cut", "tax vote", "Tax rate", "vote x1", "one two", "one two", "one two", " ", None]
    df = texts(spark, values, cluster="if(external_id < 4 or external_id > 6, 0, 1)")
    top = word_counts.cluster_top_words(df, min_df=2)
    got = [tuple(r) for r in top.orderBy("cluster", "rank").collect()]
    # In cluster 1 every word is in all three texts: more than 0.9 of them.
    assert got == [(0, 1, "tax", 4), (0, 2, "vote", 2)]
    assert word_counts.cluster_top_words(df.where("cluster = 1"), min_df=3).count() == 0
    samples = clusters.cluster_samples(df, n=3)
    assert samples.groupBy("cluster").count().where("count <> 3").count() == 0
    first = sorted(map(tuple, samples.collect()))
    assert first == sorted(map(tuple, clusters.cluster_samples(df.repartition(7), n=3).collect()))
    prompts = {r.cluster: r.prompt for r in clusters.cluster_prompts(top, samples, instructions="Do.\n").collect()}
    assert prompts[0].startswith("Do.\n\nCluster: 0\n\nTop words (count): tax(4), vote(2)\n\nSample posts:\n- ")
    assert "Top words (count): \n\nSample posts:\n- one two\n- one two\n- one two\n\nOutput format:\n" in prompts[1]
    long = texts(spark, ["x" * 300 + "\\n"], cluster="0")
    cut = clusters.cluster_prompts(top, clusters.cluster_samples(long)).first().prompt
    assert "- " + "x" * 280 + "\n" in cut


def test_members(spark):
    df = texts(spark, list("abcde"), cluster="cast(external_id % 2 as int)")
    wide = [tuple(r) for r in clusters.cluster_member_table(df, 3).orderBy("position").collect()]
    assert wide == [(0, "0", "1", ""), (1, "2", "3", ""), (2, "4", "", "")]
    odd = texts(spark, list("abcdef"), cluster="cast(case external_id when 0 then -1 when 1 then null when 2 then 7 else 0 end as int)")
    members = clusters.cluster_members(odd)
    assert sorted((r.cluster if r.cluster is not None else -9, r.external_id, r.position) for r in members.collect()) == [
        (-9, 1, 0), (-1, 0, 0), (0, 3, 0), (0, 4, 1), (0, 5, 2), (7, 2, 0)
    ]
    table = clusters.cluster_member_table(odd, 2).orderBy("position")
    assert table.columns == ["position", "cluster_0", "cluster_1", "cluster_other"]
    assert [tuple(r) for r in table.collect()] == [(0, "3", "", "0"), (1, "4", "", "1"), (2, "5", "", "2")]


class Failing:
    """Fails on any batch that has a text with the word boom."""

    def __init__(self, dimensions):
        self.dimensions = dimensions

    def __call__(self, values):
        if any("boom" in v for v in values):
            raise RuntimeError("encoder failed")
        return np.array([[len(v), *[1.0] * (self.dimensions - 1)] for v in values])


def test_failing_batches_become_nan(spark):
    df = texts(spark, ["a", "bb", "boom", "dddd", None]).coalesce(1)
    out = embed.embed_texts(df, Failing, prompt="", batch_size=2, dimensions=4)
    rows = {r.external_id: r for r in out.collect()}
    assert {i: r.embed_ok for i, r in rows.items()} == {0: True, 1: True, 2: False, 3: False}
    assert np.isnan(rows[3].embedding).all() and abs(np.linalg.norm(rows[1].embedding) - 1) < 1e-6
    assert sorted(r.external_id for r in embed.usable(out).collect()) == [0, 1]
    with pytest.raises(Exception, match="encoder failed"):
        embed.embed_texts(df, Failing, prompt="", batch_size=2, dimensions=4, on_error="raise").collect()


class Recording(Failing):
    """Refuses chunks whose texts differ in length by more than one."""

    def __call__(self, values):
        if max(map(len, values)) - min(map(len, values)) > 1:
            raise RuntimeError("padded")
        return super().__call__(values)


def test_encoding_by_length_and_with_a_profile(spark):
    df = texts(spark, ["a" * n for n in (1, 9, 2, 8, 1, 9)]).coalesce(1)
    plain = embed.embed_texts(df, Failing, prompt="", batch_size=2, dimensions=4)
    sorted_out = embed.embed_texts(df, Recording, prompt="", batch_size=3, dimensions=4, by_length=True, on_error="raise")
    as_dict = lambda out: {r.external_id: list(r.embedding) for r in out.collect()}
    assert as_dict(sorted_out) == as_dict(plain)
    assert embed.embed_texts(df, Recording, prompt="", batch_size=3, dimensions=4).where("embed_ok").count() == 0
    # a local session cannot run a stage with resources of its own; the plan asks for them
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    asked = embed.embed_texts(df, Failing, prompt="", batch_size=2, dimensions=4, profile=profile)
    plan = asked._jdf.queryExecution().analyzed()
    assert plan.profile().isDefined() and not plain._jdf.queryExecution().analyzed().profile().isDefined()
    assert plan.profile().get().getTaskCpus().get() == 2


def test_embeddings_are_repeatable_and_stored(spark, tmp_path):
    df = texts(spark, ["one two", "two one", "three"] * 5, platform="'TS'", month="'2024-06'")
    runs = [
        {r.external_id: r.embedding for r in embed.embed_texts(df.repartition(p), batch_size=b).collect()}
        for p, b in ((1, 512), (5, 2))
    ]
    assert runs[0] == runs[1] and len(runs[0][0]) == 128 and runs[0][0] == runs[0][1]
    write_embeddings(embed.embed_texts(df, keep=["platform", "month"]), str(tmp_path / "v"))
    assert read_embeddings(spark, str(tmp_path / "v"), "TS", "2024-06").count() == 15
    assert read_embeddings(spark, str(tmp_path / "v"), "BS").count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(30, 3)) * 0.1 + c for c in ([0, 0, 3], [0, 3, 0], [3, 0, 0])])
    rows = [(i, [float(x) for x in p], i // 30) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "external_id long, embedding array<float>, truth int").repartition(3).cache()


def test_kmeans(spark, vectors):
    found = clusters.kmeans_clusters(vectors, 3).collect()
    assert len({(r.truth, r.cluster) for r in found}) == 3
    again = clusters.kmeans_clusters(vectors, 3).collect()
    assert sorted((r.external_id, r.cluster) for r in found) == sorted((r.external_id, r.cluster) for r in again)


def test_silhouette_equals_brute_force(spark, vectors):
    labelled = vectors.withColumn("odd", F.expr("case when external_id = 5 then 9 else external_id % 2 end"))
    names = ["truth", "odd"]
    sampled = {r.labelling: r.silhouette for r in clusters.silhouette(labelled, names, sample_size=5000).collect()}
    whole = {r.labelling: (r.n, r.silhouette) for r in clusters.silhouette(labelled, names).collect()}
    rows = labelled.orderBy("external_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    square = ((x[:, None] - x[None]) ** 2).sum(-1)

    def by_hand(d, name):
        y, scores = np.array([r[name] for r in rows]), []
        for i in range(len(y)):
            same = (y == y[i]) & (np.arange(len(y)) != i)
            a = d[i][same].mean() if same.any() else None
            b = min(d[i][y == c].mean() for c in set(y) - {y[i]})
            scores.append(0 if a is None else (b - a) / max(a, b))
        return np.mean(scores)

    for name in names:
        assert abs(sampled[name] - by_hand(np.sqrt(square), name)) < 1e-9
        assert whole[name][0] == len(rows) and abs(whole[name][1] - by_hand(square, name)) < 1e-9


def test_vectors_that_cannot_be_compared_are_left_out(spark, vectors):
    odd = spark.createDataFrame(
        [(900, [float("nan")] * 3, 0), (901, None, 0), (902, [1.0, None, 0.0], 0), (903, [float("inf")] * 3, 0)],
        "external_id long, embedding array<float>, truth int",
    )
    both = vectors.unionByName(odd)
    assert clusters.silhouette(both, ["truth"]).first().n == 90
    assert clusters.kmeans_clusters(both, 3, n_init=2).count() == 90
    assert neighbours.core_distance(both).count() == 90


def test_k_sweep(spark, vectors):
    rows = clusters.k_sweep(vectors, k_max=4, n_init=1).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4]
    assert rows[0].inertia > rows[1].inertia > rows[2].inertia
    assert max(rows, key=lambda r: r.silhouette).k == 3


def test_mini_batches_come_near_the_full_fit(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    full = clusters.fit_kmeans(vectors, [5, 10], key="vec_id", n_init=5)
    small = clusters.fit_kmeans(vectors, [5, 10], key="vec_id", n_init=5, method="mini-batch", batch_size=256)
    for k in (5, 10):
        assert full[k][1] <= small[k][1] * (1 + 1e-9) or small[k][1] < full[k][1] * 1.05
        assert small[k][1] < 1.05 * full[k][1]
    again = clusters.fit_kmeans(vectors.repartition(7), [5], key="vec_id", n_init=5, method="mini-batch", batch_size=256)
    assert again[5][1] == pytest.approx(clusters.fit_kmeans(vectors, [5], key="vec_id", n_init=5, method="mini-batch", batch_size=256)[5][1], rel=1e-6)


def test_a_pass_reads_its_batch_only(spark, monkeypatch):
    read = []
    real = clusters._sums

    def noted(rows, models):
        read.append(rows.count())
        return real(rows, models)

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    monkeypatch.setattr(clusters, "_sums", noted)
    clusters.fit_kmeans(vectors, [3], key="vec_id", n_init=2, method="mini-batch", batch_size=200, max_iter=10, patience=None)
    passes = read[clusters.SEED_ROUNDS + 1 : -1]
    assert len(passes) == 10 and max(passes) < 300 and sum(passes) == 2000 and read[-1] == 2000


def test_seeds_come_from_all_rows(spark):
    """A group of few rows far away is drawn, however rare it is."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(20_000)] + [(20_000 + i, [900.0 + i, 0.0, 0.0, 0.0]) for i in range(2)]
    table = spark.createDataFrame(rows, f"{POST_ID} long, embedding array<double>").repartition(4)
    centres = clusters.seed_centres(table.select(POST_ID, F.col("embedding").alias("v")), [2, 3], POST_ID, 1, 4)
    assert set(centres) == {(k, s) for k in (2, 3) for s in range(4)}
    assert all(c[:, 0].max() > 800 for c in centres.values())


def test_all_models_of_a_size_are_compared_together():
    """Rows, sums and costs as one point at a time gives them; of centres equally near the first has the point."""
    r = np.random.default_rng(9)
    points = r.normal(size=(700, 5))
    models = [r.normal(size=(k, 5)) for k in (4, 1, 3, 4, 3)]
    models[2] = np.repeat(points[:1], 3, axis=0)
    adder = clusters._Adder(models)
    assert len(adder.groups) == 3
    for part in (points[:300], points[300:]):
        adder.add(part)
    at, found = 0, adder.result()
    for centres in models:
        own = found[at : at + len(centres)]
        at += len(centres)
        far = ((points[:, None] - centres) ** 2).sum(-1)
        near = far.argmin(axis=1) if len(np.unique(centres, axis=0)) > 1 else np.zeros(len(points), int)
        assert own[:, 0].tolist() == np.bincount(near, minlength=len(centres)).tolist()
        assert np.allclose(own[:, 1:-1], np.eye(len(centres))[near].T @ points)
        assert np.allclose(own[:, -1], np.eye(len(centres))[near].T @ far.min(axis=1))


def test_passes_give_every_core_an_equal_share(spark, monkeypatch):
    shares = []
    real = clusters._sums

    def noted(rows, models):
        if not shares:
            shares.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
        return real(rows, models)

    r = np.random.default_rng(10)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(400, 4)))]
    vectors = spark.createDataFrame(rows, f"{POST_ID} long, embedding array<double>").repartition(11)
    monkeypatch.setattr(clusters, "_sums", noted)
    monkeypatch.setattr(clusters, "TASK_ROWS", 30)
    clusters.fit_kmeans(vectors, [3], n_init=1, max_iter=2)
    assert len(shares) == 2 * spark.sparkContext.defaultParallelism and max(shares) - min(shares) <= 11
    assert clusters.fit_kmeans(vectors.limit(2), [2], n_init=1)[2][1] == pytest.approx(0.0, abs=1e-9)


def test_unknown_methods_and_empty_tables(spark, vectors):
    with pytest.raises(ValueError, match="unknown method"):
        clusters.fit_kmeans(vectors, [2], method="other")
    assert clusters.fit_kmeans(vectors.limit(0), [2], method="mini-batch")[2][1] == 0.0


def test_a_pass_sends_a_row_per_sixteen_centres(spark, monkeypatch):
    """The sums of all models of a pass are those of each row's nearest centre, and few rows carry them."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 4))
    models = [points[:k].copy() for k in (2, 3, 30)]
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>").repartition(5)
    kind, sent = type(rows), []
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sent.append(real(df)) or sent[-1])
    found = clusters._sums(rows, models)
    assert [len(x) for x in sent] == [3]  # 35 centres
    for centres, (n, sums, cost) in zip(models, found, strict=True):
        far = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        own = np.eye(len(centres))[far.argmin(axis=1)]
        assert np.array_equal(n, own.sum(axis=0))
        assert np.allclose(sums, own.T @ points)
        assert np.allclose(cost, own.T @ far.min(axis=1))
    assert [n.sum() for n, _, _ in clusters._sums(rows.where("false"), models)] == [0, 0, 0]


def test_words_of_a_batch_are_counted_in_bounded_runs():
    sizes = np.array([0, 5, embed.WORDS_AT_ONCE, 1, 3 * embed.WORDS_AT_ONCE, 0, 0, 2, *[1] * 50])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    runs = list(embed._runs(ends, 20))
    assert [row for first, last in runs for row in range(first, last)] == list(range(len(sizes)))
    assert all(last - first <= 20 for first, last in runs)
    assert all(last - first == 1 or ends[last] - ends[first] <= embed.WORDS_AT_ONCE for first, last in runs)
    assert list(embed._runs(np.array([0]), 20)) == []
