"""The stages against plain Python on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from socialspark.llm.suffix_dedup import LENGTH

SYLLABLES = {"aa": ["der", "und", "keit", "schaft", "ung", "ver"], "bb": ["the", "and", "tion", "ing", "er", "re"]}


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    r = random.Random(6)

    def text(lang, n):
        return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    passage = text("bb", 90)
    rows, labels = [], []
    for i in range(160):
        lang = "aa" if i % 4 == 0 else "bb"
        words = text(lang, r.randint(60, 160))
        if i % 10 == 3:
            words = words.upper().replace(" ", "!! ")
        if i % 20 == 7:
            words += f" {passage} " + text(lang, 10)
        rows.append((i, words, lang, f"src{i % 3}", len(words)))
        labels.append((i, 0 if i % 10 == 3 else 1, 0))
    for i in range(160, 175):  # exact and near copies
        words = rows[i - 160][1].split(" ")
        if i % 2:
            words[5] = "changed"
        rows.append((i, " ".join(words), rows[i - 160][2], "src0", len(rows[i - 160][1])))
    rows += [(200, None, "bb", "src1", 0), (201, "", "bb", "src1", 0), (202, "12 34 !!", "bb", "src1", 8), (203, rows[9][1], None, "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {i: t for i, t, *_ in rows}


def test_each_stage(spark, tables):
    folder, texts = tables
    docs = pipeline.table(spark, folder, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, folder))
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r for r in docs.collect()}
            assert len(kept[name]) == docs.count()

    assert set(kept["language_id"]) == set(texts) - {200, 201, 202}

    known = sorted(kept["language_id"])
    root = {i: i for i in known}
    for i in known:
        for j in known:
            if j < i and root[i] == i:
                a, b = grams(texts[i]), grams(texts[j])
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j]
    assert set(kept["near_duplicates"]) == {i for i in known if root[i] == i}

    seen: dict = {}
    data = {i: texts[i].encode() for i in kept["near_duplicates"]}
    for d in data.values():
        for k in range(len(d) - LENGTH + 1):
            seen[d[k : k + LENGTH]] = seen.get(d[k : k + LENGTH], 0) + 1
    removed = 0
    for i, d in data.items():
        gone = set()
        for k in range(len(d) - LENGTH + 1):
            if seen[d[k : k + LENGTH]] > 1:
                gone |= set(range(k, k + LENGTH))
        removed += bool(gone)
        left = bytes(b for k, b in enumerate(d) if k not in gone).decode()
        assert (kept["repeated_passages"][i].text if left.strip() else "") == (left if left.strip() else "")
    assert removed >= 7

    mixed = set(kept["mixing"])
    poor = {i for i in kept["repeated_passages"] if "!!" in texts[i]}
    assert mixed <= set(kept["repeated_passages"]) and len(mixed & poor) < len(poor) / 2
    assert len(set(kept["repeated_passages"]) - poor - mixed) <= 2

    packed = docs.collect()
    assert {r.doc_id for r in packed} == mixed
    for i in mixed:
        own = [r for r in packed if r.doc_id == i]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_run_is_the_stages_and_odd_tables_pass(spark, tables, tmp_path):
    folder, _ = tables
    assert pipeline.run(spark, folder).count() > 0
    docs = pipeline.table(spark, folder, "documents")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    pipeline.table(spark, folder, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_and_clashing_columns(spark, tables):
    folder, _ = tables
    docs = pipeline.table(spark, folder, "documents")
    clash = {c: F.lit(f"own {c}") for c in ("score", "lang_pred", "row", "kept", "n_removed", "n", "class_id", "copies", "domain", "_row", "words")}
    again = docs.where("doc_id in (1, 2)").withColumn("doc_id", F.lit(0).cast("long"))  # ids with other texts
    unnamed = docs.where("doc_id in (1, 5, 6)").withColumn("doc_id", F.lit(None).cast("long"))
    odd = docs.where("doc_id not in (5, 6, 165, 166)").unionByName(again).unionByName(unnamed).withColumns(clash)
    kept = {}
    for name, stage in pipeline.STAGES:
        odd = pipeline.cut(stage(spark, odd, folder))
        if name != "packing":
            assert odd.columns == [*docs.columns, *clash]
            assert odd.where(" or ".join(f"`{c}` <> 'own {c}'" for c in clash)).count() == 0
            kept[name] = odd.collect()
    names = [r.doc_id for r in kept["near_duplicates"]]
    texts = [r.text for r in kept["near_duplicates"]]
    assert names.count(0) == 3 and 1 not in names and 2 not in names  # copies of 1 and 2 under a smaller id
    assert names.count(None) == 2 and len(set(texts)) == len(texts)  # the copy of 1 goes, 5 and 6 have no other


def test_passages_of_over_fifty_words_go(spark):
    """60 words of 340 bytes repeat and go; 45 words of 300 bytes stay; so do documents without repeats."""
    r = random.Random(12)

    def text(n, size):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(size)) for _ in range(n))

    long, short = text(60, 5)[:340], text(45, 6)[:300]
    assert len(long.split()) > 50 and len(long) < LENGTH and len(short.split()) < 50
    texts = [f"{text(40, 6)}\n{p}\n{text(40, 6)}" for p in (long, long, long, short, short, text(60, 5))]
    docs = spark.createDataFrame([(i, t, "bb", "src", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r for r in pipeline.remove_repeated_passages(spark, docs, "").collect()}
    for i in range(3):
        assert long[:100] not in left[i].text and long[-100:] not in left[i].text
        assert len(left[i].text) >= len(texts[i]) - len(long) - 10 and left[i].n_chars == len(left[i].text)
    assert [left[i].text for i in (3, 4, 5)] == texts[3:]
