import random

from socialspark.llm.ngram_join import banding, ngram_join


def grams(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def by_hand(rows):
    sets = [grams(t) for _, t in rows]
    links = [set() for _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (least[find(i)], len(links[i])) for i, (d, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)

    def words(n):
        return ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 5))) for _ in range(n)]

    texts = [None, "", "  ", "one two", "One  two", "one two three", " ".join(words(2000))]
    for _ in range(10):
        base = words(r.randint(30, 200))
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = words(1)[0]
            texts.append(" ".join(copy))
    base = words(120)
    for k in range(60):  # a large group of near copies, and copies of some of them
        copy = list(base)
        copy[k] = "zz"
        texts += [" ".join(copy)] * (1 + k % 3)
    r.shuffle(texts)
    return list(enumerate(texts))


def test_links_and_classes_as_by_brute_force(spark):
    for seed, block in ((1, 512), (2, 7)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, bands long").repartition(4)
        found = ngram_join(docs, block=block).toPandas()
        got = {r.doc_id: (r.class_id, r.n_links) for r in found.itertuples()}
        assert got == by_hand(rows)


def test_banding_reaches_its_recall():
    bands, rows = banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert 1 - (1 - 0.8**rows) ** (bands - 1) < 0.9999


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c\nd e f"), (None, None), (3, "q" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join(docs).toPandas()
    assert len(found) == 6
    assert set(found.loc[found.doc_id.isin([1, 2]), "class_id"]) == {1}
    assert set(found.loc[found.doc_id.isin([1, 2]), "n_links"]) == {2}
    assert set(found.loc[found.doc_id.isna(), "n_links"]) == {0}
    assert ngram_join(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_compared_by_their_own_texts(spark):
    a, b = "a b c d e f g", "u v w x y z t"
    rows = [(5, a), (5, b), (6, a), (7, b), (5, None), (8, "q r s"), (8, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.class_id, r.n_links, r.copy_of, r.n_copies) for r in ngram_join(docs).collect())
    assert found == [(5, 5, 0, 5, 1), (5, 5, 1, 5, 2), (5, 5, 1, 5, 2), (6, 5, 1, 5, 2), (7, 5, 1, 5, 2), (8, 8, 1, 8, 2), (8, 8, 1, 8, 2)]
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]  # by themselves the texts are four classes
    found = {r.doc_id: r.class_id for r in ngram_join(spark.createDataFrame(numbered, docs.schema)).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4, 5: 5, 6: 5}


def test_blocks_bounded_by_bytes_give_the_same(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, bands long").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(docs, block_bytes=1500).toPandas().itertuples()}
    assert got == by_hand(rows)
