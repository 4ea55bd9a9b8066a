import random
import re

from pyspark.sql import functions as F

from socialspark.operators import keywords


def made_words(seed, n, letters="ab.", longest=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n)]


def units(words):
    return [[re.escape(c) for c in w] for w in words]


def test_the_first_alternative_wins_as_in_a_plain_list():
    for seed in range(200):
        words, text = made_words(seed, 1 + seed % 30), "".join(random.Random(seed).choices("ab.c", k=80))
        plain = re.findall("|".join(map(re.escape, words)), text)
        assert re.findall(keywords.trie_pattern(units(words)), text) == plain, (seed, words)


def test_all_words_stay_where_a_pattern_goes_on():
    for seed in range(200):
        words, texts = made_words(seed, 1 + seed % 10, longest=3), made_words(-1 - seed, 60, "ab.", 4)
        pattern = keywords.trie_pattern(units(words), first_wins=False)
        assert [bool(re.fullmatch(pattern, t)) for t in texts] == [t in words for t in texts]


def test_shared_prefixes_are_written_once():
    assert keywords.trie_pattern(units(["biden2024", "biden", "bidet", "biden20"])) == "bide(?:n(?:2024|)|t)"
    assert keywords.trie_pattern([]) == keywords.NOTHING
    assert keywords.trie_pattern(units(["a", "", "b"])) == "(?:a|)"


def test_two_thousand_keywords_in_texts(spark):
    words = sorted(set(made_words(1, 3000, "abcdef", 7)), key=lambda w: w[::-1])[:2000]
    texts = [" ".join(made_words(10 + i, 30, "abcdefg", 9)) for i in range(20)] + ["", None, "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r.keyword for r in keywords.tag_keywords(df, words).orderBy("id").collect()]
    plain = re.compile("|".join(map(re.escape, words)))
    assert got == [None if t is None else ",".join(plain.findall(t.replace(" ", ""))) for t in texts]
    assert [r.keyword for r in keywords.tag_keywords(df, []).orderBy("id").collect()] == [
        None if t is None else "" for t in texts
    ]


def test_a_group_holds_when_any_of_its_terms_does(spark):
    terms = ["ab", "abc d", "b*", "a.c", "cc*", "d"]
    texts = ["ab", "xab", "abc d", "abc dx", "bbb", "cb", "a.c!", "abc", "ccx y", "D", "", None, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    one = keywords.keyword_groups(df, {"any": terms, "none": [], "both": [("ab", "d"), ("a", "b")]}).orderBy("id").collect()
    each = [F.coalesce(F.lower("text").rlike(keywords.term_pattern(t)), F.lit(False)) for t in terms]
    want = df.select("id", F.greatest(*each).alias("any")).orderBy("id").collect()
    assert [r.any for r in one] == [r.any for r in want] and any(r.any for r in want)
    assert not any(r.none for r in one)
    assert [t for t, r in zip(texts, one) if r.both] == ["a b"]
