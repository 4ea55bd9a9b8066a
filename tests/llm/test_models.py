import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from socialspark import session
from socialspark.llm import context_tree, language_id, packing, toxicity
from socialspark.llm.common import fold, spaced_words, words_of
from socialspark.llm.words import Letters, distinct_words, parts_of, split_words


def tree_by_hand(train, depth):
    """The weighting recursion on nested contexts; returns the log10 probability of a text."""
    nodes: dict = {}
    for text in train:
        data = b"\n" * depth + text
        for at in range(depth, len(data)):
            for bit in range(8):
                node = (1 << bit) | data[at] >> (8 - bit)
                one = data[at] >> (7 - bit) & 1
                for d in range(depth + 1):
                    nodes.setdefault((data[at - d : at], node), [0, 0])[one] += 1
    children: dict = {}
    for context, node in nodes:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))

    def own(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def weighted(key):
        p = own(*nodes[key])
        if len(key[0]) == depth:
            return p
        return math.log(0.5) + np.logaddexp(p, sum(weighted(c) for c in children[key]))

    def predict(context, node, d):
        key = (context[len(context) - d :], node)
        a, b = nodes.get(key, (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        w = math.exp(math.log(0.5) + own(a, b) - weighted(key)) if key in nodes else 0.5
        return w * p + (1 - w) * predict(context, node, d + 1)

    def score(text):
        data, total = b"\n" * depth + text, 0.0
        for at in range(depth, len(data)):
            for bit in range(8):
                node = (1 << bit) | data[at] >> (8 - bit)
                p = predict(data[at - depth : at], node, 0)
                total += math.log10(p if data[at] >> (7 - bit) & 1 else 1 - p)
        return total

    return score


def test_context_tree_scores_as_by_hand(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcé") for _ in range(r.randint(1, 5))) for _ in range(30)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40))) for _ in range(40)]
    texts += [None, "", " \t", "NEW Zzz\n\x0bword", texts[0], texts[0].upper()]
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(3)
    found = context_tree.context_tree_scores(docs, fold("doc_id", 5) == 1, block_bytes=500).toPandas().set_index("doc_id")
    train = [context_tree.plain(t) for i, t in enumerate(texts) if i not in held]
    score = tree_by_hand(train, context_tree.DEPTH)
    counts = Counter(w for t in train for w in t[:-1].split() + [b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        row, text = found.loc[i], context_tree.plain(t)
        tokens = text[:-1].split() + [b"\n"]
        assert row["held_out"] == (i in held)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(tokens), sum(w in counts for w in tokens), n)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert row["score"] == pytest.approx(score(text), rel=1e-9)
    assert context_tree.context_tree_scores(docs.limit(0), F.lit(False)).count() == 0
    nothing = context_tree.context_tree_scores(docs.limit(5), F.lit(True)).toPandas()
    assert np.allclose(nothing["bits_per_byte"], 8)


def test_long_texts_cross_chunks(spark, monkeypatch):
    data = np.frombuffer(b"ab cd ab\n\nxy ab\n", np.uint8)
    sizes = np.array([9, 1, 6])
    whole = context_tree.distinct(data, sizes, context_tree.GRAM, 5), context_tree.distinct(data, sizes, context_tree.WORD, 5)
    monkeypatch.setattr(context_tree, "_CHUNK", 1)
    parts = context_tree.distinct(data, sizes, context_tree.GRAM, 5), context_tree.distinct(data, sizes, context_tree.WORD, 5)
    for a, b in zip(whole, parts):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert sorted(whole[1][1]) == [1, 1, 3, 3]
    for values in (whole[0][0], whole[0][1], np.array([0.5, -1.25])):
        assert (context_tree.unpack(context_tree.pack(values), values.dtype.type) == values).all()


def toxic_rows(n=1600):
    r = random.Random(2)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 80))]
        kind = i % 4
        if kind in (1, 3):
            words[r.randrange(len(words))] = "dolt"
        if kind in (2, 3):
            words[r.randrange(len(words))] = "martians"
        if kind == 3:
            words += ["dolt", "martians"]
        rows.append((i, " ".join(words), int(kind == 3)))
    return rows


def test_pairs_of_terms_are_learned(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, terms=40)
    found = toxicity.score(docs, model).toPandas().set_index("doc_id")["score"]
    right = [(found[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert np.mean(right) > 0.97
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "martians dolt " * 50_000)], "doc_id long, text string")
    scores = toxicity.score(odd, model).toPandas()["score"]
    assert scores.between(0, 1).all() and scores[2] > 0.5 and scores[0] == scores[1] < 0.5
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("score > 0.01").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_machine_scores_pairs_once():
    machine = toxicity.FactorizationMachine(np.zeros(0), 0.1, np.array([0.2, -0.3, 0.5]), np.array([[1.0, 2], [0.5, -1], [2, 0]]))
    z = 0.1 + 0.4 + (0.5 - 2) + 2 + 1
    got = machine.scores(np.array([1, 1, 1]), np.array([0, 1, 2]), 3)
    assert got == pytest.approx([1 / (1 + math.exp(-0.1)), 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-0.1))])


def test_toxicity_scores_as_by_hand(spark):
    """The whole score again, a word, a term and a pair at a time."""
    r = random.Random(6)
    rows = toxic_rows(300)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, terms=60)
    place = {int(t): i for i, t in enumerate(model.terms)}
    texts = [t for _, t, _ in rows[:40]] + [None, "", "DOLT, dolt! ÉTÉ", " ".join(r.choice(["dolt", "martians", "été"]) for _ in range(500))]
    found = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    for i, got in found.collect():
        terms = set()
        for word in regex.findall(r"[\p{L}\p{M}]+", (texts[i] or "").lower()):
            terms |= {int(t) for t in toxicity.word_terms([word])[0]}
        own = sorted(place[t] for t in terms if t in place)
        z = model.bias + sum(model.weights[p] for p in own)
        z += sum(float(model.factors[p] @ model.factors[q]) for p in own for q in own if p < q)
        assert got == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_terms_that_tell_only_together_are_kept():
    used, y = [], []
    for i in range(400):  # 0 and 1 are in half of all rows each, and together in those of label 1
        a, b = i % 2, i // 2 % 2
        used.append(np.array([2, 3 + i % 5] + [0] * a + [1] * b, np.int64))
        y.append(int(a and b))
    assert set(toxicity._told_by_pairs(used, np.array(y), 8, 0, list(range(8)), 2)) == {0, 1}


def test_languages(spark):
    r = random.Random(4)
    stems = {"aa": ["der", "und", "keit", "schaft"], "bb": ["the", "and", "tion", "ing"]}

    def text(lang):
        return " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(20))

    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.fit(docs.where("doc_id % 3 <> 1"))
    found = language_id.predict(docs, model).toPandas().merge(docs.toPandas().drop(columns="score"), on="doc_id")
    assert (found["lang_pred"] == found["lang"]).all() and found["score"].between(0.5, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "schaftundtion " * 20_000), (4, "日本語")], "doc_id long, text string")
    got = language_id.predict(odd, model).toPandas().set_index("doc_id")
    assert list(got["lang_pred"][[1.0, 2.0, 3.0]]) == ["und"] * 3 and (got["score"][[1.0, 2.0, 3.0]] == 0).all()
    assert got["lang_pred"].iloc[3] == "aa" and got["score"][4.0] == pytest.approx(0.5)
    empty = language_id.fit(docs.limit(0))
    assert set(language_id.predict(docs, empty).toPandas()["lang_pred"]) == {"und"}


def test_texts_reach_the_workers_in_batches_bounded_by_bytes(spark, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('der und das ', 800) as text", "'de' as lang")
    model = language_id.fit(docs.limit(5))

    def bounded(batch):
        assert batch.nbytes < 2 * session.BATCH_BYTES
        return [batch]

    monkeypatch.setattr(language_id, "parts_of", bounded)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    assert language_id.predict(docs, model, keep=None).where("lang_pred = 'de'").count() == 3000
    spark.conf.set(key, "1m")
    session.use_small_batches(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_words_in_one_string_are_the_words(spark):
    """Over more rows than one part has, with rows that have no word."""
    r = random.Random(3)
    letters = "aZé\u0301\xa0 \u3000字ßİ\U0001F600\U00010400\u0345 \t\n.,'-09ﬀ"
    texts = [None, "", " ", "12"] * 600 + ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    r.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(1)
    found = rows.select(words_of(F.col("text")).alias("words"), spaced_words(F.col("text")).alias("spaced")).toArrow()
    batch = found.combine_chunks().to_batches()[0]
    parts = list(parts_of(batch))
    assert len(parts) > 3
    for part in parts:
        (words, places, starts), got = distinct_words(part.column(0)), distinct_words(split_words(part.column(1)))
        assert words == got[0] and (places == got[1]).all() and (starts == got[2]).all()


def test_unseen_words_fall_back_to_shorter_grams():
    def hashed(k, *grams):
        return Letters(list(grams)).spans(k)[0] if grams else np.zeros(0, np.uint64)

    hashes = {0: hashed(1), 5: hashed(5), 4: hashed(4), 3: hashed(3, "^ab"), 2: hashed(2, "zz"), 1: hashed(1)}
    none = np.zeros((0, 2))
    logs = {0: none, 5: none, 4: none, 3: np.array([[-1.0, -5]]), 2: np.array([[-9.0, -1]]), 1: none}
    model = language_id.LanguageModel(["aa", "bb"], hashes, logs)
    assert model.rows(["abzz", "yzz", "q"]).tolist() == [[-1, -5], [-9, -1], [0, 0]]


def test_language_scores_as_by_hand(spark):
    """The whole back-off again with dictionaries, a word at a time, combining marks included."""
    r = random.Random(7)
    letters = {"aa": "abcé", "bb": "bcdñ", "cc": "कखगि"}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        words = ["".join(r.choice(letters[lang]) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 30))]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else ", ".join(words), lang))
    train, test = rows[:150], rows[150:]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language_id.fit(docs, docs_per_lang=10_000, words_per_lang=40, grams_per_lang=50)

    counts = {k: Counter() for k in (0, *language_id.ORDERS)}
    for _, text, lang in train:
        for word in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
            counts[0][lang, word] += 1
            marked = f"^{word}$"
            for k in language_id.ORDERS:
                for at in range(len(marked) - k + 1):
                    if marked[at : at + k] not in ("^", "$"):
                        counts[k][lang, marked[at : at + k]] += 1
    langs, logs = ["aa", "bb", "cc"], {}
    for k, own in counts.items():
        kept = {}
        for lang in langs:
            ranked = sorted((-n, entry.encode()) for (x, entry), n in own.items() if x == lang)
            kept |= {(lang, e.decode()): -n for n, e in ranked[: 50 if k else 40]}
        entries = {e for _, e in kept}
        totals = [sum(n for (x, _), n in kept.items() if x == lang) for lang in langs]
        logs[k] = {
            e: np.array([math.log((kept.get((x, e), 0) + 0.5) / (t + 0.5 * len(entries))) for x, t in zip(langs, totals)])
            for e in entries
        }

    def row_of(word):
        if word in logs[0]:
            return logs[0][word]
        marked = f"^{word}$"
        for k in language_id.ORDERS:
            hits = [logs[k][marked[at : at + k]] for at in range(len(marked) - k + 1) if marked[at : at + k] in logs[k]]
            if hits:
                return np.mean(hits, axis=0)
        return np.zeros(3)

    found = language_id.predict(spark.createDataFrame(test, docs.schema), model, keep=("doc_id",)).toPandas().set_index("doc_id")
    for i, text, _ in test:
        total = sum(row_of(w) for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()))
        p = np.exp(total - total.max())
        assert found["lang_pred"][i] == langs[int(p.argmax())]
        assert found["score"][i] == pytest.approx(p.max() / p.sum(), rel=1e-9)


def test_language_of_rows_with_clashing_columns_and_no_ids(spark):
    rows = [(None, "der und die das" if i % 2 else "the and of to", "de" if i % 2 else "en", 7.0, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, keep=None)
    assert found.columns == ["row", "lang_pred", "score"]
    assert found.where("row.lang <> lang_pred or row.score <> 7 or row.lang_pred <> 'x'").count() == 0
    assert found.count() == 60


def test_packing_places_every_token_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    letters = "ab'.,!? st\nİßΣσ日1é́-|$\x1c\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(120)]
    texts += [None, "", " ", "<|endoftext|> don't", "word " * 6000, "x" * 3000, texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(2)
    found = packing.pack_documents(docs, path, capacity=512, window_tokens=3000).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = found[found["doc_id"] == i].sort_values("start")
        assert [x for ids in pieces["ids"] for x in ids] == want
        assert list(pieces["start"]) == list(np.cumsum([0, *pieces["length"][:-1]]))
        assert set(pieces["doc_tokens"]) == {len(want)}
        for ids, crc in zip(pieces["ids"], pieces["ids_crc32"]):
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == crc
    for _, sequence in found.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence["offset"]) == list(np.cumsum([0, *sequence["length"][:-1]]))
        total = int(sequence["length"].sum())
        assert total <= 512 and total & (total - 1) == 0
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_words_that_decompose_do_not_shift_others():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    letters = [chr(c) for c in (*range(0x958, 0x960), 0x9DC, 0x9DD, 0x9DF, 0xA33, 0xA36, *range(0xA59, 0xA5C), 0xA5E, 0xFB1D, *range(0xFB2A, 0xFB4F)) if chr(c).isalpha()]
    texts = [f"word number {i} स{x}क, and ব{x} {x}. İß ΣΑΣ e\u0301té straße" for i, x in enumerate(letters)]
    texts += ["plain words only", "\u0938\u095c\u0915 \u09ac\u09dc", ""]
    got = packing.WordTokenizer(path).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_that_differ_in_case_or_punctuation_share_their_merges():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    texts = ["übermäßig, Übermäßig! ÜBERMÄßIG übermäßig", "(übermäßig)12 ÜBERMÄßIG,\nübermäßig!21", None, ""]
    words = packing.WordTokenizer(path)
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert list(ids) == tokenizer.encode(text or "", add_special_tokens=False).ids
    assert words._known == len(["übermäßig", ",", "!", "(", ")", "1", "2"])


def test_units_of_any_text_give_the_ids_of_the_tokenizer(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    with open(path) as file:
        said = json.load(file)
    cased = str(tmp_path / "cased.json")
    with open(cased, "w") as file:
        json.dump(said | {"normalizer": None}, file)
    r = random.Random(8)
    letters = [*"abeiosTUVZ  \n.,!'()-<|>_09", *"ÀÖ×ØÞßàö÷øþÿ", *"œŒİıſKΣςЖ日ªº²½", *"\x00\x01\x1c\x1f\x7f\t\r\x85\xa0\xad\u2028\u3000\u0301\u0308\u0338\U0001f600"]
    for some in (letters, letters[:27], letters[:39], [*"aÉ ", "\u0301"], [*"xS9'", "'s", "'re", "<|endoftext|>", " "]):
        texts = ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(400)]
        for file in (path, cased):
            words, tokenizer = packing.WordTokenizer(file), Tokenizer.from_file(file)
            for text, ids in zip(texts, words.encode(texts, at_once=150), strict=True):
                assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_lines_that_do_not_fit_are_encoded_by_word(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    real = packing.plain_words
    monkeypatch.setattr(packing, "plain_words", lambda words: (np.array([bool(w) for w in words], bool), *real(words)[1:]))
    texts = ["one two don't", "a1b2 three", "\u0938\u095c\u0915 four x!y", "x.1 12 five."]
    for text, ids in zip(texts, packing.WordTokenizer(path).encode(texts), strict=True):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids


def test_costs_are_balanced():
    lengths = [random.Random(5).randint(1, 3000) for _ in range(400)]
    rows = packing.pack_window(lengths, 4096, 64)
    spent: dict = {}
    for _, _, n, seq, _ in rows:
        spent[seq] = spent.get(seq, 0) + packing.cost(n, 64)
    full = [c for s, c in spent.items() if s < sum(lengths) // 4096]
    assert max(full) < 2 * min(full)
