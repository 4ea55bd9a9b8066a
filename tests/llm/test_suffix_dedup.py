import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from socialspark.llm.suffix_dedup import remove_repeats, repeated_windows
from socialspark.llm.suffix_sort import common, deep_shallow


def by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)

    def words(n):
        return " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(n))

    passage, other = words(40), words(30)
    near = words(60).split(" ")
    texts = [None, "", "kurz", passage, passage, "x" * 300, "ab" * 200 + words(5)]
    for _ in range(12):
        texts.append(words(r.randint(0, 20)) + passage[r.randint(0, 30) : r.randint(120, 200)] + words(r.randint(0, 20)))
    for _ in range(8):
        copy = list(near)
        copy[r.randrange(len(copy))] = "zz"
        texts.append(" ".join(copy))
    texts += [other + " " + other, words(30) + other, near[0] * 50, words(200)]
    return texts


def test_deep_shallow_orders_like_sorted():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 60))) for _ in range(300)]
    strings += [b"a" * 40 + s for s in strings] + [b"a" * 40] * 3
    order, shared = deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        assert shared[k] == common(strings[order[k - 1]], strings[order[k]])
    assert sorted(order) == list(range(len(strings)))


def test_small_and_large_groups_agree(monkeypatch):
    r = random.Random(2)
    lefts = [bytes(r.choice(b"ab") for _ in range(20)) for _ in range(20)]
    rights = [b"q" * 10 + bytes(r.choice(b"ab") for _ in range(30)) for _ in range(20)]
    low, high = np.zeros(20, int), np.array([r.randint(5, 20) for _ in range(20)])
    lefts = [x[:h] for x, h in zip(lefts, high)]

    def covered(found):
        return [sorted({t for a, b in x for t in range(a, b + 1)}) for x in found]

    pairs = repeated_windows(lefts, rights, low, high, 16)
    monkeypatch.setattr("socialspark.llm.suffix_dedup._PAIRWISE", 1)
    assert covered(pairs) == covered(repeated_windows(lefts, rights, low, high, 16))
    assert any(pairs)


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 20_000), (3, 1)])
def test_removes_what_brute_force_removes(spark, seed, group):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram string").repartition(3)
    found = remove_repeats(docs, length=48, gram=16, group=group).toPandas().sort_values("doc_id")
    got = list(found[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None))
    assert got == by_hand(texts, 48)
    assert sum(x[1] for x in got) > 1000


def test_long_texts_go_in_pieces(spark, monkeypatch):
    import socialspark.llm.suffix_dedup as module

    texts = [("".join(random.Random(k).choice("abcdefgh") for _ in range(3000))) for k in range(3)]
    texts.append(texts[0][500:2500] + texts[1][100:900])
    rows = []
    monkeypatch.setattr(module, "_PIECE", 700)
    for part in module.anchors([t.encode() for t in texts], 48, 16):
        rows += list(zip(*[x.tolist() for x in part]))
    monkeypatch.setattr(module, "_PIECE", 1 << 21)
    once = [r for part in module.anchors([t.encode() for t in texts], 48, 16) for r in zip(*[x.tolist() for x in part])]
    assert sorted(rows) == sorted(once)


def test_odd_rows(spark):
    text = "wort " * 100
    rows = [(1, text), (1, text), (None, "a" * 500), (None, None), (2, "kurz"), (3, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = remove_repeats(docs).toPandas()
    assert len(found) == 6
    assert (found.loc[found.doc_id == 1, "n_removed"] == 500).all()
    assert found.loc[found.doc_id == 2, "n_removed"].item() == 0
    assert found.loc[found.doc_id == 3, "n_removed"].item() == 600
    assert remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_together_keep_their_places():
    """Two texts that fill a batch of pieces: places must not run over their bits."""
    from socialspark.llm import suffix_dedup

    r = np.random.default_rng(9)
    texts = [r.integers(97, 123, n, np.uint8).tobytes() for n in ((1 << 21) - 1, (1 << 21) + 2000)]
    both = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(texts, suffix_dedup.LENGTH, suffix_dedup.GRAM))]
    alone = []
    for i, text in enumerate(texts):
        parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchors([text], suffix_dedup.LENGTH, suffix_dedup.GRAM))]
        alone.append([np.full(len(parts[0]), i), *parts[1:]])
    for got, *want in zip(both, *alone):
        assert (got == np.concatenate(want)).all()


def test_texts_of_a_batch_are_hashed_in_small_pieces():
    """The arrays of a piece take about a hundred times its bytes."""
    from socialspark.llm.suffix_dedup import anchors

    text = bytes(random.Random(1).randbytes(100_000))
    parts = list(anchors([text] * 16, 400, 96))
    assert len(parts) >= 5
    assert len({tuple(sorted(part[1][part[0] == i].tolist())) for part in parts for i in set(part[0].tolist())}) == 1
