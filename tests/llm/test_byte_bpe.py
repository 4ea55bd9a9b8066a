import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from socialspark.llm import byte_bpe
from socialspark.llm.queries import op11_byte_bpe

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("known", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    None, "", " ", "\n", "  a", "a  ", "\n\na", " \n a\t", "a \n b", "a\r\nb", "\ta\tb\t\t c", "it's I'LL don't 're",
    "a b 　 c\x85d", "<|endoftext|> x", "x" * 1000, "ab" * 3000, " " * 300 + "x", "日本語" * 50, "é 🙂🙂",
]


def merged_by_hand(match: bytes, ranks) -> list[int]:
    """Whole if it is a token, else the leftmost pair of least rank, again and again."""
    if match in ranks:
        return [ranks[match]]
    parts = [bytes([b]) for b in match]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_trees_merge_as_by_hand(ranks):
    r = random.Random(5)
    merges = byte_bpe.Merges(ranks)
    lengths = [1, 2, 3, 4, 5, 8, 9, 16, 17, 31, 32, 33, 63, 64, 65, 130]
    matches = [bytes(r.choice(b" aabeinrst\xc3\xa9") for _ in range(n)) for n in lengths for _ in range(40)]
    ids, sizes = merges.encode(matches)
    want = [merged_by_hand(m, ranks) for m in matches]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    for m, ids in zip(matches, want, strict=True):  # the long way gives the same for any length
        if m not in ranks and len(m) > 1:
            assert merges.of_long(m).tolist() == ids


def test_texts_as_the_known_library(ranks, known):
    r = random.Random(3)
    alphabet = " \n\t'aAbésſ1２.!, 日🙂\r "
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    encoder = byte_bpe.Encoder(ranks, PATTERN)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == known.encode_ordinary(text or "")
        assert encoder.decode(ids) == (text or "").encode()


def test_memory_that_is_full_starts_anew(ranks, known, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    texts = [" ".join(f"word{i * k}" for k in range(30)) for i in range(1200)]
    found = byte_bpe.Encoder(ranks, PATTERN).encode(texts)
    assert [x.tolist() for x in found] == known.encode_ordinary_batch(texts)


def test_round_trip_over_a_table(spark, known):
    texts = ODD + ["the same", "the same", "word " * 20_000]
    rows = [(i % 17 if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    encoded = byte_bpe.encode_texts(docs, PATH, PATTERN, digests=True)
    decoded = byte_bpe.decode_ids(encoded, PATH, PATTERN)
    want = sorted((-1 if i is None else i, known.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    got = [(r["doc_id"], r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encoded.collect()]
    assert sorted((-1 if i is None else i, ids) for i, ids, *_ in got) == [(i, ids) for i, ids, _ in want]
    for _, ids, n, ids_hash, _ in got:
        assert (n, ids_hash) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    spelt = [hashlib.sha256(b).hexdigest() for *_, b in want]
    assert sorted(x[4] for x in got) == sorted(spelt)
    assert sorted((-1 if i is None else i, bytes(b)) for i, b in decoded.collect()) == sorted((i, b) for i, _, b in want)


def test_empty_tables_and_unknown_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    encoded = byte_bpe.encode_texts(none, PATH, PATTERN, digests=True)
    assert encoded.count() == 0
    assert byte_bpe.decode_ids(encoded, PATH, PATTERN).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["bytes"] for r in byte_bpe.decode_ids(ids, PATH, PATTERN).orderBy("doc_id").collect()] == [None, b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode_ids(spark.createDataFrame([(1, [50256])], ids.schema), PATH, PATTERN).collect()


def test_query_over_its_table(spark, known):
    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    found = op11_byte_bpe(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = known.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
