"""Self-join of documents on the Jaccard similarity of their word n-grams.

Texts are compared as lower-case words between white space. MinHash values of the n-grams
are grouped into bands, whose number and rows follow from the threshold and the
target recall; documents that share the hash of a band are candidates, and every candidate pair
is verified on the full sets of n-grams.

Texts with the same words are one class before anything is compared. Pairs never
become rows: candidates are dealt into blocks of about ``BLOCK`` classes and ``BLOCK_BYTES`` of text (or one text, if it is longer), by the
largest buckets that they are in or reach, and two blocks meet in a task once if any bucket reaches
into both. The task checks all their candidate pairs in matrices and returns a row per class:
how many links it has there, and its least companion. So a bucket that holds a third of all rows is many
blocks over many tasks, and work on it is quadratic in its different texts only.

Defined results: null or empty texts, texts of white space and rows without an id have
no n-grams and no links, and are their own class (``class_id`` is their id); texts with fewer than ``n`` words
have one n-gram, of all their words. Ids may repeat: every row is compared by its own text, and classes are named by the
least id in them. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.llm.components import components
from socialspark.llm.hashing import Spans
from socialspark.session import cut

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
BLOCK = 512
BLOCK_BYTES = 4 << 20
_CHUNK = 1 << 18


def banding(threshold: float = THRESHOLD, recall: float = RECALL, noise: float = 0.25) -> tuple[int, int]:
    """``(bands, rows)``: the fewest values that find a pair at ``threshold`` with probability ``recall``.

    Rows grow until a pair at half the threshold becomes a candidate with
    probability ``noise`` at most.
    """
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= noise or threshold**(rows + 1) < 1e-3:
            break
    return bands, rows


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = (text or "").lower().split()
    found = []
    for first in range(0, max(len(words) - n + 1, min(len(words), 1)), _CHUNK):
        part = [w.encode("utf-8", "surrogatepass") for w in words[first : first + _CHUNK + n - 1]]
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
        stops = np.cumsum(sizes)
        starts = stops - sizes
        last = max(len(part) - n + 1, 1)
        spans = Spans(np.frombuffer(b" ".join(part), np.uint8))
        found.append(spans.hash(starts[:last], stops[len(part) - last :] - 1))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the MinHash values of a set of n-grams."""
    random = np.random.Generator(np.random.PCG64(7))
    times = random.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    plus = random.integers(0, 1 << 64, (bands * rows, 1), np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(grams), 1024):
        values = grams[None, first : first + 1024] * times
        values += plus
        np.minimum(least, values.min(axis=1), out=least)
    joined = np.ascontiguousarray(least.reshape(bands, rows)).view(np.uint8).reshape(-1)
    at = np.arange(bands) * rows * 8
    return Spans(joined).hash(at, at + rows * 8)


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, sigs, sizes = [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = ngrams(text, n)
                words = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-8", "surrogatepass"), np.uint8)
                ends = np.zeros(1, np.int64), np.array([len(words)])
                first.append(Spans(words, 0).hash(*ends)[0].astype(np.int64))
                second.append(Spans(words, 1).hash(*ends)[0].astype(np.int64))
                sizes.append(len(words))
                sigs.append(band_hashes(grams, bands, rows).astype(np.int64) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                    pa.array(sigs, pa.list_(pa.int64())), pa.array(sizes, pa.int64()),
                ],
                ["id", "own", "h1", "h2", "bands", "bytes"],
            )

    return run


def _links(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which ``wanted`` pairs of two lists of sets reach the threshold."""
    sizes = np.array([len(s) for s in left + right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, gram, seen = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    shared = seen[gram] > 1
    owner, gram = owner[shared], gram[shared]
    _, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    cuts = np.searchsorted(gram, np.arange(0, (gram[-1] + 1 if len(gram) else 0) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((len(sizes), width), np.float32)
        part[owner[a:b], gram[a:b] - k * width] = 1
        common += part[: len(left)] @ part[len(left) :].T
    total = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return wanted & (common >= threshold * total - 1e-9)


def _verify(n: int, threshold: float):
    """Rows sorted by pair of blocks: a row per class with links in the pair."""

    def least_companions(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> dict[int, int]:
        root = {int(x): int(x) for x in np.concatenate([left, right])}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, row in enumerate(linked):
            for j in np.flatnonzero(row):
                a, b = find(int(left[i])), find(int(right[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    def of_pair(frame: pa.Table) -> pa.RecordBatch:
        lo, hi = frame["lo"][0].as_py(), frame["hi"][0].as_py()
        node, block = frame["node"].to_numpy(), frame["block"].to_numpy()
        copies = frame["copies"].to_numpy()
        _, keep = np.unique(node, return_index=True)
        sets = [ngrams(frame["text"][int(i)].as_py(), n) for i in keep]
        bands = np.array([frame["bands"][int(i)].as_py() for i in keep])
        node, block, copies = node[keep], block[keep], copies[keep]
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        wanted = np.zeros((len(a), len(b)), bool)
        for k in range(bands.shape[1]):
            wanted |= bands[a, k][:, None] == bands[b, k][None, :]
        if lo == hi:
            wanted &= np.tri(len(a), k=-1, dtype=bool)
        linked = _links([sets[i] for i in a], [sets[i] for i in b], wanted, threshold)
        count = np.zeros(len(node), np.int64)
        np.add.at(count, a, linked @ copies[b])
        np.add.at(count, b, linked.T @ copies[a])
        root = least_companions(node[a], node[b], linked)
        has = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[has]), pa.array([root[int(x)] for x in node[has]], pa.int64()), pa.array(count[has])],
            ["node", "root", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            edges = np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, len(lo)], strict=True):
                if start == stop:
                    continue
                key = (lo[start], hi[start])
                if held and key != last:
                    yield of_pair(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, stop - start))
                last = key
        if held:
            yield of_pair(pa.Table.from_batches(held))

    return run


def _blocks(members: DataFrame, size: int, most_bytes: int) -> DataFrame:
    """``(node, block)``: blocks of about ``size`` nodes and ``most_bytes`` of text that share buckets where they can.

    A node is at home in its largest bucket. A home of few nodes moves in with the
    most popular home that any of its buckets reaches, so that a large group is a few
    full blocks and not many small ones; the nodes of a small home stay together.
    """
    few = size // 4
    home = members.groupBy("node").agg(F.max(F.struct("n", "band", "h")).alias("at"), F.max("bytes").alias("bytes"))
    home = home.select("node", F.xxhash64("at").alias("home"), "bytes")
    home = cut(home)
    popular = home.groupBy("home").agg(F.count(F.lit(1)).alias("k"))
    placed = cut(members.select("band", "h", "node").join(home.drop("bytes").join(popular, "home"), "node"))
    best = placed.groupBy("band", "h").agg(F.max(F.struct("k", "home")).alias("best"))
    host = (
        placed.where(F.col("k") <= few).select("band", "h", "home", "k").distinct()
        .join(best, ["band", "h"])
        .groupBy("home", "k").agg(F.max("best").alias("best"))
        .select("home", F.when(F.col("best.k") > F.col("k"), F.col("best.home")).otherwise(F.col("home")).alias("host"))
    )
    hosted = cut(
        home.join(popular, "home").join(host, "home", "left")
        .select("node", "bytes", F.coalesce("host", "home").alias("host"), F.when(F.col("k") <= few, F.xxhash64("home")).otherwise(F.xxhash64("node")).alias("mix"))
    )
    enough = F.greatest(F.ceil(F.count(F.lit(1)) / size), F.ceil(F.sum("bytes") / most_bytes))
    parts = hosted.groupBy("host").agg(enough.alias("parts"))
    return hosted.join(parts, "host").select("node", F.xxhash64("host", F.pmod("mix", F.col("parts"))).alias("block"))


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document: ``class_id``, ``n_links``, ``copy_of``, ``n_copies``.

    Two documents are linked if the Jaccard similarity of their n-grams reaches the
    threshold. ``class_id`` is the least id that a document reaches by links, ``n_links`` counts
    its links to other rows, ``copy_of`` is the least id with the same words and
    ``n_copies`` the number of rows with them. A pair at the threshold is found with
    probability ``recall``, a more similar one with a higher.
    """
    bands, rows = banding(threshold, recall)
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("own"))
    signed = cut(texts.mapInArrow(_signatures(n, bands, rows), "id long, own long, h1 long, h2 long, bands array<long>, bytes long"))
    classes = cut(
        signed.where("id is not null and bands is not null")
        .groupBy("h1", "h2")
        .agg(
            F.min(F.struct("id", "own")).alias("one"), F.count(F.lit(1)).alias("copies"),
            F.min_by("bands", F.struct("id", "own")).alias("bands"), F.max("bytes").alias("bytes"),
        )
        .withColumn("node", F.xxhash64("h1", "h2"))
    )
    banded = classes.select("node", "bytes", F.posexplode("bands").alias("band", "h"))
    buckets = (
        banded.groupBy("band", "h")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .where("n > 1")
        # the same members under another band: the first band is enough
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("band", "h")).alias("at"))
        .select("n", "at.band", "at.h")
    )
    members = cut(banded.join(buckets, ["band", "h"]))
    homes = cut(_blocks(members, block, block_bytes))
    reach = members.join(homes, "node").groupBy("band", "h", "block").agg(F.count(F.lit(1)).alias("k"))
    other = reach.select("band", "h", F.col("block").alias("hi"), F.col("k").alias("_k"))
    pairs = (
        reach.withColumnRenamed("block", "lo")
        .join(other, ["band", "h"])
        .where("lo < hi or (lo = hi and k > 1)")
        .select("lo", "hi")
        .distinct()
    )
    meets = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    held = classes.select("one.id", "one.own", "node", "copies", "bands").join(homes, "node")
    dealt = (
        texts.join(held, ["id", "own"])
        .join(meets, "block")
        .repartition("lo", "hi")
        .sortWithinPartitions("lo", "hi")
        .select("lo", "hi", "block", "node", "copies", "bands", "text")
    )
    links = cut(dealt.mapInArrow(_verify(n, threshold), "node long, root long, links long"))
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    least = F.col("one.id").alias("least")
    linked = cut(roots.join(classes.select("node", least), "node"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("name")), "root").select("node", "name")
    known = (
        classes.select("h1", "h2", "node", least, "copies")
        .join(counted, "node", "left")
        .join(named, "node", "left")
    )
    found = signed.withColumn("_in", F.expr("id is not null and bands is not null")).join(
        known.withColumn("_in", F.lit(True)), ["_in", "h1", "h2"], "left"
    )
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("name", "least", "id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("least", "id").alias("copy_of"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )
