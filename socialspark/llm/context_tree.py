"""Language-model scores by context-tree weighting over bytes.

A text is its words, ASCII letters in lower case, with one space between and a line
feed at the end; so the bytes and the words with their end say the same. Every byte is eight binary
decisions, each with a tree of contexts: the bytes before it, the latest first, up to ``depth``. In a
context of some length a decision is predicted by the Krichevsky-Trofimov estimate of what
followed that context in the training texts; the weighting recursion mixes the estimates
of all lengths by how well each coded the training texts. The model is then frozen, and a text's
score is the sum of the log10 probabilities of its bytes.

How it is spread:

1. Texts become blocks of about ``BLOCK_BYTES``, packed, in the shared folder.
2. A block lists its distinct grams (``depth`` bytes of context, and the next byte) and words with their
   counts in training texts, in one sorted list per part; a part is the hash of the three latest
   bytes of context, or of a word.
3. Each part merges its lists as they stream by, so a task holds distinct grams only. Below three bytes a part has
   complete subtrees of contexts; the few levels above are small aggregates over all parts.
4. Each part gives its grams their log probability, again streams the lists and answers each with values in the
   same order.
5. A block meets the answers to its lists and adds up its texts.

No model is sent to all tasks: parts grow in number with the corpus, up to ``MOST_PARTS``, then in size with its
distinct grams. Words and grams are known by 64-bit hashes and by themselves.

Defined results: a null or empty text is the end alone; ids may be null or repeat; without
training texts every decision has probability 1/2; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.llm.hashing import Spans, mix
from socialspark.session import cut

DEPTH = 5
TOP = 3
BLOCK_BYTES = 16 << 20
MOST_PARTS = 4096
WORD, GRAM = 0, 1
_CHUNK = 2 << 20
_HALF = math.log(0.5)
_U8 = np.uint64(8)


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b"\n"


# --- what a block lists -----------------------------------------------------------------


def chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_CHUNK`` bytes."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        start = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, start + _CHUNK, side="right")))
        yield first, last
        first = last


def grams(data: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """For each byte its context, latest byte first, and itself last; texts begin after line feeds."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    out = data.astype(np.uint64)
    for back in range(1, depth + 1):
        before = np.full(len(data), 10, np.uint64)
        before[back:] = data[:-back]
        before[place < back] = 10
        out |= before << np.uint64(8 * (depth + 1 - back))
    return out


def words(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and ends of the texts, and the text of each."""
    stops = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], stops[:-1] + 1])
    ends = np.cumsum(sizes) - 1
    full = starts < stops
    spans = Spans(data)
    hashes = np.concatenate([spans.hash(starts[full], stops[full]), spans.hash(ends, ends + 1)])
    owner = np.concatenate([np.searchsorted(ends, stops[full]), np.arange(len(sizes))])
    return hashes, owner


def part_of(kind: int, keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    stem = keys if kind == WORD else keys >> np.uint64(8 * (depth + 1 - TOP))
    return (mix(stem + np.uint64(kind + 1)) % np.uint64(parts)).astype(np.int64)


def distinct(data: np.ndarray, sizes: np.ndarray, kind: int, depth: int, chosen: np.ndarray | None = None):
    """Distinct keys of a block and their counts, of the ``chosen`` texts only if given."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    for first, last in chunks(sizes):
        part = data[ends[first] - sizes[first] : ends[last - 1]]
        own = sizes[first:last]
        if kind == GRAM:
            found = grams(part, own, depth)
            owner = None if chosen is None else np.repeat(np.arange(len(own)), own)
        else:
            found, owner = words(part, own)
        if chosen is not None:
            found = found[chosen[first:last][owner]]
        more, n = np.unique(found, return_counts=True)
        keys, counts = add_up(np.concatenate([keys, more]), np.concatenate([counts, n]))
    return keys, counts


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def pack(values: np.ndarray) -> bytes:
    """Sorted keys as differences, or counts, compressed."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<"))).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes(), 3)


def unpack(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T
    values = np.ascontiguousarray(flat).view(np.dtype(kind).newbyteorder("<")).reshape(-1).astype(kind)
    return np.cumsum(values, dtype=np.uint64) if kind is np.uint64 else values


# --- the trees -------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after seven steps up."""
    y = x + 7
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x) - np.log(x + 1) - np.log(x + 2) - np.log((x + 3) * (x + 4)) - np.log((x + 5) * (x + 6))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one after so many zeros and ones."""
    return (ones + 0.5) / (zeros + ones + 1.0)


class Level:
    """Nodes of one depth: context and decision, with counts, weighted log probability and the weight of their own estimate."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.ids, self.zeros, self.ones = ids, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.weighted, self.weight = own, np.ones(len(ids))
        else:
            self.weighted = np.logaddexp(_HALF + own, _HALF + below)
            self.weight = np.exp(_HALF + own - self.weighted)
        self.parent = np.zeros(0, np.int64)

    def up(self) -> Level:
        """The level above; its nodes lose the oldest byte of context."""
        ids = (self.ids >> np.uint64(16) << _U8) | (self.ids & np.uint64(255))
        order = np.argsort(ids, kind="stable")
        ordered = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.parent = np.empty(len(ids), np.int64)
        self.parent[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        sums = [np.add.reduceat(x[order], first) for x in (self.zeros, self.ones, self.weighted)]
        return Level(ordered[first], *sums)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, bit: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels from ``depth`` up to ``TOP`` of the trees of decision ``bit``; each gram's node, and its bit."""
    byte = keys & np.uint64(255)
    node = (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
    ids = (keys >> _U8 << _U8) | node
    is_one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    at = np.cumsum(np.concatenate([[False], ids[1:] != ids[:-1]]))
    n = counts.astype(float)
    levels = [Level(ids[first], np.add.reduceat(n * ~is_one, first), np.add.reduceat(n * is_one, first), None)]
    for _ in range(depth - TOP):
        levels.append(levels[-1].up())
    return levels, at, is_one


def gram_logs(keys: np.ndarray, counts: np.ndarray, depth: int, top: dict[str, np.ndarray]) -> np.ndarray:
    """Log10 probability of the last byte of each gram; ``top`` has what the levels above contribute to each node at ``TOP``."""
    out = np.zeros(len(keys))
    for bit in range(8):
        levels, at, is_one = subtree(keys, counts, depth, bit)
        place = np.searchsorted(top["ids"], levels[-1].ids)
        fixed, rest = top["fixed"][place], top["rest"][place]
        for level in reversed(levels):
            if level is not levels[-1]:
                fixed, rest = fixed[level.parent], rest[level.parent]
            fixed = fixed + rest * level.weight * kt(level.zeros, level.ones)
            rest = rest * (1 - level.weight)
        p = fixed[at]
        out += np.log10(np.where(is_one, p, 1 - p))
    return out


# --- on Spark --------------------------------------------------------------------------


def _pack_blocks(id_name: str, block_bytes: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        block = TaskContext.get().partitionId() << 24
        squeeze = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, texts, size, block
            row = {"block": block, "ids": ids, "held": held, "sizes": [len(t) for t in texts], "data": squeeze.compress(b"".join(texts))}
            ids, held, texts, size, block = [], [], [], 0, block + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(plain(t))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    return run


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
    return data, np.array(row["sizes"], np.int64), np.array(row["held"], bool)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


_LIST = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_LIST_SQL = "part int, kind int, block long, keys binary, counts binary"


def _list_keys(depth: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data, sizes, held = _block(row)
                for kind in (WORD, GRAM):
                    keys, _ = distinct(data, sizes, kind, depth)
                    trained, n = distinct(data, sizes, kind, depth, ~held)
                    counts = np.zeros(len(keys), np.int64)
                    counts[np.searchsorted(keys, trained)] = n
                    part = part_of(kind, keys, depth, parts)
                    for p in np.unique(part):
                        own = part == p
                        yield pa.RecordBatch.from_pylist(
                            [{"part": p, "kind": kind, "block": row["block"], "keys": pack(keys[own]), "counts": pack(counts[own])}], _LIST
                        )

    return run


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists sorted by kind and part: one list for each, of all blocks."""
    at, waiting, size = None, [], 0
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settle() -> None:
        nonlocal keys, counts, waiting, size
        keys, counts = add_up(
            np.concatenate([keys, *[k for k, _ in waiting]]), np.concatenate([counts, *[c for _, c in waiting]])
        )
        waiting, size = [], 0

    def out() -> pa.RecordBatch:
        settle()
        return pa.RecordBatch.from_pylist(
            [{"part": at[1], "kind": at[0], "block": -1, "keys": pack(keys), "counts": pack(counts)}], _LIST
        )

    for batch in batches:
        for row in _rows(batch):
            if at is not None and at != (row["kind"], row["part"]):
                yield out()
                keys, counts = keys[:0], counts[:0]
            at = row["kind"], row["part"]
            waiting.append((unpack(row["keys"], np.uint64), unpack(row["counts"], np.int64)))
            size += len(waiting[-1][0])
            if size > max(1 << 20, len(keys)):
                settle()
    if at is not None:
        yield out()


_NODE_SQL = "part int, id long, zeros double, ones double, weighted double"


def _top_nodes(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, counts = unpack(row["keys"], np.uint64), unpack(row["counts"], np.int64)
                for bit in range(8):
                    top = subtree(keys, counts, depth, bit)[0][-1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(top.ids), row["part"], np.int32)), pa.array(top.ids.astype(np.int64)),
                            pa.array(top.zeros), pa.array(top.ones), pa.array(top.weighted),
                        ],
                        ["part", "id", "zeros", "ones", "weighted"],
                    )

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, zeros, ones, below = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        level = Level(ids, zeros, ones, below)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), *(pa.array(x) for x in (zeros, ones, level.weighted, level.weight, kt(zeros, ones)))],
            ["id", "zeros", "ones", "weighted", "weight", "kt"],
        )


def _shorter(node: Column) -> Column:
    """A node without its oldest byte of context."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(255))


def _contributions(nodes: DataFrame) -> DataFrame:
    """``nodes`` at ``TOP`` with what the levels above them contribute: ``p = fixed + rest * (prediction below)``."""
    levels = []
    level = nodes
    for _ in range(TOP):
        sums = level.groupBy(_shorter(F.col("id")).alias("id")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        level = cut(sums.mapInArrow(_weigh, "id long, zeros double, ones double, weighted double, weight double, kt double"))
        levels.append(level)
    fixed, rest = F.col("weight") * F.col("kt"), 1 - F.col("weight")
    above = levels.pop().select("id", fixed.alias("fixed"), rest.alias("rest"))
    while levels:
        level = levels.pop().withColumn("_up", _shorter(F.col("id")))
        above = level.join(above.withColumnRenamed("id", "_up"), "_up").select(
            "id", (F.col("fixed") + F.col("rest") * fixed).alias("fixed"), (F.col("rest") * rest).alias("rest")
        )
    return nodes.select("part", "id", _shorter(F.col("id")).alias("_up")).join(above.withColumnRenamed("id", "_up"), "_up").drop("_up")


_TOP_SQL = "part int, kind int, turn int, block long, keys binary, counts binary, id long, fixed double, rest double"


def _turns(lists: DataFrame, turn: int) -> DataFrame:
    return lists.select("part", "kind", F.lit(turn).alias("turn"), "block", "keys", "counts")


def _model(depth: int):
    """Per part, contributions first, then the merged list: its grams with their log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tops = None, []
        for batch in batches:
            part, turn = batch.column("part").to_numpy(), batch.column("turn").to_numpy()
            change = np.flatnonzero((part[1:] != part[:-1]) | (turn[1:] != turn[:-1])) + 1
            for start, stop in zip([0, *change], [*change, len(part)], strict=True):
                if start == stop:
                    continue
                if part[start] != at:
                    at, tops = part[start], []
                own = batch.slice(start, stop - start)
                if turn[start] == 0:
                    tops.append([own.column(c).to_numpy() for c in ("id", "fixed", "rest")])
                    continue
                ids, fixed, rest = (np.concatenate(x) for x in zip(*tops, strict=True))
                order = np.argsort(ids)
                top = {"ids": ids[order].astype(np.uint64), "fixed": fixed[order], "rest": rest[order]}
                for row in own.select(["part", "kind", "keys", "counts"]).to_pylist():
                    logs = gram_logs(unpack(row["keys"], np.uint64), unpack(row["counts"], np.int64), depth, top)
                    yield pa.RecordBatch.from_pylist([row | {"block": -1, "counts": pack(logs)}], _LIST)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per kind and part, its model first, then the lists of blocks: the values of their keys."""
    keys, values = np.zeros(0, np.uint64), np.zeros(0)
    for batch in batches:
        for row in _rows(batch):
            if row["turn"] == 0:
                keys = unpack(row["keys"], np.uint64)
                values = unpack(row["counts"], np.float64 if row["kind"] == GRAM else np.int64)
            else:
                found = values[np.searchsorted(keys, unpack(row["keys"], np.uint64))]
                out = {"part": row["part"], "kind": row["kind"], "block": row["block"], "keys": None, "counts": pack(found)}
                yield pa.RecordBatch.from_pylist([out], _LIST)


def _add_up_texts(depth: int, parts: int, tokens: int, vocabulary: int, names: list[str], id_type: pa.DataType):
    """Per block, the answers first, then the block: a row per text."""

    def values_of(kind: int, keys: np.ndarray, answers: dict) -> np.ndarray:
        part = part_of(kind, keys, depth, parts)
        order = np.argsort(part, kind="stable")
        out = np.empty(len(keys))
        out[order] = np.concatenate([answers[kind, p] for p in np.unique(part)])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict = {}
        for batch in batches:
            for row in _rows(batch):
                if row["turn"] == 0:
                    answers[row["kind"], row["part"]] = unpack(row["counts"], np.float64 if row["kind"] == GRAM else np.int64)
                    continue
                data, sizes, held = _block(row)
                known = {kind: distinct(data, sizes, kind, depth)[0] for kind in (WORD, GRAM)}
                values = {kind: values_of(kind, keys, answers) for kind, keys in known.items()}
                answers = {}
                ends = np.cumsum(sizes)
                columns: list[list[np.ndarray]] = [[], [], [], []]
                for first, last in chunks(sizes):
                    part, own = data[ends[first] - sizes[first] : ends[last - 1]], sizes[first:last]
                    starts = np.cumsum(own) - own
                    found, place = np.unique(grams(part, own, depth), return_inverse=True)
                    score = np.add.reduceat(values[GRAM][np.searchsorted(known[GRAM], found)][place], starts)
                    hashes, owner = words(part, own)
                    count = values[WORD][np.searchsorted(known[WORD], hashes)]
                    base = np.log10((count + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                    n = len(own)
                    for column, x in zip(
                        columns,
                        (np.bincount(owner, minlength=n), np.bincount(owner, count > 0, n).astype(np.int64), np.bincount(owner, base, n), score),
                        strict=True,
                    ):
                        column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], id_type), pa.array(row["held"], pa.bool_()),
                        *(pa.array(np.concatenate(c)) for c in columns), pa.array(sizes),
                    ],
                    names,
                )

    return run


def context_tree_scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` of every row.

    Learns from the rows where ``held_out`` is false. ``score`` is the model's log10 probability of the text,
    ``base_score`` that of its words and end with add-half counts of training words.
    """
    rows = docs.select(F.col(id_col), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col))
    id_sql = rows.schema[0].dataType.simpleString()
    id_type = pa.int64() if id_sql == "bigint" else pa.int32() if id_sql == "int" else pa.string()
    packed = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
    blocks = cut(
        rows.mapInArrow(
            _pack_blocks(id_col, block_bytes, packed), f"block long, ids array<{id_sql}>, held array<boolean>, sizes array<bigint>, data binary"
        )
    )
    parts = min(MOST_PARTS, max(8, 2 * blocks.count()))
    lists = cut(blocks.mapInArrow(_list_keys(depth, parts), _LIST_SQL))

    def together(frame: DataFrame, *order: str) -> DataFrame:
        return frame.repartition(order[0] if order[0] == "block" else "part").sortWithinPartitions(*order)

    merged = cut(together(lists, "kind", "part").mapInArrow(_merge_lists, _LIST_SQL))
    gram_lists, word_lists = merged.where(F.col("kind") == GRAM), merged.where(F.col("kind") == WORD)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [unpack(c, np.int64) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], ["n", "v"]
            )

    tokens, vocabulary = word_lists.mapInArrow(total, "n long, v long").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))
    ).first()
    nodes = cut(gram_lists.mapInArrow(_top_nodes(depth), _NODE_SQL))
    above = _contributions(nodes).select(
        "part", F.lit(GRAM).alias("kind"), F.lit(0).alias("turn"), F.lit(-1).cast("long").alias("block"), "id", "fixed", "rest"
    )
    both = above.unionByName(_turns(gram_lists, 1), allowMissingColumns=True)
    model = cut(together(both, "part", "turn").mapInArrow(_model(depth), _LIST_SQL))
    asked = _turns(model.unionByName(word_lists), 0).unionByName(_turns(lists, 1))
    answers = together(asked, "kind", "part", "turn").mapInArrow(_answer, _LIST_SQL)
    met = answers.select("block", F.lit(0).alias("turn"), "kind", "part", "counts").unionByName(
        blocks.withColumn("turn", F.lit(1)), allowMissingColumns=True
    )
    names = ["_id", "held_out", "n_tokens", "n_known", "base_score", "score", "_bytes"]
    scored = together(met, "block", "turn").mapInArrow(
        _add_up_texts(depth, parts, tokens, vocabulary, names, id_type),
        f"_id {id_sql}, held_out boolean, n_tokens long, n_known long, base_score double, score double, _bytes long",
    )
    return scored.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / math.log10(2) / F.col("_bytes")).alias("bits_per_byte"),
    )
