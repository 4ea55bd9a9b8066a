"""Byte-level BPE: texts to token ids by a file of ranks, and ids back to bytes.

A text is cut by the pattern of its vocabulary, and every match is encoded by itself: one that
is a token as a whole is that token, any other starts as its bytes and joins the pair
of neighbours with the least rank, the leftmost first, until no pair is a token.

The least pair comes from a **segment tree over byte positions**: leaf ``i`` holds the rank of the pair that
starts at the live position ``i``, above the position itself, so the root is the leftmost least
pair. A merge changes three leaves (the pair itself, the one before it and the one
swallowed) and the nodes above them. Short matches go through the same tree many at a time,
a row of a matrix each; longer ones than ``TOGETHER`` bytes one by one, in ``n log n`` steps.

Texts are whole and each is encoded by itself inside its task: nothing is shuffled. A task remembers the ids of
``REMEMBERED`` distinct words, and starts anew when they are full. The vocabulary is read on the driver and sent to every
task; its size is that of the file.

Defined results: a null or empty text has no ids; ids of rows may be null or repeat, every row counts by
itself; an empty table gives no rows; special tokens in a text are ordinary text; bytes that are no UTF-8 become U+FFFD.
Other columns are ignored. ``decode_ids`` gives null for null ids and raises for ids that the vocabulary lacks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from socialspark.llm.common import texts_of, worker_memory

TOGETHER = 64
REMEMBERED = 400_000
AT_ONCE = 512
#: Rank of a pair that is no token.
NONE = 1 << 30
_SHIFT = 32
_LAST = NONE << _SHIFT


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Ids of the matches of a vocabulary, by segment trees."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        halves = [
            (left << _SHIFT | right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        ]
        halves.sort()
        self._pairs = np.array([k for k, _ in halves] + [np.iinfo(np.int64).max], np.int64)
        self._joined = np.array([r for _, r in halves] + [NONE], np.int64)
        self._by_pair = dict(halves)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; ``NONE`` where they make no token."""
        keys = left << _SHIFT | right
        at = np.searchsorted(self._pairs, keys)
        return np.where(self._pairs[at] == keys, self._joined[at], NONE)

    def encode(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches in a row, and how many each has."""
        whole = [self.ranks.get(m, -1) for m in matches]
        first = np.array(whole, np.int64)
        sizes = np.ones(len(matches), np.int64)
        lengths = np.fromiter(map(len, matches), np.int64, len(matches))
        merged: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        split = np.flatnonzero(first < 0)
        for k in split[lengths[split] > TOGETHER]:
            ids = self.of_long(matches[k])
            merged.append((np.array([k]), ids, np.array([len(ids)])))
        for width in (4, 8, 16, 32, TOGETHER):
            some = split[(lengths[split] <= width) & (lengths[split] > (width // 2 if width > 4 else 0))]
            for at in range(0, len(some), 1 << 15):
                own = some[at : at + (1 << 15)]
                merged.append((own, *self.of_short([matches[k] for k in own], lengths[own], width)))
        for own, _, count in merged:
            sizes[own] = count
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        out[starts[first >= 0]] = first[first >= 0]
        for own, ids, count in merged:
            before = np.cumsum(count) - count
            out[np.repeat(starts[own] - before, count) + np.arange(len(ids))] = ids
        return out, sizes

    def of_short(self, matches: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Many matches of ``width`` (a power of two) bytes at most, a merge of each at a time."""
        n, wide = len(matches), width + 1
        data = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in matches), np.uint8).reshape(n, width)
        tokens = np.full((n, wide), -1, np.int64)
        tokens[:, :width] = np.where(np.arange(width) < lengths[:, None], self.of_byte[data], -1)
        after = np.tile(np.arange(1, wide + 1, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * width), _LAST, np.int64)
        leaves = self.joined(tokens[:, :-1], tokens[:, 1:]) << _SHIFT | np.arange(width)
        tree[:, width:] = np.where(np.arange(width) < lengths[:, None] - 1, leaves, _LAST)
        node = width
        while node > 1:
            np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2], out=tree[:, node // 2 : node])
            node //= 2
        flat_tokens, flat_after, flat_before, flat_tree = (x.reshape(-1) for x in (tokens, after, before, tree))
        live = np.arange(n)
        while True:
            root = tree[live, 1]
            live = live[root < _LAST]
            if not len(live):
                break
            root = root[root < _LAST]
            at, base, end = root & ((1 << _SHIFT) - 1), live * wide, lengths[live]
            swallowed = flat_after[base + at]
            follower = flat_after[base + swallowed]
            flat_tokens[base + at] = joined = root >> _SHIFT
            flat_tokens[base + swallowed] = -1
            flat_after[base + at] = follower
            ends = follower >= end
            flat_before[base + np.where(ends, width, follower)] = at
            leader = flat_before[base + at]
            own = np.where(ends, NONE, self.joined(joined, flat_tokens[base + np.minimum(follower, width)]))
            led = leader >= 0
            above = self.joined(flat_tokens[base[led] + leader[led]], joined[led])
            leaf = np.concatenate([at, swallowed, leader[led]])
            rows = np.concatenate([live, live, live[led]]) * (2 * width)
            value = np.concatenate([own, np.full(len(live), NONE), above])
            node = leaf + width
            flat_tree[rows + node] = np.where(value < NONE, value << _SHIFT | leaf, _LAST)
            while node[0] > 1:
                node >>= 1
                flat_tree[rows + node] = np.minimum(flat_tree[rows + 2 * node], flat_tree[rows + 2 * node + 1])
        return flat_tokens[flat_tokens >= 0], (tokens >= 0).sum(axis=1)

    def of_long(self, match: bytes) -> np.ndarray:
        """One match of any length."""
        n, get = len(match), self._by_pair.get
        width = 1 << (n - 1).bit_length()
        start = self.of_byte[np.frombuffer(match, np.uint8)]
        leaves = np.full(2 * width, _LAST, np.int64)
        found = self.joined(start[:-1], start[1:])
        leaves[width : width + n - 1] = np.where(found < NONE, found << _SHIFT | np.arange(n - 1), _LAST)
        node = width
        while node > 1:
            np.minimum(leaves[node : 2 * node : 2], leaves[node + 1 : 2 * node : 2], out=leaves[node // 2 : node])
            node //= 2
        tokens, tree = start.tolist(), leaves.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(leaf: int, rank: int) -> None:
            node = leaf + width
            tree[node] = rank << _SHIFT | leaf if rank < NONE else _LAST
            while node > 1:
                least = min(tree[node], tree[node ^ 1])
                node >>= 1
                if tree[node] == least:
                    break
                tree[node] = least

        while (root := tree[1]) < _LAST:
            at, joined = root & ((1 << _SHIFT) - 1), root >> _SHIFT
            swallowed = after[at]
            follower = after[at] = after[swallowed]
            tokens[at], tokens[swallowed] = joined, -1
            update(swallowed, NONE)
            if follower < n:
                before[follower] = at
                update(at, get(joined << _SHIFT | tokens[follower], NONE))
            else:
                update(at, NONE)
            if (leader := before[at]) >= 0:
                update(leader, get(tokens[leader] << _SHIFT | joined, NONE))
        return np.array([t for t in tokens if t >= 0], np.int64)


class Encoder:
    """Ids of whole texts, encoding each distinct word once.

    A word here is what stands between two blanks or line feeds, with the one before
    it. A match of the pattern never reaches over such a place if there is no other white
    space beside it, so words are matched and remembered by themselves. Words with more white space at an
    edge are put together with their neighbours first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self._matches = regex.compile(pattern).findall
        self._merges = Merges(ranks)
        count = max(ranks.values()) + 1
        tokens = [b""] * count
        for token, rank in ranks.items():
            tokens[rank] = token
        self._known = np.zeros(count, bool)
        self._known[list(ranks.values())] = True
        self._spelt = np.frombuffer(b"".join(tokens), np.uint8)
        self._length = np.fromiter(map(len, tokens), np.int64, count)
        self._first = np.cumsum(self._length) - self._length
        self._clear()

    def _clear(self) -> None:
        self._code: dict[str, int] = {}
        self._odd: dict[str, int] = {}
        self._used = self._held = 0
        self._start = np.zeros(1 << 16, np.int64)
        self._size = np.zeros(1 << 16, np.int64)
        self._edge = np.zeros(1 << 16, np.int8)
        self._ids = np.zeros(1 << 18, np.uint32)

    def _learn(self, strings: list[str], edges: list[int]) -> range:
        """Places of new strings, each matched by itself; ``edges``: 1 if white space begins it, 2 if some ends it."""
        place: dict[str, int] = {}
        found: list[list[int]] = []
        for s in strings:
            core = s[1:]
            parts = (s,) if core.isascii() and core.isalpha() and s[0] == " " else self._matches(s)
            found.append([place.setdefault(p, len(place)) for p in parts])
        flat, sizes = self._merges.encode([p.encode() for p in place])
        parts = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        each = np.fromiter(map(len, found), np.int64, len(found))
        ids = flat[_spans(np.cumsum(sizes)[parts] - sizes[parts], sizes[parts])]
        totals = np.concatenate([[0], np.cumsum(sizes[parts])])
        stops = np.cumsum(each)
        own = totals[stops] - totals[stops - each]
        at, last = self._used, self._used + len(strings)
        if last > len(self._start):
            self._start, self._size, self._edge = (np.resize(x, 2 * last) for x in (self._start, self._size, self._edge))
        if self._held + len(ids) > len(self._ids):
            self._ids = np.resize(self._ids, 2 * (self._held + len(ids)))
        self._start[at:last] = self._held + np.cumsum(own) - own
        self._size[at:last] = own
        self._edge[at:last] = edges
        self._ids[self._held : self._held + len(ids)] = ids
        self._used, self._held = last, self._held + len(ids)
        return range(at, last)

    def _places(self, words: list[str]) -> np.ndarray:
        distinct = set(words)
        new = distinct - self._code.keys()
        if self._used + len(new) > REMEMBERED:
            self._clear()
            new = distinct
        if new:
            order = list(new)
            cores = [w[1:] if w[:1] == "\n" else w for w in order]
            edges = [(c[0].isspace() | c[-1].isspace() << 1) if c else 3 for c in cores]
            placed = self._learn([w if w[:1] == "\n" else f" {w}" for w in order], edges)
            self._code.update(zip(order, placed, strict=True))
        return np.fromiter(map(self._code.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for first in range(0, len(texts), AT_ONCE):
            split = [f"\n{t or ''}".replace("\n", " \n").split(" ")[1:] for t in texts[first : first + AT_ONCE]]
            words = list(chain.from_iterable(split))
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            heads = np.zeros(len(words), bool)
            heads[np.cumsum(sizes) - sizes] = True  # the line feed before a text is none of its own
            places = self._places(words)
            edge = self._edge[places]
            joins = (edge & 1).astype(bool)
            joins[1:] |= (edge[:-1] & 2).astype(bool)
            joins &= ~heads
            runs = np.flatnonzero(~joins)
            ends = np.append(runs[1:], len(words))
            odd = np.flatnonzero((ends - runs > 1) | heads[runs] & (edge[runs] & 1).astype(bool))
            chosen, cut = places[runs], heads[runs].copy()
            if len(odd):
                chosen[odd] = self._joined(words, runs[odd], ends[odd], heads[runs[odd]])
                cut[odd] = False
            starts, counts = self._start[chosen] + cut, self._size[chosen] - cut
            ids = self._ids[_spans(starts, counts)]
            totals = np.concatenate([[0], np.cumsum(counts)])
            of_text = totals[np.append(np.flatnonzero(heads[runs]), len(runs))]
            for a, b in zip(of_text[:-1], of_text[1:], strict=True):
                yield ids[a:b]

    def _joined(self, words: list[str], starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> list[int]:
        """Places of runs of words that are matched together."""
        whole = []
        for a, b, head in zip(starts.tolist(), ends.tolist(), heads.tolist(), strict=True):
            s = "".join(w if w[:1] == "\n" else f" {w}" for w in words[a:b])
            whole.append(s[1:] if head else s)
        new = list(set(whole) - self._odd.keys())
        if new:
            self._odd.update(zip(new, self._learn(new, [0] * len(new)), strict=True))
        return [self._odd[s] for s in whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids spell."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self._known) or not self._known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        parts = [ids[k : k + (1 << 20)] for k in range(0, len(ids), 1 << 20)]
        return b"".join(self._spelt[_spans(self._first[p], self._length[p])].tobytes() for p in parts)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, in a row."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


def _encoder(sent, pattern: str) -> Encoder:
    """One for each Python worker, so that its later tasks know the words of the earlier ones."""
    memory = worker_memory()
    key = ("byte_bpe", sent.value["digest"], pattern)
    if key not in memory:
        memory[key] = Encoder(sent.value["ranks"], pattern)
    return memory[key]


def _send(df: DataFrame, path: str):
    ranks = read_ranks(path)
    digest = hashlib.sha256(b"".join(b"%d %s\n" % (r, t) for t, r in ranks.items())).hexdigest()
    return df.sparkSession.sparkContext.broadcast({"ranks": ranks, "digest": digest})  # as large as the file


def encode_texts(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    digests: bool = False,
) -> DataFrame:
    """``(id, n_tokens)`` of every row, its ``ids``, and with ``digests`` the SHA-256 of ids and of their decoded bytes."""
    sent = _send(docs, path)
    rows = docs.select(id_col, text_col)
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long" + ", ids array<int>" * with_ids
    schema += ", ids_sha256 string, decoded_sha256 string" * digests
    names = [id_col, "n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * digests]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                found = list(encoder.encode(texts_of(part.column(1))))
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                columns = [part.column(0), pa.array(sizes)]
                if with_ids:
                    flat = np.concatenate(found).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(flat)))
                if digests:
                    columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]))
                    columns.append(pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in found]))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)``: what the ids of every row spell, as binary; null for null ids."""
    sent = _send(encoded, path)
    rows = encoded.select(id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent, pattern)
        for batch in batches:
            lists = batch.column(1)
            spelt = [encoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelt, pa.binary())], [id_col, "bytes"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, bytes binary")
