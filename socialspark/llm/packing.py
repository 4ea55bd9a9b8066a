"""Packing of tokenized documents into training sequences, balanced by attention cost.

``pack_documents`` cuts each document into pieces and lays them into sequences
of at most ``capacity`` tokens. A piece of ``n`` tokens costs ``n + n * n / (6 * width)``:
the dense layers of a model of that width are linear in it, attention within
the piece is quadratic. Pieces are placed by descending cost into the cheapest
sequence that has room; one that fits nowhere whole is cut at the room of the
cheapest sequence.

Sequences are filled in windows of about ``window_tokens`` tokens inside each input
partition, so nothing is shuffled and a task holds one window of ids at most (or
one document, if that is longer). The capacities of a window add up to
exactly its tokens: full sequences, and powers of two for the rest. Sequences of
such lengths need no padding.

Defined results: a null or empty text is the end token alone; ids may be null or
repeat, every row is packed by itself; an empty table gives no rows. Other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from socialspark.llm.common import texts_of, worker_memory

CAPACITY = 4096
WINDOW_TOKENS = 4_000_000
WIDTH = 1024
END_ID = 2
#: Units whose ids a worker remembers; a full memory is emptied.
REMEMBERED = 300_000

#: Punctuation that stays one piece, whatever letters stand before it.
TAIL = ".,;:!?"
#: Plain words or pieces encoded together.
LINE = 400

#: How a tokenizer's file says that it lowers texts and cuts them at white space, around digits and between letters and others.
CUTS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
GAP, LETTER, DIGIT, OTHER, ODD = range(5)
#: What the byte-level alphabet writes for bytes that are no visible character of Latin-1.
_SPELT = dict(zip([*range(0x21), *range(0x7F, 0xA1), 0xAD], range(256, 324), strict=True))


def byte_kinds(odd: str | None) -> np.ndarray:
    """The kind of each byte; those of the characters ``odd`` are odd, if None all but gaps.

    The two bytes of a letter from U+00C0 to U+00FF are letters if the second follows the first, see ``units_of``.
    """
    kinds = np.full(256, ODD, np.uint8)
    if odd is not None:
        kinds[0x21:0x7F] = OTHER
        for first, last, kind in (("0", "9", DIGIT), ("A", "Z", LETTER), ("a", "z", LETTER)):
            kinds[ord(first) : ord(last) + 1] = kind
        kinds[0xC3] = LETTER
        kinds[[ord(c) for c in odd if c.isascii()]] = ODD
    kinds[[0x20, 0x0A]] = GAP
    return kinds


def units_of(texts: list[str | None], kinds: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The units of all texts in a row, and how many there are up to the end of each text.

    Words, cut at spaces and line feeds, are units as they are if they have an odd byte. Others are lowered and cut
    into runs of letters, single digits and runs of others.
    """
    whole = pa.array(["" if t is None else t for t in texts], pa.large_string())
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[: bounds[-1]]
    kind = kinds[data]
    lowered = data.copy()
    lowered[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if kinds[0xC3] == LETTER:
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        value = data[second]
        kind[second[(value != 0x97) & (value != 0xB7)]] = LETTER
        lowered[second[value < 0x9F]] += 0x20
    solid = kind != GAP
    begins = np.zeros(len(data) + 1, bool)  # where a text begins
    begins[bounds] = True
    begins = begins[:-1]

    def starts_of(run: np.ndarray) -> np.ndarray:
        """Where a text begins or the kind differs from the one before, gaps aside."""
        starts = begins.copy()
        starts[1:] |= run[1:] != run[:-1]
        return starts & solid

    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        first = np.flatnonzero(starts_of(solid))
        stops = np.zeros(len(data) + 1, bool)
        stops[1:] = solid
        stops[1:-1] &= begins[1:] | ~solid[1:]
        last = np.flatnonzero(stops)
        word = np.unique(np.searchsorted(first, odd, side="right") - 1)
        turns = np.zeros(len(data) + 1, np.int8)
        turns[first[word]] += 1
        turns[last[word]] -= 1
        inside = np.cumsum(turns[:-1], dtype=np.int8).astype(bool)
        kind[inside] = ODD
        lowered[inside] = data[inside]
    starts = starts_of(kind)
    digits = np.flatnonzero(kind == DIGIT)
    starts[digits] = True
    offsets = np.append(np.flatnonzero(starts[solid]), np.count_nonzero(solid)).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(lowered[solid]))
    return units, np.searchsorted(np.flatnonzero(starts), bounds[1:])


def plain_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are letters and a tail of plain punctuation, as the tokenizer composes and lowers them.

    Also how many pieces each is before the merges, and how many bytes the tokenizer makes of it.
    """
    n = len(words)
    cores = [w.rstrip(TAIL) for w in words]
    plain = np.fromiter(map(str.isalpha, cores), bool, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    pieces = 1 + (sizes > np.fromiter(map(len, cores), np.int64, n))
    for i in np.flatnonzero(~np.fromiter(map(str.isascii, words), bool, n)).tolist():
        core = normalize("NFC", cores[i])
        plain[i] = core.isalpha() and core.lower().isalpha()
        sizes[i] = len(normalize("NFC", words[i]).lower().encode("utf-8", "surrogatepass"))
    return plain, pieces, sizes


class _Codes(dict):
    """Numbers of units; a new unit gets the next one and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordTokenizer:
    """Ids of whole texts, tokenizing each distinct unit once.

    Right for tokenizers that never join characters across a space, as those that
    split at white space before the merges and drop it. Texts are cut at spaces
    and line feeds only; whatever else counts as white space is the tokenizer's to
    decide. If its file says ``CUTS``, words of the commonest characters are cut into the pieces that it
    makes of them, lowered, and these need its merges only; words with an apostrophe or the
    first character of an added token stay whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._ends = None
        if suffix:
            vocabulary = self._tokenizer.get_vocab()
            self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self._ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self._bytes = np.zeros(len(self._ends), np.int64)
            for token, i in vocabulary.items():
                self._bytes[i] = len(token.removesuffix(suffix))  # a character stands for a byte
        said = json.loads(self._tokenizer.to_str())
        added = said["added_tokens"]
        if suffix and all(said[k] == v for k, v in CUTS.items()) and all(x["content"][0].isascii() and not x["normalized"] for x in added):
            self._merges = Tokenizer(self._tokenizer.model)
            self._merges.pre_tokenizer = WhitespaceSplit()
            odd = "'" + "".join(x["content"][0] for x in added)
            self._plain = re.compile(f"(?:(?![{re.escape(odd)}])[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff])*").fullmatch
        else:
            self._merges = odd = None
        self._kinds = byte_kinds(odd)
        self._clear()

    def _clear(self) -> None:
        self._code = _Codes()
        self._start = np.zeros(1 << 16, np.int64)
        self._size = np.zeros(1 << 16, np.int64)
        self._ids = np.zeros(1 << 18, np.uint32)
        self._known = self._held = 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where those of each word start and how many they are.

        Letters, or letters and a tail of plain punctuation, are one or two pieces before the
        merges, and each piece ends in a token that ends a word. Such words are encoded in
        lines and told apart by these tokens. Others are encoded one by one, as are the words
        of a line whose tokens do not fit them.
        """
        plain, pieces, spelt = plain_words(words)
        if self._ends is None:
            plain[:] = False
        own = np.flatnonzero(plain)
        lines = [own[k : k + LINE] for k in range(0, len(own), LINE)]
        other = np.flatnonzero(~plain).tolist()
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, held = [], 0
        encode = self._tokenizer.encode_batch_fast
        joined = [" ".join([words[i] for i in line.tolist()]) for line in lines]
        for line, got in zip(lines, encode(joined, add_special_tokens=False), strict=True):
            flat = np.array(got.ids, np.int64)
            told = self._told_apart(pieces[line], spelt[line], flat)
            if told is None:
                other += line.tolist()
                continue
            sizes[line] = told
            starts[line] = held + np.cumsum(told) - told
            parts.append(flat.astype(np.uint32))
            held += len(flat)
        found = [e.ids for e in encode([words[i] for i in other], add_special_tokens=False)]
        told = np.fromiter(map(len, found), np.int64, len(found))
        sizes[other], starts[other] = told, held + np.cumsum(told) - told
        parts.append(np.fromiter(chain.from_iterable(found), np.uint32, int(told.sum())))
        return np.concatenate(parts), starts, sizes

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_encode``, for pieces that need the merges only."""
        spelt = [p if p.isascii() else p.encode().decode("latin-1").translate(_SPELT) for p in pieces]
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        parts, held, other = [], 0, []
        lines = [slice(k, k + LINE) for k in range(0, len(pieces), LINE)]
        found = self._merges.encode_batch_fast([" ".join(spelt[line]) for line in lines], add_special_tokens=False)
        for line, got in zip(lines, found, strict=True):
            flat = np.array(got.ids, np.int64)
            told = self._told_apart(np.ones(len(lengths[line]), np.int64), lengths[line], flat)
            if told is None:
                other += range(len(pieces))[line]
                continue
            sizes[line] = told
            starts[line] = held + np.cumsum(told) - told
            parts.append(flat.astype(np.uint32))
            held += len(flat)
        if other:
            flat, at, told = self._encode([pieces[i] for i in other])
            sizes[other], starts[other] = told, held + at
            parts.append(flat)
        return np.concatenate(parts), starts, sizes

    def _told_apart(self, pieces: np.ndarray, spelt: np.ndarray, flat: np.ndarray) -> np.ndarray | None:
        """How many of the ids in ``flat`` each word of a line has; None unless they fit the words.

        They do if as many tokens end words as there are pieces, and the tokens of each word
        spell as many bytes as it has.
        """
        stops = np.flatnonzero(self._ends[flat]) + 1
        pieces = np.cumsum(pieces)
        if len(stops) != pieces[-1] or stops[-1] != len(flat):
            return None
        stops = stops[pieces - 1]
        bytes_so_far = np.cumsum(self._bytes[flat])[stops - 1]
        return np.diff(stops, prepend=0) if (bytes_so_far == np.cumsum(spelt)).all() else None

    def _learn(self, units: list[str]) -> None:
        """Notes the ids of new units, which have the next numbers."""
        plain = np.zeros(len(units), bool)
        if self._merges:
            plain[:] = [self._plain(u) is not None for u in units]
        own, whole = np.flatnonzero(plain), np.flatnonzero(~plain)
        at, last = self._known, self._known + len(units)
        if last > len(self._start):
            self._start, self._size = (np.resize(x, 2 * last) for x in (self._start, self._size))
        for which, encode in ((own, self._encode_pieces), (whole, self._encode)):
            if not len(which):
                continue
            flat, starts, sizes = encode([units[i] for i in which.tolist()])
            if self._held + len(flat) > len(self._ids):
                self._ids = np.resize(self._ids, 2 * (self._held + len(flat)))
            self._start[at + which] = self._held + starts
            self._size[at + which] = sizes
            self._ids[self._held : self._held + len(flat)] = flat
            self._held += len(flat)
        self._known = last

    def encode(self, texts: list[str | None], at_once: int = 512) -> Iterator[np.ndarray]:
        """The ids of each text, without special tokens."""
        for first in range(0, len(texts), at_once):
            if self._known > REMEMBERED:
                self._clear()
            units, ends = units_of(texts[first : first + at_once], self._kinds)
            units = units.dictionary_encode()
            distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
            codes = np.fromiter(map(self._code.__getitem__, distinct), np.int64, len(distinct))
            if self._code.new:
                self._learn(self._code.new)
                self._code.new = []
            codes = codes[units.indices.to_numpy()]
            sizes = self._size[codes]
            stops = np.append(0, np.cumsum(sizes))
            place = np.repeat(self._start[codes] - stops[:-1], sizes)
            place += np.arange(stops[-1])
            yield from np.split(self._ids[place], stops[ends[:-1]])


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its later tasks know the units of the earlier ones."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
    memory = worker_memory()
    if ("packing", path) not in memory:
        memory["packing", path] = WordTokenizer(path)
    return memory["packing", path]


def capacities(tokens: int, capacity: int) -> np.ndarray:
    """Full sequences, then the powers of two that add up to the rest."""
    full, rest = divmod(tokens, capacity)
    powers = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    return np.array([capacity] * full + powers, np.int64)


def cost(length, width: int):
    return length + length * length / (6.0 * width)


def pack_window(lengths: list[int], capacity: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of each piece; every sequence ends full."""
    pieces = []
    for doc, n in enumerate(lengths):
        pieces += [(doc, s, min(capacity, n - s)) for s in range(0, n, capacity)]
    room = capacities(sum(lengths), capacity)
    spent, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    out = []
    for doc, start, n in pieces:
        while n:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room)
            at = int(fits[np.argmin(spent[fits])])
            take = min(n, int(room[at]))
            out.append((doc, start, take, at, int(used[at])))
            spent[at] += cost(take, width)
            used[at] += take
            room[at] -= take
            start, n = start + take, n - take
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    window_tokens: int = WINDOW_TOKENS,
    width: int = WIDTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: document, place in it, place in its sequence, cost, and the ids.

    ``tokenizer`` is the path of a word tokenizer's file, the same on every
    machine. Sequence ids hold the partition in the upper bits, so a task that is
    run again gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        names: list = []
        ids: list[np.ndarray] = []
        held, first = 0, TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, held, first
            rows = pack_window([len(x) for x in ids], capacity, width)
            doc, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            parts = [ids[d][s : s + n] for d, s, n in zip(doc, start, length, strict=True)]
            columns = [
                pa.array([names[d] for d in doc], id_type),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                pa.array([len(ids[d]) for d in doc], pa.int64()),
                pa.array(seq + first),
                pa.array(offset),
                pa.array(cost(length.astype(float), width)),
            ]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            first += int(seq.max()) + 1
            names, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names_out)

        for batch in batches:
            id_type = batch.column(0).type
            for name, got in zip(batch.column(0).to_pylist(), words.encode(texts_of(batch.column(1))), strict=True):
                names.append(name)
                ids.append(np.append(got, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= window_tokens:
                    yield flush()
        if ids:
            yield flush()

    named = docs.select(id_col, text_col)
    id_kind = named.schema[0].dataType.simpleString()
    schema = (
        f"`{id_col}` {id_kind}, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long, cost double" + ", ids array<int>" * with_ids
    )
    names_out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
    names_out += ["ids"] * with_ids
    return named.mapInArrow(run, schema)
