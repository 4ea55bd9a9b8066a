"""Words of Arrow batches as numbers: distinct words, their code points and hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from socialspark.llm.hashing import mix

_FACTORS = np.random.Generator(np.random.PCG64(20250117)).integers(0, 1 << 62, 64, np.uint64) * np.uint64(4) + np.uint64(1)
#: Words whose spans are hashed at once.
AT_ONCE = 1 << 16
#: Rows of a batch whose words are held as numbers at once.
ROWS = 1024


def distinct_words(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a column of lists, the place of every word among them, and where the words of each row start."""
    found = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False), starts


def split_words(spaced: pa.Array) -> pa.Array:
    """Lists of the words that single spaces part."""
    return pc.split_pattern(spaced, " ")


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``ROWS`` rows."""
    for first in range(0, batch.num_rows, ROWS):
        yield batch.slice(first, ROWS)


class Letters:
    """The code points of words in a row, each word between two marks if asked."""

    def __init__(self, words: list[str], marks: tuple[str, str] = ("", "")) -> None:
        before, after = marks
        joined = "".join(f"{before}{w}{after}" for w in words) if before or after else "".join(words)
        extra = len(before) + len(after)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + extra
        self.starts = np.cumsum(self.sizes) - self.sizes
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.points = mix(points + np.uint64(1))

    def spans(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all spans of ``k`` letters inside a word, and the word of each."""
        words = np.repeat(np.arange(len(self.sizes)), np.maximum(self.sizes - k + 1, 0))
        counts = np.maximum(self.sizes - k + 1, 0)
        at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts) + self.starts[words]
        return self._hash(at, k), words

    def firsts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``k`` letters of the words that have as many, and these words."""
        words = np.flatnonzero(self.sizes >= k)
        return self._hash(self.starts[words], k), words

    def _hash(self, at: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(at), k, np.uint64)
        for j in range(k):
            out += self.points[at + j] * _FACTORS[j]
        return mix(out)

    def wholes(self) -> np.ndarray:
        """Hashes of the words; each letter counts by its place, however many there are."""
        place = (np.arange(len(self.points)) - np.repeat(self.starts, self.sizes)).astype(np.uint64)
        each = mix(self.points ^ (place * _FACTORS[-1]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        return mix(sums[self.starts + self.sizes] - sums[self.starts] + self.sizes.astype(np.uint64))


def in_chunks(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The words in parts of ``AT_ONCE``, with the place of the first of each."""
    for first in range(0, len(words), AT_ONCE):
        yield first, words[first : first + AT_ONCE]


def places_in(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes among the sorted ``known`` ones, -1 for others."""
    if not len(known):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)
