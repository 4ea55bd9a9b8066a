"""Batch text embedding. The encoder is supplied by the caller."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.constants import CLEAN_TEXT, EMBEDDING_DIMENSIONS, EMBEDDING_PROMPT, POST_ID
from socialspark.functions.text import words

Encoder = Callable[[Sequence[str]], np.ndarray]
#: Words, and numbers of their vectors, that are counted at once.
WORDS_AT_ONCE = 1 << 17
NUMBERS_AT_ONCE = 1 << 18


def _runs(ends: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows, ``rows`` at most, with ``WORDS_AT_ONCE`` words at most or a row alone; ``ends`` counts words."""
    first = 0
    while first < len(ends) - 1:
        fits = int(np.searchsorted(ends, ends[first] + WORDS_AT_ONCE, side="right")) - 1
        last = min(max(fits, first + 1), first + rows, len(ends) - 1)
        yield first, last
        first = last


def hashed_embeddings(
    posts: DataFrame, key: str, text_col: str, prompt: str, dimensions: int, normalize: bool, keep: Sequence[str]
) -> DataFrame:
    """Counts of hashed words. A stand-in where no model is at hand.

    Words are cut in DataFrame functions. They are hashed, once for each different word of an Arrow batch, and
    counted where they are, a bounded number at a time; nothing is exploded or shuffled.
    """
    columns = [key, *keep]
    cut = posts.where(F.col(text_col).isNotNull()).select(
        *columns, words(F.concat(F.lit(prompt), F.col(text_col))).alias("_words")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(len(columns))
            coded = listed.flatten().dictionary_encode()
            digests = (hashlib.md5(word.encode()).digest() for word in coded.dictionary.to_pylist())
            places = np.array([int.from_bytes(d[:4], "big") % dimensions for d in digests], dtype=np.int64)
            codes = coded.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
            for first, last in _runs(ends, max(1, NUMBERS_AT_ONCE // dimensions)):
                n = last - first
                rows = np.repeat(np.arange(n), np.diff(ends[first : last + 1]))
                at = rows * dimensions + places[codes[ends[first] : ends[last]]]
                matrix = np.bincount(at, minlength=n * dimensions).reshape(n, dimensions)
                if normalize:
                    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                    matrix = matrix / np.where(norms > 0, norms, 1.0)
                vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dimensions, pa.array(matrix.astype(np.float32).ravel()))
                own = [column.slice(first, n) for column in batch.columns[: len(columns)]]
                arrays = [*own, vectors, pa.array(np.ones(n, dtype=bool))]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "embedding", "embed_ok"])

    return cut.mapInArrow(count, _vector_schema(cut.select(*columns)))


def _vector_schema(keyed: DataFrame) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema]
    return ", ".join([*fields, "embedding array<float>", "embed_ok boolean"])


def embed_texts(
    posts: DataFrame,
    make_encoder: Callable[[int], Encoder] | None = None,
    key: str = POST_ID,
    text_col: str = CLEAN_TEXT,
    prompt: str = EMBEDDING_PROMPT,
    batch_size: int = 512,
    dimensions: int = EMBEDDING_DIMENSIONS,
    normalize: bool = True,
    on_error: str = "nan",
    keep: Sequence[str] = (),
    profile: ResourceProfile | None = None,
    by_length: bool = False,
) -> DataFrame:
    """``(key, *keep, embedding array<float>, embed_ok)``.

    Without ``make_encoder`` the vectors are counts of hashed words, see
    ``hashed_embeddings``. ``make_encoder(dimensions)`` runs once per Python worker and may load a
    model; its result maps a list of texts to a matrix. Texts arrive as Arrow
    batches and are encoded ``batch_size`` at a time. With ``on_error="nan"``
    a failing batch becomes NaN vectors flagged ``embed_ok = false`` and the
    run goes on; with ``"raise"`` it fails the task.

    With ``profile`` the encoding stage asks for these resources, such as a GPU a task, and no other stage
    does. With ``by_length`` the texts of an Arrow batch are encoded shortest first, so
    that the texts of a chunk are about equally long and an encoder that pads wastes little.
    """
    if on_error not in ("nan", "raise"):
        raise ValueError(f"unknown on_error {on_error!r}")
    if make_encoder is None:
        return hashed_embeddings(posts, key, text_col, prompt, dimensions, normalize, keep)
    columns = [key, *keep]

    def encode_chunk(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, bool]:
        try:
            matrix = np.asarray(encoder([prompt + t for t in texts]), dtype=np.float64)
            if matrix.shape != (len(texts), dimensions):
                raise ValueError(f"encoder returned shape {matrix.shape}")
        except Exception:
            if on_error == "raise":
                raise
            return np.full((len(texts), dimensions), np.nan, dtype=np.float32), False
        if normalize:
            norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
        return matrix.astype(np.float32), True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder(dimensions)
        for frame in frames:
            if by_length:
                frame = frame.sort_values(text_col, key=lambda texts: texts.str.len(), kind="stable")
            for start in range(0, len(frame), batch_size):
                chunk = frame.iloc[start : start + batch_size]
                vectors, ok = encode_chunk(encoder, chunk[text_col].tolist())
                yield chunk[columns].assign(embedding=list(vectors), embed_ok=ok)

    texts = posts.select(*columns, text_col).where(F.col(text_col).isNotNull())
    return texts.mapInPandas(run, _vector_schema(texts.select(*columns)), profile=profile)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors that may be compared: encoded, not null, every component a finite number."""
    kept = vectors.where(F.col("embed_ok")) if "embed_ok" in vectors.columns else vectors
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(F.col(column).isNotNull() & F.coalesce(fine, F.lit(False)))
