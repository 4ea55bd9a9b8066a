"""Language identification: known words first, then shorter and shorter character n-grams.

``fit`` counts the words of labelled texts and the character n-grams (5 down
to 1, with marks at the ends of words, which alone are no n-gram) of those words. ``predict`` gives every known
word its log frequency in each language. An unseen word gets the mean log frequency of its known
n-grams of the greatest order that has any. The sums over the words
of the whole text, as probabilities, name the language. Both cut words by one expression; a
batch looks up its distinct words together, by 64-bit hashes of words and n-grams.

The model is bounded, so that it can be sent to every task: it is fitted on about
``docs_per_lang`` texts of each language, chosen by a hash of id and text, and keeps the
``words_per_lang`` and, of each order, ``grams_per_lang`` most frequent entries.

Defined results: a null text or one without a letter is ``und`` with score 0; letters
that no entry of the model covers give the smallest learned language with the probability of chance; without
labelled texts everything is ``und``. Ids may be null or repeat. Other columns of the input are
ignored, or carried in one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from socialspark.llm.common import spaced_words, words_of
from socialspark.llm.words import Letters, distinct_words, in_chunks, parts_of, places_in, split_words
from socialspark.session import use_small_batches

DOCS_PER_LANG = 4000
WORDS_PER_LANG = 30_000
GRAMS_PER_LANG = 10_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
MARKS = ("^", "$")
SMOOTH = 0.5


@dataclass
class LanguageModel:
    """Languages, and for each order (0: whole words) the sorted hashes of its entries and their log frequencies."""

    languages: list[str]
    hashes: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word by language."""
        out = np.zeros((len(words), len(self.languages)))
        for first, part in in_chunks(words):
            place = places_in(self.hashes[0], Letters(part).wholes())
            known = place >= 0
            out[first : first + len(part)][known] = self.logs[0][place[known]]
            left = np.flatnonzero(~known)
            for k in ORDERS:
                if not len(left):
                    break
                spans, of = Letters([part[i] for i in left], MARKS).spans(k)
                place = places_in(self.hashes[k], spans)
                hit = place >= 0
                counts = np.bincount(of[hit], minlength=len(left))
                found = counts > 0
                for lang in range(len(self.languages)):
                    sums = np.bincount(of[hit], self.logs[k][place[hit], lang], len(left))
                    out[first + left[found], lang] = sums[found] / counts[found]
                left = left[~found]
        return out


def sample_of(docs: DataFrame, lang: str, key: list[str], per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language, by a hash of ``key``: the same on every run."""
    counts = docs.groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    share = counts.select(lang, (F.lit(float(per_lang)) / F.col("n")).alias("_share"))
    draw = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.join(F.broadcast(share), lang).where(draw < F.col("_share")).drop("_share")


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    docs_per_lang: int = DOCS_PER_LANG,
    words_per_lang: int = WORDS_PER_LANG,
    grams_per_lang: int = GRAMS_PER_LANG,
) -> LanguageModel:
    """Count on Spark; what comes to the driver is bounded by the parameters and the number of languages."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    words = (
        sample_of(rows, "lang", ["id", "text"], docs_per_lang)
        .select("lang", F.explode(words_of(F.col("text"))).alias("entry"))
        .groupBy("lang", "entry")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    marked = F.concat(F.lit(MARKS[0]), "entry", F.lit(MARKS[1]))

    def spans_of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (k - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.struct(F.lit(k).alias("k"), F.substring(marked, at, F.lit(k)).alias("entry")))

    spans = [spans_of(k) for k in ORDERS]
    grams = (
        words.select("lang", "n", F.inline(F.concat(*spans)))
        .where((F.length("entry") == F.col("k")) & ~F.col("entry").isin(*MARKS))
        .groupBy("lang", "k", "entry")
        .agg(F.sum("n").alias("n"))
    )
    both = words.select("lang", F.lit(0).alias("k"), "entry", "n").unionByName(grams)
    order = Window.partitionBy("lang", "k").orderBy(F.desc("n"), "entry")
    limit = F.when(F.col("k") == 0, words_per_lang).otherwise(grams_per_lang)
    kept = (
        both.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(words_per_lang, grams_per_lang))
        .where(F.col("rank") <= limit)
        .drop("rank")
        .toArrow()
    )
    langs = sorted(x for x in kept["lang"].unique().to_pylist())
    at = {lang: i for i, lang in enumerate(langs)}
    order_of, lang_of = kept["k"].to_numpy(), np.array([at[x] for x in kept["lang"].to_pylist()], np.int64)
    hashes, logs = {}, {}
    for k in (0, *ORDERS):
        own = np.flatnonzero(order_of == k)
        letters = Letters(kept["entry"].take(own).to_pylist())
        found = letters.wholes() if k == 0 else letters.spans(k)[0]
        hashes[k], place = np.unique(found, return_inverse=True)
        counts = np.zeros((len(hashes[k]), len(langs)))
        np.add.at(counts, (place, lang_of[own]), kept["n"].to_numpy()[own])
        logs[k] = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * max(len(counts), 1)))
    return LanguageModel(langs, hashes, logs)


def predict(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] | None = ("doc_id",)
) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` of every row, whole texts.

    With ``keep=None`` all columns of the row are in the struct ``row`` instead.
    """
    plain = {"languages": model.languages, "hashes": model.hashes, "logs": model.logs}
    sent = use_small_batches(docs.sparkSession).sparkContext.broadcast(plain)  # bounded, see fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(**sent.value)
        for batch in (part for whole in batches for part in parts_of(whole)):
            words, places, starts = distinct_words(split_words(batch.column(1)))
            lettered = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            langs, scores = _best(model, model.rows(words), places, starts, lettered)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    text = F.col(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row")
    rows = docs.select(row, spaced_words(text).alias("words"), text.rlike("\\p{L}").alias("lettered"))
    names = ["row", "lang_pred", "score"]
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = rows.mapInArrow(run, schema)
    return found if keep is None else found.select(*[F.col(f"row.`{c}`") for c in keep], "lang_pred", "score")


def _best(
    model: LanguageModel, rows: np.ndarray, places: np.ndarray, starts: np.ndarray, lettered: np.ndarray
) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, whose words lie between two ``starts``, and its probability."""
    n = len(lettered)
    langs, scores = [UNKNOWN] * n, np.zeros(n)
    known = np.flatnonzero(lettered & (np.diff(starts) > 0)) if model.languages else np.zeros(0, np.int64)
    if len(known):
        sums = np.stack([_sums(rows[:, lang][places], starts)[known] for lang in range(rows.shape[1])], axis=1)
        sums = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = sums.argmax(axis=1)
        scores[known] = sums[np.arange(len(known)), best] / sums.sum(axis=1)
        for i, b in zip(known.tolist(), best.tolist(), strict=True):
            langs[i] = model.languages[b]
    return langs, scores


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums between the starts, each by itself, so that a text's sum does not depend on its neighbours."""
    out = np.zeros(len(starts) - 1)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out
