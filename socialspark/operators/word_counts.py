"""Word frequencies: per month and platform, and per cluster.

Occurrences and document frequency come out of one aggregation. A text yields
its tokens and, marked, its distinct tokens, so that a document frequency is a
sum instead of a distinct count, which would need the document id in the
exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.constants import CLEAN_TEXT, CREATED_AT, MONTHS
from socialspark.functions.text import is_blank, letter_words, words
from socialspark.functions.timeutil import month_of, parse_ts
from socialspark.operators.ranking import top_per_key


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def explode_words(
    df: DataFrame, tokens: Column, stop_words: Sequence[str], keep: Sequence[str], count_rows: bool = False
) -> DataFrame:
    """``(*keep, word, is_doc)``: a row per occurrence (``is_doc`` 0) of a kept
    word and one more per distinct word of the text (``is_doc`` 1).

    With ``count_rows`` every input row also yields the empty word, so that a
    count of rows comes out of the same aggregation as the counts of words.
    """
    if count_rows:
        tokens = F.concat(F.array(F.lit("")), tokens)
    found = df.select(*keep, tokens.alias("_tokens"))
    both = F.array("_tokens", F.array_distinct("_tokens"))
    rows = found.select(*keep, F.posexplode(both).alias("is_doc", "_words")).select(
        *keep, "is_doc", F.explode("_words").alias("word")
    )
    # Stated here, since joins on the word add it to some branches of a plan only.
    rows = rows.where(F.col("word").isNotNull())
    return rows.where(~F.col("word").isin(list(stop_words))) if stop_words else rows


def monthly_word_freq(
    posts: DataFrame,
    by: Sequence[str] = (),
    text_col: str = CLEAN_TEXT,
    months: Sequence[str] = MONTHS,
    stop_words: Sequence[str] | None = None,
    min_df: int = 20,
) -> DataFrame:
    """``(*by, month, word, n, freq)`` for words in at least ``min_df`` posts.

    ``freq`` is relative to the month's total of kept words; a month without
    any has a null ``freq``. Counts of all months are columns of one
    aggregation by word, which yields the zero-filled calendar, the document
    frequency over the whole corpus and the counts with a single exchange.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    by = list(by)
    dated = posts.withColumn("month", month_of(parse_ts(F.col(CREATED_AT)))).where(
        F.col("month").isin(list(months))
    )
    rows = explode_words(dated, words(F.col(text_col)), stop_words, [*by, "month"])
    columns = [f"n_{i}" for i in range(len(months))]
    counted = (
        rows.groupBy(*by, "word")
        .agg(
            F.sum("is_doc").alias("df"),
            *[
                F.count(F.when((F.col("month") == m) & (F.col("is_doc") == 0), 1)).alias(c)
                for m, c in zip(months, columns)
            ],
        )
        .where(F.col("df") >= min_df)
    )
    # One row per group (platform), whatever the size of the vocabulary.
    totals = counted.groupBy(*by).agg(*[F.sum(c).alias(f"total_{c}") for c in columns])
    series = F.array(
        *[
            F.struct(
                F.lit(m).alias("month"),
                F.col(c).alias("n"),
                F.try_divide(F.col(c).cast("double"), F.col(f"total_{c}").cast("double")).alias("freq"),
            )
            for m, c in zip(months, columns)
        ]
    )
    if by:
        joined = counted.join(totals, by)
    else:
        whole = totals.select(F.struct(*totals.columns).alias("t")).scalar()
        joined = counted.withColumn("_t", whole).select("*", "_t.*")
    return joined.select(*by, "word", F.inline(series))


def top_words_overall(
    freq: DataFrame,
    platforms: Sequence[str],
    by: str = "platform",
    n: int = 10,
    months: Sequence[str] = MONTHS,
) -> DataFrame:
    """The ``n`` words with the greatest sum of monthly frequencies.

    Input is ``monthly_word_freq`` of several platforms. A word that one
    platform lacks has frequency 0 there. Output has a row per word, platform
    and month with ``freq`` and ``log_freq``.
    """
    freq = freq.where(F.col(by).isin(list(platforms)))
    totals = freq.groupBy("word").agg(F.sum("freq").alias("total"))
    grid = (
        totals.orderBy(F.desc("total"), "word")
        .limit(n)
        .withColumn(by, F.explode(F.array(*map(F.lit, platforms))))
        .withColumn("month", F.explode(F.array(*map(F.lit, months))))
    )
    # n * platforms * months rows, all three fixed by the caller: safe to broadcast.
    found = freq.select("word", by, "month", "freq").join(
        F.broadcast(grid.select("word", by, "month")), ["word", by, "month"], "left_semi"
    )
    value = F.coalesce("freq", F.lit(0.0))
    return grid.join(found, ["word", by, "month"], "left").select(
        "word", "total", by, "month", value.alias("freq"), F.log1p(value).alias("log_freq")
    )


def cluster_top_words(
    posts: DataFrame,
    cluster: str = "cluster",
    text_col: str = CLEAN_TEXT,
    top_n: int = 30,
    min_df: int = 3,
    max_df: float = 0.9,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """``(cluster, rank, word, n)``: the most frequent words of each cluster.

    All clusters are counted in one pass. ``min_df`` and ``max_df`` apply
    inside a cluster; where they contradict each other the cluster has no
    words.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    texts = posts.where(~is_blank(F.col(text_col)))
    counted = (
        explode_words(texts, letter_words(F.col(text_col)), stop_words, [cluster], count_rows=True)
        .groupBy(cluster, "word")
        .agg(
            F.count(F.when(F.col("is_doc") == 0, 1)).alias("n"),
            F.sum("is_doc").alias("_df"),
            F.max(F.col("word") == "").alias("_is_row"),
        )
    )
    # Both uses of `counted` need all its columns and filter on an aggregate,
    # not on a key, so they stay the same plan up to the exchange and share it.
    sizes = counted.where("_is_row").select(cluster, F.greatest("n", "_df").alias("_docs"))
    kept = (
        counted.where(~F.col("_is_row") & (F.col("_df") >= min_df))
        .join(sizes, cluster)
        .where(F.col("_df") <= max_df * F.col("_docs"))
    )
    return top_per_key(kept, [cluster], [F.desc("n"), F.asc("word")], top_n, rank="rank").select(
        cluster, "rank", "word", "n"
    )
