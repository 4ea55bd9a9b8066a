"""Filtering, keep-latest deduplication and text cleaning of a post table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.constants import CLEAN_TEXT, CREATED_AT, POST_ID, STUDY_SINCE, STUDY_UNTIL
from socialspark.functions.predicates import all_present, is_url, language_ok
from socialspark.functions.text import clean_text_rows
from socialspark.functions.timeutil import format_ts, in_month_range, next_month, parse_ts
from socialspark.operators.ranking import first_per_key


def keep_latest(
    posts: DataFrame, key: str = POST_ID, tie_break: Sequence[str] = ("url", "content")
) -> DataFrame:
    """One row per id, the one with the latest ``created_at``.

    Equal times are decided by ``tie_break`` in ascending order, so that a
    re-run and a re-partitioned run agree. Rows without a readable time lose.
    """
    ordered = [F.col("_ts").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    dated = posts.withColumn("_ts", parse_ts(F.col(CREATED_AT)))
    return first_per_key(dated, [key], ordered).drop("_ts")


def clean_posts(
    posts: DataFrame,
    month: str | None = None,
    renames: Mapping[str, str] | None = None,
    require_prior_clean: bool = False,
    lang_match: str = "substring",
    repair: str = "always",
    time_formats: Sequence[str] = (),
    tie_break: Sequence[str] = ("url", "content"),
) -> DataFrame:
    """Valid posts of one month (or of the study span), one per id, cleaned.

    The cheap filters run first, then the only exchange (keep-latest), then
    the costly text cleaning, on the surviving rows alone.
    """
    if renames:
        posts = posts.withColumnsRenamed(dict(renames))
    since, until = (month, next_month(month)) if month else (STUDY_SINCE, STUDY_UNTIL)
    text = CLEAN_TEXT if require_prior_clean else "content"
    valid = (
        posts.withColumn("_ts", parse_ts(F.col(CREATED_AT), time_formats))
        .where(all_present([POST_ID, "url", "author_username", text]))
        .where(in_month_range(F.col("_ts"), since, until))
        .where(language_ok(F.col("lang"), match=lang_match))
        .where(is_url(F.col("url")))
    )
    latest = first_per_key(
        valid.withColumn(POST_ID, F.col(POST_ID).cast("string")),
        [POST_ID],
        [F.col("_ts").desc(), *[F.col(c).asc_nulls_last() for c in tie_break]],
    )
    latest = latest.withColumn(CREATED_AT, format_ts(F.col("_ts"))).drop("_ts", CLEAN_TEXT)
    return latest.select("*", clean_text_rows(F.col("content"), repair).alias(CLEAN_TEXT))
