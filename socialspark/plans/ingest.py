"""Raw search hits to flat post and author tables.

Each hit carries the position of its keyword, page and place on the page.
These three define "first seen" for a distributed run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.constants import AUTHOR_FIELDS, POST_FIELDS
from socialspark.functions.text import one_line
from socialspark.functions.timeutil import parse_ts
from socialspark.operators.ranking import first_per_key

SEEN_ORDER = ("kw_pos", "page", "pos")


def _text(*names: str) -> Column:
    """The first of several spellings that has a value, or the empty string."""
    return F.coalesce(*[F.col(n) for n in names], F.lit(""))


def search_window(
    raw: DataFrame, since: str, until: str, language: str | None = None
) -> DataFrame:
    """Hits created in ``[since, until)`` (ISO instants), optionally by language."""
    created = parse_ts(_text("record.created_at", "record.createdAt"))
    hits = raw.where(
        (created >= F.to_timestamp(F.lit(since))) & (created < F.to_timestamp(F.lit(until)))
    )
    return hits.where(F.array_contains("record.langs", language)) if language else hits


def newest_first(raw: DataFrame) -> DataFrame:
    return raw.orderBy(parse_ts(_text("record.created_at", "record.createdAt")).desc(), "uri")


def first_seen_posts(raw: DataFrame) -> DataFrame:
    """Raw hits with a uri, one per uri: the first keyword, page and place."""
    hits = raw.where(F.length("uri") > 0)
    return first_per_key(hits, ["uri"], [F.col(c) for c in SEEN_ORDER])


def flat_post_columns() -> list[Column]:
    """The 17 columns of a flat post; a missing counter stays null."""

    def counter(stem: str) -> Column:
        return F.coalesce(F.col(f"{stem}_count"), F.col(f"{stem}Count")).alias(f"{stem}Count")

    return [
        F.col("keyword"),
        F.col("uri"),
        _text("cid").alias("cid"),
        _text("indexed_at", "indexedAt").alias("indexedAt"),
        _text("record.created_at", "record.createdAt").alias("createdAt"),
        one_line(F.col("record.text")).alias("text"),
        F.coalesce(F.array_join("record.langs", ","), F.lit("")).alias("langs"),
        _text("author.did").alias("author_did"),
        *[counter(s) for s in ("reply", "repost", "like", "quote", "bookmark")],
        *[
            _text(f"record.reply.{end}.{part}").alias(f"reply_{end}_{part}")
            for end in ("parent", "root")
            for part in ("uri", "cid")
        ],
    ]


def author_columns() -> list[Column]:
    return [
        F.col("author.did").alias("did"),
        _text("author.handle").alias("handle"),
        _text("author.display_name", "author.displayName").alias("display_name"),
        _text("author.created_at", "author.createdAt").alias("created_at"),
        _text("author.avatar").alias("avatar"),
        _text("author.associated.activity_subscription.allow_subscriptions").alias(
            "allow_subscriptions"
        ),
        _text("author.pronouns").alias("pronouns"),
        _text("author.verification").alias("verification"),
    ]


def flatten_posts(raw: DataFrame) -> DataFrame:
    """Unique posts, flat. A post without an author key is kept."""
    return first_seen_posts(raw).select(*flat_post_columns()).select(*POST_FIELDS)


def flatten_authors(raw: DataFrame) -> DataFrame:
    """Unique authors of the unique posts, as first seen."""
    authors = (
        first_seen_posts(raw)
        .where(F.length("author.did") > 0)
        .select(*author_columns(), *SEEN_ORDER, "uri")
    )
    return first_per_key(authors, ["did"], [F.col(c) for c in (*SEEN_ORDER, "uri")]).select(
        *AUTHOR_FIELDS
    )


def ingest_totals(raw: DataFrame) -> DataFrame:
    """One row: unique posts and unique authors."""
    posts = first_seen_posts(raw).select("author.did")
    per_author = posts.groupBy("did").agg(F.count(F.lit(1)).alias("n"))
    return per_author.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_posts"),
        F.count(F.when(F.length("did") > 0, 1)).alias("total_authors"),
    )
