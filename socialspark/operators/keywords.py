"""Keyword tagging, boolean keyword groups and keyword-list comparison."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.constants import KEYWORD_GROUPS, TAG_KEYWORDS
from socialspark.functions.text import WORD_CLASS, no_spaces


NOTHING = "(?!)"  # matches nowhere


def trie_pattern(words: Sequence[Sequence[str]], first_wins: bool = True) -> str:
    """One pattern for a list of words, given as lists of units, that shares their prefixes.

    A unit is a piece of a pattern that matches one way only, or ends its word. A
    position is tried once per branch of the prefix tree, so the cost does not grow with the list.
    Words that differ in a unit exclude each other there, hence grouping by the next unit keeps
    the meaning of the order. With ``first_wins`` what comes after a word that is its prefix can
    never be reached, and is left out; otherwise all words stay, for patterns that go on after them.
    """
    branches: dict[str, list[Sequence[str]]] = {}
    ends = False
    for word in words:
        if word:
            branches.setdefault(word[0], []).append(word[1:])
            continue
        if ends:
            continue
        ends = True
        branches[""] = []  # the empty rest keeps its place among the branches
        if first_wins:
            break
    parts = []
    for unit, rests in branches.items():
        # A stretch without branches is written out, so nesting is as deep as words branch.
        while len(rests) == 1 and rests[0]:
            unit, rests = unit + rests[0][0], [rests[0][1:]]
        parts.append(unit + (trie_pattern(rests, first_wins) if any(rests) else ""))
    if not parts:
        return NOTHING
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def tag_keywords(
    posts: DataFrame,
    keywords: Sequence[str] = TAG_KEYWORDS,
    text_col: str = "text",
    name: str = "keyword",
    longest_first: bool = False,
) -> DataFrame:
    """Add all non-overlapping keyword hits, joined by commas, repeats kept.

    Spaces are removed before matching, so a hit may span words. The first
    alternative wins at each position (``biden`` hides ``biden2024``);
    ``longest_first`` lets the longer keyword win. No hit, or no keywords, gives the empty
    string; null text stays null.
    """
    ordered = sorted(keywords, key=len, reverse=True) if longest_first else keywords
    pattern = trie_pattern([[re.escape(c) for c in k] for k in ordered])
    hits = F.regexp_extract_all(no_spaces(F.col(text_col)), F.lit(pattern), 0)
    return posts.withColumn(name, F.array_join(hits, ","))


def terms_pattern(terms: Sequence[str]) -> str:
    """Whole-word pattern of any of ``terms``; see ``term_pattern``."""
    ending = f"[{WORD_CLASS}]*"
    units = [[re.escape(c) for c in t.rstrip("*").lower()] + [ending] * t.endswith("*") for t in terms]
    return f"(?:^|[^{WORD_CLASS}]){trie_pattern(units, first_wins=False)}(?:$|[^{WORD_CLASS}])"


def term_pattern(term: str) -> str:
    """Whole-word pattern of a word or phrase; a final ``*`` allows any ending."""
    stem = re.escape(term.rstrip("*").lower())
    end = f"[{WORD_CLASS}]*" if term.endswith("*") else ""
    return f"(?:^|[^{WORD_CLASS}]){stem}{end}(?:$|[^{WORD_CLASS}])"


def keyword_groups(
    posts: DataFrame,
    groups: Mapping[str, Sequence] = KEYWORD_GROUPS,
    text_col: str = "text",
) -> DataFrame:
    """Add one boolean column per group of terms.

    A group holds when any term occurs as whole words in the lower-cased
    text; a tuple of terms holds when all of them do. Null text gives false.
    """
    lowered = posts.withColumn("_lower", F.lower(F.col(text_col)))

    def holds(terms: Sequence) -> Column:
        single = [t for t in terms if isinstance(t, str)]
        tests = [F.col("_lower").rlike(terms_pattern(single))] if single else []
        # Terms that must all occur are few, and each is looked for by itself.
        tests += [
            reduce(lambda a, b: a & b, [F.col("_lower").rlike(terms_pattern([x])) for x in t])
            for t in terms if not isinstance(t, str)
        ]
        return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))

    return lowered.withColumns({name: holds(terms) for name, terms in groups.items()}).drop("_lower")


def compare_keyword_lists(left: DataFrame, right: DataFrame, column: str = "keyword") -> DataFrame:
    """``(keyword, side)`` with side ``both``, ``left`` or ``right``.

    Keywords are compared in lower case without spaces. One aggregation
    answers the intersection and both differences.
    """
    sides = left.select(no_spaces(F.col(column)).alias("keyword"), F.lit(1).alias("side")).unionByName(
        right.select(no_spaces(F.col(column)).alias("keyword"), F.lit(2).alias("side"))
    )
    found = sides.groupBy("keyword").agg(F.bit_or("side").alias("side"))
    return found.withColumn(
        "side", F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.col("side"))
    )
