"""Small helpers that several operators share."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """``crc32(key as text) mod folds``; 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def worker_memory() -> dict:
    """What a Python worker keeps from one task to the next.

    Functions travel to the workers by value, and their globals with them, anew for each task; so this
    hangs on the interpreter, under a name that no file has.
    """
    return sys.modules.setdefault("socialspark_worker_memory", ModuleType("socialspark_worker_memory")).__dict__


def texts_of(column) -> list[str | None]:
    """The texts of an Arrow column; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast("binary").to_pylist()]


#: What counts as a word wherever texts are cut into words.
WORD = "[\\p{L}\\p{M}]+"
_GAP = "[^\\p{L}\\p{M}]+"


def words_of(text: Column) -> Column:
    """The lower-case words of a text, in order; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The words of ``words_of`` as one string, a space between two; null if there are none.

    In a row and on its way to Python this is one value, not one for each word.
    """
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), _GAP, " ")), F.lit(""))
