"""Row filters used by the cleaning plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from socialspark.functions.text import is_blank


def is_url(c: Column) -> Column:
    """Scheme is http or https; a host is not required.

    Leading control characters and spaces, and tabs or line breaks anywhere,
    are ignored. A host with only one of ``[`` and ``]`` is not a URL.
    """
    url = F.translate(c, "\t\r\n", "")
    host = F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)
    ok = url.rlike(r"(?i)^[\x00-\x20]*https?:") & (host.contains("[") == host.contains("]"))
    return F.coalesce(ok, F.lit(False))


def language_ok(c: Column, language: str = "en", match: str = "substring") -> Column:
    """Missing or empty passes; otherwise the language must occur.

    ``substring`` accepts ``fr,en`` and ``kven`` alike; ``token`` compares
    whole language tags or their primary part (``en``, ``en-us``).
    """
    lower = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    if match == "substring":
        hit = lower.contains(language)
    elif match == "token":
        hit = lower.rlike(rf"(^|[^a-z0-9]){language}($|[^a-z0-9])")
    else:
        raise ValueError(f"unknown language match {match!r}")
    return (lower == "") | hit


def all_present(columns: Sequence[str]) -> Column:
    """No column is null or blank."""
    tests = [F.col(c).isNotNull() & ~is_blank(F.col(c).cast("string")) for c in columns]
    return reduce(lambda a, b: a & b, tests)
