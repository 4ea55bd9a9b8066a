"""Removal of every byte that lies in a string of ``length`` bytes which also starts elsewhere.

Equal strings must be brought together without moving all suffixes. Of the ``GRAM``-byte
grams in a window of ``length`` bytes the one with the least hash is its anchor; equal
windows have the same anchor at the same place. So only anchors, one per 150 bytes
or so, are dealt out, by the hash of their gram:

1. Anchors whose gram occurs once are dropped.
2. Occurrences are classes by everything that the windows of an anchor cover. A class of two or more
   is repeated as a whole, and ends here as one row, however many copies it has.
3. The other classes of a gram are compared by suffix sorting: the bytes right of the
   anchor's start are sorted, and those left of it, backwards (`suffix_sort`). With the common
   prefixes of neighbours, a window that begins ``t`` bytes before the anchor is repeated
   if another class agrees on ``t`` bytes to the left and ``length - t`` to the right.
   A gram with more than ``GROUP`` classes is not gathered: the hashes of its windows are counted instead.
4. The repeated spans return to their documents.

Matches never cross documents, are judged on the input, and overlaps count. Classes,
grams and windows are compared by hashes of 64 bits inside groups of equal 64-bit hashes.

Defined results: a null text counts as empty and keeps nothing, with no spans; texts
shorter than ``length`` are kept whole; ids may be null or repeat, rows with the
same text are copies of each other. Other columns are passed on if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.llm.hashing import Spans, mix
from socialspark.llm.suffix_sort import deep_shallow
from socialspark.llm.words import parts_of
from socialspark.session import cut

LENGTH = 400
GRAM = 96
#: Classes of one gram that a task may gather: at most this many spans of under ``2 * LENGTH`` bytes.
GROUP = 20_000
#: Bytes whose hashes a task holds at once, at some hundred bytes each.
_PIECE = 1 << 18
_PLACE = np.uint64((1 << 22) - 1)
_PAIRWISE = 24


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(text, anchor, first, last, gram hash, class hash)`` of every anchor.

    ``first`` and ``last`` are the starts of its windows. Short texts are handled
    together, long ones in overlapping pieces.
    """
    reach = length - gram + 1
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for i, data in enumerate(texts):
        if len(data) < length:
            continue
        for start in range(0, len(data), _PIECE):
            stop = min(len(data), start + _PIECE)
            lo, hi = max(0, start - reach), min(len(data), stop + length)
            if held and size + hi - lo > _PLACE:  # places have so many bits
                yield _anchors_of(held, length, gram)
                held, size = [], 0
            held.append((i, lo, start, stop, data[lo:hi]))
            size += hi - lo
            if size >= _PIECE:
                yield _anchors_of(held, length, gram)
                held, size = [], 0
    if held:
        yield _anchors_of(held, length, gram)


def _anchors_of(pieces, length: int, gram: int) -> tuple[np.ndarray, ...]:
    reach = length - gram + 1
    data = np.frombuffer(b"".join(p[4] for p in pieces), np.uint8)
    sizes = np.array([len(p[4]) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    spans = Spans(data, 0)
    n = len(data) - gram + 1
    hashes = spans.hash(slice(0, n), slice(gram, gram + n))
    keys = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-(n + reach) // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begins, sizes, strict=True) if s >= length])
    place = (np.minimum(behind[windows], ahead[windows + reach - 1]) & _PLACE).astype(np.int64)
    turns = np.flatnonzero(place[1:] != place[:-1]) + 1
    starts, stops = np.concatenate([[0], turns]), np.concatenate([turns, [len(place)]]) - 1
    at, first, last = place[starts], windows[starts], windows[stops]
    piece = np.searchsorted(begins, at, side="right") - 1
    shift = np.array([p[1] for p in pieces])[piece] - begins[piece]
    low, high = np.array([p[2] for p in pieces])[piece], np.array([p[3] for p in pieces])[piece]
    own = (at + shift >= low) & (at + shift < high)
    at, first, last, piece, shift = at[own], first[own], last[own], piece[own], shift[own]
    whole = Spans(data, 1).hash(first, last + length)
    whole = mix(whole + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    text = np.array([p[0] for p in pieces])[piece]
    return text, at + shift, first + shift, last + shift, hashes[at].astype(np.int64), whole.astype(np.int64)


def _emit_anchors(length: int, gram: int):
    names = ["gram", "class", "id", "key", "at", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            for text, at, first, last, gh, ch in anchors([_utf8(t) for t in batch.column("_text").to_pylist()], length, gram):
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gh), pa.array(ch), batch.column("_id").take(rows), batch.column("_key").take(rows),
                        pa.array(at), pa.array((at - first).astype(np.int32)), pa.array((at - last).astype(np.int32)),
                    ],
                    names,
                )

    return run


def repeated_windows(
    lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, length: int
) -> list[list[tuple[int, int]]]:
    """For classes of one gram, the ranges of ``t`` whose windows another class has, too.

    Class ``i`` has the windows that begin ``low[i]`` to ``high[i]`` bytes before the anchor;
    ``lefts`` read backwards from there, ``rights`` forwards.
    """
    n = len(lefts)
    order_r, shared_r = deep_shallow(rights)
    order_l, shared_l = deep_shallow(lefts)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= _PAIRWISE:
        rank_l = {int(x): k for k, x in enumerate(order_l)}
        for i in range(n):
            agree = length
            for j in range(i + 1, n):
                agree = min(agree, int(shared_r[j]))
                a, b = int(order_r[i]), int(order_r[j])
                x, y = sorted((rank_l[a], rank_l[b]))
                lo = max(length - agree, int(low[a]), int(low[b]))
                hi = min(int(shared_l[x + 1 : y + 1].min()), int(high[a]), int(high[b]))
                if lo <= hi:
                    found[a].append((lo, hi))
                    found[b].append((lo, hi))
        return found
    in_r, in_l = np.empty(n, np.int64), np.empty(n, np.int64)
    hits = np.zeros((n, int(high.max()) + 2), bool)
    for t in range(int(low.min()), int(high.max()) + 1):
        in_r[order_r] = np.cumsum(shared_r < length - t)
        in_l[order_l] = np.cumsum(shared_l < t)
        own = np.flatnonzero((low <= t) & (t <= high))
        _, same, count = np.unique(in_r[own] * (n + 1) + in_l[own], return_inverse=True, return_counts=True)
        hits[own, t] = count[same] > 1
    for i, row in enumerate(hits):
        turns = np.flatnonzero(np.diff(np.concatenate([[False], row]).astype(np.int8)))
        found[i] = [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return found


def _cut_out(length: int):
    """Rows of a document and its classes: the bytes around each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            out: dict[str, list] = {k: [] for k in ("gram", "class", "many", "left", "right", "before", "after")}
            for text, wanted in zip(batch.column("_text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = _utf8(text)
                for w in wanted:
                    at = w["at"]
                    out["before"].append(data[at - w["left"] : at][::-1])
                    out["after"].append(data[at : at - w["right"] + length])
                    for k in ("gram", "class", "many", "left", "right"):
                        out[k].append(w[k])
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out), _CONTEXT, preserve_index=False)

    return run


_CONTEXT = pa.schema(
    [("gram", pa.int64()), ("class", pa.int64()), ("many", pa.bool_()), ("left", pa.int32()), ("right", pa.int32()), ("before", pa.binary()), ("after", pa.binary())]
)
_CONTEXT_SQL = "gram long, class long, many boolean, left int, right int, before binary, after binary"
_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_RANGES_SQL = "gram long, class long, ranges array<struct<lo:int,hi:int>>"


def _sort_groups(length: int):
    """Rows sorted by gram: the repeated ranges of every class."""

    def of_group(rows: pa.Table) -> tuple[pa.Table, list]:
        lefts, rights = rows["before"].to_pylist(), rows["after"].to_pylist()
        return repeated_windows(lefts, rights, rows["right"].to_numpy(), rows["left"].to_numpy(), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready: list[tuple[np.ndarray, np.ndarray, list]] = []

        def close() -> None:
            nonlocal held
            rows = pa.Table.from_batches(held)
            ready.append((rows["gram"].to_numpy(), rows["class"].to_numpy(), of_group(rows)))
            held = []

        def flush() -> pa.RecordBatch:
            nonlocal ready
            ranges = [[{"lo": a, "hi": b} for a, b in x] for _, _, found in ready for x in found]
            grams, classes = (np.concatenate([r[k] for r in ready]) for k in (0, 1))
            ready = []
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(classes), pa.array(ranges, _RANGES)], ["gram", "class", "ranges"])

        for batch in batches:
            gram = batch.column("gram").to_numpy()
            turns = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            for start, stop in zip([0, *turns], [*turns, len(gram)], strict=True):
                if start == stop:
                    continue
                if held and held[0].column("gram")[0].as_py() != gram[start]:
                    close()
                held.append(batch.slice(start, stop - start))
            if ready:
                yield flush()
        if held:
            close()
            yield flush()

    return run


def _hash_windows(length: int):
    """Every window of a class by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["before"][::-1] + row["after"], np.uint8)
                first = np.arange(row["left"] - row["right"] + 1)
                hashes = Spans(data, 1).hash(first, first + length).astype(np.int64)
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["gram"])), pa.array(np.full(n, row["class"])), pa.array((row["left"] - first).astype(np.int32)), pa.array(hashes)],
                    ["gram", "class", "t", "window"],
                )

    return run


def _joined(spans: list[tuple[int, int]], common: int) -> list[tuple[int, int]]:
    """Runs of the sorted spans; neighbours with at least ``common`` bytes in common are one."""
    runs: list[tuple[int, int]] = []
    for lo, hi in spans:
        if runs and lo <= runs[-1][1] - common:
            runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
        else:
            runs.append((lo, hi))
    return runs


def _remove(length: int, as_text: bool, words: int, long: int):
    """Rows of a document and its repeated spans: what is left of it.

    Passages, strings of which every window is repeated, go if they have more than ``words`` words or at
    least ``long`` bytes.
    """
    kind = pa.string() if as_text else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            out: list[tuple] = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = _utf8(text)
                found = sorted((x["lo"], x["hi"]) for x in spans or ())
                if words or long:
                    found = [(lo, hi) for lo, hi in _joined(found, length - 1) if hi - lo >= long or len(data[lo:hi].split()) > words]
                runs = _joined(found, 0)
                kept, at, removed = [], 0, 0
                for lo, hi in runs:
                    kept.append(data[at:lo])
                    removed += hi - lo
                    at = hi
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), removed, len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if as_text else left))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``(_id, _key, spans)`` of the documents ``(_id, _key, _text)`` that have repeated spans; spans may overlap."""
    found = cut(
        keyed.select("_id", "_key", "_text").mapInArrow(
            _emit_anchors(length, gram), "gram long, class long, id long, key long, at long, left int, right int"
        )
    )
    # a table, so that nothing but the exchanges stands below the join and a hot gram can be split
    busy = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram"))
    found = cut(found.join(busy, "gram"))
    classes = cut(
        found.groupBy("gram", "class").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "at")).alias("one"), F.max("left").alias("left"), F.max("right").alias("right")
        )
    )
    sizes = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1")
    wanted = (
        classes.join(sizes, "gram")
        .groupBy("one.id", "one.key")
        .agg(F.collect_list(F.struct("gram", "class", (F.col("c") > group).alias("many"), "one.at", "left", "right")).alias("wanted"))
        .select(F.col("id").alias("_id"), F.col("key").alias("_key"), "wanted")
    )
    # one of the rows with this id and text is enough; others would add the same classes again
    contexts = keyed.select("_id", "_key", "_text").join(wanted, ["_id", "_key"]).mapInArrow(_cut_out(length), _CONTEXT_SQL)
    contexts = cut(contexts.dropDuplicates(["gram", "class"]))
    sorted_out = (
        contexts.where("not many").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_groups(length), _RANGES_SQL)
    )
    windows = contexts.where("many").mapInArrow(_hash_windows(length), "gram long, class long, t int, window long")
    again = windows.groupBy("gram", "t", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    counted = (
        windows.join(again, ["gram", "t", "window"])
        .groupBy("gram", "class")
        .agg(F.collect_list(F.struct(F.col("t").alias("lo"), F.col("t").alias("hi"))).alias("ranges"))
    )
    ranges = sorted_out.unionByName(counted).where(F.size("ranges") > 0)
    whole = classes.where("n > 1").select(
        "gram", "class", F.array(F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))).alias("ranges")
    )
    single = classes.where("n = 1").select("gram", "class").join(ranges, ["gram", "class"])
    hits = found.join(single.unionByName(whole), ["gram", "class"])
    spans = hits.select(
        "id", "key", "at", "left", "right", F.explode("ranges").alias("r")
    ).select(
        F.col("id").alias("_id"),
        F.col("key").alias("_key"),
        (F.col("at") - F.coalesce("r.hi", "left")).alias("lo"),
        (F.col("at") - F.coalesce("r.lo", "right") + length).alias("hi"),
    )
    return spans.groupBy("_id", "_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
    length: int = LENGTH,
    gram: int = GRAM,
    group: int = GROUP,
    as_text: bool = False,
    in_struct: bool = False,
    words: int = 0,
    long: int = 0,
) -> DataFrame:
    """The columns ``keep`` (the id alone by default) and, per row, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept``.

    ``kept`` are the remaining bytes, which may begin or end inside a character; with
    ``as_text`` a string without such characters. With ``in_struct`` the columns ``keep`` are in the struct ``row``.
    Passages of at most ``words`` words (cut ones at their ends count) and under ``long`` bytes stay; by default none does.
    """
    columns = [F.col(c) for c in (keep or (id_col,))]
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"),
        F.col(text_col).alias("_text"),
        F.struct(*columns).alias("_row"),
    )
    spans = cut(repeated_spans(keyed, length, gram, group))
    joined = keyed.join(spans, ["_id", "_key"], "left").select("_text", "spans", "_row")
    row = joined.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(
        _remove(length, as_text, words, long),
        f"_row {row}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}",
    )
    if in_struct:
        return out.withColumnRenamed("_row", "row")
    return out.select("_row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
