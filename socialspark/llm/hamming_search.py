"""Exact nearest binary codes by incremental multi-index hashing.

A code of ``b`` bits is cut into segments of up to 16 bits, each with an index of its
own. In round ``r`` a query looks up, in every segment, the values at distance exactly
``r`` from its own and verifies the full codes found there. A code at
distance ``d < segments * (r + 1)`` agrees to within ``r`` bits in some segment, so after
the round every such code has been verified. A query leaves as soon as its ``k``-th best
distance is covered in this sense; the others go on with a larger radius, until all values have been looked up.

The index lives in blocks of about ``BLOCK`` codes, by segment and the first bits of the value;
queries go to the blocks whose first bits are within the radius, in blocks, too. In
a block a lookup is an offset table by value. Only the best of a query in a block leave the task.
Equal codes are one code with their smallest ids, so copies cost nothing.

Defined results: vectors that are null, empty or zero or hold a null or non-finite component
take no part, nor do rows without an id; ties go to the smaller id; rows that
share an id are one candidate, at its nearest; with fewer candidates than ``k`` all
are returned. Codes must have equal length; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.llm.neighbour_lists import BLOCK, blocks, expand, first_ids, merge, usable, with_ids
from socialspark.session import cut

K = 10
SEGMENT = 16
HEAD = 4
QUERIES = 512


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, code)``: a bit per component, set if it is positive, first component first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.packbits(np.asarray(v) > 0, bitorder="little").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["id", "code"])

    return usable(vectors, id_col, vector_col).mapInArrow(run, "id long, code binary")


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with exactly ``radius`` set."""
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[np.bitwise_count(values) == radius]


def segment_values(codes: np.ndarray) -> np.ndarray:
    """Bytes of codes as 16-bit values, a column per segment."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 2) * 2), np.uint8)
    padded[:, : codes.shape[1]] = codes
    return padded.view("<u2").astype(np.uint32)


def _as_matrix(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def candidates(
    queries: np.ndarray, values: np.ndarray, head: int, radius: int, probes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, code)`` whose segment values differ in exactly ``radius`` bits, by ``probes``, their ``masks``.

    ``values`` all begin with the bits ``head``. Values are looked up one by
    one, or all compared if there are fewer of them than lookups.
    """
    order = np.argsort(values, kind="stable")
    present, starts, counts = np.unique(values[order], return_index=True, return_counts=True)
    if len(probes) > len(present):
        q, at = np.nonzero(np.bitwise_count(queries[:, None] ^ present[None, :]) == radius)
    else:
        low = SEGMENT - HEAD
        table = np.full(1 << low, -1, np.int32)
        table[present & ((1 << low) - 1)] = np.arange(len(present))
        wanted = queries[:, None] ^ probes[None, :]
        q, p = np.nonzero((wanted >> low) == head)
        at = table[wanted[q, p] & ((1 << low) - 1)]
        q, at = q[at >= 0], at[at >= 0]
    sizes = counts[at]
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + sizes, sizes)
    return np.repeat(q, sizes), order[place]


_BEST = pa.list_(pa.struct([("distance", pa.int32()), ("id", pa.int64())]))


def _look_up(radius: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = masks(SEGMENT, radius)  # once a task
        for batch in batches:
            for row in batch.select(["segment", "head", "block", "asked"]).to_pylist():
                codes = _as_matrix([x["code"] for x in row["block"]])
                asked = [x["code"] for x in row["asked"]]
                limit = np.array([x["limit"] for x in row["asked"]])
                matrix, segment = _as_matrix(asked), row["segment"]
                values, wanted = segment_values(codes)[:, segment], segment_values(matrix)[:, segment]
                keys, best = [], []
                for first in range(0, len(asked), 64):
                    q, c = candidates(wanted[first : first + 64], values, row["head"], radius, probes)
                    distance = np.bitwise_count(matrix[first + q] ^ codes[c]).sum(axis=1, dtype=np.int32)
                    near = distance <= limit[first + q]
                    q, c, distance = q[near], c[near], distance[near]
                    order = np.lexsort((c, distance, q))
                    q, c, distance = q[order], c[order], distance[order]
                    turns = np.searchsorted(q, np.arange(min(64, len(asked) - first) + 1))
                    for i, (a, b) in enumerate(zip(turns[:-1], turns[1:], strict=True)):
                        if a == b:
                            continue
                        take = k
                        while True:
                            # all codes at the distance of the k+1-st code: ties are settled by ids
                            last = distance[min(a + take, b - 1)]
                            stop = a + int(np.searchsorted(distance[a:b], last, side="right"))
                            ids = sorted((int(d), x) for d, j in zip(distance[a:stop], c[a:stop], strict=True) for x in row["block"][j]["ids"])
                            ids = first_ids(ids, k + 1)
                            if len(ids) > k or stop == b:
                                break
                            take *= 4  # an id with several codes among the nearest
                        keys.append(asked[first + i])
                        best.append([{"distance": d, "id": x} for d, x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(best, _BEST)], ["code", "best"])

    return run


def hamming_search(codes: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the ``k`` nearest rows of ``codes`` for each row of ``queries``.

    Both are ``(id, code)``; a query is not its own neighbour.
    """
    index = cut(with_ids(codes, "code", k))
    length = index.agg(F.max(F.length("code"))).first()[0] or 0
    segments = max(1, math.ceil(length * 8 / SEGMENT))
    # the bits of a segment, least first; a code of odd length ends in a segment of 8 bits
    byte = lambda at: F.conv(F.hex(F.substring("code", at, 1)), 16, 10).cast("int")
    value = [byte(2 * s + 1) + F.coalesce(byte(2 * s + 2), F.lit(0)) * 256 for s in range(segments)]
    heads = F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftright(v, SEGMENT - HEAD).alias("head")) for s, v in enumerate(value)])
    parts = cut(
        blocks(index.select("code", "ids", F.inline(heads)), ["segment", "head"], ["code", "ids"], F.xxhash64("code"), block)
    )
    state = cut(
        queries.select("code").distinct().withColumn("best", F.array().cast("array<struct<distance:int,id:bigint>>"))
    )
    done = state.limit(0)
    for radius in range(SEGMENT + 1):
        full = F.size("best") > k
        limit = F.when(full, F.element_at("best", -1)["distance"]).otherwise(length * 8)
        near = [
            F.array(*[F.lit(h) for h in range(1 << HEAD) if (h ^ own).bit_count() <= radius]) for own in range(1 << HEAD)
        ]
        routed = (
            state.select("code", limit.alias("limit"), F.inline(heads))
            .select("code", "limit", "segment", F.explode(F.element_at(F.array(*near), F.col("head") + 1)).alias("head"))
        )
        asked = blocks(routed, ["segment", "head"], ["code", "limit"], F.xxhash64("code"), QUERIES)
        asked = asked.select("segment", "head", F.col("block").alias("asked"))
        new = parts.join(asked, ["segment", "head"]).mapInArrow(
            _look_up(radius, k), "code binary, best array<struct<distance:int,id:bigint>>"
        )
        state = cut(merge(state.unionByName(new), "code", k))
        covered = F.coalesce(full & (F.element_at("best", -1)["distance"] < segments * (radius + 1)), F.lit(False))
        done = done.unionByName(state.where(covered))
        state = state.where(~covered)
        if state.isEmpty():
            break
    found = done.unionByName(state)
    return expand(queries, found, "code", k).select(
        "query_id", "rank", F.col("near.id").alias("vec_id"), F.col("near.distance").alias("distance")
    )
