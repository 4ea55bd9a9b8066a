"""What the searches share: usable vectors, copies, and lists of the nearest.

Equal keys are searched once. Of the rows with one key only the ``k + 1`` smallest ids
can be among the ``k`` nearest of anything, since they are equally near and ties go
to smaller ids; so one row per key carries these ids, however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vec)`` of rows with an id and a vector that is not null, empty or zero and whose components are finite."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
        .where("id is not null and vec is not null")
        .where(F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    )


def with_ids(rows: DataFrame, key: str, k: int) -> DataFrame:
    """A row per ``key`` with its ``k + 1`` smallest distinct ids in ``ids``."""
    order = Window.partitionBy(F.xxhash64(key), key).orderBy("id")
    first = rows.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= k + 1)
    return first.groupBy(F.xxhash64(key).alias("_hash"), key).agg(F.sort_array(F.collect_set("id")).alias("ids")).drop("_hash")


def blocks(rows: DataFrame, by: list[str], columns: list[str], spread: Column, size: int) -> DataFrame:
    """Rows of equal ``by`` as lists of about ``size``: a row per list, ``block`` its members."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    slots = F.ceil(F.col("_n") / size)
    return (
        rows.join(counts, by)
        .withColumn("_slot", F.pmod(spread, slots))
        .groupBy(*by, "_slot")
        .agg(F.collect_list(F.struct(*columns)).alias("block"))
    )


def merge(lists: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k + 1`` least of the lists ``best`` of structs with ``id``, per key; each id once, where it is least."""
    each = lists.select(key, F.explode("best").alias("_near")).groupBy(key, F.col("_near.id").alias("_id")).agg(F.min("_near").alias("_near"))
    merged = each.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("_near")), 1, k + 1).alias("best"))
    return merged


def first_ids(pairs: list[tuple], n: int) -> list[tuple]:
    """The first ``n`` of the sorted pairs ``(…, id)`` with different ids."""
    out, seen = [], set()
    for pair in pairs:
        if pair[-1] not in seen:
            seen.add(pair[-1])
            out.append(pair)
            if len(out) == n:
                break
    return out


def expand(queries: DataFrame, found: DataFrame, key: str, k: int) -> DataFrame:
    """``(query_id, rank, near)`` for the rows of ``queries`` ``(id, key)``; ``near`` is a struct with ``id``."""
    joined = queries.select(F.col("id").alias("query_id"), key).distinct().join(found, key)
    others = F.filter("best", lambda x: x["id"] != F.col("query_id"))
    return joined.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "near")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), "near"
    )
