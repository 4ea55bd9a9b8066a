"""Whitening of embeddings with distributed block matrices.

Components become whole numbers on a fixed grid, ``x = floor(scale * c) + offset``. The fit list is every
distinct ``x`` vector once. Its rows, centred exactly (``(n * x - S) / n`` from whole numbers) and indexed, become an MLlib
``BlockMatrix``; its transpose times itself is the scatter, whose eigenvectors are found on the driver, a matrix of dimensions by
dimensions. Another product of block matrices projects the rows on the leading components over the
square roots of their eigenvalues. The covariance of the projected fit list is multiplied out in the same way and
compared with the identity.

The scatter has one block as its result, so the long side is split: every group of ``BLOCKS_EACH`` row blocks is multiplied in a
task of its own and the products are added. No task sees more rows than that, whatever the table. The driver holds the keys
of the blocks, one per ``BLOCK_MB`` of vectors in large tables. Copies are pre-aggregated before they meet, and every row is projected by
itself, so copies of one vector never share a task.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors, and
entries of ``2**52 / scale`` or more in magnitude, whose grid point is not exact. Vectors must have one length: others than the most frequent (of
ties the longest) are dropped. Ids may be null or repeat, every row gets its own result. Directions in which the fit list does not
vary, to double precision, are no components, so a table of equal vectors gives no rows, as does an empty one. ``deviation``
is null where it does not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from socialspark.session import cut

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
BLOCK_MB = 8
#: Row blocks multiplied in one task.
BLOCKS_EACH = 4
#: Dimensions in a block.
WIDE = 1024
_SCHEMA = "{id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def grid(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(id, x)`` of the rows that take part; ``x`` holds longs."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**52) / scale))
    x = F.transform("vec", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset))
    rows = cut(
        vectors.select(F.col(id_col).alias("id"), vec.alias("vec"))
        .where(F.col("vec").isNotNull() & (F.size("vec") > 0))
        .where(F.coalesce(fine, F.lit(False)))
        .select("id", x.alias("x"))
    )
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return rows if common is None else rows.where(F.size("x") == common["d"])


def _moments(fit: DataFrame) -> tuple[int, list[int], int]:
    """Rows, the sums of each dimension, and the largest distance of an entry from 0 after moving by the floor of its mean."""
    per = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at")
    exact = per.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high")
    )
    rows = exact.orderBy("at").collect()  # a row per dimension
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    far = max(max(abs(r["low"] - s // n), abs(r["high"] - s // n)) for r, s in zip(rows, sums, strict=True))
    return n, sums, far


def _gaps(n: int, sums: list[int], far: int) -> tuple[Column, bool]:
    """``n * x - S`` per dimension, exactly, and whether longs hold the sum of their squares."""
    small = len(sums) * (n * (far + 1)) ** 2 < 1 << 63
    kind = "bigint" if n * (far + 1) < 1 << 62 else "decimal(38,0)"
    means = F.lit([s // n for s in sums]).cast("array<bigint>")
    rest = F.lit([s % n for s in sums]).cast("array<bigint>")
    whole = F.lit(n).cast(kind)
    moved = F.zip_with("x", means, lambda x, m: x - m)
    return F.zip_with(moved, rest, lambda y, r: (whole * y - r).cast(kind)), small


def _squares(small: bool) -> Column:
    """The sum of the squares of ``_gaps``."""
    if small:
        return F.aggregate("_gaps", F.lit(0).cast("bigint"), lambda a, g: a + g * g)
    wide = F.transform("_gaps", lambda g: g.cast("decimal(38,0)"))
    total = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda a, g: F.try_add(a, F.try_multiply(g, g)).cast("decimal(38,0)"))
    return total.try_cast("bigint")


def indexed(df: DataFrame) -> DataFrame:
    """``df`` with a gap-free ``row_index`` from 0. The rows stay where they are; numbers are fixed by writing them."""
    placed = cut(
        df.withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # a row per partition: safe to broadcast
    return placed.join(F.broadcast(offsets), "_part").withColumn("row_index", F.col("_local") + F.col("_offset")).drop("_part", "_local", "_offset")


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """Blocks of the ``n`` rows ``(row_index, values)``; as large as ``BLOCK_MB`` if there are many."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    most = max(1, (BLOCK_MB << 20) // (8 * min(dims, WIDE)))
    each = max(1, min(most, -(-n // (parts * BLOCKS_EACH))))
    as_vectors = rows.select(F.col("row_index").alias("index"), array_to_vector("values").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(as_vectors, "vector"), n, dims)
    return matrix.toBlockMatrix(each, min(dims, WIDE))


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, split along its rows."""
    groups = max(1, -(-blocks.numRowBlocks // BLOCKS_EACH))
    other = blocks._java_matrix_wrapper._java_model
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", other, groups)
    local = BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (local + local.T) / 2


def project(spark: SparkSession, blocks: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """The rows times ``weights``, dimensions by components."""
    d, k = weights.shape
    wide = blocks.colsPerBlock
    pieces = [
        ((at, 0), DenseMatrix(len(part), k, part.T.ravel().tolist()))
        for at, part in enumerate(weights[s : s + wide] for s in range(0, d, wide))
    ]
    return blocks.multiply(BlockMatrix(spark.sparkContext.parallelize(pieces, 1), wide, k, d, k))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors; none that rounding cannot tell from 0."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    noise = max(values.max(), 0) * len(values) * np.finfo(float).eps * 16
    order = order[values[order] > noise]
    return values[order], vectors[:, order]


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component."""
    spark = vectors.sparkSession
    schema = _SCHEMA.format(id=f"`{id_col}` {vectors.select(id_col).schema[0].dataType.simpleString()}")
    rows = grid(vectors, id_col, vector_col, scale, offset)
    distinct = cut(rows.groupBy(F.xxhash64("x").alias("_hash"), "x").agg(F.count(F.lit(1)).alias("copies")).drop("copies", "_hash"))
    if distinct.isEmpty():
        return spark.createDataFrame([], schema)
    n, sums, far = _moments(distinct)
    dims = len(sums)
    gaps, small = _gaps(n, sums, far)
    centred = F.transform("_gaps", lambda g: g.cast("double") / F.lit(float(n)))
    fit = distinct.withColumn("_gaps", gaps).select(centred.alias("values"))
    blocks = block_matrix(indexed(fit), n, dims)
    covariance = scatter(blocks) / n
    values, directions = components_of(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    weights = directions / np.sqrt(values)
    white = scatter(project(spark, blocks, weights)) / n
    error = float(np.abs(white - np.eye(len(values))).max())
    shares = F.lit([float(v) for v in values / np.trace(covariance)])

    named = rows.withColumn("_gaps", gaps).select("id", _squares(small).alias("deviation"), centred.alias("values"))
    every = indexed(named)
    every_blocks = block_matrix(every, every.count(), dims)
    moved = project(spark, every_blocks, weights).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", moved._java_matrix_wrapper._java_model)
    return (
        every.select("row_index", "id", "deviation")
        .join(found.select(F.col("index").alias("row_index"), vector_to_array("vector").alias("whitened")), "row_index")
        .select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            F.col("id").alias(id_col),
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(shares, F.col("at") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
