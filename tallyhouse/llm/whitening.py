"""Embedding whitening on MLlib's block matrices.

Entries become integers, so sums, means and deviations are exact whatever the offset of the data. Rows
are centred, indexed and dealt into blocks; blocks times their transposes add up to the scatter matrix,
whose eigenvectors, scaled, form the whitening matrix; blocks times that matrix are the whitened rows. Only
matrices of the size of the dimension, never of the rows, come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.common import SharedFolder

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
BLOCK_ROWS, BLOCK_COLUMNS, MOST_ROW_BLOCKS = 1024, 1024, 1 << 16
BLOCKS_IN_TASK = 8
_FARTHEST = 1 << 53


def _usable(vector: Column) -> Column:
    """No NULL, no NaN, no infinity; NULL for a NULL vector."""
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))


def _whole(vector: Column, scale: int, offset: int) -> Column:
    """Entries as integers; beyond 2^53, where doubles have no units, they count as 2^53."""
    bounded = lambda c: F.least(F.greatest(c, F.lit(-float(_FARTHEST))), F.lit(float(_FARTHEST)))
    return F.transform(vector, lambda c: F.floor(bounded(c.cast("double") * scale)) + F.lit(offset))


def _indexed(rows: DataFrame, folder: SharedFolder) -> DataFrame:
    """The rows, written, with ``index`` from 0 without gaps."""
    kept = folder.keep(rows.withColumn("mark", F.monotonically_increasing_id()), "vectors")
    kept = kept.withColumns({"part": F.shiftright("mark", 33), "place": F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))}).drop("mark")
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = kept.groupBy("part").agg((F.max("place") + 1).alias("rows"))
    starts = folder.keep(sizes.select("part", F.coalesce(before, F.lit(0)).alias("start")), "starts")
    return kept.join(starts, "part").withColumn("index", F.col("start") + F.col("place")).drop("part", "place", "start")


def blocks(rows: DataFrame, n_rows: int, n_columns: int) -> BlockMatrix:
    """A block matrix of index and values; indices that are absent are rows of zeros."""
    vectors = rows.select(F.col("index").cast("bigint"), array_to_vector("values").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n_rows, n_columns)
    # Few enough blocks for the driver, which plans a product by their numbers.
    return matrix.toBlockMatrix(max(BLOCK_ROWS, -(-n_rows // MOST_ROW_BLOCKS)), min(BLOCK_COLUMNS, n_columns))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, for rows that are centred.

    The product of one pair of columns of blocks is dealt to many tasks, each of which takes a few row blocks and
    sends one sum on."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_IN_TASK))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    out = BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (out + out.T) / 2


def _product(matrix: BlockMatrix, right: np.ndarray) -> DataFrame:
    """index, values: each row times ``right``."""
    size, width = matrix.colsPerBlock, right.shape[1]
    parts = [right[i : i + size] for i in range(0, len(right), size)]
    tiles = [((i, 0), DenseMatrix(*p.shape, p.ravel(order="F"))) for i, p in enumerate(parts)]
    local = BlockMatrix(matrix.blocks.context.parallelize(tiles, 1), size, width, len(right), width)
    rows = callMLlibFunc("getIndexedRows", matrix.multiply(local).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("values"))


def _centred(rows: DataFrame, n: int, sums: list[int], spread: list[int], largest: int) -> DataFrame:
    """``values`` (x minus its mean) and ``deviation``, from exact integers: n * x - S."""
    fits = sum((n * s) ** 2 for s in spread) < 1 << 63 and n * largest < 1 << 62
    kind = "bigint" if fits else "decimal(38,0)"
    total = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    apart = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(x.cast(kind if fits else "decimal(18,0)"), F.lit(n)), s))
    squares = F.aggregate(F.col("apart"), F.lit(0).cast(kind), lambda acc, d: F.try_add(acc, F.try_multiply(d, d)).cast(kind))
    return rows.withColumn("apart", apart).select(
        "index", "id", squares.try_cast("bigint").alias("deviation"), F.transform("apart", lambda d: d.cast("double") / n).alias("values")
    )


def whiten(
    vectors: DataFrame,
    folder: SharedFolder,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """One row per usable vector: id, n (usable vectors), deviation, whitened (array), explained (array), identity_error.

    Entries c become x = floor(scale * c) + offset. deviation is the sum over dimensions of (n * x - S)^2, S being
    the sum of the dimension; NULL where a bigint can't hold it. whitened are the first ``components`` principal
    components of x with variance one, explained their shares of the whole variance, and identity_error the largest
    entry of |covariance of whitened - identity|. Components without variance (within rounding of the
    largest) have no scale and are left out, so equal vectors, or a single one, give empty arrays.

    Vectors that are NULL or hold NULL, NaN or infinity are dropped, and so are those of another length than
    most (of lengths that are equally common the longer one counts). Entries beyond 2^53 / scale count as that.
    Ids may be NULL or repeated; each row counts. An empty table gives an empty result. Other columns are ignored.
    The driver holds a few matrices of dimension x dimension; a vector has to fit in a row."""
    id_kind = vectors.schema[id_col].dataType
    plain = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("vector")).filter(_usable(F.col("vector")))
    rows = _indexed(plain.select("id", _whole(F.col("vector"), scale, offset).alias("x")), folder)
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    width, n = (common["d"], common["n"]) if common else (0, 0)
    rows = rows.filter(F.size("x") == width)
    sums, spread, largest = [], [], 0
    if width:
        by_place = rows.select(F.posexplode("x").alias("place", "v")).groupBy("place")
        figures = by_place.agg(F.sum(F.col("v").cast("decimal(18,0)")).alias("s"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("place").collect()
        sums = [int(f["s"]) for f in figures]
        spread = [f["most"] - f["least"] for f in figures]
        largest = max(max(abs(f["most"]), abs(f["least"])) for f in figures)
    n_rows = rows.agg(F.max("index")).first()[0] if n else None
    centred = folder.keep(_centred(rows, n, sums, spread, largest), "centred")

    shares, off = [], 0.0
    whitened = centred.select("index", F.array().cast("array<double>").alias("values"))
    if any(spread):
        matrix = blocks(centred, n_rows + 1, width)
        values, axes = np.linalg.eigh(scatter(matrix) / n)
        values, axes = values[::-1], axes[:, ::-1]
        count = min(components, int((values > values[0] * width * np.finfo(float).eps).sum()))
        shares = (values[:count] / values.sum()).tolist()
        whitened = folder.keep(_product(matrix, axes[:, :count] / np.sqrt(values[:count])), "whitened")
        off = _identity_error(centred.select("index").join(whitened, "index"), n, n_rows + 1, count)
    out = centred.join(whitened.withColumnRenamed("values", "whitened"), "index")
    return out.select(
        F.col("id").cast(id_kind).alias(id_col),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, shares)).cast("array<double>").alias("explained"),
        F.lit(off).alias("identity_error"),
    )


def _identity_error(rows: DataFrame, n: int, n_rows: int, count: int) -> float:
    """How far the covariance of the whitened rows is from the identity; they are centred once more before."""
    means = rows.select(F.posexplode("values").alias("place", "v")).groupBy("place").agg((F.sum("v") / n).alias("m")).orderBy("place").collect()
    mean = F.array(*[F.lit(r["m"]) for r in means])
    moved = rows.select("index", F.zip_with("values", mean, lambda v, m: v - m).alias("values"))
    return float(np.abs(scatter(blocks(moved, n_rows, count)) / n - np.eye(count)).max())
