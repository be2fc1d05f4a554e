"""Whitening of embeddings with MLlib's BlockMatrix.

Entries become whole numbers x = floor(64 * c) + 1000000. One pass over all rows gives their count n and the sums S of
each dimension, exactly. Centred rows (n * x - S) / n are numbered and dealt into blocks of BLOCK_ROWS rows; the scatter
matrix is the blocks transposed times the blocks, the middle dimension split so that no task multiplies more than MIDDLE
row blocks and only d x d partial sums go on. The driver decomposes the scatter over n (d x d, from `eigh`), and a
second BlockMatrix product with the whitening matrix projects all rows. The same scatter over the projected rows, centred
by their own means, checks that their covariance is the identity.

Multiplying makes the driver list the blocks it multiplies, so rows go through in slabs of at most SLAB_BLOCKS blocks;
scatters add up, projections follow each other. What the driver holds is a d x d matrix, a count for each task that
wrote rows, and that list.

Rows are dropped when the vector is null, holds null or non-finite entries, or entries that do not fit a long (64 * c beyond 2^53).
So are vectors whose length is not the table's most frequent one (the longer at a tie). Repeated rows and ids all count
and all come back. An empty table gives no rows. A component whose eigenvalue is zero to double precision has no scale:
`whitened` is null there, and the identity error is taken over the others (null if there is none); `explained` is null when
nothing varies. `deviation` is null where it does not fit a long. Columns besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.regions import store
from forgetide.session import scratch_path

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS, BLOCK_COLUMNS = 2048, 1024
MIDDLE = 16
SLAB_BLOCKS = 1 << 16
PART = 33  # monotonically_increasing_id: the task's number above 33 bits


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    fits = F.forall(vector_column, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < 2.0 ** 53, F.lit(False)) & ~F.isnan(c))
    rows = vectors.filter(F.col(vector_column).isNotNull()).filter(fits & (F.size(vector_column) > 0)).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(vector_column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(common.select("d")), F.size("x") == F.col("d"), "left_semi")  # one row


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if len(batch):
            part = _matrix(batch.column(0)).sum(axis=0)
            n, total = n + len(batch), part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])


def _centred(n: int, sums: np.ndarray):
    """(vec_id, deviation, centred): n * x - S squared and summed, exact, and (n * x - S) / n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            # x and S / n are near each other; as numbers of any size where a product might leave 64 bits
            wide = n * float(np.abs(x).max()) >= 2.0 ** 62
            gap = n * x.astype(object) - sums.astype(object) if wide else n * x - sums
            largest = max(abs(int(gap.max())), abs(int(gap.min())))
            exact = gap.astype(object) if largest ** 2 * x.shape[1] >= 1 << 63 else gap
            deviation = [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]
            centred = (gap / n).astype(np.float64)
            ends = pa.array(np.arange(0, centred.size + 1, centred.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(
                ends, pa.array(centred.ravel()))], names=["vec_id", "deviation", "centred"])
    return run


class Slabs:
    """Stored rows with a `place` that numbers them within their task, as BlockMatrix slabs of consecutive rows."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS, slab_blocks: int = SLAB_BLOCKS):
        self.rows, self.block_rows = rows, block_rows
        counts = rows.groupBy(F.shiftright("place", PART).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        self.slabs, limit = [[]], slab_blocks * block_rows  # one count for each task that wrote rows
        for part, n in counts:
            if self.slabs[-1] and sum(m for _, m in self.slabs[-1]) + n > limit:
                self.slabs.append([])
            self.slabs[-1].append((part, n))

    def __iter__(self) -> Iterator[tuple[DataFrame, int]]:
        """(rows with an index from 0 on, their count) of each slab. The filter on `place` reaches the files' statistics."""
        spark = self.rows.sparkSession
        for slab in self.slabs:
            first, last = slab[0][0], slab[-1][0]
            mine = self.rows.filter((F.col("place") >= first << PART) & (F.col("place") < (last + 1) << PART))
            before = np.cumsum([0] + [n for _, n in slab]).tolist()
            starts = spark.createDataFrame([(part, at) for (part, _), at in zip(slab, before[:-1], strict=True)], "part long, start long")
            numbered = mine.join(starts, F.shiftright("place", PART) == F.col("part")).withColumn(
                "index", F.col("start") + F.col("place").bitwiseAND((1 << PART) - 1)).drop("part", "start")
            yield numbered, before[-1]

    def blocks(self, numbered: DataFrame, count: int, column: str, width: int) -> BlockMatrix:
        vectors = MLUtils.convertVectorColumnsFromML(numbered.select("index", array_to_vector(column).alias("vector")), "vector")
        return IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, count, width)).toBlockMatrix(self.block_rows, BLOCK_COLUMNS)

    def scatter(self, column: str, width: int) -> np.ndarray:
        """The sum of the rows' outer products."""
        total = np.zeros((width, width))
        for numbered, count in self:
            matrix = self.blocks(numbered, count, column, width)
            splits = -(-count // (self.block_rows * MIDDLE))
            # the product with a split middle dimension; otherwise all row blocks would meet in the one task of the result block
            product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
            total += BlockMatrix(product, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray()
        return total

    def projected(self, column: str, weights: np.ndarray) -> DataFrame:
        """The stored columns besides `column` with `projected`, the rows times the weights."""
        spark, out = self.rows.sparkSession, None
        for numbered, count in self:
            factor = _small(spark, weights)
            product = self.blocks(numbered, count, column, len(weights)).multiply(factor).toIndexedRowMatrix()
            lines = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
            slab = numbered.drop(column).join(lines.select("index", vector_to_array("vector").alias("projected")), "index").drop("index")
            out = slab if out is None else out.unionByName(slab)
        return out


def _small(spark: SparkSession, matrix: np.ndarray) -> BlockMatrix:
    """A matrix of the driver in blocks that fit the columns of the rows' blocks."""
    parts = [((i, j), DenseMatrix(len(part), part.shape[1], part.ravel(order="F").tolist()))
             for i in range(-(-len(matrix) // BLOCK_COLUMNS)) for j in range(-(-matrix.shape[1] // BLOCK_COLUMNS))
             for part in [matrix[i * BLOCK_COLUMNS:(i + 1) * BLOCK_COLUMNS, j * BLOCK_COLUMNS:(j + 1) * BLOCK_COLUMNS]]]
    return BlockMatrix(spark.sparkContext.parallelize(parts, len(parts)), BLOCK_COLUMNS, BLOCK_COLUMNS, *matrix.shape)


def principal(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors (columns), trace, and which eigenvalues are above rounding."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    return values, vectors, float(np.trace(covariance)), values > len(values) * np.finfo(float).eps * values[0]


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
             block_rows: int = BLOCK_ROWS, slab_blocks: int = SLAB_BLOCKS) -> DataFrame:
    """(vec_id, n, deviation, whitened array, explained array, identity_error): one row per remaining vector, arrays by component."""
    spark = ship(vectors.sparkSession)
    folder = scratch_path(spark, "whitening")
    rows = store(whole_numbers(vectors, id_column, vector_column), folder, "numbers")
    parts = rows.select("x").mapInArrow(_sums, "n long, sums array<long>")
    count = parts.agg(F.sum("n")).first()[0] or 0
    shape = ("vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    if not count:
        return spark.createDataFrame([], shape)
    sums = np.array([s for _, s in parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()])
    width = len(sums)
    centred = store(rows.mapInArrow(_centred(count, sums), "vec_id long, deviation long, centred array<double>").withColumn(
        "place", F.monotonically_increasing_id()), folder, "centred")
    slabs = Slabs(centred, block_rows, slab_blocks)
    values, directions, trace, wide = principal(slabs.scatter("centred", width), count)
    kept = min(components, width)
    scales = np.where(wide, 1 / np.sqrt(np.where(wide, values, 1.0)), 0.0)[:kept]
    projected = store(slabs.projected("centred", directions[:, :kept] * scales).withColumn("place", F.monotonically_increasing_id()), folder, "projected")
    means = projected.select(Summarizer.mean(array_to_vector("projected")).alias("m")).first()["m"].toArray()
    mean_column = F.array(*[F.lit(float(m)) for m in means])
    again = projected.select("place", F.zip_with("projected", mean_column, lambda p, m: p - m).alias("centred"))
    covariance = Slabs(again, block_rows, slab_blocks).scatter("centred", kept) / count
    found = np.flatnonzero(wide[:kept])
    error = float(np.abs(covariance[np.ix_(found, found)] - np.eye(len(found))).max()) if len(found) else None
    share = [F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values[:kept]]
    scaled = [F.col("projected")[i] if wide[i] else F.lit(None).cast("double") for i in range(kept)]
    return projected.select("vec_id", F.lit(count).cast("long").alias("n"), "deviation", F.array(*scaled).alias("whitened"),
                            F.array(*share).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def components_of(rows: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c"))
    return each.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"),
                       F.col("_c.explained").alias("explained"), "identity_error")
