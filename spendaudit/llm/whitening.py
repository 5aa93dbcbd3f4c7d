"""Whitening of embeddings by block matrices.

The kept vectors become integers, are centred by exact integer sums and numbered, and
blocks of consecutive numbers form a distributed ``BlockMatrix``.  Its transpose times
itself is the scatter matrix, a small matrix whose eigenvectors are found on the driver;
the numbered rows times the whitening matrix are the projected rows.

The product with the transpose is taken over splits of the long dimension, so that no
task meets all blocks.  For the projection the block column is folded into a square
grid of blocks and multiplied by a block-diagonal matrix that holds the whitening matrix
in each place: a block matrix is dealt out over both dimensions, and one block column
alone would use only the square root of the tasks.  The driver keeps one pair of
numbers per block, of at least ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import land

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000     # an entry c becomes floor(SCALE * c) + SHIFT
BLOCK_ROWS = 1024                # least rows of a block ...
BLOCK_BYTES = 8 << 20            # ... which grows with the table up to this size
BLOCKS_PER_SPLIT = 8             # blocks that one task multiplies
# An eigenvalue below this share of the trace is rounding: the vectors have no extent there.
FLAT = 1e-12


@dataclass(frozen=True)
class Fit:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance matrix of
    ``n`` vectors, and the exact sums of their dimensions."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    def whitening(self, components: int) -> np.ndarray:
        """Matrix that centred rows are multiplied by; a flat component has zeros."""
        e = self.values[:components]
        scale = np.where(self.extent(components), 1 / np.sqrt(np.where(e > 0, e, 1)), 0.0)
        return self.vectors[:, :components] * scale

    def extent(self, components: int) -> np.ndarray:
        """Whether each component has a variance."""
        return self.values[:components] > max(FLAT * self.values.sum(), 0.0)


def integer_vectors(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id"
                    ) -> DataFrame:
    """(id, x) of the rows whose vector has entries, all of them finite."""
    c = F.col(vector_col).cast("array<double>")
    finite = F.forall(c, lambda v: F.coalesce((v - v) == 0, F.lit(False)))
    return (rows.where((F.size(vector_col) > 0) & finite)
            .select(F.col(id_col).alias("id"),
                    F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT).alias("x")))


def number(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` landed in the shared folder with a column ``at`` of consecutive numbers in
    any order, and how many there are: a row's place in its partition plus the rows of the
    partitions before.  Nothing is shuffled but one row per partition."""
    rows = land(rows.withColumn("__id", F.monotonically_increasing_id()), "whitening-rows")
    part = F.shiftright("__id", 33)
    sizes = land(rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
                 .withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")),
                 "whitening-offsets")
    n = int(sizes.agg(F.sum("__n")).first()[0] or 0)
    at = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.withColumn("__p", part).join(F.broadcast(sizes), "__p")
            .withColumn("at", at).drop("__p", "__n", "__before", "__id")), n


def block_rows(n: int, d: int) -> int:
    """Rows of a block: more of them in larger tables, up to BLOCK_BYTES."""
    return max(BLOCK_ROWS, min(n >> 16, BLOCK_BYTES // (8 * max(d, 1))))


class Blocks:
    """Rows of doubles (at: 0..n-1, v) as blocks of ``size`` consecutive rows; the last one
    is filled up with zeros."""

    def __init__(self, rows: DataFrame, n: int, d: int):
        size = self.size = block_rows(n, d)
        self.n, self.d, self.count = n, d, -(-n // size)

        def gather(part: pd.DataFrame) -> pd.DataFrame:
            block = np.zeros((size, d))
            block[part["at"].to_numpy() % size] = np.stack(part["v"].to_list())
            return pd.DataFrame({"block": [int(part["at"].iloc[0]) // size],
                                 "payload": [block.tobytes()]})

        self.frame = land(rows.groupBy(F.expr(f"at div {size}").alias("block"))
                          .applyInPandas(gather, "block long, payload binary"), "whitening-blocks")

    def matrix(self, columns: int = 1) -> BlockMatrix:
        """The blocks as a matrix of ``columns`` block columns, filled row by row."""
        size, d = self.size, self.d

        def block(r):
            # row by row in memory, which for DenseMatrix is the transposed order
            return ((r.block // columns, r.block % columns),
                    DenseMatrix(size, d, np.frombuffer(r.payload), True))

        return BlockMatrix(self.frame.rdd.map(block), size, d,
                           -(-self.count // columns) * size, columns * d)

    def scatter(self) -> np.ndarray:
        """Sum of the rows' outer products: the transposed matrix times the matrix."""
        m = self.matrix().persist(StorageLevel.MEMORY_AND_DISK)
        splits = -(-self.count // BLOCKS_PER_SPLIT)
        product = m.transpose()._java_matrix_wrapper.call(
            "multiply", m._java_matrix_wrapper._java_model, splits)
        out = BlockMatrix(product, self.d, self.d).toLocalMatrix().toArray()
        m._java_matrix_wrapper._java_model.blocks().unpersist(False)
        return (out + out.T) / 2

    def times(self, right: np.ndarray) -> DataFrame:
        """(at, v): every row times ``right``."""
        spark, size, n = self.frame.sparkSession, self.size, self.n
        side = max(1, int(np.ceil(np.sqrt(self.count))))
        values = right.ravel(order="F").tolist()
        diagonal = spark.sparkContext.parallelize(range(side), min(side, 64)).map(
            lambda j: ((j, j), DenseMatrix(*right.shape, values)))
        product = self.matrix(side).multiply(
            BlockMatrix(diagonal, self.d, right.shape[1], side * self.d, side * right.shape[1]))
        blocks = spark.createDataFrame(
            product.blocks.map(lambda b: (b[0][0] * side + b[0][1],
                                          bytearray(np.ascontiguousarray(b[1].toArray()).tobytes()))),
            "block long, payload binary")

        def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for block, payload in zip(part["block"], part["payload"]):
                    v = np.frombuffer(payload).reshape(size, -1)[:max(0, n - block * size)]
                    yield pd.DataFrame({"at": block * size + np.arange(len(v)), "v": list(v)})

        return blocks.mapInPandas(rows, "at long, v array<double>")


def _sums(rows: DataFrame, column: str, kind: str) -> list:
    """Sums of an array column, place by place."""
    got = (rows.select(F.posexplode(column).alias("i", "v")).groupBy("i")
           .agg(F.sum(F.col("v").cast(kind)).alias("s")).collect())  # one row per dimension
    return [r["s"] for r in sorted(got, key=lambda r: r["i"])]


def _centred(column: str, sums: list[int], n: int):
    """n times the deviation from the mean, an exact integer."""
    s = F.array(*[F.lit(x).cast("long") for x in sums])
    return F.zip_with(column, s, lambda v, t: v * F.lit(n) - t)


def fit(numbered: DataFrame, n: int) -> tuple[Fit, Blocks]:
    """Principal components of the integer vectors ``x``, and the centred blocks."""
    lengths = numbered.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if lengths["lo"] != lengths["hi"]:
        raise ValueError(f"vectors of {lengths['lo']} to {lengths['hi']} entries have no common "
                         "covariance matrix")
    sums, d = [int(s) for s in _sums(numbered, "x", "decimal(38,0)")], lengths["hi"]
    blocks = Blocks(numbered.select("at", F.transform(_centred("x", sums, n),
                                                      lambda v: v.cast("double") / n).alias("v")),
                    n, d)
    values, vectors = np.linalg.eigh(blocks.scatter() / n)
    return Fit(n, tuple(sums), values[::-1], vectors[:, ::-1]), blocks


def identity_error(whitened: DataFrame, n: int, extent: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance matrix less the identity, over the
    components that have an extent."""
    k = len(extent)
    means = F.array(*[F.lit(s / n) for s in _sums(whitened, "v", "double")])
    centred = whitened.select("at", F.zip_with("v", means, lambda v, m: v - m).alias("v"))
    gap = np.abs(Blocks(centred, n, k).scatter() / n - np.eye(k))[np.ix_(extent, extent)]
    return float(gap.max(initial=0.0))


def whiten(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id",
           components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector: id, deviation (decimal: the sum over dimensions of
    (n*x - S)^2), whitened (array over components) and, the same in every row, n,
    explained (array) and identity_error.

    Vectors that are NULL, empty or hold NULL, infinite or NaN entries are dropped; ids may be
    NULL or repeated, each row is kept by itself; repeated vectors count as often as they
    occur.  A component along which the vectors do not differ has NULL in ``whitened``.
    Vectors of different lengths raise ValueError.  Entries beyond about 1e17 do not fit the integers and raise an overflow
    error.  Other columns are ignored, whatever their names.  An empty table, or one whose
    vectors are all dropped, gives an empty result.
    """
    numbered, n = number(integer_vectors(rows, vector_col, id_col))
    out = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, deviation decimal(38,0), " \
          "whitened array<double>, n long, explained array<double>, identity_error double"
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], out)
    model, blocks = fit(numbered, n)
    extent = model.extent(components)
    white = land(blocks.times(model.whitening(components)), "whitening-rows")
    error = identity_error(white, n, extent)
    share = model.values[:components] / max(model.values.sum(), np.finfo(float).tiny)
    square = F.aggregate(_centred("x", list(model.sums), n), F.lit(0).cast("decimal(38,0)"),
                         lambda s, v: (s + v.cast("decimal(19,0)") * v.cast("decimal(19,0)"))
                         .cast("decimal(38,0)"))
    seen = F.array(*[F.lit(bool(x)) for x in extent])
    return (numbered.select("at", F.col("id").alias(id_col), square.alias("deviation"))
            .join(white, "at")
            .select(id_col, "deviation",
                    F.zip_with("v", seen, lambda v, s: F.when(s, v)).alias("whitened"),
                    F.lit(n).cast("long").alias("n"),
                    F.array(*[F.lit(float(max(s, 0.0))) for s in share]).alias("explained"),
                    F.lit(error).alias("identity_error")))
