"""Helpers shared by the training-data operators: whole-text columns, row locators,
landing tables in the shared folder and joins that survive a hot key."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir

# Locator of a row: the file it was read from and its position there.  Names that
# user columns are not expected to carry.
FILE, ROW = "__llm_file", "__llm_row"
# A group holding more than 1/HEAVY_SHARE of all rows is joined by broadcast; there
# are fewer than HEAVY_SHARE such groups whatever the data.
HEAVY_SHARE = 1000


def whole_text(col: str = "text") -> Column:
    """The text as a string, NULL as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def land_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def land(df: DataFrame, name: str) -> DataFrame:
    """``land_at`` without the path: cuts the lineage with a table every executor can
    read again."""
    return land_at(df, name)[0]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared folder) of a narrow intermediate table."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_locator(docs: DataFrame) -> DataFrame:
    """``docs`` plus (FILE, ROW), which name one row each.

    Rows of file-backed tables use the file path and row position of the scan.  Any
    other DataFrame is first landed in the shared folder, so that its rows have a
    place they can be found again at.  Located rows are returned as they are.
    """
    if FILE in docs.columns and ROW in docs.columns:
        return docs

    def located(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", meta["file_path"].alias(FILE), meta["row_index"].alias(ROW))
    try:
        return located(docs)
    except AnalysisException:
        return located(land(docs, "rows"))


def total_rows(groups: DataFrame, n_col: str) -> int:
    return int(groups.agg(F.sum(n_col)).first()[0] or 0)


def heavy_groups(groups: DataFrame, n_col: str, total: int) -> DataFrame:
    """Groups of more than ``total / HEAVY_SHARE`` rows.  As the sizes add up to
    ``total``, there are fewer than HEAVY_SHARE of them: safe to broadcast."""
    return groups.where(F.col(n_col) * F.lit(HEAVY_SHARE) > F.lit(total))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_col: str, total: int,
                how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with one row per ``key`` value.

    Heavy groups meet their rows by broadcast, so a hot key never gathers in one
    task; the remaining keys hold at most 1/HEAVY_SHARE of the rows each and are
    joined by shuffle, by the same plan at every size.  ``key`` must not be NULL.
    """
    heavy = heavy_groups(groups, n_col, total)
    light = groups.where(F.col(n_col) * F.lit(HEAVY_SHARE) <= F.lit(total))
    hot = rows.join(F.broadcast(heavy), key, how)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(
        light.hint("merge"), key, how)
    return hot.unionByName(rest)


def keep_rows(located: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``located`` whose locator is in ``kept``, without the locator columns.
    Locators are unique, so no key is hot."""
    return located.join(kept.select(FILE, ROW), [FILE, ROW], "left_semi").drop(FILE, ROW)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the strings of ``column`` add up to about ``size`` bytes each
    (a single longer string is a batch of its own)."""
    import numpy as np
    for batch in batches:
        lengths = np.array([x or 0 for x in pa.compute.binary_length(batch.column(column))
                            .to_pylist()], dtype=np.int64)
        if not len(lengths):
            continue
        part = (np.cumsum(lengths) - lengths) // size
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for i, j in zip(starts, starts[1:] + [len(lengths)]):
            yield batch.slice(i, j - i)


def release_memory() -> None:
    """Unused memory of a Python worker back to the system, where the allocators can: workers
    outlive their tasks, and what an idle one holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
