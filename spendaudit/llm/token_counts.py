"""Token counts per document by a separator scan over flat token files.

A flat token file is a run of token identifiers with an end-of-document identifier after
every document and no index.  It is read as fixed-size blocks that pay no heed to where
documents end.  In each block the separators are found by one vectorised comparison;
a prefix sum of the separators of the earlier blocks gives every piece of a document its
number in the file, and pieces of one document that lie in several blocks are added up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

BLOCK_TOKENS = 1 << 16
TOKENIZER = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256   # free in that vocabulary
DTYPE = "<u2"


@lru_cache(maxsize=2)
def encoder(path: str):
    """tiktoken encoder over a rank file, once per worker."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


_FLAT = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
                      T.StructField("data", T.BinaryType())])


def flat_token_files(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     tokenizer: str | None = None, separator: int = END_OF_DOCUMENT,
                     block_tokens: int = BLOCK_TOKENS, dtype: str = DTYPE) -> DataFrame:
    """Tokenised documents as flat files, one per input partition: rows (file, block,
    data) of ``block_tokens`` identifiers each, the last of a file shorter, and rows
    (file, ordinal, id) that say which document was written as the file's n-th.

    NULL texts are empty documents: a separator alone.  The partitions must come from a
    repeatable scan, as those of a table do.
    """
    path = tokenizer or tokenizer_path()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(_FLAT.fields + [T.StructField("ordinal", T.LongType()),
                                          T.StructField("id", id_type)])
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        file = f"p{TaskContext.get().partitionId()}"
        enc = encoder(path)
        end = np.array([separator], dtype=dtype)
        held: list[np.ndarray] = []
        size = block = ordinal = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = enc.encode_to_numpy(text, disallowed_special=()).astype(dtype)
                held += [ids, end]
                size += len(ids) + 1
            n = batch.num_rows
            blocks: list[bytes] = []
            if size >= block_tokens:
                flat = np.concatenate(held)
                full = size // block_tokens
                blocks = [flat[i * block_tokens:(i + 1) * block_tokens].tobytes()
                          for i in range(full)]
                held, size = [flat[full * block_tokens:].copy()], size - full * block_tokens
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                     pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("id")],
                    names=schema.names)
            if blocks:
                yield block_batch(file, block, blocks)
            ordinal, block = ordinal + n, block + len(blocks)
        if size:
            yield block_batch(file, block, [np.concatenate(held).tobytes()])

    def block_batch(file: str, first: int, blocks: list[bytes]) -> pa.RecordBatch:
        n = len(blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n), pa.array(range(first, first + n), pa.int64()),
             pa.array(blocks, pa.binary()), pa.nulls(n, pa.int64()),
             pa.nulls(n, arrow_id)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_id = to_arrow_type(id_type)
    return rows.mapInArrow(run, schema)


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS,
                    dtype: str = DTYPE) -> DataFrame:
    """Flat token files of a folder as (file, block, data)."""
    width = np.dtype(dtype).itemsize * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(data.as_buffer())
                for i in range(0, len(raw), width):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([i // width], pa.int64()),
                         pa.array([bytes(raw[i:i + width])], pa.binary())], names=_FLAT.names)

    return files.mapInArrow(run, _FLAT)


def scan_block(data: bytes, separator: int, dtype: str = DTYPE) -> np.ndarray:
    """Lengths of the pieces between separators: one more than there are separators."""
    ids = np.frombuffer(data, dtype=dtype)
    at = np.flatnonzero(ids == separator)
    edges = np.concatenate([[-1], at, [len(ids)]])
    return np.diff(edges) - 1


def _pieces(flat: DataFrame, separator: int, dtype: str) -> DataFrame:
    """One row per piece: (file, block, k, n, seps), seps on the first piece of a block;
    manifest rows (data NULL) pass as (file, block -1, ordinal, id)."""
    manifest = "ordinal" in flat.columns
    fields = [T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
              T.StructField("k", T.LongType()), T.StructField("n", T.LongType()),
              T.StructField("seps", T.LongType())]
    if manifest:
        fields += [T.StructField("listed", T.BooleanType()), flat.schema["id"]]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, blocks = batch.column("file"), batch.column("block").to_pylist()
            data = batch.column("data")
            if manifest:
                rest = np.flatnonzero(np.array([b is None for b in blocks]))
                if rest.size:
                    listed = batch.take(pa.array(rest))
                    n = listed.num_rows
                    zero = pa.array(np.zeros(n, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [listed.column("file"), pa.array(np.full(n, -1)),
                         listed.column("ordinal"), zero, zero, pa.array(np.ones(n, bool)),
                         listed.column("id")], names=schema.names)
            for i, block in enumerate(blocks):
                if block is None:
                    continue
                lengths = scan_block(data[i].as_py(), separator, dtype)
                n = len(lengths)
                seps = np.zeros(n, np.int64)
                seps[0] = n - 1
                cols = [pa.array([files[i].as_py()] * n, pa.string()),
                        pa.array(np.full(n, block)), pa.array(np.arange(n)),
                        pa.array(lengths.astype(np.int64)), pa.array(seps)]
                if manifest:
                    cols += [pa.array(np.zeros(n, bool)), pa.nulls(n, batch.column("id").type)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return flat.mapInArrow(run, schema)


def separator_scan(flat: DataFrame, separator: int = END_OF_DOCUMENT,
                   dtype: str = DTYPE) -> DataFrame:
    """(file, ordinal, n_tokens, n_pieces) of every document of flat token files given as
    (file, block, data), and id when the rows of ``flat_token_files`` tell it.

    A document is what a separator ends; tokens after the last separator of a file
    make a last document too, unless there are none.  Pieces are narrow rows, grouped by
    file: files must be of bounded size, as shards are.
    """
    pieces = _pieces(flat, separator, dtype)
    before = Window.partitionBy("file").orderBy("block").rangeBetween(
        Window.unboundedPreceding, -1)
    numbered = pieces.withColumn(
        "ordinal", F.col("k") + F.when(F.col("block") >= 0, F.coalesce(
            F.sum("seps").over(before), F.lit(0))).otherwise(0))
    ended = Window.partitionBy("file")
    numbered = numbered.withColumn("seps_in_file", F.sum("seps").over(ended))
    in_block = (F.col("block") >= 0).cast("long")
    found = [F.sum("n").alias("n_tokens"), F.sum(in_block).alias("n_pieces"),
             F.max(F.col("ordinal") < F.col("seps_in_file")).alias("ended")]
    if "listed" in pieces.columns:
        found.append(F.max("id").alias("id"))
    out = (numbered.groupBy("file", "ordinal").agg(*found)
           .where("ended OR n_tokens > 0").drop("ended"))
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, separator: int = END_OF_DOCUMENT,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_tokens, n_pieces) of every document: tokenised into flat files that are then
    counted by the separator scan.  NULL and empty texts have no tokens; repeated rows
    and NULL ids are counted one by one; an empty table gives an empty result."""
    flat = flat_token_files(docs, text_col, id_col, tokenizer, separator, block_tokens)
    return (separator_scan(flat, separator)
            .select(F.col("id").alias(id_col), "n_tokens", "n_pieces"))
