"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in id order.  A balanced Feistel network permutes the
smallest even-bit power of two that covers n; values that fall outside are walked
along their cycle until they are inside, which makes it a permutation of 0..n-1.  Row
i then belongs to shard ``perm(i) % shards`` at slot ``perm(i) // shards``, so shard
sizes differ by one at most, slots have no gaps, and both directions can be computed
from (n, seed) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_text

SHARDS = 16
SEED = 20240131
ROUNDS = 6
_PRIME = (1 << 31) - 1  # modulus of the round function


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(offset, multiplier) of each round, derived from the seed."""
    return [((seed * 48271 + 7919 * r + 1) % _PRIME, (seed * 16807 + 104729 * r + 65537) % _PRIME)
            for r in range(1, ROUNDS + 1)]


def _round(x: np.ndarray, key: tuple[int, int], mask: int) -> np.ndarray:
    t = (x + np.uint64(key[0])) % np.uint64(_PRIME) * np.uint64(key[1]) % np.uint64(_PRIME)
    t = (t ^ (t >> np.uint64(15))) * np.uint64(key[1]) % np.uint64(_PRIME)
    return (t ^ (t >> np.uint64(13))) & np.uint64(mask)


def _network(v: np.ndarray, h: int, keys: list[tuple[int, int]], forward: bool) -> np.ndarray:
    mask = (1 << h) - 1
    left, right = v >> np.uint64(h), v & np.uint64(mask)
    for key in keys if forward else keys[::-1]:
        if forward:
            left, right = right, left ^ _round(right, key, mask)
        else:
            left, right = right ^ _round(left, key, mask), left
    return (left << np.uint64(h)) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, forward: bool = True) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at ``rows``, by cycle walking."""
    h, keys = _half_bits(n), round_keys(seed)
    v = _network(rows.astype(np.uint64), h, keys, forward)
    outside = np.flatnonzero(v >= np.uint64(n))
    while outside.size:
        v[outside] = _network(v[outside], h, keys, forward)
        outside = outside[v[outside] >= np.uint64(n)]
    return v.astype(np.int64)


def locate(rows: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED):
    """(shard, slot) of global row numbers."""
    p = permute(np.asarray(rows), n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED):
    """Global row number stored at (shard, slot)."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, forward=False)


def number_rows(df: DataFrame, order: list[str], column: str = "row_number"):
    """``df`` with global row numbers 0..n-1 in the order of ``order``, and n.

    One range-partitioned sort; a row's number is its position in its partition plus
    the rows of the partitions before.  Rows equal in every order column are spread by
    a hash of their input position, so a hot value does not gather in one task.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    ranged = (df.withColumn("__tie", tie).repartitionByRange(*order, "__tie")
              .sortWithinPartitions(*order, "__tie").drop("__tie")
              .withColumn("__at", F.monotonically_increasing_id()))
    ranged = cut(ranged.withColumn("__p", F.shiftright("__at", 33)))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition of the sort
    offsets = cut(sizes.select("__p", "__n", (F.sum("__n").over(Window.orderBy("__p"))
                                              - F.col("__n")).alias("__before")))
    n = int(offsets.agg(F.sum("__n")).first()[0] or 0)
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(F.broadcast(offsets), "__p")
            .withColumn(column, F.col("__before") + at)
            .drop("__p", "__at", "__n", "__before")), n


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          seed: int = SEED) -> DataFrame:
    """Shard and slot of every row under the law ``rows``: shard sizes at most one
    apart.

    Rows are numbered by (id, text CRC, size), NULL ids first; rows equal in all three
    are interchangeable.  A NULL text has no bytes.  An empty table gives an empty
    result.  Only narrow columns are sorted; texts are read once and not shuffled.
    """
    text = whole_text(text_col)
    narrow = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"))
    numbered, n = number_rows(narrow, [id_col, "text_crc32", "size"])

    @F.pandas_udf("long")
    def perm(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for r in rows:
            yield pd.Series(permute(r.to_numpy(), n, seed))

    return (numbered.withColumn("__perm", perm("row_number"))
            .select(id_col, "size", "text_crc32", F.lit("rows").alias("law"),
                    (F.col("__perm") % shards).cast("int").alias("shard"),
                    F.expr(f"__perm div {int(shards)}").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "row_number"))
