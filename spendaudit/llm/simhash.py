"""SimHash near-duplicates by segment-popcount embedding and a grid join.

A document's fingerprint is the bitwise majority of its shingle hashes.  The 64 bits are
cut into 32 segments, and a fingerprint is embedded as the vector of their popcounts.  A
differing bit changes one popcount by one at most, so the Manhattan distance of two
vectors is a lower bound of the bit distance.  Segments are gathered in 8 axes; vectors
within distance 4 agree in full on at least 4 of them, so every link shares the grid cell
of at least one of the 70 choices of 4 axes.  Inside a cell, pairs are tested against
the Manhattan bound first and then exactly.

Only distinct fingerprints enter the join, and a cell yields a spanning forest of its
links, never all pairs; cells of more than ``CELL_ROWS`` fingerprints are split into
blocks that are compared block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILE, ROW, cut, join_groups, keep_rows, total_rows, whole_text, with_locator
from .components import components

SHINGLE = 4            # words
MAX_BITS = 4           # fingerprints at most this many bits apart are linked
AXES = 8               # of 4 two-bit segments each
CELL_ROWS = 2048
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: A-Z lower-cased, words split at ASCII white space, XXH64 of every
    shingle (the whole sequence when shorter), repeats included; a bit is set when more
    than half of the hashes have it.  No words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stops = np.cumsum(lengths) - 1
    starts = (stops - lengths + 1)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in
                          zip(starts, stops[shingle - 1:].tolist())), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):   # bounded scratch space for very long texts
        part = hashes[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, columns of ``keep``); fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, whole_text(text_col).alias("text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]
                          + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(list(batch.columns)[:-1] + [pa.array(fps)],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: popcounts of the 32 two-bit segments, two bits each in one word."""
    v = fp.view(np.uint64)
    m = np.uint64(0x5555555555555555)
    return (v & m) + ((v >> np.uint64(1)) & m)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: each segment's difference is 0, 1 or 2."""
    m = np.uint64(0x3333333333333333)
    total = np.zeros(np.broadcast(a, b).shape, dtype=np.uint64)
    for shift in (0, 2):
        x = (a >> np.uint64(shift)) & m
        y = (b >> np.uint64(shift)) & m
        # x - y + 2 in each 4-bit field is 0..4; its distance from 2
        d = x + np.uint64(0x2222222222222222) - y
        two = ~(d | (d >> np.uint64(1)) | (d >> np.uint64(2))) | (d >> np.uint64(2))
        two &= np.uint64(0x1111111111111111)      # 0 or 4: difference 2
        one = d & np.uint64(0x1111111111111111)   # 1 or 3: difference 1
        total += np.bitwise_count(one) + np.uint64(2) * np.bitwise_count(two)
    return total


def cell_choices(max_bits: int = MAX_BITS) -> list[tuple[int, ...]]:
    """Axis choices of the grid: vectors within ``max_bits`` agree on all axes of one."""
    if not 0 <= max_bits < AXES:
        raise ValueError(f"max_bits must be 0 to {AXES - 1}")
    return list(combinations(range(AXES), AXES - max_bits))


def cells(fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells of fingerprints: (choice, code), choices by row of the result."""
    emb = popcounts(fp)
    byte = [(emb >> np.uint64(8 * i)) & np.uint64(0xFF) for i in range(AXES)]
    codes = []
    for axes in cell_choices(max_bits):
        code = np.zeros(len(fp), dtype=np.uint64)
        for a in axes:
            code = (code << np.uint64(8)) | byte[a]
        codes.append(code)
    return np.stack(codes)


def _cell_rows(max_bits: int):
    choices = len(cell_choices(max_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                part = fp[i:i + 4096]
                code = cells(part, max_bits).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(choices, dtype=np.int32), len(part))),
                     pa.array(code.ravel()), pa.array(np.tile(part, choices))],
                    names=["choice", "code", "fp"])
    return run


def spanning_links(fp: np.ndarray, max_bits: int, apart: np.ndarray | None = None):
    """(a, b) forest edges over ``fp`` that connect what links within ``max_bits``.

    Grown group by group: unreached fingerprints are compared with a frontier in blocks.
    With ``apart`` (0 or 1 per fingerprint) only links between the two sides count.
    """
    n = len(fp)
    emb = popcounts(fp)
    bits = fp.view(np.uint64)
    free = np.ones(n, dtype=bool)
    out_a, out_b = [], []
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed] = False
        frontier = [seed]
        while frontier:
            at = frontier.pop()
            rest = np.flatnonzero(free if apart is None else free & (apart != apart[at]))
            if not rest.size:
                continue
            near = rest[manhattan(emb[rest], emb[at]) <= max_bits]
            near = near[np.bitwise_count(bits[near] ^ bits[at]) <= max_bits]
            if near.size:
                free[near] = False
                out_a.append(np.full(near.size, fp[at]))
                out_b.append(fp[near])
                frontier.extend(near.tolist())
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


_FOUND = "a long, b long, choice int, code long, n long"


def _cell_links(max_bits: int, cell_rows: int):
    """Links of the cells of one partition, whose rows come sorted by cell.  Cells of two
    and three are compared all at once, larger ones one by one; a cell beyond
    ``cell_rows`` is only reported, as (choice, code, n), for the block-wise path."""
    def batch_of(a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
             pa.nulls(n, pa.int64())], names=["a", "b", "choice", "code", "n"])

    def report(choice, code, n):
        return pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([choice], pa.int32()),
             pa.array([code], pa.int64()), pa.array([n], pa.int64())],
            names=["a", "b", "choice", "code", "n"])

    def links(choice, code, fp, more):
        """``more``: rows of the last cell that were let go."""
        new = np.flatnonzero((choice[1:] != choice[:-1]) | (code[1:] != code[:-1])) + 1
        start = np.concatenate([[0], new])
        size = np.diff(np.concatenate([start, [len(fp)]]))
        size[-1] += more
        bits, emb = fp.view(np.uint64), popcounts(fp)
        three = start[size == 3]
        a, b = [], []
        for i, gap in ((start[size == 2], 1), (three, 1), (three + 1, 1), (three, 2)):
            near = i[manhattan(emb[i], emb[i + gap]) <= max_bits]
            near = near[np.bitwise_count(bits[near] ^ bits[near + gap]) <= max_bits]
            a.append(fp[near])
            b.append(fp[near + gap])
        for s, k in zip(start[size > 3], size[size > 3]):
            if k <= cell_rows:
                x, y = spanning_links(fp[s:s + k], max_bits)
                a.append(x)
                b.append(y)
            else:
                yield report(choice[s], code[s], k)
        yield batch_of(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False)
                   for c in ("choice", "code", "fp")]
            if held is not None:
                if more and (now[0][0] != held[0][-1] or now[1][0] != held[1][-1]):
                    yield from links(*held, more)
                    more = 0
                else:
                    now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            choice, code, fp = now
            last = np.flatnonzero((choice != choice[-1]) | (code != code[-1]))
            at = last[-1] + 1 if last.size else 0   # the last cell may go on
            if at:
                if more:   # the held cell ended inside this batch
                    end = np.flatnonzero((choice != choice[0]) | (code != code[0]))[0]
                    yield report(choice[0], code[0], end + more)
                    more = 0
                    choice, code, fp, at = choice[end:], code[end:], fp[end:], at - end
                if at:
                    yield from links(choice[:at], code[:at], fp[:at], 0)
            held = [x[at:] for x in (choice, code, fp)]
            if len(held[2]) > cell_rows:   # only the size of such a cell matters here
                more += len(held[2]) - cell_rows
                held = [x[-cell_rows:] for x in held]
        if held is not None:
            yield from links(*held, more)
    return run


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS,
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect exactly what the
    bit distance connects: a spanning forest per cell, repeated links included."""
    in_cells = distinct.select("fp").mapInArrow(_cell_rows(max_bits),
                                                "choice int, code long, fp long")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(in_cells.repartition(parts, "choice", "code")
                .sortWithinPartitions("choice", "code")
                .mapInArrow(_cell_links(max_bits, cell_rows), _FOUND))
    small = found.where("n IS NULL").select("a", "b")
    large = found.where("n IS NOT NULL").select(
        "choice", "code", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    if large.isEmpty():
        return small
    # fingerprints of a large cell in blocks, every pair of blocks in its own group
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    blocked = in_cells.join(large, ["choice", "code"]).withColumn("block", block)
    pairs = (blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("choice", "code", "fp", F.least("block", "other").alias("i"),
                     F.greatest("block", "other").alias("j"),
                     (F.col("block") > F.col("other")).cast("int").alias("side")))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        a, b = spanning_links(pdf["fp"].to_numpy(), max_bits,
                              None if same else pdf["side"].to_numpy())
        return pd.DataFrame({"a": a, "b": b})

    return small.unionByName(pairs.groupBy("choice", "code", "i", "j")
                             .applyInPandas(between, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    cell_rows: int = CELL_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fingerprint, component_id, component_root, columns of ``keep``) of every
    document; component_root is the least fingerprint of the component.

    component_id is the smallest id reachable over links of at most ``max_bits`` bits.
    Documents without words (NULL, empty) have fingerprint zero and link like others;
    equal fingerprints are one node; NULL ids are never the smallest unless a component
    has no other; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle, keep))
    nodes = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    total = total_rows(nodes, "n")
    roots = components(near_links(nodes, max_bits, cell_rows))
    labelled = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                .withColumn("root", F.coalesce("root", "fp")))
    named = (labelled.join(labelled.groupBy("root").agg(F.min("least").alias("component_id")),
                           "root").select("fp", "n", "component_id", F.col("root").alias("component_root")))
    named = cut(named)
    return (join_groups(rows, named, "fp", "n", total)
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0"))
                    .alias("fingerprint"), "component_id", "component_root", *keep))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id (NULL ids
    last, then the first by place); all columns are kept as they are."""
    located = with_locator(docs)
    found = near_duplicates(located, id_col, text_col, shingle, max_bits, keep=(FILE, ROW))
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), FILE, ROW)).alias("first")
    kept = (found.groupBy("component_root").agg(first)
            .select(F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{ROW}").alias(ROW)))
    return keep_rows(located, kept)
