"""Document fingerprints: invertible Bloom lookup sketches of passage digests.

A text is cut into passages of a few words at places chosen by the words themselves, the
first words one by one so that short texts have several passages too; each is hashed to 64
bits.  The sketch is a fixed number of cells (count, key sum, check sum) that every
digest is XORed into three times.  Subtracting the sketches of two versions leaves
only the digests in which they differ, and peeling cells that hold one digest
recovers them.  When the difference is too large to peel, both versions are sketched
again into more cells, until it is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, slices, whole_text

CELLS = 24             # cells of a published fingerprint (three sub-tables)
HEAD = 8               # so many first words of a text are passages of their own
LONGEST = 16           # words of a passage at most
LONG_WORD = 16         # a word beyond this many characters is cut like a text
ROWS_PER_RANGE = 2048  # rows of one id range in ``neighbour_fingerprints``
AT_ONCE = 256          # pairs of documents that are sketched and peeled together ...
MANY_KEYS = 50_000     # ... or fewer, once they have so many passages together
CHARS = 4_000_000      # characters of text a worker takes up at a time
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def pieces(word: str) -> list[str]:
    """A long word (or text without spaces) in pieces of at most LONG_WORD characters, cut
    after three characters whose CRC is divisible by 8."""
    out, start = [], 0
    for i in range(1, len(word) + 1):
        if i - start >= LONG_WORD or (i - start >= 3
                                      and not zlib.crc32(word[i - 3:i].encode()) & 7):
            out.append(word[start:i])
            start = i
    if start < len(word):
        out.append(word[start:])
    return out


def passages(text: str) -> list[str]:
    """Passages of a text, in order: they end at line ends, after words whose CRC is
    divisible by 8, and after LONGEST words, so that cuts stay where they are when the
    text changes elsewhere.  The first HEAD words are passages of their own."""
    out: list[str] = []
    head = HEAD
    for line in text.split("\n"):
        if not line:
            continue
        words = line.split(" ")
        if len(line) > LONG_WORD and max(map(len, words)) > LONG_WORD:
            words = [p for w in words for p in (pieces(w) if len(w) > LONG_WORD else (w,))]
        if head:
            out += words[:head]
            words, head = words[head:], head - min(head, len(words))
        start, n = 0, len(words)
        for i, word in enumerate(words, 1):
            if (i - start == LONGEST or i == n
                    or (word and not zlib.crc32(word.encode()) & 7)):
                out.append(" ".join(words[start:i]))
                start = i
    return out


def digests(text: str) -> list[int]:
    """64-bit digests of the passages.  The n-th repeat of a passage is hashed
    with seed n, so repeats are told apart and do not cancel."""
    seen: dict[str, int] = {}
    out = []
    for p in passages(text):
        n = seen.get(p, 0)
        seen[p] = n + 1
        out.append(xxhash.xxh64_intdigest(p.encode(), n))
    return out


class Sketch:
    """Invertible Bloom lookup table over 64-bit keys."""

    __slots__ = ("counts", "keys", "checks", "part")

    def __init__(self, cells: int = CELLS, keys: list[int] = ()):
        self.part = cells // 3
        self.counts, self.keys, self.checks = [0] * cells, [0] * cells, [0] * cells
        for k in keys:
            self.add(k, 1)

    def cells_of(self, key: int) -> tuple[int, int, int]:
        p = self.part
        return key % p, p + (key >> 21) % p, 2 * p + (key >> 42) % p

    def add(self, key: int, sign: int) -> None:
        check = (key * _ODD & _MASK) >> 32
        for i in self.cells_of(key):
            self.counts[i] += sign
            self.keys[i] ^= key
            self.checks[i] ^= check

    def minus(self, other: "Sketch") -> "Sketch":
        out = Sketch(0)
        out.part = self.part
        out.counts = [a - b for a, b in zip(self.counts, other.counts)]
        out.keys = [a ^ b for a, b in zip(self.keys, other.keys)]
        out.checks = [a ^ b for a, b in zip(self.checks, other.checks)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """Keys only on the left and only on the right, or None if some cells stay
        entangled.  Empties the sketch."""
        left: list[int] = []
        right: list[int] = []
        counts, keys, checks = self.counts, self.keys, self.checks
        todo = [i for i, c in enumerate(counts) if c == 1 or c == -1]
        while todo:
            i = todo.pop()
            sign, key = counts[i], keys[i]
            if sign not in (1, -1) or checks[i] != (key * _ODD & _MASK) >> 32:
                continue
            (left if sign == 1 else right).append(key)
            self.add(key, -sign)
            todo.extend(j for j in self.cells_of(key) if counts[j] in (1, -1))
        return None if any(counts) or any(keys) or any(checks) else (left, right)

    def to_text(self) -> str:
        n = len(self.counts)
        return base64.b64encode(struct.pack(f"<{n}i{n}Q{n}I", *self.counts, *self.keys,
                                            *self.checks)).decode()

    @classmethod
    def from_text(cls, text: str) -> "Sketch":
        raw = base64.b64decode(text)
        n = len(raw) // 16
        v = struct.unpack(f"<{n}i{n}Q{n}I", raw)
        out = cls(0)
        out.part, out.counts = n // 3, list(v[:n])
        out.keys, out.checks = list(v[n:2 * n]), list(v[2 * n:])
        return out


def difference(a: list[int], b: list[int], sa: Sketch | None = None,
               sb: Sketch | None = None) -> tuple[list[int], list[int]]:
    """Digests only in ``a`` and only in ``b``: peel the published sketches, and on
    failure sketch both again with more cells until peeling succeeds."""
    found = (sa or Sketch(CELLS, a)).minus(sb or Sketch(CELLS, b)).peel()
    cells = max(4 * CELLS, 3 * ((len(a) + len(b)) // 2 + 8))
    while found is None:
        found = Sketch(cells, a).minus(Sketch(cells, b)).peel()
        cells *= 2
    return found


def likeness(a: list[int], b: list[int], sa: Sketch, sb: Sketch) -> float:
    """Share of both texts' passages that the other has too, 0 to 1; two texts
    without passages are alike."""
    if not a and not b:
        return 1.0
    left, right = difference(a, b, sa, sb)
    return 1.0 - (len(left) + len(right)) / (len(a) + len(b))


# ---------------------------------------------------------- many sketches at once
def _checks(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(_ODD)) >> np.uint64(32)


class Sketches:
    """Sketches of many key lists, ``parts[i]`` cells in each of the three sub-tables of
    the i-th, laid out one after the other.  The cells are those of ``Sketch``."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts.astype(np.int64)
        ends = np.cumsum(3 * self.parts)
        self.first = ends - 3 * self.parts
        size = int(ends[-1]) if len(ends) else 0
        self.counts = np.zeros(size, np.int64)
        self.keys = np.zeros(size, np.uint64)
        self.checks = np.zeros(size, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, signs) -> None:
        """XOR each key into the three cells that it has in its owner's sketch."""
        part = self.parts[owner].astype(np.uint64)
        checks = _checks(keys)
        for i, shift in enumerate((0, 21, 42)):
            cell = (self.first[owner] + i * self.parts[owner]
                    + ((keys >> np.uint64(shift)) % part).astype(np.int64))
            np.add.at(self.counts, cell, signs)
            np.bitwise_xor.at(self.keys, cell, keys)
            np.bitwise_xor.at(self.checks, cell, checks)

    def minus(self, at: np.ndarray, other: "Sketches", other_at: np.ndarray, cells: int
              ) -> "Sketches":
        """Differences of pairs of sketches of ``cells`` cells each."""
        out = Sketches(np.full(len(at), cells // 3))
        mine = (self.first[at][:, None] + np.arange(cells)).ravel()
        theirs = (other.first[other_at][:, None] + np.arange(cells)).ravel()
        out.counts = self.counts[mine] - other.counts[theirs]
        out.keys = self.keys[mine] ^ other.keys[theirs]
        out.checks = self.checks[mine] ^ other.checks[theirs]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of keys recovered, whether nothing is left) of each sketch.  Every round
        takes out the keys of all cells that hold one."""
        owner_of = np.repeat(np.arange(len(self.parts)), 3 * self.parts)
        found = np.zeros(len(self.parts), np.int64)
        for _ in range(len(self.counts) + 1):
            pure = np.flatnonzero((np.abs(self.counts) == 1)
                                  & (self.checks == _checks(self.keys)))
            if not len(pure):
                break
            owner, keys, signs = owner_of[pure], self.keys[pure], self.counts[pure]
            order = np.lexsort((keys, owner))
            owner, keys, signs = owner[order], keys[order], signs[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))
            owner, keys, signs = owner[new], keys[new], signs[new]
            found += np.bincount(owner, minlength=len(found))
            self.add(owner, keys, -signs)
        left = (self.counts != 0) | (self.keys != 0) | (self.checks != 0)
        return found, np.bincount(owner_of[left], minlength=len(found)) == 0

    def to_texts(self, cells: int) -> list[str]:
        """``Sketch.to_text`` of each, all of ``cells`` cells."""
        rows = np.dtype([("c", "<i4", cells), ("k", "<u8", cells), ("x", "<u4", cells)])
        out = np.empty(len(self.parts), rows)
        for name, v in (("c", self.counts), ("k", self.keys), ("x", self.checks)):
            out[name] = v.reshape(-1, cells)
        return [base64.b64encode(r.tobytes()).decode() for r in out]


def _joined(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, keys) of lists laid end to end."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return owner, np.concatenate([*lists, np.empty(0, np.uint64)])


def sketch_all(lists: list[np.ndarray], parts: np.ndarray) -> Sketches:
    out = Sketches(parts)
    out.add(*_joined(lists), 1)
    return out


def likenesses(keys: list[np.ndarray], pairs: list[tuple[int, int]], published: Sketches
               ) -> np.ndarray:
    """``likeness`` of pairs of the key lists: the published sketches are subtracted and
    peeled, and the pairs that do not come apart sketched again into more cells."""
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    sizes = np.array([len(k) for k in keys], np.int64)
    total = sizes[a] + sizes[b]
    found, done = published.minus(a, published, b, CELLS).peel()
    cells = np.maximum(4 * CELLS, 3 * (total // 2 + 8))
    while not done.all():
        todo = np.flatnonzero(~done)
        again = Sketches(cells[todo] // 3)
        again.add(*_joined([keys[i] for i in a[todo]]), 1)
        again.add(*_joined([keys[i] for i in b[todo]]), -1)
        found[todo], done[todo] = again.peel()
        cells *= 2
    return np.where(total > 0, 1.0 - found / np.maximum(total, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third (floor) replaced by the beginning, as long (or
    all), of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _range_starts(docs: DataFrame, id_col: str, rows_per_range: int) -> list:
    """First (largest) ids of consecutive ranges of the ids in descending order; a
    few thousand rows a range, so one id per range reaches the driver."""
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    n = -(-ids.count() // rows_per_range)
    if n <= 1:
        return [r[0] for r in ids.agg(F.max("id")).collect() if r[0] is not None]
    firsts = (ids.repartitionByRange(n, F.desc("id")).groupBy(F.spark_partition_id().alias("p"))
              .agg(F.max("id").alias("id")).collect())
    return sorted({r["id"] for r in firsts}, reverse=True)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprint of every text and of its edited version, and their likeness to each
    other and to the next document (descending id; after the last comes the first).
    n_paragraphs counts passages.

    The texts are shuffled once, into ranges of ids; the first document of each range
    is also sent to the range before, so every row meets its successor in one task
    that streams over sorted rows.  NULL texts are empty, NULL ids come last, rows with
    the same id are ordered by their text's hash, a lone document follows itself, and
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    starts = _range_starts(rows, "id", rows_per_range)
    last = max(len(starts) - 1, 0)
    if not starts:  # only NULL ids, or nothing: one range that follows itself
        starts = [None]
    ascending = starts[::-1]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges(ids):
        import pandas as pd
        out = []
        for v in ids.tolist():
            if v is None or v != v or ascending[0] is None:
                out.append([last])
                continue
            # ranges whose start is >= v, the nearest of them holds v
            p = len(ascending) - bisect_left(ascending, v) - 1
            out.append([p, (p - 1) % (last + 1)] if starts[p] == v else [p])
        return pd.Series(out)

    id_type = rows.schema["id"].dataType
    if isinstance(id_type, T.IntegralType):  # NULLs must not turn ids into floats
        probe = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    else:
        probe = F.col("id")
    # outer: no row lacks a range, and the inner form's filter would run the UDF once more,
    # in a second Python worker
    dealt = (rows.withColumn("ps", ranges(probe))
             .select("id", "text", F.posexplode_outer("ps").alias("copy", "p"))
             .withColumn("tail", F.col("copy") == 1)
             .withColumn("h", F.xxhash64("text"))
             .repartitionById(len(starts), "p")  # hashed, several ranges would share a task
             .sortWithinPartitions("p", "tail", F.desc_nulls_last("id"), "h"))
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
        T.StructField("n_paragraphs", T.LongType())])
    return dealt.select("id", "text", "p", "tail").mapInArrow(_stream_pairs(id_col), schema)


def _stream_pairs(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from paired(batches)
        finally:
            release_memory()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (p, id array, text, digests) waiting for its successor
        for batch in slices(batches, 1, CHARS):
            pairs: list[tuple] = []
            n_keys = 0
            ids, texts = batch.column("id"), batch.column("text")
            ps, tails = batch.column("p").to_pylist(), batch.column("tail").to_pylist()
            for i, text in enumerate(texts.to_pylist()):
                if held is not None and held[0] == ps[i]:
                    row = (ps[i], ids.slice(i, 1), text, _key_array(text))
                    pairs.append((held, row))
                    n_keys += len(row[3])
                    held = None if tails[i] else row
                elif tails[i]:
                    held = None  # further rows of the id that starts the next range
                else:
                    held = (ps[i], ids.slice(i, 1), text, _key_array(text))
                if len(pairs) >= AT_ONCE or n_keys > MANY_KEYS:
                    yield _to_batch(id_col, pairs)
                    pairs, n_keys = [], 0
            if pairs:
                yield _to_batch(id_col, pairs)
        if held is not None:  # only when the table holds NULL ids alone
            yield _to_batch(id_col, [(held, held)])
    return run


def _key_array(text: str) -> np.ndarray:
    return np.array(digests(text), np.uint64)


def _to_batch(id_col: str, pairs: list[tuple]) -> pa.RecordBatch:
    """Output rows of (row, following row) pairs."""
    n = len(pairs)
    edited = [edited_text(row[2], following[2]) for row, following in pairs]
    keys = ([row[3] for row, _ in pairs] + [_key_array(t) for t in edited]
            + [following[3] for _, following in pairs])
    published = sketch_all(keys, np.full(3 * n, CELLS // 3))
    texts = published.to_texts(CELLS)
    near = likenesses(keys, [(i, n + i) for i in range(n)] + [(i, 2 * n + i) for i in range(n)],
                      published)
    cols = [pa.concat_arrays([row[1] for row, _ in pairs]),
            pa.array([len(row[2]) for row, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(texts[:n]), pa.array(texts[n:2 * n]), pa.array(near[:n]), pa.array(near[n:]),
            pa.array([len(row[3]) for row, _ in pairs], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=[
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "n_paragraphs"])
