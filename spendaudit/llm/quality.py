"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text is described by three blocks of terms: trigrams of byte classes (how it is
written), how much of it repeats itself, and its hashed words.  Each block is weighted by
inverse document frequency and brought to a fixed length; a truncated singular value
decomposition of the labelled sample turns the terms into latent vectors.  The labelled
vectors are broadcast (``TRAIN_ROWS`` of them at most).  Documents come in blocks, the
cosines of a block with all labelled vectors are one matrix product, and the labels of the
nearest ones vote with a weight that grows with their cosine.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

TRAIN_ROWS = 8192     # bound of the labelled sample that the classifier is fitted on
THRESHOLD = 0.5
DIMENSIONS = 48
NEIGHBOURS = 15       # and whatever is as near as the last of them
SHARPNESS = 8         # a neighbour's vote weighs its cosine to this power
BLOCK = 256           # documents of one matrix product
PIECE = 1 << 20       # characters of a text that are looked at together

# Byte classes: letters (and all bytes of non-ASCII characters), capitals, digits, ...
_KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\r\n", ".,;:", "'\"-()", "!?", "|",
          "#$%&*@", "<>/\\=_{}[]")
CLASSES = len(_KINDS) + 2
SHAPES, REPEATS, WORDS = CLASSES ** 3, 24, 1024
TERMS = SHAPES + REPEATS + WORDS
# Lengths of the three blocks in a term vector.
SHAPE_WEIGHT, REPEAT_WEIGHT, WORD_WEIGHT = 1.0, 1.0, 0.3


def _byte_classes() -> np.ndarray:
    kind = np.full(256, len(_KINDS) + 1, np.int32)  # other ASCII
    kind[ord("a"):ord("z") + 1] = 0
    kind[128:] = 0
    for i, chars in enumerate(_KINDS, 1):
        kind[[ord(c) for c in chars]] = i
    return kind


_CLASS = _byte_classes()
_SPACE = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    """The whole text in pieces of about PIECE characters that end at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def terms(text: str) -> np.ndarray:
    """Logarithmic term counts of a whole text."""
    shapes, tail = np.zeros(SHAPES, np.int64), np.full(2, _CLASS[10], np.int32)
    counts, words, again, last = Counter(), 0, 0, None
    for piece in pieces(text):
        c = np.concatenate([tail, _CLASS[np.frombuffer(piece.encode("utf-8", "replace"), np.uint8)]])
        shapes += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=SHAPES)
        tail = c[-2:]
        found = piece.lower().split()
        if found:
            again += (found[0] == last) + sum(a == b for a, b in zip(found, found[1:]))
            last = found[-1]
            words += len(found)
            counts.update(found)
    repeats = np.zeros(REPEATS, np.float32)
    half = REPEATS // 2
    n = max(1, words)
    repeats[min(half - 1, half * len(counts) // n)] = 1    # share of distinct words
    repeats[half + min(half - 1, -(-half * again // n))] = 1  # share of words said twice running
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in counts), np.int64,
                     len(counts)) % WORDS
    tf = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    return np.concatenate([np.log1p(shapes), repeats,
                           np.bincount(at, tf, WORDS)]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term counts times ``idf``, each block brought to its length."""
    x = x * idf
    a, b = SHAPES, SHAPES + REPEATS
    return np.hstack([SHAPE_WEIGHT * _unit(x[:, :a]), REPEAT_WEIGHT * _unit(x[:, a:b]),
                      WORD_WEIGHT * _unit(x[:, b:])]).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """``idf`` of the terms, ``axes`` (terms x dimensions), the labelled documents' latent
    unit ``vectors`` and their ``labels`` (0 to 1)."""
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled documents of each row of
        term counts; the share among all of them where none is near, 0.5 without any."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = _unit(weighted(x, self.idf) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, -k, axis=1)[:, -k][:, None]
        votes = np.where(near >= last - 1e-6, np.maximum(near, 0.0) ** SHARPNESS, 0.0).astype(float)
        total = votes.sum(axis=1)
        found = np.where(total > 0, votes @ self.labels / np.maximum(total, 1e-300),
                         self.labels.mean())
        return np.clip(found, 0.0, 1.0)


def principal_axes(x: np.ndarray, dimensions: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration."""
    k = min(dimensions, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 12, x.shape[1]))
                                                    ).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k]


def fit_model(x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> QualityModel:
    if not len(x):
        none = np.zeros((0, 0), np.float32)
        return QualityModel(np.ones(TERMS, np.float32), none, none, labels)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
    w = weighted(x, idf)
    axes = principal_axes(w, dimensions)
    return QualityModel(idf, axes, _unit(w @ axes), labels)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of the sample, as places and values of what is not zero."""
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            x = terms(text)
            at = np.flatnonzero(x).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"label": [label], "at": pa.array([at.tobytes()], pa.binary()),
                 "value": pa.array([x[at].tobytes()], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", max_rows: int = TRAIN_ROWS
          ) -> QualityModel:
    """Model from the labelled documents that ``train`` (Column -> Column) admits, at most
    ``max_rows`` ids, chosen by a hash of the id.  Equal texts count once, with the mean of
    their labels; rows without id or label are passed over.  Without any labelled document
    the model scores 0.5 everywhere."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
              .where("id IS NOT NULL AND label IS NOT NULL").where(train(F.col("id")))
              .groupBy("id").agg(F.avg("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    texts = (docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
             .join(F.broadcast(chosen), "id")  # at most max_rows ids
             .groupBy(F.sha2("text", 256).alias("sha"))
             .agg(F.first("text").alias("text"), F.avg("label").alias("label")))
    rows = (texts.select("text", "label")
            .mapInArrow(_term_rows, "label double, at binary, value binary").collect())
    rows.sort(key=lambda r: (bytes(r["at"]), bytes(r["value"]), r["label"]))  # the same model on a rerun
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    return fit_model(x, np.array([r["label"] for r in rows], float))


def with_score(docs: DataFrame, model: QualityModel, text_col: str = "text",
               score_col: str = "quality_score") -> DataFrame:
    """``docs`` plus the quality score (0 to 1) of each whole text.

    A NULL text is scored as the empty one, which has a vector like any other text.  Long
    texts are read whole, piece by piece.  Repeated rows and equal texts get equal scores.
    A column of ``docs`` named like the score is replaced; other columns play no part,
    whatever their names.  An empty table stays empty.
    """
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TRAIN_ROWS vectors at most
    schema = T.StructType(docs.schema.fields + [T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                x = np.stack([terms(t or "") for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(shared.value.score(x), pa.float64())],
                    names=schema.names)

    return docs.mapInArrow(run, schema)
