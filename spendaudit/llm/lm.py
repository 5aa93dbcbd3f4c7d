"""Language-model scores from a class-based log-bilinear model.

Words fall into a bounded number of classes: the most frequent words are classes of
their own, the others are classed by their ending.  A log-bilinear neural model predicts
the class of a token from the classes of the two tokens before: their context vectors,
each through its position's matrix, add up to a predicted vector whose product with the
class vectors, plus a bias, gives the class scores.  It is trained in numpy by
noise-contrastive estimation on the class trigrams counted over the whole training
corpus.  At scoring time, batched matrix products and a softmax give the normalised log
probability of every class in every context; within its class a word has its smoothed
training frequency.  All probabilities of a context add up to one.

What grows with the corpus (word counts, the rare words of the documents) is counted and
joined by Spark; what reaches the driver is bounded: the most frequent words, the class
totals and the class trigrams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, whole_text

HEADS = 63             # most frequent words: one class each
ENDINGS = 62           # classes of other words by ending; then a class for the rest, the end
CLASSES = HEADS + ENDINGS + 2
FREQUENT = 50_000      # at most so many frequent words have their counts on every worker
DIM = 24
NOISE = 64             # noise samples, shared by a batch
BATCH = 1024
STEPS = 4000
RATE = 0.15
SEED = 7
CHARS = 4_000_000
END = b"\n"            # the end token: no word contains it


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased words split at ASCII white space, then the end token."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def ending(word: bytes) -> bytes:
    """Last three bytes of a word without trailing punctuation, marked if it had some."""
    core = word.rstrip(b".,;:!?")
    return core[-3:] + (b"." if len(core) < len(word) else b"")


class Classes:
    """Class of a word: bounded lists of frequent words and endings."""

    def __init__(self, heads: list[bytes], endings: list[bytes]):
        self.heads = {w: i for i, w in enumerate(heads)}
        self.endings = {e: HEADS + i for i, e in enumerate(endings)}
        self.rest, self.end = HEADS + ENDINGS, HEADS + ENDINGS + 1

    def of(self, word: bytes) -> int:
        if word == END:
            return self.end
        c = self.heads.get(word)
        return c if c is not None else self.endings.get(ending(word), self.rest)


@dataclass
class Model:
    """Counts and weights that scoring needs on every worker (bounded)."""
    classes: Classes
    counts: dict          # frequent word -> training count
    tokens: int           # N
    types: int            # V
    class_tokens: np.ndarray
    class_types: np.ndarray
    log_class: np.ndarray  # [context, class] log10 probability; context = c1 * CLASSES + c2


# -- counting -------------------------------------------------------------------

_WORDS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())],
            names=["word", "n"])
        found.clear()
        return batch

    for batch in slices(batches, 0, CHARS):
        for text in batch.column(0).to_pylist():
            found.update(words_of(text))
        if len(found) > 1_000_000:
            yield flush()
    if found:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts (column text), the end token included."""
    return texts.mapInArrow(_count_words, _WORDS).groupBy("word").agg(F.sum("n").alias("n"))


def _class_totals(counts: DataFrame, classes: Classes) -> list:
    """(class, tokens, types): at most CLASSES rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            c = np.array([classes.of(w) for w in batch.column(0).to_pylist()], dtype=np.int64)
            np.add.at(tokens, c, batch.column(1).to_numpy())
            np.add.at(types, c, 1)
        at = np.flatnonzero(types)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tokens[at]),
                                          pa.array(types[at])], names=["c", "n", "v"])
    return (counts.mapInArrow(run, "c long, n long, v long").groupBy("c")
            .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())


def _ending_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[ending(w)] += n
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()),
                                      pa.array(found.values(), pa.int64())], names=["word", "n"])


def _trigrams(classes: Classes):
    """Class trigram counts of a partition, as code (c1 * C + c2) * C + c3.  Two end tokens
    stand before every text as context; they are no targets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Memo(classes)
        for batch in slices(batches, 0, CHARS):
            found, padding = [], []
            for text in batch.column(0).to_pylist():
                padding.append(len(found))
                found += (classes.end, classes.end)
                found += map(of.__getitem__, words_of(text))
            c = np.array(found, dtype=np.int64)
            target = np.ones(len(c), dtype=bool)
            target[np.array(padding)] = target[np.array(padding) + 1] = False
            code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            codes, n = np.unique(code[target[2:]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))],
                                             names=["code", "n"])
    return run


class _Memo(dict):
    """Class of a word, remembered for a bounded number of words."""

    def __init__(self, classes: Classes):
        super().__init__()
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        c = self[word] = self.classes.of(word)
        return c


# -- the model ------------------------------------------------------------------

def train_nce(codes: np.ndarray, n: np.ndarray, unigram: np.ndarray, steps: int = STEPS,
              seed: int = SEED) -> dict[str, np.ndarray]:
    """Log-bilinear weights by noise-contrastive estimation on class trigram counts.

    Batches are drawn in proportion to the counts, noise from the class frequencies;
    AdaGrad steps.
    """
    rng = np.random.default_rng(seed)
    noise = (unigram + 1.0) / (unigram + 1.0).sum()
    log_noise = np.log(NOISE * noise)
    w = {"r": rng.normal(0, 0.1, (CLASSES, DIM)), "q": rng.normal(0, 0.1, (CLASSES, DIM)),
         "m1": np.eye(DIM) * 0.5, "m2": np.eye(DIM), "b": np.log(noise)}
    if not len(codes):
        return w
    seen = {k: np.full(v.shape, 1e-2) for k, v in w.items()}
    cdf = np.cumsum(n / n.sum())
    for step in range(steps):
        pick = np.minimum(np.searchsorted(cdf, rng.random(BATCH)), len(codes) - 1)
        code = codes[pick]
        c1, c2, t = code // (CLASSES * CLASSES), code // CLASSES % CLASSES, code % CLASSES
        k = rng.choice(CLASSES, NOISE, p=noise)
        r1, r2 = w["r"][c1], w["r"][c2]
        h = r1 @ w["m1"] + r2 @ w["m2"]
        pos = (h * w["q"][t]).sum(1) + w["b"][t] - log_noise[t]
        neg = h @ w["q"][k].T + w["b"][k] - log_noise[k]
        gp = 1 / (1 + np.exp(-pos)) - 1                 # d loss / d positive score
        gn = 1 / (1 + np.exp(-neg))                     # each noise sample counts once
        gh = gp[:, None] * w["q"][t] + gn @ w["q"][k]
        g = {key: np.zeros_like(v) for key, v in w.items()}
        np.add.at(g["q"], t, gp[:, None] * h)
        np.add.at(g["q"], k, gn.T @ h)
        np.add.at(g["b"], t, gp)
        np.add.at(g["b"], k, gn.sum(0))
        g["m1"], g["m2"] = r1.T @ gh, r2.T @ gh
        np.add.at(g["r"], c1, gh @ w["m1"].T)
        np.add.at(g["r"], c2, gh @ w["m2"].T)
        rate = RATE * (1 - step / steps) + 1e-3
        for key, v in w.items():
            d = g[key] / BATCH
            seen[key] += d * d
            v -= rate * d / np.sqrt(seen[key])
    return w


def class_log_probabilities(w: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(class | two classes before) for every context, normalised: the products of
    all context vectors with all class vectors, one batch per first class."""
    out = np.empty((CLASSES * CLASSES, CLASSES), dtype=np.float32)
    second = w["r"] @ w["m2"]
    first = w["r"] @ w["m1"]
    for c in range(CLASSES):
        z = (first[c] + second) @ w["q"].T + w["b"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        out[c * CLASSES:(c + 1) * CLASSES] = z / math.log(10)
    return out


def frequent_words(counts: DataFrame, at_most: int = FREQUENT) -> dict[bytes, int]:
    """Counts of the words above a frequency that at most ``at_most`` words reach.  The
    frequency comes from a histogram of few bins, so no more than those words are sent to
    the driver."""
    level = F.floor(F.log2("n") * 8)
    bins = {r["b"]: r["v"] for r in counts.groupBy(level.alias("b"))
            .agg(F.count(F.lit(1)).alias("v")).collect()}
    least, total = None, 0
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > at_most:
            break
        least = b
    if least is None:
        return {}
    return {bytes(r["word"]): r["n"] for r in counts.where(level >= least).collect()}


def fit(texts: DataFrame, counts: DataFrame, steps: int = STEPS) -> Model:
    """Model of the training texts (column text) whose word counts are ``counts``.
    Without training texts every class is as likely as any other."""
    total = counts.agg(F.sum("n"), F.count("n")).first()
    frequent = frequent_words(counts)
    top = counts.orderBy(F.desc("n"), "word").limit(HEADS + 1).collect()
    heads = [w for w in (bytes(r["word"]) for r in top) if w != END][:HEADS]
    tails = (counts.where(~F.col("word").isin([F.lit(w) for w in heads + [END]]))
             .mapInArrow(_ending_totals, _WORDS).groupBy("word").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "word").limit(ENDINGS).collect())
    classes = Classes(heads, [bytes(r["word"]) for r in tails])
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in _class_totals(counts, classes):
        class_tokens[r["c"]], class_types[r["c"]] = r["n"], r["v"]
    trigrams = (texts.select("text").mapInArrow(_trigrams(classes), "code long, n long")
                .groupBy("code").agg(F.sum("n").alias("n")).orderBy("code")
                .toPandas())   # at most CLASSES^3 rows of two numbers
    weights = train_nce(trigrams["code"].to_numpy(np.int64), trigrams["n"].to_numpy(float),
                        class_tokens, steps)
    return Model(classes, frequent, int(total[0] or 0), int(total[1]), class_tokens, class_types,
                 class_log_probabilities(weights))


# -- scoring --------------------------------------------------------------------

def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
          steps: int = STEPS) -> DataFrame:
    """Model and unigram log10 probability of every whole text.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, score.  ``train``
    (Column -> Column of the id) says which documents the model learns from; a NULL there
    (NULL ids) means training.  NULL texts are empty: the end token alone.  Without
    training documents all words are unknown.  Repeated rows are scored one by one; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    learns = F.coalesce(train(F.col(id_col)), F.lit(True))
    rows = docs.select(whole_text(text_col).alias("text"), F.col(id_col).alias("id"),
                       learns.alias("learns"))
    texts = rows.where("learns").select("text")
    counts = cut(word_counts(texts))
    model = fit(texts, counts, steps)
    sent = spark.sparkContext.broadcast(model)   # bounded by FREQUENT and CLASSES

    schema = T.StructType([
        T.StructField("row", T.LongType()), rows.schema["id"],
        T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StructType([
            T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])))])
    scored = cut(rows.mapInArrow(_score_batches(sent, schema.names), schema))

    # words beyond the frequent ones: their counts by an exact join, one row per document
    # and word; each is met by at most one count row, and no such word is frequent
    rare = scored.select("row", F.inline("rare"))
    met = rare.join(counts.withColumnRenamed("n", "c"), "word")
    # a rare word's score already counts it as unseen, log10(1 / size): add log10(c + 1)
    gain = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain"),
        F.sum("n").alias("known"))
    return (scored.drop("rare").join(gain, "row", "left")
            .select(F.col("id").alias(id_col), "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    F.lit(model.tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score")))


def _class_sizes(model: Model) -> np.ndarray:
    """log10 of each class's tokens plus its types plus one for what was never seen."""
    return np.log10(model.class_tokens + model.class_types + 1.0)


class _Words(dict):
    """(class, log10(count + 1)) of frequent words; (class, None) of the others."""

    def __init__(self, model: Model):
        super().__init__()
        self.classes, self.counts = model.classes, model.counts

    def __missing__(self, word: bytes):
        if len(self) > 600_000:
            self.clear()
        n = self.counts.get(word)
        found = self[word] = (self.classes.of(word), -1.0 if n is None else math.log10(n + 1.0))
        return found


def _score_batches(sent, names: list[str]):
    """Per document: the sums over its words, those that are not frequent as if unseen
    and listed for the join.  Row numbers are the task's, in steps that keep tasks
    apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        model: Model = sent.value
        lookup = _Words(model)
        unseen = -math.log10(model.tokens + model.types + 1.0)
        sizes = _class_sizes(model)
        end = model.classes.end
        # log10 of P(class | context) / class size, by context and class
        table = (model.log_class - sizes[None, :]).astype(np.float32)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 0, CHARS):
            out = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                found = [lookup[w] for w in words]
                c = np.fromiter((x[0] for x in found), dtype=np.int64, count=len(words))
                g = np.fromiter((x[1] for x in found), dtype=np.float64, count=len(words))
                known = g >= 0
                gain = g[known].sum()
                before = np.concatenate([[end, end], c])
                context = before[:-2] * CLASSES + before[1:-1]
                model_sum = table[context, c].sum(dtype=np.float64) + gain
                rare = Counter(words[i] for i in np.flatnonzero(~known).tolist())
                out.append((len(words), int(known.sum()), unseen * len(words) + gain, model_sum,
                            [{"word": w, "n": n} for w, n in rare.items()]))
            cols = list(zip(*out))
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column(1),
                 pa.array([not x for x in batch.column(2).to_pylist()], pa.bool_()),
                 pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()),
                 pa.array(cols[4], pa.list_(pa.struct([("word", pa.binary()),
                                                       ("n", pa.int64())])))], names=names)
            row += n
    return run
