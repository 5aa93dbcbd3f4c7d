"""Toxicity from a learned lexicon matched by Levenshtein automata.

The lexicon is learned from labelled training documents: words, and stems that many
different words start with, which occur far more often in toxic texts than in clean
ones.  Its entries form a trie.  A word is matched by running the Levenshtein automaton
of the lexicon (states are sets of trie node and edits so far) over it; transitions are
built on first use and kept, so a word costs about one dictionary lookup a letter.  Each
match is looked at in a window of words: inside quotation marks, or after a reporting
verb, it counts as quotation, else as abuse.  A logistic model gives the score: exact and
misspelled matches count together, less a small fixed discount where all are misspelled;
quoted matches count apart.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, whole_text

TRAIN_ROWS = 50_000    # bound of the labelled sample that the model is fitted on
THRESHOLD = 0.7        # predicted toxic from this score on
MAX_EDITS = 1
MIN_FUZZY = 5          # shorter lexicon words must match exactly
MIN_STEM = 4
MIN_CONTEXTS = 4       # distinct neighbourhoods (words) or endings (stems) of an entry
MIN_RATIO = 20.0       # rate among toxic texts over rate among clean texts
WINDOW = 6             # words looked at on each side of a match
CACHE = 400_000        # words whose match a worker remembers
# Characters stripped from the ends of a word, quotation marks that open
# and close, and reporting words before a quotation.
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’‚‹›…¡¿—–"
OPENING = "\"'«„“‘‚‹”"
CLOSING = "\"'»”’›“"
REPORTING = ("said says say wrote writes called calls quote quoted quotes quoting reported "
             "reports term word words slur insult phrase definition means meaning").split()
# Prior mean and precision of the weights (intercept, then the features of
# ``features``): abuse counts, quotation does not count.  The discount of texts without an
# exact match is held near its mean, because clean training texts cannot show it (their
# near forms are taken as words of their own) and few toxic ones do.
PRIOR_MEAN = (-4.0, 4.0, 1.0, 1.0, -0.5, 0.0, 0.0)
PRIOR_PRECISION = (0.05, 0.2, 0.5, 0.5, 100.0, 2.0, 2.0)
NONE, FUZZY, EXACT = 0, 1, 2


class LexiconAutomaton:
    """Levenshtein automaton of all lexicon words at once, made deterministic lazily.

    ``words`` match within ``max_edits`` insertions, deletions, substitutions and swaps of
    adjacent letters (exactly when shorter than ``min_fuzzy``); ``stems`` match every word
    that starts with them.  A state also holds begun swaps: (node after both letters,
    letter still to come).
    """

    def __init__(self, words=(), stems=(), max_edits: int = MAX_EDITS,
                 min_fuzzy: int = MIN_FUZZY, max_states: int = 200_000):
        self.max_edits, self.max_states = max_edits, max_states
        self.children: list[dict[str, int]] = [{}]
        self.word_len: list[int] = [0]      # length of the word ending here, or 0
        self.stem: list[bool] = [False]
        self.min_fuzzy = min_fuzzy
        for w in words:
            self.word_len[self._node(w)] = len(w)
        for s in stems:
            self.stem[self._node(s)] = True
        self._reset()

    def _node(self, w: str) -> int:
        n = 0
        for c in w:
            if c not in self.children[n]:
                self.children[n][c] = len(self.children)
                self.children.append({})
                self.word_len.append(0)
                self.stem.append(False)
            n = self.children[n][c]
        return n

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int | tuple[int, str], int]] = []
        self.accepts: list[int] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int | tuple[int, str], int]) -> int:
        """Id of the state of fewest edits per node, closed under skipped letters."""
        todo = list(nodes.items())
        while todo:
            n, e = todo.pop()
            if e < self.max_edits and not isinstance(n, tuple):
                for ch in self.children[n].values():
                    if nodes.get(ch, self.max_edits + 1) > e + 1:
                        nodes[ch] = e + 1
                        todo.append((ch, e + 1))
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            best = NONE
            for n, e in nodes.items():
                if not isinstance(n, tuple) and self.word_len[n]:
                    if e == 0:
                        best = EXACT
                    elif best == NONE and self.word_len[n] >= self.min_fuzzy:
                        best = FUZZY
            self.accepts.append(best)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        """Next state, or -1 when nothing can match any more, or -2 at an exact stem."""
        out: dict[int | tuple[int, str], int] = {}
        k = self.max_edits
        for n, e in self.sets[state].items():
            if isinstance(n, tuple):
                if n[1] == c and out.get(n[0], k + 1) > e:
                    out[n[0]] = e
                continue
            ch = self.children[n].get(c)
            if ch is not None:
                if e == 0 and self.stem[ch]:
                    return -2
                if out.get(ch, k + 1) > e:
                    out[ch] = e
            if e < k:
                if out.get(n, k + 1) > e + 1:
                    out[n] = e + 1
                for letter, other in self.children[n].items():
                    if out.get(other, k + 1) > e + 1:
                        out[other] = e + 1
                    swapped = self.children[other].get(c)
                    if swapped is not None and letter != c:
                        swap = (swapped, letter)
                        if out.get(swap, k + 1) > e + 1:
                            out[swap] = e + 1
        return self._state(out) if out else -1

    def match(self, word: str) -> int:
        """NONE, FUZZY or EXACT."""
        if len(self.sets) > self.max_states:
            self._reset()
        s = self.start
        for c in word:
            nxt = self.steps[s].get(c)
            if nxt is None:
                nxt = self.steps[s][c] = self._step(s, c)
            if nxt < 0:
                return EXACT if nxt == -2 else NONE
            s = nxt
        return self.accepts[s]


class Matcher(dict):
    """Match kind of raw words (with punctuation), remembered up to CACHE words."""

    def __init__(self, model: "ToxicityModel"):
        super().__init__()
        self.automaton = LexiconAutomaton(model.words, model.stems)
        self.known_clean = model.known_clean

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        word = raw.strip(STRIP)
        kind = self.automaton.match(word) if word else NONE
        if kind == FUZZY and word in self.known_clean:
            kind = NONE
        self[raw] = kind
        return kind


@dataclass
class ToxicityModel:
    """Lexicon (words, stems), near forms that clean training texts use, and weights."""
    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    known_clean: frozenset = frozenset()
    weights: tuple[float, ...] = field(default=PRIOR_MEAN)


def is_quoted(words: list[str], i: int, window: int = WINDOW) -> bool:
    """Whether word ``i`` is quoted rather than used: an opening mark at or shortly
    before it with the closing mark at or shortly after it, or a reporting word within
    the three words before together with a mark on either side."""
    lo, hi = max(0, i - window), min(len(words), i + window + 1)
    opened = False
    for j in range(i, lo - 1, -1):
        if j < i and words[j][-1] in CLOSING and words[j][0] not in OPENING:
            break
        if words[j][0] in OPENING and (j == i or words[j][-1] not in CLOSING
                                       or len(words[j]) == 1):
            opened = True
            break
    closed = any(words[j].rstrip(".,;:!?")[-1:] in CLOSING and words[j].rstrip(".,;:!?")
                 for j in range(i, hi))
    if opened and closed:
        return True
    reported = any(w.strip(STRIP) in REPORTING for w in words[max(0, i - 3):i])
    return reported and (opened or closed)


def hits(text: str, matcher: Matcher) -> tuple[int, int, int, list[str]]:
    """Counts of exact, misspelled and quoted matches, and the misspelled forms."""
    words = text.lower().split()
    kinds = list(map(matcher.__getitem__, words))
    if not any(kinds):
        return 0, 0, 0, []
    exact = fuzzy = quoted = 0
    forms = []
    for i, kind in enumerate(kinds):
        if not kind:
            continue
        if kind == FUZZY:
            forms.append(words[i].strip(STRIP))
        if is_quoted(words, i):
            quoted += 1
        elif kind == EXACT:
            exact += 1
        else:
            fuzzy += 1
    return exact, fuzzy, quoted, forms


def features(exact, fuzzy, quoted) -> np.ndarray:
    """Rows of (1, exact or misspelled >= 1, 2, 3; misspelled only; quoted >= 1, 2)."""
    e, f, q = (np.asarray(v, dtype=np.int64) for v in (exact, fuzzy, quoted))
    n = e + f
    return np.column_stack([np.ones(len(e)), n >= 1, n >= 2, n >= 3, (e == 0) & (f >= 1),
                            q >= 1, q >= 2]).astype(float)


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """MAP logistic weights under the normal prior (Newton steps); ``n`` counts rows."""
    mean, prec = np.array(PRIOR_MEAN), np.array(PRIOR_PRECISION)
    w = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - prec * (w - mean)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(prec)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                   train, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled training documents, chosen by a
    hash of the id; equal texts count once, toxic if any label says so."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col("toxic"))
              .where("id IS NOT NULL AND toxic IS NOT NULL").where(train(F.col("id")))
              .groupBy("id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = (docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
            .join(F.broadcast(chosen), "id"))  # at most max_rows ids
    return (rows.select(F.sha2("text", 256).alias("sha"), "text", "toxic")
            .groupBy("sha").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
            .drop("sha"))


_COUNTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("tox", T.LongType()),
                        T.StructField("clean", T.LongType()),
                        T.StructField("mask", T.LongType())])


def _bit(s: str) -> int:
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return 1 << ((h * 2654435761 & 0xFFFFFFFF) >> 26)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each word and each stem (``stem*``), by class, and for toxic texts 64
    bits of hashed neighbourhoods (words) or endings (stems)."""
    tox, clean, mask = Counter(), Counter(), {}

    def flush():
        keys = list(tox.keys() | clean.keys())
        signed = [m - (1 << 64) if m >> 63 else m for m in (mask.get(k, 0) for k in keys)]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([tox[k] for k in keys], pa.int64()),
             pa.array([clean[k] for k in keys], pa.int64()), pa.array(signed, pa.int64())],
            names=["key", "tox", "clean", "mask"])
        tox.clear(), clean.clear(), mask.clear()
        return batch

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(),
                               batch.column("toxic").to_pylist()):
            words = [w.strip(STRIP) for w in text.lower().split()]
            found = {w for w in words if len(w) >= 3}
            keys = set(found)
            for w in found:
                keys.update(w[:n] + "*" for n in range(MIN_STEM, len(w)))
            (tox if label else clean).update(keys)
            if label:
                for i, w in enumerate(words):
                    if len(w) < 3:
                        continue
                    around = (words[i - 1] if i else "") + "|" + (
                        words[i + 1] if i + 1 < len(words) else "")
                    mask[w] = mask.get(w, 0) | _bit(around)
                    for n in range(MIN_STEM, len(w)):
                        k = w[:n] + "*"
                        mask[k] = mask.get(k, 0) | _bit(w[n:])
        if len(tox) + len(clean) > 1_000_000:
            yield flush()
    if tox or clean:
        yield flush()


def learn_lexicon(train: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, stems) that mark toxic texts: a rate at least MIN_RATIO times that of clean
    texts, and a log-likelihood ratio that chance would not give among all candidates.
    Candidates have MIN_CONTEXTS distinct neighbourhoods (words) or endings (stems), so
    that copies of one text do not make an entry."""
    sizes = train.agg(F.sum("toxic"), F.count("toxic")).first()
    n1 = int(sizes[0] or 0)
    n0 = int(sizes[1]) - n1
    if not n1 or not n0:
        return (), ()
    keys = cut(train.mapInArrow(_count_keys, _COUNTS).groupBy("key")
            .agg(F.sum("tox").alias("a"), F.sum("clean").alias("b"),
                 F.bit_or("mask").alias("mask"))
            .where((F.col("a") > 0) & (F.bit_count("mask") >= MIN_CONTEXTS)))
    m = keys.agg(F.count(F.lit(1))).first()[0]
    if not m:
        return (), ()
    rate = (F.col("a") + F.col("b")) / F.lit(float(n1 + n0))

    def part(k, e):  # k * ln(k / e), 0 at 0
        return F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    llr = part(F.col("a"), rate * n1) + part(F.col("b"), rate * n0)
    ratio = (F.col("a") / n1) / ((F.col("b") + 0.5) / (n0 + 1.0))
    chosen = (keys.where((ratio >= MIN_RATIO) & (llr >= F.lit(math.log(m) + 1)))
              .select("key").collect())
    found = sorted(r["key"] for r in chosen)
    stems: list[str] = []
    for k in found:  # shortest stems first in sorted order; the longer ones add nothing
        if k.endswith("*") and not any(k.startswith(s) for s in stems):
            stems.append(k[:-1])
    return tuple(k for k in found if not k.endswith("*")), tuple(stems)


_HITS = T.StructType([T.StructField("toxic", T.LongType()), T.StructField("exact", T.LongType()),
                      T.StructField("fuzzy", T.LongType()),
                      T.StructField("quoted", T.LongType()),
                      T.StructField("forms", T.ArrayType(T.StringType()))])


def _count_hits(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            rows = [hits(t, matcher) for t in batch.column("text").to_pylist()]
            e, f, q, forms = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int64()), pa.array(e, pa.int64()),
                 pa.array(f, pa.int64()), pa.array(q, pa.int64()),
                 pa.array(forms, pa.list_(pa.string()))],
                names=["toxic", "exact", "fuzzy", "quoted", "forms"])
    return run


def learn(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id",
          text_col: str = "text", max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Model from the labelled documents that ``train`` (Column -> Column) admits, at
    most ``max_rows`` of them.  Without labels of both classes the lexicon is empty and
    every text gets the prior's score."""
    texts = training_texts(docs, labels, id_col, text_col, train, max_rows)
    texts = cut(texts.select("text", F.col("toxic").cast("long").alias("toxic")))
    words, stems = learn_lexicon(texts)
    model = ToxicityModel(words, stems)
    if not words and not stems:
        return model
    # near forms that clean texts use are words of their own, not misspellings
    counted = texts.mapInArrow(_count_hits(model), _HITS)
    forms = (counted.where("toxic = 0").select(F.explode("forms").alias("form")).distinct()
             .collect())  # within MAX_EDITS of a lexicon word, from at most max_rows texts
    model.known_clean = frozenset(r["form"] for r in forms)
    cap = [F.least(F.col(c), F.lit(3)).alias(c) for c in ("exact", "fuzzy", "quoted")]
    table = (texts.mapInArrow(_count_hits(model), _HITS).select("toxic", *cap)
             .groupBy("toxic", "exact", "fuzzy", "quoted").count().collect())
    x = features(*([r[c] for r in table] for c in ("exact", "fuzzy", "quoted")))
    model.weights = tuple(fit_weights(x, np.array([r["toxic"] for r in table], float),
                                      np.array([r["count"] for r in table], float)))
    return model


def with_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
               score_col: str = "score", counts: bool = False) -> DataFrame:
    """``docs`` plus the score of its whole text; NULL and empty texts get the score of a
    text without matches.  ``counts`` adds n_abuse, n_misspelled and n_quoted."""
    extra = ["n_abuse", "n_misspelled", "n_quoted"] if counts else []
    schema = T.StructType(docs.schema.fields + [T.StructField(score_col, T.DoubleType())]
                          + [T.StructField(c, T.LongType()) for c in extra])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        w = np.array(model.weights)
        for batch in batches:
            rows = [hits(t or "", matcher)[:3] for t in batch.column(at).to_pylist()]
            e, f, q = zip(*rows) if rows else ((), (), ())
            score = 1 / (1 + np.exp(-features(e, f, q) @ w))
            more = [pa.array(score, pa.float64())]
            more += [pa.array(v, pa.int64()) for v in (e, f, q)] if counts else []
            yield pa.RecordBatch.from_arrays(list(batch.columns) + more, names=schema.names)

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts that score at least ``threshold``."""
    name = "__llm_toxicity"
    return with_score(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)
