"""Byte-level BPE encoding and decoding in Arrow and numpy over the rows of each partition.

The texts of a slice are cut into segments and these into pre-token pieces; each distinct
piece is encoded once.  Pieces of as many tokens are the rows of one matrix: a step contracts
the leftmost pair of minimum rank in every row and looks up the two pairs this makes, and
rows without a pair that merges are done.  Long pieces take their pairs from a heap instead.
The ids of pieces, segments and texts follow by index; decoding takes the bytes of every id
from the vocabulary in turn.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, slices, whole_text

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
LONG_PIECE = 192       # bytes; longer pieces take their pairs from a heap
WINDOW = 1 << 17       # bytes; longer pieces still are encoded window by window
TAIL = 64              # tokens before a window that are encoded again with it
SPREAD = 4096          # bytes around a boundary that are encoded again at most
CHARS = 4_000_000      # bytes of text a worker takes up at a time
QUERY_BYTES = 500_000  # bytes of pieces contracted together
QUERY_IDS = 1_000_000  # ids decoded together
NONE = np.iinfo(np.int32).max  # rank of a pair that does not merge


def merge_rows(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, r): tokens a and b next to each other, key ``a << 32 | b``, merge to r.  Keys
    ascend."""
    keys, r = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            x, y = ranks.get(token[:i]), ranks.get(token[i:])
            if x is not None and y is not None:
                keys.append(x << 32 | y), r.append(rank)
    keys, r = np.array(keys, dtype=np.int64), np.array(r, dtype=np.int32)
    order = np.argsort(keys)
    return keys[order], r[order]


class Codec:
    """Encoder and decoder of one worker over a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.plain = pattern == public_tokenizers.PATTERN   # letter runs are pieces there
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.whole = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.keys, self.ranks = merge_rows(ranks)
        self.vocab = pa.array([self.bytes.get(r, b"") for r in range(max(ranks.values()) + 1)],
                              pa.large_binary())
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.first = self._rank(self.byte[a], self.byte[b]).reshape(256, 256)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What tokens a and b next to each other merge to, or NONE."""
        if not len(self.keys):
            return np.full(len(a), NONE, dtype=np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    # -- encoding ---------------------------------------------------------------
    def _pieces(self, segment: str) -> list[str]:
        """Matches of the pattern; a word, alone or with one mark after it, needs no search."""
        core = segment[1:] if segment[0] == " " else segment
        if not core or not self.plain:
            return self.find(segment)
        if core.isalpha():
            return [segment]
        if core[-1] in ".,;:!?" and core[:-1].isalpha():
            return [segment[:-1], segment[-1]]
        return self.find(segment)

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of pieces; one that is a token has its id."""
        raw = [p.encode() for p in pieces]
        out, rest = [b""] * len(raw), []
        for i, rank in enumerate(map(self.whole.get, raw)):
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(raw[i]) <= WINDOW:
                rest.append(i)
            else:
                out[i] = np.array(self._long_piece(raw[i]), dtype="<u4").tobytes()
        for i, ids in zip(rest, self._contract([raw[i] for i in rest])):
            out[i] = ids
        return out

    def _long_piece(self, raw: bytes) -> list[int]:
        """Ids of a piece of any length, in memory that does not grow with its query.

        Ids are those of the whole piece if every two neighbours are the ids of their joint
        bytes: a merge across a boundary would show in the two tokens beside it.  So the
        piece is encoded in short chunks, all in one query, and where two chunks do not fit,
        the tokens around their boundary are encoded again, more of them in each round.
        Should that spread (as in a long run of one letter), the piece is encoded from left
        to right instead.
        """
        chunks = [raw[i:i + LONG_PIECE] for i in range(0, len(raw), LONG_PIECE)]
        parts = [_ids(x) for x in self._contract(chunks)]
        k = 4
        while True:
            fit = self._fits([(x[-1], y[0]) for x, y in zip(parts, parts[1:])])
            bad = [i for i, ok in enumerate(fit) if not ok]
            if not bad:
                return [t for part in parts for t in part]
            runs = []  # first and last of the parts that bad boundaries join
            for i in bad:
                if runs and runs[-1][1] == i:
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1])
            again = [self._text(parts[i][-k:] + [t for p in parts[i + 1:j] for t in p]
                                + parts[j][:k]) for i, j in runs]
            if max(map(len, again)) > SPREAD:
                return self._by_windows(raw)
            new, at = [], 0
            for (i, j), ids in zip(runs, self._contract(again)):
                new += [*parts[at:i], parts[i][:-k], _ids(ids), parts[j][k:]]
                at = j + 1
            parts = [p for p in new + parts[at:] if p]
            k *= 2

    def _by_windows(self, raw: bytes) -> list[int]:
        """The same from left to right: each window is encoded together with the last TAIL
        tokens before it; if the new first token does not fit the token left of it, more
        tokens are taken back, up to all."""
        done: list[int] = []
        for at in range(0, len(raw), WINDOW):
            step, back = raw[at:at + WINDOW], TAIL
            while True:
                k = min(back, len(done))
                ids = _ids(self._contract([self._text(done[len(done) - k:]) + step])[0])
                if k == len(done) or self._fits([(done[-k - 1], ids[0])])[0]:
                    break
                back *= 4
            done[len(done) - k:] = ids
        return done

    def _text(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[t] for t in ids])

    def _fits(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether the joint bytes of two tokens are encoded as these two."""
        new = list(set(pairs))
        ids = self._contract([self._text(list(p)) for p in new])
        fit = {p: _ids(x) == list(p) for p, x in zip(new, ids)}
        return [fit[p] for p in pairs]

    def _contract(self, raw: list[bytes]) -> list[bytes]:
        """Ids of byte strings, each contracted until no pair merges."""
        out: list[bytes] = [b""] * len(raw)
        part, size = [], 0
        for i, x in enumerate(raw):
            if len(x) > LONG_PIECE:
                out[i] = self._by_heap(x)
                continue
            part.append(i)
            size += len(x)
            if size >= QUERY_BYTES:
                self._put(out, part, raw)
                part, size = [], 0
        self._put(out, part, raw)
        return out

    def _put(self, out: list[bytes], part: list[int], raw: list[bytes]) -> None:
        for i, ids in zip(part, self._by_steps([raw[i] for i in part])):
            out[i] = ids

    def _by_steps(self, raw: list[bytes]) -> list[bytes]:
        """Short strings together.  Each step takes one token off every row, so rows of as
        many tokens, whether contracted to them or as many bytes long, form one matrix."""
        out: list[bytes] = [b""] * len(raw)
        lengths = np.array([len(x) for x in raw], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        joint = np.frombuffer(b"".join([raw[i] for i in order]), dtype=np.uint8)
        widest = int(lengths.max(initial=0))
        firsts = np.searchsorted(lengths[order], np.arange(widest + 2))
        ends = np.append(0, np.cumsum(lengths[order]))
        which = np.empty(0, dtype=np.int64)   # the string of each row
        toks = np.empty((0, widest), dtype=np.int32)
        pairs = np.empty((0, max(widest - 1, 0)), dtype=np.int32)
        for width in range(widest, 0, -1):
            i, j = firsts[width], firsts[width + 1]
            if i < j:
                text = joint[ends[i]:ends[j]].reshape(-1, width)
                which = np.concatenate([which, order[i:j]])
                toks = np.concatenate([toks, self.byte[text]])
                pairs = np.concatenate([pairs, self.first[text[:, :-1], text[:, 1:]]])
            if not len(which):
                toks, pairs = toks[:, 1:], pairs[:, 1:]
                continue
            if width > 1:
                at = pairs.argmin(axis=1)
                least = pairs[np.arange(len(at)), at]
                done = least == NONE
            else:
                done = np.ones(len(which), dtype=bool)
            flat = toks[done].astype("<u4").tobytes()
            for k, i in enumerate(which[done].tolist()):
                out[i] = flat[4 * width * k:4 * width * (k + 1)]
            if width == 1:
                break
            which, toks, pairs, at, least = (x[~done] for x in (which, toks, pairs, at, least))
            rows = np.arange(len(which))
            toks[rows, at] = least
            toks = _without(toks, at + 1)
            pairs = _without(pairs, np.minimum(at + 1, width - 2))
            left, right = rows[at > 0], rows[at < width - 2]
            pairs[left, at[left] - 1] = self._rank(toks[left, at[left] - 1], least[left])
            pairs[right, at[right]] = self._rank(least[right], toks[right, at[right] + 1])
        return out

    def _by_heap(self, raw: bytes) -> bytes:
        """One long string: its pairs wait in a heap by rank and place."""
        rank, n = self.whole.get, len(raw)
        before = list(range(-1, n))       # start of the token left of the one at a place
        after = [*range(1, n + 1), -1]    # its end, -1 where no token starts any more
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            mid = after[i]
            if mid < 0 or after[mid] != end:
                continue                  # a token of the pair has been merged since
            after[i], after[mid], before[end] = end, -1, i
            if i and (r := rank(raw[before[i]:end])) is not None:
                heappush(heap, (r, before[i], end))
            if end < n and (r := rank(raw[i:after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        ids, i = [], 0
        while i < n:
            ids.append(self.whole[raw[i:after[i]]])
            i = after[i]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if _SPACE_AFTER_SPACE.search(t)]
        cut = [_segments(texts[i]) for i in odd]
        ends = np.cumsum([0, *map(len, cut)])
        found = pa.array([s for ss in cut for s in ss], pa.large_string()).dictionary_encode()
        for i, ids in zip(odd, self._texts(found.dictionary.to_pylist(),
                                             found.indices.to_numpy(), ends)):
            out[i] = ids

        rest = sorted(set(range(len(texts))) - set(odd))
        plain = pc.split_pattern(pa.array([texts[i] for i in rest], pa.large_string()), " ")
        ends = plain.offsets.to_numpy()
        found = plain.flatten().dictionary_encode()
        segments = [" " + s for s in found.dictionary.to_pylist()]
        at = found.indices.to_numpy().copy()
        at[ends[:-1]] = len(segments) + np.arange(len(rest))   # no space before a text
        segments += [texts[i].partition(" ")[0] for i in rest]
        for i, ids in zip(rest, self._texts(segments, at, ends)):
            out[i] = ids
        return out

    def _texts(self, segments: list[str], at: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of texts that are ``segments[at]`` cut at ``ends``."""
        cut = [self._pieces(s) if s else [] for s in segments]
        inner = np.cumsum([0, *map(len, cut)])
        found = pa.array([p for ps in cut for p in ps], pa.large_string()).dictionary_encode()
        del cut
        ids = pa.array(self._merge(found.dictionary.to_pylist()), pa.large_binary())
        found = _grouped(ids.take(found.indices), inner)
        return _grouped(found.take(pa.array(at)), ends).to_pylist()

    # -- decoding ---------------------------------------------------------------
    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence, ``QUERY_IDS`` ids at a time."""
        ids = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)
        data, places = [], [np.zeros(1, dtype=np.int64)]
        for first in range(0, len(ids), QUERY_IDS):
            found = self.vocab.take(pa.array(ids[first:first + QUERY_IDS]))
            data.append(_data(found))
            places.append(_offsets(found)[1:] + places[-1][-1])
        text = b"".join(data)
        ends = np.cumsum([0, *(len(x) // 4 for x in encoded)])
        places = np.concatenate(places)[ends].tolist()
        return [text[x:y] for x, y in zip(places, places[1:])]


def _without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``rows`` less the entry at ``at`` of each."""
    keep = np.ones(rows.shape, dtype=bool)
    keep[np.arange(len(rows)), at] = False
    return rows[keep].reshape(len(rows), rows.shape[1] - 1)


def _offsets(rows: pa.LargeBinaryArray) -> np.ndarray:
    """Where each row starts and the last one ends."""
    if not len(rows):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset:rows.offset + len(rows) + 1]


def _data(rows: pa.LargeBinaryArray) -> pa.Buffer:
    """The bytes of all rows."""
    data, places = rows.buffers()[2] or pa.py_buffer(b""), _offsets(rows)
    return data.slice(int(places[0]), int(places[-1] - places[0]))


def _grouped(rows: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The rows between each two ``ends`` put together."""
    places = _offsets(rows)[ends]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(places) - 1,
        [None, pa.py_buffer(places), rows.buffers()[2] or pa.py_buffer(b"")])


def _ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


_SPACE_AFTER_SPACE = regex.compile(r"\s ")


def _segments(text: str) -> list[str]:
    """A text cut where no pre-token reaches across: from a character that is not white
    space to one that is.  If no space follows other white space, cutting before every
    space does that."""
    if not text:
        return []
    if _SPACE_AFTER_SPACE.search(text):
        return regex.findall(r"\s*\S+|\s+", text)
    parts = text.split(" ")
    return [s for s in [parts[0], *(" " + p for p in parts[1:])] if s]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str | None = None, pattern: str | None = None,
                  with_ids: bool = False, with_decoded: bool | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip) of every text, and with
    ``with_ids`` the ids (binary, little-endian unsigned 32-bit) and the decoded text, the
    latter unless ``with_decoded`` is False.

    NULL and empty texts have no tokens.  Whole texts are encoded, each match of the
    pattern by itself, without special tokens.  A match of any length is encoded whole, in
    windows beyond WINDOW bytes; its time grows with its length, its memory does not but
    for the ids.  Repeated rows give repeated results, other columns are ignored, whatever
    their names, and an empty table gives an empty result.  Rows stay where they are: no
    shuffle.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    pattern = pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("__llm_text"))
    with_decoded = with_ids if with_decoded is None else with_decoded
    extra = [T.StructField("ids", T.BinaryType())] * with_ids
    extra += [T.StructField("decoded", T.StringType())] * with_decoded
    schema = T.StructType([
        rows.schema[0], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType())] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        try:
            yield from encoded(c, batches)
        finally:
            release_memory()

    def encoded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, CHARS):
            texts = batch.column(1).to_pylist()
            ids = c.encode(texts)
            back = c.decode(ids)
            cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    pa.array([x == t.encode() for x, t in zip(back, texts)], pa.bool_())]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
            if with_decoded:
                cols.append(pa.array([x.decode("utf-8", "replace") for x in back], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)
