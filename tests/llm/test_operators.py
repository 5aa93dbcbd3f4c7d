"""Every operator against brute force on a small fixture with nulls, empty and long
texts, ties, repeated rows and clashing columns, and on an empty table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spendaudit.llm import (bpe, exact_dedup, fingerprints, lm, mixing, sharding, simhash,
                            token_counts)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, n long"
WORDS = ("amber brook cedar delta ember flint grove haven inlet jetty knoll ledge mesa north "
         "orbit pearl quartz ridge stone thorn umber vale wharf xenon yield zephyr").split()


def sentence(i, k=30):
    return " ".join(WORDS[(i * 7 + j * j + j * i) % len(WORDS)] for j in range(k))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    texts = [None, "", " \n ", "one", "One", sentence(1), sentence(1), sentence(1) + " tail",
             sentence(2) + "\n" + sentence(3), sentence(2) + "\n" + sentence(4),
             "naïve  café\t漢字 😀\n\nx", " ".join(sentence(i) for i in range(60)),
             "a" * 3000, "stop. " * 40]
    out = [(i, t, "en", [None, "b", "a", "c"][i % 4], 0, "k", 1) for i, t in enumerate(texts)]
    out += [(100 + i, sentence(i + 10, 12 + i), None, "b", None, None, None) for i in range(25)]
    out.append(out[5])                                    # a repeated row
    out.append((None, sentence(1), "en", "a", 0, "k", 1))  # no id
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# -- exact dedup
@pytest.mark.parametrize("digest,batch", [(exact_dedup.sha256, 1),
                                          (lambda t: F.substring(F.sha2(t, 256), 1, 1), 1 << 20)])
def test_exact_dedup(docs, rows, digest, batch):
    got = exact_dedup.dedup(docs, digest=digest, batch_bytes=batch).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(-1 if r[0] is None else r[0])
    want = Counter((r[0], max(groups[r[1] or ""]), len(groups[r[1] or ""]), sha(r[1] or ""))
                   for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_rows(docs, rows, no_docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r[1] or "" for r in rows})
    assert exact_dedup.dedup(no_docs).count() == 0


# -- fingerprints
def test_sketch_peels_and_retries():
    rng = np.random.default_rng(1)
    for n in (0, 3, 40, 400):
        a = [int(x) for x in rng.integers(0, 1 << 63, n + 20)]
        b = a[:20] + [int(x) for x in rng.integers(0, 1 << 63, n)]
        left, right = fingerprints.difference(a, b)
        assert set(left) == set(a) - set(b) and set(right) == set(b) - set(a)
    s = fingerprints.Sketch(24, a)
    assert fingerprints.Sketch.from_text(s.to_text()).keys == s.keys


def test_one_line_and_repetitive_texts_keep_likeness():
    """An edit of the last third leaves about two thirds of the digests."""
    following = " ".join(f"other{i}" for i in range(3000))
    long_line = " ".join(f"word{i * i % 977}" for i in range(2000))
    for text in (sentence(1, 10), sentence(2), sentence(3, 60), long_line, "Shti " * 400,
                 "Shti" * 400, "x" * 5000, "".join(chr(0x4e00 + i * i % 997) for i in range(300)),
                 " ".join(["Shti"] * 100) + "\n" + sentence(4)):
        edited = fingerprints.edited_text(text, following)
        a, b = fingerprints.digests(text), fingerprints.digests(edited)
        near = fingerprints.likeness(a, b, fingerprints.Sketch(24, a), fingerprints.Sketch(24, b))
        assert 0.5 <= near <= 0.9, (text[:30], near)
    for text in (sentence(5, 40), "  a  b\tc ", " ", "x" * 40):   # nothing is lost
        assert "".join("".join(fingerprints.passages(text)).split()) == "".join(text.split())
    assert fingerprints.digests("a  b") != fingerprints.digests("a b")


@pytest.mark.parametrize("per_range", [3, 2048])
def test_neighbour_fingerprints(docs, rows, no_docs, per_range):
    got = fingerprints.neighbour_fingerprints(docs.where("doc_id <> 5"), rows_per_range=per_range)
    order = sorted((r for r in rows if r[0] not in (None, 5)), key=lambda r: -r[0])
    texts = [r[1] or "" for r in order]
    want = {}
    for i, t in enumerate(texts):
        k, nxt = len(t) // 3, texts[(i + 1) % len(texts)]
        edited = t[:len(t) - k] + nxt[:k]
        a, b, c = (Counter(fingerprints.digests(x)) for x in (t, edited, nxt))

        def near(x, y):
            both = sum(x.values()) + sum(y.values())
            return 2 * sum((x & y).values()) / both if both else 1.0
        want[order[i][0]] = (len(t), sha(edited), near(a, b), near(a, c))
    found = {r.doc_id: r for r in got.collect()}
    assert found.keys() == want.keys()
    for i, (n, e, x, y) in want.items():
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (n, e)
        assert abs(r.near_edited - x) < 1e-9 and abs(r.near_next - y) < 1e-9
    assert fingerprints.neighbour_fingerprints(docs).count() == len(rows)
    assert fingerprints.neighbour_fingerprints(no_docs).count() == 0


def test_documents_of_many_passages_are_sketched_a_few_at_a_time(monkeypatch):
    """What a worker sketches together is bounded by passages and characters, not only by
    documents, and the rows do not depend on it."""
    import pyarrow as pa
    texts = [" ".join(f"w{(i + 1) * j % 997}" for j in range(1500)) for i in range(300)]
    batch = pa.RecordBatch.from_pydict({
        "id": pa.array(range(300, 0, -1), pa.int64()), "text": texts,
        "p": pa.array([0] * 300, pa.int32()), "tail": [False] * 300})
    made, plain = [], fingerprints._to_batch

    def to_batch(id_col, pairs):
        made.append((sum(len(row[3]) for _, row in pairs), sum(len(row[2]) for _, row in pairs)))
        return plain(id_col, pairs)
    monkeypatch.setattr(fingerprints, "_to_batch", to_batch)

    def run():
        return pa.Table.from_batches(list(fingerprints._stream_pairs("doc_id")(iter([batch])))
                                     ).to_pylist()
    got = run()[:299]
    most = max(len(fingerprints.digests(t)) for t in texts)
    assert sum(n for n, _ in made) > fingerprints.MANY_KEYS + most
    assert max(n for n, _ in made) <= fingerprints.MANY_KEYS + most
    monkeypatch.setattr(fingerprints, "MANY_KEYS", 1 << 60)
    monkeypatch.setattr(fingerprints, "CHARS", 50_000)
    made.clear()
    assert run()[:299] == got
    assert max(n for _, n in made) <= 50_000 + max(map(len, texts))


def test_id_ranges_take_one_python_step(docs):
    plan = fingerprints.neighbour_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_id_ranges_are_dealt_one_to_a_task(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    got = fingerprints.neighbour_fingerprints(docs, rows_per_range=100)
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 4000 and max(per_task) < 200   # ranges are 100 rows, give or take


# -- token counts
def test_token_counts(docs, rows, no_docs):
    enc = token_counts.encoder(token_counts.tokenizer_path())
    want = Counter((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in rows)
    for block in (7, 1 << 16):
        got = token_counts.token_counts(docs, block_tokens=block).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(no_docs).count() == 0


def test_scan_of_flat_files(spark, tmp_path):
    flat = np.array([5, 6, 0, 0, 7, 8, 9, 10, 11, 0, 12], dtype="<u2")
    (tmp_path / "shard.bin").write_bytes(flat.tobytes())
    blocks = token_counts.read_flat_files(spark, str(tmp_path), block_tokens=3)
    got = token_counts.separator_scan(blocks, separator=0).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n_tokens) for r in got] == [(0, 2), (1, 0), (2, 5), (3, 1)]


# -- mixing
def fill(sizes, weights, share=1.5, repeats=2):
    """Targets by resharing the excess until none is above its cap."""
    total, target, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        part = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if part[i] > repeats * sizes[i]]
        if not over:
            for i in free:
                target[i] = part[i]
            break
        for i in over:
            target[i] = repeats * sizes[i]
        free -= set(over)
    return target


def test_mixing(docs, rows, no_docs):
    got = mixing.mix(docs, block_words=16, levels=2).collect()
    words = [len((r[1] or "").encode().split()) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, words):
        sizes[r[3]] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(names, fill([sizes[s] for s in names], [3, 1, 2, 3])))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted(
        (r[0] or -1, n) for r, n in zip(rows, words))
    taken = Counter()
    source = {r[0]: r[3] for r in rows}
    shards = Counter()
    for r in got:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-5
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(d["words"] for d in r.draws)
        taken[source[r.doc_id]] += r.taken
        shards.update(d["shard"] for d in r.draws)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert set(shards) <= {0, 1, 2, 3}
    again = mixing.mix(docs.repartition(5), block_words=16, levels=2).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(no_docs).count() == 0


def test_splitting_tree(spark):
    blocks = spark.createDataFrame([(1, 40), (2, 7), (3, 100)], "rank int, blocks long")
    got = mixing.split_blocks(blocks, levels=3, seed=9).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r["rank"]] += r["count"]
        by_shard[r["shard"]] += r["count"]
    assert by_source == {1: 40, 2: 7, 3: 100} and set(by_shard.values()) <= {18, 19}


def test_hypergeometric_inverts_the_distribution(spark):
    from math import comb
    total, marked, drawn = 30, 12, 10
    p = [comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn)
         for k in range(drawn + 1)]
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    lit = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    got = Counter(r[0] for r in u.select(mixing.hypergeometric(F.col("u"), *lit)).collect())
    assert all(abs(got[k] / 4000 - p[k]) < 1e-3 for k in range(drawn + 1))


# -- SimHash
def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = ([b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words
                else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, bits):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, i in zip(label, ids):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


@pytest.mark.parametrize("bits,cell", [(4, 2048), (6, 3)])
def test_simhash(docs, rows, no_docs, bits, cell):
    fps = [brute_fingerprint(r[1] or "") for r in rows]
    comp = brute_components(fps, [r[0] for r in rows], bits)
    got = simhash.near_duplicates(docs, max_bits=bits, cell_rows=cell).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        (r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp))
    if bits == 4:
        kept = simhash.drop_near_duplicates(docs)
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in comp})
        assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("cell", [2048, 20])
def test_simhash_links_of_dense_fingerprints(spark, cell):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6)
    fps = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) ^ (1 << int(z))
           for b in base for x, y, z in rng.integers(0, 60, (25, 3))}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    links = simhash.near_links(frame, 4, cell)
    from spendaudit.llm.components import components
    root = {r.node: r.root for r in components(links).collect()}
    got = [root.get(f, f) for f in fps]
    assert got == brute_components(fps, fps, 4)
    a = np.array(fps)
    d = simhash.manhattan(simhash.popcounts(a)[:, None], simhash.popcounts(a)[None, :])
    assert (d <= np.bitwise_count(a[:, None] ^ a[None, :])).all()


# -- sharding
def test_permutation():
    for n in (1, 2, 3, 7, 64, 100, 1000):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permute(p, n, forward=False).tolist() == list(range(n))
        shard, slot = sharding.locate(np.arange(n), n)
        assert sharding.row_at(shard, slot, n).tolist() == list(range(n))


def test_shard(docs, rows, no_docs):
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        p = sharding.permute(np.array([r.row_number]), len(rows))[0]
        assert (r.shard, r.slot) == (p % 16, p // 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard(no_docs).count() == 0


# -- language model
def test_lm(docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (12,))  # most words take the join
    train = lambda c: F.crc32(c.cast("string")) % 7 != 2
    got = lm.score(docs, train, steps=30).collect()
    learns = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    tokens = [lm.words_of(r[1] or "") for r in rows]
    c = Counter(w for t, x in zip(tokens, learns) if x for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], not x, len(t), sum(c[w] > 0 for w in t), n, round(
        sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))
        for r, x, t in zip(rows, learns, tokens))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score(no_docs, train, steps=5).count() == 0


def test_lm_is_normalised(docs):
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = lm.word_counts(texts)
    m = lm.fit(texts, counts, steps=30)
    assert np.allclose((10.0 ** m.log_class.astype(float)).sum(axis=1), 1, atol=1e-4)
    size = 10 ** lm._class_sizes(m)
    inside = Counter()
    for r in counts.collect():
        inside[m.classes.of(bytes(r["word"]))] += r["n"] + 1
    assert all(abs((inside[k] + 1) / size[k] - 1) < 1e-9 for k in inside)  # + 1: the unseen


# -- BPE
def test_bpe(docs, rows, no_docs):
    import public_tokenizers
    enc = token_counts.encoder(public_tokenizers.path(bpe.TOKENIZER))
    want = Counter()
    for r in rows:
        ids = np.array(enc.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()
        want[(r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), sha(r[1] or ""))] += 1
    got = bpe.encode_decode(docs, with_ids=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.round_trip for r in got)
    assert bpe.encode_decode(no_docs).count() == 0


def test_bpe_odd_texts():
    import random

    import public_tokenizers
    path = public_tokenizers.path(bpe.TOKENIZER)
    enc, c = token_counts.encoder(path), bpe.codec(path, public_tokenizers.PATTERN)
    random.seed(5)
    letters = "ab \n\t\x0b\x1c\x85\xa0　.,'sé9漢😀\x00  "
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40)))
             for _ in range(500)]
    texts += ["aab" * 900, "ab" * 400, "ACGT" * 600, "a" * 5000, " " * 700 + "x", "=-" * 300]
    ids = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert c.decode(ids) == [t.encode() for t in texts]


def test_bpe_pieces_advance_together():
    """A step contracts a pair in every piece: the pair lookups follow from the length of the
    longest piece, not from how many there are.  Lengths on both sides of LONG_PIECE."""
    import random

    import public_tokenizers
    path = public_tokenizers.path(bpe.TOKENIZER)
    enc, c = token_counts.encoder(path), bpe.Codec(path, public_tokenizers.PATTERN)
    looked = []
    rank, c._rank = c._rank, lambda a, b: looked.append(len(a)) or rank(a, b)
    random.seed(12)
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 20)))
             for _ in range(5000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in c._contract([w.encode() for w in words])] \
        == [enc.encode_ordinary(w) for w in words]
    assert 0 < len(looked) <= 2 * 20
    for n in (1, 2, 3, *range(bpe.LONG_PIECE - 2, bpe.LONG_PIECE + 3), 1000):
        for letters in ("a", "ab", "acgt", "é漢a"):
            w = "".join(random.choice(letters) for _ in range(n))
            assert [np.frombuffer(x, "<u4").tolist() for x in c.encode([w, " " + w])] \
                == [enc.encode_ordinary(w), enc.encode_ordinary(" " + w)], w
    assert c.encode([]) == [] and c.encode([""]) == [b""] and c._contract([]) == []


def test_bpe_worker_keeps_nothing_of_past_texts():
    """What a worker holds between slices of text does not grow with the words it has seen."""
    import gc
    import random
    import tracemalloc

    import public_tokenizers
    c = bpe.Codec(public_tokenizers.path(bpe.TOKENIZER), public_tokenizers.PATTERN)
    random.seed(13)
    slices = [[" ".join("".join(random.choices("abcdefghijklmnop", k=9)) for _ in range(2000))
               for _ in range(10)] for _ in range(3)]
    c.encode(slices[0])
    gc.collect()
    tracemalloc.start()
    try:
        for texts in slices:
            c.encode(texts)
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 2_000_000


def test_bpe_ids_without_the_decoded_text(docs):
    both = bpe.encode_decode(docs, with_ids=True)
    ids = bpe.encode_decode(docs, with_ids=True, with_decoded=False)
    assert both.columns[-2:] == ["ids", "decoded"] and ids.columns == both.columns[:-1]
    assert Counter(map(tuple, ids.collect())) == Counter(map(tuple, both.drop("decoded").collect()))


def test_pipeline_encodes_without_sending_the_decoded_text(spark, docs):
    """The last stage's UDF itself returns what the stage returns: a decoded text that is
    dropped afterwards would pass through the executor's memory all the same."""
    import corpus_pipeline
    plan = corpus_pipeline.encode(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "decoded#" not in plan


def test_bpe_decoding_across_queries(monkeypatch):
    """A sequence cut by the size of a decoding query is put together again, also inside a
    character, and empty sequences keep their place."""
    import public_tokenizers
    c = bpe.codec(public_tokenizers.path(bpe.TOKENIZER), public_tokenizers.PATTERN)
    texts = ["", "naïve 日本語 🙂\x00 text", "", "a b  c\n\n" * 9, ""]
    ids = c.encode(texts)
    for size in (1, 2, 7, 1_000_000):
        monkeypatch.setattr(bpe, "QUERY_IDS", size)
        assert c.decode(ids) == [t.encode() for t in texts]
        assert c.decode([]) == [] and c.decode([b""]) == [b""]
