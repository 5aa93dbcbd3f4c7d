"""Whitening, the quality classifier and the Merkle manifest against brute force."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendaudit.llm import merkle, quality, queries, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree long"
SMALL = "/root/testdata/sf0.001"


# -- Merkle manifest
def H(s):
    return sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    """Rows as (doc_id, text, lang, source, n_chars)."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, delivered=False):
        text = r[1].replace("\n", "") if delivered and r[1] is not None else r[1]
        return H("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            run = i // 3 * 3
            yield nodes[run:i], nodes[i + 1:run + 3]
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in by[s]]) for s in order]
    top = tree([t[-1][0] for t in trees])
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = [*path(trees[k], i), *path(top, k)]
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0)
            for left, right in steps:
                now = H("".join(left) + now + "".join(right))
            yield (r[0], leaf(r), trees[k][-1][0], top[-1][0],
                   H("".join(x for a, b in steps for x in a + b)), now, now == top[-1][0])


def fixture_rows():
    sources = [None, "b", "é", "", "z"]
    rows = [(i if i % 7 else None, None if i % 5 == 0 else "a\nb" * (i % 3), "en",
             sources[min(4, i % 13)], i, "clash", 1) for i in range(300)]
    return rows + rows[:30] + [(9, "x\n" * 100000, None, "only", None, None, None)]


def test_manifest_equals_brute_force(spark):
    rows = fixture_rows()
    got = merkle.prove(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(
        [r[:5] for r in rows])))
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_the_documents(spark):
    docs = queries.documents(spark, SMALL)
    want = sorted(brute_manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars)
                                  for r in docs.collect()]))
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, SMALL).collect())) == want


def test_only_every_fourth_level_is_stored(spark):
    rows = (spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"),
                                     F.sha2(F.col("id").cast("string"), 256).alias("digest")))
    m = merkle.build(rows)
    assert [x.count() for x in m.trees.levels] == [1000, 13, 1]
    root = m.root
    ids = merkle.with_paths(m, "id long, ok boolean", lambda x, path, top: (
        x["doc_id"], merkle.fold(x["digest"], path) == root and len(path) == 7))
    assert ids.where("ok").select("id").distinct().count() == 1000


def test_manifest_of_one_row_and_of_none(spark):
    none = spark.createDataFrame([(None,) * 7], DOCS)
    (r,) = merkle.prove(none).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == H("-----") and r.verified
    assert r.proof_sha256 == H("")
    empty = merkle.prove(none.limit(0))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


# -- whitening
def brute_whitening(vectors, components):
    x = np.floor(64 * np.array(vectors, float)).astype(object) + 1000000
    n, sums = len(x), x.sum(axis=0)
    c = ((n * x - sums) / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1][:, :components]
    return ((n * x - sums) ** 2).sum(axis=1), c @ u, e


def same_up_to_sign(got, want, scale):
    want = want / scale
    return np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9


@pytest.mark.parametrize("size", [None, 7])
def test_whitening_equals_brute_force(spark, monkeypatch, size):
    if size:  # many blocks, the last one not full
        monkeypatch.setattr(whitening, "BLOCK_ROWS", size)
        monkeypatch.setattr(whitening, "BLOCK_BYTES", 1)
    rng = np.random.default_rng(3)
    kept = (rng.standard_normal((60, 5)) * [3, 2, 1, .5, .2]).astype(np.float32).tolist()
    kept += kept[:4]
    rows = [(i, v, i) for i, v in enumerate(kept)]
    rows += [(100, None, 0), (101, [1.0, None, 0.0, 0.0, 0.0], 0),
             (102, [float("nan")] * 5, 0), (103, [float("-inf"), 0.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, at long").repartition(3)
    got = sorted(whitening.whiten(df, components=4).collect(), key=lambda r: r.vec_id)
    deviation, c, e = brute_whitening(kept, 4)
    assert [r.vec_id for r in got] == list(range(64)) and {r.n for r in got} == {64}
    assert [int(r.deviation) for r in got] == deviation.tolist()
    assert same_up_to_sign(np.array([r.whitened for r in got]), c, np.sqrt(e[:4]))
    assert np.allclose(got[0].explained, e[:4] / e.sum(), rtol=1e-10)
    assert got[0].identity_error < 1e-9


def test_whitening_query(spark):
    got = queries.op11_embedding_whitening(spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, c, e = brute_whitening([r.embedding for r in rows], 32)
    got = sorted(got.collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 32 * len(rows) and {r.component for r in got} == set(range(1, 33))
    assert [r.deviation for r in got[::32]] == deviation.tolist()
    white = np.array([r.whitened for r in got]).reshape(-1, 32)
    assert same_up_to_sign(white, c, np.sqrt(e[:32]))


def test_whitening_without_extent_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 2.0]), (1, [2.0, 2.0])],
                               "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 3 and all(len(r.whitened) == 2 and r.whitened[1] is None for r in got)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], df.schema)).collect() == []
    assert len(whitening.whiten(df.unionByName(spark.createDataFrame([(4, [])], df.schema))).collect()) == 3
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema))


# -- quality classifier
def brute_votes(model, text):
    z = quality.weighted(quality.terms(text)[None], model.idf) @ model.axes
    z = z[0] / max(np.linalg.norm(z), 1e-9)
    near = sorted(((float(z @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
    last = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
    votes = [(max(s, 0) ** quality.SHARPNESS, y) for s, y in near if s >= last - 1e-6]
    return sum(w * y for w, y in votes) / sum(w for w, _ in votes)


def test_quality_votes_equal_brute_force_and_hold_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.learn(docs, labels, queries._train_labelled)
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = queries.op12_quality_classifier(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    for r in got[::10]:
        assert abs(r.score - brute_votes(model, texts[r.doc_id] or "")) < 1e-3
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_quality_terms_of_pieces_are_those_of_the_whole(monkeypatch):
    random.seed(5)
    text = " ".join(random.choice(["Ab", "cd.", "#x", "漢字", "no\n", "no"]) for _ in range(3000))
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "PIECE", 50)
    assert np.allclose(quality.terms(text), whole, rtol=1e-6)


def test_quality_odd_tables(spark):
    rows = [(1, "Good words here, plain ones."), (2, "### !!! ||| $$$"), (3, None), (4, ""),
            (None, "x" * 300000), (1, "Good words here, plain ones.")]
    docs = spark.createDataFrame([(*r, "score") for r in rows],
                                 "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)],
                                   "doc_id long, quality int")
    everyone = lambda c: F.lit(True)
    model = quality.learn(docs, labels, everyone)
    assert len(model.labels) == 2
    got = quality.with_score(docs, model).collect()
    assert len(got) == 6 and got[0].quality_score == got[5].quality_score > 0.5
    assert got[1].quality_score < 0.5 and got[2].quality_score == got[3].quality_score
    assert quality.with_score(docs.limit(0), model).collect() == []
    nobody = quality.learn(docs, labels.limit(0), everyone)
    assert {r.quality_score for r in quality.with_score(docs, nobody).collect()} == {0.5}


# -- byte-level BPE: long words, exact matches
def test_bpe_long_words_by_chunks_and_windows(monkeypatch):
    """Words far beyond one query, against the tokenizer library: mixed letters, runs of one
    letter (where the repair spreads), periodic and multi-byte words."""
    import public_tokenizers

    from spendaudit.llm import bpe, token_counts
    path = public_tokenizers.path(bpe.TOKENIZER)
    enc, c = token_counts.encoder(path), bpe.codec(path, public_tokenizers.PATTERN)
    for name, v in (("LONG_PIECE", 30), ("WINDOW", 40), ("TAIL", 2)):
        monkeypatch.setattr(bpe, name, v)
    random.seed(6)
    words = [" " + "a" * 301, "hab" * 90, "漢字é" * 40]
    words += ["".join(random.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(250))
              for k in (2, 3, 26)]
    for spread in (60, 4096):
        monkeypatch.setattr(bpe, "SPREAD", spread)
        for w in words:
            (ids,) = c._merge([w])
            assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(w), w


def test_bpe_of_a_word_of_megabytes(spark):
    from spendaudit.llm import bpe
    rows = [(1, "x" * 4_000_000), (2, "tail"), (3, None)]
    got = {r.doc_id: r for r in bpe.encode_decode(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].round_trip and got[1].n_tokens < 4_000_000 and got[3].n_tokens == 0
    assert got[1].decoded_sha256 == H("x" * 4_000_000)


def test_bpe_pieces_are_the_matches_of_the_pattern():
    import public_tokenizers
    import regex

    from spendaudit.llm import bpe
    c = bpe.codec(public_tokenizers.path(bpe.TOKENIZER), public_tokenizers.PATTERN)
    pattern = regex.compile(public_tokenizers.PATTERN)
    random.seed(8)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\r\n", " ", "12", ".", "!?", "é", "漢", "'s"]
    for _ in range(5000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert [p for s in bpe._segments(t) for p in c._pieces(s)] == pattern.findall(t), repr(t)


# -- main text: the whole article, with weights learned from pages
@pytest.fixture(scope="module")
def page_weights(spark):
    from spendaudit.llm import html_extract
    return html_extract.learn_weights(spark.read.parquet(f"{SMALL}/pages.parquet"))


def page(body):
    return ("<html><body><nav><ul><li><a href='/'>home</a></li><li>about us</li></ul></nav>"
            f"<div class='ad'>buy things here</div>{body}<footer>imprint and more</footer></body></html>")


@pytest.mark.parametrize("body,want", [
    ("<article><p>First words.</p><ul><li>item one</li><li>item two</li></ul><p>last</p></article>",
     "First words.\nitem one\nitem two\nlast"),
    ("<article><p>First words.</p><aside>one two three four five six seven eight nine ten</aside>"
     "<p>last bit</p></article>", "First words.\nlast bit"),
    ("<article><p>First words.</p><p class='share price'>The share price rose.</p>"
     "<p class='ad'>buy this</p></article>", "First words.\nThe share price rose."),
    ("<article><p>First <span class='ad'>buy now</span> words.</p><table><tr><td>cell</td></tr>"
     "</table></article>", "First words.\ncell"),
    ("<div class='legal-post'><article><p>First words.</p><ol><li>a</li></ol></article></div>",
     "First words.\na")])
def test_the_whole_article_is_kept(page_weights, body, want):
    from spendaudit.llm import html_extract
    assert html_extract.extract(page(body), page_weights) == want


def test_a_page_without_tags_is_text(page_weights):
    from spendaudit.llm import html_extract
    assert html_extract.extract("only text,\n no tags", page_weights) == "only text, no tags"


def test_small_trees_against_brute_force(page_weights):
    """Random articles of nested blocks, some of them boilerplate: the text is that of the
    blocks outside of boilerplate, in order."""
    from spendaudit.llm import html_extract
    rng = random.Random(9)
    noise = ["<aside>{}</aside>", "<form>{}</form>", "<div class='ad'>{}</div>",
             "<section class='comments'>{}</section>", "<nav>{}</nav>", "<footer>{}</footer>"]
    keep = ["<div>{}</div>", "<section>{}</section>", "<ul><li>{}</li></ul>",
            "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>"]
    count = iter(range(10 ** 6))

    def node(depth, kept):
        """(html, kept texts)"""
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            text = " ".join(f"w{next(count)}" for _ in range(rng.randint(1, 6)))
            return f"<p>{text}</p>", [text] if kept else []
        shape = rng.choice(noise if kind < 0.55 else keep)
        inside = [node(depth - 1, kept and shape not in noise) for _ in range(rng.randint(1, 3))]
        return shape.format("".join(h for h, _ in inside)), [t for _, ts in inside for t in ts]

    for _ in range(300):
        parts = [node(3, True) for _ in range(rng.randint(1, 4))]
        html = page("<article>" + "".join(h for h, _ in parts) + "</article>")
        want = [t for _, ts in parts for t in ts]
        assert html_extract.extract(html, page_weights) == "\n".join(want), html
