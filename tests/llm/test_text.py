"""Toxicity, main-text extraction, and the pipeline."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendaudit.llm import html_extract, queries, toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    random.seed(2)
    lexicon = ["idiot", "moron", "trash", "scum", "worthless"]
    auto = toxicity.LexiconAutomaton(lexicon, ["lowei"])
    words = ["".join(random.choice("idotmrnashcuwel") for _ in range(random.randint(1, 9)))
             for _ in range(3000)]
    for w in lexicon:
        for _ in range(100):
            i = random.randrange(len(w) + 1)
            words.append(w[:i] + random.choice(["", "x", "o"]) + w[i + random.choice([0, 1]):])
    for w in words + ["loweitum", "lowe"]:
        near = [x for x in lexicon if edits(w, x) <= 1 and (w == x or len(x) >= 5)]
        want = (toxicity.EXACT if w in lexicon or w.startswith("lowei") else
                toxicity.FUZZY if near else toxicity.NONE)
        assert auto.match(w) == want, w


def test_automaton_admits_swaps():
    auto = toxicity.LexiconAutomaton(["idiot", "moron", "scum"])
    for w in ["idoit", "diiot", "idito", "omron", "morno"]:
        assert auto.match(w) == toxicity.FUZZY, w
    for w in ["idtoi", "dioit", "idoitt", "omrno", "sucm"]:
        assert auto.match(w) == toxicity.NONE, w


def test_quotation_is_not_abuse():
    m = toxicity.Matcher(toxicity.ToxicityModel(("idiot",)))
    assert toxicity.hits("you are an idiot", m)[:3] == (1, 0, 0)
    assert toxicity.hits("you are an id1ot!", m)[:3] == (0, 1, 0)
    assert toxicity.hits('the word "idiot" is old', m)[:3] == (0, 0, 1)
    assert toxicity.hits("he wrote «you are an idiot» and left", m)[:3] == (0, 0, 1)


def test_toxicity_learns_and_filters(spark):
    random.seed(4)
    calm = "amber brook cedar delta ember flint grove haven inlet jetty".split()
    rows, labels = [(None, None, 1), (900, "", 1), (901, None, 1)], [(None, 0), (900, 0)]
    for i in range(400):
        words = [random.choice(calm) + str(random.randrange(50)) for _ in range(30)]
        if i % 5 == 0:
            words[i % 29] = "moron"
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, lambda c: F.crc32(c.cast("string")) % 3 != 1)
    assert model.words == ("moron",)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] is None or r[0] % 5
                                                 or r[0] >= 900}
    empty = toxicity.learn(docs.limit(0), marks, lambda c: F.lit(True))
    assert empty.words == () and toxicity.with_score(docs.limit(0), empty, score_col="s").count() == 0


def test_misspelled_terms_alone_reject(spark):
    """The labelled texts hold exact terms only."""
    random.seed(5)
    calm = "amber brook cedar delta ember flint grove haven inlet jetty".split()
    rows, labels = [], []
    for i in range(400):
        words = [random.choice(calm) + str(random.randrange(50)) for _ in range(30)]
        if i % 8 == 0:
            words[i % 29] = random.choice(["moron", "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"),
                           spark.createDataFrame(labels, "doc_id long, toxic int"),
                           lambda c: F.lit(True))
    assert model.words == ("idiot", "moron")
    texts = [(1, "amber m0ron brook"), (2, "amber idoit brook"), (3, "mroon idi0t idito moorn"),
             (4, "amber moron brook"), (5, "amber brook"), (6, 'the word "idoit" is old')]
    got = {r.doc_id: r.score for r in toxicity.with_score(
        spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert all(got[i] >= toxicity.THRESHOLD for i in (1, 2, 3, 4))
    assert got[5] < toxicity.THRESHOLD and got[6] < toxicity.THRESHOLD
    assert got[1] < got[4]   # the discount


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big  &amp; bold</h1><p>First para&shy;graph<br>of text.<div class="ad">Buy</div>
<p>Second <b>one</b> with &#233;.</p><script>var x = "<p>no</p>";</script>
<form><label>Mail</label></form><section class="comments"><p>I disagree</p></section></article>
<aside>More</aside><footer>&copy; 2024"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>Just text</p>", 5),
            (1, "u", PAGE, 5), (None, "u", "<div><nav>a</nav>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_extract.main_text(pages).collect()
    want = "Big & bold\nFirst para\xadgraph of text.\nSecond one with é."
    assert sorted((r.page_id or 0, r.text) for r in got) == sorted(
        [(1, want), (1, want), (2, ""), (3, ""), (4, "Just text"), (0, "")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_boilerplate_decides_against_many_labelled_pages():
    """Weights of a large labelled set that shows no aside, form or section."""
    counts = {"w+article": 10 ** 6, "w+body": 10 ** 6, "w+p": 10 ** 6, "w-body": 10 ** 5,
              "w-p": 10 ** 4, "w-nav": 10 ** 5, "t+p": 10 ** 5, "t-p": 10 ** 3}
    weights = html_extract.weights_from(counts)
    def got(body, tag="<body>"):
        return html_extract.extract(f"<html>{tag}{body}</body></html>", weights)
    rest = "one two three four five six seven eight nine ten"
    for block in ("<aside><p>No no</p></aside>", "<form><p>No no</p></form>",
                  "<section class='comments'><p>No no</p></section>",
                  "<div class='sidebar'><div><p>No no</p></div></div>",
                  "<section class='comments'><article><p>No no</p></article></section>"):
        assert got(f"<article><p>{rest}</p>{block}<p>{rest}</p></article>") == f"{rest}\n{rest}"
        assert got(f"{block}<article><p>One two</p></article>{block}") == "One two"
    article = "<article><p>One two</p></article>"
    for page in (article, f"<form>{article}</form>", f"<div class='page sidebar'>{article}</div>"):
        assert got(page) == "One two"
    assert got("<article class='post tag-search'><p>One two</p></article>",
               "<body class='has-sidebar'>") == "One two"


def page_words(html):
    return " ".join(b.text for b in html_extract.parse(html)).split()


def test_parser_keeps_page_text():
    assert page_words("<html><head><title>T</title><body><article><header><h1>Big</h1></header>"
                      "<p>one</p></article>") == ["Big", "one"]
    assert page_words("<head><title>T</title></head ><header>top</header>") == ["top"]
    for name in ("button", "svg", "canvas", "audio", "video", "template", "option", "select"):
        assert page_words(f"<p>one <{name}> two</p><p>three</p>") == ["one", "two", "three"]
        assert page_words(f"<p>a <{name}>b<!-- </{name}> -->c</{name}> d</p>") == ["a", "d"]
        assert page_words(f"<p>a <{name}>b</p><p>c <{name}>d</{name}> e") == ["a", "b", "c", "e"]
    assert page_words("<article>a <math><mi>x</mi></math> <object>b</object> c") == [
        "a", "x", "b", "c"]
    assert page_words("<p>a <script>var x = 1;</scripts>b</p>") == ["a"]


def test_parser_keeps_deep_containers():
    for n in (50, 400, 20_000):
        page = "<div>" * 110 + "<article>" + "<div>" * n + "<p>one" + "</div>" * n + "<p>two"
        blocks = html_extract.parse(page)
        assert [b.text for b in blocks] == ["one", "two"]
        assert all(b.labelled and "article" in b.context for b in blocks)


def test_best_region():
    random.seed(6)
    for _ in range(200):
        s = [random.randint(-5, 5) for _ in range(random.randint(0, 12))]
        i, j = html_extract.best_region(s)
        best = max([0] + [sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)])
        assert sum(s[i:j]) == best


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f.split("_")[0] for f in names if f.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and set(queries.oracle_sql()) <= names


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    from spendaudit.llm import common
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.land(stage(spark, out[-1], "/root/testdata/sf0.001"), name))
    return out


def test_pipeline_stages(stages):
    docs, calm, unique, apart, mixed, encoded = stages
    assert all(x.columns == docs.columns for x in stages[:-1])
    assert unique.count() == calm.select("text").distinct().count()
    from test_operators import brute_components, brute_fingerprint
    rows = unique.select("doc_id", "text").collect()
    comp = brute_components([brute_fingerprint(r.text) for r in rows], [r.doc_id for r in rows], 4)
    assert sorted(r.doc_id for r in apart.select("doc_id").collect()) == sorted(set(comp))
    assert encoded.count() == mixed.count() and encoded.where("NOT round_trip").count() == 0


def plain_score(text, model):
    """The score of a text without the automaton: every word against every lexicon entry by
    edit distance (a swap of neighbours is one edit)."""
    def near(w, x):
        swapped = [w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)]
        return len(x) >= toxicity.MIN_FUZZY and (
            (abs(len(w) - len(x)) <= 1 and edits(w, x) <= toxicity.MAX_EDITS) or x in swapped)

    words = (text or "").lower().split()
    n = exact = quoted = 0
    for i, raw in enumerate(words):
        w = raw.strip(toxicity.STRIP)
        whole = w in model.words or any(w.startswith(s) for s in model.stems)
        if not w or not (whole or (w not in model.known_clean
                                   and any(near(w, x) for x in model.words))):
            continue
        if toxicity.is_quoted(words, i):
            quoted += 1
        else:
            n, exact = n + 1, exact + whole
    x = [1, n >= 1, n >= 2, n >= 3, n >= 1 and not exact, quoted >= 1, quoted >= 2]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))


def test_toxicity_stage_row_by_row(spark, stages):
    """The stage keeps exactly the documents that the plain score does not reject, each once
    and unchanged; so does the query's score."""
    docs, calm = stages[:2]
    model = queries.toxicity_model(spark, "/root/testdata/sf0.001")
    assert model.words
    rows = docs.collect()
    score = {r.doc_id: plain_score(r.text, model) for r in rows}
    assert sorted(calm.collect()) == sorted(r for r in rows if score[r.doc_id] < toxicity.THRESHOLD)
    assert len(rows) > calm.count() > len(rows) // 2
    for r in queries.op3_toxicity(spark, "/root/testdata/sf0.001").collect():
        assert abs(r.score - score[r.doc_id]) < 1e-9
        assert r.predicted == (score[r.doc_id] >= toxicity.THRESHOLD)


def test_mixing_stage_row_by_row(stages, tmp_path):
    """Each document comes out once for every pass that takes at least half of its words,
    with the passes worked out by the query's SQL over the stage's own input."""
    import duckdb
    apart, mixed = stages[3:5]
    apart.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    ctes = queries.MIXING_SQL[:queries.MIXING_SQL.rindex("SELECT doc_id, CAST(size AS BIGINT)")]
    want = {}
    for doc, size, start, whole, quota in con.execute(
            ctes + "SELECT doc_id, size, start, source_size, quota FROM placed").fetchall():
        taken = [min(max(quota - start - p * whole, 0), size) for p in range(2)]
        want[doc] = sum(size > 0 and t > 0 and 2 * t >= size for t in taken)
    got = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert got == Counter({d: n for d, n in want.items() if n}) and max(got.values()) == 2
    assert mixed.distinct().exceptAll(apart.distinct()).count() == 0
