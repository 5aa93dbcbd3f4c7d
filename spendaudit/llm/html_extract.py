"""Main-text extraction by the maximum-scoring subsequence of a page's tokens.

A page is read as a sequence of words and tags.  Words score positive where pages put
their article and negative where they put menus, notices or comments; tags score
negative, the more the rarer they are inside articles.  One linear scan finds the
contiguous region of the largest total.  The weights come from labelled pages: pages that
mark their article (one ``article`` or ``main`` element) tell, for every kind of
container and tag, how many words lie inside and outside of it; fixed prior counts stand
for containers that the labelled pages do not show.

Inside a container of boilerplate that container decides, however strong the evidence of
the article around it is: inside an article it counts as nothing, so that the article goes
on behind it, and elsewhere against the region.  Tags are charged where words score negative.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

CHARS = 4_000_000
# Fixed values.  Elements whose content is never page text.  That of RAW elements is no
# markup and goes on to the end of the page without an end tag; any other element without
# an end tag is an ordinary one.
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = RAW | frozenset("noscript template head svg annotation annotation-xml canvas select "
                          "option button audio video datalist".split())
# Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt "
                   "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
                   "html legend li main menu nav ol p pre search section summary table tbody td "
                   "tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Containers that set the context of the words inside, with the prior counts of words
# inside and outside articles that the labelled pages' counts are added to.
CONTAINERS = {
    "article": (900, 100), "main": (900, 100), "section": (60, 40), "div": (55, 45),
    "body": (50, 50), "p": (60, 40), "h1": (60, 40), "h2": (55, 45), "h3": (55, 45),
    "blockquote": (60, 40), "pre": (60, 40), "table": (50, 50), "ul": (45, 55), "ol": (50, 50),
    "li": (45, 55), "a": (40, 60), "nav": (5, 995), "header": (10, 490), "footer": (5, 995),
    "aside": (5, 995), "form": (5, 995), "menu": (5, 995), "label": (5, 495),
    "fieldset": (5, 495), "dialog": (5, 995), "search": (5, 495)}
# Words of class, id and role attributes that name boilerplate, and those that name articles.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies disqus footer form gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "paywall popup promo promoted promotion reactions recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "teaser toolbar topbar widget widgets alert complementary contentinfo discussion responses "
    "feedback legal copyright toc rail".split())
ARTICLE_NAMES = frozenset("article articlebody content entry main post story".split())
# Containers that decide alone.  WRAPPERS may also be put around a whole page.
WRAPPERS = frozenset("form header label fieldset search #boilerplate".split())
DECIDING = WRAPPERS | frozenset("nav aside footer menu dialog".split())
PRIOR_BOILERPLATE, PRIOR_ARTICLE = (2, 998), (800, 200)
TAG_COST = 1.0         # of a tag that never occurs inside articles
WORD_CAP = 1.0         # score of a word, at most, either way
BARE = 0.1             # evidence of words outside of any container (a page without tags)
# Elements of running text: a boilerplate name drops their words, wherever they are ...
INLINE = frozenset("span a small label b i em strong".split())
# ... and elements that are text themselves: one listed word among others does not decide.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*"
                        r"(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in RAW}
_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)


def names_in(attributes: str, name: str = "", inside: bool = False) -> tuple[str, ...]:
    """Boilerplate or article features of a tag's class, id and role.  Names on the page
    itself or on its main element say nothing about boilerplate, nor do those of an
    article that is also named as one, nor does a header inside an article."""
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        kind = m.group(1).lower()
        value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if kind == "hidden" or (kind == "style" and re.search(r"display\s*:\s*none", value)):
            out.add("#boilerplate")
        elif kind in ("class", "id", "role", "itemprop"):
            value = re.sub(r"[^a-z0-9]+", " ", value)
            found = set(_NAME.findall(value))
            if name in TEXTUAL and found - BOILERPLATE:
                continue
            harmless = (name in ("html", "body", "main")
                        or (name == "article" and found & ARTICLE_NAMES))
            if not harmless and found & BOILERPLATE - ({"header"} if inside else set()):
                out.add("#boilerplate")
            elif found & ARTICLE_NAMES:
                out.add("#article")
    return tuple(out)


def element_ends(html: str) -> dict[int, int]:
    """End of the whole element by the end of its start tag, for INLINE elements and SKIPPED
    ones that are not RAW, if they have an end tag of their own."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    at = 0
    while m := _TOKEN.search(html, at):
        at = m.end()
        name = m.group(2).lower() if m.group(2) else None
        if name not in SKIPPED and name not in INLINE:
            continue
        if m.group(1):
            if begun.get(name):
                ends[begun[name].pop()] = at
        elif not m.group(0).endswith("/>"):
            if name in RAW:
                close = _RAW_END[name].search(html, at)
                at = close.end() if close else len(html)
            else:
                begun.setdefault(name, []).append(at)
    return ends


@dataclass
class Block:
    """A run of text between block tags: its words joined by single spaces, the features of
    the containers around it (without wrappers of the whole article), and the tags since
    the block before."""
    text: str
    context: tuple[str, ...]
    tags: tuple[str, ...]
    labelled: bool     # inside the page's article or main element


def parse(html: str) -> list[Block]:
    """Blocks of a page in order.  Comments, and elements that hold no page text, are
    skipped; tags that are never closed or never opened are put up with."""
    blocks: list[Block] = []
    # open elements, each with the context and article depth around it
    stack: list[tuple[str, tuple[str, ...], int]] = []
    opened: Counter = Counter()
    sole = len(_ARTICLE.findall(html)) == 1
    parts: list[str] = []
    tags: list[str] = []
    context: tuple[str, ...] = ()
    depth_article = 0

    def flush():
        nonlocal parts, tags
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts = []
            if text:
                blocks.append(Block(text, context, tuple(tags), depth_article > 0))
                tags = []

    def leave() -> str:
        nonlocal context, depth_article
        top, context, depth_article = stack.pop()
        opened[top] -= 1
        return top

    def enter(name: str, features: tuple[str, ...]):
        nonlocal context, depth_article
        stack.append((name, context, depth_article))
        opened[name] += 1
        if name in ("article", "main"):
            if not depth_article:   # what wraps the article is no boilerplate inside it
                named = sole or name == "main"
                context = tuple(f for f in context if f not in WRAPPERS
                                or (f == "#boilerplate" and not named))
            depth_article += 1
        new = tuple(f for f in features if f not in context)
        if new:
            context += new

    ends = None
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in SKIPPED:
            if m.group(1) or m.group(0).endswith("/>"):
                continue
            if name in RAW:
                close = _RAW_END[name].search(html, at)
                stop = close.end() if close else end
            else:
                ends = element_ends(html) if ends is None else ends
                stop = ends.get(at)
            if stop is not None:
                at = stop
                if name not in ("script", "style", "title", "head"):
                    parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m.group(1):
            tags.append(name)
            if opened[name]:
                while leave() != name:
                    pass
            continue
        tags.append(name)
        if name in VOID or m.group(3).endswith("/"):
            continue
        if name in BLOCKS and name not in ("li", "td", "th", "tr", "dd", "dt"):
            # a paragraph ends where another block starts
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "u",
                                             "small", "font"):
                if not any(x[0] == "p" for x in stack[-4:]):
                    break
                leave()
        features = names_in(m.group(3), name, depth_article > 0) if m.group(3) else ()
        if name in INLINE and "#boilerplate" in features:
            ends = element_ends(html) if ends is None else ends
            if at in ends:
                parts.append(" ")
                tags.pop()
                at = ends[at]
            continue
        if name in CONTAINERS and not (name == "header" and depth_article):
            features = (name,) + features
        enter(name, features)
    flush()
    return blocks


def _add(total: Counter, blocks: list[Block]) -> None:
    """Words by container and tags, inside ("+") and outside ("-") of the article."""
    for b in blocks:
        inside = b.labelled and "#boilerplate" not in b.context and not (
            {"nav", "aside", "footer", "form", "menu", "dialog"} & set(b.context))
        sign = "+" if inside else "-"
        words = b.text.count(" ") + 1
        for f in b.context:
            total["w" + sign + f] += words
        for t in b.tags:
            total["t" + sign + t] += 1


@dataclass
class Weights:
    """log10 odds of a word by container, and cost of a tag."""
    word: dict[str, float]
    tag: dict[str, float]

    def of(self, context: tuple[str, ...]) -> float:
        """Score of a word: the evidence of the strongest boilerplate container, or the
        summed evidence if there is none, squashed.  Lists, tables and other neutral
        containers inside an article say nothing against it.  Boilerplate inside an
        article scores 0: it is no part of the text and no end of it."""
        z, article = 0.0, False
        for f in context:
            w = self.word.get(f, 0.0)
            if f in DECIDING and w < 0:
                against = min(self.word.get(x, 0.0) for x in context if x in DECIDING)
                return 0.0 if article else WORD_CAP * math.tanh(against)
            z += max(w, 0.0) if article else w
            article = article or f in ("article", "main")
        return WORD_CAP * math.tanh(z if context else BARE)


def weights_from(counts: dict[str, int]) -> Weights:
    """Weights from summed counts; a feature's labelled words weigh at most 1000 against
    its prior, so that one site's habits do not drown what containers mean."""
    word = {}
    priors = dict(CONTAINERS) | {"#boilerplate": PRIOR_BOILERPLATE, "#article": PRIOR_ARTICLE}
    for f, (a, b) in priors.items():
        x, y = counts.get("w+" + f, 0), counts.get("w-" + f, 0)
        scale = min(1.0, 1000.0 / max(x + y, 1))
        word[f] = math.log10((a + x * scale) / (b + y * scale))
    tag = {}
    for key in {k[2:] for k in counts if k[0] == "t"} | set(CONTAINERS):
        x, y = counts.get("t+" + key, 0), counts.get("t-" + key, 0)
        tag[key] = TAG_COST * (y + 0.5) / (x + y + 1.0)
    return Weights(word, tag)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run of largest total, the first of equal
    ones; (0, 0) if no score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(html: str, weights: Weights) -> str:
    """Blocks of the best region that score positive, in page order, joined by line
    feeds."""
    blocks = parse(html)
    if not blocks:
        return ""
    memo: dict[tuple[str, ...], float] = {}
    words, scores = [], []
    for b in blocks:
        w = memo.get(b.context)
        if w is None:
            w = memo[b.context] = weights.of(b.context)
        words.append(w)
        scores.append(w * (b.text.count(" ") + 1)
                      - sum(weights.tag.get(t, 0.5) for t in b.tags) * (w < 0))
    i, j = best_region(scores)
    return "\n".join(b.text for b, w in zip(blocks[i:j], words[i:j]) if w > 0)


def learn_weights(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages: those with exactly one article or main element.
    The counts are one number per container and tag name."""
    known = BLOCKS | VOID | frozenset("a abbr b bdi cite code del em font i img ins kbd label mark "
                                      "q s small span strong sub sup time u var".split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, 0, CHARS):
            for html in batch.column(0).to_pylist():
                if len(_ARTICLE.findall(html)) == 1:
                    one: Counter = Counter()
                    _add(one, parse(html))
                    for k, n in one.items():
                        total[k if k[0] == "w" or k[2:] in known else k[:2] + "other"] += n
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()),
                                          pa.array(total.values(), pa.int64())],
                                         names=["key", "n"])

    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    rows = (pages.select(html).mapInArrow(run, "key string, n long")
            .groupBy("key").agg(F.sum("n").alias("n")).collect())
    return weights_from({r["key"]: r["n"] for r in rows})


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text",
              weights: Weights | None = None) -> DataFrame:
    """``pages`` without its html, plus the main text and its length in code points.

    NULL and empty pages, and pages without a positive region, give an empty text.  Rows
    are treated one by one; a column called ``text_col`` or n_chars is replaced.
    """
    weights = weights or learn_weights(pages, html_col)
    others = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__llm_html")
    rows = pages.select(html, *others)
    schema = T.StructType(rows.schema.fields[1:] + [T.StructField(text_col, T.StringType()),
                                                    T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, CHARS):
            found = [extract(h, weights) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                list(batch.columns)[1:] + [pa.array(found, pa.string()),
                                           pa.array([len(t) for t in found], pa.int64())],
                names=schema.names)

    return rows.mapInArrow(run, schema)
