"""Operator 7: main text of web pages by the maximum-scoring subsequence.

Method: a page is a row of words and tags in page order. Words score positive, tags negative; the weights come
from labelled pages, those that mark their article themselves (one ``article`` or ``main`` element): a word weighs the
share of such words that stand inside the mark, a tag costs what such tags stand outside it. One linear scan
finds the contiguous region with the highest sum; it is widened to whole blocks and its text is returned.
Scripts, styles and comments give no words.

Elements that seldom hold article text by their kind (menus, headers, footers, asides, forms) or by a part of their class, id, role
or label (``comment-list`` and ``CommentThread`` have the part *comment*) are doubtful. How doubtful is learned: each such kind and part
has the share of its words that stand inside the mark, drawn to a prior. The words of a doubtful element do not count, unless it
was never closed, an ``article`` or ``main`` stands in it, or the page has too little text besides: the more doubtful the element, the
less other text is enough. So a wrapper or a page-wide form keeps its words, and a long list of reader comments does not. A part behind a word like *has* or *no*
says nothing of the element itself.

The weights are counted on every labelled page in one aggregation; their number is bounded by the fixed lists of
kinds and parts. Without any labelled page the prior weights hold. Reading a page takes time in proportion to its length, however deep its elements nest.

Tags are read by the states of the HTML standard: a quote opens a value only right behind ``=``, elsewhere it is a plain
character. A quoted value that never ends is read up to the tag's end.

Defined cases: null or empty html gives the empty text; broken markup (open tags, stray end tags, cut entities, cut pages) is
read as far as it goes; ties go to the first region; pages are independent of each other and of other columns; a null ``page_id`` or
``url`` is carried; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
MARKS = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
KINDS = BLOCKS | frozenset("a abbr b cite code em i img q s small span strong sub sup time u".split())
# Prior share of article text in doubtful kinds, and in elements with a doubtful part in class, id, role or label.
DOUBTFUL = {
    "nav": 0.02, "footer": 0.02, "aside": 0.05, "form": 0.2, "head": 0.01, "header": 0.1, "dialog": 0.05, "menu": 0.05, "object": 0.05, "canvas": 0.05,
    "audio": 0.05, "video": 0.05, "button": 0.01, "select": 0.01, "option": 0.01, "svg": 0.01, "template": 0.01, "noscript": 0.02,
}
PARTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commenting complementary consent contentinfo "
    "cookie cookies disqus discussion footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination "
    "paywall popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "taboola toolbar widget widgets".split()
)
PART_SHARE, PRIOR_WORDS = 0.02, 50.0
# Words that make the part behind them a statement about something else, and words that make a header the article's own.
NOT_ITSELF = frozenset("has with no without is show hide".split())
OWN_HEADER = frozenset("entry post article story content chapter section".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^\s/>]*+(?:[\s/]*+(?:[^\s/>=]|=)[^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+)*+[\s/]*+(?:>|\Z)|[^<]+|<",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s/>=]|=)([^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

PRIOR = 2.0
TAG_COST = 6.0
LEAST_COST = 0.05
LEAST_OTHER = 1


def doubtful_parts(tag: str) -> set[str]:
    """The doubtful parts of a start tag's class, id, role and label."""
    found = set()
    for first, rest, *values in _ATTRIBUTE.findall(tag, _NAME.match(tag).end()):
        if (first + rest).lower() in ("class", "id", "role", "aria-label"):
            for token in "".join(values).split():
                parts = [p.lower() for p in _PART.findall(token)]
                for before, part in zip([None, *parts], parts):
                    if part in PARTS and before not in NOT_ITSELF and not (part == "header" and OWN_HEADER.intersection(parts)):
                        found.add(part)
    return found


@dataclass
class Doubtful:
    """A doubtful element: its features, the doubtful element around it, and what was seen inside it."""

    features: list[str]
    parent: int
    inside: bool
    words: int
    marks: int
    closed: bool = False
    own: int = 0  # words with no doubtful element between


def _read(page: str) -> tuple[list[tuple[str, str, str, bool, int]], list[Doubtful]]:
    """Events (kind, name or text, context, inside a mark, innermost doubtful element) and the doubtful elements; element 0 is the page."""
    elements = [Doubtful([], 0, False, 0, 0, True)]
    events: list[tuple[str, str, str, bool, int]] = []
    stack: list[tuple[str, int]] = []
    around = [0]
    open_names: Counter = Counter()
    unclosed: set[str] = set()
    words = marks = 0
    at, size = 0, len(page)

    def close(closed: bool) -> None:
        name, number = stack.pop()
        open_names[name] -= 1
        if number:
            around.pop()
            element = elements[number]
            element.closed, element.words, element.marks = closed, words - element.words, marks - element.marks

    while at < size:
        found = _TOKEN.match(page, at)
        token = found[0]
        at = found.end()
        if token[0] != "<" or token == "<":
            n = len(token.split())
            words += n
            elements[around[-1]].own += n
            direct = bool(stack) and stack[-1][1] > 0
            context = "a" if open_names["a"] else "outside" if direct else stack[-1][0] if stack else "body"
            events.append(("text", token, context, bool(open_names["article"] or open_names["main"]), around[-1]))
            continue
        named = _NAME.match(token)
        if not named:
            continue  # comments, declarations
        name = named[1].lower()
        marked = bool(open_names["article"] or open_names["main"])
        events.append(("tag", name, "", marked, around[-1]))
        if token[1] == "/":
            if open_names[name]:
                while stack[-1][0] != name:
                    close(False)
                close(True)
            continue
        if name in RAW and not token.endswith("/>"):
            # Where one is never closed, none behind it is.
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            if not end:
                unclosed.add(name)
            if end or name in ("script", "style"):
                closing = page.find(">", end.start()) if end else -1
                at = closing + 1 if closing >= 0 else size
            continue
        if name == "body" and open_names["head"]:
            while stack[-1][0] != "head":
                close(False)
            close(True)
        if name in ("p", "li", "a", "option") and stack and stack[-1][0] == name:
            close(True)  # its end tag may be left out
        if name in VOID or name in RAW or token.endswith("/>"):
            continue
        features = []
        if name not in ("html", "body") and name not in MARKS:
            if name in DOUBTFUL and not (name == "header" and marked):
                features.append(f"is:{name}")
            if len(token) > len(name) + 2:
                features += [f"has:{p}" for p in sorted(doubtful_parts(token))]
        if features:
            elements.append(Doubtful(features, around[-1], marked, words, marks))
            around.append(len(elements) - 1)
        marks += name in MARKS
        open_names[name] += 1
        stack.append((name, len(elements) - 1 if features else 0))
    while stack:
        close(False)
    elements[0].words = words
    return events, elements


def _share(feature: str, shares: dict[str, float]) -> float:
    return shares.get(feature, DOUBTFUL.get(feature[3:], PART_SHARE) if feature.startswith("is:") else PART_SHARE)


def dropped(elements: list[Doubtful], shares: dict[str, float]) -> list[bool]:
    """Whether the words of each doubtful element count for nothing. The least doubtful ones are settled first.

    Words of an element count as other text once it is kept, so never for itself.
    """
    doubt = [min((_share(f, shares) for f in e.features), default=1.0) for e in elements]
    gone = [False] * len(elements)
    settled = [not e.closed or e.marks > 0 or d >= 0.5 for e, d in zip(elements, doubt)]
    other = sum(e.own for e, kept in zip(elements, settled) if kept)
    for k in sorted((k for k, kept in enumerate(settled) if not kept), key=lambda k: (-doubt[k], -elements[k].words, k)):
        e = elements[k]
        gone[k] = other >= max(LEAST_OTHER, 5 * doubt[k] * e.words)
        if not gone[k]:
            other += e.own
    for k in range(1, len(elements)):
        gone[k] = gone[k] or gone[elements[k].parent]
    return gone


def tokens(page: str, shares: dict[str, float]) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, name or text, context, inside a mark): kind is 'tag', 'text', or 'dropped' for texts of dropped elements."""
    events, elements = _read(page)
    gone = dropped(elements, shares)
    for kind, value, context, inside, element in events:
        yield "dropped" if kind == "text" and gone[element] else kind, value, context, inside


def _tag(name: str) -> str:
    return f"<{name if name in KINDS else 'other'}>"


def _word(context: str) -> str:
    return context if context in KINDS or context == "outside" else "other"


def observed(page: str) -> Counter:
    """(feature, inside) counts of a labelled page; empty for any other."""
    if len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
        return Counter()
    counts: Counter = Counter()
    for element in _read(page)[1][1:]:
        if element.closed and not element.marks:
            for feature in element.features:
                counts[feature, element.inside] += element.words
    for kind, value, context, inside in tokens(page, {}):
        if kind == "tag":
            if value not in MARKS:
                counts[_tag(value), inside] += 1
        elif kind == "text" or context == "outside":
            counts[_word(context), inside] += len(value.split())
    return counts


def fitted(pages: DataFrame) -> dict[str, float]:
    """Share of each feature's occurrences inside the mark, over all labelled pages, drawn to a half, or to the prior of a doubtful feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                total.update(observed(value.as_py()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
            names=["feature", "inside", "n"],
        )

    rows = pages.select("html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).mapInArrow(count, "feature string, inside boolean, n long")
    sums = rows.groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n")).collect()
    doubtful = lambda f: f.startswith(("is:", "has:"))
    return {
        r["feature"]: (r["inside"] + PRIOR_WORDS * _share(r["feature"], {})) / (r["n"] + PRIOR_WORDS) if doubtful(r["feature"]) else (r["inside"] + PRIOR / 2) / (r["n"] + PRIOR)
        for r in sums
    }


def main_text(page: str | None, shares: dict[str, float]) -> str:
    """The text of the best region of one page."""
    if not page:
        return ""
    scores: list[float] = []
    parts: list[str | None] = []  # None: a block ends here
    for kind, value, context, _ in tokens(page, shares):
        if kind == "tag":
            scores.append(-LEAST_COST - TAG_COST * (1 - shares.get(_tag(value), 0.5)) if value not in MARKS else -LEAST_COST)
            parts.append(None if value in BLOCKS else "")
        elif kind == "text":
            text = html.unescape(value)
            scores.append(len(text.split()) * shares.get(_word(context), 0.5))
            parts.append(text)
    best = run = 0.0
    first = end = start = 0
    for k, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += score
        if run > best:
            best, first, end = run, start, k + 1
    if not best:
        return ""
    while first > 0 and parts[first - 1] is not None:
        first -= 1
    while end < len(parts) and parts[end] is not None:
        end += 1
    # All white space, a block's end included, becomes one space; inline tags leave none.
    return " ".join("".join(" " if p is None else p for p in parts[first:end]).split())


def extracted(pages: DataFrame, shares: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                texts = [main_text(x.as_py(), shares) for x in batch.column(2).slice(k, 256)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 256), batch.column(1).slice(k, 256), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
