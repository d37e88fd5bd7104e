"""Operator 3: main text of a page as the maximum-scoring subsequence.

A page becomes a sequence of runs of words and of tags. Words score by where
they stand (inside a menu, a link, an advert, a plain paragraph, ...), tags by
their name; words of content score positive, tags never do. One linear scan
finds the contiguous region of the largest sum, and the text of the region,
without the boilerplate elements inside it, is the result.

The weights are log-odds learned from labelled pages, that is pages with a
marked ``<article>``: a word inside is content, a word outside is not. At most
``max_training_pages`` pages (a hash sample) are read for it; extraction reads
every page whole.

Class words are believed as far as they leave a page: an element that holds
``WHOLE`` of the words outside menus, headers and the like is no boilerplate,
whatever it is called. Several articles of a page are one region if the text
between them costs less than they bring, else the best one; a header inside an
article is a header.

Defined cases: NULL html counts as empty; a page without words gives the empty
text and 0; unclosed elements end with their parent or at the next article;
an unclosed comment, script or style runs to the end of the page; repeated
rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and class words of boilerplate.
RAW = "script|style|noscript|template|textarea|title|svg|iframe|select|button|object|canvas|math"
SKIP = set("nav header footer aside form menu dialog fieldset head address " .split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PLAIN = set("p li td th dd dt h1 h2 h3 h4 h5 h6 div pre blockquote figcaption section".split())
# class words that announce boilerplate wherever they stand in a name: sidebar-left, post-comments
PART = ("ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|sidebar|side-?bar|nav|navbar|navigation|breadcrumbs?|footer|"
        "masthead|cookies?|banner|popup|modal|newsletter|sharing|share|comments?|comment-?list|disqus|widget|pagination|pager|toolbar")
# ... and those that may also tell what a page is about (popular-science, legal-analysis): the whole name, or its last word
LAST = ("promo|promotion|aside|menu|header|consent|gdpr|notice|alert|overlay|subscribe|subscription|signup|login|social|related|"
        "recommended|recommendations|trending|popular|respond|reply|replies|tags|search|hidden|copyright|legal|disclaimer|"
        "contentinfo|complementary")
NOISY = re.compile(rf"(?:{PART})(?:[-_].*)?|(?:.*[-_])?(?:{PART}|{LAST})", re.I)
# ... unless it says what the element has, or names the head of an article
HARMLESS = re.compile(r"(?:has|no|with|without|is|hide|show)[-_].*|(?:article|entry|post|story|page)[-_]header", re.I)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[a-zA-Z/][^<>]*>|[^<]+|<", re.S | re.I)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

EDGE = -25.0   # crossing the border of a marked article
LIMIT = 4.0    # largest weight of one word or tag
SKIPPED = -12  # most that one boilerplate element can take from a region
WHOLE = 0.8    # share of a page's words that no class word can take away


class Run:
    """A run of words or a tag of one page."""
    __slots__ = ("key", "words", "text", "block", "skip", "inside", "edge")

    def __init__(self, key, words, text, block, skip, inside, edge=False):
        self.key, self.words, self.text, self.block = key, words, text, block
        self.skip, self.inside, self.edge = skip, inside, edge


class Open:
    """An open element and what its place says about the words in it."""
    __slots__ = ("name", "skip", "inside", "link", "near", "para", "at")

    def __init__(self, name, skip, inside, above=None, at=0):
        self.name, self.skip, self.inside = name, skip, inside
        # inside a link; the nearest element that is not inline; the open p of this table cell
        self.link = name == "a" or bool(above and above.link)
        self.near = name if name not in INLINE else above.near if above else ""
        cell = name in ("td", "th", "table", "caption")
        self.para = at if name == "p" else -1 if cell or not above else above.para
        self.at = at


def runs(page: str, innocent: frozenset[int] = frozenset(), marked: dict[int, int] | None = None) -> Iterator[Run]:
    """The runs of a page. ``innocent``: places of elements whose class words
    are not believed; ``marked`` receives the number of the boilerplate element
    of each place that is boilerplate by class words alone."""
    stack: list[Open] = []
    count: Counter = Counter()  # open elements by name
    root = Open("", 0, False)
    block = marks = 0

    def close(to: int) -> None:
        for o in stack[to:]:
            count[o.name] -= 1
        del stack[to:]

    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            if m[0][0] == "<" and len(m[0]) > 1:  # comment, declaration, raw element
                continue
            text = entities.unescape(m[0])
            top = stack[-1] if stack else root
            key = f"{'skip' if top.skip else 'word'} {'link' if top.link else ''} {top.near if top.near in PLAIN else 'other'}"
            yield Run(key, len(text.split()), text, block, top.skip, top.inside)
            continue
        name = name.lower()
        top = stack[-1] if stack else root
        if name not in INLINE:
            block += 1
        edge = name in ("article", "main")
        if m["end"]:
            if count[name]:  # an end tag without its element ends nothing
                at = len(stack) - 1
                while stack[at].name != name:
                    at -= 1
                top = stack[at]
                close(at)
        elif name not in VOID and not m["attr"].endswith("/"):
            by_name = name in SKIP
            noise = by_name or m.start() not in innocent and noisy(name, m["attr"])  # an article may be a reader's comment
            if edge and not noise and top.skip and not top.inside:
                close(0)  # an element before the article was left open
                top = root
            para = top.para if name == "p" else -1
            if name in ("p", "li") and top.name == name or para >= 0:
                close(para if para >= 0 else len(stack) - 1)  # the end tag of these may be left out
                top = stack[-1] if stack else root
            if noise and not top.skip:
                marks += 1
                if marked is not None and not by_name:
                    marked[m.start()] = marks
            stack.append(Open(name, top.skip or (marks if noise else 0), top.inside or (edge and not noise),
                              top if stack else None, len(stack)))
            count[name] += 1
            top = stack[-1]
        yield Run(f"<{name}>", 0, "", block, top.skip, top.inside, edge and not top.skip)


def page_runs(page: str) -> list[Run]:
    """``runs``, without believing class words that would take ``WHOLE`` of the
    page's words or more: an article is never lost to the name of its frame."""
    innocent: set[int] = set()
    while True:
        marked: dict[int, int] = {}
        seq = list(runs(page, frozenset(innocent), marked))
        words: Counter = Counter()
        for r in seq:
            words[r.skip] += r.words
        by_class = set(marked.values())
        total = words[0] + sum(n for k, n in words.items() if k in by_class)
        guilty = {at for at, k in marked.items() if total and words[k] >= WHOLE * total}
        if not guilty:
            return seq
        innocent |= guilty


def noisy(name: str, attributes: str) -> bool:
    """Does the element announce boilerplate, by its name or class words?"""
    if name in SKIP:
        return True
    words = [w for a in ATTR.findall(attributes) for w in a.strip("\"'").split()]
    return name != "html" and name != "body" and any(NOISY.fullmatch(w) and not HARMLESS.fullmatch(w) for w in words)


# --- weights -------------------------------------------------------------------

def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        inside, outside = Counter(), Counter()
        for page in b.column(0):
            for r in page_runs(page.as_py() or ""):
                (inside if r.inside and not r.skip else outside)[r.key] += max(1, r.words)
        keys = list(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()),
             pa.array([outside[k] for k in keys], pa.int64())], names=["key", "inside", "outside"])


def learn_weights(pages: DataFrame, html_col: str = "html", max_training_pages: int = 2000,
                  min_count: int = 50) -> dict[str, float]:
    """Log-odds per run kind. Kinds seen fewer than ``min_count`` times are
    left to the defaults of ``weight``; there are at most as many kinds as
    tag names in the sample."""
    marked = pages.where(F.col(html_col).rlike("(?i)<article\\b")).select(html_col)
    share = min(1.0, max_training_pages / max(1, marked.count()))
    sample = marked.where(F.pmod(F.xxhash64(html_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = (sample.mapInArrow(_counts, "key string, inside long, outside long").groupBy("key")
            .agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
            .where(F.col("i") + F.col("o") >= min_count).collect())
    return {r.key: max(-LIMIT, min(LIMIT, math.log((r.i + 0.5) / (r.o + 0.5)))) for r in rows}


def weight(key: str, learned: dict[str, float]) -> float:
    w = learned.get(key)
    if key[0] == "<":
        return min(-0.1, w if w is not None else -0.2)
    if key.startswith("skip"):
        return min(-0.5, w if w is not None else -2.0)
    if w is None:
        w = -1.0 if " link " in key else 1.0
    # a kind of place that pages use for both is worth little, never against content by itself
    return w if " link " in key else max(0.2, w)


def run_scores(seq: list[Run], learned: dict[str, float]) -> list[float]:
    out, taken, last = [], 0.0, 0
    for r in seq:
        s = EDGE if r.edge else weight(r.key, learned) * max(1, r.words if r.key[0] != "<" else 1)
        if not r.words and r.key[0] != "<":
            s = 0.0
        if r.skip:  # all of one boilerplate element counts once, up to SKIPPED
            taken = taken if r.skip == last else 0.0
            s = max(s, SKIPPED - taken) if s < 0 else 0.0
            taken, last = taken + s, r.skip
        out.append(s)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous region of the largest positive sum, in one scan;
    (0, 0) if none is positive."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(page: str, learned: dict[str, float]) -> str:
    seq = page_runs(page)
    start, end = best_region(run_scores(seq, learned))
    blocks: list[list] = []
    for r in seq[start:end]:
        if r.text and not r.skip:
            if blocks and blocks[-1][0] == r.block:
                blocks[-1][1] += r.text
            else:
                blocks.append([r.block, r.text])
    return " ".join(t for t in (" ".join(b[1].split()) for b in blocks) if t)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 labelled: DataFrame | None = None, max_training_pages: int = 2000) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``pages``;
    weights come from ``labelled`` (default: ``pages`` itself)."""
    learned = learn_weights(pages if labelled is None else labelled, html_col, max_training_pages)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py() or "", learned) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
