"""Main text of web pages: flat blocks, classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- fixed values: elements by what they do to text ---------------------------
RAW = frozenset("script style title textarea template iframe xmp noembed noframes head".split())
# These are left out as a whole, but only if they end.
SKIPPED = frozenset("noscript object svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr input"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose maction msub msup msubsup"
    " munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd semantics annotation annotation-xml".split())
CONTAINERS = frozenset(
    "article aside blockquote body button center dd details dialog div dl fieldset figure footer form header html li"
    " main menu nav ol section select span table tbody td th tr ul".split())
OUTSIDE = frozenset("aside button dialog footer form menu nav select fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUTSIDE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|ads?|adverts?|advertisement|advertising"
    r"|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe"
    r"|subscription|signup|login|search|comments?|commentlist|disqus|reply|replies|respond|responses|share|sharing|social"
    r"|related|recommended|recommendations|breadcrumbs?|pagination|pager|widget|toolbar|copyright|legal|disclaimer|form)(?:$|[^a-z])")
INSIDE = frozenset(("article", "main"))
INSIDE_NAMES = re.compile(r"(?:^|[^a-z])(?:article|post|entry|story|content|main|maintext|bodytext)(?:$|[^a-z])")

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+>|[^>]*+(?:>|\Z))", re.S)
SKIPPED_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|template|iframe|xmp|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>]|\Z)|\Z)"
    r"|<(/?)(noscript|object|svg)(?=[\s/>]|\Z)(?:(?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+>|[^>]*+(?:>|\Z))", re.S | re.I)
NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|data-main)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """Text between two block-level tags."""

    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    inside: bool = False
    outside: bool = False
    heading: bool = False
    wanted: bool = False
    text: str = ""

    def close(self) -> bool:
        self.text = " ".join(html.unescape("".join(self.parts)).split())
        return bool(self.text)


def _kind(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element begins the article, begins something else, is marked as wanted."""
    names, role, hidden, wanted = "", "", False, False
    if attributes:
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            names += f" {value}" if name in ("class", "id") else ""
            role = value if name == "role" else role
            hidden |= name == "hidden" or name == "style" and bool(HIDDEN.search(value))
            wanted |= name == "data-main"
    starts = tag in INSIDE or role in ("main", "article") or tag not in ("body", "html") and bool(INSIDE_NAMES.search(names))
    leaves = tag in OUTSIDE or role in OUTSIDE_ROLES or hidden or tag == "header" and not inside
    if not leaves and tag not in ("body", "html", "main") and names:
        found = OUTSIDE_NAMES.search(names)
        # The head of an article is part of it, a page's is not.
        leaves = bool(found) and not (tag == "article" or inside and "header" in found[0])
    return starts and not leaves, leaves, wanted


def _ends(page: str) -> dict[int, int]:
    """Where the skipped elements that have an end tag of their own begin and end."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for found in SKIPPED_TAG.finditer(page):
        if found[3]:
            starts = begun.setdefault(found[3].lower(), [])
            if not found[2]:
                if not found[0].endswith("/>"):
                    starts.append(found.start())
            elif starts:
                ends[starts.pop()] = found.end()
    return ends


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what they stand in. Tags need not be closed or nested well."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, in the article, outside, wanted
    current, at, links = Block(), 0, 0
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal current
        if current.parts and current.close():
            out.append(current)
        state = stack[-1] if stack else ("", False, False, False)
        current = Block(inside=state[1], outside=state[2], wanted=state[3])

    def put(text: str) -> None:
        current.parts.append(text)
        if links:
            current.linked.append(text)

    while True:
        found = TAG.search(page, at)
        if not found:
            put(page[at:])
            break
        if found.start() > at:
            put(page[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = bool(found[1])
        if tag in RAW and not closing:
            if not found[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(page, at)
                # An element that never ends holds the rest, but a head without an end is no head.
                at = end.end() if end else at if tag == "head" else len(page)
            if tag in ("head", "title", "textarea", "iframe"):
                flush()
            continue
        if tag in SKIPPED:
            if not closing:
                ends = _ends(page) if ends is None else ends
                at = ends.get(found.start(), at)
            if tag == "noscript":
                flush()
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag == "br":
            put(" ")
            continue
        if tag in INLINE and tag != "span":
            continue
        if tag in CONTAINERS:
            if closing:
                if any(entry[0] == tag for entry in stack):
                    if tag != "span":
                        links = 0
                        last = stack
                        while stack and stack[-1][0] != tag:
                            last.pop()
                        stack.pop()
                        flush()
                    elif stack[-1][0] == "span":
                        stack.pop()
                        flush()
                elif tag != "span":
                    flush()
                continue
            state = stack[-1] if stack else ("", False, False, False)
            starts, leaves, wanted = _kind(tag, found[3], state[1])
            if tag == "span" and not leaves:
                continue
            if tag in ("li", "td", "th", "tr", "dd"):
                # These end their like, whether closed or not.
                while stack and stack[-1][0] == tag:
                    stack.pop()
                state = stack[-1] if stack else ("", False, False, False)
            stack.append((tag, state[1] or starts, state[2] or leaves, state[3] or wanted))
            flush()
            continue
        flush()
        if not closing and tag != "hr":
            starts, leaves, wanted = _kind(tag, found[3], current.inside) if found[3] not in (">", "") else (False, False, False)
            current.outside |= leaves
            current.wanted |= wanted
            current.heading = len(tag) == 2 and tag[0] == "h"
    flush()
    return out


FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "outside", "article_elsewhere",
    "heading",
)


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Word count and link density of each block and its neighbours, and what it stands in."""
    sizes = [len(block.text.split()) for block in found]
    density = [
        min(1.0, len(" ".join(block.linked).split()) / size) if block.linked else 0.0
        for block, size in zip(found, sizes)
    ]
    article = any(block.inside and not block.outside for block in found)
    rows = []
    for i, block in enumerate(found):
        before = (sizes[i - 1], density[i - 1]) if i else (0, 0.0)
        after = (sizes[i + 1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        rows.append((
            float(sizes[i]), density[i], float(before[0]), before[1], float(after[0]), after[1], float(block.inside),
            float(block.outside), float(article and not block.inside), float(block.heading)))
    return rows


_LONG = "The committee met on Tuesday to discuss the plan and agreed, after a long debate, that work on the bridge will start in spring. "
_MID = "In the evening the rain stopped, and they all walked home. "
_MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>World news</a></li><li><a href=/c>Sport</a></li></ul>"
# The labelled pages: main text is marked with data-main. Parameters of ``labelled_blocks``.
LABELLED_PAGES = (
    f"<body><nav>{_MENU}</nav><div class=ad>Buy two coats now and get the third one free of charge until Sunday evening only.</div>"
    f"<article data-main><h1>A bridge for the town</h1><p>{_LONG}</p><p>Yes.</p><p><a href=/r>The report of the committee</a></p><h2><a href=/h>Why</a></h2><p>{_LONG * 2}</p><ul><li>One point</li>"
    f"<li>Another point</li></ul></article><footer>Copyright by the town paper, all rights reserved, and some more words.</footer>",
    f"<body><header><h1>The Town Paper</h1><p>News that is worth the walk since nineteen hundred and two.</p></header>{_MENU}"
    f"<div><h1 data-main>Spring</h1><p data-main>{_LONG}</p><p data-main>{_LONG}</p><p data-main>Nobody objected to it.</p>"
    f"<p data-main>{_LONG}</p></div><div><a href=/x>Read more stories about bridges</a></div><div><a href=/y>Next</a></div>"
    f"<div class=comments><p>{_LONG}</p><p>I do not agree at all.</p></div><p><a href=/i>Imprint</a> <a href=/t>Terms</a></p>",
    f"<body><div class=menu>{_MENU}</div><main data-main><h2>Water</h2><p>{_LONG * 3}</p><p>Short.</p><p><a href=/s>Source</a></p></main><aside><p>{_LONG}</p>"
    f"</aside><p>Some words below the article that belong to the page and not to it, as many as one would write.</p>",
    f"<body>{_MENU}<table><tr><td><a href=/1>One</a> <a href=/2>Two</a></td><td><p data-main>{_LONG * 2}</p><p data-main>{_LONG}</p>"
    f"<p data-main>He <a href=/he>said</a> so again and again, and then went home to sleep.</p></td></tr></table><p>Page 1</p>"
    f"<p><a href=/p>All pages</a></p><form><p>{_LONG}</p></form>",
    f"<body><div id=cookie-notice><p>{_LONG}</p></div><div class=post><h1 data-main>Title of it</h1><p data-main>Word.</p>"
    f"<p data-main>{_LONG}</p><div class=share><a href=/s>Share</a></div><p data-main><a href=/m>More on it</a></p><p data-main>Last words.</p></div>"
    f"<section class=related><p>{_LONG}</p>{_MENU}</section>",
    f"<body>{_MENU}{_MENU}<p><a href=/z>Contact</a></p><p>Welcome</p><p><a href=/q>Search the whole archive of the paper</a></p>",
    "<article data-main><p>One.</p></article>", "<article data-main><p>Two words</p><p>x</p><p>Now three words</p></article>",
    "<main data-main>Short</main>", "<article data-main><p>In four short words</p><p>x y</p>",
    f"<p>Top</p><article data-main><p>In it</p><p>{_MID}</p><p>End</p></article><p>Below</p>",
    f"<body><p data-main>{_LONG}</p><p data-main>{_LONG}</p>", f"<p data-main>{_MID}</p>", f"<p data-main>{_MID * 2}</p>",
    f"<body>{_MENU}<div><h1 data-main>Rain</h1><p data-main>{_MID}</p><p data-main>{_MID}</p><p data-main>Soon.</p>"
    f"<p data-main>{_MID * 2}</p></div><p>All rights reserved</p>",
    f"<body>{_MENU}<div><p data-main>{_MID * 2}</p><p data-main>{_MID}</p></div><div><p>Page 3</p></div><p><a href=/u>Up</a></p>",
)


def labelled_blocks(spark: SparkSession, pages: tuple[str, ...] = LABELLED_PAGES) -> DataFrame:
    """A small table of blocks: ``features`` and ``label`` 1 for main text."""
    rows = []
    for page in pages:
        found = blocks(page)
        rows += [(Vectors.dense(values), float(block.wanted)) for block, values in zip(found, features(found))]
    return spark.createDataFrame(rows, ["features", "label"])


Tree = tuple | float


def train(labelled: DataFrame, depth: int = 6) -> Tree:
    """A decision tree over the block features, as nested (feature, threshold, at most, above)."""
    learner = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=1, seed=1)
    model = learner.fit(labelled.coalesce(1))

    def plain(node) -> Tree:
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        split = node.split()
        return split.featureIndex(), float(split.threshold()), plain(node.leftChild()), plain(node.rightChild())

    return plain(model._java_obj.rootNode())


def keeps(tree: Tree, values: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if values[feature] <= threshold else high
    return tree > 0.5


def main_text(page: str | None, tree: Tree) -> str:
    """The blocks of a whole page that the tree keeps, joined by one space."""
    found = blocks(page or "")
    return " ".join(block.text for block, values in zip(found, features(found)) if keeps(tree, values))


def extract(pages: DataFrame, html_column: str = "html", tree: Tree | None = None) -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if none) and ``n_chars`` (code points) in place of the html.

    A null page is empty. Nothing is cut or capped; repeated rows are extracted each. Other columns
    stay, but for any of the two new names. Without a ``tree`` one is trained on the labelled table.
    """
    tree = tree if tree is not None else train(labelled_blocks(pages.sparkSession))
    others = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    return pages.select(*others, text_of(html_column, tree).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def text_of(page: str, tree: Tree) -> Column:
    @F.pandas_udf("string")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, tree) for page in batch], dtype=object)

    return values(page)
