"""Main text of web pages: flat text blocks judged by word counts and link densities of a block and its neighbours.

The page is read once into a flat list of blocks. Blocks inside elements that are no article by what they are (nav, aside,
form ...) or by one of their class, id or role words (menu, advert, comments ...) are never text, but count as neighbours.
The features of every other block are its own, the previous and the next block's number of words and link density, and
whether it stands inside an article or main part, outside of the one that the page has, or on a page without one. A
decision tree trained on the small labelled table below keeps or drops it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes: quoted values only after '=', and no '<' outside of them, so that a stray quote or '<' swallows nothing.
ATTRS = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+"""
#: The same up to the '/' of a self-closing tag; a '/' at the end of an unquoted value is none.
EMPTY = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'<>]+|/(?!>)|[^<>/])*+/>"""
PARTS = "noscript|template|textarea|select|svg|iframe|object"
#: The same for code, whose quotes may be broken: no '>' before its end.
EMPTY_CODE = r"""(?:=\s*"[^"<>]*"|=\s*'[^'<>]*'|=\s*[^\s"'<>]+|/(?!>)|[^<>/])*+/>"""
#: Where such a part ends if its end tag is missing, or not found before the next part of its kind: the next tag of a block.
BLOCK = r"</?(?:article|aside|blockquote|body|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|main|nav|ol|p|pre|section|table|ul)\b"
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    rf"""|(?P<raw><(?:script|style)\b{EMPTY_CODE}|<(?:{PARTS})\b{EMPTY}|<(?P<code>script|style)\b.*?(?:</(?P=code)\s*>|\Z)"""
    rf"""|<(?P<part>{PARTS})\b{ATTRS}>(?:(?:(?!<(?P=part)\b).)*?</(?P=part)\s*>|(?:(?!{BLOCK}).)*+))"""
    rf"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>{ATTRS})(?:>|\Z|(?P<open>(?=<)))"""
    r"""|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that can hold others and are always closed, so that a stack follows them.
NESTED = frozenset("html head body div section article main nav header footer aside form ul ol li dl table figure fieldset dialog details menu title button".split())
FURNITURE = frozenset("nav footer aside form head title dialog menu button fieldset".split())
#: Class, id and role words, each as a whole, of parts that are no article, and of those that hold one. A word may have parts
#: around it that say where or what in such a part an element is ("main-sidebar", "comment-list"), no others ("has-sidebar").
WHERE, WHAT = "site|page|main|global|top|bottom|left|right|primary|secondary|post|entry|article|inline|sticky|user|reader", "area|list|box|bar|wrapper|wrap|container|section|block|slot|unit|inner|left|right|top|bottom|form|links?|nav|menu|item|content|text|body|title|header|footer|thread|notice|message|banner|signup|sidebar|widget|posts|articles|main|[0-9]+"
OTHER = "ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|breadcrumbs?|captcha|comments?|commentlist|respond|replies|disqus|consent|cookies?|gdpr|disclaimer|legal|notices?|alert|footer|contentinfo|login|signup|masthead|menu|modal|nav|navbar|navigation|pager|pagination|newsletter|subscribe|subscription|overlay|popup|dialog|recommended|recommendations|related|search|searchbox|share|sharing|social|sidebar|complementary|teasers?|toolbar|widgets?"
FURNITURE_NAME = re.compile(rf"(?:(?:{WHERE})[-_]+)*(?:{OTHER})(?:[-_]+(?:{WHAT}))*|(?:(?:site|page|main|global|top)[-_]+)?header", re.I)
ARTICLE_NAME = re.compile(r"(?:article|post|entry|story|content|main|hentry)(?:[-_]+(?:body|content|text|article|area|inner|main))*|(?:site|page|main)[-_]+content", re.I)
#: Places of a block: inside an article or main part, on a page without one, outside of the page's, inside of furniture.
INSIDE, OPEN, OUTSIDE, NEVER = 1, 0, -1, -2

#: The labelled table, by pages in block order: words, link density, place, and whether the block is main text. The features
#: of the blocks before and after come from the order.
LABELLED = [
    # articles with a headline, short and long paragraphs, a list, a quotation
    [(1, 1.0, -2, 0), (1, 1.0, -2, 0), (2, 1.0, -2, 0), (7, 0.0, -2, 0), (9, 0.0, 1, 1), (60, 0.0, 1, 1), (4, 0.0, 1, 1), (120, 0.02, 1, 1), (1, 0.0, 1, 1), (33, 0.0, 1, 1), (9, 0.1, -2, 0)],
    [(6, 0.0, 1, 1), (2, 0.0, 1, 1), (3, 0.0, 1, 1), (2, 0.0, 1, 1), (1, 0.0, 1, 1), (80, 0.1, 1, 1), (12, 0.4, 1, 1), (45, 0.0, 1, 1), (3, 0.0, 1, 1)],
    [(11, 0.0, 1, 1), (220, 0.01, 1, 1), (5, 0.6, 1, 1), (70, 0.0, 1, 1), (3, 1.0, 1, 1), (64, 0.0, 1, 1), (8, 0.0, -2, 0), (150, 0.0, 1, 1), (12, 0.0, -2, 0), (95, 0.0, 1, 1), (30, 0.0, -2, 0)],
    [(4, 0.0, -1, 0), (14, 0.0, -1, 0), (10, 0.0, 1, 1), (8, 0.0, 1, 1), (55, 0.0, 1, 1), (18, 0.7, 1, 1), (40, 0.0, 1, 1), (22, 0.0, -1, 0), (3, 1.0, -1, 0)],
    # menus and lists of links inside an article
    [(12, 0.0, 1, 1), (75, 0.0, 1, 1), (2, 1.0, 1, 0), (3, 1.0, 1, 0), (2, 1.0, 1, 0), (1, 1.0, 1, 0), (48, 0.0, 1, 1), (90, 0.05, 1, 1), (4, 1.0, 1, 0), (5, 1.0, 1, 0), (3, 1.0, 1, 0)],
    [(2, 1.0, 1, 0), (1, 1.0, 1, 0), (3, 1.0, 1, 0), (9, 0.0, 1, 1), (66, 0.0, 1, 1), (28, 0.0, 1, 1), (2, 1.0, 1, 1), (51, 0.0, 1, 1)],
    # around an article: long and short asides without a name
    [(60, 0.0, -1, 0), (45, 0.0, -1, 0), (30, 0.0, -1, 0), (9, 0.0, 1, 1), (88, 0.0, 1, 1), (110, 0.0, -1, 0), (72, 0.0, -1, 0), (5, 0.0, -1, 0)],
    [(3, 1.0, -1, 0), (2, 1.0, -1, 0), (25, 0.1, -1, 0), (7, 0.0, 1, 1), (30, 0.0, 1, 1), (2, 0.0, 1, 1), (40, 0.3, -1, 0), (18, 0.9, -1, 0)],
    # pages without an article part
    [(1, 1.0, 0, 0), (2, 1.0, 0, 0), (1, 1.0, 0, 0), (9, 0.0, 0, 1), (62, 0.0, 0, 1), (48, 0.02, 0, 1), (5, 0.0, 0, 1), (85, 0.0, 0, 1), (31, 0.1, 0, 1), (4, 1.0, 0, 0), (3, 1.0, 0, 0), (6, 0.3, 0, 0)],
    [(3, 0.0, 0, 0), (2, 1.0, 0, 0), (4, 1.0, 0, 0), (3, 1.0, 0, 0), (7, 0.0, 0, 1), (140, 0.0, 0, 1), (8, 0.0, 0, 1), (40, 0.2, 0, 1), (55, 0.0, 0, 1), (6, 0.8, 0, 0), (2, 1.0, 0, 0)],
    [(5, 0.0, 0, 0), (4, 0.5, 0, 0), (24, 0.9, 0, 0), (12, 0.8, 0, 0), (10, 0.0, 0, 1), (26, 0.0, 0, 1), (19, 0.0, 0, 1), (70, 0.1, 0, 1), (3, 1.0, 0, 0), (5, 0.6, 0, 0), (4, 0.0, 0, 0)],
    [(2, 0.0, 0, 0), (3, 0.0, 0, 0), (2, 1.0, 0, 0), (6, 0.0, 0, 0), (5, 0.4, 0, 0), (40, 0.7, 0, 0), (18, 0.6, 0, 0), (3, 1.0, 0, 0), (2, 0.0, 0, 0)],
    [(12, 0.0, 0, 1), (90, 0.0, 0, 1), (33, 0.0, 0, 1), (16, 0.0, 0, 1), (58, 0.0, 0, 1), (4, 0.0, 0, 1), (77, 0.0, 0, 1), (21, 0.0, 0, 1)],
    [(2, 1.0, 0, 0), (1, 1.0, 0, 0), (4, 0.0, 0, 1), (80, 0.0, 0, 1), (3, 0.0, 0, 1), (52, 0.1, 0, 1), (2, 1.0, 0, 0), (3, 1.0, 0, 0), (2, 0.0, 0, 0), (4, 0.0, 0, 0)],
    [(3, 1.0, 0, 0), (2, 0.0, 0, 1), (45, 0.0, 0, 1), (6, 0.0, 0, 1), (38, 0.0, 0, 1), (5, 0.0, 0, 1), (64, 0.2, 0, 1), (4, 0.8, 0, 0), (1, 1.0, 0, 0)],
    [(1, 0.0, 0, 0), (2, 0.0, 0, 0), (1, 1.0, 0, 0), (6, 0.0, 0, 1), (100, 0.0, 0, 1), (1, 0.0, 0, 1), (29, 0.0, 0, 1), (5, 1.0, 0, 0), (6, 0.0, 0, 0), (3, 0.0, 0, 0)],
    [(2, 1.0, 0, 0), (35, 0.05, 0, 1), (42, 0.0, 0, 1), (3, 1.0, 0, 0), (2, 1.0, 0, 0), (15, 0.9, 0, 0), (3, 1.0, 0, 0), (60, 0.0, 0, 1), (27, 0.0, 0, 1), (1, 1.0, 0, 0)],
]
DEPTH = 6


def table(pages: list[list[tuple]] = LABELLED) -> list[tuple]:
    """The rows that the tree learns from: the features of every block that may be text, and its label."""
    rows = []
    for blocks in pages:
        for i, (words, density, where, label) in enumerate(blocks):
            if where != NEVER:
                rows.append((*features(blocks, i, words, density, where), label))
    return rows


def features(blocks: list, i: int, words: int, density: float, where: int) -> tuple:
    """Words and link density of block i and its neighbours (no words at an edge), and its place."""
    before = blocks[i - 1][:2] if i else (0, 0.0)
    after = blocks[i + 1][:2] if i + 1 < len(blocks) else (0, 0.0)
    return words, density, *before, *after, where


def grow(rows: list[tuple], depth: int = DEPTH):
    """A decision tree by Gini impurity: (feature, limit, tree up to the limit, tree above it), or the label of a leaf."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    impurity = lambda part: (p := sum(r[-1] for r in part)) * (len(part) - p) / len(part)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            score = impurity([r for r in rows if r[f] <= limit]) + impurity([r for r in rows if r[f] > limit])
            if best is None or score < best[0] - 1e-12:
                best = score, f, limit
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, limit = best
    return f, limit, grow([r for r in rows if r[f] <= limit], depth - 1), grow([r for r in rows if r[f] > limit], depth - 1)


def judge(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def place(tag: str, attrs: str, outer: int) -> int:
    """Where the inside of an element stands, given where the element stands. Furniture holds for all inside it."""
    if outer == NEVER:
        return outer
    names = [n for a, b, c in NAMES.findall(attrs) for n in (a or b or c).split()] if attrs else []
    if tag in FURNITURE or (tag == "header" and outer != INSIDE) or (tag not in ("html", "body", "main") and any(map(FURNITURE_NAME.fullmatch, names))):
        return NEVER
    return INSIDE if tag in ("article", "main") or any(map(ARTICLE_NAME.fullmatch, names)) else outer


def blocks(page: str) -> list[tuple[int, float, int, str]]:
    """The text blocks of a page in order: words, link density, place, text."""
    found, parts, linked = [], [], 0
    stack: list[tuple[str, int]] = [("", OPEN)]
    in_link, named = False, False  # named: the block's own element is furniture

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                found.append((len(words), min(1.0, linked / len(words)), NEVER if named else stack[-1][1], " ".join(words)))
        parts, linked = [], 0

    for m in TOKEN.finditer(page):
        text = m["text"]
        if m["open"] is not None and m["attrs"].strip() and "=" not in m["attrs"]:
            text = m[0]  # words after a '<', no tag
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text.split())
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                parts.append(" ")
            continue
        end = bool(m["end"])
        if tag in INLINE:
            if tag == "a":
                in_link = not end
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        named = tag not in NESTED and not end and bool(m["attrs"]) and place(tag, m["attrs"], stack[-1][1]) == NEVER
        if tag in NESTED:
            if not end:
                if tag == "li" and any(t == "li" for t, _ in stack[max((i for i, x in enumerate(stack) if x[0] in ("ul", "ol")), default=0) :]):
                    while stack.pop()[0] != "li":  # an item ends where the next one of its list begins
                        pass
                if not m["attrs"].endswith("/"):
                    stack.append((tag, place(tag, m["attrs"], stack[-1][1])))
            elif any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
                in_link = False
    flush()
    if any(where == INSIDE for _, _, where, _ in found):
        found = [(words, density, OUTSIDE if where == OPEN else where, text) for words, density, where, text in found]
    return found


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n".join(text for i, (words, density, where, text) in enumerate(found) if where != NEVER and judge(tree, features(found, i, words, density, where)))


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each whole page: its kept blocks in page order, one line each; empty if there are none.

    Null and empty pages give the empty text; pages of any length are read whole, each on its own (repeated rows and rows
    with equal or null ids too); an empty table gives no rows. Scripts, styles, comments and form controls are never text;
    unclosed tags and a cut-off end are read as far as they go, an unclosed element that is never text up to the next block,
    an unclosed script to its end tag. Columns of pages stay, whatever they are called; one named `out` is replaced.
    """
    base = pages.drop(out) if out != column else pages
    shaped = base.withColumn(out, F.lit("").cast("string"))
    tree = grow(table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                source = part.column(part.schema.get_field_index(column)).to_pylist()
                array = pa.array([main_text(v, tree) for v in source], pa.string())
                yield pa.RecordBatch.from_arrays([array if f.name == out else part.column(i) for i, f in enumerate(part.schema)], names=part.schema.names)

    return shaped.mapInArrow(run, shaped.schema)
