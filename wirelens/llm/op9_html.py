"""HTML main-text extraction by tree scoring.

A page is parsed to a tree. Every paragraph-like block (also a div or section
with text and no blocks inside) passes points - one,
one more for each comma, and for each 100 characters up to three - to its
parent, half of them to the grandparent, a third to the next ancestors; a
container's points are discounted by the share of its text that lies in
links. The best container is kept, widened to the article or main element
around it, with those siblings that score a fifth of it; without such an
element, with all sibling blocks whose text is mostly not links.

Scripts, styles, forms, menus, header, footer and aside elements give and
keep nothing. Class, id and role speak by degrees. A part named as a menu,
header, footer, sidebar, notice, advert or reader comments by a whole token
(``sidebar``, ``cookie-banner``) goes, unless an article, main or h1 element
stands in it: then what it holds gives a tenth of its points, and it goes
unless the best container is in it. A part with such a word in a longer token
(``has-sidebar``, ``related-work``) gives half its points; it stays within
the kept container unless half its text is links. No word takes out the best
container or what is around it. Lists of links stay within an article or main
element; elsewhere they are menus. A page of parts that go has the empty text.

Text: character references are decoded, white space inside a block becomes
one space, blocks are joined in page order by a line feed.

Defined results: a null, empty or tagless page gives its bare text or the
empty string; unclosed and stray tags are tolerated; rows with null or
repeated ids each give their row; an empty table gives no rows; further
columns are ignored. Pages are worked on one at a time, whole.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre
search section summary table tbody td tfoot th thead tr ul""".split())
#: Blocks whose text scores, and elements that never hold main text.
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
SILENT = frozenset("""head script style noscript template iframe object svg canvas audio video form button select
textarea input datalist nav menu dialog""".split())
ASIDE = frozenset("header footer aside".split())
#: Words of a class, id or role that mark a part as no main text.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
comments commentlist consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav
navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related
replies reply respond search share sharing sidebar social sponsor sponsored subscribe subscription toolbar
complementary""".split())
#: Words that say nothing of their own beside a mark in one token.
FILLERS = frozenset("""area articles bar block body bottom box button buttons col column container content entry form global
group head icons inner item items left link links list main module outer page panel posts primary right row secondary section
signup site slot stories thread top unit user widget widgets wrap wrapper""".split())
ROOTS = frozenset(("main", "body", "html"))
#: Points of what stands in a part that a longer token, or a whole one, marks.
PARTLY, WHOLLY = 0.5, 0.1
#: An open element of the first kind ends at the start of one of the second.
ENDS = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
#: Elements beyond which an end of that kind doesn't reach.
WALLS = frozenset("table ul ol dl div section article main aside body html blockquote".split())


class Node:
    """``weight``: 1, PARTLY or WHOLLY as its names mark it; ``holds``:
    whether an article, main or h1 element that no name marks is in it."""

    __slots__ = ("tag", "marks", "up", "kids", "weight", "holds")

    def __init__(self, tag, marks, up, weight=1.0):
        self.tag, self.marks, self.up, self.kids = tag, marks, up, []
        self.weight, self.holds = weight, False


def named(found: str) -> tuple[frozenset, float]:
    """The words of class, id and role, and the weight that they give."""
    words, weight = set(), 1.0
    for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", found).lower().split():
        parts = re.findall(r"[a-z]+", token)
        words.update(parts)
        if not MARKS.isdisjoint(parts):
            weight = min(weight, WHOLLY if all(w in MARKS or w in FILLERS for w in parts) else PARTLY)
    return frozenset(words), weight


class Tree(HTMLParser):
    """Nodes with text strings and nodes as kids."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", frozenset(), None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        node = self.at
        while node is not None and node.tag not in WALLS | {tag} or node is not None and node.tag in ENDS:
            if tag in ENDS.get(node.tag, ()):
                self.at = node.up
                break
            if node.tag in WALLS:
                break
            node = node.up
        found = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        marks, weight = named(found) if found and tag not in ROOTS else (frozenset(), 1.0)
        child = Node(tag, marks, self.at, weight)
        self.at.kids.append(child)
        if tag in ("article", "main", "h1") and weight > WHOLLY:
            up = self.at
            while up is not None and not up.holds:
                up.holds, up = True, up.up
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "p", "div"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in ("table", "article", "main") and tag not in ("article", "main", "table"):
                return  # a stray end tag doesn't close what is around
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


def silent(node: Node) -> bool:
    """Whether nothing of the node is main text, whatever is around it."""
    return node.tag in SILENT or node.tag in ASIDE or node.weight == WHOLLY and not node.holds and node.tag != "article"


def gone(node: Node, spared: set, size: dict) -> bool:
    """Whether the node goes from the kept containers; ``spared`` are the
    best container and all around it."""
    if silent(node):
        return True
    if node.weight == 1 or node in spared:
        return False
    s = size.get(node, (0, 0, 0))
    return node.weight == WHOLLY or s[0] > 0 and 2 * s[1] >= s[0]


def paragraph(node: Node) -> bool:
    """A block of text: of such an element, or a div or section with text of
    its own and no blocks inside."""
    return node.tag in PARAGRAPH or node.tag in ("div", "section") and any(
        isinstance(k, str) and k.strip() for k in node.kids) and not any(isinstance(k, Node) and k.tag in BLOCK for k in node.kids)


def measure(root: Node):
    """Depth-first: per node its text length, link text length and commas,
    and the points passed to the containers."""
    size: dict[Node, list] = {}
    points: dict[Node, float] = {}
    stack = [(root, False, 0, 1.0)]
    while stack:
        node, done, inlink, weight = stack.pop()
        if not done:
            weight *= node.weight
            stack.append((node, True, inlink, weight))
            size[node] = [0, 0, 0]
            for kid in node.kids:
                if isinstance(kid, str):
                    n = len(" ".join(kid.split()))
                    s = size[node]
                    s[0] += n
                    s[2] += kid.count(",") + kid.count("，") + kid.count("、")
                    if inlink or node.tag == "a":
                        s[1] += n
                elif not silent(kid):
                    stack.append((kid, False, inlink or node.tag == "a", weight))
            continue
        s = size[node]
        if node.up is not None and node.up in size:
            for k in range(3):
                size[node.up][k] += s[k]
        if s[0] > 0 and paragraph(node):
            give = weight * (1 + s[2] + min(s[0] / 100, 3)) * (1 - s[1] / s[0])
            up, level = node.up, 0
            while up is not None and give > 0:
                points[up] = points.get(up, 0.0) + give / (1, 2, 3, 6, 9)[min(level, 4)]
                up, level = up.up, level + 1
    return size, {c: p * (1 - size[c][1] / max(1, size[c][0])) for c, p in points.items() if c in size}


def chosen(root: Node) -> tuple[list[Node], set, dict, bool]:
    """The kept containers in page order, the best container with all around
    it, the sizes of nodes, and whether an article or main element is kept."""
    size, points = measure(root)
    if not points:
        tops = [n for n in size if n.tag in ("article", "main") and size[n][0]]
        return tops[:1] or [root], set(tops[:1]), size, bool(tops)
    best = max(points, key=lambda c: points[c])  # the first of equals
    around, up, spared = None, best, set()
    while up is not None:
        spared.add(up)
        if around is None or around.tag != "article" and "article" not in around.marks:
            if up.tag == "article" or "article" in up.marks and up.tag not in ROOTS:
                around = up
            elif up.tag == "main" or "main" in up.marks and up.tag == "div":
                around = around or up
        up = up.up
    best_points = points[best]
    top = around or best
    if top.up is None:
        return [top], spared, size, False
    kept = []
    for kid in top.up.kids:
        if isinstance(kid, str) or kid not in size or gone(kid, spared, size):
            continue
        own = points.get(kid, 0.0)
        if around is None and kid.weight == 1 and kid.tag in BLOCK and 4 * size[kid][1] < size[kid][0]:
            kept.append(kid)  # nothing marks where the text ends: all but links stays
            continue
        if kid.tag in PARAGRAPH and top.tag != "article":
            n, linked, commas = size[kid]
            own = best_points if n > 80 and linked < n / 4 or n and not linked and commas else own
        if kid is top or own >= max(3.0, best_points / 5) and (top.tag != "article" or kid.tag in ("article", "section", "div", "main")):
            kept.append(kid)
    return kept, spared, size, around is not None


def linked_list(node: Node, size: dict) -> bool:
    """A list whose text is all links is a menu."""
    s = size.get(node)
    return node.tag in ("ul", "ol", "menu") and s is not None and s[0] > 0 and s[1] >= 0.9 * s[0] and sum(
        not isinstance(k, str) and k.tag == "li" for k in node.kids) > 1


def blocks(nodes: list[Node], spared: set, size: dict, links: bool) -> list[str]:
    out, run = [], []

    def end():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack = [n for n in reversed(nodes)]
    while stack:
        node = stack.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif not gone(node, spared, size) and (links or not linked_list(node, size)):
            inside = list(reversed(node.kids))
            if node.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(inside)
    end()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    nodes, spared, size, marked = chosen(Tree(html).root)
    return "\n".join(blocks(nodes, spared, size, marked))


def with_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in column ``out``."""
    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in htmls], dtype=object)

    return pages.withColumn(out, extract(F.col(html)))


def query(pages: DataFrame) -> DataFrame:
    d = with_main_text(pages.select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
