"""Class words lower points and don't decide alone; scoring against brute force."""

import random

import pytest

from wirelens.llm import op9_html
from wirelens.llm.op9_html import Tree, gone, main_text, measure, paragraph, silent

P = "Plain text with commas, one, two, and so on. " * 6
T = P.strip()
COMMENTS = f"<div class='comments'><p>{P}</p><p>{P}</p><p>{P}</p></div>"
NOTICE = "<div class='cookie-notice'><p>We use cookies, many, for you.</p></div>"


@pytest.mark.parametrize("html, want", [
    # a class of the page's frame that names a sidebar
    (f"<body><div class='layout has-sidebar'>{NOTICE}<article><h1>Title</h1><p>{P}</p></article><div class=sidebar><p>{P}</p></div>{COMMENTS}</div></body>", ["Title", T]),
    (f"<body><div class='sidebar'>{NOTICE}<article><h1>Title</h1><p>{P}</p></article>{COMMENTS}</div></body>", ["Title", T]),
    (f"<body><div id='modal'><h1>Title</h1><p>{P}</p></div>{COMMENTS}</body>", ["Title", T]),
    # words in longer tokens, within an article or main element
    (f"<article><div class='post-header'><h1>Title</h1></div><p>{P}</p><section class='related-work'><h2>Related work</h2><p>{P}</p></section>"
     f"<div id='social-history'><p>Social</p></div><div class='ad-hoc'><p>Ad hoc</p></div></article>", ["Title", T, "Related work", T, "Social", "Ad hoc"]),
    (f"<main><div class='ad-hoc'><p>{P}</p></div><div class='ad-slot'><p>Buy, buy, buy</p></div></main>", [T]),
    # references of an article stay, a menu beside the text of a plain page goes
    (f"<article><p>{P}</p><h2>References</h2><ol><li><a href=a>One</a></li><li><a href=b>Two</a></li></ol></article>", [T, "References", "One", "Two"]),
    (f"<body><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><div><p>{P}</p></div></body>", [T]),
    # half links under a word: goes also within the article
    (f"<article><p>{P}</p><div class='wp-share-tools'><a href=a>Post it</a> <a href=b>Send it</a></div></article>", [T]),
    # comments within the article, and a page of nothing else
    (f"<article><p>{P}</p>{COMMENTS}</article>", [T]),
    (f"<article><p>{P}</p><ol class='comment-list'><li class=comment><article class='comment-body'><p>{P}</p><p>{P}</p></article></li></ol></article>", [T]),
    (COMMENTS + NOTICE, []),
    # an article named like an advert is kept where it is all there is
    (f"<body><article class='promoted'><p>{P}</p></article></body>", [T]),
])
def test_marks(html, want):
    assert main_text(html) == "\n".join(want)


def brute(root):
    """Points of containers by the rule of the docstring, by recursion."""
    def texts(n, linked=False):
        linked = linked or n.tag == "a"
        for k in n.kids:
            if isinstance(k, str):
                yield k, linked
            elif not silent(k):
                yield from texts(k, linked)

    def each(n, ups, weight):
        weight *= n.weight
        got = list(texts(n, any(u.tag == "a" for u in ups)))
        size = sum(len(" ".join(t.split())) for t, _ in got)
        links = sum(len(" ".join(t.split())) for t, x in got if x)
        share[n] = links / max(1, size)
        if size and paragraph(n):
            give = weight * (1 + sum(t.count(",") for t, _ in got) + min(size / 100, 3)) * (1 - links / size)
            for k, up in enumerate(reversed(ups)):
                if give > 0:
                    points[up] = points.get(up, 0.0) + give / (1, 2, 3, 6, 9)[min(k, 4)]
        for k in n.kids:
            if not isinstance(k, str) and not silent(k):
                each(k, [*ups, n], weight)

    points, share = {}, {}
    each(root, [], 1.0)
    return {n: p * (1 - share[n]) for n, p in points.items()}


def page(r, depth=0):
    out = []
    for _ in range(r.randint(1, 4)):
        tag = r.choice(["div", "section", "p", "ul", "article", "main", "aside", "nav", "span", "a", "blockquote", "h1"])
        name = r.choice(["", "", "", " class='comments'", " class='has-sidebar'", " id='ad-slot'", " class='related-work post'", " role='banner'"])
        text = r.choice(["", "one, two", "three " * r.randint(1, 60), "x"])
        inside = page(r, depth + 1) if depth < 4 and tag not in ("p", "a", "span", "h1") and r.random() < 0.7 else ""
        out.append(f"<{tag}{name}>{text}{inside}</{tag}>")
    return "".join(out)


def test_points_against_brute_force():
    r = random.Random(5)
    for _ in range(300):
        root = Tree(page(r)).root
        size, points = measure(root)
        want = brute(root)
        assert set(points) == set(want) and all(abs(points[n] - want[n]) < 1e-9 for n in want)
        if points:  # no word takes out the best container or what is around it
            _, spared, size, _ = op9_html.chosen(root)
            best = max(points, key=lambda c: points[c])
            up = best
            while up is not None:
                assert up in spared and not gone(up, spared, size)
                up = up.up
