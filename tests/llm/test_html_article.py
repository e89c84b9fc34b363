"""The article of a page is found by density, not by names."""

from __future__ import annotations

import math
import random

import pytest

from ledgerline.llm import html

LINE = "A paragraph of some length, for the article."
BODY = "<h1>Head</h1>" + f"<p>{LINE}</p>" * 8
WANT = ["Head"] + [LINE] * 8
BESIDE = [
    '<div class="c1"><p>Copyright 2024 Some Company. All rights reserved.</p></div>',
    '<div class="letter-call"><p>Get our best stories by mail every week, for free.</p></div>',
    '<div class="col-right"><p><a href=a>Teaser one</a> <a href=b>Teaser two</a></p></div>',
    "<div><a href=/>Home</a></div>",
    '<div class="reader-voices"><p>I read this twice and it is a very good text, thank you so much for it, really.</p><p>Not so sure about the second half of it, to be honest.</p></div>',
]
BOXES = ["<article>%s</article>", '<div class="story">%s</div>', "<main><article>%s</article></main>", '<div id=wrap><nav>x</nav><div class="story">%s</div></div>']


@pytest.mark.parametrize("box", BOXES)
def test_blocks_of_unlisted_names_beside_an_article_go(box):
    for side in BESIDE:
        assert html.main_text(f"<body>{side}{box % BODY}</body>").split("\n\n") == WANT, side
        assert html.main_text(f"<body>{box % BODY}{side}</body>").split("\n\n") == WANT, side
    assert html.main_text("<body>" + "".join(BESIDE) + box % BODY + "".join(BESIDE) + "</body>").split("\n\n") == WANT


def test_an_advert_longer_than_a_short_article_goes():
    advert = '<div class="ad">' + "Buy this now, it is cheap. " * 5 + "</div>"
    assert html.main_text(f"{advert}<article><h1>Short</h1><p>Short</p></article>") == "Short\n\nShort"
    assert html.main_text(f"{advert}<article></article>") == ""
    assert html.main_text(f"<div class=widget>{BODY}</div><article>Teaser</article>").split("\n\n")[:9] == WANT


def test_what_belongs_to_an_article_stays():
    other = "<p>Another section of the article, with its own words in it.</p>" * 3
    lines = ["Another section of the article, with its own words in it."] * 3
    cases = {
        f"<body><h1>Title</h1><article>{BODY}</article></body>": ["Title", *WANT],
        f'<article><div class=lead><p>Short</p></div><div class=text>{BODY}</div><div class=end><p><a href=x>Source</a></p></div></article>': ["Short", *WANT, "Source"],
        f'<body><div class=part-1>{BODY}</div><div class=part-2>{other}</div></body>': [*WANT, *lines],
        f'<body><div class=wrap><div class=one>{BODY}</div><div class=two>{other}</div></div></body>': [*WANT, *lines],
        f"<body><section id=a>{BODY}</section><section id=b>{other}</section></body>": [*WANT, *lines],
        f"<body><div class=story>{BODY}</div><h2>Table</h2><table><tr><td>1</td><td>2</td></tr></table></body>": [*WANT, "Table", "1", "2"],
        f"<body><article>{BODY}</article><article>{other}</article></body>": [*WANT, *lines],
        "<body><div class=a><p>One text of a page</p></div><div class=b><p>One text of a page</p></div></body>": ["One text of a page"] * 2,
    }
    for page, want in cases.items():
        assert html.main_text(page).split("\n\n") == want, page


def test_without_the_density_step_unlisted_blocks_would_stay():
    page = f"<body>{BESIDE[0]}<div class=story>{BODY}</div>{BESIDE[4]}</body>"
    root = html.parse(page)
    html.reopen(root)
    assert html.text_of(root) != WANT and html.main_text(page).split("\n\n") == WANT


def _plain_counts(node):
    below = [_plain_counts(x) for x in node.parts if isinstance(x, html.Node) and not x.skip]
    own = node.chars, node.links, node.tags, node.link_tags
    return tuple(map(sum, zip(own, *(x[0] for x in below)))), below


def _plain_sums(counted, share):
    """Density and density sum of a node and all below, in the order of the page."""
    (chars, links, tags, link_tags), below = counted
    density, sums = 0.0, [_plain_sums(x, share) for x in below]
    if chars:
        base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
        inner = math.log(max(1.0, chars / max(1, links) * max(1, tags) / max(1, link_tags)))
        density = chars / max(1, tags) * inner / (math.log(base) if links or share else 1.0)  # without any link the logarithm is natural
    total = sum(x[0][0] for x in sums) or density
    return [(density, total), *(row for x in sums for row in x)]


def test_densities_agree_with_a_recursive_version():
    rng = random.Random(5)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            words = "word " * rng.randint(0, 40)
            return rng.choice([f"<p>{words}</p>", f"<a href=x>{words}</a>", words, f"<div><p>{words}<a href=y>more</a></p></div>", "<nav>x</nav>"])
        return "<div>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    def order(node):
        return [node, *(x for p in node.parts if isinstance(p, html.Node) and not p.skip for x in order(p))]

    for _ in range(200):
        root = html.parse(tree(4))
        html.reopen(root)
        counted = _plain_counts(root)
        want = _plain_sums(counted, counted[0][1] / max(1, counted[0][0]))
        nodes, parents = html.measure(root)
        for node, (density, total) in zip(order(root), want):
            assert node.density == pytest.approx(density, rel=1e-9, abs=1e-9) and node.total == pytest.approx(total, rel=1e-9, abs=1e-9)
        best = nodes[html.core_of(nodes, parents)]
        assert best.total == pytest.approx(max(t for _, t in want), rel=1e-9)
