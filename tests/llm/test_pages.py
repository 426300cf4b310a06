"""Main text of pages: golden pages labelled by hand, and blocks against Python's own HTML parser."""

import random
from html.parser import HTMLParser

import numpy as np
import pytest

from sievelight.llm import html_main
from sievelight.llm.labelled_pages import PAGES, pages

BAKER = "Every Friday the bakery on Mill Lane sells out before nine, and its owner says that nothing but the flour has changed in thirty years."
RIVER = "The river rose by two metres in one night. Volunteers carried sandbags until dawn, while the council opened the school hall for those who had to leave their homes."
GUIDE = "Before you begin, switch the device off and wait for the lamp to go out. A screwdriver and a clean cloth are all that is needed for the steps below."
TALE = "She had never seen the sea, though she had drawn it many times: flat, blue, and without an end, as the schoolbooks had it."

#: (page, the text that a reader would keep)
GOLDEN = [
    (  # a blog, with names as blogs have them
        f"""<!doctype html><html><head><title>Flour</title><script>if (a < b) run("<p>no</p>")</script></head><body class="home page">
        <div id="masthead"><a href="/">The Crumb</a><p>A blog on bread</p></div><div class="nav-menu"><ul><li><a href="/a">About</a></li><li><a href="/r">Recipes</a></li></ul></div>
        <div class="entry-content"><h1>Thirty years of flour</h1><p>{BAKER}</p><p>Not the oven.</p><p>{TALE} <a href="/sea">Read about the sea</a> &amp; more.</p><blockquote>Bread is patience.</blockquote></div>
        <div class="share-buttons"><a href="/t">Share</a></div><div id="comments"><h3>2 comments</h3><p>{RIVER}</p><p>Lovely!</p></div><div class="sidebar"><h4>Recent</h4><ul><li><a href="/1">Rye</a></li></ul></div><div id="footer">Imprint</div></body></html>""",
        f"Thirty years of flour {BAKER} Not the oven. {TALE} Read about the sea & more. Bread is patience.",
    ),
    (  # news without any name
        f"""<body><div><a href="/">Daily</a></div><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/m">Money matters</a></li></ul>
        <div><h1>Flood in the lower town</h1><p>{RIVER}</p><p>No one was hurt.</p><p>{BAKER} {RIVER}</p><p>{TALE}</p></div>
        <div><h3>More</h3><p><a href="/2">Bridge closed for repairs until spring</a></p><p><a href="/3">Council meets on Monday about the dam</a></p></div><div>&copy; Daily <a href="/i">Imprint</a></div></body>""",
        f"Flood in the lower town {RIVER} No one was hurt. {BAKER} {RIVER} {TALE}",
    ),
    (  # a manual in sections, its frame is one form
        f"""<form method="post"><header><p>Support</p></header><nav><a href="/">Home</a></nav><main><section><h2>Cleaning</h2><p>{GUIDE}</p><ol><li>Open the lid.</li><li>Wipe the lens.</li></ol></section>
        <section><h2>Storage</h2><p>{GUIDE} {BAKER}</p><p>Done.</p></section></main><footer><p>Was this page of help? <button>Yes</button></p></footer></form>""",
        f"Cleaning {GUIDE} Open the lid. Wipe the lens. Storage {GUIDE} {BAKER} Done.",
    ),
    (  # an old page of tables, tags left open
        f"""<table><tr><td><a href=a>One<br><a href=b>Two</a><br><a href=c>Three</a><td><font size=2><h2>A tale</h2>{TALE}<p>{TALE} {RIVER}<p>And so on.</font></table>""",
        f"A tale {TALE} {TALE} {RIVER} And so on.",
    ),
    ("<p>Only four words here.</p>", "Only four words here."),
    (f"<div class=page><p>{GUIDE}</p><p>Hi.</p></div>", f"{GUIDE} Hi."),
    (f"<noscript><div><p>{RIVER} {BAKER}</p></div></noscript>", f"{RIVER} {BAKER}"),
    (f"<main><article><header><h1>Log</h1></header><p>{TALE}</p><aside>{RIVER}</aside><div class='advert'>{GUIDE}</div><p>End.</p></article></main><aside>{BAKER}</aside>", f"Log {TALE} End."),
    ("<nav><ul><li><a href='/x'>only</a></li><li>a menu</li></ul></nav><div class='cookie-notice'>We use cookies.</div>", ""),
]


@pytest.fixture(scope="module")
def tree():
    return html_main.train(PAGES)


def test_golden_pages(tree):
    """Words kept and words that should have been, over all pages: what the README states."""
    kept = wanted = both = 0
    for page, want in GOLDEN:
        got = html_main.main_text(tree, page)
        a, b = got.split(), want.split()
        common = sum(min(a.count(w), b.count(w)) for w in set(a))
        kept, wanted, both = kept + len(a), wanted + len(b), both + common
        assert not a or common >= 0.8 * max(len(a), len(b)), (got, want)
    print(f"recall {both / wanted:.3f}, precision {both / kept:.3f}")
    assert both >= 0.97 * wanted and both >= 0.97 * kept


def test_pages_that_the_tree_has_not_seen(tree):
    found = [html_main.undeclared(html_main.flat_blocks(p)) for p in pages(200, 10_000)]
    y, n = np.array([b.label for f in found for b in f]), np.array([b.words for f in found for b in f])
    keep = np.concatenate([html_main.leaves(tree, html_main.features(f)) for f in found]) >= 0.5
    assert n[keep & (y == 1)].sum() > 0.97 * n[y == 1].sum() and n[keep & (y == 1)].sum() > 0.98 * n[keep].sum()


def test_the_tree_looks_at_links_and_neighbours(tree):
    def used(t):
        return set() if len(t) == 1 else {html_main.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert {"words", "link_density"} <= used(tree) and {"density_before", "density_after", "words_before", "words_after"} & used(tree)


class Plain(HTMLParser):
    """Block texts as Python's parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip = [], "", 0

    def cut(self):
        if self.text.split():
            self.out.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.skip += tag in html_main.RAW_TAGS
        if tag in html_main.BLOCK_TAGS:
            self.cut()

    def handle_endtag(self, tag):
        self.skip -= tag in html_main.RAW_TAGS
        if tag in html_main.BLOCK_TAGS:
            self.cut()

    def handle_data(self, data):
        if not self.skip:
            self.text += data


def test_blocks_against_the_parser():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<div class='a>b'>", "</div>", "<br>", "<b>", "</b>", "word ", "two  words\n", "&amp;", "&lt;p&gt;", "é ", "<a href='/x'>", "</a>", "<!-- <p>no</p> -->", "<script>var a = '<p>';</script>", "<style>p{}</style>", "<li>", "<h2>", "</h2>", "<td>", "<section>", "</section>", "1 < 2 ", "<title>t</title>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for page in [*made, *PAGES[:60], *[p for p, _ in GOLDEN]]:
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.cut()
        assert [b.text for b in html_main.flat_blocks(page)] == plain.out, page


def test_measures_by_their_definition():
    for page in PAGES[:80] + [p for p, _ in GOLDEN]:
        found = html_main.undeclared(html_main.flat_blocks(page))
        x = html_main.features(found)
        for i, b in enumerate(found):
            near = {c: (found[i + d].words, found[i + d].linked / found[i + d].words) if 0 <= i + d < len(found) else (0, 0) for c, d in (("before", -1), ("after", 1))}
            assert x[i, :6].tolist() == [b.words, b.linked / b.words, *near["before"], *near["after"]]
            assert 0 <= x[i, 7] <= 1 and x[i, 8] <= 1 and x[i, 9] >= b.words
    assert html_main.features([]).shape == (0, len(html_main.FEATURES))
