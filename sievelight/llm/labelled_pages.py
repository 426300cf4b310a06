"""Small labelled table for main-text extraction: pages whose main blocks carry data-label.

The pages follow a few layouts that were labelled by hand, each with parts of several lengths: menus, site names, teasers, articles (in one
element, in sections, in bare or nested divs, in table cells), link-heavy paragraphs, lists, link lists, notes of readers and imprints.
No element has a class or an id, and none is a nav, aside, header, footer or form, so only the blocks' own measures tell them apart.
"""

from __future__ import annotations

import random

_WORDS = "the river town has kept its old mill since the last flood and visitors still ask about water wheels every summer while bakers nearby use flour from it for bread that is sold on market days along with honey and cheese".split()


class _Page:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, n: int) -> str:
        at = self.rng.randrange(len(_WORDS))
        return " ".join(_WORDS[(at + i) % len(_WORDS)] for i in range(n)).capitalize()

    def one(self, *options):
        return options[self.rng.randrange(len(options))]

    def size(self) -> int:
        """Words of a paragraph: mostly long, often short, sometimes a word or two."""
        return self.one(1, 2, self.rng.randint(3, 9), self.rng.randint(10, 30), self.rng.randint(30, 140), self.rng.randint(30, 140))

    def linked(self, n: int, share: float) -> str:
        """n words of which about a share stands in links."""
        out, left = [], n
        while left > 0:
            k = min(left, self.rng.randint(1, 5))
            out.append(f"<a href='/x'>{self.words(k)}</a>" if self.rng.random() < share else self.words(k))
            left -= k
        return " ".join(out)

    def paragraph(self, tag: str = "p") -> str:
        n = self.size()
        share = self.one(0, 0, 0, 0.1, 0.3) if n > 12 else 0
        return f"<{tag} data-label>{self.linked(n, share)}.</{tag}>"

    def article(self, tag: str = "p", least: int = 1, most: int = 9) -> str:
        out = [f"<h1 data-label>{self.words(self.rng.randint(1, 12))}</h1>"] if self.rng.random() < 0.8 else []
        for k in range(self.rng.randint(least, most)):
            if k and self.rng.random() < 0.12:
                out.append(f"<h2 data-label>{self.words(self.rng.randint(1, 6))}</h2>")
            if k and self.rng.random() < 0.1:
                out.append("<ul>" + "".join(f"<li data-label>{self.words(self.rng.randint(1, 14))}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>")
            out.append(self.paragraph(tag))
        return "".join(out)

    def menu(self) -> str:
        names = [f"<a href='/{i}'>{self.words(self.rng.randint(1, 3))}</a>" for i in range(self.rng.randint(3, 8))]
        return self.one("<ul>" + "".join(f"<li>{x}</li>" for x in names) + "</ul>", "<p>" + " | ".join(names) + "</p>", "<div>" + "".join(f"<div>{x}</div>" for x in names) + "</div>")

    def teaser(self) -> str:
        return f"<div>{self.words(self.rng.randint(2, 18))}.</div>"

    def related(self) -> str:
        return f"<div><h3>{self.words(self.rng.randint(1, 2))}</h3>" + "".join(f"<p><a href='/r'>{self.words(self.rng.randint(4, 12))}</a></p>" for _ in range(self.rng.randint(2, 6))) + "</div>"

    def readers(self) -> str:
        return f"<div><h3>{self.rng.randint(2, 9)} comments</h3>" + "".join(f"<div><p><a href='/u'>{self.words(1)}</a></p><p>{self.words(self.rng.randint(3, 30))}.</p></div>" for _ in range(self.rng.randint(2, 4))) + "</div>"

    def imprint(self) -> str:
        return f"<div>&copy; {self.linked(self.rng.randint(2, 14), 0.3)}</div>"

    def main(self) -> str:
        kind = self.rng.randrange(7)
        if kind == 0:
            return f"<article>{self.article()}</article>"
        if kind == 1:
            return f"<div>{self.article()}</div>"
        if kind == 2:
            return self.article()
        if kind == 3:
            return "<div>" + "".join(f"<section>{self.article(least=2, most=4)}</section>" for _ in range(self.rng.randint(2, 4))) + "</div>"
        if kind == 4:
            return f"<div>{self.article('div', 3)}</div>"
        if kind == 5:
            return f"<table><tr><td>{self.menu()}</td><td>{self.article(least=2)}</td></tr></table>"
        return f"<div><div>{self.article(least=2)}</div></div>"

    def html(self) -> str:
        if self.rng.random() < 0.4:  # a page that is nothing but its text, as pages that declare all else are
            return f"<body><article>{self.article(most=self.one(2, 12))}</article></body>"
        some = lambda f, share: f() if self.rng.random() < share else ""
        before = [some(self.teaser, 0.3), some(self.menu, 0.8), some(self.teaser, 0.5)]
        after = [some(self.related, 0.5), some(self.readers, 0.35), some(self.menu, 0.2), some(self.imprint, 0.8)]
        return f"<body>{''.join(before)}{self.main()}{''.join(after)}</body>"


def pages(n: int = 240, first: int = 0) -> list[str]:
    return [_Page(k).html() for k in range(first, first + n)]


PAGES = pages()
