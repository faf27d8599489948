"""The labelled pages that the decision tree of ``html_text`` is trained on.

Each page comes with the texts of its main blocks; every other block of the page is boilerplate. Some pages are
written out; the others are drawn by rule, with a seed: main blocks of 1 to 80 words, linked or not, in any order and
also last, as paragraphs, headings, list entries, quotations and table cells; menus, teasers, notices, adverts, comments
and footers of all lengths around and inside; with main containers by tag or by name, or with none, where only words,
links and neighbours tell.
"""

from __future__ import annotations

import random

_LONG = "The river rose by two metres in a single night and the lower town was cut off from the road until the army brought boats and food for those who had stayed."
_MORE = "Engineers had warned for years that the dyke would not hold, and the council had put money aside, but work was to begin only after the next harvest."
_LINKED = 'Readers of our <a href="/old">first report</a> will remember that the same bridge was closed in spring after cracks were found in two of its piers.'
_CLEAN_LINKED = "Readers of our first report will remember that the same bridge was closed in spring after cracks were found in two of its piers."
_NAV = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul>'
_LINKS = "<ul><li><a href=/1>Ten photographs of the flood you have to see</a></li><li><a href=/2>Why the dyke was never built</a></li><li><a href=/3>What the mayor said next</a></li></ul>"

#: (page, main blocks)
PAGES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (f"<body><nav>{_NAV}</nav><article><h1>River floods town</h1><p>{_LONG}</p><p>{_MORE}</p><p>Short one.</p></article><footer>All rights reserved</footer></body>", ("River floods town", _LONG, _MORE, "Short one.")),
    (f"<body><header><a href=/>The Daily</a><p>News since 1902</p></header><main><h1>River</h1><h2>Night of fear</h2><p>{_LONG}</p><p>{_LINKED}</p><div class=ad>Buy two boats and get one free this week only</div><p>{_MORE}</p></main><aside>{_LINKS}</aside></body>", ("River", "Night of fear", _LONG, _CLEAN_LINKED, _MORE)),
    (f"<body><div>{_NAV}</div><div><h1>River floods town</h1><p>{_LONG}</p><p>Two people are missing.</p><p>{_MORE}</p></div><div>{_LINKS}</div><div>Contact us</div></body>", ("River floods town", _LONG, "Two people are missing.", _MORE)),
    (f"<body><div><a href=/>Home</a> <a href=/b>Blog</a> <a href=/c>About me</a></div><h2>A wet week</h2><p>{_LONG}</p><p>{_LINKED}</p><p>{_MORE}</p><p><a href=/p>Previous post</a></p><p><a href=/n>Next post</a></p></body>", ("A wet week", _LONG, _CLEAN_LINKED, _MORE)),
    (f"<body><table><tr><td>{_NAV}</td><td><p>{_LONG}</p><p>{_MORE}</p></td></tr></table><p>Terms</p></body>", (_LONG, _MORE)),
    (f"<body><div id=cookie-notice>We use cookies to give you the best experience on our site and to show you adverts that you may like.<button>Accept</button></div><article><p>{_LONG}</p><ul><li>Two dead</li><li>Forty homes lost</li></ul><p>{_MORE}</p></article><div id=comments><p>{_LINKED}</p><p>I do not believe a word of this, they said the same thing ten years ago and nothing came of it.</p></div></body>", (_LONG, "Two dead", "Forty homes lost", _MORE)),
    (f"<body><article class=post><h1>Soup</h1><p>Serves four.</p><h2>Ingredients</h2><ul><li>Leeks</li><li><a href=/stock>Stock</a></li><li>Cream</li></ul><h2>Method</h2><p>{_MORE}</p></article><form><label>Search</label><input></form><div class=sidebar><h3>More recipes</h3>{_LINKS}</div></body>", ("Soup", "Serves four.", "Ingredients", "Leeks", "Stock", "Cream", "Method", _MORE)),
    (f"<body><div class=content><p>{_LONG}</p><div class=share>Share this on your page</div><blockquote class=loud>Leave your houses at once, said the loudspeakers.</blockquote><p>{_MORE}</p></div><div class=newsletter>Sign up for our letter and read it first every single morning</div></body>", (_LONG, "Leave your houses at once, said the loudspeakers.", _MORE)),
    (f"<body><div><a href=/a>World</a></div><div><a href=/b>Europe</a></div><div><p>{_MORE}</p><p>{_LONG}</p></div><div><a href=/x>Imprint</a> | <a href=/y>Privacy</a> | <a href=/z>Jobs at the paper</a></div></body>", (_MORE, _LONG)),
    (f"<body><article><a href=/full><div>{_LINKED}</div></a><h1>The bridge</h1><p>{_LONG}</p><p><a href=/m>{_MORE}</a></p></article></body>", (_CLEAN_LINKED, "The bridge", _LONG, _MORE)),
    (f"<body><div class=menu>{_NAV}</div><div><h1>Notes</h1><p>Rain again.</p><p>{_LONG}</p></div><div class=footer><p>{_MORE}</p></div></body>", ("Notes", "Rain again.", _LONG)),
    (f"<body><div>{_LINKS}</div><h1>Bridge closed</h1><div><p>{_LINKED}</p><p>{_LONG}</p></div><div><a href=/1>Bridge</a>, <a href=/2>river</a>, <a href=/3>town hall</a></div></body>", ("Bridge closed", _CLEAN_LINKED, _LONG)),
    (f"<article><p>{_LONG}</p><p>{_MORE}</p></article>", (_LONG, _MORE)),
    ("<body><main><p>Nothing happened today.</p></main></body>", ("Nothing happened today.",)),
    (f"<body><h1>River</h1><p>{_LONG}</p><p>{_MORE}</p></body>", ("River", _LONG, _MORE)),
    (f"<body><p>{_LONG}</p><p>{_LINKED}</p></body>", (_LONG, _CLEAN_LINKED)),
    (f"<body><p>{_MORE}</p></body>", (_MORE,)),
    (f"<body><main><h1>Links</h1>{_LINKS}<p>Done.</p></main><footer>{_NAV}<p>{_LONG}</p></footer></body>", ("Links", "Ten photographs of the flood you have to see", "Why the dyke was never built", "What the mayor said next", "Done.")),
    (f"<body><article><h2>List</h2><ul><li><a href=/1>One</a></li><li>Two</li><li><a href=/3>Three</a></li></ul></article><aside><p>{_MORE}</p></aside></body>", ("List", "One", "Two", "Three")),
    (f"<body><nav>{_NAV}</nav><p>{_LONG}</p><div class=advert>{_MORE}</div><p>{_LINKED}</p><form><p>{_MORE}</p></form></body>", (_LONG, _CLEAN_LINKED)),
    (f"<body><div class=sidebar><p>{_MORE}</p></div><article><p>{_LONG}</p><aside><p>{_LINKED}</p></aside><p>Ends here.</p></article></body>", (_LONG, "Ends here.")),
    (f"<body><div><a href=/>Start</a></div><p>{_LONG}</p><p>Only then did it stop.</p><p>{_MORE}</p><p>Contact</p></body>", (_LONG, "Only then did it stop.", _MORE)),
    (f"<body><header><p>{_LINKED}</p></header><main><p>{_LONG}</p></main></body>", (_LONG,)),
    (f"<body><article><h1>Notes</h1><p>One.</p><p>Two.</p><p>Three.</p></article><div class=comments><article><p>{_LONG}</p></article></div></body>", ("Notes", "One.", "Two.", "Three.")),
    ("<body><article><p><a href=/a>All of it is linked</a></p></article></body>", ("All of it is linked",)),
    (f"<body><div><p>Imprint</p></div><h2>Dyke</h2><p>{_MORE}</p><p>{_LONG}</p><div><a href=/1>More</a></div></body>", ("Dyke", _MORE, _LONG)),
)


_WORDS = "the of and a to in on with for from river town night road boat dyke council money harvest work year bridge pier report water army house street rain week mayor school field train".split()
_NAMES = {
    "notice": ["cookie-notice", "alert", "consent-box", "newsletter-signup", "site-notice"],
    "advert": ["ad", "ads", "advert", "ad-box", "sponsored", "promo", "banner-ad"],
    "comments": ["comments", "comment-list", "post-comments", "replies", "disqus_thread"],
    "menu": ["menu", "nav", "main-nav", "breadcrumbs", "toolbar"],
    "side": ["sidebar", "related-posts", "widget", "share-buttons", "recommended"],
    "foot": ["footer", "site-footer", "page-footer"],
}


class _Drawn:
    """One page by rule; ``main`` collects the texts of its main blocks, no text stands twice."""

    def __init__(self, seed: int):
        self.draw, self.count, self.main = random.Random(seed), 0, []
        self.seed = seed

    def text(self, low: int, high: int) -> str:
        self.count += 1
        n = self.draw.randint(low, high)
        return " ".join([f"{self.draw.choice(_WORDS).title()}{self.seed}x{self.count}", *(self.draw.choice(_WORDS) for _ in range(n - 1))])

    def linked(self, text: str, share: float) -> str:
        words = text.split()
        n = round(share * len(words))
        return f"<a href=/{self.count}>{' '.join(words[:n])}</a> {' '.join(words[n:])}" if n else text

    def body_block(self, plain: bool) -> str:
        """A main block; plain: without telling names around, where short linked ones can't be told from a menu."""
        kind = self.draw.choice(["p"] * 6 + ["li", "h2", "blockquote", "td", "pre"])
        if plain:
            kind = self.draw.choice(["p"] * 5 + ["h2"])
            text, share = (self.text(2, 8), 0.0) if kind == "h2" else (self.text(*self.draw.choice([(12, 80), (12, 80), (2, 10)])), self.draw.choice([0.0, 0.0, 0.1, 0.25]))
        else:
            text, share = self.text(*self.draw.choice([(1, 1), (1, 3), (2, 10), (10, 30), (20, 80)])), self.draw.choice([0.0, 0.0, 0.0, 0.2, 0.6, 1.0])
        self.main.append(text)
        inner = self.linked(text, share)
        wraps = {"li": f"<ul><li>{inner}</li></ul>", "td": f"<table><tr><td>{inner}</td></tr></table>"}
        return wraps.get(kind, f"<{kind}>{inner}</{kind}>")

    def links(self) -> str:
        return "<ul>" + "".join(f"<li><a href=/{k}>{self.text(1, 9)}</a></li>" for k in range(self.draw.randint(2, 7))) + "</ul>"

    def boiler(self, kind: str, inside: str) -> str:
        """Boilerplate with a telling name or tag; inside: what it holds, links, text or both."""
        name = self.draw.choice(_NAMES[kind])
        holds = {"links": self.links, "text": lambda: f"<p>{self.text(1, 60)}</p>", "both": lambda: f"<p>{self.text(3, 40)}</p>{self.links()}"}[inside]()
        if self.draw.random() < 0.3:
            holds = f"<h{self.draw.randint(1, 4)}>{self.text(1, 6)}</h3>{holds}"
        tag = {"menu": "nav", "side": "aside", "foot": "footer"}.get(kind)
        if tag and self.draw.random() < 0.5:
            return f"<{tag}>{holds}</{tag}>"
        if inside == "text" and self.draw.random() < 0.4:
            tag = self.draw.choice(["p", "blockquote", "section", "div"])
            return f'<{tag} class="{name}">{self.text(1, 40)}</{tag}>'
        return f'<div {self.draw.choice(["class", "id"])}="{name}">{holds}</div>'

    def page(self) -> tuple[str, tuple[str, ...]]:
        some = lambda *kinds: "".join(self.boiler(k, self.draw.choice(["links", "text", "both"])) for k in kinds if self.draw.random() < 0.6)
        plain = self.draw.random() < 0.35
        if plain:
            # no name or tag tells the article; around it only lists of links and very short lines
            top = f"<div>{self.links()}</div>" if self.draw.random() < 0.8 else ""
            body = [self.body_block(True) for _ in range(self.draw.randint(2, 9))]
            first = self.text(15, 50)
            self.main.append(first)
            body.insert(self.draw.randint(0, len(body)), f"<p>{first}</p>")
            end = f"<div>{self.links()}</div>" if self.draw.random() < 0.6 else ""
            end += f"<div>{self.text(1, 2)}</div>" if end and self.draw.random() < 0.5 else ""
            return f"<body>{some('menu', 'notice')}{top}<div>{''.join(body)}</div>{end}{some('comments', 'side', 'foot')}</body>", tuple(self.main)
        body = [self.body_block(False) for _ in range(self.draw.randint(1, 9))]
        for _ in range(self.draw.randint(0, 2)):
            body.insert(self.draw.randint(0, len(body)), self.boiler(self.draw.choice(["advert", "notice", "side"]), "text"))
        open_, close = self.draw.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<section id=story>", "</section>"), ("<main><article class=post>", "</article></main>")])
        before, behind = "", ""
        if self.draw.random() < 0.3:
            title = self.text(2, 9)
            self.main.append(title)
            before = f"<h1>{title}</h1>"
        if self.draw.random() < 0.4:
            behind = f"<section><h2>{self.text(1, 4)}</h2>" + "".join(f"<div><p>{self.text(1, 50)}</p></div>" for _ in range(self.draw.randint(1, 4))) + "</section>"
        top = some("menu", "notice") + (f"<header><h1>{self.text(1, 4)}</h1><p>{self.text(1, 12)}</p></header>" if self.draw.random() < 0.3 else "")
        end = some("comments", "side", "foot")
        return f"<body>{top}{before}{open_}{''.join(body)}{close}{behind}{end}</body>", tuple(self.main)


def labelled_pages(drawn: int = 150, seed: int = 1) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The written and ``drawn`` pages by rule: (page, main blocks)."""
    return PAGES + tuple(_Drawn(seed * 100_000 + k).page() for k in range(drawn))
