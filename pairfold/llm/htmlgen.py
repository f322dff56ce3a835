"""Invented pages with a known main text, to train the block labeller on.

Each page mixes one of many ways to mark up each region. Words are random syllables, so that the labeller has to learn from
tag paths, lengths, links and order, and from the few words that boilerplate is made of.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber co da el fi go hu in ja ke lo mi na or pa que ra si tu un vo wa xi yo ze th er on re ti st".split()
#: Words that name regions of a page (fixed values).
MENU = "home about news contact login register search menu shop blog archive sitemap help account categories next previous skip".split()
NOTICE = "we use cookies accept consent privacy policy notice this site agree settings decline browser javascript enable please".split()
ADVERT = "advertisement sponsored ad promoted buy now offer sale discount shop deal click here free".split()
FOOT = "copyright all rights reserved terms privacy powered by contact imprint © sitemap".split()
REMARK = "reply says comment posted by thanks great post report like share anonymous ago".split()
ASIDE = "related popular recent posts tags trending read more see also archive subscribe follow share".split()
FORM = "email name submit send subscribe newsletter password search sign up your message".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.known = ["".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 2, 2, 3, 4)))) for _ in range(400)]

    def pick(self, *of: str) -> str:
        return self.r.choice(of)

    def words(self, lo: int, hi: int, extra: list[str] | None = None, share: float = 0.5) -> str:
        n = self.r.randint(lo, hi)
        return " ".join(self.r.choice(extra) if extra and self.r.random() < share else self.r.choice(self.known) for _ in range(n))

    def prose(self, lo: int, hi: int) -> str:
        kind, out = self.r.random(), []
        while sum(len(x.split()) for x in out) < lo or not out:
            out.append(self.words(2, max(3, min(25, hi))).capitalize() + self.pick(".", ".", ".", "?", "!", ","))
        text = " ".join(out)
        if kind < 0.08:
            text = text.replace(" ", " | ")
        elif kind < 0.12:
            text = text.replace(" ", " ### ")
        return text

    def box(self, name: str, inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        attr = self.pick("class", "class", "id")
        extra = self.pick("", "", " " + self.words(1, 1)) if attr == "class" else ""
        tag = self.r.choice(tags)
        return f'<{tag} {attr}="{name}{extra}">{inner}</{tag}>'

    def links(self, extra: list[str], lo: int, hi: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3, extra)}</a>' for i in range(self.r.randint(lo, hi))]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick(" ", " | ", "").join(items) if kind < 0.9 else "".join(f"<p>{x}</p>" for x in items)

    def mixed(self, extra: list[str]) -> str:
        return self.pick(self.prose(3, 30), self.words(2, 14, extra), f"<p>{self.prose(3, 20)}</p>", f"<p>{self.words(3, 12, extra)}</p>")

    # regions that are no main text
    def menu(self) -> str:
        inner = self.links(MENU, 3, 9)
        return f"<nav>{inner}</nav>" if self.r.random() < 0.5 else self.box(self.pick("nav", "navbar", "menu", "main-menu", "navigation", "topnav", "breadcrumbs", "breadcrumb", "toc"), inner, ("div", "ul", "section"))

    def header(self) -> str:
        inner = self.pick(f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.prose(2, 8)}</p>", f"<div>{self.words(1, 5)}</div>") + self.pick("", self.menu())
        return f"<header>{inner}</header>" if self.r.random() < 0.6 else self.box(self.pick("header", "site-header", "masthead", "topbar", "top", "page-header", "banner", "logo"), inner)

    def footer(self) -> str:
        inner = self.pick("&copy; ", "", "© ") + self.words(1, 8, FOOT) + self.pick("", " &middot; ") + self.pick("", self.prose(3, 25), self.links(FOOT, 2, 6))
        return f"<footer>{inner}</footer>" if self.r.random() < 0.6 else self.box(self.pick("footer", "site-footer", "bottom", "copyright", "page-footer", "foot", "colophon"), inner)

    def sidebar(self) -> str:
        inner = self.pick(f"<h3>{self.words(1, 3, ASIDE)}</h3>", f"<h2>{self.words(1, 3, ASIDE)}</h2>", "") + self.pick(self.links(ASIDE, 2, 8), self.mixed(ASIDE))
        return f"<aside>{inner}</aside>" if self.r.random() < 0.5 else self.box(self.pick("sidebar", "side-bar", "rail", "widget", "widgets", "related", "related-posts", "popular", "aside", "secondary", "share", "social", "tags", "recommended", "sidebar-right"), inner)

    def notice(self) -> str:
        return self.box(self.pick("cookie", "cookie-banner", "cookies", "notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "overlay", "disclaimer", "paywall", "cookie-notice", "toast"), self.mixed(NOTICE) + self.pick("", "<button>OK</button>"), ("div", "section", "aside", "p"))

    def advert(self) -> str:
        return self.box(self.pick("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "adsbygoogle", "banner-ad", "ad-container", "dfp"), self.mixed(ADVERT), ("div", "div", "section", "aside", "ins", "p"))

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(1, 3, FORM)}</label><input name=x>" for _ in range(self.r.randint(1, 3))) + f"<button>{self.words(1, 2, FORM)}</button>"
        inner = self.pick("", f"<p>{self.prose(3, 15)}</p>", f"<h3>{self.words(1, 4, FORM)}</h3>") + inner
        return f"<form>{inner}</form>" if self.r.random() < 0.7 else self.box(self.pick("newsletter", "subscribe", "signup", "login", "search", "contact-form", "search-form"), f"<form>{inner}</form>")

    def remarks(self) -> str:
        one = lambda: self.pick(
            f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose(3, 40)}</p></div>', f"<li><p>{self.words(1, 3, REMARK)}</p><p>{self.prose(3, 40)}</p></li>",
            f'<article class="comment"><p>{self.prose(3, 40)}</p></article>', f"<p>{self.prose(3, 40)}</p>", f"<div>{self.prose(3, 40)}</div>",
        )
        inner = self.pick("", f"<h3>{self.words(1, 3, REMARK)}</h3>", f"<h2>{self.r.randint(1, 90)} comments</h2>") + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.box(self.pick("comments", "comment-list", "commentlist", "discussion", "replies", "responses", "disqus", "user-comments", "comment-section", "reviews"), inner, ("div", "section", "ol", "ul"))

    def junk(self) -> str:
        return self.r.choice((self.menu, self.sidebar, self.notice, self.advert, self.advert, self.form, self.remarks))()

    # the main text
    def body(self) -> str:
        out, n = [], self.r.choice((1, 1, 2, 3, 4, 6, 8, 12, 20))
        if self.r.random() < 0.75:
            head = f"<h1>{self.words(2, 14).capitalize()}</h1>"
            out.append(self.pick(head, head, f"<header>{head}</header>"))
        for _ in range(n):
            p = self.prose(self.r.choice((1, 2, 8, 30, 80)), 25)
            kind = self.r.random()
            if kind < 0.62:
                out.append(self.pick(f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"{p}<br><br>", f"<div>{p}</div>", f'<p>{p} <a href="/x">{self.words(1, 4)}</a> {self.words(1, 9)}.</p>'))
            elif kind < 0.7:
                out.append(f"<h{self.r.randint(2, 4)}>{self.words(1, 8)}</h2>".replace("</h2>", ""))
                out[-1] += f"</h{out[-1][2]}>"
            elif kind < 0.77:
                out.append("<ul>" + "".join(f"<li>{self.prose(2, 12)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote>{self.pick(p, f'<p>{p}</p>')}</blockquote>")
            elif kind < 0.86:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>")
            else:
                out.append(f"<p><em>{self.prose(2, 9)}</em></p>")
        return "".join(out)

    def page(self) -> list[tuple[str, bool]]:
        """Pieces of a page in order, each with whether it is main text; tags between pieces nest over them."""
        out: list[tuple[str, bool]] = []
        put = lambda x, main=False: out.append((x, main))
        put(f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>")
        wrap = self.r.choice(((), (), ('<div class="%s">',), ('<div id="%s">', '<div class="%s">')))
        for w in wrap:
            put(w % self.pick("wrapper", "container", "page", "site", self.words(1, 1), "row", "layout"))
        for region, p in ((self.notice, 0.2), (self.header, 0.55), (self.menu, 0.75), (self.advert, 0.5), (self.sidebar, 0.2), (self.form, 0.1), (self.notice, 0.1)):
            if self.r.random() < p:
                put(region())
        tag, attr = self.r.choice((("article", ""), ("article", ""), ("main", ""), ("main", "x"), ("article", "x"), ("div", "x"), ("div", "x"), ("section", "x"), ("td", "x")))
        name = self.pick("content", "post", "entry-content", "article", "article-body", "main", "story", "text", "post-content", "body", "main-content", "entry", "single", self.words(1, 1))
        put(f"<{tag}" + (f' {self.pick("class", "id")}="{name}"' if attr else "") + ">")
        if tag in ("main", "div") and self.r.random() < 0.3:
            put("<article>")
        for k in range(self.r.choice((1, 1, 2, 3))):
            if k or self.r.random() < 0.1:
                put(self.junk())
            put(self.body(), True)
        if self.r.random() < 0.25:
            put(self.remarks() if self.r.random() < 0.5 else self.junk())
        put(f"</{tag}>")
        for region, p in ((self.remarks, 0.35), (self.sidebar, 0.35), (self.advert, 0.25), (self.form, 0.2), (self.menu, 0.1), (self.footer, 0.85), (self.notice, 0.1)):
            if self.r.random() < p:
                put(region())
        put("" if self.r.random() < 0.1 else "</body></html>")
        return out
