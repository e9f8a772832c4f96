"""Labelled pages for the extraction model, generated.

Each page is built from a random layout with invented words: menus, headers,
notices, adverts, sidebars, forms, an article, reader comments, footers, in the
tags and class names that web pages commonly use, or without any; some pages are
plain ``div`` elements, and some have other elements, without one name (those have
no adverts, notices, comments and teasers, which nothing would tell from the article). The texts of the article's
blocks are the labels.
"""

from __future__ import annotations

import random

_SOUNDS = "ba be di do fa gu ka ke li lo ma mi na no pe ra re sa so ta te ti un va zo".split()


class _Maker:
    def __init__(self, rng: random.Random, plain: bool = False):
        self.rng, self.content, self.plain = rng, set(), plain
        self.unnamed = plain or rng.random() < 0.15

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rng.choices(_SOUNDS, k=self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 2, high: int = 25) -> str:
        s = self.words(low, high)
        return s[0].upper() + s[1:] + self.rng.choice("....!?:")

    def named(self, *words: str) -> str:
        """A class or id of one of the words, or none."""
        r = self.rng
        word = r.choice(words) if words else None
        if word is None or self.unnamed or r.random() < 0.1:
            return ""
        word = r.choice(["{}", "{}", "{}", "site-{}", "{}-box", "page_{}", "{}Wrap", "c-{}", "{} block"]).format(word)
        return r.choice([' class="{}"', " class='{}'", ' id="{}"', ' class="x1 {}"']).format(word)

    def some(self, tags: str, text: str, *words: str) -> str:
        tag = "div" if self.plain else self.rng.choice(tags.split())
        return f"<{tag}{self.named(*words)}>{text}</{tag}>"

    # ------------------------------------------------------ not content

    def links(self, n: int) -> str:
        tail = lambda: self.rng.choice(["", "", "", "", ",", ".", "!", " 1"])
        return "".join(f'<li><a href="/{self.rng.randint(0, 99)}">{self.words(1, 3)}{tail()}</a></li>' for _ in range(n))

    def menu(self) -> str:
        body = f"<ul>{self.links(self.rng.randint(3, 8))}</ul>" if self.rng.random() < 0.7 else " | ".join(
            f'<a href="#">{self.words(1, 2)}</a>' for _ in range(self.rng.randint(3, 7)))
        return self.some("nav nav div", body, "menu", "nav", "navbar", "navigation", "breadcrumb")

    def header(self) -> str:
        body = f"<{(h := self.rng.choice(['h1', 'h2', 'p', 'div', 'a']))}>{self.words(1, 5)}</{h}>"
        if self.rng.random() < 0.5 and not self.plain:
            body += f"<p>{self.sentence(3, 12)}</p>"
        if self.rng.random() < 0.4:
            body += self.menu()
        return self.some("header header div", body, "header", "masthead", "top-header", "banner")

    def footer(self) -> str:
        body = self.rng.choice(["&copy; ", "Copyright ", "", "&copy; "]) + self.words(1, 4) + " &middot; " + self.sentence(3, 14)
        if self.rng.random() < 0.5:
            body = f"<p>{body}</p><p>{self.sentence()}</p>"
        return self.some("footer footer div", body, "footer", "foot", "copyright", "legal")

    def advert(self) -> str:
        body = self.rng.choice(["{}", "<p>{}</p>", "<p>{}</p><p><a href='#'>{}</a></p>", "<a href='#'>{}</a> {}"])
        body = body.replace("{}", self.sentence(4, 25), 1).replace("{}", self.words(2, 5))
        return self.some("div div aside section p", body, "ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement")

    def notice(self) -> str:
        body = f"<p>{self.sentence(5, 30)}</p>" + self.rng.choice(["", f"<button>{self.words(1, 2)}</button>"])
        return self.some("div div section", self.rng.choice([body, self.sentence(5, 30)]), "cookie", "cookie-notice", "consent", "notice", "alert",
                         "popup", "newsletter", "subscribe")

    def sidebar(self) -> str:
        parts = [f"<h3>{self.words(1, 3)}</h3><ul>{self.links(self.rng.randint(2, 6))}</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.sentence(5, 30)}</p>",
                 f"<div>{self.sentence(4, 20)}</div>"]
        if self.unnamed:
            parts = parts[:1]
        return self.some("aside aside div section", "".join(self.rng.sample(parts, self.rng.randint(1, len(parts)))), "sidebar", "widget", "related", "popular",
                         "recommended", "trending", "share", "social")

    def form(self) -> str:
        body = f"<label>{self.words(1, 3)}</label><input><p>{self.sentence(3, 15)}</p><button>{self.words(1, 2)}</button>"
        if self.rng.random() < 0.4:
            body += f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>"
        return f"<form{self.named('search', 'login', 'signup', 'form', 'contact')}>{body}</form>"

    def comments(self) -> str:
        one = lambda: self.some("div li p section div li p div div li article", self.rng.choice([
            f"<b>{self.words(1, 2)}</b> {self.sentence(3, 40)}", f"<p>{self.sentence(3, 40)}</p>", f"<h4>{self.words(1, 2)}</h4><p>{self.sentence(3, 40)}</p><p>{self.sentence(3, 40)}</p>"]),
            "comment", "reply", "comment-body", "user-comment")
        body = self.rng.choice([f"<h3>{self.words(1, 3)}</h3>", "", f"<h2>{self.words(1, 2)}</h2>"]) + "".join(one() for _ in range(self.rng.randint(1, 6)))
        tag = self.rng.choice(["section", "div", "ol", "ul"])
        word = self.rng.choice(["comments", "discussion", "replies", "respond", "comment-list", "disqus", "reader-comments"])
        return f"<{tag} {self.rng.choice(['class', 'id'])}=\"{word}\">{body}</{tag}>"

    # ---------------------------------------------------------- content

    def keep(self, text: str) -> str:
        self.content.add(" ".join(text.split()))
        return text

    def paragraph(self) -> str:
        r = self.rng
        text = " ".join(self.sentence(1, r.choice([3, 10, 30])) for _ in range(r.choice([1, 1, 2, 5, 12])))
        if r.random() < 0.3:
            text = text[:-1] if r.random() < 0.5 else self.words(1, 60)
        if r.random() < 0.1:
            text = " ".join(w + r.choice(["###", "!!", " |", "%%%"]) for w in text.split())
        self.keep(text)
        if r.random() < 0.3:
            words = text.split()
            k = r.randrange(len(words))
            words[k] = r.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span>{}</span>"]).format(words[k])
            text = " ".join(words)
        if r.random() < 0.05:
            text = f"<a href='/x'>{text}</a>"
        if self.divs:
            return f"<div>{text}</div>"
        kind = r.random()
        if kind < 0.7:
            return f"<p>{text}</p>"
        if kind < 0.78:
            return f"<p>{text}"
        if kind < 0.84:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.9:
            return f"<div{self.named('paragraph', 'text', 'para')}>{text}</div>"
        if kind < 0.95:
            return f"<{(h := r.choice(['h2', 'h3']))}>{text}</{h}>"
        return f"<ul><li>{text}</li><li>{self.keep(self.sentence())}</li></ul>"

    def article(self) -> str:
        r = self.rng
        self.divs = r.random() < (0.5 if self.plain else 0.15)
        title = "div" if self.divs and r.random() < 0.5 else "h1"
        head = f"<{title}>{self.keep(self.sentence(2, 12)[:-1])}</{title}>" if r.random() < 0.7 else ""
        parts = [self.paragraph() for _ in range(r.choice([1, 1, 1, 2, 4, 8, 15]))]
        for extra in (self.form,) if self.unnamed else (self.advert, self.sidebar, self.form):
            if r.random() < 0.12:
                parts.insert(r.randint(0, len(parts)), extra())
        if r.random() < 0.15 and not self.unnamed:
            parts.append(self.comments())
        body = head + "".join(parts)
        tag = "div" if self.plain else r.choice(["article", "article", "article", "main", "section", "div"])
        name = self.named("article", "post", "entry", "story", "content", "main", "article-body", "text") if tag != "div" or r.random() < 0.95 else ""
        return f"<{tag}{name}>{body}</{tag}>"


def labelled_page(rng: random.Random, plain: bool = False) -> tuple[str, set[str]]:
    """A page, and the texts of its content blocks."""
    m = _Maker(rng, plain)
    told = (m.advert, m.notice, m.comments)  # by their names only
    chance = lambda p, f: f() if rng.random() < p and not (m.unnamed and f in told) else ""
    before = [chance(0.7, m.menu), chance(0.5, m.header), chance(0.5, m.advert), chance(0.3, m.notice), chance(0.15, m.form)]
    after = [chance(0.4, m.sidebar), chance(0.3, m.comments), chance(0.25, m.form), chance(0.2, m.advert), chance(0.15, m.notice)]
    rng.shuffle(before)
    rng.shuffle(after)
    middle = m.article()
    if rng.random() < 0.3:
        middle = m.some("div main div", "".join(["".join(before[3:]), middle, "".join(after[:2])]), "container", "wrap", "page", "layout", "main", "content")
        before, after = before[:3], after[2:]
    body = "".join(before) + middle + "".join(after) + chance(0.85, m.footer)
    if rng.random() < (0.3 if m.unnamed else 0.1):
        body = middle  # a page that is its article
    head = f"<head><title>{m.words(2, 5)}</title><style>p{{margin:0}}</style></head>"
    return f"<!DOCTYPE html><html>{head}<body{m.named('page', 'home', 'body')}>{body}</body></html>", m.content


def labelled_pages(n: int = 1000, seed: int = 11, plain: float = 0.25) -> list[tuple[str, set[str]]]:
    """``n`` pages, a share ``plain`` of them without names."""
    rng = random.Random(seed)
    return [labelled_page(rng, rng.random() < plain) for _ in range(n)]
