"""Labelled pages for training and testing the extractor, made from a seed.

A page is built of parts whose role is known: article text, or one of menu, header,
footer, sidebar, notice, advert, form and reader comments. Every text of the latter starts
with a private-use mark, by which labels are read off the parsed page.
"""

from __future__ import annotations

import html
import random

#: Marks text that is not the article's.
MARK = ""
SYLLABLES = "an er on th re in st nd ou le de la ti en ha es ar ue co ma si no vi tra pe lo su mi ge ver sch lich ung que eau ment ción ado ía né ró ö".split()
JUNK = ["###", "***", "%%%", "&&&", "$$$", "!!"]


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> list[str]:
        return [self.word() for _ in range(self.r.randint(low, high))]

    def sentence(self, low: int = 3, high: int = 18) -> str:
        x = self.words(low, high)
        if self.style == "symbols":
            x = [w + self.r.choice(JUNK) for w in x]
        elif self.style == "upper":
            x = [w.upper() + "!!" for w in x]
        elif self.style == "bars":
            return " | ".join(x)
        return " ".join(x).capitalize() + self.r.choice((".", ".", ".", ",", "?", ""))

    def prose(self, low: int = 1, high: int = 7) -> str:
        return html.escape(" ".join(self.sentence() for _ in range(self.r.randint(low, high))), quote=False)

    def attrs(self, names: str, odds: float = 0.85) -> str:
        """A class, an id or both from the given names, now and then none."""
        if self.r.random() > odds:
            return self.r.choice(("", f' class="{self.word()}"', f' class="col-{self.r.randint(1, 12)}"'))
        name = self.r.choice(names.split())
        if self.r.random() < 0.3:
            name = self.r.choice((f"{name}-{self.word()}", f"{self.word()}-{name}", f"{name} {self.word()}", f"{self.word()}_{name}", name.title(), f"{name}{self.r.randint(1, 9)}"))
        return self.r.choice((f' class="{name}"', f' class="{name}"', f' id="{name}"', f' id="{name}" class="{self.word()}"', f" class='{name}'", f" class={name.split()[0]}"))

    def m(self, text: str) -> str:
        return MARK + text

    def links(self, low: int, high: int, kind: str | None = None) -> str:
        n, kind = self.r.randint(low, high), kind or self.r.choice(("ul", "ul", "span", "div", "bar"))
        one = lambda: f'<a href="/{self.word()}">{self.m(" ".join(self.words(1, 4)))}</a>'
        if kind == "ul":
            return f"<ul{self.attrs('links list items', 0.2)}>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        if kind == "div":
            return "".join(f"<div>{one()}</div>" for _ in range(n))
        return (" | " if kind == "bar" else " ").join(one() for _ in range(n))

    def menu(self) -> str:
        if self.r.random() < 0.6:
            return f"<nav{self.attrs('nav menu main-nav navbar topnav', 0.3)}>{self.links(2, 9)}</nav>"
        return f"<div{self.attrs('nav menu navigation navbar main-menu topbar breadcrumb breadcrumbs site-nav top-bar toolbar', 0.97)}>{self.links(2, 9)}</div>"

    def header(self) -> str:
        inner = f"<{(t := self.r.choice(('div', 'p', 'h1', 'h2', 'span')))}>{self.m(' '.join(self.words(1, 4)))}</{t}>"
        if self.r.random() < 0.5:
            inner += f"<p>{self.m(self.prose(1, 1))}</p>"
        if self.r.random() < 0.5:
            inner += self.menu()
        if self.r.random() < 0.2:
            inner += self.form()
        if self.r.random() < 0.6:
            return f"<header{self.attrs('header site-header page-header', 0.3)}>{inner}</header>"
        return f"<div{self.attrs('header masthead site-header banner top page-header branding top-bar logo', 1)}>{inner}</div>"

    def footer(self) -> str:
        inner = self.r.choice(("&copy; ", "Copyright ", "© ", "")) + str(self.r.randint(1999, 2025)) + " " + self.prose(1, 2)
        inner = self.r.choice((self.m(inner), f"<p>{self.m(inner)}</p>", f"<div><p>{self.m(inner)}</p>{self.links(1, 6)}</div>"))
        if self.r.random() < 0.6:
            return f"<footer{self.attrs('footer site-footer', 0.3)}>{inner}</footer>"
        return f"<div{self.attrs('footer site-footer foot bottom bottom-bar colophon copyright legal page-footer', 1)}>{inner}</div>"

    def sidebar(self) -> str:
        parts = []
        for _ in range(self.r.randint(1, 4)):
            head = f"<h{(h := self.r.randint(2, 4))}>{self.m(' '.join(self.words(1, 3)))}</h{h}>"
            body = self.r.choice((lambda: self.links(2, 8), lambda: f"<p>{self.m(self.prose(1, 3))}</p>", lambda: f"<div{self.attrs('widget box teaser', 0.6)}><p>{self.m(self.prose(1, 4))}</p></div>"))()
            parts.append(self.r.choice((head + body, body)))
        if self.r.random() < 0.6:
            return f"<aside{self.attrs('sidebar widget related side', 0.4)}>{''.join(parts)}</aside>"
        return f"<div{self.attrs('sidebar side sidebar-right widget widget-area related related-posts rail recommended', 1)}>{''.join(parts)}</div>"

    def advert(self) -> str:
        inner = self.r.choice((lambda: self.m(self.prose(1, 3)), lambda: f"<p>{self.m(self.prose(1, 4))}</p>", lambda: f'<a href="/{self.word()}">{self.m(self.prose(1, 2))}</a>', lambda: f"<span>{self.m(self.prose(1, 1))}</span><p>{self.m(self.prose(1, 2))}</p>"))()
        tag = self.r.choice(("div", "div", "div", "section", "aside", "p", "ins"))
        return f"<{tag}{self.attrs('ad ads advert advertisement ad-slot adbox sponsored sponsor promo promotion banner-ad ad-banner adsbygoogle', 1)}>{inner}</{tag}>"

    def notice(self) -> str:
        inner = self.r.choice((lambda: self.m(self.prose(1, 3)), lambda: f"<p>{self.m(self.prose(1, 3))}</p><button>{self.m(self.word())}</button>", lambda: f"<p>{self.m(self.prose(1, 2))}</p><a href='/x'>{self.m(self.word())}</a>"))()
        tag = self.r.choice(("div", "div", "section", "aside", "dialog"))
        return f"<{tag}{self.attrs('cookie cookies cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe paywall disclaimer message notification privacy-notice', 1)}{self.r.choice(('', ' role=alert', ' role=dialog'))}>{inner}</{tag}>"

    def form(self) -> str:
        parts = []
        for _ in range(self.r.randint(1, 4)):
            parts.append(self.r.choice((f"<label>{self.m(self.word())}</label><input type=text name={self.word()}>", f"<p>{self.m(self.prose(1, 2))}</p><input type='email'>", f"<select><option>{self.m(self.word())}</option><option>{self.m(self.word())}</option></select>", f"<textarea>{self.m(self.prose(1, 1))}</textarea>", f"<div>{self.m(' '.join(self.words(1, 5)))}<input></div>")))
        return f"<form{self.attrs('search login signup contact subscribe form', 0.4)} action='/x'>{''.join(parts)}<button>{self.m(self.word())}</button></form>"

    def comments(self) -> str:
        one = lambda: self.r.choice((lambda: f"<{(t := self.r.choice(('div', 'li', 'article')))}{self.attrs('comment reply comment-body', 0.7)}><{(b := self.r.choice(('b', 'span', 'h4', 'p')))}>{self.m(' '.join(self.words(1, 2)))}</{b}><p>{self.m(self.prose(1, 6))}</p></{t}>", lambda: f"<p>{self.m(self.prose(1, 6))}</p>"))()
        inner = "".join(one() for _ in range(self.r.randint(1, 6)))
        if self.r.random() < 0.5:
            inner = f"<h{(h := self.r.randint(2, 4))}>{self.m(' '.join(self.words(1, 3)))}</h{h}>" + inner
        if self.r.random() < 0.3:
            inner += self.form()
        tag = self.r.choice(("div", "section", "ol", "ul", "aside"))
        return f"<{tag}{self.attrs('comments comment comment-list commentlist discussion responses reader-comments replies disqus user-comments', 1)}>{inner}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attrs('share social sharing social-links share-buttons', 1)}>{self.links(2, 5)}</div>"

    def inline(self) -> str:
        text = self.prose(1, 7)
        k = self.r.random()
        if k < 0.12:
            return f"<b>{text}<br>"  # never closed
        if k < 0.4:
            words = text.split(" ")
            i = self.r.randrange(len(words))
            tag = self.r.choice(("b", "i", "em", "strong", "a href='/y'", "code", "span", "mark", "u", "sup"))
            last = i + 1 if self.r.random() < 0.7 else self.r.randint(i + 1, len(words))
            words[i:last] = [f"<{tag}>{' '.join(words[i:last])}</{tag.split()[0]}>"]
            text = " ".join(words)
        elif k < 0.46:  # a line that is mostly a link
            text = f"{' '.join(self.words(0, 3))} <a href='/y'>{' '.join(self.words(1, 6))}</a>{self.r.choice(('', '.'))}"
        return text

    def paragraph(self) -> str:
        return f"<p{self.attrs('lead intro text para', 0.1)}>{self.inline()}" + self.r.choice(("</p>", "</p>", "</p>", "</p>\n", ""))

    def block(self) -> str:
        k = self.r.random()
        if k < 0.72:
            return self.paragraph()
        if k < 0.82:
            return f"<h{(h := self.r.randint(2, 4))}>{html.escape(' '.join(self.words(1, 7)))}</h{h}>"
        if k < 0.88:
            t = self.r.choice(("ul", "ol"))
            return f"<{t}>" + "".join(f"<li>{self.r.choice((self.inline(), ' '.join(self.words(1, 5))))}</li>" for _ in range(self.r.randint(1, 5))) + f"</{t}>"
        if k < 0.91:
            return f"<blockquote>{self.r.choice((self.paragraph(), self.inline()))}</blockquote>"
        if k < 0.93:
            return f"<pre>{self.prose(1, 2)}</pre>"
        if k < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{' '.join(self.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if k < 0.97:
            return f"<figure><img src='/z.png'><figcaption>{self.prose(1, 1)}</figcaption></figure>"
        return f"<div>{self.inline()}</div>"

    def article(self) -> str:
        n = self.r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14, 25))
        head = f"<h1{self.attrs('title headline entry-title', 0.3)}>{html.escape(' '.join(self.words(1, 9)))}</h1>" if self.r.random() < 0.8 or not n else ""
        if head and self.r.random() < 0.1:
            head = f"<header{self.attrs('entry-header article-header', 0.5)}>{head}</header>"
        blocks = [self.block() for _ in range(n)]
        for part in (self.advert, self.share, self.notice, self.form, self.sidebar):
            if blocks and self.r.random() < 0.08:
                blocks.insert(self.r.randrange(len(blocks) + 1), part())
        if self.r.random() < 0.08:
            blocks.append(self.comments())
        if n and self.r.random() < 0.15:
            return f"<article>{head}<div{self.attrs('content body text article-body entry-content post-content', 0.9)}>{''.join(blocks)}</div></article>"
        inner = head + "".join(blocks)
        k = self.r.random()
        if k < 0.45:
            return f"<article{self.attrs('post article entry story hentry', 0.3)}>{inner}</article>"
        if k < 0.56:
            return f"<main{self.attrs('main content', 0.3)}>{inner}</main>"
        if k < 0.84:
            return f"<div{self.attrs('article post content entry-content post-content article-body story main story-body text body-text post-body page-content maincontent', 0.92)}>{inner}</div>"
        if k < 0.87:
            return f"<table><tr><td>{self.links(2, 6)}</td><td>{inner}</td></tr></table>"
        return inner

    def page(self) -> str:
        self.style = self.r.choice(("", "", "", "", "", "", "symbols", "upper", "bars"))
        top = [p() for p, odds in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.6), (self.advert, 0.35)) if self.r.random() < odds]
        if self.r.random() < 0.3:
            self.r.shuffle(top)
        after = [p() for p, odds in ((self.share, 0.15), (self.comments, 0.35), (self.sidebar, 0.35), (self.advert, 0.2), (self.form, 0.15), (self.footer, 0.7), (self.notice, 0.15)) if self.r.random() < odds]
        if self.r.random() < 0.12:  # nothing but an article
            top, after = [], []
        before = [self.sidebar()] if top and self.r.random() < 0.12 else []
        middle = "".join(before) + self.article()
        rest = "".join(after)
        for _ in range(self.r.choice((0, 0, 1, 1, 2))):
            tag = self.r.choice(("div", "div", "main", "section"))
            wrap = f"<{tag}{self.attrs('wrapper container page row site layout main content', 0.7)}>"
            if self.r.random() < 0.5:
                middle = f"{wrap}{middle}</{tag}>"
            else:
                middle, rest = f"{wrap}{middle}{rest}</{tag}>", ""
        script = "<script>var t='</p>';</script>" if self.r.random() < 0.4 else ""
        comment = "<!-- ad -->" if self.r.random() < 0.4 else ""
        out = f"<!DOCTYPE html><html><head><title>{self.prose(1, 1)}</title><style>p{{margin:0}}</style></head><body{self.attrs('page home single', 0.2)}>{script}{''.join(top)}{comment}{middle}{rest}"
        return out + ("</body></html>" if self.r.random() < 0.9 else "")


def labelled_pages(n: int, seed: int) -> list[str]:
    made = Pages(seed)
    return [made.page() for _ in range(n)]
