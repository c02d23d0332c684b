"""Labelled pages: layouts drawn at random from a grammar of contents and of what surrounds them, as varied as pages are.

data-y="1" marks the article, data-y="0" what isn't part of it, inside the article too. Names of classes are evidence there, not the
verdict: articles bear names of menus or comments at times, and what surrounds them often has no names.
"""

from __future__ import annotations

from random import Random

_VOWELS, _CONSONANTS = "aeiou", "bdfghklmnprstvw"
#: Fixed lists: names of what holds articles, of parts of articles, of what surrounds them, and names that say nothing.
HOLDERS = "content post entry story article main post-content entry-content article-body story-text main-column page-body text prose".split()
ODD_HOLDERS = "discussion thread page hero legal share-price search-results menu-recipes popular-science ad-hoc comment-of-the-week header-story side-story".split()
PARTS = "section intro lead part chapter legal summary box share-price popular-myths key-points note-to-readers comment-of-the-author page-two side-by-side".split()
NOTHING = "row col wrapper container inner grid x1 css-1ab2 block unit clearfix c12 region".split()
AROUND = {
    "ad": "ad advert ads adsbygoogle sponsored promo ad-slot advertisement sponsor-box".split(),
    "note": "newsletter cookie cookie-banner cookie-notice consent subscribe popup notice alert paywall signup-box login modal".split(),
    "side": "sidebar related related-posts widget side-column recommended trending complementary".split(),
    "talk": "comments comment comment-list replies disqus reactions responses-comments".split(),
    "menu": "menu nav navbar breadcrumb breadcrumbs pagination navigation main-menu tabs toolbar social social-buttons tags".split(),
    "foot": "footer site-footer copyright colophon imprint contentinfo".split(),
    "head": "header masthead topbar branding site-header banner logo".split(),
}


class _Draw:
    def __init__(self, seed: int):
        self.r = Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.r.choice("...!?") for _ in range(self.r.randint(least, most)))

    def name(self, names: list[str], share: float = 1.0) -> str:
        """An attribute that bears one of names, often beside one that says nothing; or, beyond the share, none or such a one alone."""
        r = self.r
        if r.random() >= share:
            return r.choice(["", "", f' class="{r.choice(NOTHING)}"'])
        some = r.choice(names)
        return r.choice([f' class="{some}"', f" class='{some}'", f' id="{some}"', f' class="{r.choice(NOTHING)} {some}"'])

    def link(self, least: int = 1, most: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.words(least, most)}</a>'

    def links(self) -> str:
        r = self.r
        many = [self.link() for _ in range(r.randint(2, 9))]
        return r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in many)}</ul>", " ".join(many), " | ".join(many), "".join(f"<p>{x}</p>" for x in many), "".join(f"<div>{x}</div>" for x in many)])

    def paragraph(self) -> str:
        r = self.r
        text = self.sentences(1, 6)
        if r.random() < 0.2:
            text = f"{self.sentences(1, 2)} {self.link()} {text}"
        if r.random() < 0.1:
            text = f"<b>{self.words(1, 3)}</b> {text}<br>{self.sentences(1, 3)}"
        if r.random() < 0.08:
            text = self.words(1, 4)
        if r.random() < 0.04:
            text = self.link(3, 9)
        if r.random() < 0.03:
            text = r.choice(["All rights reserved.", f"&copy; {self.words(1, 4)}."])
        return f"<p{self.name(['lead', 'intro', 'copy', 'text', 'note'], 0.06)}>{text}</p>"

    def piece(self, deep: int = 0) -> str:
        r, k = self.r, self.r.random()
        if k < 0.62:
            return self.paragraph()
        if k < 0.69:
            return f"<h2>{self.words(1, 7)}</h2>" + self.paragraph()
        if k < 0.75:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{r.choice([self.words(1, 6), self.sentences(1, 2), '<p>' + self.sentences(1, 2) + '</p>'])}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
        if k < 0.80:
            return r.choice([f"<blockquote>{self.paragraph()}</blockquote>", f"<blockquote>{self.sentences(1, 3)}</blockquote>", f"<pre>{self.words(2, 20)}</pre>"])
        if k < 0.84:
            return "<table>" + "".join(f"<tr><th>{self.words(1, 2)}</th><td>{self.words(1, 9)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if k < 0.87:
            return f"<figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure>"
        if k < 0.89:
            return f"<dl><dt>{self.words(1, 2)}</dt><dd>{self.sentences(1, 2)}</dd></dl>"
        if k < 0.91:
            return self.sentences(1, 5) + "<br><br>" + self.sentences(1, 4)
        if deep < 2:
            t = r.choice(["section", "div", "div"])
            return f"<{t}{self.name(PARTS, 0.5)}>{''.join(self.piece(deep + 1) for _ in range(r.randint(1, 4)))}</{t}>"
        return self.paragraph()

    def around(self, inside: bool = False) -> str:
        """Something that isn't the article."""
        r = self.r
        kind = r.choice(["ad", "note", "side", "talk", "menu", "form"] + ["talk"] * inside)
        if kind == "form":
            return f'<form{self.name(AROUND["note"], 0.4)} data-y="0">{r.choice(["", "<h3>" + self.words(1, 4) + "</h3>"])}<p>{self.sentences(1, 3)}</p><label>{self.word()}</label><input name=q><button>OK</button></form>'
        if kind == "menu":
            tag, names = r.choice([("nav", 0.3), ("div", 0.7), ("ul", 0.5), ("div", 0.4)])
            return f'<{tag}{self.name(AROUND["menu"], names)} data-y="0">{self.links()}</{tag}>'
        if kind == "talk":
            says = lambda: r.choice([f"<p>{self.sentences(1, 5)}</p>" * r.randint(1, 2), self.sentences(1, 3)])
            one = r.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "<p>{}</p>", "<div>{}</div>", "<blockquote>{}</blockquote>"])
            many = "".join(one.format(says()) for _ in range(r.randint(1, 7)))
            tag = r.choice(["section", "div", "div", "details", "aside"])
            return f'<{tag}{self.name(AROUND["talk"])} data-y="0">{r.choice(["", "<h3>Comments</h3>", "<summary>Comments</summary>" if tag == "details" else "<h2>Replies</h2>"])}{"<ol>" + many + "</ol>" if one.startswith("<li") else many}</{tag}>'
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "div", "section"])
            what = r.choice([self.links(), f"<h3>{self.words(1, 3)}</h3>{self.links()}", "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(r.randint(1, 6))), f"<h3>More</h3><p>{self.sentences(1, 3)}</p>{self.links()}", self.sentences(1, 3), f"<div>{self.sentences(1, 2)}</div><ul><li>{self.sentences(1, 2)}</li><li>{self.link()}</li></ul>"])
            return f'<{tag}{self.name(AROUND["side"], 0.25 if tag == "aside" else 1)} data-y="0">{what}</{tag}>'
        tag = r.choice(["div", "div", "section", "p", "ins", "span", "dialog"] if kind == "ad" else ["div", "div", "section", "aside", "dialog", "p"])
        plain = self.sentences(1, 4)
        what = plain if tag in ("p", "ins", "span") else r.choice([plain, f"<p>{plain}</p>", f"<h3>{self.words(1, 4)}</h3><p>{plain}</p>", f"<p>{plain}</p><p>{self.sentences(1, 4)}</p><p>{self.link()}</p>", f"<div><p>{self.sentences(1, 5)}</p></div><button>OK</button>"])
        role = ' role="alert"' if kind == "note" and r.random() < 0.1 else self.name(AROUND[kind])
        return f'<{tag}{role} data-y="0">{what}</{tag}>'

    def top(self) -> str:
        r = self.r
        title = r.choice([f"<h1>{self.link(1, 2)}</h1>", f"<h2>{self.words(1, 3)}</h2>", f"<p>{self.words(2, 6)}</p>", self.link(1, 2), f"<h2>{self.words(1, 2)}</h2><p>{self.words(2, 8)}</p>"])
        menu = r.choice(["", f"<nav>{self.links()}</nav>", f"<div>{self.links()}</div>"])
        return r.choice([
            f'<header{self.name(AROUND["head"], 0.3)} data-y="0">{title}{menu}</header>', f'<div{self.name(AROUND["head"])} data-y="0">{title}{menu}</div>', f'<nav data-y="0">{self.links()}</nav>',
            f'<div data-y="0">{self.links()}</div>', f'<div{self.name(AROUND["menu"])} data-y="0">{self.links()}</div>', "", f'<ul data-y="0">{"".join(f"<li>{self.link()}</li>" for _ in range(r.randint(3, 8)))}</ul>',
        ])

    def foot(self) -> str:
        r = self.r
        said = r.choice([f"&copy; {self.words(1, 3)}", f"&copy; {self.word()} &middot; {self.sentences(1, 3)}", f"<p>&copy; {self.words(1, 4)}. {self.sentences(1, 2)}</p>", f"<p>&copy; {self.word()}</p>{self.links()}", self.links(), self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", f"<p>{self.words(2, 6)}</p>"])
        return r.choice([f'<footer data-y="0">{said}</footer>', f'<footer{self.name(AROUND["foot"], 0.4)} data-y="0">{said}</footer>', f'<div{self.name(AROUND["foot"])} data-y="0">{said}</div>', "", f'<div data-y="0">{self.links()}</div>', f'<p data-y="0">{r.choice(["&copy; " + self.words(1, 5), self.words(1, 3) + ". All rights reserved."])}</p>'])

    def page(self) -> str:
        r = self.r
        title = f"<h1>{self.words(1, 9)}</h1>"
        if r.random() < 0.25:
            title = f"<header>{title}{r.choice(['', f'<p>{self.words(2, 6)}</p>'])}</header>"
        pieces = [self.piece() for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14]))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            pieces.insert(r.randint(0, len(pieces)), self.around(True))
        if r.random() < 0.15:
            pieces.append(f'<footer data-y="0">{r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", self.links()])}</footer>')
        inner = ("" if r.random() < 0.1 else title) + "".join(pieces)
        outer = [self.around() for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
        shape = r.random()
        if shape < 0.36:
            text = f'<article{self.name(HOLDERS, 0.4)} data-y="1">{inner}</article>'
        elif shape < 0.44:
            text = f'<main data-y="1">{inner}</main>'
        elif shape < 0.56:
            text = f'<div{self.name(HOLDERS)} data-y="1">{inner}</div>'
        elif shape < 0.64:
            text = f'<{(t := r.choice(["div", "section", "div", "article"]))}{self.name(ODD_HOLDERS)} data-y="1">{inner}</{t}>'
        elif shape < 0.78:
            text = f'<div data-y="1">{inner}</div>'
        elif shape < 0.84:
            text = f'<section data-y="1">{inner}</section>'
        else:
            text = inner
            outer = [f'<div{self.name(["sidebar"], 0.5)} data-y="0">{self.links()}</div>' if r.random() < 0.5 else x for x in outer]
        where = r.randint(0, len(outer))
        body = "".join(outer[:where]) + text + "".join(outer[where:])
        wrap = r.random()
        if wrap < 0.3:
            body = f"<main>{body}</main>"
        elif wrap < 0.55:
            body = f"<div{self.name(['page', 'content', 'main', 'wrapper'], 0.5)}>{body}</div>"
        elif wrap < 0.7:
            body = f'<div class="wrapper"><div class="row">{body}</div></div>'
        mark = ' data-y="1"' if shape >= 0.84 else ""
        if mark and r.random() < 0.3:  # no body either
            return f'<html data-y="1">{self.top()}{body}{self.foot()}'
        if r.random() < 0.12 and not mark:
            return self.top() + body + self.foot()
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body{mark}>{self.top()}{body}{self.foot()}</body></html>"


def labelled_pages(n: int = 300, seed: int = 1) -> list[str]:
    draw = _Draw(seed)
    return [draw.page() for _ in range(n)]
