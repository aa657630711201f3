"""Made-up pages with known main text, to train the block labeller on.

Every page is put together from the parts that pages have, in many spellings; a mark character stands in each main block.
"""

from __future__ import annotations

import random

MARK = "\ue000"

# Names that pages give their parts.
NOISE = {
    "ad": "ad ads advert advertisement banner promo sponsor sponsored adbox ad-slot google-ad",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu links toc pagination",
    "head": "header masthead top site-header page-header logo branding",
    "foot": "footer site-footer bottom copyright legal colophon credits",
    "side": "sidebar side widget rail aside secondary related recommended popular trending more-stories",
    "note": "cookie cookie-notice notice consent gdpr alert popup modal overlay newsletter subscribe paywall",
    "form": "form search login signup contact-form poll feedback",
    "talk": "comments comment reader-comments discussion replies reply disqus respond comment-list user-comment",
    "share": "share social sharing share-bar tools actions tags meta",
}
MAIN = "content article post entry entry-content article-body story text main main-content post-content body-text page-content single"
SAID = "cookies privacy subscribe login copyright rights reserved share comment reply search menu home contact about sign up advertisement sponsored terms accept agree newsletter"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = ["".join(self.r.choice("bcdfghjklmnprstvwäöéñ") + self.r.choice("aeiouü") + self.r.choice(["", "", "n", "r", "s", "ch"])) for _ in range(220)]
        self.vocabulary = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 3))) for _ in range(3000)]

    def words(self, low: int, high: int, cue: float = 0.0) -> str:
        r = self.r
        n = r.randint(low, high) if r.random() < 0.7 else r.randint(low, max(low, (low + high) // 4))
        out = []
        for k in range(n):
            w = r.choice(SAID.split()) if r.random() < cue else r.choice(self.vocabulary)
            if r.random() < 0.03:
                w = w * 2 if r.random() < 0.5 else w.upper()
            out.append((w.capitalize() if k == 0 or out[-1].endswith(".") else w) + ("." if r.random() < 0.08 else "," if r.random() < 0.06 else ""))
        text = " ".join(out)
        style = r.random()
        if style < 0.04:
            text = " ".join([out[0]] * n)
        elif style < 0.08:
            text = text.upper().replace(" ", "!! ")
        elif style < 0.12:
            text = text.replace(" ", r.choice([" | ", "### ", "%%% ", " &amp; "]))
        return text

    def named(self, tag: str, names: str, inner: str) -> str:
        r = self.r
        name = r.choice(names.split())
        extra = "" if r.random() < 0.6 else " " + r.choice(["clearfix", "row", "col", "box", "block", "wrap", "x1"])
        attr = f' class="{name}{extra}"' if r.random() < 0.7 else f' id="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.words(1, 4, 0.2)}</a>' for k in range(r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " ".join(items)

    def prose(self) -> str:
        return "".join(f"<p>{self.words(4, 40, 0.08)}</p>" for _ in range(self.r.randint(1, 3)))

    def noise(self, kind: str) -> str:
        r, names = self.r, NOISE[kind]
        bare = r.random() < 0.4
        if kind == "menu":
            return f"<nav>{self.links(2, 9)}</nav>" if bare else self.named(r.choice(["div", "nav", "ul"]), names, self.links(2, 9))
        if kind == "head":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{self.words(1, 8)}</p>"]) + (self.links(2, 6) if r.random() < 0.5 else "")
            return f"<header>{inner}</header>" if bare else self.named(r.choice(["div", "header"]), names, inner)
        if kind == "foot":
            inner = r.choice([f"&copy; {self.words(3, 16, 0.1)}", f"<p>{self.words(3, 20, 0.2)}</p>", self.links(2, 6), f"&copy; www.example.org &middot; {self.words(3, 16)}"])
            return f"<footer>{inner}</footer>" if bare or r.random() < 0.5 else self.named("div", names, inner)
        if kind == "side":
            inner = r.choice([self.links(2, 8), self.prose(), f"<h3>{self.words(1, 4)}</h3>{self.links(2, 5)}", f"<h2>{self.words(1, 4)}</h2>{self.prose()}"])
            return f"<aside>{inner}</aside>" if bare else self.named(r.choice(["div", "aside", "section"]), names, inner)
        if kind == "form":
            return f"<form><label>{self.words(1, 3, 0.4)}</label><input name=q><button>{self.words(1, 2, 0.5)}</button><p>{self.words(2, 20, 0.2)}</p></form>"
        if kind == "talk":
            each = r.choice([lambda: f"<p>{self.words(3, 50)}</p>", lambda: self.named("div", "comment comment-body reply user-comment", f"<b>{self.words(1, 2)}</b><p>{self.words(3, 40)}</p>"), lambda: f"<li>{self.words(3, 40)}</li>"])
            inner = (f"<h3>{self.words(1, 3, 0.5)}</h3>" if r.random() < 0.6 else "") + "".join(each() for _ in range(r.randint(1, 6)))
            return self.named(r.choice(["div", "section", "ol", "ul"]), "comments comment-list reader-comments discussion replies disqus respond", inner)
        inner = r.choice([self.words(2, 25, 0.1), f"<p>{self.words(2, 30, 0.15)}</p>", f'<a href="/x">{self.words(1, 8)}</a>', f"<span>{self.words(1, 12, 0.2)}</span>", f"{self.words(3, 20, 0.3)}<button>{self.words(1, 2, 0.6)}</button>"])
        return self.named(r.choice(["div", "div", "section", "aside", "p"]), names, inner)

    def main_block(self) -> str:
        r = self.r
        t = lambda low, high: MARK + self.words(low, high)
        kind = r.random()
        if kind < 0.62:
            text = t(1, 70)
            if r.random() < 0.25:
                a, _, b = text.partition(" ")
                text = f"{a} <{(x := r.choice(['a href=/q', 'b', 'em', 'span', 'i', 'strong']))}>{self.words(1, 6)}</{x.split()[0]}> {b}"
            return f"<p>{text}</p>" if r.random() < 0.75 else r.choice([f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>"])
        if kind < 0.74:
            return f"<h{(k := r.choice('234'))}>{t(1, 9)}</h{k}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{t(1, 25)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{t(3, 40)}</blockquote>"
        if kind < 0.92:
            return f"<pre>{t(2, 30)}</pre>"
        if kind < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{t(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{t(2, 15)}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        parts = [self.main_block() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14, 30]))]
        if r.random() < 0.75:
            parts.insert(0, f"<h1>{MARK}{self.words(1, 12)}</h1>")
        for kind in ("ad", "share", "note", "side", "form", "talk"):
            if r.random() < 0.08:
                parts.insert(r.randint(0, len(parts)), self.noise(kind))
        inner = "".join(parts)
        form = r.random()
        if form < 0.45:
            return f"<article>{inner}</article>"
        if form < 0.55:
            return f"<main>{inner}</main>"
        if form < 0.62:
            return f"<main><article>{inner}</article></main>"
        if form < 0.92:
            return self.named(r.choice(["div", "div", "section", "article", "main"]), MAIN, inner if r.random() < 0.6 else self.named("div", MAIN, inner))
        return inner

    def page(self) -> str:
        r = self.r
        before = [self.noise(k) for k, p in (("note", 0.15), ("head", 0.35), ("menu", 0.75), ("form", 0.12), ("ad", 0.5), ("side", 0.12)) if r.random() < p]
        after = [self.noise(k) for k, p in (("share", 0.2), ("talk", 0.3), ("side", 0.3), ("ad", 0.2), ("form", 0.12), ("menu", 0.12), ("foot", 0.85), ("note", 0.12)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        body = "".join(before) + (self.article() if r.random() < 0.97 else "") + "".join(after)
        if r.random() < 0.25:
            body = f'<div class="{r.choice(["page", "wrapper", "container", "site", "layout"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"
