"""Labelled pages for the block labeller, made from rules: chrome and articles in the many shapes that pages have."""

from __future__ import annotations

import random

SYLLABLES = "an be chi dor el fra gu hin io ka lu men no per qui ra sto ti ur ver wa xen yo zel ent ion äch ción".split()
MENU = ["Home", "About", "About us", "Contact", "Products", "Blog", "News", "Login", "Sign up", "Help", "FAQ", "Sitemap", "Search", "Archive", "Next", "Previous", "Read more", "Skip to content", "Start", "Kontakt", "Accueil", "Inicio"]
FOOT = ["© 2024 {w} Inc. All rights reserved.", "&copy; {w}.example.com &middot; {s}", "Privacy policy", "Terms of use", "Imprint", "Powered by {w}", "Contact: {w}@example.com", "{s}"]
NOTICE = ["We use cookies to improve your experience.", "This site uses cookies. {s}", "Accept all", "Subscribe to our newsletter", "Please enable JavaScript.", "You are reading an archived page.", "{s}"]
ADVERT = ["Advertisement", "Sponsored", "Buy now and save 50%", "{s}", "{s} {s}", "Limited offer: {s}"]
COMMENT = ["{w} says:", "Reply", "{s}", "{s} {s}", "3 comments", "Posted by {w} on 12 May", "Leave a comment", "Great article, thanks!"]
FORM = ["Name", "Email", "Message", "Send", "Your name", "Subscribe", "Search", "Submit", "Password", "{s}"]
TEASER = ["{s}", "Read more", "Related: {s}", "{s} {s}", "More on {w}", "You may also like"]
#: What a page has beside its article: texts, tags that may hold them, and names of classes and ids, in some languages.
CHROME = {
    "menu": (MENU, ["nav", "div", "ul", "section", "table"], "menu nav navbar navigation main-nav topnav breadcrumb breadcrumbs tabs toolbar pagination pager site-nav links skip share social toc hauptmenü navigazione rubriques"),
    "header": (MENU + ["{s}", "{W}"], ["header", "div"], "header masthead site-header top topbar banner logo branding page-header head hero kopfzeile entete cabecera"),
    "footer": (FOOT, ["footer", "div", "section"], "footer site-footer bottom foot colophon copyright legal credits footer-links pied fusszeile pie impressum"),
    "sidebar": (MENU + ["{s}", "Related articles", "Popular posts", "Tags"], ["aside", "div", "section"], "sidebar side aside widget related recommended secondary rail right-column popular trending tags categories more-stories seitenleiste barre-laterale"),
    "teaser": (TEASER, ["div", "section", "ul"], "teaser teasers related-links related-posts read-next more-news promo-list recommendations verwandt lire-aussi relacionados card-list"),
    "notice": (NOTICE, ["div", "section", "aside", "dialog", "p"], "cookie cookies consent notice alert banner gdpr popup modal overlay newsletter message warning cookie-banner promo-bar disclaimer hinweis avertissement aviso"),
    "advert": (ADVERT, ["div", "aside", "section", "ins"], "ad ads advert advertisement sponsor sponsored promo banner-ad adsbox ad-slot ad-container google-ad commercial promotion anzeige werbung publicite pub publicidad"),
    "form": (FORM, ["form", "div"], "form search search-form login signup contact-form subscribe newsletter-form searchbox field suche recherche buscar"),
    "comments": (COMMENT, ["section", "div", "aside", "ol", "article"], "comments comment comment-list responses discussion disqus replies comment-body reader-comments user-comments commentaires commentaire kommentare kommentar comentarios comentario reacties avis reviews leserbriefe"),
}
#: Elements that hold an article, and names they may have; only the first two may have none.
HOLDERS = ["article", "main", "div", "section"]
HOLDER_NAMES = "post entry content article post-content entry-content main-content article-body story text body main page-content single hentry artikel contenu contenido blog-post document".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 2, 2, 3, 4))))

    def sentence(self, least: int = 3, most: int = 25) -> str:
        # Punctuation and symbols vary, so the labeller learns that they say nothing.
        mark = self.r.choice(["", "", "", "", "***", "%%%", "$$$", " |", "!!"])
        if self.r.random() < 0.06:
            return " ".join([self.word()] * self.r.randint(least, most))
        words = [self.word() + (mark if self.r.random() < 0.8 else "") for _ in range(self.r.randint(least, most))]
        if self.r.random() < 0.05:
            words = [w.upper() for w in words]
        return (" ".join(words)).capitalize() + self.r.choice([".", ".", "", "!", "?"])

    def filled(self, text: str) -> str:
        return text.format(w=self.word(), W=self.word().capitalize(), s=self.sentence(1, 12))

    def attribute(self, names: str, always: bool) -> str:
        if not names or not always and self.r.random() < 0.5:
            return ""
        name = self.r.choice(names.split())
        if self.r.random() < 0.2:
            name += self.r.choice(["-wrap", "_inner", " clearfix", " col-4", "-1", "Box", " container"])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{name}"'

    def inline(self, text: str) -> str:
        if self.r.random() < 0.15:
            a = self.r.choice(["b", "i", "em", "strong", "span", "code"])
            text = f"<{a}>{text}" + (f"</{a}>" if self.r.random() < 0.8 else "")
        if self.r.random() < 0.12:
            text += f' <a href="/{self.word()}">{self.sentence(1, 4)}</a>'
        return text + ("<br>" if self.r.random() < 0.1 else "")

    def linked(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def chrome(self, kind: str, inside: bool = False) -> str:
        texts, tags, names = CHROME[kind]
        tag = self.r.choice(tags)
        if kind in ("menu", "teaser") and self.r.random() < 0.25:
            return self.links_alone(texts)
        # Without a telling tag (and inside an article) the name must tell.
        told = tag in ("nav", "header", "footer", "aside", "form") and not (inside and tag in ("header", "footer"))
        attribute = self.attribute(names, not told)
        items = [self.filled(self.r.choice(texts)) for _ in range(self.r.randint(1, 6))]
        shape = self.r.random()
        link = lambda t: self.linked(t) if kind in ("menu", "sidebar", "header", "teaser") or self.r.random() < 0.2 else t
        if tag == "table":
            body = "".join("<tr>" * (not k or shape < 0.5) + f"<td>{link(t)}</td>" for k, t in enumerate(items))
        elif tag == "p" or kind == "advert" and shape < 0.6:
            body = self.filled(self.r.choice(texts))
        elif kind == "form":
            body = "".join(f"<label>{t}</label><input>" if self.r.random() < 0.5 else f"<p>{t}<input></p>" for t in items) + "<button>Send</button>"
        elif kind == "teaser" and tag != "ul" and shape < 0.6:
            body = "".join(f"<{h}>{link(t)}</{h}>" + (f"<p>{self.sentence()}</p>" if self.r.random() < 0.6 else "") for t in items for h in [self.r.choice(["h2", "h3", "h4", "strong"])])
        elif tag in ("ul", "ol") or shape < 0.45:
            rows = "".join(f"<li>{link(t)}" + ("</li>" if self.r.random() < 0.8 else "") for t in items)
            body = rows if tag in ("ul", "ol") else f"<ul>{rows}</ul>"
        elif shape < 0.6:
            body = " ".join(link(t) for t in items)
        else:
            body = "".join(f"<{x}>{link(t)}</{x}>" for t in items for x in [self.r.choice(["p", "div", "h3", "span", "p"])])
        if kind == "header" and self.r.random() < 0.5:
            body = f"<{(h := self.r.choice(['h1', 'h1', 'h2', 'p', 'strong']))}>{self.filled('{s}')}</{h}>" + body * (self.r.random() < 0.6)
        if kind in ("sidebar", "comments", "footer", "teaser") and self.r.random() < 0.4:
            body = f"<{(h := self.r.choice(['h2', 'h3']))}>{self.filled(self.r.choice(texts))}</{h}>" + body
        return f"<{tag}{attribute}>{body}</{tag}>"

    def links_alone(self, texts: list[str]) -> str:
        """Short texts that are all links, where no tag or name says what they are."""
        items = [self.linked(self.filled(self.r.choice(texts))) for _ in range(self.r.randint(3, 9))]
        name = f' class="{self.word()}"' if self.r.random() < 0.5 else ""
        shape = self.r.random()
        if shape < 0.35:
            return f"<table{name}>" + "".join("<tr>" * (not k or shape < 0.15) + f"<td>{t}" for k, t in enumerate(items)) + "</table>"
        if shape < 0.7:
            return f"<ul{name}>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
        return f"<div{name}>" + "".join(f"<{x}>{t}</{x}>" for t in items for x in [self.r.choice(["div", "p", "span"])]) + "</div>"

    def article(self) -> list[str]:
        parts = [f"<h1>{self.sentence(1, 14)}</h1>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.choice((1, 1, 2, 3, 4, 5, 6, 8, 12, 30))):
            kind = self.r.random()
            if kind < 0.66:
                close = "</p>" if self.r.random() < 0.8 else ""
                parts.append(f"<p>{self.inline(self.sentence(*self.r.choice([(1, 4), (3, 12), (8, 60), (40, 120)])))}{close}")
            elif kind < 0.76:
                parts.append(f"<{(h := self.r.choice(['h2', 'h3', 'h4']))}>{self.sentence(1, 8)}</{h}>")
            elif kind < 0.86:
                parts.append(f"<{(u := self.r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.inline(self.sentence(1, 14))}</li>" for _ in range(self.r.randint(1, 5))) + f"</{u}>")
            elif kind < 0.91:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.sentence(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 3))) + "</table>")
            elif kind < 0.96:
                parts.append(f"<blockquote><p>{self.sentence()}</p></blockquote>" if self.r.random() < 0.5 else f"<pre>{self.sentence()}</pre>")
            else:
                parts.append(f'<figure><img src="x.png"><figcaption>{self.sentence()}</figcaption></figure>')
        return parts

    def page(self) -> tuple[str, str]:
        """A page, and the same page with the article's parts alone (what is to be found)."""
        r = self.r
        article = self.article()
        inner = list(article)
        for kind in ("advert", "menu", "notice", "form", "comments", "sidebar", "teaser"):
            if r.random() < 0.1:
                inner.insert(r.randint(0, len(inner)), self.chrome(kind, inside=True))
        tag = r.choice(HOLDERS)
        name = "" if tag in HOLDERS[:2] and r.random() < 0.5 else r.choice(HOLDER_NAMES)
        body = "".join(inner)
        if r.random() < 0.15:
            body = f"<div>{body}</div>"
        if tag == "main" and r.random() < 0.5:
            body = f"<article>{body}</article>"
        bare = r.random() < 0.1  # nothing holds the article
        holder = body if bare else f"<{tag}" + (f' {r.choice(["class", "id"])}="{name}"' if name else "") + f">{body}</{tag}>"
        before = [self.chrome(k) for k in ("notice", "header", "menu", "menu", "advert", "form", "sidebar") if r.random() < 0.45]
        after = [self.chrome(k) for k in ("comments", "teaser", "sidebar", "advert", "form", "footer", "notice", "menu") if r.random() < 0.45]
        r.shuffle(before) if r.random() < 0.3 else None
        if r.random() < 0.15:
            before, after = [], after
        rows = r.random() < 0.06  # a table that lays out the page
        if rows:
            before, after = [f"<tr><td>{x}</td></tr>" if r.random() < 0.5 else f"<td>{x}</td>" for x in before], [f"<td>{x}</td>" for x in after]
            holder, before, after = f"<td>{holder}</td>", ["<table>", *before], [*after, "</table>"]
        script = '<script>var t="</p>";</script>' if r.random() < 0.5 else ""
        frame = ["<div id=\"page\" class=\"wrapper\">", "</div>"] if r.random() < 0.3 else ["", ""]
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 8)}</title>{script}</head><body>{frame[0]}{''.join(before)}{holder}{''.join(after)}{frame[1]}</body></html>", "".join(article)
