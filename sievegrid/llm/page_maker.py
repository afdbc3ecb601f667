"""Seeded pages of varied layout with known main text, to train the block labeller on.

A page has a layout (a family) and names its parts in one language, by meaningless names, or not at all. One family is
held out: training never sees it, nor its language of names.
"""

from __future__ import annotations

import html

import numpy as np

# Names that sites give their parts, by language.
NAMES = {
    "en": {
        "main": "content post entry article story text body main page single prose",
        "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs links",
        "side": "sidebar side widget related recommended popular tags archive rail promo",
        "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion",
        "notice": "cookie consent notice alert gdpr popup modal newsletter subscribe banner",
        "comment": "comment comments replies reply discussion responses disqus",
        "foot": "footer foot copyright legal bottom colophon",
        "head": "header head masthead top logo brand",
        "share": "share social toolbar meta byline author tools",
    },
    "de": {"main": "inhalt artikel beitrag text", "menu": "menue navigation hauptmenue", "side": "seitenleiste rand mehr", "ad": "werbung anzeige", "notice": "hinweis meldung einwilligung", "comment": "kommentare kommentar antworten", "foot": "fuss fusszeile impressum", "head": "kopf kopfzeile marke", "share": "teilen autor"},
    "fr": {"main": "contenu texte billet", "menu": "menu rubriques", "side": "colonne annexes lire-aussi", "ad": "pub publicite annonce", "notice": "avis alerte", "comment": "commentaires reactions", "foot": "pied mentions", "head": "entete bandeau", "share": "partage auteur"},
    "es": {"main": "contenido articulo cuerpo", "menu": "menu navegacion", "side": "lateral relacionados", "ad": "publicidad anuncio", "notice": "aviso galletas", "comment": "comentarios respuestas", "foot": "pie creditos", "head": "cabecera encabezado", "share": "compartir autor"},
}
# Names of the held-out family.
HELD_OUT_NAMES = {"main": "inhoud tekst", "menu": "hoofdmenu", "side": "zijbalk", "ad": "reclame", "notice": "melding", "comment": "reacties", "foot": "voet", "head": "kop", "share": "delen"}
FAMILIES = {"modern": 0.45, "divisions": 0.19, "table": 0.16, "bare": 0.2}
HELD_OUT = "portal"
_SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa qu re st ta un ve wa xi yo ze th er on ti nd ou ng".split()


class _Page:
    def __init__(self, rng: np.random.Generator, family: str):
        self.rng, self.out, self.main, self.family = rng, [], set(), family
        self.names = {k: v.split() for k, v in (HELD_OUT_NAMES if family == HELD_OUT else NAMES[str(rng.choice(["en", "en", "en", "de", "fr", "es"]))]).items()}
        naming = rng.random()
        if naming < 0.15 and family != HELD_OUT:
            self.names = {k: [] for k in self.names}
        elif naming < 0.25 and family != HELD_OUT:
            self.names = {k: ["".join(rng.choice(list("abcdefghijkxyz"), 6)) for _ in range(2)] for k in self.names}
        picks, sizes = rng.integers(0, len(_SYLLABLES), (rng.integers(30, 200), 4)).tolist(), rng.integers(1, 5, 200).tolist()
        self.words = ["".join(_SYLLABLES[i] for i in own[:n]) for own, n in zip(picks, sizes)]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, names: list[str]) -> str:
        return str(names[self.rng.integers(len(names))])

    def text(self, low: int, high: int, stop: bool = True) -> str:
        words = [self.words[i] for i in self.rng.integers(0, len(self.words), self.rng.integers(low, high))]
        marks = self.rng.random(len(words))
        words = [w + ("." if m < 0.08 else "," if m < 0.16 else "") for w, m in zip(words, marks)]
        text = " ".join(words)
        return text[0].upper() + text[1:] + ("." if stop and text[-1] not in ".," else "")

    def put(self, text: str, main: bool = False) -> str:
        if main:
            self.main.add(text)
        return html.escape(text, quote=False)

    def open(self, tag: str, names: list[str] | None = None, p: float = 0.85) -> str:
        if not names or not self.chance(p):
            return f"<{tag}>"  # nameless parts are told by their surroundings
        name = self.pick(names)
        if self.chance(0.3):
            name += self.pick(["-box", "-wrap", "-area", " box", "-inner", "_list", " wide"])
        return f'<{tag} {"id" if self.chance(0.25) else "class"}="{name}">'

    def links(self, low: int, high: int) -> None:
        style = self.rng.integers(3)
        items = [f'<a href="/{i}">{self.text(1, 4, False)}</a>' for i in range(self.rng.integers(low, high))]
        self.out.append("<ul>" + "".join(f"<li>{x}</li>" if style == 0 else f"<li>{x}" for x in items) + "</ul>" if style < 2 else " ".join(items))

    def menu(self) -> None:
        tag = "nav" if self.chance(0.6) else "div"
        self.out.append(self.open(tag, self.names["menu"], 0.3 if tag == "nav" else 1))
        self.links(2, 9)
        self.out.append(f"</{tag}>")

    def small(self, tag: str, names: list[str], p: float = 1.0) -> None:
        self.out.append(self.open(tag, names, p))
        for _ in range(self.rng.integers(1, 4)):
            kind = self.rng.integers(4)
            if kind == 0:
                self.out.append(self.text(2, 30))
            elif kind == 1:
                self.out.append(f"<p>{self.text(2, 40)}</p>")
            elif kind == 2:
                self.links(1, 5)
            else:
                self.out.append(f"<h3>{self.text(1, 5, False)}</h3><p>{self.text(3, 25)}</p>")
        self.out.append(f"</{tag}>")

    def form(self) -> None:
        self.out.append(f'<form action="/s">{self.text(1, 6, False)}<input name="q"><label>{self.text(1, 4, False)}</label><p>{self.text(2, 14)}</p></form>')

    def comments(self) -> None:
        tag = self.pick(["div", "section", "ol", "aside"])
        self.out.append(self.open(tag, self.names["comment"], 1))
        if self.chance(0.5):
            self.out.append(f"<h3>{self.text(1, 4, False)}</h3>")
        for _ in range(self.rng.integers(1, 7)):
            inner = "li" if tag == "ol" else self.pick(["div", "article", "p"])
            body = self.text(3, 60)
            self.out.append(self.open(inner, self.names["comment"], 0.6) + (body if inner == "p" else f"<p>{body}</p>") + f"</{inner}>")
        self.out.append(f"</{tag}>")

    def advert(self) -> None:
        tag = self.pick(["div", "div", "aside", "section"])
        self.small(tag, self.names["ad"]) if self.chance(0.4) else self.out.append(self.open(tag, self.names["ad"], 1) + self.text(2, 30) + f"</{tag}>")

    def paragraph(self) -> None:
        text = self.text(1, 120 if self.chance(0.7) else 12)
        text = self.put(text + " ©" if self.chance(0.03) else text, True)
        if self.chance(0.15):
            self.out.append(f"<p><b>{text}<br>")  # left open
        elif self.chance(0.3):
            cut = text.find(" ", len(text) // 2)
            tag = self.pick(['a href="/x"', 'a href="/x"', "math", "button", "code"])
            inner = f"{text[:cut]} <{tag}>{text[cut + 1 :]}</{tag.split()[0]}>" if cut > 0 and self.chance(0.5) else f"<i>{text}</i>"
            self.out.append(f"<p>{inner}</p>")
        else:
            self.out.append(f"<p>{text}" + "</p>" * self.chance(0.9))

    def said(self, tag: str, low: int, high: int, stop: bool = False) -> str:
        return f"<{tag}>{self.put(self.text(low, high, stop), True)}" + f"</{tag}>" * self.chance(0.85)

    def figure(self) -> None:
        caption = self.said("figcaption", 1, 20, self.chance(0.5))
        self.out.append(f'<figure><img src="x.png">{caption}</figure>' if self.chance(0.7) else f'<figure>{caption}<img src="x.png"></figure>')

    def definitions(self) -> None:
        many = int(self.rng.integers(1, 5))
        self.out.append("<dl>" + "".join(self.said("dt", 1, 4) + self.said("dd", 1, 25, self.chance(0.6)) for _ in range(many)) + "</dl>")

    def data_table(self) -> None:
        """A table of the text itself: a caption, a row or a column of header cells, and short cells, numbers among them."""
        columns, first = int(self.rng.integers(1, 5)), self.chance(0.3)
        cell = lambda tag: self.said(tag, 1, 4) if self.chance(0.7) else f"<{tag}>{self.put(str(self.rng.integers(10_000)), True)}</{tag}>"
        rows = ["".join(cell("th") for _ in range(columns))] * self.chance(0.8)
        rows += ["".join(cell("th" if first and not i else "td") for i in range(columns)) for _ in range(self.rng.integers(1, 6))]
        head = self.said("caption", 1, 8) if self.chance(0.3) else ""
        self.out.append("<table>" + head + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")

    def loose(self) -> None:
        """A heading and text straight in divisions, broken by line ends, as long or short as it comes."""
        if self.chance(0.6):
            self.out.append(self.said("h2" if self.chance(0.5) else "h3", 1, 8))
        for _ in range(self.rng.integers(1, 4)):
            parts = [self.text(1, 30) for _ in range(self.rng.integers(1, 4))]
            self.put(" ".join(parts), True)
            self.out.append("<div>" + self.pick(["<br>", "<br/>", "<br><br>"]).join(parts) + "</div>")

    def body(self) -> None:
        for _ in range(self.rng.integers(1, 14) if self.chance(0.93) else self.rng.integers(14, 60)):
            kind = self.rng.random()
            if kind < 0.01:
                self.out += [f"<p>{self.put(self.text(1, 12), True)}</p>"] * int(self.rng.integers(2, 30))
            elif kind < 0.50:
                self.paragraph()
            elif kind < 0.53:
                self.figure()
            elif kind < 0.56:
                self.definitions()
            elif kind < 0.59:
                self.data_table()
            elif kind < 0.62:
                self.loose()
            elif kind < 0.70:
                self.out.append(f"<h2>{self.put(self.text(1, 9, False), True)}</h2>")
            elif kind < 0.76:
                self.out.append("<ul>" + "".join(f"<li>{self.put(self.text(2, 25), True)}</li>" for _ in range(self.rng.integers(1, 6))) + "</ul>")
            elif kind < 0.80:
                self.out.append(f"<blockquote>{self.put(self.text(4, 40), True)}</blockquote>")
            elif kind < 0.84:
                self.out.append("<table>" + "".join(f"<tr><td>{self.put(self.text(1, 4, False), True)}</td><td>{self.put(self.text(1, 6, False), True)}</td></tr>" for _ in range(self.rng.integers(1, 4))) + "</table>")
            elif kind < 0.88:
                self.out.append(f"<div>{self.put(self.text(5, 60), True)}</div>")
            elif kind < 0.91:
                tag = "xmp" if self.chance(0.35) else "pre"
                self.out.append(f"<{tag}>{self.put(self.text(2, 20, False), True)}</{tag}>")
            elif kind < 0.94:
                self.advert()
            elif kind < 0.96:
                self.small("div", self.names["share"])
            elif kind < 0.98:
                self.small("aside", self.names["side"], 0.6)
            else:
                self.form()

    def start(self) -> str:
        title = self.text(2, 12, False)
        if self.chance(0.8 if self.family == "bare" else 0.95):
            self.out.append(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>")
        return title

    def prose(self) -> None:
        """Main text that stands in its container without a paragraph of its own, or with one for each part."""
        kind = self.rng.integers(3)
        for _ in range(self.rng.integers(1, 6)):
            parts = [self.text(*((3, 25) if self.chance(0.4) else (8, 80))) for _ in range(self.rng.integers(1, 4))]
            self.put(" ".join(parts), True)
            text = self.pick(["<br>", "<br><br>", "<br />\n"]).join(parts)
            self.out.append((f"{text}<p>", f"<p>{text}</p>", f"<div>{text}</div>")[kind])

    def title_line(self, title: str) -> None:
        tag = self.pick(["h1", "h1", "h2"])
        self.out.append(f"<{tag}>{self.put(title, True)}</{tag}>")

    def around(self, p: float, *parts) -> None:
        for part in parts:
            if self.chance(p):
                part()

    def make_bare(self) -> None:
        """Little but the text: no container, or one division."""
        title = self.start()
        self.around(0.3, self.menu, lambda: self.small("div", self.names["head"]))
        shell = self.pick(["", "", "div", "center", "article", "main", "section"])
        self.out.append(self.open(shell, self.names["main"], 0.5) if shell else "")
        if self.chance(0.6):
            self.title_line(title)
        if self.chance(0.5):
            self.prose()
        if self.chance(0.6):
            for _ in range(self.rng.integers(1, 7)):
                self.paragraph()
        if not self.main:
            self.paragraph()
        self.out.append(f"</{shell}>" if shell else "")
        if any(self.names.values()):  # a nameless comment can't be told from the text
            self.around(0.3, self.comments, self.advert)
        if self.chance(0.3):
            tag = self.pick(["footer", "div", "p"])
            self.out.append(f"<{tag}>&copy; {self.text(1, 8, False)}</{tag}>")

    def make_divisions(self) -> None:
        """Divisions only, one for each part, often nested."""
        title = self.start()
        deep = self.rng.integers(0, 3)
        self.out.append("<div>" * deep)
        self.around(0.8, lambda: self.small("div", self.names["head"]), self.menu)
        self.around(0.3, self.form, self.advert, lambda: self.small("div", self.names["notice"]))
        self.out.append(self.open("div", self.names["main"], 0.8))
        if self.chance(0.85):
            self.title_line(title)
        self.prose() if self.chance(0.4) else self.body()
        if not self.main:
            self.paragraph()
        self.out.append("</div>")
        self.around(0.35, self.comments, lambda: self.small("div", self.names["side"]), lambda: self.small("div", self.names["ad"]))
        self.around(0.8, lambda: self.out.append(self.open("div", self.names["foot"], 0.9) + f"&copy; {self.text(1, 14, False)}</div>"))
        self.out.append("</div>" * deep)

    def cell(self, fill, *names: str) -> None:
        self.out.append("<td>" if self.chance(0.6) else f'<td class="{self.pick(list(names))}">' if names else '<td valign="top">')
        fill()
        self.out.append("</td>")

    def plain_links(self) -> None:
        joint = self.pick([" ", " | ", "<br>", " &middot; "])
        self.out.append(joint.join(f'<a href="/{i}">{self.text(1, 4, False)}</a>' for i in range(self.rng.integers(1, 8))))

    def make_table(self) -> None:
        """The page is a table: a row for the head, one with menu, text and margin, one for the foot."""
        title = self.start()
        self.out.append('<table width="100%">' + "<tbody>" * self.chance(0.3))
        if self.chance(0.7):
            self.out.append('<tr><td colspan="3">')
            self.out.append(f"<b>{self.text(1, 5, False)}</b>" if self.chance(0.6) else "")
            self.around(0.6, self.plain_links)
            self.out.append("</td></tr>")
        self.out.append("<tr>")
        if self.chance(0.7):
            self.cell(self.plain_links, *self.names["menu"])

        def text() -> None:
            if self.chance(0.85):
                self.title_line(title)
            self.prose() if self.chance(0.5) else self.body()
            if not self.main:
                self.paragraph()

        self.cell(text, *self.names["main"])
        if self.chance(0.4):
            self.cell(lambda: self.around(0.7, self.plain_links, lambda: self.out.append(self.text(2, 20))), *self.names["side"])
        self.out.append("</tr>")
        if self.chance(0.6):
            self.out.append(f'<tr><td colspan="3">&copy; {self.text(1, 10, False)}</td></tr>')
        self.out.append("</table>")
        self.around(0.2, self.comments)

    def make_portal(self) -> None:
        """Held out: three columns of nested divisions and lists, margins on both sides of the text, a byline under the title."""
        title = self.start()
        self.small("div", self.names["head"])
        self.out.append(self.open("ul", self.names["menu"], 1) + "".join(f'<li><a href="/{i}">{self.text(1, 3, False)}</a></li>' for i in range(self.rng.integers(3, 9))) + "</ul>")
        self.out.append("<div><div>")
        self.small("div", self.names["side"], 0.7)
        self.out.append("</div><div>" + self.open("div", self.names["main"], 0.7))
        self.title_line(title)
        self.around(0.4, lambda: self.small("div", self.names["share"], 1))
        self.prose() if self.chance(0.5) else self.body()
        self.out.append("</div>")
        self.around(0.4, self.comments)
        self.out.append("</div><div>")
        self.around(0.6, self.advert, lambda: self.small("div", self.names["side"], 0.7))
        self.out.append("</div></div>" + self.open("div", self.names["foot"], 0.8) + f"&copy; {self.text(1, 12, False)}</div>")

    def make(self) -> tuple[str, set[str]]:
        {"bare": self.make_bare, "divisions": self.make_divisions, "table": self.make_table, HELD_OUT: self.make_portal}.get(self.family, self.make_modern)()
        if self.chance(0.9):
            self.out.append("</body></html>")
        return "".join(self.out), self.main

    def make_modern(self) -> None:
        """Landmark elements or named sections, with everything that sites put around their text."""
        title = self.start()
        if self.chance(0.5):
            tag = "header" if self.chance(0.6) else "div"
            self.out.append(self.open(tag, self.names["head"], 0.5 if tag == "header" else 1))
            self.out.append(f"<h1>{self.text(1, 5, False)}</h1>" if self.chance(0.3) else f"<p>{self.text(1, 8, False)}</p>")
            if self.chance(0.5):
                self.menu()
            self.out.append(f"</{tag}>")
        if self.chance(0.75):
            self.menu()
        if self.chance(0.3):
            self.small("div", self.names["notice"])
        if self.chance(0.5):
            self.advert()
        if self.chance(0.2):
            self.form()
        side_first = self.chance(0.3)
        if side_first:
            self.small(self.pick(["aside", "div"]), self.names["side"])
        shell = self.rng.integers(6)
        opening = {0: "<article>", 1: "<main>", 2: self.open("div", self.names["main"], 1), 3: "<main><article>", 4: self.open("article", self.names["main"], 1), 5: self.open("section", self.names["main"], 1)}[int(shell)]
        self.out.append(opening)
        if self.chance(0.8):
            self.out.append(f"<h1>{self.put(title, True)}</h1>")
        if self.chance(0.2):
            self.small("div", self.names["share"])
        if self.chance(0.25):
            self.out.append(f"<p><b>{self.put(self.text(2, 30), True)}<br>")
        self.body()
        if self.chance(0.15):
            self.comments()
        self.out.append({0: "</article>", 1: "</main>", 2: "</div>", 3: "</article></main>", 4: "</article>", 5: "</section>"}[int(shell)])
        if self.chance(0.4):
            self.comments()
        if self.chance(0.4) and not side_first:
            self.small(self.pick(["aside", "div", "section"]), self.names["side"])
        if self.chance(0.2):
            self.form()
        if self.chance(0.2):
            self.small("div", self.names["notice"])
        if self.chance(0.85):
            tag = "footer" if self.chance(0.7) else "div"
            self.out.append(self.open(tag, self.names["foot"], 0.3 if tag == "footer" else 1) + "&copy; " + self.text(1, 20, False) + (f"<p>{self.text(1, 12)}</p>" if self.chance(0.4) else ""))
            if self.chance(0.3):
                self.links(1, 6)
            self.out.append(f"</{tag}>")


def make_page(rng: np.random.Generator, family: str | None = None) -> tuple[str, set[str]]:
    """(html, texts of its main blocks); the family is drawn where none is given, never the held-out one."""
    return _Page(rng, family or str(rng.choice(list(FAMILIES), p=list(FAMILIES.values())))).make()
