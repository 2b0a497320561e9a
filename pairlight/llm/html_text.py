"""Main text of web pages by a tree-structured graphical model.

Each element of a page's DOM is a node with two states, content or boilerplate.
Node potentials come from its tag, the words of its class, id and role, the
length of its text and the share of links, in it and below it; parent-child
potentials couple the nodes along the tree. Sum-product messages go up from the leaves and down from
the root, and give every node's exact content marginal. Text stands in the
result if the marginal of its element is at least one half.

The potentials are fitted here, by the gradient of the exact likelihood, on
labelled pages. The tables have no labelled pages, so these are generated: ``PAGES``
pages of many layouts (semantic tags, class names in several languages or that say
nothing, plain elements, no container at all; menus, headers, notices, adverts in
blocks and within lines, forms and stray parts of them, sidebars, comments, footers)
whose parts are known. A node, inline ones too, counts as content if it holds main text.

Character references are decoded; white space inside a block becomes one space;
blocks are trimmed and joined in page order by one space. Null or empty html, or a
page without content: empty text. Unclosed, crossed or cut-off markup is read as
far as it goes: a quote opens a value only behind an equals sign, and one that
nothing closes ends with its tag. Repeated rows: one result each. A very long page
is one row and is held whole, with its tree. Empty table: empty. Extra columns
pass through ``extract``; ``text`` and ``n_chars`` replace columns of that name.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.llm.text import slices, tidy, unused

PAGES, STEPS, SEED = 1200, 150, 10
# Fixed values of HTML: elements without content, with raw text, and those that run inside a line.
#: Only there does a slash at a tag's end close the element.
FOREIGN = frozenset(["math"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg xmp".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i ins kbd label mark q ruby rp rt s samp small span strong sub sup time tt u var wbr img del big strike".split())
#: Lists, tables and their parts; they, inline elements and all others have parent-child potentials of their own.
PARTED = frozenset("ul ol dl table li dt dd tr td th tbody thead tfoot caption figcaption option summary".split())
KINDS = 3
# An element on the left is closed by the start of one on the right.
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: An attribute's value. A quote opens only behind the equals sign; one that nothing closes ends with the tag.
_VALUE = r"""\"[^\"<>]*\"|'[^'<>]*'|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'][^>]*|[^\s>\"'][^\s>]*|"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE}))?+)*+)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(rf"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+", re.S)
#: The attributes whose words tell what an element is for.
NAMED = frozenset("class id role itemprop aria-label".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Elements in page order, with parent and depth, and the text runs between their tags."""

    __slots__ = ("parent", "depth", "tag", "names", "text", "links", "runs")

    def __init__(self, source: str) -> None:
        self.parent, self.depth, self.tag, self.names, self.text, self.links = [-1], [0], ["#page"], [()], [0], [0]
        #: (element, text) or (element, None) where a block begins or ends.
        self.runs: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, linked, at = [0], 0, 0
        match = _TOKEN.match
        end = len(source)
        while at < end:
            m = match(source, at)
            if m is None:
                break
            at = m.end()
            closing, name, attrs, text = m.groups()
            if text is not None:
                if text.strip():
                    own = stack[-1]
                    n = len(text)
                    self.text[own] += n
                    if linked:
                        self.links[own] += n
                self.runs.append((stack[-1], text))
                continue
            if name is None:
                continue
            name = name.lower()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == name:
                        if name not in INLINE:
                            self.runs.append((stack[i], None))
                        linked -= sum(self.tag[x] == "a" for x in stack[i:])
                        del stack[i:]
                        break
                continue
            while len(stack) > 1 and name in CLOSES.get(self.tag[stack[-1]], ()):
                stack.pop()
            if name in VOID:
                if name in ("br", "hr"):
                    self.runs.append((stack[-1], None))
                continue
            node = len(self.parent)
            self.parent.append(stack[-1])
            self.depth.append(self.depth[stack[-1]] + 1)
            self.tag.append(name)
            self.names.append(tuple(_WORD.findall(_CAMEL.sub(" ", html.unescape(" ".join(value for key, value in _ATTR.findall(attrs) if key.lower() in NAMED))).lower())) if "=" in attrs else ())
            self.text.append(0)
            self.links.append(0)
            if name not in INLINE:
                self.runs.append((node, None))
            if name in RAW:  # nothing in it is markup, and nothing of it is text
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                self.runs.append((node, None))
            elif not (attrs.endswith("/") and self.inside(stack, FOREIGN)):
                stack.append(node)
                linked += name == "a"

    def inside(self, stack: list[int], tags: frozenset) -> bool:
        return any(self.tag[i] in tags for i in stack)

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        text, links = list(self.text), list(self.links)
        for i in range(n - 1, 0, -1):  # what an inline element says belongs to its block
            if self.tag[i] in INLINE:
                text[self.parent[i]] += text[i]
                links[self.parent[i]] += links[i]
        whole, linked, ps = list(text), list(links), [0] * n
        for i in range(n - 1, 0, -1):
            if self.tag[i] not in INLINE:
                whole[self.parent[i]] += whole[i]
                linked[self.parent[i]] += linked[i]
            ps[self.parent[i]] += self.tag[i] == "p"
        out = []
        for i in range(n):
            own = ["1", "t=" + self.tag[i]]
            inline = self.tag[i] in INLINE
            if self.parent[i] >= 0:
                own.append("p=" + self.tag[self.parent[i]])
                own.append("p=" + self.tag[self.parent[i]] + " " + self.tag[i])
            own.append(("n+" if self.names[i] else "n-") + ("i" if inline else self.tag[i] if self.tag[i] in ("div", "section", "p") else ""))
            if not inline and whole[i] > text[i]:  # a container: all its text, and how much of it are links
                size = whole[i]
                own.append("S=" + ("1" if size < 60 else "2" if size < 200 else "3" if size < 800 else "4" if size < 3200 else "5"))
                own.append("L=" + (many := "0" if linked[i] < 0.15 * size else "1" if linked[i] < 0.6 * size else "2"))
                if i:
                    own.append(f"L={many} {self.tag[self.parent[i]]}")
                own.append("P=" + ("0" if not ps[i] else "1" if ps[i] == 1 else "2"))
            elif not inline and i:
                beside = "q=" + ("0" if not ps[self.parent[i]] else "1" if ps[self.parent[i]] == 1 else "2")
                own.append(f"{beside} {self.tag[self.parent[i]]} p" if self.tag[i] == "p" else beside)
            own += ["n=" + w for w in dict.fromkeys(self.names[i])]
            if inline:  # its text counts for its block
                out.append(own)
                continue
            size = text[i]
            own.append("s=" + ("0" if not size else "1" if size < 25 else "2" if size < 80 else "3" if size < 240 else "4"))
            if size:
                share = links[i] / size
                own.append("l=" + ("0" if share < 0.1 else "1" if share < 0.5 else "2"))
            out.append(own)
        return out

    def read(self, content: np.ndarray) -> str:
        """Blocks of content text, joined by one space."""
        blocks, now = [], []
        for node, text in self.runs:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif content[node]:
                now.append(text)
        if now:
            blocks.append("".join(now))
        return " ".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


class Forest:
    """Trees of several pages as arrays, ordered by depth for the messages."""

    def __init__(self, pages: list[Page], known: dict[str, int], grow: bool = False) -> None:
        sizes = np.array([len(p.tag) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.parent = np.concatenate([np.array(p.parent) + a for p, a in zip(pages, self.first, strict=False)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        self.kind = np.array([1 if t in PARTED else 2 if t in INLINE else 0 for p in pages for t in p.tag])
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        node, feature = [], []
        at = 0
        for page in pages:
            for own in page.features():
                for f in own:
                    i = known.setdefault(f, len(known)) if grow else known.get(f, -1)
                    if i >= 0:
                        node.append(at)
                        feature.append(i)
                at += 1
        self.node, self.feature, self.n = np.array(node), np.array(feature), at

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the expected counts of (parent, child) states, by sum-product."""
        score = np.bincount(self.node, weights[self.feature], minlength=self.n)
        up = np.zeros((self.n, 2))
        up[:, 1] = score
        sent = np.zeros((self.n, 2))
        for own in reversed(self.levels[1:]):
            e = edge[self.kind[own]]
            sent[own] = np.logaddexp(e[:, :, 0] + up[own, :1], e[:, :, 1] + up[own, 1:])
            np.add.at(up, self.parent[own], sent[own])
        down = np.zeros((self.n, 2))
        pairs = np.zeros((KINDS, 2, 2))
        for own in self.levels[1:]:
            above = down[self.parent[own]] + up[self.parent[own]] - sent[own]  # the parent without this child
            e = edge[self.kind[own]]
            joint = above[:, :, None] + e + up[own][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            p = np.exp(joint)
            p /= p.sum(axis=(1, 2), keepdims=True)
            np.add.at(pairs, self.kind[own], p)
            down[own] = np.logaddexp(above[:, :1] + e[:, 0], above[:, 1:] + e[:, 1])
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


class TreeModel:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.edge = np.zeros((KINDS, 2, 2))

    def fit(self, pages: list[Page], labels: list[np.ndarray], steps: int = STEPS, decay: float = 2e-3) -> None:
        forest = Forest(pages, self.known, grow=True)
        y = np.concatenate(labels).astype(float)
        self.weights = np.zeros(len(self.known))
        inner = np.concatenate(forest.levels[1:])
        seen = np.zeros((KINDS, 2, 2))
        np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]].astype(int), y[inner].astype(int)), 1)
        square, square_edge = np.full(len(self.weights), 1e-6), np.full((KINDS, 2, 2), 1e-6)
        for _ in range(steps):
            p, pairs = forest.marginals(self.weights, self.edge)
            g = np.bincount(forest.feature, (y - p)[forest.node], minlength=len(self.weights)) / len(pages) - decay * self.weights
            ge = (seen - pairs) / len(pages) - decay * self.edge
            square += g * g
            square_edge += ge * ge
            self.weights += 0.5 * g / np.sqrt(square)
            self.edge += 0.5 * ge / np.sqrt(square_edge)

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        if not pages:
            return []
        forest = Forest(pages, self.known)
        content = forest.marginals(self.weights, self.edge)[0] >= 0.5
        return [page.read(content[a:b]) for page, a, b in zip(pages, forest.first, forest.first[1:], strict=False)]


# Names that web pages commonly give to their parts.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu links pagination toc tabs",
    "header": "header masthead banner logo site branding top topbar hero",
    "footer": "footer bottom copyright colophon legal credits imprint",
    "aside": "sidebar aside related widget popular trending recommended more rail teaser promo",
    "ad": "ad ads advert advertisement sponsor sponsored promoted adbox dfp commercial",
    "notice": "cookie cookies consent notice banner popup modal overlay gdpr alert privacy warning disclaimer",
    "form": "form newsletter subscribe search login signup searchbox contact subscription",
    "comments": "comments comment discussion replies reply thread disqus responses respond reader feedback",
    "share": "share social sharing follow tags meta byline toolbar buttons",
    "main": "main content article post entry body story text page blog news primary container wrapper single copy prose",
}
#: Such names in other languages.
FOREIGN_PARTS = {
    "nav": "menue navigazione menú leiste", "header": "kopf entête cabecera testata", "footer": "fuss fußzeile pied pie", "aside": "randspalte seite lateral colonne", "ad": "werbung anzeige publicité publicidad pub reklame",
    "notice": "hinweis avis aviso datenschutz", "form": "formular suche recherche buscar anmelden", "comments": "kommentare commentaires comentarios leserbriefe", "share": "teilen partager compartir", "main": "inhalt beitrag artikel contenu texte contenido cuerpo testo haupt",
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section", "ins"], "notice": ["div", "section", "aside"], "form": ["form", "div"], "comments": ["section", "div", "aside"], "share": ["div", "ul", "p"]}


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """(html, main blocks): pages of random layouts; main words begin with ``qz`` so that the parts can be told apart."""
    rng = np.random.Generator(np.random.Philox(key=seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def words(lo: int, hi: int, main: bool = False) -> str:
        own = ["".join(pick("abcdefghilmnoprstuv") for _ in range(int(rng.integers(2, 9)))) for _ in range(int(rng.integers(lo, hi + 1)))]
        return " ".join("qz" + w if main else w for w in own).capitalize() + pick([".", ".", "!", "?", ""])

    def named(kind: str, always: float) -> str:
        names = (PARTS if chance(0.75) else FOREIGN_PARTS)[kind].split()
        if chance(0.15):  # names that say nothing
            names = ["".join(pick("abcdefghklmnrstuvwxyz") for _ in range(int(rng.integers(2, 8)))) for _ in range(3)]
        own = [pick(names) for _ in range(int(rng.integers(1, 3)))]
        if chance(0.3):
            own = ["-".join([pick(names), pick(["box", "area", "wrap", "inner", "block", "list", "section"])])]
        return f' {pick(["class", "class", "id"])}="{" ".join(own)}"' if chance(always) else ""

    def link_list(k: int) -> str:
        tag = pick(["ul", "ul", "ul", "ol"])
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a>' + pick(["</li>", "</li>", ""]) for i in range(k)) + f"</{tag}>"

    def junk(kind: str) -> str:
        tag = pick(_TAGS[kind])
        own_tag = tag in ("nav", "footer", "header", "aside", "form")
        if tag == "ul":
            return f"<ul{named(kind, 1)}>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(int(rng.integers(3, 8)))) + "</ul>"
        inner = {
            "nav": lambda: link_list(int(rng.integers(3, 9))),
            "header": lambda: pick(["", f"<h1>{words(1, 3)}</h1>", f"<h2>{words(1, 3)}</h2>", f"<div>{words(1, 4)}</div>"]) + f"<p>{words(2, 8)}</p>" * int(rng.integers(0, 2)) + pick(["", link_list(4)]),
            "footer": lambda: pick(["&copy; ", ""]) + words(3, 25) + pick(["", link_list(4), f"<p>{words(5, 30)}</p>"]),
            "aside": lambda: f"<h3>{words(1, 3)}</h3>" + pick([link_list(5), f"<p>{words(8, 40)}</p>"]),
            "ad": lambda: pick([words(3, 30), f"<p>{words(5, 30)}</p>", f'<a href="#">{words(3, 12)}</a>']),
            "notice": lambda: pick([words(5, 30), f"<p>{words(8, 40)}</p>"]) + pick(["", f"<button>{words(1, 2)}</button>"]),
            "form": lambda: f"<label>{words(1, 4)}</label><input name=x><button>{words(1, 2)}</button>" + pick(["", f"<p>{words(4, 20)}</p>"]),
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f"<{t}{named('comments', 1 if t == 'article' else 0.6)}><b>{words(1, 2)}</b><p>{words(4, 40)}</p></{t}>" for t in [pick(["div", "li", "article"])] * int(rng.integers(1, 5))),
            "share": lambda: "".join(f'<a href="#">{words(1, 2)}</a> ' for _ in range(4)),
        }[kind]()
        return f"<{tag}{named(kind, 0.4 if own_tag else 1)}>{inner}</{tag}>"

    def main_block() -> str:
        kind = pick(["p"] * 8 + ["h2", "h3", "ul", "links", "links", "links", "links", "links", "linked", "figure", "blockquote", "pre", "table", "bold", "dl", "lines"])
        if kind == "figure":
            return f"<figure><img src=/i.png><figcaption>{words(1, 15, True)}</figcaption></figure>"
        if kind == "links":
            tag = pick(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f'<li><a href="/{i}">{words(1, 9, True)}</a>' + pick(["</li>", "</li>", ""]) for i in range(int(rng.integers(2, 9)))) + f"</{tag}>"
        if kind == "linked":
            return f'<p><a href="/y">{words(2, 20, True)}</a></p>'
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words(3, 20, True)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{words(1, 4, True)}</td><td>{words(1, 4, True)}</td></tr>" for _ in range(3)) + "</table>"
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{words(1, 4, True)}</dt><dd>{words(3, 30, True)}</dd>" for _ in range(int(rng.integers(1, 5)))) + "</dl>"
        if kind == "lines":
            return "<p>" + "<br>".join(words(4, 30, True) for _ in range(int(rng.integers(2, 5)))) + "</p>"
        if kind in ("h2", "h3"):
            return f"<{kind}>{words(1, 8, True)}</{kind}>"
        if kind == "bold":
            return f"<p><b>{words(1, 12, True)}<br>"
        text = words(1, 90, True)
        if chance(0.35):
            inner = pick(["a href=/x", "em", "strong", "i", "b", "span", "code", "span style=x", "small", "mark"])
            text += f' <{inner}>{words(1, 6, True)}</{inner.split()[0]}> {words(2, 20, True)}'
        if chance(0.12):
            inner = pick(["span", "ins", "a", "span", "ins", "small", "em"])
            where = pick(["", words(2, 12, True)])
            text += f' <{inner}{named("ad", 1)}>{words(1, 6)}</{inner}> {where}'
        return f"<{kind}>{text}" + ("" if kind == "p" and chance(0.3) else f"</{kind}>")

    out = []
    for _ in range(n):
        tag = pick(["article", "article", "main", "div", "section"])
        title = f"<{(own := pick(['h1', 'h1', 'h2']))}>{words(1, 10, True)}</{own}>"
        title = f"<header>{title}</header>" if chance(0.1) else title
        inside = [title] * int(rng.integers(0, 2)) + [main_block() for _ in range(int(pick([1, 2, *rng.integers(1, 9, 4)])))]
        if chance(0.1):  # a page of a few words
            inside = [f"<p>{words(2, 12, True)}</p>"]
        if chance(0.15):  # parts of forms without a form, adverts in the flow
            stray = [f"<label>{words(1, 3)}</label><select><option>{words(1, 2)}<option>{words(1, 2)}</select>", f"<button>{words(1, 3)}</button>", f"<fieldset><legend>{words(1, 3)}</legend><label>{words(1, 4)}</label><input></fieldset>", f"<label>{words(1, 4)}</label><textarea>{words(1, 4)}</textarea>", f"<ins{named('ad', 1)}>{words(1, 9)}</ins>", f"<select><option>{words(1, 2)}</option><option>{words(1, 2)}</option></select>"]
            inside.insert(int(rng.integers(1, len(inside) + 1)), pick(stray))
        for kind in ("ad", "share", "form", "aside", "notice", "comments"):
            if chance(0.12):
                inside.insert(int(rng.integers(1, len(inside) + 1)) if kind != "comments" else len(inside), junk(kind))
        if chance(0.3):  # a plain page: elements without names, or none around the text
            wrap = pick([0, 0, 1, 2])
            body = "<div>" * wrap + "".join(inside) + "</div>" * wrap
        else:
            body = f"<{tag}{named('main', 0.4 if tag in ('article', 'main') else 0.8)}>{''.join(inside)}</{tag}>"
        for _ in range(int(rng.integers(0, 3)) if chance(0.4) else 0):
            body = f"<div{named('main', 0.7)}>{body}</div>"
        if chance(0.35):
            body = f"<{pick(['div', 'main', 'section'])}{named('main', 0.8)}>{pick(['', junk('nav'), junk('aside')])}{body}{pick(['', junk('aside'), junk('comments'), junk('share')])}</div>"
        some = pick([0.0, 0.3, 0.5, 0.6])
        if chance(0.12):  # an article of a few words and nothing else
            some, body = 0.0, f"<article><p>{words(2, 8, True)}</p></article>"
        before = [junk(k) for k in ("notice", "header", "nav", "ad", "form") if chance(some)]
        after = [junk(k) for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if chance(some)]
        extra = pick(["", f"<style>.{words(1, 1)}{{color:red}}</style>", f"<script>f({int(rng.integers(99))})</script>", f'<link rel=x href="/s.css"><base href="/">'])
        head = pick(["<!DOCTYPE html><html>", "<html>", '<html lang="en">', ""]) + pick([f"<head><title>{words(2, 8)}</title>{extra}</head>", f"<head>{extra}<meta charset=utf-8></head>", ""]) + pick(["<body>", '<body class="page">', "<body>", ""])
        out.append(head + "".join(before) + body + "".join(after) + pick(["</body></html>", "</body></html>", ""]))
    return [(page, re.findall(r"qz\w+", page, re.I)) for page in out]


@functools.lru_cache(maxsize=4)
def trained(pages: int = PAGES, steps: int = STEPS, seed: int = SEED) -> TreeModel:
    """A model, kept for the session, fitted on ``pages`` generated pages; a node is content if main text stands in it."""
    parsed, labels = [], []
    for source, _ in labelled_pages(pages, seed):
        page = Page(source)
        y = np.zeros(len(page.tag), bool)
        for node, text in page.runs:
            if text and re.search(r"\bqz", text, re.I):
                while node >= 0 and not y[node]:
                    y[node] = True
                    node = page.parent[node]
        parsed.append(page)
        labels.append(y)
    model = TreeModel()
    model.fit(parsed, labels, steps)
    return model


def extract(pages: DataFrame, html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """``pages`` with text and n_chars; the html column is dropped."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    hidden = unused("html_of_page", pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, hidden, 2 << 20):
                texts = own.texts([h or "" for h in batch.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html_col}`").cast("string").alias(hidden)).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
