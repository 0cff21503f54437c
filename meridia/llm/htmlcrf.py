"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level boundaries, each with the
tags, classes and ids of its ancestors. Features of the ancestors and of the text score
each block as main text or boilerplate, transitions tie neighbours together, and Viterbi
decoding picks the best sequence. Weights come from maximum likelihood (forward-backward,
AdaGrad) on labelled pages that ``labelled_pages`` builds from a seed: articles in many
layouts (elements of their own, named and unnamed containers, layout tables, paragraphs
straight in the body) amid menus, headers, footers, sidebars, notices, adverts, forms and
comments, with names that say something and with names that don't.

Scripts, styles, comments, titles and other text that is never shown are not blocks.
Character references are decoded within their run of text, so none forms across a tag; white space inside a block becomes one space, and the
main blocks are joined in page order by one newline. Whole pages are read; the parser is
linear in their length. All ancestors of a block count, with every word of their classes, ids and roles.

Edge cases: null or empty html, and pages without main blocks, give the empty text; a page
cut short inside a tag loses that tag; an unclosed quote ends at the next ">"; unclosed
comments, scripts and xmp elements run to the end; xmp is shown as it is written, formulas without annotations;
repeated rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

# Fixed sets of HTML's element kinds.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("canvas iframe noembed noframes noscript object script style svg template textarea title".split())
#: Formulas stand in the text around them; of the second kind browsers show nothing, the third parts cells.
FORMULA = frozenset("maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
FORMULA_UNSHOWN = frozenset("annotation annotation-xml mphantom".split())
FORMULA_SPACE = frozenset("mspace mtd mtr".split())
#: An open element of the second kind ends when one of the first starts beside it.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}

#: What class and id names commonly say about an element.
GROUPS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs tabs toolbar pagination pager sitemap",
    "head": "header masthead topbar logo branding hero",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar aside widget related recommended rail trending popular teaser more",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay warning disclaimer",
    "form": "form search login signup subscribe newsletter register contact input",
    "share": "share social follow tools print meta byline tags",
    "comment": "comment comments reply replies respond discussion disqus thread feedback reviews",
    "main": "article post entry content main story body text page prose",
}
_GROUP_OF = {word: group for group, words in GROUPS.items() for word in words.split()}

_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in (*FORMULA_UNSHOWN, "xmp")}
_LABEL = re.compile(r'data-label="(\d)"')
_WORD = re.compile(r"[a-z]+")

#: (features of all ancestors and their names, tag of the innermost, tag of the one around it)
Place = tuple[frozenset[str], str, str]
#: (text, characters inside links, place, label if the page has it)
Block = tuple[str, int, Place, int | None]
NOWHERE: Place = (frozenset(), "", "")


def blocks_of(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order.

    Every ancestor and every word of its class, id and role counts. Features that are not
    among the known ones are left out, so that no element carries more than those down.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place, int | None]] = []
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    in_formula = False
    linked, in_link, trust_quotes, at, size = 0, False, True, 0, len(page)
    lower = page.lower() if len(page.lower()) == len(page) else page.translate({c: c + 32 for c in range(65, 91)})

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(map(html.unescape, parts)).split())
            if text:
                _, place, label = stack[-1] if stack else ("", NOWHERE, None)
                out.append((text, linked, place, label))
            parts.clear()
        linked = 0

    def pop() -> None:
        open_tags[stack.pop()[0]] -= 1

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            parts.append(page[at:lt])
            linked += (lt - at) * in_link
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing or after in ("!", "?"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                parts.append("<")
                at = lt + 1
            continue
        whole = _TAG_END.match(page, name.end()) if trust_quotes else None
        if whole:
            at = whole.end()
        else:
            trust_quotes = False
            end = page.find(">", name.end())
            at = end + 1 if end >= 0 else size
        tag = name[0].lower()
        if tag in FORMULA_UNSHOWN:
            if in_formula and not closing and not page.startswith("/>", at - 2) and tag not in unclosed:
                end = _ENDS[tag].search(page, at)
                if end:
                    end = page.find(">", end.end() - 1)
                    at = end + 1 if end >= 0 else size
                else:
                    unclosed.add(tag)
            continue
        if tag == "math":
            in_formula = not closing
        if tag in FORMULA_SPACE:
            parts.append(" ")
        if tag in FORMULA:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in UNSHOWN:
            # Where no end follows one place, none follows any later one.
            end = -1 if tag in unclosed else lower.find(f"</{tag}", at)
            if end < 0:
                unclosed.add(tag)
                at = size if tag in ("script", "style", "title", "textarea") else at
            else:
                end = page.find(">", end)
                at = end + 1 if end >= 0 else size
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            pop()
        while stack and stack[-1][0] in ENDED_BY.get(tag, ()):
            pop()
        attributes = page[name.end() : at]
        names = [w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())] if "=" in attributes else ()
        marked = _LABEL.search(attributes) if "data-label" in attributes else None
        _, (above, around, _), label = stack[-1] if stack else ("", NOWHERE, None)
        kind = "pre" if tag == "xmp" else tag
        new = {f for f in element_features(kind, names) if f not in above and (known is None or f in known)}
        stack.append((tag, (above | new if new else above, kind, around), int(marked[1]) if marked else label))
        open_tags[tag] += 1
        if tag == "xmp":
            end = _ENDS[tag].search(page, at)
            stop = end.start() if end else size
            parts.append(html.escape(page[at:stop], quote=False))
            at = stop
    flush()
    return out


def element_features(tag: str, names: Iterable[str]) -> Iterator[str]:
    """What an element says about all blocks inside it."""
    yield f"in={tag}"
    for name in names:
        yield f"name={name}"
        if name in _GROUP_OF:
            yield f"group={_GROUP_OF[name]}"


def ancestor_features(place: Place) -> set[str]:
    above, own, parent = place
    found = {"bias", f"own={own}", *above}
    if parent:
        found.add(f"parent={parent}")
    return found


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    density = min(linked / len(text), 1.0)
    found = [f"words={min(int(math.log2(words)), 7)}", f"linked={int(density * 4)}"]
    if text[-1] in ".!?:;\"”»…":
        found.append("ends")
    if "©" in text:
        found.append("copyright")
    if "," in text:
        found.append("comma")
    if text[0].islower():
        found.append("starts-low")
    if words <= 4 and text[-1] not in ".!?":
        found.append("label-like")
    return found


class BlockField:
    """Weights for main text against boilerplate, and of transitions between the two."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]
        self.start = [0.0, 0.0]
        self._places: dict[Place, float] = {}

    def emission(self, block: Block) -> float:
        text, linked, place, _ = block
        if place not in self._places:
            if len(self._places) > 50_000:
                self._places.clear()
            self._places[place] = sum(self.weight.get(f, 0.0) for f in ancestor_features(place))
        return self._places[place] + sum([self.weight.get(f, 0.0) for f in text_features(text, linked)])

    def decode(self, emissions: list[float]) -> list[int]:
        """Viterbi."""
        if not emissions:
            return []
        (a, b), (c, d) = self.step
        low, high, back = self.start[0], self.start[1] + emissions[0], []
        for e in emissions[1:]:
            from_low, from_high = (0, low + a) if low + a >= high + c else (1, high + c), (0, low + b) if low + b >= high + d else (1, high + d)
            back.append((from_low[0], from_high[0]))
            low, high = from_low[1], from_high[1] + e
        label = int(high > low)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]

    def text(self, page: str) -> str:
        blocks = blocks_of(page, self.weight)
        labels = self.decode([self.emission(b) for b in blocks])
        return "\n".join(b[0] for b, y in zip(blocks, labels, strict=True) if y)


def _add(x: float, y: float) -> float:
    top = max(x, y)
    return top + math.log1p(math.exp(-abs(x - y)))


def train(pages: list[str], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> BlockField:
    """Maximum likelihood on pages whose elements carry data-label attributes."""
    field, squares = BlockField(), Counter()
    data = []
    for page in pages:
        blocks = blocks_of(page)
        if blocks:
            data.append(([sorted(ancestor_features(b[2])) + text_features(b[0], b[1]) for b in blocks], [b[3] or 0 for b in blocks]))

    def move(key, value: float, gradient: float) -> float:
        gradient -= decay * value
        squares[key] += gradient * gradient
        return value + rate * gradient / math.sqrt(squares[key] + 1e-8)

    for _ in range(rounds):
        for features, labels in data:
            e = [sum(field.weight.get(f, 0.0) for f in fs) for fs in features]
            (a, b), (c, d) = field.step
            ahead = [(field.start[0], field.start[1] + e[0])]
            for x in e[1:]:
                low, high = ahead[-1]
                ahead.append((_add(low + a, high + c), _add(low + b, high + d) + x))
            behind = [(0.0, 0.0)]
            for x in reversed(e[1:]):
                low, high = behind[-1]
                behind.append((_add(a + low, b + x + high), _add(c + low, d + x + high)))
            behind.reverse()
            total = _add(*ahead[-1])
            main = [math.exp(ah[1] + bh[1] - total) for ah, bh in zip(ahead, behind, strict=True)]
            pairs = [[0.0, 0.0], [0.0, 0.0]]
            for i in range(1, len(e)):
                pairs[labels[i - 1]][labels[i]] += 1
                for s in (0, 1):
                    for t in (0, 1):
                        pairs[s][t] -= math.exp(ahead[i - 1][s] + field.step[s][t] + t * e[i] + behind[i][t] - total)
            gradients: Counter[str] = Counter()
            for fs, y, p in zip(features, labels, main, strict=True):
                for f in fs:
                    gradients[f] += y - p
            for f, g in gradients.items():
                field.weight[f] = move(f, field.weight.get(f, 0.0), g)
            for s in (0, 1):
                field.start[s] = move(("start", s), field.start[s], (labels[0] == s) - (main[0] if s else 1 - main[0]))
                for t in (0, 1):
                    field.step[s][t] = move(("step", s, t), field.step[s][t], pairs[s][t])
    return field


#: Where generated articles stand, and how often.
SHAPES = {"article": 36, "main": 10, "listed": 17, "section": 6, "unlisted": 10, "bare": 12, "table": 9}


def labelled_pages(count: int, seed: int = 0, shapes: Container[str] = tuple(SHAPES)) -> list[str]:
    """Pages in which data-label="1" marks the elements of the article and 0 the rest."""
    r = random.Random(seed)
    syllables = [c + v for c in "bdfgklmnprstvz" for v in ("a", "e", "i", "o", "un", "er")]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        s = words(3, 18)
        if r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + r.choice("....!?")

    def prose(a: int = 1, b: int = 8) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def names(group: str) -> str:
        if r.random() < 0.3:
            return ""
        name = r.choice(GROUPS[group].split()) + r.choice(["", "", f"-{word()}", "-wrapper", "-inner", "-box"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.55:
            body = prose()
            return body.replace(" ", f" {link(words(1, 3))} ", 1) if r.random() < 0.2 else body
        if kind < 0.65:
            return words(1, 6)
        if kind < 0.72:
            return prose().upper()
        if kind < 0.79:
            return " | ".join(words(1, 2) for _ in range(r.randint(2, 9)))
        if kind < 0.86:
            return " ".join(w + r.choice(["!!", "***", "%%%", "$$$"]) for w in words(4, 40).split())
        if kind < 0.92:
            return r.choice(["All rights reserved.", "Copyright (c) 2020 " + words(1, 3), "© " + words(1, 4), word() + "@" + word() + ".example", str(r.randint(10**6, 10**12))])
        return f"<b>{prose(1, 2)}<br>{prose(1, 2)}" + r.choice(["</b>", ""])

    def article() -> str:
        body = [f"<h1>{prose(1, 1) if r.random() < 0.5 else words(2, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.72:
                body.append(f"<p>{paragraph()}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.8:
                body.append(f"<h{(n := r.randint(2, 4))}>{words(1, 6)}</h{n}>")
            elif kind < 0.88:
                body.append("<ul>" + "".join(f"<li>{sentence() if r.random() < 0.6 else words(1, 5)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                body.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif kind < 0.96:
                body.append(f"<pre>{words(3, 20)}</pre>")
            else:
                body.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            if r.random() < 0.06:
                body.append(f'<div{names("advert")} data-label="0">{prose(1, 2)}</div>' if r.random() < 0.6 else f'<aside data-label="0"{names("side")}><h3>{words(1, 3)}</h3><p>{prose(1, 2)}</p></aside>')
        inner = "".join(body)
        shape = r.choices([x for x in SHAPES if x in shapes], [n for x, n in SHAPES.items() if x in shapes])[0]
        if shape == "article":
            return f'<article data-label="1"{names("main") if r.random() < 0.4 else ""}>{inner}</article>'
        if shape == "main":
            return f'<main data-label="1"{names("main") if r.random() < 0.4 else ""}>{inner}</main>'
        if shape == "listed":
            return f'<div data-label="1" {r.choice(["class", "id"])}="{r.choice(GROUPS["main"].split())}{r.choice(["", "-body", "-text"])}">{inner}</div>'
        if shape == "section":
            return f'<section data-label="1">{inner}</section>'
        if shape == "unlisted":
            return f'<div data-label="1"{strange()}>{inner}</div>'
        if shape == "table":
            side = r.choice([menu, sidebar, menu])()
            cells = [f'<td data-label="0"{r.choice([strange(), "", " width=120"])}>{side}</td>', f'<td data-label="1"{r.choice([strange(), "", ""])}>{inner}</td>']
            return f"<table><tr>{''.join(cells)}</tr></table>"
        return inner if r.random() < 0.7 else f"{prose(2, 6)}<br><br>{prose(2, 6)}"

    def strange() -> str:
        """Names that say nothing, as many as stylesheets have."""
        return f' {r.choice(["class", "class", "id"])}="{" ".join("-".join(word() for _ in range(r.randint(1, 3))) for _ in range(r.choice([1, 1, 2, 4])))}"'

    def marked(piece: str) -> str:
        return re.sub(r"^<(\w+)", r'<\1 data-label="0"', piece, count=1)

    def menu() -> str:
        items = "".join(f"<li>{link(words(1, 2).capitalize() + r.choice(['', '', '.', ',']))}</li>" for _ in range(r.randint(2, 9)))
        return r.choice([f"<nav{names('menu')}><ul>{items}</ul></nav>", f'<div class="{r.choice(GROUPS["menu"].split())}"><ul>{items}</ul></div>', f"<div{strange()}><ul>{items}</ul></div>"])

    def header() -> str:
        return f"<header{names('head')}><{(t := r.choice(['h1', 'div', 'p', 'h2']))}>{words(1, 5).title()}</{t}>" + (f"<p>{sentence()}</p>" if r.random() < 0.5 else "") + (menu() if r.random() < 0.4 else "") + "</header>"

    def advert() -> str:
        return f'<div class="{r.choice(GROUPS["advert"].split())}">{r.choice([prose(1, 3), link(words(2, 7)), words(2, 6), prose(1, 2) + chr(10) + prose(1, 2)])}</div>'

    def notice() -> str:
        return f'<div class="{r.choice(GROUPS["notice"].split())}"><p>{prose(1, 3)}</p><button>{words(1, 2)}</button></div>'

    def form() -> str:
        return f'<form{names("form")}><label>{words(1, 3)}</label><input name="q"><select><option>{word()}<option>{word()}</select><p>{sentence()}</p><button>{words(1, 2)}</button></form>'

    def sidebar() -> str:
        inner = f"<h3>{words(1, 3)}</h3>" + r.choice([f"<p>{prose(1, 3)}</p>", "<ul>" + "".join(f"<li>{link(words(3, 9))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"])
        return r.choice([f"<aside{names('side')}>{inner}</aside>", f'<div class="{r.choice(GROUPS["side"].split())}">{inner}</div>'])

    def comments() -> str:
        t = r.choice(["div", "div", "li", "article"])
        each = "".join(f'<{t} class="comment"><h4>{word()}</h4><p>{prose(1, 4)}</p></{t}>' for _ in range(r.randint(1, 5)))
        return f'<{(s := r.choice(["section", "div"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "replies", "discussion", "comments-area"])}"><h3>{words(1, 3)}</h3>{each}</{s}>'

    def footer() -> str:
        inner = r.choice([f"&copy; {word()}.example &middot; {prose(1, 2)}", f"<p>© {r.randint(1999, 2030)} {words(1, 4)}. All rights reserved.</p>", f"<p>{prose(1, 3)}</p>", "<ul>" + "".join(f"<li>{link(words(1, 2))}</li>" for _ in range(4)) + "</ul>"])
        return r.choice([f"<footer{names('foot')}>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{r.choice(["footer", "copyright", "legal", "bottom"])}">{inner}</div>'])

    pages = []
    for _ in range(count):
        before = [f() for f, p in ((notice, 0.2), (header, 0.4), (menu, 0.8), (form, 0.15), (advert, 0.5), (sidebar, 0.2)) if r.random() < p]
        after = [f() for f, p in ((advert, 0.2), (sidebar, 0.3), (comments, 0.35), (form, 0.2), (notice, 0.15), (footer, 0.9)) if r.random() < p]
        body = "".join(map(marked, before)) + article() + "".join(map(marked, after))
        if r.random() < 0.3:
            body = f'<div{r.choice([f""" id="{r.choice(["page", "wrapper", "container", "root"])}\"""", strange()])}>{body}</div>'
        # What has no label of its own is an article that stands straight in the body.
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var t='</p>';</script></head><body data-label=\"1\">{body}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained(pages: int = 800, seed: int = 0) -> BlockField:
    """The field trained on that many labelled pages; a few seconds, once a driver."""
    return train(labelled_pages(pages, seed))


def main_text(field: BlockField, pages: DataFrame, html_col: str = "html") -> Column:
    """The main text of each whole page."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field)  # some hundred weights

    @F.arrow_udf("string")
    def extract(htmls: pa.Array) -> pa.Array:
        return pa.array([shared.value.text(h.as_py()) for h in htmls], pa.string())

    return extract(text_or_empty(html_col))
