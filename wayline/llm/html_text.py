"""HTML extraction by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, stretches of text within one innermost block element.
Each block has features of its ancestors (tags, words of class, id and role) and of its
text (length, share of links, endings, cue words), and those of its neighbours' text. A
chain over a page's blocks with the labels main and other is trained on labelled pages,
and a page is decoded by Viterbi; the main blocks are joined in page order.

``labelled_pages`` makes the training pages: layouts, class names and texts are drawn
from lists by a seeded generator, several hundred pages whatever the corpus, so that the
model is the same in every run. ``train`` takes any other labelled blocks as well.

Character references are decoded, white space within a block becomes one space (a line
break element counts as white space). Scripts, styles, templates, text areas, frames and
comments hold no text; that of any other element is kept as it stands. Null
and empty pages and pages without main text give an empty text. Pages are handled one by
one: repeated rows, null ids and null urls keep their rows, an empty table gives none. A very
long page takes time and memory in proportion to its length, whatever stands in it: tags are
found in one forward scan, and of an ancestor only features that the model knows are kept.
Of labels that are equally likely "other" is chosen. A column named ``text`` is replaced,
others are passed through, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

PAGES, SEED, STEPS, DECAY = 700, 5, 250, 0.02

# A tag from its name on; quoted values may hold ">". Both forms end before or at the next "<" or ">", so scanning is linear.
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_WHOLE = re.compile(_NAME.pattern + r"((?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'])*+)>")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "template", "iframe", "textarea")}
_NAMES = re.compile(r"\b(class|id|role|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCKS = frozenset(
    "html head title body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "form fieldset legend label button select option pre blockquote figure figcaption address details summary hr noscript dialog menu center".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_ENDS_P = frozenset("main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol dl table form fieldset pre blockquote figure address details hr menu center".split())
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_CUES = frozenset("cookie cookies copyright rights reserved subscribe newsletter login log sign menu home share comment comments reply replied sponsored advertisement privacy terms related read posted search".split())


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of each tag of a page in one forward scan.

    A raw element is one tag up to its end. Comments, declarations and the like have no name. A "<" that
    begins none of these is text. Where no ">" follows, no tag is sought any more.
    """
    at, size, last = 0, len(page), page.rfind(">")
    in_svg = 0
    while (start := page.find("<", at)) >= 0:
        m = _WHOLE.match(page, start)
        if m is not None:
            slash, name, attributes = m.groups()
            name, end = name.lower(), m.end()
        elif page.startswith("!--", start + 1) or page.startswith("![CDATA[", start + 1):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(mark, start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        elif start > last:
            return
        elif (m := _NAME.match(page, start)) is None:
            at = start + 1
            if at < size and page[at] in "!?/":
                at = page.find(">", at) + 1
                yield start, at, "", False, ""
            continue
        else:
            slash, name = m.group(1), m.group(2).lower()
            end = page.find(">", m.end()) + 1
            if not end:
                return
            attributes = page[m.end() : end - 1]
        raw = not slash and name in _RAW
        if raw:
            end = page.find(">", m.end(2)) + 1
            attributes = page[m.end(2) : end - 1]
        if name == "svg" and not attributes.endswith("/"):
            in_svg = max(0, in_svg - 1) if slash else in_svg + 1
        if raw and not (in_svg and attributes.endswith("/")):  # only in svg may such an element close itself
            close = _RAW[name].search(page, end)
            end = (page.find(">", close.end()) + 1 or size) if close else size
        at = end
        yield start, end, "title-in-svg" if in_svg and name == "title" else name, bool(slash), attributes


class _Open:
    """The open block elements, with the places of each name, so that closing one looks at no other."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset]] = [("", frozenset())]
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, features: frozenset) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, features))

    def pop(self, names, stops=()) -> None:
        """Close down to the innermost open element of these names, if none of stops is further in."""
        innermost = lambda many: max((self.places[n][-1] for n in many if self.places.get(n)), default=0)
        k = innermost(names)
        if k and k >= innermost(stops):
            for name, _ in reversed(self.stack[k:]):
                self.places[name].pop()
            del self.stack[k:]


def blocks(page: str, known: frozenset | None = None) -> list[tuple[str, frozenset, list[str]]]:
    """(text, ancestor features, text features) of each leaf block of a page, in order; of ancestor features those known, if given."""
    out = []
    opened = _Open()
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, opened.stack[-1][1], _of_text(text, linked)))
            parts.clear()
        linked = 0

    for start, end, name, slash, attributes in tags(page):
        if start > at:
            run = page[at:start]
            parts.append(run)
            if in_link:
                linked += len(run)
        at = end
        if name in _RAW and not slash or name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if slash else 1
            continue
        block = name in BLOCKS
        if not block:
            continue
        close()
        in_link = in_link if name == "div" or name == "p" else 0
        if slash:
            opened.pop((name,))
            continue
        if name in _ENDS_P:
            opened.pop(("p",), ("div", "td", "th", "li", "article", "section", "body", "main", "aside", "blockquote", "form"))
        if name in _ENDS:
            names, stops = _ENDS[name]
            opened.pop(names.split(), stops)
        if name not in _VOID:
            opened.push(name, _with(opened.stack[-1][1], name, attributes, known))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def _with(above: frozenset, name: str, attributes: str, known: frozenset | None) -> frozenset:
    own = {f"in={name}", f"leaf={name}"}
    if attributes:
        for key, a, b, c in _NAMES.findall(attributes):
            key = key.lower()
            if key == "hidden" or (key == "style" and "none" in (a or b or c)):
                own.add("hidden")
            elif key != "style":
                own.update(f"named={x.lower()}" for x in _PART.findall(a or b or c))
    own.update(x for x in above if x[:5] != "leaf=")
    return frozenset(own if known is None else own & known)


def _of_text(text: str, linked: int) -> list[str]:
    words = text.split(" ")
    n = len(words)
    share = min(1.0, linked / len(text))
    out = [f"words={min(7, n.bit_length())}", f"links={0 if share < 0.1 else 1 if share < 0.6 else 2}", "bias"]
    out.append("ends=stop" if text[-1] in ".!?\"'»”" else "ends=other")
    if "©" in text:
        out.append("sign=copyright")
    if n <= 25:
        out.extend(f"cue={w}" for w in {x.strip(".,:;!?()").lower() for x in words} & _CUES)
    return out


def features(page_blocks: list[tuple[str, frozenset, list[str]]]) -> list[list[str]]:
    """All features of each block: its own, and what text stands before and after it."""
    near = [[x for x in t if x[:4] in ("word", "link", "ends")] for _, _, t in page_blocks]
    out = []
    for i, (_, above, text) in enumerate(page_blocks):
        f = [*above, *text]
        f += [f"before:{x}" for x in near[i - 1]] if i else ["first"]
        f += [f"after:{x}" for x in near[i + 1]] if i + 1 < len(page_blocks) else ["last"]
        out.append(f)
    return out


class Chain:
    """A trained chain: a weight for each feature (main against other) and for each step between labels."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps, self.known = weights, steps.tolist(), frozenset(weights)

    def decode(self, page_features: list[list[str]]) -> list[bool]:
        """Viterbi: whether each block is main."""
        (oo, om), (mo, mm) = self.steps
        get, other, main, back = self.weights.get, 0.0, 0.0, []
        for i, f in enumerate(page_features):
            gain = sum([get(x, 0.0) for x in f])
            if i:
                a, b = other + oo >= main + mo, other + om >= main + mm
                other, main = (other + oo if a else main + mo), (other + om if b else main + mm)
                back.append((not a, not b))
            main += gain
        label, out = main > other, []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return [*([label] if page_features else []), *reversed(out)]


def train(pages: Iterable[tuple[list[list[str]], list[bool]]], steps: int = STEPS, decay: float = DECAY) -> Chain:
    """A chain fitted to the features and labels of pages: penalised likelihood, climbed by Adam."""
    pages = [(f, y) for f, y in pages if f]
    index: dict[str, int] = {}
    rows, cols, at = [], [], 0
    longest = max(len(y) for _, y in pages)
    gold, mask = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for p, (page_features, y) in enumerate(pages):
        gold[p, : len(y)], mask[p, : len(y)] = y, True
        for f in page_features:
            cols += [index.setdefault(x, len(index)) for x in f]
            rows += [at] * len(f)
            at += 1
    rows, cols = np.array(rows), np.array(cols)
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    moments = [np.zeros(len(index) + 4), np.zeros(len(index) + 4)]
    pair_mask = mask[:, 1:]
    gold_pairs = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair_mask).sum() for b in (0, 1)] for a in (0, 1)])
    for k in range(1, steps + 1):
        gain = np.zeros(mask.shape)
        gain[mask] = np.bincount(rows, w[cols], at)
        unary = np.stack([np.zeros(mask.shape), gain], 2)
        forward, backward = np.zeros(unary.shape), np.zeros(unary.shape)
        forward[:, 0] = unary[:, 0]
        for i in range(1, longest):
            step = np.logaddexp(forward[:, i - 1, :1] + t[0], forward[:, i - 1, 1:] + t[1]) + unary[:, i]
            forward[:, i] = np.where(mask[:, i, None], step, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            after = unary[:, i + 1] + backward[:, i + 1]
            step = np.logaddexp(t[:, 0] + after[:, :1], t[:, 1] + after[:, 1:])
            backward[:, i] = np.where(mask[:, i + 1, None], step, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total)
        slope = np.bincount(cols, ((gold - chance)[mask])[rows], len(index)) / len(pages) - decay * w / len(pages)
        pairs = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                both = forward[:, :-1, a] + t[a, b] + unary[:, 1:, b] + backward[:, 1:, b] - total
                pairs[a, b] = np.exp(np.where(pair_mask, both, -np.inf)).sum()
        slope = np.concatenate([slope, ((gold_pairs - pairs) / len(pages) - decay * t / len(pages)).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        move = 0.1 * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-8)
        w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
    return Chain({x: float(w[i]) for x, i in index.items()}, t)


_ASIDE = {
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs links tabs pagination pager",
    "header": "header masthead top banner brand logo topbar",
    "footer": "footer bottom copyright legal colophon imprint",
    "sidebar": "sidebar side aside widget related recommended trending popular rail",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall warning message",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense commercial",
    "form": "form search login signup signin register contact subscribe",
    "comments": "comments comment replies reply discussion disqus responses feedback reader readers",
    "share": "share social sharing tags meta byline author toolbar actions",
}
_MAIN = "content main article post entry story text body page maincontent articlebody single".split()
_CUE_TEXTS = {
    "menu": ["Home", "About", "Contact", "News", "Menu", "Search", "Next", "Previous"],
    "footer": ["© 2021 Example. All rights reserved.", "Privacy · Terms", "Copyright 2020 Example Inc.", "Powered by Example"],
    "notice": ["This site uses cookies.", "Subscribe to our newsletter!", "Please accept our terms.", "You have read 3 of 5 free pages."],
    "ad": ["Sponsored", "Advertisement", "Buy now and save 20%", "Special offer!"],
    "form": ["Log in", "Search", "Your name", "Sign up", "Send"],
    "comments": ["Comments", "Reader comments", "3 comments", "Reply", "Leave a comment"],
    "share": ["Share", "Posted by admin", "Tweet", "By A. Author", "Tags: one, two"],
    "sidebar": ["Related", "Read more", "Most read", "You may also like"],
    "header": ["The Example Times", "Welcome", "Daily News"],
}


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Pages with the texts of their main blocks, drawn from lists of layouts, names and texts."""
    draw = random.Random(seed)
    syllable = "an the on er in re st ti en es ou or la de un mi ka lo für ça ño zu ge".split()

    def word():
        return "".join(draw.choice(syllable) for _ in range(draw.randint(1, 4)))

    def sentence(low=4, high=18):
        return " ".join(word() for _ in range(draw.randint(low, high))).capitalize() + draw.choice([*"......!?", "", "", " |", "##", "%%", "&&", "!!", ":"])

    def paragraph():
        if draw.random() < 0.12:
            return draw.choice(["All rights reserved.", "Licensed under CC BY 4.0.", sentence(1, 2), sentence(1, 3), "Home and search, he replied.", "Comments and cookies are related."])
        return " ".join(sentence() for _ in range(draw.choice([1, 1, 1, 2, 3, 5, 8])))

    def link(text):
        return f'<a href="/{word()}">{text}</a>'

    def named(kind):
        names = _ASIDE[kind].split()
        return draw.choice([f' class="{draw.choice(names)}"', f' id="{draw.choice(names)}"', f' class="{word()} {draw.choice(names)}-{draw.choice(["box", "area", "list", "wrap"])}"', f" class={draw.choice(names)}"])

    def other(kind, inside=False):
        """A stretch of a page that is not main text."""
        cue = lambda: draw.choice(_CUE_TEXTS[kind]) if draw.random() < 0.6 else sentence(1, 6)
        bare = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        tag = bare if bare and draw.random() < 0.6 else draw.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
        attrs = named(kind) if tag != bare or draw.random() < 0.5 else ""
        if kind in ("menu", "share"):
            items = [link(draw.choice(_CUE_TEXTS[kind]) if draw.random() < 0.3 else word()) for _ in range(draw.randint(2, 8))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if draw.random() < 0.7 else " | ".join(items)
        elif kind == "form":
            inner = f'<label>{cue()}</label><input name="q"><select><option>{word()}<option>{word()}</select><button>{cue()}</button>'
        elif kind == "comments":
            inner = f"<h3>{draw.choice(_CUE_TEXTS[kind][:3])}</h3>" * (draw.random() < 0.7)
            inner += "".join(draw.choice([f'<div class="comment"><b>{word()}</b> <p>{paragraph()}</p></div>', f"<p>{paragraph()}</p>", f"<li>{paragraph()} {link('Reply')}</li>"]) for _ in range(draw.randint(1, 5)))
        elif kind == "sidebar":
            inner = f"<h4>{cue()}</h4><ul>" + "".join(f"<li>{link(sentence(2, 6))}</li>" for _ in range(draw.randint(1, 6))) + "</ul>" + f"<p>{paragraph()}</p>" * (draw.random() < 0.4)
        else:
            inner = draw.choice([cue(), f"<p>{cue()}</p>", f"<p>{cue()}</p><p>{sentence()}</p>", f"{cue()} {link(word())}", f"<span>{cue()}</span> &middot; {sentence()}"])
            if kind == "header" and draw.random() < 0.5:
                inner = f"<h1>{cue()}</h1>" if not inside else inner
        return f"<{tag}{attrs}>{inner}</{tag}>"

    pages = []
    for _ in range(n):
        main: list[str] = []

        def text_block(tag):
            text = paragraph() if tag not in ("h1", "h2", "h3") else sentence(2, 9)
            main.append(text)
            style = draw.random()
            shown = html.escape(text) if style < 0.8 else f"<b>{html.escape(text)}</b>" if style < 0.9 else f"{html.escape(text)} {link('')}"
            return f"<{tag}>{shown}" + ("" if tag in ("p", "li") and draw.random() < 0.25 else f"</{tag}>")

        body = [text_block("h1")] if draw.random() < 0.8 else []
        if draw.random() < 0.2:
            body.append(other("share", True))
        for _ in range(draw.choice([1, 2, 4, 6, 10, 15])):
            kind = draw.random()
            if kind < 0.72:
                body.append(text_block("p"))
            elif kind < 0.8:
                body.append(text_block(draw.choice(["h2", "h3"])))
            elif kind < 0.86:
                body.append("<ul>" + "".join(text_block("li") for _ in range(draw.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{text_block('p')}</blockquote>")
            elif kind < 0.93:
                body.append("<table><tr>" + "".join(text_block("td") for _ in range(2)) + "</tr></table>")
            else:
                body.append(other(draw.choice(["ad", "notice", "form", "share", "sidebar"]), True))
        inner = "".join(body)
        if draw.random() < 0.12:
            inner += other(draw.choice(["comments", "share", "footer"]), True)
        frame = draw.random()
        name = draw.choice(_MAIN)
        if frame < 0.5:
            inner = f"<article{draw.choice(['', f' class={name}'])}>{inner}</article>"
            if draw.random() < 0.3:
                inner = f"<main>{inner}</main>"
        elif frame < 0.65:
            inner = f"<main>{inner}</main>"
        elif frame < 0.93:
            inner = f'<div {draw.choice(["id", "class"])}="{name}">{inner}</div>'
        elif frame < 0.97:
            inner = f'<table><tr><td class="{name}">{inner}</td></tr></table>'
        before = [other(k) for k in ("notice", "header", "menu", "ad", "form", "sidebar") if draw.random() < (0.75 if k == "menu" else 0.35)]
        after = [other(k) for k in ("ad", "share", "comments", "sidebar", "form", "notice", "footer") if draw.random() < (0.75 if k == "footer" else 0.3)]
        head = f"<head><title>{sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if draw.random() < 0.8 else ""
        pages.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {word()} -->{inner}{''.join(after)}" + "</body></html>" * (draw.random() < 0.8), main))
    return pages


def labelled_blocks(page: str, main: list[str]) -> tuple[list[list[str]], list[bool]]:
    """Features and labels of a page whose main blocks have these texts, in order."""
    found = blocks(page)
    labels, k = [], 0
    main = [" ".join(x.split()) for x in main]
    for text, above, _ in found:
        hit = k < len(main) and text == main[k] and not any(x.startswith("in=") and x[3:] in ("title", "nav", "footer", "aside", "form") for x in above)
        labels.append(hit)
        k += hit
    return features(found), labels


def trained() -> Chain:
    return train(labelled_blocks(page, main) for page, main in labelled_pages())


def extract_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "", chain.known)
    return "\n".join(b[0] for b, main in zip(found, chain.decode(features(found))) if main)


def extract(pages: DataFrame, chain: Chain | None = None, html_col: str = "html") -> DataFrame:
    """pages with ``text``, the main text, in place of the html."""
    model = pages.sparkSession.sparkContext.broadcast(chain or trained())
    others = [c for c in pages.columns if c not in (html_col, "text")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(x.as_py(), model.value) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*others, "text"])

    rows = pages.select(html_col, *others)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(each, f"{fields}, text string" if fields else "text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


ORACLE_SQL = {}
