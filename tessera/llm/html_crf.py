"""Main-text extraction with a linear-chain conditional random field over the DOM's leaf blocks.

A page becomes its leaf blocks: stretches of text between block-level tags, each with the open elements
above it. Features are the ancestors' tags and the words of their class and id, the block's own tag, and
what its text looks like. The field is trained on labelled pages (``labelled_pages``: layouts made here
from common page furniture, labelled as they are made) and decoded by Viterbi; blocks labelled main make the text.

Defined results: a null or empty html, or a page without main blocks, gives an empty text; unclosed and
misnested tags close at the end of what holds them (an unclosed script, style, textarea or title holds the
rest of the page; of other elements without text only the tag goes); repeated rows are extracted alike; an empty table
gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Comments, marked sections, declarations, tags. In a tag, quotes open a value only after an equals sign, and only if they close.
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*\"|'[^']*')?+|[^<>=])*+)>",
    re.S,
)
_named = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_name_word = re.compile(r"[a-z]+")
# Fixed values of HTML: elements whose content is no text, elements inside a line, elements without content.
RAW = frozenset("script style template noscript title textarea svg math iframe object select option head".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Of the first, the ones that hold the rest of a page when they aren't closed.
TO_END = frozenset("script style textarea title".split())
#: An attribute value without quotes that ends in a slash, which isn't the tag's own.
_bare_end = re.compile(r"=\s*[^\s\"'=]+/\Z")
_raw_end = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: A start tag that ends an open element of the named kinds.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block:
    """A leaf block: its text, the open elements above it, and how much of the text is in links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; white space inside a block is one space."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    held: list[str] = []
    endless: set[str] = set()  # names without an end tag in what is left
    linked = in_link = 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                found.append(Block(text, tuple(stack), linked))
            held.clear()
        linked = 0

    at, end = 0, len(page)
    match = _token.search(page)
    while match is not None:
        if match.start() > at:
            part = page[at : match.start()]
            held.append(part)
            if in_link:
                linked += len(part)
        at = match.end()
        name = match[3]
        if match[1]:
            held.append(match[1])
        elif name:
            name = name.lower()
            closing = bool(match[2])
            if name in RAW and not closing:
                # A self-closing tag is empty; of those without an end tag, only raw texts take the rest of the page.
                if name != "head" and (not match[4].endswith("/") or _bare_end.search(match[4])):
                    stop = None if name in endless else _raw_end[name].search(page, at)
                    if stop:
                        at = stop.end()
                    elif name in TO_END:
                        at = end
                    else:
                        endless.add(name)
            elif name == "a":
                in_link = 0 if closing else 1
            elif name in INLINE:
                pass
            elif name in VOID:
                if name in ("br", "hr"):
                    held.append(" ")
                    if name == "hr":
                        flush()
            elif closing:
                flush()
                in_link = 0
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                flush()
                ends = CLOSES.get(name)
                if ends:
                    while stack and stack[-1][0] in ends:
                        stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                words = frozenset(w for m in _named.finditer(match[4]) for w in _name_word.findall((m[2] or m[3] or m[4] or "").lower())) if match[4] else frozenset()
                stack.append((name, words))
        match = _token.search(page, at)
    if at < end:
        held.append(page[at:])
    flush()
    return found


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold, for each block."""
    n, out = len(page), []
    for i, b in enumerate(page):
        own = b.path[-1][0] if b.path else "none"
        f = ["bias", f"own={own}"]
        for depth, (tag, words) in enumerate(reversed(b.path)):
            f.append(f"in={tag}")
            f += [f"named={w}" for w in words]
            if depth == 1:
                f.append(f"parent={tag}")
        f = list(dict.fromkeys(f))
        size = len(b.text)
        f.append(f"length={min(8, int(np.log2(size + 1)) if size else 0)}")
        f.append(f"links={int(4 * min(1.0, b.linked / max(1, size)))}")
        f.append("stop" if b.text[-1] in ".!?…»”\"'。" else "nostop")
        if "©" in b.text or "\xae" in b.text:
            f.append("copyright")
        f.append(f"place={int(4 * i / n)}")
        out.append(f)
    return out


class Field:
    """Weights of a two-label chain: feature -> (boilerplate, main), and label transitions."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]], start: list[float]):
        self.weights, self.moves, self.start = weights, moves, start

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves
        back = []
        s0 = s1 = 0.0
        for i, names in enumerate(features(page)):
            e0 = e1 = 0.0
            for name in names:
                w = get(name, none)
                e0 += w[0]
                e1 += w[1]
            if i == 0:
                s0, s1 = self.start[0] + e0, self.start[1] + e1
            else:
                a0, a1, b0, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
                back.append((0 if a0 >= a1 else 1, 0 if b0 > b1 else 1))
                s0, s1 = max(a0, a1) + e0, max(b0, b1) + e1
        label = 0 if s0 >= s1 else 1
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[str, list[str]]], rounds: int = 150, penalty: float = 0.02) -> Field:
    """Fit the field to labelled pages (html, main blocks' texts in order) by gradient ascent on the likelihood."""
    made = []
    for page, main in pages:
        bs, want = blocks(page), list(main)
        labels = []
        for b in bs:
            hit = bool(want) and b.text == want[0]
            labels.append(int(hit))
            if hit:
                want.pop(0)
        if bs and not want:
            made.append((features(bs), labels))
    names = sorted({f for fs, _ in made for block in fs for f in block})
    index = {f: i for i, f in enumerate(names)}
    long = max(len(y) for _, y in made)
    x = np.zeros((len(made), long, len(names)), np.float32)
    y = np.zeros((len(made), long), np.int64)
    real = np.zeros((len(made), long), bool)
    for p, (fs, labels) in enumerate(made):
        for t, block in enumerate(fs):
            x[p, t, [index[f] for f in block]] = 1
        y[p, : len(labels)], real[p, : len(labels)] = labels, True
    flat = x.reshape(-1, len(names))
    w, m, s = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    gold = np.eye(2)[y] * real[..., None]
    gold_w = flat.T @ gold.reshape(-1, 2)
    pair = real[:, 1:]
    gold_m = np.einsum("pti,ptj->ij", gold[:, :-1] * pair[..., None], gold[:, 1:])
    gold_s = gold[:, 0].sum(0)
    size = [np.zeros_like(w), np.zeros_like(m), np.zeros_like(s)]
    for _ in range(rounds):
        e = (flat @ w).reshape(len(made), long, 2)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = s + e[:, 0]
        for t in range(1, long):
            go = np.logaddexp.reduce(a[:, t - 1, :, None] + m, axis=1) + e[:, t]
            a[:, t] = np.where(real[:, t, None], go, a[:, t - 1])
        total = np.logaddexp.reduce(a[:, -1], axis=1)
        for t in range(long - 2, -1, -1):
            go = np.logaddexp.reduce(m + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(real[:, t + 1, None], go, 0)
        post = np.exp(a + b - total[:, None, None]) * real[..., None]
        joint = np.exp(a[:, :-1, :, None] + m + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair[..., None, None]
        grads = [gold_w - flat.T @ post.reshape(-1, 2) - penalty * w, gold_m - joint.sum((0, 1)) - penalty * m, gold_s - post[:, 0].sum(0) - penalty * s]
        for v, g, k in zip((w, m, s), grads, range(3), strict=True):  # steps scaled by each weight's own history
            size[k] += g * g
            v += 0.5 * g / np.sqrt(size[k] + 1e-8)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, m.tolist(), s.tolist())


# Words common in the class and id names of page furniture and of main text.
FURNITURE = {
    "nav": "menu nav navigation navbar breadcrumb topnav", "header": "header masthead banner topbar logo", "footer": "footer copyright bottom legal",
    "aside": "sidebar side related widget rail", "notice": "cookie notice consent banner alert gdpr", "ad": "ad ads advert advertisement sponsor sponsored promo",
    "form": "form search newsletter subscribe login signup", "comments": "comments comment discussion replies disqus respond", "share": "share social sharing tools",
}
MAIN_NAMES = "content article post entry main body story text page".split()


def labelled_pages(count: int = 250, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with furniture of many kinds around, between and inside the article, and the article's blocks."""
    rnd = random.Random(seed)
    letters = "bcdfglmnprstv"
    word = lambda: "".join(rnd.choice(letters) + rnd.choice("aeiouéä") for _ in range(rnd.randint(1, 4)))

    def sentence(a, b):
        ws = [word() for _ in range(rnd.randint(a, b))]
        return " ".join(ws).capitalize() + rnd.choice(["."] * 6 + ["!", "?", "", "..."])

    def prose():
        return " ".join(sentence(3, 16) for _ in range(rnd.choice([1, 1, 2, 3, 5, 9])))

    def attr(kind):
        names = FURNITURE[kind].split()
        how = rnd.random()
        return f' class="{rnd.choice(names)}"' if how < 0.6 else f' id="{rnd.choice(names)}-{rnd.randint(1, 9)}"' if how < 0.8 else ""

    def links(tag="li"):
        return "".join(f'<{tag}><a href="/{word()}">{" ".join(word() for _ in range(rnd.randint(1, 3)))}</a></{tag}>' for _ in range(rnd.randint(2, 7)))

    def named(kind, tag, inner):
        a = attr(kind)
        tag = "div" if rnd.random() < 0.4 and a else tag
        return f"<{tag}{a}>{inner}</{tag}>"

    def furniture(kind):
        if kind == "nav":
            return named(kind, "nav", f"<ul>{links()}</ul>" if rnd.random() < 0.8 else links("span"))
        if kind == "header":
            return named(kind, "header", f"<h1>{sentence(1, 4)}</h1>" if rnd.random() < 0.4 else f"<p>{sentence(1, 6)}</p>{links('span')}")
        if kind == "footer":
            return named(kind, "footer", rnd.choice(["&copy; ", "", "\xa9 2020 "]) + f"{word()}.example &middot; {sentence(2, 9)}")
        if kind == "aside":
            return named(kind, "aside", f"<h3>{sentence(1, 4)}</h3>" + rnd.choice([f"<ul>{links()}</ul>", f"<p>{prose()}</p>"]))
        if kind == "form":
            return named(kind, "form", f"<label>{sentence(1, 4)}</label><input name='q'><button>{word()}</button><p>{sentence(3, 9)}</p>")
        if kind == "comments":
            each = "".join(f"<div class='comment'><b>{word()}</b><p>{prose()}</p></div>" if rnd.random() < 0.6 else f"<li><p>{prose()}</p></li>" for _ in range(rnd.randint(1, 5)))
            return named(kind, "section", f"<h2>{sentence(1, 3)}</h2>{each}") if rnd.random() < 0.7 else f'<ol class="commentlist comments">{each}</ol>'
        if kind == "share":
            return f'<div class="{rnd.choice(FURNITURE[kind].split())}">{links("span")}</div>'
        names = FURNITURE[kind].split()
        return f'<div class="{rnd.choice(names)}">{rnd.choice(["", "<p>"])}{prose()}</div>'

    made = []
    for i in range(count):
        main: list[str] = []

        def say(text, main=main):
            main.append(" ".join(text.split()))
            return text.replace(" ", rnd.choice([" ", " ", "\n"]), 1)

        title = sentence(3, 12)
        body = [f"<h1>{say(title)}</h1>"] if rnd.random() < 0.85 else []
        for _ in range(rnd.randint(1, 12)):
            how = rnd.random()
            if how < 0.72:
                body.append(f"<p>{rnd.choice(['', '<b>', '<em>'])}{say(prose())}" + rnd.choice(["</p>", "</p>", "<br>", ""]))
            elif how < 0.8:
                body.append(f"<h2>{say(sentence(2, 7))}</h2>")
            elif how < 0.87:
                body.append("<ul>" + "".join(f"<li>{say(sentence(3, 12))}</li>" for _ in range(rnd.randint(2, 4))) + "</ul>")
            elif how < 0.91:
                body.append(f"<blockquote>{say(prose())}</blockquote>")
            elif how < 0.94:
                body.append("<table><tr>" + "".join(f"<td>{say(word() + ' ' + word())}</td>" for _ in range(2)) + "</tr></table>")
            else:
                body.append(furniture(rnd.choice(["ad", "aside", "share", "form", "notice", "nav"])))
        if rnd.random() < 0.3:
            body.append(furniture(rnd.choice(["comments", "share", "aside"])))
        shell = rnd.random()
        name = rnd.choice(MAIN_NAMES)
        inner = "".join(body)
        article = f"<article>{inner}</article>" if shell < 0.55 else f"<main>{inner}</main>" if shell < 0.7 else f'<div class="{name}">{inner}</div>' if shell < 0.85 else f'<main><article class="{name}">{inner}</article></main>'
        top = [furniture(k) for k in rnd.sample(["nav", "header", "notice", "ad", "form", "aside"], rnd.randint(1, 4))]
        low = [furniture(k) for k in rnd.sample(["aside", "ad", "comments", "nav", "share", "notice", "form"], rnd.randint(0, 3))] + ([furniture("footer")] if rnd.random() < 0.9 else [])
        made.append((f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(top)}<!-- x -->{article}{''.join(low)}</body></html>", main))
    return made


def extract(page: str, field: Field) -> str:
    """The main text of a page."""
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, field.decode(found), strict=True) if label)


_trained: list[Field] = []


def default_field() -> Field:
    """The field trained on ``labelled_pages()``, once per process."""
    if not _trained:
        _trained.append(train(labelled_pages()))
    return _trained[0]


def _run(ref):
    def run(batches):
        field = ref.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                found = [extract(p, field) for p in texts(some.column(2))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def report(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ref = pages.sparkSession.sparkContext.broadcast(field or default_field())  # a few hundred weights
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_run(ref), "page_id bigint, url string, text string, n_chars bigint")
