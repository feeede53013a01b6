"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between the borders of block elements, with white space turned into single
spaces and character references decoded.  Each block is described by the tags, and the words of the classes, ids and
roles, of its ancestors and by features of its text; the field labels each block as main text or not, with weights for
features, for pairs of neighbouring labels and for the page's first label, and Viterbi finds the best labelling.

The weights are fitted by gradient ascent on the regularised log-likelihood of TRAIN_PAGES labelled pages (a documented
bound).  No table has labels for blocks, so those pages are made: known layouts of invented words, in which every block
is labelled as it is written.  The fitted weights (some hundred numbers) go to the tasks, which parse and decode pages.

Scripts, styles, comments, templates, form controls and the head are no blocks; a quoted attribute that nothing ends takes
the rest of the page, as in browsers.  Text of <noscript> and of elements marked hidden counts like any other.  Defined results: null or empty html, or
a page without main blocks, gives an empty text; unclosed and stray tags are tolerated (an end tag closes what it can; a
tag such as <p> or <li> closes its open sibling); repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, EPOCHS, RATE, PENALTY, SEED = 200, 40, 0.5, 1e-3, 11

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|(?![\"'])))*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|data-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "iframe", "template", "xmp", "noembed", "noframes"}
SKIP = RAW | {"head", "select", "option", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "object", "audio", "video", "canvas", "svg", "g", "text", "tspan"} | {"math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mstyle", "mspace"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_CLOSE_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "html", "nav", "aside", "main", "form", "td", "th", "header", "footer", "blockquote"}


class _Open:
    """The open elements, with counts of their names in the whole page, since the last element that bounds the closing of
    siblings (SCOPE) and since the last block, so that a tag that closes nothing costs no search."""

    def __init__(self):
        # name, (names of all ancestors, the last of them), whether text is skipped, label, the block's label, inside a link
        self.stack: list[tuple] = [("", (frozenset(), ""), False, None, None, False)]
        self.all, self.scopes, self.inline = Counter(), [Counter()], [Counter()]
        self.bounds: list[str] = [""]

    def push(self, entry: tuple) -> None:
        name = entry[0]
        self.stack.append(entry)
        self.all[name] += 1
        if name in SCOPE:
            self.scopes.append(Counter())
            self.bounds.append(name)
        else:
            self.scopes[-1][name] += 1
        if name in INLINE:
            self.inline[-1][name] += 1
        else:
            self.inline.append(Counter())

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.all[name] -= 1
        if name in SCOPE:
            self.scopes.pop()
            self.bounds.pop()
        else:
            self.scopes[-1][name] -= 1
        if name in INLINE:
            self.inline[-1][name] -= 1
        else:
            self.inline.pop()
        return name

    def end(self, name: str) -> None:
        """Close the last element of that name; an end tag of an inline one reaches no further than its block."""
        if (self.inline[-1] if name in INLINE else self.all)[name] > 0:
            while self.pop() != name:
                pass

    def close(self, names: set[str]) -> None:
        """Close the last open sibling of these names, if there is one."""
        if any(self.scopes[-1][x] > 0 for x in names) or self.bounds[-1] in names:
            while self.pop() not in names:
                pass


def leaf_blocks(page: str) -> list[tuple[str, tuple, int, str | None]]:
    """(text, (ancestors' tags and names, the last one), characters inside links, label written on the page) of each leaf block."""
    out: list = []
    open_ = _Open()
    stack = open_.stack
    text: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if text:
            words = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if words:
                out.append((words, stack[-1][1], min(linked, len(words)), stack[-1][4]))
            text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not stack[-1][2]:
            text.append(piece)
            if stack[-1][5]:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE and name not in RAW:
            flush()
        if m[1]:
            open_.end(name)
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        closing = CLOSES.get(name) or ({"p"} if name in BLOCKS_CLOSE_P else None)
        if closing:
            open_.close(closing)
        if name == "body" and open_.all["head"]:
            open_.end("head")
        _, (names, own), skip, label, block_label, link = stack[-1]
        new = [name]
        for key, value in _NAMES.findall(m[3]) if m[3] else ():
            key, value = key.lower(), value.strip("\"'")
            if key == "data-label":
                label = value
            else:
                new += [f".{x}" for x in _PART.findall(value.lower())]
        if name in INLINE:
            open_.push((name, (names, own), skip or name in SKIP, label, block_label, link or name == "a"))
        else:
            open_.push((name, (names if names.issuperset(new) else names.union(new), new[-1]), skip or name in SKIP, label, label, link))
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_features(path: tuple) -> tuple[str, ...]:
    return tuple(sorted(f"in {x}" for x in path[0] if x not in ("html", "body"))) + (f"own {path[1]}",)


def _size(n: int) -> int:
    return 0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3 if n < 60 else 4


def features(blocks: list) -> list[tuple[str, ...]]:
    """The names of the features that hold for each block."""
    out = []
    for text, path, linked, _ in blocks:
        words = text.count(" ") + 1
        end = text[-1]
        out.append((
            "bias", f"words {_size(words)}", f"links {4 * linked // len(text)}", f"end {'.' if end in '.!?:;' else 'letter' if end.isalnum() else 'other'}",
            f"mark {any(c in text for c in '©®|»')}", f"capital {text[0].isupper()}", *_path_features(path),
        ))
    return out


class Field:
    """The weights of a fitted field."""

    def __init__(self, index: dict[str, int], weights, pairs, first):
        self.index, self.weights, self.pairs, self.first = index, weights, pairs, first

    def scores(self, blocks: list):
        import numpy as np

        index, weights = self.index, self.weights
        return np.array([weights[[index[f] for f in fs if f in index]].sum(axis=0) for fs in features(blocks)]).reshape(-1, 2)

    def viterbi(self, blocks: list) -> list[int]:
        """The best labels: 1 is main text."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.pairs.tolist()
        rows = self.scores(blocks).tolist()
        x, y = rows[0][0] + self.first[0], rows[0][1] + self.first[1]
        back = []
        for a, b in rows[1:]:
            u, v = x + aa, y + ba
            w, z = x + ab, y + bb
            back.append((u < v, w < z))
            x, y = max(u, v) + a, max(w, z) + b
        labels = [int(y > x)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def fit(pages: list[str], *, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """A field fitted to pages whose blocks carry data-label="1" for main text."""
    import numpy as np

    chains = [(features(b), np.array([int(x[3] == "1") for x in b])) for b in map(leaf_blocks, pages) if b]
    index: dict[str, int] = {}
    for fs, _ in chains:
        for names in fs:
            for f in names:
                index.setdefault(f, len(index))
    rows = [[np.array([index[f] for f in names]) for names in fs] for fs, _ in chains]
    weights, pairs, first = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full_like(x, 1e-8) for x in (weights, pairs, first)]
    for _ in range(epochs):
        grads = [np.zeros_like(x) for x in (weights, pairs, first)]
        for at, (_, y) in zip(rows, chains, strict=True):
            n = len(y)
            s = np.array([weights[a].sum(axis=0) for a in at])
            s[0] += first
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = s[0]
            for i in range(1, n):
                forward[i] = s[i] + np.logaddexp(forward[i - 1, 0] + pairs[0], forward[i - 1, 1] + pairs[1])
            for i in range(n - 2, -1, -1):
                z = s[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(pairs[:, 0] + z[0], pairs[:, 1] + z[1])
            total = np.logaddexp(*forward[-1])
            node = np.eye(2)[y] - np.exp(forward + backward - total)
            for a, g in zip(at, node, strict=True):
                grads[0][a] += g
            for i in range(1, n):
                grads[1] -= np.exp(forward[i - 1][:, None] + pairs + s[i] + backward[i] - total)
                grads[1][y[i - 1], y[i]] += 1
            grads[2] += node[0]
        for x, g, q in zip((weights, pairs, first), grads, squares, strict=True):
            g = g / len(chains) - penalty * x
            q += g * g
            x += rate * g / np.sqrt(q)
    return Field(index, weights, pairs, first)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Made pages in varied layouts; main text stands in elements with data-label="1"."""
    import random

    r = random.Random(seed)
    parts = ["ba", "re", "ti", "lo", "men", "sa", "du", "ver", "ko", "ni", "tra", "le", "qui", "os", "an", "sch", "ü", "é", "ción"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    noisy = lambda s: re.sub(" ", lambda _: r.choice([" ", "*** ", "%%% ", " | "]), s) if r.random() < 0.1 else s
    prose = lambda: noisy(" ".join(line(2, 25) + r.choice([".", ".", "?", ""]) for _ in range(r.choice([1, 1, 2, 4, 8]))))
    named = lambda tag, *names: f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">' if names and r.random() < 0.9 else f"<{tag}>"

    def menu():
        items = "".join(f'<li><a href="/{word()}">{line(1, 2)}</a></li>' for _ in range(r.randint(3, 9)))
        return r.choice([f"<nav><ul>{items}</ul></nav>", named("div", "menu", "nav", "navbar", "main-menu", "navigation", "breadcrumb", "topnav") + f"<ul>{items}</ul></div>", f'<div role="navigation"><ul>{items}</ul></div>'])

    def advert():
        return r.choice([named("div", "ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement") + f"{line(2, 14)}. {line(1, 6)}.</div>", f'<aside class="ad"><p>{line(3, 12)}.</p></aside>', f'<ins class="ad">{line(3, 9)}</ins>'])

    def side():
        items = "".join(f'<li><a href="/{word()}">{line(2, 6)}</a></li>' for _ in range(r.randint(2, 6)))
        body = r.choice([f"<h3>{line(1, 3)}</h3><ul>{items}</ul>", f"<h4>{line(1, 3)}</h4><p>{line(4, 20)}.</p>", f"<p>{line(5, 30)}.</p><p>{line(5, 30)}.</p>"])
        return r.choice(["<aside>" + body + "</aside>", named("div", "sidebar", "related", "widget", "side", "share", "newsletter", "recommended", "popular", "social", "tags") + body + "</div>"])

    def notice():
        return named("div", "cookie", "cookie-banner", "consent", "notice", "gdpr", "popup", "alert", "modal", "banner") + f"<p>{line(4, 16)}.</p><button>{line(1, 2)}</button></div>"

    def comments():
        each = "".join(r.choice([named("div", "comment", "comment-body", "reply") + f"<p>{prose()}</p></div>", f"<li><b>{word()}</b><p>{prose()}</p></li>"]) for _ in range(r.randint(1, 5)))
        return r.choice([named("section", "comments", "comment-list", "discussion", "responses"), named("div", "comments", "replies", "disqus")]).replace("<", "<", 1) + f"<h3>{line(1, 2)}</h3>{each}</x>"

    def form():
        return f'<form action="/s"><label>{line(1, 3)}</label><input name="q"><p>{line(2, 8)}</p><button>{line(1, 2)}</button></form>'

    def body():
        out = [r.choice([f"<h1>{line(2, 10)}</h1>", f"<h1>{line(2, 10)}</h1><h2>{line(2, 8)}</h2>", ""])]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            out.append(r.choices([f"<p>{prose()}</p>", f"<p><b>{prose()}<br><p>", f"<p>{prose()} <a href='/x'>{line(1, 3)}</a> {line(1, 4)}.", f"<h2>{line(1, 6)}</h2>", f"<ul><li>{line(2, 12)}</li><li>{prose()}</li></ul>", f"<blockquote>{prose()}</blockquote>", f"<pre>{line(3, 20)}</pre>", f"<table><tr><td>{line(1, 4)}</td><td>{line(1, 4)}</td></tr></table>", f"<div>{prose()}</div>", f"<figure><figcaption>{line(3, 10)}</figcaption></figure>"], [9, 3, 2, 2, 2, 1, 1, 1, 1, 0.5])[0])
        if not any(x for x in out):
            out.append(f"<p>{prose()}</p>")
        return out

    def page():
        main = body()
        if r.random() < 0.25:
            main.insert(r.randint(1, len(main)), f'<div data-label="0">{r.choice([advert, side, notice, form])()}</div>')
        main = "".join(main)
        box = r.choice(["<article data-label='1'>{}</article>"] * 4 + ["<main data-label='1'>{}</main>", "<main><article data-label='1'>{}</article></main>", "<div class='content' data-label='1'>{}</div>", "<div id='article-body' class='post' data-label='1'>{}</div>", "<section class='entry story' data-label='1'>{}</section>", "<div role='main' data-label='1'>{}</div>", "<div data-label='1'>{}</div>"]).replace("{}", main)
        before = [f for f, p in ((menu, 0.8), (notice, 0.2), (advert, 0.5), (form, 0.2), (side, 0.15)) if r.random() < p]
        after = [f for f, p in ((side, 0.35), (comments, 0.3), (advert, 0.25), (menu, 0.15), (form, 0.15), (notice, 0.15)) if r.random() < p]
        r.shuffle(after)
        head = r.choice(["", f"<header><h2>{line(1, 3)}</h2><p>{line(2, 9)}</p></header>", named("div", "header", "site-header", "masthead", "logo") + f"{line(1, 5)}</div>"])
        foot = r.choice([f"<footer>&copy; {word()}.example.com &middot; {line(2, 9)}.</footer>"] * 2 + ["", f"<footer><p>{line(3, 20)}.</p><ul><li><a href='/p'>{line(1, 2)}</a></li></ul></footer>", named("div", "footer", "site-footer", "copyright", "legal") + f"{line(3, 15)}.</div>"])
        end = r.choice(["</body></html>", ""])
        return f"<!DOCTYPE html><html><head><title>{line(2, 8)}</title><script>var t=1;</script></head><body>{head}{''.join(f() for f in before)}{box}{''.join(f() for f in after)}{foot}{end}"

    return [page().replace("</x>", "</section></div>") for _ in range(n)]


def extract(pages: DataFrame, *, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    sent = pages.sparkSession.sparkContext.broadcast(field or fit(labelled_pages()))

    def run(frames):
        import pandas as pd

        model = sent.value
        for frame in frames:
            texts = []
            for page in frame["html"]:
                blocks = leaf_blocks(page) if isinstance(page, str) else []
                texts.append("\n".join(b[0] for b, y in zip(blocks, model.viterbi(blocks), strict=True) if y))
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
