"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is a vector: its tag path (tags,
classes and ids of all open block-level elements, hashed; names that training has not seen count as one), its words (hashed) and a few numbers (length, share of link
words, place, and how much of the page's text stands in the elements around it). A bidirectional LSTM in numpy reads the sequence of a page's blocks and labels each with the whole page
in view. It is trained in one task, on pages made from a seed whose parts are known, and sent to the tasks (its size
is fixed: under 200 kB). Those pages have known names, names that say nothing, or none, and layouts of articles, plain boxes, grids and
tables, so that the network also goes by where the page's text is.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm.shared import map_rows

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul "
    "noscript template object canvas audio video".split()
)
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Elements whose content is not text of the page, and holds no tags: without an end tag, it goes to the end of the page.
RAW = "script|style|title|textarea|iframe"
#: Of the block-level tags, those that may stand in a paragraph.
_WITHIN_P = {"noscript", "template", "object", "canvas", "audio", "video"}
#: A start tag of one of these ends an open one of the same group.
_SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = BLOCK_TAGS - _WITHIN_P - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z]+")

PATH, WORDS, NUMBERS = 96, 32, 17
AROUND = 4  # elements around a block whose text is counted
SIZE = PATH + WORDS + NUMBERS
HIDDEN = 16
PAGES, EPOCHS, BATCH = 1200, 8, 16
BATCH_BLOCKS = 40_000  # of one run of the network; a longer page is a run of its own



class Path:
    """The open block-level elements: those above, the names of the innermost, and the sums of all names' hashed vectors."""

    __slots__ = ("above", "names", "sums")

    def __init__(self, above: Path | None, names: tuple[str, ...]):
        self.above, self.names = above, names
        self.sums = above.sums.copy() if above else np.zeros(PATH, dtype=np.float32)
        for name in names:
            at, sign = _paths[name]
            self.sums[at] += sign

    def last(self, n: int) -> list[str]:
        """The n innermost names, or all there are."""
        out: list[str] = []
        path: Path | None = self
        while path and len(out) < n:
            out = [*path.names, *out]
            path = path.above
        return out[-n:]


def _marks(attributes: str) -> list[str]:
    """The names that an element's attributes give it; those that say nothing to the network are one, `~`."""
    found = dict.fromkeys(f"{a.lower()}:{part}" for a, *v in _NAMES.findall(attributes) for part in _PARTS.split("".join(v).lower()) if part)
    told = [x for x in found if x in _telling()]
    return [*told, "~"] if len(told) < len(found) else told


@lru_cache(maxsize=1)
def _telling() -> frozenset[str]:
    """The names that pages to learn from have: all that training can give a meaning."""
    made = [*(part for parts in _MAIN for part in parts), *(part for parts in _REST.values() for part in parts)]
    return frozenset(f"{a.lower()}:{x}" for part in made for a, *v in _NAMES.findall(part) for x in _PARTS.split("".join(v).lower()) if x)


Block = tuple[Path, str, int, int]  # path, text, words, words in links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: references decoded, white space runs as one space, trimmed, none empty."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    root = Path(None, ())
    still_open: Counter[str] = Counter()
    texts: list[str] = []
    links = linked = 0
    unclosed = False  # a comment or script that the page ends in

    def flush() -> None:
        nonlocal linked
        if texts:
            words = "".join(texts).split()
            if words:
                out.append((stack[-1][1] if stack else root, " ".join(words), len(words), min(linked, len(words))))
            texts.clear()
        linked = 0

    def cut(i: int) -> None:
        for tag, _ in stack[i:]:
            still_open[tag] -= 1
        del stack[i:]

    def close(tag: str) -> None:
        if still_open[tag]:
            cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))

    def text(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece)
        texts.append(piece)
        if links:
            linked += len(piece.split())

    at, tail = 0, page.rfind(">") + 1  # without a `>`, what follows holds no tag
    for m in _TOKEN.finditer(page, 0, tail):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag, ends, names = (m[3] or m[6] or "").lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "a":
            links = max(0, links - 1) if ends else 1
        elif tag == "br":
            texts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if ends:
                close(tag)
                continue
            if tag in _ENDS_P and stack and stack[-1][0] == "p":
                cut(len(stack) - 1)
            group = _SELF_CLOSING.get(tag, ())
            for i in range(len(stack) - 1, -1, -1) if any(still_open[g] for g in group) else ():
                if stack[i][0] in group:
                    cut(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div", "article", "section"):
                    break
            if tag not in VOID:
                marks = _marks(names) if "=" in names else []
                stack.append((tag, Path(stack[-1][1] if stack else root, (tag, *marks))))
                still_open[tag] += 1
        elif not tag and m[1]:
            texts.append(" ")
            unclosed = at == tail and not re.search(r"</[a-z]+\s*>\Z", m[0], re.I)
        elif not tag and at == tail:
            unclosed = m[0].startswith("<!--") and not m[0].endswith("-->")
    if at < len(page) and not unclosed:
        text(page[at:].partition("<!--")[0])
    flush()
    return out


class _Hashed(dict):
    """Token to its place among `size`, and its sign."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(token)
        self[token] = value = (h % self.size, 1.0 if h >> 40 & 1 else -1.0)
        return value


_paths, _words = _Hashed(PATH), _Hashed(WORDS)


def _around(path: Path) -> Iterator[Path]:
    """The element that a block stands in and those around it, AROUND of them at most."""
    at: Path | None = path
    for _ in range(AROUND):
        if at is None or at.above is None:  # all of the page
            return
        yield at
        at = at.above


def vectors(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), SIZE), dtype=np.float32)
    plain: dict[Path, int] = {}  # words outside of links, by element
    every: dict[Path, int] = {}
    for path, _, n, linked in found:
        for p in _around(path):
            plain[p] = plain.get(p, 0) + n - linked
            every[p] = every.get(p, 0) + n
    whole = max(1, sum(n - linked for _, _, n, linked in found))
    for i, (path, text, n, linked) in enumerate(found):
        out[i, :PATH] = path.sums
        for name in path.last(2):  # the innermost names once more, as such
            at, sign = _paths["<" + name]
            out[i, at] += sign
        places = [_words[w] for w in text.lower().split()]
        scale = 1 / np.sqrt(n)
        np.add.at(out[i], [PATH + p for p, _ in places], [s * scale for _, s in places])
        around = list(_around(path))
        shares = [plain[p] / whole for p in around] + [0.0] * (AROUND - len(around))
        links = [1 - plain[p] / every[p] for p in around] + [0.0] * (AROUND - len(around))
        same = float(i > 0 and found[i - 1][0].above is path.above)
        out[i, PATH + WORDS :] = (np.log1p(n) / 4, linked / n, i / len(found), 1 / (1 + i), 1 / (len(found) - i), text[-1] in ".!?", text.count(",") / n, 1.0, *shares, *links, same)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """A bidirectional LSTM with one output for each step. Arrays are time x page x size; a mask marks the steps that count."""

    def __init__(self, size: int = SIZE, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"v": rng.normal(0, 0.3, 2 * hidden), "c": np.zeros(1)}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * hidden))
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p["z" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        steps, pages, n = *x.shape[:2], self.hidden
        inputs = x.reshape(-1, x.shape[2]) @ self.p["w" + d] + self.p["z" + d]
        inputs = inputs.reshape(steps, pages, 4 * n)
        h, c = np.zeros((pages, n), x.dtype), np.zeros((pages, n), x.dtype)
        out, kept = np.zeros((steps, pages, n), x.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = inputs[t] + h @ self.p["u" + d]
            ifo, g = _sigmoid(gates[:, : 3 * n]), np.tanh(gates[:, 3 * n :])
            i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tanh))
            c, h = m * new + (1 - m) * c, m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], axis=2) @ self.p["v"] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the steps that count, and its gradients by back-propagation through time."""
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        z = states @ self.p["v"] + self.p["c"]
        n, total = self.hidden, mask.sum()
        loss = float((mask * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))).sum() / total)
        dz = mask * (_sigmoid(z) - y) / total
        grads = {"v": np.tensordot(dz, states, 2), "c": dz.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            dout = dz[..., None] * self.p["v"][k * n : (k + 1) * n]
            dh = np.zeros(dout.shape[1:], x.dtype)
            dc, du = np.zeros_like(dh), np.zeros_like(self.p["u" + d])
            dgates = np.zeros((*x.shape[:2], 4 * n), x.dtype)
            for t, h, c, i, f, o, g, tanh in reversed(runs[d][1]):
                m = mask[t][:, None]
                dh = dh + dout[t]
                dnew = m * (dc + dh * o * (1 - tanh * tanh))
                dg = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * tanh * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                dgates[t] = dg
                du += h.T @ dg
                dh, dc = (1 - m) * dh + dg @ self.p["u" + d].T, (1 - m) * dc + dnew * f
            flat = dgates.reshape(-1, 4 * n)
            grads |= {"w" + d: x.reshape(-1, x.shape[2]).T @ flat, "u" + d: du, "z" + d: flat.sum(0)}
        return loss, grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


# ---- pages to learn from

_MAIN = (
    ["article"], ["article"], ["main"], ["main", "article"], ["div class='content'"], ["div id='content'"], ["div class='post-body'"], ["section class='article-text'"],
    ["div class='entry-content'"], ["div class='story'"], ["div itemprop='articleBody'"], ["div id='main'", "div class='text'"], ["div class='page'", "article class='post'"], [],
)
_REST = {
    "menu": ("nav", "ul class='menu'", "div class='nav-links'", "div id='menu'", "div class='breadcrumb'", "nav class='main-nav'"),
    "header": ("header", "div class='header'", "div id='masthead'", "div class='site-header'", "header class='top'"),
    "footer": ("footer", "div class='footer'", "div id='footer'", "div class='copyright'", "footer class='site-footer'"),
    "sidebar": ("aside", "div class='sidebar'", "div id='sidebar'", "aside class='widget'", "div class='related'", "section class='recommended'"),
    "notice": ("div class='cookie-notice'", "div class='notice'", "div class='alert'", "div id='consent'", "div class='banner'", "div role='alert'", "div class='cookie'"),
    "advert": ("div class='ad'", "div class='ads'", "div class='advert'", "div class='sponsored'", "div class='promo'", "div id='ad'", "aside class='ad'"),
    "form": ("form", "form class='search'", "div class='newsletter'", "div class='subscribe'", "div class='login'"),
    "comments": ("section class='comments'", "div class='comment'", "ol class='comment-list'", "div id='comments'", "div class='responses'"),
    "share": ("div class='share'", "ul class='social'"),
}
_PHRASES = {
    "menu": "home about contact news products blog archive help",
    "header": "welcome site sign in search",
    "footer": "&copy; all rights reserved privacy terms imprint &middot;",
    "sidebar": "related popular read more latest tags",
    "notice": "we use cookies accept this site notice",
    "advert": "advertisement sponsored buy now offer",
    "form": "search email subscribe name password send",
    "comments": "reply says comment posted great thanks",
    "share": "share tweet print follow",
}


#: Wrappers of articles that don't say so; `~` stands for a word of the page's own.
_PLAIN = (
    ["div"], ["div", "div"], ["div class='~'"], ["div id='~'", "div class='~ ~'"], ["section class='~'"], ["div class='wrapper'", "div class='~'", "div"], ["table", "tr", "td"], ["table class='layout'", "tr", "td class='~'"],
)
_PLAIN_REST = {
    "menu": ("nav", "div", "div class='~'", "ul", "ul class='~'"), "header": ("header", "div class='~'"), "footer": ("footer", "div class='~'", "div id='foot'"), "sidebar": ("aside", "div", "div class='~'"),
    "notice": ("div class='~'", "div role='dialog'"), "advert": ("div class='~'", "aside"), "form": ("form", "form class='~'"), "comments": ("section", "div class='~'", "ol"), "share": ("div class='~'", "ul"),
}


def made_page(rng: np.random.Generator, named: float = 0.55) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks. named: the share of pages whose parts have names that tell what they are."""
    syllables = ["".join(rng.choice(list("abcdefghiklmnoprstuvwzäéñ"), rng.integers(1, 4))) for _ in range(30)]
    pick = lambda of: of[int(rng.integers(len(of)))]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    noise = ["", "", "", "***", "%%%", "&amp;&amp;"] if rng.random() < 0.15 else [""]
    tells = rng.random() < named
    own = [re.sub("[^a-z]", "x", word()) for _ in range(6)]

    def sentence(n: int) -> str:
        words = [word() + pick(noise) + ("," if rng.random() < 0.08 else "") for _ in range(n)]
        return " ".join([words[0].capitalize(), *words[1:]]) + pick(["."] * 6 + ["!", "?", ""])

    def wrap(parts: list[str], inner: str) -> str:
        for p in reversed(parts):
            inner = f"<{re.sub('~', lambda _: pick(own), p)}>{inner}</{p.split()[0]}>"
        return inner

    texts: list[str] = []

    def paragraph() -> str:
        body = " ".join(sentence(int(rng.choice([1, 2, 6, 14, 25]))) for _ in range(rng.choice([1, 1, 2, 4])))
        texts.append(body)
        tag, r = pick(["p"] * 12 + ["li", "blockquote", "h2", "h3", "div"]), rng.random()
        if tag == "p" and r < 0.12:
            return f"<p><b>{body}<br>"
        if r < 0.2:
            first, _, rest = body.partition(" ")
            body = f"<a href='/x'>{first}</a> <i>{rest}</i>"
        return wrap(["ul", "li"], body) if tag == "li" else f"<{tag}>{body}</{tag}>" if tag != "p" or r < 0.85 else f"<p>{body}"

    def piece() -> str:
        """A table, code, caption, list or definitions: short blocks of the article."""
        short = lambda: pick([word(), str(rng.integers(1, 9999)), f"{rng.integers(1, 99)}.{rng.integers(10)}", f"{word()} {word()}", sentence(3)])
        n = int(rng.integers(2, 5))
        kind = pick(["table", "table", "pre", "figure", "ul", "dl"])
        if kind == "table":
            rows = [[short() for _ in range(n)] for _ in range(rng.integers(1, 4))]
            texts.extend(c for row in rows for c in row)
            return "<table>" + "".join("<tr>" + "".join(f"<{'th' if i == 0 and n == 3 else 'td'}>{c}</{'th' if i == 0 and n == 3 else 'td'}>" for c in row) + "</tr>" for i, row in enumerate(rows)) + "</table>"
        held = [short() for _ in range(n)]
        if kind == "pre":
            texts.append("; ".join(f"{h} = {i}" for i, h in enumerate(held)))
            return f"<pre><code>{texts[-1]}</code></pre>"
        if kind == "figure":
            texts.append(sentence(5))
            return f"<figure><img src='x.png'><figcaption>{texts[-1]}</figcaption></figure>"
        texts.extend(held)
        return "<dl>" + "".join(f"<{'dd' if i % 2 else 'dt'}>{h}</{'dd' if i % 2 else 'dt'}>" for i, h in enumerate(held)) + "</dl>" if kind == "dl" else "<ul>" + "".join(f"<li>{h}</li>" for h in held) + "</ul>"

    def rest(kind: str, inside: bool = False) -> str:
        outer = pick(_REST[kind] if tells or inside else _PLAIN_REST[kind])
        if kind == "menu" or (kind in ("sidebar", "footer", "share") and rng.random() < 0.4):
            items = "".join(f"<li><a href='/{i}'>{word() if rng.random() < 0.7 else pick(_PHRASES[kind].split())}</a></li>" for i in range(rng.integers(1, 9)))
            return wrap([outer], items if rng.random() < 0.2 or outer.startswith("ul") else f"<ul>{items}</ul>")
        if kind == "sidebar" and not inside and rng.random() < 0.6:  # a heading and links to other pages
            head = f"<{pick(['h3', 'h4', 'div', 'p'])}>{pick(_PHRASES[kind].split()).capitalize() if rng.random() < 0.7 else sentence(2)}"
            links = "".join(f"<li><a href='/{i}'>{sentence(int(rng.integers(2, 7)))}</a></li>" for i in range(rng.integers(1, 6)))
            return wrap([outer], f"{head}</{head[1 : head.index('>')]}><ul>{links}</ul>")
        inner = []
        for _ in range(1 if inside else rng.integers(1, 4)):
            s = " ".join(sentence(int(rng.integers(2, 15 if tells else 9))) for _ in range(rng.integers(1, 4 if tells else 2)))
            s = pick(["Sign up today", "Subscribe now", "Advertisement", "Buy now", "Read more"]) if inside and rng.random() < 0.4 else f"{pick(_PHRASES[kind].split())} {s}" if rng.random() < (0.5 if tells else 0.9) else s
            inner.append(pick([f"<p>{s}</p>", s + "<br>", f"<div>{s}</div>", f"<h3>{s}</h3>", f"<label>{s}</label><input name='q'>"]) if len(inner) or rng.random() < 0.4 else s)
        return wrap([outer], "".join(inner))

    title = sentence(int(rng.integers(2, 9)))
    article = []
    if rng.random() < 0.85:
        texts.append(title)
        article.append(f"<h1>{title}</h1>")
    for _ in range(int(rng.choice([1, 2, 4, 8, 16] if tells else [2, 4, 8, 16]))):
        article.append(piece() if rng.random() < 0.08 else paragraph())
        if rng.random() < 0.06:
            article.append(rest(pick(["advert", "sidebar", "share", "form", "notice"]), inside=True))
    main = pick(_MAIN) if tells else pick(_PLAIN)
    if not tells and len(texts) < 3:
        main = pick([["article"], ["main"]])  # so little text must be named
    before = [rest(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.4]
    after = [rest(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.35]
    if rng.random() < 0.5:
        after.append(rest("footer"))
    inner = wrap(main, "".join(article))
    if not tells and rng.random() < 0.4:  # the page is a table or grid, a cell for each part
        cells = [rest(pick(["menu", "sidebar"])) if rng.random() < 0.5 else "", "".join(article), rest(pick(["sidebar", "advert", "form"])) if rng.random() < 0.7 else ""]
        row, cell = pick([("<table><tr>", "td"), (f"<div class='{pick(own)}'><div class='{pick(own)}'>", f"div class='{pick(own)}'"), ("<div><div>", "div")])
        inner = row + "".join(f"<{cell}>{c}</{cell.split()[0]}>" for c in cells if c) + ("</tr></table>" if "tr" in row else "</div></div>")
    body = "".join(before) + inner + "".join(after)
    if not tells:  # boxes around all of it, and around some parts
        deep = lambda x, n: wrap([pick(["div", "div class='~'", "div class='~ ~'", "div id='~'"]) for _ in range(n)], x)
        k = int(rng.integers(0, 3))
        parts = [*before, inner, *after]
        body = deep("".join(deep(x, int(rng.integers(0, k + 1))) for x in parts), int(rng.integers(0, 4)))
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}"
    return page + ("</body></html>" if rng.random() < 0.9 else ""), [" ".join(html.unescape(t).split()) for t in texts]


def labelled(page: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the page's blocks, and 1 for those that are its article's, matched in order."""
    found, y, k = blocks(page), [], 0
    for b in found:
        y.append(float(k < len(texts) and b[1] == texts[k]))
        k += int(y[-1])
    if k < len(texts):
        raise ValueError("the article's blocks are not all there")
    return vectors(found), np.array(y, dtype=np.float32)


@lru_cache(maxsize=4)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """The network after training with Adam on made pages; the same for the same parameters."""
    rng, net = np.random.default_rng(seed), Network()
    data = [labelled(*made_page(rng)) for _ in range(pages)]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(pages), key=lambda i: len(data[i][1]) // 8)
        batches = [order[i : i + BATCH] for i in range(0, pages, BATCH)]
        for b in rng.permutation(len(batches)):
            x, mask = padded([data[i][0] for i in batches[b]])
            y = padded([data[i][1][:, None] for i in batches[b]])[0][..., 0]
            _, grads = net.gradients(x, mask, y)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = 0.01 * (1 - epoch / epochs) * min(1.0, 5 / (norm + 1e-9))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] -= (rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6) + 2e-5 * net.p[k])).astype(np.float32)
    return net


_trained: dict[tuple, Network] = {}


def trained_in_task(spark: SparkSession) -> Network:
    """The network, trained in a task of its own, where numpy has one thread: many make these small products slower. Once a driver."""
    known = (PAGES, EPOCHS)
    if known not in _trained:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained().p)])], names=["weights"])

        net = Network()
        net.p = pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(work, "weights binary").first()[0])
        _trained[known] = net
    return _trained[known]


def main_texts(pages: list[str], net: Network) -> Iterator[list[str]]:
    """The blocks of each page's main text."""
    found = [blocks(p) for p in pages]
    kept: list[list[str]] = [[] for _ in pages]
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and len(found[order[at + n]]) * (n + 1) <= BATCH_BLOCKS:
            n += 1
        run = order[at : at + n]
        x, mask = padded([vectors(found[i]) for i in run])
        z = net.logits(x, mask)
        for k, i in enumerate(run):
            kept[i] = [b[1] for b, score in zip(found[i], z[:, k], strict=False) if score > 0]
        at += n
    yield from kept


def extract(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    text is the main text's blocks joined by two line ends, empty if there are none. A null or empty html has an empty
    text; a very long page is one run of the network, in linear time. Null page_ids and urls stay null, repeated rows are read each, an empty table gives an empty result, and
    further columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(net or trained_in_task(pages.sparkSession))

    def work(rows: pa.RecordBatch) -> dict:
        texts = ["\n\n".join(b) for b in main_texts([h or "" for h in rows.column("html").to_pylist()], sent.value)]
        return {"page_id": rows.column("page_id"), "url": rows.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_rows(rows, "html", "page_id long, url string, text string, n_chars long", work)
