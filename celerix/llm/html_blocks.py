"""Main-text extraction by a recurrent block labeller.

A page becomes its leaf sequence: runs of text between block-level tags, each with the path of open tags (their class
and id words included) and its words. A bidirectional LSTM in numpy reads the whole sequence, path and words as hashed
vectors, and labels every block with the document around it in view. It is trained here, on pages that a generator
writes from common templates, whose labels are known as they are written; no row of any table is needed.

A block's path is its PATH_WORDS innermost names. Defined cases: null, empty and text-less html give the empty text;
markup that never closes is read to its end, in time in proportion to the page; pages
that repeat give equal texts; a null page_id or url stays null; empty tables give empty results; other columns are
ignored; any number of blocks is read.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celerix.llm.common import bounded, pieces

PATH, WORDS, DENSE, HIDDEN = 64, 24, 6, 20
INPUT = PATH + WORDS + DENSE
WRITTEN, PAGES, STEPS, SEED = 1600, 48, 280, 6  # pages written for training, pages a step, steps, seed

#: Tags that stand inside a block; tags whose content is no text; tags without content; tags that end an open p.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = "script style noscript template svg math iframe object canvas audio video head title textarea select".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TO_THE_END = {"script", "style", "textarea", "title"}  # of the silent tags, those that run to the page's end where nothing closes them
EMPTY_IF_SLASHED = {"svg", "math"}

PATH_WORDS = 64  # innermost tag and class names that a block's path holds

_markup = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_end = re.compile(r""">|=\s*(?:"[^"]*"|'[^']*')""")
_tag_name = re.compile(r"[^\s/>]+")
_close = {s: re.compile(rf"</{s}\s*>", re.I) for s in SILENT}
_named = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_token = re.compile(r"[a-zA-Z]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Page:
    """Tags of a page in one forward pass; whatever the markup, a character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """Where the tag whose name starts at `at` ends: after the first > outside of a quoted value, or after the first one if there is none such."""
        start = at
        while self.quotes and (m := _end.search(self.page, at)):
            at = m.end()
            if m[0] == ">":
                return at
        self.quotes = False  # the values that start here run to the end of the page
        return self.page.find(">", start) + 1

    def next(self, at: int) -> tuple[int, int, str]:
        """(start, end, inside) of the next markup; inside is empty for comments and declarations. Start is the page's end if none is left."""
        m = _markup.search(self.page, at)
        n = len(self.page)
        if not m:
            return n, n, ""
        if m[0] == "<!--":
            end = self.page.find("-->", m.end())
            return m.start(), n if end < 0 else end + 3, ""
        if m.start() > self.last:
            return n, n, ""
        end = self.page.find(">", m.end()) + 1 if m[0] in ("<!", "<?") else self.end(m.start() + 1)
        return m.start(), end, "" if m[0] in ("<!", "<?") else self.page[m.start() + 1 : end - 1]


class _Stack:
    """Open tags, each with the path of names down to it, and how many of each name are open."""

    def __init__(self):
        self.tags: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter = Counter()

    def path(self) -> tuple[str, ...]:
        return self.tags[-1][1] if self.tags else ()

    def push(self, name: str, words: tuple[str, ...]) -> None:
        self.tags.append((name, (*self.path(), *words)[-PATH_WORDS:]))
        self.open[name] += 1

    def cut(self, k: int) -> None:
        for name, _ in self.tags[k:]:
            self.open[name] -= 1
        del self.tags[k:]

    def close(self, names: set[str], stops) -> None:
        """Close down to the innermost open tag of these names, unless one at which stops() holds comes first."""
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.tags) - 1, -1, -1):
            if self.tags[k][0] in names:
                self.cut(k)
                return
            if stops(self.tags[k][0]):
                return


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: white space is made even, character references are decoded."""
    out: list[Block] = []
    source, stack = _Page(page), _Stack()
    parts: list[str] = []
    linked = 0
    path: tuple[str, ...] = ()
    at = 0
    unclosed: set[str] = set()  # silent tags that nothing closes from here on

    def cut() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    while at < len(page):
        start, end, inside = source.next(at)
        if start > at:
            if not parts or not path:
                path = stack.path()
            if not stack.open["head"]:
                text = entities.unescape(page[at:start])
                parts.append(text)
                if stack.open["a"]:
                    linked += len(text.strip())
        at = end
        if not inside:
            continue
        closing = inside[0] == "/"
        m = _tag_name.match(inside, closing)
        name, attributes = m[0].lower(), inside[m.end() :]
        if not closing and name in SILENT and name != "head" and name not in unclosed:
            close = None if name in EMPTY_IF_SLASHED and attributes.endswith("/") else _close[name].search(page, at)
            if close or name in TO_THE_END or (name in EMPTY_IF_SLASHED and attributes.endswith("/")):
                at = close.end() if close else at if name in EMPTY_IF_SLASHED else len(page)
                parts.append(" ") if parts else None
                continue
            unclosed.add(name)
        if name not in INLINE:
            cut()
        if closing:
            stack.close({name}, lambda _: False)
            continue
        if name in VOID:
            continue
        if name == "body":
            stack.close({"head"}, lambda _: False)
        if name in CLOSES_P:
            stack.close({"p"}, lambda t: t not in INLINE)
        elif name in SAME:
            stack.close(SAME[name], lambda t: t in ("ul", "ol", "dl", "table", "select"))
        classes = [f".{t.lower()}" for g in _named.findall(attributes) for t in _token.findall("".join(g))] if attributes else []
        stack.push(name, (name, *classes))
    cut()
    return out


@functools.lru_cache(1 << 16)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for depth, word in enumerate(reversed(path)):
        code = zlib.crc32(word.encode())
        v[code % PATH] += (1 if code >> 16 & 1 else -1) * (1.0 if depth < 2 else 0.8)
    return v


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = zlib.crc32(word.lower().encode()) % WORDS
        return code


_slots = _Slots()


def vectors(sequence: list[Block]) -> np.ndarray:
    out = np.zeros((len(sequence), INPUT), np.float32)
    if len(_slots) > 300_000:
        _slots.clear()
    for k, b in enumerate(sequence):
        words = b.text.split()
        out[k, :PATH] = _path_vector(b.path)
        out[k, PATH : PATH + WORDS] = np.bincount(np.fromiter(map(_slots.__getitem__, words), np.int64, len(words)), minlength=WORDS) / len(words) ** 0.5 * 0.3
        n = len(b.text)
        ends = b.text.count(".") + b.text.count("!") + b.text.count("?") + b.text.count(",")
        out[k, PATH + WORDS :] = (np.log1p(n) / 6, b.linked / n, min(1.0, 20 * ends / n), k / len(sequence), 1 / (1 + k), len(words) == 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Forward and backward LSTM over blocks, and a logistic layer on both states."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        make = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {f"{d}{k}": make(n, 4 * HIDDEN) for d in "fb" for k, n in (("x", INPUT), ("h", HIDDEN))}
        self.w |= {f"{d}c": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32) for d in "fb"}
        self.w |= {"o": make(2 * HIDDEN, 1), "z": np.zeros(1, np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: steps x pages x INPUT. States of one direction; masked steps hold the state."""
        steps, pages, _ = x.shape
        pre = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = pre[t] + h @ self.w[f"{d}h"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            th = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, u, th, m))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], axis=2)
        return (both @ self.w["o"])[..., 0] + self.w["z"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid((both @ self.w["o"])[..., 0] + self.w["z"][0])
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        dz = (mask * (p - y) / n).astype(np.float32)
        grad = {"o": np.einsum("tph,tp->h", both, dz)[:, None], "z": np.array([dz.sum()], np.float32)}
        dboth = dz[..., None] * self.w["o"][:, 0]
        for k, d in enumerate("fb"):
            gx, gh, gc = (np.zeros_like(self.w[d + s]) for s in "xhc")
            dh, dc = np.zeros_like(runs[d][0][0]), np.zeros_like(runs[d][0][0])
            for t, h, c, i, f, o, u, th, m in reversed(runs[d][1]):
                dh = dh + dboth[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                own = dh * m
                dnew = dc * m + own * o * (1 - th**2)
                dg = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), own * th * o * (1 - o), dnew * i * (1 - u**2)], axis=1)
                gx += x[t].T @ dg
                gh += h.T @ dg
                gc += dg.sum(0)
                dh = dh * (1 - m) + dg @ self.w[d + "h"].T
                dc = dc * (1 - m) + dnew * f
            grad |= {d + "x": gx, d + "h": gh, d + "c": gc}
        return loss, grad

    def fit(self, pages: Iterator[tuple[list[Block], list[int]]], steps: int = STEPS) -> Labeller:
        """Adam over batches of pages of like length, from a set of WRITTEN pages."""
        written = sorted(((vectors(found), labels) for found, labels in (next(pages) for _ in range(WRITTEN))), key=lambda p: len(p[1]))
        rng = np.random.default_rng(SEED)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = int(rng.integers(0, max(1, len(written) - PAGES + 1)))
            batch = written[at : at + PAGES]
            x, mask = padded([v for v, _ in batch])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(batch):
                y[: len(labels), k] = labels
            _, grad = self.gradients(x, mask, y)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - 0.02 * (0.1 if step > 0.8 * steps else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, sequences: list[list[Block]], cells: int = 1 << 15) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length share a pass of at most about `cells` blocks."""
        out = [np.zeros(len(s), bool) for s in sequences]
        order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: len(sequences[k]))
        while order:
            longest = len(sequences[order[-1]])
            take = order[-max(1, cells // longest) :]
            del order[-len(take) :]
            x, mask = padded([vectors(sequences[k]) for k in take])
            logit = self.logits(x, mask)
            for i, k in enumerate(take):
                out[k] = logit[: len(out[k]), i] > 0
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in sequences)
    x, mask = np.zeros((steps, len(sequences), INPUT), np.float32), np.zeros((steps, len(sequences)), np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


class Templates:
    """Pages with known labels: every text node is written as main or not by the part of the template it stands in."""

    def __init__(self, seed: int = SEED):
        self.rng = np.random.default_rng(seed)

    def _one(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def _maybe(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def _word(self) -> str:
        return "".join(self._one("an", "el", "mi", "to", "ra", "the", "ing", "que", "sch", "ó", "ün", "ca", "do", "st", "re") for _ in range(int(self.rng.integers(1, 5))))

    def _text(self, low: int, high: int, sentences: bool = True) -> str:
        words = [self._word() for _ in range(int(self.rng.integers(low, high + 1)))]
        if sentences:
            words = [w + ("." if self._maybe(0.1) else "," if self._maybe(0.08) else "") for w in words]
            words[0], words[-1] = words[0].capitalize(), words[-1].rstrip(".,") + "."
        return " ".join(words)

    def _node(self, tag: str, text: str, label: int, attr: str = "") -> str:
        """A tag with one text node; a mark before the text carries the label through the parser."""
        return f"<{tag}{attr}>{chr(0xE001 if label else 0xE000)}{text}" + ("" if tag == "p" and self._maybe(0.1) else f"</{tag}>")

    def _links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self._node('a', self._text(1, 3, False), 0, ' href=#')}</li>" for _ in range(n)) + "</ul>"

    def _name(self, *names: str) -> str:
        return f' {self._one("class", "id")}="{self._one(*names)}"'

    def _article(self) -> str:
        out = [self._node(self._one("h1", "h1", "h2"), self._text(2, 12, self._maybe(0.4)), 1)] if self._maybe(0.85) else []
        if self._maybe(0.2):
            out.append(self._node("div", self._text(2, 5, False), 0, self._name("share", "social", "breadcrumb", "meta tags", "ad", "advert", "toolbar")))
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.7:
                out.append(self._node("p", self._text(1, 70), 1))
            elif kind < 0.8:  # sloppy markup
                out.append(f"<p><b>{self._node('span', self._text(3, 15), 1)}<br>" if self._maybe(0.5) else f"<p><b>{chr(0xE001)}{self._text(3, 15)}<br>")
            elif kind < 0.86:
                out.append(self._node(self._one("h2", "h3"), self._text(1, 6, False), 1))
            elif kind < 0.9:
                out.append("<ul>" + "".join(self._node("li", self._text(2, 12), 1) for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(self._node(self._one("td", "td", "th"), self._text(1, 3, False), 1) for _ in range(3)) + "</tr>" for _ in range(int(self.rng.integers(1, 4)))) + "</table>")
            elif kind < 0.93:
                out.append(f"<p>{self._node('a', self._text(6, 30), 1, ' href=#')}</p>")
            elif kind < 0.95:
                out.append("<blockquote>" + self._node("p", self._text(5, 30), 1) + "</blockquote>")
            else:
                out.append(self._junk())
        return "".join(out)

    def _junk(self) -> str:
        kind = int(self.rng.integers(9))
        if kind == 0:
            return self._node("div", self._text(2, 20), 0, self._name("ad", "ads", "advert", "advertisement", "sponsored", "promo banner", "ad box"))
        if kind == 1:
            return f"<aside{self._one('', self._name('sidebar', 'related', 'widget'))}>" + self._node(self._one("h3", "p"), self._text(1, 5, False), 0) + self._one(self._links(3), self._node("p", self._text(4, 25), 0)) + "</aside>"
        if kind == 2:
            return f"<div{self._name('cookie', 'cookie notice', 'notice', 'consent banner', 'alert', 'popup modal')}>" + self._node("p", self._text(4, 25), 0) + self._node("button", self._text(1, 2, False), 0) + "</div>"
        if kind == 3:
            return "<form>" + self._node("label", self._text(1, 3, False), 0) + "<input>" + self._node("button", self._text(1, 2, False), 0) + "</form>"
        if kind == 4:
            return f"<div{self._name('sidebar', 'side', 'related', 'recommended', 'widget', 'newsletter', 'share social')}>" + self._node(self._one("p", "h3", "div"), self._text(2, 20), 0) + self._one("", self._links(2)) + "</div>"
        if kind == 5:
            return self._node("p", self._text(4, 25), 0, self._name("notice", "disclaimer", "ad", "cookie", "promo", "subscribe"))
        if kind == 6:
            return f"<{self._one('section', 'div', 'ol')}{self._name('comments', 'comment list', 'responses', 'discussion', 'replies')}>" + "".join(f"<div{self._name('comment', 'reply', 'comment body')}>" + self._node("b", self._text(1, 1, False), 0) + self._node("p", self._text(3, 40), 0) + "</div>" for _ in range(int(self.rng.integers(1, 5)))) + f"</{self._one('section', 'div')}>"
        if kind == 7:
            return "<nav>" + self._links(int(self.rng.integers(1, 6))) + "</nav>"
        return f"<div{self._name('menu', 'nav', 'navbar', 'breadcrumb', 'pagination', 'tags')}>" + self._links(int(self.rng.integers(1, 5))) + "</div>"

    def page(self) -> str:
        top = [self._one(f"<nav>{self._links(int(self.rng.integers(1, 8)))}</nav>", f"<header{self._one('', self._name('site header', 'masthead', 'top'))}>{self._node(self._one('h1', 'div', 'p'), self._text(1, 5, False), 0)}{self._one('', self._links(4))}</header>", f"<div{self._name('header', 'menu', 'nav', 'masthead')}>{self._one(self._links(4), self._node('p', self._text(2, 12), 0))}</div>", "")]
        top += [self._junk() for _ in range(int(self.rng.integers(0, 3)))]
        tag = self._one("article", "article", "article", "main", "main><article", "div" + self._name("content", "main", "post", "article body", "entry content", "story"), "section" + self._name("content", "article", "post"))
        end = "".join(f"</{re.match('[a-z]+', t)[0]}>" for t in reversed(tag.split("><")))
        after = [self._junk() for _ in range(int(self.rng.integers(0, 3)))]
        foot = self._one(f"<footer>{self._one(chr(0xE000) + self._text(3, 20), self._node('p', self._text(3, 20), 0), self._links(3))}</footer>", f"<div{self._name('footer', 'site footer', 'copyright', 'bottom')}>{self._node('p', self._text(3, 20), 0)}</div>", "")
        if self._maybe(0.06):  # laid out by a table
            cells = [f"<td{self._one('', self._name('menu', 'nav', 'left'))}>{self._links(3)}</td>", f"<td{self._one('', self._name('content', 'main', 'text'))}>{self._article()}</td>"]
            return "<html><head><title>x</title></head><body>" + top[0] + f"<table{self._one('', ' width=800')}><tr>" + "".join(cells) + "</tr></table>" + foot + "</body></html>"
        return "<html><head><title>x</title></head><body>" + "".join(top) + f"<{tag}>" + self._article() + end + "".join(after) + foot + "</body></html>"

    def __iter__(self):
        return self

    def __next__(self) -> tuple[list[Block], list[int]]:
        found = blocks(self.page())
        labels = [int(chr(0xE001) in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(chr(0xE000), "").replace(chr(0xE001), "") or "x"
        return (found, labels) if found else next(self)


@functools.lru_cache(1)
def trained() -> Labeller:
    """The production labeller; training is deterministic and takes seconds."""
    return Labeller().fit(Templates())


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return [" ".join(b.text for b, ok in zip(s, keep.tolist(), strict=True) if ok) for s, keep in zip(found, labeller.label(found), strict=True)]


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 4 << 20):
                texts = main_texts([h or "" for h in part.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
