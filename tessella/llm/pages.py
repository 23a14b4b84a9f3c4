"""Main text of web pages, by a recurrent labeller of their blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each
with the path of open tags above it.  A bidirectional LSTM in numpy reads a
page's blocks in both directions; a block's vector has hashed parts of its tag
path, hashed words, and a few measures.  Every block is classified with the
whole page as context, and the blocks labelled as article are joined.

No page comes with labels, so the labeller learns from pages that are written
here by templates: articles among menus, headers, footers, sidebars, notices,
adverts, forms and comments, in semantic tags or plain ``div`` with telling
class names, with unclosed tags, links, lists and code in the article.  Their
number is fixed, so are the seeds; learning takes seconds on the driver.

Edge cases: a null or empty html has an empty text; a page without blocks or
without article blocks too; a null url or page_id is returned as it is.  A
<br> is white space; unclosed and misnested tags are closed as browsers do for
paragraphs, list items and table cells; a <head> that is left open ends where
something that can't stand in it begins.  Cutting a page into blocks takes a
time in proportion to its length, whatever is left open in it.  Rows that
repeat an id or a page are extracted each on its own; an empty table has no
rows, and columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import html as html_module
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_map, table
from tessella.llm.textkernel import find_words, hash_spans, text_column

PATH_SLOTS, WORD_SLOTS, MEASURES, HIDDEN = 192, 64, 6, 16
TRAIN_PAGES, EPOCHS, TRAIN_BATCH = 500, 7, 20
#: How often a page's words are hidden while learning, so that its structure must do.
HIDE_WORDS = 0.4
#: Pages whose blocks go through the network together.
RUN_BATCH = 256

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_SPECIAL = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-zA-Z]+")
#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select option button canvas math audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: What can stand in <head>; any other tag, and text, ends it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}


@dataclass
class Block:
    path: int  # the hashed parts of the open tags, as bits
    text: str
    linked: int  # characters in links


@lru_cache(maxsize=100_000)
def part_bit(part: str) -> int:
    """The bit of a tag, of a part of a class or id, or of the last two tags together."""
    raw = np.frombuffer(part.encode("utf-8", "replace"), dtype=np.uint8)
    return 1 << int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0] % np.uint64(PATH_SLOTS))


class Tags:
    """The tags of a page, one after the other, in a time that grows with the page and no faster."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.dead: set[int] = set()  # quotes and ends from which no tag ends
        self.ahead = (0, -1)  # from the first to the second of these, the next special character is the second
        self.unclosed: set[str] = set()

    def _special(self, at: int) -> int:
        if not self.ahead[0] <= at <= self.ahead[1]:
            m = _SPECIAL.search(self.page, at)
            self.ahead = (at, m.start() if m else len(self.page))
        return self.ahead[1]

    def end(self, at: int) -> int:
        """Where the tag ends whose name ended here: at the next > that is not quoted; -1 if there is none."""
        seen = []
        while at <= self.last[">"]:
            place = self._special(at)
            if place >= len(self.page) or place in self.dead:
                break
            if self.page[place] == ">":
                return place
            seen.append(place)
            quote = self.page[place]
            if place == self.last[quote]:
                break
            at = self.page.index(quote, place + 1) + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name with a / before if it closes, the rest) of the next tag; comments and the like have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                found = page.find("-->", start + 4)
                return start, found + 3 if found >= 0 else len(page), "", ""
            if page.startswith("<![CDATA[", start):
                found = page.find("]]>", start + 9)
                return start, found + 3 if found >= 0 else len(page), "", page[start + 9 : found if found >= 0 else len(page)]
            if start > self.last[">"]:
                continue
            if page[at : at + 1] in ("!", "?"):
                return start, page.index(">", at) + 1, "", ""
            if (m := _NAME.match(page, at)) and (found := self.end(m.end())) >= 0:
                return start, found + 1, m[0].lower(), page[m.end() : found]
        return None

    def closing(self, tag: str, at: int) -> int:
        """Where the next closing tag of that name ends, -1 if there is none."""
        if tag in self.unclosed:
            return -1
        m = _closing(tag).search(self.page, at)
        if m is None:
            self.unclosed.add(tag)
            return -1
        return m.end()


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*+>", re.I)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[str] = []  # open tags that aren't inline
    masks = [0]  # the bits of all of them, up to each
    where: dict[str, list[int]] = defaultdict(list)  # places of a tag in the stack
    held: list[str] = []
    linked, link = 0, -1  # link: how many tags were open where the open link began
    source = Tags(page)

    def close_block() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text and not where["head"]:
                out.append(Block(masks[-1] | part_bit(">".join(stack[-2:])), text, linked))
        held, linked = [], 0

    def cut(place: int) -> None:
        nonlocal link
        while len(stack) > place:
            where[stack.pop()].pop()
            masks.pop()
        if link > len(stack):
            link = -1

    def close_head() -> None:
        if where["head"]:
            close_block()
            cut(where["head"][0])

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html_module.unescape(raw) if "&" in raw else raw
            held.append(text)
            if link >= 0:
                linked += len(text.strip())

    at = 0
    while at < len(page):
        found = source.next(at)
        raw = page[at : found[0] if found else len(page)]
        if raw and not raw.isspace():
            close_head()
        add(raw)
        if found is None:
            break
        _, at, tag, rest = found
        if not tag:
            add(rest)  # what CDATA holds
        elif tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                link = -1
            elif tag not in INLINE:
                close_block()
                if where[tag]:
                    cut(where[tag][-1])
        elif tag == "br":
            held.append(" ")
        else:
            if tag not in _IN_HEAD:
                close_head()
            if tag in RAW:
                done = source.closing(tag, at)
                if done >= 0 or tag in ("script", "style", "textarea", "title"):  # else only the tag itself goes
                    at = done if done >= 0 else len(page)
                    held.append(" ")
                continue
            open_ = not rest.rstrip().endswith("/")
            if tag in INLINE:
                if tag == "a" and open_:
                    link = len(stack)
                continue
            close_block()
            scope = max((where[t][-1] for t in _SCOPE.get(tag, ()) if where[t]), default=-1)
            shut = [i for t in _CLOSES.get(tag, ("p",)) for i in _above(where[t], scope)]
            if shut:
                cut(min(shut))
            if tag not in VOID and open_:
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
                mask = masks[-1] | part_bit(tag)
                for part in {p.lower() for p in _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names))}:
                    mask |= part_bit(part)
                where[tag].append(len(stack))
                stack.append(tag)
                masks.append(mask)
    close_block()
    return out


def _above(places: list[int], limit: int) -> list[int]:
    """The last of ascending places that are beyond a limit."""
    n = len(places)
    while n and places[n - 1] > limit:
        n -= 1
    return places[n:]


def path_slots(path: int) -> np.ndarray:
    """The bits of a path as a vector."""
    raw = np.frombuffer(path.to_bytes(PATH_SLOTS // 8, "little"), dtype=np.uint8)
    return np.unpackbits(raw, bitorder="little").astype(float)


def block_vectors(found: list[Block], n: list[int]) -> np.ndarray:
    """Hashed words and measures of blocks; n: how many blocks each page has."""
    raw, offsets = text_column(pa.array([b.text for b in found], pa.string()))
    words = find_words(raw, offsets)
    counts = np.diff(words.first)
    slot = (hash_spans(raw, words.start, words.end, lower=True) % np.uint64(WORD_SLOTS)).astype(np.int64)
    bags = np.bincount(words.row * WORD_SLOTS + slot, minlength=len(found) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
    sizes = np.maximum(np.diff(offsets), 1)
    last = raw[offsets[1:] - 1]
    place = np.concatenate([(np.arange(k) + 0.5) / k for k in n]) if n else np.zeros(0)
    total = np.repeat(n, n)
    measures = np.stack(
        [
            np.log1p(counts) / 5,
            np.array([b.linked for b in found]) / np.array([max(len(b.text), 1) for b in found]),
            np.isin(last, np.frombuffer(b".!?:;", dtype=np.uint8)),
            place,
            1.0 / total,
            sizes / np.maximum(counts, 1) / 10,
        ],
        axis=1,
    )
    bags = bags / np.sqrt(np.maximum((bags * bags).sum(1), 1))[:, None]  # no word weighs more for being repeated
    return np.concatenate([bags, measures], axis=1)


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _padded(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pages one after the other -> (steps, pages, width), and which are real."""
    steps = int(n.max())
    page = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((steps, len(n), x.shape[1]))
    mask = np.zeros((steps, len(n)), dtype=bool)
    out[step, page], mask[step, page] = x, True
    return out, mask


def _run(z: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """An LSTM over projected inputs z (steps, pages, 4 * HIDDEN); padding leaves its state as it is."""
    h, c = np.zeros((z.shape[1], HIDDEN)), np.zeros((z.shape[1], HIDDEN))
    out = np.empty((*z.shape[:2], HIDDEN))
    for t in range(len(z)):
        g = z[t] + h @ u
        i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        a = np.tanh(g[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = f * c + i * a
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((h, c, i, f, o, a, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
        out[t] = h
    return out


@dataclass
class Labeller:
    """Weights of both directions (path, other input, recurrent, bias) and of the classifier."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 1) -> Labeller:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w[d + "p"] = rng.normal(0, 0.2, (PATH_SLOTS, 4 * HIDDEN))
            w[d + "x"] = rng.normal(0, 0.1, (WORD_SLOTS + MEASURES, 4 * HIDDEN))
            w[d + "u"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[d + "c"] = np.zeros(4 * HIDDEN)
            w[d + "c"][HIDDEN : 2 * HIDDEN] = 1.0
        w["v"], w["vp"], w["k"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(PATH_SLOTS), np.zeros(1)
        return Labeller(w)

    def project(self, paths: np.ndarray) -> np.ndarray:
        """What a path adds to both directions' gates and to the output."""
        w = self.weights
        return np.concatenate([paths @ w["fp"], paths @ w["bp"], (paths @ w["vp"])[:, None]], axis=1)

    def probabilities(self, projected: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each block, that it belongs to the article; pages one after the other, n blocks each."""
        w, out = self.weights, np.empty(len(x))
        first = np.concatenate([[0], np.cumsum(n)])
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        for a in range(0, len(order), RUN_BATCH):
            pages = order[a : a + RUN_BATCH]
            rows = np.concatenate([np.arange(first[p], first[p + 1]) for p in pages])
            z, mask = _padded(np.concatenate([projected[rows, : 8 * HIDDEN] + np.concatenate([x[rows] @ w["fx"] + w["fc"], x[rows] @ w["bx"] + w["bc"]], axis=1), projected[rows, 8 * HIDDEN :]], axis=1), n[pages])
            forward = _run(z[:, :, : 4 * HIDDEN], mask, w["fu"])
            backward = _run(z[::-1, :, 4 * HIDDEN : 8 * HIDDEN], mask[::-1], w["bu"])[::-1]
            s = forward @ w["v"][:HIDDEN] + backward @ w["v"][HIDDEN:] + z[:, :, -1] + w["k"]
            out[rows] = _sigmoid(s.T[mask.T])
        return out

    def _step(self, paths: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        w = self.weights
        both, mask = _padded(np.concatenate([paths, x, y[:, None]], axis=1), n)
        p, v, target = both[:, :, :PATH_SLOTS], both[:, :, PATH_SLOTS:-1], both[:, :, -1]
        kept, hidden = {"f": [], "b": []}, {}
        for d, turn in (("f", 1), ("b", -1)):
            z = p[::turn] @ w[d + "p"] + v[::turn] @ w[d + "x"] + w[d + "c"]
            hidden[d] = _run(z, mask[::turn], w[d + "u"], kept[d])
        s = hidden["f"] @ w["v"][:HIDDEN] + hidden["b"][::-1] @ w["v"][HIDDEN:] + p @ w["vp"] + w["k"]
        ds = np.where(mask, _sigmoid(s) - target, 0.0) / len(x)
        grad = {"v": np.concatenate([np.einsum("tb,tbh->h", ds, hidden["f"]), np.einsum("tb,tbh->h", ds, hidden["b"][::-1])]), "vp": np.einsum("tb,tbp->p", ds, p), "k": np.array([ds.sum()])}
        for d, turn, part in (("f", 1, w["v"][:HIDDEN]), ("b", -1, w["v"][HIDDEN:])):
            out = ds[::turn][:, :, None] * part
            dz = np.zeros((*ds.shape, 4 * HIDDEN))
            dh, dc = np.zeros(out.shape[1:]), np.zeros(out.shape[1:])
            grad[d + "u"] = np.zeros_like(w[d + "u"])
            for t in range(len(out) - 1, -1, -1):
                h, c, i, f, o, a, tc, m = kept[d][t]
                dh = dh + out[t]
                dcn = np.where(m, dc + dh * o * (1 - tc * tc), 0.0)
                g = np.concatenate([dcn * a * i * (1 - i), dcn * c * f * (1 - f), np.where(m, dh * tc, 0.0) * o * (1 - o), dcn * i * (1 - a * a)], axis=1)
                dz[t] = g
                grad[d + "u"] += h.T @ g
                dh = np.where(m, 0.0, dh) + g @ w[d + "u"].T
                dc = np.where(m, dcn * f, dc)
            flat = dz.reshape(-1, 4 * HIDDEN)
            grad[d + "p"] = p[::turn].reshape(-1, PATH_SLOTS).T @ flat
            grad[d + "x"] = v[::turn].reshape(-1, WORD_SLOTS + MEASURES).T @ flat
            grad[d + "c"] = flat.sum(0)
        return grad


def train(pages: list[tuple[str, list[bool]]], epochs: int = EPOCHS, seed: int = 1) -> Labeller:
    """pages: html and, for each of its blocks, whether it belongs to the article (Adam, small batches)."""
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    data = []
    for page, marks in pages:
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError("a page's blocks and marks differ")
        if found:
            data.append((np.stack([path_slots(b.path) for b in found]), block_vectors(found, [len(found)]), np.array(marks, dtype=float)))
    mean = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), TRAIN_BATCH):
            batch = [data[i] for i in order[a : a + TRAIN_BATCH]]
            paths, x, y = (np.concatenate([b[i] for b in batch]) for i in range(3))
            hide = np.repeat(rng.random(len(batch)) < HIDE_WORDS, [len(b[2]) for b in batch])
            x = np.where(hide[:, None] & (np.arange(x.shape[1]) < WORD_SLOTS), 0.0, x)
            grad = model._step(paths, x, y, np.array([len(b[2]) for b in batch]))
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                model.weights[k] = model.weights[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


# ---- pages to learn from

#: Words that tell what a part is (fixed values).
BOILERPLATE = {
    "nav": "nav navigation navbar menu topnav breadcrumb breadcrumbs pagination toc sitemap skip links",
    "header": "header masthead topbar branding logo site-header page-header",
    "footer": "footer site-footer copyright colophon bottom legal imprint credits",
    "aside": "sidebar aside widget related recommended popular trending more-stories archive tags tagcloud author-box bio",
    "notice": "cookie consent notice gdpr privacy banner alert popup modal overlay paywall message disclaimer",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot taboola outbrain affiliate",
    "form": "form newsletter subscribe signup login search contact-form register",
    "share": "share social sharing follow buttons toolbar tools print meta",
    "comments": "comments comment comment-list respond reply discussion disqus feedback reviews",
}
ARTICLE = "article content post entry story main body text article-body post-content entry-content story-body page-content main-content prose"
_SYLLABLES = "an ar be co da de do el en er es fa ge ha in is ka la le li lo ma me mi mo na ne no on or pa pe po qu ra re ri ro sa se si so ta te ti to tu un ur va ve vi wa ze ou ent ing tion eur ich sch das les".split()
_TELLING = {
    "nav": "home about contact next previous menu",
    "footer": "© copyright all rights reserved terms privacy imprint",
    "notice": "cookies we use accept privacy policy settings",
    "ad": "advertisement sponsored buy now offer sale deal",
    "form": "email name subscribe sign up password search submit",
    "share": "share tweet facebook follow print email",
    "comments": "reply says ago likes report permalink",
    "aside": "related read more popular latest stories",
    "header": "welcome login news today site",
}


def written_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and the marks of its blocks."""
    html: list[str] = []
    marks: list[bool] = []
    pick = lambda words: words[int(rng.integers(len(words)))]

    def word() -> str:
        return "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5))))

    def sentence(n: int) -> str:
        out = [word() for _ in range(n)]
        if rng.random() < 0.08:
            out = [w for w in out[: 1 + n // 10] for _ in range(10)][:n]
        if rng.random() < 0.15:
            out = [w + pick(["***", "%%%", "&amp;&amp;", "###", "!!"]) for w in out]
        if rng.random() < 0.1:
            out = [w.upper() for w in out]
        return " ".join(out).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def part(kind: str, depth: int = 0) -> None:
        telling = _TELLING[kind].split()
        say = lambda n: " ".join(pick(telling) if rng.random() < 0.4 else word() for _ in range(n))
        names = " ".join(pick(BOILERPLATE[kind].split()) for _ in range(int(rng.integers(1, 3))))
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6 else pick(["div", "section", "div"])
        attributes = f' {pick(["class", "class", "id"])}="{names}"' if tag in ("div", "section") or rng.random() < 0.5 else ""
        html.append(f"<{tag}{attributes}>")
        style = rng.random()
        if kind in ("nav", "share") or style < 0.25:
            html.append("<ul>")
            for _ in range(int(rng.integers(1, 9))):
                html.append(f'<li><a href="/{word()}">{say(int(rng.integers(1, 4)))}</a>' + pick(["</li>", "</li>", ""]))
                marks.append(False)
            html.append("</ul>")
        elif style < 0.6:
            html.append(say(int(rng.integers(2, 25))) + pick(["", ".", "!"]))
            marks.append(False)
        else:
            for _ in range(int(rng.integers(1, 5))):
                html.append("<p>" + pick(["", "<b>", "<span>"]) + say(int(rng.integers(2, 40))) + pick([".", ""]))
                marks.append(False)
                html.append("</p>")
        if kind == "form":
            html.append('<input name="q"><button>' + word() + "</button>")
        html.append(f"</{tag}>")

    def article() -> None:
        wrap = []
        if rng.random() < 0.75:
            wrap.append("article" if rng.random() < 0.7 else "main")
        if not wrap or rng.random() < 0.4:
            wrap.append(f'div class="{pick(ARTICLE.split())}"')
        html.extend(f"<{w}>" for w in wrap)
        if rng.random() < 0.85:
            html.append(f"<{(h := pick(['h1', 'h1', 'h2']))}>{sentence(int(rng.integers(1, 12)))}</{h}>")
            marks.append(True)
        count = int(rng.integers(1, 6)) if rng.random() < 0.5 else int(rng.integers(1, 40))
        for _ in range(count):
            style, text = rng.random(), sentence(int(rng.integers(1, 60)) if rng.random() < 0.7 else int(rng.integers(1, 4)))
            if style < 0.62:
                html.append(f"<p>{text}" + pick(["</p>", "</p>", "</p>", ""]))
            elif style < 0.72:
                html.append(f"<p><b>{text}<br>")
            elif style < 0.77:
                html.append(f"<{(h := pick(['h2', 'h3', 'h4']))}>{text}</{h}>")
            elif style < 0.82:
                html.append(f"<blockquote>{text}</blockquote>")
            elif style < 0.86:
                html.append(f"<pre><code>{text}</code></pre>")
            elif style < 0.92:
                items = int(rng.integers(1, 5))
                html.append("<ul>" + "".join(f"<li>{sentence(int(rng.integers(1, 15)))}</li>" for _ in range(items)) + "</ul>")
                marks.extend([True] * (items - 1))
            elif style < 0.95:
                html.append(f'<p>{sentence(5)} <a href="/{word()}">{word()}</a> {text}</p>')
            elif style < 0.97:
                html.append(f"<figure><img src='x.png'><figcaption>{text}</figcaption></figure>")
            else:
                html.append(f"<table><tr><td>{text}</td></tr></table>")
            marks.append(True)
            if rng.random() < 0.03:
                part(pick(["ad", "aside", "share"]), 1)
        html.extend(f"</{w.split()[0]}>" for w in reversed(wrap))

    html.append("<!DOCTYPE html><html><head><title>" + sentence(4) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    before = [k for k in ("notice", "header", "nav", "ad", "form", "share", "aside") if rng.random() < (0.75 if k == "nav" else 0.35)]
    rng.shuffle(before)
    for k in before:
        part(k)
    if rng.random() < 0.96:
        article()
    after = [k for k in ("share", "aside", "ad", "form", "comments", "notice") if rng.random() < 0.3]
    rng.shuffle(after)
    for k in [*after, *(["footer"] if rng.random() < 0.85 else [])]:
        part(k)
    html.append(pick(["</body></html>", ""]))
    return "".join(html), marks


def fitted(pages: int = TRAIN_PAGES, seed: int = 3) -> Labeller:
    rng = np.random.default_rng(seed)
    return train([written_page(rng) for _ in range(pages)])


# ---- in Spark


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                found = [blocks(page or "") for page in batch.column(2).to_pylist()]
                n = np.array([len(f) for f in found])
                flat = [b for f in found for b in f]
                chosen = np.zeros(0, dtype=bool)
                if flat:
                    new = list({b.path for b in flat}.difference(known))
                    if len(known) + len(new) > 50_000:
                        known.clear()
                        new = list({b.path for b in flat})
                    if new:
                        known.update(zip(new, model.project(np.stack([path_slots(p) for p in new])), strict=True))
                    x = block_vectors(flat, [k for k in n.tolist() if k])
                    chosen = model.probabilities(np.stack([known[b.path] for b in flat]), x, n) >= 0.5
                texts, at = [], 0
                for f in found:
                    texts.append("\n\n".join(b.text for b, good in zip(f, chosen[at : at + len(f)].tolist(), strict=True) if good))
                    at += len(f)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_main_text over all of ``pages``."""
    return extract(table(spark, sf_dir, "pages"), fitted())
