"""Main text of web pages: a bidirectional LSTM labels the sequence of a page's leaf blocks.

A page is read once from left to right into leaf blocks: runs of text between the tags that begin or end a block. A
block is told to the network by its path (tags, and words of class, id and role, of all elements around it, hashed),
its words (hashed) and eight numbers (length, share of links, place and the like). The network, in numpy, reads the
blocks of a page in both directions, so each is classed with the whole page in view; the main ones, in page order, are
the text.

No labels of blocks are given, so they are made from the pages. A bounded sample (:data:`SAMPLE` different pages of at most
:data:`LONGEST` characters, the first by a hash) gives texts: blocks in an ``article`` or ``main``
element, outside of elements named as something else, are main. Each page of the sample is also laid out anew,
:data:`LAYOUTS` times, in random layouts whose labels are known: its main blocks, a few cut short, in one of many usual containers,
menus, headers, footers, sidebars, notices, adverts, forms and comments in theirs around and inside, some without any
name. Their texts are words of the page in lengths usual for their kind, so words alone don't give them away.

Nulls, empty texts, ties: a null or empty html has no blocks, its text is ''. Blocks without characters are none.
Broken markup is read as browsers do in the common cases: unclosed paragraphs and list items end where the next begins,
end tags without a beginning are passed over, an unclosed script or comment goes on to the end. Repeated rows and
ids each give a row. An empty table gives an empty result. Where no page of the sample has main blocks, none is found
in any page. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.llm import storage

SAMPLE, LONGEST, LAYOUTS = 300, 40_000, 8
HIDDEN, EPOCHS, RATE, SEED = 24, 8, 0.01, 11
#: How often a page of the sample counts besides with some main blocks cut short; pages that are fitted together.
REPEATS, LOT = 2, 32
BAG, LEAF, WORDS, NUMBERS = 512, 32, 32, 8
#: Elements deeper than this count as lying at this depth.
DEPTH = 48

# Elements of HTML by what they do to a block.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend"
    " li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_SKIPPED = frozenset("script style template noscript iframe svg title textarea object canvas audio video".split())
#: An element that begins here ends an open one of these, unless one of those lies between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    """A leaf block: its path (as :class:`Paths` knows it), text, and characters of it in links."""

    path: int
    text: str
    linked: int = 0


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, without digits; ``hidden`` for what isn't shown."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ()
    out = []
    for m in _NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[5] or (m[1] and m[1].lower() == "style"):
            out += ["hidden"] if m[5] or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
        else:
            out += [w.lower() for w in _WORD.findall(value) if 1 < len(w) <= 20]
    return tuple(out[:12])


def _bits(token: str, size: int, bits: int) -> list[int]:
    return [zlib.crc32(f"{k}{token}".encode()) % size for k in range(bits)]


class Paths:
    """Numbers for paths, and their vectors: which tags and names lie around (two bits of BAG each), the innermost
    element, and the one around it."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.depth, self.tags, self.vectors = [0], ["", ""], [np.zeros(BAG + 2 * LEAF, np.float32)]

    def under(self, parent: int, tag: str, names: tuple[str, ...]) -> int:
        key = (parent, tag, names)
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.vectors)
            vector = self.vectors[parent].copy()
            vector[BAG + LEAF :] = vector[BAG : BAG + LEAF]
            vector[BAG : BAG + LEAF] = 0
            for token in (f"<{tag}", *names):
                vector[_bits(token, BAG, 2)] = 1
            vector[BAG + _bits(tag, LEAF, 1)[0]] = 1
            self.vectors.append(vector)
        return at


def blocks(html: str, paths: Paths) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    state = {"links": 0, "linked": 0, "head": False}
    spans: list[int] = []

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(stack[-1][1] if stack else 0, text, min(sum(spans), len(text))))
            parts.clear()
            spans.clear()

    def text(piece: str) -> None:
        if piece and not state["head"]:
            parts.append(piece)
            if state["links"]:
                spans.append(len(piece))

    at, end = 0, len(html)
    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _SKIPPED:
            if not closing and not m[3].endswith("/"):
                over = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
                at = over.end() if over else end
        elif tag == "head":
            state["head"] = not closing
        elif tag == "a":
            state["links"] = 0 if closing else 1
        elif tag in ("br", "wbr"):
            text(" " if tag == "br" else "")
        elif tag in _BLOCKS:
            flush()
            state["head"] = state["links"] = 0
            if closing:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - 4 * DEPTH), -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            ended, within = _ENDS.get(tag, ((), ()))
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - 4 * DEPTH), -1) if ended else ():
                if stack[k][0] in within:
                    break
                if stack[k][0] in ended:
                    del stack[k:]
                    break
            if tag != "hr":
                around = stack[min(len(stack), DEPTH) - 1][1] if stack else 0
                stack.append((tag, paths.under(around, tag, _names(m[3]))))
    text(html[at:])
    flush()
    return out


# What the network sees


def _word_vectors(texts: Sequence[str]) -> np.ndarray:
    """Each text's words, hashed, as the logarithm of their counts over the logarithm of all."""
    raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
    cut = (raw == 32) | (raw == 10)
    begin = np.flatnonzero(np.r_[True, cut[:-1]]) if len(raw) else np.empty(0, np.int64)
    if not len(begin):
        return np.zeros((len(texts), WORDS), np.float32)
    length = np.diff(np.r_[begin, len(raw) + 1])  # with the character after
    place = np.arange(len(raw)) - np.repeat(begin, np.minimum(length, len(raw) - begin))
    power = (np.uint32(2654435761) * (np.arange(16, dtype=np.uint32) * np.uint32(2) + np.uint32(1))).astype(np.uint32)
    sums = np.add.reduceat(np.where(cut, 0, raw).astype(np.uint32) * power[place & 15], begin)
    sums ^= sums >> np.uint32(15)
    bucket = ((sums * np.uint32(2246822519)) >> np.uint32(27)).astype(np.int64) % WORDS
    of = np.cumsum(raw == 10) if len(texts) > 1 else np.zeros(len(raw), np.int64)
    of = (of - (raw == 10))[begin]
    counts = np.bincount(of * WORDS + bucket, minlength=len(texts) * WORDS).reshape(len(texts), WORDS)
    return (np.log1p(counts) / np.log1p(np.maximum(counts.sum(1, keepdims=True), 1))).astype(np.float32)


def _number_vectors(page: Sequence[Block]) -> np.ndarray:
    n = len(page)
    size = np.array([len(b.text) for b in page], np.float32)
    words = np.array([b.text.count(" ") + 1 for b in page], np.float32)
    linked = np.array([b.linked for b in page], np.float32) / size
    ends = np.array([b.text[-1] in ".!?…。\"”»" for b in page], np.float32)
    stops = np.array([b.text.count(". ") + b.text.count(", ") for b in page], np.float32)
    share = size / size.sum()
    return np.column_stack([np.log1p(size) / 8, np.log1p(words) / 6, linked, ends, np.log1p(stops) / 4, np.arange(n, dtype=np.float32) / n, np.full(n, np.log1p(n) / 6, np.float32), share]).astype(np.float32)


@dataclass
class Pages:
    """Blocks of several pages as arrays: path numbers with their vectors, and the rest of the features."""

    path: np.ndarray
    vectors: np.ndarray
    rest: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(pages: Sequence[Sequence[Block]], paths: Paths) -> Pages:
        flat = [b for page in pages for b in page]
        used, path = np.unique(np.array([b.path for b in flat], np.int64), return_inverse=True)
        rest = np.concatenate([_word_vectors([b.text for b in flat]), np.concatenate([_number_vectors(p) for p in pages if p] or [np.zeros((0, NUMBERS), np.float32)])], axis=1)
        return Pages(path.ravel(), np.stack([paths.vectors[i] for i in used]) if len(used) else np.zeros((0, BAG + 2 * LEAF), np.float32), rest, np.cumsum([0, *map(len, pages)]))


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """An LSTM in each direction over the blocks of a page, and a logistic unit over both states."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = SEED, hidden: int = HIDDEN) -> Network:
        rng, w = np.random.default_rng(seed), {}
        for side in "fb":
            w[f"{side}p"] = rng.normal(0, 0.15, (BAG + 2 * LEAF, 4 * hidden))
            w[f"{side}r"] = rng.normal(0, 0.15, (WORDS + NUMBERS, 4 * hidden))
            w[f"{side}h"] = rng.normal(0, hidden**-0.5 / 2, (hidden, 4 * hidden))
            w[f"{side}c"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        w["o"] = rng.normal(0, 0.3, 2 * hidden)
        w["oc"] = np.zeros(1)
        return Network({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each step: ``x`` (steps, pages, 4 * hidden) is what enters; a masked step leaves the state as it is."""
        h = c = np.zeros((x.shape[1], x.shape[2] // 4), np.float32)
        n, out = h.shape[1], np.empty((*x.shape[:2], x.shape[2] // 4), np.float32)
        for t in range(len(x)):
            z = x[t] + h @ self.weights[f"{side}h"]
            gates = _sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            m = mask[t][:, None]
            new = f * c + i * g
            s = np.tanh(new)
            if trace is not None:
                trace.append((h, c, i, f, o, g, s, m))
            h, c = np.where(m, o * s, h), np.where(m, new, c)
            out[t] = h
        return out

    def _entering(self, side: str, pages: Pages) -> np.ndarray:
        w = self.weights
        return (pages.vectors @ w[f"{side}p"])[pages.path] + pages.rest @ w[f"{side}r"] + w[f"{side}c"]

    @staticmethod
    def _grid(pages: Pages, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers (steps, pages) of some pages and which of them are real."""
        size = pages.begin[some + 1] - pages.begin[some]
        steps = np.arange(size.max())[:, None]
        mask = steps < size
        return np.where(mask, pages.begin[some] + steps, 0), mask

    def chances(self, pages: Pages, together: int = 128) -> np.ndarray:
        """Each block's chance of being main text. Pages of like length are read together."""
        out, w = np.zeros(pages.begin[-1], np.float32), self.weights
        if not len(out):
            return out
        entering = {side: self._entering(side, pages) for side in "fb"}
        size = np.diff(pages.begin)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        for k in range(0, len(order), together):
            at, mask = self._grid(pages, order[k : k + together])
            n = len(w["o"]) // 2
            score = self._run("f", entering["f"][at], mask) @ w["o"][:n] + self._run("b", entering["b"][at[::-1]], mask[::-1])[::-1] @ w["o"][n:] + w["oc"]
            out[at[mask]] = _sigmoid(score[mask])
        return out

    def slopes(self, pages: Pages, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over the blocks of pages, and its slope in each weight (back-propagation through time)."""
        w, n = self.weights, len(self.weights["o"]) // 2
        at, mask = self._grid(pages, np.arange(len(pages.begin) - 1))
        traces: dict[str, list] = {"f": [], "b": []}
        f = self._run("f", self._entering("f", pages)[at], mask, traces["f"])
        b = self._run("b", self._entering("b", pages)[at[::-1]], mask[::-1], traces["b"])[::-1]
        p = _sigmoid(f @ w["o"][:n] + b @ w["o"][n:] + w["oc"])
        y, total = truth[at], mask.sum()
        loss = -float(np.where(mask, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0).sum() / total)
        d = np.where(mask, p - y, 0) / total
        out = {"o": np.r_[np.einsum("tp,tph->h", d, f), np.einsum("tp,tph->h", d, b)], "oc": np.array([d.sum()])}
        for side, enter, error, places, masks in (("f", f, d, at, mask), ("b", b, d[::-1], at[::-1], mask[::-1])):
            v = w["o"][:n] if side == "f" else w["o"][n:]
            dh, dc, dz = np.zeros_like(enter[0]), np.zeros_like(enter[0]), np.zeros((*places.shape, 4 * n), np.float32)
            back = np.zeros_like(w[f"{side}h"])
            for t in range(len(places) - 1, -1, -1):
                h, c, i, g_, o, g, s, m = traces[side][t]
                dh = dh + error[t][:, None] * v
                here, through = np.where(m, dh, 0), np.where(m, 0, dh)
                dnew = np.where(m, dc, 0) + here * o * (1 - s * s)
                dz[t] = np.concatenate([dnew * g * i * (1 - i), dnew * c * g_ * (1 - g_), here * s * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                back += h.T @ dz[t]
                dh, dc = through + dz[t] @ w[f"{side}h"].T, np.where(m, dnew * g_, dc)
            flat, places = dz[masks], places[masks]
            by_path = np.zeros((len(pages.vectors), 4 * n), np.float32)
            np.add.at(by_path, pages.path[places], flat)
            out |= {f"{side}p": pages.vectors.T @ by_path, f"{side}r": pages.rest[places].T @ flat, f"{side}c": flat.sum(0), f"{side}h": back}
        return loss, out

    def fit(self, lots: Sequence[tuple[Pages, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Network:
        """Adam over lots of pages of like length, with the labels of their blocks."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            for lot in rng.permutation(len(lots)):
                step += 1
                _, slopes = self.slopes(*lots[lot])
                pace = rate * (1 - epoch / epochs) * min(1, step / 20)
                for k, g in slopes.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


# Labels: what markup says, and layouts made of a page's own texts

# Usual containers of each part of a page, as tag and names.
_MAIN = "article main section div.content div.post div.entry.content div.article.body div.article div.story section.story div.main.content div.post.content div.text div.blog.post div.main div.page.content td.content div div".split()
_PARTS = {
    "menu": "nav div.menu div.navbar div.nav ul.nav div.navigation div.breadcrumbs div.breadcrumb div.top.bar div.tabs ul.menu div.pagination div.toc",
    "header": "header div.header div.masthead div.site.header div.banner div.top div.branding div.logo",
    "footer": "footer div.footer div.site.footer div.copyright div.contentinfo div.bottom div.colophon div.legal",
    "side": "aside div.sidebar div.side div.widget div.related div.recommended section.more.stories div.trending div.complementary div.popular div.social.share div.author.bio div.tags",
    "notice": "div.cookie.notice div.cookie.banner div.cookies div.notice div.alert div.gdpr div.consent div.newsletter div.subscribe div.popup div.modal div.dialog div.paywall div.warning div.message div.hidden section.notice",
    "advert": "div.ad div.ads div.advert div.advertisement div.sponsored div.promo div.promotion div.banner.ad div.adsense aside.ad section.advert div.sponsor",
    "form": "form form.search div.login form.contact form.signup div.search fieldset div.form",
    "comments": "section.comments div.comments div.comment.list ol.comment.list div.replies div.discussion div.disqus div.reader.comments div.responses ul.comments section.reader.comments div.feedback",
}
PARTS = {k: v.split() for k, v in _PARTS.items()}
_OTHER_TAGS = frozenset("nav header footer aside form fieldset button label select".split())
_OTHER_NAMES = frozenset(w for k, v in PARTS.items() for x in v for w in x.split(".")[1:]) - {"top", "main", "message", "list", "more", "stories", "author", "tags", "text", "feedback"}


def _labels(page: Sequence[Block], chains: dict[int, tuple]) -> list[bool]:
    """Main by markup: in an article or main element and in no element that says it is something else."""

    def main(path: int) -> bool:
        inside = False
        while path:
            path, tag, names = chains[path]
            if tag in _OTHER_TAGS or not _OTHER_NAMES.isdisjoint(names):
                return False
            inside |= tag in ("article", "main")
        return inside

    known: dict[int, bool] = {}
    return [known.setdefault(b.path, False) if b.path in known else known.setdefault(b.path, main(b.path)) for b in page]


class _Layouts:
    """Random layouts of a page: its main blocks in a new container, other parts around and inside."""

    def __init__(self, paths: Paths, seed: int):
        self.paths, self.rng = paths, np.random.default_rng(seed)

    def _in(self, path: int, what: str) -> int:
        """The path of an element in ``path``; names go missing, and meaningless ones come in."""
        tag, *names = what.split(".")
        names = tuple(n for n in names if self.rng.random() > 0.05)
        if self.rng.random() < 0.25:
            names += ("".join(chr(97 + k) for k in self.rng.integers(0, 26, self.rng.integers(2, 7))),)
        return self.paths.under(path, tag, names)

    def _pick(self, of: Sequence[str]) -> str:
        return of[self.rng.integers(len(of))]

    def _words(self, low: int, high: int) -> str:
        n, at = int(self.rng.integers(low, high + 1)), int(self.rng.integers(len(self.words)))
        return " ".join(self.words[(at + k) % len(self.words)] for k in range(n))

    def _part(self, kind: str, path: int, nameless: bool) -> list[Block]:
        tag = self._pick(PARTS[kind])
        top = self._in(path, "div" if nameless else tag)
        if self.rng.random() < 0.3:
            top = self._in(top, "div")
        out = []
        if kind in ("menu", "header", "footer", "side") or (kind == "form" and self.rng.random() < 0.5):
            links = self.rng.random() < (0.9 if kind == "menu" else 0.6)
            inner = self._in(self._in(top, "ul"), "li") if self.rng.random() < 0.7 else self._in(top, self._pick(["div", "p"]))
            for _ in range(self.rng.integers(1, 9 if kind == "menu" else 5)):
                text = self._words(1, 4) if links else self._words(2, 16)
                out.append(Block(inner, text, len(text) if links else 0))
            if kind != "menu" and self.rng.random() < 0.4:
                out.insert(0, Block(self._in(top, self._pick(["h2", "h3", "h4", "p"])), self._words(1, 5)))
        elif kind == "comments":
            if self.rng.random() < 0.7:
                out.append(Block(self._in(top, self._pick(["h2", "h3", "h4"])), self._words(1, 3)))
            each = self._pick(["div.comment", "li.comment", "article.comment", "li", "div", "blockquote.reply", "div.reply"])
            for _ in range(self.rng.integers(1, 7)):
                one = self._in(top, each)
                if self.rng.random() < 0.5:
                    name = self._words(1, 2)
                    out.append(Block(self._in(one, self._pick(["div.author", "p.meta", "div.date", "header"])), name, len(name) if self.rng.random() < 0.5 else 0))
                for _ in range(self.rng.integers(1, 3)):
                    out.append(Block(self._in(one, "p") if self.rng.random() < 0.7 else one, self._words(3, 70) + "."))
        elif kind == "form":
            for _ in range(self.rng.integers(1, 5)):
                out.append(Block(self._in(top, self._pick(["label", "button", "option", "p", "legend", "div"])), self._words(1, 6)))
        else:
            for _ in range(self.rng.integers(1, 3)):
                text = self._words(3, 45)
                out.append(Block(self._in(top, self._pick(["p", "p", "div", "h4", "li"])) if self.rng.random() < 0.5 else top, text, len(text) if self.rng.random() < 0.3 else 0))
        return out

    def shortened(self, block: Block) -> Block:
        """The block itself or, one time in twelve, the same with a word or a few: main blocks can be short."""
        return Block(block.path, self._words(1, 4)) if self.rng.random() < 1 / 12 else block

    def again(self, page: Sequence[Block], labels: Sequence[bool]) -> tuple[list[Block], list[bool]]:
        """A page as it is, but for main blocks that are :meth:`shortened`."""
        self.words = " ".join(b.text for b in page).split()
        return [self.shortened(b) if y else b for b, y in zip(page, labels)], list(labels)

    def lay(self, main: Sequence[Block]) -> tuple[list[Block], list[bool]]:
        rng = self.rng
        self.words = " ".join(b.text for b in main[:40]).split()
        top = self.paths.under(0, "body", ())
        for _ in range(rng.integers(0, 3)):
            top = self._in(top, self._pick(["div", "div.page", "div.wrapper", "div.container", "div.layout", "table", "div.site"]))
        before = [k for k in ("header", "menu", "notice", "advert", "form", "side") if rng.random() < 0.45]
        after = [k for k in ("comments", "side", "advert", "form", "notice", "menu") if rng.random() < 0.4] + (["footer"] if rng.random() < 0.8 else [])
        bare = rng.random() < 0.12  # nothing in this page is named
        out = [(b, False) for k in rng.permutation(before) for b in self._part(str(k), top, bare)]
        own = self._in(top, "div" if bare else self._pick(_MAIN))
        holder = own
        if rng.random() < 0.3:
            holder = self._in(own, self._pick(["div", "section", "div.body", "div.inner", "div.text"]))
        kept = [main[k] for k in sorted(rng.choice(len(main), rng.integers(1, len(main) + 1), replace=False))] if rng.random() < 0.3 else list(main)
        for k, b in enumerate(kept[:60]):
            short = len(b.text) < 120
            inner = self._pick(["h1", "h2", "h1"] if k == 0 and short else ["h2", "p", "li", "p"] if short else ["p"] * 8 + ["div", "blockquote", "li", "pre", "td"])
            path = self._in(self._in(holder, "ul"), "li") if inner == "li" else self._in(self._in(holder, "header"), "h1") if inner == "h1" and rng.random() < 0.1 else self._in(holder, inner)
            b = self.shortened(b)
            linked = int(len(b.text) * rng.random() * 0.3) if rng.random() < 0.2 else 0
            out.append((Block(path, b.text, linked), True))
            if rng.random() < 0.04:
                out += [(x, False) for x in self._part(self._pick(["advert", "side", "notice", "form", "menu"]), holder, False)]
        for k in after:
            inside = k != "footer" and rng.random() < 0.3
            out += [(x, False) for x in self._part(str(k), own if inside else top, bare and not inside)]
        return [b for b, _ in out], [y for _, y in out]


def learn(htmls: Sequence[str], seed: int = SEED, layouts: int = LAYOUTS) -> Network | None:
    """A network fitted to pages and their layouts; None if no page has a main block."""
    paths = Paths()
    told: list[tuple[list[Block], list[bool]]] = []
    read = [blocks(h, paths) for h in htmls]
    chains = {at: key for key, at in paths.known.items()}
    making = _Layouts(paths, seed)
    for page in read:
        labels = _labels(page, chains)
        main = [b for b, y in zip(page, labels) if y]
        if not main:
            continue
        told += [(page, labels), *(making.again(page, labels) for _ in range(REPEATS)), *(making.lay(main) for _ in range(layouts))]
    told.sort(key=lambda x: len(x[0]))
    lots = [told[k : k + LOT] for k in range(0, len(told), LOT)]
    return Network.new(seed).fit([(Pages.of([x for x, _ in lot], paths), np.array([y for _, ys in lot for y in ys], np.float32)) for lot in lots], seed=seed) if lots else None


def main_blocks(pages: Sequence[Sequence[Block]], paths: Paths, network: Network | None) -> Iterator[list[str]]:
    """Texts of the main blocks of each page."""
    if network is None:
        yield from ([] for _ in pages)
        return
    data = Pages.of(pages, paths)
    main = network.chances(data) >= 0.5
    for k, page in enumerate(pages):
        yield [b.text for b, y in zip(page, main[data.begin[k] : data.begin[k + 1]].tolist()) if y]


def fitted(pages: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network fitted to different pages with an article or main element, the first by a hash, in one task; None if none
    of them has a main block. The hashes are chosen first, so that tasks send no page but the chosen ones, and the driver
    gets weights alone."""
    html = F.col("html").cast("string")
    able = pages.select(html.alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.char_length("html") <= LONGEST)).select(F.xxhash64("html").alias("at"), "html")
    chosen = [r[0] for r in able.select("at").distinct().orderBy("at").limit(sample).collect()]
    if not chosen:
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        network = learn([h for _, h in rows]) if rows else None
        if network is not None:
            w = network.weights
            yield pa.RecordBatch.from_arrays([pa.array(list(w)), pa.array([list(v.shape) for v in w.values()], pa.list_(pa.int32())), pa.array([v.astype("<f4").tobytes() for v in w.values()], pa.binary())], ["name", "shape", "data"])

    few = able.filter(F.col("at").isin(chosen)).groupBy("at").agg(F.min("html").alias("html")).repartition(1)
    found = few.mapInArrow(run, "name string, shape array<int>, data binary").collect()
    return Network({r.name: np.frombuffer(r.data, "<f4").reshape(r.shape).astype(np.float32) for r in found}) if found else None


def extract(pages: DataFrame, sample: int = SAMPLE, block_chars: int = 1 << 22) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    network = fitted(slim, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for batch in batches:
            texts: list[str] = []
            held: list[list[Block]] = []
            size = 0
            for html in batch.column(2):
                html = html.as_py() or ""
                held.append(blocks(html, paths))
                size += len(html)
                if size >= block_chars:
                    texts += map("\n\n".join, main_blocks(held, paths, network))
                    held, size = [], 0
                    paths.clear()
            texts += map("\n\n".join, main_blocks(held, paths, network))
            paths.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = slim.schema["page_id"].dataType.simpleString()
    return storage.spread(slim).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
