"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut at block-level tags; the text between two cuts is a leaf block, known by the tags, classes and ids above it
and by its own look (length, share of link text, sentence marks). The field labels the blocks of a page as article or
other, with weights for each feature and for each pair of neighbouring labels, and is decoded by Viterbi.

It is trained on labelled pages: the built-in ones of `labelled_pages`, and a bounded sample (`SAMPLE` pages) of the given
table whose own mark-up names the article, each once as it is and once in other dress (names of its containers replaced,
foreign blocks put in), so that the field doesn't lean on one site's tags. Training sees only these; extraction runs page
by page where the page is, without a shuffle.

Character references are decoded, white space within a block becomes one space, blocks are trimmed and joined by a line
feed. Null or empty html gives an empty text; broken or unclosed tags end where the next block begins; a page without
text has an empty text. Repeated rows give repeated results; null ids are kept; an empty table gives no rows and other
columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import map_slices

SAMPLE, EPOCHS, RATE = 150, 4, 0.5
DEEPEST = 200  # open elements on a page that may be trained on; pages are read whatever their depth

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg|textarea|select|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_BLOCK = frozenset("html head body title p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 article section nav header footer aside main table thead tbody tfoot tr td th caption form fieldset legend blockquote pre figure figcaption hr address details summary dialog center button".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Tags that an opening tag of the same kind closes.
_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CLOSES_P = _BLOCK - {"button", "html", "head", "body", "title"}
_PART = re.compile(r"[a-z]+")


class Path:
    """An element with those above it. What it adds to their features is kept, not the whole list, so deep pages stay linear."""

    __slots__ = ("above", "tag", "names", "own", "block", "depth", "headed")

    def __init__(self, above: Path | None, tag: str, names: tuple, own: tuple):
        self.above, self.tag, self.names, self.own = above, tag, names, own
        self.block = self if tag in _BLOCK else above.block if above else None  # the nearest one
        self.depth = above.depth + 1 if above else 0
        self.headed = tag in ("head", "title") or bool(above and above.headed)

    @staticmethod
    def of(elements) -> Path | None:
        path, known = None, set()
        for tag, names in elements:
            own = tuple(f for f in element_features(tag, names) if f not in known)
            known.update(own)
            path = Path(path, tag, names, own)
        return path

    def up(self) -> Iterator[Path]:
        node = self
        while node:
            yield node
            node = node.above

    def __iter__(self):
        return iter([(x.tag, x.names) for x in self.up()][::-1])


def element_features(tag: str, names: tuple) -> list[str]:
    return list(dict.fromkeys([*([f"<{tag}"] if tag in _BLOCK else []), *(f".{name}" for name in names)]))


class Leaf:
    """A leaf block: the elements above it, its text, and how much of that is in links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text: str, linked: int):
        self.path, self.text, self.linked = path if isinstance(path, Path) or path is None else Path.of(path), text, linked


def leaves(html: str) -> list[Leaf]:
    """The leaf blocks of a page, in order."""
    out: list[Leaf] = []
    stack: list[Path] = []
    opened, shown = defaultdict(int), defaultdict(int)  # open elements by tag, and features by how many of them have it as their own
    piece: list[str] = []
    linked, at = 0, 0

    def flush():
        nonlocal linked
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out.append(Leaf(stack[-1] if stack else None, text, linked))
            piece.clear()
            linked = 0

    def text_to(end: int):
        nonlocal linked
        if end > at:
            piece.append(html[at:end])
            if opened["a"]:
                linked += end - at

    def close_down_to(depth: int):
        while len(stack) > depth:
            node = stack.pop()
            opened[node.tag] -= 1
            for f in node.own:
                shown[f] -= 1

    for m in _TOKEN.finditer(html):
        text_to(m.start())
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1):
                piece.append(" ")
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            piece.append(" ")
        if tag in _VOID:
            continue
        if m.group(2):
            if opened[tag]:
                while stack[-1].tag != tag:
                    close_down_to(len(stack) - 1)
                close_down_to(len(stack) - 1)
            continue
        close = _SAME.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        block = stack[-1].block if close and stack else None
        while block:
            if block.tag in close:
                close_down_to(block.depth)
                break
            if block.tag not in ("tr", "td", "th"):
                break
            block = block.above.block if block.above else None
        attributes = m.group(4)
        names = tuple(x for found in _NAMES.findall(attributes) for x in _PART.findall("".join(found).lower())) if attributes else ()
        if attributes and _HIDDEN.search(attributes):
            names += ("hidden",)
        own = tuple(f for f in element_features(tag, names) if not shown[f])
        for f in own:
            shown[f] += 1
        opened[tag] += 1
        stack.append(Path(stack[-1] if stack else None, tag, names, own))
    text_to(len(html))
    flush()
    return [x for x in out if not (x.path and x.path.headed)]


def _last(path: Path | None) -> str:
    return f"leaf {path.block.tag if path and path.block else ''}"


def path_features(path: Path | None) -> list[str]:
    return sorted({*(f for node in path.up() for f in node.own), _last(path)} if path else {_last(path)})


def text_features(leaf: Leaf) -> list[str]:
    n = leaf.text.count(" ") + 1
    share = leaf.linked / max(len(leaf.text), 1)
    out = [f"words {min(n.bit_length(), 7)}", f"links {0 if share < 0.1 else 1 if share < 0.5 else 2}", "*"]
    if leaf.text[-1] in ".!?…\"»":
        out.append("sentence")
    if "©" in leaf.text:
        out.append("copyright")
    return out


class Field:
    """Weights of the features and of pairs of labels; label 1 is the article."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pairs, self.first = np.zeros((2, 2)), np.zeros(2)

    def scores(self, page: list[Leaf]) -> np.ndarray:
        """How far the features speak for label 1, block by block."""
        out, known = np.empty(len(page)), {None: 0.0}
        for k, leaf in enumerate(page):
            waiting, node = [], leaf.path
            while node not in known:
                waiting.append(node)
                node = node.above
            s = known[node]
            for node in reversed(waiting):
                s = known[node] = s + sum(self.weights.get(f, 0.0) for f in node.own)
            out[k] = s + self.weights.get(_last(leaf.path), 0.0) + sum(self.weights.get(f, 0.0) for f in text_features(leaf))
        return out

    def decode(self, page: list[Leaf]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to the article."""
        if not page:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back, scores = [], self.scores(page).tolist()
        a, b = float(self.first[0]), float(self.first[1]) + scores[0]
        for s in scores[1:]:
            from0, from1 = b + p10 >= a + p00, b + p11 >= a + p01
            a, b = (b + p10 if from0 else a + p00), (b + p11 if from1 else a + p01) + s
            back.append((int(from0), int(from1)))
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[Leaf], list[int]]], epochs: int = EPOCHS, seed: int = 1) -> Field:
        """Gradient steps on the log-likelihood, with step widths per weight."""
        rng, seen, seen_pairs, seen_first = random.Random(seed), {}, np.full((2, 2), 1e-2), np.full(2, 1e-2)
        for _ in range(epochs):
            for page, labels in rng.sample(pages, len(pages)):
                s = np.stack([np.zeros(len(page)), self.scores(page)], axis=1)
                n = len(page)
                fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = self.first + s[0]
                for k in range(1, n):
                    fore[k] = np.logaddexp(*(fore[k - 1][:, None] + self.pairs)) + s[k]
                for k in range(n - 2, -1, -1):
                    aft[k] = np.logaddexp(*(self.pairs + s[k + 1] + aft[k + 1]).T)
                total = np.logaddexp(*fore[-1])
                gap = np.array(labels) - np.exp(fore[:, 1] + aft[:, 1] - total)
                sums: dict[str, float] = {}
                for leaf, g in zip(page, gap.tolist(), strict=True):
                    for f in (*path_features(leaf.path), *text_features(leaf)):
                        sums[f] = sums.get(f, 0.0) + g
                for f, g in sums.items():
                    seen[f] = seen.get(f, 1e-2) + g * g
                    self.weights[f] = 0.9999 * self.weights.get(f, 0.0) + RATE * g / seen[f] ** 0.5
                pairs = np.zeros((2, 2))
                for k in range(1, n):
                    pairs[labels[k - 1], labels[k]] += 1
                    pairs -= np.exp(fore[k - 1][:, None] + self.pairs + s[k] + aft[k] - total)
                seen_pairs += pairs**2
                self.pairs = self.pairs + RATE * pairs / np.sqrt(seen_pairs)
                first = np.eye(2)[labels[0]] - np.exp(fore[0] + aft[0] - total)
                seen_first += first**2
                self.first = self.first + RATE * first / np.sqrt(seen_first)
        return self


#: Containers of articles and of everything else, as (tag, names); each group may stand for each other.
_ARTICLE = [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("post", "body")), ("section", ("entry",)), ("div", ("article", "text")), ("div", ("story",))]
_OTHER = {
    "menu": [("nav", ()), ("div", ("menu",)), ("ul", ("navigation",)), ("div", ("navbar",)), ("div", ("breadcrumb",))],
    "footer": [("footer", ()), ("div", ("footer",)), ("div", ("copyright",))],
    "header": [("header", ()), ("div", ("header",)), ("div", ("banner",)), ("div", ("masthead",))],
    "advert": [("div", ("ad",)), ("div", ("ads",)), ("div", ("advert",)), ("div", ("sponsor",)), ("div", ("promo",)), ("aside", ("advertisement",))],
    "sidebar": [("aside", ()), ("div", ("sidebar",)), ("div", ("related",)), ("div", ("widget",))],
    "notice": [("div", ("cookie",)), ("div", ("notice",)), ("div", ("consent",)), ("div", ("newsletter",)), ("div", ("popup",)), ("div", ("modal",)), ("div", ("share",)), ("div", ("social",)), ("dialog", ())],
    "form": [("form", ()), ("form", ("login",)), ("form", ("search",))],
    "comments": [("section", ("comments",)), ("div", ("comments",)), ("div", ("comment",)), ("ol", ("commentlist",)), ("div", ("disqus",)), ("div", ("replies",))],
}
_BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "button"))
_BOILER_NAMES = frozenset(name for group in _OTHER.values() for _, names in group for name in names) | {"hidden"}


def named_label(leaf: Leaf) -> int | None:
    """What the mark-up says of a block on a page that names its article: the label of training pages."""
    inside = [k for k, (tag, _) in enumerate(leaf.path or ()) if tag in ("article", "main")]
    other = any(tag in _BOILER_TAGS or _BOILER_NAMES & set(names) for tag, names in leaf.path or ())
    return int(bool(inside) and not other)


def redressed(page: list[Leaf], labels: list[int], rng: random.Random) -> tuple[list[Leaf], list[int]]:
    """The page with other containers around its blocks, and with other kinds of blocks put in."""
    dress = rng.choice(_ARTICLE)
    body = (("html", ()), ("body", ()))
    out, marks, kinds = [], [], list(_OTHER)
    swap = {}

    def foreign(text: str, linked: bool):
        container = rng.choice(_OTHER[rng.choice(kinds)])
        nested = body if rng.random() < 0.6 else (*body, dress)
        leaf = rng.choice([(), (("p", ()),), (("ul", ()), ("li", ())), (("div", ()),)])
        out.append(Leaf((*nested, container, *leaf), text, len(text) if linked else 0))
        marks.append(0)

    texts = [x.text for x in page]
    for leaf, label in zip(page, labels, strict=True):
        if rng.random() < 0.25:
            for _ in range(rng.randint(1, 4)):
                words = rng.choice(texts).split()
                foreign(" ".join(words[: rng.randint(1, 40)]), rng.random() < 0.5)
        if label:
            inner = tuple(x for x in leaf.path or () if x[0] not in ("html", "body", "article", "main", "section"))
            out.append(Leaf((*body, dress, *inner), leaf.text, leaf.linked))
        else:
            outer = next((x for x in leaf.path or () if x[0] not in ("html", "body", "article", "main", "div", "ul", "li") or x[1]), ("div", ()))
            if outer not in swap:
                swap[outer] = rng.choice(_OTHER[rng.choice(kinds)])
            out.append(Leaf((*body, swap[outer], *(x for x in leaf.path or () if x[0] in ("ul", "li", "p", "a"))), leaf.text, leaf.linked))
        marks.append(label)
    return out, marks


def labelled_pages() -> list[tuple[list[Leaf], list[int]]]:
    """Built-in labelled pages: blocks of every kind in every usual container."""
    rng, out = random.Random(5), []
    body = (("html", ()), ("body", ()))
    sentence = "The committee met on Monday and agreed on the plan for the coming year after a long debate."
    for dress in _ARTICLE:
        for _ in range(8):
            page, labels = [], []

            def add(path, text, label, linked=0, page=page, labels=labels):
                page.append(Leaf((*body, *path), text, linked))
                labels.append(label)

            def others(*kinds, within=(), add=add):
                for kind in kinds:
                    container = rng.choice(_OTHER[kind])
                    for _ in range(rng.randint(1, 4)):
                        text = {"menu": "Home", "footer": "© 2020 Example. All rights reserved.", "form": "Your name", "header": "Example Daily", "comments": "I fully agree with this, well said!"}.get(kind, rng.choice(["Read more about our offers.", sentence, "Buy now!", "Related"]))
                        leaf = (("ul", ()), ("li", ())) if kind == "menu" else rng.choice([(), (("p", ()),), (("div", ()),)])
                        add((*within, container, *leaf), text, 0, len(text) if kind in ("menu", "sidebar") else 0)

            others("header", "menu", "notice")
            add((dress, ("h1", ())), "A plan for the coming year", 1)
            for _ in range(rng.randint(1, 6)):
                add((dress, (rng.choice(["p", "p", "p", "blockquote", "h2", "li", "td", "pre", "div"]), ())), " ".join([sentence] * rng.randint(1, 4) if rng.random() < 0.6 else sentence.split()[: rng.randint(2, 12)]), 1)
                if rng.random() < 0.4:
                    others(rng.choice(list(_OTHER)), within=rng.choice([(), (dress,)]))
            others("comments", within=rng.choice([(), (dress,)]))
            others("sidebar", "form", "footer")
            out.append((page, labels))
    return out


def fit(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """The field, trained on the built-in pages and on a bounded sample of those that name their article."""
    n = pages.count()
    share = min(1.0, sample / max(n, 1))
    picked = pages.where(F.pmod(F.xxhash64("page_id", F.lit("label")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rng, training = random.Random(3), labelled_pages()
    rows = picked.select("page_id", F.col("html").cast("string").alias("html")).collect()  # about `sample` pages
    for row in sorted(rows, key=lambda r: (r.page_id is None, r.page_id, r.html or "")):
        page = leaves(row.html or "")
        if any(x.path and x.path.depth >= DEEPEST for x in page):
            continue
        labels = [named_label(x) for x in page]
        if any(labels):
            training += [(page, labels), redressed(page, labels, rng)]
    return Field().train(training)


def main_text(field: Field, html: str | None) -> str:
    page = leaves(html or "")
    return "\n".join(x.text for x, label in zip(page, field.decode(page), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = field or fit(pages)
    sent = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = sent.value
        for b in batches:
            texts = [main_text(field, html) for html in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_slices(rows, run, "page_id bigint, url string, text string, n_chars bigint", text="html")
