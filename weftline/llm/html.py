"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks (text between block-level boundaries). Features of a block are its ancestors' tags,
words of their class, id and role attributes, properties of its text and links, and of what stands beside it: the share of the
page's text and the share of links in the element around it, and whether that holds form controls. Text is measured in bytes and
marks, not in words, so that they mean the same in every script. The field has two labels, content and other; it is trained by
maximum likelihood (forward-backward gradients) on labelled pages and decoded by Viterbi. Cost is linear in the length of a page:
an element keeps only the features that no ancestor has, and its weights are summed once.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import values

#: HTML elements whose text is never shown as text.
HIDDEN = frozenset("script style template noscript head title textarea select option button iframe object svg math audio video canvas datalist".split())
#: HTML elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements; any other element bounds a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br".split())
#: Elements that an open p ends at.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that bound no block: inline ones, and hidden ones that stand in the middle of a text.
SEAMLESS = INLINE | {"script", "style", "template", "noscript"}
#: Elements that end an open element of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that can stand in head; any other ends an open head.
IN_HEAD = frozenset("head title base basefont bgsound link meta noframes noscript script style template".split())
#: HTML form controls.
CONTROLS = frozenset("button input select textarea".split())
#: Words that notices, adverts and forms use about themselves. They count beside form controls only: articles use them too.
CUES = frozenset("accept ads advertisement advertising comment comments consent cookies copyright cookie donate email follow login newsletter password policy privacy promotion register replies reply reserved rights share sign sponsored subscribe terms".split())
#: Hashed feature space: the bound on the model's size.
SPACE = 1 << 14
#: Labelled pages that the model is fitted on.
TRAINING_PAGES = 1500
#: Shares of the training pages whose article stands in containers that say nothing, that are bare text, that hold their
#: comments in the article, that lay their menu out in a table, that are the article and little else, whose paragraphs are no p
#: elements, that aren't in Latin script, whose article is a few words, and that are one form.
MASKED, BARE, NESTED, TABLED, ALONE, UNMARKED, OTHER_SCRIPTS, SHORT, WRAPPED = 0.3, 0.03, 0.12, 0.08, 0.08, 0.25, 0.35, 0.06, 0.03
#: Ranges of letters of the other scripts of the training pages, and whether they put spaces between words: Cyrillic, Greek, Arabic,
#: Devanagari, Hangul, Hiragana, Chinese.
SCRIPTS = ((0x430, 0x450, True), (0x3B1, 0x3CA, True), (0x627, 0x64B, True), (0x905, 0x93A, True), (0xAC00, 0xAD00, True), (0x3042, 0x3094, False), (0x4E00, 0x5200, False))
#: Attributes whose words name an element.
NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_TOKENS = re.compile(r"[a-z]{2,}")


@lru_cache(maxsize=100_000)
def _feature(name: str) -> int:
    h = 2166136261
    for b in name.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % SPACE


@lru_cache(maxsize=20_000)
def _element(tag: str, *names: str) -> tuple[int, ...]:
    """Features of an element: its tag and the words of its names."""
    return tuple({_feature(f"t={tag}"), *(_feature(f"c={x}") for name in names for x in _TOKENS.findall(name.lower()))})


class Node:
    """What an element adds to the features of its ancestors. Iterates over all of them, its own first."""

    __slots__ = ("new", "parent")

    def __init__(self, parent: Node | None, new: tuple[int, ...]):
        self.parent, self.new = parent, new

    def __iter__(self) -> Iterator[int]:
        node = self
        while node is not None:
            yield from node.new
            node = node.parent


class Box:
    """A block-level element: characters of text and of linked text in it and all it holds, and whether a form or form controls stand in it."""

    __slots__ = ("controls", "linked", "parent", "size")

    def __init__(self, parent: Box | None):
        self.parent, self.size, self.linked, self.controls = parent, 0, 0, False


class Block(NamedTuple):
    text: str
    #: Features of the elements it stands in.
    own: Iterable[int]
    #: The nearest block-level element.
    tag: str
    #: Characters inside links.
    linked: int
    #: The element that it stands in.
    box: Box | None = None


class _Open(NamedTuple):
    tag: str
    node: Node
    #: Its feature numbers, to be taken from the open ones when it ends.
    names: tuple[int, ...]
    box: Box
    hidden: bool
    link: bool
    block_tag: str


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.boxes = [Box(None)]
        self.stack = [_Open("", Node(None, ()), (), self.boxes[0], False, False, "")]
        # How many elements of a tag, and with a feature, are open.
        self.open: Counter[str] = Counter()
        self.active: Counter[int] = Counter()
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked, self.where = 0, self.stack[0]

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                box, linked = self.where.box, min(self.linked, len(text))
                box.size += len(text)
                box.linked += linked
                self.blocks.append(Block(text, self.where.node, self.stack[-1].block_tag, linked, box))
            self.text, self.linked = [], 0

    def finish(self) -> None:
        self.flush()
        for box in reversed(self.boxes):
            if box.parent is not None:
                box.parent.size += box.size
                box.parent.linked += box.linked

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and self.open["head"]:
            self.end_head()
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in SEAMLESS:
            self.flush()
            if tag in ENDS_P:
                self.close_to("p")
            for other in SIBLINGS.get(tag, ()):
                if self.stack[-1][0] == other:
                    self.cut(len(self.stack) - 1)
        top = self.stack[-1]
        if tag == "form" or (tag in CONTROLS and dict(attrs).get("type") != "hidden"):
            top.box.controls = True
        if tag in VOID:
            return
        node, box, own = top.node, top.box, ()
        if tag not in SEAMLESS:
            own = _element(tag, *[v for name, v in attrs if v and name in NAMING])
            new = tuple([x for x in own if not self.active[x]])
            for x in own:
                self.active[x] += 1
            node = Node(node, new) if new else node  # nested elements of a kind share one node
            if tag not in HIDDEN:
                box = Box(box)
                self.boxes.append(box)
        self.stack.append(_Open(tag, node, own, box, top.hidden or tag in HIDDEN, top.link or tag == "a", top.block_tag if tag in INLINE else tag))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br" and self.stack[-1][0] == tag and len(self.stack) > 1:
            self.handle_endtag(tag)

    def cut(self, at: int) -> None:
        for element in self.stack[at:]:
            self.open[element.tag] -= 1
            for x in element.names:
                self.active[x] -= 1
        del self.stack[at:]

    def close_to(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.cut(i)
                return
            if self.stack[i][0] in ("table", "td", "th") and tag == "p":
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in SEAMLESS:
            self.flush()
        self.close_to(tag)

    def end_head(self) -> None:
        """</head> may be left out; what stands in a title, template or noscript of head ends nothing."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == "head":
                self.cut(i)
                return
            if self.stack[i][0] in ("title", "template", "noscript", "svg", "math", "object"):
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():  # bare text can't stand in head either
            self.end_head()
        top = self.stack[-1]
        if not top.hidden:
            if not self.text:
                self.where = top
            self.text.append(data)
            if top.link:
                self.linked += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass


def blocks_of(html: str | None) -> list[Block]:
    """The leaf blocks, in page order."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.finish()
    return parser.blocks


def text_features(blocks: Sequence[Block]) -> list[list[int]]:
    """Feature numbers of each block, but for those of the elements that it stands in."""
    out, n = [], len(blocks)
    blocks = [Block(*b) for b in blocks]
    page = max(1, sum(len(b.text) for b in blocks))
    # Blocks of the same kind in the same element around them: mostly the paragraphs of one text, or the items of one menu.
    peers: defaultdict[tuple[Box, str], list[int]] = defaultdict(list)
    for b in blocks:
        if b.box is not None:
            peers[b.box.parent or b.box, b.tag].append(len(b.text))
    parts = {key: (sum(sizes), len(sizes)) for key, sizes in peers.items()}
    for k, (text, _, tag, linked, box) in enumerate(blocks):
        length, links = len(text), linked / len(text)
        size = len(text.encode("utf-8", "surrogatepass"))
        size = size if size < 2 * length else size * 3 // 4  # other scripts say as much in fewer characters
        long, end = min(8, size.bit_length() - 3), text[-1] in '.!?…:;。！？؟।"”»'
        names = [
            "bias",
            f"tag={tag}",
            f"len={long}",
            f"links={int(links * 4)}",
            f"words={min(4, text.count(' ').bit_length())}",
            f"end={end}",
            f"mark={text[0] in '©|»›•·'}",
            f"digits={sum(map(str.isdigit, text)) * 4 > length}",
            f"edge={'first' if k == 0 else 'last' if k == n - 1 else 'inner'}",
            f"tag={tag}&len={long}",
            f"end={end}&len={long}",
        ]
        if box is not None:
            around = box.parent or box
            (among, many), other = parts[around, tag], int(around.linked / max(1, around.size) * 4)
            share, many = int(among / page * 4), min(4, many.bit_length())
            controls = box.controls or around.controls
            names += [f"share={share}", f"beside={other}", f"share={share}&beside={other}", f"tag={tag}&share={share}", f"peers={many}", f"tag={tag}&peers={many}", f"controls={controls}"]
            if controls and size < 2000:
                names += {f"cue={x}" for x in _TOKENS.findall(text.lower()) if x in CUES}
        out.append([*map(_feature, names)])
    return out


def features(blocks: Sequence[Block]) -> list[list[int]]:
    """All feature numbers of each block."""
    return [[*b[1], *own] for b, own in zip(blocks, text_features(blocks), strict=True)]


def _log_sum(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


class _Page(NamedTuple):
    """A labelled page as the gradient wants it: its features, and for each feature of a block the place in them and the block."""

    features: np.ndarray
    places: np.ndarray
    blocks: np.ndarray
    starts: np.ndarray
    labels: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]], labels: list[int]) -> _Page:
        sizes, y, pairs = np.array([len(r) for r in rows]), np.asarray(labels), np.zeros((2, 2))
        at, places = np.unique([x for r in rows for x in r], return_inverse=True)
        np.add.at(pairs, (y[:-1], y[1:]), 1)
        return cls(at, places, np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes) - sizes, y, pairs)


class Crf:
    """Two labels: 0 other, 1 content."""

    def __init__(self):
        self.w, self.t = np.zeros((SPACE, 2)), np.zeros((2, 2))
        self._odds: list[float] | None = None

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((x for r in rows for x in r), np.int64)
        starts = np.cumsum([0, *map(len, rows[:-1])])
        return np.add.reduceat(self.w[flat], starts, axis=0)

    def fit(self, pages: Sequence[tuple[list[list[int]], list[int]]], epochs: int = 12, rate: float = 0.15, decay: float = 1e-5) -> Crf:
        """Stochastic gradient ascent with AdaGrad steps on the conditional log-likelihood."""
        gw, gt, rng = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2), np.random.default_rng(1)
        ready = [_Page.of(rows, labels) for rows, labels in pages if rows]
        for _ in range(epochs):
            for p in rng.permutation(len(ready)):
                page = ready[p]
                e = np.add.reduceat(self.w[page.features][page.places], page.starts, axis=0)
                (t00, t01), (t10, t11) = self.t.tolist()
                ahead, behind, plain = [e[0].tolist()], [[0.0, 0.0]], e.tolist()
                for e0, e1 in plain[1:]:
                    x, y = ahead[-1]
                    ahead.append([e0 + _log_sum(x + t00, y + t10), e1 + _log_sum(x + t01, y + t11)])
                for e0, e1 in plain[:0:-1]:
                    x, y = behind[-1]
                    behind.append([_log_sum(t00 + e0 + x, t01 + e1 + y), _log_sum(t10 + e0 + x, t11 + e1 + y)])
                a, b = np.array(ahead), np.array(behind[::-1])
                z = _log_sum(*ahead[-1])
                # One label's gradient is the other's with the sign turned.
                step = (page.labels - np.exp(a[:, 1] + b[:, 1] - z))[page.blocks]
                total = np.bincount(page.places, step)
                total = np.stack([-total, total], 1) - decay * self.w[page.features]
                gw[page.features] += total**2
                self.w[page.features] += rate * total / np.sqrt(gw[page.features])
                if len(plain) > 1:
                    pair = np.exp(a[:-1, :, None] + self.t[None] + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0)
                    gt += (page.pairs - pair) ** 2
                    self.t += rate * (page.pairs - pair) / np.sqrt(gt)
        return self

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most probable labels (Viterbi); ties go to content."""
        if not rows:
            return []
        return self.best(self.scores(rows).tolist())

    def decode_blocks(self, blocks: Sequence[Block]) -> list[int]:
        """The same from blocks: the weights of an element are summed once, for all that stands in it."""
        if not blocks:
            return []
        odds = self.odds()
        sums: dict[Node | None, float] = {None: 0.0}
        scores = []
        for block, own in zip(blocks, text_features(blocks), strict=True):
            path, node = [], block.own
            while node not in sums:
                path.append(node)
                node = node.parent
            total = sums[node]
            for x in reversed(path):
                for f in x.new:
                    total += odds[f]
                sums[x] = total
            scores.append((0.0, total + sum([odds[f] for f in own])))
        return self.best(scores)

    def odds(self) -> list[float]:
        """How much each feature speaks for content; only differences between the labels matter to decoding."""
        if self._odds is None:
            self._odds = (self.w[:, 1] - self.w[:, 0]).tolist()
        return self._odds

    def best(self, e: Sequence[Sequence[float]]) -> list[int]:
        t = self.t.tolist()
        (x, y), back = e[0], []
        for e0, e1 in e[1:]:
            back.append((int(y + t[1][0] >= x + t[0][0]), int(y + t[1][1] >= x + t[0][1])))
            x, y = e0 + max(x + t[0][0], y + t[1][0]), e1 + max(x + t[0][1], y + t[1][1])
        labels = [int(y >= x)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 3) -> Iterator[tuple[str, list[str]]]:
    """(html, texts of its content blocks): training pages of common layouts, written from scratch with invented words."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ser", "tan", "vo", "ri", "del", "un", "pra", "sho", "be"]
    cues = sorted(CUES)
    script: tuple[int, int, bool] | None = None

    def name_word() -> str:
        return "".join(rng.choices(syllables, k=rng.randrange(1, 5)))

    def word() -> str:
        if script is None:
            return name_word() if rng.random() > 0.004 else rng.choice(cues)
        return "".join(chr(rng.randrange(script[0], script[1])) for _ in range(rng.randrange(1, 8 if script[2] else 3)))

    def phrase(lo: int, hi: int) -> str:
        return ("" if script and not script[2] else " ").join(word() for _ in range(rng.randrange(lo, hi)))

    def sentence() -> str:
        if script and not script[2]:
            return phrase(4, 22) + rng.choice(["。", "。", "。", "！", "？", ""])
        return phrase(4, 22).capitalize() + rng.choice([".", ".", ".", "!", "?", "", "!!", " |", "###"])

    def paragraph() -> str:
        return ("" if script and not script[2] else " ").join(sentence() for _ in range(rng.randrange(1, 8)))

    def appeal() -> str:
        """What a notice says: a sentence or two with words of its kind."""
        return " ".join(f"{phrase(1, 6)} {rng.choice(cues)} {phrase(1, 8)}." for _ in range(rng.randrange(1, 4))).capitalize()

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{name_word()}">{phrase(1, 4)}</a></li>' for _ in range(k))

    def any_of(*x: str) -> str:
        return rng.choice(x)

    def thread(said: str) -> str:
        name = any_of("comments", "comment-list", "replies", "responses", "thread", "discussion", "reader-comments", "user-comments", "reactions", "feedback", "disqus_thread", "respond")
        title = any_of("", "", f"<h3>{phrase(1, 3)}</h3>", "<h2>Comments</h2>")
        return any_of('<section class="{0}">{1}</section>', '<div id="{0}">{1}</div>', '<div class="{0}">{1}</div>', '<ol class="{0}">{1}</ol>', '<section id="{0}">{1}</section>').format(name, title + said)

    for _ in range(n):
        content: list[str] = []
        script = SCRIPTS[rng.randrange(len(SCRIPTS))] if rng.random() < OTHER_SCRIPTS else None
        para = "<p>{}</p>"
        if rng.random() < UNMARKED:
            para = any_of("<div>{}</div>", "<div>{}</div>", f'<div class="{name_word()}">{{}}</div>', '<div class="paragraph">{}</div>', "<section>{}</section>", "<div><span>{}</span></div>", "<div><div>{}</div></div>")

        def put(text: str, own=content) -> str:
            own.append(text)
            return text

        def body(put=put) -> str:
            out = [f"<h1>{put(phrase(2, 10))}</h1>"] if rng.random() < 0.85 else []
            if rng.random() < SHORT:
                return "".join(out) + any_of("<p>{}</p>", "<p><b>{}<br>", para).format(put(phrase(1, 5).capitalize() + any_of(".", "")))
            for _ in range(rng.randrange(1, 12)):
                kind = rng.random()
                if kind < 0.62:
                    out.append(para.format(put(paragraph() if rng.random() < 0.95 else appeal())))
                elif kind < 0.70:
                    out.append(f"<p><b>{put(paragraph())}<br>")
                elif kind < 0.76:
                    out.append(f"<h{rng.randrange(2, 5)}>{put(phrase(1, 7))}</h2>")
                elif kind < 0.82:
                    kind_of = any_of("ul", "ol", "ol")
                    out.append(f"<{kind_of}>" + "".join(f"<li>{put(any_of(sentence(), phrase(1, 6), paragraph()))}</li>" for _ in range(rng.randrange(1, 6))) + f"</{kind_of}>")
                elif kind < 0.87:
                    out.append(f"<blockquote>{put(paragraph())}</blockquote>")
                elif kind < 0.91:
                    out.append(any_of("<pre>{}</pre>", "<pre><code>{}</code></pre>", '<div class="highlight"><pre>{}</pre></div>').format(put(any_of(phrase(3, 20), f"{phrase(1, 4)} = {name_word()}({name_word()});"))))
                elif kind < 0.95:
                    out.append("<table>" + "".join(f"<tr><td>{put(phrase(1, 4))}<td>{put(str(rng.randrange(1, 9999)))}" for _ in range(rng.randrange(1, 4))) + "</table>")
                else:
                    a, b, c = phrase(2, 9), phrase(1, 3), phrase(2, 9)
                    put(f"{a} {b} {c}")
                    out.append(f'<p>{a} <a href="/{name_word()}">{b}</a> {c}</p>')
                if rng.random() < 0.06:
                    out.append(f'<div class="{any_of("ad", "advert", "ads", "promo", "sponsored", "banner ad")}">{paragraph()}</div>')
                if rng.random() < 0.05:
                    control = any_of("<form><input type=email><button>{}</button></form>", "<button>{}</button>").format(word())
                    out.append(f'<div class="{any_of(name_word(), "box", "c4")}">{any_of("<p>{}</p>", "{}").format(appeal())}{control}</div>')
                if rng.random() < 0.04:
                    out.append(f'<aside class="{any_of("related", "pullout", "sidebar", "share")}"><ul>{links(2)}</ul>{sentence()}</aside>')
            return "\n".join(out)

        head = f"<head><title>{phrase(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        menu = any_of("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<header><nav class="main-menu">{}</nav></header>', '<div role="navigation">{}</div>', '<ul class="breadcrumb">{}</ul>')
        parts = [menu.format(f"<ul>{links(rng.randrange(2, 9))}</ul>")]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(0, 2), any_of('<header class="site-header">{}</header>', '<div id="header">{}</div>', "<header>{}</header>", '<div class="masthead">{}</div>').format(f"<p>{any_of(phrase(1, 5), sentence())}</p>"))
        if rng.random() < 0.6:
            parts.append(f'<!-- ad --><div class="{any_of("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner")}">{any_of(sentence(), paragraph())}</div>')
        if rng.random() < 0.35:
            parts.append(f'<div class="{any_of("cookie-notice", "notice", "cookie", "consent", "alert", "popup", "gdpr", "newsletter", "modal")}">{any_of(sentence(), f"<p>{paragraph()}</p>")}</div>')
        if rng.random() < 0.15:
            control = any_of("<button>{}</button>", "<input type=button value={}>").format(name_word())
            notice = f'<div class="{any_of(name_word(), f"x{rng.randrange(99)}", "bar", "box", "inner", "row")}">{any_of("<p>{}</p>", "{}", "<div>{}</div>").format(appeal())}{control}</div>'
            parts.insert(rng.randrange(0, len(parts) + 1), notice)
        if rng.random() < BARE:
            yield "\n\n".join([put(paragraph())]), content
            continue
        masked, name = rng.random() < MASKED, any_of(f"c{rng.randrange(1, 99)}", name_word(), f"css-{rng.randrange(1, 9999)}", "row", "col", "inner", "box", "wrap")
        main = any_of("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="article-body">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<section class="story">{}</section>', '<article class="post"><section>{}</section></article>')
        if masked:
            main = any_of("{}", "<div>{}</div>", f'<div class="{name}">{{}}</div>', f'<div id="{name}"><div>{{}}</div></div>', f'<div class="{name_word()}"><div class="{name}">{{}}</div></div>', "<center>{}</center>")
        article = body()
        if rng.random() < NESTED:
            said = "".join(any_of("<p>{}</p>", '<div class="comment">{}</div>', "<li>{}</li>").format(any_of(sentence(), paragraph())) for _ in range(rng.randrange(1, 4)))
            article += thread(said)
        if rng.random() < TABLED:
            cell = "<br>".join(f'<a href="/{name_word()}">{phrase(1, 3).capitalize()}</a>' for _ in range(rng.randrange(2, 7)))
            parts = [f"<table><tr><td>{cell}</td><td>{main.format(article)}</td></tr></table>"]
        else:
            parts.append(main.format(article))
        tail = []
        if rng.random() < 0.45:
            tail.append(any_of("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<aside class="related">{}</aside>', '<div class="widget">{}</div>', '<section class="related-posts">{}</section>').format(any_of(f"<ul>{links(4)}</ul>", f"<p>{paragraph()}</p>", f"<h3>{phrase(1, 4)}</h3><p>{sentence()}</p>")))
        if rng.random() < 0.4:
            tail.append(thread("".join(any_of("<p>{}</p>", "<li>{}</li>", '<div class="comment">{}</div>', "<div>{}</div>", '<div class="reply"><b>A</b><p>{}</p></div>').format(any_of(paragraph(), sentence())) for _ in range(rng.randrange(1, 5)))))
        if rng.random() < 0.3:
            tail.append(any_of("<form>{}</form>", '<form class="search">{}</form>', '<form id="subscribe">{}</form>').format(f"<label>{phrase(1, 4)}</label><input><p>{sentence()}</p><button>{word()}</button>"))
        alone = rng.random() < ALONE
        if alone:
            parts, tail = [main.format(article)], tail[: rng.randrange(0, 2)]
        for x in tail:
            if rng.random() < 0.2:
                parts.insert(rng.randrange(0, len(parts)), x)
            else:
                parts.append(x)
        if rng.random() < 0.9 and not alone:
            parts.append(any_of("<footer>{}</footer>", "<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<footer class="site-footer"><p>{}</p></footer>').format(any_of(f"&copy; {word()} &middot; {paragraph()}", sentence(), paragraph(), f"<ul>{links(3)}</ul>")))
        wrap = '<form id="form" method="post">{}</form>' if rng.random() < WRAPPED else any_of("{}", "{}", '<div class="page">{}</div>', '<div id="wrapper"><div class="container">{}</div></div>')
        yield f"<!DOCTYPE html><html>{head}<body>{wrap.format(''.join(parts))}</body></html>", content


@lru_cache(maxsize=4)
def trained_model(pages: int = TRAINING_PAGES, seed: int = 3) -> Crf:
    """The field fitted on ``pages`` labelled pages (the documented bound of its training sample)."""
    sample = []
    for html, content in labelled_pages(pages, seed):
        blocks, left = blocks_of(html), [" ".join(c.split()) for c in content]
        labels = []
        for text, *_ in blocks:
            labels.append(int(text in left))
            if labels[-1]:
                left.remove(text)
        sample.append((features(blocks), labels))
    return Crf().fit(sample)


def main_text(html: str | None, model: Crf) -> str:
    """Content blocks in page order, one line each; null, empty and contentless pages give an empty string."""
    blocks = blocks_of(html)
    return "\n".join(b[0] for b, y in zip(blocks, model.decode_blocks(blocks), strict=True) if y)


def extract_main_text(pages: DataFrame, html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """``pages`` with the columns text and n_chars (its code points) in place of ``html_col`` and of columns so named.

    Null html counts as empty. Broken markup is read as far as it goes; a page of any length or depth is read whole, in linear time.
    Repeated rows stay. Ties between labels go to content. Other columns, null or not, pass through.
    """
    model = model or trained_model()
    sent = pages.sparkSession.sparkContext.broadcast((model.w, model.t))
    rows = pages.drop(*{"text", "n_chars"} - {html_col})
    at = rows.columns.index(html_col)
    names = [c for c in rows.columns if c != html_col] + ["text", "n_chars"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf()
        own.w, own.t = sent.value
        for batch in batches:
            found = [main_text(x, own) for x in values(batch.column(at))]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*rest, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names)

    schema = rows.drop(html_col).withColumns({"text": F.lit("x"), "n_chars": F.lit(1).cast("long")}).schema
    return rows.mapInArrow(extract, schema)
