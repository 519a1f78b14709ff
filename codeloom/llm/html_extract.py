"""Main text of web pages by a linear-chain conditional random field.

A page is cut into its leaf blocks in order. Each block is described by the tags,
classes and roles of its ancestors and by the shape of its text, and the chain is
labelled main or boilerplate by Viterbi decoding. Weights are learnt by maximising
the likelihood of labelled pages, which a rule composes from layout parts whose
labels are known (``labelled_pages``); other labelled pages can be passed instead.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names by how a browser lays them out.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second starts.
ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name, up to its end: quotes after an equals sign may hold the closing mark.
REST = re.compile(r"(?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+>")
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in ("script", "style")}
#: Elements that are open at once; what is nested deeper counts as a child of the last one, as in browsers.
MOST_OPEN = 512
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Path:
    """An element and those around it. Equal paths of one root are one object, which also keeps what a model makes of them."""

    __slots__ = ("parent", "tag", "attributes", "below", "known", "own", "near", "score")

    def __init__(self, parent: Path | None = None, tag: str = "", attributes: str = ""):
        self.parent, self.tag, self.attributes = parent, tag, attributes
        self.below: dict[tuple[str, str], Path] = {}
        self.score: np.ndarray | None = None

    def child(self, tag: str, attributes: str) -> Path:
        found = self.below.get((tag, attributes))
        if found is None:
            found = self.below[tag, attributes] = Path(self, tag, attributes)
        return found

    def block(self) -> Path:
        """The nearest element that isn't inline, or the root."""
        at = self
        while at.parent is not None and at.tag not in BLOCK_TAGS:
            at = at.parent
        return at


class Block(NamedTuple):
    path: Path
    text: str
    linked: int


#: For each element, the open elements that its start may end.
ENDS = {tag: frozenset({n for n, by in ENDED_BY.items() if tag in by} | ({"p"} if tag not in ("button", "label", "iframe", "noscript", "select", "textarea") else set())) for tag in BLOCK_TAGS}
#: Elements whose inside an implied end doesn't leave.
BOUNDS = frozenset("table ul ol dl select div article section td main body".split())


class Reader:
    """The state of reading a page: open elements, and the text since the last block."""

    def __init__(self, root: Path):
        self.top, self.stack, self.out = root, [], []
        self.open: dict[str, int] = {}
        self.deeper: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0

    def text(self, text: str) -> None:
        self.parts.append(text)
        if self.open.get("a"):
            self.linked += len(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.out.append(Block(self.top, text, self.linked))
            self.parts.clear()
        self.linked = 0

    def close(self, at: int) -> None:
        """End the open elements from place ``at`` on."""
        if any(p.tag in BLOCK_TAGS for p in self.stack[at:]):
            self.flush()
        for p in self.stack[at:]:
            self.open[p.tag] -= 1
        self.top = self.stack[at].parent
        del self.stack[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK_TAGS:
            self.flush()
        if tag in VOID_TAGS:
            return
        ended = ENDS.get(tag, ())
        if any(self.open.get(n) for n in ended):
            for at in range(len(self.stack) - 1, -1, -1):
                name = self.stack[at].tag
                if name in ended:
                    self.close(at)
                    break
                if name in BOUNDS:
                    break
        if attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            return
        if len(self.stack) >= MOST_OPEN:
            self.deeper[tag] = self.deeper.get(tag, 0) + 1
            return
        self.top = self.top.child(tag, attributes)
        self.stack.append(self.top)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in VOID_TAGS:
            if tag == "br":
                self.parts.append(" ")
        elif self.deeper.get(tag):
            self.deeper[tag] -= 1
            if tag in BLOCK_TAGS:
                self.flush()
        elif self.open.get(tag):
            self.close(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag))
        elif tag in BLOCK_TAGS:
            self.flush()


def blocks(page: str, root: Path | None = None) -> list[Block]:
    """The leaf blocks that have text, in order: path, text with single spaces, characters in links.

    One pass. A tag that quotes keep open to the end of the page is read again without
    regard to quotes, as are all that follow it; a mark that starts no tag is text.
    """
    read = Reader(root or Path())
    at, last, quotes = 0, page.rfind(">"), True
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            read.text(page[at:])
            break
        if mark > at:
            read.text(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            if end < 0:
                break
            at = end + 3
            continue
        if mark > last:
            read.text(page[mark])
            at = mark + 1
            continue
        if page.startswith(("<!", "<?"), mark):
            at = page.index(">", mark) + 1
            continue
        closing = page.startswith("</", mark)
        name = NAME.match(page, mark + 1 + closing)
        if not name:
            read.text("<")
            at = mark + 1
            continue
        tag, begin = name[0].lower(), name.end()
        rest = REST.match(page, begin) if quotes else None
        if rest:
            at = rest.end()
        else:
            quotes = False
            at = page.index(">", begin - 1 if page[begin - 1] == ">" else begin) + 1
        if tag in RAW_END and not closing:
            end = RAW_END[tag].search(page, at)
            if not end:
                break
            at = end.end()
        elif closing:
            read.end(tag)
        else:
            read.start(tag, page[begin : at - 1])
    read.flush()
    return read.out


def element_names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, the parts of class and id names, the role, and whether it is hidden, once each; those of ordinary length are kept at hand."""
    return (short_names if len(attributes) <= 4096 else all_names)(tag, attributes)


def all_names(tag: str, attributes: str) -> tuple[str, ...]:
    names = [tag]
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            names += [f".{x.lower()}" for x in NAME_PARTS.findall(value)]
        elif name == "role":
            names.append(f"role={value.lower()}")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            names.append("hidden")
    return tuple(dict.fromkeys(names))


short_names = lru_cache(maxsize=50_000)(all_names)


def path_features(path: Path) -> list[str]:
    """Names of all ancestors, and of the nearest ones with their distance; inline elements don't count."""
    found, near, at = set(), 0, path
    while at.parent is not None:
        if at.tag in BLOCK_TAGS:
            for name in element_names(at.tag, at.attributes):
                found.add(name)
                if near < 4:
                    found.add(f"{near}:{name}")
            near += 1
        at = at.parent
    return sorted(found)


CUES = {
    "rights": re.compile(r"©|\(c\)|copyright|all rights reserved", re.I),
    "notice": re.compile(r"\bcookies?\b|\bconsent\b|privacy policy|terms of (?:use|service)", re.I),
    "offer": re.compile(r"\badvert|sponsored|subscribe|newsletter|sign up|log in|buy now", re.I),
    "reply": re.compile(r"\breply\b|\bcomments?\b", re.I),
}


def text_features(block: Block) -> list[str]:
    """Length, link share, closing mark and telling words."""
    text = block.text
    words = text.count(" ") + 1
    share = min(block.linked / len(text), 1)
    found = [f"words={min(words.bit_length(), 7)}", f"links={round(share * 4)}", f"stop={text[-1] in '.!?:;'}"]
    if words < 60:
        found += [cue for cue, pattern in CUES.items() if pattern.search(text)]
    return found


def chain_features(chain: list[Block]) -> list[list[str]]:
    """For each block: its text's features, the length and links of its neighbours, and the share of the page's unlinked text beside it under one element."""
    own = [text_features(b) for b in chain]
    around = ["none", *("/".join(f[:2]) for f in own), "none"]
    holders = [p.parent or p for p in (b.path.block() for b in chain)]
    plain = [max(len(b.text) - b.linked, 0) for b in chain]
    sums: dict[int, int] = {}
    for h, n in zip(holders, plain, strict=True):
        sums[id(h)] = sums.get(id(h), 0) + n
    total = max(sum(plain), 1)
    return [[*f, f"before={around[i]}", f"after={around[i + 2]}", f"held={round(sums[id(h)] / total * 4)}"] for i, (f, h) in enumerate(zip(own, holders, strict=True))]


class Model(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label before x label
    first: np.ndarray


def summed(model: Model, names: list[str]) -> np.ndarray:
    known = [i for n in names if (i := model.index.get(n)) is not None]
    return model.weights[known].sum(axis=0) if known else np.zeros(2)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 100, rate: float = 0.3, penalty: float = 3e-4) -> Model:
    """Maximise the regularised likelihood of the label chains by adaptive gradient steps over all pages."""
    described = [[["bias", *path_features(b.path), *f] for b, f in zip(chain, chain_features(chain), strict=True)] for chain, _ in pages]
    index = {name: i for i, name in enumerate(sorted({n for page in described for b in page for n in b}))}
    rows = [[np.array([index[n] for n in b]) for b in page] for page in described]
    flat = np.concatenate([r for page in rows for r in page])
    owner = np.repeat(np.arange(sum(map(len, rows))), [len(r) for page in rows for r in page])
    # Chains are padded to one length, and forward and backward sums run over all of them at once.
    lengths = np.array([len(y) for _, y in pages])
    chains, longest = len(pages), int(lengths.max(initial=0))
    there = np.arange(longest)[None, :] < lengths[:, None]
    truth = np.zeros((chains, longest, 2))
    truth[there] = np.eye(2)[np.concatenate([np.array(y, int) for _, y in pages])]
    weights, moves, first = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    memory = [np.full_like(x, 1e-2) for x in (weights, moves, first)]
    for _ in range(rounds):
        state = np.zeros((int(lengths.sum()), 2))
        for label in (0, 1):
            state[:, label] = np.bincount(owner, weights[flat, label], len(state))
        s = np.zeros((chains, longest, 2))
        s[there] = state
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = first + s[:, 0]
        for t in range(1, longest):
            on = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + s[:, t]
            forward[:, t] = np.where(there[:, t, None], on, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back = np.logaddexp.reduce(moves + (s[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], back, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        p = np.where(there[..., None], np.exp(forward + backward - total[:, None, None]), 0)
        pairs = np.exp(forward[:, :-1, :, None] + moves + (s + backward)[:, 1:, None, :] - total[:, None, None, None])
        pairs = np.where(there[:, 1:, None, None], truth[:, :-1, :, None] * truth[:, 1:, None, :] - pairs, 0)
        error = (truth - p)[there]
        g_weights = np.stack([np.bincount(flat, error[owner, label], len(index)) for label in (0, 1)], axis=1)
        for x, g, m in zip((weights, moves, first), (g_weights, pairs.sum(axis=(0, 1)), (truth - p)[:, 0].sum(axis=0)), memory, strict=True):
            g = g - penalty * chains * x
            m += g * g
            x += rate * g / np.sqrt(m)
    return Model(index, weights, moves, first)


def decode(scores: list[np.ndarray], model: Model) -> list[int]:
    """The likeliest labels of a chain."""
    if not scores:
        return []
    (m00, m01), (m10, m11) = model.moves.tolist()
    a, b = (model.first + scores[0]).tolist()
    back = []
    for s0, s1 in scores[1:]:
        back.append((a + m00 < b + m10, a + m01 < b + m11))
        a, b = max(a + m00, b + m10) + s0, max(a + m01, b + m11) + s1
    label = int(b > a)
    labels = [label]
    for choice in reversed(back):
        label = int(choice[label])
        labels.append(label)
    return labels[::-1]


class Extractor:
    """Applies a model; what paths and texts' shapes add to the scores is remembered within a task."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most = model, most
        self.shapes: dict[str, np.ndarray] = {}
        self.bias = summed(model, ["bias"])

    def root(self) -> Path:
        root = Path()
        root.known, root.own, root.near, root.score = frozenset(), np.zeros(2), (), self.bias
        return root

    def path_score(self, path: Path) -> np.ndarray:
        """The sum of the weights of ``path_features``, from those of the parent."""
        todo = []
        while path.score is None:
            todo.append(path)
            path = path.parent
        for p in reversed(todo):
            above = p.parent
            p.known, p.own, p.near, p.score = above.known, above.own, above.near, above.score
            if p.tag in BLOCK_TAGS:
                names = element_names(p.tag, p.attributes)
                new = [n for n in names if n in self.model.index and n not in above.known]
                if new:
                    p.known, p.own = above.known.union(new), above.own + summed(self.model, new)
                p.near = (names, *above.near[:3])
                p.score = self.bias + p.own + summed(self.model, [f"{i}:{n}" for i, found in enumerate(p.near) for n in found])
            path = p
        return path.score

    def scores(self, chain: list[Block]) -> list[np.ndarray]:
        found = []
        for b, features in zip(chain, chain_features(chain), strict=True):
            score = self.path_score(b.path)
            for f in features:
                if (one := self.shapes.get(f)) is None:
                    one = self.shapes[f] = summed(self.model, [f])
                score = score + one
            found.append(score)
        return found

    def main_text(self, page: str | None) -> str:
        chain = blocks(page or "", self.root())
        return "\n\n".join(b.text for b, label in zip(chain, decode(self.scores(chain), self.model), strict=True) if label)


#: Names that layouts give to the parts of a page.
MAIN_NAMES = "content article post entry story main text body post-content entry-content article-body story-body page-content main-content".split()
PART_NAMES = {
    "menu": "nav navbar menu navigation main-menu breadcrumb breadcrumbs topnav nav-links pagination pager toc".split(),
    "header": "header masthead site-header banner topbar logo branding page-header".split(),
    "footer": "footer site-footer copyright legal bottom colophon footer-links".split(),
    "sidebar": "sidebar aside widget rail secondary related recommended trending popular side-column".split(),
    "notice": "cookie cookie-banner consent notice gdpr alert privacy-notice modal popup overlay".split(),
    "advert": "ad ads advert advertisement sponsored promo banner-ad ad-slot sponsor adsense".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form".split(),
    "comments": "comments comment comment-list replies respond discussion disqus reviews".split(),
    "share": "share social sharing share-buttons tags tag-list".split(),
}
PART_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "div", "advert": "div", "form": "form", "comments": "section", "share": "div"}
SYLLABLES = "ba ren ti lo mar sen du ka vel on er ist pa que ment ion al us die ach".split()


def labelled_pages(count: int = 800, seed: int = 5, names: dict[str, list[str]] | None = None, main_names: list[str] | None = None, plain: float = 0.25) -> list[tuple[list[Block], list[int]]]:
    """Pages composed of parts with known labels, as blocks and labels; headings and texts of the article are main.

    A share ``plain`` of the pages has no telling tags or names, only the shapes of texts and where they lie.
    """
    pick = random.Random(seed)
    mark = "\x02"
    part_names, main_names = names or PART_NAMES, main_names or MAIN_NAMES

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(low, high)))

    def sentence(low: int = 4, high: int = 60) -> str:
        return words(low, high).capitalize() + pick.choice(["."] * 8 + ["!", "?", "", ","])

    def wrapped(tag: str, names: list[str], inner: str) -> str:
        kind = pick.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{pick.choice(names)}">{inner}</{tag}>' if names else f"<{tag}>{inner}</{tag}>"

    def part(kind: str, named: bool | None = None) -> str:
        named = pick.random() < 0.6 if named is None else named
        named_here = PART_TAGS[kind] == "div" or named
        tag = pick.choice([PART_TAGS[kind], "div"]) if named else PART_TAGS[kind]
        if kind in ("menu", "share") or kind in ("footer", "sidebar", "header") and pick.random() < 0.4:
            inner = "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(pick.randint(2, 8))) + "</ul>"
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + (f"<p>{sentence(3, 20)}</p>" if pick.random() < 0.5 else "")
        elif kind == "comments":
            level = pick.choice("2334")
            inner = (f"<h{level}>{words(1, 3)}</h{level}>" if pick.random() < 0.6 else "") + "".join(wrapped(pick.choice(["div", "article", "li"]), pick.choice([["comment", "reply", "comment-body"], []]), f"<p>{sentence(3, 60)}</p>") for _ in range(pick.randint(1, 5)))
        elif kind == "footer" and pick.random() < 0.6:
            inner = f"&copy; {words(1, 3)} &middot; {sentence(2, 20)}"
        elif kind == "header":
            inner = pick.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<a href='/'>{words(1, 3)}</a>"])
        else:
            inner = pick.choice([sentence(2, 40), f"<p>{sentence(2, 40)}</p>", f"<h{(level := pick.choice('234'))}>{words(1, 3)}</h{level}><p>{sentence(2, 30)}</p>", f'<a href="/y">{sentence(2, 12)}</a>'])
        return wrapped(tag, part_names[kind] if named_here else [], inner)

    def article() -> str:
        body = [f"<h1>{mark}{words(1, 10)}</h1>"] if pick.random() < 0.8 else []
        for _ in range(pick.randint(0 if body else 1, 9)):
            r = pick.random()
            if r < 0.7:
                inner = mark + sentence(1, 120)
                body.append(pick.choice([f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}<br>"]))
            elif r < 0.78:
                body.append(f"<h2>{mark}{words(1, 6)}</h2>")
            elif r < 0.84:
                body.append("<ul>" + "".join(f"<li>{mark}{sentence(2, 20)}</li>" for _ in range(pick.randint(2, 4))) + "</ul>")
            elif r < 0.88:
                body.append(f"<blockquote>{mark}{sentence()}</blockquote>")
            elif r < 0.9:
                body.append("<table><tr>" + "".join(f"<td>{mark}{words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                body.append(part(pick.choice(["advert", "share", "sidebar", "form", "notice", "comments", "header", "menu"])))
        inner = "".join(body)
        style = pick.random()
        if style < 0.03:
            return inner
        if style < 0.4:
            return f"<article>{inner}</article>"
        if style < 0.55:
            return f"<main>{inner}</main>"
        if style < 0.65:
            return f"<main><article>{inner}</article></main>"
        if style < 0.75:
            return wrapped("article", main_names, inner)
        return wrapped(pick.choice(["div", "div", "section"]), main_names, inner)

    def noise(inner: str) -> str:
        name = "".join(pick.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(pick.randint(1, 6)))
        return pick.choice([f'<div class="{name}">{inner}</div>', f"<div>{inner}</div>", f'<div id="{name}">{inner}</div>', f'<section class="{name}">{inner}</section>'])

    def plain_page() -> str:
        """Divisions without telling names: links, notices and forms around headings and sentences."""
        def small() -> str:
            kind = pick.random()
            if kind < 0.4:
                each = pick.choice(["<a href=/x>{}</a> ", "<div><a href=/x>{}</a></div>", "<ul><li><a href=/x>{}</a></ul>"])
                return noise("".join(each.format(words(1, 4)) for _ in range(pick.randint(2, 8))))
            if kind < 0.55:
                return noise(f"&copy; {words(1, 3)}. {pick.choice(['All rights reserved.', words(1, 5), ''])}")
            if kind < 0.7:
                return noise(f"<form>{words(1, 3)}<input name=q><button>{words(1, 2)}</button></form>")
            if kind < 0.85:
                return noise(pick.choice(["We use cookies. ", "Subscribe to our newsletter. ", "Advertisement. ", "Privacy policy. "]) + words(0, 6))
            return noise(words(1, 3))

        tag = pick.choice(["p", "div", "div"])
        body = [noise(f"<h1>{mark}{words(1, 10)}</h1>") if pick.random() < 0.2 else f"<h1>{mark}{words(1, 10)}</h1>"] if pick.random() < 0.85 else []
        for _ in range(pick.randint(1, 9)):
            body.append(f"<{tag}>{mark}{sentence(8, 120)}</{tag}>" if pick.random() < 0.85 else pick.choice([f"<h2>{mark}{words(1, 6)}</h2>", f"<{tag}>{mark}{sentence(1, 8)}</{tag}>"]))
        core = noise("".join(body))
        around = [small() for _ in range(pick.randint(0, 3))], [small() for _ in range(pick.randint(0, 3))]
        whole = "".join(around[0]) + core + "".join(around[1])
        return noise(whole) if pick.random() < 0.4 else whole

    out = []
    for _ in range(count):
        if pick.random() < plain:
            found = blocks(f"<html><head><title>{words(1, 10)}</title></head><body>{plain_page()}</body></html>")
            out.append(([b._replace(text=b.text.replace(mark, "")) for b in found], [int(mark in b.text) for b in found]))
            continue
        before = [part(k) for k in ("menu", "header", "notice", "advert", "form", "sidebar") if pick.random() < 0.4]
        after = [part(k) for k in ("comments", "share", "sidebar", "advert", "notice", "form", "menu", "footer") if pick.random() < 0.4]
        pick.shuffle(before)
        head = f"<head><title>{words(1, 10)}</title></head>"
        core = article()
        if pick.random() < 0.3:
            core = wrapped("div", ["container", "wrapper", "row", "page", "site", "layout"], core + "".join(after[:2]))
            after = after[2:]
        if pick.random() < 0.02:  # no markup at all
            head, before, core, after = "", [], mark + sentence(5, 80), []
        whole = f"<html>{head}<body>{''.join(before)}{core}{''.join(after)}</body></html>"
        found = blocks(whole if head else core)
        out.append(([b._replace(text=b.text.replace(mark, "")) for b in found], [int(mark in b.text) for b in found]))
    return [([b for b in chain if b.text], [y for b, y in zip(chain, labels, strict=True) if b.text]) for chain, labels in out]


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Learnt from ``labelled_pages``, once in a driver's life; it is the same each time."""
    return train(labelled_pages())


def extract_main_text(pages: DataFrame, training: list[tuple[list[Block], list[int]]] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row: the blocks labelled main, joined by an empty line.

    Character references are decoded, and white space inside a block is one space; a
    line break is white space. Broken markup is read in one pass. Null and empty pages, and those without a main block, have
    an empty text. Repeated rows are each extracted; other columns are ignored. An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(default_model() if training is None else train(training))
    kept = pages.select("page_id", "url", "html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                rows = batch.slice(begin, 1000)
                texts = [extractor.main_text(p.as_py()) for p in rows.column("html")]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = kept.schema
    return kept.mapInArrow(extract, f"page_id {kinds['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
