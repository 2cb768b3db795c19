"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page becomes a sequence of leaf blocks: stretches of text between block-level tags, each with its open
elements. Features are ancestor tags, words of their class and id, and figures of the text, its links, its
neighbours, and of how much of the page's prose its container holds. Reading takes time in proportion to the page.
The field is trained by its exact likelihood (forward-backward) on ``TRAIN_PAGES`` labelled pages, a bound
that is a parameter, and each page is decoded by Viterbi.

Defined results: null or blank html has empty text and 0 characters; null url or id stays null; broken
markup (unclosed or stray tags, open comments) is read on; repeated rows get equal rows; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.html_pages import labelled_page

TRAIN_PAGES = 900
TRAIN_STEPS = 160
#: Fixed lists of the markup language.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select".split())
CLOSED_BY = {"p": frozenset("p div ul ol li dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 blockquote pre main figure hr".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
CONTAINERS = frozenset("body div section article aside nav header footer main form table td th ul ol dl blockquote figure fieldset".split())
TELLING = frozenset("article main nav header footer aside form".split())

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+""")
_NAME = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An open element, with what it hands down: features are shared with its parent unless it adds some."""

    __slots__ = ("tag", "linked", "names", "told", "features", "leaf", "above", "closable", "home")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None, depth: int, known: Container[str] | None):
        self.tag = tag
        self.linked = tag == "a" or (parent is not None and parent.linked)
        shown = tag not in ("html", "body")
        own = [f"name:{n}" for n in names] + ([f"in:{tag}"] if shown else [])
        above = parent.features if parent else frozenset()
        more = [f for f in own if f not in above and (known is None or f in known)]
        self.features = above.union(more) if more else above
        self.names = bool(names) or (parent is not None and parent.names)
        self.told = tag in TELLING or (parent is not None and parent.told)
        self.leaf = tag if shown else parent.leaf if parent else "-"
        blocks = parent.above if parent else ()
        self.above = (*blocks[-1:], tag) if shown and tag not in INLINE else blocks
        self.home = self if parent is None or tag in CONTAINERS else parent.home
        # the deepest open element of each kind that may be closed unsaid, up to the next container
        self.closable = {} if parent is None or tag in CONTAINERS else parent.closable
        if tag in CLOSED_BY:
            self.closable = {**self.closable, tag: depth}


@dataclass
class Block:
    text: str
    linked: int
    node: Node | None


@dataclass
class _Builder:
    known: Container[str] | None = None
    blocks: list[Block] = field(default_factory=list)
    stack: list[Node] = field(default_factory=list)
    open_tags: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    node: Node | None = None

    def text(self, raw: str) -> None:
        if not raw or not (self.parts or not raw.isspace()):
            return
        top = self.stack[-1] if self.stack else None
        if not self.parts:
            self.node = top
        self.parts.append(raw)
        if top is not None and top.linked:
            self.linked += len(raw)

    def end(self) -> None:
        if self.parts:
            words = html.unescape("".join(self.parts)).split()
            if words:
                size = max(1, sum(map(len, self.parts)))
                self.blocks.append(Block(" ".join(words), min(100, 100 * self.linked // size), self.node))
        self.parts, self.linked, self.node = [], 0, None

    def cut(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open_tags[node.tag] -= 1
        del self.stack[depth:]

    def open(self, tag: str, attributes: str) -> None:
        if self.stack:
            found = [depth for kind, depth in self.stack[-1].closable.items() if tag in CLOSED_BY[kind]]
            if found:
                self.cut(max(found))
        if tag not in VOID and not attributes.endswith("/"):
            names = attribute_names(attributes) if "=" in attributes else ()
            self.stack.append(Node(tag, names, self.stack[-1] if self.stack else None, len(self.stack), self.known))
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if self.open_tags.get(tag):
            depth = len(self.stack) - 1
            while self.stack[depth].tag != tag:
                depth -= 1
            self.cut(depth)


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for groups in _NAME.findall(attributes):
        for value in groups:
            found += [p.lower() for p in _PART.findall(value)]
    return tuple(dict.fromkeys(found))


_short_names = lru_cache(maxsize=4096)(_names)


def attribute_names(attributes: str) -> tuple[str, ...]:
    return _short_names(attributes) if len(attributes) <= 200 else _names(attributes)


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """Texts ("", text, ""), opened ("+", tag, attributes) and closed ("-", tag, "") elements, in order.

    The scanner never returns behind a place it gave out, and an unclosed quote is searched for once:
    from then on quotes count as other characters. Elements with raw content are given without it.
    """
    at, quotes, begin = 0, True, 0
    while True:
        begin = page.find("<", begin)
        if begin < 0:
            break
        if page.startswith(("<!", "<?"), begin):
            stop = "-->" if page.startswith("<!--", begin) else "]]>" if page.startswith("<![CDATA[", begin) else ">"
            yield "", page[at:begin], ""
            end = page.find(stop, begin + (4 if stop == "-->" else 2))
            at = begin = end + len(stop) if end >= 0 else len(page)
            continue
        m = _TAG.match(page, begin)
        if m is None:
            begin += 1
            continue
        end = -1
        if quotes:
            end = _QUOTED.match(page, m.end()).end()
            if end >= len(page) or page[end] != ">":
                quotes, end = False, -1
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:  # no tag ends any more
                break
        yield "", page[at:begin], ""
        tag = m[1].lower()
        at = begin = end + 1
        if page[m.start() + 1] == "/":
            yield "-", tag, ""
        elif tag in RAW:
            closing = _closing(tag).search(page, at)
            end = page.find(">", closing.end()) if closing else -1
            at = begin = end + 1 if end >= 0 else len(page)
            yield "+", "hr", ""
        else:
            yield "+", tag, page[m.end() : end]
    yield "", page[at:], ""


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9_])", re.I)


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The page's blocks in order; raw elements (scripts, styles, titles, ...) have none.

    ``known`` are the features worth keeping, all if None.
    """
    built = _Builder(known)
    for kind, value, attributes in markup(page):
        if not kind:
            built.text(value)
        elif value == "br":
            built.text(" ")
        else:
            if value not in INLINE:
                built.end()
            if kind == "-":
                built.close(value)
            else:
                built.open(value, attributes)
    built.end()
    return built.blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block: its elements, its text, its neighbours, its container's share of plain text."""
    masses: dict[int, int] = {}
    headed: set[int] = set()  # containers with a title
    plain = []
    for b in blocks:
        if b.node and b.node.leaf == "h1":
            headed.add(id(b.node.home))
        n = b.text.count(" ") + 1
        prose = n if b.linked < 34 and n >= 8 else 0
        plain.append(prose)
        home = id(b.node.home) if b.node else 0
        masses[home] = masses.get(home, 0) + prose
    most, all_ = max(masses.values(), default=0), max(1, sum(masses.values()))
    out = []
    for i, b in enumerate(blocks):
        node = b.node
        own = set(node.features) if node else set()
        n = b.text.count(" ") + 1
        mass = masses[id(node.home) if node else 0]
        rich = "most" if mass == most and most else "some" if 4 * mass >= all_ else "few" if mass else "none"
        words = f"words:{min(6, n.bit_length())}"
        stop = b.text[-1] in ".!?…:;\"»”"
        beside = "".join("p" if 0 <= j < len(blocks) and plain[j] else "-" for j in (i - 1, i + 1))
        own |= {f"leaf:{node.leaf if node else '-'}", f"pair:{'>'.join(node.above) if node else ''}", words, f"links:{b.linked // 34}", f"stop:{stop}"}
        head = f"headed:{id(node.home) in headed if node else False}"
        if "©" in b.text or "(c)" in b.text:
            own.add("copyright")
        if node is None or not (node.names or node.told):  # markup says nothing: the text must
            leaf = node.leaf if node else "-"
            own |= {"untold", f"mass:{rich}", f"mass:{rich}&{words}", f"mass:{rich}&{b.linked // 34}{stop}", f"mass:{rich}&{leaf}"}
            own |= {f"beside:{beside}", f"beside:{beside}&mass:{rich}", head, f"{head}&links:{b.linked // 34}", f"{head}&mass:{rich}", f"{head}&{leaf}&{words}"}
        elif not node.told:  # names may say nothing
            own |= {f"named&mass:{rich}", f"named&mass:{rich}&{words}", f"named&beside:{beside}"}
        own.add("first" if i == 0 else "last" if i + 1 == len(blocks) else "inside")
        own.add("bias")
        out.append(sorted(own))
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features per label, of label pairs, and of a page's first label; label 1 is content."""

    index: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray
    start: np.ndarray

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        out = np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            out[i] = self.weights[[k for k in map(get, row) if k is not None]].sum(axis=0)
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The labels of highest probability together (Viterbi)."""
        if not rows:
            return []
        scores = self.scores(rows).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = self.start[0] + scores[0][0], self.start[1] + scores[0][1]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = (a + p00 >= b + p10), (a + p01 >= b + p11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + p00 if from0 else b + p10) + s0, (a + p01 if from1 else b + p11) + s1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = TRAIN_STEPS, ridge: float = 2e-4) -> Field:
    """Maximum likelihood with a ridge, by Adam on the exact gradient over all pages at once."""
    counts: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                counts[f] = counts.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 2))}
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    n, longest = len(pages), len(pages[0][0])
    width = max(len(row) for rows, _ in pages for row in rows)
    ids = np.full((n, longest, width), len(index))
    gold = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, row in enumerate(rows):
            found = [index[f] for f in row if f in index]
            ids[i, j, : len(found)] = found
        gold[i, : len(labels)] = labels
        live[i, : len(rows)] = True
    flat, lengths, total = ids[live], live.sum(axis=1), live.sum()
    shapes = [(len(index) + 1, 2), (2, 2), (2,)]
    theta = [np.zeros(s) for s in shapes]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    both = live[:, 1:] & live[:, :-1]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    gold_start = np.bincount(gold[:, 0], minlength=2)
    add = np.logaddexp
    for step in range(1, steps + 1):
        w, pairs, start = theta
        score = np.zeros((n, longest, 2))
        score[live] = w[flat].sum(axis=1)
        forward = np.zeros_like(score)
        forward[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            k = int((lengths > t).sum())
            own = forward[:k, t - 1]
            forward[:k, t] = score[:k, t] + add(own[:, :1] + pairs[0], own[:, 1:] + pairs[1])
        backward = np.zeros_like(score)
        for t in range(longest - 2, -1, -1):
            k = int((lengths > t + 1).sum())
            ahead = score[:k, t + 1] + backward[:k, t + 1]
            backward[:k, t] = add(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
        end = forward[np.arange(n), lengths - 1]
        log_z = add(end[:, 0], end[:, 1])
        marginal = np.exp(forward + backward - log_z[:, None, None])
        error = marginal.copy()
        error[np.arange(n)[:, None], np.arange(longest), gold] -= 1
        grad_w = np.stack([np.bincount(flat.ravel(), np.repeat(error[live][:, y], width), len(index) + 1) for y in (0, 1)], axis=1)
        joint = forward[:, :-1, :, None] + pairs + (score + backward)[:, 1:, None, :] - log_z[:, None, None, None]
        grad_pairs = np.exp(joint[both]).sum(axis=0) - gold_pairs
        grad_start = marginal[:, 0].sum(axis=0) - gold_start
        for i, g in enumerate((grad_w, grad_pairs, grad_start)):
            g = g / total + ridge * theta[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            theta[i] = theta[i] - 0.15 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-9)
        theta[0][-1] = 0
    return Field(index, theta[0], theta[1], theta[2])


def labelled_blocks(page: str, gold: list[tuple[str, int]]) -> tuple[list[list[str]], list[int]]:
    """A labelled page as features and labels; a block that no gold text starts keeps its neighbour's label."""
    blocks = leaf_blocks(page)
    labels, at = [], 0
    for b in blocks:
        look = next((k for k in range(at, min(at + 4, len(gold))) if " ".join(gold[k][0].split()) == b.text), None)
        if look is None:
            labels.append(labels[-1] if labels else 0)
        else:
            labels.append(gold[look][1])
            at = look + 1
    return features(blocks), labels


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 1) -> Field:
    return fit([labelled_blocks(*labelled_page(seed * 1_000_003 + i)) for i in range(pages)])


def main_text(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page or "", model.index)
    labels = model.decode(features(blocks))
    return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or trained()
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
