"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's segmentations form a lattice over the pieces of a public vocabulary; a piece weighs by its rank in
it (Zipf), characters without a piece fall back to bytes. A segmentation's probability is its weight over
the sum of all. Top-k without replacement: each region of the lattice carries a perturbed bound, a Gumbel
variable of its total probability, truncated by the bound of the region it came from. The search pops the
region of the highest bound, draws its best segmentation (ancestral, exact by backward sums), and splits
the rest by the first decision that differs. The next bound, kappa, gives each sample's probability of
being included: 1 - exp(-exp(log p - kappa)).

All random numbers are hashes of (row key, sample, place), so a row's samples don't depend on partitions,
batches or retries. Lattices are built for the different words of a block of texts, whose size bounds the
memory; nothing is cut off: all pieces of all words of whole texts take part.

Defined results: null or empty text has one segmentation, the empty one; a text with fewer segmentations
than asked for gives all of them, with inclusion 1 (logarithm 0); repeated rows get equal samples; a null key is a key;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import keeps, only

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of text whose lattices are held at once.
BLOCK_CHARS = 3_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLOTS = 1 << 20
PREFIX = -2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def mixed(state: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    for k in keys:
        state = _mix(state * _M1 + np.atleast_1d(k).astype(np.uint64) + _M1)
    return state


def uniforms(*keys: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Numbers inside (0, 1) that depend on the keys alone; ``state`` has earlier keys mixed already."""
    h = mixed(np.zeros(1, np.uint64) if state is None else state, *keys)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def gumbel_below(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The greatest of a region's perturbed values, given that it lies below the bound; -inf without mass."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.log(np.exp(-bound) - np.exp(-log_mass) * np.log(u))


class Vocabulary:
    """Pieces with weights, found by a hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.first_byte = next(i for i in range(len(self.pieces)) if model.is_byte(i))
        normal = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.weights = np.full(len(self.pieces), -np.inf)
        ranks = np.arange(len(normal))
        self.weights[normal] = -np.log(ranks + 2.0)
        self.byte_weight = -np.log(len(normal) + 2.0)
        self.longest = max(len(self.pieces[i]) for i in normal)
        # strings that pieces begin with are in the table too, so that a place is left once nothing can follow
        known: dict[int, int] = {}
        for i in normal:
            h = 0
            for c in map(ord, self.pieces[i]):
                h = (h * int(_M1) + c + 1) & 0xFFFFFFFFFFFFFFFF
                known.setdefault(h, PREFIX)
            known[h] = i
        hashes = _mix(np.fromiter(known, np.uint64, len(known)))
        slots = (hashes >> np.uint64(44)).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        hashes, slots, ids = hashes[order], slots[order], np.fromiter(known.values(), np.int32, len(known))[order]
        way = np.arange(len(slots)) - np.searchsorted(slots, slots)
        self.ways = int(way.max()) + 1
        self.table = np.full((self.ways, _SLOTS), -1, np.int32)
        self.hashes = np.zeros((self.ways, _SLOTS), np.uint64)
        self.table[way, slots], self.hashes[way, slots] = ids, hashes
        self.piece_weights = np.append(self.weights, [-np.inf, -np.inf])  # at PREFIX and at -1 too
        self.bytes = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b in range(256):
            self.bytes[self.first_byte + b] = bytes([b])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by rolling hashes; PREFIX where a piece begins like that, -1 where none does."""
        h = _mix(h)
        slot = (h >> np.uint64(44)).astype(np.int64)
        out = np.where(self.hashes[0, slot] == h, self.table[0, slot], -1)
        for k in range(1, self.ways):
            again = np.flatnonzero((out == -1) & (self.table[k, slot] != -1))
            if again.size:
                out[again] = np.where(self.hashes[k, slot[again]] == h[again], self.table[k, slot[again]], -1)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before a text is taken off."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Vocabulary] = {}
keeps("pieces", _loaded.clear)


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def units(text: str) -> list[str]:
    """Stretches that no piece crosses: spaces and what follows them."""
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


@dataclass
class Lattice:
    """Nodes of several words in a row, and their edges in order of node and length."""

    turn: np.ndarray  # number of each word of the block within its text

    first: np.ndarray  # first node of a word
    ends: np.ndarray  # whether a node ends its word
    start: np.ndarray  # first edge of each node, and the number of edges
    length: np.ndarray  # characters of an edge
    prob: np.ndarray  # of each edge, given its node
    cum: np.ndarray  # its running sums within the node
    piece: np.ndarray  # id; below 0 a character's bytes
    codes: np.ndarray
    widest: int  # most edges of a node

    def drawn(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node in whose part of the probability u lies."""
        edge = self.start[node]
        u = u * self.cum[self.start[node + 1] - 1]
        more = np.flatnonzero(u >= self.cum[edge])
        while more.size:
            edge[more] += 1
            more = more[u[more] >= self.cum[edge[more]]]
        return edge

    def row(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the edges of some nodes, side by side, and their numbers."""
        edge = self.start[node][:, None] + np.arange(self.widest)
        there = edge < self.start[node + 1][:, None]
        edge = np.where(there, edge, 0)
        return np.where(there, self.prob[edge], 0.0), edge


def build_lattice(words: list[str], vocab: Vocabulary) -> Lattice:
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    codes = np.zeros(total, np.uint64)
    inner = np.ones(total, bool)
    inner[first + sizes] = False
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    nodes, lengths, ids = [], [], []
    at, h = np.flatnonzero(inner), np.zeros(total, np.uint64)
    for k in range(vocab.longest):
        if not at.size:
            break
        h[at] = h[at] * _M1 + codes[at + k] + np.uint64(1)
        found = vocab.find(h[at])
        is_piece = found >= 0
        if k == 0:  # a character without a piece stands for its bytes
            is_piece[:] = True
            found = np.where(found < 0, PREFIX, found)
        nodes.append(at[is_piece])
        lengths.append(np.full(len(nodes[-1]), k + 1, np.int32))
        ids.append(found[is_piece])
        at = at[(found != -1) & inner[at + k + 1]]
    # edges in order of node and length, without sorting: a node's come by length anyway
    degree = np.zeros(total, np.int64)
    for at in nodes:
        degree[at] += 1
    start = np.r_[0, np.cumsum(degree)]
    free = start[:-1].copy()
    node, length, piece = np.empty(start[-1], np.int64), np.empty(start[-1], np.int32), np.empty(start[-1], np.int32)
    for at, size, found in zip(nodes, lengths, ids, strict=True):
        place = free[at]
        node[place], length[place], piece[place] = at, size, found
        free[at] += 1
    raw = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    weight = np.where(piece >= 0, vocab.piece_weights[piece], vocab.byte_weight * raw[node])
    # backward sums, all nodes with the same distance to their word's end at once
    back = np.repeat(first + sizes, sizes + 1) - np.arange(total)
    level = back[node]
    order = np.argsort(level.astype(np.uint16) if len(words) and sizes.max() < 1 << 16 else level, kind="stable")
    target, sorted_node, sorted_weight = (node + length)[order], node[order], weight[order]
    heads = np.flatnonzero(np.r_[True, sorted_node[1:] != sorted_node[:-1]]) if len(order) else np.empty(0, np.int64)
    head_node = sorted_node[heads]
    count = np.diff(np.r_[heads, len(order)])
    levels = np.searchsorted(back[head_node], np.arange(1, int(sizes.max(initial=0)) + 2))
    beta, prob = np.zeros(total), np.zeros(len(order))
    for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
        lo, hi = heads[a], heads[b] if b < len(heads) else len(order)
        own = sorted_weight[lo:hi] + beta[target[lo:hi]]
        inside, n = heads[a:b] - lo, count[a:b]
        top = np.maximum.reduceat(own, inside)
        e = np.exp(own - np.repeat(top, n))
        s = np.add.reduceat(e, inside)
        beta[head_node[a:b]] = top + np.log(s)
        prob[order[lo:hi]] = e / np.repeat(s, n)
    cum = prob.copy()
    widest = int(degree.max(initial=1))
    for j in range(1, widest):
        edge = start[:-1][degree > j] + j
        cum[edge] += cum[edge - 1]
    return Lattice(np.empty(0, np.int64), first, ~inner, start, length, prob, cum, piece, codes, widest)


@dataclass
class Path:
    """One segmentation of every text: decisions in order of text, word and step."""

    text: np.ndarray
    word: np.ndarray
    step: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    bound: np.ndarray  # perturbed bound of the region that differs first here
    special: np.ndarray  # per text the decision whose exclusions go beyond its own edge, or -1
    barred: np.ndarray  # per text those exclusions


class _Numbers(dict):
    """Each different word's number, in the order they come."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


def _draw(lattice: Lattice, word: np.ndarray, node: np.ndarray, step: np.ndarray, seed: np.ndarray, sample: int) -> list[np.ndarray]:
    """Decisions from the given nodes to the ends of their words."""
    out = []
    state = mixed(np.zeros(1, np.uint64), seed, np.uint64(sample), lattice.turn[word])
    while word.size:
        edge = lattice.drawn(node, uniforms(step, state=state))
        out.append(np.stack([word, step, node, edge]))
        node = node + lattice.length[edge]
        more = ~lattice.ends[node]
        word, node, step, state = word[more], node[more], step[more] + 1, state[more]
    return out


def sample_texts(texts: list[str], seeds: np.ndarray, k: int, vocab: Vocabulary) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k samples (ids, log probability, perturbed value), the best first, and kappa last."""
    lists = [units(t) for t in texts]
    index = _Numbers()
    flat = [i for ws in lists for i in map(index.__getitem__, ws)]
    n = len(texts)
    out: list[list] = [[] for _ in texts]
    lattice = build_lattice(list(index), vocab)
    text_of = np.repeat(np.arange(n), [len(ws) for ws in lists])
    lattice.turn = np.concatenate([np.arange(len(ws)) for ws in lists]) if lists else lattice.turn
    start_node = lattice.first[np.array(flat, np.int64)] if flat else np.empty(0, np.int64)
    first_word = np.searchsorted(text_of, np.arange(n + 1))
    seeds = seeds.astype(np.uint64)
    values = -np.log(-np.log(uniforms(seeds, np.uint64(0), np.uint64(1 << 40))))
    words = np.arange(len(flat))
    parts = _draw(lattice, words, start_node, np.zeros(len(words), np.int64), seeds[text_of], 0)
    alive = np.ones(n, bool)
    width = lattice.widest
    special, barred = np.full(n, -1), np.zeros((n, width), bool)
    paths: list[Path] = []
    for sample in range(k):
        path = _arranged(parts, text_of, n, special, barred)
        paths.append(path)
        _bounds(path, lattice, values, seeds, sample, alive, special)
        for i, (ids, logp) in enumerate(_read(path, lattice, vocab, n)):
            if alive[i]:
                out[i].append((ids, logp, float(values[i])))
        best, owner, where = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for m, p in enumerate(paths):
            edges = np.searchsorted(p.text, np.arange(n + 1))
            mine = np.flatnonzero(edges[1:] > edges[:-1])
            if not mine.size:
                continue
            top = np.full(n, -np.inf)
            top[mine] = np.maximum.reduceat(p.bound, edges[mine])
            first = np.flatnonzero(p.bound == top[p.text])[::-1]  # the first of equal ones is written last
            place = np.zeros(n, np.int64)
            place[p.text[first]] = first
            better = alive & (top > best)
            best[better], owner[better], where[better] = top[better], m, place[better]
        alive = best > -np.inf
        values = best
        if sample + 1 == k or not alive.any():
            break
        parts, special, barred = _branch(paths, owner, where, alive, lattice, seeds, sample + 1, text_of, first_word, start_node)
    for i in range(n):
        out[i].append(float(values[i]))
    return out


def _arranged(parts: list[np.ndarray], text_of: np.ndarray, n: int, special: np.ndarray, barred: np.ndarray) -> Path:
    word, step, node, edge = np.concatenate(parts, axis=1) if parts else np.empty((4, 0), np.int64)
    order = np.lexsort((step, word))
    word, step, node, edge = word[order], step[order], node[order], edge[order]
    text = text_of[word]
    return Path(text, word, step, node, edge, np.full(len(word), -np.inf), special, barred)


def _bounds(path: Path, lattice: Lattice, values: np.ndarray, seeds: np.ndarray, sample: int, alive: np.ndarray, special: np.ndarray) -> None:
    """Bounds of the regions that differ from this path at or after its branch."""
    if not len(path.word):
        return
    here = np.arange(len(path.word))
    chosen = lattice.prob[path.edge]
    logs = np.log(chosen)
    edges = np.searchsorted(path.text, np.arange(len(values) + 1))
    begin = edges[path.text]
    prefix = np.zeros(len(logs))
    for a, b in zip(edges[:-1], edges[1:], strict=True):  # text by text, so that sums round alike in every block
        if b > a:
            np.cumsum(logs[a : b - 1], out=prefix[a + 1 : b])
    single = lattice.start[path.node + 1] - lattice.start[path.node] == 1
    other = np.where(single, 0.0, np.maximum(0.0, 1.0 - chosen))
    at = np.flatnonzero(special >= 0)  # at its branch more is barred than the path's own edge
    if at.size:
        branch = edges[at] + special[at]
        bar = path.barred[at].copy()
        node = path.node[branch]
        bar[np.arange(len(at)), path.edge[branch] - lattice.start[node]] = True
        other[branch] = np.where(bar, 0.0, lattice.row(node)[0]).cumsum(axis=1)[:, -1]
    with np.errstate(divide="ignore"):
        mass = prefix + np.log(other)
    own = here - begin >= special[path.text]  # earlier decisions belong to regions of other paths
    state = mixed(np.zeros(1, np.uint64), seeds, np.uint64(sample))[path.text]
    u = uniforms(lattice.turn[path.word], path.step + (1 << 20), state=state)
    fresh = gumbel_below(mass, values[path.text], u)
    path.bound[:] = np.where(own & alive[path.text], fresh, -np.inf)


def _branch(paths, owner, where, alive, lattice, seeds, sample, text_of, first_word, start_node):
    """The next path of each text: its owner's decisions before the branch, another edge there, then fresh ones."""
    n = len(owner)
    width = lattice.widest
    parts, special, barred = [], np.full(n, -1), np.zeros((n, width), bool)
    words, nodes, steps = [], [], []
    for m, p in enumerate(paths):
        mine = np.flatnonzero(alive & (owner == m))
        if not mine.size:
            continue
        edges = np.searchsorted(p.text, np.arange(n + 1))
        limit = np.zeros(n, np.int64)
        limit[mine] = where[mine]
        keep = np.arange(len(p.word)) < limit[p.text]
        parts.append(np.stack([p.word[keep], p.step[keep], p.node[keep], p.edge[keep]]))
        at = where[mine]
        bar = np.zeros((len(mine), width), bool)
        bar[np.arange(len(mine)), p.edge[at] - lattice.start[p.node[at]]] = True
        same = p.special[mine] == at - edges[mine]
        bar[same] |= p.barred[mine[same]]
        rows, edges_ = lattice.row(p.node[at])
        cum = np.cumsum(np.where(bar, 0.0, rows), axis=1)
        u = uniforms(seeds[mine], np.uint64(sample), lattice.turn[p.word[at]], p.step[at] + (1 << 21)) * cum[:, -1]
        edge = edges_[np.arange(len(mine)), (u[:, None] >= cum).sum(axis=1)]
        parts.append(np.stack([p.word[at], p.step[at], p.node[at], edge]))
        special[mine], barred[mine] = at - edges[mine], bar
        p.bound[at] = -np.inf
        node = p.node[at] + lattice.length[edge]
        more = ~lattice.ends[node]
        words.append(p.word[at][more])
        nodes.append(node[more])
        steps.append(p.step[at][more] + 1)
        later = np.concatenate([np.arange(w + 1, first_word[i + 1]) for i, w in zip(mine, p.word[at], strict=True)] or [np.empty(0, np.int64)])
        words.append(later)
        nodes.append(start_node[later])
        steps.append(np.zeros(len(later), np.int64))
    word, node, step = (np.concatenate(x).astype(np.int64) for x in (words, nodes, steps))
    parts += _draw(lattice, word, node, step, seeds[text_of[word]], sample)
    return parts, special, barred


def _read(path: Path, lattice: Lattice, vocab: Vocabulary, n: int) -> Iterator[tuple[np.ndarray, float]]:
    """Ids and log probability of each text's segmentation."""
    edges = np.searchsorted(path.text, np.arange(n + 1))
    logs, code = np.log(lattice.prob[path.edge]), lattice.codes[path.node]
    ids = lattice.piece[path.edge].astype(np.int64)
    bare = ids < 0
    ids = np.where(bare & (code < 0x80), code.astype(np.int64) + vocab.first_byte, ids).astype(np.uint32)
    lone = np.flatnonzero(bare & (code >= 0x80))  # characters of several bytes
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        own = ids[a:b]
        if len(lone):
            here = lone[np.searchsorted(lone, a) : np.searchsorted(lone, b)]
            if len(here):
                spread, done = [], a
                for j in here:
                    spread.append(ids[done:j])
                    raw = chr(int(lattice.codes[path.node[j]])).encode("utf-8", "surrogatepass")
                    spread.append(np.frombuffer(raw, np.uint8).astype(np.uint32) + np.uint32(vocab.first_byte))
                    done = j + 1
                own = np.concatenate([*spread, ids[done:b]])
        yield own, float(logs[a:b].sum())


def best_texts(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each text's segmentation of greatest weight (Viterbi); of equal ones that of the shortest first piece."""
    lists = [units(t) for t in texts]
    index = _Numbers()
    flat = [[index[w] for w in ws] for ws in lists]
    ids = [best_word(w, vocab) for w in index]
    return [np.concatenate([ids[i] for i in ws]) if ws else np.empty(0, np.uint32) for ws in flat]


def best_word(word: str, vocab: Vocabulary) -> np.ndarray:
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint32)
    score, step = np.full(n + 1, -np.inf), np.zeros(n, np.int64)
    score[n] = 0.0
    ids = np.full((n, min(n, vocab.longest)), -1, np.int32)
    h = np.zeros(n, np.uint64)
    for k in range(ids.shape[1]):
        at = np.arange(n - k)
        h[at] = h[at] * _M1 + codes[at + k] + np.uint64(1)
        ids[at, k] = vocab.find(h[at])
    raw = [chr(int(c)).encode("utf-8", "surrogatepass") for c in codes]
    for i in range(n - 1, -1, -1):
        reach = min(n - i, ids.shape[1])
        own = vocab.piece_weights[ids[i, :reach]]
        if ids[i, 0] < 0:
            own[0] = vocab.byte_weight * len(raw[i])
        own = own + score[i + 1 : i + reach + 1]
        step[i] = int(np.argmax(own))
        score[i] = own[step[i]]
    out, i = [], 0
    while i < n:
        k = int(step[i])
        out += [int(ids[i, k])] if ids[i, k] >= 0 else [vocab.first_byte + b for b in raw[i]]
        i += k + 1
    return np.array(out, np.uint32)


def log_inclusion(logp: float, kappa: float) -> float:
    """Logarithm of 1 - exp(-exp(logp - kappa)); texts of many words have far too small a probability itself."""
    d = logp - kappa
    if kappa == -np.inf:
        return 0.0
    return d if d < -30 else float(np.log(-np.expm1(-np.exp(min(d, 30.0)))))


def blocks(texts: list[str]) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BLOCK_CHARS:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def sampled(docs: DataFrame, model_path: str, k: int = 3, seed: int = 1, ids: bool = False, key: str = "doc_id") -> DataFrame:
    """A row per document and sample: key, sample, n_pieces, ids_crc32, round_trip, log_prob, perturbed, log_inclusion.

    Numbers are rounded to 8 digits: vector units round the last one by place. ``ids`` adds the sample's ids. ``round_trip`` says whether decoding them gives the text.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pieces")
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            seeds = batch.column(2).to_numpy().view(np.uint64)
            for part in blocks(texts):
                rows: list[tuple] = []
                for i, found in enumerate(sample_texts(texts[part], seeds[part], k, vocab), part.start):
                    *samples, kappa = found
                    for m, (own, logp, value) in enumerate(samples):
                        rows.append((i, m, len(own), zlib.crc32(own.astype("<u4").tobytes()), vocab.decode(own) == texts[i], round(logp, 8), round(value, 8), round(log_inclusion(logp, kappa), 8), own if ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
                arrays = [batch.column(0).take(pa.array(columns[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(columns[1:8], kinds, strict=True)]
                if ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in columns[8]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = [key, "sample", "n_pieces", "ids_crc32", "round_trip", "log_prob", "perturbed", "log_inclusion"] + (["ids"] if ids else [])
    schema = f"{key} {key_type}, sample int, n_pieces long, ids_crc32 long, round_trip boolean, log_prob double, perturbed double, log_inclusion double"
    return docs.select(key, "text", F.xxhash64(F.lit(seed), F.col(key)).alias("seed")).mapInArrow(run, schema + (", ids array<int>" if ids else ""))


def encoded(docs: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """A row per document: key, ids (its segmentation of greatest weight). Null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            for step in range(0, batch.num_rows, 256):
                part = batch.slice(step, 256)
                found = best_texts([t or "" for t in part.column(1).to_pylist()], vocab)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """A row per row: key, text of its ids. Null ids give null; ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            for step in range(0, batch.num_rows, 256):
                part = batch.slice(step, 256)
                texts = [None if x is None else vocab.decode(np.array(x, np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(key, ids).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")
