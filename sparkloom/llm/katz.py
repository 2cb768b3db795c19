"""Katz backoff language model of any order (three by default): training, storage and scoring.

A token's probability after its history (the words before it, begin marks before a text) is
d(c) * c / c(history) if training saw the n-gram c times, with Good-Turing discounts d for counts up to
``KATZ_K``; else it is the history's backoff weight times the probability after the history shortened by
its first word, down to the base model: add-one over single tokens. A history that training never saw has
weight 1. Discounts that the counts of counts don't allow (outside 0 to 1) are 1; a history that then
loses nothing counts one token more, so that something is left. Weights normalise exactly: what the seen n-grams leave,
over what the shorter history gives to all but their last words.

The model is a table of compressed blocks, dealt by hash ranges of the *last* history word, so that all
n-grams from two words up, their histories' sums and their weights meet in one range; ranges are worked
off in slices. A word's own count is that of the history it is. Words that follow in a range ask the words'
ranges for their counts. Scoring deals texts' tokens to the ranges in the same way, evaluates the recursion
for each token, and returns sums to the texts. Blocks are bounded by ``CHUNK_TOKENS``, so memory doesn't follow the corpus.
A single word that were a third of all tokens would make its range that large: a limit of this form.

A text is known by its place in its partition, which is sorted by id and text for that: a retried task finds the same places.

Defined results: null text is the end token alone; a null id counts as empty text for the split; repeated
rows are learned and scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import only
from sparkloom.llm.tokens import mix, word_hashes
from sparkloom.operators.lineage import cut

KATZ_K = 5
#: Tokens that a task packs at once.
CHUNK_TOKENS = 2_500_000
#: Bytes of text behind one range of hashes.
RANGE_BYTES = 40_000_000
#: A range is worked off in so many slices.
SLICES = 16
#: Texts of each partition whose words make the code book, and its words; it shortens blocks and has no effect on results.
BOOK_TEXTS, BOOK_WORDS = 512, 400_000
#: Rows of an Arrow batch: a task's blocks in one batch would stand in the JVM and in Python as a whole.
BATCH_ROWS = 32
BEGIN, END = np.uint64(1), np.uint64(2)
_M = np.uint64(0x9E3779B97F4A7C15)
RARE = (1 << 24) - 1


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight stand together."""
    head = np.array([len(arrays), *[v for a in arrays for v in (ord(a.dtype.char), len(a))]], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(head.tobytes() + b"".join(planes), 3)


def thaw(block: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(block)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for char, length in np.frombuffer(data, np.int64, 2 * n, 8).reshape(-1, 2).tolist():
        kind = np.dtype(chr(char))
        size = kind.itemsize * length
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += size
    return out


def joined(*parts: bytes) -> bytes:
    """Byte strings as one, their lengths first."""
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def parted(block: bytes) -> list[bytes]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(block, np.int64, n, 8)).tolist()
    return [block[8 * (n + 1) + a : 8 * (n + 1) + b] for a, b in zip([0, *ends], ends, strict=False)]


def narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.int64)


def ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Monotone in the hash, so that sorted hashes have sorted ranges."""
    return ((hashes >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def range_borders(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(ranges(sorted_hashes, parts), np.arange(parts + 1))


class Book:
    """Short codes of frequent words; others stand by their hash."""

    def __init__(self, words: np.ndarray):
        self.words = words  # by frequency
        self.order = np.argsort(words).astype(np.uint32)
        self.sorted = words[self.order]

    def codes(self, words: np.ndarray) -> np.ndarray:
        at, known = found_in(self.sorted, words)
        return np.where(known, self.order[at], RARE).astype(np.uint32) if len(self.words) else np.full(len(words), RARE, np.uint32)

    def words_of(self, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.uint64)
        known = codes != RARE
        out[known] = self.words[codes[known]]
        out[~known] = rare
        return out


SCHEMA = "kind string, target int, chunk long, block binary"


def _rows(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "target", "chunk", "block"])


@dataclass(frozen=True)
class Setup:
    order: int
    parts: int
    book: Book


@dataclass(frozen=True)
class Figures:
    """Of the training texts: tokens, different tokens, texts, and n-grams seen once, twice, ... by order from two."""

    tokens: int = 0
    words: int = 0
    texts: int = 0
    counts: tuple[tuple[int, ...], ...] = ()

    @property
    def whole(self) -> int:
        return self.tokens + self.words + 1

    def discounts(self, order: int) -> np.ndarray:
        """d(0..k) of n-grams of an order by Good-Turing with Katz's cutoff; 1 where the counts of counts don't allow it."""
        n, k = self.counts[order - 2] if len(self.counts) > order - 2 else (0,) * (KATZ_K + 1), KATZ_K
        out = np.ones(k + 1)
        tail = (k + 1) * n[k] / n[0] if n[0] else 1.0
        for r in range(1, k + 1):
            if n[r - 1] and tail < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
                if 0 < d <= 1:
                    out[r] = d
        return out


# packing


def columns_of(words: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different words in order, and by their numbers: the last history word, the one before it, ..., and the word of each token.

    Texts' words end with END.
    """
    names, at = np.unique(words, return_inverse=True)
    begin = np.searchsorted(names, BEGIN)  # no word has this number
    names = np.insert(names, begin, BEGIN)
    at = at.astype(np.int32)
    at += at >= begin
    starts = np.cumsum(sizes) - sizes
    out = []
    for back in range(1, order):
        h = np.empty_like(at)
        h[back:] = at[:-back]
        for i in range(back):
            h[np.minimum(starts + i, starts + sizes - 1)[sizes > i]] = begin
        out.append(h)
    return names, [*out, at]


def packed(names: np.ndarray, columns: list[np.ndarray], more: np.ndarray, setup: Setup, rising: bool = False) -> Iterator[tuple[int, bytes]]:
    """A block for each range: last history words and their numbers of rows, other columns, ``more``; words are coded.

    ``rising``: ``more`` never falls within a last history word, and is kept as differences.
    """
    order = np.argsort(columns[0], kind="stable").astype(np.int32)
    count = np.bincount(columns[0], minlength=len(names))
    present = np.flatnonzero(count)
    count = count[present]
    edges = np.r_[0, np.cumsum(count)]
    codes = setup.book.codes(names)
    others = [c[order] for c in columns[1:]]
    more = more[order]
    if rising:
        step = np.diff(more, prepend=0)
        step[edges[:-1]] = more[edges[:-1]]
        more = step
    borders = range_borders(names[present], setup.parts)
    for p in range(setup.parts):
        a, b = borders[p], borders[p + 1]
        if a < b:
            s = slice(edges[a], edges[b])
            arrays = []
            for c in (present[a:b], *[c[s] for c in others]):
                code = codes[c]
                arrays += [code, names[c[code == RARE]]]
            yield p, freeze(narrow(count[a:b]), narrow(more[s]), *arrays)


class Blocks:
    """Blocks of a range, kept coded; slices of the range are read one at a time."""

    def __init__(self, blocks: list[bytes], setup: Setup, rising: bool = False):
        self.setup, self.arrays, self.names, self.edges, self.rare = setup, [], [], [], []
        while blocks:  # they go as they are read
            count, more, code, rare, *coded = thaw(blocks.pop(0))
            self.names.append(setup.book.words_of(code, rare))
            edges = np.r_[0, np.cumsum(count, dtype=np.int64)]
            if rising:
                whole = np.cumsum(more, dtype=np.int64)
                whole -= np.repeat(whole[edges[:-1]] - more[edges[:-1]], count)
                more = narrow(whole)
            self.edges.append(edges)
            self.arrays.append((count, more, coded))
            self.rare.append([np.r_[0, np.cumsum(code == RARE, dtype=np.int32)][edges] for code in coded[::2]])

    def read(self, i: int, number: int, all_parts: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns and ``more`` of the rows of a block whose last history words lie in one of all parts."""
        names, (count, more, coded) = self.names[i], self.arrays[i]
        a, b = np.searchsorted(ranges(names, all_parts), [number, number + 1])
        s = slice(self.edges[i][a], self.edges[i][b])
        columns = [np.repeat(names[a:b], count[a:b])]
        for j, rare in enumerate(self.rare[i]):
            columns.append(self.setup.book.words_of(coded[2 * j][s], coded[2 * j + 1][rare[a] : rare[b]]))
        return columns, more[s]

    def numbered(self, number: int, all_parts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The same over all blocks: different words in order, columns of their numbers, ``more``. Words of rows are never spread out."""
        book, parts = self.setup.book, []
        for names, edges, rare, (count, more, coded) in zip(self.names, self.edges, self.rare, self.arrays, strict=True):
            a, b = np.searchsorted(ranges(names, all_parts), [number, number + 1])
            s = slice(edges[a], edges[b])
            columns = [(coded[2 * j][s], coded[2 * j + 1][at[a] : at[b]]) for j, at in enumerate(rare)]
            parts.append((names[a:b], count[a:b], more[s], columns))
        used = np.zeros(len(book.words), bool)
        for code in (code for part in parts for code, _ in part[3]):
            used[code[code != RARE]] = True
        names = [book.words[used], *[x for part in parts for x in (part[0], *[rare for _, rare in part[3]])]]
        names = np.unique(np.concatenate(names))
        place = np.zeros(len(book.words), np.int32)
        place[used] = np.searchsorted(names, book.words[used])
        out = [[np.repeat(np.searchsorted(names, first).astype(np.int32), count) for first, count, _, _ in parts]]
        for j in range(self.setup.order - 1):
            out.append([])
            for code, rare in (part[3][j] for part in parts):
                other = code == RARE
                at = place[np.where(other, 0, code)]
                at[other] = np.searchsorted(names, rare)
                out[-1].append(at)
        return names, [np.concatenate(x) for x in out], np.concatenate([part[2] for part in parts])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Texts (id, text, place) in chunks: number, words with end marks, sizes, and the rows without texts."""
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    rows: list[pa.RecordBatch] = []
    number, tokens = None, 0
    for batch in batches:
        for step in range(0, batch.num_rows, 128):
            part = batch.slice(step, 128)
            hashes, counts = word_hashes(part.column(1))
            ends = np.cumsum(counts + 1) - 1
            own = np.full(len(hashes) + len(counts), END)
            inner = np.ones(len(own), bool)
            inner[ends] = False
            own[inner] = hashes
            number = part.column(2)[0].as_py() if number is None else number
            words.append(own)
            sizes.append(counts + 1)
            rows.append(part.select([0]))
            tokens += len(own)
            if tokens >= CHUNK_TOKENS:
                own, words = np.concatenate(words), []
                yield number, own, np.concatenate(sizes), rows
                sizes, rows, number, tokens = [], [], None, 0
    if words:
        yield number, np.concatenate(words), np.concatenate(sizes), rows


def _placed(docs: DataFrame) -> DataFrame:
    """id, text and a number that grows with the place, which the id and the text decide within a partition."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, dict[str, list[tuple[int, bytes]]]]]:
    """Rows of each value of ``key`` by kind; the rows come sorted by it."""
    at, rows = None, {}
    for batch in batches:
        kinds, keys, numbers, blocks = (batch.column(batch.schema.get_field_index(x)) for x in ("kind", key, "chunk", "block"))
        for i in range(batch.num_rows):
            k = keys[i].as_py()
            if k != at:
                if rows:
                    yield at, rows
                at, rows = k, {}
            rows.setdefault(kinds[i].as_py(), []).append((numbers[i].as_py(), blocks[i].as_py()))
    if rows:
        yield at, rows


def computed(df: DataFrame) -> DataFrame:
    """``cut`` with small Arrow batches."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    try:
        conf.set(name, str(BATCH_ROWS))
        return cut(df)
    finally:
        conf.set(name, before)


def dealt(rows: DataFrame, key: str, parts: int, work) -> DataFrame:
    """``work(key, rows by kind)`` for each value of the key, one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("katz")
        for k, group in grouped(batches, key):
            for row in work(k, group):
                yield _rows([row])

    # more partitions than keys, so that few tasks get several of them
    return rows.repartition(4 * parts, key).sortWithinPartitions(key, "kind", "chunk").mapInArrow(run, SCHEMA)


# training


def merged(columns: list[np.ndarray], count: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows (of numbers) as one, in order of the last history word and the others; their counts, or rows, added."""
    bits = max((int(c.max(initial=0)) for c in columns), default=0).bit_length()
    if bits * len(columns) < 64:  # a row as one number
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = (key << bits) | c
        if count is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, count = key[order], count[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        key = key[first]
        size = len(columns[0])
        columns = [((key >> (bits * j)) & ((1 << bits) - 1)).astype(np.int32) for j in range(len(columns) - 1, -1, -1)]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        count = None if count is None else count[order]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first, size = np.flatnonzero(new), len(order)
        columns = [c[first] for c in columns]
    if count is None:
        return columns, np.diff(np.r_[first, size])
    return columns, np.add.reduceat(count.astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def pack_types(docs: DataFrame, setup: Setup) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("katz")
        for number, words, sizes, _ in chunks(batches):
            names, columns = columns_of(words, sizes, setup.order)
            del words
            columns, count = merged(columns)
            for p, block in packed(names, columns, count, setup):
                yield _rows([("types", p, number, block)])

    return _placed(docs).mapInArrow(run, SCHEMA)


def count_range(p: int, rows: dict[str, list[tuple[int, bytes]]], setup: Setup) -> Iterator[tuple[str, int, int, bytes]]:
    """Merged n-grams of a range, its words' counts, the words that ask for theirs, and counts of counts."""
    blocks = Blocks([b for _, b in rows.pop("types")], setup)
    seen = np.zeros((setup.order - 1, KATZ_K + 1), np.int64)
    followers = np.empty(0, np.uint64)
    tokens = words = texts = 0
    for number in range(SLICES):
        names, columns, count = blocks.numbered(p * SLICES + number, setup.parts * SLICES)
        columns, count = merged(columns, count)
        if not len(count):
            continue
        yield from (("grams", p, number, block) for _, block in packed(names, columns, count, Setup(setup.order, 1, setup.book)))
        for level in range(2, setup.order + 1):
            own = count if level == setup.order else merged([*columns[: level - 1], columns[-1]], count)[1]
            seen[level - 2] += [(own == r).sum() for r in range(1, KATZ_K + 2)]
        total = np.bincount(columns[0], weights=count, minlength=len(names)).astype(np.int64)
        follow = names[np.bincount(columns[-1], minlength=len(names)) > 0]
        tokens += int(count.sum())
        begins = names == BEGIN
        texts += int(total[begins].sum())
        word = (total > 0) & ~begins
        words += int(word.sum())
        yield "vocab", p, number, freeze(names[word], narrow(total[word]))
        followers = np.union1d(followers, follow)
    yield "figures", p, 0, freeze(np.array([tokens, words, texts, *seen.ravel()], np.int64))
    borders = range_borders(followers, setup.parts)
    for q in range(setup.parts):
        if borders[q] < borders[q + 1]:
            some = followers[borders[q] : borders[q + 1]]
            codes = setup.book.codes(some)
            yield "ask", q, p, freeze(codes, some[codes == RARE])


def counts_of(rows: dict[str, list[tuple[int, bytes]]], texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a range and their counts; the end mark's is the number of texts."""
    blocks = [thaw(b) for _, b in rows.pop("vocab", [])]
    names = np.concatenate([np.array([END]), *[b[0] for b in blocks]])
    count = np.concatenate([np.array([texts], np.int64), *[b[1].astype(np.int64) for b in blocks]])
    order = np.argsort(names, kind="stable")
    return names[order], count[order]


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether each wanted one is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_keys(columns: list[np.ndarray], level: int) -> np.ndarray:
    """Keys of the n-grams of an order: the history's key and the word."""
    return mix(history_keys(columns, level) * _M + columns[-1])


def history_keys(columns: list[np.ndarray], level: int) -> np.ndarray:
    key = columns[0].copy()
    for c in columns[1 : level - 1]:
        key = mix(key * _M + c)
    return key


@dataclass
class Level:
    """All n-grams of one order in a slice."""

    keys: np.ndarray  # sorted
    chance: np.ndarray  # discounted probability
    histories: np.ndarray  # sorted
    total: np.ndarray
    weight: np.ndarray  # backoff weight of each history
    history: np.ndarray = field(repr=False)  # of each n-gram
    shorter: np.ndarray = field(repr=False)  # probability of each n-gram's word after the shorter history


def levels_of(columns: list[np.ndarray], count: np.ndarray, word_count: np.ndarray, setup: Setup, figures: Figures) -> list[Level]:
    """Orders two and up of a slice's n-grams, with exactly normalised weights; word_count: of each row's word."""
    out: list[Level] = []
    for level in range(2, setup.order + 1):
        if level == setup.order:  # rows differ
            keys = gram_keys(columns, level)
            first = np.argsort(keys)
            keys, c = keys[first], count[first].astype(float)
        else:
            keys, first, own = np.unique(gram_keys(columns, level), return_index=True, return_inverse=True)
            c = np.bincount(own, weights=count)
            del own
        histories, history = np.unique(history_keys(columns, level)[first], return_inverse=True)
        total = np.bincount(history, weights=c, minlength=len(histories))
        d = figures.discounts(level)
        kept = c * d[np.where(c <= KATZ_K, c, 0).astype(np.int64)]
        left = np.bincount(history, weights=c - kept, minlength=len(histories))
        none = left <= 0  # such a history counts one token more
        chance = np.where(none[history], c / (total + 1)[history], kept / total[history])
        left = np.where(none, 1 / (total + 1), left / total)
        if level == 2:
            ones = word_count[first] + 1
            rest = (figures.whole - np.bincount(history, weights=ones, minlength=len(histories))) / figures.whole
            shorter = ones / figures.whole
        else:
            below = out[-1]
            shorter = below.chance[np.searchsorted(below.keys, gram_keys([x[first] for x in columns], level - 1))]
            rest = 1 - np.bincount(history, weights=shorter, minlength=len(histories))
        out.append(Level(keys, chance, histories, total, left / rest, history, shorter))
    return out


def answer_range(q: int, rows: dict[str, list[tuple[int, bytes]]], texts: int, book: Book) -> Iterator[tuple[str, int, int, bytes]]:
    """The counts that the ranges asked for, in the order of their words."""
    names, count = counts_of(rows, texts)
    for p, block in rows.get("ask", []):
        at, known = found_in(names, book.words_of(*thaw(block)))
        yield "counts", p, q, freeze(narrow(np.where(known, count[at], 0)))


@dataclass
class Model:
    """Stored rows of SCHEMA: grams (n-grams and counts by range and slice), vocab (words and counts), counts (of the words that follow in a range)."""

    rows: DataFrame
    setup: Setup
    figures: Figures

    def save(self, path: str) -> None:
        """Parquet partitioned by kind; refuses a path that exists."""
        book = base64.b64encode(self.setup.book.words.tobytes()).decode()
        meta = json.dumps({"order": self.setup.order, "parts": self.setup.parts, "book": book, "figures": asdict(self.figures)}).encode()
        spark = self.rows.sparkSession
        head = spark.createDataFrame([("meta", 0, 0, bytearray(meta))], SCHEMA)
        self.rows.unionByName(head).write.partitionBy("kind").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).select("kind", "target", "chunk", "block")
        meta = json.loads(bytes(rows.where("kind = 'meta'").first()["block"]))
        found = meta["figures"]
        found["counts"] = tuple(map(tuple, found["counts"]))
        book = Book(np.frombuffer(base64.b64decode(meta["book"]), np.uint64))
        return Model(rows.where("kind <> 'meta'"), Setup(meta["order"], meta["parts"], book), Figures(**found))

    def table(self) -> DataFrame:
        """The model in plain columns: an n-gram of every order from two a row, its discounted and its shorter probability, its history's backoff weight."""
        setup, figures = self.setup, self.figures

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in grouped(batches, "target"):
                for level, found in ((i, x) for levels in range_levels(rows, setup, figures) for i, x in enumerate(levels[0], 2)):
                    arrays = [np.full(len(found.keys), level, np.int32), found.histories[found.history].view(np.int64), found.keys.view(np.int64)]
                    arrays += [found.chance, found.shorter, found.weight[found.history]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["order", "history", "gram", "probability", "shorter", "weight"])

        rows = self.rows.where("kind in ('grams', 'counts')").repartition(setup.parts, "target").sortWithinPartitions("target", "kind", "chunk")
        return rows.mapInArrow(run, "order int, history long, gram long, probability double, shorter double, weight double")

    def score(self, docs: DataFrame) -> DataFrame:
        """One row per text: doc_id, n_tokens, n_known, base_score, score (log10 probabilities)."""
        setup, figures, parts = self.setup, self.figures, self.setup.parts
        tokens = pack_tokens(docs, setup).unionByName(self.rows.where("kind in ('grams', 'counts')"))
        scored = computed(dealt(tokens, "target", parts, lambda p, rows: score_range(p, rows, setup, figures)))
        asked = scored.where("kind = 'base'").unionByName(self.rows.where("kind = 'vocab'"))
        added = dealt(asked, "target", parts, lambda q, rows: base_range(rows, setup, figures))
        back = scored.where("kind in ('texts', 'sums')").unionByName(added)
        kind = docs.schema["doc_id"].dataType.simpleString()
        back = back.repartition(parts, "chunk").sortWithinPartitions("chunk")
        return back.mapInArrow(_finisher(figures), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def train(docs: DataFrame, order: int = 3) -> Model:
    """The model of all texts of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    setup = Setup(order, max(8, -(-size // RANGE_BYTES)), code_book(docs))
    counted = computed(dealt(pack_types(docs, setup), "target", setup.parts, lambda p, rows: count_range(p, rows, setup)))
    found = [thaw(r["block"])[0] for r in counted.where("kind = 'figures'").select("block").collect()]  # a few numbers per range
    sums = np.sum(found, axis=0) if found else np.zeros(3 + (order - 1) * (KATZ_K + 1), np.int64)
    texts = int(sums[2])
    counts = tuple(tuple(map(int, x)) for x in sums[3:].reshape(order - 1, KATZ_K + 1))
    figures = Figures(int(sums[0]), int(sums[1]) + (texts > 0), texts, counts)
    asked = counted.where("kind in ('ask', 'vocab')")
    answers = computed(dealt(asked, "target", setup.parts, lambda q, rows: answer_range(q, rows, texts, setup.book)))
    return Model(counted.where("kind in ('grams', 'vocab')").unionByName(answers), setup, figures)


def code_book(docs: DataFrame) -> Book:
    """The most frequent words of some texts of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = BOOK_TEXTS
        for batch in batches:
            for step in range(0, min(left, batch.num_rows), 128):
                words, count = np.unique(word_hashes(batch.slice(step, 128).column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(count)], ["word", "n"])
            left -= batch.num_rows
            if left <= 0:
                return

    some = docs.select("text").mapInArrow(run, "word long, n long")
    top = some.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(BOOK_WORDS).select("word").collect()
    return Book(np.concatenate([np.array([END, BEGIN]), np.array([r["word"] for r in top], np.int64).view(np.uint64)]))


# scoring


def pack_tokens(docs: DataFrame, setup: Setup) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("katz")
        for number, words, sizes, rows in chunks(batches):
            text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            names, columns = columns_of(words, sizes, setup.order)
            del words
            for p, block in packed(names, columns, text, setup, rising=True):
                yield _rows([("tokens", p, number, block)])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema) as out:
                for r in rows:
                    out.write_batch(r)
            body = zstandard.compress(sink.getvalue().to_pybytes(), 1)
            yield _rows([("texts", number % setup.parts, number, joined(freeze(narrow(sizes)), body))])

    return _placed(docs).mapInArrow(run, SCHEMA)


def range_levels(rows: dict[str, list[tuple[int, bytes]]], setup: Setup, figures: Figures) -> Iterator[tuple[list[Level], int, np.ndarray, np.ndarray]]:
    """Of each slice of a range that has any: levels, number, and the words that follow in the range with their counts."""
    grams = sorted(rows.pop("grams", []))  # slices are read one at a time, twice
    followers = np.empty(0, np.uint64)
    for _, block in grams:
        names, columns, _ = Blocks([block], setup).numbered(0, 1)
        followers = np.union1d(followers, names[np.bincount(columns[-1], minlength=len(names)) > 0])
    count = [thaw(b)[0].astype(np.int64) for _, b in sorted(rows.pop("counts", []))]
    count = np.concatenate(count) if count else np.empty(0, np.int64)
    while grams:
        number, block = grams.pop(0)
        columns, c = Blocks([block], setup).read(0, 0, 1)
        yield levels_of(columns, c, count[np.searchsorted(followers, columns[-1])], setup, figures), number, followers, count


def score_range(p: int, rows: dict[str, list[tuple[int, bytes]]], setup: Setup, figures: Figures) -> Iterator[tuple[str, int, int, bytes]]:
    """Sums of a range's tokens per text; base-level tokens whose word doesn't follow in the range ask the word's range."""
    for number, block in rows.pop("texts", []):
        yield "texts", p, number, block
    found = rows.pop("tokens", [])
    coded = [b for _, b in found]
    found = [(chunk, None) for chunk, _ in found]  # Blocks lets go of what it has read
    blocks = Blocks(coded, setup, rising=True)
    parts: list[list[list[np.ndarray]]] = [[] for _ in found]
    bases: list[list[np.ndarray]] = [[] for _ in found]
    followers, count, done = np.empty(0, np.uint64), np.empty(0, np.int64), set()

    def work(levels: list[Level] | None, number: int) -> None:
        for i in range(len(found)):
            columns, text = blocks.read(i, p * SLICES + number, setup.parts * SLICES)
            if len(text):
                value, base, known, late = evaluate(columns, levels, followers, count, figures)
                names, own = np.unique(text, return_inverse=True)
                parts[i].append([names, *[np.bincount(own, weights=x, minlength=len(names)) for x in (value, base, known)]])
                if len(late):
                    bases[i].append((columns[-1][late], text[late]))

    for levels, number, followers, count in range_levels(rows, setup, figures):  # noqa: B020
        done.add(number)
        for level in levels:  # only the table shows these
            level.history = level.shorter = np.empty(0)
        work(levels, number)
    for number in set(range(SLICES)) - done:
        work(None, number)
    for (chunk, _), some, late in zip(found, parts, bases, strict=True):
        if some:
            text, value, base, known = (np.concatenate(x) for x in zip(*some, strict=True))
            names, own = np.unique(text, return_inverse=True)
            value, base, known = (np.bincount(own, weights=x) for x in (value, base, known))
            yield "sums", 0, chunk, freeze(narrow(names), value, base, narrow(known.astype(np.int64)))
        if late:
            word, text = (np.concatenate(x) for x in zip(*late, strict=True))
            order = np.argsort(word, kind="stable")
            word, text = word[order], text[order]
            borders = range_borders(word, setup.parts)
            for q in range(setup.parts):
                s = slice(borders[q], borders[q + 1])
                if s.stop > s.start:
                    first = np.flatnonzero(np.r_[True, word[s][1:] != word[s][:-1]])
                    yield "base", q, chunk, freeze(word[s][first], narrow(np.diff(np.r_[first, s.stop - s.start])), narrow(text[s]))


def evaluate(columns: list[np.ndarray], levels: list[Level] | None, followers: np.ndarray, count: np.ndarray, figures: Figures):
    """Per token: log10 probability (without the base level's of late ones), log10(c + 1) and whether c > 0 of its last history word; late ones."""
    n = len(columns[0])
    value, rest = np.zeros(n), np.arange(n)
    for level in range(len(columns), 1, -1):  # from the longest history to the shortest
        if levels is None or not len(rest):
            continue
        model, some = levels[level - 2], [c[rest] for c in columns]
        at, seen = found_in(model.keys, gram_keys(some, level))
        value[rest[seen]] += np.log10(model.chance[at[seen]])
        rest, some = rest[~seen], [c[~seen] for c in some]
        at, known = found_in(model.histories, history_keys(some, level))
        value[rest[known]] += np.log10(model.weight[at[known]])
    at, here = found_in(followers, columns[-1][rest])
    value[rest[here]] += np.log10(count[at[here]] + 1.0)
    value[rest] -= np.log10(figures.whole)
    inner = columns[0] != BEGIN  # each word but the end mark is the last history word of one token
    own = np.zeros(n)
    if levels is not None:
        at, known = found_in(levels[0].histories, columns[0])
        own = np.where(known & inner, levels[0].total[at], 0.0)
    return value, np.log10(own + 1.0), own > 0, rest[~here]


def base_range(rows: dict[str, list[tuple[int, bytes]]], setup: Setup, figures: Figures) -> Iterator[tuple[str, int, int, bytes]]:
    names, count = counts_of(rows, figures.texts)
    for chunk, block in rows.get("base", []):
        word, times, text = thaw(block)
        at, known = found_in(names, word)
        value = np.repeat(np.log10(np.where(known, count[at], 0) + 1.0), times)
        texts, own = np.unique(text, return_inverse=True)
        zero = np.zeros(len(texts))
        yield "sums", 0, chunk, freeze(texts, np.bincount(own, weights=value), zero, zero.astype(np.uint8))


def _finisher(figures: Figures):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "chunk"):
            frozen, body = parted(rows["texts"][0][1])
            ids = pa.ipc.open_stream(zstandard.decompress(body)).read_all().column(0).combine_chunks()
            sizes = thaw(frozen)[0].astype(np.int64)
            value, base, known = (np.zeros(len(sizes)) for _ in range(3))
            for _, block in sorted(rows.get("sums", [])):  # in one order, so that sums round alike
                text, *some = thaw(block)
                for out, x in zip((value, base, known), some, strict=True):
                    out[text] += x
            base += np.log10(figures.texts + 1.0) - sizes * np.log10(figures.whole)
            known += figures.texts > 0
            columns = [ids, pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return finish


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7) == 2


def score(docs: DataFrame, order: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from those not held out."""
    model = train(docs.where(~held_out()), order)
    tokens = F.lit(model.figures.tokens).cast("long").alias("train_tokens")
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")
