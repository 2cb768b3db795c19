"""Best-fit packing of documents into sequences, by linear grouping.

Large pieces are sorted by length and put into groups of equal cardinality, each group's lengths rounded
up to its largest; configurations of these few sizes are chosen by repeated exact knapsacks; actual pieces
take the places of the rounded ones; small pieces then go best fit into the room that is really left,
and into new sequences where none is.

The plan is made from the histogram of lengths alone (at most ``capacity`` of them), over *runs* of equal
sequences, so that its size and time don't follow the number of documents. Pieces are then ranked within
their length and looked up in the plan. Ranks are taken in parts, so that one length may hold any share
of the pieces.

Defined results: null text is one piece with the end id alone; a very long text is cut into pieces of the
capacity; repeated rows get places of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import sys
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import keeps, only
from sparkloom.operators.lineage import cut

#: Words (without case and signs at the end) that a worker's younger memory keeps; full, it becomes the older one, which is dropped.
KEPT_WORDS = 400_000
#: ... and their characters: sentences of unspaced script are words.
KEPT_CHARS = 8_000_000
#: Texts that are encoded together, and their UTF-8 bytes; a longer text is encoded alone.
STEP_TEXTS, STEP_BYTES = 256, 2 << 20
#: Settings of the execution that encodes: rows and bytes that travel to a worker together. Both sides hold them whole.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Signs that a word's part ends before, in no special token of the file.
ENDS = ".,!?;:#*$%&"
#: What parts are encoded between, so many in one text.
MARK, JOINED = "\x01", 64
END = (1).to_bytes(4, "little")
GROUPS = 40
#: A piece is large from this share of the capacity on.
LARGE = 8
MAX_PARTS = 64

#: Fixed values of vocabularies whose tokens never cross white space, and which ignore case.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: By file: two generations of known words and their ids; empty if its texts must be encoded whole.
_known: dict[str, list[dict[str, bytes]]] = {}
_loaded: dict[str, object] = {}


def _forget() -> None:
    for memory in _known.values():
        memory[:] = [{}, {}] if memory else []


keeps("packing", _forget)


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        _known[path] = [{}, {}] if {k: parts.get(k) for k in WORDWISE} == WORDWISE else []
    return _loaded[path], _known[path]


def split_words(text: str) -> list[str]:
    """Words at Unicode white space; this vocabulary's tokens never cross it."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        for mark in "\t\n\r\v\f":
            text = text.replace(mark, " ")
        return [x for x in text.split(" ") if x]
    return text.split()


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def _stays_letter(char: str) -> bool:
    """Whether what the file's rules make of a character ends with a letter: of some letters they make a letter and a sign, which joins what follows."""
    return char.isalpha() and (char.isascii() or unicodedata.normalize("NFC", char).lower()[-1].isalpha())


def _core(word: str) -> tuple[str, str]:
    """A word as a part and the signs that end it; the two are tokenized apart."""
    core = word.rstrip(ENDS)
    if not core or len(core) == len(word) or not _stays_letter(core[-1]):
        core = word
    return core.lower() if core.isascii() and "<" not in core else core, word[len(core) :]


def _encoded(parts: list[str], tokenizer) -> list[bytes]:
    """Ids of each part. Parts stand between marks in one text, since tokens don't cross white space and no other token has the mark's id."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    if len(mark) != 1 or MARK in "".join(parts):
        return [_bytes(x.ids) for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
    texts = [f" {MARK} ".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)]
    out = []
    for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
        ids = np.array(found.ids, "<u4")
        data, start = ids.tobytes(), 0
        for end in (np.flatnonzero(ids == mark[0]) * 4).tolist():
            out.append(data[start:end])
            start = end + 4
        out.append(data[start:])
    return out


def _learn(missing: list[str], tokenizer, memory: list[dict[str, bytes]]) -> tuple[dict[str, bytes], int]:
    """Ids of words that the younger memory lacks. It gets their parts alone, from the older one or encoded; also gives the characters that came in."""
    young, old = memory
    pairs = list(map(_core, missing))
    parts = {core for core, _ in pairs}
    parts.update([end for _, end in pairs if end])
    needed = [x for x in parts if x not in young]
    came = sum(map(len, needed))
    if old:
        before = {part: found for part in needed if (found := old.get(part)) is not None}
        young.update(before)
        needed = [x for x in needed if x not in before]
    for i in range(0, len(needed), 8192):
        some = needed[i : i + 8192]
        young.update(zip(some, _encoded(some, tokenizer), strict=True))
    return {word: young[core] + young[end] if end else young[core] for word, (core, end) in zip(missing, pairs, strict=True)}, came


#: Characters in the younger memory, by the tokenizer's path.
_kept: dict[str, int] = defaultdict(int)


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, the end id last.

    Words are looked up where the file's rules allow it (``WORDWISE``), else texts are encoded whole.
    """
    tokenizer, memory = _tokenizer(path)
    if not memory:
        for text in texts:
            yield _bytes(tokenizer.encode(text, add_special_tokens=False).ids) + END
        return
    lists = [split_words(t.lower() if t.isascii() and "<" not in t else t) for t in texts]  # special tokens hold a < and are met before case is ignored
    if len(memory[0]) > KEPT_WORDS or _kept[path] > KEPT_CHARS:
        memory[:] = [{}, memory[0]]
        _kept[path] = 0
    get, missing, found = memory[0].get, set(), []
    for words in lists:
        ids = list(map(get, words))
        holes = [i for i, x in enumerate(ids) if x is None] if None in ids else ()
        missing.update([words[i] for i in holes])
        found.append((ids, holes))
    made, came = _learn(list(missing), tokenizer, memory)
    _kept[path] += came
    for words, (ids, holes) in zip(lists, found, strict=True):
        for i in holes:
            ids[i] = made[words[i]]
        yield b"".join(ids) + END


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each step: only a step's texts are strings at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        n = min(STEP_TEXTS, max(1, int(np.searchsorted(ends, before + STEP_BYTES, side="right")) - at), len(ends) - at)
        yield at, n
        at += n


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    width = 4 * capacity
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, piece, start, length, crc = [], [], [], [], []
            for at, n in steps(texts):
                for row, data in enumerate(encode_texts([t or "" for t in texts.slice(at, n).to_pylist()], path), at):
                    for k in range(0, len(data), width):
                        part = data[k : k + width]
                        rows.append(row)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """``count`` equal sequences: lengths with how often each occurs, in order; ``room`` is left."""

    count: int
    room: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def best_pattern(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """Which of the sizes (largest first), at most as often as are left, fill the capacity best."""
    reach = np.zeros(capacity + 1, dtype=bool)
    reach[0] = True
    before = []
    for size, n in zip(sizes, left, strict=True):
        before.append(reach)
        for k in range(1, min(n, capacity // size) + 1):
            grown = reach.copy()
            grown[k * size :] |= before[-1][: capacity + 1 - k * size]
            reach = grown
    at, pattern = int(np.flatnonzero(reach)[-1]), {}
    for i in range(len(sizes) - 1, -1, -1):
        k = 0
        while not before[i][at - k * sizes[i]]:
            k += 1
        if k:
            pattern[i] = k
            at -= k * sizes[i]
    return pattern


def plan_large(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs of the large pieces: grouped, rounded, arranged, and put back to actual lengths."""
    order = sorted(counts, reverse=True)
    total = sum(counts.values())
    per = -(-total // GROUPS)
    groups: list[list[list[int]]] = []
    room = 0
    for length in order:
        n = counts[length]
        while n:
            if not room:
                groups.append([])
                room = per
            taken = min(n, room)
            groups[-1].append([length, taken])
            n, room = n - taken, room - taken
    sizes = [g[0][0] for g in groups]
    left = [sum(n for _, n in g) for g in groups]
    runs = []
    while any(left):
        open_ = [i for i, n in enumerate(left) if n]
        pattern = best_pattern([sizes[i] for i in open_], [left[i] for i in open_], capacity)
        pattern = {open_[i]: k for i, k in pattern.items()}
        times = min(left[i] // k for i, k in pattern.items())
        slots = []
        for i, k in pattern.items():
            left[i] -= k * times
            for _ in range(k):
                slots.append(_take(groups[i], times))
        runs += _aligned(slots, times, capacity)
    return runs


def _take(group: list[list[int]], n: int) -> list[tuple[int, int]]:
    out = []
    while n:
        length, have = group[0]
        taken = min(n, have)
        out.append((length, taken))
        n -= taken
        if taken == have:
            group.pop(0)
        else:
            group[0][1] -= taken
    return out


def _aligned(slots: list[list[tuple[int, int]]], times: int, capacity: int) -> list[Run]:
    """Runs of sequences whose slots all hold the same lengths."""
    heads = [0] * len(slots)
    used = [0] * len(slots)
    out = []
    while times:
        n = min(slots[i][heads[i]][1] - used[i] for i in range(len(slots)))
        parts: dict[int, int] = {}
        for i, slot in enumerate(slots):
            length = slot[heads[i]][0]
            parts[length] = parts.get(length, 0) + 1
            used[i] += n
            if used[i] == slot[heads[i]][1]:
                heads[i] += 1
                used[i] = 0
        out.append(Run(n, capacity - sum(a * b for a, b in parts.items()), list(parts.items())))
        times -= n
    return out


def add_small(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit, longest first: each small piece into the sequence with the least room that suffices."""
    rooms = sorted((r.room, i) for i, r in enumerate(runs))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, (length, -1))
            if at == len(rooms):
                each = capacity // length
                runs.append(Run(-(-n // each), capacity))
                bisect.insort(rooms, (capacity, len(runs) - 1))
                continue
            _, i = rooms.pop(at)
            run, each = runs[i], runs[i].room // length
            full = n // each
            if full >= run.count:
                n -= each * run.count
            elif full:
                rest = Run(run.count - full, run.room, list(run.parts))
                runs.append(rest)
                bisect.insort(rooms, (rest.room, len(runs) - 1))
                run.count = full
                n -= each * full
            else:
                if run.count > 1:
                    rest = Run(run.count - 1, run.room, list(run.parts))
                    runs.append(rest)
                    bisect.insort(rooms, (rest.room, len(runs) - 1))
                    run.count = 1
                each, n = n, 0
            run.parts.append((length, each))
            run.room -= each * length
            bisect.insort(rooms, (run.room, i))
    return runs


def make_plan(counts: dict[int, int], capacity: int) -> list[Run]:
    border = max(1, capacity // LARGE)
    large = {k: n for k, n in counts.items() if k > border}
    small = {k: n for k, n in counts.items() if k <= border}
    return add_small(plan_large(large, capacity), small, capacity)


def plan_table(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces of this length in each sequence), sorted."""
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, each in run.parts:
            rows.append((length, at.get(length, 0), sequence, offset, each))
            at[length] = at.get(length, 0) + each * run.count
            offset += length * each
        sequence += run.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cutup = cut(pieces(docs, tokenizer_path, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(MAX_PARTS)).cast("int")), BATCHES)
    rows = cutup.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity * MAX_PARTS at most
    counts: dict[int, int] = {}
    for r in rows:
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    total = sum(counts.values())
    parts = min(MAX_PARTS, 1 + 256 * max(counts.values(), default=0) // max(1, total))
    inside = np.zeros((capacity + 1, parts), dtype=np.int64)
    for r in rows:
        inside[r["length"], r["salt"] % parts] += r["n"]
    earlier = np.cumsum(inside, axis=1) - inside
    table = plan_table(make_plan(counts, capacity))
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "part", "rank"))
            rank = rank + earlier[length, part]
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            turn = rank - row[:, 1]
            sequence, offset = row[:, 2] + turn // row[:, 4], row[:, 3] + turn % row[:, 4] * length
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    order = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cutup.withColumn("part", F.col("salt") % parts).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "part", (F.row_number().over(order) - 1).cast("long").alias("rank")
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
