"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set are the 64-bit hashes of its distinct shingles. Sizes fall into bands; a band divides
the universe of hashes into segments. Two sets that link differ in at most H tokens, so that of any H+1
segments one is equal in both. Each set therefore emits hashes of its first non-empty segments (its
*subset*), as many as the largest H of its size asks for, plus one: in its own band, and in the next
lower one if a set of that band can be its partner. Empty segments would meet everywhere and are left
out; a small set that is short of segments takes neighbourhoods instead: each segment with one token
deleted, worth one unit more each, which all sets of bands up to ``DELETION_SIZE`` index. Whoever is short even
then is joined through its single tokens. Candidates are kept only if they meet often enough (a lower
bound from the two sizes), and each is verified on the whole sets.

Groups of copies aren't expanded: equal sets are one class, and a bucket with many members is never paired:
its members are compared with a pivot, and further candidates come from what two members share beside it
(see ``links``).

Defined results: null or blank text has an empty set and links with nothing; fewer words than a shingle
count as one shingle; repeated rows are copies; an empty table gives an empty result; further columns are
ignored by ``components`` and handed through by ``representatives``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import free_names, only
from sparkloom.llm.tokens import mix, word_hashes
from sparkloom.operators.components import connected_components
from sparkloom.operators.lineage import cut

#: Bands grow by this ratio, up to the size's type.
BAND = 1.4
#: In bands up to this size every segment is indexed with its deletion neighbourhood.
DELETION_SIZE = 120
#: Bitmaps of differences to a pivot have so many words (a power of two).
LANES = 4
#: Members of a bucket that are paired without a pivot.
SMALL_CELL = 6
#: Cells of more members than this put tokens that many of them hold last; about ``JUDGES`` members tell which.
LARGE_CELL = 32
JUDGES = 16
#: Keys of sets that are broadcast at most (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Tokens of pivots' sets that are broadcast at most (8 bytes each).
BROADCAST_TOKENS = 4_000_000
#: Keys of sets that a task remembers to emit a set once.
KEPT_KEYS = 300_000
_M1 = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, given the hashes of its words."""
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < width:
        whole = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            whole = mix(whole * _M1 + h[k : k + 1])
        return whole
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= _M1
        out += h[k : k + n]
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [shingle_set(hashes[e - c : e], width) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


@dataclass(frozen=True)
class Threshold:
    """Two sets link when ``of`` * intersection >= ``at`` * union."""

    at: int = 85
    of: int = 100

    def differ(self, both: int) -> int:
        """Most tokens in which two sets of ``both`` tokens together can differ and link."""
        return (self.of - self.at) * both // (self.of + self.at)

    def partner(self, size: int) -> int:
        """Largest size of a set that links with one of this size."""
        return size * self.of // self.at

    def most(self, size: int) -> int:
        return self.differ(size + self.partner(size))


def bands(limit: int = 1 << 26) -> list[int]:
    """Largest size of each band."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


_TOPS = np.array(bands())


@lru_cache(maxsize=256)
def segments_of(top: int, rule: Threshold) -> int:
    """Segments of a band: its largest quota, and room for more empty ones than chance is likely to give."""
    quota = rule.most(top) + 1
    if top <= DELETION_SIZE:
        return quota + 1  # neighbourhoods make up for empty ones
    segments = quota
    for _ in range(8):
        empty = segments * math.exp(-top / segments)
        segments = quota + 3 + math.ceil(empty + 5 * math.sqrt(empty))
    return segments


def segment_rows(tokens: np.ndarray, band: int, rule: Threshold) -> tuple[np.ndarray, bool]:
    """Hashes that the set emits in a band, and whether they are too few for its size."""
    top = int(_TOPS[band])
    segments = segments_of(top, rule)
    need = rule.most(min(len(tokens), top)) + 1
    at = (mix(tokens ^ np.uint64(band)) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, values = at[order], mix(tokens[order])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    held = np.diff(np.r_[first, len(at)])
    sums = np.add.reduceat(values, first)
    where = at[first].astype(np.uint64) + np.uint64((band + 1) << 32)
    exact = mix(sums * _M1 + where)
    if top > DELETION_SIZE:
        return exact[:need], len(first) < need
    own = np.repeat(np.arange(len(first)), held)
    less = mix((sums[own] - values) * _M1 + where[own])[held[own] > 1]  # less than one token is an empty segment
    return np.unique(np.concatenate([exact, less])), 2 * len(first) - int((held == 1).sum()) < need


def emitted(tokens: np.ndarray, rule: Threshold) -> tuple[np.ndarray, bool]:
    """All hashes of a set, and whether it must also be joined by single tokens."""
    size = len(tokens)
    if rule.most(size) == 0:
        return np.empty(0, np.uint64), False  # links with equal sets only
    own = int(np.searchsorted(_TOPS, size))
    out, late = [], False
    for band in (own, own - 1):
        if band < own and (band < 0 or rule.partner(int(_TOPS[band])) < size):
            continue
        rows, short = segment_rows(tokens, band, rule)
        out.append(rows)
        late |= short
    return np.concatenate(out), late


def set_key(tokens: np.ndarray) -> int:
    """Key of a set: its xxhash as a signed 64-bit number; 0 for the empty set."""
    if not len(tokens):
        return 0
    found = xxhash.xxh3_64_intdigest(tokens.tobytes()) | 1
    return found - (1 << 64) if found >> 63 else found


def _sets(docs: DataFrame, width: int, columns: str, build, *more: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        seen: set[int] = set()
        for batch in batches:
            for step in range(0, batch.num_rows, 256):
                part = batch.slice(step, 256)
                yield build(part, shingle_sets(part.column(1), width), seen)

    return docs.select("doc_id", "text", *[c.alias(f"more{i}") for i, c in enumerate(more)]).mapInArrow(run, columns)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: doc_id, n (size of its set), k (key of its set) and t (hash of its text)."""

    def build(rows: pa.RecordBatch, sets: list, _: set) -> pa.RecordBatch:
        sizes, keys = pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(0), sizes, keys, rows.column(2)], ["doc_id", "n", "k", "t"])

    return _sets(docs, width, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, k long, t long", build, text_hash())


def signatures(docs: DataFrame, width: int, rule: Threshold, single: bool = False) -> DataFrame:
    """(sig, k, n): what each different set emits; a task emits a set once. ``single``: its tokens.

    n is the set's size, negative if what it emits is too little for its size.
    """

    def build(_: pa.RecordBatch, sets: list, seen: set[int]) -> pa.RecordBatch:
        sig, k, n = [], [], []
        for s in sets:
            key = set_key(s)
            if not key or key in seen:
                continue
            if len(seen) > KEPT_KEYS:
                seen.clear()
            seen.add(key)
            rows, short = (s, False) if single else emitted(s, rule)
            sig.append(rows)
            k.append(np.full(len(rows), key, np.int64))
            n.append(np.full(len(rows), -len(s) if short else len(s), np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        columns = [join(sig, np.uint64).view(np.int64), join(k, np.int64), join(n, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "k", "n"])

    return _sets(docs, width, "sig long, k long, n int", build)


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    def build(_: pa.RecordBatch, sets: list, seen: set[int]) -> pa.RecordBatch:
        keys = [set_key(s) for s in sets]
        first = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                first.append(i)
        if len(seen) > KEPT_KEYS:
            seen.clear()
        values = pa.array([sets[i].view(np.int64) for i in first], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in first], pa.int64()), values], ["k", "tokens"])

    return _sets(docs, width, "k long, tokens array<long>", build)


def fitting(rule: Threshold, a: str = "na", b: str = "nb") -> Column:
    return F.least(a, b) * rule.of >= F.greatest(a, b) * rule.at


def needed(rule: Threshold, na: str, nb: str) -> Column:
    """Least intersection of a linking pair of these sizes."""
    return F.expr(f"({rule.at} * ({na} + {nb}) + {rule.of + rule.at - 1}) div {rule.of + rule.at}")


def least_shared(rule: Threshold) -> Column:
    """Fewest equal hashes of a linking pair of sizes na and nb: the smaller one's quota less what may differ."""
    lo = F.least("na", "nb")
    a, b = rule.of - rule.at, rule.of + rule.at
    quota = F.expr(f"({a} * (least(na, nb) + least(na, nb) * {rule.of} div {rule.at})) div {b} + 1")
    differ = F.expr(f"({a} * (na + nb)) div {b}")
    return F.when(lo <= DELETION_SIZE, F.lit(1)).otherwise(F.greatest(F.lit(1), quota - differ))


def sets_of(docs: DataFrame, keys: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(k, tokens) of the wanted set keys, each from one document that has it; computed once."""
    few = wanted.count() <= BROADCAST_KEYS
    held = keys.join(F.broadcast(wanted) if few else wanted, "k", "left_semi")
    ids = cut(held.groupBy("k").agg(F.min("doc_id").alias("id")).select("id").distinct())
    some = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    found = whole_sets(some, width)
    found = cut(found.join(F.broadcast(wanted) if few else wanted, "k", "left_semi"))
    once = found.count() == found.select("k").distinct().count()  # unless ids repeat; then sets needn't travel
    return found if once else cut(found.dropDuplicates(["k"]))


def among(rows: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """The rows whose ``key`` is among the keys (one column of that name); up to a size rows don't travel for it."""
    keys = cut(keys.distinct())
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_semi")


def paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys with the sizes (na, nb) and tokens (ta, tb) of both; only sets of the pairs travel."""
    pairs = cut(pairs.select("a", "b"))
    one, two = (sets.select(F.col("k").alias(end), F.col("n").alias(f"n{end}"), F.col("tokens").alias(f"t{end}")) for end in ("a", "b"))
    if pairs.count() <= BROADCAST_KEYS:
        some = one.join(F.broadcast(pairs), "a")
    else:
        some = pairs.join(among(one, pairs.select("a"), "a"), "a")
    return some.join(among(two, pairs.select("b"), "b"), "b")


def alike(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a, b) of set keys that can link, by 16 bits of each token: a quarter of the bytes of whole sets."""
    part = F.expr("array_distinct(transform(tokens, t -> cast((shiftright(t, 24) & 65535) - 32768 as smallint)))")
    both = paired(pairs, sets.select("k", F.size("tokens").alias("n"), part.alias("tokens")))
    # tokens of one set that have the same bits count as shared
    most = F.size(F.array_intersect("ta", "tb")) + F.least(F.col("na") - F.size("ta"), F.col("nb") - F.size("tb"))
    return both.where(most >= needed(rule, "na", "nb")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a, b) of set keys that link, by their whole sets."""
    both = paired(pairs, sets.select("k", F.size("tokens").alias("n"), "tokens"))
    shared = both.withColumn("i", F.size(F.array_intersect("ta", "tb")))
    return shared.where(F.col("i") * rule.of >= (F.col("na") + F.col("nb") - F.col("i")) * rule.at).select("a", "b")


def labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the component of the set ``key``; a set without links is its own."""
    own = labels.select(F.col("v").alias(key), F.col("label").alias(name))
    return rows.join(own, key, "left").withColumn(name, F.coalesce(name, key))


def common(pairs: DataFrame, members: DataFrame, pivots: DataFrame, small: bool) -> DataFrame:
    """(p, often): tokens beside the pivot of a large cell that two or more of some of its members hold.

    It only decides the order in which a cell's tokens are looked at, so that judging by some members loses nothing.
    """
    sizes = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LARGE_CELL)
    sizes = cut(sizes)
    few = sizes.count() <= BROADCAST_KEYS
    some = pairs.join(F.broadcast(sizes) if few else sizes, "p").where(F.expr(f"pmod(xxhash64(p, k), c) < {JUDGES}")).select("p", "k")
    some = cut(some)
    left = members.join(F.broadcast(some) if some.count() <= BROADCAST_KEYS else some, "k")
    tokens = left.join(F.broadcast(pivots) if small else pivots, "p").select("p", F.explode(F.array_except("t", "tp")).alias("token"))
    often = tokens.groupBy("p", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return cut(often.groupBy("p").agg(F.collect_list("token").alias("often")))


def compared(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """Of (p, k): np, n, i (sizes, intersection), linked, and what must be shared (see ``links``).

    ``away`` are the first tokens outside the pivot, in an order that a cell shares: rare ones, ``rare`` in number,
    before common ones. For partners that aren't smaller the first ``short`` of them do.
    """
    pairs = cut(pairs)
    pivots = cut(among(sets.select(F.col("k").alias("p"), F.col("tokens").alias("tp")), pairs.select("p"), "p"))
    # few beside the members; by their size pivots and pairs are broadcast, so that members' sets don't travel
    small = (pivots.agg(F.sum(F.size("tp"))).first()[0] or 0) <= BROADCAST_TOKENS
    members = sets.select("k", F.col("tokens").alias("t"))
    often = common(pairs, members, pivots, small)
    light = (often.agg(F.sum(F.size("often"))).first()[0] or 0) <= BROADCAST_TOKENS
    if pairs.count() <= BROADCAST_KEYS:
        left = members.join(F.broadcast(pairs), "k")
    else:
        left = pairs.join(among(members, pairs.select("k")), "k")
    both = left.join(F.broadcast(pivots) if small else pivots, "p")
    both = both.join(F.broadcast(often) if light else often, "p", "left")
    rows = both.withColumns({"np": F.size("tp"), "n": F.size("t"), "i": F.size(F.array_intersect("t", "tp"))})
    rows = rows.withColumn("linked", F.col("i") * rule.of >= (F.col("np") + F.col("n") - F.col("i")) * rule.at)
    least = F.greatest(F.lit(1), F.expr(f"({rule.at} * n + {rule.of - 1}) div {rule.of} - i").cast("int"))
    most = F.greatest(F.lit(1), (needed(rule, "n", "n") - F.col("i")).cast("int"))
    inside = F.col("i") * rule.of >= F.col("n") * rule.at
    some = F.expr("np - i - (n + np - 2 * i + 2) div 2 + 1").cast("int")
    empty = F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumns({"more": F.array_except("t", "tp"), "gone": F.array_except("tp", "t")})
    rows = rows.withColumn("first", F.coalesce(F.array_except("more", "often"), F.col("more")))
    rows = rows.withColumn("last", F.coalesce(F.array_intersect("more", "often"), empty))
    away = F.slice(F.concat("first", "last"), F.lit(1), F.greatest(F.lit(0), F.col("n") - F.col("i") - least + 1))
    short = F.greatest(F.lit(0), F.col("n") - F.col("i") - most + 1)
    probe = F.when(inside & (F.col("n") < F.col("np")), F.slice("gone", F.lit(1), F.greatest(F.lit(0), some))).otherwise(empty)
    index = F.when(inside & ~F.col("linked"), F.col("gone")).otherwise(empty)
    marks = [bits(x, lane).alias(f"{x}{lane}") for x in ("more", "gone") for lane in range(LANES)]
    lists = [away.alias("away"), probe.alias("probe"), index.alias("index"), short.alias("short"), F.size("first").alias("rare")]
    return rows.select("p", "k", "np", "n", "i", "linked", *lists, *marks)


def place(token: str) -> tuple[str, str]:
    """Lane and bit of a token in bitmaps, by the first bits of its hash: in the order of the sets."""
    first = LANES.bit_length() - 1
    return f"cast(shiftrightunsigned({token}, {64 - first}) as int)", f"cast(shiftrightunsigned({token}, {58 - first}) & 63 as int)"


def bits(tokens: str, lane: int) -> Column:
    """64 of the bits of a set's bitmap: one for each token; tokens may share one."""
    at, bit = place("t")
    return F.expr(f"aggregate({tokens}, 0L, (m, t) -> if({at} = {lane}, m | shiftleft(1L, {bit}), m))")


def later(token: str, lane: int) -> Column:
    """The bits of a lane that come after a token's."""
    at, bit = place(token)
    return F.expr(f"case when {at} < {lane} then -1L when {at} > {lane} then 0L else shiftleft(shiftleft(-1L, {bit}), 1) end")


def telling(tokens: DataFrame) -> DataFrame:
    """(p, token, part) that members of different components share, one at least among its first (``short``); of those that
    the same members hold the first in their order (``last``: after all others), for they say the same."""
    sign = F.lit(-(1 << 63))  # sets are in the order of unsigned numbers
    members = [F.expr(f"bit_xor(xxhash64({i}, kind, k))").alias(f"h{i}") for i in range(2)]
    figures = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("kind").alias("a"), F.max("kind").alias("b"), F.max("short").alias("s")]
    apart = tokens.groupBy("p", "token", "part", "last").agg(*figures, *members, F.count(F.lit(1)).alias("c"))
    apart = apart.where("lo <> hi and if(part, a <> b, s)")
    first = F.min(F.struct("last", F.col("token").bitwiseXOR(sign).alias("token")))["token"].bitwiseXOR(sign)
    return apart.groupBy("p", "part", "c", "h0", "h1").agg(first.alias("token")).select("p", "token", "part")


_FIGURES = ["np", "n", "i", "short", "rare", *[f"{x}{lane}" for x in ("more", "gone") for lane in range(LANES)]]


def beside_pivots(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """(p, token, at, kind, k, label, own, ...) of tokens beside a pivot that members of different components share; ``at``: their places."""
    rows = cut(labelled(labelled(seen, labels, "k", "label"), labels, "p", "own"))
    tokens = None
    for kind, column in enumerate(("away", "probe", "index")):
        some = rows.select("p", "k", "label", "short", "rare", F.lit(kind).alias("kind"), F.posexplode(column).alias("at", "token"))
        some = some.withColumns({"short": F.expr("kind = 0 and at < short"), "last": F.expr("kind = 0 and at >= rare")}).drop("rare")
        tokens = some if tokens is None else tokens.unionByName(some)
    # first the few tokens that members of different components share; taking them from the rows again needs no disk
    tokens = tokens.withColumn("part", F.col("kind") > 0)
    apart = cut(telling(tokens))
    few = apart.count() <= BROADCAST_KEYS
    kept = tokens.join(F.broadcast(apart) if few else apart, ["p", "token", "part"], "left_semi").select("p", "k", "kind", "at", "token")
    return cut(kept.join(rows.select("p", "k", "label", "own", *_FIGURES), ["p", "k"]))


def relabelled(rows: DataFrame, before: DataFrame, labels: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the components as they are by ``labels``, given those of ``before``."""
    old = before.select("v", F.col("label").alias("old"))
    moved = cut(labels.join(old, "v", "left").select(F.coalesce("old", "v").alias("old"), F.col("label").alias("new")).where("old <> new").distinct())
    few = moved.count() <= BROADCAST_KEYS
    for name in names:
        to = moved.withColumnRenamed("old", name)
        rows = rows.join(F.broadcast(to) if few else to, name, "left").withColumn(name, F.coalesce("new", name)).drop("new")
    return rows


def _count(body: Callable[[Column, Column, int], Column], of: str) -> Column:
    return sum((F.bit_count(body(F.col(f"{of}{lane}_a"), F.col(f"{of}{lane}_b"), lane)) for lane in range(LANES)), F.lit(0))


def _shared() -> tuple[Column, Column]:
    """Bounds from above of what members a and b share outside the pivot and of the pivot, from their bitmaps."""
    out_a, out_b = F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")
    one, two = _count(lambda a, b, _: a.bitwiseAND(F.bitwise_not(b)), "more"), _count(lambda a, b, _: b.bitwiseAND(F.bitwise_not(a)), "more")
    return F.least(out_a - one, out_b - two), F.least("i_a", "i_b", F.col("np_a") - _count(lambda a, b, _: a.bitwiseOR(b), "gone"))


def _first(of: str, held: tuple[Column, Column], least: Column, hashed: Column) -> Column:
    """Whether a token can be the first of ``least`` tokens, one at least, that the ``of`` of a and b share, of so many ``held``.

    ``hashed``: all tokens of later hashes come after this one. Else bitmaps can't tell what comes after.
    """
    one = _count(lambda a, b, lane: a.bitwiseAND(F.bitwise_not(b)).bitwiseAND(later("token", lane)), of)
    two = _count(lambda a, b, lane: b.bitwiseAND(F.bitwise_not(a)).bitwiseAND(later("token", lane)), of)
    one, two = (F.when(hashed, x).otherwise(0) for x in (one, two))
    return F.least(held[0] - F.col("at_a") - one, held[1] - F.col("at_b") - two) >= F.greatest(F.lit(1), least)


def _different(rule: Threshold) -> Column:
    return (F.col("label_a") != F.col("label_b")) & (F.col("k_a") != F.col("k_b")) & fitting(rule, "n_a", "n_b")


def led(kept: DataFrame, rule: Threshold) -> DataFrame:
    """Candidates (a, b): each member with one of those that lead the tokens it holds beside a pivot, the one it shares most with.

    A token's lead is the member of it that shares most with the pivot.
    """
    rows = kept.where("kind = 0").select("p", "token", "k", "label", "i")
    lead = rows.groupBy("p", "token").agg(F.max(F.struct("i", "k", "label")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    lead = lead.where("lo <> hi").select("p", "token", F.col("m.k").alias("a"), F.col("m.label").alias("l"))
    met = rows.join(lead, ["p", "token"]).where("label <> l").groupBy("p", "a", F.col("k").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    figures = kept.select("p", "k", "label", *_FIGURES).distinct()
    for key, end in (("a", "_a"), ("b", "_b")):
        met = met.join(figures.select("p", F.col("k").alias(key), *[F.col(x).alias(x + end) for x in ("k", "label", *_FIGURES)]), ["p", key])
    outside, within = _shared()
    met = met.where(_different(rule) & (outside + within >= needed(rule, "n_a", "n_b")))
    return met.groupBy("b").agg(F.max(F.struct("c", "a"))["a"].alias("a")).select("a", "b").distinct()


def meetings(kept: DataFrame, rule: Threshold) -> DataFrame:
    """Candidates (a, b) among members of a pivot's cells that are in different components, once for each token that can be their first."""

    def side(kind: int, end: str) -> DataFrame:
        return kept.where(F.col("kind") == kind).select("p", "token", *[F.col(c).alias(c + end) for c in ("k", "at", "label", "own", *_FIGURES)])

    need = needed(rule, "n_a", "n_b")
    out_a, out_b = F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")
    gone_a, gone_b = F.col("np_a") - F.col("i_a"), F.col("np_b") - F.col("i_b")
    outside, within = _shared()
    # the smaller one has the token among its first
    sharing = side(0, "_a").where("at_a < short_a").join(side(0, "_b"), ["p", "token"]).where("n_a <= n_b")
    sharing = sharing.where(_different(rule) & (outside + within >= need) & _first("more", (out_a, out_b), need - within, F.expr("at_a < rare_a")))
    differ = F.expr(f"({rule.of - rule.at} * (n_a + n_b)) div {rule.of + rule.at}")
    lacking = side(1, "_a").join(side(2, "_b"), ["p", "token"])
    lacking = lacking.where(_different(rule) & (outside + within >= need) & (F.least("i_a", "i_b") >= need) & (out_a + out_b + F.abs(gone_a - gone_b) <= differ))
    lacking = lacking.where(_first("gone", (gone_a, gone_b), need - outside - F.col("np_a") + gone_a + gone_b, F.lit(True)))
    both = sharing.select("k_a", "k_b").unionByName(lacking.select("k_a", "k_b"))
    return both.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"))


def links(docs: DataFrame, keys: DataFrame, width: int, rule: Threshold) -> DataFrame:
    """(a, b) links between set keys, enough of them to connect all that are connected by links.

    Cells (buckets of one hash) of up to ``SMALL_CELL`` members are paired. A larger cell has a pivot p, the
    member that meets most; all members are compared with it exactly, and again with a second one if they
    are in other components by then. Two members x and y of different components that may still link
    are found by what they share beside p, not by pairing the cell: an intersection of at least ``need``
    has at least need - min(|x & p|, |y & p|) tokens outside p. Where that is positive, x and y meet in
    the prefixes of their tokens outside p (``away``), in any order of tokens that the cell shares; rare ones come
    first, so that what many members hold is seldom looked at. ``need`` grows with both sizes, so of the smaller
    one a shorter prefix (``short``) does. Else one of them, x, is smaller than p and the
    other, y, isn't linked with p, and they lack more than half of x's differences to p both; so they meet
    in a part of what x lacks (``probe``) and all that y lacks (``index``).

    Many copies of one text that differ as much as links allow have links by the square of their number. So
    members are compared with one other each first (``led``), and pairs are made only of what is in different
    components then.
    """
    order = W.partitionBy("sig").orderBy("k")
    rows = signatures(docs, width, rule)
    beside = (F.lag("k").over(order) != F.col("k")) | (F.lead("k").over(order) != F.col("k"))  # streams, holds no bucket
    met = rows.withColumn("met", F.coalesce(beside, F.lit(False))).where("met or n < 0")
    met = cut(met.select("sig", "k", F.abs("n").alias("n"), (F.col("n") < 0).alias("late")).dropDuplicates(["sig", "k"]))
    sizes = met.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    held = cut(met.join(sizes, "sig").select("sig", "k", "n", "c"))
    sets = sets_of(docs, keys, cut(held.select("k").distinct()), width)
    found = docs.sparkSession.createDataFrame([], "a long, b long")
    labels = docs.sparkSession.createDataFrame([], "v long, label long")
    large = held.where(F.col("c") > SMALL_CELL)
    kept = None
    if not large.isEmpty():
        degree = large.groupBy("k").agg(F.sum("c").alias("d"))
        member = cut(large.join(degree, "k").select("sig", "k", "n", "d"))
        lead = member.groupBy("sig").agg(F.max(F.struct("d", "k"))["k"].alias("p"))
        lead = cut(lead)
        seen = cut(compared(member.join(lead, "sig").where("k <> p").select("p", "k").distinct(), sets, rule))
        found = cut(seen.where("linked").select(F.col("p").alias("a"), F.col("k").alias("b")))
        labels = cut(connected_components(found))
        again = labelled(labelled(member.join(lead, "sig"), labels, "k", "label"), labels, "p", "own").where("label <> own")
        again = cut(again.select("sig", "k", "n", "d", "label"))
        lead = again.groupBy("sig").agg(F.max(F.struct("d", "k", "n", "label")).alias("m"))
        near = again.join(lead, "sig").where("label <> m.label").select(F.col("m.k").alias("a"), F.col("k").alias("b"), F.col("m.n").alias("na"), F.col("n").alias("nb"))
        near = near.where(fitting(rule)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
        best = near.groupBy("b").agg(F.max(F.struct("c", "a"))["a"].alias("a"))
        more = cut(verified(best, sets, rule))
        if not more.isEmpty():
            found = found.unionByName(more)
            labels = cut(connected_components(found))
        kept = beside_pivots(seen, labels)
        more = cut(verified(led(kept, rule), sets, rule))
        if not more.isEmpty():
            before, found = labels, found.unionByName(more)
            labels = cut(connected_components(found))
            kept = cut(relabelled(kept, before, labels, "label", "own"))
    # cells of few members; a pair's other meetings, in large cells, are as many as either has at most
    often = held.groupBy("k").agg(F.sum((F.col("c") > SMALL_CELL).cast("int")).alias("l"))
    rows = labelled(held.where(F.col("c") <= SMALL_CELL).join(often, "k"), labels, "k", "label")
    one, two = (rows.select("sig", *[F.col(c).alias(c + x) for c in ("k", "n", "l", "label")]) for x in ("a", "b"))
    few = one.join(two, "sig").where("ka < kb and labela <> labelb").where(fitting(rule))
    few = few.groupBy(F.col("ka").alias("a"), F.col("kb").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first(F.least("la", "lb")).alias("l")
    )
    few = few.where(F.col("c") + F.col("l") >= least_shared(rule)).select("a", "b")
    pairs = few if kept is None else few.unionByName(meetings(kept, rule)).distinct()
    out = found.unionByName(cut(verified(alike(pairs, sets, rule), sets, rule)))
    late = cut(met.where("late").select("k").distinct())
    if not late.isEmpty():
        out = out.unionByName(late_links(docs, keys, late, width, rule))
    return out


def late_links(docs: DataFrame, keys: DataFrame, late: DataFrame, width: int, rule: Threshold) -> DataFrame:
    """Links of the few sets that no allocation serves, found through their single tokens."""
    tokens = signatures(docs, width, rule, single=True).select("sig", "k", "n")
    few = late.count() <= BROADCAST_KEYS
    rare = cut(tokens.join(F.broadcast(late) if few else late, "k", "left_semi").select("sig", F.col("k").alias("a"), F.col("n").alias("na")))
    small = rare.count() <= BROADCAST_KEYS
    met = tokens.select("sig", F.col("k").alias("b"), F.col("n").alias("nb")).join(F.broadcast(rare) if small else rare, "sig")
    met = cut(met.where("a <> b").where(fitting(rule)).select("a", "b").distinct())
    ends = cut(met.select(F.col("a").alias("k")).unionByName(met.select(F.col("b").alias("k"))).distinct())
    return cut(verified(met, sets_of(docs, keys, ends, width), rule))


def classes(docs: DataFrame, width: int = 4, rule: Threshold = Threshold()) -> DataFrame:
    """One row per document: doc_id, n_shingles, k (its set's key) and label (its component's key)."""
    keys = cut(keyed(docs, width))
    labels = connected_components(links(docs, keys, width, rule)).withColumnRenamed("v", "k")
    return keys.join(labels, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), "k", "t", F.coalesce("label", "k").alias("label"))


def components(docs: DataFrame, width: int = 4, rule: Threshold = Threshold()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows = cut(classes(docs, width, rule))
    least = rows.where("k <> 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("k") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def representatives(docs: DataFrame, width: int = 5, rule: Threshold = Threshold(80)) -> DataFrame:
    """One row of each component with all its columns: that of the smallest doc_id (null last) and text hash.

    Rows are told apart by doc_id and text, so an id may repeat with other texts. Of rows equal in both one
    stays. Rows without words link with nothing and stay, but for repeated ones of the same id and text.
    """
    rows = cut(classes(docs, width, rule))
    row = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t")
    stays = rows.where("k <> 0").groupBy("label").agg(F.min(row).alias("r")).select("r.doc_id", "r.t")
    stays = cut(stays.unionByName(rows.where("k = 0").select("doc_id", "t")).distinct())
    times = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("times"))
    names = free_names(docs, "id", "t")
    match = F.col(names["id"]).eqNullSafe(F.col("doc_id")) & (F.col(names["t"]) == text_hash())
    same = (stays["doc_id"].eqNullSafe(times["doc_id"])) & (stays["t"] == times["t"])
    gone = cut(times.join(stays, same, "left_anti").select(F.col("doc_id").alias(names["id"]), F.col("t").alias(names["t"])))
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, match, "left_anti")
    again = times.where("times > 1").join(stays, same, "left_semi")
    again = cut(again.select(F.col("doc_id").alias(names["id"]), F.col("t").alias(names["t"])))
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, match, "left_anti").unionByName(once).select(*docs.columns)
