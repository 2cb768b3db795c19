"""Source divergence audit: how far the sources of a language use its frequent terms differently.

Rows (lang, term, source, document) are dealt by language and term, sorted within partitions (a term's own bytes decide
before its language's: which run comes first doesn't matter, and Spark compares the first eight bytes at once), and
scanned run by run: the run of a term gives its document frequency and its counts per source. Tasks sum up what they read
before that shuffle, a row for each language, term and source, so that a frequent term or a large source travels
as a few rows; ``document`` is the smallest one behind a row. Only terms in at least ``least`` documents of their
language go on; a second scan of the runs emits, per run, partial figures of pairs of sources and the terms that
a source has more of than its language.

A group (a source of a language, or the language) gives a kept term with ``n`` occurrences
1 + floor(10^9 * (n + 5) / (N + 5 V)), N being its occurrences of the V kept terms. The divergence of two sources
is the sum of the absolute differences over all kept terms. A term that a source lacks has the source's base
value, so the sum is V times the difference of the bases, plus what each source's own terms change (its
histogram of counts against the other's base), plus a correction for the terms that both have; only the
last needs pairs within a run, and tasks hold those as sums per pair, ``PAIRS`` at most.

All arithmetic is exact (Python's integers where 63 bits could end). The result has a row for each ordered
pair of sources of a language, which is the report asked for.

Defined results: null text, lang and source are empty strings; a row is a document, so repeated rows count each;
a source whose documents have no term, and a language without kept terms (all values 0), are groups all the same;
equal values rank by item; an empty table gives an empty result; further columns are ignored. Texts are read in
pieces of ``PIECE`` bytes, cut between terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut

#: Bytes of a term: letters, A-Z in lower case, and all of UTF-8's longer forms; others end it.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE, SMOOTH = 1_000_000_000, 5
#: Bytes of text that are split at once, and entries that a task sums up before it sends them.
PIECE, ENTRIES = 1 << 20, 1_000_000
#: Sums of pairs that a task holds before it sends them, and rows of an Arrow batch it sends.
PAIRS, BATCH = 200_000, 20_000
#: Terms times sources that stand in a matrix at once.
CELLS = 1 << 20


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    if len(text) <= PIECE:
        yield text.translate(TERM_BYTES).split()
        return
    clean, at = text.translate(TERM_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, doc, df, n) summed over a task's documents; the empty term counts a source's documents."""
    held: dict[tuple, list] = {}
    entries = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (df, n, doc) in held.items():
            keys, counts = list(df), list(df.values())
            for at in range(0, len(keys), BATCH):
                own = keys[at : at + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array([source] * len(own), pa.string()),
                        pa.array([doc] * len(own), pa.int64()), pa.array(counts[at : at + BATCH], pa.int64()), pa.array(map(n.__getitem__, own), pa.int64()),
                    ],
                    ["lang", "term", "source", "doc", "df", "n"],
                )
        held.clear()

    for batch in batches:
        langs, sources, docs = (batch.column(c).to_pylist() for c in ("lang", "source", "doc"))
        texts = batch.column("text").cast(pa.binary())
        for i, (lang, source, doc) in enumerate(zip(langs, sources, docs, strict=True)):
            own = held.setdefault((lang, source), [Counter(), Counter(), doc])
            df, n = own[0], own[1]
            before, seen = len(df), None
            for piece in terms_of(texts[i].as_py()):
                n.update(piece)
                seen = set(piece) if seen is None else seen | set(piece)
            df.update(seen or ())
            df[b""] += 1
            if doc is not None:
                own[2] = doc if own[2] is None else min(doc, own[2])
            entries += len(df) - before
            if entries >= ENTRIES:
                yield from flushed()
                entries = 0
    yield from flushed()


def _starts(table: pa.Table, *names: str) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns."""
    out = np.zeros(table.num_rows, bool)
    if len(out):
        out[0] = True
    for name in names:
        column = table.column(name).combine_chunks()
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _runs(batches: Iterator[pa.RecordBatch], reduce) -> Iterator[pa.Table]:
    """Tables of whole runs of (lang, term); what is still open at a batch's end waits, reduced, for the next."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = reduce(table if waiting is None else pa.concat_tables([waiting, table]))
        starts = np.flatnonzero(_starts(table, "lang", "term"))
        if not len(starts):
            continue
        waiting = table.slice(int(starts[-1]))
        if starts[-1]:
            yield table.slice(0, int(starts[-1]))
    if waiting is not None:
        yield waiting


def _by_source(table: pa.Table) -> pa.Table:
    """One row for each (lang, term, source) of a sorted table."""
    starts = np.flatnonzero(_starts(table, "lang", "term", "source"))
    if not len(starts):
        return table
    sums = {c: pa.array(np.add.reduceat(table.column(c).to_numpy(), starts)) for c in ("df", "n")}
    first = table.take(pa.array(starts))
    return pa.table({c: sums.get(c, first.column(c)) for c in table.column_names})


def _frequent(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of terms in at least ``least`` documents, and of the empty term; ``head`` marks a run's first row."""
        for table in _runs(batches, _by_source):
            head = _starts(table, "lang", "term")
            starts = np.flatnonzero(head)
            found = np.add.reduceat(table.column("df").to_numpy(), starts)
            mark = pc.equal(table.column("term"), "").to_numpy()
            keep = np.repeat(found >= least, np.diff([*starts, len(head)])) | mark
            out = pa.table({**{c: table.column(c) for c in ("lang", "term", "source", "n")}, "head": pa.array((head & ~mark).astype(np.int64))})
            yield from out.filter(pa.array(keep)).combine_chunks().to_batches()

    return scan


def _shares(n: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), by Python's integers."""
    return (SCALE * (n.astype(object) + SMOOTH) // (total.astype(object) + SMOOTH * kept.astype(object)) + 1).astype(np.int64)


def _emit(kind: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), BATCH):
        lang, source, item, value = zip(*rows[at : at + BATCH], strict=True)
        strings = [pa.array(x, pa.string()) for x in (lang, source, item)]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(value), pa.int32()), *strings, pa.array(value, pa.int64())], ["kind", "lang", "source", "item", "value"])


PAIR, TERM = 0, 1


def _both(run: np.ndarray, source: np.ndarray, p: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(a, b, x) for sources a < b that share runs: what having their terms both changes, summed over the runs."""
    used, source = np.unique(source, return_inverse=True)
    shares, has = (np.zeros((int(run.max(initial=-1)) + 1, len(used)), t) for t in (np.int64, bool))
    shares[run, source], has[run, source] = p, True
    low = np.zeros(len(used), np.int64)
    low[source] = base
    for a in range(len(used) - 1):
        own = np.flatnonzero(has[:, a])
        one, rest, with_ = shares[own, a, None], shares[own, a + 1 :], has[own, a + 1 :]
        change = np.abs(one - rest) - np.abs(one - low[a + 1 :]) - np.abs(low[a] - rest) + np.abs(low[a] - low[a + 1 :])
        for b in np.flatnonzero(with_.any(0)).tolist():
            yield int(used[a]), int(used[a + 1 + b]), int(change[with_[:, b], b].sum())


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run: for pairs of its sources what having the term both changes, and the terms above the language's share."""
    sums: dict[tuple, int] = defaultdict(int)
    over: list[tuple] = []
    for table in _runs(batches, lambda t: t):
        n, own, lang_total, kept = (table.column(c).to_numpy() for c in ("n", "total", "lang_total", "kept"))
        starts = np.flatnonzero(_starts(table, "lang", "term"))
        sizes = np.diff([*starts, len(n)])
        p, base = _shares(n, own, kept), _shares(np.zeros_like(n), own, kept)
        q = np.repeat(_shares(np.add.reduceat(n, starts), lang_total[starts], kept[starts]), sizes)
        langs, sources, terms = (table.column(c).to_pylist() for c in ("lang", "source", "term"))
        over += [(langs[i], sources[i], terms[i], int(p[i] - q[i])) for i in np.flatnonzero((p > q) & (n > 0)).tolist()]
        if len(over) >= PAIRS:
            yield from _emit(TERM, over)
            over = []
        runs = np.repeat(np.arange(len(starts)), sizes)
        lang_of = np.array(langs, object)
        for lang in dict.fromkeys(langs):
            at = np.flatnonzero(lang_of == lang)
            names, place = np.unique(np.array(sources, object)[at], return_inverse=True)
            run = np.unique(runs[at], return_inverse=True)[1]
            step = max(1, CELLS // len(names))
            for first in range(0, int(run[-1]) + 1, step):
                own = (run >= first) & (run < first + step)
                for a, b, x in _both(run[own] - first, place[own], p[at][own], base[at][own]):
                    sums[lang, names[a], names[b]] += x
                    if len(sums) >= PAIRS:
                        yield from _emit(PAIR, [(*k, v) for k, v in sums.items()])
                        sums.clear()
    yield from _emit(TERM, over)
    yield from _emit(PAIR, [(*k, v) for k, v in sums.items()])


def frequent_terms(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, term, source, n, head): counts of each language's terms in at least ``least`` documents; the empty term stands for the source itself."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"), F.col("doc_id").cast("long").alias("doc"))
    partial = rows.mapInArrow(_partial, "lang string, term string, source string, doc long, df long, n long")
    dealt = partial.repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "doc")
    return dealt.mapInArrow(_frequent(least), "lang string, term string, source string, n long, head long")


def _share(n: Column, total: Column, kept: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTH * kept)) + 1


def divergence(docs: DataFrame, least: int = 30, most: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by divergence, and the ``most`` terms that stand out."""
    counts = cut(frequent_terms(docs, least))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("kept"))
    groups = cut(groups.join(langs, "lang").withColumn("base", F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0))))
    used = counts.where("term <> ''").join(groups.drop("base"), ["lang", "source"])
    dealt = used.repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    figures = cut(dealt.select("lang", "term", "source", "n", "total", "lang_total", "kept").mapInArrow(_figures, "kind int, lang string, source string, item string, value long"))

    histogram = used.groupBy("lang", "source", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).agg(F.count(F.lit(1)).alias("m"))
    histogram = histogram.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("shares"))  # as many as a source has different counts
    sides = groups.join(histogram, ["lang", "source"], "left").select("lang", "source", "kept", "base", F.coalesce("shares", F.expr("array()")).alias("shares"))
    a, b = (sides.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "base", "shares")], *(["kept"] if s == "a" else [])) for s in "ab")

    def alone(shares: str, own: str, other: str) -> Column:
        apart = F.abs(F.col(own) - F.col(other))
        return F.aggregate(shares, F.lit(0).cast("long"), lambda sum_, x: sum_ + x["m"] * (F.abs(x["p"] - F.col(other)) - apart))

    both = figures.where(F.col("kind") == PAIR).groupBy("lang", F.col("source").alias("source_a"), F.col("item").alias("source_b")).agg(F.sum("value").alias("both"))
    value = F.col("kept") * F.abs(F.col("base_a") - F.col("base_b")) + alone("shares_a", "base_a", "base_b") + alone("shares_b", "base_b", "base_a")
    pairs = a.join(b, "lang").where("source_a < source_b").select("lang", "source_a", "source_b", value.alias("value"))
    pairs = pairs.join(both, ["lang", "source_a", "source_b"], "left").select("lang", "source_a", "source_b", (F.col("value") + F.coalesce("both", F.lit(0))).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = figures.where(F.col("kind") == TERM).select("lang", "source", F.lit("term").alias("part"), "item", "value", place).where(F.col("rank") <= most)
    return pairs.select("*", place).unionByName(terms)
