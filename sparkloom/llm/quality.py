"""Quality rules: word rules of a document, and lines that too many documents of a host share.

A line is compared by its normal form (trimmed, lower-cased, inner white space as one space). It is
boilerplate of its host when more than ``max_documents`` different documents of that host hold it; exact
copies of a text count once. Boilerplate lines are removed; a document is depleted when more than
``max_removed_percent`` of its words go and fewer than ``min_words`` are left.

Defined results: null text has no words and no lines (base_failed, not kept); null host is a host of its
own; repeated rows get the same verdict; an empty table gives an empty result; further columns are
ignored, and ``clean`` hands through all columns of its input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bind, free_names, row_key, words
from sparkloom.operators.lineage import cut


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_documents: int = 20
    max_removed_percent: int = 80
    #: Frequent lines, and documents that have some, are broadcast up to this number; beyond it a shuffle joins them.
    broadcast_lines: int = 200_000


def repeated_words(tokens: Column, window: int) -> Column:
    """Number of words that lie in a window of ``window`` words (a power of two) found at least twice.

    Windows are hashed by doubling, from pairs on; a text whose shorter windows all differ is done early.
    """
    size = F.size(tokens)

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(
            order,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)))
                    | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                ),
                lambda x: x["i"],
            ),
        )
        return bind(
            F.array_sort(twice),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    def grow(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def windows(start: Column, step: int) -> Column:
        if step == window:
            whole = F.slice(start, F.lit(1), F.size(start) - (window - 1))
            return bind(whole, covered)
        return bind(
            grow(start, step),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(windows(h, 2 * step)),
        )

    pairs = F.transform(tokens, lambda x, i: F.xxhash64(x, F.get(tokens, i + 1)))
    return F.when(size <= window, F.lit(0)).otherwise(bind(pairs, lambda h: windows(h, 2)))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_key(host: Column, line: Column) -> Column:
    """Hash of a line's normal form within its host; for lines with a word."""
    uneven = F.contains(line, F.lit("  "))
    for mark in "\t\v\f\r":
        uneven = uneven | F.contains(line, F.lit(mark))
    even = F.when(uneven, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)
    return F.xxhash64(host, F.lower(F.trim(even)))


def word_rules(text: Column, rules: QualityRules) -> Column:
    """The figures of the word rules as one struct; null text counts as empty."""

    def figures(whole: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), has_word)
        return bind(
            words(whole),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                repeated_words(w, rules.window).cast("long").alias("n_repeat_words"),
            ),
        )

    return bind(F.coalesce(text, F.lit("")), figures)


def base_failed(f: str, rules: QualityRules) -> Column:
    n = F.col(f)["n_words"]
    return (n < rules.min_words) | (100 * F.col(f)["n_repeat_words"] > rules.max_repeat_percent * n)


def document_key(host: str) -> Column:
    return row_key(F.col("doc_id"), F.col(host), F.coalesce("text", F.lit("")))


def document_lines(docs: DataFrame, host: str) -> DataFrame:
    """A row per document and line with a word: key and digest of the document, place, line, number of words."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(host).alias("host"), document_key(host).alias("key"), F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, "\n")).alias("i", "one")
    ).where(has_word(F.col("one")))
    return rows.select("key", "digest", "i", line_key(F.col("host"), F.col("one")).alias("line"), F.size(words(F.col("one"))).alias("n"))


def frequent_lines(lines: DataFrame, rules: QualityRules) -> tuple[DataFrame, DataFrame]:
    """The boilerplate lines, and the occurrences of all lines that occur often enough to be some."""
    limit = rules.max_documents
    candidates = cut(lines.groupBy("line").count().where(F.col("count") > limit).select("line"))
    small = candidates.count() <= rules.broadcast_lines
    held = cut(lines.join(F.broadcast(candidates) if small else candidates, "line"))
    texts = held.select("line", "digest").distinct()  # dealt by both, so that a line of many documents is counted in parts
    return cut(texts.groupBy("line").count().where(F.col("count") > limit).select("line")), held


def line_removals(docs: DataFrame, host: str, rules: QualityRules) -> DataFrame:
    """Per document with boilerplate: key, the boilerplate line keys, and the words that go with them."""
    found, held = frequent_lines(document_lines(docs, host), rules)
    small = found.count() <= rules.broadcast_lines
    once = held.dropDuplicates(["key", "i"]).join(F.broadcast(found) if small else found, "line")
    return once.groupBy("key").agg(F.collect_set("line").alias("bad_lines"), F.sum("n").alias("removed_words"))


def _judged(docs: DataFrame, host: str, rules: QualityRules) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with figures, failed, bad (boilerplate lines or null), removed and kept under names that are free."""
    as_ = free_names(docs, "figures", "key", "bad", "removed", "failed", "kept")
    removed = cut(
        line_removals(docs, host, rules).select(
            F.col("key").alias(as_["key"]), F.col("bad_lines").alias(as_["bad"]), F.col("removed_words").alias(as_["removed"])
        )
    )
    few = removed.count() <= rules.broadcast_lines
    out = docs.withColumns({as_["figures"]: word_rules(F.col("text"), rules), as_["key"]: document_key(host)})
    out = out.withColumn(as_["failed"], base_failed(as_["figures"], rules)).join(F.broadcast(removed) if few else removed, as_["key"], "left")
    gone, n = F.coalesce(as_["removed"], F.lit(0)), F.col(as_["figures"])["n_words"]
    depleted = (100 * gone > rules.max_removed_percent * n) & (n - gone < rules.min_words)
    return out.withColumns({as_["removed"]: gone, as_["kept"]: ~F.col(as_["failed"]) & ~depleted}), as_


def judge(docs: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: figures, base_failed, words removed with boilerplate lines, kept."""
    out, as_ = _judged(docs.select("doc_id", host, "text"), host, rules)
    return out.select(
        "doc_id",
        f"{as_['figures']}.*",
        F.col(as_["failed"]).alias("base_failed"),
        F.col(as_["removed"]).alias("removed_words"),
        F.col(as_["kept"]).alias("kept"),
    )


def clean(docs: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The kept documents with all their columns, their text without boilerplate lines, n_chars anew."""
    out, as_ = _judged(docs, host, rules)
    out = out.where(as_["kept"])
    bad = F.col(as_["bad"])
    stays = F.array_join(
        F.filter(F.split("text", "\n"), lambda x: ~(has_word(x) & F.coalesce(F.array_contains(bad, line_key(F.col(host), x)), F.lit(False)))),
        "\n",
    )
    text = F.when(bad.isNull(), F.col("text")).otherwise(stays)
    if "n_chars" in docs.columns:
        anew = F.when(bad.isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", anew)
    return out.withColumn("text", text).select(*docs.columns)
