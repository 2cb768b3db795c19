"""Secret scans with multipart credential linking.

Base rules report key assignments, access identifiers and long hexadecimal runs wherever they stand.
Beside them there are *weak* parts: identifiers, key material and endpoints that alone are too common to
report. A weak part is reported only if complementary parts start within ``reach`` characters of it in
the same scope (a stretch of text without a blank line): an identifier needs a secret, key material needs
an identifier, an endpoint needs both. Parts are exploded and joined with their neighbours by an interval
frame over positions, so no pairs are made; a weak part that overlaps a base span is dropped.

Positions are code points, the end exclusive.

Defined results: null text has no spans; repeated rows get equal rows; a text without matches gives zero
counts and empty spans; an empty table gives an empty result; further columns are ignored by ``scan`` and
handed through by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import bind, free_names, row_key
from sparkloom.operators.lineage import cut

#: Fixed patterns: (kind, role, pattern, group whose length counts, least length).
BASE = [
    ("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "id", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("identifier", "id", r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}|(?i:access_?key|client|account|user)[_-]?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}", 0, 8),
    ("material", "secret", r"[A-Za-z0-9/+]{40,}={0,2}|[0-9a-f]{16,23}", 0, 16),
    ("endpoint", "endpoint", r"(?i:(?:https?|s3|wss?|jdbc:[a-z]+)://)[A-Za-z0-9.-]+\.[A-Za-z0-9.-]+|(?i:endpoint|hostname|host)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", 0, 8),
]
KINDS = [x[0] for x in BASE + WEAK]
SPAN = "array<struct<start:int,kind:int,end:int>>"
MASK = "[REDACTED]"
#: Elements that running sums take at once.
BLOCK = 128
#: Characters of a text in which a place is looked up from the start.
STRETCH = 4096
#: Spans that ``redact`` broadcasts at most; beyond it they are joined by a shuffle.
BROADCAST_SPANS = 500_000


def running(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """Running sums (maxima, ...) of an array, in blocks: an aggregate that lengthens an array would be quadratic."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(start), step)

    def blocked(all_: Column) -> Column:
        count = (F.size(all_) + (BLOCK - 1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor(count / BLOCK).cast("int") - 1), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        return bind(
            parts,
            lambda p: bind(
                F.transform(p, total),
                lambda sums: F.flatten(
                    F.transform(
                        p,
                        lambda x, j: bind(
                            total(F.slice(sums, F.lit(1), j)), lambda before: F.transform(x, lambda _, i: step(before, total(F.slice(x, F.lit(1), i + 1))))
                        ),
                    )
                ),
            ),
        )

    return bind(values, lambda x: F.when(F.size(x) == 0, x).otherwise(blocked(x)))


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches that are long enough, in order."""

    def located(found: Column, gaps: Column) -> Column:
        ends = running(F.transform(found, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit)), 0, lambda a, b: a + b)
        spans = bind(
            ends,
            lambda e: F.transform(
                found,
                lambda hit, i: F.struct(
                    (F.get(e, i) - F.length(hit)).alias("start"),
                    F.lit(kind).alias("kind"),
                    F.get(e, i).alias("end"),
                    (F.length(F.regexp_extract(hit, pattern, group)) >= least).alias("long"),
                ),
            ),
        )
        return F.transform(F.filter(spans, lambda s: s["long"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    none = F.expr(f"cast(array() as {SPAN})")
    return bind(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(bind(F.split(text, pattern, -1), lambda gaps: located(m, gaps))),
    )


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def parts(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: key, base spans, weak spans, ends of its scopes."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def of(rules: list, shift: int) -> Column:
        found = [spans_of(F.col("text"), i + shift, pattern, group, least) for i, (_, _, pattern, group, least) in enumerate(rules)]
        return F.array_sort(F.concat(*found))

    blank = spans_of(F.col("text"), 0, r"\n\x20*\n\s*", 0, 2)
    rows = rows.select(
        "doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"), of(BASE, 0).alias("base"), of(WEAK, len(BASE)).alias("weak")
    )
    return rows.select("doc_id", "key", "base", "weak", F.when(F.size("weak") > 0, blank).alias("breaks"))


def linked(found: DataFrame, reach: int) -> DataFrame:
    """(key, extra): the weak spans that complementary parts confirm."""
    roles = F.array(*[F.lit(x[1]) for x in BASE + WEAK])
    several = found.where(F.size("weak") > 0).where(F.size("weak") + F.size("base") > 1).dropDuplicates(["key"])
    marks = F.transform("breaks", lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("kind"), b["end"].alias("end")))
    rows = several.select("key", F.explode(F.concat("base", "weak", marks)).alias("s")).select("key", "s.*")
    order = W.partitionBy("key").orderBy("start", "kind")
    rows = rows.withColumn("scope", F.sum((F.col("kind") < 0).cast("int")).over(order)).where("kind >= 0")
    rows = rows.withColumn("role", F.get(roles, F.col("kind")))
    strong = F.col("kind") < len(BASE)
    before = order.rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("key").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)  # growing frames are linear
    rows = rows.withColumn("reached", F.max(F.when(strong, F.col("end"))).over(before))
    rows = rows.withColumn("coming", F.min(F.when(strong, F.col("start"))).over(after))
    near = W.partitionBy("key", "scope").orderBy("start").rangeBetween(-reach, reach)
    for role in ("id", "secret"):
        rows = rows.withColumn(role, F.sum((F.col("role") == role).cast("int")).over(near))
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("coming", F.col("end")) >= F.col("end"))
    wanted = (
        F.when(F.col("role") == "id", F.col("secret") > 0)
        .when(F.col("role") == "secret", F.col("id") > 0)
        .otherwise((F.col("id") > 0) & (F.col("secret") > 0))
    )
    rows = rows.where(~strong & apart & wanted)
    return rows.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))


def scan(docs: DataFrame, reach: int = 300) -> DataFrame:
    """One row per document: key, doc_id, base and all spans (start, kind, end)."""
    found = cut(parts(docs))
    out = found.select("key", "doc_id", "base").join(linked(found, reach), "key", "left")
    none = F.expr(f"cast(array() as {SPAN})")
    return out.select("key", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def report(docs: DataFrame, reach: int = 300) -> DataFrame:
    """One row per document: doc_id, counts per base kind, digest of the base spans, all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, reach).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping or adjoining spans masked, adjoining ones by a mask each.

    A place is looked up within a stretch of the text, so that many spans of a long text don't each read
    it from its start.
    """
    count = F.floor((F.length(text) + (STRETCH - 1)) / STRETCH).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda b: F.substring(text, b * STRETCH + 1, F.lit(STRETCH)))
    reach = running(F.transform(spans, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b))

    def piece(parts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / STRETCH).cast("int"), F.floor(b / STRETCH).cast("int")
        within = F.substring(F.get(parts, first), a % STRETCH + 1, b - a)
        head = F.substring(F.get(parts, first), a % STRETCH + 1, F.lit(STRETCH))
        middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.coalesce(F.substring(F.get(parts, last), F.lit(1), b % STRETCH), F.lit(""))
        return F.when(b <= a, F.lit("")).when(first == last, within).otherwise(F.concat(head, middle, tail))

    def joined(parts: Column, ends: Column) -> Column:
        before = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("before")))
        open_ = F.filter(before, lambda x: x["start"] >= x["before"])  # else it overlaps an earlier span
        between = F.transform(open_, lambda x: F.concat(piece(parts, x["before"], x["start"]), F.lit(MASK)))
        return F.concat(F.array_join(between, ""), piece(parts, F.element_at(ends, -1), F.length(text)))

    return bind(stretches, lambda parts: bind(reach, lambda ends: joined(parts, ends)))


def redact(docs: DataFrame, reach: int = 300) -> DataFrame:
    """All documents with all their columns; spans of secrets are masked in the text, n_chars follows."""
    as_ = free_names(docs, "key", "spans")
    key, spans = as_["key"], as_["spans"]
    found = scan(docs, reach).where(F.size("spans") > 0).select(F.col("key").alias(key), F.col("spans").alias(spans))
    found = cut(found.dropDuplicates([key]))
    small = (found.agg(F.sum(F.size(spans))).first()[0] or 0) <= BROADCAST_SPANS
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    out = keyed.join(F.broadcast(found) if small else found, key, "left")
    clean = F.col(spans).isNull()
    text = F.when(clean, F.col("text")).otherwise(masked(F.col("text"), F.col(spans)))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        anew = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(anew))
    return out.select(*docs.columns)
