"""Canonical exact digest of a document.

Canonical form: Unicode composition (NFC), full case folding, composition again, white space runs as one
space, trimmed. Its fingerprint is 128 bits of xxhash (two seeds). Documents whose fingerprints are equal
are compared byte by byte within their bucket; should two canonical forms share a bucket, all but the
first (by row key) get a suffix ``-n``.

Defined results: null text counts as empty; null ids sort first; repeated rows count as one document and
get equal rows; the next of the last document is the first, so that a single document is its own next;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut

#: Buckets with several documents are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_BUCKETS = 500_000


def canonical(text: Column) -> Column:
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\x1C-\x1F\p{Z}\x{85}]+", " "))


def hashes(canon: Column) -> list[Column]:
    return [F.xxhash64(canon).alias("h1"), F.xxhash64(F.lit(11), canon, F.lit(13)).alias("h2")]


def hex128(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a 128-bit key of the row's content (r1, r2)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(3), "text", "doc_id").alias("r2"), "doc_id", "text")


def prepared(docs: DataFrame) -> DataFrame:
    """The columns of ``placed``, the canonical text and its hashes."""
    return placed(docs).withColumn("canon", canonical(F.col("text"))).select("*", *hashes(F.col("canon")))


def collisions(rows: DataFrame) -> DataFrame:
    """(h1, h2, canon, variant) of the canonical forms that share a bucket with another; bytes are compared."""
    buckets = rows.select("h1", "h2", "r1", "r2").groupBy("h1", "h2").agg(
        F.min("r1").alias("lo"), F.max("r1").alias("hi")
    )
    several = cut(buckets.where("lo <> hi").select("h1", "h2"))
    few = several.count() <= BROADCAST_BUCKETS
    inside = rows.join(F.broadcast(several) if few else several, ["h1", "h2"])
    forms = inside.groupBy("h1", "h2", "canon").agg(F.min("r1").alias("first"))
    clash = forms.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    clash = cut(clash)
    if clash.count() == 0:
        return clash.select("h1", "h2", F.lit("").alias("canon"), F.lit(0).alias("variant")).limit(0)
    order = W.partitionBy("h1", "h2").orderBy("first", "canon")
    return cut(forms.join(clash, ["h1", "h2"]).select("h1", "h2", "canon", (F.row_number().over(order) - 1).alias("variant")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, its fingerprint, and the columns of ``prepared``."""
    rows = prepared(docs)
    clash = collisions(rows)
    plain = hex128(F.col("h1"), F.col("h2"))
    if clash.isEmpty():
        return rows.withColumn("fingerprint", plain)
    suffix = F.when(F.col("variant") > 0, F.concat(F.lit("-"), F.col("variant").cast("string"))).otherwise("")
    return rows.join(clash, ["h1", "h2", "canon"], "left").withColumn("fingerprint", F.concat(plain, F.coalesce(suffix, F.lit(""))))


def neighbours(rows: DataFrame) -> DataFrame:
    """(r1, r2, p1, p2, pn): for each document the one before it by doc_id, and that one's length."""
    small = rows.select("r1", "r2", "doc_id", F.length("text").alias("n")).distinct()
    ranged = cut(small.repartitionByRange(F.col("doc_id").asc_nulls_first(), "r1").withColumn("slice", F.spark_partition_id()))
    one = F.struct("doc_id", "r1", "r2", "n").alias("one")
    inner = W.partitionBy("slice").orderBy(F.col("doc_id").asc_nulls_first(), "r1", "r2")
    before = ranged.select("slice", "r1", "r2", F.lag(one).over(inner).alias("b"))
    last = ranged.groupBy("slice").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), one)).alias("last"))
    ends = [(r["slice"], r["last"]["one"]) for r in last.orderBy("slice").collect()]  # one row per range slice
    if not ends:
        return before.select("r1", "r2", "r1", "r2").toDF("r1", "r2", "p1", "p2").withColumn("pn", F.lit(0))
    link = [(k, ends[i - 1][1]["r1"], ends[i - 1][1]["r2"], ends[i - 1][1]["n"]) for i, (k, _) in enumerate(ends)]
    starts = rows.sparkSession.createDataFrame(link, "slice int, s1 long, s2 long, sn int")
    return before.join(F.broadcast(starts), "slice").select(
        "r1",
        "r2",
        F.when(F.col("b").isNull(), F.col("s1")).otherwise(F.col("b.r1")).alias("p1"),
        F.when(F.col("b").isNull(), F.col("s2")).otherwise(F.col("b.r2")).alias("p2"),
        F.when(F.col("b").isNull(), F.col("sn")).otherwise(F.col("b.n")).alias("pn"),
    )


def edited_likeness(docs: DataFrame, quarter: int = 4) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document."""
    rows = fingerprints(docs).select("r1", "r2", "doc_id", "text", "fingerprint")
    around = neighbours(placed(docs))
    given = rows.join(around, ["r1", "r2"]).select(
        F.col("p1").alias("r1"),
        F.col("p2").alias("r2"),
        F.col("doc_id").alias("next_doc_id"),
        F.expr(f"substring(text, 1, pn div {quarter})").alias("head"),
        F.col("fingerprint").alias("next_fingerprint"),
    ).distinct()
    both = rows.join(given, ["r1", "r2"]).withColumn("n", F.length("text"))
    both = both.withColumn("edited", F.concat(F.expr(f"substring(text, 1, n - n div {quarter})"), "head"))
    both = both.withColumn("canon", canonical(F.col("edited"))).select("*", *hashes(F.col("canon")))
    both = both.withColumn("edited_fingerprint", hex128(F.col("h1"), F.col("h2")))
    same = lambda x: F.when(F.col("fingerprint") == F.col(x), F.lit(1.0)).otherwise(F.lit(0.0))
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        same("edited_fingerprint").alias("near_edited"),
        same("next_fingerprint").alias("near_next"),
        "next_doc_id",
    )
