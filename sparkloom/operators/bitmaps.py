"""Sets of vertices as bitmaps: an eighth of a byte per vertex, tested inside scans.

A set is a table of buckets (Spark's bitmap functions): 32,768 ids in 4,096 bytes, empty buckets left out. To be tested, it becomes
one array of 64-bit words in a session variable, which plans hold as a constant, so a scan of edges or vertices looks a bit up by
place: no join, no exchange. (A scalar subquery would do, but not inside functions over arrays.) The array passes through the
driver and goes to every task, so it is for sets of a checked size: ``fits`` bounds it by the ids and by the members. Larger
sets are joined.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids and bytes of a bucket: fixed values of Spark's bitmap functions.
BUCKET_IDS, BUCKET_BYTES = 32_768, 4_096
#: A set that takes more isn't sent to tasks.
BITMAP_BYTES = 64 << 20


def bytes_of(num_vertices: int, members: int) -> int:
    """What a set can take at most: a bucket for each member, or all buckets."""
    return BUCKET_BYTES * min(members, -(-num_vertices // BUCKET_IDS))


@dataclass(frozen=True)
class VertexSet:
    """``buckets`` has (bucket int, bits binary), a bucket once."""

    buckets: DataFrame
    num_vertices: int

    @staticmethod
    def of(vertices: DataFrame, num_vertices: int, column: str = "v") -> VertexSet:
        place = F.col(column) + 1  # the functions count from 1
        found = vertices.groupBy((F.bitmap_bucket_number(place) - 1).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        return VertexSet(found, num_vertices)

    def union(self, other: VertexSet) -> VertexSet:
        both = self.buckets.unionByName(other.buckets)
        return VertexSet(both.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")), self.num_vertices)

    def size(self) -> Column:
        """Members, as an aggregate over ``buckets``."""
        return F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))

    def vertices(self) -> DataFrame:
        """(v) of the members."""
        words = self.buckets.select("bucket", F.posexplode(_words(F.col("bits"))).alias("i", "word")).where("word <> 0")
        bits = words.select("bucket", "i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("word", _shift(k)) == 1)).alias("k"))
        return bits.select((F.col("bucket").cast("long") * BUCKET_IDS + F.col("i") * 64 + F.col("k")).alias("v"))

    def tester(self) -> Tester:
        """The set as a constant of plans; a job of its own. Only for sets that ``fits`` admits."""
        spark, n = self.buckets.sparkSession, -(-self.num_vertices // BUCKET_IDS)
        every = spark.range(n).select(F.col("id").cast("int").alias("bucket"))
        rows = every.join(self.buckets, "bucket", "left").select("bucket", F.when(F.col("bits").isNotNull(), _words(F.col("bits"))).alias("words"))
        one = rows.agg(F.array_sort(F.collect_list(F.struct("bucket", "words"))).alias("rows")).select(F.col("rows.words").alias("words"))
        view = f"sparkloom_view_{uuid.uuid4().hex}"
        one.createOrReplaceTempView(view)
        try:
            return Tester.set(spark, f"(SELECT words FROM {view})")
        finally:
            spark.catalog.dropTempView(view)


def fits(num_vertices: int, members: int) -> bool:
    return bytes_of(num_vertices, members) <= BITMAP_BYTES


def _words(bits: Column) -> Column:
    """4,096 bytes as 512 numbers, the first byte in the highest place."""
    word = lambda i: F.conv(F.hex(F.substring(bits, i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BYTES // 8 - 1)), word)


def _shift(k: Column) -> Column:
    """Where the k-th of a word's ids stands: bytes from the top, bits of a byte from below."""
    return (F.lit(7) - F.shiftright(k, 3)) * 8 + k.bitwiseAND(F.lit(7))


@dataclass(frozen=True)
class Tester:
    """A set held by the session variable ``name``; plans that were made with it keep its value."""

    spark: SparkSession
    name: str

    @staticmethod
    def set(spark: SparkSession, value: str) -> Tester:
        name = f"sparkloom_set_{uuid.uuid4().hex}"
        spark.sql(f"DECLARE VARIABLE {name} ARRAY<ARRAY<BIGINT>>")
        spark.sql(f"SET VAR {name} = {value}")
        return Tester(spark, name)

    def has(self, v: Column) -> Column:
        """Whether a vertex, 0 to V-1, is in the set; false for null."""
        word = F.get(F.get(F.expr(self.name), F.shiftright(v, 15).cast("int")), F.shiftright(v.bitwiseAND(F.lit(BUCKET_IDS - 1)), 6).cast("int"))
        return F.coalesce(F.getbit(word, _shift(v.bitwiseAND(F.lit(63)).cast("int"))) == 1, F.lit(False))

    def union(self, other: Tester) -> Tester:
        """Both sets' members, worked out where the arrays are: no job."""
        words = "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE zip_with(a, b, (x, y) -> x | y) END"
        return Tester.set(self.spark, f"zip_with({self.name}, {other.name}, (a, b) -> {words})")

    def drop(self) -> None:
        self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {self.name}")
