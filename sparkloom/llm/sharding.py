"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells; a document lies in the cell of its id's hash, a shard owns the cells
before each of its virtual nodes. No shard takes more than its capacity; what overflows continues
clockwise to the next shard with room. With ``slack`` 0 the capacities are n/shards rounded down or up,
so that counts are at most one apart (law ``rows``); with more slack fewer documents leave their own
shard, and fewer move when a shard is added.

Only counts per cell come to the driver (at most ``CELLS`` of them), and only the resulting ranges of
ranks go back. Cells with many rows are ranked in parts, so one id may hold any share of the rows.

Defined results: null text has no bytes; null ids share a cell; repeated rows get places of their own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut

CELLS = 1 << 14
#: A cell is ranked in parts that hold about one in so many of all rows.
PARTS = 256
MAX_PARTS = 1024


def ring(shards: int, virtual: int) -> list[int]:
    """For each cell the shard of the first virtual node at or after it, clockwise."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % CELLS
            while cell in at:
                cell = (cell + 1) % CELLS
            at[cell] = shard
    owner, shard = [0] * CELLS, at[min(at)]
    for cell in range(CELLS - 1, -1, -1):
        shard = at.get(cell, shard)
        owner[cell] = shard
    return owner


@dataclass(frozen=True)
class Stretch:
    """Ranks ``start`` to ``end`` (exclusive) of a cell go to ``shard``, from slot ``slot`` on."""

    cell: int
    start: int
    end: int
    shard: int
    slot: int


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def place(counts: dict[int, int], owner: list[int], limits: list[int]) -> list[Stretch]:
    """Fill the ring cell by cell; a full shard hands on to the next shard with room."""
    following = list(range(len(owner)))  # next cell, clockwise, whose shard may have room
    held = [0] * len(limits)

    def room(cell: int) -> int:
        path = []
        while held[owner[cell]] >= limits[owner[cell]]:
            path.append(cell)
            cell = following[cell] if following[cell] != cell else (cell + 1) % len(owner)
        for x in path:
            following[x] = cell
        return cell

    out = []
    for cell in sorted(counts):
        left, start = counts[cell], 0
        while left:
            shard = owner[room(cell)]
            taken = min(left, limits[shard] - held[shard])
            out.append(Stretch(cell, start, start + taken, shard, held[shard]))
            held[shard] += taken
            start, left = start + taken, left - taken
    return out


def assign(docs: DataFrame, shards: int = 40, virtual: int = 64, slack: float = 0.0) -> DataFrame:
    """One row per document: doc_id, size (bytes plus 16), text_crc32, shard, slot, own_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int").alias("cell"),
        F.pmod(F.xxhash64(F.lit(5), "doc_id", text), F.lit(MAX_PARTS)).cast("int").alias("part"),  # of the row, not its place
    )
    rows = cut(rows)
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, owner = sum(counts.values()), ring(shards, virtual)
    stretches = place(counts, owner, capacities(total, shards, slack))
    parts = min(MAX_PARTS, 1 + PARTS * max(counts.values(), default=0) // max(1, total))
    rows = rows.withColumn("part", F.col("part") % parts)
    order = W.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(order) - 1)
    if parts > 1:
        sizes = rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
        earlier = W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.select("cell", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
        rows = rows.join(sizes, ["cell", "part"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    table = docs.sparkSession.createDataFrame(
        [(s.cell, s.start, s.end, s.shard, s.slot, owner[s.cell]) for s in stretches],
        "cell int, from long, to long, shard int, base long, own_shard int",
    )
    inside = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    return rows.join(F.broadcast(table), "cell").where(inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("from")).alias("slot"), "own_shard"
    )
