"""Centroid clustering (Lloyd's rounds) over integer vectors, screened by the norms of segments.

Each component becomes floor(``SCALE`` * x), exactly. A vector is stored once with the norms of its ``BLOCKS``
segments, its compressed form. By Cauchy-Schwarz, segment by segment, the squared distance to a centroid is at
least the squared distance of the two compressed forms; a centroid whose bound is above a distance that was
already found can't be nearer and isn't looked at. The bounds are floats lowered by more than their rounding
error; every distance that decides is an exact integer, so the result doesn't depend on the screening.

A round sends the centroids (``k`` times the dimension, a parameter) to the tasks and gets exact sums per
cluster, component and digit back; nothing else comes to the driver. Sums of tasks are added in digits of 30
bits, so that no sum overflows.

Defined results: a vector is kept if it has exactly ``dims`` components, none null, NaN or infinite; the others
give no row. Rows are vectors: repeated rows count each, a null id is the empty string for the choice of the
first centroids and a null in the result, ids that are equal are told apart by their components. With fewer
vectors than ``k`` there are as many clusters as vectors; an empty table gives an empty result. Components so
large that a squared distance could pass 63 bits are worked off with Python's integers, and distances and
inertias above 2^63 - 1 are given as that. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut

SCALE = 1024
#: Segments of a vector; their norms are its compressed form.
BLOCKS = 8
#: What bounds are lowered by, relative to the norms: far above the rounding errors of doubles.
SLACK = 1e-12
DIGIT = 30
MOST = (1 << 63) - 1
#: Places of a task's figures that aren't components: rows, exact distances.
ROWS, EXACT = -1, -2


def doubles(x: np.ndarray) -> np.ndarray:
    """Integers as doubles, infinite where these end."""
    if x.dtype != object:
        return x.astype(np.float64)
    flat = [float(v) if abs(v).bit_length() < 1024 else math.inf for v in x.reshape(-1).tolist()]
    return np.array(flat, np.float64).reshape(x.shape)


@dataclass(frozen=True)
class Layout:
    """How vectors are stored: ``width`` bytes a component; ``wide`` ones are Python integers in memory."""

    dims: int
    width: int
    wide: bool

    @staticmethod
    def of(dims: int, most: float) -> Layout:
        """For components up to ``most`` in absolute value."""
        if 4 * dims * most * most < MOST:
            return Layout(dims, 2 if most < 1 << 15 else 4, False)
        bits = 1 + (math.frexp(most)[1] if math.isfinite(most) else 1034)
        return Layout(dims, bits // 8 + 1, True)

    def pack(self, values: np.ndarray) -> list[bytes]:
        """Rows of doubles as integers, floor(SCALE * x)."""
        if not self.wide:
            return [r.tobytes() for r in np.floor(values * SCALE).astype(f"<i{self.width}")]
        whole = lambda x: int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)
        return [b"".join(whole(x).to_bytes(self.width, "little", signed=True) for x in r) for r in values.tolist()]

    def unpack(self, rows: list[bytes]) -> np.ndarray:
        if not self.wide:
            return np.frombuffer(b"".join(rows), f"<i{self.width}").astype(np.int64).reshape(-1, self.dims)
        w = self.width
        ints = [int.from_bytes(r[i : i + w], "little", signed=True) for r in rows for i in range(0, w * self.dims, w)]
        out = np.empty(len(ints), object)
        out[:] = ints
        return out.reshape(-1, self.dims)

    def norms(self, vectors: np.ndarray) -> np.ndarray:
        """Norms of the segments, as doubles; infinite where doubles end, which screens nothing."""
        with np.errstate(over="ignore"):
            x = doubles(vectors)
            edges = [i * self.dims // BLOCKS for i in range(BLOCKS)] if self.dims >= BLOCKS else list(range(self.dims))
            return np.sqrt(np.add.reduceat(x * x, edges, axis=1))


@dataclass
class Centroids:
    """Centroids as rows of Python integers, and the rounds' exact distances against all that there were."""

    rows: list[list[int]]
    layout: Layout
    exact: int = 0
    possible: int = 0
    _arrays: tuple | None = field(default=None, repr=False)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self._arrays is None:
            c = np.array(self.rows, object if self.layout.wide else np.int64).reshape(-1, self.layout.dims)
            self._arrays = c, self.layout.norms(c)
        return self._arrays

    def digest(self, j: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[j])).encode()).hexdigest()

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per vector its nearest centroid (the smaller number of equals), the squared distance, and how many distances were computed."""
        c, c_norms = self.arrays()
        bound = np.empty((len(x), len(c)))
        with np.errstate(invalid="ignore", over="ignore"):
            for j, one in enumerate(c_norms):
                gap = np.maximum(np.abs(norms - one) - SLACK * (norms + one), 0)
                bound[:, j] = (gap * gap).sum(1) * (1 - SLACK)
        exact = lambda rows, centres: ((rows - centres) ** 2).sum(1)
        cluster = np.where(np.isnan(bound), 0, bound).argmin(1)
        distance = exact(x, c[cluster])
        done, first = len(x), cluster.copy()
        for j in range(len(c)):
            open_ = (first != j) & ~(bound[:, j] > doubles(distance) * (1 + SLACK))
            if not open_.any():
                continue
            at = np.flatnonzero(open_)
            d = exact(x[at], c[j])
            nearer = (d < distance[at]) | ((d == distance[at]) & (j < cluster[at]))
            cluster[at[nearer]], distance[at[nearer]] = j, d[nearer]
            done += len(at)
        return cluster, distance, done


def kept(column: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, all of them finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) == dims) & finite, F.lit(False))


def vectors(df: DataFrame, dims: int, id_column: str, column: str) -> tuple[DataFrame, Layout]:
    """(id, v, norms) of the kept vectors, written once, and how they are stored."""
    rows = df.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("x")).where(kept(F.col("x"), dims))
    most = rows.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("m")).first()["m"]
    layout = Layout.of(dims, (most or 0.0) * SCALE + 1)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            packed = layout.pack(values)
            norms = [r.tobytes() for r in layout.norms(layout.unpack(packed))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(norms, pa.binary())], ["id", "v", "norms"])

    kind = df.schema[id_column].dataType.simpleString()
    return cut(rows.mapInArrow(stored, f"id {kind}, v binary, norms binary")), layout


def first_centroids(stored: DataFrame, layout: Layout, k: int, seed: str) -> Centroids:
    """The k vectors whose ids have the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = stored.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return Centroids(layout.unpack([bytes(r["v"]) for r in found]).tolist(), layout)


def _read(batch: pa.RecordBatch, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    norms = np.frombuffer(b"".join(batch.column("norms").to_pylist()), np.float64)
    return layout.unpack(batch.column("v").to_pylist()), norms.reshape(batch.num_rows, -1)


def digits(x: int) -> list[int]:
    """A number in digits of DIGIT bits; the last one has the sign."""
    out = []
    while not -(1 << DIGIT) <= x < 1 << DIGIT:
        out.append(x & ((1 << DIGIT) - 1))
        x >>= DIGIT
    return [*out, x]


def moved(stored: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every vector to its nearest centroid, then each centroid with vectors to their floored mean."""
    layout, k = centroids.layout, len(centroids.rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, exact = [[0] * layout.dims for _ in range(k)], [0] * k, 0
        for batch in batches:
            x, norms = _read(batch, layout)
            cluster, _, done = centroids.nearest(x, norms)
            exact += done
            for j in np.unique(cluster).tolist():
                own = x[cluster == j]
                rows[j] += len(own)
                total[j] = [a + b for a, b in zip(total[j], own.sum(0).tolist(), strict=True)]
        out = [(j, i, d, s) for j in range(k) if rows[j] for i, x in [*enumerate(total[j]), (ROWS, rows[j])] for d, s in enumerate(digits(x))]
        out.append((0, EXACT, 0, exact))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "digit", "s"])

    shares = stored.mapInArrow(sums, "cluster int, place int, digit int, s long")
    found: dict[tuple[int, int], int] = {}
    for r in shares.groupBy("cluster", "place", "digit").agg(F.sum("s").alias("s")).collect():  # a few per centroid and component
        at = (r["cluster"], r["place"])
        found[at] = found.get(at, 0) + (r["s"] << (DIGIT * r["digit"]))
    rows = [[found[j, i] // found[j, ROWS] for i in range(layout.dims)] if (j, ROWS) in found else old for j, old in enumerate(centroids.rows)]
    seen = sum(found.get((j, ROWS), 0) for j in range(k))
    return Centroids(rows, layout, centroids.exact + found.get((0, EXACT), 0), centroids.possible + k * seen)


def assigned(stored: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    layout = centroids.layout

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = centroids.nearest(*_read(batch, layout))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(np.minimum(distance, MOST).astype(np.int64))], ["id", "cluster", "distance"])

    kind = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(place, f"id {kind}, cluster int, distance long")


def trained(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:", id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, Centroids]:
    """The stored vectors, and the centroids after all rounds."""
    stored, layout = vectors(df, dims, id_column, column)
    centroids = first_centroids(stored, layout, k, seed)
    for _ in range(rounds if centroids.rows else 0):
        centroids = moved(stored, centroids)
    return stored, centroids


def clustered(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:", id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    stored, centroids = trained(df, k, rounds, dims, seed, id_column, column)
    kind = stored.schema["id"].dataType.simpleString()
    if not centroids.rows:
        return df.sparkSession.createDataFrame([], f"{id_column} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = cut(assigned(stored, centroids))
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row per centroid
    rows = [(j, min(s, MOST), min(sum(sums.values()), MOST), centroids.digest(j)) for j, s in sorted(sums.items())]
    figures = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(figures), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
