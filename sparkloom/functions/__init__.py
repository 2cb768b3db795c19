"""Column functions of the kernels: named combiners, guarded arithmetic, unreached values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance of a vertex that wasn't reached; candidates at or above it are never taken.
UNREACHED = 1e9

COMBINERS = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.min, "count": F.count}


def combiner(name: str) -> callable:
    """The aggregate behind a combiner's name; ``any`` takes the smallest, so that results are repeatable."""
    if name not in COMBINERS:
        raise ValueError(f"combiner {name!r} is none of {sorted(COMBINERS)}")
    return COMBINERS[name]


def over(numerator: Column, denominator: Column, otherwise: Column) -> Column:
    """Division that gives ``otherwise`` where the denominator isn't positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(otherwise)


def human_size(bytes_: Column) -> Column:
    """Bytes with a unit, two digits."""
    out = F.concat(F.format_number(bytes_ / F.lit(1.0), 2), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        limit = 1024.0**power
        out = F.when(bytes_ >= limit, F.concat(F.format_number(bytes_ / limit, 2), F.lit(f" {unit}"))).otherwise(out)
    return out
