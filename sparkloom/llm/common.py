"""Small expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; no word for a text without any."""
    return F.array_remove(F.split(text, SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*columns: Column) -> Column:
    """128 bits that stand for a row's content; equal rows share a key and get equal results."""
    return F.struct(
        F.xxhash64(*columns).alias("a"),
        F.xxhash64(F.lit(7), *columns, F.lit("row")).alias("b"),
    )


def free_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """A column name for each wanted one that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in wanted:
        free = f"_{name}"
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out[name] = free
    return out


#: What an operator keeps in a Python worker between tasks, by its name: how to let go of it.
_caches: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    _caches[owner] = clear


def only(owner: str) -> None:
    """Let go of what other operators kept in this worker: workers are reused from stage to stage."""
    for name, clear in _caches.items():
        if name != owner:
            clear()
