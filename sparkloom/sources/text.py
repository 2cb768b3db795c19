"""Text edge lists and run logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.records import write_edges

#: Fixed patterns of a run log: the line that starts a run, and a process's time.
RUN_START = r"sudo\s+mpirun.*?--map-by socket\s+(.*)"
RUN_TIME = r"total_process_time\s+=([0-9.]+)\(s\)"
#: Lines of edge lists: numbers that fit the binary records, a weight where one is wanted.
NUMBER, WEIGHT = r"\d{1,18}", r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _edges(line: Column, pattern: str, weighted: bool) -> DataFrame:
    fields = [F.regexp_extract(line, pattern, i) for i in (1, 2, 3)[: 3 if weighted else 2]]
    kinds = ("long", "long", "float")
    return [F.when(f != "", f).try_cast(k).alias(n) for f, k, n in zip(fields, kinds, ("src", "dst", "w"), strict=False)]


def parsed_lines(spark: SparkSession, path: str, weighted: bool = False, gr: bool | None = None) -> DataFrame:
    """(file, line, src, dst, w if weighted) of an edge list's lines; ``src`` is null where the line is no edge.

    Tab-separated: ``src<tab>dst[<tab>w]``, no header, no comments; empty lines are none. ``gr`` (by the name's ending if not said):
    ``a src dst [w]`` separated by spaces; lines of other kinds aren't edge lines and are left out.
    """
    gr = path.endswith(".gr") if gr is None else gr
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.rtrim("value").alias("line"))
    if gr:
        lines = lines.where(F.col("line").rlike(r"^\s*a\s"))
        pattern = rf"^\s*a\s+({NUMBER})\s+({NUMBER})" + (rf"\s+({WEIGHT})$" if weighted else rf"(?:\s+{WEIGHT})?$")
    else:
        lines = lines.where("line <> ''")
        pattern = rf"^({NUMBER})\t({NUMBER})" + (rf"\t({WEIGHT})$" if weighted else rf"(?:\t{WEIGHT})?$")
    return lines.select("file", "line", *_edges(F.col("line"), pattern, weighted))


def read_text_edges(spark: SparkSession, path: str, weighted: bool = False, gr: bool | None = None) -> DataFrame:
    """The edges of a text file; a line that is none fails the job, with the line in the message. ``bad_lines`` finds them all."""
    rows = parsed_lines(spark, path, weighted, gr)
    complain = F.raise_error(F.concat(F.lit("no edge: "), F.substring("line", 1, 200), F.lit(" in "), F.col("file"))).cast("long")
    return rows.select(F.coalesce("src", complain).alias("src"), *rows.columns[3:])


def read_tsv_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return read_text_edges(spark, path, weighted, gr=False)


def read_gr_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return read_text_edges(spark, path, weighted, gr=True)


def bad_lines(spark: SparkSession, path: str, weighted: bool = False, gr: bool | None = None) -> DataFrame:
    """(file, line) of the lines that are no edges."""
    return parsed_lines(spark, path, weighted, gr).where("src is null").select("file", "line")


def convert_edges(spark: SparkSession, path: str, out: str, weighted: bool = False, gr: bool | None = None) -> tuple[int, int]:
    """Writes a text file's edges as binary records, in one pass from lines to records; gives the numbers of edges and of bad lines."""
    seen = Observation()
    rows = parsed_lines(spark, path, weighted, gr)
    rows = rows.observe(seen, F.count("src").alias("edges"), F.count_if(F.col("src").isNull()).alias("bad"))
    write_edges(rows.where("src is not null"), out, weighted)
    return seen.get.get("edges") or 0, seen.get.get("bad") or 0


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines of log files by the byte ranges that tasks read; ``block`` is where a range begins."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


_RUNS = "file string, block long, number long, command string, time double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, number, command, time): the runs that begin in a block, from 1; number 0 has the greatest time before the first."""
    start, timed = RUN_START.replace(r"\s", "[[:space:]]"), RUN_TIME.replace(r"\s", "[[:space:]]")
    begins = re.compile(RUN_START)
    at, number, time, command = None, 0, None, None

    def row(key: tuple, n: int, text: str | None, most: float | None) -> tuple:
        return (*key, n, text, most)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "number", "command", "time"])

    for batch in batches:
        lines = batch.column("value")
        is_start = pc.match_substring_regex(lines, start).to_numpy(zero_copy_only=False)
        is_time = pc.match_substring_regex(lines, timed).to_numpy(zero_copy_only=False)
        rows: list[tuple] = []
        blocks, files = batch.column("block").to_numpy(), batch.column("file")
        for i in np.flatnonzero(is_start | is_time).tolist():
            key = (files[i].as_py(), int(blocks[i]))
            line = lines[i].as_py()
            if key != at:
                if at is not None:
                    rows.append(row(at, number, command, time))
                at, number, time, command = key, 0, None, None
            if is_start[i]:
                rows.append(row(at, number, command, time))
                number, time, command = number + 1, None, begins.search(line)[1].strip()
            else:
                try:
                    found = float(re.search(RUN_TIME, line)[1])
                except ValueError:  # 1.2.3
                    continue
                time = found if time is None else max(time, found)
        if rows:
            yield out(rows)
    if at is not None:
        yield out([row(at, number, command, time)])


def summarise_runs(lines: DataFrame) -> DataFrame:
    """(file, run, command, max_time) from ``read_log``: a run's greatest process time, in seconds, 0 without any.

    Each byte range is scanned where it is read, and gives its runs and what came before its first: times that belong to the
    run that was open when the range began. Ranges are put in order by a row for each; no file is read by one task, and lines don't
    travel. Lines before a file's first run give no row. A line that starts a run isn't read for a time.
    """
    runs = lines.select("file", "block", "value").mapInArrow(_scan, _RUNS)
    counts = runs.groupBy("file", "block").agg(F.max("number").alias("n"))
    before = counts.select("file", "block", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = runs.join(before, ["file", "block"]).withColumn("run", F.col("before") + F.col("number")).where("run > 0")
    return placed.groupBy("file", "run").agg(F.max("command").alias("command"), F.coalesce(F.max("time"), F.lit(0.0)).alias("max_time"))


def report_lines(summary: DataFrame) -> DataFrame:
    """(file, run, place, value): a line with the command, one with the time, and an empty one for each run."""
    lines = F.array(F.concat(F.lit("Run: "), "command"), F.concat(F.lit("Max Total Process Time: "), F.col("max_time").cast("string"), F.lit("(s)")), F.lit(""))
    return summary.select("file", "run", F.posexplode(lines).alias("place", "value"))


def write_report(summary: DataFrame, path: str) -> None:
    """The report's lines as one text file."""
    report_lines(summary).orderBy("file", "run", "place").select("value").coalesce(1).write.mode("overwrite").text(path)
