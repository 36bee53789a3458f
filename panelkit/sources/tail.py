"""The last lines of a log by their place in its files.

A line's place is (file, byte offset), as Hadoop's text input gives it, so no order column is needed and equal timestamps
don't matter. Only the last splits are opened: files are taken from the newest back, a split at a time, until there are
enough lines. What is read does not grow with the log.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.sources.files import _fs

#: Bytes of a split.
SPLIT_BYTES = 1 << 20


def age_order(name: str) -> tuple:
    """Sort key of a log file, oldest first: ``x.log.2``, ``x.log.1``, ``x.log``; other names in their own order."""
    m = re.fullmatch(r"(.*?)(?:\.(\d+))?(\.gz)?", name)
    return m[1], -int(m[2] or 0)


def log_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder (or the file itself), oldest first; hidden files and empty ones are left out."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p) if s.isFile() and s.getLen() > 0]
    return [f for name, f in sorted(found, key=lambda x: age_order(x[0])) if not name.startswith(("_", "."))]


def tail_by_position(spark: SparkSession, path: str, n: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``position, file, offset, line`` of the last ``n`` lines, newest first (position 1). A missing path has none."""
    sc = spark.sparkContext
    conf = {"mapreduce.input.fileinputformat.split.maxsize": str(split_bytes), "mapreduce.input.fileinputformat.split.minsize": "1"}
    held: list[tuple[str, int, str]] = []
    for file in reversed(log_files(spark, path)):
        if len(held) >= n:
            break
        lines = sc.newAPIHadoopFile(file, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable",
                                    "org.apache.hadoop.io.Text", conf=conf)
        for part in range(lines.getNumPartitions() - 1, -1, -1):
            left = n - len(held)
            if left <= 0:
                break

            def last(rows, left=left):
                from collections import deque

                return list(deque(rows, maxlen=left))  # a task sends no more lines than are asked for

            held += [(file, offset, line) for offset, line in reversed(sc.runJob(lines, last, [part]))]
    rows = [(i + 1, f, o, x) for i, (f, o, x) in enumerate(held)]
    return spark.createDataFrame(rows, "position int, file string, offset long, line string").withColumn("file", F.element_at(F.split("file", "/"), -1))
