"""Best-fit packing of token sequences with large-item matching.

Documents are encoded and cut into pieces of at most the capacity (only a document's first piece may be shorter). What
the packing decides depends on piece lengths alone, so it runs on the histogram of lengths, which has at most
``capacity`` rows whatever the corpus holds:

* lengths above a third of the capacity, longest first: a bin takes two of them at most, so each is matched greedily
  with the longest partner that fits;
* the others, longest first, go to the fullest bins that still have room, as many to a bin as fit; bins are opened when
  no gap is wide enough.

Bins with the same content are one run, and every placement is a rule: pieces of one length with ranks in an interval
go to a run's bins in order. The rules (a few for each length, independent of the corpus) are broadcast; Spark ranks the
pieces within their length and looks up where each one goes. Every piece is placed and none is cut further.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import arrow_rows, col, give_back, tokenizer_path, written
from panelkit.llm.encode import encoder, with_end

CAPACITY = 1024
END_ID = 2

_RULES = "length long, first_rank long, end_rank long, first_bin long, per_bin long, at long"


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rules (length, first rank, end rank, first bin, pieces per bin, offset in the bin) for ``counts`` pieces of each
    length, and the number of bins."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    rules: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of bins (first, number)
    bins = 0

    def put(length: int, count: int, first: int, per_bin: int, at: int) -> None:
        rules.append((length, rank[length], rank[length] + count, first, per_bin, at))
        rank[length] += count
        left[length] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:
            if b > a or a + b > capacity or not left[a] or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                if a == b:
                    put(a, 2 * n, bins, 2, 0)
                else:
                    put(a, n, bins, 1, 0)
                    put(b, n, bins, 1, a)
                gaps[capacity - a - b].append((bins, n))
                bins += n
        if left[a]:
            n = left[a]
            put(a, n, bins, 1, 0)
            gaps[capacity - a].append((bins, n))
            bins += n

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            room = min((g for g, runs in gaps.items() if g >= s and runs), default=None)
            if room is None:
                room, n = capacity, -(-left[s] // (capacity // s))
                gaps[room].append((bins, n))
                bins += n
            first, n = gaps[room].pop()
            per_bin, at = room // s, capacity - room
            full, rest = divmod(min(left[s], per_bin * n), per_bin)
            if full:
                put(s, full * per_bin, first, per_bin, at)
                gaps[room - per_bin * s].append((first, full))
            if rest:
                put(s, rest, first + full, rest, at)
                gaps[room - rest * s].append((first + full, 1))
            if n > full + bool(rest):
                gaps[room].append((first + full + bool(rest), n - full - bool(rest)))
    return rules, bins


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    give_back()  # what the stages before left in this process
    task = TaskContext.get().partitionId()
    enc = encoder(path)
    seen: dict[int, int] = defaultdict(int)  # pieces of each length so far: at most ``capacity`` entries
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if keep_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]
    for batch in batches:
        done = 0
        for ids, sizes in enc.lots(batch.column(1)):
            rows: list[list] = [[] for _ in names]
            ended, stops = with_end(ids, sizes, end_id)
            del ids
            data, first = memoryview(ended).cast("B"), 0
            for doc, stop in zip(batch.column(0).slice(done, len(stops)).to_pylist(), stops.tolist(), strict=True):
                total = stop - first
                edges = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for piece, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = data[4 * (first + a) : 4 * (first + z)]
                    for held, v in zip(rows, (doc, piece, a, z - a, zlib.crc32(part), task, seen[z - a], part), strict=False):
                        held.append(v)
                    seen[z - a] += 1
                first = stop
            done += len(stops)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], names=names)
    give_back()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``, little-endian
    unsigned 32-bit, with ``keep_ids``).

    A null text is empty and gives one piece with the end id. Every row is a document of its own, repeated rows and null
    ids included. An empty table gives no rows. Other columns are ignored. The pieces are written to the shared folder
    once, with each task's own numbering of a length; what a length has in earlier tasks makes the numbering global.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 1600)
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + (", ids binary" if keep_ids else "")
    job = partial(_pieces, path=tokenizer_path(tokenizer), capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    pieces = written(slim.mapInArrow(job, schema), "pieces")

    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rules, _ = plan_bins(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    rule = F.broadcast(spark.createDataFrame(rules, _RULES).withColumnRenamed("length", "rule_length"))
    placed = ranked.join(rule, (F.col("length") == F.col("rule_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    k = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(k / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("at") + (k % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., keep_ids=True)``: ``sequence_id, input_ids`` and the pieces'
    lengths in order (for masks between documents). A sequence holds at most the capacity."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        return pd.DataFrame({"sequence_id": [rows.sequence_id.iloc[0]], "input_ids": [np.frombuffer(b"".join(rows.ids), "<u4").astype("int32")], "lengths": [rows.length.to_numpy()]})

    return packed.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, input_ids array<int>, lengths array<long>")
