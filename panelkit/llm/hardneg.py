"""Hard negatives by a secondary sort of pair scores.

Each anchor needs its best rows of its own label (positives) and, for each positive, the best rows of other labels whose
score lies in a window under the positive's score. Scores are exact integers.

* Rows are numbered in the order of their ids and stored as blocks of bounded size in the shared folder, once. Only block
  names travel after that: a task takes one block's anchors and a stretch of ``STRETCH`` blocks, reads them one by one and
  multiplies.
* Pair scores become packed keys (anchor, descending score, positives first, row number), 24 bytes whose byte order is the
  sort order. ``repartitionAndSortWithinPartitions`` deals them by anchor and sorts, spilling where it must. An iterator
  reads each anchor's pairs from the best down: a positive opens a window, a negative is emitted to every open window that
  holds it until the window has enough. Nothing is held for an anchor but its windows.
* A task sends only pairs that can matter: a stretch's best ``positives`` of an anchor in the first pass, whose sorted
  stream fixes the windows; then the stretch's best ``negatives`` of every window in the second. Both are exact, since the
  best of all are among the bests of each stretch.

The work is anchors times rows by definition; the rows sent are anchors times stretches.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import arrow_rows, pyfs, shared_folder, written

#: Numbers (rows times length) that a block holds at most; blocks that a task reads one after the other.
BLOCK_NUMBERS, STRETCH = 500_000, 64
#: Numbers of a score matrix in a task.
_SCORES = 1 << 21
_KEY = struct.Struct(">QQQ")
_TOP, _LEAST = (1 << 63) - 1, -(1 << 63)


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the window: low <= negative / positive <= high, in percent."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


# ---------------------------------------------------------------------------------------------------------- blocks
def _store(table: pa.Table, folder: str) -> pa.Table:
    table = table.sort_by("row")
    fs, base = pyfs(folder)
    fs.create_dir(base, recursive=True)
    x = np.array(table.column("x").to_pylist(), np.int64).reshape(table.num_rows, -1)
    small = not x.size or (x.min() >= -(1 << 31) and x.max() < 1 << 31)
    ids, anchor = table.column("vec_id"), table.column("anchor").to_numpy()
    name = f"block-{uuid.uuid4().hex}.npz"  # a lost task's file is never named in the table that Spark commits
    data = io.BytesIO()
    np.savez(data, row=table.column("row").to_numpy(), id=ids.fill_null(0).to_numpy(), no_id=ids.is_null().to_numpy(), label=table.column("label").to_numpy(), anchor=anchor, x=x.astype(np.int32) if small else x)
    with fs.open_output_stream(f"{base}/{name}") as f:
        f.write(data.getvalue())
    return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "anchors": pa.array([int(anchor.sum())], pa.int64()), "file": [name]})


def _load(folder: str, name: str) -> dict:
    fs, base = pyfs(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return dict(np.load(io.BytesIO(f.read())))


def _stored_blocks(rows: DataFrame, folder: str) -> DataFrame:
    """Number the rows by (length, id, content), store blocks of them and return the written table of blocks."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = rows.dropDuplicates(["vec_id", "label", "x"]).select("*", F.size("x").alias("dim"), F.xxhash64("label", "x").alias("tie"))
    order = [F.col("dim"), F.col("vec_id").asc_nulls_last(), F.col("tie")]
    ordered = full.repartitionByRange(n, *order).sortWithinPartitions(*order, "label", "x")
    placed = written(ordered.select("vec_id", "label", "x", "anchor", "dim", F.monotonically_increasing_id().alias("at")), "ordered-vectors")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    row = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    size = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest("dim", F.lit(1))))
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part").select("vec_id", "label", "x", "anchor", "dim", row.alias("row"))
    dealt = numbered.withColumn("block", F.floor(F.col("row") / size))

    def store(table: pa.Table) -> pa.Table:
        return _store(table, folder)

    return written(dealt.groupBy("dim", "block").applyInArrow(store, "dim int, block long, anchors long, file string"), "vector-blocks")


# ---------------------------------------------------------------------------------------------------------- scores
def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: doubles where none can pass 2^53, else 64-bit integers, else integers of any
    size cut to 64 bits."""
    most = max(1, a.shape[1]) * int(np.abs(a.astype(object)).max(initial=0)) * int(np.abs(x.astype(object)).max(initial=0)) if _wide(a) or _wide(x) else max(1, a.shape[1]) * _peak(a) * _peak(x)
    if most < 1 << 53:
        return a.astype(np.float64) @ x.astype(np.float64).T
    if most < 1 << 62:
        return a.astype(np.int64) @ x.astype(np.int64).T
    return np.clip(a.astype(object) @ x.astype(object).T, _LEAST, _TOP).astype(np.int64)


def _wide(m: np.ndarray) -> bool:
    return bool(m.size) and int(m.min()) == _LEAST  # its absolute value has no 64-bit form


def _peak(m: np.ndarray) -> int:
    return int(np.abs(m.astype(np.int64)).max(initial=0))


class _Best:
    """The best ``k`` (score, row) of every slot, ties to the smaller row, over the matrices it is shown."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.where = np.zeros(0, np.int64)

    def show(self, first: int, s: np.ndarray, ok: np.ndarray, rows: np.ndarray, where: np.ndarray) -> None:
        """Scores ``s`` of slots from ``first`` on where ``ok``; ``where`` names the columns to the caller."""
        if not s.size or not self.k:
            return
        r, c = np.nonzero(ok)
        v = s[r, c]
        if s.shape[1] > self.k:  # of each slot only what reaches its k-th best
            low = np.where(ok, s.astype(np.float64), -np.inf)
            kth = np.partition(low, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            near = v.astype(np.float64) >= kth[r]
            r, c, v = r[near], c[near], v[near]
        self.slot = np.concatenate([self.slot, r + first])
        self.score = np.concatenate([self.score, v.astype(np.int64)])
        self.row = np.concatenate([self.row, rows[c]])
        self.where = np.concatenate([self.where, where[c]])
        order = np.lexsort((self.row, ~self.score, self.slot))
        slot = self.slot[order]
        start = np.searchsorted(slot, slot)
        keep = order[np.arange(len(order)) - start < self.k]
        self.slot, self.score, self.row, self.where = self.slot[keep], self.score[keep], self.row[keep], self.where[keep]


def _id(block: dict, i: int) -> int | None:
    return None if block["no_id"][i] else int(block["id"][i])


_PAIR = "anchor long, anchor_id long, negative boolean, row long, id long, score long, dim int, block long"
_PAIR_TYPES = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("negative", pa.bool_()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("dim", pa.int32()), ("block", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch], folder: str, rule: Mining, negatives: bool) -> Iterator[pa.RecordBatch]:
    """A stretch's best pairs of a block's anchors: positives, or negatives inside the anchors' windows."""
    for batch in batches:
        for task in batch.to_pylist():
            own = _load(folder, task["file"])
            of = np.flatnonzero(own["anchor"])
            a, label, number = own["x"][of], own["label"][of], own["row"][of]
            k = rule.positives if negatives else 1
            low, high = _windows(folder, task["windows"], number, rule) if negatives else (None, None)
            best = _Best(len(of) * k, rule.negatives if negatives else rule.positives)
            ids: list[tuple[np.ndarray, np.ndarray]] = []
            count = 0
            for name in task["files"]:
                other = _load(folder, name)
                step = max(1, _SCORES // max(1, len(other["row"])))
                where = np.arange(count, count + len(other["row"]))
                for i in range(0, len(of), step):
                    part = slice(i, i + step)
                    s = scores(a[part], other["x"])
                    same = label[part, None] == other["label"][None, :]
                    if not negatives:
                        best.show(i, s, same & (number[part, None] != other["row"][None, :]), other["row"], where)
                        continue
                    for j in range(k):
                        ok = ~same & (s >= low[part, j, None]) & (s <= high[part, j, None])
                        # slots of window j follow those of window j - 1
                        best.show(j * len(of) + i, s, ok, other["row"], where)
                ids.append((other["id"], other["no_id"]))
                count += len(other["row"])
            if not len(best.slot):
                continue
            all_ids, none = (np.concatenate(c) for c in zip(*ids, strict=True))
            anchor = best.slot % len(of)
            first = np.unique(np.stack([anchor, best.row]), axis=1, return_index=True)[1]  # a row of two windows once
            anchor, where = anchor[first], best.where[first]
            n = len(first)
            columns = [number[anchor], pa.array(own["id"][of][anchor], mask=own["no_id"][of][anchor]), np.full(n, negatives), best.row[first], pa.array(all_ids[where], mask=none[where]), best.score[first], np.full(n, task["dim"], np.int32), np.full(n, task["block"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, np.ndarray) else c for c, t in zip(columns, _PAIR_TYPES, strict=True)], schema=_PAIR_TYPES)


def bounds(score: int, rule: Mining) -> tuple[int, int]:
    """Least and largest negative score of a positive's window; an empty window where the score is below zero."""
    return max(_LEAST, -((-rule.low * score) // 100)), min(_TOP, (rule.high * score) // 100)


def _windows(folder: str, name: str, numbers: np.ndarray, rule: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchor, window) of a block's anchors; windows that don't exist are empty."""
    held = _load(folder, name)
    low, high = np.full((len(numbers), rule.positives), 1, np.int64), np.zeros((len(numbers), rule.positives), np.int64)
    at, used = np.searchsorted(numbers, held["anchor"]), np.zeros(len(numbers), np.int64)
    for i, s in zip(at.tolist(), held["score"].tolist(), strict=True):
        low[i, used[i]], high[i, used[i]] = bounds(s, rule)
        used[i] += 1
    return low, high


def _store_windows(table: pa.Table, folder: str) -> pa.Table:
    fs, base = pyfs(folder)
    name, data = f"windows-{uuid.uuid4().hex}.npz", io.BytesIO()
    np.savez(data, anchor=table.column("anchor").to_numpy(), score=table.column("score").to_numpy())
    with fs.open_output_stream(f"{base}/{name}") as f:
        f.write(data.getvalue())
    return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "windows": [name]})


# ---------------------------------------------------------------------------------------------------------- the sort
def pack(anchor: int, score: int, negative: bool, row: int) -> bytes:
    """A key whose byte order is (anchor, descending score, positives first, row)."""
    return _KEY.pack(anchor, _TOP - score, negative << 62 | row)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, rest = _KEY.unpack(key)
    return anchor, _TOP - score, bool(rest >> 62), rest & ((1 << 62) - 1)


def _by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def _sorted_pairs(pairs: DataFrame):
    """An RDD of (key, (anchor id, row id, length, block)), each anchor in one partition, best pairs first."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(rows: Iterable) -> Iterator[tuple]:
        for r in rows:
            yield pack(r.anchor, r.score, r.negative, r.row), (r.anchor_id, r.id, r.dim, r.block)

    return pairs.rdd.mapPartitions(keyed).repartitionAndSortWithinPartitions(n, _by_anchor)


def _first_positives(pairs: Iterable, rule: Mining) -> Iterator[tuple]:
    now, taken = None, 0
    for key, (anchor_id, other_id, dim, block) in pairs:
        anchor, score, _, row = unpack(key)
        if anchor != now:
            now, taken = anchor, 0
        if taken < rule.positives:
            taken += 1
            yield anchor, anchor_id, False, row, other_id, score, dim, block


def emitted(pairs: Iterable, rule: Mining) -> Iterator[tuple]:
    """Walk sorted pairs: positives open windows, negatives go to the open windows that hold them."""
    now, windows = None, []
    for key, (anchor_id, other_id, _, _) in pairs:
        anchor, score, negative, _ = unpack(key)
        if anchor != now:
            now, windows = anchor, []
        if not negative:
            windows.append([other_id, score, *bounds(score, rule), 0])
            continue
        for w in windows:
            if w[2] <= score <= w[3] and w[4] < rule.negatives:
                w[4] += 1
                yield anchor_id, w[0], w[4], other_id, w[1], score


def mined(rows: DataFrame, rule: Mining = Mining()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``vec_id long, label long,
    x array<long>, anchor boolean`` without nulls in ``label``, ``x``, its components and ``anchor``.

    Higher scores come first, ties by the smaller id (null ids last, rows of one id by a digest of their content).
    Repeated rows (same id, label and vector) count once. Rows of one id with other content are rows, and anchors, of
    their own. Vectors are compared when their lengths agree. Scores beyond 64 bits are cut to them. Anchors without
    positives, and windows without negatives, have no rows; an empty table gives none.
    """
    spark = rows.sparkSession
    arrow_rows(spark, 10_000)
    folder = shared_folder(spark, "hard-negatives")
    blocks = _stored_blocks(rows, folder)
    stretches = blocks.groupBy("dim", F.floor(F.col("block") / STRETCH).alias("stretch")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = written(blocks.where("anchors > 0").select("dim", "block", "file").join(stretches, "dim").repartition(n), "block-pairs")

    near = tasks.select("dim", "block", "file", "files").mapInArrow(partial(_pairs, folder=folder, rule=rule, negatives=False), _PAIR)
    first = written(spark.createDataFrame(_sorted_pairs(near).mapPartitions(partial(_first_positives, rule=rule)), _PAIR), "positives")

    def store(table: pa.Table) -> pa.Table:
        return _store_windows(table, folder)

    windows = first.select("dim", "block", "anchor", "score").groupBy("dim", "block").applyInArrow(store, "dim int, block long, windows string")
    aimed = tasks.join(written(windows, "windows"), ["dim", "block"]).select("dim", "block", "file", "files", "windows")
    far = aimed.repartition(n).mapInArrow(partial(_pairs, folder=folder, rule=rule, negatives=True), _PAIR)
    out = _sorted_pairs(first.unionByName(far)).mapPartitions(partial(emitted, rule=rule))
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x``: usable rows of ``embeddings``, each component c as floor(256 * c) in double. Components
    beyond 64 bits are cut to them."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(e, lambda c: F.floor(F.lit(256.0) * c)).alias("x"))


def hard_negatives(vectors: DataFrame, rule: Mining = Mining()) -> DataFrame:
    """:func:`mined` over ``embeddings``: anchors are ids divisible by 50, and ids divisible by 7 take the next label of
    ten. Rows with a null label or vector, or a null or non-finite component, take no part; other columns are ignored."""
    rows = integer_vectors(vectors).where(F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), "x", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)).alias("anchor")), rule)


#: The same rows from all pairs of an anchor and a row.
SQL = """
WITH v AS (
  SELECT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER w AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY rank <= 3
"""
