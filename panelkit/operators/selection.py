"""Exact quantiles by refinement: values are counted where they lie, never moved.

A double becomes an unsigned 64-bit key of the same order. A pass counts one stretch of the key's bits per (group, column)
and sends counts only, combined in each task before the shuffle:

1. the first ``FIRST_BITS`` bits of every value. The counts give each group's number of values and, for every wanted rank,
   the one prefix that holds it;
2. while a prefix holds more than ``FEW`` values, the next ``NEXT_BITS`` bits of the values that share it;
3. the values themselves, with counts, of the last prefixes.

All columns share a pass, so a table is scanned two times, three beyond some 10^9 values a column. Without groups the
wanted prefixes (ranks x columns) go into the tasks as constants; with groups they are joined to the rows by group, as one
row a group. The sums over prefixes run inside one (group, column, rank) and see at most 2^22 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import materialize

FIRST_BITS, NEXT_BITS = 20, 22
#: Values of one prefix that the last pass may send as (value, count).
FEW = 1_000_000


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of doubles: -0 equals 0, NaN comes last."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _atoms(column: pa.Array) -> list[pa.Array]:
    """A column as plain ones: a struct is its fields and whether it is there."""
    if not pa.types.is_struct(column.type):
        return [column]
    return [column.is_valid(), *[a for field in column.flatten() for a in _atoms(field)]]


def _counted(groups: list[pa.Array], what: pa.Array) -> tuple[list[pa.Array], pa.Array, pa.Array]:
    """Occurrences of each value of ``what`` in each group: group columns, values, counts."""
    atoms = [a for g in groups for a in _atoms(g)]
    names = [f"_a{i}" for i in range(len(atoms))]
    rows = pa.Table.from_arrays([*atoms, what, pa.array(np.arange(len(what)))], names=[*names, "_b", "_row"])
    found = rows.group_by([*names, "_b"]).aggregate([("_row", "min"), ([], "count_all")])
    one = found.column("_row_min").combine_chunks()  # a row of each group
    return [g.take(one) for g in groups], found.column("_b").combine_chunks(), found.column("count_all").combine_chunks()


def _pass(batches: Iterator[pa.RecordBatch], by: list[str], n_cols: int, slots: int, done: int, width: int,
          fixed: list[list[int | None]] | None) -> Iterator[pa.RecordBatch]:
    """Counts of the ``width`` bits after the first ``done`` (of the values themselves when nothing follows). A batch has
    the group columns, the values and, unless ``fixed`` names them, each column's wanted prefixes."""
    last = done + width == 64
    skip, after = np.uint64(64 - done) if done else None, np.uint64(64 - done - width)
    low = np.uint64((1 << width) - 1)
    for batch in batches:
        groups = [batch.column(i) for i in range(len(by))]
        for i in range(n_cols):
            held = batch.column(len(by) + i)
            valid = held.is_valid().to_numpy(zero_copy_only=False)
            x = held.fill_null(0.0).to_numpy(zero_copy_only=False)
            keys = ordered_keys(x)
            for s in range(slots if done else 1):
                use = valid
                if done:
                    if fixed is not None:
                        wanted = fixed[i][s]
                        if wanted is None:
                            continue
                        use = valid & (keys >> skip == np.uint64(wanted))
                    else:
                        target = batch.column(len(by) + n_cols + i * slots + s)
                        use = valid & target.is_valid().to_numpy(zero_copy_only=False)
                        use &= keys >> skip == target.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
                at = np.flatnonzero(use)
                if not len(at):
                    continue
                what = pa.array(x[at] + 0.0) if last else pa.array(((keys[at] >> after) & low).astype(np.int64))
                if by:
                    rows = pa.array(at)
                    keyed, values, counts = _counted([g.take(rows) for g in groups], what)
                else:
                    found, many = np.unique(what.to_numpy(), return_counts=True)
                    keyed, values, counts = [], pa.array(found), pa.array(many.astype(np.int64))
                n = len(counts)
                yield pa.RecordBatch.from_arrays([*keyed, pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, s, np.int32)), values, counts.cast(pa.int64())], names=[*by, "_i", "_s", "_b", "_c"])


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, long form: ``*by, column, n, q`` with ``q`` an array in the order of
    ``probs`` and ``n`` the non-null values. Groups and columns without a value have no row; null group keys are groups
    of their own; NaN counts as the largest value."""
    by = by or []
    keys = [f"_k{j}" for j in range(len(by))]
    slots = 2 * len(probs)  # the values below and above each quantile's place
    source = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    key_types = [f"{k} {source.schema[k].dataType.simpleString()}" for k in keys]
    group = ["_i", *keys]

    def run(rows: DataFrame, done: int, width: int, fixed=None) -> DataFrame:
        last = done + width == 64
        schema = ", ".join([*key_types, "_i int", "_s int", f"_b {'double' if last else 'long'}", "_c long"])
        job = partial(_pass, by=keys, n_cols=len(cols), slots=slots, done=done, width=width, fixed=fixed)
        counts = rows.mapInArrow(job, schema).groupBy(*group, "_s", "_b").agg(F.sum("_c").alias("_c"))
        order = Window.partitionBy(*group, "_s").orderBy("_b")
        return counts.withColumn("_before", F.sum("_c").over(order) - F.col("_c"))

    def holds(rank: Column) -> Column:
        return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))

    first = run(source, 0, FIRST_BITS).withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    places = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ranks = [r for pos in places for r in (F.floor(pos), F.ceil(pos))]
    hits = F.array(*[F.when(holds(r), F.struct(F.lit(s).alias("_s"), r.alias("_r"))) for s, r in enumerate(ranks)])
    found = first.select(*group, "_n", F.col("_b").alias("_p"), "_before", "_c", F.inline(F.filter(hits, lambda h: h.isNotNull())))
    state = found.select(*group, "_n", "_s", "_p", (F.col("_r") - F.col("_before")).alias("_r"), "_c")

    done = FIRST_BITS
    while True:
        if by:
            state = materialize(state)
            most = state.agg(F.max("_c")).first()[0] or 0
            fixed = None
            wide = state.groupBy(*[F.col(k).alias(f"_g{k}") for k in keys]).agg(
                *[F.max(F.when((F.col("_i") == i) & (F.col("_s") == s), F.col("_p"))).alias(f"_t{i}_{s}")
                  for i in range(len(cols)) for s in range(slots)])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in keys])
            rows = source.join(wide, same).drop(*[f"_g{k}" for k in keys])
        else:
            held = state.collect()  # ranks x columns
            most = max((r["_c"] for r in held), default=0)
            state = df.sparkSession.createDataFrame([tuple(r) for r in held], "_i int, _n long, _s int, _p long, _r long, _c long")
            fixed = [[None] * slots for _ in cols]
            for r in held:
                fixed[r["_i"]][r["_s"]] = r["_p"]
            rows = source
        width = NEXT_BITS if most > FEW and done + NEXT_BITS < 64 else 64 - done
        counts = run(rows, done, width, fixed)
        wanted = state.select(*[F.col(c).alias(f"_w{c}") for c in (*group, "_s")], "_n", "_p", "_r")
        match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w{c}")) for c in (*group, "_s")])
        hit = counts.join(wanted, match & holds(F.col("_r")))
        if done + width == 64:
            break
        state = hit.select(*group, "_n", "_s", (F.shiftleft("_p", width) + F.col("_b")).alias("_p"), (F.col("_r") - F.col("_before")).alias("_r"), "_c")
        done += width

    value = hit.groupBy(*group, "_n").agg(*[F.max(F.when(F.col("_s") == s, F.col("_b"))).alias(f"_v{s}") for s in range(slots)])
    q = []
    for j, pos in enumerate(places):
        below, above = F.col(f"_v{2 * j}"), F.col(f"_v{2 * j + 1}")
        q.append(F.when(F.floor(pos) == F.ceil(pos), below).otherwise((F.ceil(pos) - pos) * below + (pos - F.floor(pos)) * above))
    names = F.array(*[F.lit(c) for c in cols])
    return value.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], names[F.col("_i")].alias("column"), F.col("_n").alias("n"), F.array(*q).alias("q"))
