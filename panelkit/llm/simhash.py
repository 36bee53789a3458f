"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its word shingles. Texts are
linked when their fingerprints differ in at most ``radius`` bits.

Search. The bits are cut into ``radius + 2`` blocks; fingerprints within the radius agree in two blocks at least, so one
table for each pair of blocks, bucketed by the bits of that pair, brings every link together in some bucket. Buckets hold
distinct fingerprints only (copies collapse before), and a bucket above ``BLOCK`` fingerprints is dealt out over a grid of
its blocks: complete, in tasks of bounded size.

Comparison. A task stores its fingerprints as 64 vertical bit planes, 64 fingerprints to a machine word. For a
fingerprint and a word of candidates it XORs plane by plane and adds the difference bits to carry-save counters, so 64
distances advance together. A counter that passes the radius marks its lane; words whose lanes are all marked are
abandoned. A task does not return pairs but the star of each local component, so a group of n near copies gives n - 1
links, whose components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelkit.llm.common import arrow_rows, col, row_digest, written
from panelkit.llm.graph import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one bucket that are compared in one task.
BLOCK = 4096
_HASHES = 1 << 16
_CELLS = 1 << 18


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a UTF-8 text: A-Z lower-cased, words between spaces and ASCII controls 9 to 13, shingles
    with their repeats. Fewer words than a shingle: the whole sequence is the only one. No word or null: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _HASHES):
        hashes = np.array([xxh64_intdigest(line[a:z], SEED) for a, z in zip(first[i : i + _HASHES], last[i : i + _HASHES], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array, shingle: int) -> pa.Array:
    return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())


def with_fingerprint(docs: DataFrame, out: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit column ``out``."""
    arrow_rows(docs.sparkSession, 2000)

    def prints(texts: pa.Array) -> pa.Array:
        return _fingerprints(texts, shingle)

    prints.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(prints, "long")(col(text_col).cast("string").cast("binary")))


def near(prints: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j < end[i], whose 64-bit ``prints`` differ in at most ``radius`` bits, by carry-save
    counting over vertical bit planes."""
    n = len(prints)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")  # 64 planes of ``words`` words
    del bits
    every, one = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    rows = np.flatnonzero(end > np.arange(n) + 1)
    w0, w1 = (rows + 1) >> 6, (end[rows] - 1) >> 6
    cells = np.cumsum(w1 - w0 + 1)
    k = radius.bit_length()  # counters start so high that they overflow just past the radius
    slack = (1 << k) - 1 - radius
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + _CELLS)))
        size = w1[at:to] - w0[at:to] + 1
        q = np.repeat(rows[at:to], size)
        w = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w0[at:to], size)
        lo, hi = np.maximum(q + 1 - 64 * w, 0).astype(np.uint64), np.minimum(end[q] - 64 * w, 64).astype(np.uint64)
        alive = (every << lo) & (every >> (np.uint64(64) - hi))
        count = [np.full(len(q), every if slack >> i & 1 else 0, np.uint64) for i in range(k)]
        for b in range(64):
            carry = planes[b][w] ^ (every * ((prints[q] >> np.uint64(b)) & one))
            for i in range(k):
                count[i], carry = count[i] ^ carry, count[i] & carry
            alive &= ~carry
            if b % 4 == 3:  # abandon words without a lane inside the radius
                keep = np.flatnonzero(alive)
                if len(keep) < len(alive):
                    q, w, alive, count = q[keep], w[keep], alive[keep], [c[keep] for c in count]
        if len(q):
            lanes = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, lane = np.nonzero(lanes)
            if len(cell):
                yield q[cell], 64 * w[cell] + lane
        at = to


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of every pair the smaller label, until nothing changes."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label[:] = label[label]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket in, star links out. Holds one Arrow batch and the bucket that it cuts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        n = len(prints)
        new = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        edges = np.concatenate([new, [n]])
        end = edges[np.searchsorted(edges, np.arange(n), side="right")]
        label = np.arange(n)
        for i, j in near(prints.view(np.uint64), end, radius):
            _unite(label, i, j)
        linked = np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[label[linked]])], schema=schema)

    rest_k, rest_p = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        prints = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
        if rest_k is not None:
            keys, prints = np.concatenate([rest_k, keys]), np.concatenate([rest_p, prints])
        cut = int(np.flatnonzero(np.any(keys != keys[-1], axis=1))[-1]) + 1 if np.any(keys != keys[-1]) else 0
        rest_k, rest_p = keys[cut:], prints[cut:]
        if cut:
            yield stars(keys[:cut], prints[:cut])
    if rest_k is not None:
        yield stars(rest_k, rest_p)


def fingerprint_components(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``node, root`` (see :func:`connected_components`) over the distinct values of the column ``fp`` of ``prints``."""
    spark = prints.sparkSession
    edges_at = [64 * i // (radius + 2) for i in range(radius + 3)]
    masks = [((1 << (z - a)) - 1) << a for a, z in zip(edges_at, edges_at[1:], strict=False)]
    signed = [(m - (1 << 64) if m >> 63 else m) for m in (x | y for x, y in combinations(masks, 2))]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(signed)])
    buckets = prints.select("fp").distinct().select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    large = buckets.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("t", "k", F.ceil(F.col("n") / block).cast("int").alias("m"))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    grid = F.when(F.col("m").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    )
    cells = buckets.join(large, ["t", "k"], "left").select("t", "k", F.explode(grid).alias("c"), "fp").select("t", "k", "c.i", "c.j", "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow_rows(spark, 50_000)
    dealt = cells.repartition(n, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp")
    return connected_components(dealt.mapInArrow(partial(_compare, radius=radius), "a long, b long"), "simhash")


def _component_ids(prints: DataFrame, radius: int) -> DataFrame:
    """``fp, component_id`` for every distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = fingerprint_components(prints, radius)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    # written, so that the join shuffles both sides for itself and can split a large component
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return rooted.join(least, "root").select("fp", "component_id", "root")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the component is named by its smallest id.

    Null and word-less texts have fingerprint zero and are linked like any other. Repeated rows each get a row. Null ids
    do not name a component unless it has no other (then null). An empty table gives no rows. Other columns are ignored.
    Texts of any length are read whole, once; from then on only fingerprints are shuffled.
    """
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    prints = written(with_fingerprint(slim, "fp", shingle=shingle).select("doc_id", "fp"), "fingerprints")
    ids = _component_ids(prints, radius)
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id, nulls last; among rows with one id the smallest digest of
    the row. Of identical rows one stays. Null and word-less texts are one group. Extra columns are kept, whatever their
    names; an empty table stays empty. Texts of any length are read whole, and shuffled only with the rows that stay."""
    digest = row_digest(docs)
    light = docs.select(col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), col(text_col).alias("text"))
    prints = written(with_fingerprint(light, "fp", shingle=shingle).select("doc_id", "digest", "fp"), "fingerprints")
    ids = _component_ids(prints, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    by_print = prints.groupBy("fp").agg(first.alias("best"))
    winners = by_print.join(ids, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("__id"), F.col("best.digest").alias("__digest"))
    marked = docs.select(F.struct("*").alias("row"), col(id_col).cast("long").alias("id"), digest.alias("digest"))
    kept = marked.join(winners, marked["id"].eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_semi")
    return kept.dropDuplicates(["id", "digest"]).select("row.*")
