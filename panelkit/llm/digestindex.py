"""Exact duplicates through a persistent index of digests.

The index is a table in a shared folder, bucketed and sorted by the SHA-256 of the text, with one entry for every text
that was ever kept. A batch of new rows goes in like this:

1. digests are computed once and written (40 bytes a row; texts are not shuffled);
2. the batch's rows are counted per digest, combined before the shuffle, and written with the index's buckets;
3. a sort-merge anti-join against the index finds the texts not seen before; neither side moves, since both are bucketed;
4. those are appended as the batch's own partition of the index. Known texts only add a count to a second table of the
   same buckets.

A batch is named. Adding a batch again (a retry after a failure at any point) compares with the other batches only and
replaces the rows it wrote, so nothing is counted or dropped twice. One batch is added at a time. ``compact`` folds all
batches into one sorted file a bucket.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import col, fresh, shared_folder, written

#: Texts whose rows are more than this part of all rows are joined through a broadcast: at most this many texts.
HOT_PARTS = 10_000
_ENTRY = "digest binary, keep_id bigint, keep_row bigint, copies bigint"


def text_digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, digest`` of every row, written once: ``row`` tells equal rows apart."""
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_digest(col(text_col)).alias("digest"))
    return written(slim, "digests")


@dataclass
class DigestIndex:
    """The index at ``path``. ``buckets`` is fixed when the folder is made and stored with it."""

    spark: SparkSession
    path: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
        """Open the index at ``path``, or make an empty one with ``buckets`` (as many as shuffle partitions if not said)."""
        form = f"{path}/buckets"
        try:
            n = spark.read.schema("buckets int").json(form).first()["buckets"]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").json(form)
            made = cls(spark, path, n)
            for kind in ("index", "repeats"):  # an empty batch, so that the folders exist
                made._replace(spark.createDataFrame([], _ENTRY), kind, "none")
        index = cls(spark, path, n)
        index._register()
        return index

    def _table(self, kind: str) -> str:
        return f"panelkit_{kind}_{hashlib.sha1(self.path.encode()).hexdigest()[:16]}"

    def _register(self) -> None:
        """Name the folders as bucketed tables in this session's catalogue; the files are the index, not the names."""
        for kind in ("index", "repeats"):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._table(kind)} ({_ENTRY}, batch string) USING parquet PARTITIONED BY (batch) "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")

    def close(self) -> None:
        """Take the names out of the catalogue. The files stay, and ``open`` names them again."""
        for kind in ("index", "repeats"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(kind)}")

    def _read(self, kind: str) -> DataFrame:
        self.spark.sql(f"MSCK REPAIR TABLE {self._table(kind)}")  # a batch's folder is a partition
        self.spark.catalog.refreshTable(self._table(kind))
        return self.spark.table(self._table(kind))

    def entries(self) -> DataFrame:
        """``digest, keep_id, keep_row, copies, batch``: every kept text, with its rows in the batch that brought it."""
        return self._read("index")

    def _replace(self, rows: DataFrame, kind: str, batch: str) -> None:
        """Write a batch's folder of a table, bucketed like the table; what an earlier try left there goes."""
        self._bucketed(rows.select("digest", "keep_id", "keep_row", "copies"), f"{self.path}/{kind}/batch={batch}", keep_name=False)

    def _bucketed(self, rows: DataFrame, folder: str, keep_name: bool) -> str:
        name = f"{self._table('batch')}_{uuid.uuid4().hex[:8]}"
        rows.write.mode("overwrite").bucketBy(self.buckets, "digest").sortBy("digest").option("path", folder).saveAsTable(name)
        if not keep_name:
            self.spark.sql(f"DROP TABLE {name}")
        return name

    def add(self, rows: DataFrame, batch: str) -> None:
        """Deduplicate ``rows`` (of :func:`digests`) as the batch ``batch`` (letters, digits, ``_.-``) and append what is
        new.

        Of equal texts inside the batch the row with the largest ``doc_id`` is kept (one of them if several rows have
        that id; null ids only where no other is there). Texts that an earlier batch holds keep that batch's row.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"a batch's name has letters, digits and _.- only: {batch!r}")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"), F.count(F.lit(1)).alias("copies"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            groups = groups.repartition(self.buckets, "digest")
        name = self._bucketed(groups, f"{self.path}/batches/{batch}", keep_name=True)
        new = self.spark.table(name)
        others = self.entries().where(F.col("batch") != batch).select("digest").hint("merge")
        self._replace(new.join(others, "digest", "left_anti"), "index", batch)
        others = self.entries().where(F.col("batch") != batch).select("digest").hint("merge")
        self._replace(new.join(others, "digest", "left_semi"), "repeats", batch)
        self.spark.sql(f"DROP TABLE {name}")

    def groups(self) -> DataFrame:
        """``digest, keep_id, keep_row, group_size`` of every text over all batches, without a shuffle."""
        more = self._read("repeats").groupBy("digest").agg(F.sum("copies").alias("more"))
        joined = self.entries().join(more.hint("merge"), "digest", "left")
        return joined.select("digest", "keep_id", "keep_row", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def resolve(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``keep_id, keep_row, group_size`` of their texts. Texts with more than 1 in ``HOT_PARTS`` of the
        index's rows are at most ``HOT_PARTS``: they are broadcast. All others are joined by digest."""
        found = written(self.groups(), "digest-groups")
        limit = (found.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]) / HOT_PARTS
        hot, rest = found.where(F.col("group_size") > limit), found.where(F.col("group_size") <= limit)
        one = rows.join(F.broadcast(hot), "digest")
        two = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.hint("merge"), "digest")
        return one.unionByName(two)

    def compact(self) -> DigestIndex:
        """An index at a new folder beside this one with all batches as one: a single sorted file a bucket, counts
        folded in. Readers of this index are not disturbed; the caller goes on with the new one."""
        out = DigestIndex.open(self.spark, f"{self.path}-{uuid.uuid4().hex[:8]}", self.buckets)
        whole = self.groups().select("digest", "keep_id", "keep_row", F.col("group_size").alias("copies"))
        out._replace(whole.repartition(self.buckets, "digest"), "index", "compacted")
        return out


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no earlier batch of the index holds, one a text (the largest id); the index then
    holds them too. Columns and order of columns are those of ``docs``; an empty table adds nothing. Texts are not
    normalised, null counts as empty, texts of any length are read whole."""
    row = fresh(docs, "row")
    tagged = written(docs.withColumn(row, F.monotonically_increasing_id()), "batch-rows")
    rows = written(tagged.select(col(id_col).cast("long").alias("doc_id"), F.col(row).alias("row"), text_digest(col(text_col)).alias("digest")), "digests")
    index.add(rows, batch)
    mine = index.entries().where(F.col("batch") == batch).select(F.col("keep_row").alias(row))
    return tagged.join(mine, row, "left_semi").drop(row)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, dropped ones too.

    Texts are equal when identical; null is the empty text. The row with the largest id stays; of several rows with that
    id and text exactly one stays, and rows without an id only where the group has no id at all (``keep_id`` null).
    Repeated rows count as often as they occur. Very long texts are hashed whole, row by row, and never shuffled. An
    empty table gives no rows. Other columns are ignored, whatever their names.

    The rows go through a new index in two batches, the upper half of the id range first, so that the later batch finds
    the largest ids already indexed.
    """
    spark = docs.sparkSession
    rows = digests(docs, id_col, text_col)
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    index = DigestIndex.open(spark, shared_folder(spark, "digest-index"))
    middle = None if ends["a"] is None else (ends["a"] + ends["b"]) // 2
    upper = F.coalesce(F.col("doc_id") > F.lit(middle).cast("long"), F.lit(False))
    index.add(rows.where(upper), "upper")
    index.add(rows.where(~upper), "lower")
    out = index.resolve(rows).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    index.close()
    return out


#: The same rows by one window a text.
SQL = """
SELECT doc_id,
       max(doc_id) OVER t AS keep_id,
       count(*) OVER t AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW t AS (PARTITION BY coalesce(text, ''))
"""
