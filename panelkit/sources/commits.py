"""Committed appends (S7, S8, S12): a request's rows are seen whole and once, whatever fails on the way.

Rows are staged by one Spark job under a folder named after the attempt. The request is then published by one small
document, ``_commits/<request>.json``, that is written under another name and renamed to its own; the rename fails where
the document already exists, so of several attempts at one request exactly one is published, and a repeated request
publishes nothing. Readers keep the rows of published attempts: a join of the attempts' names with the documents. What a
failed attempt left behind is never read and :meth:`CommittedTable.vacuum` removes it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.sources.files import _fs, list_dirs, partition_day, path_exists

_COMMIT = "request_id string, attempt string, timestamp_utc string, event string"


def rename(spark: SparkSession, src: str, dst: str, replace: bool) -> bool:
    """Rename a file in one step. Without ``replace`` an existing ``dst`` stays and the answer is False. The filesystem
    must rename atomically, as HDFS does; on a local one a hard link takes the name."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    if not replace and _fs(spark, src)[0].getScheme() == "file":
        local = [fs.Path(p).toUri().getPath() for p in (src, dst)]
        try:
            os.link(*local)
        except FileExistsError:
            return False
        os.unlink(local[0])
        return True
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE if replace else fs.Options.Rename.NONE
    source = fs.Path(src)
    context = fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(source), context.makeQualified(fs.Path(dst)), how)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def write_small(spark: SparkSession, text: str, path: str) -> None:
    """Write a small document through the cluster's filesystem."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def swap_document(spark: SparkSession, doc: dict, path: str) -> None:
    """Replace a pointer document in one step: readers see the old one or the new one."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    write_small(spark, json.dumps(doc, ensure_ascii=False), temporary)
    rename(spark, temporary, path, replace=True)


class CommittedTable:
    """JSON rows under ``base/data/dt=<day>/attempt=<name>`` and the documents that publish attempts."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _document(self, request_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", request_id):
            raise ValueError(f"a request id has letters, digits and _.- only: {request_id!r}")
        return f"{self.base}/_commits/{request_id}.json"

    def stage(self, rows: DataFrame, request_id: str, meta: dict | None = None, now: datetime | None = None) -> str:
        """Write the rows of an attempt, stamped like a snapshot; they are not seen yet. Returns the attempt's name."""
        ts = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
        attempt = f"{request_id}-{uuid.uuid4().hex[:12]}"
        stamp = {"timestamp_utc": F.lit(ts.isoformat()), "request_id": F.lit(request_id), **{k: F.lit(v) for k, v in (meta or {}).items()},
                 "dt": F.lit(ts.strftime("%Y-%m-%d")), "attempt": F.lit(attempt)}
        rows.withColumns(stamp).write.mode("append").partitionBy("dt", "attempt").json(f"{self.base}/data")
        return attempt

    def publish(self, request_id: str, attempt: str, event: dict | None = None, now: datetime | None = None) -> bool:
        """Make an attempt's rows, and its event, seen; False when the request was published before."""
        ts = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
        doc = {"request_id": request_id, "attempt": attempt, "timestamp_utc": ts.isoformat(), "event": json.dumps(event or {}, ensure_ascii=False)}
        temporary = f"{self.base}/_tmp/{attempt}.json"
        write_small(self.spark, json.dumps(doc, ensure_ascii=False), temporary)
        return rename_into(self.spark, temporary, self._document(request_id))

    def append(self, rows: DataFrame, request_id: str, meta: dict | None = None, event: dict | None = None, now: datetime | None = None) -> bool:
        """Stage and publish; nothing is written for a request that is published already."""
        if path_exists(self.spark, self._document(request_id)):
            return False
        return self.publish(request_id, self.stage(rows, request_id, meta, now), event, now)

    def commits(self) -> DataFrame:
        """The published requests, one row each (an event is the ``event`` column)."""
        folder = f"{self.base}/_commits"
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json(f"{folder}/*.json")

    def read(self, schema: T.StructType, now: str | None = None, days: int | None = None) -> DataFrame:
        """Published rows with ``dt`` (a date) and ``attempt``; with ``now`` and ``days`` only the folders of the last
        ``days`` days are opened."""
        full = T.StructType([*schema.fields, T.StructField("dt", T.DateType()), T.StructField("attempt", T.StringType())])
        root = f"{self.base}/data"
        first = date.fromisoformat(now[:10]) - timedelta(days=days - 1) if now and days else date.min
        wanted = sorted(path for name, path in list_dirs(self.spark, root) if (day := partition_day(name)) and day >= first)
        if not wanted:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", root).json(wanted)
        return rows.join(self.commits().select("attempt"), "attempt", "left_semi")

    def vacuum(self, keep_hours: float = 24.0) -> int:
        """Remove the folders of attempts that were not published and are older than ``keep_hours``; returns how many."""
        published = {r.attempt for r in self.commits().select("attempt").collect()}
        oldest = (datetime.now(timezone.utc) - timedelta(hours=keep_hours)).timestamp() * 1000
        gone = 0
        for _, day in list_dirs(self.spark, f"{self.base}/data"):
            for name, path in list_dirs(self.spark, day):
                fs, p = _fs(self.spark, path)
                if name.partition("=")[2] not in published and fs.getFileStatus(p).getModificationTime() <= oldest:
                    fs.delete(p, True)
                    gone += 1
        return gone


def rename_into(spark: SparkSession, src: str, dst: str) -> bool:
    """Rename into a folder that may not exist yet, keeping an existing ``dst``."""
    fs, p = _fs(spark, dst)
    fs.mkdirs(p.getParent())
    return rename(spark, src, dst, replace=False)
