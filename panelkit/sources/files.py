"""Sources and sinks (S1–S14): period discovery, tolerant JSON lines, dt-partitioned snapshots, event appends,
CSV exports, lookup persistence, a content-hash-checked baseline registry and run artefacts.

Paths go through Hadoop's FileSystem API (via the session), so the same code lists local folders, HDFS or object
stores. Nothing here reads data on the driver except tiny pointer / manifest documents.
"""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a period table is named, and the loose form.
PERIOD_PREFIX = "PEDE"
PERIOD_YEAR = r"(\d{4})"
PERIOD_LOOSE = r"(20\d{2})"


# ------------------------------------------------------------------------------------------- filesystem helpers
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(name, full path) of the sub-folders of ``root``."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()]


def read_small_text(spark: SparkSession, path: str) -> str | None:
    """Read a small document (pointer / manifest) through the cluster filesystem."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.option("wholetext", "true").text(path).collect()
    return rows[0][0] if rows else None


# ------------------------------------------------------------------------------------------- S1 / S2 / U1
def discover_periods(spark: SparkSession, root: str, loose: bool = False, minimum: int = 3,
                     prefix: str = PERIOD_PREFIX) -> list[tuple[int, str]]:
    """Period folders under ``root`` named ``prefix`` + year (any case; loose=True accepts any name holding 20##),
    sorted by period. Fewer than ``minimum`` → ValueError."""
    found = {}
    strict = re.compile(re.escape(prefix) + PERIOD_YEAR, re.IGNORECASE)
    for name, full in list_dirs(spark, root):
        m = re.search(PERIOD_LOOSE, name) if loose else strict.fullmatch(name.strip())
        if m:
            found[int(m.group(1))] = full
    if len(found) < minimum:
        raise ValueError(f"at least {minimum} period folders are needed, found {len(found)}")
    return sorted(found.items())


def load_periods(spark: SparkSession, root: str, conform=None, fmt: str = "parquet", period_col: str = "ano_base",
                 **kw) -> DataFrame:
    """S2 + U1: read every period folder, tag its period, conform it (``conform(df, period)``) and stack them by
    column name (a column absent in one period becomes null)."""
    frames = []
    for period, path in discover_periods(spark, root, **kw):
        df = spark.read.format(fmt).option("header", "true").load(path)
        df = df.withColumn(period_col, F.lit(period).cast("int"))
        frames.append(conform(df, period) if conform else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ------------------------------------------------------------------------------------------- S5 / S11
def parse_json_objects(lines: DataFrame, schema: T.StructType, col: str = "value") -> DataFrame:
    """S5 core: keep only lines that parse as a JSON *object* (blank, malformed and non-object lines are dropped)
    and project them onto ``schema``. Runs per row on executors (variant parsing, no Python)."""
    v = F.try_parse_json(F.col(col))
    is_obj = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    kept = lines.filter(F.trim(F.col(col)) != "").filter(is_obj)
    return kept.select(F.from_json(F.col(col), schema).alias("_j")).select("_j.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant JSON-lines read; a missing path gives an empty frame with the schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return parse_json_objects(spark.read.text(path), schema)


def tail_lines(lines: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """The last n lines, newest first (files carry no line order in Spark, so an explicit order is
    required); a top-n sort (TakeOrderedAndProject), not a full sort."""
    return lines.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


# ------------------------------------------------------------------------------------------- S6 / S7 / S8
def read_snapshots(spark: SparkSession, base: str, schema: T.StructType, now: str, days: int) -> DataFrame:
    """Scan a dt=YYYY-MM-DD partitioned JSON snapshot folder keeping partitions dt ≥ now − (days − 1).

    Only the names of the partition folders are listed; of these the wanted days alone are given to the reader, so
    older days and folders whose name is no date are never opened. score / timestamp are coerced tolerantly."""
    first = date.fromisoformat(now[:10]) - timedelta(days=days - 1)
    wanted = [(day, path) for name, path in list_dirs(spark, base) if (day := partition_day(name)) and day >= first]
    if not wanted:
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("dt", T.DateType())]))
    df = spark.read.schema(schema).option("basePath", base).json([path for _, path in sorted(wanted)])
    out = df.withColumn("dt", F.try_to_timestamp(F.col("dt").cast("string"), F.lit("yyyy-MM-dd")).cast("date"))
    if "score" in out.columns:
        out = out.withColumn("score", F.col("score").cast("string").try_cast("double"))
    if "timestamp_utc" in out.columns:
        out = out.withColumn("timestamp_utc", tolerant_timestamp(F.col("timestamp_utc").cast("string")))
    return out


def partition_day(name: str) -> date | None:
    """The day of a ``dt=YYYY-MM-DD`` folder name; None for any other name."""
    key, _, value = name.partition("=")
    try:
        return date.fromisoformat(value) if key == "dt" and len(value) == 10 else None
    except ValueError:
        return None


def tolerant_timestamp(c: Column) -> Column:
    """ISO-8601 text (a trailing 'Z' accepted) → timestamp; unparseable → null."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def write_snapshots(scored: DataFrame, base: str, request_id: str, meta: dict, now: datetime | None = None) -> None:
    """Append scored rows with the metadata columns under dt=<UTC date of now>. Rows keep their own score (the
    caller passes input and score joined on a key, never concatenated by position)."""
    ts = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    cols = {
        "timestamp_utc": F.lit(ts.isoformat()),
        "dt": F.lit(ts.strftime("%Y-%m-%d")),
        "request_id": F.lit(request_id),
        **{k: F.lit(v) for k, v in meta.items()},
    }
    scored.withColumns(cols).write.mode("append").partitionBy("dt").json(base)


def append_event(spark: SparkSession, path: str, event_type: str, data: dict, now: datetime | None = None) -> dict:
    """Append one event document (timestamp_utc and event_type first) to a JSON-lines folder."""
    payload = {"timestamp_utc": (now or datetime.now(timezone.utc)).isoformat(), "event_type": event_type, **data}
    spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "value string").coalesce(1) \
        .write.mode("append").text(path)
    return payload


# ------------------------------------------------------------------------------------------- S9 / S10 / S14
def export_csv(df: DataFrame, path: str, front: list[str]) -> None:
    """Key columns first, the rest after, header row."""
    first = [c for c in front if c in df.columns]
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode("overwrite").option(
        "header", "true").csv(path)


def save_lookup(lookup, path: str) -> None:
    """The three statistic tables as parquet folders and the fitted scalars as one JSON document."""
    for name, tbl in lookup.tables.items():
        tbl.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(lookup.tables.values())).sparkSession
    meta = {"keys": lookup.keys, "all_null_cols": lookup.all_null_cols, "medians": lookup.medians}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/_meta")


def load_lookup(spark: SparkSession, path: str):
    from panelkit.operators.features import LEVELS, Lookup

    meta = json.loads(read_small_text(spark, f"{path}/_meta"))
    tables = {lvl: spark.read.parquet(f"{path}/{lvl}") for lvl in LEVELS}
    return Lookup(tables=tables, keys=meta["keys"], all_null_cols=meta["all_null_cols"], medians=meta["medians"])


def save_document(spark: SparkSession, doc: dict, path: str) -> None:
    """One JSON document per run (metrics, model metadata, cohort summary)."""
    spark.createDataFrame([(json.dumps(doc, ensure_ascii=False, default=str),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def load_document(spark: SparkSession, path: str):
    text = read_small_text(spark, path)
    return json.loads(text) if text else None


# ------------------------------------------------------------------------------------------- S12 / S13
def baseline_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per baseline folder: id (folder name), n, created_at (first 19 characters)."""
    found = [path for _, folder in list_dirs(spark, root)
             if path_exists(spark, path := f"{folder}/baseline_manifest.json")]
    if not found:
        return spark.createDataFrame([], "baseline_id string, n_rows bigint, created_at string, sha256 string")
    schema = "n_rows bigint, created_at string, baseline_file_sha256 string"
    df = spark.read.schema(schema).option("multiLine", "true").json(found)
    bid = F.regexp_extract(F.input_file_name(), r"/([^/]+)/baseline_manifest\.json$", 1)
    return df.select(bid.alias("baseline_id"), "n_rows", F.substring("created_at", 1, 19).alias("created_at"),
                     F.col("baseline_file_sha256").alias("sha256"))


def file_hashes(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of a file, or of every part file of a folder, by file name; each is read by a task of its own (a part
    file is bounded by the writer's file size)."""
    rows = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()
    return {r.name: r.sha for r in rows if not r.name.startswith(("_", "."))}


def load_baseline(spark: SparkSession, root: str, pointer: str, fallback: str | None = None):
    """Follow the pointer document to a baseline folder; accept its CSV only when its content hashes equal the
    manifest's: ``baseline_file_sha256`` for a single file, ``baseline_part_sha256`` (name → hash) for a folder of
    part files. Otherwise fall back to ``fallback`` (id 'legacy_valid_scored'). Returns (id, DataFrame) or
    (None, None)."""
    ptr = load_document(spark, pointer) if path_exists(spark, pointer) else None
    bid = str((ptr or {}).get("baseline_id", "")).strip()
    if bid:
        folder = f"{root}/{bid}"
        manifest = (load_document(spark, f"{folder}/baseline_manifest.json")
                    if path_exists(spark, f"{folder}/baseline_manifest.json") else None) or {}
        csv = f"{folder}/baseline.csv"
        parts, single = manifest.get("baseline_part_sha256"), str(manifest.get("baseline_file_sha256", "")).strip()
        if (parts or single) and path_exists(spark, csv):
            actual = file_hashes(spark, csv)
            if actual == parts if parts else list(actual.values()) == [single]:
                return bid, spark.read.option("header", "true").option("inferSchema", "true").csv(csv)
    if fallback and path_exists(spark, fallback):
        return "legacy_valid_scored", spark.read.option("header", "true").option("inferSchema", "true").csv(fallback)
    return None, None
