"""Helpers shared by the operators: shared-folder tables, collision-free column names, row identity, tokenizers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import ensure_checkpoint_dir

#: A word is a run of characters other than the space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors and
    fixes the rows of anything computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that ``df`` does not have (names compare without case)."""
    have, n, out = {c.lower() for c in df.columns}, 0, f"__{name}"
    while out.lower() in have:
        n, out = n + 1, f"__{name}_{n}"
    return out


#: Bytes after which an Arrow batch ends, whatever its rows; a longer text is a batch of its own.
BATCH_BYTES = 64 << 20


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows an Arrow batch may hold at most, and its bytes: together they bound a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system. A Python worker serves one stage after the other, and what Arrow's and the C
    library's allocators keep from the largest would stay with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def row_digest(df: DataFrame) -> Column:
    """64-bit digest over all columns of a row, taken together with the id as the identity of a row."""
    return F.xxhash64(*[F.to_json(F.struct(col(c))) if t.startswith(("map", "variant")) else col(c) for c, t in df.dtypes])


def pyfs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a shared-folder URI, for code in tasks that writes or reads whole files there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def binary_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file: an existing path as it is, else looked up by name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a JSON file, loaded once in each process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


@contextlib.contextmanager
def held(*frames: DataFrame):
    """Keep frames in memory and on disk for the length of a block."""
    for f in frames:
        f.persist()
    try:
        yield
    finally:
        for f in frames:
            f.unpersist()
