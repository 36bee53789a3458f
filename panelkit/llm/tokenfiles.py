"""Token ids in Arrow files of equal-length sequences.

One Spark task writes one shard: an Arrow IPC file (the stream format framed for random access) whose record batches all
hold ``batch_rows`` rows except the last, with three columns::

    input_ids       fixed_size_list<uint16 or uint32>[seq_len]    16 bits where the vocabulary fits
    attention_mask  fixed_size_list<bool>[seq_len]                true for a token, false for padding
    document_start  fixed_size_list<bool>[seq_len]                true where a document's first token stands

Sequence ``k`` of a shard is row ``k % batch_rows`` of batch ``k // batch_rows``; a memory-mapped reader slices the value
buffers (the masks are bit-packed) without a copy. A shard's documents follow one another without gaps in ascending id order (null ids first), only
the shard's last sequence is padded. Since every document ends with its end id, no document is empty and the start marks
delimit all of them. Ids of the documents stand in the file's schema-side table: a second Arrow file beside it, one row
for each document in the same order.

Shards are cut by ranges of the id. A task writes under a name of its own and reports it in the manifest, which Spark
commits as a table: a lost or repeated attempt leaves an unnamed file and nothing else.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelkit.llm.common import arrow_rows, col, pyfs, shared_folder, tokenizer_path
from panelkit.llm.encode import encoder, with_end

SEQ_LEN = 1024
BATCH_ROWS = 256
END_ID = 2

_MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("tokens_file", T.StringType()),
    T.StructField("documents_file", T.StringType()),
    T.StructField("n_documents", T.LongType()),
    T.StructField("n_sequences", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
])


def sequence_schema(seq_len: int, id_type: pa.DataType) -> pa.Schema:
    kinds = {"input_ids": id_type, "attention_mask": pa.bool_(), "document_start": pa.bool_()}
    return pa.schema([(name, pa.list_(pa.field("item", kind, False), seq_len)) for name, kind in kinds.items()])


class _ShardWriter:
    """Fills one shard file; holds at most one batch of sequences and one document."""

    def __init__(self, sink, seq_len: int, batch_rows: int, largest_id: int):
        narrow = largest_id < 1 << 16
        self.kind = "<u2" if narrow else "<u4"
        self.schema = sequence_schema(seq_len, pa.uint16() if narrow else pa.uint32())
        self.file = pa.ipc.new_file(sink, self.schema)
        self.seq_len, self.room = seq_len, seq_len * batch_rows
        self.ids = np.zeros(self.room, self.kind)
        self.starts = np.zeros(self.room, bool)
        self.used = self.tokens = self.rows = 0

    def add(self, ids: np.ndarray) -> None:
        at, first = 0, True
        while at < len(ids):
            n = min(len(ids) - at, self.room - self.used)
            self.ids[self.used : self.used + n] = ids[at : at + n]
            if first:
                self.starts[self.used], first = True, False
            at, self.used = at + n, self.used + n
            if self.used == self.room:
                self._flush()
        self.tokens += len(ids)

    def _flush(self) -> None:
        rows = -(-self.used // self.seq_len)
        n = rows * self.seq_len
        mask = np.arange(n) < self.used
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(v, f.type.value_type), type=f.type) for v, f in zip((self.ids[:n], mask, self.starts[:n]), self.schema, strict=True)]
        self.file.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.rows += rows
        self.ids, self.starts, self.used = np.zeros(self.room, self.kind), np.zeros(self.room, bool), 0

    def close(self) -> None:
        if self.used:
            self._flush()
        self.file.close()


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, seq_len: int, batch_rows: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    fs, base = pyfs(folder)
    names = [f"{kind}-{shard:06d}-{uuid.uuid4().hex[:8]}.arrow" for kind in ("tokens", "documents")]
    enc = encoder(path)
    largest = max(end_id, *enc.tok.get_vocab(with_added_tokens=True).values())
    docs_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    writer = docs = None
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if writer is None:
            fs.create_dir(base, recursive=True)
            sinks = [fs.open_output_stream(f"{base}/{n}") for n in names]
            writer, docs = _ShardWriter(sinks[0], seq_len, batch_rows, largest), pa.ipc.new_file(sinks[1], docs_schema)
        sizes = []
        for ids, each in enc.lots(batch.column(1)):
            ended, stops = with_end(ids, each, end_id)
            for n, z in zip((each + 1).tolist(), stops.tolist(), strict=True):
                writer.add(ended[z - n : z])
                sizes.append(n)
        docs.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], schema=docs_schema))
        count += batch.num_rows
    if writer is not None:
        writer.close()
        docs.close()
        for s in sinks:
            s.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "tokens_file": [names[0]], "documents_file": [names[1]], "n_documents": pa.array([count], pa.int64()), "n_sequences": pa.array([writer.rows], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS, shards: int | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write shards in ascending id order under ``folder``, which all
    executors and readers share. Returns the manifest, one row a shard, which is also stored in the folder.

    Null texts are empty (only the end id). Rows with one id are ordered by a digest of their text, equal rows are
    kept and written as often as they occur. Null ids come first. An empty table gives an empty manifest. Other columns
    are ignored. The text is shuffled once, before it is encoded; memory holds one Arrow batch of texts and one batch
    of sequences.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    job = partial(_write_shard, folder=folder, path=tokenizer_path(tokenizer), end_id=end_id, seq_len=seq_len, batch_rows=batch_rows)
    ordered.mapInArrow(job, _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class TokenFile:
    """Random access to a shard: sequences and masks as views of the mapped file where the store is local."""

    def __init__(self, folder: str, name: str):
        fs, base = pyfs(folder)
        local = type(fs).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(f"{base}/{name}") if local else fs.open_input_file(f"{base}/{name}")
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.batch_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def values(self, batch: int, name: str) -> pa.Array:
        """All values of a batch's column, flat, without a copy."""
        return self.file.get_batch(batch).column(name).flatten()

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``: a view and a slice of the file's buffers."""
        at = (k % self.batch_rows) * self.seq_len
        ids, mask = (self.values(k // self.batch_rows, c).slice(at, self.seq_len) for c in ("input_ids", "attention_mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of each document as unsigned 32-bit, end id included, in file order; holds a document and a batch."""
        held: list[np.ndarray] = []
        for b in range(self.file.num_record_batches):
            n = self.values(b, "attention_mask").true_count
            ids = self.values(b, "input_ids").to_numpy(zero_copy_only=True)[:n]
            cuts = np.flatnonzero(self.values(b, "document_start").to_numpy(zero_copy_only=False)[:n])
            edges = [0, *cuts.tolist(), n]
            for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                if i and held:
                    yield np.concatenate(held)
                    held = []
                if z > a:
                    held.append(ids[a:z].astype("<u4"))
        if held:
            yield np.concatenate(held)


def _read_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = pyfs(folder)
    for batch in batches:
        for row in batch.to_pylist():
            start = row["start"]
            ids = pa.ipc.open_file(fs.open_input_file(f"{base}/{row['documents_file']}"))
            found = TokenFile(folder, row["tokens_file"]).documents()
            for b in range(ids.num_record_batches):
                part = ids.get_batch(b)
                starts, sizes, crcs = [], [], []
                for _ in range(part.num_rows):
                    doc = next(found)
                    starts.append(start)
                    sizes.append(len(doc))
                    crcs.append(zlib.crc32(doc))
                    start += len(doc)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * part.num_rows, pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the files hold them: id, tokens of all documents before it, its length and the checksum of its ids.
    A window over the manifest (one row a shard) gives each shard's first position; every shard is read by one task."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = read_manifest(spark, folder).withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").mapInArrow(partial(_read_shards, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_file_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` to a new shared folder and return what is read back from them."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer)
    return read_documents(docs.sparkSession, folder)
