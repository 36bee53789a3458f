"""Token files and counts against brute force."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from panelkit.llm import tokencount, tokenfiles
from panelkit.llm.common import shared_folder, tokenizer, tokenizer_path
from panelkit.llm.queries import QUERIES

ROWS = [(5, "Beta gamma. Delta"), (1, None), (3, ""), (None, "no id here"), (5, "Beta gamma. Delta"), (2, "long word " * 3000), (9, "<|endoftext|> x"), (5, "another text")]


def brute(rows):
    tok = tokenizer(tokenizer_path("word_bpe_49k.json"))
    return {(i, t): np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}


def check(got, rows):
    ids = brute(rows)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert len(got) == len(rows)
    start = 0
    for s, _, n, _ in got:  # gapless
        assert s == start
        start += n
    order = [g[1] for g in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    want = sorted(((i if i is not None else -1), len(ids[i, t]), zlib.crc32(ids[i, t].tobytes())) for i, t in rows)
    assert sorted((d if d is not None else -1, n, c) for _, d, n, c in got) == want


def test_token_files_round_trip(spark, docs):
    df = docs(ROWS).withColumn("start", F.lit("clash")).withColumn("shard", F.lit(1.5))
    check(tokenfiles.token_file_digest(df, "word_bpe_49k.json").collect(), ROWS)


def test_token_files_sequences_and_masks(spark, docs):
    folder = shared_folder(spark, "test")
    manifest = tokenfiles.write_token_files(docs(ROWS), folder, "word_bpe_49k.json", seq_len=16, batch_rows=4, shards=3).orderBy("shard").collect()
    stream = []
    for m in manifest:
        f = tokenfiles.TokenFile(folder, m.tokens_file)
        seqs = [f.sequence(k) for k in range(m.n_sequences)]
        assert all(len(i) == 16 for i, _ in seqs)
        assert sum(k.true_count for _, k in seqs) == m.n_tokens
        assert all(k.true_count == 16 for _, k in seqs[:-1])
        assert not seqs[0][0].flags.owndata  # a view of the mapped file
        stream += [x for i, k in seqs for x in i[np.array(k.to_pylist())].tolist()]
        assert {f.file.get_batch(b).num_rows for b in range(f.file.num_record_batches - 1)} <= {4}
    ids = brute(ROWS)
    assert sorted(stream) == sorted(x for i, t in ROWS for x in ids[i, t].tolist())
    check(tokenfiles.read_documents(spark, folder).collect(), ROWS)


def test_token_files_empty(spark, docs):
    assert tokenfiles.token_file_digest(docs([]), "word_bpe_49k.json").count() == 0


def test_token_file_query_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op1_token_files"](spark, d).collect(), rows)


def test_token_counts(spark, docs):
    rows = ROWS + [(7, "x " * 600)]
    got = sorted(map(tuple, tokencount.token_counts(docs(rows).withColumn("n_tokens", F.lit("clash")), "byte_bpe_50k.json").collect()), key=str)
    tok = tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got == sorted(want, key=str)
    assert tokencount.token_counts(docs([]), "byte_bpe_50k.json").count() == 0


def test_token_count_query_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    tok = tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op9_token_counts"](spark, d).collect()} == want


def test_many_special_strings_take_linear_time():
    import time

    from panelkit.llm.common import tokenizer_path
    from panelkit.llm.encode import UnitEncoder
    from panelkit.llm.tokencount import TokenCounter

    path = tokenizer_path("byte_bpe_50k.json")
    counter, special = TokenCounter(path, set()), UnitEncoder(path).specials[0]
    text = f"word {special} of, {special}{special}x"
    assert counter.count(text) == len(UnitEncoder(path).tok.encode(text, add_special_tokens=False).ids)
    start = time.perf_counter()
    counter.count(f"{special} a" * 100_000)
    assert time.perf_counter() - start < 10
