"""Exact duplicates against brute force, and the index over several batches."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelkit.llm.digestindex import DigestIndex, deduplicated, digests, exact_duplicates
from panelkit.llm.queries import QUERIES


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row; one row of equal (id, text) rows is kept."""
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[text or ""].append((doc is not None, doc or 0, i))
    out = [None] * len(rows)
    for text, members in groups.items():
        best = max(members)
        for has, doc, i in members:
            keep = best[1] if best[0] else None
            out[i] = (doc if has else None, keep, len(members), i == best[2], hashlib.sha256(text.encode()).hexdigest())
    return sorted(out, key=str)


def run(frame):
    return sorted((tuple(r) for r in exact_duplicates(frame).collect()), key=str)


def test_groups(docs):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, "b"), (9, "c "), (8, "c"), (7, None), (4, ""), (6, "A"), (10, "a\n")]
    assert run(docs(rows)) == brute(rows)


def test_ties_nulls_and_repeated_rows(docs):
    rows = [(1, "x")] * 5 + [(None, "x"), (None, "y"), (None, "y"), (2, None), (2, None), (-3, "x"), (0, "z")]
    assert run(docs(rows)) == brute(rows)


def test_empty_table(docs):
    assert run(docs([], parts=1)) == []


def test_long_texts_and_extra_columns(spark):
    text = "word " * 800_000  # 4 MB
    rows = [(1, text), (2, text + "x"), (3, text)]
    frame = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, digest string, row int")
    assert run(frame) == brute(rows)


def test_one_text_holds_a_third(docs):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(3000)]
    assert run(docs(rows, parts=7)) == brute(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 20)), st.one_of(st.none(), st.sampled_from(["", "a", "b", "é", "é"]))), min_size=1, max_size=25))
def test_random_rows(docs, rows):
    assert run(docs(rows, parts=2)) == brute(rows)


def test_batches(spark, docs, tmp_path):
    index = DigestIndex.open(spark, f"{tmp_path}/index", buckets=4)
    one = deduplicated(docs([(1, "a"), (2, "a"), (3, "b")]), index, "one")
    assert sorted(r.doc_id for r in one.collect()) == [2, 3]
    assert one.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    two = deduplicated(docs([(9, "a"), (10, "c"), (11, "c"), (12, "b")]), index, "two")
    assert sorted(r.doc_id for r in two.collect()) == [11]
    assert sorted((r.keep_id, r.group_size) for r in index.groups().collect()) == [(2, 3), (3, 2), (11, 2)]


def test_a_retried_batch_counts_once(spark, docs, tmp_path):
    index = DigestIndex.open(spark, f"{tmp_path}/index", buckets=3)
    index.add(digests(docs([(1, "a"), (2, "b")])), "one")
    rows = digests(docs([(3, "b"), (4, "c"), (5, "c")]))
    for _ in range(2):
        index.add(rows, "two")
    assert sorted((r.keep_id, r.group_size) for r in index.groups().collect()) == [(1, 1), (2, 2), (5, 2)]


def test_a_failure_between_the_two_writes(spark, docs, tmp_path, monkeypatch):
    index = DigestIndex.open(spark, f"{tmp_path}/index", buckets=3)
    index.add(digests(docs([(1, "a")])), "one")
    write = DigestIndex._replace

    def fails(self, rows, kind, batch):
        if kind == "repeats":
            raise OSError("lost")
        write(self, rows, kind, batch)

    rows = digests(docs([(2, "a"), (3, "b")]))
    monkeypatch.setattr(DigestIndex, "_replace", fails)
    with pytest.raises(OSError):
        index.add(rows, "two")
    monkeypatch.setattr(DigestIndex, "_replace", write)
    index.add(rows, "two")
    assert sorted((r.keep_id, r.group_size) for r in index.groups().collect()) == [(1, 2), (3, 1)]


def test_opened_again_and_compacted(spark, docs, tmp_path):
    index = DigestIndex.open(spark, f"{tmp_path}/index", buckets=5)
    index.add(digests(docs([(1, "a"), (2, "b")])), "one")
    index.add(digests(docs([(3, "a"), (4, "c")])), "two")
    index.close()
    again = DigestIndex.open(spark, f"{tmp_path}/index")
    assert again.buckets == 5
    packed = again.compact()
    want = [(1, 2), (2, 1), (4, 1)]
    for held in (again, packed):
        assert sorted((r.keep_id, r.group_size) for r in held.groups().collect()) == want
    packed.add(digests(docs([(7, "c"), (8, "d")])), "three")
    assert sorted((r.keep_id, r.group_size) for r in packed.groups().collect()) == [(1, 2), (2, 1), (4, 2), (8, 1)]


def test_the_anti_join_is_by_bucket(spark, docs, tmp_path, capsys):
    """Neither the index nor the batch moves: no exchange between the scans and the sort-merge join."""
    index = DigestIndex.open(spark, f"{tmp_path}/index", buckets=8)
    index.add(digests(docs([(1, "a")])), "one")
    index.groups().explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_bad_batch_name(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        DigestIndex.open(spark, f"{tmp_path}/index", buckets=2).add(digests(docs([(1, "a")])), "a/b")


def test_registered_query(spark, docs, table_dir):
    rows = [(i, f"t{i % 7}") for i in range(50)]
    d = table_dir(documents=docs(rows))
    assert sorted((tuple(r) for r in QUERIES["op11_exact_dedup"](spark, d).collect()), key=str) == brute(rows)
