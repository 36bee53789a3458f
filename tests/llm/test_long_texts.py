"""Texts of some megabytes through the operators that read them row by row."""

import pytest

from panelkit.llm import langid, mixing, packing, quality, simhash, tokencount

LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 32_000  # 2 MB
ROWS = [(1, LONG, "en", "s"), (2, LONG + "x", "en", "s"), (3, "x" * 1_000_000, "en", "s"), (4, "Short text here.", "en", "t"), (5, "", "en", "t")]


@pytest.fixture()
def table(docs):
    return docs(ROWS, parts=2)


def test_quality(table):
    got = {r.doc_id: r for r in quality.quality_figures(table).collect()}
    assert got[1].n_words == 13 * 32_000 and got[1].base_failed and got[3].n_words == 1


def test_simhash(table):
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(table).collect()}
    assert got[1] == got[2] == 1


def test_mixture(table):
    got = {r.doc_id: r.size for r in mixing.mixture(table).collect()}
    assert got == {1: 416_000, 2: 416_001, 3: 1, 4: 3, 5: 0}


def test_packing_and_counts_agree(table):
    pieces = {}
    for r in packing.pack(table, "byte_bpe_50k.json").collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    counts = {r.doc_id: r.n_tokens + 1 for r in tokencount.token_counts(table, "byte_bpe_50k.json").collect()}
    assert pieces == counts and all(n > 0 for n in pieces.values())


def test_language(table):
    got = {r.doc_id: r.lang_pred for r in langid.languages(table).collect()}
    assert got[1] == got[2] == "en" and got[5] == "und"
