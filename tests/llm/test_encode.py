"""Units against whole texts encoded by the library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import encode
from panelkit.llm.common import tokenizer_path
from panelkit.llm.encode import UnitEncoder, encoder
from panelkit.llm.tokencount import TokenCounter, whole_tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", " ", "  ", "\n", "a\n\nb", "a \n b", "a\t b", "a  b", "it's I'LL we 've", "x\x00y \0 z", "a  b c \x1c d", "<|endoftext|>",
    "a <|endoftext|> b\n <|endoftext|>\n\n<|endoftext|>", "<|startoftext|>A", "İstanbul ẞ ΣΣ", "é café ﬁ", "日本語 テキスト १२३", "a,b.c!? 12 1234", "word\x85next ᠎ z", "🙂🙂 🙂", "\r\n\r\n x", "tail ", "tail\n", " ́x",
]


def expected(enc, text):
    return np.asarray(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", NAMES)
def test_units_equal_whole_texts(name):
    enc = UnitEncoder(tokenizer_path(name), memo=50)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(ODD + ["the", " of", "Xy", ".", "\n"]) for _ in range(12)) for _ in range(300)]
    assert [bytes(x) for x in enc.batch(texts)] == [expected(enc, t) for t in texts]
    assert list(enc.batch([None])) == [b""]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(name, text):
    enc = UnitEncoder(tokenizer_path(name), memo=50)
    assert next(enc.batch([text])) == expected(enc, text)


def test_plain_characters_one_by_one():
    """Every character that the fast path takes, inside and at the edges of words."""
    for name in NAMES:
        enc = UnitEncoder(tokenizer_path(name))
        texts = [f"a{chr(c)} {chr(c)}b x{chr(c)}y {chr(c)}" for c in [*range(1, 0x250), *range(0x2000, 0x2010)]]
        assert [bytes(x) for x in enc.batch(texts)] == [expected(enc, t) for t in texts]


def test_counts_equal_the_library():
    path = tokenizer_path(NAMES[0])
    proven = set(whole_tokens(path))
    assert 40_000 < len(proven) < 50_257
    counter = TokenCounter(path, proven, memo=20)
    for t in ODD + ["the cat sat on the mat " * 50]:
        assert counter.count(t) == len(counter.enc.tok.encode(t, add_special_tokens=False).ids), t
    counter = TokenCounter(path, proven)
    counter.count("the of and")
    assert counter.merges == 0  # proven strings need no merge


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("lot", [encode.LOT_BYTES, 400, 1])
def test_lots_equal_whole_texts(name, lot, monkeypatch):
    monkeypatch.setattr(encode, "LOT_BYTES", lot)
    enc = UnitEncoder(tokenizer_path(name), memo=20)
    rng = random.Random(4)
    texts = [None, *ODD, *("".join(rng.choice([*ODD, "the", " of", "Xy", ".", "\n"]) for _ in range(12)) for _ in range(100)), None]
    got = [x.tobytes() for ids, sizes in enc.lots(pa.array(["cut off", *texts], pa.string()).slice(1)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [expected(enc, t or "") for t in texts]
    assert list(enc.lots(pa.array([], pa.string()))) == []


def test_units_are_merged_once_for_all_tasks_of_a_process(monkeypatch):
    enc = encoder(tokenizer_path(NAMES[1]))
    texts, merged, one = pa.array(["zyxwv qponm zyxwv", "qponm"]), [], enc._one
    monkeypatch.setattr(enc, "_one", lambda unit: merged.append(unit) or one(unit))
    for _ in range(2):
        list(encoder(tokenizer_path(NAMES[1])).lots(texts))
    assert sorted(merged) == ["qponm", "zyxwv"]


def test_words_behind_a_space_are_encoded_once_for_all_lots(monkeypatch):
    enc = UnitEncoder(tokenizer_path(NAMES[0]))
    coded, together = [], enc._together
    monkeypatch.setattr(enc, "_together", lambda units: coded.extend(units) or together(units))
    for _ in range(2):
        list(enc.lots(pa.array(["a zyxwv qponm, zyxwv", "b qponm, été"])))
    assert sorted(coded) == [" qponm,", " zyxwv", " été"]
    assert not any(u[:1] == " " for u in enc.memo)


@pytest.mark.parametrize("room", [0, 150, 1 << 20])
def test_remembered_words_are_bounded_and_right(room, monkeypatch):
    monkeypatch.setattr(encode, "KNOWN_BYTES", room)
    monkeypatch.setattr(encode, "TOGETHER", 3)
    monkeypatch.setattr(encode, "MEMO_CHARS", 4)
    enc = UnitEncoder(tokenizer_path(NAMES[0]))
    rng = random.Random(6)
    for _ in range(12):
        texts = [*ODD, *(" ".join(rng.choice(["w%d" % rng.randrange(90), "été", "x,y", "日本", "<|endoftext|>"]) for _ in range(9)) for _ in range(10))]
        got = [x.tobytes() for ids, sizes in enc.lots(pa.array(texts)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [expected(enc, t) for t in texts]
        words = {u for u in " ".join(texts).split(" ")}
        assert sum(k.nbytes for k in enc.known) <= room + 60 * len(words)
    assert all(len(u) <= 4 for u in enc.memo)


def test_units_of_a_word_ending_tokenizer_are_remembered_as_columns(monkeypatch):
    monkeypatch.setattr(encode, "MEMO_PARTS", 40)
    enc = UnitEncoder(tokenizer_path(NAMES[1]))
    words = [f"{a}{b}{end}" for a in ("Zyx", "qpo", "été") for b in "abcdefghij" for end in ("", ".", ",7")]
    texts = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    one, merged = enc._one, []
    monkeypatch.setattr(enc, "_one", lambda unit: merged.append(unit) or one(unit))
    for _ in range(2):
        got = [x.tobytes() for ids, sizes in enc.lots(pa.array(texts)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [expected(enc, t) for t in texts]
    assert sorted(merged) == sorted(words)  # once for both
    assert set(words) == set(enc.known[0].to_pylist())
    assert not {w for w in words if not w.isalpha()} & {*enc.memo, *enc.elder}  # parts of units alone
