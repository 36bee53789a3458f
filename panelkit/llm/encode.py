"""Whole texts to token ids through the tokenizers library, with a bounded memo of space-delimited units.

Both tokenizer files split text into pre-tokens before merging, so the ids of a text are the ids of its units in
order as long as units are cut where a pre-token always ends:

* word-ending BPE (white space dropped): every space or newline is such a place;
* byte-level BPE: right before a space that a non-space character follows, and around a lone newline. The space belongs
  to the unit after it. Texts that hold one of the tokenizer's special strings are encoded whole instead, since a special string also
  ends the white-space run before it.

Units repeat, so a memo (two halves of ``MEMO_UNITS`` entries; a full younger half replaces the elder) saves most merges. Of a lot
of texts, the distinct units of a word-ending tokenizer, and the distinct byte-level units that are a word behind a space (these
are encoded as one text), are remembered as Arrow columns of ``KNOWN_BYTES``: a tenth of the memory that a memo takes for them. Results are those of encoding each text at once; ``tests/llm/test_encode.py`` holds both against each other.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from panelkit.llm.common import give_back, tokenizer

#: How byte-level tokenizers split text (a fixed value of that format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Units of the memo's younger half; with the elder half at most about 250 MB in a worker.
MEMO_UNITS = 500_000

#: The same for pre-tokens of a word-ending tokenizer's units, of which Arrow columns hold the whole ones.
MEMO_PARTS = 50_000

#: Bytes of texts whose units are looked up together; a longer text is encoded by itself.
LOT_BYTES = 8 << 20

_SPACE_THEN_SPACE = re.compile(r" (?:\s|$)|\n(?:\s|$)|[\t\r\x0b\x0c]")
_CUT = re.compile(r" (?=\S)")
#: The same for Arrow's expressions, whose own classes are ASCII: white space of any kind, as Python knows it.
_WHITE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACED = rf"[ \n](?:[{_WHITE}]|\z)|[\t\r\x0b\x0c]"
_BEFORE_WORD = rf" ([^{_WHITE}])"
_ONE_WORD = rf"\A [^{_WHITE}]+\z"
#: Units that are encoded in one call, and bytes of the units in Arrow columns, with their ids, that an encoder remembers,
#: besides those of a lot. Longer units than ``MEMO_CHARS`` are not remembered in the memo.
TOGETHER, KNOWN_BYTES, MEMO_CHARS = 10_000, 32 << 20, 64
#: Characters whose classes and case no Unicode version changes and that have one normal form.
_PLAIN = re.compile("[\n\x20-\x7e\u00a1-\u012f\u0131-\u024f]*")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1,
    else the next unused code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


def byte_level(text: str) -> str:
    """A pre-token as a byte-level vocabulary spells it."""
    return text.encode().decode("latin-1").translate(BYTE_CHARS)


class UnitEncoder:
    """``batch(texts)`` yields little-endian unsigned 32-bit ids as bytes, for texts of any length."""

    def __init__(self, path: str, memo: int = MEMO_UNITS):
        self.tok = tokenizer(path)
        state = json.loads(self.tok.to_str())
        self.specials = [t["content"] for t in state["added_tokens"]]
        model, norm, pre = state["model"], state["normalizer"], state["pre_tokenizer"] or {}
        self.lowers = model.get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(norm)
        self.keeps_space = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm
        self.pattern = None
        if self.lowers:
            self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        elif self.keeps_space:
            self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.begins = None  # of a byte-level vocabulary: the tokens that begin with a space
        if self.keeps_space and not any(re.search(r"\s", s) for s in self.specials):
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self.begins = np.zeros(max(vocab.values()) + 1, bool)
            self.begins[[i for t, i in vocab.items() if t[:1] == BYTE_CHARS[0x20]]] = True
        self.merge = self.tok.model.tokenize
        self.memo: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.limit = min(memo, MEMO_PARTS) if self.lowers else memo
        self.known = pa.array([], pa.string()), pa.array([], pa.binary())  # units in Arrow columns and their ids

    def units(self, text: str) -> list[str] | None:
        """The units of a text, or None if it must be encoded whole."""
        if self.lowers:
            return text.replace("\n", " ").split(" ")
        if not self.keeps_space or any(s in text for s in self.specials):
            return None
        if _SPACE_THEN_SPACE.search(text) or "\0" in text:
            parts = _CUT.split(text)
            return [parts[0], *(" " + p for p in parts[1:])]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def pretokens(self, unit: str) -> list[str] | None:
        """Pre-tokens of a plain unit; None if only the library may split it."""
        if not _PLAIN.fullmatch(unit) or self.lowers and any(s in unit for s in self.specials):
            return None  # byte-level texts with a special string are never cut into units
        if (unit[1:] if unit[:1] == " " else unit).isalpha():
            return [unit.strip(" ").lower() if self.lowers else unit]
        return self.pattern.findall(unit.lower() if self.lowers else unit)

    def _merged(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()

    def _one(self, unit: str) -> bytes:
        """Ids of a unit that the memo lacks."""
        if self.keeps_space and unit.isascii() and unit[:1] == " " and unit[1:].isalpha():
            return self._merged(BYTE_CHARS[0x20] + unit[1:])  # one pre-token, and the memo's entry is the unit's own
        parts = self.pretokens(unit)
        if parts is None:
            return np.array(self.tok.encode(unit, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.lowers and len(parts) == 1:
            return self._merged(byte_level(parts[0]))  # remembered as a unit
        out = []
        for p in parts:
            got = self.memo.get(p) or self.elder.get(p)
            if got is None:
                got = self._merged(byte_level(p))
                if len(p) <= MEMO_CHARS:
                    self.memo[p] = got
            out.append(got)
        return b"".join(out)

    def _make_room(self) -> None:
        """When the memo's younger half is full it becomes the elder half."""
        if len(self.memo) >= self.limit:
            self.memo, self.elder = {}, self.memo
            give_back()

    def learn(self, units: Iterable[str]) -> list[bytes]:
        """Ids of ``units``, which the memo then holds."""
        self._make_room()
        memo, elder = self.memo, self.elder
        one, out = self._one, []
        for u in units:
            got = memo.get(u)
            if got is None:
                got = elder.get(u)
                got = one(u) if got is None else got
                if len(u) <= MEMO_CHARS:
                    memo[u] = got
            out.append(got)
        return out

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text (None: empty)."""
        for text in texts:
            text = text or ""
            units = self.units(text)
            if units is None:
                yield np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            out = []
            for i in range(0, len(units), self.limit):
                part = units[i : i + self.limit] if len(units) > self.limit else units
                try:
                    out.append(b"".join([self.memo[u] for u in part]))
                except KeyError:
                    distinct = list(set(part))
                    ids = dict(zip(distinct, self.learn(distinct), strict=True))
                    out.append(b"".join([ids[u] for u in part]))
            yield out[0] if len(out) == 1 else b"".join(out)

    def _cut(self, lot: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lists of units of each text, and the places of texts that must be encoded whole (their lists mean nothing)."""
        lot = lot.fill_null("")
        if self.lowers:
            return pc.split_pattern(pc.replace_substring(lot, "\n", " "), " "), np.zeros(0, np.int64)
        whole = pc.match_substring(lot, "\0")
        for s in self.specials:
            whole = pc.or_(whole, pc.match_substring(lot, s))
        marked = pc.replace_substring(pc.replace_substring(lot, " ", "\0 "), "\n", "\0\n\0")
        spaced = pc.match_substring_regex(lot, _SPACED)
        if spaced.true_count:
            marked = pc.replace_with_mask(marked, spaced, pc.replace_substring_regex(lot.filter(spaced), _BEFORE_WORD, "\0 \\1"))
        return pc.split_pattern(marked, "\0"), np.flatnonzero(whole.to_numpy(zero_copy_only=False))

    def _looked_up(self, units: pa.Array) -> pa.Array:
        """Ids of each of these distinct units. Units of a word-ending tokenizer and words behind a space are encoded many at
        once and remembered as Arrow columns."""
        if self.lowers:
            words = pc.less_equal(pc.utf8_length(units), MEMO_CHARS)
        else:
            words = pc.match_substring_regex(units, _ONE_WORD) if self.begins is not None else pa.array(np.zeros(len(units), bool))
        others, found = units.filter(pc.invert(words)).to_pylist(), []
        for i in range(0, len(others), self.limit):
            found += self.learn(others[i : i + self.limit])
        words = words.to_numpy(zero_copy_only=False)
        named = units.filter(pa.array(words))
        at = pc.index_in(named, value_set=self.known[0])
        new = named.filter(at.is_null())
        coded = pa.concat_arrays([self.known[1], *(self._together(new.slice(i, TOGETHER).to_pylist()) for i in range(0, len(new), TOGETHER))])
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(len(self.known[0]), len(coded))
        if self.known[0].nbytes + new.nbytes + coded.nbytes > KNOWN_BYTES:
            coded = coded.take(pa.array(at))
            self.known, at = (named, coded), np.arange(len(named))
        else:
            self.known = pa.concat_arrays([self.known[0], new]), coded
        place = len(coded) + np.cumsum(~words) - 1
        place[words] = at
        return pa.concat_arrays([coded, pa.array(found, pa.binary())]).take(pa.array(place))

    def _together(self, units: list[str]) -> pa.Array:
        """Ids of units of a word-ending tokenizer, or of words behind a space, from one text of them all: of a unit's tokens
        the first alone has the space."""
        if self.lowers:
            self._make_room()
            return pa.array(map(self._one, units), pa.binary())
        ids = np.array(self.tok.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(units):  # a vocabulary without some bytes
            return pa.array([np.array(self.tok.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in units], pa.binary())
        return pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer((4 * np.append(starts, len(ids))).astype(np.int32)), pa.py_buffer(ids)])

    def lots(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts (null: empty), a lot of texts at a time: one text's after the other's, and how many each has.
        A unit that stands often in a lot is looked up once."""
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT_BYTES, "right")))
            lot = texts.slice(at, to - at)
            at = to
            if not (self.lowers or self.keeps_space) or lot.nbytes > 2 * LOT_BYTES:
                yield _joined([np.frombuffer(x, "<u4") for x in self.batch(lot.to_pylist())])
                continue
            yield self._lot(lot)
            give_back()

    def _lot(self, lot: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists, whole = self._cut(lot)
        coded = lists.flatten().dictionary_encode()
        taken = self._looked_up(coded.dictionary).take(coded.indices)
        stops = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1] // 4
        ids = np.frombuffer(taken.buffers()[2], "<u4")[: stops[-1]] if stops[-1] else np.zeros(0, "<u4")
        sizes = np.diff(stops[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]).astype(np.int64)
        if not len(whole):
            return ids, sizes
        each = np.split(ids, np.cumsum(sizes)[:-1])
        for i, x in zip(whole.tolist(), self.batch(lot.take(pa.array(whole)).to_pylist()), strict=True):
            each[i] = np.frombuffer(x, "<u4")
        return _joined(each)


def _joined(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """A lot's ids with the end id after each text's, and where each text then stops."""
    stops = np.cumsum(sizes + 1)
    ended = np.full(int(stops[-1]), end_id, "<u4")
    inside = np.ones(len(ended), bool)
    inside[stops - 1] = False
    ended[inside] = ids
    return ended, stops


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of a tokenizer file, one for all tasks of a process: what a task has merged serves the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
