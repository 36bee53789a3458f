"""Token counts by the whole-token shortcut.

Offline, once for a vocabulary: every vocabulary string that is a single pre-token and that the merges rebuild as one
token is proven whole. Counting then splits a text into pre-tokens, counts each proven one as 1 without merging, and
runs the merges only for the rest. Units and unproven pre-tokens are remembered in a bounded memo.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import arrow_rows, col, tokenizer, tokenizer_path
from panelkit.llm.encode import BYTE_CHARS, UnitEncoder, byte_level


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings proven to be one pre-token and one token, as text. Bounded by the vocabulary."""
    tok, split = tokenizer(path), UnitEncoder(path)
    bytes_of = {c: b for b, c in BYTE_CHARS.items()}
    out = {}
    for spelled, ident in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(bytes_of[c] for c in spelled).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token by itself
        if [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(text)] != [spelled] or split.pretokens(text) not in (None, [text]):
            continue
        if [t.id for t in split.merge(spelled)] == [ident]:
            out[text] = ident
    return out


class TokenCounter:
    """``count(text)`` for a byte-level tokenizer file, given its proven vocabulary."""

    def __init__(self, path: str, proven: set[str], memo: int = 500_000):
        self.enc = UnitEncoder(path)
        self.proven, self.limit = proven, memo
        self.memo: dict[str, int] = {}
        self.elder: dict[str, int] = {}
        self.merges = 0
        #: The leftmost special string, the longest of those that start there.
        self.special = re.compile("|".join(map(re.escape, sorted(self.enc.specials, key=len, reverse=True))))

    def _merged(self, pretoken: str) -> int:
        self.merges += 1
        return len(self.enc.merge(byte_level(pretoken)))

    def _unit(self, unit: str) -> int:
        parts = self.enc.pretokens(unit)
        if parts is None:
            return len(self.enc.tok.encode(unit, add_special_tokens=False).ids)
        n = 0
        for p in parts:
            n += 1 if p in self.proven else self._merged(p)
        return n

    def _learn(self, units: set[str]) -> None:
        if len(self.memo) >= self.limit:
            self.memo, self.elder = {}, self.memo
        memo, elder = self.memo, self.elder
        for u in units.difference(memo):
            got = elder.get(u)
            memo[u] = self._unit(u) if got is None else got

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self._rest(text)

    def _rest(self, text: str) -> int:
        """A special string is one token wherever it stands and ends the text before it."""
        if not self.enc.specials:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        units, n = self.enc.units(text), 0
        for i in range(0, len(units), self.limit):
            part = units[i : i + self.limit] if len(units) > self.limit else units
            try:
                n += sum([self.memo[u] for u in part])
            except KeyError:
                self._learn(set(part))
                n += sum(map(self.memo.__getitem__, part))
        return n


def _count(batches: Iterator[pa.Array], path: str, proven) -> Iterator[pa.Array]:
    counter = TokenCounter(path, proven.value)
    for texts in batches:
        yield pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())


def token_counts(docs: DataFrame, tokenizer_name: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in one pass without a shuffle.

    Null texts are empty: no bytes, no tokens. Rows with a null id and repeated rows are kept as they are. Other columns
    are ignored. Texts may be of any length; a worker holds one Arrow batch of texts and the units of one text.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    path = tokenizer_path(tokenizer_name)
    if json.loads(tokenizer(path).to_str())["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("the whole-token proof is for byte-level vocabularies")
    proven = spark.sparkContext.broadcast(set(whole_tokens(path)))

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _count(batches, path, proven)

    counts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(counts, "long")
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return slim.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), udf("text").alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
