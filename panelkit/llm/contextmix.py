"""Language-model scores by logistic context mixing over the bits of a text.

The text is lower-cased (A-Z) and read as its words, each closed by a space, and a closing newline; the model gives every
bit of every byte a probability, so the sum of logarithms is the text's log probability. A word's probability depends on
its own bytes, on the kind of text that the words before it speak for (``Kinds``, usually a language), and on the word
just before: the start of the text, a short word (up to ``SHORT`` bytes: articles, prepositions and the like, hashed to a
class), or any longer word. Kind and word before are the mark of a word, word and mark together a unit. Whole texts are
read, in order, and every distinct unit of all texts is evaluated once, in Spark.

The model, in the order of its passes:

0. Kinds of text: ``KINDS`` clusters of all training documents over their ``KIND_WORDS`` most frequent words, fitted in
   Spark. While a text is read, the running likelihood of its words so far names its kind.
1. Spark counts all units (partial counts in tasks, then a shuffle by unit), apart for training documents, for one
   training fold in sixteen from which the weights are learned, and for held-out documents.
2. Six predictors with hashed contexts: the kind with the last two and with the last four bytes, the mark with the last
   two; the word so far alone, with the kind, and with the mark. The first three live in tables of ``2**SHARED_BITS``
   slots that every task reads. The contexts of the last three grow with the corpus, so their tables do:
   units are dealt into bins by the word's first bytes (its lead), some ``BIN_BYTES`` of distinct units each, and a bin
   holds every unit that shares a context beyond the lead, so its tables are counted there, with a slot for each node
   that the bin can have, and never leave it. A lead with more than ``BIN_BYTES`` is split by a longer lead. Inside the
   lead the contexts of a few bytes with the kind or the mark take their place.
3. Mixing weights are learned online in each bin: logistic gradient steps on the predictors' stretched probabilities,
   with a weight set gated by the bit's place in its byte and the confidence of the two longest contexts. An adaptive map then
   refines the mixed probability by partial byte. The mixing fold takes no part in the counts for this and supplies the
   units to learn from, so the weights see contexts as new texts do; bins' weights are averaged.
4. Tables of all training documents give each distinct unit its probability.
5. Along a text, each unit's probability adapts to the text: ``(r + A p) / (i + A)`` for a unit that has stood ``r`` times
   among the ``i`` words before it, with ``A`` = ``ADAPT``. The units above a count that at most ``HEAD`` units reach are
   broadcast with their probability and their word's training count; the rest of a text's units meet theirs in a join.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import BATCH_BYTES, arrow_rows, binary_batches, col, give_back, written

FOLDS, HELD_OUT, MIX_FOLDS = 7, 2, 16
#: Slots of the shared tables, as powers of two: the kind with the last two and with the last four bytes, the mark with the last two.
SHARED_BITS = (20, 22, 22)
SHARED = len(SHARED_BITS)
PREDICTORS = SHARED + 3
#: Weight sets of a place: confidence classes of the two longest contexts.
SURE = 6
GATES = SURE * SURE
#: Kinds of text, the words that tell them apart, and rounds of their fit.
KINDS, KIND_WORDS, KIND_ROUNDS = 8, 1500, 15
#: Bytes of a short word; what the word before can leave: the start, a longer word, and classes of short words.
SHORT, BEFORE = 3, 30
ADAPT = 1000.0
#: Units that are broadcast, at most.
HEAD = 200_000
#: Bytes of a word after which it goes on as a unit of its own.
CUT = 4096
#: Entries of a task's counters, and bytes of texts that are read at once (a longer text by itself).
FLUSH, TEXT_BYTES = 150_000, 2 << 20
#: Bytes of distinct units in a bin, about, and of a lead before it is split; bytes of the shortest lead.
BIN_BYTES, LEAD = 1 << 18, 3
#: Tasks that fill shared tables, and rows of summed weights, at most.
TABLE_TASKS, SHARDS = 256, 16
#: Gradient steps of a bin, where its units give fewer in one round, and rounds at most.
STEPS, ROUNDS = 150, 16
_BLOCK = 1 << 15
#: What a slot of a task's table holds at most; then its blocks are handed on.
_FULL = (1 << 32) - 1
_BLOCKS = "predictor int, block int, data binary"
_BATCH_BYTES = 1 << 18
#: Places that kinds are named for at once, and steps of a likelihood's unit: whole numbers add up alike in any order.
_PLACES, _FINE = 1 << 18, 1 << 30
_REACH = 8.0
_KNOTS = 33
_RATE = 0.02

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
#: What the word before leaves: the start of a text, a longer word, and the classes of short words.
_START, _LONG, _SHORT = 0, 1, 2


class Kinds:
    """Clusters of texts by frequent words, and the running likelihood that names a text's kind as it is read."""

    def __init__(self, words: list[bytes], likelihood: np.ndarray, prior: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.binary())
        self.table = np.vstack([likelihood.T, np.zeros((1, len(prior)))])  # the last row: words without a say
        self.prior = prior
        self.kinds = len(prior)
        self.steps = np.ascontiguousarray(np.rint(self.table.T * _FINE).astype(np.int64))
        self.start = np.rint(prior * _FINE).astype(np.int64)

    def along(self, words: list[bytes]) -> list[int]:
        """The kind of each word, and of the end: the likeliest given the words before it."""
        at = np.fromiter((self.at.get(w, -1) for w in words), np.int64, len(words))
        return self.named(np.append(at, -1), np.zeros(len(words) + 1, np.int64)).tolist()

    def named(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The kind at each place of texts in order, whose words are ``at`` these rows of the table."""
        out = np.zeros(len(at), np.int64)
        if self.kinds == 1:
            return out
        before = np.zeros(self.kinds, np.int64)  # sums up to a part, and up to the text that it starts in
        begun = np.zeros(self.kinds, np.int64)
        for i in range(0, len(at), _PLACES):
            rows, here = at[i : i + _PLACES], text[i : i + _PLACES]
            new = np.flatnonzero(np.diff(here, prepend=text[i - 1] if i else -1))  # where a text starts
            nth = np.cumsum(np.bincount(new, minlength=len(here)))  # texts begun in this part
            best = None
            for k in range(self.kinds):
                step = self.steps[k][rows]
                run = np.cumsum(step)
                run += before[k] - step
                base = np.append(begun[k], run[new])
                before[k], begun[k] = run[-1] + step[-1], base[-1]
                run += self.start[k] - base[nth]
                if best is None:
                    best = run
                else:
                    better = run > best
                    out[i : i + _PLACES][better] = k
                    np.maximum(best, run, out=best)
        return out


class _Before(dict):
    """What a word leaves to the next one; remembers a bounded number of short words."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > SHORT:
            return _LONG
        left = _SHORT + zlib.crc32(word) % (BEFORE - _SHORT)
        if len(self) < 100_000:
            self[word] = left
        return left


_BEFORE = _Before()
_MARKS = [[bytes([k * BEFORE + b]) for b in range(BEFORE)] for k in range(KINDS)]


def text_units(text: bytes | None, kinds: Kinds) -> tuple[list[bytes], list[bytes]]:
    """Units (mark, bytes, closing byte) of a text in order, the last one its end, and the words that were cut.

    A word over ``CUT`` bytes is a run of units of ``CUT`` bytes without a closing byte and a last one closed by a tab."""
    words = text.lower().split() if text else []
    before = [_START, *map(_BEFORE.__getitem__, words)]
    marks = [_MARKS[k][b] for k, b in zip(kinds.along(words), before, strict=True)]
    if words and max(map(len, words)) >= CUT:
        units, cut = [], []
        for mark, w in zip(marks, words, strict=False):
            if len(w) < CUT:
                units.append(mark + w + b" ")
                continue
            cut.append(w)
            units += [mark + w[i : i + CUT] for i in range(0, len(w) - len(w) % CUT, CUT)]
            units.append(mark + w[len(w) - len(w) % CUT :] + b"\t")
    else:
        units, cut = [m + w + b" " for m, w in zip(marks, words, strict=False)], []
    units.append(marks[-1] + b"\n")
    return units, cut


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts in lower case, the word at each place, and the words of each text."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    found = lists.flatten().view(pa.binary())
    whole = pc.binary_length(found).to_numpy() > 0  # white space at the ends leaves empty strings
    ends = np.cumsum(np.append(0, whole))[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
    coded = found.filter(pa.array(whole)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(ends)


def _rows_at(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word ``among`` others, -1 if it is not there."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _lots(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes in its column ``text``."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


class Places:
    """The units of texts without a word to cut, place by place: ``text`` and ``unit`` are indices, ``units`` the distinct
    units, ``sizes`` the places of each text with its end. ``cut`` tells which texts are left out."""

    def __init__(self, texts: pa.Array, kinds: Kinds):
        words, code, sizes = _words(texts)
        self.cut = np.zeros(len(texts), bool)
        length = pc.binary_length(words).to_numpy()
        if len(length) and length.max() >= CUT:
            text = np.repeat(np.arange(len(sizes)), sizes)
            self.cut[text[length[code] >= CUT]] = True
            code, sizes = code[~self.cut[text]], sizes[~self.cut]
        end = len(words)
        self.sizes = sizes + 1
        self.text = np.repeat(np.arange(len(sizes)), self.sizes)
        last = np.cumsum(self.sizes) - 1
        at = np.full(len(self.text), end, np.int64)
        inside = np.ones(len(at), bool)
        inside[last] = False
        at[inside] = code
        self.n_bytes = np.bincount(self.text, np.append(length + 1, 1)[at], minlength=len(sizes)).astype(np.int64)
        left = np.full(end + 1, _LONG, np.int64)
        short = np.flatnonzero(length <= SHORT)
        left[short] = [_BEFORE[w] for w in words.take(pa.array(short)).to_pylist()]
        before = np.roll(left[at], 1)
        before[last + 1 - self.sizes] = _START
        mark = kinds.named(np.append(_rows_at(words, kinds.words), -1)[at], self.text) * BEFORE + before
        coded = pa.array(mark * (end + 1) + at).dictionary_encode()
        self.unit = coded.indices.to_numpy().astype(np.int64)
        mark, at = np.divmod(coded.dictionary.to_numpy(), end + 1)
        marks, closing = pa.array([bytes([m]) for m in range(KINDS * BEFORE)], pa.binary()), pa.array([b" ", b"\n"], pa.binary())
        named = pa.concat_arrays([words, pa.array([b""], pa.binary())]).take(pa.array(at))
        self.units = pc.binary_join_element_wise(marks.take(pa.array(mark)), named, closing.take(pa.array((at == end).astype(np.int64))), pa.scalar(b"", pa.binary()))


class Tally:
    """A task's sums for keys; tables of keys and numbers are added up and handed on when they grow large."""

    def __init__(self, keys: list[str], sums: list[str]):
        self.keys, self.sums, self.held, self.rows, self.size = keys, sums, [], 0, 0

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.rows, self.size = self.rows + len(rows), self.size + rows.nbytes
        if self.rows > 2 * FLUSH or self.size > BATCH_BYTES:
            together = self.together()
            if len(together) > FLUSH or together.nbytes > BATCH_BYTES // 2:
                yield from together.to_batches(50_000)
                together = together.slice(0, 0)
            self.held, self.rows, self.size = [together], len(together), together.nbytes
            give_back()

    def together(self) -> pa.Table:
        got = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([(c, "sum") for c in self.sums])
        return got.select([*self.keys, *(f"{c}_sum" for c in self.sums)]).rename_columns([*self.keys, *self.sums])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self.together().to_batches(50_000)


def _is_token(unit: bytes) -> bool:
    """Whether a unit is a whole word or the end, not a part of a cut word."""
    return unit[-1:] in b" \n"


def _fold(id_col: Column, folds: int, shift: int = 1) -> Column:
    return (F.floor(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) / shift) % folds).cast("int")


# ---- counting ------------------------------------------------------------------------------------------------------

_UNIT_ROWS = pa.schema([("kind", pa.int32()), ("unit", pa.binary()), ("n", pa.int64()), ("m", pa.int64()), ("h", pa.int64())])


def _count_units(batches: Iterator[pa.RecordBatch], kinds: Kinds) -> Iterator[pa.RecordBatch]:
    """Partial counts of units (kind 0) and cut words (kind 1): n in documents for the tables, m in the mixing fold, h in
    held-out documents."""
    held = Tally(["kind", "unit"], ["n", "m", "h"])
    for batch in batches:
        for lot in _lots(batch, 1):
            part, places = lot.column(0).to_numpy(), Places(lot.column(1), kinds)
            counts = np.bincount(3 * places.unit + part[~places.cut][places.text], minlength=3 * len(places.units)).reshape(-1, 3)
            yield from held.add(pa.table([pa.array(np.zeros(len(counts), np.int32)), places.units, *map(pa.array, np.ascontiguousarray(counts.T))], schema=_UNIT_ROWS))
            for i in np.flatnonzero(places.cut).tolist():
                units, cut = text_units(lot.column(1)[i].as_py(), kinds)
                rows = [(k, u, *(c if j == part[i] else 0 for j in range(3))) for k, found in enumerate((units, cut)) for u, c in Counter(found).items()]
                for some in binary_batches(rows, _UNIT_ROWS, 50_000):
                    yield from held.add(pa.Table.from_batches([some]))
    yield from held.rest()
    del held
    give_back()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words."""
    held = Tally(["word"], ["n"])
    for batch in batches:
        for lot in _lots(batch, 0):
            words, code, _ = _words(lot.column(0))
            yield from held.add(pa.table({"word": words, "n": pa.array(np.bincount(code, minlength=len(words)), pa.int64())}))
    yield from held.rest()
    del held
    give_back()


_COUNTED = "size binary, at binary, n binary, draw binary"


def _frequent(batches: Iterator[pa.RecordBatch], frequent: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The counts of frequent words in each text that has any, a row for each lot of texts: how many differ, which, how
    often, and a number drawn by them."""
    among = pa.array(frequent, pa.binary())
    for batch in batches:
        for lot in _lots(batch, 0):
            words, code, sizes = _words(lot.column(0))
            at = _rows_at(words, among)[code]
            pair, often = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at >= 0] * len(frequent) + at[at >= 0], return_counts=True)
            size = np.bincount(pair // len(frequent), minlength=len(sizes))
            size, where = size[size > 0], pair % len(frequent)
            if not len(size):
                continue
            ends, names, counts = np.cumsum(size).tolist(), where.tolist(), often.tolist()
            draw = [hashlib.blake2b(repr((names[a:z], counts[a:z])).encode(), digest_size=8).digest() for a, z in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_pydict({"size": [size.astype(np.int32).tobytes()], "at": [where.astype(np.int32).tobytes()], "n": [often.astype(np.int64).tobytes()], "draw": [np.array([int.from_bytes(d) for d in draw], np.uint64).tobytes()]})
    give_back()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a lot of texts, each with a frequent word: which words, how often, where each text starts and the drawn numbers."""
    for batch in batches:
        for size, at, n, draw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = np.frombuffer(size, np.int32).astype(np.int64)
            yield np.frombuffer(at, np.int32), np.frombuffer(n, np.int64), np.cumsum(size) - size, np.frombuffer(draw, np.uint64)


def _shape(counts: np.ndarray) -> np.ndarray:
    shape = np.sqrt(counts)
    return shape / np.linalg.norm(shape, axis=1, keepdims=True)


def _fits(at: np.ndarray, n: np.ndarray, start: np.ndarray, table: np.ndarray, shaped: bool) -> np.ndarray:
    """What the words of each text make with each row of the table, by their counts or the shape of these."""
    of = table[:, at]
    of *= np.sqrt(n) if shaped else n
    fits = np.add.reduceat(of, start, axis=1)
    return fits / np.sqrt(np.add.reduceat(n, start)) if shaped else fits


_SEED = "rank double, draw binary, counts binary, far double"


def _seed(batches: Iterator[pa.RecordBatch], words: int, seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's candidate for the next seed, and how far its texts are from the ``seeds``: the text with the most
    frequent words at first, then one drawn in proportion to its squared distance."""
    best, total = None, 0.0
    for at, n, start, draw in _lists(batches):
        if len(seeds):
            far = np.maximum(1 - _fits(at, n, start, seeds, True).max(axis=0), 0) ** 2
            chance = ((_stir(draw + _U(len(seeds)) * _K1) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            rank = np.log(chance) / np.maximum(far, 1e-30)
            total += float(far.sum())
        else:
            rank = np.add.reduceat(n, start).astype(np.float64)
            total += float(len(start))
        i = np.lexsort((draw, rank))[-1]
        if best is None or (rank[i], draw[i]) > best[:2]:
            own = slice(start[i], start[i + 1] if i + 1 < len(start) else None)
            best = rank[i], draw[i], np.bincount(at[own], n[own], minlength=words)
    if best is not None:
        yield pa.RecordBatch.from_pydict({"rank": [float(best[0])], "draw": [int(best[1]).to_bytes(8)], "counts": [_squeezed(best[2])], "far": [total]})


def _tally(batches: Iterator[pa.RecordBatch], words: int, table: np.ndarray, prior: np.ndarray, shaped: bool) -> Iterator[pa.RecordBatch]:
    """Texts and word counts of each kind, a cell each, when every text goes to the kind it fits best."""
    kinds = len(prior)
    sums = np.zeros((kinds, words + 1), np.int64)
    for at, n, start, _ in _lists(batches):
        label = (_fits(at, n, start, table, shaped) + prior[:, None]).argmax(axis=0)
        cell = np.repeat(label, np.diff(np.append(start, len(at)))) * words + at
        sums[:, :words] += np.bincount(cell, n, minlength=kinds * words).astype(np.int64).reshape(kinds, words)
        sums[:, words] += np.bincount(label, minlength=kinds)
    cell = np.flatnonzero(sums.ravel())
    yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int32), "n": sums.ravel()[cell]})


def fit_kinds(training: DataFrame) -> Kinds:
    """Kinds of text: hard clustering of the word counts of all training documents, from seeds far apart. Every round is a
    pass over the counts in Spark; what reaches the driver is one candidate a task and the kinds' sums."""
    given = training.where(F.length("data") > 0).select("data")
    top = given.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "word").limit(KIND_WORDS)
    words = [bytes(r.word) for r in top.collect()]
    if not words:
        return Kinds([], np.zeros((1, 0)), np.zeros(1))
    n = len(words)
    counted = written(given.mapInArrow(partial(_frequent, frequent=words), _COUNTED), "kind-words")
    seeds = np.zeros((0, n))
    while len(seeds) < KINDS:
        found = counted.mapInArrow(partial(_seed, words=n, seeds=seeds), _SEED).collect()  # a row a task
        if sum(r.far for r in found) < 1e-9:
            break
        best = max(found, key=lambda r: (r["rank"], bytes(r.draw)))
        seeds = np.vstack([seeds, _shape(_unsqueezed(best.counts)[None, :])])

    def tally(table: np.ndarray, prior: np.ndarray, shaped: bool = False) -> np.ndarray:
        cells = counted.mapInArrow(partial(_tally, words=n, table=table, prior=prior, shaped=shaped), "cell int, n long")
        cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # kinds x words at most
        sums = np.zeros(len(prior) * (n + 1), np.int64)
        sums[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        return sums.reshape(len(prior), n + 1)

    sums = tally(seeds, np.zeros(len(seeds)), shaped=True)
    overall = (sums[:, :n].sum(axis=0) + 0.5) / (sums[:, :n].sum() + 0.5 * n)
    for _ in range(KIND_ROUNDS):
        table = np.log((sums[:, :n] + 50 * overall) / (sums[:, :n].sum(axis=1, keepdims=True) + 50))
        prior = np.log(sums[:, n] + 1.0)
        moved = tally(table, prior)
        if (moved == sums).all():
            break
        sums = moved
    return Kinds(words, table, prior)


def count_units(docs: DataFrame, kinds: Kinds) -> DataFrame:
    """``kind, unit, n, m, h`` over the documents (doc_id, held_out, data)."""
    part = F.when(F.col("held_out"), 2).when(_fold(F.col("doc_id"), MIX_FOLDS, FOLDS) == 0, 1).otherwise(0)
    rows = docs.select(part.alias("part"), "data").mapInArrow(partial(_count_units, kinds=kinds), "kind int, unit binary, n long, m long, h long")
    return written(rows.groupBy("kind", "unit").agg(*[F.sum(c).alias(c) for c in "nmh"]), "units")


def binned(units: DataFrame) -> DataFrame:
    """Units (kind 0) with the length of their lead and their bin, ``lead int, bin int``. Only the hot leads, each with
    over ``BIN_BYTES`` of distinct units, reach the driver."""
    given = units.where("kind = 0")
    total = given.agg(F.coalesce(F.sum(F.length("unit")), F.lit(0)).alias("b")).first().b
    bins = max(1, -(-total // BIN_BYTES))
    spark, lead, length = units.sparkSession, F.lit(LEAD), LEAD
    while length < CUT:
        key = F.expr(f"substring(unit, 2, {length})")
        # shorter units are whole words; a hot lead lies in hot leads only
        longer = units.where("kind = 0").where(F.length("unit") > length)
        hot = [r.key for r in longer.groupBy(key.alias("key")).agg(F.sum(F.length("unit")).alias("b")).where(F.col("b") > BIN_BYTES).select("key").collect()]
        if not hot:
            break
        table = F.broadcast(spark.createDataFrame([(h,) for h in hot], "hot binary"))  # at most the units' bytes / BIN_BYTES rows
        given = given.join(table.withColumnRenamed("hot", f"hot{length}"), key == F.col(f"hot{length}"), "left")
        lead = F.when(F.col(f"hot{length}").isNotNull(), F.lit(2 * length)).otherwise(lead)
        length *= 2
    dealt = given.withColumn("lead", lead.cast("int"))
    at = F.pmod(F.xxhash64(F.expr("substring(unit, 2, lead)")), F.lit(bins)).cast("int")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bins // 4)  # work is in the bytes' bits: small tables, many tasks
    return dealt.select("unit", "n", "m", "h", "lead", at.alias("bin")).repartition(tasks, "bin")


# ---- contexts and shared tables ------------------------------------------------------------------------------------


def contexts(units: list[bytes], chosen: np.ndarray | None = None, predictors: int = PREDICTORS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every predicted byte of the units (or every ``chosen`` one): the unit's index, the bytes of the word before it,
    the byte, and the hash of each of the first ``predictors`` predictors' contexts."""
    sizes = np.array([len(u) for u in units], np.int64)
    flat = np.frombuffer(b"".join(units), np.uint8)
    row = np.repeat(np.arange(len(units)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(flat)) - begin[row]
    wide = flat.astype(_U) + _U(1)
    pick = np.flatnonzero(at > 0 if chosen is None else chosen)
    row, at = row[pick], at[pick]
    first = begin[row]
    mark, length = wide[first] * (_K1 | _U(1)) * _K3, at.astype(_U) * _K2
    kind = (flat[first] // BEFORE).astype(_U) * (_K1 ^ _K3)
    value, last = np.zeros(len(pick), _U), []
    for k in range(4):
        back = wide[np.maximum(pick - k - 1, 0)]
        back *= _K2 ** _U(k + 1) | _U(1)
        back *= at > k + 1
        back += value
        value = back
        last.append(value)
    out = [last[1] + kind, last[3] + kind, last[1] + mark]
    if predictors > SHARED:
        power = np.cumprod(np.full(int(sizes.max()), _K1 | _U(1)))  # wraps around
        term = wide * power[np.arange(len(flat)) - np.repeat(begin, sizes)]
        sums = np.cumsum(term) - term  # terms before each byte
        inner = sums[pick] - sums[first] - term[first]  # without the mark
        out += [inner + length, inner + kind + length, inner + mark + length]
    return row, at - 1, flat[pick], [_stir(v + _U(k + 1) * _K3) for k, v in enumerate(out)]


def shared_bytes(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that units in ascending order share: which bytes behind the marks are the first with all that is before them
    the same, and for every such byte of every unit its number among those first ones."""
    sizes = np.array([len(u) for u in units], np.int64)
    flat = np.frombuffer(b"".join(units), np.uint8)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(units)), sizes)
    at = np.arange(len(flat)) - begin[row]
    above = np.where((row > 0) & (at < sizes[row - 1]), begin[row - 1] + at, -1)
    differs = (above < 0) | (flat != flat[above])
    common = np.minimum.reduceat(np.where(differs, at, sizes[row]), begin)
    new = (at >= common[row]) & (at > 0)
    order = np.argsort(at.astype(np.uint16), kind="stable")  # by place, then in the units' order
    order = order[len(units) :]  # without the marks
    number = np.cumsum(new) - 1
    nearest = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))
    of = np.zeros(len(flat), np.int64)
    of[order] = number[order[nearest]]
    return new, of[at > 0]


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _K2
    return (x ^ (x >> _U(29))) * _K3


def _slots(bits: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return _slots_of(bits, context, node.astype(_U) * _K1)


def _slots_of(bits: int, context: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Slots of contexts with their nodes' numbers times ``_K1``."""
    at = context ^ turn
    at *= _K2
    at >>= _U(64 - bits)
    return at.view(np.int64)


def _batched(units: list[bytes]) -> Iterator[slice]:
    """Slices of units with a bounded number of bytes."""
    ends = np.cumsum([len(u) for u in units])
    at = 0
    while at < len(units):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BATCH_BYTES)))
        yield slice(at, to)
        at = to


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _squeezed(counts: np.ndarray) -> bytes:
    """Mostly empty or small counts of any type, deflated byte plane by byte plane behind the type's letter; of few counts
    among zeros only these, behind a star, with the steps from one to the next and the size."""
    kind, at = counts.dtype.char.encode(), np.flatnonzero(counts)
    if 4 * len(at) > len(counts):
        return kind + zlib.compress(_planes(counts), 1)
    steps = np.diff(at, prepend=0).astype(np.uint32)
    return b"*" + kind + len(counts).to_bytes(8) + len(at).to_bytes(8) + zlib.compress(_planes(steps) + _planes(counts[at]), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    if data[:1] != b"*":
        return _of_planes(zlib.decompress(data[1:]), np.dtype(data[:1].decode()))
    kind, size, n, found = np.dtype(data[1:2].decode()), int.from_bytes(data[2:10]), int.from_bytes(data[10:18]), zlib.decompress(data[18:])
    out = np.zeros(size, kind)
    out[np.cumsum(_of_planes(found[: 4 * n], np.dtype(np.uint32)), dtype=np.int64)] = _of_planes(found[4 * n :], kind)
    return out


def _distinct(context: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a context and its byte: context, which pair stands at each place, and byte."""
    coded = pa.array(context).dictionary_encode()
    pairs = pa.array(coded.indices.to_numpy().astype(np.int64) << 8 | byte).dictionary_encode()
    pair = pairs.dictionary.to_numpy()
    return coded.dictionary.to_numpy()[pair >> 8], pairs.indices.to_numpy(), pair & 255


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of zeros and ones of this task's units, as blocks of the shared tables. The counts are exact: before four
    bytes could overflow, the blocks are handed on and the tables start anew."""
    tables = [np.zeros(2 << bits, np.uint32) for bits in SHARED_BITS]
    held = 0  # no slot holds more

    def flush() -> Iterator[pa.RecordBatch]:
        for k, bits in enumerate(SHARED_BITS):
            for block in range((1 << bits) // _BLOCK):
                data = tables[k][2 * block * _BLOCK : 2 * (block + 1) * _BLOCK]
                if data.any():
                    yield pa.RecordBatch.from_pydict({"predictor": pa.array([k], pa.int32()), "block": pa.array([block], pa.int32()), "data": [_squeezed(data)]})
                    data[:] = 0

    for batch in batches:
        units, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.int64)
        for part in _batched(units):
            row, _, byte, ctx = contexts(units[part], predictors=SHARED)
            seen = [_distinct(c, byte) for c in ctx]
            left = counts[part].copy()
            most = _FULL // len(row)
            while left.any():
                now = np.minimum(left, most)  # a count that fills a slot by itself takes several rounds
                left -= now
                weight = now[row]
                size = int(weight.sum())
                if held + size > _FULL:
                    yield from flush()
                    held = 0
                held += size
                for k, bits in enumerate(SHARED_BITS):
                    at, of, byte = seen[k]
                    total = np.bincount(of, weight, minlength=len(at)).astype(np.uint32)
                    for b in range(8):
                        node, bit = (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1
                        np.add.at(tables[k], 2 * _slots(bits, at, node) + bit, total)
    yield from flush()
    tables.clear()
    give_back()


def _total(table: pa.Table) -> np.ndarray:
    return sum(_unsqueezed(d).astype(np.int64) for d in table.column("data").to_pylist())


def _sum(table: pa.Table) -> pa.Table:
    """One block's sums over tasks."""
    return pa.table({"predictor": table.column("predictor")[:1], "block": table.column("block")[:1], "data": pa.array([_squeezed(_total(table))], pa.binary())})


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probabilities of a one and confidence classes of counts."""
    n = zeros + ones
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -_REACH, _REACH), (n >= 1).astype(np.uint8) + (n >= 3) + (n >= 10) + (n >= 40) + (n >= 300)


def _finish(table: pa.Table) -> pa.Table:
    """One block's sums as stretched probabilities and confidence classes."""
    stretch, sure = _stretched(*_total(table).reshape(_BLOCK, 2).T)
    return pa.table({"predictor": table.column("predictor")[:1], "block": table.column("block")[:1], "stretch": pa.array([stretch.astype(np.float16).tobytes()], pa.binary()), "sure": pa.array([sure.astype(np.uint8).tobytes() if table.column("predictor")[0].as_py() == SHARED - 1 else None], pa.binary())})


def _knots(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (mixed + _REACH) * ((_KNOTS - 1) / (2 * _REACH))
    low = np.minimum(place.astype(np.int64), _KNOTS - 2)
    return low, place - low


class Model:
    """Shared tables, weights and the refining map: a few megabytes, whatever was counted."""

    def __init__(self, stretch: list[np.ndarray], sure: np.ndarray):
        self.stretch, self.sure = stretch, sure
        self.weights = np.full((8, GATES, PREDICTORS + 1), 0.3)
        self.weights[:, :, -1] = 0.0
        knots = (np.arange(_KNOTS) - (_KNOTS - 1) / 2) * (2 * _REACH / (_KNOTS - 1))
        self.map = np.tile(1 / (1 + np.exp(-knots)), (256, 1))

    def mixed(self, b: int, gate: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        """Mixed prediction in the stretched domain."""
        w = self.weights[b].astype(np.float32)[gate]
        return np.clip(np.einsum("kn,nk->n", inputs, w), -_REACH, _REACH)

    def probability(self, node: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Probability of a one: the mixed one averaged with the refined one."""
        low, part = _knots(mixed)
        flat = node * _KNOTS + low
        table = self.map.ravel()
        refined = table[flat] * (1 - part) + table[flat + 1] * part
        return np.clip((1 / (1 + np.exp(-mixed)) + refined) / 2, 1e-6, 1 - 1e-6)


class Bin:
    """The units of a bin, their counts for its tables, and the model of the shared tables. What units have in common up to
    a byte is worked out once: of their bytes only the ``nodes`` with a past of their own are kept."""

    def __init__(self, model: Model, units: list[bytes], lead: np.ndarray, counts: np.ndarray):
        self.model, self.units = model, units
        order = np.array(sorted(range(len(units)), key=units.__getitem__), np.int64)
        given = [units[i] for i in order.tolist()]
        new, of = shared_bytes(given)
        sizes = np.array([len(u) - 1 for u in given], np.int64)
        weight = np.bincount(of, np.repeat(counts[order], sizes).astype(np.float64))
        row, before, byte, self.ctx = contexts(given, new)
        self.byte = byte.astype(np.int64)
        self.deep = before >= lead[order][row]  # beyond the lead the bin holds all units of a context
        self.weight = weight
        self.bits = max(4, math.ceil(math.log2(2 * max(1, len(of)))))
        # the units' bytes, in the units' own order
        begin, place = np.cumsum(sizes) - sizes, np.argsort(order)
        own = sizes[place]
        self.row = np.repeat(np.arange(len(units)), own)
        self.node = of[np.arange(len(of)) - np.repeat(np.cumsum(own) - own - begin[place], own)]

    def planes(self, pick: np.ndarray | slice = slice(None)) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place in the byte: the place and, for picked nodes, partial byte, bit, gate and stretched predictions
        (with a constant). Each place has tables of its own, with two slots for each byte of the bin."""
        counting = np.flatnonzero(self.deep & (self.weight > 0))
        deep = np.flatnonzero(self.deep[pick])
        weight, asked = self.weight[counting], [c[pick] for c in self.ctx[:SHARED]]
        among = np.arange(len(self.byte))[pick][deep]
        for b in range(8):
            node, bit = (1 << b) | (self.byte >> (8 - b)), (self.byte >> (7 - b)) & 1
            turn = node.astype(_U) * _K1
            some, at_node, at_turn = bit[counting], node[pick], turn[pick]
            inputs = np.ones((PREDICTORS + 1, len(at_node)), np.float32)
            for k, bits in enumerate(SHARED_BITS):
                at = _slots_of(bits, asked[k], at_turn)
                inputs[k] = self.model.stretch[k][at]
            gate = (SURE + 1) * self.model.sure[at]
            inputs[SHARED], inputs[SHARED + 1], inputs[SHARED + 2] = inputs[1], inputs[1], inputs[2]
            for k in range(SHARED, PREDICTORS):
                slot = _slots_of(self.bits, self.ctx[k], turn)
                slot <<= 1
                table = np.bincount(slot[counting] + some, weight, minlength=2 << self.bits)
                at = slot[among]
                inputs[k][deep], sure = _stretched(table[at], table[at + 1])
                gate[deep] = sure + (SURE * gate[deep] if k > SHARED + 1 else 0)
            yield b, at_node, bit[pick], gate, inputs

    def score(self) -> np.ndarray:
        """log10 probability of each unit."""
        total = np.zeros(len(self.byte))
        for b, node, bit, gate, inputs in self.planes():
            p = self.model.probability(node, self.model.mixed(b, gate, inputs))
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return np.bincount(self.row, total[self.node], minlength=len(self.units))

    def learn(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights after online gradient steps on the units with ``counts``, and zeros and ones seen at every knot of the
        refining map under them. Units weigh by their whole counts; a step is as long as that of as many units of one
        count each, however frequent some are."""
        own = self.model.weights.copy()
        pick = np.flatnonzero(counts[self.row] > 0)
        weight = counts[self.row][pick].astype(np.float64)
        nodes, of = np.unique(self.node[pick], return_inverse=True)
        seen = np.zeros((2, 256 * _KNOTS))
        step_of = [slice(i, i + 1024) for i in range(0, len(pick), 1024)]
        rounds = min(ROUNDS, max(1, -(-STEPS // max(1, len(step_of)))))
        cells = np.arange(PREDICTORS + 1)
        for b, *planes in self.planes(nodes):
            node, bit, gate, inputs = (p[..., of] for p in planes)
            steps = []
            for s in step_of:
                g, mass = gate[s].astype(np.int64), weight[s]
                scale = (np.sqrt(np.bincount(g, minlength=GATES)) / np.maximum(np.bincount(g, mass, minlength=GATES), 1))
                steps.append(((g + GATES * cells[:, None]).ravel(), inputs[:, s].astype(np.float64), bit[s], mass, scale))
            now = np.ascontiguousarray(own[b].T)
            for cell, x, one, mass, scale in steps * rounds:
                mixed = np.minimum(np.maximum((x * now.take(cell).reshape(x.shape)).sum(axis=0), -_REACH), _REACH)
                err = (one - 1 / (1 + np.exp(-mixed))) * mass
                now += _RATE * np.bincount(cell, (err * x).ravel(), minlength=now.size).reshape(now.shape) * scale
            own[b] = now.T
            low, frac = _knots(np.clip((inputs * own[b][gate].T).sum(axis=0), -_REACH, _REACH))
            for v in (0, 1):
                w = np.where(bit == v, weight, 0)
                for knot, part in ((low, 1 - frac), (low + 1, frac)):
                    seen[v] += np.bincount(node * _KNOTS + knot, w * part, minlength=256 * _KNOTS)
        return own, seen


def assemble(blocks: list[dict]) -> Model:
    """Finished blocks as a model with its first weights."""
    stretch, sure = [np.zeros(1 << bits, np.float16) for bits in SHARED_BITS], np.zeros(1 << SHARED_BITS[-1], np.uint8)
    for r in blocks:
        at = slice(r["block"] * _BLOCK, (r["block"] + 1) * _BLOCK)
        stretch[r["predictor"]][at] = np.frombuffer(r["stretch"], np.float16)
        if r["predictor"] == SHARED - 1:
            sure[at] = np.frombuffer(r["sure"], np.uint8)
    return Model(stretch, sure)


def table_blocks(units: DataFrame, counts: Column) -> DataFrame:
    """Counts of zeros and ones over units with the weight ``counts``, as blocks of each task's tables."""
    given = units.where("kind = 0").select("unit", counts.alias("c")).where("c > 0")
    tasks = min(TABLE_TASKS, max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return given.coalesce(tasks).mapInArrow(_fill, _BLOCKS)


def finished(blocks: DataFrame) -> Model:
    """The model of summed blocks; what reaches the driver is at most the shared tables' size."""
    done = blocks.groupBy("predictor", "block").applyInArrow(_finish, "predictor int, block int, stretch binary, sure binary")
    return assemble([r.asDict() for r in done.collect()])


def _of_bin(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Units of a bin in an order of their own, with lead, n and m."""
    names = table.column("unit").combine_chunks()
    names_order = pc.array_sort_indices(names).to_numpy()
    units = names.to_pylist()
    crc = np.fromiter(map(zlib.crc32, units), np.uint32, len(units))
    order = names_order[np.argsort(crc[names_order], kind="stable")]
    lead, n, m = (table.column(c).to_numpy()[order] for c in ("lead", "n", "m"))
    return [units[i] for i in order.tolist()], lead, n, m


def _learn_bin(table: pa.Table, model) -> pa.Table:
    give_back()
    units, lead, n, m = _of_bin(table)
    weights, seen = Bin(model.value, units, lead, n).learn(m)
    return pa.table({"bin": table.column("bin")[:1], "n": pa.array([int((m > 0).sum())], pa.int64()), "weights": [weights.tobytes()], "seen": [_squeezed(seen.ravel())]})


def _sum_learned(table: pa.Table) -> pa.Table:
    """Sums over bins: units learned from, weights times them, and what the map saw, in the order of the bins."""
    table = table.sort_by("bin")
    n = table.column("n").to_numpy()
    weights = sum(c * np.frombuffer(w) for c, w in zip(n.tolist(), table.column("weights").to_pylist(), strict=True))
    seen = sum(map(_unsqueezed, table.column("seen").to_pylist()))
    return pa.table({"bin": table.column("bin")[:1], "n": pa.array([int(n.sum())], pa.int64()), "weights": [weights.tobytes()], "seen": [_squeezed(seen)]})


def _score_bin(table: pa.Table, model) -> pa.Table:
    """Units with their log10 probability, their word's training count (null for parts of cut words), whether they speak
    for their word as its first unit, and how often they stand in all documents."""
    give_back()
    names = table.column("unit").combine_chunks()
    lead, n, m, h = (table.column(c).to_numpy() for c in ("lead", "n", "m", "h"))
    units = names.to_pylist()
    logp = Bin(model.value, units, lead, n + m).score()
    token = np.fromiter(map(_is_token, units), bool, len(units))
    word = pc.binary_slice(names, 1, -1).dictionary_encode().indices.to_numpy()[token]
    count = np.bincount(word, (n + m)[token], minlength=len(units)).astype(np.int64)
    c, first = np.zeros(len(units), np.int64), np.zeros(len(units), bool)
    c[token] = count[word]
    first[np.flatnonzero(token)[np.unique(word, return_index=True)[1]]] = True
    return pa.table({
        "kind": pa.array(np.zeros(len(units), np.int32)), "unit": names, "logp": pa.array(logp), "c": pa.array(c, mask=~token), "first": pa.array(first & (c > 0)),
        "times": pa.array(n + m + h),
    })


_EVALUATED = "kind int, unit binary, logp double, c long, first boolean, times long"


def fit(units: DataFrame, bins: DataFrame) -> Model:
    """The model of all counted units, with weights learned in the bins."""
    spark = units.sparkSession
    counted = written(table_blocks(units, F.col("n")).groupBy("predictor", "block").applyInArrow(_sum, _BLOCKS), "early-tables")
    early = spark.sparkContext.broadcast(finished(counted))
    form = "bin int, n long, weights binary, seen binary"
    learned = bins.groupBy("bin").applyInArrow(lambda t: _learn_bin(t, early), form)
    learned = learned.where("n > 0").groupBy(F.pmod("bin", F.lit(SHARDS))).applyInArrow(_sum_learned, form).collect()  # SHARDS rows
    early.destroy()
    model = finished(counted.unionByName(table_blocks(units, F.col("m"))))
    if learned:
        learned = sorted(learned, key=lambda r: r.bin)
        model.weights = sum(np.frombuffer(r.weights) for r in learned).reshape(model.weights.shape) / sum(r.n for r in learned)
        zeros, ones = sum(_unsqueezed(r.seen) for r in learned).reshape(2, 256, _KNOTS)
        model.map = (ones + 4 * model.map) / (zeros + ones + 4)
    return model


def evaluated(units: DataFrame, bins: DataFrame, model) -> DataFrame:
    """``kind, unit, logp, c, first, times`` of every distinct unit, and of cut words (without probability)."""
    own = bins.groupBy("bin").applyInArrow(lambda t: _score_bin(t, model), _EVALUATED)
    c = F.col("n") + F.col("m")
    cut = units.where("kind = 1").select("kind", "unit", F.lit(None).cast("double").alias("logp"), c.alias("c"), (c > 0).alias("first"), (c + F.col("h")).alias("times"))
    return written(own.unionByName(cut), "evaluated")


# ---- scoring -------------------------------------------------------------------------------------------------------


def repeats(units: np.ndarray, logp: np.ndarray) -> float:
    """Sum of log10(r + A p) over a run of units, r times seen before in the run."""
    order = np.argsort(units, kind="stable")
    same = units[order]
    first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
    before = np.empty(len(units), np.int64)
    before[order] = np.arange(len(units)) - np.repeat(first, np.diff(np.r_[first, len(units)]))
    p = logp + math.log10(ADAPT)
    again = np.flatnonzero(before)
    p[again] = np.log10(before[again] + 10.0 ** p[again])
    return float(p.sum())


def places(n: int) -> float:
    """Sum of log10(i + A) over the places of a run of n units."""
    return (math.lgamma(n + ADAPT) - math.lgamma(ADAPT)) / math.log(10)


class Head:
    """The frequent units: their probabilities, and log10 of their words' base probabilities (zero for parts of words)."""

    def __init__(self, rows: pa.Table, room: int, kinds: Kinds):
        self.kinds = kinds
        self.units = rows.column("unit").combine_chunks()
        c = rows.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
        self.logp, token = rows.column("logp").to_numpy().copy(), ~np.isnan(c)
        self.known = c > 0
        self.base = np.where(token, np.log10((np.nan_to_num(c) + 1) / max(1, room)), 0.0)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """Which of the texts have a word to cut, and of the others: bytes read, tokens, tokens of the head with a training
        count, their base score, the model's score without the other units, and the other units (kind 0) with their number."""
        p = Places(texts, self.kinds)
        return p.cut, self.figures(p.text, p.unit, p.units, p.sizes, p.n_bytes, p.sizes)

    def read_cut(self, text: bytes) -> list[pa.Array]:
        """The same figures of a text with words to cut; they are the units of kind 1."""
        units, cut = text_units(text, self.kinds)
        coded = pa.array(units, pa.binary()).dictionary_encode()
        tokens = np.array([sum(map(_is_token, units)) + len(cut)])
        size = np.array([len(units)])
        return self.figures(np.zeros(len(units), np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary, size, np.array([sum(map(len, units))]) - size, tokens, Counter(cut))

    def figures(self, text: np.ndarray, unit: np.ndarray, units: pa.Array, sizes: np.ndarray, n_bytes: np.ndarray, tokens: np.ndarray, cut: Counter | None = None) -> list[pa.Array]:
        n, distinct = len(sizes), max(1, len(units))
        found = pa.array(text * distinct + unit).value_counts()  # in the order of the texts
        text, unit = np.divmod(found.field("values").to_numpy(), distinct)
        often = found.field("counts").to_numpy()
        at = _rows_at(units, self.units)[unit]
        here = at >= 0
        of, times, at = text[here], often[here], at[here]
        known = np.bincount(of, times * self.known[at], minlength=n).astype(np.int64)
        base = np.bincount(of, times * self.base[at], minlength=n)
        logp = np.bincount(of, repeated(self.logp[at], times), minlength=n) - np.array([places(k) for k in sizes.tolist()])
        rest, names, counts = text[~here], units.take(pa.array(unit[~here])), often[~here]
        kind = np.zeros(len(rest), np.int32)
        if cut:  # a single text
            rest, kind = np.append(rest, [0] * len(cut)), np.append(kind, [1] * len(cut)).astype(np.int32)
            names, counts = pa.concat_arrays([names, pa.array(list(cut), pa.binary())]), np.append(counts, list(cut.values()))
        offsets = np.append(0, np.cumsum(np.bincount(rest, minlength=n)))
        others = pa.StructArray.from_arrays([pa.array(kind), names, pa.array(counts, pa.int64())], ["kind", "unit", "in_text"])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return [*map(pa.array, (n_bytes, tokens, known, base.astype(np.float64), logp), kinds), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), others)]


def repeated(logp: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For units with these probabilities that stand so often in a text: the sum of log10(r + A p) over r from 0."""
    p = logp + math.log10(ADAPT)
    many = np.flatnonzero(times > 1)
    more = times[many] - 1
    r = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    unit = np.repeat(np.arange(len(many)), more)
    out = p.copy()
    out[many] += np.bincount(unit, np.log10(r + 10.0 ** p[many][unit]), minlength=len(many))
    return out


def _score(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, nth = TaskContext.get().partitionId() << 40, 0
    head = head.value
    names = ["row", "doc_id", "held_out", "n_bytes", "n_tokens", "known", "base", "score", "others"]
    for batch in batches:
        for lot in _lots(batch, 2):
            cut, figures = head.read(lot.column(2))
            some = [(lot.filter(pa.array(~cut)), figures), *((lot.slice(i, 1), head.read_cut(lot.column(2)[i].as_py())) for i in np.flatnonzero(cut).tolist())]
            for rows, found in some:
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(task + nth, task + nth + rows.num_rows)), rows.column(0), rows.column(1), *found], names=names)
                    nth += rows.num_rows
        give_back()


def head_of(units: DataFrame, most: int, room: int, kinds: Kinds) -> Head:
    """The most frequent units: all units from a count on that at most ``most`` units reach."""
    size = F.when(F.col("times") < 1000, F.col("times")).otherwise(F.floor(F.log2("times") * 64) + 1000)
    given = units.where("kind = 0")
    tally = sorted(((r.size, r.n) for r in given.groupBy(size.cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # some thousand rows
    got, least = 0, None
    for s, n in tally:
        if got + n > most:
            break
        got, least = got + n, s
    return Head(given.where(size >= least if least is not None else F.lit(False)).select("unit", "logp", "c").toArrow(), room, kinds)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and ``n_bytes, bits_per_byte`` of every row.

    Null texts are empty: one token, the end. Null ids count as the empty text for the folds. Repeated rows are scored
    each and counted each. If no document is in the training folds, N and V are 0: the base is then undefined (null) and
    every bit has probability one half. An empty table gives no rows. Other columns are ignored. Texts of any length are
    scored whole; a word over ``CUT`` bytes goes on as further units.
    """
    spark: SparkSession = docs.sparkSession
    arrow_rows(spark, 1000)
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), (_fold(col(id_col), FOLDS) == HELD_OUT).alias("held_out"), col(text_col).cast("string").cast("binary").alias("data"))
    kinds = fit_kinds(slim.where("not held_out").select("doc_id", "data"))
    units = count_units(slim, kinds)
    bins = binned(units)
    arrow_rows(spark, 20_000)
    model = spark.sparkContext.broadcast(fit(units, bins))
    words = evaluated(units, bins, model)
    model.destroy()
    sums = words.agg(F.coalesce(F.sum(F.when(F.col("first"), F.col("c"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("first").cast("long")), F.lit(0)).alias("distinct")).first()
    total, room = int(sums.total), int(sums.total) + int(sums.distinct)
    frequent = spark.sparkContext.broadcast(head_of(words, head, room, kinds))
    arrow_rows(spark, 1000)
    schema = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, score double, others array<struct<kind int, unit binary, in_text long>>"
    texts = written(slim.mapInArrow(partial(_score, head=frequent), schema), "scored")
    frequent.destroy()

    met = texts.select("row", F.explode("others").alias("o")).select("row", "o.*").join(words.select("kind", "unit", "logp", "c").hint("shuffle_hash"), ["unit", "kind"])
    again = F.expr(f"aggregate(sequence(1L, in_text - 1), 0D, (s, r) -> s + log10(r + {ADAPT}D * pow(10D, logp)))")
    model_share = F.when(F.col("kind") == 0, F.col("logp") + F.lit(math.log10(ADAPT)) + F.when(F.col("in_text") > 1, again).otherwise(0.0)).otherwise(0.0)
    base_share = F.col("in_text") * F.log10((F.col("c") + 1) / F.lit(float(max(1, room))))
    per_row = met.groupBy("row").agg(
        F.sum(model_share).alias("rare_score"), F.sum(F.coalesce(base_share, F.lit(0.0))).alias("rare_base"),
        F.sum(F.when(F.col("c") > 0, F.col("in_text")).otherwise(0)).alias("rare_known"),
    )
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    out = texts.drop("others").join(per_row, "row", "left").withColumn("score", score)
    base = F.when(F.lit(total > 0), F.col("base") + F.coalesce("rare_base", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.cast("double").alias("base_score"), "score", "n_bytes",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
