"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows: a forward and a backward GRU whose input weights are one row for each
byte, and a softmax over the languages at every position. Each position of the whole text is labelled; the document's
probabilities are the mean over its positions. Training is plain numpy, by backpropagation through time with Adam, on
windows of a bounded sample of labelled documents (``SAMPLE_DOCS`` a language, ``SAMPLE_WINDOWS`` windows spread over each
whole text), drawn by hash. The fitted weights are some thousand numbers, sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import arrow_rows, col, fresh, give_back

HIDDEN = 8
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
TRAIN_WINDOW, STEPS, BATCH, RATE = 48, 200, 128, 0.02
#: Bytes a window holds when a text is labelled, and windows that run side by side.
WINDOW, SIDE_BY_SIDE = 128, 2048
FOLDS, HELD_OUT = 4, 2
#: The pipeline rejects a document whose best language has a lower mean probability.
LEAST_SCORE = 0.5


@dataclass
class Network:
    """Weights by name; direction 0 reads forward, 1 backward."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], hidden: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "01":
            w["x" + d] = rng.normal(0, 0.1, (256, 3 * hidden))
            w["u" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            w["c" + d] = np.zeros(hidden)
            w["o" + d] = rng.normal(0, hidden**-0.5, (hidden, len(langs)))
        w["b"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def _run(net: Network, d: str, x: np.ndarray, real: np.ndarray | None, tape: list | None = None) -> np.ndarray:
    """Hidden states of one direction over ``x`` (steps, sequences); ``tape`` gathers what the backward pass needs.
    Steps that are not ``real`` leave the state at zero."""
    steps, n = x.shape
    size = net.w["c" + d].size
    table, u, c = net.w["x" + d], net.w["u" + d], net.w["c" + d]
    t_gate, t_cand = np.ascontiguousarray(table[:, : 2 * size]), np.ascontiguousarray(table[:, 2 * size :])
    u_gate, u_cand = np.ascontiguousarray(u[:, : 2 * size]), np.ascontiguousarray(u[:, 2 * size :])
    out = np.empty((steps, n, size), np.float32)
    gate, part = np.empty((n, 2 * size), np.float32), np.empty((n, 2 * size), np.float32)
    given, m, cand = (np.empty((n, size), np.float32) for _ in range(3))
    h = np.zeros((n, size), np.float32)
    for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
        np.take(t_gate, x[t], axis=0, out=gate, mode="clip")
        np.take(t_cand, x[t], axis=0, out=given, mode="clip")
        np.matmul(h, u_gate, out=part)
        gate += part
        _sigmoid(gate)
        np.matmul(h, u_cand, out=m)
        m += c
        np.multiply(m, gate[:, size:], out=cand)
        cand += given
        np.tanh(cand, out=cand)
        if tape is not None:
            tape.append((t, h, gate[:, :size].copy(), gate[:, size:].copy(), m.copy(), cand.copy()))
        new = out[t]
        np.subtract(h, cand, out=new)
        new *= gate[:, :size]
        new += cand
        if real is not None:
            new *= real[t][:, None]
        h = new
    return out


def _probabilities(net: Network, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    s = hf @ net.w["o0"]
    s += hb @ net.w["o1"]
    s += net.w["b"]
    s -= s.max(axis=-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=-1, keepdims=True)
    return s


def gradients(net: Network, x: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over real positions and its gradients, by backpropagation through time."""
    tapes: tuple[list, list] = ([], [])
    hs = [_run(net, d, x, real, tape) for d, tape in zip("01", tapes, strict=True)]
    p = _probabilities(net, *hs)
    weight = real / real.sum()
    at = (slice(None), np.arange(x.shape[1]), label)
    loss = float(-(np.log(p[at] + 1e-9) * weight).sum())
    err = p
    err[at] -= 1
    err *= weight[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in net.w.items()}
    grad["b"] = err.sum(axis=(0, 1))
    for d, hidden, tape in zip("01", hs, tapes, strict=True):
        grad["o" + d] = np.tensordot(hidden, err, ((0, 1), (0, 1)))
        from_out = err @ net.w["o" + d].T
        u, size = net.w["u" + d], net.w["c" + d].size
        later = np.zeros_like(hidden[0])
        inputs = np.empty((len(tape), x.shape[1], 3 * size), np.float32)
        for i, (t, h, z, r, m, cand) in enumerate(reversed(tape)):
            dh = (later + from_out[t]) * real[t][:, None]
            dcand = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (h - cand) * z * (1 - z)
            dm = dcand * r
            dr = dcand * m * r * (1 - r)
            gates = np.concatenate([dz, dr, dm], axis=1)
            grad["u" + d] += h.T @ gates
            grad["c" + d] += dm.sum(axis=0)
            later = dh * z + gates @ u.T
            inputs[i] = np.concatenate([dz, dr, dcand], axis=1)
        order = np.array([t for t, *_ in reversed(tape)])
        byte = x[order].ravel()
        flat = inputs.reshape(-1, 3 * size)
        by = np.argsort(byte, kind="stable")
        first = np.flatnonzero(np.r_[True, byte[by][1:] != byte[by][:-1]])
        grad["x" + d][byte[by][first]] = np.add.reduceat(flat[by], first, axis=0)
    return loss, grad


def _window_matrix(windows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (size, windows) and which of them are real."""
    lengths = np.array([len(w) for w in windows])
    flat = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in windows), np.uint8).reshape(len(windows), size)
    return np.ascontiguousarray(flat.T), np.ascontiguousarray((np.arange(size)[:, None] < lengths).astype(np.float32))


def train(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Network:
    """Fit the network on (language, window) pairs; languages weigh alike in every step."""
    langs = sorted({lang for lang, _ in samples})
    net = Network.new(langs, hidden, seed)
    if len(langs) < 2:
        return net
    x, real = _window_matrix([w for _, w in samples], TRAIN_WINDOW)
    label = np.array([langs.index(lang) for lang, _ in samples])
    members = [np.flatnonzero(label == k) for k in range(len(langs))]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(a) for k, a in net.w.items()}
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(members[k]) for k in rng.integers(0, len(langs), batch)])
        _, grad = gradients(net, x[:, pick], real[:, pick], label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))  # constant, then falling
        for k, g in grad.items():
            g = g * min(1, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.98 * v[k] + 0.02 * g * g
            net.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities of each text (texts, languages); zero for an empty text. Windows of all texts run
    side by side; memory is that of ``SIDE_BY_SIDE`` windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    begin = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    total = np.zeros((len(texts), len(net.langs)))
    for i in range(0, len(owner), SIDE_BY_SIDE):
        who, at = owner[i : i + SIDE_BY_SIDE], begin[i : i + SIDE_BY_SIDE]
        x, real = _window_matrix([texts[o][b : b + WINDOW] for o, b in zip(who, at, strict=True)], WINDOW)
        whole = bool(real.all())
        hf, hb = (_run(net, d, x, None if whole else real) for d in "01")
        p = _probabilities(net, hf, hb)
        if not whole:
            p *= real[:, :, None]
        np.add.at(total, who, p.sum(axis=0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def _fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """The bounded sample: of each language about ``SAMPLE_DOCS`` (twice as many at most) training documents, drawn by a
    hash of id and length, repeated rows once, and of each up to ``SAMPLE_WINDOWS`` windows evenly spread over the whole text."""
    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    learn = slim.where((_fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    ticket = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30))
    learn = learn.select("text", "lang", ticket.alias("ticket"))
    # repeated rows have one ticket: they are counted, and drawn, once
    counts = learn.groupBy("lang", "ticket").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    drawn = learn.join(F.broadcast(counts), "lang").where(F.col("ticket") * F.col("n") < (1 << 30) * float(SAMPLE_DOCS))
    drawn = drawn.groupBy("lang", "ticket").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("ticket"))  # of the drawn rows alone
    drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= 2 * SAMPLE_DOCS)
    data, n = F.col("text").cast("binary"), F.octet_length("text")
    places = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda k: F.floor(F.greatest(n - TRAIN_WINDOW, F.lit(0)) * k / (SAMPLE_WINDOWS - 1)).cast("int"))
    cut = F.explode(F.array_distinct(places))
    windows = drawn.select("lang", "ticket", data.alias("data"), cut.alias("at")).select("lang", "ticket", "at", F.expr(f"substring(data, at + 1, {TRAIN_WINDOW})").alias("w"))
    rows = sorted((r.lang, r.ticket, r.at, bytes(r.w)) for r in windows.collect())
    return [(lang, w) for lang, _, _, w in rows]


def _labeller(net: Network):
    names, kinds = ["lang_pred", "score"], [pa.string(), pa.float64()]

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            given = texts.to_pylist()
            use = [i for i, t in enumerate(given) if t and any(map(str.isalpha, t))] if net.langs else []
            lang, score = ["und"] * len(given), [0.0] * len(given)
            if use:
                p = document_probabilities(net, [given[i].encode() for i in use])
                for i, row in zip(use, p, strict=True):
                    best = int(row.argmax())
                    lang[i], score[i] = net.langs[best], min(1.0, float(row[best]))
            yield pa.StructArray.from_arrays([pa.array(lang, kinds[0]), pa.array(score, kinds[1])], names=names)
        give_back()

    label.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(label, "lang_pred string, score double")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no document has a language to learn
    from. With one language to learn from, that one is predicted. Null ids count as the empty text for the fold.
    Repeated rows are labelled each; an empty table gives no rows. Other columns are ignored.
    """
    arrow_rows(docs.sparkSession, 1000)
    net = train(training_windows(docs, id_col, text_col, lang_col))
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), (_fold(col(id_col)) == HELD_OUT).alias("held_out"), col(text_col).cast("string").alias("text"))
    return slim.select("doc_id", "held_out", _labeller(net)("text").alias("l")).select("doc_id", "held_out", "l.lang_pred", "l.score")


def identified_documents(docs: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows whose language is undetermined: no letter, or no language with a mean position probability
    of ``least_score``.

    Null and empty texts go; every other column, nulls and clashing names included, is kept as it is, and repeated rows
    share their verdict. Without a document to learn from all rows go; an empty table stays empty. Very long texts are
    read whole, ``SIDE_BY_SIDE`` windows at a time."""
    arrow_rows(docs.sparkSession, 1000)
    net = train(training_windows(docs, id_col, text_col, lang_col))
    name = fresh(docs, "lang")
    labelled = docs.withColumn(name, _labeller(net)(col(text_col).cast("string")))
    return labelled.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least_score)).drop(name)
