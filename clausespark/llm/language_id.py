"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read a text's bytes forwards and backwards; at every byte a softmax over both states gives
language probabilities, so every position has a label, and a document's probabilities are the mean over its
letter bytes. The gates are piecewise linear (clipped to 0..1, the candidate state to -1..1), which keeps the
pass over a large corpus cheap. The network is trained in numpy by backpropagation through time (Adam).

Upper-case A-Z share the entries of a-z; digits, ASCII punctuation and white space share one entry. Long texts
are read whole, in windows of at most ``CORE`` bytes that begin and end ``MARGIN`` bytes early and late, so
that the states have settled where positions count; windows of many documents run side by side.

Training takes a bounded sample of the labelled rows: one piece of ``PIECE`` characters, from a place that
depends on doc_id only, of at most ``PER_LANGUAGE`` documents a language, those with the smallest hash of doc_id.

Defined cases: a null text or one without letters is ``und`` with score 0; a null doc_id is neither held out nor
learned from; with no labelled row every text is ``und``; repeated rows get equal results; an empty table gives
an empty result; added columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark.llm.common import own_columns, unit_hash
from clausespark.session import ship_package

HIDDEN = 12
CORE, MARGIN = 256, 8
SIDE_BY_SIDE = 2048
PER_LANGUAGE = 600
PIECE = 220
STEPS, BATCH, SPAN, RATE = 300, 96, 64, 0.015
UNDETERMINED = "und"
LETTER = r"\p{L}"


def _symbols() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


SYMBOL = _symbols()
IS_LETTER = SYMBOL != 32


@dataclass
class Network:
    """Parameters: per direction the byte table (256, 3H) and the recurrence (H, 3H); output (2H, L) and bias (L)."""

    languages: list[str]
    table_f: np.ndarray
    table_b: np.ndarray
    recur_f: np.ndarray
    recur_b: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    NAMES = ("table_f", "table_b", "recur_f", "recur_b", "out", "bias")

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        n = len(languages)
        return cls(languages, draw(256, 3 * hidden, scale=0.4), draw(256, 3 * hidden, scale=0.4), draw(hidden, 3 * hidden, scale=0.25), draw(hidden, 3 * hidden, scale=0.25), draw(2 * hidden, n, scale=0.2), np.zeros(n, dtype=np.float32))


def _read(table: np.ndarray, recur: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) over symbols (T, B); ``keep`` collects what the backward pass needs."""
    steps, batch = x.shape
    h = recur.shape[0]
    # the gates' line 0.25 a + 0.5 is put into the parameters; each gate has arrays of its own, which are contiguous
    tables = [np.ascontiguousarray(table[:, k * h:(k + 1) * h] * (0.25, 0.25, 1)[k] + (0.5, 0.5, 0)[k], dtype=table.dtype) for k in range(3)]
    recurs = [np.ascontiguousarray(recur[:, k * h:(k + 1) * h] * (0.25, 0.25, 1)[k], dtype=table.dtype) for k in range(3)]
    states = np.empty((steps, batch, h), dtype=table.dtype)
    state = np.zeros((batch, h), dtype=table.dtype)
    z, r, c, rec = (np.empty((batch, h), dtype=table.dtype) for _ in range(4))
    for t in range(steps):
        for gate, entries, weights in ((z, tables[0], recurs[0]), (r, tables[1], recurs[1])):
            np.take(entries, x[t], axis=0, out=gate, mode="clip")
            np.matmul(state, weights, out=rec)
            gate += rec
            np.clip(gate, 0, 1, out=gate)
        np.take(tables[2], x[t], axis=0, out=c, mode="clip")
        np.matmul(state, recurs[2], out=rec)
        if keep is not None:
            kept = rec.copy()
        rec *= r
        c += rec
        np.clip(c, -1, 1, out=c)
        if keep is not None:
            keep.append((z.copy(), r.copy(), c.copy(), kept, state))
        step = states[t]
        np.subtract(state, c, out=step)
        step *= z
        step += c
        state = step
    return states


def _unread(recur: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the gate inputs (T, B, 3H) and of the recurrence."""
    steps, batch, h = d_states.shape
    d_gates, d_recur = np.empty((steps, batch, 3 * h), dtype=recur.dtype), np.zeros_like(recur)
    d = np.zeros((batch, h), dtype=recur.dtype)
    for t in reversed(range(steps)):
        z, r, c, rec, before = kept[t]
        d = d + d_states[t]
        d_c = d * (1 - z) * (np.abs(c) < 1)
        d_z = d * (before - c) * 0.25 * ((z > 0) & (z < 1))
        d_r = d_c * rec * 0.25 * ((r > 0) & (r < 1))
        d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_rec = np.concatenate([d_z, d_r, d_c * r], axis=1)
        d_recur += before.T @ d_rec
        d = d * z + d_rec @ recur.T
    return d_gates, d_recur


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(L, T, B) for symbols (T, B)."""
    h = net.recur_f.shape[0]
    p = net.out[:h].T @ _read(net.table_f, net.recur_f, x).reshape(-1, h).T
    back = net.out[h:].T @ _read(net.table_b, net.recur_b, x[::-1]).reshape(-1, h).T
    p = p.reshape(-1, *x.shape)
    p += back.reshape(p.shape)[:, ::-1]
    p += net.bias[:, None, None]
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p


def loss_and_gradients(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the letter positions of pieces (T, B) with one label each, and its gradients."""
    h = net.recur_f.shape[0]
    kept_f, kept_b = [], []
    f, b = _read(net.table_f, net.recur_f, x, kept_f), _read(net.table_b, net.recur_b, x[::-1], kept_b)[::-1]
    states = np.concatenate([f, b], axis=2)
    p = _softmax(states @ net.out + net.bias)
    counts = IS_LETTER[x][..., None].astype(p.dtype)
    total = max(1.0, float(counts.sum()))
    wanted = np.eye(p.shape[2], dtype=p.dtype)[label]
    loss = -float((np.log(np.maximum((p * wanted).sum(axis=2), 1e-12)) * counts[..., 0]).sum()) / total
    d = (p - wanted) * counts / total
    grads = {"out": np.tensordot(states, d, axes=([0, 1], [0, 1])), "bias": d.sum(axis=(0, 1))}
    d_states = d @ net.out.T
    for name, kept, xs, ds in (("f", kept_f, x, d_states[..., :h]), ("b", kept_b, x[::-1], d_states[::-1, :, h:])):
        d_gates, grads[f"recur_{name}"] = _unread(getattr(net, f"recur_{name}"), kept, ds)
        hot = np.zeros((xs.size, 256), dtype=d_gates.dtype)
        hot[np.arange(xs.size), xs.ravel()] = 1
        grads[f"table_{name}"] = hot.T @ d_gates.reshape(xs.size, -1)
    return loss, grads


def train(pieces: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 0) -> Network | None:
    """Train on pieces of text; every language is drawn equally often. None if there is nothing to learn from."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net, rng = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    code = np.array([languages.index(x) for x in labels])
    by_language = [np.flatnonzero(code == k) for k in range(len(languages))]
    symbols = [SYMBOL[np.frombuffer(p, dtype=np.uint8)] for p in pieces]
    first = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    second = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    for step in range(1, steps + 1):
        rows = np.array([rng.choice(by_language[k]) for k in rng.integers(len(languages), size=BATCH)])
        x = np.full((SPAN, BATCH), 32, dtype=np.uint8)
        for j, i in enumerate(rows):
            at = rng.integers(max(1, len(symbols[i]) - SPAN + 1))
            got = symbols[i][at:at + SPAN]
            x[:len(got), j] = got
        _, grads = loss_and_gradients(net, x, code[rows])
        rate = RATE * (1 - 0.9 * step / steps)
        for n, g in grads.items():
            g = np.clip(g, -1, 1)
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.01 * (g * g - second[n])
            move = rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-8)
            setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    return net


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into near-equal windows of at most CORE bytes: (text, begin, length) of each."""
    n = -(-lengths // CORE)
    text = np.repeat(np.arange(len(lengths)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = place * lengths[text] // n[text]
    return text, begin, (place + 1) * lengths[text] // n[text] - begin


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, L): mean language probabilities over the letter bytes of each whole text; 0 if it has none."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    stream = SYMBOL[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    offset = np.cumsum(sizes) - sizes
    text, begin, length = windows(sizes)
    order = np.argsort(length, kind="stable")
    sums, counts = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    for i in range(0, len(order), SIDE_BY_SIDE):
        rows = order[i:i + SIDE_BY_SIDE]
        place = np.arange(-MARGIN, int(length[rows].max()) + MARGIN)[:, None]
        inside = begin[rows] + place  # place within the text
        x = np.full(inside.shape, 32, dtype=np.uint8)
        real = (inside >= 0) & (inside < sizes[text[rows]])
        x[real] = stream[(offset[text[rows]] + inside)[real]]
        p = position_probabilities(net, x)
        counted = (place >= 0) & (place < length[rows]) & IS_LETTER[x]
        p *= counted
        np.add.at(sums, text[rows], p.sum(axis=1).T)
        np.add.at(counts, text[rows], counted.sum(axis=0))
    return sums / np.maximum(counts, 1)[:, None]


def label_positions(net: Network, text: str) -> list[str]:
    """The language of every byte of one text."""
    x = SYMBOL[np.frombuffer(text.encode(), dtype=np.uint8)][:, None]
    return [net.languages[k] for k in position_probabilities(net, x)[:, :, 0].argmax(axis=0)] if len(x) else []


def held_out() -> Column:
    """Whether a document is kept for testing: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """Pieces and labels of at most ``per_language`` documents a language, none held out."""
    t = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = {r["lang"]: r["n"] for r in t.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * per_language / n))])
    t = t.withColumn("u", unit_hash("doc_id", seed=11)).filter(F.col("u") <= share[F.col("lang")])
    at = F.floor(unit_hash("doc_id", seed=12) * F.greatest(F.lit(1), F.length("text") - PIECE)).cast("int") + 1
    t = t.select("lang", "u", "doc_id", F.substring("text", at, F.lit(PIECE)).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "piece"))
    got = t.withColumn("rank", rank).filter(F.col("rank") <= per_language).orderBy("lang", "rank").collect()
    return [r["piece"].encode() for r in got], [r["lang"] for r in got]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    out = ("lang_pred", "score")
    kept = own_columns(docs, *out)
    if net is None:
        return docs.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    ship_package(docs.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*net.languages, UNDETERMINED], dtype=object)
        for texts in batches:
            p = pooled(net, [(x or "").encode() for x in texts])
            best, none = p.argmax(axis=1), p.sum(axis=1) == 0
            yield pd.DataFrame({"lang": names[np.where(none, len(net.languages), best)], "score": np.where(none, 0.0, np.clip(p.max(axis=1), 0, 1))})

    has_letters = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    t = docs.select(*kept, predict(F.when(has_letters, F.col("text"))).alias("__p"))
    return t.select(*kept, F.coalesce("__p.lang", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("__p.score", F.lit(0.0)).alias("score"))


def fit(docs: DataFrame) -> Network | None:
    return train(*training_sample(docs))


def keep_identified(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` without those whose language is undetermined."""
    return identify(docs, net).filter(F.col("lang_pred") != UNDETERMINED).select(*own_columns(docs, "lang_pred", "score"))
