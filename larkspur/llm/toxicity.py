"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals score documents.

Fitting takes a bounded sample of labelled documents (``max_per_class`` of either label, in
the order of a hash of the id) to the driver. From their document frequencies come log-odds for words and word
beginnings; words of toxic documents with high log-odds are the labelled tokens. The field has two tags, the log-odds
as features of a token, and weights for neighbouring tags; all are fitted by gradient ascent on the
conditional likelihood. A logistic curve over the expected number of toxic words, their density and the highest
marginal, fitted to the labels, gives the document score.

Scoring is a map over all rows: forward and backward passes run over whole documents, many
side by side. Only words are read, never labels, lang, source or ids.

Defined cases: null and empty texts are scored, as documents without a word; repeated rows get equal
scores; without labelled rows of both kinds the score is the share of toxic ones (1/2 without
labels); an empty table gives an empty result. Labels that are null are no labels.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrays import U, Prefix, portions, spans

#: Beginnings of so many bytes are features besides the word; 0 is the word.
BEGINNINGS = (0, 4, 5, 6, 7, 8)
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Table:
    """64-bit keys to numbers, looked up in bulk; a key has one of four slots."""

    keys: np.ndarray
    values: np.ndarray
    bits: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys))))) + 3)
        while True:
            t = cls(np.zeros((1 << bits) + 4, U), np.zeros((1 << bits) + 4, np.float32), bits)
            if t._fill(keys, values):
                return t
            bits += 1

    def _fill(self, keys, values) -> bool:
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            at = k >> (64 - self.bits)
            free = [p for p in range(at, at + 4) if not self.keys[p]]
            if not free:
                return False
            self.keys[free[0]], self.values[free[0]] = k, v
        return True

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        out = np.zeros(len(keys), np.float32)
        left = np.arange(len(keys))
        for p in range(4):
            held = self.keys[at[left] + p]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]] + p]
            left = left[~hit & (held != 0)]
            if not len(left):
                break
        return out


def token_keys(data: np.ndarray, offsets: np.ndarray):
    """Words of letters and digits in lower case: per feature their keys, then starts, ends, offsets by document."""
    upper = (data >= 65) & (data <= 90)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)  # Latin-1 capitals in UTF-8
    starts, ends, by_doc = spans(_LETTER[data], offsets)
    prefix = Prefix(np.where(upper, data + np.uint8(32), data))
    keys = []
    for k, n in enumerate(BEGINNINGS):
        h = prefix.hashes(starts, np.minimum(starts + n, ends) if n else ends)
        keys.append(np.maximum(h ^ U(k * 0x51ED270B), U(1)))
    return keys, starts, ends, by_doc


@dataclass
class Model:
    tables: list[Table] = field(default_factory=list)
    theta: np.ndarray | None = None  # features of a token -> how much more tag 1 weighs
    moves: np.ndarray | None = None  # (from, to)
    curve: np.ndarray | None = None
    prior: float = 0.5

    def features(self, keys: list[np.ndarray]) -> np.ndarray:
        x = np.stack([t.get(k) for t, k in zip(self.tables, keys, strict=True)], axis=1)
        return np.concatenate([np.ones((len(x), 1), np.float32), x, x.max(axis=1, keepdims=True)], axis=1)

    def marginals(self, data, offsets):
        keys, starts, ends, by_doc = token_keys(data, offsets)
        return forward_backward(self.features(keys) @ self.theta, self.moves, by_doc)[0], starts, ends, by_doc

    def scores(self, p: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, by_doc) @ self.curve, -30, 30)))


def summary(p: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """Per document: 1, log of expected toxic words, their log density, highest marginal."""
    n = np.diff(by_doc)
    total = np.diff(np.concatenate(([0.0], np.cumsum(p, dtype=np.float64)))[by_doc])
    top = np.zeros(len(n))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, by_doc[:-1][some])
    total = np.maximum(total, 0)
    return np.stack([np.ones(len(n)), np.log(total + 0.02), np.log((total + 0.02) / (n + 20.0)), top], axis=1)


def forward_backward(score: np.ndarray, moves: np.ndarray, by_doc: np.ndarray, pairs: bool = False):
    """Marginals of tag 1 per token (score: log weight of tag 1 over tag 0) and, if asked, the
    expected moves between tags and the log partition functions' sum. Documents go side by side, longest first."""
    n = np.diff(by_doc)
    order = np.argsort(-n, kind="stable")
    first, n = by_doc[:-1][order], n[order]
    m = np.exp(moves)
    e = np.exp(np.clip(score.astype(np.float64), -30, 30))
    alpha = np.zeros((len(score), 2))
    scale = np.ones(len(score))
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), "left")  # documents longer than t
    a = None
    for t in range(longest):
        at = first[: active[t]] + t
        if t == 0:
            b0, b1 = np.ones(len(at)), e[at]
        else:
            a = a[: active[t]]
            b0 = a[:, 0] * m[0, 0] + a[:, 1] * m[1, 0]
            b1 = (a[:, 0] * m[0, 1] + a[:, 1] * m[1, 1]) * e[at]
        c = b0 + b1
        a = np.stack([b0 / c, b1 / c], axis=1)
        alpha[at], scale[at] = a, c
    beta = np.ones((len(score), 2))
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        nxt = beta[at + 1]
        w1, c = nxt[:, 1] * e[at + 1], scale[at + 1]
        w0 = nxt[:, 0]
        beta[at, 0] = (m[0, 0] * w0 + m[0, 1] * w1) / c
        beta[at, 1] = (m[1, 0] * w0 + m[1, 1] * w1) / c
        if pairs:
            al = alpha[at]
            expected += m * np.array([[(al[:, i] * w / c).sum() for w in (w0, w1)] for i in (0, 1)])
    p = alpha[:, 1] * beta[:, 1]
    p = p / np.maximum(p + alpha[:, 0] * beta[:, 0], 1e-300)
    return p, expected, float(np.log(scale).sum())


def _climb(w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    """Gradient ascent with step sizes by the gradients' running moments."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def fit(texts: list[str], toxic: list[int], *, share: float | None = None, min_documents: int = 3, odds: float = 2.5, max_tagged: int = 300) -> Model:
    """Log-odds and curve from all given texts, the field from the first ``max_tagged`` of either label.
    share: of toxic documents where the model is used; None: as in the texts."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 0.5)
    parts, counts = [], []
    for _, data, offsets in portions(pa.array(texts, pa.large_string())):  # the driver holds the keys of tokens, not what it takes to find them
        k, _, _, at = token_keys(data, offsets)
        parts.append(k)
        counts.append(np.diff(at))
    keys = [np.concatenate(k) for k in zip(*parts, strict=True)]
    by_doc = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    del parts
    doc = np.repeat(np.arange(len(y)), np.diff(by_doc))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    tables = []
    for k in keys:
        order = np.lexsort((doc, k))
        new = np.ones(len(k), bool)
        new[1:] = (k[order][1:] != k[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        once = order[new]  # a key and document
        key, at = np.unique(k[once], return_inverse=True)
        in1 = np.bincount(at, y[doc[once]], len(key))
        in0 = np.bincount(at, 1 - y[doc[once]], len(key))
        logs = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
        # As sure as the counts make it: the log-odds less one deviation, on their own side of 0.
        sure = np.sign(logs) * np.maximum(np.abs(logs) - np.sqrt(1 / (in1 + 0.5) + 1 / (in0 + 0.5)), 0)
        use = (in1 + in0 >= min_documents) & (np.abs(sure) > 0.2)
        tables.append(Table.of(key[use], sure[use]))
    model = Model(tables=tables)
    x = model.features(keys)
    least = min(odds, 0.6 * float(x[:, -1].max()))
    tagged = np.concatenate([np.flatnonzero(y == c)[:max_tagged] for c in (0, 1)])
    every, all_by_doc = x, by_doc
    rows = np.concatenate([np.arange(by_doc[d], by_doc[d + 1]) for d in tagged])
    by_doc = np.concatenate(([0], np.cumsum(np.diff(by_doc)[tagged])))
    x, doc = x[rows], doc[rows]
    x64 = x.astype(np.float64)
    tags = ((y[doc] == 1) & (x[:, -1] >= least)).astype(np.float64)
    t = tags.astype(int)
    inner = np.ones(len(t), bool)
    inner[by_doc[:-1][np.diff(by_doc) > 0]] = False
    held = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(held, (t[at - 1], t[at]), 1)
    width = x.shape[1]

    def gradient(w):
        p, expected, _ = forward_backward(x64 @ w[:width], w[width:].reshape(2, 2), by_doc, pairs=True)
        g = np.concatenate([x64.T @ (tags - p), (held - expected).ravel()])
        return g / max(1.0, tags.sum()) - 1e-3 * w

    w = _climb(np.concatenate([[-3.0], np.full(width - 1, 0.3), np.zeros(4)]), gradient, 50, 0.15)
    model.theta, model.moves = w[:width], w[width:].reshape(2, 2)
    p = forward_backward(every @ model.theta, model.moves, all_by_doc)[0]
    z = summary(p, all_by_doc)
    share = n1 / len(y) if share is None else min(max(share, 0.01), 0.99)
    balance = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)

    def slope(c):
        q = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        return z.T @ (balance * (y - q)) / len(y) - 1e-4 * c

    model.curve = _climb(np.zeros(z.shape[1]), slope, 800, 0.1)
    return model


def fit_tables(docs: DataFrame, labels: DataFrame, *, max_per_class: int = 1000) -> Model:
    """Fits on at most ``max_per_class`` labelled documents of either label whose crc32(doc_id) mod 5 isn't 0."""
    chosen = labels.select("doc_id", F.col("toxic").alias("y")).filter(F.col("y").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)).distinct()
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = chosen.filter("y = 1").orderBy(*by_hash).limit(max_per_class).union(chosen.filter("y = 0").orderBy(*by_hash).limit(max_per_class))
    ids = sample.collect()  # 2 * max_per_class rows at most
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in ids], "doc_id long, y int")
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").collect()
    found = sorted({(zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or "", r["y"]) for r in found})
    share = chosen.agg(F.avg("y")).first()[0]
    return fit([r[2] for r in found], [r[3] for r in found], share=share)


def toxicity(docs: DataFrame, model: Model, *, offending: float = 0.5) -> DataFrame:
    """Per row: doc_id, score, n_toxic (words above ``offending``), spans [(start, end)] of
    those words as byte offsets in the UTF-8 text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        m = shipped.value
        for b in batches:
            for i, data, offsets in portions(b.column(1), 4 << 20):
                n = len(offsets) - 1
                keys = b.column(0).slice(i, n)
                if m.curve is None:
                    score, at = np.full(n, m.prior), [[] for _ in range(n)]
                else:
                    p, starts, ends, by_doc = m.marginals(data, offsets)
                    score = m.scores(p, by_doc)
                    hit = np.flatnonzero(p >= offending)
                    at = [[] for _ in range(n)]
                    of = np.searchsorted(by_doc, hit, "right") - 1
                    for d, s, e in zip(of.tolist(), (starts[hit] - offsets[of]).tolist(), (ends[hit] - offsets[of]).tolist(), strict=True):
                        at[d].append({"start": s, "end": e})
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(score), pa.array([len(x) for x in at], pa.int32()), pa.array(at, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "score", "n_toxic", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_toxic int, spans array<struct<start: long, end: long>>")


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below the threshold. All rows, where
    labels didn't suffice to fit a curve: the prior tells nothing of a text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shipped.value
        for b in batches:
            for i, data, offsets in portions(b.column(at), 4 << 20):
                n = len(offsets) - 1
                if m.curve is None:
                    yield b.slice(i, n)
                    continue
                p, _, _, by_doc = m.marginals(data, offsets)
                yield b.slice(i, n).filter(pa.array(m.scores(p, by_doc) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
