"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (lines, long ones cut every ``passage_words`` words).
Every passage is encoded from shares of character classes and repeated words; gated
attention weighs the passages, and the weighted sum gives the score. Only documents are
labelled: encoder, attention and score are fitted together by their likelihood.

The fit uses at most ``labelled_docs`` labelled documents, those with the smallest hash
of their id, and runs in one task. Scoring is one pass over whole texts without a shuffle.

Labels are learnt only from rows whose crc32 of the id as text is not divisible by five. A
null id counts as held out. Null and empty texts are one passage without words.
Repeated rows get equal scores; of repeated labels each is a row of its own. Without
labels of both kinds the score is the share of label 1, or one half. Columns of
documents other than ``text`` (and ``doc_id`` to find labels) are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._text import SOLID, _word_hashes, chunks, clean, map_frames, text_batches

PASSAGE_WORDS = 64
LABELLED_DOCS = 8_000
THRESHOLD = 0.3
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 24, 64, 0.01, 1e-4, 5

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r\n", "#$%&*", "|", "!", ".?", ",;:", "'\"()[]{}<>=/\\+-_@^~`"]
_KIND = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _KIND[list(_c.encode())] = _i
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Distances at which a word may repeat.
_LAGS = (1, 2, 3, 4, 6)
FEATURES = len(_CLASSES) + 1 + len(_LAGS) + 3


def passages(texts: list, passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, index of each text's first passage and the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = SOLID[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    new_line = np.ones(len(start), bool)
    new_line[1:] = line[1:] != line[:-1]
    at = np.arange(len(start))
    in_line = at - np.maximum.accumulate(np.where(new_line, at, 0))
    begin = np.flatnonzero(in_line % passage_words == 0)
    first = np.searchsorted(start[begin], offsets)
    out = np.zeros((len(begin), FEATURES))
    if len(begin):
        stop = np.append(begin[1:], len(start)) - 1
        size = end[stop] - start[begin]
        which = np.repeat(np.arange(len(begin)), size)
        byte = np.repeat(start[begin] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        n_kinds = len(_CLASSES) + 1
        kinds = np.bincount(which * n_kinds + _KIND[data[byte]], minlength=len(begin) * n_kinds).reshape(len(begin), n_kinds)
        out[:, :n_kinds] = kinds / size[:, None]
        words = stop - begin + 1
        hashes = _word_hashes(_FOLD[data[inside]], end - start)
        passage = np.repeat(np.arange(len(begin)), words)
        for j, lag in enumerate(_LAGS):
            same = np.zeros(len(hashes), bool)
            same[lag:] = (hashes[lag:] == hashes[:-lag]) & (passage[lag:] == passage[:-lag])
            out[:, n_kinds + j] = np.add.reduceat(same.astype(np.int64), begin) / words
        out[:, -3] = np.log1p(words)
        out[:, -2] = size / words / 10
        out[:, -1] = _KIND[data[start]][begin] == 1
    empty = np.flatnonzero(first[1:] == first[:-1])
    if len(empty):  # a text without words is one passage of zeros
        out = np.insert(out, first[empty], 0.0, axis=0)
        first = first + np.searchsorted(empty, np.arange(len(first)))
    return out, first


class Model:
    """Encoder, gated attention and score; ``fit`` by Adam on whole bags."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.p = {
            "encode": rng.normal(size=(len(mean), HIDDEN)) / np.sqrt(len(mean)),
            "shift": np.zeros(HIDDEN),
            "tanh": rng.normal(size=(HIDDEN, GATES)) / np.sqrt(HIDDEN),
            "gate": rng.normal(size=(HIDDEN, GATES)) / np.sqrt(HIDDEN),
            "weigh": rng.normal(size=GATES) / np.sqrt(GATES),
            "score": np.zeros(HIDDEN),
            "base": np.array(np.log(prior / (1 - prior))),
        }

    def _forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, begin = self.p, first[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        e = np.tanh(x @ p["encode"] + p["shift"])
        t, g = np.tanh(e @ p["tanh"]), 1 / (1 + np.exp(-(e @ p["gate"])))
        s = (t * g) @ p["weigh"]
        bag = np.repeat(np.arange(len(begin)), np.diff(first))
        a = np.exp(s - np.maximum.reduceat(s, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * e, begin)
        return x, e, t, g, bag, a, z, 1 / (1 + np.exp(-(z @ p["score"] + p["base"])))

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every bag."""
        return self._forward(x, first)[-1]

    def _gradients(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, begin = self.p, first[:-1]
        x, e, t, g, bag, a, z, y = self._forward(x, first)
        dy = (y - label) / len(label)
        dz = np.outer(dy, p["score"])[bag]
        da = (e * dz).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, begin)[bag])
        dtg = np.outer(ds, p["weigh"])
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        de = (a[:, None] * dz + dt @ p["tanh"].T + dg @ p["gate"].T) * (1 - e * e)
        out = {"encode": x.T @ de, "shift": de.sum(axis=0), "tanh": e.T @ dt, "gate": e.T @ dg, "weigh": (t * g).T @ ds, "score": z.T @ dy, "base": dy.sum()}
        return {k: v + DECAY * p[k] for k, v in out.items()}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        step = 0
        steps = EPOCHS * -(-len(label) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for lo in range(0, len(order), BATCH):
                bags = order[lo : lo + BATCH]
                rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
                size = first[bags + 1] - first[bags]
                grads = self._gradients(x[rows], np.concatenate([[0], np.cumsum(size)]), label[bags])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k, gradient in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * gradient
                    v[k] = 0.999 * v[k] + 0.001 * gradient**2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, sizes, label = [], [], []
        for b in batches:
            texts = clean(b["text"])
            for lo, hi in chunks(texts):
                x, first = passages(texts[lo:hi])
                found.append(x)
                sizes.append(np.diff(first))
                label.append(b["quality"].iloc[lo:hi].to_numpy(np.float64))
        if not label:
            yield pd.DataFrame({"model": [pickle.dumps(Model(np.zeros(FEATURES), np.ones(FEATURES), 0.5))]})
            return
        x, first, y = np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(label)
        model = Model(x.mean(axis=0), x.std(axis=0) + 0.01, float(np.clip(y.mean(), 0.001, 0.999)))
        yield pd.DataFrame({"model": [pickle.dumps(model.fit(x, first, y) if 0 < y.sum() < len(y) else model)]})

    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most labelled_docs rows of two numbers
    sample = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_docs)
    row = map_frames(sample.coalesce(1), fit, "model binary").first()
    return pickle.loads(bytes(row["model"])) if row else Model(np.zeros(FEATURES), np.ones(FEATURES), 0.5)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = clean(b["text"])
            found = [model.scores(*passages(texts[lo:hi])) for lo, hi in chunks(texts)]
            yield b.assign(**{name: np.concatenate(found) if found else np.zeros(0)})

    text_batches(docs.sparkSession)
    return map_frames(docs, score, StructType([*docs.drop(name).schema.fields, StructField(name, DoubleType())]))
