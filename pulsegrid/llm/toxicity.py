"""Toxicity classifier with a counterfactual penalty.

A document is its sentences, and it is toxic if any of them is: its score is one minus the
product of its sentences' probabilities of being harmless. A sentence's logit is the sum of weights of
its words and of their beginnings of 4, 5 and 6 bytes, found by hash. Weights are fitted to the
documents' labels by likelihood, and besides, for every labelled sentence with an identity
term (a word that names a group of people), the term is swapped for another of its kind and
the squared change of the sentence's logit is a cost. So a group that labelled insults often
mention does not become a sign of toxicity by itself, and neutral mentions of it score as
neutral mentions of any other group do.

The fit uses at most ``labelled_docs`` labelled documents, those with the smallest hash of their
id, and runs in one task, which takes at most ``labelled_bytes`` of their texts, in that order.
Scoring is one pass over whole texts without a shuffle.

Labels are learnt only from rows whose crc32 of the id as text leaves another remainder than 2
by four. A null id counts as held out. Null and empty texts are one sentence without words.
Sentences end at ``.``, ``!``, ``?`` or a line's end, and after 64 words. Repeated rows get equal
scores; of repeated labels each is a row of its own. Without labels of both kinds the score is the
share of label 1, or one half. Columns of documents other than ``text`` (and ``doc_id`` to
find labels) are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._text import _BYTE_VALUES, _STEP, ALNUM, chunks, clean, map_frames, mix, text_batches

LABELLED_DOCS, LABELLED_BYTES = 8_000, 64 << 20
THRESHOLD = 0.3
BEGINNINGS, SENTENCE_WORDS = (4, 5, 6), 64
LEAST_DOCS, LEAST_SIGNS, TRUST = 5, 4.0, 0.7
STEPS, RATE, DECAY, PENALTY = 200, 0.1, 1e-4, 4.0

# Words that name groups of people, by kind. A swap stays inside a line.
IDENTITY_TERMS = (
    "women men girls boys",
    "woman man girl boy",
    "muslims christians jews hindus buddhists atheists catholics",
    "muslim christian jewish hindu buddhist atheist catholic",
    "gay lesbian bisexual straight transgender",
    "black white asian latino african european arab",
    "immigrants refugees foreigners locals natives",
    "disabled blind deaf elderly young",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus buddhisten atheisten",
    "schwarze weiße asiaten afrikaner europäer araber",
    "einwanderer flüchtlinge ausländer einheimische",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "noirs blancs asiatiques africains européens arabes",
    "immigrés réfugiés étrangers habitants",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "negros blancos asiáticos africanos europeos árabes",
    "inmigrantes refugiados extranjeros vecinos",
)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


class Sentences(NamedTuple):
    word: np.ndarray  # hash of every word
    feature: np.ndarray  # hashes of all words' features, word after word
    each: np.ndarray  # index of every word's first feature, and the end
    sentence: np.ndarray  # index of every sentence's first word, and the end
    text: np.ndarray  # index of every text's first sentence, and the end


def sentences(texts: Sequence[str | None]) -> Sentences:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    folded = _FOLD[data]
    inside = ALNUM[folded]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    n = len(start)

    # sentences: words with no end between them, cut every SENTENCE_WORDS
    ended = np.searchsorted(np.flatnonzero(_ENDS[data]), start)
    new = np.ones(n, bool)
    new[1:] = ended[1:] != ended[:-1]
    at = np.arange(n)
    inner = at - np.maximum.accumulate(np.where(new, at, 0)) if n else at
    sentence = np.flatnonzero(inner % SENTENCE_WORDS == 0)
    text = np.searchsorted(start[sentence], offsets)
    sentence = np.append(sentence, n)
    empty = np.flatnonzero(text[1:] == text[:-1])
    if len(empty):  # a text without words is one sentence without words
        sentence = np.insert(sentence, text[empty], sentence[text[empty]])
        text = text + np.searchsorted(empty, np.arange(len(text)))

    # hashes of words and of their beginnings from one running sum
    length = end - start
    letters = folded[inside]
    begin = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(begin, length)
    powers = np.multiply.accumulate(np.full(int(length.max()) if n else 0, _STEP | np.uint64(1), np.uint64))
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[letters] * powers[place], out=total[1:])
    first = lambda m: mix(total[begin + m] - total[begin] + m.astype(np.uint64) * _STEP)
    word = first(length)
    count = 1 + sum((length > m).astype(np.int64) for m in BEGINNINGS)
    each = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=each[1:])
    feature = np.empty(int(each[-1]), np.uint64)
    feature[each[:-1]] = word
    for j, m in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(length > m)
        feature[each[long] + j] = mix(total[begin[long] + m] - total[begin[long]] + np.uint64(m * 2654435761))
    return Sentences(word, feature, each, sentence, text)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums between edges, empty ranges included; what surrounds a range does not change its sum."""
    size = np.diff(edges)
    return np.bincount(np.repeat(np.arange(len(size)), size), values, len(size))


class Swaps(NamedTuple):
    """Labelled sentences' changes under a swap: features lost and gained, by swap."""

    owner: np.ndarray  # the swap of every entry
    feature: np.ndarray
    sign: np.ndarray
    n: int


def swaps(s: Sentences, kinds: Sequence[str] = IDENTITY_TERMS) -> Swaps:
    """Every sentence with identity terms, each term swapped for the next of its kind (by a turn that the sentence sets)."""
    terms = [line.split() for line in kinds]
    names = sorted({t for line in terms for t in line})
    known = sentences([" ".join(names)] if names else [])
    place = {t: i for i, t in enumerate(names)}
    kind = {int(known.word[place[t]]): (line, i) for line in terms if len(line) > 1 for i, t in enumerate(line)}
    hits = np.flatnonzero(np.isin(s.word, np.array(list(kind), np.uint64))) if kind else np.zeros(0, np.int64)
    where = np.searchsorted(s.sentence, hits, "right") - 1
    owner, feature, sign, last, n = [], [], [], -1, 0
    for word, at in zip(hits.tolist(), where.tolist()):
        n += at != last
        last = at
        line, i = kind[int(s.word[word])]
        other = place[line[(i + 1 + at % (len(line) - 1)) % len(line)]]
        for features, by in ((s.feature[s.each[word] : s.each[word + 1]], -1.0), (known.feature[known.each[other] : known.each[other + 1]], 1.0)):
            owner += [n - 1] * len(features)
            feature += features.tolist()
            sign += [by] * len(features)
    return Swaps(np.array(owner, np.int64), np.array(feature, np.uint64), np.array(sign), n)


class Model:
    """Weights of features, by the features' hashes, and a base; ``fit`` by Adam on the features that tell the labels apart."""

    def __init__(self, prior: float):
        self.prior, self.fitted = prior, False
        self.hashes, self.weights, self.base = np.zeros(0, np.uint64), np.zeros(0), 0.0

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which features have a weight, and its place."""
        at = np.searchsorted(self.hashes, features)
        held = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == features) if len(self.hashes) else np.zeros(0, np.int64)
        return held, at[held]

    def scores(self, s: Sentences) -> np.ndarray:
        if not self.fitted:
            return np.full(len(s.text) - 1, self.prior)
        held, at = self.find(s.feature)
        logit = np.bincount(owners(s)[held], self.weights[at], len(s.sentence) - 1) + self.base
        return -np.expm1(np.minimum(_sums(-np.logaddexp(0, logit), s.text), 0.0))

    def fit(self, s: Sentences, label: np.ndarray, kinds: Sequence[str] = IDENTITY_TERMS, penalty: float = PENALTY) -> Model:
        swap = swaps(s, kinds)
        self.hashes, odds = telling(s, label)
        start = TRUST * odds
        entry, slot = self.find(s.feature)
        owner = owners(s)[entry]
        kept, at = self.find(swap.feature)
        swap = Swaps(swap.owner[kept], at, swap.sign[kept], swap.n)
        weights = np.append(start, -np.log(len(s.sentence) / max(label.sum(), 1)))  # the last is the base
        m, v = np.zeros(len(weights)), np.zeros(len(weights))
        for step in range(1, STEPS + 1):
            grad = gradient(weights, start, slot, owner, s.text, label, swap, penalty)
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            weights = weights - RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.base, self.fitted = weights[:-1], float(weights[-1]), True
        return self


def owners(s: Sentences) -> np.ndarray:
    """The sentence of every feature."""
    return np.repeat(np.arange(len(s.sentence) - 1), np.diff(s.each[s.sentence]))


def telling(s: Sentences, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of features that LEAST_DOCS texts or more hold, and label 1 more or less often than chance by LEAST_SIGNS deviations; their log-odds."""
    hashes, code = np.unique(s.feature, return_inverse=True)
    text = np.repeat(np.arange(len(s.text) - 1), np.diff(s.each[s.sentence[s.text]]))
    held = np.unique(text * len(hashes) + code)
    code, share = held % max(len(hashes), 1), label.mean()
    n = np.bincount(code, minlength=len(hashes))
    toxic = np.bincount(code, label[held // max(len(hashes), 1)], len(hashes))
    told = (n >= LEAST_DOCS) & (np.abs(toxic - share * n) >= LEAST_SIGNS * np.sqrt(share * (1 - share) * n))
    odds = np.log((toxic[told] + 0.5) / (n[told] - toxic[told] + 0.5) * (1 - share) / share)
    return hashes[told], odds


def objective(weights: np.ndarray, start: np.ndarray, slot: np.ndarray, owner: np.ndarray, text: np.ndarray, label: np.ndarray, swap: Swaps, penalty: float) -> float:
    """Mean negative log-likelihood, decay towards the log-odds each feature has by itself, and the mean squared change under swaps."""
    logit = np.bincount(owner, weights[slot], text[-1]) + weights[-1]
    harmless = _sums(-np.logaddexp(0, logit), text)
    likelihood = np.where(label > 0, np.log(np.maximum(-np.expm1(harmless), 1e-12)), harmless)
    change = np.bincount(swap.owner, weights[swap.feature] * swap.sign, swap.n)
    return float(-likelihood.mean() + DECAY / 2 * ((weights[:-1] - start) ** 2).sum() + (penalty * (change**2).mean() if swap.n else 0.0))


def gradient(weights: np.ndarray, start: np.ndarray, slot: np.ndarray, owner: np.ndarray, text: np.ndarray, label: np.ndarray, swap: Swaps, penalty: float) -> np.ndarray:
    logit = np.bincount(owner, weights[slot], text[-1]) + weights[-1]
    harmless = np.exp(_sums(-np.logaddexp(0, logit), text))
    by_text = np.where(label > 0, -harmless / np.maximum(1 - harmless, 1e-12), 1.0) / len(label)
    by_sentence = np.repeat(by_text, np.diff(text)) / (1 + np.exp(-logit))
    # without a known feature the counts are whole numbers
    out = np.bincount(slot, by_sentence[owner], len(weights)).astype(float)
    out[-1] = by_sentence.sum()
    out[:-1] += DECAY * (weights[:-1] - start)
    if swap.n:
        change = np.bincount(swap.owner, weights[swap.feature] * swap.sign, swap.n)
        out += np.bincount(swap.feature, 2 * penalty / swap.n * change[swap.owner] * swap.sign, len(weights))
    return out


def counterfactual_gap(model: Model, texts: Sequence[str], kinds: Sequence[str] = IDENTITY_TERMS) -> float:
    """Mean absolute change of the sentences' logits when identity terms are swapped; 0 without any."""
    swap = swaps(sentences(texts), kinds)
    held, at = model.find(swap.feature)
    return float(np.abs(np.bincount(swap.owner[held], model.weights[at] * swap.sign[held], swap.n)).mean()) if swap.n else 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def train(
    docs: DataFrame,
    labels: DataFrame,
    kinds: Sequence[str] = IDENTITY_TERMS,
    penalty: float = PENALTY,
    labelled_docs: int = LABELLED_DOCS,
    labelled_bytes: int = LABELLED_BYTES,
) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, label, room = [], [], labelled_bytes
        for b in batches:
            for text, y in zip(clean(b["text"]), b["toxic"].tolist()):
                room -= len((text or "").encode("utf-8", "surrogatepass"))
                if room >= 0 or not texts:
                    texts.append(text)
                    label.append(y)
        y = np.array(label, np.float64)
        model = Model(float(y.mean()) if label else 0.5)
        yield pd.DataFrame({"model": [pickle.dumps(model.fit(sentences(texts), y, kinds, penalty) if 0 < y.sum() < len(y) else model)]})

    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most labelled_docs rows of two numbers
    sample = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_docs)
    row = map_frames(sample.coalesce(1), fit, "model binary").first()
    return pickle.loads(bytes(row["model"])) if row else Model(0.5)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability that the whole text is toxic; a column of that name is replaced."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = clean(b["text"])
            found = [model.scores(sentences(texts[lo:hi])) for lo, hi in chunks(texts)]
            yield b.assign(**{name: np.concatenate(found) if found else np.zeros(0)})

    text_batches(docs.sparkSession)
    return map_frames(docs, score, StructType([*docs.drop(name).schema.fields, StructField(name, DoubleType())]))
