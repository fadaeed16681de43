"""Hard-negative mining with segment summaries.

Components are floored after scaling, so a score is an exact integer inner product.
A vector is cut into segments, of which only the mean and the deviation are looked at first:
over a segment of n components the inner product is n times the product of the means, plus or
minus at most the product of the deviations (root of the summed squares about the mean). The
sum of that over all segments bounds the score from both sides. Bounds are taken with one
segment, then with ever more for the rows that remain, and only those left are scored.

An anchor's positives are the best rows of its own label: rows whose upper bound is below the
anchor's best found so far go. Negatives have another label and a score inside a window relative to
the positive's: rows whose bounds miss all windows of the anchor, or whose upper bound is below
what each window holds already, go. Both passes compare all rows with all anchors in blocks: rows
are dealt by a hash of their id to groups of about ``group_bytes``, so no label is ever gathered,
and every group meets the anchors as a stream and returns at most its best of each window.
Nothing is lost: the bounds only skip rows that cannot be among the results.

Rows without id or label, with a null vector, or with a component that is null or not finite
(also after scaling) take no part. Repeated rows count once; rows of one id that differ are
rows of their own, but never partners of an anchor with their id. Vectors of different lengths never meet.
Scores beyond 37 digits count as equal; those beyond 64 bits are returned as the nearest 64-bit number.
Columns other than ``vec_id``, ``embedding`` and ``label`` are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from ._text import map_frames

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
SEGMENTS = (1, 4, 16)
GROUP_BYTES = 32 << 20
TILE, ANCHORS_AT_ONCE = 4096, 64
_LONG, _WIDEST = 2**63 - 1, 10**37
_EXACT = 2.0**53


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    picked = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    return picked.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)


class Summaries:
    """Means and deviations of vectors at every level, scaled so that bounds are two matrix products."""

    def __init__(self, x: np.ndarray, segments: tuple[int, ...] = SEGMENTS):
        self.levels = []
        dim = x.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            for n in sorted({min(s, dim) for s in segments} - {0}):
                edges = np.linspace(0, dim, n + 1).astype(int)
                size = np.diff(edges)
                mean = np.add.reduceat(x, edges[:-1], axis=1) / size
                about = x - np.repeat(mean, size, axis=1)
                self.levels.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(about * about, edges[:-1], axis=1))))
            self.norm = np.sqrt((x * x).sum(axis=1))

    def bounds(self, level: int, rows: np.ndarray, other: Summaries) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of ``other``'s vectors with rows of this."""
        with np.errstate(over="ignore", invalid="ignore"):
            mean = other.levels[level][0] @ self.levels[level][0][rows].T
            spread = other.levels[level][1] @ self.levels[level][1][rows].T
            spread += 1e-9 * np.outer(other.norm, self.norm[rows]) + 1e-6  # rounding
            low, high = mean - spread, mean + spread
        # what doubles cannot hold is not bounded
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers: doubles where they hold them, else Python integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return a @ b.T
    return np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b).T


class Shelf:
    """The rows of a group that have one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], labels, ids))
        ids, labels, x = ids[order], labels[order], x[order]
        first = np.ones(len(ids), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (x[1:] != x[:-1]).any(axis=1)
        self.ids, self.labels, self.x = ids[first], labels[first], x[first]
        self.tiles = [slice(lo, lo + TILE) for lo in range(0, len(self.ids), TILE)]
        self.summaries = [Summaries(self.x[t]) for t in self.tiles]

    def scored(self, x: np.ndarray, wanted, found) -> None:
        """Bounds, refined level by level, then exact scores of the pairs that remain, tile by tile.

        ``wanted(tile, rows, low, high)`` says which pairs remain (None bounds: those that may at all);
        ``found(anchor, rows, scores)`` takes the exact scores of one anchor's rows.
        """
        own = Summaries(x)
        for tile, kept in zip(self.tiles, self.summaries):
            rows = np.arange(tile.start, min(tile.stop, len(self.ids)))
            left = wanted(rows, None, None)
            for level in range(len(own.levels)):
                if not left.any():
                    break
                low, high = kept.bounds(level, rows - tile.start, own)
                left &= wanted(rows, low, high)
                some = left.any(axis=0)
                if some.mean() < 0.8:
                    rows, left = rows[some], left[:, some]
            if not left.any():
                continue
            share = left.mean()
            whole = products(x, self.x[rows]) if share > 0.1 else None
            for i in np.flatnonzero(left.any(axis=1)).tolist():
                at = np.flatnonzero(left[i])
                found(i, rows[at], whole[i, at] if whole is not None else products(x[i : i + 1], self.x[rows[at]])[0])


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` first by descending score, then id."""
    if len(scores) > 4 * n:
        edge = np.partition(scores, len(scores) - n)[len(scores) - n]
        at = np.flatnonzero(scores >= edge)
        return at[np.lexsort((ids[at], -scores[at]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class Best:
    """The first ``n`` of one window (inclusive), so far."""

    def __init__(self, n: int, low=None, high=None):
        self.n, self.low, self.high = n, low, high
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    @property
    def floor(self):
        """A score below this is no use."""
        last = self.scores[-1] if len(self.scores) == self.n else None
        return last if self.low is None else self.low if last is None else max(last, self.low)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor
        ok = np.ones(len(scores), bool) if floor is None else scores >= floor
        if self.high is not None:
            ok &= scores <= self.high
        if ok.any():
            scores, ids = np.concatenate([self.scores, scores[ok]]), np.concatenate([self.ids, ids[ok]])
            at = _first(scores, ids, self.n)
            self.scores, self.ids = scores[at], ids[at]


def _digits(score) -> str:
    return str(max(-_WIDEST, min(_WIDEST, int(score))))


def _float(score) -> float:
    return float(max(-_WIDEST, min(_WIDEST, int(score))))


def _vectors(column: pd.Series, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Floored vectors by length, with their places in the column."""
    size = column.map(len).to_numpy(np.int64)
    out = {}
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        with np.errstate(over="ignore"):
            x = np.floor(scale * np.array(column.iloc[at].tolist(), np.float64).reshape(len(at), d))
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            out[d] = at[fine], x[fine]
    return out


def _search(scale: int, answer):
    """A task's work: rows (kind 0) of a group come first, then its anchors, answered in small blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, shelves = None, [], None
        for b in batches:
            for number, part in b.groupby("g", sort=False):
                if number != group:
                    group, held, shelves = number, [], None
                kind = part["kind"].to_numpy()
                if (kind == 0).any():
                    held.append(part[kind == 0])
                if (kind == 1).any() and held:
                    shelves = _shelves(pd.concat(held, ignore_index=True), scale) if shelves is None else shelves
                    held = held[:1]
                    asked = part[kind == 1].reset_index(drop=True)
                    for d, (at, x) in _vectors(asked["embedding"], scale).items():
                        for lo in range(0, len(at) if d in shelves else 0, ANCHORS_AT_ONCE):
                            yield answer(shelves[d], asked.iloc[at[lo : lo + ANCHORS_AT_ONCE]], x[lo : lo + ANCHORS_AT_ONCE])

    return run


def _shelves(rows: pd.DataFrame, scale: int) -> dict[int, Shelf]:
    ids, labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    return {d: Shelf(ids[at], labels[at], x) for d, (at, x) in _vectors(rows["embedding"], scale).items()}


def _positives(n: int):
    def answer(shelf: Shelf, asked: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        ids, labels = asked["vec_id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
        best = [Best(n) for _ in ids]

        def wanted(rows, low, high):
            if high is None:
                return (labels[:, None] == shelf.labels[rows]) & (ids[:, None] != shelf.ids[rows])
            floors = [b.floor for b in best]
            return high >= np.array([-np.inf if f is None else _float(f) for f in floors])[:, None]

        shelf.scored(x, wanted, lambda i, rows, scores: best[i].add(scores, shelf.ids[rows]))
        out = [(a, ids[i], int(p), _digits(s)) for i, (a, b) in enumerate(zip(asked["a"].tolist(), best)) for p, s in zip(b.ids.tolist(), b.scores.tolist())]
        return pd.DataFrame(out, columns=["a", "anchor_id", "partner", "score"])

    return answer


def _negatives(n: int, low: int, high: int):
    def answer(shelf: Shelf, asked: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        ids, labels = asked["vec_id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
        # low * p <= 100 * s <= high * p, for whole numbers s
        windows = [{int(p): Best(n, -(-low * int(p) // 100), high * int(p) // 100) for p in set(w)} for w in asked["windows"]]
        windows = [{p: b for p, b in w.items() if b.low <= b.high} for w in windows]

        def wanted(rows, lower, upper):
            if upper is None:
                return (labels[:, None] != shelf.labels[rows]) & (ids[:, None] != shelf.ids[rows])
            out = np.zeros(upper.shape, bool)
            for i, w in enumerate(windows):
                for b in w.values():
                    out[i] |= (upper[i] >= _float(b.floor)) & (lower[i] <= _float(b.high))
            return out

        def found(i, rows, scores):
            for b in windows[i].values():
                b.add(scores, shelf.ids[rows])

        shelf.scored(x, wanted, found)
        out = [
            (a, ids[i], str(p), int(m), _digits(s))
            for i, (a, w) in enumerate(zip(asked["a"].tolist(), windows))
            for p, b in w.items()
            for m, s in zip(b.ids.tolist(), b.scores.tolist())
        ]
        return pd.DataFrame(out, columns=["a", "anchor_id", "positive_score", "partner", "score"])

    return answer


def _groups(rows: DataFrame, group_bytes: int) -> int:
    """Groups to deal rows to: as many as the session shuffles to, or more so that each holds about ``group_bytes``."""
    total = rows.agg(F.sum(F.size("embedding") * 8 + 24).alias("bytes")).first()["bytes"] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes))


def _blocks(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Every row once, by a hash of its id, and every anchor in every group, after the group's rows."""
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("kind", F.lit(0))
    everywhere = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1))
    return dealt.unionByName(everywhere, allowMissingColumns=True).repartition(F.col("g")).sortWithinPartitions("g", "kind")


def mine(
    vectors: DataFrame,
    is_anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``is_anchor`` (a condition on vec_id and label) holds. For each of their
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score is from
    ``low`` to ``high`` hundredths of the positive's.
    """
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    rows = usable(vectors)
    groups = _groups(rows, group_bytes)
    # rows of one id that differ are anchors of their own
    anchors = durable(rows.where(is_anchor).distinct().withColumn("a", F.xxhash64("vec_id", "label", "embedding")))

    score = F.col("score").cast("decimal(38,0)")
    near = map_frames(_blocks(rows, anchors, groups), _search(scale, _positives(positives)), "a bigint, anchor_id bigint, partner bigint, score string")
    near = near.withColumn("__n", F.row_number().over(Window.partitionBy("a", "anchor_id").orderBy(score.desc(), "partner"))).where(F.col("__n") <= positives)
    near = durable(near.select("a", "anchor_id", F.col("partner").alias("positive_id"), F.col("score").alias("positive_score")))

    # at most ``positives`` scores an anchor
    windows = near.groupBy("a", F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("windows"))
    asked = durable(anchors.join(windows, ["a", "vec_id"]))
    far = map_frames(_blocks(rows, asked, groups), _search(scale, _negatives(negatives, low, high)), "a bigint, anchor_id bigint, positive_score string, partner bigint, score string")
    place = Window.partitionBy("a", "anchor_id", "positive_score").orderBy(score.desc(), "partner")
    far = far.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    found = near.join(far, ["a", "anchor_id", "positive_score"])
    limit = lambda c: F.least(F.greatest(F.col(c).cast("decimal(38,0)"), F.lit(-_LONG - 1)), F.lit(_LONG)).cast("bigint").alias(c)
    found = found.withColumnRenamed("partner", "negative_id").withColumnRenamed("score", "negative_score")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", limit("positive_score"), limit("negative_score"))
