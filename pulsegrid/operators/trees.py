"""Regression forests grown as Spark jobs: many forests at once, deterministic, with a minimum split size.

A forest is a function of its rows and its seed, however the rows are dealt: a row's weight in
a tree is a Poisson(1) count drawn from a hash of (row id, tree), a node's candidate features are those with
the smallest hash of (tree, node, feature), and targets are summed as whole numbers, so no
order of adding changes a split. Ties go to the lower feature, then to the lower threshold.
Thresholds are quantiles of the forest's training rows: of all of them, or of about ``EDGE_ROWS`` picked by
the hash of their id if there are more.

Forests of expanding windows (``cross_validate``) are grown together. A forest whose training rows fit in
one task (``LOCAL_ROWS``) is grown there; tasks hold one copy of the rows and take their share of forests.
Larger ones begin with one histogram job a level, keyed by (forest, tree, node, feature, bin), for all
forests at once; nodes that have become small enough go to tasks with their rows. The number of jobs
depends on the depth, not on the number of forests or trees. Of a validation forest only the branches that its
test rows take are grown, which changes no prediction.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, importable

#: Rows a task grows a tree from; beyond that a node's histogram is a Spark aggregate.
LOCAL_ROWS = 200_000
EDGE_ROWS, BINS = 20_000, 128
PAIRS_AT_ONCE, CELLS_AT_ONCE = 1 << 21, 1 << 22
_PRIME = 2**31 - 1
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_SCALE = 2.0**30
_GROW, _LOCAL, _LEAF = -3, -2, -1


@dataclass(frozen=True)
class Settings:
    """Trees, depth and minimum split size of the reference setting; its candidates per node are the root of the number of features."""

    trees: int = 200
    depth: int = 15
    min_split: int = 5
    seed: int = 7


def draw(seed: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | int = 0) -> np.ndarray:
    """Whole numbers in [0, 2**31 - 1) that depend on all arguments."""
    a, b, c = np.asarray(a, np.int64) % _PRIME, np.asarray(b, np.int64) % _PRIME, np.asarray(c, np.int64) % _PRIME
    x = (a * 48271 + b * 69621 + c * 16807 + seed) % _PRIME
    for extra in (a, b, c, seed):
        x = (x * x + extra) % _PRIME
    return x


def weights(seed: int, rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """How often each row is in each tree's bootstrap: trees x rows."""
    return np.searchsorted(_POISSON, draw(seed, rows[None, :], trees[:, None]) / _PRIME, "right").astype(np.int64)


def candidates(seed: int, trees: np.ndarray, nodes: np.ndarray, features: int) -> np.ndarray:
    """The features a node may split on, ascending: nodes x root of the number of features."""
    tried = max(1, math.isqrt(features))
    drawn = draw(seed + 1, trees[:, None], nodes[:, None], np.arange(features)[None, :])
    order = np.lexsort((np.broadcast_to(np.arange(features), drawn.shape), drawn), axis=-1)
    return np.sort(order[:, :tried], axis=1)


def quantile_edges(x: np.ndarray) -> list[np.ndarray]:
    """Distinct thresholds of every column; values up to a threshold go left."""
    if not len(x):
        return [np.zeros(0)] * x.shape[1]
    at = np.unique(np.arange(1, BINS) * len(x) // BINS)
    return [np.unique(np.sort(column)[at]) for column in x.T]


def encode(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _gains(n: np.ndarray, s: np.ndarray, total_n: np.ndarray, total_s: np.ndarray) -> np.ndarray:
    """Fall of the squared error by cutting after each bin, from running counts and sums; -1 where a side is empty."""
    right = total_n - n
    ok = (n > 0) & (right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / n + (total_s - s) ** 2 / right - total_s * total_s / total_n
    return np.where(ok, gain, -1.0)


def _worth(gain: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    return gain > 1e-9 * np.maximum(1.0, s * s / np.maximum(n, 1))


def grow(codes, q, w, trees, settings: Settings, tests=None, node: int = 1, fallback: float = 0.0):
    """Grow trees on rows coded by bins; ``w`` is trees x rows.

    With ``tests`` (codes of rows to predict) returns their predictions, trees x tests, and grows only what they need;
    otherwise returns the nodes as (tree, node, feature, bin, value), feature -1 for leaves. Starts at ``node``.
    """
    features, place = codes.shape[1], np.arange(len(trees))
    t, r = np.nonzero(w)
    weight = w[t, r].astype(np.float64)
    slot, target = t.copy(), q[r] * weight
    tree_of, node_of, level = place, np.full(len(trees), node, np.int64), int(node).bit_length() - 1
    out, found = np.full((len(trees), 0 if tests is None else len(tests)), fallback), []
    if tests is not None:
        test_t, test_r = (x.ravel() for x in np.indices(out.shape))
        test_slot = test_t.copy()
    while len(tree_of):
        k = len(tree_of)
        n, s = np.bincount(slot, weight, k), np.bincount(slot, target, k)
        value = np.divide(s, n, out=np.full(k, fallback), where=n > 0)
        best, feature, cut = np.full(k, -1.0), np.full(k, -1, np.int64), np.zeros(k, np.int64)
        may = np.flatnonzero((n >= settings.min_split) & (level < settings.depth)) if features else np.zeros(0, np.int64)
        for lo in range(0, len(may), max(1, CELLS_AT_ONCE // (BINS + 1))):
            some = may[lo : lo + max(1, CELLS_AT_ONCE // (BINS + 1))]
            local = np.full(k, -1)
            local[some] = np.arange(len(some))
            pairs = np.flatnonzero(local[slot] >= 0)
            at, row, pw, pt = local[slot[pairs]], r[pairs], weight[pairs], target[pairs]
            tried = candidates(settings.seed, trees[tree_of[some]], node_of[some], features)
            for j in range(tried.shape[1]):
                cell = at * (BINS + 1) + codes[row, tried[at, j]]
                size = len(some) * (BINS + 1)
                left_n = np.bincount(cell, pw, size).reshape(len(some), -1).cumsum(axis=1)
                left_s = np.bincount(cell, pt, size).reshape(len(some), -1).cumsum(axis=1)
                gain = _gains(left_n, left_s, n[some][:, None], s[some][:, None])
                first = gain.argmax(axis=1)
                gain = gain[np.arange(len(some)), first]
                better = (gain > best[some]) & _worth(gain, n[some], s[some])
                best[some[better]], feature[some[better]], cut[some[better]] = gain[better], tried[better, j], first[better]
        splits = feature >= 0
        if tests is None:
            found.append(pd.DataFrame({"tree": trees[tree_of], "node": node_of, "feature": feature, "bin": cut, "value": value}))
            needed = np.repeat(splits, 2)
        else:
            over = ~splits[test_slot]
            out[test_t[over], test_r[over]] = value[test_slot[over]]
            test_t, test_r, test_slot = test_t[~over], test_r[~over], test_slot[~over]
            child = test_slot * 2 + (tests[test_r, feature[test_slot]] > cut[test_slot])
            needed = np.zeros(2 * k, bool)
            needed[child] = True
        fresh = np.cumsum(needed) - 1
        if tests is not None:
            test_slot = fresh[child]
        stay = np.flatnonzero(splits[slot])
        slot, r, weight, target = slot[stay], r[stay], weight[stay], target[stay]
        child = slot * 2 + (codes[r, feature[slot]] > cut[slot])
        stay = needed[child]
        slot, r, weight, target = fresh[child[stay]], r[stay], weight[stay], target[stay]
        parent = np.flatnonzero(needed) // 2
        tree_of, node_of = tree_of[parent], node_of[parent] * 2 + np.flatnonzero(needed) % 2
        level += 1
    return out if tests is not None else pd.concat(found, ignore_index=True)


# ------------------------------------------------------------------ Spark side
def _frames(df: DataFrame, work, schema: str) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInPandas(work, schema)


def _matrix(part: pd.DataFrame, features: int) -> np.ndarray:
    return np.array(part["x"].tolist(), np.float64).reshape(len(part), features)


@dataclass(frozen=True)
class _Data:
    """Coded training rows as a table, and what all tasks have to know of it."""

    rows: DataFrame  # id, key (a struct), row, day, fold, x, y
    features: int
    scale: float
    sample_day: np.ndarray
    sample: np.ndarray
    count: int

    def edges(self, until: int | None) -> list[np.ndarray]:
        """Thresholds of the forest trained on the days before ``until``."""
        return quantile_edges(self.sample if until is None else self.sample[self.sample_day < until])


def _prepare(df: DataFrame, feats: Sequence[str], target: str, keys: Sequence[str], day: Column, fold: Column, row: Column | None) -> _Data:
    row = F.xxhash64(*keys) if row is None else row
    vector = F.array(*[F.col(f).cast("double") for f in feats]).cast("array<double>")
    rows = durable(
        df.select(
            F.monotonically_increasing_id().alias("id"),
            F.struct(*keys).alias("key"),
            F.pmod(row.cast("bigint"), F.lit(_PRIME).cast("bigint")).alias("row"),
            day.cast("int").alias("day"),
            fold.cast("int").alias("fold"),
            vector.alias("x"),
            F.col(target).cast("double").alias("y"),
        )
    )
    n, top = rows.agg(F.count(F.lit(1)), F.max(F.abs("y"))).first()
    share = min(1.0, EDGE_ROWS / max(n, 1))
    # about EDGE_ROWS rows, whatever the table
    picked = rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_003)) < share * 1_000_003).select("day", "x").toPandas()
    scale = _SCALE / top if top else 1.0
    return _Data(rows, len(feats), scale, picked["day"].to_numpy(np.int64, na_value=0) if len(picked) else np.zeros(0, np.int64), _matrix(picked, len(feats)), n)


def _own_copies(rows: DataFrame, groups: int) -> DataFrame:
    """Every row in every group."""
    return rows.drop("key").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g").sortWithinPartitions("g", "row")


def _grouped(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come group after group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for _, part in b.groupby(list(by), sort=False):
            if held and (held[0][list(by)].iloc[0] != part[list(by)].iloc[0]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _tree_chunks(settings: Settings, rows: int) -> list[np.ndarray]:
    size = max(1, min(settings.trees, PAIRS_AT_ONCE // max(rows, 1)))
    return [np.arange(lo, min(lo + size, settings.trees)) for lo in range(0, settings.trees, size)]


def _quantised(y: pd.Series | np.ndarray, scale: float) -> np.ndarray:
    return np.rint(np.asarray(y, np.float64) * scale)


def _tops(data: _Data, forests: dict[int, int | None], settings: Settings) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], pd.DataFrame]:
    """Upper levels of the forests by histogram jobs: (feature or state, bin) of every tree and node; and the values of their leaves."""
    width = 2
    tops = {f: (np.full((settings.trees, width), _GROW, np.int32), np.zeros((settings.trees, width), np.int32)) for f in forests}
    leaves = []
    for level in range(settings.depth + 1):
        if not any((state[:, 1 << level :] == _GROW).any() for state, _ in tops.values()):
            break
        work = partial(_histograms, data=replace(data, rows=None), forests=forests, tops=tops, settings=settings, level=level)
        cells = _frames(data.rows.select("row", "day", "x", "y"), work, "forest int, tree int, node int, feature int, bin int, n bigint, s bigint")
        cells = cells.groupBy("forest", "tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        inside = Window.partitionBy("forest", "tree", "node", "feature")
        running = inside.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.select("forest", "tree", "node", "feature", "bin", *[F.sum(c).over(running).cast("double").alias(f"left_{c}") for c in "ns"], *[F.sum(c).over(inside).cast("double").alias(c) for c in "ns"])
        ls, ln, s, n = (F.col(c) for c in ("left_s", "left_n", "s", "n"))
        gain = F.when(n > ln, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n).otherwise(-1.0)
        place = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "left_n", "n", "s")
        # one row per node that is still large: at most the rows of the forests over LOCAL_ROWS
        decided = cells.groupBy("forest", "tree", "node").agg(F.max(place).alias("p")).select("forest", "tree", "node", "p.*").collect()
        for f, (state, cut) in list(tops.items()):
            if state.shape[1] < 4 << level:
                more = (4 << level) - state.shape[1]
                tops[f] = (np.pad(state, ((0, 0), (0, more)), constant_values=_LOCAL), np.pad(cut, ((0, 0), (0, more))))
        for d in decided:
            state, cut = tops[d["forest"]]
            if level >= settings.depth or d["n"] < settings.min_split or not _worth(np.array(d["gain"]), np.array(d["n"]), np.array(d["s"])):
                state[d["tree"], d["node"]] = _LEAF
                leaves.append((d["forest"], d["tree"], d["node"], d["s"] / d["n"]))
                continue
            state[d["tree"], d["node"]], cut[d["tree"], d["node"]] = -d["f"], -d["b"]
            for child, size in ((2 * d["node"], d["left_n"]), (2 * d["node"] + 1, d["n"] - d["left_n"])):
                state[d["tree"], child] = _LOCAL if size <= LOCAL_ROWS else _GROW
    return tops, pd.DataFrame(leaves, columns=["forest", "tree", "node", "value"])


def _walk(codes: np.ndarray, state: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node every row reaches in every tree's upper levels: trees x rows."""
    at = np.ones((len(state), len(codes)), np.int64)
    tree, row = np.arange(len(state))[:, None], np.arange(len(codes))[None, :]
    while True:
        feature = state[tree, at]
        inner = feature >= 0
        if not inner.any():
            return at
        right = codes[row, np.maximum(feature, 0)] > cut[tree, at]
        at = np.where(inner, 2 * at + right, at)


def _histograms(batches, data: _Data, forests, tops, settings: Settings, level: int) -> Iterator[pd.DataFrame]:
    """Counts and sums of a task's rows by (forest, tree, node, candidate feature, bin), summed over its batches while they are few."""
    edges = {f: data.edges(until) for f, until in forests.items()}
    total: dict[int, dict] = {f: {} for f in forests}
    for b in batches:
        x, q, day = _matrix(b, data.features), _quantised(b["y"], data.scale), b["day"].to_numpy()
        for f, until in forests.items():
            use = np.flatnonzero(np.ones(len(b), bool) if until is None else day < until)
            codes, (state, cut) = encode(x[use], edges[f]), tops[f]
            for trees in _tree_chunks(settings, len(use)):
                w = weights(settings.seed, b["row"].to_numpy(np.int64)[use], trees)
                at = _walk(codes, state[trees], cut[trees])
                t, r = np.nonzero((w > 0) & (state[trees[:, None], at] == _GROW))
                if not len(t):
                    continue
                node = trees[t] << 17 | at[t, r]
                names, slot = np.unique(node, return_inverse=True)
                tried = candidates(settings.seed, names >> 17, names & 0x1FFFF, data.features)
                weight = w[t, r].astype(np.float64)
                for j in range(tried.shape[1]):
                    cell = slot * (BINS + 1) + codes[r, tried[slot, j]]
                    held, where = np.unique(cell, return_inverse=True)
                    n, s = np.bincount(where, weight), np.bincount(where, weight * q[use][r])
                    own = held // (BINS + 1)
                    keys = zip(names[own].tolist(), tried[own, j].tolist(), (held % (BINS + 1)).tolist())
                    sums = total[f]
                    for key, cn, cs in zip(keys, n.tolist(), s.tolist()):
                        a = sums.get(key)
                        sums[key] = (cn, cs) if a is None else (a[0] + cn, a[1] + cs)
        if sum(map(len, total.values())) > 500_000:
            yield _cells(total)
            total = {f: {} for f in forests}
    yield _cells(total)


def _cells(total: dict[int, dict]) -> pd.DataFrame:
    out = [(f, k >> 17, k & 0x1FFFF, j, b, int(n), int(s)) for f, sums in total.items() for (k, j, b), (n, s) in sums.items()]
    return pd.DataFrame(out, columns=["forest", "tree", "node", "feature", "bin", "n", "s"])


def _ship(batches, data: _Data, forests, tops, settings: Settings, tests: bool) -> Iterator[pd.DataFrame]:
    """Rows of small nodes below the upper levels: to be grown where (forest, tree, node) is dealt to. Test rows have weight 0."""
    edges = {f: data.edges(until) for f, until in forests.items()}
    for b in batches:
        x, q, day, ids = _matrix(b, data.features), _quantised(b["y"], data.scale), b["day"].to_numpy(), b["row"].to_numpy(np.int64)
        fold = b["fold"].to_numpy(np.float64, na_value=-1)
        for f, until in forests.items():
            use = np.flatnonzero(np.ones(len(b), bool) if until is None else (day < until) | (fold == f))
            codes, (state, cut) = encode(x[use], edges[f]), tops[f]
            test = (fold[use] == f) if tests else np.zeros(len(use), bool)
            for trees in _tree_chunks(settings, len(use)):
                w = np.where(test[None, :], 0, weights(settings.seed, ids[use], trees))
                at = _walk(codes, state[trees], cut[trees])
                t, r = np.nonzero(((w > 0) & (state[trees[:, None], at] == _LOCAL)) | test[None, :])
                if len(t):
                    part = {"forest": f, "tree": trees[t], "node": at[t, r], "w": w[t, r], "q": q[use][r], "codes": [codes[i].tobytes() for i in r]}
                    yield pd.DataFrame({**part, "id": b["id"].to_numpy(np.int64)[use[r]]})


def _finish(batches, data: _Data, leaves: dict, settings: Settings, tests: bool) -> Iterator[pd.DataFrame]:
    for part in _grouped(batches, ["forest", "tree", "node"]):
        f, tree, node = (int(part[c].iloc[0]) for c in ("forest", "tree", "node"))
        w = part["w"].to_numpy(np.int64)
        codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), data.features)
        train, asked = w > 0, w == 0
        q = part["q"].to_numpy(np.float64)
        name = np.array([tree])
        if tests:
            if (f, tree, node) in leaves:
                out = np.full(int(asked.sum()), leaves[f, tree, node])
            else:
                out = grow(codes[train], q[train], w[None, train], name, settings, codes[asked], node)[0]
            yield pd.DataFrame({"id": part["id"][asked].to_numpy(np.int64), "forest": f, "total": out / data.scale, "trees": 1})
        else:
            yield grow(codes[train], q[train], w[None, train], name, settings, node=node).assign(forest=f)


def cross_validate(
    df: DataFrame, feats: Sequence[str], target: str, keys: Sequence[str], day: Column, fold: Column, first: dict[int, int], settings: Settings, row: Column | None = None
) -> DataFrame:
    """(keys, fold, prediction) of every row with a fold in ``first``, by the forest of the rows whose ``day`` is before the fold's ``first``."""
    data = _prepare(df, feats, target, keys, day, fold, row)
    shared = replace(data, rows=None)
    days = {r["day"]: r["n"] for r in data.rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per day of the calendar
    size = {f: sum(n for d, n in days.items() if d < until) for f, until in first.items()}
    small = sorted((f for f in first if size[f] <= LOCAL_ROWS), key=lambda f: -size[f])
    large = {f: first[f] for f in first if size[f] > LOCAL_ROWS}
    schema, shipped_schema = "id bigint, forest int, total double, trees int", "forest int, tree int, node int, w int, q double, codes binary, id bigint"
    parts = []
    if small:
        groups = min(len(small), max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
        jobs = {g: small[g::groups] for g in range(groups)}
        last = max(first[f] for f in small)
        read = data.rows.where((F.col("day") < last) | F.col("fold").isin(small))

        def run(batches):
            for part in _grouped(batches, ["g"]):
                x, y, days, folds = _matrix(part, shared.features), _quantised(part["y"], shared.scale), part["day"].to_numpy(), part["fold"].to_numpy(np.float64, na_value=-1)
                ids = part["row"].to_numpy(np.int64)
                for f in jobs[int(part["g"].iloc[0])]:
                    train, asked = np.flatnonzero(days < first[f]), np.flatnonzero(folds == f)
                    edges = shared.edges(first[f])
                    codes, tests, total = encode(x[train], edges), encode(x[asked], edges), 0.0
                    for trees in _tree_chunks(settings, len(train)):
                        w = weights(settings.seed, ids[train], trees)
                        total = total + grow(codes, y[train], w, trees, settings, tests, fallback=float(y[train].mean()) if len(train) else 0.0).sum(axis=0)
                    yield pd.DataFrame({"id": part["id"].to_numpy(np.int64)[asked], "forest": f, "total": total / shared.scale, "trees": settings.trees})

        parts.append(_frames(_own_copies(read, groups), run, schema))
    if large:
        tops, leaves = _tops(data, large, settings)
        known = {(a, b, c): v for a, b, c, v in leaves.itertuples(index=False)}
        shipped = _frames(
            data.rows.drop("key"),
            partial(_ship, data=shared, forests=large, tops=tops, settings=settings, tests=True),
            shipped_schema,
        )
        dealt = shipped.repartition("forest", "tree", "node").sortWithinPartitions("forest", "tree", "node")
        parts.append(_frames(dealt, partial(_finish, data=shared, leaves=known, settings=settings, tests=True), schema))
    if not parts:
        raise ValueError("not enough rows for cross-validation")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    summed = both.groupBy("id").agg((F.sum("total") / F.sum("trees")).alias("prediction"))
    return durable(data.rows.where("fold IS NOT NULL").select("id", "key", "fold").join(summed, "id").select("key.*", "fold", "prediction"))


@dataclass(frozen=True)
class ForestModel:
    """A fitted forest: a table of nodes (tree, node, feature, threshold, value), feature -1 for leaves."""

    nodes: DataFrame
    features: list[str]
    settings: Settings

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``; trees are dealt to tasks, each with one copy of a block of the rows."""
        spark = rows.sparkSession
        taken = durable(rows.withColumn("__row", F.monotonically_increasing_id()))
        blocks = max(1, -(-taken.count() // 100_000))
        chunks = min(self.settings.trees, max(-(-self.settings.trees // 64), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))
        empty = F.lit(None)
        x = taken.select(
            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
            F.pmod("__row", F.lit(blocks)).cast("int").alias("block"),
            F.lit(1).alias("kind"),
            "__row",
            F.array(*[F.col(c).cast("double") for c in self.features]).cast("array<double>").alias("x"),
            *[empty.cast(t).alias(c) for c, t in (("tree", "int"), ("node", "int"), ("feature", "int"), ("threshold", "double"), ("value", "double"))],
        )
        trees = self.nodes.select(
            F.pmod("tree", F.lit(chunks)).cast("int").alias("chunk"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
            F.lit(0).alias("kind"),
            empty.cast("bigint").alias("__row"),
            empty.cast("array<double>").alias("x"),
            *[F.col(c).cast(t).alias(c) for c, t in (("tree", "int"), ("node", "int"), ("feature", "int"), ("threshold", "double"), ("value", "double"))],
        )
        dealt = trees.unionByName(x).repartition("chunk", "block").sortWithinPartitions("chunk", "block", "kind", "tree", "__row")
        work = partial(_predict, features=len(self.features), depth=self.settings.depth)
        sums = _frames(dealt, work, "__row bigint, total double").groupBy("__row").agg(F.sum("total").alias("__total"))
        return taken.join(sums, "__row").withColumn("prediction", F.col("__total") / self.settings.trees).drop("__row", "__total")

    def describe(self) -> dict:
        s = self.settings
        return {"features": self.features, "trees": s.trees, "depth": s.depth, "min_split": s.min_split, "seed": s.seed}


def _predict(batches, features: int, depth: int) -> Iterator[pd.DataFrame]:
    group, held, forest = None, [], None
    for b in batches:
        for key, part in b.groupby(["chunk", "block"], sort=False):
            if key != group:
                group, held, forest = key, [], None
            kind = part["kind"].to_numpy()
            if (kind == 0).any():
                held.append(part.loc[kind == 0, ["tree", "node", "feature", "threshold", "value"]])
            if (kind == 1).any():
                forest = _dense(pd.concat(held), depth) if forest is None else forest
                asked = part[kind == 1]
                x, (feature, threshold, value) = _matrix(asked, features), forest
                at = np.ones((len(feature), len(x)), np.int64)
                tree, row = np.arange(len(feature))[:, None], np.arange(len(x))[None, :]
                for _ in range(depth):
                    f = feature[tree, at]
                    at = np.where(f >= 0, 2 * at + (x[row, np.maximum(f, 0)] > threshold[tree, at]), at)
                yield pd.DataFrame({"__row": asked["__row"].astype("int64"), "total": value[tree, at].sum(axis=0)})


def _dense(nodes: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, tree = np.unique(nodes["tree"].to_numpy(np.int64), return_inverse=True)
    node, shape = nodes["node"].to_numpy(np.int64), (len(names), 2 << depth)
    feature, threshold, value = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
    feature[tree, node], threshold[tree, node], value[tree, node] = nodes["feature"], nodes["threshold"], nodes["value"]
    return feature, threshold, value


def fit(df: DataFrame, feats: Sequence[str], target: str, keys: Sequence[str], settings: Settings, row: Column | None = None) -> ForestModel:
    """A forest of all rows."""
    data = _prepare(df, feats, target, keys, F.lit(0), F.lit(None), row)
    if not data.count:
        raise ValueError("no rows to fit a forest on")
    shared, edges = replace(data, rows=None), data.edges(None)
    spark = df.sparkSession
    schema = "tree int, node int, feature int, bin int, value double"
    if data.count <= LOCAL_ROWS:
        groups = min(settings.trees, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

        def run(batches):
            for part in _grouped(batches, ["g"]):
                codes, q, ids = encode(_matrix(part, shared.features), edges), _quantised(part["y"], shared.scale), part["row"].to_numpy(np.int64)
                mine = np.arange(int(part["g"].iloc[0]), settings.trees, groups)
                size = max(1, PAIRS_AT_ONCE // len(part))
                for lo in range(0, len(mine), size):
                    trees = mine[lo : lo + size]
                    yield grow(codes, q, weights(settings.seed, ids, trees), trees, settings, fallback=float(q.mean()))

        nodes = _frames(_own_copies(data.rows, groups), run, schema)
    else:
        tops, leaves = _tops(data, {0: None}, settings)
        shipped = _frames(
            data.rows.drop("key"),
            partial(_ship, data=shared, forests={0: None}, tops=tops, settings=settings, tests=False),
            "forest int, tree int, node int, w int, q double, codes binary, id bigint",
        )
        dealt = shipped.drop("id").repartition("forest", "tree", "node").sortWithinPartitions("forest", "tree", "node")
        low = _frames(dealt, partial(_finish, data=shared, leaves={}, settings=settings, tests=False), f"{schema}, forest int").drop("forest")
        state, cut = tops[0]
        tree, node = np.nonzero(state >= 0)
        inner = pd.DataFrame({"tree": tree, "node": node, "feature": state[tree, node], "bin": cut[tree, node], "value": 0.0})
        high = pd.concat([inner, leaves.drop(columns="forest").assign(feature=-1, bin=0)])[["tree", "node", "feature", "bin", "value"]]
        nodes = low.unionByName(spark.createDataFrame(high.astype({"tree": int, "node": int, "feature": int, "bin": int}), schema))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in e]).cast("array<double>") for e in edges]).cast("array<array<double>>")
    threshold = F.when(F.col("feature") >= 0, F.get(F.get(table, F.col("feature")), F.col("bin")))
    return ForestModel(durable(nodes.select("tree", "node", "feature", threshold.alias("threshold"), (F.col("value") / data.scale).alias("value"))), list(feats), settings)


def save(model: ForestModel, path: str) -> None:
    """Nodes and settings as two Parquet tables."""
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    model.nodes.sparkSession.createDataFrame([(json.dumps(model.describe()),)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")


def load(spark, path: str) -> ForestModel:
    known = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    feats = known.pop("features")
    return ForestModel(spark.read.parquet(f"{path}/nodes"), feats, Settings(**known))
