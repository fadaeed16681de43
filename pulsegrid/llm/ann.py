"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length, where the nearest by distance is the nearest by
cosine. Each of ``tables`` hash tables floors ``hashes`` Gaussian projections divided
by ``width``. A query looks into its own bucket and ``probes - 1`` perturbed ones, in the
order of their estimated success: perturbations of one step up or down are ranked
by the query's distance to the cell's edge, and sets of them are visited by the
expected sum of squares (a sequence that is the same for all queries). Candidates of
all tables are merged and ranked by their exact cosine in double precision.

Equal vectors are one class with its ``k + 1`` smallest ids: no other id of the class can
be among anyone's ``k`` nearest, as ties go to smaller ids. So copies cost nothing,
however many there are. Every class is in every table. Buckets are dealt to groups of
about ``group_rows`` rows, a larger bucket is split by a salt; a task holds the index
rows of one group and streams over the queries that probe it. A query whose probed buckets hold
fewer than ``k`` others is compared with every row, in groups of the same size.

Vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id. Vectors of different lengths never meet. Repeated rows count
once. Columns other than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from ._text import map_frames, mix

TABLES, HASHES, WIDTH, PROBES = 16, 10, 2.0, 128
GROUP_ROWS = 8192
SEED = 11


def perturbations(hashes: int, probes: int) -> np.ndarray:
    """0/1 rows over 2 * hashes edges ranked by distance, in the order of the expected sum of squares.

    Ranks j and 2 * hashes - 1 - j are the two edges of one cell, so no row has both.
    """
    n = 2 * hashes
    j = np.arange(1, n + 1)
    low = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    high = 1 - (n + 1 - j) / (hashes + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (hashes + 1) * (hashes + 2))
    cost = np.where(j <= hashes, low, high)
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(n - 1 - c in chosen for c in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    rows = np.zeros((len(out), n), np.uint64)
    for r, chosen in zip(rows, out):
        r[list(chosen)] = 1
    return rows


class Tables:
    """The hash functions for vectors of one length."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = SEED):
        rng = np.random.default_rng((seed, dim))
        self.shape, self.width = (tables, hashes), width
        self.axes = rng.normal(size=(dim, tables * hashes))
        self.shift = rng.uniform(0, width, tables * hashes)
        self.step = rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = mix(np.arange(tables, dtype=np.uint64) + np.uint64(dim * 1000003))

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of every vector in every table before the last mixing, and the offsets inside the cells."""
        at = ((unit @ self.axes + self.shift) / self.width).reshape(len(unit), *self.shape)
        cell = np.floor(at)
        return (cell.astype(np.int64).view(np.uint64) * self.step).sum(axis=2) + self.base, at - cell

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return mix(self.place(unit)[0]).view(np.int64)

    def probe(self, unit: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Codes of all probed buckets: vectors x tables x probes."""
        bucket, inside = self.place(unit)
        distance = np.concatenate([inside, 1 - inside], axis=2)
        move = np.concatenate([np.zeros_like(self.step) - self.step, self.step])
        ranked = move[np.argsort(distance, axis=2, kind="stable")]
        return mix(bucket[:, :, None] + (ranked[:, :, None, :] * sets[None, None]).sum(axis=3)).view(np.int64)


def _vectors(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors (double) by length, with their places in the column."""
    raw = column.tolist()
    size = np.array([len(v) // 8 for v in raw])
    return {int(d): (at, np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), d)) for d in np.unique(size) for at in [np.flatnonzero(size == d)]}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with the components as bytes of doubles."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, v in zip(b["vec_id"], b["embedding"]):
                x = np.array([np.nan if c is None else c for c in v], np.float64) + 0.0
                if len(x) and np.isfinite(x).all() and x.any():
                    out.append((i, x.tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "v"])

    picked = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_frames(picked.where("vec_id IS NOT NULL AND embedding IS NOT NULL"), pack, "vec_id bigint, v binary")


def nearest(
    vectors: DataFrame,
    is_query=None,
    k: int = 5,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    probes: int = PROBES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` (a condition on vec_id) holds."""
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    sets = perturbations(hashes, probes)

    rows = durable(usable(vectors).distinct())
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("__n", smallest).where(F.col("__n") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("v").alias("c"), F.col("ids")[0].alias("c0"), "ids", "v")
    classes = durable(classes)
    asked = rows.where(is_query).select("vec_id", F.xxhash64("v").alias("c"), "v")
    queries = durable(classes.join(asked.select("v").distinct(), "v", "left_semi").select("c", "c0", "v"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, (at, x) in _vectors(b["v"]).items():
                codes = Tables(d, tables, hashes, width).codes(_unit(x))
                part = b.iloc[np.repeat(at, tables)]
                yield pd.DataFrame({"code": codes.ravel(), "c": part["c"].array, "c0": part["c0"].array})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, (at, x) in _vectors(b["v"]).items():
                own, unit = Tables(d, tables, hashes, width), _unit(x)
                for lo in range(0, len(at), 64):
                    codes = own.probe(unit[lo : lo + 64], sets).reshape(len(unit[lo : lo + 64]), -1)
                    part = b.iloc[np.repeat(at[lo : lo + 64], codes.shape[1])]
                    yield pd.DataFrame({"code": codes.ravel(), "c": part["c"].array, "c0": part["c0"].array})

    coded = map_frames(classes.select("c", "c0", "v"), index, "code bigint, c bigint, c0 bigint")
    size = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    hot = durable(size.where(F.col("n") > group_rows).select("code", F.ceil(F.col("n") / group_rows).cast("int").alias("salts")))
    groups = max(1, classes.count() * tables // group_rows)
    salts = F.coalesce("salts", F.lit(1))
    group = F.pmod(F.xxhash64("code", "salt"), F.lit(groups)).cast("int")
    held = coded.join(hot, "code", "left").withColumn("salt", F.pmod(F.xxhash64("c"), salts).cast("int")).select(group.alias("g"), "code", "c", "c0")
    held = held.join(classes, ["c", "c0"]).select("g", F.lit(0).alias("kind"), F.array("code").alias("codes"), "c", "c0", "ids", "v")
    probed = map_frames(queries, ask, "code bigint, c bigint, c0 bigint").distinct().join(hot, "code", "left")
    probed = probed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(group.alias("g"), "code", "c", "c0")
    probed = probed.groupBy("g", "c", "c0").agg(F.collect_set("code").alias("codes")).join(queries, ["c", "c0"])
    probed = probed.select("g", F.lit(1).alias("kind"), "codes", "c", "c0", F.array().cast("array<bigint>").alias("ids"), "v")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, held = None, []
        shelves: dict[int, tuple] = {}
        for b in batches:
            for number, part in b.groupby("g", sort=False):
                if number != g:
                    g, held, shelves = number, [], {}
                kind = part["kind"].to_numpy()
                if (kind == 0).any():
                    held.append(part[kind == 0])
                if (kind == 1).any() and held:
                    shelves = shelves or _shelves(pd.concat(held, ignore_index=True))
                    yield _best(part[kind == 1], shelves, k)

    def answered(held: DataFrame, probed: DataFrame) -> DataFrame:
        """(v, near): the best classes' ids of every query that the groups answer."""
        everything = held.unionByName(probed).repartition(F.col("g")).sortWithinPartitions("g", "kind")
        found = map_frames(everything, search, "c bigint, c0 bigint, ids array<bigint>, score double")
        found = found.groupBy("c", "c0", "ids").agg(F.max("score").alias("score"))
        each = found.select("c", "c0", "score", F.explode("ids").alias("vec_id"))
        top = each.groupBy("c", "c0").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
        return queries.join(top, ["c", "c0"]).select("v", F.slice("near", 1, k + 1).alias("near"))

    nothing = F.array().cast("array<struct<far:double,vec_id:bigint>>")
    per_query = asked.select(F.col("vec_id").alias("query_id"), "v").join(answered(held, probed), "v", "left").withColumn("near", F.coalesce("near", nothing))
    per_query = durable(per_query)
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    few = durable(per_query.where(F.size(own) < k).select("v").distinct())
    if not few.isEmpty():
        # buckets that hold too little: these queries meet every row, in groups dealt by a hash, under one code
        one, blocks = F.array(F.lit(0).cast("bigint")).alias("codes"), max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count() // group_rows)
        every = classes.select(F.pmod("c", F.lit(blocks)).cast("int").alias("g"), F.lit(0).alias("kind"), one, "c", "c0", "ids", "v")
        lost = queries.join(few, "v", "left_semi").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        lost = lost.select("g", F.lit(1).alias("kind"), one, "c", "c0", F.array().cast("array<bigint>").alias("ids"), "v")
        again = answered(every, lost).withColumnRenamed("near", "all_near")
        per_query = per_query.join(again, "v", "left").withColumn("near", F.coalesce("all_near", "near"))
    return per_query.select("query_id", F.posexplode(own).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )


def _shelves(index: pd.DataFrame) -> dict[int, tuple]:
    """Index rows of a group by the vectors' length: codes in order, unit vectors, ids."""
    out = {}
    for d, (at, x) in _vectors(index["v"]).items():
        codes = np.array([c[0] for c in index["codes"].iloc[at]], np.int64)
        order = np.argsort(codes, kind="stable")
        key = list(zip(index["c"].iloc[at].tolist(), index["c0"].iloc[at].tolist()))
        distinct = {c: i for i, c in enumerate(dict.fromkeys(key))}
        out[d] = codes[order], np.array([distinct[c] for c in key])[order], _unit(x)[order], index["ids"].iloc[at].to_numpy()[order]
    return out


def _best(asked: pd.DataFrame, shelves: dict[int, tuple], k: int) -> pd.DataFrame:
    out = []
    for d, (at, x) in _vectors(asked["v"]).items():
        if d not in shelves:
            continue
        codes, number, unit, ids = shelves[d]
        wanted, c, c0 = asked["codes"].iloc[at].tolist(), asked["c"].iloc[at].tolist(), asked["c0"].iloc[at].tolist()
        for i, q in enumerate(_unit(x)):
            probes = np.asarray(wanted[i], np.int64)
            lo, hi = np.searchsorted(codes, probes), np.searchsorted(codes, probes, "right")
            n = hi - lo
            if not n.any():
                continue
            rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = rows[np.unique(number[rows], return_index=True)[1]]
            score = unit[rows] @ q
            best = np.argsort(-score, kind="stable")
            if len(best) > k + 1:  # ties at the end stay
                best = best[score[best] >= score[best[k]] - 1e-12]
            out += [(c[i], c0[i], ids[rows[j]], float(score[j])) for j in best.tolist()]
    return pd.DataFrame(out, columns=["c", "c0", "ids", "score"])
