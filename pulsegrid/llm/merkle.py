"""Merkle manifest of a dataset: a content-addressed DAG of rows, with a proof for every row.

Each row is a leaf, the lowercase hex SHA-256 of its columns in turn: ``-`` for a null, else
the value's UTF-8 byte count, ``:`` and the value. Leaves of a group ascend by key; every
``FANOUT`` neighbours become their digest (of the hex texts joined) until one node, the
group's root, remains. Group roots in the order of the groups (null first, by bytes) form a
tree likewise, up to the root of the dataset.

Trees are built and read in segments of ``LEVELS`` levels. A segment is what lies
below one node: at most ``FANOUT ** LEVELS`` children at its lower edge and the
digest-to-children records between. It is named by its upper digest, so equal content has
one name. Requests descend from the root: a request is a rank in its tree, whose digits
say which child to take at each record; the children not taken are collected, and a
segment's collected levels are reversed before the path above is appended. All requests that
share an upper segment share its descent, so a segment answers at most
``FANOUT ** LEVELS`` requests and no digest gathers more, however large a group is.

Ranks come from one range partitioning by (group, key), which a salt splits even where
rows repeat. The number of rounds is the logarithm of the largest group to the base
``FANOUT ** LEVELS``: three for 380 million rows.

Null keys come first; equal keys are ordered by leaf, and repeated rows are leaves of their own.
A null group is a group. An empty table has no root and gives no rows. Columns other than
those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from ._text import map_frames

FANOUT, LEVELS = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_RECORDS = "array<struct<digest:binary,children:array<binary>>>"


def leaf(values: Sequence[Column]) -> Column:
    """Digest (binary) of a row's values."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves; found by comparing, as logarithms round."""
    return sum(F.when(n > FANOUT**k, 1).otherwise(0) for k in range(40))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``__rank``, their place in the order of group and ``order``; and (__group, __first, n) of every group."""
    salted = durable(rows.withColumn("__salt", F.monotonically_increasing_id()))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "__salt"]
    placed = salted.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = durable(placed.withColumn("__task", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(2**33 - 1)))
    # One row per task, each at most the session's shuffle partitions: no group by data.
    ahead = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    size = placed.groupBy(F.col("__task").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = size.select("__t", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    numbered = placed.join(F.broadcast(offsets), F.col("__task") == F.col("__t")).withColumn("__rank", F.col("__ahead") + F.col("__at"))
    numbered = numbered.drop("__salt", "__task", "__at", "__t", "__ahead")
    groups = numbered.groupBy(F.col(group).alias("__group")).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("n"))
    return numbered, durable(groups)


def _positions(groups: DataFrame) -> DataFrame:
    """(__group, __first, n, tree): groups numbered by their first row, which is their order."""
    spread, _ = ranked(groups.withColumn("__all", F.lit(0)), "__all", ["__first"])
    return durable(spread.withColumnRenamed("__rank", "tree").drop("__all"))


def build(items: DataFrame, trees: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Segments of every round, from the leaves up, and (tree, root).

    ``items`` has (tree, rank, digest), ``trees`` (tree, n). A segment is a row (tree, block, levels, digest, records).
    """
    levels = trees.select("tree", depth(F.col("n")).alias("depth"))
    rounds = max(1, -(-(levels.agg(F.max("depth")).first()[0] or 0) // LEVELS))
    items = items.select("tree", "rank", "digest").join(levels, "tree")
    out, block = [], FANOUT**LEVELS
    for r in range(rounds):
        left = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.col("depth") - r * LEVELS)).cast("int")
        dealt = items.select("tree", F.floor(F.col("rank") / block).cast("bigint").alias("block"), "rank", "digest", left.alias("levels"), "depth")
        dealt = dealt.repartition(F.col("tree"), F.col("block")).sortWithinPartitions("tree", "block", "rank")
        made = durable(map_frames(dealt, _segments, f"tree bigint, block bigint, levels int, depth int, digest binary, records {_RECORDS}"))
        out.append(made)
        items = made.select("tree", F.col("block").alias("rank"), "digest", "depth")
    return out, items.select("tree", F.col("digest").alias("root"))


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per (tree, block) of rows that come in their order; a block may reach over batches."""
    held: list[pd.DataFrame] = []

    def close(part: pd.DataFrame) -> pd.DataFrame:
        row, nodes, records = part.iloc[0], [bytes(d) for d in part["digest"]], {}
        for _ in range(int(row["levels"])):
            runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
            nodes = [parent(run) for run in runs]
            records.update(zip(nodes, runs))
        table = [{"digest": d, "children": c} for d, c in records.items()]
        return pd.DataFrame([(row["tree"], row["block"], row["levels"], row["depth"], nodes[0], table)], columns=["tree", "block", "levels", "depth", "digest", "records"])

    for b in batches:
        for key, part in b.groupby(["tree", "block"], sort=False):
            if held and (held[0]["tree"].iloc[0], held[0]["block"].iloc[0]) != key:
                yield close(pd.concat(held))
                held = []
            held.append(part)
    if held:
        yield close(pd.concat(held))


def descend(requests: DataFrame, segments: DataFrame, above: DataFrame) -> DataFrame:
    """``requests`` (tree, rank and more) with ``arrived`` (the digest their digits lead to) and ``path``.

    ``above`` has (tree, block, path) of every segment. A path lists its levels from the lowest: one byte for
    the place taken, one for the number of siblings, and their digests.
    """
    block = FANOUT**LEVELS
    carried = [c for c in requests.columns if c not in ("tree", "rank")]
    kinds = dict(requests.dtypes)
    asked = requests.withColumn("block", F.floor(F.col("rank") / block).cast("bigint"))
    asked = asked.select("tree", "block", "rank", *carried, *[F.lit(None).cast(t).alias(c) for c, t in (("levels", "int"), ("digest", "binary"), ("records", _RECORDS), ("path", "binary"))])
    stored = segments.join(above, ["tree", "block"]).withColumn("rank", F.lit(-1).cast("bigint"))
    stored = stored.select("tree", "block", "rank", *[F.lit(None).cast(kinds[c]).alias(c) for c in carried], "levels", "digest", "records", "path")
    dealt = stored.unionByName(asked).repartition(F.col("tree"), F.col("block")).sortWithinPartitions("tree", "block", "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store: dict[bytes, list[bytes]] = {}
        top, levels, path = b"", 0, b""
        for b in batches:
            arrived, paths = [], []
            for rank, n, digest, records, upper in zip(b["rank"].tolist(), b["levels"].tolist(), b["digest"], b["records"], b["path"]):
                if rank < 0:  # the segment comes before its requests
                    top, levels, path = bytes(digest), int(n), bytes(upper)
                    store = {bytes(r["digest"]): [bytes(c) for c in r["children"]] for r in records}
                    arrived.append(None)
                    paths.append(None)
                    continue
                at, found = top, []
                for level in range(levels - 1, -1, -1):
                    digit, children = rank // FANOUT**level % FANOUT, store[at]
                    found.append(bytes([digit, len(children) - 1]) + b"".join(children[:digit] + children[digit + 1 :]))
                    at = children[digit]
                arrived.append(at)
                paths.append(b"".join(reversed(found)) + path)
            done = b["rank"].to_numpy(np.int64) >= 0
            yield b[["tree", "rank", *carried]].assign(arrived=arrived, path=paths)[done]

    schema = f"tree bigint, rank bigint, {''.join(f'`{c}` {kinds[c]}, ' for c in carried)}arrived binary, path binary"
    return map_frames(dealt, run, schema)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place taken, siblings) of every level, from the lowest."""
    i = 0
    while i < len(path):
        place, n = path[i], path[i + 1]
        yield place, [path[i + 2 + 32 * j : i + 34 + 32 * j] for j in range(n)]
        i += 2 + 32 * n


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for place, siblings in steps(path):
        digest = parent([*siblings[:place], digest, *siblings[place:]])
    return digest


class Manifest:
    """The written tree of a table: ``leaves``, ``segments`` (digest-to-children records) and the dataset's ``root``."""

    def __init__(self, docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", key: str = "doc_id", extra: dict[str, Column] | None = None):
        extra = extra or {}
        if clash := set(extra) & {"tree", "rank", "key", "group", "digest", "arrived", "path", "subroot", "block", "levels", "records"}:
            raise ValueError(f"names in use: {', '.join(sorted(clash))}")
        rows = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf([F.col(c) for c in columns]).alias("digest"), *[v.alias(c) for c, v in extra.items()])
        numbered, groups = ranked(rows, "group", ["key", "digest"])
        self.groups = _positions(groups)
        # one row per group: Spark broadcasts it by its written size or splits the hot groups of the join
        joined = numbered.join(self.groups, F.col("group").eqNullSafe(F.col("__group")))
        self.leaves = durable(joined.withColumn("rank", F.col("__rank") - F.col("__first")).drop("__group", "__rank", "__first", "n"))
        self.segments, roots = build(self.leaves, self.groups.select("tree", "n"))
        self.subroots = durable(roots.withColumnRenamed("root", "subroot"))
        tops = self.subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.col("subroot").alias("digest"))
        count = tops.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        self.top_segments, root = build(tops, durable(count))
        row = root.first()
        self.root = bytes(row["root"]) if row else None

    def proofs(self) -> DataFrame:
        """``leaves`` with ``arrived``, ``subroot`` and ``path`` up to the dataset's root."""
        path = self.subroots.sparkSession.createDataFrame([(0, 0, b"")], "tree bigint, block bigint, path binary")
        for r in range(len(self.top_segments) - 1, 0, -1):
            path = self._upper(self.top_segments, r, path)
        wanted = self.subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.col("tree").alias("group_tree"))
        tops = durable(descend(wanted, self.top_segments[0], path))
        path = durable(tops.select(F.col("group_tree").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path"))
        for r in range(len(self.segments) - 1, 0, -1):
            path = self._upper(self.segments, r, path)
        return descend(self.leaves.drop("digest"), self.segments[0], path).join(self.subroots, "tree")

    @staticmethod
    def _upper(segments: list[DataFrame], r: int, path: DataFrame) -> DataFrame:
        """(tree, block, path) of the segments of round r - 1: they are what the segments of round r have as leaves."""
        below = segments[r - 1].select("tree", F.col("block").alias("rank"))
        return durable(descend(below, segments[r], path).select("tree", F.col("rank").alias("block"), "path"))


def audited(proofs: DataFrame, root: bytes, changed: str) -> DataFrame:
    """``proofs`` with proof_sha256 (of all siblings), ``folded_root`` of the leaf in ``changed`` (or the original, where null) and ``verified``."""
    kinds = dict(proofs.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums, ends = [], []
            for path, digest, new in zip(b["path"], b["arrived"], b[changed]):
                path = bytes(path)
                sums.append(hashlib.sha256("".join(s.hex() for _, some in steps(path) for s in some).encode()).hexdigest())
                ends.append(fold(bytes(digest if new is None else new), path))
            yield b.drop(columns="path").assign(proof_sha256=sums, folded_root=[e.hex() for e in ends], verified=[e == root for e in ends])

    kept = "".join(f"`{c}` {t}, " for c, t in kinds.items() if c != "path")
    return map_frames(proofs, work, f"{kept}proof_sha256 string, folded_root string, verified boolean")
