"""Near-duplicate documents by SetSketch registers.

A document is its set of word shingles. Every shingle gives points of a Poisson
process, each dealt to one of ``m`` registers; a register keeps the smallest point
and stores it on an exponential scale, truncated to 16 bits. Registers of a union
are the maxima of the parts' registers, so sketches merge; two registers agree with
a probability close to the Jaccard similarity, so bands of registers find
candidates. Candidates are estimated jointly by maximum likelihood from the numbers of
larger, smaller and equal registers, and every link is confirmed on the full sets.

1. Equal sets become one node (per digest of the set), with the smallest id.
2. Nodes that share a band form families: connected components of the bands.
3. A family is dealt to chunks of bounded total size by a hash of the node, each
   chunk with the family's first node beside it. Inside a chunk candidates are
   compared unless they are connected already, and only a spanning forest is returned.
4. Families of several chunks that are not one component by then are finished:
   blocks of their nodes outside the largest component meet every chunk once.
5. Components of all links.

No step emits the pairs of a group, and what a task holds is bounded by the chunk
size and the longest document. A pair at the threshold shares no band with
a probability of 2e-8 (150 registers, 30 bands of 5).

Rows are identified by (doc_id, hash of the text). Repeated rows get the same
result. Rows that share an id but not the text are judged one by one; sets with the
same smallest id count as linked. A row without an id is linked with nothing, its component is null and it is kept.
Texts without words have empty sets and are linked with nothing. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ._graph import components
from ._text import SOLID, chunks, clean, heavy, map_frames, mix, shingle_sets, text_batches, words_of
from .linededup import keyed

SHINGLE = 5
#: Links have 100 * intersection >= 85 * union.
PERCENT = 85
BANDS, ROWS = 30, 5
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Shingles in a chunk of a family, and in a block of its unsettled nodes; registers and band keys of a node count as so many.
CHUNK_SHINGLES = 200_000
NODE_SHINGLES = 70
#: Sets sketched at once.
SKETCH_SETS = 512
#: A pair is not a candidate if its registers are so much less likely at the threshold than at their best (natural logarithm).
LESS_LIKELY = 18.0

_ROUND = np.uint64(0xD1342543DE82EF95)


def sketches(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """Registers (uint16) of every set, one row each; empty sets have zeros."""
    size = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(sets), m), np.inf)
    flat = least.reshape(-1)
    state = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), size)
    x = np.zeros(len(state))
    turn = 0
    while len(doc):
        turn += 1
        h = mix(state + np.uint64(turn * int(_ROUND) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        register = (mix(h) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        np.minimum.at(flat, doc * m + register.astype(np.int64), x)
        active = x < least.max(axis=1)[doc]
        state, doc, x = state[active], doc[active], x[active]
    with np.errstate(divide="ignore"):
        level = np.floor(1 + (np.log(RATE) - np.log(least)) / np.log(BASE))  # an empty set: minus infinity
    return np.clip(level, 0, TOP + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of every sketch."""
    r = registers.astype(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), r.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ (r[:, :, j] + np.uint64(1)))
    return key


def _agree(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def plausible(larger: np.ndarray, smaller: np.ndarray, m: int, n: int, others: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sketches with so many larger and smaller registers may come from sets at the threshold or above.

    Joint likelihood of the similarity with the sizes known; compared at the best
    similarity at or above the threshold and at the best of all.
    """
    u, v = n / (n + others), others / (n + others)
    grid = np.linspace(0, 1, 81)[:, None] * np.minimum(u / v, v / u)[None, :]
    up, down = _agree(np.clip(u - v * grid, 1e-12, 1)), _agree(np.clip(v - u * grid, 1e-12, 1))
    same = np.clip(1 - up - down, 1e-12, 1)
    score = larger * np.log(np.maximum(up, 1e-12)) + smaller * np.log(np.maximum(down, 1e-12)) + (m - larger - smaller) * np.log(same)
    at = np.where(grid >= percent / 100 - 1 / 80, score, -np.inf).max(axis=0)
    return at >= score.max(axis=0) - LESS_LIKELY


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def spanning_links(sets: list[np.ndarray], group: list[int], fresh: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets.

    Only pairs with a set of ``fresh`` are looked at; equal numbers in ``group`` mean
    that sets are connected already.
    """
    parts = [sketches(sets[i : i + SKETCH_SETS]) for i in range(0, len(sets), SKETCH_SETS)]
    registers = np.concatenate(parts) if parts else sketches([])
    keys = band_keys(registers)
    size = np.array([len(s) for s in sets], np.int64)
    forest = _Forest(len(sets))
    seen: dict[int, int] = {}
    for i, g in enumerate(group):
        forest.up[i] = seen.setdefault(g, i)
    root = np.array([forest.root(i) for i in range(len(sets))])
    out = []
    order = np.flatnonzero(fresh)
    for i in order.tolist():
        near = (root != root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        at = np.flatnonzero(near)
        at = at[(keys[at] == keys[i]).any(axis=1)]
        if not len(at):
            continue
        larger = (registers[i] > registers[at]).sum(axis=1)
        smaller = (registers[i] < registers[at]).sum(axis=1)
        ok = plausible(larger, smaller, registers.shape[1], size[i], size[at], percent)
        at = at[ok][np.argsort((larger + smaller)[ok], kind="stable")]  # the likeliest first
        for j in at.tolist():
            if root[i] == root[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (size[i] + size[j] - shared):
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def document_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, n_shingles, digest of the set, band keys) of every row."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = clean(b["text"])
            for lo, hi in chunks(texts):
                sets = shingle_sets(words_of(texts[lo:hi], SOLID), shingle)
                part = b.iloc[lo:hi]
                digests = [(int(np.add.reduce(s)), int(np.bitwise_xor.reduce(mix(s)))) for s in sets]
                distinct = dict(zip(digests, sets))
                at = dict(zip(distinct, range(len(distinct))))
                keys = band_keys(sketches(list(distinct.values()))).view(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "row": part["row"],
                        "n": [len(s) for s in sets],
                        "d1": np.array([d for d, _ in digests], np.uint64).view(np.int64),
                        "d2": np.array([d for _, d in digests], np.uint64).view(np.int64),
                        "bands": [keys[at[d]].tobytes() for d in digests],
                    }
                )

    text_batches(docs.sparkSession)
    return map_frames(keyed(docs), build, "doc_id bigint, row bigint, n bigint, d1 bigint, d2 bigint, bands binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(node, key) of all bands."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = np.frombuffer(b"".join(b["bands"]), np.int64)
            yield pd.DataFrame({"node": np.repeat(b["node"].to_numpy(np.int64), len(keys) // max(1, len(b))), "key": keys})

    return map_frames(nodes.select("node", "bands"), unpack, "node bigint, key bigint")


_LINKS = "a bigint, b bigint"


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes with the text of the document that stands for them."""
    texts = keyed(docs).groupBy(F.col("doc_id").alias("node"), "row").agg(F.first("text").alias("text"))
    return nodes.join(texts, ["node", "row"])


def _link_groups(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["node", "row"])
    texts, sets = pdf["text"].tolist(), []
    for lo, hi in chunks(texts):
        sets += shingle_sets(words_of(texts[lo:hi], SOLID), shingle)
    node = pdf["node"].to_numpy(np.int64)
    found = spanning_links(sets, pdf["part"].tolist(), pdf["fresh"].to_numpy(bool), percent)
    return pd.DataFrame([(node[i], node[j]) for i, j in found], columns=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    link_groups = lambda pdf: _link_groups(pdf, shingle, percent)
    rows = durable(document_sets(docs, shingle))
    filled = rows.where("doc_id IS NOT NULL AND n > 0")
    first = filled.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    first = durable(first.select("d1", "d2", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row")))
    # a set so small that one other shingle takes it below the threshold is linked with nothing
    linkable = filled.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    nodes = linkable.select(F.col("doc_id").alias("node"), "row", "n", "bands").join(first.select("node", "row"), ["node", "row"], "left_semi")

    bands = durable(_bands(nodes))
    shared = bands.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b < z").select("key", "b")
    star = bands.join(shared, "key").select(F.col("node").alias("a"), "b").where("a != b")
    families = durable(components(star))

    members = nodes.select("node", "row", "n").distinct().join(families, "node")
    weight = members.groupBy("root").agg(F.ceil(F.sum(F.col("n") + NODE_SHINGLES) / chunk_shingles).cast("int").alias("chunks"))
    placed = members.join(weight, "root").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int"))
    # the first node of a family of several chunks goes to all of them
    placed = durable(_texts(placed, docs))
    inner = placed.withColumn(
        "chunk", F.explode(F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk")))
    ).select("root", "chunk", "node", "row", "text", F.col("node").alias("part"), F.lit(True).alias("fresh"))
    links = durable(heavy(inner, "root", "chunk").groupBy("root", "chunk").applyInPandas(link_groups, _LINKS))

    wide = placed.where("chunks > 1")
    if not wide.isEmpty():
        links = links.unionByName(_finish(wide, links, chunk_shingles, link_groups))
    joined = components(links)

    roots = joined.select(F.col("node").alias("__node"), "root")
    labelled = first.join(roots, F.col("node") == F.col("__node"), "left").select(
        F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), F.coalesce("root", "node").alias("component_id")
    )
    same = (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")) & F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.coalesce("component_id", "doc_id")
    return rows.join(labelled, same, "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _finish(wide: DataFrame, links: DataFrame, chunk_shingles: int, link_groups) -> DataFrame:
    """Links of families of several chunks that join different components found so far."""
    done = components(links).select("node", F.col("root").alias("part"))
    state = durable(wide.join(done, "node", "left").withColumn("part", F.coalesce("part", "node")))
    size = state.groupBy("root", "part").agg(F.sum("n").alias("n"))
    largest = size.groupBy("root").agg(F.max(F.struct("n", "part")).alias("best"), F.count(F.lit(1)).alias("parts"))
    largest = largest.where("parts > 1").select("root", F.col("best.part").alias("main"))
    state = state.join(largest, "root")
    loose = state.where(F.col("part") != F.col("main"))
    blocks = loose.groupBy("root").agg(F.ceil(F.sum(F.col("n") + NODE_SHINGLES) / chunk_shingles).cast("int").alias("blocks"))
    loose = loose.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    columns = ["root", "block", "chunk", "node", "row", "text", "part", "fresh"]
    asked = loose.withColumn("chunk", F.explode(every)).withColumn("fresh", F.lit(True)).select(columns)
    given = state.join(blocks, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("fresh", F.lit(False))
    groups = asked.unionByName(given.select(columns))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return link_groups(pdf.sort_values("fresh", ascending=False, kind="stable"))

    return durable(heavy(groups, "root", "block", "chunk").groupBy("root", "block", "chunk").applyInPandas(link, _LINKS))
