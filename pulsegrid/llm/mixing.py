"""Mixing sources to target weights by proportionate fair scheduling.

Documents of a source are dealt into blocks of ``block_docs``; one block goes to one
slot. With weight w of D parts, block i of a source is released at slot
floor(i D / w) and due before slot ceil((i + 1) D / w); the released block with the
earliest deadline gets the slot. So after every slot each source has had less than
one block more or less than its share. Weights are whole parts, so the schedule
repeats after D slots: one period (D entries) is laid out on the driver, and the
slot of any block follows by arithmetic.

When a source has no block left, the schedule starts again with the other sources at
their parts; ``mix_phase`` counts that. Phase 0 is the mixture at the full target
weights, later phases hold what the mixture cannot place. No document is dropped or
repeated.

Documents of a source are ordered by a hash of their id and text (so null or repeated ids are not one piece). They are numbered inside
pieces of about ``piece_docs`` documents, and the pieces' counts give the offsets, so
a source with a third of all rows is many pieces. Sources that have no weight, and null,
form one group with ``other`` parts. Repeated rows have places of their own. Columns
of ``docs`` are kept; columns of the same names as the new ones are replaced.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import unused

BLOCK_DOCS = 16
PIECE_DOCS = 4_000
OTHER = "other"
#: Parts of the mixture, by source; all further sources share the last entry.
TARGET_PARTS = {
    "src0": 12, "src1": 10, "src2": 9, "src3": 8, "src4": 8, "src5": 7, "src6": 7, "src7": 6, "src8": 6, "src9": 5,
    "src10": 5, "src11": 4, "src12": 4, "src13": 4, "src14": 3, "src15": 3, "src16": 3, "src17": 2, "src18": 2, "src19": 2,
    OTHER: 1,
}


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """Slots of every source's blocks in one period of sum(parts) slots."""
    total = sum(parts.values())
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for t in range(total):
        released = [s for s, w in parts.items() if len(slots[s]) < w and len(slots[s]) * total // w <= t]
        due = min(released, key=lambda s: (-(-(len(slots[s]) + 1) * total // parts[s]), s))
        slots[due].append(t)
    return slots


def _slot(i: int, w: int, total: int, at: list[int]) -> int:
    return i // w * total + at[i % w]


def phases(blocks: dict[str, int], parts: dict[str, int]) -> list[tuple[str, int, int, int, int, int, int, list[int]]]:
    """Rows (source, phase, first block, end block, first slot, parts, period, slots in the period).

    A phase ends at the first slot whose source has no block left for it.
    """
    done, base, out = dict.fromkeys(blocks, 0), 0, []
    for phase in range(len(blocks)):
        left = {s: n - done[s] for s, n in blocks.items() if n > done[s]}
        if not left:
            break
        scale = gcd(*(parts[s] for s in left))
        own = {s: parts[s] // scale for s in left}
        total, at = sum(own.values()), period(own)
        length = min(_slot(left[s], own[s], total, at[s]) for s in left)
        for s in left:
            n = length // total * own[s] + sum(x < length % total for x in at[s])
            if n:
                out.append((s, phase, done[s], done[s] + n, base, own[s], total, at[s]))
            done[s] += n
        base += length
    return out


def mix(docs: DataFrame, parts: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS, piece_docs: int = PIECE_DOCS) -> DataFrame:
    """``docs`` with mix_source, mix_block, mix_phase, mix_slot and mix_offset (the place inside the block)."""
    parts = TARGET_PARTS if parts is None else parts
    if OTHER not in parts or min(parts.values()) < 1:
        raise ValueError("every source and 'other' needs at least one whole part")
    spark = docs.sparkSession
    new = ["mix_source", "mix_block", "mix_phase", "mix_slot", "mix_offset"]
    source = F.when(F.col("source").isin([s for s in parts if s != OTHER]), F.col("source")).otherwise(F.lit(OTHER))
    docs = docs.drop(*new)
    kept = docs.columns
    order, piece, place, piece_source, piece_at, piece_rows, start, of, first, end, base, weight, period_, slots = (
        unused(kept, f"__{name}") for name in "order piece place piece_source piece_at piece_rows start of first end base weight period slots".split()
    )
    # null and repeated ids are told apart by their texts
    by = [F.col(c) for c in ("doc_id", "text") if c in kept]
    docs = docs.withColumn("mix_source", source).withColumn(order, F.xxhash64(*by, F.lit(7)))
    # one row per weight at most
    counts = {r["mix_source"]: r["n"] for r in docs.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = max(1, -(-max(counts.values(), default=0) // piece_docs))
    docs = docs.withColumn(piece, F.pmod(order, F.lit(pieces)))
    earlier = Window.partitionBy("mix_source").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        docs.groupBy("mix_source", piece)
        .agg(F.count(F.lit(1)).alias(piece_rows))
        .select(F.col("mix_source").alias(piece_source), F.col(piece).alias(piece_at), F.coalesce(F.sum(piece_rows).over(earlier), F.lit(0)).alias(start))
    )
    inside = Window.partitionBy("mix_source", piece).orderBy(order, *by)
    numbered = docs.withColumn(place, F.row_number().over(inside) - 1)
    numbered = numbered.join(starts, (F.col("mix_source") == F.col(piece_source)) & (F.col(piece) == F.col(piece_at)))
    number = F.col(start) + F.col(place)
    numbered = numbered.withColumn("mix_block", F.floor(number / block_docs).cast("bigint")).withColumn("mix_offset", F.pmod(number, F.lit(block_docs)).cast("int"))
    plan = phases({s: -(-n // block_docs) for s, n in counts.items()}, parts)
    schema = f"`{of}` string, mix_phase int, `{first}` bigint, `{end}` bigint, `{base}` bigint, `{weight}` bigint, `{period_}` bigint, `{slots}` array<bigint>"
    table = spark.createDataFrame(plan, schema)
    placed = numbered.join(
        table, (F.col("mix_source") == F.col(of)) & (F.col("mix_block") >= F.col(first)) & (F.col("mix_block") < F.col(end))
    )
    i = F.col("mix_block") - F.col(first)
    slot = F.col(base) + F.floor(i / F.col(weight)) * F.col(period_) + F.element_at(slots, (i % F.col(weight) + 1).cast("int"))
    placed = placed.withColumn("mix_slot", slot.cast("bigint"))
    return placed.select(kept + new)


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture sorted by its schedule, range-partitioned, so that files in name order are the training order."""
    return mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
