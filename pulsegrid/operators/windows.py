"""Trailing, leading and positional windows.

Two grains are distinguished. *Day grain* means at most one row per
``by + date``: a group can never exceed the number of calendar days, so a plain
``Window.partitionBy(by)`` is bounded however large the table gets. *Row grain*
(activities, samples) has no such bound; there the rows are numbered with
:func:`row_positions` and framed through :func:`with_halo`, which cuts a long
group into blocks that carry the few neighbouring rows a bounded frame needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import durable

BLOCK = "_blk"
CORE = "_core"
#: Rows of one entity that a task numbers and sorts at once.
TASK_ROWS = 1_000_000


def day_order(by: Sequence[str], d: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(d)


# ------------------------------------------------------------------ day grain
def trailing(
    c: Column | str,
    by: Sequence[str],
    d: str,
    n: int,
    fn: str = "avg",
    min_periods: int = 1,
    shift: int = 0,
    frame: str = "rows",
) -> Column:
    """Aggregate of the last ``n`` rows (or days), ending ``shift`` rows ago.

    ``frame="rows"`` counts present rows and lets a calendar gap stretch the
    window; ``frame="days"`` is calendar-exact.
    """
    c = F.col(c) if isinstance(c, str) else c
    start, end = -(n - 1) - shift, -shift
    if frame == "rows":
        w = day_order(by, d).rowsBetween(start, end)
    else:
        w = Window.partitionBy(*by).orderBy(F.unix_date(F.col(d))).rangeBetween(start, end)
    value = {"avg": F.avg, "std": F.stddev_samp, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[fn](c)
    return F.when(F.count(c).over(w) >= min_periods, value.over(w))


def next_row(c: Column | str, by: Sequence[str], d: str = "date", n: int = 1) -> Column:
    """Value of the n-th following row of the entity."""
    return F.lead(c, n).over(day_order(by, d))


def ffill(c: Column | str, by: Sequence[str], d: str, limit: int) -> Column:
    """Carry the last non-null value forward over at most ``limit`` rows."""
    return F.last(c, ignorenulls=True).over(day_order(by, d).rowsBetween(-limit, 0))


def expanding_folds(df: DataFrame, by: Sequence[str], d: str, start: int = 30, step: int = 7) -> DataFrame:
    """Number the rows of each entity and assign expanding-window test folds.

    Adds ``row_idx`` and ``fold``: null for the initial training rows and for
    an incomplete tail block.
    """
    idx = F.row_number().over(day_order(by, d)) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    fold = F.floor((F.col("row_idx") - start) / step).cast("int")
    complete = start + step * (F.col("fold") + 1) <= F.col("_total")
    return (
        df.withColumns({"row_idx": idx, "_total": total})
        .withColumn("fold", F.when(F.col("row_idx") >= start, fold))
        .withColumn("fold", F.when(complete, F.col("fold")))
        .drop("_total")
    )


def tail_fraction(df: DataFrame, by: Sequence[str], d: str, fraction: float = 0.2) -> DataFrame:
    """The last ``fraction`` of each entity's rows (day grain)."""
    idx = F.row_number().over(day_order(by, d)) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    cut = F.floor(total * F.lit(1.0 - fraction))
    return df.withColumn("_tail", idx >= cut).where("_tail").drop("_tail")


# ------------------------------------------------------------------ row grain
def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last in ``order``.

    Written as rank ≤ 1 so Spark filters each map task before the exchange and
    a key with very many copies ships one row per task.
    """
    return last_n(df, keys, order, 1)


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The last ``n`` rows per entity in ``order``."""
    w = Window.partitionBy(*by).orderBy(*[F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per group in ``order``; optionally keep the rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return ranked.withColumnRenamed("_rn", rank) if rank else ranked.drop("_rn")


def row_positions(
    df: DataFrame, by: Sequence[str], coarse: Column, order: Sequence[str | Column], name: str = "row_pos", task_rows: int = TASK_ROWS
) -> DataFrame:
    """0-based position of every row within its entity; an entity of more than ``task_rows`` rows is no single task.

    ``coarse`` must be non-decreasing along ``order`` (a day, an hour, a sequence
    prefix). Rows without an entity are left out; so are rows without ``coarse``, but their places count, as the first ones. A large entity's rows are numbered
    inside each (entity, coarse) piece and shifted by the number of rows in earlier pieces, so that it
    spreads over its pieces. The others are numbered whole: where no entity is large, what
    is grouped by the entity afterwards needs no exchange of the rows. Counts the rows when called.
    """
    by = list(by)
    columns = [*by, *[c for c in df.columns if c not in by], name]
    known = [F.col(c).isNotNull() for c in by]
    keyed = df.where(reduce(and_, known)).withColumns({"_piece": coarse, "_placed": coarse.isNotNull()})
    large = durable(keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > task_rows).drop("_rows"))
    if large.isEmpty():
        inside = F.row_number().over(Window.partitionBy(*by).orderBy("_placed", *order))
        return keyed.drop("_piece").withColumn(name, inside.cast("long") - 1).where("_placed").select(*columns)
    piece = [*by, "_piece"]
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.join(F.broadcast(large), by, "left_semi")
        .groupBy(*piece)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*piece, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    # at most one row for every task_rows rows
    marked = keyed.join(F.broadcast(large.withColumn("_large", F.lit(True))), by, "left")
    inside = F.row_number().over(Window.partitionBy(*piece).orderBy("_placed", *order))
    return (
        marked.withColumn("_piece", F.when(F.col("_large"), F.col("_piece")))
        .withColumn("_inside", inside)
        .where("_placed")
        .join(starts, piece, "left")
        .withColumn(name, F.coalesce(F.col("_start"), F.lit(0)) + F.col("_inside") - 1)
        .select(*columns)
    )


def with_halo(df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut positions into blocks of ``size`` and copy the frame's edge rows over.

    Adds ``_blk`` and ``_core``. A row frame of up to ``before`` preceding and
    ``after`` following rows, evaluated per (entity, block), is exact on the core
    rows; drop the others afterwards with ``where("_core")``.
    """
    if before > size or after > size:
        raise ValueError("a halo may not be longer than a block")
    block = F.floor(F.col(pos) / size).cast("long")
    offset = F.col(pos) % size

    def copy(b: Column, core: bool) -> Column:
        return F.struct(b.alias(BLOCK), F.lit(core).alias(CORE))

    copies = [copy(block, True)]
    if before:
        copies.append(F.when(offset >= size - before, copy(block + 1, False)))
    if after:
        copies.append(F.when((offset < after) & (block > 0), copy(block - 1, False)))
    return (
        df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumns({BLOCK: F.col(f"_copy.{BLOCK}"), CORE: F.col(f"_copy.{CORE}")})
        .drop("_copy")
    )


def block_window(by: Sequence[str], pos: str, start: int, end: int) -> WindowSpec:
    return Window.partitionBy(*by, BLOCK).orderBy(pos).rowsBetween(start, end)


def centred_mean(c: Column | str, by: Sequence[str], pos: str, half: int = 7) -> Column:
    """Mean of the non-null values within ±half rows, 0.0 when there is none."""
    return F.coalesce(F.avg(c).over(block_window(by, pos, -half, half)), F.lit(0.0))


def lag_in_block(c: Column | str, by: Sequence[str], pos: str) -> Column:
    return F.lag(c, 1).over(Window.partitionBy(*by, BLOCK).orderBy(pos))


def rolling_mean_rows(
    df: DataFrame, by: Sequence[str], pos: str, c: str, n: int, name: str, size: int = 8192
) -> DataFrame:
    """Mean over full windows of ``n`` rows; null for the first n − 1 rows."""
    w = block_window(by, pos, -(n - 1), 0)
    return (
        with_halo(df, pos, size, before=n - 1)
        .withColumn(name, F.avg(c).over(w))
        .where(F.col(CORE))
        .withColumn(name, F.when(F.col(pos) >= n - 1, F.col(name)))
        .drop(BLOCK, CORE)
    )
