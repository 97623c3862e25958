"""Ordered scans (rank, running sum, carry forward) that never put one key in one task.

A plain window over ``partitionBy(doc)`` sends a whole document to one task. Here the rows of a
key are split by *levels*: integer columns, coarse to fine, that follow the row order
(for example ``[block(page), page]``). Rows are scanned inside the finest level only; the
levels are summarised with ordinary (map-side combined) aggregates, the summaries are scanned,
and each row picks up what its level starts with through one equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperquay.session import cut_lineage, stored

BLOCK = 1 << 16


def block(col: Column | str, size: int = BLOCK) -> Column:
    """Order-keeping group number: at most ``size`` distinct integer values share one."""
    c = F.col(col) if isinstance(col, str) else col
    return (c - F.pmod(c, F.lit(size))).cast("long")


def _before(parts: Sequence[str], order: str):
    return W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _with_levels(df: DataFrame, levels: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__lv{i}" for i in range(len(levels))]
    return df.withColumns(dict(zip(names, levels))), names


def _starts(tails: DataFrame, keys, names, cols, fold, scan, merge) -> DataFrame:
    """State at the start of every finest level, from the per-level summaries in ``tails``.

    With several levels the summaries are read once per level, so they are written out first.
    """
    if len(names) > 1:
        tails = cut_lineage(tails)
    summaries = {len(names): tails}
    for depth in range(len(names) - 1, 0, -1):
        finer = names[depth]
        summaries[depth] = summaries[depth + 1].groupBy(*keys, *names[:depth]).agg(
            *[fold(c, finer).alias(c) for c in cols]
        )
    starts = None
    for depth in range(1, len(names) + 1):
        parent = [*keys, *names[: depth - 1]]
        here = summaries[depth].select(
            *keys,
            *names[:depth],
            *[scan(c, _before(parent, names[depth - 1])).alias(f"__s_{c}") for c in cols],
        )
        if starts is not None:
            up = starts.select(*parent, *[F.col(f"__s_{c}").alias(f"__u_{c}") for c in cols])
            here = here.join(up, parent, "inner").select(
                *keys,
                *names[:depth],
                *[merge(F.col(f"__s_{c}"), F.col(f"__u_{c}")).alias(f"__s_{c}") for c in cols],
            )
        starts = here
    return starts


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    levels: Sequence[Column],
) -> DataFrame:
    """Add inclusive running sums of ``sums`` per key in ``order``."""
    keys, cols = list(keys), [f"__r{i}" for i in range(len(sums))]
    d, names = _with_levels(df.withColumns({c: e.cast("long") for c, e in zip(cols, sums.values())}), levels)
    tails = d.groupBy(*keys, *names).agg(*[F.sum(c).alias(c) for c in cols])
    starts = _starts(
        tails, keys, names, cols,
        fold=lambda c, _: F.sum(c),
        scan=lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)),
        merge=lambda own, up: own + up,
    )
    w = W.partitionBy(*keys, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = d.withColumns({c: F.sum(c).over(w) for c in cols})
    out = local.join(starts, [*keys, *names], "inner")
    return out.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(c) + F.col(f"__s_{c}")).alias(n) for c, n in zip(cols, sums)],
    )


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], levels: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """1-based row number per key; ``order`` must be a total order within the key."""
    return running_sums(df, keys, order, {name: F.lit(1)}, levels)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    levels: Sequence[Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add the last non-null value at (or, if not ``inclusive``, before) each row per key."""
    keys, cols = list(keys), [f"__r{i}" for i in range(len(values))]
    d, names = _with_levels(df.withColumns(dict(zip(cols, values.values()))), levels)
    when = F.struct(*[F.col(o) for o in order])
    tails = d.groupBy(*keys, *names).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in cols]
    )
    starts = _starts(
        tails, keys, names, cols,
        fold=lambda c, lv: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(lv))),
        scan=lambda c, w: F.last(c, ignorenulls=True).over(w),
        merge=lambda own, up: F.coalesce(own, up),
    )
    w = W.partitionBy(*keys, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = d.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    out = local.join(starts, [*keys, *names], "inner")
    return out.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col(c), F.col(f"__s_{c}")).alias(n) for c, n in zip(cols, values)],
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """1-based position of every row in one total order, without a single-task window.

    Rows are range-partitioned and sorted, written once, and numbered inside their partition;
    the only table that is scanned as a whole has one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("__id"), 33)
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    w = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    # One row per range partition: the partition count bounds the broadcast.
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, within + F.col("__start") + 1)
        .drop("__id", "__part", "__start")
    )


class Listing:
    """Rows in one order, to be read page by page: an index of keys in written ranges.

    The index is made once, by one range shuffle of ``key`` (unique) and the columns ``reads`` of the
    order. The driver keeps one number per range, as many as shuffles have partitions; a page reads
    only the ranges it lies in, and sorts nothing. Later changes of the rows are not seen.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], reads: Sequence[str], key: str) -> None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = df.select(*dict.fromkeys([key, *reads])).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        at = F.monotonically_increasing_id()
        self.key = key
        self.index = stored(
            ranges.select(key, at.alias("__id")).select(
                key, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.shiftright("__id", 33).cast("int").alias("range")
            ),
            "listing", "range",
        )
        sizes = self.index.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()
        self.starts, self.total = [], 0
        for r in sorted(sizes):
            self.starts.append((r["range"], self.total, r["n"]))
            self.total += r["n"]

    def keys(self, page: int, size: int) -> DataFrame:
        """Keys of a 1-based page; a page past the end gives the last page."""
        last = max(1, -(-self.total // size))
        skip = (min(max(page, 1), last) - 1) * size
        mine = [(r, skip - start) for r, start, n in self.starts if start < skip + size and start + n > skip]
        low = F.lit(0)
        for r, first in mine:
            low = F.when(F.col("range") == r, first).otherwise(low)
        return (
            self.index.filter(F.col("range").isin([r for r, _ in mine]))
            .filter((F.col("at") >= low) & (F.col("at") < low + size)).select(self.key)
        )

    def page(self, df: DataFrame, page: int, size: int) -> DataFrame:
        """The rows of a page, in no order."""
        return df.join(self.keys(page, size), self.key, "left_semi").select(*df.columns)


def look_ahead(
    df: DataFrame, keys: Sequence[str], idx: str, width: int, into: str, size: int = BLOCK, part: str | None = None,
    of: Sequence[str] | None = None,
) -> DataFrame:
    """Add the array of this row and up to ``width - 1`` following rows of the key, in ``idx`` order.

    The array holds the columns ``of`` (all but the keys).

    ``idx`` must be dense per key. The first rows of a block are copied to the block before, so
    the frame can cross the block edge while each task still sees a bounded block. ``part`` keeps
    the block number as a column; rows stay partitioned by it and the keys.
    """
    keys = list(keys)
    payload = list(of or [c for c in df.columns if c not in keys])
    own = block(idx, size)
    edge = F.pmod(F.col(idx), F.lit(size)) < width - 1
    blocks = F.when(edge & (own > 0), F.array(own, own - size)).otherwise(F.array(own))
    placed = df.withColumn("__home", own).withColumn("__blk", F.explode(blocks))
    w = W.partitionBy(*keys, "__blk").orderBy(idx).rowsBetween(0, width - 1)
    out = placed.withColumn(into, F.collect_list(F.struct(*payload)).over(w)).filter(F.col("__blk") == F.col("__home"))
    return (out.withColumnRenamed("__blk", part) if part else out.drop("__blk")).drop("__home")


def join_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: Column,
    sep: str,
    part: Column,
    into: str,
) -> DataFrame:
    """One string per key: ``text`` values in ``order`` joined by ``sep`` (nulls skipped).

    Built in two steps over ``part`` (an order-keeping group number), so that no task collects
    all pieces of a long key as separate rows.
    """
    first = (
        df.select(*keys, part.alias("__part"), F.struct(*order, text.alias("__t")).alias("__e"))
        .filter(F.col("__e.__t").isNotNull())
        .groupBy(*keys, "__part")
        .agg(_joined("__e", "__t", sep).alias("__t"))
    )
    return first.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__part", "__t"))), lambda e: e["__t"]), sep).alias(into)
    )


def _joined(elem: str, text: str, sep: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.col(elem))), lambda e: e[text]), sep)
