"""Building blocks that keep per-group work bounded when one group holds a large share of all rows.

* ``with_position``    dense 0-based position inside a group; huge groups are spread by range.
* ``attach``           join one row per group onto the rows of the group, salted.
* ``exact_quantiles``  interpolated quantiles; huge groups go through positions instead of buffers.
* ``explode_range``    emit an integer range in two steps, so one row never builds a huge array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from vocalgrid.session import pinned

MAX_GROUP_ROWS_CONF = "vocalgrid.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000
SALTS = 16


def max_group_rows(df: DataFrame, wide_types: tuple[type, ...] = (ArrayType, BinaryType)) -> int:
    """Most rows one task may sort as a single group; a hundredth where rows carry whole frames (or other ``wide_types``)."""
    limit = int(df.sparkSession.conf.get(MAX_GROUP_ROWS_CONF, str(DEFAULT_MAX_GROUP_ROWS)))
    wide = any(isinstance(f.dataType, wide_types) for f in df.schema)
    return limit // 100 if wide else limit


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group (key columns only are read; combined before the shuffle)."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def _as_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "frame_idx",
    group_limit: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group. ``order`` must be unique inside a group.

    The biggest group is measured first, unless the caller knows it (``largest``). If a task can hold it, a plain window is used. Otherwise
    the rows are range-partitioned on keys and order (which splits any group, however large), and
    each partition adds the group's row count in the partitions before it.
    """
    # The rows are sorted whole, and a string may be a whole text.
    limit = max_group_rows(df, (ArrayType, BinaryType, StringType)) if group_limit is None else group_limit
    columns = _as_columns(order)
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.withColumn(name, (F.row_number().over(window.orderBy(*columns)) - 1).cast("long"))
    return _position_by_range(df, list(keys), columns, name)


def _position_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    sort = [F.col(k) for k in keys] + order
    spread = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # The id counts rows inside a partition, so pinning the ranged rows fixes part and place.
    placed = pinned(spread.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    # Keys stand in a struct, so that the rows of a null key meet theirs too.
    placed = placed.withColumn("_part", part).withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    pieces = placed.groupBy("_key", "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # One row per (group, partition): the window below is bounded by the number of partitions.
    before = Window.partitionBy("_key").orderBy("_part")
    pieces = pieces.withColumn(
        "_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_key", "_part", (F.col("_before") - F.col("_first")).alias("_shift"))
    if keys:
        joined = attach(placed, pieces, ["_key", "_part"], spread_on=["_place"])
    else:
        # One row per partition, so the wide rows stay where they are.
        joined = placed.join(F.broadcast(pieces.drop("_key")), "_part")
    return joined.withColumn(name, (F.col("_place") + F.col("_shift")).cast("long")).drop(
        "_place", "_part", "_shift", "_key"
    )


def attach(
    df: DataFrame,
    per_group: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join one row per group onto the group's rows.

    Spark broadcasts the copies of ``per_group`` when their size is under the session's threshold. For
    the other case the rows carry a salt from ``spread_on`` and the small side is repeated per salt, so
    a hot group is cut into ``salts`` partitions; the output is also never taken as already grouped by
    ``keys`` alone, which would pin a later finer grouping to the hot partition.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int"))
    # Spark's estimate of a join counts the copies; that of an explode takes all of them for one. Each half of the
    # groups meets its own row per salt, so the copies come from a hash join.
    every = df.sparkSession.range(0, 2 * salts, 1, 1).select(
        (F.col("id") % 2 == 0).alias("_half"), F.shiftright("id", 1).cast("int").alias("_salt")
    )
    halved = per_group.withColumn("_half", F.xxhash64(*keys) % 2 == 0)
    copies = halved.join(F.broadcast(every), "_half").drop("_half")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_group_size(df: DataFrame, keys: Sequence[str], spread_on: Sequence[str], name: str = "n") -> DataFrame:
    """Add the group's row count to every row without a window over the whole group."""
    return attach(df, group_size(df, keys, name), keys, spread_on)


def halo_copies(df: DataFrame, idx: str, block: int, before: int, after: int, name: str = "block") -> DataFrame:
    """Copy each row into every block whose own span, widened by the halo, covers it."""
    position = F.col(idx)
    low = F.floor((position - F.lit(after)) / F.lit(block))
    high = F.floor((position + F.lit(before)) / F.lit(block))
    if before == 0 and after == 0:
        return df.withColumn(name, low.cast("long"))
    return df.withColumn(name, F.explode(F.sequence(low.cast("long"), high.cast("long"))))


def in_own_block(idx: str, block: int, name: str = "block") -> Column:
    """True for rows that belong to the block, false for halo copies."""
    return F.floor(F.col(idx) / F.lit(block)) == F.col(name)


def to_blocks(df: DataFrame, keys: Sequence[str], idx: str, value: str, block: int) -> DataFrame:
    """Rows of a series to one array per (keys, block) of ``block`` values, the last one shorter.

    Later steps then move arrays instead of rows. ``idx`` becomes the block's number.
    """
    placed = df.select(*keys, F.floor(F.col(idx) / block).cast("long").alias("_b"), F.struct(idx, value).alias("_r"))
    gathered = placed.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return gathered.select(*keys, F.col("_b").alias(idx), F.col(f"_r.{value}").alias(value))


def block_neighbours(
    blocks: DataFrame, keys: Sequence[str], idx: str, value: str, before: int, after: int
) -> DataFrame:
    """Give each block the last ``before`` values of the one ahead and the first ``after`` of the next.

    Adds ``_head`` and ``_tail`` (null at the ends). Only these ends are copied; a block that exists
    merely as a neighbour has a null ``value``.
    """
    size = F.size(value)
    part = "part"
    own = F.struct(F.col(idx).alias("b"), F.lit(0).alias(part), F.col(value).alias("v"))
    head = F.struct(
        (F.col(idx) + 1).alias("b"), F.lit(1).alias(part),
        F.slice(value, F.greatest(size - before + 1, F.lit(1)), F.lit(before)).alias("v"),
    )
    tail = F.struct((F.col(idx) - 1).alias("b"), F.lit(2).alias(part), F.slice(value, 1, after).alias("v"))
    pieces = blocks.select(*keys, F.explode(F.array(own, head, tail)).alias("_p"))

    def pick(which: int) -> Column:
        return F.first(F.when(F.col("_p.part") == which, F.col("_p.v")), ignorenulls=True)

    return pieces.groupBy(*keys, F.col("_p.b").alias(idx)).agg(
        pick(0).alias(value), pick(1).alias("_head"), pick(2).alias("_tail")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    group_limit: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group as ``quantiles ARRAY<DOUBLE>``; nulls are skipped."""
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    probs = [float(p) for p in probabilities]
    # Equal values fold into one weighted row before anything is sorted.
    folded = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    limit = max_group_rows(df) if group_limit is None else group_limit
    if largest_group(folded, keys) <= limit:
        wanted = F.array(*[F.lit(p) for p in probs])
        result = F.percentile("_v", wanted, F.col("_w")).alias("quantiles")
        return folded.groupBy(*keys).agg(result)
    placed = _position_by_range(
        known.withColumn("_u", F.monotonically_increasing_id()), list(keys), [F.col("_v"), F.col("_u")], "_pos"
    )
    size = group_size(known, keys, "_n")
    targets = size.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in probs]))).withColumn(
        "_at", F.col("_p") * (F.col("_n") - 1)
    )
    ends = targets.withColumn(
        "_pos", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))
    )
    picked = placed.select(*keys, "_pos", "_v").join(ends, [*keys, "_pos"])
    share = F.col("_at") - F.floor("_at")
    weight = F.when(F.col("_pos") == F.floor("_at"), 1 - share).otherwise(share)
    per_p = picked.groupBy(*keys, "_p").agg(F.sum(weight * F.col("_v")).alias("_q"))
    columns = F.array(*[F.max(F.when(F.col("_p") == p, F.col("_q"))) for p in probs])
    return per_p.groupBy(*keys).agg(columns.alias("quantiles"))


def explode_range(df: DataFrame, start: Column, stop: Column, name: str, block: int = 4096) -> DataFrame:
    """One row per integer in [start, stop); nothing for empty ranges. Blocks first, then members."""
    size = F.lit(block)
    spans = (
        df.withColumn("_a", start.cast("long"))
        .withColumn("_z", stop.cast("long"))
        .where("_a < _z")
        .withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_z") - 1) / size))))
    )
    low = F.greatest(F.col("_a"), F.col("_b") * size)
    high = F.least(F.col("_z"), (F.col("_b") + 1) * size) - 1
    return spans.withColumn(name, F.explode(F.sequence(low.cast("long"), high.cast("long")))).drop("_a", "_z", "_b")
