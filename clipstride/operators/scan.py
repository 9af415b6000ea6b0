"""Running aggregates that do not put a whole key into one task.

``Window.partitionBy(job)`` sends every row of a job to one task.  A job may hold
a large share of a table, so running values are computed in two levels instead:
rows are cut into buckets that follow the sort order, each bucket is aggregated
(with map-side combine), a window over those few bucket rows gives the value
carried into each bucket, and the fine-grained window runs per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is max, min or sum of ``value``."""

    kind: str
    value: Column
    inclusive: bool = False


def time_bucket(position: Column, width: float) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def dealt(df: DataFrame, tasks: int, *by: str) -> DataFrame:
    """``df`` dealt to ``tasks`` by these columns, where a shuffle would make fewer."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by) if tasks > usual else df


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    tasks: int = 0,
    **columns: Running,
) -> DataFrame:
    """Add running aggregates over ``keys`` in ``order``.

    ``bucket`` must be non-decreasing along ``order`` and ``order`` must be total
    within a key.  Exclusive values are null (max, min) or 0 (sum) on the first row.
    Rows are sorted in ``tasks`` tasks if a shuffle has fewer.
    """
    keys = list(keys)
    cut = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    for name, agg in columns.items():
        rows = rows.withColumn(f"_v_{name}", agg.value)
    totals = rows.groupBy(*cut).agg(
        *[_AGG[a.kind](f"_v_{n}").alias(f"_t_{n}") for n, a in columns.items()]
    )
    # without keys one row for each bucket meets in one task
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *cut,
        *[_AGG[a.kind](f"_t_{n}").over(before).alias(f"_c_{n}") for n, a in columns.items()],
    )
    out = dealt(rows, tasks, *cut).join(carried, cut)
    for name, agg in columns.items():
        local = (
            Window.partitionBy(*cut)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0 if agg.inclusive else -1)
        )
        here = _AGG[agg.kind](f"_v_{name}").over(local)
        carry = F.col(f"_c_{name}")
        if agg.kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif agg.kind == "max":
            value = F.greatest(here, carry)
        else:
            value = F.least(here, carry)
        out = out.withColumn(name, value)
    return out.drop(
        "_bucket", *[f"_v_{n}" for n in columns], *[f"_c_{n}" for n in columns]
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "ordinal",
    tasks: int = 0,
) -> DataFrame:
    """0-based position of each row inside its key."""
    return running(df, keys, bucket, order, tasks, **{name: Running("sum", F.lit(1).cast("long"))})


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    *,
    gap: float = 0.0,
    touching_joins: bool = True,
    width: float = 600.0,
    name: str = "island_start",
) -> DataFrame:
    """Label each interval with the start of the merged run it belongs to.

    Intervals join a run while ``start <= running end + gap`` (or ``<`` when
    ``touching_joins`` is false).
    """
    bucket = time_bucket(F.col(start), width)
    order = [F.col(start), F.col(end)]
    reach = running(
        df, keys, bucket, _total(df, order), _reach=Running("max", F.col(end).cast("double"))
    )
    limit = F.col("_reach") + F.lit(gap)
    apart = F.col(start) > limit if touching_joins else F.col(start) >= limit
    opens = F.when(F.col("_reach").isNull() | apart, F.col(start).cast("double"))
    return running(
        reach, keys, bucket, _total(df, order), **{name: Running("max", opens, inclusive=True)}
    ).drop("_reach")


def _total(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """Make an order total with the remaining sortable columns."""
    rest = [
        F.col(f"`{f.name}`")
        for f in df.schema.fields
        if f.dataType.typeName() not in ("map", "variant")
    ]
    return [*order, *rest]


#: Cut points per key are SIDE * SIDE quantiles; keys of fewer distinct values than this many are not cut.
SIDE, UNCUT = 16, 4096


def by_value(rows: DataFrame, keys: Sequence[str], value: str, *, descending: bool = False):
    """Add ``_slot``, ranges of ``value`` that hold about equally many rows of their key.

    Slots follow the (ascending or descending) order of the value, so a key is ranked by many
    tasks.  They are cut at quantiles, from a sketch that is merged per key (the whole table
    without ``keys``), so a few values far from the rest do not crowd the others into one slot.
    Callers collapse rows to distinct values first, without nulls.
    """
    keys = list(keys)
    share = [(i + 1) / (SIDE * SIDE) for i in range(SIDE * SIDE - 1)]
    cuts = F.percentile_approx(F.col(value).cast("double"), F.lit(share), F.lit(2000))
    none = F.array().cast("array<double>")
    sketch = rows.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > UNCUT, cuts).otherwise(none).alias("_cuts"))
    # coarse cuts first, then those between two of them
    if keys:
        cut = rows.join(sketch, keys)
    else:
        cut = rows.withColumn("_cuts", sketch.scalar())
    coarse = F.filter("_cuts", lambda x, i: (i % SIDE == SIDE - 1) & (x < F.col(value)))
    fine = F.filter(F.slice("_cuts", F.col("_whole") * SIDE + 1, SIDE), lambda x: x < F.col(value))
    slot = (F.col("_whole") * SIDE + F.size(fine)).cast("long")
    return cut.withColumn("_whole", F.size(coarse)).withColumn("_slot", -slot if descending else slot).drop("_cuts", "_whole")


def counts_before(df: DataFrame, keys: Sequence[str], value: str, *, descending: bool = False) -> DataFrame:
    """Per distinct (key, value): ``n`` rows have it and ``before`` rows come first.  Null values take no part."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    return running(
        by_value(counts, keys, value, descending=descending), keys, F.col("_slot"), [order],
        before=Running("sum", F.col("n")),
    ).drop("_slot")
