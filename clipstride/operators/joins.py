"""Interval joins cut by time, so that a long recording is joined by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.operators.scan import time_bucket


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    width: float = 30.0,
    closed: bool = False,
) -> DataFrame:
    """All pairs of equal ``on`` whose spans overlap.

    Cells double in width from level to level.  A span's home is the lowest level at
    which it touches at most two cells, so a long span has few rows like a short one.
    Two spans that overlap meet where the longer one is at home: in its cells, or in
    the cells that lie above the other's.  Each side is sent to its home and, of the
    levels above, to those that the other side has, at most some sixty however long
    the spans are.  A pair is kept only in the first cell both touch, so it appears
    once.  ``width`` is that of the lowest cells; ``closed`` also accepts spans that only
    touch.  Spans without a start or an end meet nothing.
    """
    on = list(on)
    ls, le = left_span
    rs, re_ = right_span

    def at_home(df: DataFrame, start: str, end: str) -> DataFrame:
        first = _cell(F.col(start), width)
        apart = F.greatest(F.lit(0).cast("long"), _cell(F.col(end), width) - first)
        home = F.when(apart <= 1, F.lit(0)).otherwise(F.length(F.bin(apart - 1)))
        return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns(
            {"_first": first, "_last": first + apart, "_home": home})

    def levels(df: DataFrame, start: str, end: str) -> Column:
        """The levels that a side is at home on: one row, however long the side is."""
        return at_home(df.select(start, end), start, end).agg(F.collect_set("_home")).scalar()

    def cells(df: DataFrame, levels: Column, name: str) -> DataFrame:
        """A row for each cell that the spans touch on the given levels, from their home up."""
        spread = df.withColumn("_level", F.explode(levels)).where("_level >= _home")
        low, high = (F.expr(f"shiftright({c}, _level)") for c in ("_first", "_last"))
        return spread.withColumns({name: low, "_high": high}).withColumn("_at", F.explode(F.sequence(name, "_high"))).drop(
            "_first", "_last", "_home", "_high")

    a, b = at_home(left, ls, le), at_home(right, rs, re_)
    own = F.array(F.col("_home"))
    meet = [*on, "_level", "_at"]
    up = cells(a, levels(right, rs, re_), "_low_l").join(cells(b, own, "_low_r"), meet)
    down = cells(a, own, "_low_l").join(cells(b.withColumn("_own", F.col("_home")), levels(left, ls, le), "_low_r").where("_level > _own"), meet)
    if closed:
        meets = (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le))
    else:
        meets = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    once = F.col("_at") == F.greatest("_low_l", "_low_r")
    return up.union(down.drop("_own")).where(meets & once).drop("_level", "_at", "_low_l", "_low_r")


#: Cells are numbered to this far from zero; what lies beyond shares the last one.
FAR = 1 << 60


def _cell(position: Column, width: float) -> Column:
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), time_bucket(position, width)))


def points_within(
    centres: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    centre: str,
    position: str,
    half: float,
    **sums: Column,
) -> DataFrame:
    """Sums over the points in ``[centre - half, centre + half]`` of each centre.

    No pair of centre and point is ever formed.  Points are collapsed to distinct
    positions, every distinct centre becomes two probes (its lower and upper bound),
    and one sorted pass per (key, bucket) reads the running sums at the probes.
    A bucket is wider than the range, so a range touches at most two of them.
    """
    keys = list(keys)
    width = 2.0 * half + 1.0
    names = list(sums)
    dots = (
        points.withColumn("_pos", F.col(position).cast("double"))
        .groupBy(*keys, "_pos")
        .agg(*[F.sum(expr).alias(n) for n, expr in sums.items()])
        .withColumn("_tie", F.lit(1))
        .withColumn("_c", F.lit(None).cast("double"))
    )
    spots = centres.select(*keys, F.col(centre).cast("double").alias("_c")).distinct()
    empty = [F.lit(None).cast(dots.schema[n].dataType).alias(n) for n in names]
    lower = spots.select(
        *keys, (F.col("_c") - half).alias("_pos"), *empty, F.lit(0).alias("_tie"), "_c"
    )
    upper = spots.select(
        *keys, (F.col("_c") + half).alias("_pos"), *empty, F.lit(2).alias("_tie"), "_c"
    )
    line = dots.unionByName(lower).unionByName(upper).withColumn(
        "_bucket", time_bucket(F.col("_pos"), width)
    )
    cut = Window.partitionBy(*keys, "_bucket")
    upto = cut.orderBy("_pos", "_tie", "_c").rowsBetween(Window.unboundedPreceding, 0)
    crosses = time_bucket(F.col("_c") + half, width) != F.col("_bucket")

    def contribution(n: str):
        run = F.coalesce(F.col(f"_run_{n}"), F.lit(0))
        whole = F.coalesce(F.col(f"_all_{n}"), F.lit(0))
        return F.when(F.col("_tie") == 2, run).otherwise(F.when(crosses, whole).otherwise(F.lit(0)) - run)

    read = line.select(
        *keys, "_c", "_tie", "_bucket",
        *[F.sum(n).over(upto).alias(f"_run_{n}") for n in names],
        *[F.sum(n).over(cut).alias(f"_all_{n}") for n in names],
    ).where("_c is not null")
    found = read.groupBy(*keys, "_c").agg(*[F.sum(contribution(n)).alias(n) for n in names])
    keyed = centres.withColumn("_c", F.col(centre).cast("double"))
    return keyed.join(found, [*keys, "_c"], "left").drop("_c")
