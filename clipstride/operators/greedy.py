"""Greedy suppression: best first, drop what conflicts with something kept.

What becomes of a row depends only on the better rows it conflicts with.  These pairs come
from an interval join and are worked on in blocks of time, so no recording is put into one
task and no row is gathered: a block holds ids and pairs of ids.  See ``dropped``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipstride.operators.joins import interval_join
from clipstride.operators.scan import dealt, time_bucket
from clipstride.operators.store import written

#: Rows of other blocks that a block may depend on for it to be told as a table of all their fates; growth of the blocks.
INPUTS, WIDER = 10, 8


def _fates(nodes: list[int], pairs: Iterable[tuple[int, int]]) -> tuple[dict[int, int | None], list[int]]:
    """What becomes of a block's rows, and the rows outside that it depends on.

    A fate is a number with a bit for each case of the outside rows (kept or not): is the
    row kept then?  With more than INPUTS outside rows there is one case in which they are
    unknown, and the fate of a row that depends on them is None.
    """
    within, waiting = set(nodes), dict.fromkeys(nodes, 0)
    worse: dict[int, list[int]] = {}
    outside: dict[int, None] = {}
    for b, w in pairs:
        worse.setdefault(b, []).append(w)
        if b in within:
            waiting[w] += 1
        else:
            outside[b] = None
    inputs = sorted(outside)
    told = len(inputs) <= INPUTS
    cases = 1 << len(inputs) if told else 1
    every = (1 << cases) - 1
    against: dict[int, int] = dict.fromkeys(nodes, 0)  # cases in which a better row is kept
    unsure: set[int] = set()
    for i, b in enumerate(inputs):
        if told:  # the cases with bit i set
            kept = sum(1 << c for c in range(cases) if c >> i & 1)
        for w in worse[b]:
            if told:
                against[w] |= kept
            else:
                unsure.add(w)
    fates: dict[int, int | None] = {}
    ready = [n for n in nodes if not waiting[n]]
    while ready:
        n = ready.pop()
        fate = every & ~against[n]
        fates[n] = None if fate and n in unsure else fate
        for w in worse.get(n, ()):
            against[w] |= fate if fates[n] is not None else 0
            if fates[n] is None:
                unsure.add(w)
            waiting[w] -= 1
            if not waiting[w]:
                ready.append(w)
    return fates, inputs if told else []


def _settle(keys: Sequence[str]):
    """Rows (keys, _id, kept, inputs, fate): fates that are certain, and those that other blocks wait for."""

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a block are in this partition: its rows (kind 0), pairs (1), and rows others wait for (2)."""
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        group, kind, better, worse = (table.column(c).to_numpy() for c in ("_group", "_kind", "_better", "_worse"))
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        at, ids, kept, inputs, tables = [], [], [], [], []
        for part in np.split(order, cuts):
            of = kind[part]
            nodes = worse[part[of == 0]].tolist()
            pairs = zip(better[part[of == 1]].tolist(), worse[part[of == 1]].tolist())
            awaited = set(worse[part[of == 2]].tolist())
            fates, needed = _fates(nodes, pairs)
            every = (1 << (1 << len(needed))) - 1
            for place, n in zip(part[of == 0].tolist(), nodes):
                fate = fates[n]
                if fate == 0 or fate == every:
                    at.append(place)
                    ids.append(n)
                    kept.append(fate != 0)
                    inputs.append([] if n in awaited else None)
                    tables.append(bytes([fate != 0]) if n in awaited else None)
                elif fate is not None and n in awaited:
                    at.append(place)
                    ids.append(n)
                    kept.append(None)
                    inputs.append(needed)
                    tables.append(fate.to_bytes((1 << len(needed)) // 8 + 1, "little"))
        own = table.take(pa.array(at, pa.int64())).combine_chunks()
        columns = [own.column(k).combine_chunks() if isinstance(own.column(k), pa.ChunkedArray) else own.column(k) for k in keys]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(ids, pa.int64()), pa.array(kept, pa.bool_()), pa.array(inputs, pa.list_(pa.int64())), pa.array(tables, pa.binary())],
            names=[*keys, "_id", "kept", "inputs", "fate"])

    return settle


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fates of rows that blocks wait for, from those of the rows they depend on; all rows of a key are in this partition."""
    told: dict[int, tuple[list[int], bytes]] = {}
    for batch in batches:
        for n, inputs, fate in zip(*(batch.column(c).to_pylist() for c in ("_id", "inputs", "fate"))):
            told[n] = inputs, fate
    known: dict[int, bool | None] = {}
    for first in told:
        path = [first]
        while path:  # what a row depends on is better, so this ends
            n = path[-1]
            if n in known or n not in told:
                known.setdefault(n, None)
                path.pop()
                continue
            inputs, fate = told[n]
            if more := [i for i in inputs if i not in known]:
                path.extend(more)
                continue
            path.pop()
            if any(known[i] is None for i in inputs):
                known[n] = None
            else:
                case = sum(1 << k for k, i in enumerate(inputs) if known[i])
                known[n] = bool(fate[case >> 3] >> (case & 7) & 1)
    sure = [(n, kept) for n, kept in known.items() if kept is not None and told[n][0]]
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sure], pa.int64()), pa.array([k for _, k in sure], pa.bool_())], names=["_id", "kept"])


def dropped(nodes: DataFrame, pairs: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Ids (``_id``) of rows that a kept row conflicts with.

    ``nodes``: keys, _id, _at (a place in time); ``pairs``: keys, _better, _worse and their places
    _better_at, _worse_at, one for each conflict.  Ids are unique over all keys.

    In each round a block of ``width`` seconds tells the fate of its rows.  Where that depends on
    rows of other blocks, it tells it for every case of theirs, and only these tables of the few rows
    that others wait for meet per key, to be read off one from the other.  So a chain of conflicts along
    a whole recording is settled by all its blocks, in two rounds.  What depends on too many
    rows at once waits for wider blocks.
    """
    keys = list(keys)
    open_, left, out, turn = written(pairs), nodes, None, 0

    def block(at: str) -> Column:
        return F.xxhash64(*keys, time_bucket(F.col(at), width))

    while not open_.isEmpty():
        none = F.lit(None).cast("long")
        awaited = open_.where(block("_better_at") != block("_worse_at")).select(
            *keys, block("_better_at").alias("_group"), F.lit(2).alias("_kind"), none.alias("_better"), F.col("_better").alias("_worse")).distinct()
        rows = left.select(*keys, block("_at").alias("_group"), F.lit(0).alias("_kind"), none.alias("_better"), F.col("_id").alias("_worse")).unionByName(
            open_.select(*keys, block("_worse_at").alias("_group"), F.lit(1).alias("_kind"), "_better", "_worse")).unionByName(awaited)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
        told = written(rows.repartition("_group").mapInArrow(
            _settle(keys), f"{kinds}, _id long, kept boolean, inputs array<long>, fate binary"))
        sure = told.where("kept is not null").select("_id", "kept")
        read = told.where("inputs is not null").repartition(*keys).mapInArrow(_resolve, "_id long, kept boolean")
        sure = written(sure.unionByName(read))
        beaten = open_.join(sure.where("kept").select(F.col("_id").alias("_better")), "_better", "left_semi").select(F.col("_worse").alias("_id"))
        sure = written(sure.unionByName(beaten.distinct().join(sure, "_id", "left_anti").withColumn("kept", F.lit(False))))
        gone = sure.where("not kept").select("_id")
        out = gone if out is None else out.unionByName(gone)
        known = sure.select("_id")
        open_ = written(open_.join(known.withColumnRenamed("_id", "_worse"), "_worse", "left_anti").join(
            known.withColumnRenamed("_id", "_better"), "_better", "left_anti"))
        left = written(left.join(known, "_id", "left_anti"))
        turn += 1
        width *= 1 if turn % 2 else WIDER  # every second round settles what the one before has told
    return nodes.select("_id").limit(0) if out is None else out


def _best(df: DataFrame, keys: Sequence[str], at: dict[str, Column], priority: Sequence[Column], tasks: int) -> DataFrame:
    """The best row per place, with an id, its priority and the whole row."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    names = list(at)
    placed = df.select(
        *keys, *[c.alias(n) for n, c in at.items()], F.struct(F.struct(*priority).alias("p"), F.struct(*rest).alias("row")).alias("_best"))
    best = dealt(placed, tasks, *keys, *names).groupBy(*keys, *names).agg(F.min("_best").alias("_best"))
    return written(best.select(*keys, *names, F.struct("_best.p", *names).alias("_order"), "_best.row").withColumn("_id", F.monotonically_increasing_id()))


def _pairs(keys: Sequence[str], conflict: Column, at: tuple[str, str], met: DataFrame) -> DataFrame:
    """Conflicts among pairs of rows ``met`` (columns with 1 and 2 behind), the better row first."""
    first = F.col("_order1") < F.col("_order2")

    def of(name: str, better: bool) -> Column:
        return F.when(first == F.lit(better), F.col(f"{name}1")).otherwise(F.col(f"{name}2"))

    return met.where(conflict).select(
        *keys, of("_id", True).alias("_better"), of("_id", False).alias("_worse"),
        of(at[0], True).alias("_better_at"), of(at[0], False).alias("_worse_at"))


def _sides(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    one, two = ([*keys, *[F.col(n).alias(f"{n}{k}") for n in names]] for k in (1, 2))
    return df.select(*one), df.select(*two)


def _rows(best: DataFrame, keys: Sequence[str], columns: Sequence[str], gone: DataFrame) -> DataFrame:
    return best.join(gone, "_id", "left_anti").select(*keys, "row.*").select(*columns)


def keep_spaced(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    priority: Sequence[Column],
    reach: float,
    *,
    strict: bool,
    width: float = 600.0,
    tasks: int = 0,
) -> DataFrame:
    """Keep rows greedily by ascending ``priority``; two kept rows are never near.

    Near means ``|a - b| < reach`` when ``strict``, else ``<= reach``.  Exact:

    * rows at the same position exclude each other, so only the best is carried on;
    * a row better than everything within ``reach`` is certainly kept and drops all of that;
    * what is left, plateaus of equal rows say, is settled by its conflicts (``dropped``).

    Rows are sorted in ``tasks`` tasks if a shuffle has fewer.
    """
    keys = list(keys)
    best = _best(df, keys, {"_pos": F.col(position).cast("double")}, priority, tasks)
    reach_out = reach + 1e-6  # a wider look only makes fewer peaks

    def around(rows: DataFrame, value: str, name: str) -> DataFrame:
        """Add the least ``value`` within reach; rows near the edge of a cell are looked at in both."""
        home = time_bucket(F.col("_pos"), width)
        cells = F.sequence(time_bucket(F.col("_pos") - reach_out, width), time_bucket(F.col("_pos") + reach_out, width))
        near = dealt(rows.withColumn("_home", home).withColumn("_cell", F.explode(cells)), tasks, *keys, "_cell")
        over = (f"{value} over (partition by {', '.join([*keys, '_cell'])} order by _pos "
                f"range between {reach_out:.6f}D preceding and {reach_out:.6f}D following)")
        return near.withColumn(name, F.expr(over)).where("_cell = _home").drop("_cell", "_home")

    slim = best.select(*keys, "_id", "_pos", "_order")
    peaks = written(around(slim, "min(_order)", "_top").withColumn("_peak", F.col("_top") == F.col("_order")).drop("_top"))
    tops = peaks.where("_peak")

    def near(a: str, b: str) -> Column:
        apart = F.abs(F.col(a) - F.col(b))
        return apart < reach if strict else apart <= reach

    def met(left: DataFrame, right: DataFrame, *, after: bool) -> DataFrame:
        """Pairs of positions within reach; ``after``: the second one behind the first, else on both sides."""
        back = F.lit(0.0) if after else F.lit(reach_out)
        spans = left.withColumns({"_lo": F.col("_pos1") - back, "_hi": F.col("_pos1") + reach_out})
        points = right.withColumn("_end", F.col("_pos2"))
        return interval_join(spans, points, keys, ("_lo", "_hi"), ("_pos2", "_end"), width=max(reach_out, 1.0), closed=True).drop("_lo", "_hi", "_end")

    names = ["_id", "_pos", "_order"]
    beaten = met(_sides(tops, keys, ["_pos"])[0], _sides(peaks.where("not _peak"), keys, ["_id", "_pos"])[1], after=False).where(
        near("_pos1", "_pos2")).select(F.col("_id2").alias("_id"))
    gone = written(beaten.distinct())
    rest = written(peaks.where("not _peak").join(gone, "_id", "left_anti"))
    pairs = _pairs(keys, near("_pos1", "_pos2") & (F.col("_id1") != F.col("_id2")), ("_pos", "_pos"), met(*_sides(rest, keys, names), after=True))
    more = dropped(rest.select(*keys, "_id", F.col("_pos").alias("_at")), pairs, keys, width)
    return _rows(best, keys, df.columns, gone.unionByName(more))


def keep_disjoint(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    priority: Sequence[Column],
    conflict: Callable[[Mapping[str, Column], Mapping[str, Column]], Column],
    *,
    width: float = 600.0,
    tasks: int = 0,
) -> DataFrame:
    """Keep intervals greedily; ``conflict(kept, candidate)`` sees ``["s"]`` and ``["e"]``.

    Intervals that do not overlap may never conflict, and a conflict holds both ways.  Of equal
    intervals only the best is carried on: a caller's rule must let an interval conflict with
    its own copy.  Rows are sorted in ``tasks`` tasks if a shuffle has fewer.
    """
    keys = list(keys)
    best = _best(df, keys, {"_s": F.col(start).cast("double"), "_e": F.col(end).cast("double")}, priority, tasks)
    left, right = _sides(best, keys, ["_id", "_s", "_e", "_order"])
    met = interval_join(left, right, keys, ("_s1", "_e1"), ("_s2", "_e2")).where("_id1 < _id2")
    rule = conflict({"s": F.col("_s1"), "e": F.col("_e1")}, {"s": F.col("_s2"), "e": F.col("_e2")})
    pairs = _pairs(keys, rule, ("_s", "_s"), met)
    gone = dropped(best.select(*keys, "_id", F.col("_s").alias("_at")), pairs, keys, width)
    return _rows(best, keys, df.columns, gone)
