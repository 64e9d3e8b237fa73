"""Pairing off the rows of two frames one to one, without a key, within a tolerance.

Rows can pair that agree in every column but the floating ones, and in these within
atol + rtol * |b|. Whether all rows pair off is a question of matching, not of sorting: two floating
columns may tie in crossed order. It is answered in three steps, each over what the last one left:

1. Rows equal in every column cancel by count.
2. Floats are laid into grid cells so narrow that any two values of one cell are within the tolerance.
   Rows of one cell cancel, cell by cell, over several grids that are shifted against each other.
3. What is left has no partner in reach, or lost it to another row. Only rows near it matter: they are
   gathered from neighbouring cells, step by step, and in these groups a largest matching is found by
   augmenting paths, starting from the pairs there are.

Steps 1 and 2 are aggregations and windows over narrow cells; step 3 reads the surroundings of rows
that differ. No pairs of rows are listed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import product

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.sources.scratch import stored

#: The functions of step 3 travel with the plan, so that executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How far grids are shifted against each other, in widths of a cell.
SHIFTS = (0.0, 1 / 3, 2 / 3)


def _parts(c: Column, rtol: float, atol: float) -> tuple[Column, Column, Column]:
    """(linear, e, m): whether atol rules at a value, and beyond that the power of two below its size and
    how far it lies from there to the next, in steps of rtol."""
    edge = atol / rtol if rtol and atol else 1.0
    size = F.abs(c) / F.lit(edge)
    e = F.floor(F.log2(size))
    linear = F.lit(True) if not rtol else size <= 1 if atol else c == 0
    return linear, e, (size / F.pow(F.lit(2.0), e) - 1) / F.lit(rtol or 1.0)


def _cell(c: str, rtol: float, atol: float, shift: float) -> Column:
    """The cell of a value: any two values of one cell are within the tolerance. Null, NaN and infinities
    have cells of their own, as has every value without a tolerance."""
    value = F.col(c).cast("double")
    exact = F.coalesce(value.cast("string"), F.lit("null"))
    if not (rtol or atol):
        return exact
    linear, e, m = _parts(value, rtol, atol)
    steps = value / F.lit(atol or 1.0)
    straight = F.when(F.abs(steps) >= float(1 << 52), exact).otherwise(F.concat(F.lit("l"), F.floor(steps + shift).cast("string")))
    curved = F.concat_ws(":", F.signum(value).cast("int").cast("string"), e.cast("string"), F.floor(m + shift).cast("string"))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), exact).when(linear, straight).otherwise(curved)


def _place(c: str, rtol: float, atol: float) -> Column:
    """A whole number such that those of values within the tolerance are at most 2 apart; null for null, NaN
    and infinities. A step of it is as wide as the tolerance or wider."""
    value = F.col(c).cast("double")
    linear, e, m = _parts(value, rtol, atol)
    straight = value / F.lit(atol or 1.0)
    # Beyond the linear part, or (without one) beyond the smallest double, a power of two is 1 / rtol steps.
    start = 1 / rtol if rtol and atol else 1100 / rtol if rtol else 0.0
    height = F.when(linear, straight).otherwise(F.signum(value) * (F.lit(start) + e / F.lit(rtol or 1.0) + m))
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.floor(F.least(F.greatest(height * 0.49, F.lit(-1e18)), F.lit(1e18))))


def _cancelled(rows: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """rows (exact, floats, net) without those that a row of the other side cancels in the same cell.

    Within a cell, running sums tell which rows go: of the side with more, the first ones stay out."""
    marked = rows.withColumns({f"__c{i}": c for i, c in enumerate(cells)})
    by = ["__exact", *[f"__c{i}" for i in range(len(cells))]]
    plus, minus = F.greatest("net", F.lit(0)), F.greatest(-F.col("net"), F.lit(0))
    whole = Window.partitionBy(*by)
    running = whole.orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = marked.withColumns({"__pair": F.least(F.sum(plus).over(whole), F.sum(minus).over(whole)), "__up": F.sum(plus).over(running), "__down": F.sum(minus).over(running)})
    # What of this row's copies lies within the first __pair of its side is paired.
    taken = lambda until, own: F.greatest(F.lit(0), F.least(own, F.col("__pair") - (F.col(until) - own)))
    left = told.withColumn("net", F.when(F.col("net") > 0, F.col("net") - taken("__up", plus)).otherwise(F.col("net") + taken("__down", minus)))
    return left.filter("net <> 0").select(*rows.columns)


def unmatched(a: DataFrame, b: DataFrame, rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
    """(side, n, and the columns of a): rows of a and of b that a largest one-to-one pairing leaves alone,
    as often as they are left. Empty where the frames are equal within the tolerance.

    Columns of other kinds than double and float must agree, nulls and NaN each with themselves. Both
    frames need the same columns. Repeated rows count. rtol may be 0 or at least 1e-10.
    """
    if 0 < rtol < 1e-10:
        raise ValueError("rtol below 1e-10 is too near the precision of doubles for a grid")
    kinds = dict(a.dtypes)
    floats = [c for c, t in a.dtypes if t in ("double", "float")]
    exact = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(a.columns) if c not in floats]), {"ignoreNullFields": "false"}) if len(floats) < len(a.columns) else F.lit("")
    both = a.withColumn("__side", F.lit(1)).unionByName(b.select(*[F.col(c).cast(kinds[c]).alias(c) for c in a.columns]).withColumn("__side", F.lit(-1)))
    marked = both.withColumns({c: F.col(c) + F.lit(0.0).cast(kinds[c]) for c in floats}).withColumn("__exact", exact)
    named = marked.withColumn("__row", F.sha2(F.concat_ws("|", "__exact", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in floats]), 256))
    # One row for each different row, with how often each side has it.
    rest = [F.any_value(c).alias(c) for c in a.columns]
    rows = stored(named.groupBy("__exact", "__row").agg(*rest, F.count_if(F.col("__side") == 1).alias("__a"), F.count_if(F.col("__side") == -1).alias("__b")), "rows")
    left = rows.withColumn("net", F.col("__a") - F.col("__b")).filter("net <> 0").select("__exact", "__row", *a.columns, "net")
    if floats and (rtol or atol):
        for shift in SHIFTS:
            left = stored(_cancelled(left, [_cell(c, rtol, atol, shift) for c in floats]), "left")
        if not left.isEmpty():
            left = _settled(rows, left, floats, rtol, atol)
    return left.select(F.when(F.col("net") > 0, "a").otherwise("b").alias("side"), F.abs("net").alias("n"), *a.columns)


def _settled(rows: DataFrame, left: DataFrame, floats: Sequence[str], rtol: float, atol: float) -> DataFrame:
    """left, with net as a largest matching leaves it. Rows near a row in question are gathered until none
    is added; two rows are near where their cells touch in every column. Then rows whose cells touch, one
    by one, form groups, and each group is matched on its own."""
    axis = [f"__p{i}" for i in range(len(floats))]
    places = {p: _place(c, rtol, atol) for p, c in zip(axis, floats, strict=True)}
    odd = {f"__o{i}": F.when(F.col(p).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("null"))).otherwise("") for i, (p, c) in enumerate(zip(axis, floats, strict=True))}
    # Only rows that agree in all exact columns with a row in question can be near one.
    asked = left.select("__exact").distinct()
    cells = stored(rows.join(asked, "__exact", "left_semi").withColumns(places).withColumns(odd), "cells")
    cell = ["__exact", *odd, *axis]
    found = stored(cells.join(left.select("__row"), "__row", "left_semi").select(*cell).distinct(), "near")
    around = [F.struct(*[(F.col(p) + d).alias(p) for p, d in zip(axis, step, strict=True)]) for step in product((-2, -1, 0, 1, 2), repeat=len(axis))]
    known = stored(cells.select(*cell).distinct(), "known")
    frontier = found
    while not frontier.isEmpty():
        reached = frontier.select("__exact", *odd, F.explode(F.array(*around)).alias("to")).select("__exact", *odd, "to.*").distinct()
        same = F.lit(True)
        for c in cell:
            same = same & known[c].eqNullSafe(reached[c])
        new = known.join(reached, same, "left_semi")
        old = F.lit(True)
        for c in cell:
            old = old & new[c].eqNullSafe(found[c])
        frontier = stored(new.join(found, old, "left_anti"), "frontier")
        found = stored(found.unionByName(frontier), "near")
    same = F.lit(True)
    for c in cell:
        same = same & cells[c].eqNullSafe(found[c])
    near = cells.join(found, same, "left_semi")
    columns = [c for c in left.columns if c != "net"]
    schema = left.select(*columns, F.lit(0).cast("bigint").alias("net")).schema

    # A task sees rows of one set of exact values in reach of a row without a partner.
    return near.groupBy("__exact").applyInPandas(lambda frame: _matched(frame, list(floats), rtol, atol)[[*columns, "net"]], schema)


def _matched(rows: pd.DataFrame, floats: list[str], rtol: float, atol: float) -> pd.DataFrame:
    """rows with net: how many of a (positive) or b (negative) a largest matching leaves alone."""
    values = rows[floats].astype(float).to_numpy()
    where: dict[tuple, list[int]] = {}
    cells = []
    for i, place in enumerate(zip(*[rows[f"__o{k}"] for k in range(len(floats))], *[rows[f"__p{k}"] for k in range(len(floats))], strict=True)):
        named = tuple(None if pd.isna(p) else p if isinstance(p, str) else int(p) for p in place)
        cells.append(named)
        where.setdefault(named, []).append(i)
    supply, demand = rows["__a"].to_numpy().copy(), rows["__b"].to_numpy().copy()

    def close(i: int, j: int) -> bool:
        for x, y in zip(values[i], values[j], strict=True):
            if x == y or (x != x and y != y):
                continue
            if not abs(x - y) <= atol + rtol * abs(y) or x in (float("inf"), -float("inf")):
                return False
        return True

    def partners(i: int) -> Iterator[int]:
        head, place = cells[i][: len(floats)], cells[i][len(floats) :]
        for step in product((0, -1, 1, -2, 2), repeat=len(floats)):
            if any(p is None and d for p, d in zip(place, step, strict=True)):
                continue
            for j in where.get(head + tuple(None if p is None else p + d for p, d in zip(place, step, strict=True)), ()):
                if rows_b[j] and close(i, j):
                    yield j

    rows_b = demand > 0
    given: dict[int, dict[int, int]] = {}  # b row -> a row -> copies

    def pair(i: int, j: int, n: int) -> None:
        given.setdefault(j, {})[i] = given.get(j, {}).get(i, 0) + n
        supply[i] -= n
        demand[j] -= n

    for i in range(len(rows)):  # equal rows first, then whoever is near
        if n := min(supply[i], demand[i]):
            pair(i, i, n)
    for i in range(len(rows)):
        if supply[i]:
            for j in partners(i):
                if n := min(supply[i], demand[j]):
                    pair(i, j, n)
                if not supply[i]:
                    break
    for i in range(len(rows)):
        while supply[i] and (path := _augmenting(i, partners, given, demand)):
            n = min(supply[i], demand[path[-1][1]], *[given[j][k] for (_, j), (k, _) in zip(path, path[1:], strict=False)])
            for (_, j), (k, _) in zip(path, path[1:], strict=False):
                given[j][k] -= n
                if not given[j][k]:
                    del given[j][k]
            for k, j in path:
                given.setdefault(j, {})[k] = given.get(j, {}).get(k, 0) + n
            supply[i] -= n
            demand[path[-1][1]] -= n
    out = rows.copy()
    out["net"] = supply - demand
    return out[(supply > 0) | (demand > 0)]


def _augmenting(start: int, partners, given: dict[int, dict[int, int]], demand) -> list[tuple[int, int]]:
    """A path from a row of a to a row of b with copies to spare, as (a, b) pairs to make; the pairs
    between are taken apart. Empty if there is none."""
    came: dict[int, tuple[int, int | None]] = {}
    todo, seen = [(start, None)], {start}
    while todo:
        i, before = todo.pop()
        for j in partners(i):
            if j in came:
                continue
            came[j] = (i, before)
            if demand[j] > 0:
                path, at = [], j
                while at is not None:
                    k, prior = came[at]
                    path.append((k, at))
                    at = prior
                return path[::-1]
            for k in given.get(j, ()):
                if k not in seen:
                    seen.add(k)
                    todo.append((k, j))
    return []
