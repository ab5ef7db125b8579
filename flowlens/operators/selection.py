"""Exact quantiles by bracketed selection: scans and partial aggregates only.

A wide aggregate keeps a mergeable quantile sketch per column, which gives an interval
around each wanted rank whose true rank is within the sketch's error.  A second aggregate
counts the values below the interval and at its ends and takes the values strictly inside,
which are few by construction (a value with many copies can only be an end).  If more than
``INSIDE`` could lie inside, that scan sketches them instead and the next one looks into the
narrower interval.  Nothing is shuffled but one row of partial states per task, no table is
stored, and the answers are order statistics, not estimates.

Scans: two for up to ``INSIDE * ACCURACY / 6`` rows (10**8), three for up to 10**10; each
further one narrows some five hundredfold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import finite_or_null, quote

ACCURACY = 10_000  # rank error of a sketch: one part in this
INSIDE = 65_536    # values of one interval that an aggregate may hold
GRID = 2048        # steps of the sketch of an interval that holds more


def not_nan(c: Column | str) -> Column:
    x = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


@dataclass
class _Bracket:
    """The values with the 0-based ``ranks`` of a column lie from ``low`` to ``high``; ``size``
    bounds how many lie strictly between.  ``found`` gets those that are known."""

    column: int
    p: float
    ranks: list[int]
    low: float
    high: float
    size: float
    found: dict[int, float] = field(default_factory=dict)


def _ranks(p: float, n: int) -> list[int]:
    """The order statistics that linear interpolation at ``p`` needs."""
    pos = p * (n - 1)
    return sorted({math.floor(pos), math.ceil(pos)})


def quantile_table(df: DataFrame, cols: list[str], probs: list[float] | dict[str, list[float]], finite: bool = True,
                   accuracy: int = ACCURACY, inside: int = INSIDE) -> dict[str, dict[float, float]]:
    """{column: {p: value}}: exact quantiles with linear interpolation between order statistics.

    ``probs`` are those of all columns, or a list per column.  NULL and NaN are left out,
    infinities too unless ``finite=False``; a column without values has no entry.  Columns
    and probabilities share every scan.
    """
    out: dict[str, dict[float, float]] = {c: {} for c in cols}
    of = probs if isinstance(probs, dict) else {c: probs for c in cols}
    if not cols or not any(of.values()):
        return out
    clean = finite_or_null if finite else not_nan
    rows = df.select(*[clean(quote(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    margin = 2.0 / accuracy
    inner = [sorted({p for p in of[c] if 0.0 < p < 1.0}) for c in cols]
    parts = []
    for i, own in enumerate(inner):
        x = F.col(f"c{i}")
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if own:
            asked = [max(0.0, p - margin) for p in own] + [min(1.0, p + margin) for p in own]
            parts.append(F.percentile_approx(x, asked, accuracy).alias(f"q{i}"))
    first = rows.agg(*parts).first()
    brackets = [_Bracket(i, p, _ranks(p, first[f"n{i}"]), first[f"q{i}"][j], first[f"q{i}"][len(own) + j],
                         6.0 * first[f"n{i}"] / accuracy)
                for i, own in enumerate(inner) if first[f"n{i}"] for j, p in enumerate(own)]
    while open_ := [b for b in brackets if b.ranks]:
        _narrow(rows, open_, first, accuracy, inside)
    for i, c in enumerate(cols):
        if first[f"n{i}"]:
            out[c].update({round(p, 12): first[f"{'lo' if p <= 0 else 'hi'}{i}"] for p in of[c] if not 0.0 < p < 1.0})
    for b in brackets:
        pos = b.p * (first[f"n{b.column}"] - 1)
        low, high = b.found[math.floor(pos)], b.found[math.ceil(pos)]
        out[cols[b.column]][round(b.p, 12)] = low if low == high else low + (high - low) * (pos - math.floor(pos))
    return out


def _slot(x: Column, bounds: list[float]) -> Column:
    """2 i for values between the bounds i - 1 and i, 2 i + 1 for copies of bound i."""
    slot = F.when(x < F.lit(bounds[0]), 0)
    for i, b in enumerate(bounds):
        if i:
            slot = slot.when(x < F.lit(b), 2 * i)
        slot = slot.when(x == F.lit(b), 2 * i + 1)
    return slot.otherwise(2 * len(bounds))


def _narrow(rows: DataFrame, open_: list[_Bracket], first, accuracy: int, inside: int) -> None:
    """One scan over all open brackets: values that it settles are found, the others' brackets shrink.

    The ends of a column's brackets cut its values into slots; rows are counted by slot, and
    slots inside a bracket keep their values or, if these are too many, a sketch of them.
    """
    bounds: dict[int, list[float]] = {}
    for b in open_:
        bounds[b.column] = sorted({*bounds.get(b.column, []), b.low, b.high})
    # A slot inside a bracket; one that a narrower bracket cuts is bounded by that bracket's size.
    size: dict[tuple[int, int], float] = {}
    for b in open_:
        at = bounds[b.column]
        for i in range(at.index(b.low) + 1, at.index(b.high) + 1):
            size[b.column, 2 * i] = min(b.size, size.get((b.column, 2 * i), b.size))
    is_listed = lambda keys: F.struct("c", "slot").isin([F.struct(F.lit(c), F.lit(s)) for c, s in keys]) if keys else F.lit(False)
    listed = [k for k, n in size.items() if n <= inside]
    large = [k for k, n in size.items() if n > inside]
    cells = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), _slot(F.col(f"c{c}"), at).alias("slot"), F.col(f"c{c}").alias("x"))
        for c, at in bounds.items()])).alias("e")).select("e.*").where(F.col("x").isNotNull())
    parts = [F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(is_listed(listed), F.col("x")))).alias("v")]
    if large:
        parts.append(F.percentile_approx(F.when(is_listed(large), F.col("x")), [j / GRID for j in range(GRID + 1)], accuracy).alias("s"))
    counted = cells.groupBy("c", "slot").agg(*parts)
    # The lists stay in the table: ranks in front of a slot come from a window over the slots (a few per
    # bracket), and only the wanted values are picked out of a list.
    before = Window.partitionBy("c").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.array(F.lit(c), F.lit(r)) for c, r in sorted({(b.column, r) for b in open_ for r in b.ranks})])
    mine = F.filter(wanted, lambda w: (w[0] == F.col("c")) & (w[1] >= F.col("b")) & (w[1] < F.col("b") + F.size("v")))
    picked = F.map_from_arrays(F.transform(mine, lambda w: w[1]), F.transform(mine, lambda w: F.get("v", (w[1] - F.col("b")).cast("int"))))
    out = counted.withColumn("b", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        "c", "slot", "n", "b", picked.alias("v"), *(["s"] if large else []))
    cell = {(r["c"], r["slot"]): r for r in out.collect()}
    for b in open_:
        at, n = bounds[b.column], first[f"n{b.column}"]
        own = sorted((s, cell[c, s]) for c, s in cell if c == b.column)
        low, high = 2 * at.index(b.low) + 1, 2 * at.index(b.high) + 1
        place = {r: next(s for s, row in own if row["b"] <= r < row["b"] + row["n"]) for r in b.ranks}
        if place[b.ranks[0]] < low or place[b.ranks[-1]] > high:  # missed a rank (few rows): widen that side
            b.low = first[f"lo{b.column}"] if place[b.ranks[0]] < low else b.low
            b.high = first[f"hi{b.column}"] if place[b.ranks[-1]] > high else b.high
            b.size = n
            continue
        for r, s in place.items():
            if s % 2:
                b.found[r] = at[s // 2]
            elif r in cell[b.column, s]["v"]:
                b.found[r] = cell[b.column, s]["v"][r]
        b.ranks = [r for r in b.ranks if r not in b.found]
        if b.ranks:  # too many between: take the slices of the sketch around the ranks
            ends, slack = [], 2 + GRID / accuracy
            for r, step, stop in ((b.ranks[0], -slack, math.floor), (b.ranks[-1], slack, math.ceil)):
                row, s = cell[b.column, place[r]], place[r]
                j = stop((r - row["b"]) / row["n"] * GRID + step)
                ends.append(at[s // 2 - 1] if j <= 0 else at[s // 2] if j >= GRID else row["s"][j])
            b.low, b.high = ends
            b.size = sum(cell[b.column, s]["n"] for s in {place[r] for r in b.ranks}) * (4 * slack + 2) / GRID
