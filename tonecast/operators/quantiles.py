"""Exact quantiles of many columns at once by distributed selection.

A wanted value is the one of a given rank in its column. Each pass over the rows counts, for every wanted value, the rows
below, at the ends of and inside an interval that is known to hold it, and summarises the inside by a grid of approximate
percentiles. An end whose count covers the rank is the value; otherwise the next interval is the part of the grid around
the rank, or, if counting it shows that the grid missed, the next values inside. Rows in question fall about a hundredfold
a pass, and no task holds more of a column than a summary of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast.session import materialize

ACCURACY = 4_000  # size of a summary: it tells ranks to one part in this
GRID = 250  # percentiles taken of it
_PER_PASS = 24  # values looked for in one aggregate


@dataclass
class Wanted:
    """The value of a column with ``rank`` rows before it; it lies in [low, high], a bracket inside [safe_low, safe_high]."""
    column: str
    rank: int
    low: float
    high: float
    safe_low: float
    safe_high: float
    value: float | None = None

    def measures(self) -> list[Column]:
        v = F.col(self.column)
        inside = F.when((v > self.low) & (v < self.high), v)
        grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        return [F.count_if(v < self.low), F.count_if(v == self.low), F.count(inside), F.count_if((v == self.high) & (v > self.low)),
                F.min(inside), F.max(inside), F.percentile_approx(inside, grid, F.lit(ACCURACY))]

    def narrow(self, below: int, at_low: int, inside: int, at_high: int, first: float, last: float, grid: list[float]) -> None:
        if not below <= self.rank < below + at_low + inside + at_high:
            self.low, self.high = self.safe_low, self.safe_high
        elif self.rank < below + at_low:
            self.value = self.low
        elif self.rank >= below + at_low + inside:
            self.value = self.high
        else:
            self.safe_low, self.safe_high = first, last
            share = (self.rank - below - at_low) / max(inside - 1, 1)
            self.low = grid[max(math.floor((share - 2 / ACCURACY) * GRID), 0)]
            self.high = grid[min(math.ceil((share + 2 / ACCURACY) * GRID), GRID)]


def _bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    v = {c: F.col(c) for c in columns}
    told = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(v.values()) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    return {c: (told[f"n{i}"], told[f"a{i}"], told[f"b{i}"]) for i, c in enumerate(columns)}


def exact(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles of numeric columns: {(column, probability): value}.

    Nulls are left out, a column without values has None. Values are compared as doubles and must not be NaN. The columns
    are written once, as every pass reads them.
    """
    df = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "numbers")
    bounds = _bounds(df, columns)
    places = {(c, p): p * (bounds[c][0] - 1) for c in columns for p in probabilities}
    wanted: dict[tuple[str, int], Wanted] = {}
    for (c, _), place in places.items():
        n, low, high = bounds[c]
        for rank in {math.floor(place), math.ceil(place)} if n else ():
            wanted[c, rank] = Wanted(c, rank, low, high, low, high)
    todo = list(wanted.values())
    while todo:
        for k in range(0, len(todo), _PER_PASS):
            part = todo[k:k + _PER_PASS]
            told = df.agg(*[m.alias(f"m{i}_{j}") for i, w in enumerate(part) for j, m in enumerate(w.measures())]).first()
            for i, w in enumerate(part):
                w.narrow(*(told[f"m{i}_{j}"] for j in range(7)))
        todo = [w for w in todo if w.value is None]

    def between(c: str, place: float) -> float | None:
        if not bounds[c][0]:
            return None
        low, high = wanted[c, math.floor(place)].value, wanted[c, math.ceil(place)].value
        return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high
    return {key: between(key[0], place) for key, place in places.items()}
