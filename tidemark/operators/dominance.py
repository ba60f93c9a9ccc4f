"""How many points of a group have neither coordinate larger, for groups that no task can hold.

Both coordinates are cut into bands. A point's count is that of the bands before both of its own, from a table of cells,
plus those of its own band of the first coordinate, plus those of its own band of the second one that lie in earlier bands
of the first. Each of the last two needs one band only, so a task takes one band of one group. A value that edges fall on
is a band of its own, which counts whole and needs no such task, however many points share the value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written


#: Points that are counted by a table of blocks and ranks; more are merged.
SEGMENT = 16_384


def _up_to(rank: np.ndarray) -> np.ndarray:
    """For each place how many places up to it have no larger rank."""
    n = len(rank)
    rank = np.unique(rank, return_inverse=True)[1]
    top, size = rank.max() + 1, max(8, math.isqrt(n))
    block = np.arange(n) // size
    blocks = block[-1] + 1
    # ranks of whole blocks before, then places of the own block one by one
    table = np.bincount(block * top + rank, minlength=blocks * top).reshape(blocks, top).cumsum(1).cumsum(0)
    before = np.where(block > 0, table[block - 1, rank], 0)
    own = np.full(blocks * size, top)
    own[:n] = rank
    own = own.reshape(blocks, size)
    inside = ((own[:, None, :] <= own[:, :, None]) & np.tri(size, dtype=bool)).sum(2).ravel()[:n]
    return before + inside


def dominated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each point how many points, itself included, have neither coordinate larger: segments by tables, then by merging."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    rank = np.unique(b, return_inverse=True)[1].astype(np.int64)
    count = np.concatenate([_up_to(rank[lo : lo + SEGMENT]) for lo in range(0, n, SEGMENT)]).astype(np.int64)
    place, size = np.arange(n), SEGMENT
    while size < n:
        # points of a right half count those of the left half beside it
        block = place // size
        key = np.sort(block * n + rank)
        right = np.flatnonzero(block % 2)
        left = block[right] - 1
        count[right] += np.searchsorted(key, left * n + rank[right], side="right") - np.searchsorted(key, left * n)
        size *= 2
    # equal points count one another: the last of them has seen all
    last = np.flatnonzero(np.r_[(a[1:] != a[:-1]) | (b[1:] != b[:-1]), True])
    out = np.empty(n, np.int64)
    out[order] = count[last[np.searchsorted(last, place)]]
    return out


def sampled(x: np.ndarray, step: int) -> np.ndarray:
    """Every step-th of the sorted values: between two neighbours lie fewer than `step` others."""
    return np.sort(x)[step - 1 :: step]


def edges(samples: np.ndarray, step: int, most: int) -> np.ndarray:
    """Edges from the samples of all pieces of a group: where pieces times `step` is at most `most`, at most twice `most` values lie strictly between two of them."""
    every = max(1, most // step)
    return np.unique(np.sort(samples)[every - 1 :: every])


def bands(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Even numbers for the values between edges, odd ones for those on an edge."""
    below = np.searchsorted(cuts, x)
    return 2 * below + (cuts[np.minimum(below, len(cuts) - 1)] == x if len(cuts) else 0)


def dominance_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, count of each point of (keys, t, a, b, ba, bb), whose bands ascend with a and b and are odd for single values.

    Keys are not null, t is distinct within them. Points in single-valued bands of both coordinates come out once.
    The cells of a group, at most one for each pair of its bands, are summed up in one task; `points` is read three times.
    """
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def table(key, pdf):
        i, j = (np.unique(pdf[c], return_inverse=True)[1] for c in ("ba", "bb"))
        sums = np.zeros((i.max() + 2, j.max() + 2), np.int64)
        sums[i + 1, j + 1] = pdf["n"]
        sums = sums.cumsum(0).cumsum(1)
        return pdf.assign(below=sums[i + pdf["ba"].to_numpy() % 2, j + pdf["bb"].to_numpy() % 2])[[*keys, "ba", "bb", "a", "b", "below"]]

    cells = points.groupBy(*keys, "ba", "bb").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.min("b").alias("b"))
    cells, _ = written(cells.groupBy(*keys).applyInPandas(table, f"{kinds}, ba long, bb long, a double, b double, below long"), "cells")

    def first_side(key, pts, known):
        """Points of the band, and all cells before both bands."""
        below = known.set_index("bb")["below"].reindex(pts["bb"]).to_numpy()
        return pts.assign(part=dominated(pts["a"].to_numpy(), pts["b"].to_numpy()) + below)[[*keys, "t", "a", "b", "part"]]

    def second_side(key, pts, known):
        """Points of the band in earlier bands of the first coordinate; cells where no task of the first side adds them."""
        single = pts["ba"].to_numpy() % 2 == 1
        below = known.set_index("ba")["below"].reindex(pts["ba"]).fillna(0).to_numpy()
        up_to = dominated(pts["ba"].to_numpy(), pts["b"].to_numpy())
        same = pts.groupby("ba")["b"].rank(method="max").to_numpy()
        return pts.assign(part=np.where(single, up_to + below, up_to - same).astype(np.int64))[[*keys, "t", "a", "b", "part"]]

    out = f"{kinds}, t long, a double, b double, part long"
    odd_a, odd_b = F.col("ba") % 2 == 1, F.col("bb") % 2 == 1
    sides = []
    for odd, band, run, more in ((odd_a, "ba", first_side, F.lit(True)), (odd_b, "bb", second_side, odd_a)):
        mine = points.filter(~odd).groupBy(*keys, band)
        sides.append(mine.cogroup(cells.filter(~odd & more).groupBy(*keys, band)).applyInPandas(run, out))
    each = sides[0].unionByName(sides[1]).groupBy(*keys, "t").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("part").alias("count"))
    return each.drop("t").unionByName(cells.filter(odd_a & odd_b).select(*keys, "a", "b", F.col("below").alias("count")))
