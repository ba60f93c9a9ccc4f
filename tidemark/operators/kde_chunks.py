"""The choice of bandwidth and discount for series that no task can hold.

The forecast distribution is a running discounted mean of kernels, so a chunk of rows is one power of the discount and one
vector; these meet per series and bandwidth and tell each chunk the forecast that it begins with. Chunks then work out the
places of their values, and uniformity is measured by ranks over distinct values and by dominance counts over bands.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scratch import drop, written
from . import kde, selection
from .distribution import ks_stat
from .dominance import bands, dominance_counts, edges, sampled

#: A candidate of a series.
CELL = ["id", "i", "w"]


def _limits(df: DataFrame, value: str) -> DataFrame:
    """Per series the ends and outer percentiles, size and deviation."""
    grouped = df.groupBy("id").agg(F.count(value).alias("size"), F.stddev_pop(value).alias("sd"))
    return selection.beside(grouped, df, ["id"], value, {"q0": 0.0, "q1": kde.TAIL, "q2": 1 - kde.TAIL, "q3": 1.0})


def _setting(r, nu: int, n_h: int, n_omega: int, points: int):
    """Grid, bandwidths and discounts of a row of _limits()."""
    low, high = (r.q1, r.q2) if r.q1 < r.q2 else (r.q0, r.q3)
    return kde.grid_between(low, high, points), *kde.candidates_by(r.sd, r.size, nu, n_h, n_omega)


def places(df: DataFrame, value: str, order: str, t0: int, nu: int, n_h: int, n_omega: int, points: int, chunk: int) -> DataFrame:
    """id, i, h, w, omega, chunk, at, zs: places of the values from row `at` on in the forecasts before them, by chunk, bandwidth i and discount w.

    `df` has series by `id` without null values, each with two values or more and more than t0 rows.
    """
    pieces, path = written(kde._cut(df, value, ["id"], order, chunk), "pieces")
    base = (F.sum("n").over(W.partitionBy("id").orderBy("chunk")) - F.col("n")).alias("base")
    numbered = pieces.join(pieces.select("id", "chunk", base), ["id", "chunk"]).join(_limits(df, value), "id")
    rows, rows_path = written(numbered.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_h - 1)))), "pieces")

    def sum_up(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                g, hs, omegas = _setting(r, nu, n_h, n_omega, points)
                x, h = np.asarray(r.xs, float), hs[r.i]
                early = x[: max(0, t0 - r.base)]
                first = kde.start_weights(t0, omegas)[:, r.base : r.base + len(early)] @ kde.ramp(g, early, h) if len(early) else np.zeros((n_omega, points))
                late, v = x[len(early) :], np.zeros((n_omega, points))
                for lo in range(0, len(late), 1_000):
                    block = late[lo : lo + 1_000]
                    age = len(late) - 1 - lo - np.arange(len(block))
                    v += ((1 - omegas)[:, None] * omegas[:, None] ** age) @ kde.ramp(g, block, h)
                out.append((r.id, r.i, r.chunk, (omegas ** len(late)).tolist(), v.ravel(), first.ravel()))
            yield pd.DataFrame(out, columns=["id", "i", "chunk", "keep", "v", "first"])

    def carry(key, pdf):
        pdf = pdf.sort_values("chunk")
        u = np.clip(np.sum([np.asarray(f) for f in pdf["first"]], axis=0).reshape(n_omega, points), 0, 1)
        out = []
        for c, keep, v in zip(pdf["chunk"], pdf["keep"], pdf["v"]):
            out.append((*key, c, u.ravel()))
            u = np.asarray(keep)[:, None] * u + np.asarray(v).reshape(n_omega, points)
        return pd.DataFrame(out, columns=["id", "i", "chunk", "u"])

    def forecasts(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                g, hs, omegas = _setting(r, nu, n_h, n_omega, points)
                x, at = np.asarray(r.xs, float), max(t0, r.base)
                if at < r.base + r.n:
                    zs = kde.forecast_places(x[at - r.base :], hs[r.i], omegas, g, np.asarray(r.u).reshape(n_omega, points))
                    yield pd.DataFrame({"id": r.id, "i": r.i, "h": hs[r.i], "w": range(n_omega), "omega": omegas, "chunk": r.chunk, "at": at, "zs": list(zs)})

    sums = rows.mapInPandas(sum_up, "id int, i int, chunk long, keep array<double>, v array<double>, first array<double>")
    states = sums.groupBy("id", "i").applyInPandas(carry, "id int, i int, chunk long, u array<double>")
    joined = rows.join(states, ["id", "i", "chunk"])
    out, _ = written(joined.mapInPandas(forecasts, "id int, i int, h double, w int, omega double, chunk long, at long, zs array<double>"), "places")
    drop(df.sparkSession, path, rows_path)
    return out


def uniformity_of(rows: DataFrame, nu: int, most: int) -> DataFrame:
    """id, i, w, objective: kde.uniformity() of each candidate's places, which come in pieces of at most `most` values as from places()."""
    sizes = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.size("zs")).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("pieces")))

    def samples(frames):
        for pdf in frames:
            yield pdf.assign(s=[sampled(np.asarray(z), k) for z, k in zip(pdf["zs"], pdf["step"])])[[*CELL, "step", "s"]]

    def cut(key, pdf):
        return pd.DataFrame([(*key, edges(np.concatenate(list(pdf["s"])), int(pdf["step"].iloc[0]), most))], columns=[*CELL, "cuts"])

    stepped = rows.join(sizes.select(*CELL, step.cast("long").alias("step")), CELL).select(*CELL, "step", "zs")
    cuts = stepped.mapInPandas(samples, "id int, i int, w int, step long, s array<double>").groupBy(*CELL).applyInPandas(cut, "id int, i int, w int, cuts array<double>")
    # the values behind a piece: pieces may be short, so up to nu of them are looked at
    following = F.flatten(F.collect_list("head").over(W.partitionBy(*CELL).orderBy("chunk").rowsBetween(1, nu)))
    heads = rows.select(*CELL, "chunk", F.slice("zs", 1, nu).alias("head")).select(*CELL, "chunk", F.slice(following, 1, nu).alias("next"))
    whole, path = written(rows.join(heads, [*CELL, "chunk"]).join(cuts, CELL).select(*CELL, "at", "zs", "next", "cuts"), "places")

    def pairs(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                z = np.concatenate((r.zs, r.next))
                band = bands(z, np.asarray(r.cuts))
                for lag in range(1, nu + 1):
                    n = min(len(r.zs), len(z) - lag)
                    if n > 0:
                        yield pd.DataFrame({"id": r.id, "i": r.i, "w": r.w, "lag": lag, "t": r.at + np.arange(n), "a": z[:n], "b": z[lag : lag + n], "ba": band[:n], "bb": band[lag : lag + n]})

    points = whole.mapInPandas(pairs, "id int, i int, w int, lag int, t long, a double, b double, ba long, bb long")
    pairs_of = F.col("n") - F.col("lag")
    counts = dominance_counts(points, [*CELL, "lag"]).join(F.broadcast(sizes.select(*CELL, "n")) if sizes.count() <= selection.SHARED else sizes.select(*CELL, "n"), CELL)
    lagged = counts.groupBy(*CELL, "lag").agg(F.max(F.abs(F.col("count") / pairs_of - F.col("a") * F.col("b")) * F.sqrt(pairs_of)).alias("gap"))
    alone = ks_stat(rows.select(*CELL, F.explode("zs").alias("z")), "z", F.col("z"), CELL).select(*CELL, (F.col("ks") * F.sqrt("n")).alias("gap"))
    out, _ = written(lagged.drop("lag").unionByName(alone).groupBy(*CELL).agg(F.max("gap").alias("objective")), "objectives")
    drop(rows.sparkSession, path)
    return out


def select_hot(df: DataFrame, value: str, order: str, t0: int, nu: int, n_h: int, n_omega: int, points: int, chunk: int) -> DataFrame:
    """id, h, omega, objective of the series `id` of `df`, as kde.select_kde() gives them.

    One bandwidth after another goes through the pairs, so that a shuffle holds rows * n_omega * nu points at a time.
    """
    rows = places(df, value, order, t0, nu, n_h, n_omega, points, chunk)
    parts = [uniformity_of(rows.filter(F.col("i") == i), nu, chunk) for i in range(n_h)]
    objective = parts[0]
    for part in parts[1:]:
        objective = objective.unionByName(part)
    return rows.groupBy(*CELL).agg(F.min("h").alias("h"), F.min("omega").alias("omega")).join(objective, CELL).select("id", "h", "omega", "objective")
