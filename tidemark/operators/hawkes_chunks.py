"""Fits of point processes over time chunks: no task holds more than a chunk of a series.

Events are cut into chunks by time and written once. A likelihood and its gradient at trial parameters take two passes:
the first sums each chunk up in one row, the decayed weight of its events and the derivative, as seen from its last
event; the rows of a series compose in time to the state that each chunk begins with. The second pass takes that state
and gives the chunk's part of every sum. The descents of all series and starting points go in step, so a pass serves
all of them, and only parameters and sums meet in the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import drop, written
from . import hawkes as H
from .stats import chi2_sf, descend

CHUNKS = "sid int, part int, chunk long, last double, n long, n1 long, t binary, m binary"
#: Rows of states up to which they are sent to all tasks.
SMALL = 200_000
SUMS = 8


def cut_chunks(events: DataFrame, size: int, n: int) -> DataFrame:
    """Rows of CHUNKS from (sid, part, t, m): at most `size` events in the order of (t, m). Chunk numbers ascend in time."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        key, times, marks = None, [], []

        def cut(least: int):
            nonlocal number, times, marks
            t, m = np.concatenate(times), np.concatenate(marks)
            at = 0
            while len(t) - at >= least and at < len(t):
                x, y = t[at : at + size], m[at : at + size]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([number], pa.int64()), pa.array([x[-1]]), pa.array([len(x)], pa.int64()), pa.array([int(y.sum())], pa.int64()), pa.array([x.tobytes()]), pa.array([y.tobytes()])], names=names)
                at, number = at + size, number + 1
            times, marks = [t[at:]], [m[at:]]

        for batch in batches:
            sid, part, t, m = (c.to_numpy() for c in batch.columns)
            edge = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (part[1:] != part[:-1])]) if len(sid) else []
            for a, b in zip(edge, [*edge[1:], len(sid)]):
                if key != (sid[a], part[a]):
                    if times:
                        yield from cut(1)
                    key, times, marks = (int(sid[a]), int(part[a])), [], []
                times.append(t[a:b])
                marks.append(m[a:b].astype(np.int8))
            if times:
                yield from cut(size)
        if times:
            yield from cut(1)

    tasks = max(2, -(-n // size))
    ordered = events.repartitionByRange(tasks, "sid", "part", "t", "m").sortWithinPartitions("sid", "part", "t", "m")
    return ordered.mapInArrow(run, CHUNKS)


def _beta(model: str, x: np.ndarray, beta: float | None) -> float:
    return math.exp(x[2]) if model == "uni" else beta if beta is not None else math.exp(x[4])


def _weights(model: str, m: np.ndarray) -> list[np.ndarray]:
    return [np.ones(len(m))] if model == "uni" else [(m == k).astype(float) for k in (0, 1)]


class Chunks:
    """Written chunks, and the values of trial parameters over them."""

    def __init__(self, table: DataFrame, model: str, beta: float | None, ends: dict[tuple[int, int], float], rows: int):
        self.table, self.model, self.beta, self.ends, self.rows = table, model, beta, ends, rows

    def values(self, trials: list[tuple[int, int, tuple, np.ndarray]]) -> dict[int, tuple[float, np.ndarray]]:
        """For each (fit, series, parts, parameters) the minus log-likelihood and its gradient."""
        model, beta, ends = self.model, self.beta, self.ends
        asked: dict[tuple[int, int], list] = {}
        for fit, sid, parts, x in trials:
            for part in parts:
                asked.setdefault((sid, part), []).append((fit, x))

        def chunk_rows(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    sid, part, chunk, _, _, _, t, m = (batch.column(k)[i].as_py() for k in range(8))
                    yield (sid, part), chunk, np.frombuffer(t), np.frombuffer(m, np.int8), batch.column(8)[i].as_py() if batch.num_columns > 8 else None

        def sum_up(batches):
            for key, chunk, t, m, _ in chunk_rows(batches):
                rows = []
                for fit, x in asked.get(key, ()):
                    b = _beta(model, x, beta)
                    age = t[-1] - t
                    fade = np.exp(-b * age)
                    both = [v for w in _weights(model, m) for v in ((w * fade).sum(), -(w * age * fade).sum())]
                    rows.append((*key, fit, b, chunk, t[-1], *both, *([0.0, 0.0] if model == "uni" else [])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["sid", "part", "fit", "beta", "chunk", "last", "e0", "d0", "e1", "d1"])

        def carry(key, pdf):
            """The state just after the last event before each chunk: a chunk's own, and what is left of the one before."""
            pdf = pdf.sort_values("chunk")
            b, last = float(pdf["beta"].iloc[0]), pdf["last"].to_numpy()
            own = pdf[["e0", "d0", "e1", "d1"]].to_numpy()
            out = np.zeros((len(pdf), 5))
            state = np.zeros(4)
            for i in range(len(pdf) - 1):
                gap = last[i] - last[i - 1] if i else 0.0
                fade = math.exp(-b * gap)
                e0, d0, e1, d1 = state
                state = own[i] + fade * np.array([e0, d0 - gap * e0, e1, d1 - gap * e1])
                out[i + 1] = (last[i], *state)
            return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "fit": int(key[2]), **dict(zip(("from_t", "e0", "d0", "e1", "d1"), out.T))})

        def parts_of_sums(batches):
            for key, _, t, m, states in chunk_rows(batches):
                params, rows = dict(asked.get(key, ())), []
                for r in states:
                    x = params[r["fit"]]
                    b, gap = _beta(model, x, beta), t - r["from_t"]
                    fade = np.exp(-b * gap)
                    s, d = [], []
                    for w, e, g in zip(_weights(model, m), (r["e0"], r["e1"]), (r["d0"], r["d1"])):
                        here, down = H._decay_pair(t, b, w)
                        s.append(here + e * fade)
                        d.append(down + (g - gap * e) * fade)
                    sums = H.uni_sums(x, t, ends[key], s[0], d[0]) if model == "uni" else H.sym_sums(x, t, m, ends[key], beta, s, d)
                    rows.append((r["fit"], *sums, *[0.0] * (SUMS - len(sums))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["fit", *[f"q{i}" for i in range(SUMS)]])

        sums = self.table.mapInArrow(sum_up, "sid long, part long, fit long, beta double, chunk long, last double, e0 double, d0 double, e1 double, d1 double")
        states = sums.groupBy("sid", "part", "fit").applyInPandas(carry, "chunk long, fit long, from_t double, e0 double, d0 double, e1 double, d1 double")
        states = states.groupBy("chunk").agg(F.collect_list(F.struct("fit", "from_t", "e0", "d0", "e1", "d1")).alias("states"))
        small = self.rows * max(map(len, asked.values())) <= SMALL
        joined = self.table.join(F.broadcast(states) if small else states.hint("shuffle_merge"), "chunk").select(*self.table.columns, "states")
        found = joined.mapInArrow(parts_of_sums, "fit long, " + ", ".join(f"q{i} double" for i in range(SUMS)))
        total = {r["fit"]: np.array(r[1:]) for r in found.groupBy("fit").agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(SUMS)]).collect()}
        out = {}
        for fit, sid, parts, x in trials:
            end = sum(ends[sid, part] for part in parts)
            out[fit] = H.uni_value(x, total[fit][:6], end) if model == "uni" else H.sym_value(x, total[fit], end, beta)
        return out

    def fit(self, plans: list[tuple[int, tuple, H.Plan]]) -> list[dict]:
        """The results of (series, parts, plan). All descents take one step in each round."""
        ways = {}
        for p, (_, _, plan) in enumerate(plans):
            for x in plan.starts:
                way = descend(x)
                ways[len(ways)] = [p, way, next(way), None]
        while True:
            open_ = {f: w for f, w in ways.items() if w[3] is None}
            if not open_:
                break
            found = self.values([(f, *plans[p][:2], x) for f, (p, _, x, _) in open_.items()])
            for f, w in open_.items():
                try:
                    w[2] = w[1].send(plans[w[0]][2].penalty(w[2], *found[f]))
                except StopIteration as end:
                    w[3] = end.value
        return [plan.best([w[3] for w in ways.values() if w[0] == p]) for p, (_, _, plan) in enumerate(plans)]


def fit_hot(df: DataFrame, keys: list[str], hot: list, schema: str, model: str, size: int, t: str, mark: str | None = None, end: str | None = None, beta: float | None = None, restarts: int | None = None, change: bool = False) -> DataFrame:
    """The rows of the one-task fits, or change tests, for the series in `hot`: (keys, _n, _last, _end)."""
    spark = df.sparkSession
    free = None if model == "sym_full" else beta
    kind = "uni" if model == "uni" else "sym"
    names = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    ids = spark.createDataFrame([(*[r[k] for k in keys], i, r["_last"] / 2) for i, r in enumerate(hot)], f"{names}, sid int, mid double")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"ids.{k}")) for k in keys]
    joined = df.alias("d").join(F.broadcast(ids.alias("ids")), same)
    time, late = F.col(f"d.{t}").cast("double"), (F.col(f"d.{t}") > F.col("mid")) if change else F.lit(False)
    events = joined.select("sid", late.cast("int").alias("part"), (time - F.when(late, F.col("mid")).otherwise(0.0)).alias("t"), (F.col(f"d.{mark}").cast("int") if mark and kind == "sym" else F.lit(0)).alias("m"))
    table, path = written(cut_chunks(events, size, sum(r["_n"] for r in hot)), "chunks")
    counts = {(r["sid"], r["part"]): (r["n"], r["n1"], r["c"]) for r in table.groupBy("sid", "part").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("c")).collect()}
    ends = {(i, part): r["_last"] / 2 if change else r["_end"] for i, r in enumerate(hot) for part in (0, 1)}
    chunks = Chunks(table, kind, free, ends, sum(c for *_, c in counts.values()))

    def plan(sid: int, parts: tuple, **how) -> tuple[int, tuple, H.Plan]:
        n, n1 = (sum(counts.get((sid, p), (0, 0, 0))[k] for p in parts) for k in (0, 1))
        span = sum(ends[sid, p] for p in parts)
        return sid, parts, H.uni_plan(n, span, **how) if kind == "uni" else H.sym_plan(n - n1, n1, span, free, **how)

    rows, series = [], range(len(hot))
    if change:
        nulls = chunks.fit([plan(i, (0, 1), restarts=4) for i in series])
        halves = chunks.fit([plan(i, (p,), restarts=2, start=nulls[i]) for i in series for p in (0, 1)])
        for i in series:
            l0, l1, l2 = nulls[i]["loglik"], halves[2 * i]["loglik"], halves[2 * i + 1]["loglik"]
            lr = 2 * (l1 + l2 - l0)
            rows.append({"l0": l0, "l1": l1, "l2": l2, "lr": lr, "dof": H.DOF[model], "p_value": chi2_sf(max(lr, 0.0), float(H.DOF[model]))})
    else:
        rows = chunks.fit([plan(i, (0,), **({"restarts": restarts} if restarts else {})) for i in series])
    drop(spark, path)
    columns = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple({**{k: r[k] for k in keys}, **row}[c] for c in columns) for r, row in zip(hot, rows)], schema)
