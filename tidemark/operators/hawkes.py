"""Self-exciting point processes: excitation, likelihoods, fits, change tests, residuals, bootstraps.

A series is a group; numpy kernels run on it inside grouped maps. Recurrences go in blocks: each block is handled
by vector operations scaled inside the block, so no exponential of a whole day's time is formed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scratch import spread
from .hawkes_lanes import Held, Lanes
from .hawkes_lanes import fit as fit_lanes
from .stats import chi2_sf, minimize


def _decay_pair(t: np.ndarray, beta: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """s_i: the sum over earlier events j (with own_j = 1) of exp(-beta (t_i - t_j)), and its derivative by beta.

    If few events lie within the reach of an exponential, they are summed neighbour by neighbour; else in blocks.
    """
    n = len(t)
    own = np.ones(n) if own is None else own
    s, d = np.zeros(n), np.zeros(n)
    if n == 0:
        return s, d
    reach = int((np.arange(n) - np.searchsorted(t, t - 40.0 / beta)).max())
    if reach <= 64:
        for k in range(1, reach + 1):
            gap = t[k:] - t[:-k]
            e = own[:-k] * np.exp(-beta * gap)
            s[k:] += e
            d[k:] -= gap * e
        return s, d
    i, s0, d0 = 0, 0.0, 0.0
    while i < n:
        j = max(i + 1, min(int(np.searchsorted(t, t[i] + 300.0 / beta, "right")), i + 4096))
        rel = t[i:j] - t[i]
        e = own[i:j] * np.exp(beta * rel)
        a = np.concatenate(([0.0], np.cumsum(e)))[:-1]
        b = np.concatenate(([0.0], np.cumsum(e * rel)))[:-1]
        fade = np.exp(-beta * rel)
        s[i:j] = fade * (s0 + a)
        d[i:j] = fade * (d0 - rel * (s0 + a) + b)
        if j < n:
            dt = t[j] - t[j - 1]
            s0 = math.exp(-beta * dt) * (s[j - 1] + own[j - 1])
            d0 = math.exp(-beta * dt) * d[j - 1] - dt * s0
        i = j
    return s, d


def decay_states(t: np.ndarray, beta: float, own: np.ndarray | None = None) -> np.ndarray:
    return _decay_pair(t, beta, own)[0]


def uni_sums(theta: np.ndarray, t: np.ndarray, end: float, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The sums over events that make up the likelihood and its gradient, from the state before each event and its derivative."""
    mu, br, beta = np.exp(theta)
    a = br * beta
    lam = mu + a * s
    gone = np.exp(-beta * (end - t))
    return np.array([np.log(lam).sum(), (1 - gone).sum(), (1 / lam).sum(), (beta * s / lam).sum(), ((br * s + a * d) / lam).sum(), ((end - t) * gone).sum()])


def uni_value(theta: np.ndarray, sums: np.ndarray, end: float) -> tuple[float, np.ndarray]:
    mu, br, beta = np.exp(theta)
    logs, mass, by_mu, by_br, by_beta, late = sums
    value = logs - mu * end - br * mass
    return -value, -np.array([(by_mu - end) * mu, (by_br - mass) * br, (by_beta - br * late) * beta])


def uni_loglik(theta: np.ndarray, t: np.ndarray, end: float) -> tuple[float, np.ndarray]:
    """Minus log-likelihood of mu + a sum exp(-beta dt), and its gradient, in the logs of (mu, branching, beta), a = branching * beta."""
    return uni_value(theta, uni_sums(theta, t, end, *_decay_pair(t, math.exp(theta[2]))), end)


def _pooled(loglik, x, parts: list) -> tuple[float, np.ndarray]:
    """The sums of a likelihood and its gradient over parts that share parameters and have histories of their own."""
    each = [loglik(x, *p) for p in parts]
    return sum(v for v, _ in each), sum(g for _, g in each)


@dataclass
class Plan:
    """How one set of parameters is fitted: points to start from, a penalty on (x, value, gradient), and the result.

    Without starts there is nothing to fit, and `given` is the result.
    """

    starts: list[np.ndarray]
    penalty: Callable | None = None
    result: Callable | None = None
    given: dict | None = None

    def best(self, ends: list[tuple[np.ndarray, float]]) -> dict:
        return self.result(*min(ends, key=lambda y: y[1])) if self.starts else self.given

    def fit(self, loglik: Callable, parts: list) -> dict:
        return self.best([minimize(lambda x: self.penalty(x, *_pooled(loglik, x, parts)), x) for x in self.starts])


def uni_plan(n: int, end: float, beta0: float = 10.0, restarts: int = 5, limit: float = 0.999, start: dict | None = None) -> Plan:
    """n events in a total time `end`. The branching ratio stays below `limit` by a steep penalty; `start` is a fit to begin from as well."""
    if n < 2 or end <= 0:
        return Plan([], given={"mu": n / end if end > 0 else None, "alpha": 0.0, "beta": None, "loglik": (n * math.log(n / end) - n) if n and end > 0 else 0.0, "n": n})

    def penalty(x, v, g):
        over = math.exp(min(x[1], 50)) - limit
        return (v + 1e6 * over * over, g + np.array([0, 2e6 * over * math.exp(min(x[1], 50)), 0])) if over > 0 else (v, g)

    def result(x, v):
        mu, br, beta = np.exp(x)
        return {"mu": float(mu), "alpha": float(br), "beta": float(beta), "loglik": -float(v), "n": n}

    starts = []
    for k in range(restarts):
        br, b = (0.5, 0.2, 0.8, 0.35, 0.6)[k % 5], beta0 * (1, 0.2, 5, 0.02, 25)[k % 5]
        starts.append(np.log([max(n / end * (1 - br), 1e-12), br, b]))
    if start and start["beta"] is not None:
        starts.append(np.log([max(start["mu"], 1e-12), max(start["alpha"], 1e-12), start["beta"]]))
    return Plan(starts, penalty, result)


def fit_uni(t: np.ndarray | list, end: float, beta0: float = 10.0, restarts: int = 5, limit: float = 0.999, start: dict | None = None) -> dict:
    """mu, branching, beta, loglik, as planned by uni_plan(). A list of series, each to the horizon `end`, is fitted with one set of parameters."""
    parts = [(x, end) for x in (t if isinstance(t, list) else [t])]
    return uni_plan(sum(len(x) for x, _ in parts), end * len(parts), beta0, restarts, limit, start).fit(uni_loglik, parts)


def sym_sums(x: np.ndarray, t: np.ndarray, mark: np.ndarray, end: float, beta: float | None, s: list, d: list | None) -> np.ndarray:
    """As uni_sums, from the states of both marks; those of the gradient by beta only where beta is estimated."""
    p = np.exp(x)
    b = beta if beta is not None else p[4]
    own, other = np.where(mark == 0, s[0], s[1]), np.where(mark == 0, s[1], s[0])
    lam = np.where(mark == 0, p[0], p[1]) + b * (p[2] * own + p[3] * other)
    gone = np.exp(-b * (end - t))
    by_beta = late = 0.0
    if beta is None:
        downs, dother = np.where(mark == 0, d[0], d[1]), np.where(mark == 0, d[1], d[0])
        by_beta = ((p[2] * own + p[3] * other + b * (p[2] * downs + p[3] * dother)) / lam).sum()
        late = ((end - t) * gone).sum()
    return np.array([np.log(lam).sum(), (1 - gone).sum(), ((mark == 0) / lam).sum(), ((mark == 1) / lam).sum(), (b * own / lam).sum(), (b * other / lam).sum(), by_beta, late])


def sym_value(x: np.ndarray, sums: np.ndarray, end: float, beta: float | None) -> tuple[float, np.ndarray]:
    p = np.exp(x)
    logs, mass, by0, by1, by_own, by_other, by_beta, late = sums
    value = logs - (p[0] + p[1]) * end - (p[2] + p[3]) * mass
    g = [by0 - end, by1 - end, by_own - mass, by_other - mass]
    if beta is None:
        g.append(by_beta - (p[2] + p[3]) * late)
    return -value, -np.array(g) * p


def sym_loglik(x: np.ndarray, t: np.ndarray, mark: np.ndarray, end: float, beta: float | None, cache: dict | None = None) -> tuple[float, np.ndarray]:
    """Two marks with own baselines and shared self (as) and cross (ac) excitation; beta fixed, or the last of x. Logs throughout."""
    b = beta if beta is not None else math.exp(x[4])
    if beta is not None and cache:
        s, d = cache["s"], None
    else:
        pairs = [_decay_pair(t, b, (mark == k).astype(float)) for k in (0, 1)]
        s, d = [q[0] for q in pairs], [q[1] for q in pairs]
        if beta is not None and cache is not None:
            cache["s"] = s
    return sym_value(x, sym_sums(x, t, mark, end, beta, s, d), end, beta)


def sym_plan(n0: int, n1: int, end: float, beta: float | None = None, restarts: int = 4, beta0: float = 10.0, start: dict | None = None) -> Plan:
    """n0 and n1 events of the marks in a total time `end`; `start` as in uni_plan."""
    n, names = n0 + n1, ["mu0", "mu1", "alpha_self", "alpha_cross"]
    if n < 2 or end <= 0:
        # one event at most: a constant rate for its mark
        return Plan([], given={**dict.fromkeys(names, 0.0), "beta": beta, "loglik": -math.log(end) - 1 if n and end > 0 else 0.0, "n": n})
    n0, n1 = max(n0, 0.5), max(n1, 0.5)

    def penalty(x, v, g):
        a, c = np.exp(np.minimum(x[2:4], 50))
        over = a + c - 0.999
        if over > 0:
            v, g = v + 1e6 * over * over, g.copy()
            g[2] += 2e6 * over * a
            g[3] += 2e6 * over * c
        return v, g

    def result(x, v):
        p = np.exp(x)
        return {**dict(zip(names, map(float, p[:4]))), "beta": float(p[4]) if beta is None else beta, "loglik": -float(v), "n": n}

    starts = []
    for k in range(restarts):
        a, c = ((0.3, 0.1), (0.1, 0.3), (0.5, 0.2), (0.2, 0.2))[k % 4]
        first = [n0 / end * (1 - a - c), n1 / end * (1 - a - c), a, c]
        starts.append(np.log(first + ([beta0 * (1, 0.2, 5, 0.05)[k % 4]] if beta is None else [])))
    if start and start["beta"] is not None:
        starts.append(np.log(np.maximum([start[c] for c in names] + ([start["beta"]] if beta is None else []), 1e-12)))
    return Plan(starts, penalty, result)


def fit_sym(t, mark, end, beta: float | None = None, restarts: int = 4, beta0: float = 10.0, start: dict | None = None) -> dict:
    """Lists of series and marks, each to the horizon `end`, are fitted with one set of parameters; see sym_plan()."""
    parts = [(x, m, end, beta, {}) for x, m in (zip(t, mark) if isinstance(t, list) else [(t, mark)])]
    every = np.concatenate([p[1] for p in parts])
    return sym_plan(int((every == 0).sum()), int((every == 1).sum()), end * len(parts), beta, restarts, beta0, start).fit(sym_loglik, parts)


def _sorted(pdf, t, mark=None):
    pdf = pdf.sort_values([t] + ([mark] if mark else []))
    return pdf[t].to_numpy(float), pdf[mark].to_numpy(int) if mark else None


def _types(df, keys):
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def fit_hawkes_uni(df: DataFrame, keys: list[str], t: str = "t", end: str | None = None, restarts: int = 5) -> DataFrame:
    """One fit a group: mu, alpha (branching), beta, loglik, n. `end` names the horizon column; else the last event.

    A group of more than CHUNK events is fitted over time chunks, see hawkes_chunks; the others in one task each.
    """

    def run(key, pdf):
        x, _ = _sorted(pdf, t)
        return pd.DataFrame([{**dict(zip(keys, key)), **fit_uni(x, float(pdf[end].iloc[0]) if end else float(x[-1]), restarts=restarts)}])

    schema = f"{_types(df, keys)}, mu double, alpha double, beta double, loglik double, n long"
    return hot_and_others(df, keys, run, schema, "uni", t=t, end=end, restarts=restarts)


def fit_hawkes_sym(df: DataFrame, keys: list[str], beta: float | None = None, t: str = "t", mark: str = "mark", end: str | None = None) -> DataFrame:
    """Symmetric bivariate fit with beta given, or estimated without it. Groups of more than CHUNK events as in fit_hawkes_uni."""

    def run(key, pdf):
        x, m = _sorted(pdf, t, mark)
        return pd.DataFrame([{**dict(zip(keys, key)), **fit_sym(x, m, float(pdf[end].iloc[0]) if end else float(x[-1]), beta)}])

    schema = f"{_types(df, keys)}, mu0 double, mu1 double, alpha_self double, alpha_cross double, beta double, loglik double, n long"
    return hot_and_others(df, keys, run, schema, "sym", beta=beta, t=t, mark=mark, end=end)


def fit_hawkes_sym_full(df: DataFrame, keys: list[str], **how) -> DataFrame:
    return fit_hawkes_sym(df, keys, None, **how)


#: Events of a group from which on it is fitted over time chunks.
CHUNK = 200_000


def hot_and_others(df: DataFrame, keys: list[str], run: Callable, schema: str, model: str, **how) -> DataFrame:
    """Groups of at most CHUNK events by `run`, one task each, the others by hawkes_chunks.fit_hot()."""
    from . import hawkes_chunks

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(how["t"]).cast("double").alias("_last"), F.max(how.get("end") or how["t"]).cast("double").alias("_end"))
    hot = sizes.filter(F.col("_n") > CHUNK).collect()  # at most one row for each CHUNK events
    if not hot:
        return spread(df, *keys).groupBy(*keys).applyInPandas(run, schema)
    table = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], _types(df, keys))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"hot.{k}")) for k in keys]
    others = df.alias("d").join(F.broadcast(table.alias("hot")), same, "left_anti")
    return spread(others, *keys).groupBy(*keys).applyInPandas(run, schema).unionByName(hawkes_chunks.fit_hot(df, keys, hot, schema, model, CHUNK, **how))


#: Free parameters of each model.
DOF = {"uni": 3, "sym": 4, "sym_full": 5}


def _halves_of(t: np.ndarray, mark: np.ndarray | None, end: float) -> tuple[list, list]:
    """Events and marks up to the midpoint, and after it, shifted by it."""
    mid = end / 2
    first = t <= mid
    return [t[first], t[~first] - mid], [mark[first], mark[~first]] if mark is not None else [None, None]


def change_lr(parts: list, marks: list, mid: float, model: str = "uni", beta: float | None = None, restarts: int = 4, held: dict | None = None) -> tuple[dict, dict]:
    """(l0, l1, l2, lr), and the fit of the null: one set of parameters for both halves, in each of which history starts anew.

    `held` are parameters of the null that were fitted elsewhere. The halves' fits also begin from the null's, so lr is not negative.
    """
    free = None if model == "sym_full" else beta
    fit = (lambda t, m, **how: fit_uni(t, mid, **how)) if model == "uni" else (lambda t, m, **how: fit_sym(t, m, mid, free, **how))
    null = held or fit(parts, marks, restarts=restarts)
    l0 = sum(loglik_under(held, t, mid, m) for t, m in zip(parts, marks)) if held else null["loglik"]
    l1, l2 = (fit(t, m, restarts=max(1, restarts // 2), start=null)["loglik"] for t, m in zip(parts, marks))
    return {"l0": l0, "l1": l1, "l2": l2, "lr": 2 * (l1 + l2 - l0)}, null


def hawkes_change_test(df: DataFrame, keys: list[str], model: str = "uni", beta: float = 10.0, t: str = "t", mark: str = "mark") -> DataFrame:
    """l0, l1, l2 and lr = 2 (l1 + l2 - l0) of both halves against one fit of both, degrees of freedom and chi-square p-value.

    Groups of more than CHUNK events as in fit_hawkes_uni.
    """

    def run(key, pdf):
        x, m = _sorted(pdf, t, mark if model != "uni" else None)
        found, _ = change_lr(*_halves_of(x, m, float(x[-1])), float(x[-1]) / 2, model, beta)
        return pd.DataFrame([{**dict(zip(keys, key)), **found, "dof": DOF[model], "p_value": chi2_sf(max(found["lr"], 0.0), float(DOF[model]))}])

    schema = f"{_types(df, keys)}, l0 double, l1 double, l2 double, lr double, dof int, p_value double"
    return hot_and_others(df, keys, run, schema, model, beta=beta, t=t, mark=mark, change=True)


def _carried(chunks: DataFrame, keys: list[str], beta: float) -> DataFrame:
    """For each chunk the time of the last event before it and the state just after that event; null in a key's first chunk.

    A chunk is summed up in one row; only these rows of a key meet in one task.
    """
    last = F.max("t").over(W.partitionBy(*keys, "chunk"))
    ends = chunks.withColumn("last", last).groupBy(*keys, "chunk").agg(F.max("last").alias("last"), F.sum(F.exp(beta * (F.col("t") - F.col("last")))).alias("own"))

    def run(key, pdf):
        pdf = pdf.sort_values("chunk")
        after, out, before = 0.0, [], None
        for last, own in zip(pdf["last"].tolist(), pdf["own"].tolist()):
            out.append((before, after if before is not None else None))
            after = own + (after * math.exp(-beta * (last - before)) if before is not None else 0.0)
            before = last
        return pd.DataFrame({**{k: [v] * len(pdf) for k, v in zip(keys, key)}, "chunk": pdf["chunk"], "from_t": [x for x, _ in out], "from_state": [y for _, y in out]})

    return ends.groupBy(*keys).applyInPandas(run, f"{_types(chunks, keys)}, chunk long, from_t double, from_state double")


def excitation(df: DataFrame, keys: list[str], beta: float, mu: float = 1.0, alpha: float = 0.5, t: str = "t", width: float = 24.0) -> DataFrame:
    """t, state before each event, intensity, and the compensator's increment since the event before.

    A key is cut into chunks of `width` units of time, each a group of its own with the state carried in, so one busy
    key runs in many tasks. Equal times share a chunk. Rows without a time are left out.
    """
    chunks = df.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias("t")).withColumn("chunk", F.floor(F.col("t") / width))

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        x, begun = pdf["t"].to_numpy(float), pd.notna(pdf["from_t"].iloc[0])
        from_t, from_state = (float(pdf["from_t"].iloc[0]), float(pdf["from_state"].iloc[0])) if begun else (0.0, 0.0)
        s = decay_states(x, beta) + from_state * np.exp(-beta * (x - from_t))
        dt = np.diff(x, prepend=from_t)
        before = np.concatenate(([from_state], s[:-1] + 1))
        inc = mu * dt + alpha * before * (1 - np.exp(-beta * dt))
        return pd.DataFrame({**{k: [v] * len(x) for k, v in zip(keys, key)}, "t": x, "state": s, "intensity": mu + alpha * beta * s, "increment": inc})

    joined = chunks.join(_carried(chunks, keys, beta), [*keys, "chunk"])
    return joined.groupBy(*keys, "chunk").applyInPandas(run, f"{_types(df, keys)}, t double, state double, intensity double, increment double")


def intensity_at(df: DataFrame, keys: list[str], beta: float, mu: float, alpha: float, n: int = 2000, t: str = "t") -> DataFrame:
    """Intensity on n points from 0 to a key's last event: an as-of read of the latest state, decayed."""
    from .align import asof_backward

    states = excitation(df, keys, beta, mu, alpha, t).withColumn("after", F.col("state") + 1).withColumn("at", F.col("t"))
    top = df.groupBy(*keys).agg(F.max(t).cast("double").alias("_top"))
    grid = top.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keys, "i", (F.col("_top") * F.col("i") / (n - 1)).alias("t"))
    rows = asof_backward(grid, states.select(*keys, "t", "after", "at"), keys, "t", ["after", "at"], tie="after")
    return rows.select(*keys, "i", "t", (mu + F.coalesce(alpha * beta * F.col("after") * F.exp(-beta * (F.col("t") - F.col("at"))), F.lit(0.0))).alias("intensity"))


def rescaling(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Time-rescaling residuals of each group's own univariate fit: v (Exp(1) under the model) and u = 1 - exp(-v)."""

    def run(key, pdf):
        x, _ = _sorted(pdf, t)
        fit = fit_uni(x, float(x[-1]))
        if fit["beta"] is None:
            v = np.diff(x, prepend=0.0) * (fit["mu"] or 0.0)
        else:
            s, dt = decay_states(x, fit["beta"]), np.diff(x, prepend=0.0)
            v = fit["mu"] * dt + fit["alpha"] * np.concatenate(([0.0], s[:-1] + 1)) * (np.arange(len(x)) > 0) * (1 - np.exp(-fit["beta"] * dt))
        return pd.DataFrame({**{k: [a] * len(x) for k, a in zip(keys, key)}, "t": x, "v": v, "u": 1 - np.exp(-v)})

    return spread(df, *keys).groupBy(*keys).applyInPandas(run, f"{_types(df, keys)}, t double, v double, u double")


def rescaling_sym(df: DataFrame, keys: list[str], beta: float | None = None, t: str = "t", mark: str = "mark") -> DataFrame:
    """Residuals of each mark's events under the group's symmetric fit: growth of the mark's compensator between its events."""

    def run(key, pdf):
        x, m = _sorted(pdf, t, mark)
        fit = fit_sym(x, m, float(x[-1]), beta)
        b = fit["beta"] or 1.0
        # a past event of either mark has given 1 - exp(-beta age) of its mass
        given = [np.cumsum(m == k) - (m == k) - decay_states(x, b, (m == k).astype(float)) for k in (0, 1)]
        out = []
        for k in (0, 1):
            mine = m == k
            grown = fit[f"mu{k}"] * x[mine] + fit["alpha_self"] * given[k][mine] + fit["alpha_cross"] * given[1 - k][mine]
            out.append(pd.DataFrame({"mark": k, "t": x[mine], "v": np.diff(grown, prepend=0.0)}))
        out = pd.concat(out, ignore_index=True)
        return out.assign(**dict(zip(keys, key)), u=1 - np.exp(-out["v"]))[[*keys, "mark", "t", "v", "u"]]

    return spread(df, *keys).groupBy(*keys).applyInPandas(run, f"{_types(df, keys)}, mark int, t double, v double, u double")


def rescaling_summary(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Size, mean, quantiles and the Kolmogorov-Smirnov distance to Exp(1) of the residuals, by built-in functions."""
    from .distribution import ks_stat, with_ks_p

    ks = with_ks_p(ks_stat(residuals, "v", 1 - F.exp(-F.col("v")), keys)).select(*keys, "ks", "p_value")
    q = lambda p: F.percentile("v", F.lit(p))
    return residuals.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), q(0.5).alias("median"), q(0.1).alias("q10"), q(0.9).alias("q90"), q(0.99).alias("q99")).join(ks, keys)


@dataclass
class History:
    """The events of a half as they were, under a fit: knots are 0 and the events, `after` the states just after them
    (of all events, and of the signs of marks), `cum` the compensator at them, `total` at the end."""

    knots: np.ndarray
    after: list[np.ndarray]
    cum: np.ndarray
    total: float
    mass: float

    @classmethod
    def of(cls, t: np.ndarray, mark: np.ndarray | None, both: dict, end: float) -> History:
        states = Lanes(t, end, mark).states(both["beta"])
        # each event before has given 1 - exp(-beta age) of its mass
        cum = both["mu"] * t + both["alpha"] * (np.arange(len(t)) - states[0])
        steps = [np.ones(len(t))] if mark is None else [np.ones(len(t)), 1.0 - 2.0 * mark]
        after = [np.append(0.0, s + x) for s, x in zip(states, steps)]
        mass = len(t) - after[0][-1] * math.exp(-both["beta"] * (end - t[-1]))
        return cls(np.append(0.0, t), after, np.append(0.0, np.maximum.accumulate(cum)), both["mu"] * end + both["alpha"] * mass, float(mass))


def _invert(seen: History, both: dict, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The times when the compensator reaches ascending targets below its total, and the knots before them.

    Between knots it is concave, so Newton's steps from the left of a root stay there.
    """
    i = np.searchsorted(seen.cum, targets, "left") - 1
    i = np.maximum(i, 0)
    lost, low, mu, beta = targets - seen.cum[i], seen.knots[i], both["mu"], both["beta"]
    lift = both["alpha"] * seen.after[0][i]
    slope, bend = mu + beta * lift, beta * beta * lift
    x = 2 * lost / (slope + np.sqrt(np.maximum(slope * slope - 2 * bend * lost, 0.0)))
    todo = None
    for _ in range(200):
        y, e, a = (x, lost, lift) if todo is None else (x[todo], lost[todo], lift[todo])
        fade = a * np.exp(-beta * y)
        new = np.maximum(y + (e - mu * y - a + fade) / (mu + beta * fade), 0.0)
        far = np.abs(new - y) > 1e-13 * new
        if todo is None:
            x, todo = new, np.flatnonzero(far)
        else:
            x[todo] = new
            todo = todo[far]
        if not len(todo):
            break
    return low + x, i


def _simulate(fit, end, rng, most=math.inf):
    """One path under the fitted parameters, to its horizon or, if given, its first `most` events.

    Events of the baseline are uniform, and each event has a Poisson number of children at exponential delays.
    """
    born = rng.uniform(0, end, rng.poisson(fit["mu"] * end))
    every = [born]
    while len(born):
        born = np.repeat(born, rng.poisson(fit["alpha"], len(born)))
        born += rng.exponential(1 / fit["beta"], len(born))
        born = born[born <= end]
        every.append(born)
    out = np.sort(np.concatenate(every))
    return out if len(out) <= most else out[: int(most)]


def _simulate_sym(fit, end, rng):
    """One path of times and marks under a symmetric fit, to its horizon: children of the parent's mark, and of the other."""
    n = [rng.poisson(fit[f"mu{k}"] * end) for k in (0, 1)]
    born, kind = rng.uniform(0, end, sum(n)), np.repeat([0, 1], n)
    every, kinds = [born], [kind]
    while len(born):
        own, other = rng.poisson(fit["alpha_self"], len(born)), rng.poisson(fit["alpha_cross"], len(born))
        born = np.concatenate((np.repeat(born, own), np.repeat(born, other)))
        kind = np.concatenate((np.repeat(kind, own), 1 - np.repeat(kind, other)))
        born += rng.exponential(1 / fit["beta"], len(born))
        born, kind = born[born <= end], kind[born <= end]
        every.append(born)
        kinds.append(kind)
    t, marks = np.concatenate(every), np.concatenate(kinds)
    order = np.argsort(t, kind="stable")
    return t[order], marks[order].astype(int)


def loglik_under(fit: dict, t: np.ndarray, end: float, mark: np.ndarray | None = None) -> float:
    """The log-likelihood of events under parameters that were fitted elsewhere."""
    if mark is not None:
        p = [fit[c] for c in ("mu0", "mu1", "alpha_self", "alpha_cross")]
        if fit["beta"] is None or not any(p):
            return 0.0
        return -float(sym_loglik(np.log(np.maximum(p, 1e-300)), t, mark, end, fit["beta"])[0])
    if fit["beta"] is None:
        return len(t) * math.log(fit["mu"]) - fit["mu"] * end if fit["mu"] else 0.0
    return -float(uni_loglik(np.log([fit["mu"], max(fit["alpha"], 1e-300), fit["beta"]]), t, end)[0])


def states_at(t: np.ndarray, mark: np.ndarray, at: np.ndarray, beta: float) -> list[np.ndarray]:
    """For each mark its decayed events before given times."""
    if not len(t):
        return [np.zeros(len(at)) for _ in (0, 1)]
    last = np.searchsorted(t, at, side="left") - 1
    fade = np.where(last >= 0, np.exp(-beta * np.maximum(at - t[last], 0.0)), 0.0)
    return [(decay_states(t, beta, (mark == k).astype(float)) + (mark == k))[last] * fade for k in (0, 1)]


def design_loglik(x: np.ndarray, at: np.ndarray, mark: np.ndarray, end: float, beta: float, seen: list[np.ndarray], mass: float) -> tuple[float, np.ndarray]:
    """As sym_loglik for drawn events `at` that are excited by other, fixed ones: their states there, and the mass they give by `end`."""
    sums = sym_sums(x, at, mark, end, beta, seen, None)
    sums[1] = mass
    return sym_value(x, sums, end, beta)


def design_lr(parts: list, marks: list, drawn: list, mid: float, beta: float, restarts: int = 1, seen: list | None = None) -> float:
    """The change statistic of drawn halves (times, marks) over the histories of the halves as they were, with beta held.

    `seen` has for each half the states at its drawn events and the mass that its history gives, where they are known.
    """
    if seen is None:
        seen = [(states_at(t, m, at, beta), float((1 - np.exp(-beta * (mid - t))).sum())) for t, m, (at, _) in zip(parts, marks, drawn)]
    designs = []
    for (_, kinds), (states, mass) in zip(drawn, seen):
        own, other = np.where(kinds == 0, *states), np.where(kinds == 0, *states[::-1])
        designs.append((Held(own, other, kinds, mid, beta, mass).sym, [int((kinds == k).sum()) for k in (0, 1)]))
    return lanes_lr(designs, mid, "sym", beta, restarts)[0]["lr"]


def _parts_of(parts: list, marks: list, mid: float, model: str, beta: float | None) -> list[tuple[Callable, list[int]]]:
    """Of each half (value, gradient, information) at given parameters, and its events by mark."""

    def idle(x):
        n = 1 if model == "uni" else 2
        grad = np.append(np.exp(x[:n]) * mid, np.zeros(len(x) - n))
        return grad.sum(), grad, np.zeros((len(x), len(x)))

    out = []
    for t, m in zip(parts, marks):
        counts = [len(t), 0] if m is None else [int((m == 0).sum()), int((m == 1).sum())]
        if not len(t):
            out.append((idle, counts))
        elif model == "uni":
            out.append((Lanes(t, mid).uni, counts))
        else:
            out.append((Lanes(t, mid, m).sym if beta is None else Held.of(t, m, mid, beta).sym, counts))
    return out


def lanes_lr(halves: list, mid: float, model: str, beta: float | None, restarts: int, held: dict | None = None) -> tuple[dict, dict]:
    """As change_lr, over the halves of _parts_of() and by the information of their likelihoods.

    With beta given a likelihood has one maximum, so one start is enough, if no parameter begins at zero: it would stay there.
    """

    def fit(some: list, restarts: int, start: dict | None = None) -> dict:
        n0, n1 = (sum(n[k] for _, n in some) for k in (0, 1))
        plan = uni_plan(n0, mid * len(some), restarts=restarts, start=start) if model == "uni" else sym_plan(n0, n1, mid * len(some), beta, restarts, start=start)
        if beta is not None and model != "uni":
            span = mid * len(some)
            plan.starts = [np.maximum(x, np.log([max(n0, 0.5) / span / 100, max(n1, 0.5) / span / 100, 0.01, 0.01])) for x in plan.starts[-1:]]
        return fit_lanes(plan, [f for f, _ in some])

    null = held or fit(halves, restarts)
    if not held:
        l0 = null["loglik"]
    else:
        # a fit to fewer than two events has no beta, and its rates are those of plan.given
        names = ["mu", "alpha", "beta"] if model == "uni" else ["mu0", "mu1", "alpha_self", "alpha_cross", *(["beta"] if beta is None else [])]
        n = sum(map(sum, (n for _, n in halves)))
        if null["beta"] is None:
            l0 = (n * math.log(null["mu"]) - null["mu"] * 2 * mid) if model == "uni" and null["mu"] else 0.0
        elif model != "uni" and not any(null[c] for c in names[:4]):
            l0 = 0.0
        else:
            l0 = -sum(float(f(np.log(np.maximum([null[c] for c in names], 1e-300)))[0]) for f, _ in halves)
    l1, l2 = (fit([half], max(1, restarts // 2), null)["loglik"] for half in halves)
    return {"l0": l0, "l1": l1, "l2": l2, "lr": 2 * (l1 + l2 - l0)}, null


def _both(fit: dict, marked: bool) -> dict:
    """The fit of all events, whatever their mark."""
    return {"mu": fit["mu0"] + fit["mu1"], "alpha": fit["alpha_self"] + fit["alpha_cross"], "beta": fit["beta"]} if marked else fit


def redraw(t: np.ndarray, mark: np.ndarray | None, fit: dict, end: float, rng, method: str, seen: History | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Events, and marks if there are, of one half under the null.

    fixed_intensity puts Exp(1) arrivals into the compensator of the events as they are and draws each mark by its share
    of the intensity there; parametric simulates the process anew.
    """
    return _redrawn(t, mark, fit, end, rng, method, seen)[:2]


def _redrawn(t, mark, fit, end, rng, method, seen: History | None = None) -> tuple[np.ndarray, np.ndarray | None, list | None]:
    """redraw(), and the states of both marks at the drawn events where the marks went by them."""
    both = _both(fit, mark is not None)
    if both["beta"] is None or not len(t):
        star = np.sort(rng.uniform(0, end, rng.poisson((both["mu"] or 0.0) * end)))
        nothing = [np.zeros(len(star))] * 2
        return (star, None, None) if mark is None else (star, (rng.uniform(size=len(star)) * both["mu"] > fit["mu0"]).astype(int), nothing)
    if method == "parametric":
        return (_simulate(fit, end, rng), None, None) if mark is None else (*_simulate_sym(fit, end, rng), None)
    seen = seen or History.of(t, mark, both, end)
    total = seen.total
    arrivals = np.cumsum(rng.exponential(size=int(total + 10 * math.sqrt(total) + 50)))
    star = arrivals[arrivals < total]
    del arrivals
    kinds, states = (None, None) if mark is None else (np.empty(len(star), np.int8), np.empty((2, len(star))))
    for lo in range(0, len(star), BLOCK):
        at = slice(lo, lo + BLOCK)
        x, knot = _invert(seen, both, star[at])
        star[at] = np.minimum(x, np.where(knot + 1 < len(seen.knots), seen.knots[np.minimum(knot + 1, len(seen.knots) - 1)], end))
        if mark is not None:
            fade = np.exp(-fit["beta"] * (star[at] - seen.knots[knot]))
            every, signed = (a[knot] * fade for a in seen.after)
            here = states[:, at] = (every + signed) / 2, (every - signed) / 2
            rate = [fit[f"mu{k}"] + fit["beta"] * (fit["alpha_self"] * here[k] + fit["alpha_cross"] * here[1 - k]) for k in (0, 1)]
            kinds[at] = rng.uniform(size=len(x)) * (rate[0] + rate[1]) > rate[0]
    return star, kinds, states


#: Events that are drawn at a time.
BLOCK = 1 << 16


def hawkes_bootstrap(df: DataFrame, keys: list[str], replicates: int, seed: int = 0, method: str = "fixed_intensity", t: str = "t", block: int = 25, restarts: int = 1, model: str = "uni", beta: float = 10.0, mark: str = "mark") -> DataFrame:
    """lr, replicates, p_value = (1 + #{lr* >= lr}) / (B + 1) of the change test of each series.

    Both halves are drawn apart under the common fit of both, by redraw(). fixed_intensity refits the null and the
    halves of each replicate, with beta held in model "sym"; fixed_design (model "sym" only) draws in the same way and
    refits over the states of the events as they were; parametric refits the halves and holds the null's parameters. A
    series is fitted once; a task then takes one series and a block of replicates. Seeds follow from series and
    replicate, so a lost task redoes the same draws. Events travel as one binary a block.
    """
    marked = model != "uni"
    if method == "fixed_design" and model != "sym":
        raise ValueError("fixed_design needs two marks and a given beta: model='sym'")
    free = beta if model == "sym" else None
    names = ["mu0", "mu1", "alpha_self", "alpha_cross", "beta"] if marked else ["mu", "alpha", "beta"]
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), (F.col(mark).cast("int") if marked else F.lit(0)).alias("m")))).alias("ts"))

    def halves(x: np.ndarray, m: np.ndarray) -> tuple[list, list, float]:
        mid = float(x[-1]) / 2
        return *_halves_of(x, m if marked else None, 2 * mid), mid

    def observed(key, pdf):
        x, m = np.array(pdf["ts"].iloc[0], float), np.array(pdf["ms"].iloc[0], np.int8)
        parts, marks, mid = halves(x, m)
        found, null = lanes_lr(_parts_of(parts, marks, mid, model, free), mid, model, free, restarts)
        return pd.DataFrame([{**dict(zip(keys, key)), "ts": x.tobytes(), "ms": m.tobytes(), "lr": found["lr"], "fit": [math.nan if null[c] is None else float(null[c]) for c in names]}])

    kinds = _types(df, keys)
    rows = series.select(*keys, F.col("ts.t").alias("ts"), F.col("ts.m").alias("ms"))
    fitted = spread(rows, *keys).groupBy(*keys).applyInPandas(observed, f"{kinds}, ts binary, ms binary, lr double, fit array<double>")
    blocks = fitted.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1))))

    def run(key, pdf):
        row, number = pdf.iloc[0], int(key[-1])
        x = np.frombuffer(row["ts"])
        parts, marks, mid = halves(x, np.frombuffer(row["ms"], np.int8))
        null = {c: None if math.isnan(v) else float(v) for c, v in zip(names, row["fit"])}
        fixed = method != "parametric" and null["beta"] is not None
        seen = [History.of(a, m, _both(null, marked), mid) if fixed and len(a) else None for a, m in zip(parts, marks)]
        hits = done = 0
        for r in range(number * block, min(replicates, (number + 1) * block)):
            rng = np.random.default_rng([seed, r, len(x), int(x.sum() * 1e3) % (1 << 32)])
            star = [_redrawn(a, m, null, mid, rng, method, h) for a, m, h in zip(parts, marks, seen)]
            if method == "fixed_design":
                lr = design_lr(parts, marks, [s[:2] for s in star], mid, beta, restarts, [(s[2], h.mass if h else 0.0) for s, h in zip(star, seen)])
            else:
                star = [s[:2] for s in star]
                drawn = _parts_of([s[0] for s in star], [s[1] for s in star], mid, model, free)
                lr = lanes_lr(drawn, mid, model, free, restarts, null if method == "parametric" else None)[0]["lr"]
            hits += lr >= row["lr"]
            done += 1
        return pd.DataFrame([{**dict(zip(keys, key[:-1])), "lr": row["lr"], "hits": hits, "done": done}])

    parts = spread(blocks, *keys, "b").groupBy(*keys, "b").applyInPandas(run, f"{kinds}, lr double, hits long, done long")
    return parts.groupBy(*keys).agg(F.max("lr").alias("lr"), F.sum("done").alias("replicates"), ((1 + F.sum("hits")) / (F.sum("done") + 1)).alias("p_value"))
