import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import causal, distribution, entropy, hawkes, kde, series, stationarity, stats


def test_special_functions():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_quantile(0.99, 7) == pytest.approx(18.475306906582357, abs=1e-6)
    assert stats.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert stats.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert stats.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert stats.gamma_p(2.5, 3.0) == pytest.approx(0.6937810816778878, abs=1e-9)
    t = entropy.kl_thresholds(6, 57, 0.01)
    assert t["one_sample"] == pytest.approx(stats.chi2_quantile(0.99, 5) / 114) and t["finite"] > t["one_sample"]
    x = t["finite"]
    assert math.exp(-57 * x) * (math.e * 57 * x / 5) ** 5 == pytest.approx(0.01, rel=1e-6)


def simulate(end, seed):
    return hawkes._simulate({"mu": 1.0, "alpha": 0.5, "beta": 2.0}, end, np.random.default_rng(seed), 10**6)


def test_decay_and_gradient():
    t = np.sort(np.random.default_rng(0).uniform(0, 100, 200))
    for beta in (0.05, 2.0, 80.0):
        s = [np.exp(-beta * (t[i] - t[:i])).sum() for i in range(200)]
        assert np.allclose(hawkes.decay_states(t, beta), s)
    x = np.log([1.0, 0.4, 2.0])
    g = hawkes.uni_loglik(x, t, 100.0)[1]
    num = [(hawkes.uni_loglik(x + 1e-6 * e, t, 100.0)[0] - hawkes.uni_loglik(x - 1e-6 * e, t, 100.0)[0]) / 2e-6 for e in np.eye(3)]
    assert np.allclose(g, num, rtol=1e-5)


def test_fit_recovers_and_rescales(spark):
    t = simulate(1500, 3)
    df = spark.createDataFrame([(1, float(x)) for x in t] + [(2, 1.0)], "k int, t double")
    fit = {r["k"]: r for r in hawkes.fit_hawkes_uni(df, ["k"]).collect()}
    assert fit[1]["mu"] == pytest.approx(1, abs=0.2) and fit[1]["alpha"] == pytest.approx(0.5, abs=0.1) and fit[1]["beta"] == pytest.approx(2, abs=0.6)
    assert fit[2]["n"] == 1
    res = hawkes.rescaling_summary(hawkes.rescaling(df.filter("k = 1"), ["k"]), ["k"]).first()
    assert res["mean"] == pytest.approx(1, abs=0.02) and res["p_value"] > 0.01


def test_change_test(spark):
    calm, busy = np.sort(np.random.default_rng(1).uniform(0, 100, 80)), np.sort(np.random.default_rng(2).uniform(100, 200, 400))
    even = np.sort(np.random.default_rng(3).uniform(0, 200, 300))
    df = spark.createDataFrame([("jump", float(x)) for x in [*calm, *busy]] + [("none", float(x)) for x in even], "k string, t double")
    p = {r["k"]: r["p_value"] for r in hawkes.hawkes_change_test(df, ["k"]).collect()}
    assert p["jump"] < 1e-6 and p["none"] > 0.001
    boot = {r["k"]: r for r in hawkes.hawkes_bootstrap(df, ["k"], 9, block=3).collect()}
    assert boot["jump"]["replicates"] == 9 and boot["jump"]["p_value"] == pytest.approx(0.1)
    again = {r["k"]: r for r in hawkes.hawkes_bootstrap(df, ["k"], 9, block=9).collect()}
    assert again["none"]["p_value"] == boot["none"]["p_value"]


@pytest.mark.parametrize("width", [0.05, 7.0, 1e6])
def test_excitation_in_chunks(spark, width):
    """The same states however a key is cut: ties, long pauses, a key of one event, rows without a time."""
    rng = np.random.default_rng(8)
    a = np.round(np.sort(np.concatenate((rng.uniform(0, 20, 60), rng.uniform(2000, 2003, 60)))), 2)
    df = spark.createDataFrame([("a", float(x)) for x in rng.permutation(a)] + [("b", 5.0), ("b", None)], "k string, t double")
    out = hawkes.excitation(df, ["k"], 1.5, 0.7, 0.4, width=width).toPandas().sort_values(["k", "t", "state"])
    got = out[out["k"] == "a"]
    s = np.array([np.exp(-1.5 * (a[i] - a[:i])).sum() for i in range(len(a))])
    assert np.allclose(got["t"], a) and np.allclose(got["state"], s) and np.allclose(got["intensity"], 0.7 + 0.6 * s)
    grown = [0.7 * x + 0.4 * (1 - np.exp(-1.5 * (x - a[a < x]))).sum() for x in a]
    assert np.allclose(np.cumsum(got["increment"]), grown)
    only = out[out["k"] == "b"]
    assert len(only) == 1 and only["state"].item() == 0 and only["increment"].item() == pytest.approx(3.5)
    assert hawkes.excitation(df.limit(0), ["k"], 1.5, width=width).count() == 0


def test_bivariate(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 300, 500))
    df = spark.createDataFrame([(1, float(x), int(m)) for x, m in zip(t, rng.integers(0, 2, 500))], "k int, t double, mark int")
    fixed, full = hawkes.fit_hawkes_sym(df, ["k"], 2.0).first(), hawkes.fit_hawkes_sym_full(df, ["k"]).first()
    assert full["loglik"] >= fixed["loglik"] - 1e-6 and fixed["alpha_self"] + fixed["alpha_cross"] < 0.2


def test_change_statistic_is_nested():
    """One fit of both halves never beats a fit of each, and its p-values are spread without a change."""
    p = []
    for seed in range(16):
        t = hawkes._simulate({"mu": 0.3, "alpha": 0.9, "beta": 1.0}, 120.0, np.random.default_rng(seed))
        found, _ = hawkes.change_lr(*hawkes._halves_of(t, None, 120.0), 60.0)
        assert found["lr"] >= -1e-9
        p.append(stats.chi2_sf(found["lr"], 3.0))
    assert 0.2 < np.mean(p) < 0.8 and min(p) > 1e-4
    rng = np.random.default_rng(1)
    fit = {"mu0": 0.5, "mu1": 1.0, "alpha_self": 0.4, "alpha_cross": 0.2, "beta": 2.0}
    for model in ("sym", "sym_full"):
        for seed in range(3):
            t, m = hawkes._simulate_sym(fit, 80.0, np.random.default_rng(seed))
            assert hawkes.change_lr(*hawkes._halves_of(t, m, 80.0), 40.0, model, 2.0)[0]["lr"] >= -1e-9
    # arrivals drawn in compensator time have the rate and the marks of the fit
    t, m = hawkes._simulate_sym(fit, 400.0, rng)
    drawn = [hawkes.redraw(t, m, fit, 400.0, np.random.default_rng(i), "fixed_intensity") for i in range(20)]
    mass = lambda k: fit[f"mu{k}"] * 400 + sum((fit["alpha_self"] if j == k else fit["alpha_cross"]) * (1 - np.exp(-2.0 * (400 - t[m == j]))).sum() for j in (0, 1))
    for k in (0, 1):
        assert np.mean([(x == k).sum() for _, x in drawn]) == pytest.approx(mass(k), rel=0.06)
    assert all((np.diff(x) >= 0).all() and 0 <= x.min() and x.max() <= 400 for x, _ in drawn)


def test_marked_residuals_and_bootstrap(spark):
    fit = {"mu0": 0.5, "mu1": 1.0, "alpha_self": 0.4, "alpha_cross": 0.2, "beta": 2.0}
    t, m = hawkes._simulate_sym(fit, 500.0, np.random.default_rng(2))
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(t, m)], "k string, t double, mark int")
    out = hawkes.rescaling_sym(df, ["k"], 2.0)
    assert out.count() == len(t)
    for r in hawkes.rescaling_summary(out, ["k", "mark"]).collect():
        assert r["mean"] == pytest.approx(1, abs=0.1) and r["p_value"] > 0.01
    # a mark's compensator by its definition
    own = hawkes.fit_sym(t, m, float(t[-1]), 2.0)
    x = t[m == 0]
    grown = [own["mu0"] * y + sum((own["alpha_self"] if b == 0 else own["alpha_cross"]) * (1 - math.exp(-2.0 * (y - a))) for a, b in zip(t, m) if a < y) for y in x[:40]]
    got = [r["v"] for r in out.filter("mark = 0").orderBy("t").limit(40).collect()]
    assert np.allclose(np.cumsum(got), grown)
    some = hawkes.hawkes_bootstrap(df.limit(150), ["k"], 4, block=2, model="sym", beta=2.0).first()
    assert some["replicates"] == 4 and some["p_value"] in (0.2, 0.4, 0.6, 0.8, 1.0)


def test_fixed_design_bootstrap(spark):
    """Likelihood and gradient over a fixed history by their definition, and the replicates by a loop."""
    fit = {"mu0": 0.5, "mu1": 1.0, "alpha_self": 0.4, "alpha_cross": 0.2, "beta": 2.0}
    t, m = hawkes._simulate_sym(fit, 60.0, np.random.default_rng(8))
    at, kinds = hawkes.redraw(t, m, fit, 60.0, np.random.default_rng(1), "fixed_intensity")
    seen = hawkes.states_at(t, m, at, 2.0)
    assert np.allclose(seen[1], [sum(math.exp(-2.0 * (y - a)) for a, b in zip(t, m) if a < y and b == 1) for y in at])
    assert [s.tolist() for s in hawkes.states_at(t[:0], m[:0], at[:2], 2.0)] == [[0, 0], [0, 0]]
    x = np.log([0.7, 0.9, 0.3, 0.25])
    mass = sum(1 - math.exp(-2.0 * (60 - a)) for a in t)
    p = np.exp(x)
    want = sum(math.log(p[k] + 2 * (p[2] * seen[k][i] + p[3] * seen[1 - k][i])) for i, k in enumerate(kinds)) - 60 * (p[0] + p[1]) - mass * (p[2] + p[3])
    value, g = hawkes.design_loglik(x, at, kinds, 60.0, 2.0, seen, mass)
    assert -value == pytest.approx(want, rel=1e-12)
    for i in range(4):
        up, down = (hawkes.design_loglik(x + s * np.eye(4)[i] * 1e-5, at, kinds, 60.0, 2.0, seen, mass)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-5, rel=1e-5, abs=1e-6)
    # the events as they were, over their own history, are the plain test
    mid = float(t[-1]) / 2
    parts, marks = hawkes._halves_of(t, m, 2 * mid)
    found, null = hawkes.change_lr(parts, marks, mid, "sym", 2.0, 1)
    assert hawkes.design_lr(parts, marks, list(zip(parts, marks)), mid, 2.0) == pytest.approx(found["lr"], abs=1e-4)
    hits = 0
    for r in range(8):
        rng = np.random.default_rng([0, r, len(t), int(t.sum() * 1e3) % (1 << 32)])
        star = [hawkes.redraw(a, b, null, mid, rng, "fixed_intensity") for a, b in zip(parts, marks)]
        hits += hawkes.design_lr(parts, marks, star, mid, 2.0) >= found["lr"]
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(t, m)], "k string, t double, mark int")
    got = hawkes.hawkes_bootstrap(df, ["k"], 8, block=3, method="fixed_design", model="sym", beta=2.0).first()
    assert got["replicates"] == 8 and got["p_value"] == pytest.approx((1 + hits) / 9)
    with pytest.raises(ValueError):
        hawkes.hawkes_bootstrap(df, ["k"], 8, method="fixed_design")


def test_gamma_and_ks(spark):
    x = np.random.default_rng(5).gamma(3.0, 2.0, 4000)
    df = spark.createDataFrame([(1, float(v)) for v in x], "k int, x double")
    fits = distribution.fit_gamma(df, "x", ["k"])
    f = fits.first()
    assert f["shape"] == pytest.approx(3, abs=0.2) and f["scale"] == pytest.approx(2, abs=0.2)
    ks = distribution.with_ks_p(distribution.ks_stat(distribution.fitted_cdf(df, fits, "x", ["k"]), "x", F.col("cdf"), ["k"])).first()
    assert ks["ks"] < 0.03 and ks["p_value"] > 0.05


def test_pattern_kl_unseen_and_short(spark):
    rows = [(1, i, float(i)) for i in range(40)] + [(1, 40 + i, float(i % 2)) for i in range(40)] + [(2, i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    out = entropy.rolling_pattern_kl(df, "x", 20, 6, ["k"], "i").collect()
    assert {r["k"] for r in out} == {1}
    assert out and max(r["kl_first"] for r in out) == math.inf and min(r["kl_first"] for r in out) == 0.0


def test_adf():
    rng = np.random.default_rng(6)
    assert stationarity.adf(rng.normal(size=500))["p_value"] < 0.01
    assert stationarity.adf(np.cumsum(rng.normal(size=500)))["p_value"] > 0.05
    assert stationarity.adf(np.ones(50))["statistic"] is None


def test_kde_uniformity():
    x = np.random.default_rng(7).normal(size=400)
    g = kde.grid_of(x, 256)
    z = kde.pit(x, 0.5, 0.99, 50, g)
    assert len(z) == 350 and 0.4 < z.mean() < 0.6
    assert kde.uniformity(z, 5) < kde.uniformity(z**3, 5)
    # the forecast by its definition, and neighbours counted one by one
    for i in (0, 7, 349):
        past = x[: 50 + i]
        w = np.r_[kde.start_weights(50, 0.99) * 0.99**i, (1 - 0.99) * 0.99 ** np.arange(i)[::-1]]
        assert z[i] == pytest.approx(np.interp(x[50 + i], g, w @ kde.ramp(g, past, 0.5)), abs=1e-9)
    a, b = np.random.default_rng(1).integers(0, 12, (2, 200)).astype(float)
    assert kde.dominated(a, b).tolist() == [int(((a <= p) & (b <= q)).sum()) for p, q in zip(a, b)]


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_densities_over_chunks_equal_the_loop(spark, chunk):
    """Each row normalizes the density anew; however a series is cut, the same densities come out."""
    rng = np.random.default_rng(5)
    series_ = {"a": rng.normal(size=230), None: rng.gamma(2, size=95), "short": rng.normal(size=9), "flat": np.ones(80)}
    rows = [(k, i, float(v)) for k, x in series_.items() for i, v in enumerate(x)] + [("a", 500, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(3)
    h, omega, t0 = 0.4, 0.97, 20
    for every, at in ((25, None), (60, [19, 20, 94, 229, 1_000])):
        got = {(r["k"], r["row"]): r for r in kde.dynamic_kde(df, "x", ["k"], "i", h, omega, t0, every=every, points=64, at=at, chunk=chunk).collect()}
        want = {}
        for k in ("a", None):
            x = series_[k]
            g = kde.grid_of(x, 64)
            d = first = kde._unit(kde.start_weights(t0, omega) @ kde.bump(g, x[:t0], h), g)
            for i in range(t0 - 1, len(x)):
                if i >= t0:
                    d = kde._unit(omega * d + (1 - omega) * kde.bump(g, x[i], h)[0], g)
                if (i in at) if at else (i - t0 + 1) % every == 0 and i >= t0:
                    p, q = np.maximum(d, kde.TINY), np.maximum(first, kde.TINY)
                    want[k, i] = (g, d, np.trapezoid(p * np.log(p / q), g))
        assert set(got) == set(want)
        for at_, (g, d, kl) in want.items():
            assert np.allclose(got[at_]["grid"], g) and np.allclose(got[at_]["density"], d, rtol=1e-10, atol=1e-12) and got[at_]["kl_first"] == pytest.approx(kl, abs=1e-9)


def test_candidates_of_short_and_constant_series(spark):
    rows = [("flat", i, 1.0) for i in range(60)] + [("short", i, float(i % 5)) for i in range(12)] + [("ok", i, float(i * 7 % 13)) for i in range(60)]
    cells = kde.select_kde(spark.createDataFrame(rows, "k string, i int, x double"), "x", ["k"], "i", t0=8, nu=5, n_h=2, n_omega=2)
    assert {r["k"] for r in cells.collect()} == {"short", "ok"} and [r["k"] for r in kde.best_candidate(cells, ["k"]).collect()] == ["ok"]
    assert kde.grid_of(np.ones(5), 16) is None and kde.uniformity(np.linspace(0, 1, 7), 5) is None


def test_conditional_cdf_equals_loop():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(700, 2))
    x = np.round(z[:, 0] + rng.normal(size=700), 1)
    got = causal.conditional_cdf(x, z)
    some = z[np.random.default_rng(0).choice(700, size=200, replace=False)]
    gaps = [math.dist(p, q) for i, p in enumerate(some) for q in some[:i]]
    h = np.median([q for q in gaps if q > 0])
    for i in (0, 3, 699):
        w = np.array([math.exp(-math.dist(z[i], q) ** 2 / (2 * h * h)) for q in z])
        assert got[i] == pytest.approx((w * (x <= x[i])).sum() / w.sum(), rel=1e-9)


def test_xcf_equals_numpy(spark):
    rng = np.random.default_rng(8)
    d, v = rng.normal(size=60), rng.normal(size=60)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(d, v))], "k int, i int, d double, v double")
    got = [r["xcf"] for r in series.xcf(df, "d", "v", 5, ["k"], "i").orderBy("lag").collect()]
    assert np.allclose(got, causal.xcf_of(d, v, 5))
    band = causal.xcf_null(df, "d", "v", ["k"], "i", n=20, max_lag=5).orderBy("lag").collect()
    assert len(band) == 11 and all(r["low"] < r["high"] for r in band)


def test_causal_graph(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=150)
    b = np.concatenate(([0.0], a[:-1])) * 2 + 0.3 * rng.normal(size=150)
    df = spark.createDataFrame([(float(x), float(y), float(z), float(w)) for x, y, z, w in zip(a[1:], b[1:], a[:-1], b[:-1])], "a double, b double, a_lag1 double, b_lag1 double")
    edges = {(r["from"], r["to"], r["type"]) for r in causal.causal_graph(df, ["a", "b", "a_lag1", "b_lag1"], max_cond=1, sims=200).collect()}
    assert ("a_lag1", "b", "directed") in edges and not any({x, y} == {"a", "b"} for x, y, _ in edges)


def test_numbered_tests_are_all_tests():
    """The ranges of a level's numbers hold each choice of conditions around either end of a link once."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        links = [(i, j) for i in range(7) for j in range(i + 1, 7) if rng.uniform() < 0.6]
        near = causal._around(links)
        for size in range(4):
            want = sorted({(i, j, c) for i, j in links for a, b in ((i, j), (j, i)) for c in itertools.combinations([x for x in near[a] if x != b], size)})
            n, step = causal.count_tests(links, size), int(rng.integers(1, 9))
            got = [t for low in range(0, n, step) for t in causal.tests_of(links, size, low, low + step)]
            assert sorted(got) == want and len(set(got)) == len(got)
    assert [causal.combination([2, 3, 5, 7], 2, k) for k in range(6)] == list(itertools.combinations([2, 3, 5, 7], 2))


def plain_graph(x, names, alpha, max_cond, null):
    """The search by its definition, in one place."""
    links = {(i, j) for i, j in itertools.combinations(range(len(names)), 2) if causal.lag_of(names[i]) != causal.lag_of(names[j])}
    apart = {}
    for size in range(max_cond + 1):
        near = causal._around(sorted(links))
        gone = {}
        for i, j in sorted(links):
            tests = sorted({c for a, b in ((i, j), (j, i)) for c in itertools.combinations([y for y in near[a] if y != b], size)})
            for c in tests:
                if causal.independence(x, i, j, list(c), null)[0] > alpha:
                    gone[i, j] = c
                    break
        links -= gone.keys()
        apart |= {frozenset(k): c for k, c in gone.items()}
    return set(causal.orient(names, {frozenset(e) for e in links}, apart))


@pytest.mark.parametrize("per_task", [1, 3, 200])
def test_causal_graph_by_numbers(spark, per_task):
    rng = np.random.default_rng(4)
    a = rng.normal(size=91)
    b = np.concatenate(([0.0], a[:-1])) + 0.5 * rng.normal(size=91)
    c = a + b + 0.5 * rng.normal(size=91)
    x = np.stack([a[1:], b[1:], c[1:], a[:-1], b[:-1], c[:-1]], axis=1)
    names = ["a", "b", "c", "a_lag1", "b_lag1", "c_lag1"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    null = np.concatenate([causal.null_rho(90, 50, [42, 0]), causal.null_rho(90, 10, [42, 1])])
    x = np.array(sorted(map(tuple, x)))
    want = plain_graph(x, names, 0.05, 3, null)
    assert {tuple(r) for r in causal.causal_graph(df, names, alpha=0.05, max_cond=3, sims=60, per_task=per_task).collect()} == want and want


def test_causal_graphs_of_all_keys(spark):
    """Every key has its own graph and tests, equal to those of the key alone."""
    rng = np.random.default_rng(9)
    rows = []
    for key, n in (("u", 150), ("v", 120), (None, 120)):
        a = rng.normal(size=n)
        b = np.concatenate(([0.0], a[:-1])) * (2 if key == "u" else 0) + 0.3 * rng.normal(size=n)
        rows += [(key, *map(float, x)) for x in zip(a[1:], b[1:], a[:-1], b[:-1])]
    names = ["a", "b", "a_lag1", "b_lag1"]
    df = spark.createDataFrame(rows, "k string, a double, b double, a_lag1 double, b_lag1 double")
    got = {tuple(r) for r in causal.causal_graph(df, names, max_cond=1, sims=200, keys=["k"]).collect()}
    assert ("u", "a_lag1", "b", "directed") in got and (None, "a_lag1", "b", "directed") not in got
    for key in ("u", "v", None):
        alone = causal.causal_graph(df.filter(F.col("k").eqNullSafe(F.lit(key))), names, max_cond=1, sims=200)
        assert {x[1:] for x in got if x[0] == key} == {tuple(r) for r in alone.collect()}
    tests = causal.ci_tests(df, ["k"], names, [(1, 2, []), (0, 1, [2])], sims=120).collect()
    assert len(tests) == 6 and all(0 < r["p"] <= 1 for r in tests)
    one = [r for r in tests if r["k"] == "u" and r["j"] == 2][0]
    x = np.array(sorted(r[1:] for r in rows if r[0] == "u"))
    null = np.concatenate([causal.null_rho(149, m, [42, b]) for b, m in enumerate((50, 50, 20))])
    assert (one["p"], one["rho"]) == pytest.approx(causal.independence(x, 1, 2, [], null))
    with pytest.raises(ValueError):
        causal.ci_tests(df, ["k"], names, [(0, 1, [])], most_rows=130)


def test_parametric_bootstrap_holds_parameters(spark, monkeypatch):
    """Paths run to the horizon, and a replicate's l0 is that of the fit of the whole."""
    t = simulate(60.0, 5)
    end = float(t[-1])
    fit = hawkes.fit_uni(t, end, restarts=1)
    assert hawkes.loglik_under(fit, t, end) == pytest.approx(fit["loglik"], rel=1e-9)
    near = {"mu": 1.0, "alpha": 0.998, "beta": 50.0}
    paths = [hawkes._simulate(near, 20.0, np.random.default_rng(i)) for i in range(3)]
    assert all(np.array_equal(x, hawkes._simulate(near, 20.0, np.random.default_rng(i), 10**7)) for i, x in enumerate(paths))

    mid = end / 2
    parts = [t[t <= mid], t[t > mid] - mid]
    null = hawkes.fit_uni(parts, mid, restarts=1)
    lr = lambda x, whole: 2 * (sum(hawkes.fit_uni(y, mid, restarts=1, start=null)["loglik"] for y in x) - whole)
    observed, hits = lr(parts, null["loglik"]), 0
    for r in range(12):
        rng = np.random.default_rng([0, r, len(t), int(t.sum() * 1e3) % (1 << 32)])
        star = [hawkes._simulate(null, mid, rng) for _ in parts]
        hits += lr(star, sum(hawkes.loglik_under(null, x, mid) for x in star)) >= observed
    df = spark.createDataFrame([("k", float(x)) for x in t], "k string, t double")
    got = hawkes.hawkes_bootstrap(df, ["k"], replicates=12, method="parametric", block=5).first()
    assert got["replicates"] == 12 and got["p_value"] == pytest.approx((1 + hits) / 13)
