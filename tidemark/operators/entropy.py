"""Patterns, entropies, mutual information, and rolling relative entropies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scratch import written
from . import spans
from .selection import group_of

#: The category of each of the eight sign triples when fewer categories are asked for.
MERGES = {8: [0, 1, 2, 3, 4, 5, 6, 7], 6: [0, 2, 1, 3, 4, 1, 5, 0], 4: [0, 1, 3, 2, 2, 3, 1, 0], 3: [0, 1, 2, 1, 1, 2, 1, 0], 2: [0, 1, 0, 1, 0, 1, 0, 1]}


def _w(keys, order):
    return W.partitionBy(*keys).orderBy(order)


def pattern_probs(df: DataFrame, value: str, max_l: int, keys: list[str], order: str) -> DataFrame:
    """length, pattern, count, p (count over n - length), pi (share followed by an up bit; 0.5 unseen).

    Bits tell whether a value rose. Patterns are rows; the partial grouping absorbs the fan-out by length.
    """
    w = _w(keys, order)
    bits = df.withColumn("_y", (F.col(value) > F.lag(value).over(w)).cast("int")).withColumn("_i", F.row_number().over(w)).filter("_i > 1")
    code = sum((F.coalesce(F.lag("_y", k).over(w), F.lit(0)) * (1 << k) for k in range(1, max_l)), F.coalesce(F.col("_y"), F.lit(0)))
    rows = bits.withColumn("_code", code.cast("bigint")).withColumn("_next", F.lead("_y").over(w)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    rows = rows.select(*keys, "_i", "_n", "_code", "_next", F.explode(F.sequence(F.lit(1), F.lit(max_l))).alias("length")).filter("_i - 1 >= length and _next is not null")
    pattern = F.expr("_code % shiftleft(1L, length)")
    out = rows.groupBy(*keys, "length", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n_pattern"), F.sum("_next").alias("ups"), F.first("_n").alias("_n"))
    return out.withColumn("p", F.col("n_pattern") / (F.col("_n") - F.col("length"))).withColumn("pi", F.col("ups") / F.col("n_pattern")).drop("_n", "ups")


def pattern_entropy(probs: DataFrame, keys: list[str], form: str = "as_coded") -> DataFrame:
    """length, entropy of length + 1, information 1 + H_L - H_{L+1} floored at 0.

    as_coded: -sum p (pi log2(p / pi) + (1 - pi) log2(p / (1 - pi))); joint: the entropy of pattern and next bit.
    """
    p, x = F.col("p"), F.col("pi")
    sign = -1 if form == "as_coded" else 1

    def part(q):
        return F.when((q > 0) & (p > 0), q * (F.log2(p) + sign * F.log2(q))).otherwise(0.0)

    h = probs.groupBy(*keys, "length").agg((-F.sum(p * (part(x) + part(1 - x)))).alias("entropy"))
    before = F.coalesce(F.lag("entropy").over(_w(keys, "length")), F.lit(1.0))
    return h.withColumn("information", F.greatest(F.lit(0.0), 1 + before - F.col("entropy")))


def information_half_life(entropy: DataFrame, keys: list[str]) -> DataFrame:
    """The length of largest information, and the first with more than half of it."""
    top = F.max("information").over(W.partitionBy(*keys))
    rows = entropy.withColumn("_top", top)
    return rows.groupBy(*keys).agg(F.max("information").alias("max_information"), F.min(F.when(F.col("information") == F.col("_top"), F.col("length"))).alias("max_length"), F.min(F.when(F.col("information") > F.col("_top") / 2, F.col("length"))).alias("half_length"))


def equal_width_bin(value, low, high, bins: int):
    """Number from 0 of the bin; the last one is closed, a constant is in bin 0."""
    x = F.floor((value - low) / (high - low) * bins)
    return F.when(high > low, F.least(F.lit(bins - 1), x)).otherwise(0).cast("int")


def lagged_mi(df: DataFrame, value: str, lags: list[int], keys: list[str], order: str, bins: int = 10) -> DataFrame:
    """Mutual information and conditional entropy (nats) of a value and its lagged one on equal-width bins."""
    every = W.partitionBy(*keys)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_b", equal_width_bin(F.col(value), F.min(value).over(every), F.max(value).over(every), bins))
    w = _w(keys, order)
    rows = rows.select(*keys, F.col("_b").alias("y"), *[F.lag("_b", k).over(w).alias(f"_x{k}") for k in lags])
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_x{k}").alias("x")) for k in lags]))
    pairs = rows.select(*keys, "y", stacked.alias("s")).select(*keys, "s.lag", "s.x", "y").filter("x is not null")
    cells = pairs.groupBy(*keys, "lag", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(W.partitionBy(*keys, "lag"))
    cells = cells.withColumns({"n": n, "cx": F.sum("c").over(W.partitionBy(*keys, "lag", "x")), "cy": F.sum("c").over(W.partitionBy(*keys, "lag", "y"))})
    joint = F.col("c") / F.col("n")
    return cells.groupBy(*keys, "lag").agg(F.sum(joint * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"), (-F.sum(joint * F.log(F.col("c") / F.col("cx")))).alias("conditional_entropy"))


def _kl(p, q, k: int):
    """Sum p ln(p / q) over k counts as columns; infinite where q lacks what p has."""
    tp, tq = sum(p[1:], p[0]), sum(q[1:], q[0])
    terms = [F.when(a == 0, 0.0).when(b == 0, float("inf")).otherwise(a / tp * F.log((a / tp) / (b / tq))) for a, b in zip(p, q)]
    return sum(terms[1:], terms[0])


def rolling_pattern_kl(df: DataFrame, value: str, n: int, k: int, keys: list[str], order: str, stamp: str = "last", width: float = 10_000) -> DataFrame:
    """Relative entropy of each window's sign-triple distribution to the adjacent window before and to the first window.

    A window of n values holds n - 3 codes. Its counts are differences of running sums, read so many rows before; sums and
    lags go over spans of `width` of the order, so a key is worked out by many tasks.
    """
    # packed values: a missing row and a null value differ
    rows, _ = written(df.select(*keys, order, value), "values")  # each pass over spans reads its rows twice
    rows = spans.lagged(rows, keys, [order], width, F.struct(F.col(value).alias("x")), {"_x1": 1, "_x2": 2, "_x3": 3})
    past = [F.col(value), *[F.col(f"_x{j}.x") for j in (1, 2, 3)]]
    up = [F.coalesce((past[j] > past[j + 1]).cast("int"), F.lit(0)) for j in range(3)]
    code = F.when(F.col("_x3").isNotNull(), F.element_at(F.array(*map(F.lit, MERGES[k])), (up[2] * 4 + up[1] * 2 + up[0] + 1).cast("int")))
    rows = spans.running(rows.select(*keys, order, code.alias("_c")), keys, [order], width, {"_i": F.lit(1), **{f"_p{j}": (F.col("_c") == j).cast("int") for j in range(k)}})
    rows, _ = written(rows, "codes")
    sums = F.struct(F.array(*[F.col(f"_p{j}") for j in range(k)]).alias("p"), F.col(order).alias("o"))
    rows = spans.lagged(rows, keys, [order], width, sums, {"_a": n - 3, "_b": n, "_d": 2 * n - 3, "_e": n - 1})
    at = lambda c, j: F.coalesce(F.col(f"{c}.p")[j], F.lit(0))
    now, before = [F.col(f"_p{j}") - at("_a", j) for j in range(k)], [at("_b", j) - at("_d", j) for j in range(k)]
    rows = rows.filter(F.col("_i") >= n).select(*keys, "_i", F.col(order if stamp == "last" else "_e.o").alias("stamp"), *[x.alias(f"_n{j}") for j, x in enumerate(now)], *[x.alias(f"_b{j}") for j, x in enumerate(before)])
    first = rows.filter(F.col("_i") == n).select(group_of(keys).alias("_g"), *[F.col(f"_n{j}").alias(f"_f{j}") for j in range(k)])
    out = rows.withColumn("_g", group_of(keys)).join(first, "_g")
    now, before, start = ([F.col(f"_{x}{j}") for j in range(k)] for x in "nbf")
    return out.select(*keys, "stamp", F.col("_i").cast("int").alias("row"), F.when(F.col("_i") >= 2 * n, _kl(now, before, k)).alias("kl_adjacent"), _kl(now, start, k).alias("kl_first"))


def rolling_binned_kl(df: DataFrame, value: str, k: int, window: int, step: int, keys: list[str], order: str) -> DataFrame:
    """Relative entropy of each window to the first, on quantile bins of the first window (edges without repeats, open ends).

    Window counts are differences of prefix counts, so no row enters more than one count.
    """
    w = _w(keys, order)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w))
    edges = rows.filter(F.col("_i") <= window).groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(j / k) for j in range(1, k)])).alias("_e")).withColumn("_e", F.array_distinct("_e"))
    rows = rows.join(edges, keys).withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col(value))))
    rows = rows.select(*keys, order, "_i", *[F.sum((F.col("_b") == j).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"_p{j}") for j in range(k)])
    rows = rows.select("*", *[F.coalesce(F.lag(f"_p{j}", window).over(w), F.lit(0)).alias(f"_o{j}") for j in range(k)], *[F.max(F.when(F.col("_i") == window, F.col(f"_p{j}"))).over(W.partitionBy(*keys)).alias(f"_f{j}") for j in range(k)])
    out = rows.filter((F.col("_i") >= window) & ((F.col("_i") - window) % step == 0))
    return out.select(*keys, F.col(order).alias("stamp"), F.col("_i").alias("row"), _kl([F.col(f"_p{j}") - F.col(f"_o{j}") for j in range(k)], [F.col(f"_f{j}") for j in range(k)], k).alias("kl_first"))


def kl_thresholds(k: int, n: int, alpha: float) -> dict[str, float | None]:
    """Thresholds of the relative entropy of n draws over k categories: chi-square for one and two samples, the
    2(k-1)/n line, and finite-sample bounds by root finding (null without a sign change)."""
    from .stats import bisect, chi2_quantile

    c = chi2_quantile(1 - alpha, k - 1)
    bound = lambda m: lambda x: math.log(alpha) + n * x - m * math.log(math.e * n * x / m)
    one, two = k - 1, 2 * (k - 1)
    return {"one_sample": c / (2 * n), "two_sample": c / n, "line": 2 * (k - 1) / n, "finite": bisect(bound(one), one / n, 50.0), "finite_two": bisect(bound(two), two / n, 50.0)}


def flag_changes(kl: DataFrame, column: str, threshold: float) -> DataFrame:
    return kl.withColumn("change", F.coalesce(F.col(column) > threshold, F.lit(False)))
