"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected to M dimensions by a Gaussian (2-stable) matrix, so a squared projected distance over the
squared true one follows a chi-square law with M degrees. The projected space is cut into cells by a kd-tree fitted
on a bounded sample; every vector goes to its cell. A query first searches its own cell, then all cells that the
stopping test leaves. Inside a cell a smaller kd-tree is walked by rising projected distance, each neighbour is
verified on the original vectors, and the walk stops once the chance that a nearer vector projects that far falls
below 1 - CERTAINTY. Equal vectors are one point with its smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

M, CERTAINTY, SEED = 8, 0.99, 17
#: Vectors a cell aims at, queries that meet a cell at once, rows of the sample that the cells are fitted on, cells at most.
CELL, QUERIES, SAMPLE, MOST_CELLS, LEAF = 4096, 2048, 20_000, 65_536, 64


def chi_square_bound(p: float, m: int = M) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m."""
    low, high = 0.0, 200.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


class Cells:
    """A kd-tree over the projected space: arrays of split dimensions and values, leaves numbered from the left."""

    def __init__(self, sample: np.ndarray, n: int):
        self.depth = max(0, min(math.ceil(math.log2(max(n / CELL, 1))), int(math.log2(MOST_CELLS))))
        self.dim, self.at = np.zeros(1 << self.depth, np.int64), np.full(1 << self.depth, np.inf)
        parts = {1: sample}
        for node in range(1, 1 << self.depth):
            x = parts.pop(node)
            if len(x):
                d = int(x.var(0).argmax())
                self.dim[node], self.at[node] = d, np.median(x[:, d])
            right = x[:, self.dim[node]] > self.at[node]
            parts[2 * node], parts[2 * node + 1] = x[~right], x[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.dim[node]] > self.at[node])
        return node - (1 << self.depth)


def _boxes(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree over the rows of x, as index arrays."""
    todo, out = [np.arange(len(x))], []
    while todo:
        i = todo.pop()
        if len(i) <= leaf:
            out.append(i)
            continue
        d = int(np.ptp(x[i], axis=0).argmax())
        order = i[np.argsort(x[i, d], kind="stable")]
        todo += [order[: len(i) // 2], order[len(i) // 2 :]]
    return out


def _search(points: pd.DataFrame, queries: pd.DataFrame, k: int, bound: float) -> pd.DataFrame:
    """The k best of a cell's part for each query, given the k-th best score found before."""
    x, z = np.stack(points["vec"]), np.stack(points["proj"])
    norm = np.sqrt((x * x).sum(1))
    ids = points["ids"].tolist()
    leaves = _boxes(z, LEAF)
    low, high = np.stack([z[i].min(0) for i in leaves]), np.stack([z[i].max(0) for i in leaves])
    out = []
    for q in queries.itertuples(index=False):
        v, p = np.asarray(q.vec), np.asarray(q.proj)
        vn = math.sqrt((v * v).sum())
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        far = (gap * gap).sum(1)
        best: list[tuple[float, int]] = []
        floor = q.kth
        for j in np.argsort(far, kind="stable"):
            if far[j] > bound * max(2 - 2 * floor, 0) + 1e-9:
                break
            i = leaves[j]
            score = (x[i] * v).sum(1) / (norm[i] * vn)
            for t in np.flatnonzero(score >= floor - 1e-12):
                best += [(-float(score[t]), int(c)) for c in ids[i[t]] if c != q.query_id]
            best = sorted(best)[:k]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        out += [(q.query_id, c, -s) for s, c in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _meet(points: DataFrame, queries: DataFrame, k: int, bound: float) -> DataFrame:
    """Search (cell, query) pairs in groups of bounded size: a cell's points and its queries are dealt into parts, and each pair of parts meets."""
    p_sizes = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * CELL)).cast("int").alias("pn"))
    q_sizes = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qn"))
    sizes = F.broadcast(p_sizes.join(q_sizes, "cell"))  # a row per cell, of which there are MOST_CELLS at most
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = points.join(sizes, "cell").withColumn("pp", part("h", "pn")).withColumn("qp", spread("qn")).select("cell", "pp", "qp", "ids", "vec", "proj")
    q = queries.join(sizes, "cell").withColumn("qp", part("query_id", "qn")).withColumn("pp", spread("pn")).select("cell", "pp", "qp", "query_id", "vec", "proj", "kth")

    def run(a, b):
        return _search(a, b, k, bound) if len(a) and len(b) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["cell", "pp", "qp"]
    return p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", certainty: float = CERTAINTY, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest cosines found for each row where `is_query` holds, over all other rows.

    Ties go to the smaller id. Rows whose id or vector is null, whose vector is zero, holds null or non-finite
    values, or has another length than most, take no part, as query or candidate. With fewer candidates all are
    returned; with one usable row, none. Rows that repeat an id are one if their vectors are equal. Other columns are not read.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null and size(vec) > 0")
    raw = raw.filter("not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vec, x -> x <> 0)")
    dims = raw.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 1
    matrix = raw.sparkSession.sparkContext.broadcast(np.random.default_rng(seed).normal(size=(dim, M)))

    def project(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
            unit = x / np.abs(x).max(1, keepdims=True)
            unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
            z = unit @ matrix.value
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), M).cast(pa.list_(pa.float64()))], names=["vec_id", "vec", "proj"])

    rows = C.materialize(raw.filter(F.size("vec") == dim).mapInArrow(C.tidied(project), "vec_id long, vec array<double>, proj array<double>").withColumn("h", F.xxhash64("vec")), "projected")
    # equal vectors: the k + 1 smallest ids suffice, first within salts, then over all
    narrow = rows.select("h", "vec_id").distinct()
    narrow = narrow.withColumn("r", F.row_number().over(W.partitionBy("h", F.pmod("vec_id", F.lit(64))).orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    narrow = narrow.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    ids = narrow.groupBy("h").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = ids.select("h", "ids", F.element_at("ids", 1).alias("vec_id"))
    points = rows.join(first, ["h", "vec_id"]).dropDuplicates(["h"]).select("h", "ids", "vec", "proj")
    sample = C.bounded_sample(points.select("h", "proj"), "h", SAMPLE)
    n = points.count()
    cells = Cells(np.array([r["proj"] for r in sample.select("proj").collect()]).reshape(-1, M), n)
    tree = rows.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell(proj: pd.Series) -> pd.Series:
        return pd.Series(tree.value.of(np.stack(proj)) if len(proj) else [], dtype="int32")

    points = C.materialize(points.withColumn("cell", cell("proj")), "points")
    queries = C.materialize(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec", "proj").dropDuplicates(["query_id", "vec"]).withColumn("cell", cell("proj")), "queries")
    bound = chi_square_bound(certainty)
    home = C.materialize(_meet(points, queries.withColumn("kth", F.lit(-1.0)), k, bound), "home")
    kth = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.when(F.col("n") >= k, F.element_at("s", k)).otherwise(-1.0).alias("kth"))
    # the boxes of the cells in the projected space: at most MOST_CELLS rows
    boxes = points.groupBy("cell").agg(F.array(*[F.min(F.element_at("proj", i + 1)) for i in range(M)]).alias("low"), F.array(*[F.max(F.element_at("proj", i + 1)) for i in range(M)]).alias("high"))
    box = {r["cell"]: (r["low"], r["high"]) for r in boxes.collect()}
    number = np.array(sorted(box), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((number, np.array([box[c][0] for c in number]).reshape(-1, M), np.array([box[c][1] for c in number]).reshape(-1, M)))

    @F.pandas_udf("array<int>")
    def other_cells(proj: pd.Series, kth: pd.Series, own: pd.Series) -> pd.Series:
        number, low, high = shared.value
        out = []
        for p, s, c in zip(proj, kth, own):
            gap = np.maximum(np.maximum(low - p, p - high), 0)
            near = (gap * gap).sum(1) <= bound * max(2 - 2 * s, 0) + 1e-9
            out.append(number[near & (number != c)].astype(np.int32))
        return pd.Series(out)

    more = queries.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0)))
    more = more.withColumn("cell", F.explode(other_cells("proj", "kth", "cell")))
    found = home.unionByName(_meet(points, more, k, bound)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
