"""Quality by hierarchical empirical Bayes.

A document classifier (ridge logistic regression over dense features, fitted on a bounded labelled sample) gives
each document's evidence: its log odds less the prior's. Hosts, and paths inside hosts, get Beta posteriors of their
share of good documents by grouped sums of the classifier's probabilities over all documents; how strongly sparse
hosts and paths shrink, to the global share and to their host's, is estimated from the spread between groups. A
document's own probability is left out of its path's posterior, so its evidence counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C
from . import text_features as T

SAMPLE_ROWS, SAMPLE_CHARS = 5_000, 50_000
#: Without more than this many paths their table is broadcast; beyond it, it is joined by salted keys.
FEW_PATHS, SALTS = 100_000, 32


def fit_documents(docs: DataFrame, labels: DataFrame, keep=None, sample_rows: int = SAMPLE_ROWS) -> T.Logistic:
    """Texts become features in tasks; only these numbers come to the driver."""

    def run(batches):
        for batch in batches:
            x = T.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], names=["doc_id", "x", "y"])

    texts = T.labelled_texts(docs.filter(F.length("text") <= SAMPLE_CHARS), labels, "quality", sample_rows, keep)
    rows = texts.mapInArrow(C.tidied(run), "doc_id long, x binary, y int").toPandas().sort_values("doc_id")
    none = T.features(pa.array([], pa.string()))
    x = np.frombuffer(b"".join(rows["x"]), none.dtype).reshape(-1, none.shape[1])
    y = rows["y"].to_numpy(np.int64)
    del rows
    C.tidy()
    return T.Logistic().fit(x, y)


def with_evidence(docs: DataFrame, model: T.Logistic, text: str = "text") -> DataFrame:
    """`docs` with _odds, the classifier's log odds that a document is good. Texts without words have the prior's."""
    shared, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("_odds", DoubleType())])

    def run(batches):
        for batch in batches:
            x = T.features(batch.column(where))
            odds = np.clip(np.where(x[:, 0] > 0, shared.value.margin(x), shared.value.prior), -20, 20)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds)], names=[*batch.schema.names, "_odds"])

    return docs.mapInArrow(C.tidied(run), schema)


def _strength(table: DataFrame, m) -> float:
    """How many documents a group's prior weighs: by moments of the groups' shares around `mean`."""
    r = table.agg(F.sum("n").alias("n"), F.sum(F.expr("k * k / n") - 2 * F.col("k") * m + F.col("n") * m * m).alias("between"), F.sum(F.col("n") * m * (1 - m)).alias("v"), F.count(F.lit(1)).alias("g"), F.sum(F.expr("n * n")).alias("nn")).first()
    if not r["n"] or r["g"] < 2 or not r["v"]:
        return 100.0
    within = r["v"] / r["n"]
    spread = (r["between"] - r["g"] * within) / max(r["n"] - r["nn"] / r["n"], 1.0)
    return float(min(max(within / spread - 1, 5.0), 1e4)) if spread > 0 else 1e4


def posteriors(scored: DataFrame, host: list[str], path: list[str]) -> DataFrame:
    """host and path columns, n, k (documents and expected good ones of the path), host_share, strength.

    `scored` has the key columns and _odds. Sums are pre-aggregated before they are shuffled, so no group is gathered.
    """
    per_path = C.materialize(scored.groupBy(*host, *path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("1 / (1 + exp(-_odds))")).alias("k")), "paths")
    per_host = per_path.groupBy(*host).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = per_host.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    share = (total["k"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    m = _strength(per_host, F.lit(share))
    hosts = per_host.select(*[F.col(h).alias(f"_{h}") for h in host], ((F.col("k") + m * share) / (F.col("n") + m)).alias("host_share"))
    same = [F.col(h).eqNullSafe(F.col(f"_{h}")) for h in host]
    few = hosts.limit(FEW_PATHS + 1).count() <= FEW_PATHS
    paths = per_path.join(F.broadcast(hosts) if few else hosts, same).drop(*[f"_{h}" for h in host])
    paths = C.materialize(paths, "path_shares")
    return paths.withColumn("strength", F.lit(_strength(paths, F.col("host_share"))))


def judge(scored: DataFrame, table: DataFrame, host: list[str], path: list[str], prior: float) -> DataFrame:
    """`scored`, a written table, with quality: the probability that a document is good, given its text, path and host."""
    keys = [*host, *path]
    t = table.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("host_share").alias("_host"), F.col("strength").alias("_strength"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    if t.limit(FEW_PATHS + 1).count() <= FEW_PATHS:
        joined = scored.join(F.broadcast(t), same)
    else:
        t = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("_mine", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(t, [*same, F.col("_mine") == F.col("_salt")]).drop("_mine", "_salt")
    own = "1 / (1 + exp(-_odds))"
    q = F.expr(f"(greatest(_k - {own}, 0) + _strength * _host) / (_n - 1 + _strength)")
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), q))
    odds = F.col("_odds") - F.lit(prior) + F.log(q / (1 - q))
    return joined.withColumn("quality", 1 / (1 + F.exp(-odds))).drop(*[f"_{c}" for c in keys], "_n", "_k", "_host", "_strength")


def classify_quality(docs: DataFrame, labels: DataFrame, host: list[str] | None = None, path: list[str] | None = None, keep=None) -> DataFrame:
    """doc_id, score (probability of good), keep (1 if score >= 0.5): one row per input row.

    host and path default to source and lang. Null keys are a group of their own; texts without words are judged by
    their group alone; repeated rows get equal results. Without labels every score is near 0.5.
    """
    host, path = host or ["source"], path or ["lang"]
    model = fit_documents(docs, labels, keep)
    narrow = with_evidence(docs.select("doc_id", "text", *host, *path), model).drop("text")
    scored = C.materialize(narrow, "evidence")
    out = judge(scored, posteriors(scored, host, path), host, path, model.prior)
    return out.selectExpr("cast(doc_id as bigint) as doc_id", "quality as score", "cast(quality >= 0.5 as int) as keep")


def keep_good(docs: DataFrame, labels: DataFrame, host: list[str] | None = None, path: list[str] | None = None) -> DataFrame:
    """The rows of `docs` judged good, with all columns, whatever they are called. Nulls and repeats as in classify_quality.

    Texts are judged once: they are written with their evidence, which is shuffled and read without them.
    """
    model = fit_documents(docs, labels)
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*name.values())
    host, path, text = [name[c] for c in host or ["source"]], [name[c] for c in path or ["lang"]], name["text"]
    scored = C.materialize(with_evidence(rows, model, text), "evidence")
    table = posteriors(scored.select(*host, *path, "_odds"), host, path)
    good = judge(scored, table, host, path, model.prior).filter("quality >= 0.5")
    return good.select(*name.values()).toDF(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
