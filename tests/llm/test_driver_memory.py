"""What goes through the driver: no small tables of the join of near copies, no texts of the quality sample."""

import random


def test_joins_of_narrow_tables_are_not_broadcast(spark, monkeypatch):
    from tidemark.llm import common as C
    from tidemark.llm.jaccard_join import deduplicate

    plans, write = {}, C.materialize

    def noted(df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(C, "materialize", noted)
    rng = random.Random(4)
    texts = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(60)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(100 + i, " ".join([*w, "end"])) for i, w in enumerate(texts[:8])] + [(200, None)]
    kept = deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(20), 200]
    joins = [p for tag in ("shared", "held", "groups", "wanted", "cc", "kept", "seen") for p in plans[tag] if "Join" in p]
    assert len(joins) >= 6 and not any("BroadcastHashJoin" in p for p in joins)


def test_quality_sample_comes_as_features(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    from tidemark.llm import text_features as T
    from tidemark.llm.quality import fit_documents

    texts = [f"a plain sentence, number {i}, of some words." if i % 2 else f"BUY {i} $$$ !!! http://x" for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (40, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen, own = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: seen.append(self.columns) or own(self))
    got = fit_documents(docs, labels)
    assert seen == [["doc_id", "x", "y"]]
    expected = T.Logistic().fit(T.features(pa.array(texts, pa.string())), np.arange(40) % 2)
    assert np.allclose(got.w, expected.w) and np.allclose(got.mean, expected.mean) and got.prior == expected.prior
    assert fit_documents(docs, labels.limit(0)).prior == T.Logistic().fit(np.zeros((0, len(T.NAMES))), np.zeros(0, np.int64)).prior
