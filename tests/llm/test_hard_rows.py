"""Repeated and null keys in samples, texts of repeats and of long runs of marks."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("by", [None, "lang"])
def test_samples_of_repeated_keys(spark, by):
    from tidemark.llm import common as C

    schema = "doc_id long, lang string, text string"
    one = spark.createDataFrame([(7, "en", f"text {i}") for i in range(4000)], schema)
    two = spark.createDataFrame([(i % 2, "de" if i % 2 else "en", f"text {i}") for i in range(4000)], schema)
    null = spark.createDataFrame([(None, "de" if i % 4 else None, f"text {i}") for i in range(4000)], schema)
    for rows in (one, two, null):
        got = C.bounded_sample(rows, "doc_id", 300, by=by).collect()
        assert len(got) == 300 == len(set(got)) and got[0].__fields__ == ["doc_id", "lang", "text"]
    if by:
        assert sorted(r["count"] for r in C.bounded_sample(null, "doc_id", 300, by=by).groupBy("lang").count().collect()) == [150, 150]
    # rows that are equal throughout stand for one where rows are thinned
    same = one.selectExpr("doc_id", "lang", "'t' as text").unionByName(two.limit(50))
    assert 1 <= C.bounded_sample(same, "doc_id", 300, by=by).count() <= 51
    assert C.bounded_sample(one, "doc_id", 300).orderBy("text").collect() == C.bounded_sample(one.repartition(7), "doc_id", 300).orderBy("text").collect()


def test_training_rows_of_repeated_ids(spark):
    from tidemark.llm.text_features import training_rows

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, None), (3, "three")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = training_rows(docs, labels, "toxic", 5)
    assert list(got.columns) == ["doc_id", "text", "y"] and sorted(got["doc_id"]) == [1, 2, 3]
    again = training_rows(docs.repartition(5), labels, "toxic", 5)
    assert got.sort_values("doc_id")["text"].tolist() == again.sort_values("doc_id")["text"].tolist()
    assert len(training_rows(docs, labels, "toxic", 2)) == 2


def test_no_learned_language(spark):
    from tidemark.llm import language_id as L

    model = L.WordCRF().fit([], [])
    assert model.predict(pa.array(["some text", None, "1"]))[0] == ["und"] * 3
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None), (3, "", None)], "doc_id long, text string, lang string")
    got = L.identify_language(docs, L.fit_language(docs)).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    null_ids = spark.createDataFrame([(None, f"der hund {i} ist" if i % 2 else f"the dog {i} is", "de" if i % 2 else "en") for i in range(4000)], docs.schema)
    assert L.fit_language(null_ids, sample_rows=400).labels == ["de", "en"]


def contaminated(item, doc):
    from tidemark.llm import common as C
    from tidemark.llm import decontaminate as D

    data, at = C.utf8(pa.array([doc]))
    return D.Benchmark([1], [item], D.WINDOW, D.COVER).find(data, at)[0]


def test_repeated_text_takes_linear_time():
    phrase = "alpha beta gamma delta eps zeta eta theta "
    for item, doc in (("word " * 100, "word "), (phrase * 60, phrase), (" ".join(f"take item {i} now" for i in range(60)), "take item 7 now and ")):
        took = []
        for k in (4_000, 8_000):
            start = time.process_time()
            contaminated(item, doc * (k // len(doc.split())))
            took.append(time.process_time() - start)
        assert took[1] < 3 and took[1] < 3 * took[0] + 0.3, (doc, took)
    assert contaminated("word " * 100, "word " * 50_000) == [(1, 1.0)]


def test_middles_of_repeats_change_nothing(monkeypatch):
    """With and without the middles of long repeats the same items and shares are found."""
    import numpy as np

    from tidemark.llm import decontaminate as D

    r = random.Random(6)
    cases = []
    for _ in range(60):
        phrase = [r.choice(["red", "blue", "7", "Anna", "km", "of"]) for _ in range(r.choice([1, 2, 3, 5]))]
        before, after = ([f"{c}{i}" for i in range(r.choice([0, 5, 12]))] for c in "xy")
        item = before + phrase * (r.randint(10, 20) // len(phrase)) + after
        doc = (before if r.random() < 0.7 else []) + phrase * r.choice([8, 60, 400]) + (after if r.random() < 0.7 else [])
        cases.append((" ".join(item), " ".join(doc)))
    cut = []
    middles = D._run_middles
    monkeypatch.setattr(D, "_run_middles", lambda *a: (cut.append(int((x := middles(*a)).sum())), x)[1])
    short = [contaminated(*c) for c in cases]
    monkeypatch.setattr(D, "_run_middles", lambda key, place, reach: np.zeros(len(key), bool))
    assert short == [contaminated(*c) for c in cases] and sum(cut) > 500 and sum(map(bool, short)) > 20


@pytest.mark.parametrize("mark", [":", "-", "=", " ", ".", ",", "(", '"', "'", ";", "*", "©", "\n"])
def test_license_rules_read_runs_of_marks_once(mark):
    from tidemark.llm.license_scan import Scanner

    scanner = Scanner()
    starts = ["mit license ", "copyright ", "licence terms", "spdx-license-identifier:", "under the terms of the gnu general public license", "gnu lesser general public license, version", "apache license, version", "see the file ", "released under the ", "deal in the software without restriction ", "neither the name of ", "may not be reproduced ", "to the extent possible under law,", "cc by", "mozilla public license,", "if you use the software,"]
    took = []
    for k in (4_000, 16_000):
        texts = [s + mark * k + end for s in starts for end in ("", "x")]
        start = time.process_time()
        for t in texts:
            scanner.detect(t, scanner.have(t.encode()))
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5, took


def test_license_gaps_match_as_before():
    import re

    from tidemark.llm.license_scan import gap

    r = random.Random(3)
    new, old = re.compile(gap(r"licen[sc]e ?[:=] ?(?:the )?mit")), re.compile(r"licen[sc]e\W*[:=]\W*(?:the\W+)?mit")
    new2, old2 = re.compile(gap(r"copyright ?(?:\(c\)|©)? ?(?:19|20)[0-9]{2}")), re.compile(r"copyright\W*(?:\(c\)|©)?\W*(?:19|20)[0-9]{2}")
    for _ in range(3000):
        mid = "".join(r.choice(":= -(c)©.") for _ in range(r.randint(0, 6)))
        for a, b, t in ((new, old, f"license{mid}{r.choice(['the ', ''])}mit"), (new2, old2, f"copyright{mid}2020")):
            x, y = a.search(t), b.search(t)
            assert (x and x.span()) == (y and y.span()), t
