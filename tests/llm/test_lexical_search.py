"""Ranked lexical search against its formula, with odd rows, several blocks, small trees and seeded bounds."""

import collections
import math
import random
import re

import pytest

DOCS = "doc_id long, text string, score long, rank string, item int, n int"
ITEMS = "item_id long, text string, doc_id long, terms string"
WORDS = [f"t{i}" for i in range(60)] + ["été", "東京", "ß"]


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, size = sum(sum(b.values()) for _, b in bags), len(bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        if t is not None:
            asked[i].update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * size // total
            score = sum(c * math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in q.items() if b[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=0, n=300):
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    docs = [(i, " ".join(r.choices(WORDS, weights, k=r.randint(1, 60)))) for i in range(n)]
    items = [(i, ", ".join(r.choices(WORDS, weights, k=r.randint(1, 25)))) for i in range(40)]
    docs += [(500 + i, docs[3][1].upper()) for i in range(15)]  # ties beyond the tenth
    docs += [(None, docs[3][1]), (7, "t1 t2 t3"), (7, "t1 t2 t3"), (8, None), (9, ""), (9, "..., !"), (600, "t5 " * 20_000), (601, "zzz " * 9_000 + "東京")]
    items += [(100, None), (101, ""), (102, "unknown words only"), (103, docs[3][1]), (103, "t50 t51"), (None, "t4 t9 été"), (104, "t2 " * 3_000), (105, "t1-T1_t1")]
    return docs, items


@pytest.mark.parametrize("steps,chars,seeds,k", [(None, None, None, 10), (((2, 1), (1, 0)), 300, 30, 10), (((3, 2), (2, 1), (1, 0)), 2_000, 5, 3)])
def test_like_the_formula(spark, monkeypatch, steps, chars, seeds, k):
    from tidemark.llm import lexical_search as S

    if steps:
        monkeypatch.setattr(S, "STEPS", steps)
        monkeypatch.setattr(S, "TILE", 50)
        monkeypatch.setattr(S, "BLOCK_CHARS", chars)
        monkeypatch.setattr(S, "SEED_DOCS", seeds)
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 5, "r", 3, 2) for x in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*x, 1, "t") for x in items], ITEMS)
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in S.rank_documents(d, i, k).collect()), key=str)
    assert got == brute(docs, items, k)


def test_empty_tables(spark):
    from tidemark.llm.lexical_search import rank_documents

    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(d.limit(0), i).count() == 0 and rank_documents(d, i.limit(0)).count() == 0
    assert rank_documents(d.selectExpr("doc_id", "cast(null as string) as text"), i).count() == 0
    assert [tuple(r) for r in rank_documents(d, i).collect()] == brute([(1, "a b")], [(1, "a")])


def test_bounds_hold_and_prune():
    """A node's product is never below what lies under it, and bad documents go without being scored."""
    import numpy as np

    from tidemark.llm import lexical_search as S

    r = np.random.default_rng(4)
    n, v = S.DOC_FAN ** S.STEPS[0][0], 400
    at = np.arange(n + 1) * 12
    term = np.concatenate([np.sort(r.choice(v, 12, replace=False)) for _ in range(n)])
    docs = S.Rows(at, term, r.integers(1, 1000, len(term)).astype(float))
    q_at = np.arange(31) * 6
    q_term = np.concatenate([np.sort(r.choice(v, 6, replace=False)) for _ in range(30)])
    items = S.Items(q_at, q_term, np.ones(len(q_term), np.int64), r.integers(1, 9000, v), 10)
    found = S.Search(items)
    found.add(docs, np.arange(n), np.zeros(n, bool))
    assert found.scored > 0
    again = S.Search(items, found.score[np.argsort(items.order)].min(1))
    again.add(docs, np.arange(n), np.zeros(n, bool))
    assert (again.score == found.score).all() and (again.doc == found.doc).all()
    assert again.scored < 0.2 * n * 30
    docs.by_term(v)
    whole = docs.columns(np.arange(v))
    top = docs.maxima(4, v)
    top.by_term(v)
    assert (top.columns(np.arange(v)) == whole.reshape(-1, 4, v).max(1)).all()
