"""The operators for training data against brute force, round trips and held-out accuracy, with odd rows everywhere."""

import html.parser
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n long, part string, _odds double, size int"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) rows with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, 0, "x", 1, "y", 0.5, 7) for r in rows], DOCS)


WORDS = [f"w{i}" for i in range(400)]


def odd_rows(seed=0, n=40):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randint(12, 80))) for _ in range(n)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(10):  # near copies, exact copies with other case and gaps
        w = base[i].split()
        w[r.randrange(len(w))] = "changed"
        rows += [(100 + i, " ".join(w), "en", "s0"), (200 + i, base[i].upper() + "\n", None, None)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \t\n", "en", ""), (303, "one", "en", "s1"), (304, "ONE", "en", "s1"), (305, "two words", "de", "s2"), (306, "long " * 30_000 + "end", "en", "s2"), (307, "été ß — 東京 \x00 nul", "fr", "s2"), (307, "été ß — 東京 \x00 nul", "fr", "s2")]
    return rows


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), 10**9), 10**9 if rows[i][0] is None else rows[i][0])
    none = lambda x: None if x == 10**9 else x
    return sorted(((rows[i][0], len(sets[i][1]), none(low[find(i)]), links[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("k,percent,most", [(3, 90, None), (5, 80, 60)])
def test_jaccard_join(spark, monkeypatch, k, percent, most):
    from tidemark.llm import jaccard_join as J

    if most:  # groups split into many chunks, and some shingles that are hot
        monkeypatch.setattr(J, "GROUP_SHINGLES", most)
        monkeypatch.setattr(J, "HOT", 3)
    rows = odd_rows() + [(None, odd_rows()[3][1] + " x", "en", "s0"), (None, " ".join(WORDS[:30]), "en", "s0")]
    got = J.ngram_jaccard_join(docs_of(spark, rows), k, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == brute_components(rows, k, percent)


@pytest.mark.parametrize("k,percent,most", [(3, 90, 400), (5, 80, 1_000_000)])
def test_jaccard_join_of_families(spark, monkeypatch, k, percent, most):
    """Large families whose members differ in other places, so that few shingles stand in all of them, over shared passages."""
    from tidemark.llm import jaccard_join as J

    monkeypatch.setattr(J, "GROUP_SHINGLES", most)
    r, rows = random.Random(4), []
    passage = [f"p{i}" for i in range(30)]
    for family in range(4):
        base = [f"f{family}_{i}" for i in range(90)] + passage
        for i in range(60):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"x{r.randrange(500)}"
            rows.append((family * 1000 + i, " ".join(w), "en", "s"))
    got = J.ngram_jaccard_join(docs_of(spark, rows), k, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == brute_components(rows, k, percent)


def test_trie_equals_brute_force():
    from tidemark.llm.jaccard_join import Trie

    rng = np.random.default_rng(0)
    base = rng.choice(60, 25, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(10, 25), replace=False), rng.integers(0, 60, 2)])) for _ in range(80)] + [np.array([5])]
    trie = Trie(sets, 60)
    for p in sets:
        want = [100 * len(np.intersect1d(p, s)) >= 80 * len(np.union1d(p, s)) for s in sets]
        assert trie.similar(p, 80).tolist() == want


def test_deduplicate_and_empty(spark):
    from tidemark.llm.jaccard_join import deduplicate, ngram_jaccard_join

    rows = odd_rows()
    kept = deduplicate(docs_of(spark, rows))
    ids = sorted(r["doc_id"] for r in kept.collect())
    want = sorted({r[0] for r in brute_components(rows, 5, 80) if r[0] == r[2]})
    assert ids == want and kept.columns == docs_of(spark, rows[:1]).columns
    # another text under a doc_id stays, a repeated row and a row without doc_id count as copies
    a, b, c = (" ".join(WORDS[i : i + 40]) for i in (0, 100, 200))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (8, None), (8, b + " z"), (None, None), (9, "")]
    kept = deduplicate(docs_of(spark, [(*r, "en", "s") for r in rows])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, a), (5, b), (7, c), (8, None), (None, None), (9, "")], key=str)
    empty = spark.createDataFrame([], DOCS)
    assert ngram_jaccard_join(empty).count() == 0


def test_toxicity(spark):
    from tidemark.llm import toxicity as X

    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 1
        w = r.choices(WORDS, k=60)
        if bad:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["idiot", "moron", "scum", "zworx"])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    docs, lab = docs_of(spark, rows + odd_rows()[-9:]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.fit_toxicity(docs, lab, keep=F.col("doc_id") < 300)
    out = X.score_toxicity(docs, model).collect()
    assert len(out) == 409 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
    held = [x for x in out if 300 <= x["doc_id"] < 400 and x["doc_id"] not in range(300, 308)]
    assert np.mean([x["predicted"] == (x["doc_id"] % 5 == 1) for x in held]) > 0.95
    untaught = X.score_toxicity(docs, X.fit_toxicity(docs, lab, keep=F.lit(False))).select("score").distinct().collect()
    assert all(abs(x["score"] - 0.5) < 1e-3 for x in untaught)


def test_isotonic_is_the_least_squares_fit():
    """By the closed form: the largest, over all starts, of the least mean up to any end. Values then shrink by one pseudo-count a step."""
    from tidemark.llm import text_features as T

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=60), 1)
    y = (rng.random(60) < 1 / (1 + np.exp(-x))).astype(int)
    knots, values = T.isotonic(x, y)
    u = np.unique(x)
    s = np.array([y[x == v].sum() for v in u], float)
    n = np.array([(x == v).sum() for v in u], float)
    mean = lambda i, j: s[i : j + 1].sum() / n[i : j + 1].sum()
    want = np.array([max(min(mean(a, b) for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))])
    rate = (y.sum() + 1) / (len(y) + 2)
    step = np.searchsorted(knots, u)
    for k in range(len(knots)):
        inside = step == k
        assert np.allclose(want[inside], want[inside][0])
        assert values[k] == pytest.approx((want[inside][0] * n[inside].sum() + rate) / (n[inside].sum() + 1))


def test_toxicity_scores_one_by_one():
    """Scores of a whole column equal a walk through every tree for each text alone."""
    import pandas as pd

    from tidemark.llm import text_features as T
    from tidemark.llm import toxicity as X

    r = random.Random(5)
    texts = pd.Series([" ".join(r.choices(WORDS[:50] + (["idiot", "you", "scum!!"] if i % 3 == 0 else []), k=30)) for i in range(120)])
    model = X.ToxicityModel().fit(texts, np.array([i % 3 == 0 for i in range(120)], int))
    some = texts.tolist()[:25] + ["", None, "YOU IDIOT", "é" * 500]
    got = model.score(pa.array(some, pa.string()))
    for text, score in zip(some, got):
        x = T.features(pa.array([text], pa.string()), model.lexicon, model.stems)[0]
        margin = model.trees.base
        for splits, value in model.trees.trees:
            leaf = 0
            for col, cut in splits:
                code = sum(q < x[col[leaf]] for q in model.trees.cuts[col[leaf]])
                leaf = 2 * leaf + int(code > cut[leaf])
            margin += value[leaf]
        step = np.interp(margin, model.knots, model.values)
        assert score == pytest.approx(min(1, step + 1e-6 / (1 + math.exp(-margin))), abs=1e-9)


def test_quality_by_hand(spark):
    """Posteriors and decisions from given odds, by loops over the definition."""
    from tidemark.llm import common as C
    from tidemark.llm import quality as Q

    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.gauss(0.3, 2)) for i in range(120)]
    scored = C.materialize(spark.createDataFrame(rows, "doc_id long, source string, lang string, _odds double"), "t")
    table = Q.posteriors(scored, ["source"], ["lang"])
    p = {i: 1 / (1 + math.exp(-o)) for i, _, _, o in rows}
    share = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups):
        n, v = sum(g[0] for g in groups), sum(g[0] * g[2] * (1 - g[2]) for g in groups)
        within, between = v / n, sum(g[1] ** 2 / g[0] - 2 * g[1] * g[2] + g[0] * g[2] ** 2 for g in groups)
        spread = (between - len(groups) * within) / max(n - sum(g[0] ** 2 for g in groups) / n, 1)
        return min(max(within / spread - 1, 5), 1e4) if spread > 0 else 1e4

    of = lambda pick: [(len(q := [p[x[0]] for x in rows if pick(x)]), sum(q))][0]
    hosts = {h: of(lambda x: x[1] == h) for h in ("a", "b", None)}  # noqa: B023
    m = strength([(*g, share) for g in hosts.values()])
    host = {h: (k + m * share) / (n + m) for h, (n, k) in hosts.items()}
    paths = {(h, q): of(lambda x: x[1:3] == (h, q)) for h in hosts for q in ("x", "y", None)}  # noqa: B023
    w = strength([(*g, host[h]) for (h, _), g in paths.items()])
    for r_ in Q.judge(scored, table, ["source"], ["lang"], 0.3).collect():
        n, k = paths[(r_["source"], r_["lang"])]
        q = (k - p[r_["doc_id"]] + w * host[r_["source"]]) / (n - 1 + w)
        assert r_["quality"] == pytest.approx(1 / (1 + math.exp(-(r_["_odds"] - 0.3 + math.log(q / (1 - q))))), rel=1e-6)


def test_contamination_covers_what_was_copied(spark):
    """Slices of items between other words: contaminated where the slice, of a window at least, is a share of COVER, with that coverage."""
    from tidemark.llm import decontaminate as D

    r = random.Random(8)
    items = [(i, " ".join(f"q{i}w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(r.randint(3, 60)))) for i in range(25)]
    docs, want = [], {}
    for d in range(150):
        item, text = r.choice(items)
        w = text.split()
        n = r.randint(1, len(w))
        lo = r.randint(0, len(w) - n)
        docs.append((d, " ".join(r.choices(["other", "plain", "words"], k=r.randint(0, 30)) + w[lo : lo + n] + ["end"]), "en", "s"))
        hit = n / len(w) >= D.COVER and (n >= D.WINDOW or n == len(w) >= 3)
        want[d] = (int(hit), item if hit else None, pytest.approx(n / len(w)) if hit else 0.0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for row in D.find_contamination(docs_of(spark, docs), bench).collect():
        assert (row["contaminated"], row["item_id"], row["coverage"]) == want[row["doc_id"]], (row, docs[row["doc_id"]])


def test_empty_tables_and_clashing_names(spark, tmp_path):
    """Every operator on no rows, and on rows with columns named as its own."""
    import public_tokenizers

    import corpus_pipeline
    from tidemark.llm import decontaminate as D
    from tidemark.llm import language_id as L
    from tidemark.llm import license_scan as S
    from tidemark.llm import mixing as M
    from tidemark.llm import nearest as N
    from tidemark.llm import quality as Q
    from tidemark.llm import token_planes as P
    from tidemark.llm import toxicity as X
    from tidemark.llm import warc as R

    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    odd = docs_of(spark, odd_rows(n=12)).withColumn("_key", F.lit(1)).withColumn("tie", F.lit(2)).withColumn("row", F.lit(3))
    for docs in (none, odd):
        n = docs.count()
        assert X.score_toxicity(docs, X.fit_toxicity(docs, labels)).count() == n
        assert Q.classify_quality(docs, labels).count() == n and Q.keep_good(docs, labels).columns == docs.columns
        assert L.identify_language(docs, L.fit_language(docs)).count() == n
        assert S.scan_licenses(docs).count() == n
        assert D.find_contamination(docs, bench).filter("contaminated = 0").count() == D.drop_contaminated(docs, bench).count() == n
        assert M.mix_sources(docs).count() == n and M.mix_documents(docs).columns == docs.columns
        P.write_tokens(docs, str(tmp_path / f"t{n}"), public_tokenizers.path("byte_bpe_50k.json"))
        assert P.read_tokens(spark, str(tmp_path / f"t{n}")).count() == n
    pages = spark.createDataFrame([(1, "u", "<p>x", "r", "m"), (1, "u", "<p>x", "r", "m"), (None, None, None, None, None)], "page_id long, url string, html string, record string, text string")
    assert R.derive_records(pages).count() == 3 and R.derive_records(pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, h long, cell int")
    assert N.nearest_neighbours(vectors, F.col("vec_id") % 2 == 0).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).columns == none.columns, name


def test_language(spark):
    from tidemark.llm import language_id as L

    rng = np.random.default_rng(3)
    emit, start, trans, first = rng.normal(size=(200, 3)), np.zeros(200, bool), np.exp(rng.normal(size=(3, 3))), np.array([0.2, 0.3, 0.5])
    start[[0, 1, 63, 64, 130]] = True
    got, e = L.marginals(emit, start, trans, first), np.exp(emit)
    edges = [*np.flatnonzero(start), 200]
    for a, b in zip(edges[:-1], edges[1:]):
        f, g = np.zeros((b - a, 3)), np.ones((b - a, 3))
        for t in range(b - a):
            f[t] = (first if t == 0 else f[t - 1] @ trans) * e[a + t]
        for t in range(b - a - 2, -1, -1):
            g[t] = trans @ (e[a + t + 1] * g[t + 1])
        assert np.allclose(got[a:b], f * g / (f * g).sum(1, keepdims=True))

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_language(docs, keep=~L.C.held_out(4, 2), sample_rows=400)
    out = L.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(L.C.held_out(4, 2))
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    odd = {r["doc_id"]: r for r in L.identify_language(docs_of(spark, [(1, None, None, None), (2, "", None, None), (3, "12 — 34 !", None, None), (4, "東京", None, None), (5, "the and of", None, None)]), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd[4]["lang_pred"] in model.labels and odd[5]["lang_pred"] == "en" and odd[1]["score"] == 0
    # words of a switched text get their own labels
    half = ["the that and of with was"] * 4 + ["der und die nicht mit sich"] * 4
    data, at = L.C.utf8(pa.array([" ".join(half)]))
    low, s, e2, f2 = L.words_of(data, at)
    st = np.zeros(len(s), bool)
    st[0] = True
    post = L.marginals(L.emissions(low, s, e2, model.weights), st, np.exp(model.trans), np.full(len(model.labels), 0.25)).argmax(1)
    assert (post[:20] == model.labels.index("en")).mean() > 0.9 and (post[-20:] == model.labels.index("de")).mean() > 0.9


def water(sizes, budget):
    """Shares by weight, those above their cap set to it and the rest shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    from tidemark.llm import mixing as M

    rows = odd_rows(4, 90)
    out = M.mix_sources(docs_of(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {}
    for _, t, _, s in rows:
        source[s] = source.get(s, 0) + size(t)
    target = water(source, 1.5 * sum(source.values()))
    of = {i: (size(t), s) for i, t, _, s in rows}
    taken = dict.fromkeys(source, 0)
    for r in out:
        n, s = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, source[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    for s in source:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s])
    again = M.mix_sources(docs_of(spark, rows)).collect()
    key = lambda q: sorted((r["doc_id"], r["taken"], tuple(r["draws"])) for r in q)
    assert key(out) == key(again)
    mixed = M.mix_documents(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows[:1]).columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4
    assert M.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_takes_what_the_shards_draw(spark):
    from tidemark.llm import mixing as M

    out = M.mix_sources(docs_of(spark, odd_rows()), shards=8).collect()
    per_shard = {}
    for r in out:
        assert r["taken"] == sum(r["words"]) and len(r["draws"]) == len(r["words"]) == r["n_draws"]
        for s, w in zip(r["draws"], r["words"]):
            per_shard[s] = per_shard.get(s, 0) + w
    assert set(per_shard) <= set(range(8)) and sum(per_shard.values()) == sum(r["taken"] for r in out)
    # blocks of a draw lie in the shards that the tree gives their source: as many draws in each as its quotas say
    plan = M.mix_plan(docs_of(spark, odd_rows()), shards=8).collect()
    draws = np.zeros(8, int)
    for r in plan:
        for s in r["draws"]:
            draws[s] += 1
    assert draws.sum() == sum(r["passes"] + (r["part"] > 0) for r in plan) and draws.max() - draws.min() <= 1


def test_split_quotas():
    from tidemark.llm.mixing import split_quotas

    q = np.array([17, 0, 5, 101, 3])
    s = split_quotas(q, 7, 1)
    assert (s.sum(1) == q).all() and s.sum(0).max() - s.sum(0).min() <= 1 and (s >= 0).all()
    mean = np.mean([split_quotas(q, 4, i)[3, 0] for i in range(300)])
    assert abs(mean - 101 * 32 / 126) < 0.5  # shard 0 takes 32 of the 126 draws
    assert (split_quotas(np.zeros(2, int), 3, 0) == 0).all()


def test_bounded_sample(spark):
    from tidemark.llm import common as C

    for n in (10**10, 10**13, 10**15):
        assert 2 * 5000 <= C._below(5000, n) * n / C._HASHES <= 2 * 5000 + 300
    rows = spark.createDataFrame([(i, "rare" if i < 7 else "often" if i < 900 else None) for i in range(2000)], "doc_id long, lang string")
    assert C.bounded_sample(rows, "doc_id", 300).count() == 300 and C.bounded_sample(rows, "doc_id", 5000).count() == 2000
    some = {r["lang"]: r["count"] for r in C.bounded_sample(rows, "doc_id", 300, by="lang").groupBy("lang").count().collect()}
    assert some["rare"] == 7 and sum(some.values()) == 300 and abs(some["often"] - some[None]) <= 1
    assert C.bounded_sample(rows.limit(0), "doc_id", 3, by="lang").count() == 0


def test_transitions_equal_enumeration():
    from tidemark.llm.language_id import marginals

    rng = np.random.default_rng(1)
    emit, trans, first = rng.normal(size=(9, 3)), rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    start = np.zeros(9, bool)
    start[[0, 5]] = True
    post, moves = marginals(emit, start, trans, first, pairs=True)
    want_p, want_m = np.zeros((9, 3)), np.zeros((3, 3))
    for lo, hi in ((0, 5), (5, 9)):
        total, p, m = 0.0, np.zeros((9, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=hi - lo):
            w = first[path[0]] * np.exp(sum(emit[lo + i, y] for i, y in enumerate(path))) * math.prod(trans[a, b] for a, b in zip(path, path[1:]))
            total += w
            for i, y in enumerate(path):
                p[lo + i, y] += w
            for a, b in zip(path, path[1:]):
                m[a, b] += w
        want_p, want_m = want_p + p / total, want_m + m / total
    assert np.allclose(post, want_p) and np.allclose(moves, want_m)


def test_quality(spark):
    from tidemark.llm import quality as Q

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod("doc_id", F.lit(2))
    out = Q.classify_quality(docs, labels, keep=half == 0).join(labels, "doc_id").filter(half == 1)
    assert out.agg(F.avg((F.col("keep") == F.col("quality")).cast("int"))).first()[0] > 0.97
    odd = docs_of(spark, odd_rows())
    assert Q.classify_quality(odd, labels).count() == odd.count()
    kept = Q.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    # sparse groups shrink to their host, a document's own evidence is left out
    rows = spark.createDataFrame([("a", "x", 2.0)] * 50 + [("a", "y", -2.0)] + [("b", None, -2.0)] * 50, "source string, lang string, _odds double")
    t = {(r["source"], r["lang"]): r for r in Q.posteriors(rows, ["source"], ["lang"]).collect()}
    assert t[("a", "y")]["host_share"] > 0.6 > 0.4 > t[("b", None)]["host_share"]
    judged = Q.judge(rows, Q.posteriors(rows, ["source"], ["lang"]), ["source"], ["lang"], 0.0)
    assert judged.count() == 101 and judged.filter("lang = 'y'").first()["quality"] > 1 / (1 + math.exp(2))


class Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.out.append("\n" if tag not in ("a", "b", "i", "em", "span") else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.out.append("\n" if tag not in ("a", "b", "i", "em", "span") else "")

    def handle_data(self, d):
        self.out.append("" if self.skip else d.replace("\n", " "))


def test_warc(spark, tmp_path):
    from tidemark.llm import warc as R

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = R.derive_records(pages).collect()
    source = {r["page_id"]: r for r in pages.collect()}
    assert len(rows) == len(source) and len({r["metadata_id"] for r in rows}) == len(rows)
    for r in rows:
        page = source[r["page_id"]]
        p = Text()
        p.feed(page["html"])
        lines = [re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(p.out).split("\n")]
        assert r["text"].split() == " ".join(x for x in lines if x).split()
        fields, block = R.parse(bytes(r["conversion"]))
        assert fields["warc-type"] == "conversion" and fields["warc-refers-to"] == r["response_id"] and fields["warc-target-uri"] == page["url"]
        assert block.decode() == r["text"] and fields["warc-block-digest"] == R.digest(block) and fields["warc-payload-digest"] == R.digest(page["html"].encode())
        fields, block = R.parse(bytes(r["metadata"]))
        assert fields["warc-refers-to"] == r["response_id"] and f"source-payload-digest: {r['payload_digest']}".encode() in block and b"http-content-type: text/html" in block
    odd = spark.createDataFrame([(1, None, None), (2, "http://x/\r\nEvil: 1", "<p>a&amp;b<script>x</p>"), (3, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in R.derive_records(odd).collect()}
    assert got[1]["text"] == "" and got[2]["text"] == "a&b" and "\n" not in got[2]["target_uri"]
    R.write_records(R.derive_records(odd), str(tmp_path / "w"))
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "w"), wholetext=True).collect())
    assert text.count("WARC/1.1") == 6 and text.endswith("\r\n\r\n")


def test_warc_left_out_ends_and_repeated_headers():
    from tidemark.llm import warc as R

    pages = {
        "<html><head><title>T</title><meta charset=x><body><p>one</p>two": "one two", "<head><title>T</title><p>one": "one", "<head><title>T</title>one <b>two</b>": "one two", "<head><script>x</script><link href=y></head>one": "one",
        "<p>one<svg width='5'/>two<svg><text>no</text></svg>three": "one two three", "one<svg>two": "one two", "one<noscript>two": "one two", "one<noscript>no</noscript>two<template>no</template>": "one two",
        "one<script>no": "one", "one<style>no": "one", "one<!-- no": "one", "<script>a='<!--'</script>one": "one", "<script src='x' />one": "one", "<head><script src='x'/><title>T</title><p>one<script>no</script>": "one", "<header>one</header>": "one", "one<![CDATA[ x": "one x", "one<![CDATA[ no ]]>two<!--->three": "onetwothree",
    }
    for page, text in pages.items():
        assert R.plain_text(page).split() == text.split(), page
    assert len(R.plain_text("<svg>a" * 100_000).split()) == 100_000
    http = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nLink: <x>\r\nSet-Cookie: b=2\r\nContent-Type: text/html\r\n\r\n<p>x"
    record = R.build("response", {"WARC-Record-ID": "<urn:x>"}, http.encode())
    _, block = R.parse(R.derive(record)["metadata"])
    assert re.findall(r"http-(?:set-cookie|link): (.*)\r", block.decode()) == ["a=1", "<x>", "b=2"]


def test_warc_open_tags_take_linear_time():
    import time

    from tidemark.llm import warc as R

    began = time.time()
    for page in ("<a " * 200_000, "<script " * 100_000, "<title>" * 100_000, "<p " * 200_000 + "> x", "<svg>" * 50_000):
        R.derive(R.response("u", page))
    assert time.time() - began < 20
    assert R.plain_text("a <b>c</b> < d <e") == "a c < d <e"


def test_token_planes(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import token_planes as P

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = odd_rows() + [(400, "a   b  \n c \t", "en", "s"), (401, "  don't  <|endoftext|> x.. y", "en", "s"), (402, "\xa0 \xa0 z　 ", "en", "s"), (403, "end.\n\n\n", "en", "s"), (404, "x \n", "en", "s")]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for kind in ("byte", "bit"):
        P.write_tokens(docs_of(spark, rows), str(tmp_path / kind), path, kind=kind, block_ids=64)
        got = sorted(P.read_tokens(spark, str(tmp_path / kind), with_ids=True).collect(), key=lambda r: r["start"])
        at = 0
        for r, row in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
            ids = np.array(t.encode(row[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (row[0], at, len(ids) // 4, zlib.crc32(ids), ids)
            at += len(ids) // 4
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1001, dtype=np.uint64).astype(np.uint32)
    for kind, n in (("byte", 4), ("bit", 32)):
        planes = P.to_planes(ids, kind)
        assert len(planes) == n and (P.from_planes(planes, 1001) == ids).all()


def test_nearest(spark):
    from tidemark.llm import nearest as N

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    vecs = [(centres[i % 20] + 0.2 * rng.normal(size=16)).tolist() for i in range(600)]
    rows = list(enumerate(vecs)) + [(1000 + i, vecs[7]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    out = N.nearest_neighbours(df, F.col("vec_id") % 7 == 0).collect()
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i < 2000]
    x, ids = np.stack([v for _, v in good]), np.array([i for i, _ in good])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found, total = 0, 0
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in ids.tolist() if i % 7 == 0}
    for q, rs in by.items():
        score = np.round(unit @ unit[ids == q][0], 12)
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score))[:5]].tolist()
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5]
        found, total = found + len(set(best) & {r["vec_id"] for r in rs}), total + 5
        if q == 7:
            assert [r["vec_id"] for r in rs] == [1000, 1001, 1002, 1003, 1004]
    assert found / total >= 0.9
    few = N.nearest_neighbours(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert N.nearest_neighbours(df.filter("vec_id > 5000"), F.col("vec_id") == 0).count() == 0
    assert N.chi_square_bound(0.95) == pytest.approx(15.507313, abs=1e-5)


def test_nearest_over_many_cells(spark, monkeypatch):
    """Clustered vectors in many cells: exact scores, recall of 0.9 and more, and few cells within reach of a query."""
    from tidemark.llm import nearest as N

    monkeypatch.setattr(N, "CELL", 40)
    rng = np.random.default_rng(6)
    centres = 6 * rng.normal(size=(32, 24))
    x = centres[rng.integers(0, 32, 2000)] + 0.3 * rng.normal(size=(2000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, kth = 0, []
    for q in range(0, 2000, 20):
        s = unit @ unit[q]
        s[q] = -2
        best = np.argsort(-s, kind="stable")[:5]
        hits += len(set(best) & set(got[q]))
        kth.append(s[best[-1]])
        assert len(got[q]) == 5 and all(v == pytest.approx(s[i], abs=1e-12) for i, v in got[q].items())
    assert hits >= 0.9 * 500
    z = unit @ np.random.default_rng(N.SEED).normal(size=(24, N.M))
    cells = N.Cells(z, 2000)
    of = cells.of(z)
    boxes = {c: (z[of == c].min(0), z[of == c].max(0)) for c in np.unique(of)}
    bound, visited = N.chi_square_bound(N.CERTAINTY), 0
    for q, s in zip(range(0, 2000, 20), kth):
        visited += sum((np.maximum(np.maximum(a - z[q], z[q] - b), 0) ** 2).sum() <= bound * (2 - 2 * s) for a, b in boxes.values())
    assert len(boxes) >= 32 and visited <= 0.25 * 100 * len(boxes)


def test_decontamination(spark):
    from tidemark.llm import decontaminate as D

    r = random.Random(7)
    text = lambda n: " ".join(r.choices(WORDS, k=n))
    item = "a train with 12 cars left for Berlin at 7 hours and met the other train from Madrid after 12 cars had passed the bridge"
    bench = spark.createDataFrame([(1, item), (2, text(30)), (3, None), (4, ""), (5, "short one here"), (None, "x y z")], "item_id long, text string")
    moved = item.replace("12", "35").replace("Berlin", "Oslo").replace("Madrid", "Rome").replace("7 hours", "9 days")
    broken = moved.replace("after 35", "after 99")
    two = [x["text"] for x in bench.collect() if x["item_id"] == 2][0]
    rows = [(1, f"{text(20)} {item} {text(20)}", "en", "s"), (2, f"{text(20)} {moved}. {text(9)}", "en", "s"), (3, f"{text(20)}. {broken} {text(20)}", "en", "s"), (4, text(200), "en", "s"), (5, text(40) + " " + two.upper() + " " + text(5), "en", "s"), (6, None, None, None), (7, "", None, None), (8, two + " " + item, "en", "s"), (9, "12 12 12 12 12 12 12 12 Berlin Berlin", "en", "s"), (10, "Go. " + item.title(), "en", "s")]
    docs = docs_of(spark, rows)
    got = {x["doc_id"]: x for x in D.find_contamination(docs, bench).collect()}
    assert {i for i, x in got.items() if x["contaminated"]} == {1, 2, 5, 8, 10}
    assert got[8]["n_items"] == 2 and got[2]["item_id"] == 1 and got[4]["coverage"] == 0
    kept = D.drop_contaminated(docs, bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [3, 4, 6, 7, 9] and kept.columns == docs.columns
    assert D.find_contamination(docs, bench.filter("item_id > 99")).filter("contaminated = 1").count() == 0


def test_decontamination_by_row_in_many_blocks(spark, monkeypatch):
    from tidemark.llm import decontaminate as D

    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = docs.unionByName(docs.limit(30)).unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    bench = bench.unionByName(bench.limit(5))
    key = lambda q: sorted(map(str, q.collect()))
    one, kept = key(D.find_contamination(docs, bench)), key(D.drop_contaminated(docs, bench))
    monkeypatch.setattr(D, "BLOCK_CHARS", 3_000)
    assert D.benchmark_blocks(bench, "item_id", "text", 8, 0.6)[0] > 2
    assert key(D.find_contamination(docs, bench)) == one and key(D.drop_contaminated(docs, bench)) == kept
    assert len(one) == docs.count()


def test_decontamination_of_shifted_passages(spark):
    """Slots of other lengths, names that begin a sentence, and inserted or dropped words."""
    from tidemark.llm import decontaminate as D

    r = random.Random(11)
    text = lambda n: " ".join(r.choices(WORDS, k=n))
    number = "the farmer drove along the old river road and sold exactly 1,250 baskets of red apples to a merchant from the northern hills"
    name = "every morning before school opened its wide doors young Anna Maria walked slowly past the bakery and counted all the fresh loaves inside"
    opener = "Peter carried seven heavy stones up the hill. Peter dropped three of them near the old stone well by night"
    plain = text(24)
    w = plain.split()
    bench = spark.createDataFrame([(1, number), (2, name), (3, opener), (4, plain)], "item_id long, text string")
    twice = number.replace("1,250", "40") + " " + name.replace("Anna Maria", "Bob")
    found = {
        1: number.replace("1,250", "40"), 2: name.replace("Anna Maria", "Bob"), 3: opener.replace("Peter", "Mary Ann"), 4: " ".join(w[:12] + ["extra"] + w[12:]), 5: " ".join(w[:11] + w[12:]), 6: twice, 7: number.replace("1,250", "3.5"),
    }
    clean = {20: " ".join(w[:12]), 21: " ".join(w[:12] + text(60).split() + w[12:]), 22: " ".join(w[12:] + w[:12]), 23: text(90)}
    rows = [(i, f"{text(9)}. {t} {text(9)}", "en", "s") for i, t in (found | clean).items()]
    got = {x["doc_id"]: x for x in D.find_contamination(docs_of(spark, rows), bench).collect()}
    assert {i for i, x in got.items() if x["contaminated"]} == set(found)
    assert got[6]["n_items"] == 2 and [got[i]["item_id"] for i in (1, 2, 3, 4, 5, 7)] == [1, 2, 3, 4, 4, 1] and got[4]["coverage"] == 1


def test_license_scan(spark):
    from tidemark.llm import license_scan as S

    rows = [(1, "Released under the MIT license. under THE mit-License!", "en", "s"), (2, "Licensed under the Apache License, Version 2.0.", "en", "s"), (3, "CC BY-NC-SA 4.0 license text: this work is licensed under CC BY-NC-SA 4.0", "en", "s"), (4, "SPDX-License-Identifier: GPL-3.0-or-later", "en", "s"), (5, "nothing to see", "en", "s"), (6, None, None, None), (7, "licensed under the GNU Lesser General Public License, version 3", "en", "s"), (8, "Copyright (c) 2020 X. All rights reserved.", "en", "s")] + [(100 + i, t, a, b) for i, (_, t, a, b) in enumerate(odd_rows()[-9:])]
    got = {r["doc_id"]: r for r in S.scan_licenses(docs_of(spark, rows)).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, x) for x, p in S.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[1]["labels"] == "mit" and got[2]["labels"] == "apache-2" and "gpl-3" in got[4]["labels"] and got[5]["labels"] == "" and got[6]["score"] == 0
    assert got[3]["labels"] == "cc-by-nc,cc-by-nc-sa" and got[7]["labels"] == "lgpl-3" and got[8]["labels"] == "copyright,proprietary"
    assert len(S.signature_rules()) >= 300


def test_license_containment_and_gaps():
    from tidemark.llm.license_scan import Scanner

    scanner = Scanner()
    label = lambda t: {x[0] for x in scanner.detect(t.lower(), None)}
    for text, want in [("License: MIT", "mit"), ("license=MIT", "mit"), ("Copyright 2020 Foo", "copyright"), ("Copyright(c)2020", "copyright"), ("This code is released under GPL v3.", "gpl-3"), ("released under GPLv3", "gpl-3"), ("Distributed under Apache 2.0", "apache-2"), ("see MIT-license", "mit"), ("Creative Commons Attribution-ShareAlike 4.0 license", "cc-by-sa")]:
        assert want in label(text), (text, label(text))
    r = random.Random(3)
    parts = ["all rights reserved.", "licensed under the mit license.", "copyright 2020", "released under gpl v3 license", "bsd 3-clause license", "x", "this software is provided 'as-is', without any express or implied warranty"]
    for _ in range(100):
        text = " ".join(r.choices(parts, k=12))
        found = sorted((p, m.start() - m.end(), m.start(), m.end(), lab, w) for lab, _, pat, p, w in scanner.rules for m in pat.finditer(text))
        kept = []
        for _, _, a, b, lab, w in found:
            if not any(x <= a and b <= y for _, x, y, _ in kept):
                kept.append((lab, a, b, w))
        assert scanner.detect(text, None) == kept


def test_every_license_rule_finds_its_own_words():
    """A text made of each rule's first alternatives is found by the gated scan with that rule's label, unless a better rule covers it."""
    from tidemark.llm import license_scan as S

    scanner = S.Scanner()
    for label, keyword, pattern, *_ in S.WHOLE_TEXTS:
        # the pattern as text: optional parts left out, first alternatives taken
        text, was = pattern, ""
        while text != was:
            was = text
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] else m[1], text)
        text = re.sub(r"\(\?!.*?\]\)", "", text)
        text = re.sub(r"\[\^\.\]\{0,\d+\}\?", "", text)
        text = text.replace(".{1,80}?", "someone").replace("\\w+", "uck").replace("[1-4]", "4").replace("[0-9]{2}", "20").replace("\\(", "(")
        text = re.sub(r"\\(.)", r"\1", re.sub(r"(?<!\\)[\w ,\"-]\?|/\?", lambda m: m[0][0] if m[0][0] == "/" else "", text))
        have = scanner.have(text.encode())
        assert keyword in have, (keyword, text)
        compiled = [r for r in scanner.rules if r[0] == label and r[2].pattern == S.gap(pattern)][0]
        assert compiled[2].search(text), (pattern, text)
        assert scanner.detect(text, have), text
    assert len(scanner.rules) >= 600 and len(S.WHOLE_TEXTS) >= 80


def test_license_gate_changes_nothing(spark):
    """Rules behind keywords find what all rules find, on lines without a word of licensing too."""
    from tidemark.llm import license_scan as S

    lines = {"Distributed under GPLv3.": "gpl-3", "Released under the MIT.": "mit", "available under Apache 2.0 or MIT licenses": "apache-2", "Published\u2014under\u2014the BSD 3-Clause": "bsd-3", "PROVIDED under terms of CC0": "cc0", "a bridge under the river, available to all": ""}
    rows = [(i, t, "en", "s") for i, t in enumerate(lines)]
    got = {r["doc_id"]: r for r in S.scan_licenses(docs_of(spark, rows)).collect()}
    for i, (t, label) in enumerate(lines.items()):
        assert (label in got[i]["labels"].split(",")) and (got[i]["score"] > 0.9) == bool(label), t
    scanner = S.Scanner()
    names = ["mit", "apache 2.0", "gnu gpl", "cc by-sa 4.0", "zlib/libpng", "unknown"]
    texts = [lower(t) for t in lines] + [carrier.format(name) for name in names for carrier in ("released under {}", "under the {} license", "licence: {}", "{} public license, version 2", "see the file {}-license", "spdx-license-identifier: {}", "made available under the terms of the {}", "{}")]
    texts += ["all rights reserved", "permission is hereby granted, free of charge, to any person obtaining a copy", "https://creativecommons.org/licenses/by-sa/4.0", "placed into the public domain", "copyright (c) 2020"]
    for t in texts:
        assert scanner.detect(t, scanner.have(t.encode())) == scanner.detect(t, None), t


def test_components(spark):
    from tidemark.llm.common import connected_components

    r = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(got.get(x, x) == find(x) for x in root)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    rows = [n for n, _ in P.STAGES]
    assert len(rows) == 5 and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_runs_whole_and_tidies(spark):
    """run() gives the rows of its stages, and nested lists of scratch tables don't mix."""
    import corpus_pipeline
    from tidemark.llm import common as C

    with C.tracked() as outer:
        with C.tracked() as inner:
            pass
        a = C.materialize(spark.range(3), "a")
    assert inner == [] and outer == [a._scratch_path] and not C._TRACKED
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("end")).first()
    assert rows["n"] > 20 and rows["t"] == rows["end"]
