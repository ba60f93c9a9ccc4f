"""Runs of repeated words against brute force over all lags, and time on texts that are nothing but repeats."""

import hashlib
import random
import re
import time
import zlib


def brute(w):
    """All maximal stretches with a period, by every lag; the smallest period of each stretch."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def digest(doc_id, text, loop=True):
    """The query's row by its definition."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if loop and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    rest = " ".join(x for i, x in enumerate(w) if i not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(rest))


def looped(r):
    k = r.choice([1, 2, 2, 3, 5, 30])
    n = r.randint(0, r.choice([15, 40, 120, 300]))
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n else 0):
        a, p = r.randrange(n), r.randint(1, max(1, n // 3))
        length, seg = r.randint(p, 4 * p + 12), w[a : a + p]
        w[a : a + length] = (seg * (length // max(1, len(seg)) + 1))[:length]
        if r.random() < 0.4:
            w[r.randrange(len(w))] = 99
    return w


def test_runs_of_random_sequences():
    from tidemark.llm.periodic_runs import find_runs

    r = random.Random(3)
    for _ in range(3000):
        w = looped(r)
        assert find_runs(w) == brute(w), w


def test_runs_in_near_linear_time():
    """Repeats of one word, one line, lines of lines, Fibonacci words and blocks in blocks: no look at all pairs."""
    from tidemark.llm.periodic_runs import find_runs

    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    nest = ((list(range(7)) * 9 + [8]) * 12 + [9]) * 60
    blocks = ([0] * 200 + [1]) * 200
    start = time.process_time()
    assert find_runs([0] * 50_000) == [(0, 50_000, 1)]
    assert find_runs(list(range(10)) * 5_000) == [(0, 50_000, 10)]
    assert find_runs(list(range(30_000)) * 2) == [(0, 60_000, 30_000)]
    assert find_runs(list(range(60_000))) == []
    assert len(find_runs(b)) > 5_000
    assert (0, len(nest), 769) in find_runs(nest) and (0, len(blocks), 201) in find_runs(blocks)
    assert time.process_time() - start < 40


ROWS = [(None, "no id " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (10, "a b c " * 12), (10, "a b c " * 12), (11, "x" * 50 + " tail"), (12, "la la\tla\nla " * 2_000 + "end"), (13, "été 東京 ß \x00 " * 9), (14, " ".join(f"w{i}" for i in range(30)) + " x \x0b y")]


def test_frames(spark):
    from tidemark.llm.periodic_runs import collapse_runs

    docs = spark.createDataFrame([(i, t, 7, "n", 0.5) for i, t in ROWS], "doc_id long, text string, start int, collapsed string, keep double")
    got = collapse_runs(docs).collect()
    assert got[0].__fields__ == ["doc_id", "keep", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    have = sorted(((str(r["doc_id"]), r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], hashlib.sha256("".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"]).encode()).hexdigest(), hashlib.sha256(r["collapsed"].encode()).hexdigest()) for r in got), key=str)
    assert [x for x in have if x[0] != "12"] == sorted(((str(i), *digest(i, t, loop=False)) for i, t in ROWS if i != 12), key=str)
    long = [x for x in have if x[0] == "12"][0]
    assert long[1:6] == (1, 0, 8_000, 1, 8_000_000) and long[7] == hashlib.sha256(b"la end").hexdigest()
    assert collapse_runs(docs.limit(0)).count() == 0


def test_query(spark):
    import __spark_entry__ as E

    where = "/root/testdata/sf0.001"
    got = E.queries()["op12_periodic_runs"](spark, where).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got) > 10
    for r in got:
        if len(docs[r["doc_id"]] or "") < 6_000 or r["doc_id"] % 7 == 0:
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == digest(r["doc_id"], docs[r["doc_id"]]), r["doc_id"]
