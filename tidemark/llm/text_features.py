"""Dense features of whole texts, computed over Arrow buffers, and small models over them.

A text gives counts of bytes and words, shares of capitals, punctuation and digits, obfuscation marks, repetition,
and hits of word lists. Words are runs of ASCII letters, digits and bytes beyond ASCII, lower-cased.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from . import common as C

#: Second-person words of four languages.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "vous", "votre", "vos", "ton", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "tuyo", "tus", "vosotros"]

NAMES = ["log_words", "mean_word", "upper", "upper_words", "title_words", "digit", "punct", "symbol_ends", "bang", "pipe", "mixed", "inner_symbol", "repeat_char", "repeat_next", "repeat_gap", "distinct", "hapax_bigram", "line_words", "second", "lex", "lex_any", "lex_max", "near", "stem", "stem_any"]


def word_hashes(words) -> np.ndarray:
    data, at = C.utf8(pa.array([w for w in words], pa.string()))
    return C.span_hashes(data, at[:-1], at[1:])


def _rate(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in a sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[i] == x, i, -1)


def stem_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
    """Hash of each word's first n bytes (0 where the word is shorter)."""
    return np.where(e - s >= n, C.span_hashes(data, s, np.minimum(s + n, e)), np.uint64(0))


#: Lengths in bytes of the word starts that a learned list may hold.
STEMS = (5, 6, 7, 8, 9, 10)


def features(column, lexicon=np.zeros(0, np.uint64), stems: dict | None = None) -> np.ndarray:
    """One row of NAMES for each text. lexicon: sorted hashes of words; stems: sorted hashes by length, of word starts."""
    data, at = C.utf8(column)
    second = np.sort(word_hashes(SECOND_PERSON))
    out = [_piece(p, cut, lexicon, stems or {}, second) for _, _, p, cut in C.pieces(data, at)]
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _piece(raw: np.ndarray, at: np.ndarray, lexicon, stems, second) -> np.ndarray:
    rows = len(at) - 1
    n_bytes = np.maximum(np.diff(at), 1)
    upper = (raw >= 65) & (raw <= 90)
    data = C.lower_ascii(raw)
    digit = (data >= 48) & (data <= 57)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    space = C.SPACE[data]
    punct = ~(letter | digit | space)
    s, e, first = C.spans(C.ALNUM[data], at)
    n = np.maximum(np.diff(first), 1)
    h = C.span_hashes(data, s, e)
    f = np.zeros((rows, len(NAMES)))

    def put(name, x):
        f[:, NAMES.index(name)] = x

    put("log_words", np.log1p(np.diff(first)))
    put("mean_word", _rate(e - s, first) / n)
    put("upper", _rate(upper, at) / n_bytes)
    cum = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    up, dg, lt = cum(upper), cum(digit), cum(letter)
    n_up = up[e] - up[s]
    put("upper_words", _rate((n_up == e - s) & (e - s > 1), first) / n)
    put("title_words", _rate((n_up >= 1) & (n_up < e - s), first) / n)
    put("digit", _rate(digit, at) / n_bytes)
    put("punct", _rate(punct, at) / n_bytes)
    after = np.where(e + 1 < len(data), 1, 0)
    doubled = np.zeros(len(e), bool)
    if len(data) > 1:
        k = np.minimum(e, len(data) - 2)
        doubled = (after == 1) & punct[k] & (data[k] == data[k + 1])
    put("symbol_ends", _rate(doubled, first) / n)
    put("bang", _rate((data == 33) | (data == 63), at) / n_bytes)
    put("pipe", _rate(data == 124, at) / n)
    n_dg, n_lt = dg[e] - dg[s], lt[e] - lt[s]
    put("mixed", _rate((n_dg > 0) & (n_lt > 0), first) / n)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = punct[1:-1] & letter[:-2] & letter[2:] & (data[1:-1] != 39) & (data[1:-1] != 45) & (data[1:-1] != 46)
    put("inner_symbol", _rate(inner, at) / n)
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    put("repeat_char", _rate(triple, at) / n_bytes)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    put("repeat_next", _rate(same, first) / n)
    row = np.repeat(np.arange(rows), np.diff(first))
    if len(h):
        # distinct words and bigrams within each row, by one sort
        key = C.mix(h + C.mix(row.astype(np.uint64) + np.uint64(1)))
        u, back = np.unique(key, return_index=True)
        put("distinct", np.bincount(row[back], minlength=rows) / n)
        pair = C.mix(key[1:] * np.uint64(3) + key[:-1])[row[1:] == row[:-1]]
        prow = row[1:][row[1:] == row[:-1]]
        u, back, times = np.unique(pair, return_index=True, return_counts=True)
        put("hapax_bigram", np.bincount(prow[back], weights=times == 1, minlength=rows) / n)
        put("repeat_gap", np.bincount(prow[back], weights=np.maximum(times - 1, 0), minlength=rows) / n)
    lines = _rate(data == 10, at) + 1
    put("line_words", np.minimum(n / lines, 1000))
    you = _isin(h, second) >= 0
    bad = _isin(h, lexicon) >= 0
    put("second", _rate(you, first) / n)
    hits = _rate(bad, first)
    put("lex", hits / n)
    put("lex_any", np.minimum(hits, 5))
    if bad.any():
        u = np.unique(np.stack([row[bad], _isin(h[bad], lexicon)]), axis=1)
        put("lex_max", np.minimum(np.bincount(u[0], minlength=rows), 5))
        # how often a second-person word stands within five words of a hit
        near = np.zeros(len(h), bool)
        yous = cum(you)
        i = np.flatnonzero(bad)
        near[i] = yous[np.minimum(i + 6, first[row[i] + 1])] > yous[np.maximum(i - 5, first[row[i]])]
        put("near", _rate(near, first) / np.maximum(hits, 1))
    st = np.zeros(len(h), bool)
    for length, table in stems.items():
        if len(table):
            st |= _isin(stem_hashes(data, s, e, length), table) >= 0
    hits = _rate(st, first)
    put("stem", hits / n)
    put("stem_any", np.minimum(hits, 8))
    return f


class BoostedTrees:
    """Gradient-boosted trees for a 0/1 label: histograms of quantile bins, logistic loss, second-order leaves."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 1.0, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        p = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        if len(y) == 0 or y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(self.cuts, x.T)], 1)
        score, m = np.full(len(y), self.base), x.shape[1]
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, w = y - p, p * (1 - p)
            leaf, splits = np.zeros(len(y), np.int64), []
            for d in range(self.depth):
                k = 1 << d
                flat = (leaf[:, None] * m + np.arange(m)) * self.bins + code
                G = np.bincount(flat.ravel(), np.repeat(g, m), k * m * self.bins).reshape(k, m, -1).cumsum(2)
                H = np.bincount(flat.ravel(), np.repeat(w, m), k * m * self.bins).reshape(k, m, -1).cumsum(2)
                gt, ht = G[:, :1, -1:], H[:, :1, -1:]
                gain = G**2 / (H + self.ridge) + (gt - G) ** 2 / (ht - H + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(H < self.least) | (ht - H < self.least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                col, cut = best // self.bins, best % self.bins
                none = gain.reshape(k, -1).max(1) <= 1e-9
                col, cut = np.where(none, 0, col), np.where(none, self.bins, cut)
                splits.append((col, cut))
                leaf = leaf * 2 + (code[np.arange(len(y)), col[leaf]] > cut[leaf])
            G, H = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, w, 1 << self.depth)
            value = self.rate * G / (H + self.ridge)
            self.trees.append((splits, value))
            score += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if not self.trees:
            return score
        code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(self.cuts, x.T)], 1)
        at = np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for col, cut in splits:
                leaf = leaf * 2 + (code[at, col[leaf]] > cut[leaf])
            score += value[leaf]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step fit of y on score (pool adjacent violators), one pseudo-count of either label at the ends."""
    # equal scores are one point from the start
    xs, back, times = np.unique(score, return_inverse=True, return_counts=True)
    value, weight, last = [], [], []
    for a, b, n in zip(xs, np.bincount(back, weights=y, minlength=len(xs)) / times, times.astype(float)):
        value.append(b)
        weight.append(n)
        last.append(a)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, w = value.pop(), weight.pop()
            value[-1] = (value[-1] * weight[-1] + v * w) / (weight[-1] + w)
            weight[-1] += w
            last[-2:] = [last[-1]]
    value, weight = np.array(value), np.array(weight)
    # each step shrinks a little to the overall rate, so that no score is certain
    rate = (y.sum() + 1) / (len(y) + 2)
    return np.array(last), (value * weight + rate) / (weight + 1)


class Logistic:
    """Ridge logistic regression by Newton steps over standardised columns."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> "Logistic":
        self.mean, self.sd = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        p = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(p / (1 - p)))
        self.w = np.zeros(x.shape[1] + 1)
        self.w[-1] = self.prior
        if len(y) and y.min() != y.max():
            a = np.c_[self._z(x), np.ones(len(x))]
            pen = np.full(a.shape[1], ridge)
            pen[-1] = 0
            for _ in range(25):
                q = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
                step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(pen + 1e-6), a.T @ (y - q) - pen * self.w)
                self.w += step
                if np.abs(step).max() < 1e-6:
                    break
        return self

    def _z(self, x):
        return np.clip((x - self.mean) / self.sd, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.w[:-1] + self.w[-1]


def labelled_texts(docs, labels, label: str, most: int, keep=None):
    """doc_id, text, y: at most `most` labelled texts. The labels are thinned before the texts are read; of rows that repeat a doc_id one text stays, that with the smallest hash."""
    from pyspark.sql import functions as F

    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    rows = C.bounded_sample(rows.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))


def training_rows(docs, labels, label: str, most: int, keep=None) -> pd.DataFrame:
    """The rows of labelled_texts() on the driver."""
    return labelled_texts(docs, labels, label, most, keep).toPandas()
