"""Language identification by a linear-chain conditional random field over words.

Each word has features by hash: itself (the lexicon), its first and last 2 and 3 bytes (affixes) and its byte
trigrams. Emission weights and transitions are learned on sequences that switch between languages, put together
from labelled texts. Forward-backward labels every word of a text; a text's language is the one with the largest
mean marginal over its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 17
#: Labelled rows to fit on, how long their texts may be, and how many switching sequences are made of them.
SAMPLE_ROWS, SAMPLE_CHARS, SEQUENCES = 3_000, 20_000, 2_500
SEGMENT = 64
AFFIXES = ((0, 2), (0, 3), (1, 2), (1, 3))


def words_of(raw: np.ndarray, at: np.ndarray):
    data = C.lower_ascii(raw)
    return data, *C.spans(C.ALNUM[data], at)


def feature_hashes(data, s, e):
    """For each word the ids of its word and affix features; for each byte the id of the trigram that starts there."""
    p, inv = C._powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    shift = np.uint64(64 - BITS)
    seed = 1
    per_word = []

    def ids(lo, hi, seed):
        h = (total[hi] - total[lo]) * inv[lo] + np.uint64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int32)

    per_word.append(ids(s, e, seed))
    for side, n in AFFIXES:
        seed += 1
        per_word.append(ids(s, np.minimum(s + n, e), seed) if side == 0 else ids(np.maximum(e - n, s), e, seed))
    i = np.arange(max(len(data) - 2, 0))
    return per_word, ids(i, i + 3, seed + 1)


def emissions(data, s, e, weights: np.ndarray) -> np.ndarray:
    per_word, grams = feature_hashes(data, s, e)
    out = np.zeros((len(s), weights.shape[1]))
    for ids in per_word:
        out += weights[ids]
    # trigrams inside words: sums over the bytes of a word but its last two
    table = np.concatenate([weights[grams], np.zeros((3, weights.shape[1]), weights.dtype)])
    run = np.zeros((len(table) + 1, weights.shape[1]))
    np.cumsum(table, axis=0, out=run[1:], dtype=np.float64)
    out += run[np.maximum(e - 2, s)] - run[s]
    return out


def marginals(emit: np.ndarray, start: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Posterior of each label at each word. All texts form one chain that starts anew where `start` holds.

    With `pairs` also the expected number of each transition: sums of the posteriors of neighbouring labels. Segments are handled side by side: their transfer matrices carry messages from segment to segment, then
    forward and backward passes run inside all segments at once. The result is that of one long pass.
    """
    n, k = emit.shape
    pad = -n % SEGMENT
    emit = np.exp(emit - emit.max(1, keepdims=True))
    emit = np.concatenate([emit, np.ones((pad, k))]).reshape(-1, SEGMENT, k).transpose(1, 0, 2).copy()
    start = np.concatenate([start, np.ones(pad, bool)]).reshape(-1, SEGMENT).T.copy()
    m = emit.shape[1]
    whole = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(SEGMENT):
        before = whole
        whole = whole @ trans
        whole[start[t]] = (before[start[t]].sum(2))[:, :, None] * first
        whole *= emit[t][:, None, :]
        whole /= whole.max((1, 2), keepdims=True)
    forth, back = np.empty((m, k)), np.empty((m, k))
    a, b = first, np.ones(k)
    for j in range(m):
        forth[j] = a
        a = a @ whole[j]
        a = a / a.sum()
        back[m - 1 - j] = b
        b = whole[m - 1 - j] @ b
        b = b / b.sum()
    alpha = np.empty((SEGMENT, m, k))
    a = forth
    for t in range(SEGMENT):
        a = a @ trans
        a[start[t]] = first
        a *= emit[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    b, moves = back, np.zeros((k, k))
    for t in range(SEGMENT - 1, -1, -1):
        if pairs:
            go = ~start[t]
            both = (alpha[t - 1] if t else forth)[go][:, :, None] * trans * (emit[t][go] * b[go])[:, None, :]
            moves += (both / both.sum((1, 2), keepdims=True)).sum(0)
        alpha[t] *= b
        b = (emit[t] * b) @ trans.T
        b[start[t]] = 1
        b /= b.sum(1, keepdims=True)
    alpha /= alpha.sum(2, keepdims=True)
    post = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
    return (post, moves) if pairs else post


class WordCRF:
    """labels in code-point order; weights (features x labels), transitions and starts as log potentials."""

    def fit(self, texts: list[str], langs: list[str], sequences: int = SEQUENCES, rounds: int = 40, seed: int = 5) -> "WordCRF":
        self.labels = sorted(set(langs))
        k = len(self.labels)
        self.weights, self.trans, self.first = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k)
        if k < 2:
            return self
        rng = np.random.default_rng(seed)
        y = np.array([self.labels.index(x) for x in langs])
        data, at = C.utf8(pa.array(texts, pa.string()))
        data, s, e, first = words_of(data, at)
        by_label = [np.flatnonzero((y == j) & (np.diff(first) > 0)) for j in range(k)]
        by_label = [x for x in by_label if len(x)]
        if len(by_label) < 2:
            return self
        take, label, starts = [], [], []
        for _ in range(sequences):
            for part in range(int(rng.integers(1, 4))):
                of = by_label[int(rng.integers(len(by_label)))]
                d = int(of[rng.integers(len(of))])
                n = min(int(rng.integers(3, 40)), first[d + 1] - first[d])
                lo = first[d] + int(rng.integers(0, first[d + 1] - first[d] - n + 1))
                take += range(lo, lo + n)
                label += [y[d]] * n
                starts += [part == 0] + [False] * (n - 1)
        take, label, start = np.array(take), np.array(label), np.array(starts)
        per_word, grams = feature_hashes(data, s, e)
        n_grams = np.maximum(e - s - 2, 0)[take]
        inside = np.repeat(s[take] - np.concatenate(([0], np.cumsum(n_grams)[:-1])), n_grams) + np.arange(n_grams.sum())
        feature = np.concatenate([x[take] for x in per_word] + [grams[inside]])
        word = np.concatenate([np.arange(len(take))] * len(per_word) + [np.repeat(np.arange(len(take)), n_grams)])
        u, feature = np.unique(feature, return_inverse=True)
        w = np.zeros((len(u), k))
        gold = np.eye(k)[label]
        go = np.flatnonzero(~start[1:]) + 1
        gold_t = np.zeros((k, k))
        np.add.at(gold_t, (label[go - 1], label[go]), 1)
        g_w, g_t, g_f = np.full_like(w, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
        for _ in range(rounds):
            emit = np.stack([np.bincount(word, w[feature, j], len(take)) for j in range(k)], 1)
            trans, begin = np.exp(self.trans - self.trans.max()), np.exp(self.first - self.first.max())
            post, moves = marginals(emit, start, trans, begin / begin.sum(), pairs=True)
            diff = gold - post
            grad = np.stack([np.bincount(feature, diff[word, j], len(u)) for j in range(k)], 1) - 0.05 * w
            grad_t = gold_t - moves - 0.05 * self.trans
            grad_f = diff[start].sum(0) - 0.05 * self.first
            g_w += grad**2
            g_t += grad_t**2
            g_f += grad_f**2
            w += 0.5 * grad / np.sqrt(g_w)
            self.trans = self.trans + 0.3 * grad_t / np.sqrt(g_t)
            self.first = self.first + 0.1 * grad_f / np.sqrt(g_f)
        self.weights[u] = w
        return self

    def mean_marginals(self, column) -> np.ndarray:
        """For each text the mean marginal of each label over its words with letters; zeros without any."""
        data, at = C.utf8(column)
        if not self.labels:
            return np.zeros((len(column), 0))
        out = []
        trans, begin = np.exp(self.trans - self.trans.max()), np.exp(self.first - self.first.max())
        for _, _, part, cut in C.pieces(data, at):
            low, s, e, first = words_of(part, cut)
            k = len(self.labels)
            if not len(s):
                out.append(np.zeros((len(cut) - 1, k)))
                continue
            start = np.zeros(len(s), bool)
            start[first[:-1][np.diff(first) > 0]] = True
            post = marginals(emissions(low, s, e, self.weights), start, trans, begin / begin.sum())
            letters = np.concatenate(([0], np.cumsum(low > 57)))
            has = letters[e] > letters[s]
            run = np.concatenate((np.zeros((1, k)), np.cumsum(post * has[:, None], axis=0)))
            n = np.concatenate(([0], np.cumsum(has)))
            out.append((run[first[1:]] - run[first[:-1]]) / np.maximum(n[first[1:]] - n[first[:-1]], 1)[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)))

    def predict(self, column) -> tuple[list, np.ndarray]:
        if not self.labels:
            return ["und"] * len(column), np.zeros(len(column))
        mean = self.mean_marginals(column)
        data, at = C.utf8(column)
        ascii_letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
        beyond = np.concatenate(([0], np.cumsum(data >= 128)))
        plain = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
        other = ~plain & (beyond[at[1:]] > beyond[at[:-1]])
        for i in np.flatnonzero(other):
            plain[i] = any(c.isalpha() for c in column[int(i)].as_py())
        best = mean.argmax(1)
        return [self.labels[b] if p else "und" for b, p in zip(best, plain)], np.where(plain, np.clip(mean.max(1), 0, 1), 0.0)


def fit_language(docs: DataFrame, keep=None, sample_rows: int = SAMPLE_ROWS) -> WordCRF:
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 0))
    if keep is not None:
        rows = rows.filter(keep)
    chosen = C.bounded_sample(rows.select("doc_id", "lang", "text"), "doc_id", sample_rows, by="lang").toPandas().sort_values(["doc_id", "lang", "text"])
    return WordCRF().fit(chosen["text"].tolist(), chosen["lang"].tolist())


def identify_language(docs: DataFrame, model: WordCRF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row per input row; `und` with score 0 where the text is null or has no letter.

    Ties go to the first label in code-point order. With one learned language every text with letters gets it;
    with none every text gets `und`. Repeated rows get equal results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, score = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(C.tidied(run), "doc_id long, lang_pred string, score double")


def op5_language_crf(spark, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: its held_out is null, and nothing is learned from its row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language(docs, keep=~C.held_out(4, 2))
    return identify_language(docs, model).select("doc_id", C.held_out(4, 2).alias("held_out"), "lang_pred", "score")
