"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of a lexicon (a written one and one learned from the training rows), of learned word
starts, nearness of second-person words to hits, capitals, punctuation and obfuscation rates. The model is fitted
on a bounded sample of labelled rows and applied to every whole text where the text lies; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import text_features as T

#: Insults of four languages.
LEXICON = [
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "garbage", "fool", "imbecile", "filth", "vermin", "ugly", "hate", "shut", "retard", "bastard", "bitch", "shit", "fuck", "fucking", "asshole", "crap",
    "trottel", "dumm", "abschaum", "arschloch", "schwein", "versager", "blöd", "dreck", "scheisse", "scheiße",
    "imbécile", "crétin", "connard", "salaud", "ordure", "débile", "stupide", "merde", "abruti", "racaille",
    "imbécil", "estúpido", "estúpida", "basura", "escoria", "inútil", "asqueroso", "mierda", "cabrón", "payaso",
]

#: Labelled rows to fit on, and how long a text of the sample may be.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 50_000
#: Parts of the sample; what is learned for one is learned from the others.
FOLDS = 5


def words_and_starts(texts: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct (hash, row) of each text's words (0) and word starts of each length."""
    data, at = C.utf8(pa.array(texts.tolist(), pa.string()))
    seen: dict[int, list] = {n: [] for n in (0, *T.STEMS)}
    for i, j, part, cut in C.pieces(data, at):
        part = C.lower_ascii(part)
        s, e, first = C.spans(C.ALNUM[part], cut)
        row = np.repeat(np.arange(i, j), np.diff(first))
        for n, found in seen.items():
            h = C.span_hashes(part, s, e) if n == 0 else T.stem_hashes(part, s, e, n)
            _, one = np.unique(C.mix(h ^ C.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
            one = one[h[one] > 0]
            found.append((h[one], row[one]))
    return {n: tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for n, found in seen.items()}


def learn_lists(held: dict, y: np.ndarray, rows: np.ndarray, support: int = 4, share: float = 0.75) -> tuple[np.ndarray, dict]:
    """Hashes of words, and of word starts by length, that at least `support` of the chosen rows of label 1 hold and,
    smoothed, `share` of all that hold them. Both labels weigh alike in the share."""
    n1, n0 = max(y[rows].sum(), 1), max((1 - y[rows]).sum(), 1)
    out = {}
    for n, (h, row) in held.items():
        h, row = h[rows[row]], row[rows[row]]
        u, back = np.unique(h, return_inverse=True)
        c1 = np.bincount(back, weights=y[row], minlength=len(u))
        c0 = np.bincount(back, minlength=len(u)) - c1
        ratio = (c1 / n1) / (c1 / n1 + (c0 + 1) / n0)
        out[n] = u[(c1 >= support) & (ratio >= share)]
    return out.pop(0), out


class ToxicityModel:
    def fit(self, texts: pd.Series, y: np.ndarray) -> "ToxicityModel":
        held = words_and_starts(texts)

        def lists(rows):
            words, stems = learn_lists(held, y, rows, share=0.9)
            return np.unique(np.concatenate([T.word_hashes(LEXICON), words])), stems

        self.lexicon, self.stems = lists(np.ones(len(y), bool))
        # a training row's features are by lists that were learned without it, as those of a new text are
        fold, rng = np.zeros(len(y), np.int64), np.random.default_rng(0)
        for label in (0, 1):
            of = rng.permutation(np.flatnonzero(y == label))
            fold[of] = np.arange(len(of)) % FOLDS
        x = np.zeros((len(y), len(T.NAMES)))
        for k in np.unique(fold):
            x[fold == k] = T.features(pa.array(texts[fold == k].tolist(), pa.string()), *lists(fold != k))
        self.trees = T.BoostedTrees().fit(x, y)
        # calibration on margins by trees that have not seen the row either
        margin = np.zeros(len(y))
        for k in np.unique(fold):
            margin[fold == k] = T.BoostedTrees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.knots, self.values = T.isotonic(margin, y) if len(y) else (np.zeros(1), np.full(1, 0.5))
        return self

    def score(self, column) -> np.ndarray:
        """Calibrated probability, with a little of the tree margin left in so that ties of a step stay ordered."""
        m = self.trees.margin(T.features(column, self.lexicon, self.stems))
        step = np.interp(m, self.knots, self.values)
        return np.clip(step + 1e-6 / (1 + np.exp(-m)), 0, 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep=None, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    rows = T.training_rows(docs.filter(F.length("text") <= SAMPLE_CHARS), labels, "toxic", sample_rows, keep).sort_values("doc_id", ignore_index=True)
    model = ToxicityModel().fit(rows["text"].fillna(""), rows["y"].to_numpy(np.int64))
    del rows
    C.tidy()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per input row, whatever else the table holds.

    Null and empty texts get the score of a text without any feature. Repeated rows get equal scores.
    Without labelled rows every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(C.tidied(run), "doc_id long, score double, predicted int")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: its held_out is null, and nothing is learned from its row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, keep=~C.held_out(5, 0))
    return score_toxicity(docs, model).select("doc_id", C.held_out(5, 0).alias("held_out"), "score", "predicted")
