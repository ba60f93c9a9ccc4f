"""Ranked lexical search by two trees.

Documents become vectors of impacts (what an occurrence of a term is worth in a document of that length), items
vectors of weights; a score is their product. In each task the vectors of some thousand documents form a tree, and so
do the items; a node holds the coordinate maxima of what lies below it, so the product of two nodes bounds every
score between them. Pairs of nodes are refined from the roots down. A pair goes as soon as its bound is below the
weakest kth score of the items below, which drops whole batches of documents for whole groups of items, exactly.

The first pass over the texts writes the vectors of item terms and, for each task, its counts of documents and terms.
The kth scores begin from an exact search of a bounded sample of documents: they only bound from below, every
document is searched afterwards. Items are taken in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

#: Characters of items in one block, each shared with all tasks.
BLOCK_CHARS = 1_000_000
#: Documents whose exact scores give the first bounds.
SEED_DOCS = 20_000
#: Children of a node. A task's chunk of documents is one tree.
DOC_FAN, ITEM_FAN = 4, 8
#: Levels of documents and items whose nodes are paired, from the roots down: items become single ones first, as their
#: maxima add up terms of all items below, while documents share most of theirs.
STEPS = ((6, 3), (5, 2), (4, 1), (3, 0), (2, 0), (1, 0))
CHUNK_TERMS = 2_000_000
#: Numbers in a dense tile.
TILE = 4_000_000
_EXACT = float(1 << 53)
VECTORS = "doc_id long, n long, terms array<int>, times array<int>, docs long"


class Rows:
    """Sparse rows: for row i the terms and values at [at[i], at[i + 1]). Terms of a row are distinct."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.at, self.term, self.value = at, term, value

    def __len__(self):
        return len(self.at) - 1

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(self.at)[rows]
        return np.repeat(np.arange(len(rows)), n), np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def take(self, rows: np.ndarray) -> Rows:
        row, place = self._places(rows)
        return Rows(np.searchsorted(row, np.arange(len(rows) + 1)), self.term[place], self.value[place])

    def maxima(self, fan: int, terms: int) -> Rows:
        """One row for each `fan` rows: its terms with their largest values."""
        node = np.repeat(np.arange(len(self)), np.diff(self.at)) // fan
        key = node * terms + self.term
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        value = np.maximum.reduceat(self.value[order], edge) if len(key) else self.value
        node, term = np.divmod(key[edge], terms)
        return Rows(np.searchsorted(node, np.arange(-(-len(self) // fan) + 1)), term, value)

    def by_term(self, terms: int) -> None:
        """Prepare columns(): the rows of each term."""
        order = np.argsort(self.term, kind="stable")
        self.row, self.held = np.repeat(np.arange(len(self)), np.diff(self.at))[order], self.value[order]
        self.since = np.searchsorted(self.term[order], np.arange(terms + 1))

    def columns(self, terms: np.ndarray) -> np.ndarray:
        """The matrix of all rows and some terms."""
        n = self.since[terms + 1] - self.since[terms]
        place = np.repeat(self.since[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros((len(self), len(terms)))
        out[self.row[place], np.repeat(np.arange(len(terms)), n)] = self.held[place]
        return out

    def sketch(self, weight: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """A few random projections of each row: rows that share heavy terms lie near each other."""
        part = (self.value * weight[self.term])[:, None] * signs[self.term]
        total = np.concatenate((np.zeros((1, signs.shape[1])), np.cumsum(part, axis=0)))
        return total[self.at[1:]] - total[self.at[:-1]]


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of a kd-tree's leaves: halves by the widest projection, cut at multiples of `leaf`."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        width = np.ptp(points[rows], axis=0)
        half = -(-len(rows) // (2 * leaf)) * leaf
        rows = rows[np.argsort(points[rows, int(width.argmax())], kind="stable")]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Items:
    """The tree of a block of items. Weighted values are whole numbers below 2^53, so products of doubles are exact."""

    def __init__(self, at, term, times, weight, k: int):
        self.k, self.weight, self.terms = k, weight, len(weight)
        self.steps, self.tile, self.chunk = STEPS, TILE, DOC_FAN ** STEPS[0][0]
        self.signs = np.random.default_rng(7).choice([-1.0, 1.0], (max(self.terms, 1), 8))
        rows = Rows(at, term, times * weight[term].astype(float))
        sums = np.add.reduceat(np.append(rows.value, 0.0), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0)
        if len(sums) and sums.max() * 1e6 >= _EXACT:
            raise ValueError("an item has too many terms for exact scores")
        #: The item in each place of the tree.
        self.order = tree_order(rows.sketch(np.ones(self.terms), self.signs), ITEM_FAN) if len(rows) else np.zeros(0, np.int64)
        self.levels = [rows.take(self.order)]
        for _ in range(self.steps[0][1]):
            self.levels.append(self.levels[-1].maxima(ITEM_FAN, max(self.terms, 1)))
        #: Of each level, groups of neighbouring nodes: (first, past the last, terms, weights by term).
        self.groups = [[self._group(rows, lo) for lo in range(0, len(rows), ITEM_FAN)] for rows in self.levels]

    @staticmethod
    def _group(rows: Rows, lo: int):
        hi = min(len(rows), lo + ITEM_FAN)
        part = slice(rows.at[lo], rows.at[hi])
        terms, column = np.unique(rows.term[part], return_inverse=True)
        weights = np.zeros((len(terms), hi - lo))
        weights[column, np.repeat(np.arange(hi - lo), np.diff(rows.at[lo : hi + 1]))] = rows.value[part]
        return lo, hi, terms, weights


class Search:
    """The k best documents of every item so far, while chunks of documents pass."""

    def __init__(self, items: Items, least: np.ndarray | None = None):
        self.items, n = items, len(items.order)
        self.score = np.zeros((n, items.k))
        self.doc = np.zeros((n, items.k), np.int64)
        self.null = np.zeros((n, items.k), bool)
        self.least = np.ones(n) if least is None else np.maximum(least[items.order], 1.0)  # scores of 0 are none
        self.pairs = self.scored = 0

    def _products(self, docs: Rows, d: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Document nodes d times a group of item nodes. Each product is a sum of whole numbers, the same in any order."""
        step, out = max(1, self.items.tile // max(1, len(docs))), np.zeros((len(d), weights.shape[1]))
        for lo in range(0, len(terms), step):
            out += docs.columns(terms[lo : lo + step])[d] @ weights[lo : lo + step]
        return out

    def add(self, docs: Rows, ids: np.ndarray, null: np.ndarray) -> None:
        """Search a chunk of at most items.chunk documents."""
        items, terms = self.items, max(self.items.terms, 1)
        order = tree_order(docs.sketch(items.weight.astype(float), items.signs), DOC_FAN)
        levels = [docs.take(order)]
        steps = items.steps
        for _ in range(steps[0][0]):
            levels.append(levels[-1].maxima(DOC_FAN, terms))
        for level in levels:
            level.by_term(terms)
        ids, null = ids[order], null[order]
        n = len(items.order)
        alive = np.ones((len(levels[steps[0][0]]), len(items.levels[steps[0][1]])), bool)
        for (dl, il), (dn, i_n) in zip(steps, [*steps[1:], (0, 0)]):
            weakest = np.minimum.reduceat(self.least, np.arange(0, n, ITEM_FAN**il))
            for lo, hi, used, weights in items.groups[il]:
                d = np.flatnonzero(alive[:, lo:hi].any(1))
                if len(d):
                    alive[d, lo:hi] &= self._products(levels[dl], d, used, weights) >= weakest[lo:hi]
            self.pairs += int(alive.sum())
            alive = alive.repeat(DOC_FAN ** (dl - dn), 0)[: len(levels[dn])].repeat(ITEM_FAN ** (il - i_n), 1)[:, : len(items.levels[i_n])]
        self.scored += int(alive.sum())
        for lo, hi, used, weights in items.groups[0]:
            d = np.flatnonzero(alive[:, lo:hi].any(1))
            if not len(d):
                continue
            score = self._products(levels[0], d, used, weights)
            for item in range(lo, hi):
                new = np.flatnonzero(score[:, item - lo] >= self.least[item])
                if len(new):
                    self._keep(item, score[new, item - lo], ids[d[new]], null[d[new]])

    def _keep(self, item: int, score, doc, null) -> None:
        score, doc, null = (np.concatenate((a[item], b)) for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
        best = np.lexsort((doc, null, -score))[: self.items.k]
        self.score[item], self.doc[item], self.null[item] = score[best], doc[best], null[best]
        self.least[item] = max(self.least[item], score[best[-1]])

    def results(self) -> pa.RecordBatch:
        place, rank = np.nonzero(self.score > 0)
        return pa.RecordBatch.from_arrays([
            pa.array(self.items.order[place]), pa.array(self.doc[place, rank], mask=self.null[place, rank]), pa.array(self.score[place, rank].astype(np.int64)),
        ], names=["item", "doc_id", "score"])


def _terms(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all rows, and how many lie before each row."""
    data, at = C.utf8(column)
    low = C.lower_ascii(data)
    s, e, first = C.spans(C.ALNUM[low], at)
    return C.span_hashes(low, s, e), first


def _vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows of VECTORS: a document's item terms with their times; and for each task a row with `docs`, its number of
    documents with terms, where n counts all their terms and `times` the documents with each term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [x.split()[0] for x in VECTORS.split(", ")]

    def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches):
        known = shared.value
        size = len(known)
        held, docs_with, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            _, at = C.utf8(batch.column(1))
            for lo, hi, *_ in C.pieces(np.zeros(0, np.uint8), at):
                h, first = _terms(batch.column(1).slice(lo, hi - lo))
                n = np.diff(first)
                docs_with, total = docs_with + int((n > 0).sum()), total + int(n.sum())
                place = np.minimum(np.searchsorted(known, h), size - 1)
                hit = np.flatnonzero(known[place] == h)
                key, times = np.unique(np.searchsorted(first, hit, "right").astype(np.int64) * size - size + place[hit], return_counts=True)
                row, term = np.divmod(key, size)
                held += np.bincount(term, minlength=size)
                rows = np.unique(row)
                at_row = np.searchsorted(row, np.append(rows, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), lists(term, at_row), lists(times, at_row), pa.nulls(len(rows), pa.int64())], names=names)
        have = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64()), lists(have, np.array([0, len(have)])), lists(held[have], np.array([0, len(have)])), pa.array([docs_with], pa.int64())], names=names)

    return docs.mapInArrow(C.tidied(run), VECTORS)


def _search(vectors: DataFrame, block, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): what each task's documents have for the k best of each item."""

    def run(batches):
        items, least = block.value
        found = Search(items, least)
        held, size = [], 0

        def flush():
            n, ids, null, at, terms, times = (np.concatenate(x) for x in zip(*held))
            at = np.append(0, np.cumsum(at))
            m = 25 + 75 * n * n_docs // n_terms
            impact = 1_000_000_000 * times // (1000 * times + 8 * np.repeat(m, np.diff(at)))
            for lo in range(0, len(n), items.chunk):
                hi = min(len(n), lo + items.chunk)
                part = slice(at[lo], at[hi])
                found.add(Rows(at[lo : hi + 1] - at[lo], terms[part], impact[part].astype(float)), ids[lo:hi], null[lo:hi])

        for batch in batches:
            if not batch.num_rows:
                continue
            doc, n, terms, times = batch.columns[:4]
            held.append((n.to_numpy(), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)))
            size += len(held[-1][4])
            if sum(len(x[0]) for x in held) >= items.chunk or size >= CHUNK_TERMS:
                flush()
                held, size = [], 0
        if held:
            flush()
        if len(items.order):
            yield found.results()

    return vectors.mapInArrow(C.tidied(run), "item long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0, ties to smaller doc_ids.

    Terms are runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased, and compared by 64-bit
    hashes. Null and empty texts have no terms and no results. Rows that repeat a doc_id are documents of their own;
    those without a doc_id come last among equal scores. Texts of one item_id, null included, are one item. Empty
    tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        names = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(names)}
        h, first = _terms(pa.array([r["text"] for r in rows], pa.string()))
        vocabulary, term = np.unique(h, return_inverse=True)
        if not len(vocabulary):
            continue
        owner = np.repeat(np.array([number[r["item_id"]] for r in rows], np.int64), np.diff(first))
        key, times = np.unique(owner * len(vocabulary) + term, return_counts=True)
        owner, term = np.divmod(key, len(vocabulary))
        vectors = C.materialize(_vectors(chosen, vocabulary), "vectors")
        counts = vectors.filter("docs is not null")
        total = counts.agg(F.sum("docs"), F.sum("n")).first()
        n_docs, n_terms = total[0] or 0, total[1] or 0
        # one row a term of this block
        held = counts.select(F.explode(F.arrays_zip("terms", "times")).alias("x")).groupBy("x.terms").agg(F.sum("x.times").alias("df")).collect()
        if not held:
            C.discard(vectors)
            continue
        weight = np.zeros(len(vocabulary), np.int64)
        for r in held:
            weight[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        tree = Items(np.searchsorted(owner, np.arange(len(names) + 1)), term, times, weight, k)
        only = vectors.filter("docs is null")
        least = None
        if n_docs > 4 * SEED_DOCS:
            share = n_docs // SEED_DOCS
            first_block = spark.sparkContext.broadcast((tree, None))
            seed = _best(_search(only.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0), first_block, n_docs, n_terms), k)
            least = np.ones(len(names))
            for r in seed.filter(F.col("rank") == k).select("item", "score").collect():
                least[r["item"]] = r["score"]
        shared = spark.sparkContext.broadcast((tree, least))
        best = _best(_search(only, shared, n_docs, n_terms), k)
        ids = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
        out = out.unionByName(best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from words group by all),
lengths as (select doc_id, sum(tf)::bigint as n from tf group by all),
total as (select count(*) as docs, sum(n)::bigint as terms from lengths),
df as (select term, count(*) as df from tf group by all),
asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
  group by all),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, total),
m as (select doc_id, 100 - 75 + ((75 * n * docs) // terms) as m from lengths, total),
scores as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (term) join tf using (term) join m using (doc_id) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""
