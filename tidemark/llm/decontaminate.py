"""Benchmark decontamination by template canonicalisation.

Words are runs of ASCII letters, digits and bytes beyond ASCII. Numbers, names (capitalised words that don't begin
a sentence) and units after numbers become typed placeholders; other words are lower-cased. A text has four forms:
its plain lower-case words (capitals may change); one placeholder a word; one placeholder a number, quantity or name
of any number of words; and the same with capitalised words that begin a sentence taken as names too. Windows of each
form are matched by hash against those of all benchmark items. An alignment is a chain of matches of one item: both
sides advance, and the diagonal (document word less item word) moves by at most SHIFT from one to the next, so
inserted, dropped and longer or shorter slots are passed. Its slots must be consistent: an item's value always stands
for the same value of the document. A document is contaminated if an alignment covers enough of an item's words.

The benchmark is taken in blocks of bounded size, each shared with all tasks; documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .text_features import word_hashes

WINDOW, LITERALS, COVER = 8, 0.5, 0.6
#: Characters of benchmark text in one block.
BLOCK_CHARS = 20_000_000
UNITS = "kg g mg lb lbs oz km m cm mm mi ft inch inches mile miles meter meters metre metres hour hours hr hrs minute minutes min mins second seconds sec secs day days week weeks month months year years percent pct dollar dollars usd eur euro euros cent cents pound pounds litre litres liter liters l ml gallon gallons kmh mph degree degrees stunden tage jahre euro heures jours ans horas dias años".split()
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
#: The forms of a text, and how far a diagonal may move between neighbouring matches, in words.
PLAIN, EACH, JOINED, OPENERS = range(4)
SHIFT = 8


def forms(raw: np.ndarray, at: np.ndarray, units: np.ndarray) -> list[tuple]:
    """(tokens, values, tokens before each row, first word of each token and past the last, which begin a sentence) in each form.

    A token is a placeholder or a lower-case word's hash, a value the hash of the lower-case words it stands for.
    """
    low = C.lower_ascii(raw)
    two = np.zeros(len(low), bool)
    two[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low = low + (two.astype(np.uint8) << 5)
    s, e, first = C.spans(C.ALNUM[low], at)
    value = C.span_hashes(low, s, e)
    words = np.arange(len(s) + 1)
    if not len(s):
        return [(value, value, first, words, np.zeros(0, bool))] * 4
    digit = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
    number = digit[e] - digit[s] == e - s
    up = (raw >= 65) & (raw <= 90)
    up[:-1] |= two[1:]
    ups = np.concatenate(([0], np.cumsum(up)))
    capital = up[s] & (ups[e] - ups[s] == 1) & (e - s > 1)
    # what ends a sentence between a word and the one before it
    stop = np.isin(raw, np.frombuffer(b'.!?:;\n"|*', np.uint8))
    stops = np.concatenate(([0], np.cumsum(stop)))
    begins = np.ones(len(s), bool)
    begins[1:] = stops[s[1:]] > stops[e[:-1]]
    begins[first[:-1][np.diff(first) > 0]] = True
    k = np.minimum(np.searchsorted(units, value), len(units) - 1)
    inner = np.ones(len(s), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    unit = np.zeros(len(s), bool)
    unit[1:] = (units[k] == value)[1:] & number[:-1] & inner[1:]
    # one byte between a word and the one before it
    gap = np.zeros(len(s), np.uint8)
    gap[1:] = np.where((s[1:] - e[:-1] == 1) & inner[1:], raw[e[:-1]], 0)
    out = [(value, value, first, words, begins)]
    for openers, join in ((False, False), (False, True), (True, True)):
        name = capital if openers else capital & ~begins
        token = value.copy()
        token[name] = NAME
        token[unit] = UNIT
        token[number] = NUMBER
        if not join:
            out.append((token, value, first, words, begins))
            continue
        glue = unit.copy()
        glue[1:] |= number[1:] & number[:-1] & np.isin(gap[1:], np.frombuffer(b".,:/'-", np.uint8))
        glue[1:] |= name[1:] & name[:-1] & ~begins[1:] & np.isin(gap[1:], np.frombuffer(b" -'", np.uint8))
        start = np.flatnonzero(~glue)
        place = words[:-1] - start[np.cumsum(~glue) - 1]
        joined = np.add.reduceat(C.mix(value + place.astype(np.uint64)), start)
        past = np.append(start[1:], len(s))
        out.append((token[past - 1], joined, np.searchsorted(start, first), np.append(start, len(s)), begins[start]))
    return out


def windows(token: np.ndarray, first: np.ndarray, n: int, slots: bool = False):
    """(place, hash) of the windows of n tokens inside rows that hold enough words that are not placeholders; with `slots`, a placeholder as well."""
    if len(token) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    literal = np.concatenate(([0], np.cumsum(token > UNIT)))
    held = literal[n:] - literal[:-n]
    ok = (row[n - 1 :] == row[: len(row) - n + 1]) & (held >= LITERALS * n)
    if slots:
        ok &= held < n
    place = np.flatnonzero(ok)
    h = np.zeros(len(place), np.uint64)
    for j in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + token[place + j] + np.uint64(j)
    return place, C.mix(h)


def _run_middles(key: np.ndarray, place: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which windows lie deep inside a stretch where windows recur after at most WINDOW words, tokens and values alike.

    key: hashes of windows and their values, by place; reach: words that an alignment through a window may span. An
    alignment that touches the middle is a translate of one near the start, and none reaches from one end to the other.
    """
    deep, n = np.zeros(len(key), bool), len(key)
    for p in range(1, WINDOW + 1):
        if n <= p:
            break
        same = (key[p:] == key[:-p]) & (place[p:] - place[:-p] == p)
        # the first and the last place of each window's stretch
        i = np.arange(n - p)
        low = np.maximum.accumulate(np.where(same, -1, i))
        high = np.minimum.accumulate(np.where(same, n, i)[::-1])[::-1]
        start = np.maximum(low + 1, 0)
        end = np.minimum(high, n - p) + p - 1
        # window i of the stretch of link i
        inner = same & (place[:-p] - place[start] > reach[:-p]) & (place[np.minimum(end, n - 1)] - place[:-p] > reach[:-p])
        deep[:-p] |= inner
    return deep


def _union(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers lie in the intervals [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    return int(np.maximum(b - np.maximum(a, np.append(a[0], b[:-1])), 0).sum())


def _chains(hits: np.ndarray, n: int, least: float):
    """(words covered, hits) of the best chain of an item's matches, then of the best without those, as long as `least` is covered.

    hits: first word and past the last of the document, then of the item, in columns.
    """
    left = np.arange(len(hits))
    while len(left) and _union(hits[left, 2], hits[left, 3]) >= least:
        diagonal = hits[left, 0] - hits[left, 2]
        left = left[np.lexsort((hits[left, 2], diagonal))]
        ds, de, js, je = hits[left, :4].T
        diagonal = ds - js
        # runs of overlapping or touching matches on one diagonal
        edge = np.flatnonzero(np.r_[True, (diagonal[1:] != diagonal[:-1]) | (js[1:] > je[:-1])])
        run = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(left))))
        low = np.stack([np.minimum.reduceat(x, edge) for x in (ds, js)])
        high = np.stack([np.maximum.reduceat(x, edge) for x in (de, je)])
        order = np.lexsort((low[1], low[0]))
        (d0, j0), (d1, j1) = low[:, order], high[:, order]
        since = np.searchsorted(d0, d0 - 2 * n - 2 * SHIFT)
        best, before = (j1 - j0).astype(np.int64), np.full(len(order), -1)
        for i in range(1, len(order)):
            p = slice(since[i], i)
            moved = np.minimum(abs((d0[i] - j0[i]) - (d0[p] - j0[p])), abs((d0[i] - j0[i]) - (d1[p] - j1[p])))
            fits = (moved <= SHIFT) & (d0[p] < d0[i]) & (j0[p] < j0[i]) & (d1[p] <= d1[i]) & (j1[p] <= j1[i])
            if fits.any():
                gain = np.where(fits, best[p] + j1[i] - np.maximum(j0[i], j1[p]), -1)
                k = int(gain.argmax())
                if gain[k] > best[i]:
                    best[i], before[i] = gain[k], since[i] + k
        i = int(best.argmax())
        if best[i] < least:
            return
        covered, chosen = int(best[i]), []
        while i >= 0:
            chosen.append(order[i])
            i = before[i]
        inside = np.isin(run, chosen)
        yield covered, left[inside]
        left = left[~inside]


class Benchmark:
    """The forms of a block of items, with sorted tables of their windows."""

    def __init__(self, items: list, texts: list, window: int, cover: float):
        self.items, self.window, self.cover = np.array(items, np.int64), window, cover
        self.units = np.sort(word_hashes(UNITS))
        data, at = C.utf8(pa.array(texts, pa.string()))
        self.forms = forms(data, at, self.units)
        self.first = self.forms[PLAIN][2]
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.tables = []
        for form, (token, _, first, *_) in enumerate(self.forms):
            # an item shorter than a window is a window of its own length, from three words; its opener stays a word
            n = np.diff(first)
            sizes = {window, *(n[(n >= 3) & (n < window)].tolist() if form != OPENERS else ())}
            self.tables += [(form, size, *self._table(token, first, size, form)) for size in sorted(sizes)]

    def _table(self, token, first, size, form):
        place, h = windows(token, first, size, form >= JOINED)
        if size < self.window:
            keep = np.isin(place, first[:-1][np.diff(first) == size])
            place, h = place[keep], h[keep]
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        if not len(h):
            return h, place, place
        # words of the longest item that holds a window
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        words = np.diff(self.first)[row[place]]
        return h, place, np.repeat(np.maximum.reduceat(words, edge), np.diff(np.append(edge, len(h))))

    def find(self, raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, float]]]:
        """For each row the contaminating items with their coverage."""
        doc = forms(raw, at, self.units)
        out: list[list] = [[] for _ in range(len(at) - 1)]
        first = doc[PLAIN][2]
        row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        parts = []
        for form, size, table, there, longest in self.tables:
            if not len(table):
                continue
            place, h = windows(doc[form][0], doc[form][2], size, form >= JOINED)
            lo = np.searchsorted(table, h, "left")
            hit = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == h)
            if not len(hit):
                continue
            lo = lo[hit]
            times = np.searchsorted(table, h[hit], "right") - lo
            if times.sum() > 2 * len(hit):
                # of long repeats only the ends: their middles have no alignment of their own
                values = np.zeros(len(hit), np.uint64)
                for j in range(size):
                    values = values * np.uint64(0xD6E8FEB86659FD93) + doc[form][1][place[hit] + j] + np.uint64(j)
                keep = ~_run_middles(C.mix(values) ^ h[hit], place[hit], (SHIFT + 2) * longest[lo] + 2 * self.window)
                hit, lo, times = hit[keep], lo[keep], times[keep]
            here = np.repeat(place[hit], times)
            j = there[np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
            theirs, ours = doc[form][3], self.forms[form][3]
            parts.append(np.stack([theirs[here], theirs[here + size], ours[j], ours[j + size], np.full(len(j), form), np.full(len(j), size), here, j], axis=1))
        if not parts:
            return out
        hits = np.concatenate(parts)
        r, item = row[hits[:, 0]], self.row[hits[:, 2]]
        order = np.lexsort((item, r))
        hits, r, item = hits[order], r[order], item[order]
        edge = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]), True])
        for a, b in zip(edge[:-1], edge[1:]):
            n = int(self.first[item[a] + 1] - self.first[item[a]])
            # as shares are compared elsewhere: covered / n >= cover
            if _union(hits[a:b, 2], hits[a:b, 3]) / n >= self.cover:
                share = self._share(hits[a:b], n, doc)
                if share >= self.cover:
                    out[r[a]].append((int(self.items[item[a]]), share))
        return out

    def _share(self, hits: np.ndarray, n: int, doc: list) -> float:
        """The largest share of an item that a consistent alignment covers, 0 if none covers enough."""
        least, best = self.cover * n - 1e-9, 0
        for covered, _ in _chains(hits[hits[:, 4] == PLAIN], n, least):
            best = max(best, covered)
            break
        if best == n:
            return 1.0
        each = hits[hits[:, 4] == EACH]
        diagonal = each[:, 0] - each[:, 2]
        order = np.argsort(diagonal, kind="stable")
        each, diagonal = each[order], diagonal[order]
        edge = np.flatnonzero(np.r_[True, diagonal[1:] != diagonal[:-1], True]) if len(each) else np.zeros(1, np.int64)
        # windows of a diagonal cover no more words than they hold
        most = np.diff(np.append(0, np.cumsum(each[:, 3] - each[:, 2]))[edge])
        for a, b in zip(edge[:-1][most >= least], edge[1:][most >= least]):
            one = each[a:b]
            covered = _union(one[:, 2], one[:, 3])
            if covered > best and covered >= least and self._consistent(one, doc):
                best = covered
        for covered, chosen in _chains(hits, n, max(least, best + 1)):
            if self._consistent(hits[chosen], doc):
                best = covered
                break
        return best / n

    def _consistent(self, hits: np.ndarray, doc: list) -> bool:
        """Each value in an item's slots stands for one value of the document.

        A word that begins a sentence may be no name: it counts only where its value is an item's name elsewhere too.
        """
        pairs = []
        for form, size in np.unique(hits[:, 4:6], axis=0):
            chosen = hits[(hits[:, 4] == form) & (hits[:, 5] == size)]
            ours, theirs = ((chosen[:, k, None] + np.arange(size)).ravel() for k in (7, 6))
            # plain words are equal on both sides, so a slot among them stands for itself
            token = self.forms[max(form, EACH)][0][ours]
            value, there, opener = self.forms[form][1][ours], doc[form][1][theirs], self.forms[form][4][ours]
            slot = token <= UNIT
            if form == OPENERS:
                sure = slot & ~((token == NAME) & opener)
                slot &= sure | np.isin(value, value[sure & (token == NAME)])
            kind = np.full(int(slot.sum()), 0 if form <= EACH else 1, np.uint64)
            pairs.append(np.stack([kind, token[slot], value[slot], there[slot]]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pairs.shape[1] == np.unique(pairs[:3], axis=1).shape[1]


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, cover: float):
    """How many blocks there are, and the blocks in turn; one lies in the driver's memory at a time. Texts of one item lie in one block."""
    chosen = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter("item is not null and text is not null")
    n = max(1, -(-(chosen.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))

    def block(i):
        rows = chosen.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i).collect()
        return Benchmark([r["item"] for r in rows], [r["text"] for r in rows], window, cover)

    return n, map(block, range(n))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, contaminated (0/1), n_items, item_id (best covered, smaller on ties; null if none), coverage: one row per input row.

    Null and empty texts are clean. Items without three words match nothing. Repeated rows get equal results;
    an empty benchmark leaves all clean; other columns are not read. Where the benchmark has several blocks, rows are
    numbered and written once, each block is a pass over them, and only hits are grouped by row.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n, blocks = benchmark_blocks(benchmark, item_id, item_text, window, cover)
    if n > 1:
        rows = C.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    results = []
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                data, at = C.utf8(batch.column(1))
                found = [x for _, _, part, cut in C.pieces(data, at) for x in shared.value.find(part, cut)]
                best = [min(((-c, i) for i, c in x), default=None) for x in found]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0), "n_items": pa.array([len({i for i, _ in x}) for x in found], pa.int64()),
                    "item_id": pa.array([b and b[1] for b in best], pa.int64()), "coverage": pa.array([-b[0] if b else 0.0 for b in best], pa.float64()),
                })

        one = rows.select("row" if n > 1 else "doc_id", "text").mapInArrow(C.tidied(run), "doc_id long, n_items long, item_id long, coverage double")
        if n > 1:
            one = C.materialize(one.filter("n_items > 0").withColumnRenamed("doc_id", "row"), "hits")
            shared.unpersist()
        results.append(one)
    out = results[0]
    if n > 1:
        for r in results[1:]:
            out = out.unionByName(r)
        rank = F.struct(F.col("coverage"), -F.col("item_id"))
        out = out.groupBy("row").agg(F.sum("n_items").alias("n_items"), F.max_by("item_id", rank).alias("item_id"), F.max("coverage").alias("coverage"))
        out = rows.select("row", "doc_id").join(out, "row", "left").selectExpr("doc_id", "coalesce(n_items, 0) as n_items", "item_id", "coalesce(coverage, 0D) as coverage")
    return out.selectExpr("doc_id", "cast(n_items > 0 as int) as contaminated", "n_items", "item_id", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that no benchmark item contaminates, with all columns, in one pass per block of the benchmark."""
    at_column = docs.columns.index(text)
    n, blocks = benchmark_blocks(benchmark, item_id, item_text, window, cover)
    for i, block in enumerate(blocks):
        if i:  # one block at a time in the tasks' memory
            docs = C.materialize(docs, "clean")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                data, at = C.utf8(batch.column(at_column))
                clean = [not x for _, _, part, cut in C.pieces(data, at) for x in shared.value.find(part, cut)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(C.tidied(run), docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
