"""Runs of repeated words by an online sparse diagonal dynamic program.

A diagonal is a lag; its match length at a word is how many words in a row equal the word that lag before them. As
words come in, an earlier occurrence at some lag opens the diagonal, every further match increments it, and where it
ends with enough matches a run is emitted there and then. Only diagonals that can still become a run of their own are
opened, so that a text of one repeated line costs no more than others:

* A run of period q has at least q matches, and at least 12 - q. Of q matches in a row, w = (q + 1) // 2 at a time
  start at a multiple of w somewhere: only there is the occurrence q words before looked up, by a hash of w words.
  These are some n log n look-ups for n words, all of them in arrays.
* While a run of period p is active, lags that are multiples of p and no longer than the run break where it breaks:
  their runs would be this one again, with a period that is not the smallest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of the shortest run. It must be 12 or more for runs of period 1 to 6 to hold six matches in a row.
SHORTEST = 12
#: Matches in a row that every run has: SHORTEST - q for periods q up to half of it, q beyond.
GRAM = SHORTEST // 2
_MUL = np.uint64(0xD6E8FEB86659FD93)


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, one for each start."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        h = h * _MUL + words[j : j + n]
    return C.mix(h)


def repeats_a_gram(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row whether GRAM words in a row occur twice in it. No other row has a run."""
    n = np.diff(first)
    out = np.zeros(len(n), bool)
    each = np.maximum(n - GRAM + 1, 0)
    if not each.sum():
        return out
    row = np.repeat(np.arange(len(n)), each)
    h = _grams(words, GRAM)[np.repeat(first[:-1], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
    # the row joins the hash, so that equal values are repeats inside a row
    key = C.mix(h ^ (row.astype(np.uint64) * _MUL))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (row[order[1:]] == row[order[:-1]]))
    out[row[order[same]]] = True
    return out


def _openings(words: np.ndarray) -> tuple[list[int], list[int]]:
    """(place, lag) of the look-ups that hit, by place: w words from there on equal those that lag before."""
    n = len(words)
    grams = _grams(words, GRAM)
    have = len(grams)
    # places with an earlier occurrence of their gram: all others open nothing
    order = np.argsort(grams, kind="stable")
    again = order[1:][grams[order[1:]] == grams[order[:-1]]]
    if not len(again):
        return [], []
    places, lags = [], []
    for q in range(1, min(2 * GRAM, n - 1) + 1):
        i = again[again >= q]
        i = i[grams[i] == grams[i - q]]
        # the first of matches in a row is enough
        hit = np.sort(i)
        hit = hit[np.r_[True, np.diff(hit) > 1]] if len(hit) else hit
        places.append(hit)
        lags.append(np.full(len(hit), q))
    # longer periods: w matches at a multiple of w. The first six of them are compared first
    seen = np.zeros(have, bool)
    seen[again] = True
    # hashes of any number of words by prefix sums of a polynomial: a shift by a lag is a factor
    power, back = C._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    low, most = 2 * GRAM + 1, n // 2
    while low <= most:
        high = min(most, low + max(1, 4_000_000 * low // (2 * n)))
        q = np.arange(low, high + 1)
        w = (q + 1) // 2
        # multiples of w from q on, as far as w words fit
        from_k, to_k = -(-q // w), (n - w) // w
        each = np.maximum(to_k - from_k + 1, 0)
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(from_k, each)
        lag, i = np.repeat(q, each), k * np.repeat(w, each)
        keep = seen[i]
        lag, i = lag[keep], i[keep]
        keep = grams[i] == grams[i - lag]
        lag, i = lag[keep], i[keep]
        # and then all w
        w = (lag + 1) // 2
        keep = (total[i + w] - total[i]) * back[lag] == total[i - lag + w] - total[i - lag]
        places.append(i[keep])
        lags.append(lag[keep])
        low = high + 1
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lag, place))
    return place[order].tolist(), lag[order].tolist()


def find_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period.

    A run is a stretch with smallest period q and length >= max(SHORTEST, 2 * q) that no neighbouring word extends.
    """
    numbers = np.asarray(words, np.uint64)
    places, lags = _openings(C.mix(numbers + np.uint64(1))) if len(numbers) > GRAM else ([], [])
    n, at, k = len(words), 0, 0
    active: dict[int, int] = {}  # lag -> where its run starts
    runs: list[tuple[int, int, int]] = []

    def ended(closed: list[tuple[int, int]], end: int) -> None:
        """Emit the runs that end before a word: of several on the same stretch, the one of the smallest period."""
        whole: dict[int, int] = {}
        for q, start in closed:
            if end - start >= max(SHORTEST, 2 * q):
                whole[start] = min(q, whole.get(start, q))
        runs.extend((start, end - start, q) for start, q in whole.items())

    while at < n:
        if not active:
            if k == len(places):
                break
            at = max(at, places[k])  # nothing happens before the next opening
        while k < len(places) and places[k] <= at:
            i, q = places[k], lags[k]
            k += 1
            if q in active or any(q % p == 0 and i - start >= q for p, start in active.items()):
                continue
            # matches before the opening count as well
            j = i - q
            while j > 0 and words[j - 1] == words[j - 1 + q]:
                j -= 1
            active[q] = j
        word = words[at]
        closed = [(q, start) for q, start in active.items() if words[at - q] != word]
        if closed:
            for q, _ in closed:
                del active[q]
            ended(closed, at)
        at += 1
    ended(list(active.items()), n)
    return sorted((s, length, q) for s, length, q in runs)


def words_dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def joined_words(data: np.ndarray, at: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of every row joined by one space, and where each row's bytes start."""
    lengths = e - s
    inner = np.ones(len(s), np.int64)
    inner[first[:-1][np.diff(first) > 0]] = 0
    size = lengths + inner
    past = np.cumsum(size)
    out = np.full(int(past[-1]) if len(past) else 0, 32, np.uint8)
    inside = C.SPACE[data]
    np.logical_not(inside, out=inside)
    keep = np.ones(len(out), bool)
    keep[(past - size)[inner == 1]] = False
    out[keep] = data[inside]
    return out.tobytes(), np.append(0, past)[first]


def planted_loop(h: int, n: int) -> tuple[int, int] | None:
    """(a, p) by which the registered query loops the words of one document in ten from word a on."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"


def collapse_runs(docs: DataFrame, text: str = "text", loop: str | None = None, outputs: tuple[str, ...] = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")) -> DataFrame:
    """The rows of `docs` without the text, and their runs of repeated words.

    Words are runs of bytes other than ASCII white space. n_runs, the longest run (ties: smallest start, then period;
    null without runs) with floor(1000 * length / period), all runs by start and period, and the text without what
    runs repeat, its words joined by one space. `loop` names a column of unsigned numbers by which words are looped
    first, see planted_loop(). Null and empty texts have no words, no runs and an empty rest. Repeated rows fare
    alike, other columns pass (but for those that clash with an output), an empty table stays empty. No shuffle;
    a text lies in one task's memory.
    """
    keep = [c for c in docs.columns if c not in (text, loop, *outputs)]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string"), F.col(loop).cast("long") if loop else F.lit(None).cast("long"))
    extra = {x.split(" ", 1)[0]: x.split(" ", 1)[1] for x in OUT.replace("array<struct<start:long,length:long,period:long>>", "R").split(", ")}
    extra = {k: v.replace("R", "array<struct<start:long,length:long,period:long>>") for k, v in extra.items()}
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(None).cast(extra[c]).alias(c) for c in outputs]).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            data, at = C.utf8(batch.column(len(keep)))
            loops = batch.column(len(keep) + 1).to_pylist()
            rows: dict[str, list] = {c: [] for c in outputs}
            for lo, hi, part, cut in C.pieces(data, at):
                for row in _collapse(part, cut, loops[lo:hi], outputs):
                    for c, v in zip(outputs, row):
                        rows[c].append(v)
            columns = [pa.array(rows[c], arrow.field(c).type) for c in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], schema=arrow)

    return chosen.mapInArrow(C.tidied(run), schema)


_EMPTY = hashlib.sha256(b"").hexdigest()


def _collapse(data: np.ndarray, at: np.ndarray, loops: list, outputs: tuple[str, ...]):
    s, e, first = C.spans(~C.SPACE[data], at)
    words = C.span_hashes(data, s, e)
    twice = repeats_a_gram(words, first)
    whole, cut = joined_words(data, at, s, e, first)
    del words
    for row in range(len(at) - 1):
        n = int(first[row + 1] - first[row])
        rest, runs = whole[cut[row] : cut[row + 1]], []
        loop = None if loops[row] is None else planted_loop(loops[row], n)
        if loop or twice[row]:
            mine = rest.split(b" ")
            if loop:
                a, p = loop
                mine[a:] = (mine[a : a + p] * (-(-(n - a) // p)))[: n - a]
                rest = b" ".join(mine)
            number: dict[bytes, int] = {}
            runs = find_runs([number.setdefault(w, len(number)) for w in mine])
            if runs:
                dropped = words_dropped(n, runs)
                rest = b" ".join([w for w, d in zip(mine, dropped.tolist()) if not d])
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        out = {"n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2]}
        if "runs" in outputs:
            out["runs"] = [{"start": a, "length": b, "period": c} for a, b, c in runs]
        if "collapsed" in outputs:
            out["collapsed"] = rest.decode()
        if "runs_sha256" in outputs:
            out["runs_sha256"] = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest() if runs else _EMPTY
        if "collapsed_sha256" in outputs:
            out["collapsed_sha256"] = hashlib.sha256(rest).hexdigest()
        yield [out[c] for c in outputs]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("loop"))
    return collapse_runs(docs, loop="loop", outputs=("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
