"""What the text operators share: scratch tables, byte-level word spans, components of a link graph."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of text that one vectorized pass takes; a longer document goes alone.
PIECE = 1_000_000


_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode where none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        where = _OWN[0]
    return where.rstrip("/")


#: Lists that take the paths of tables as they are written.
_TRACKED: list[list[str]] = []


@contextlib.contextmanager
def tracked():
    """A list of the tables that are written inside, to be deleted by discard_paths() once nothing reads them."""
    paths: list[str] = []
    _TRACKED.append(paths)
    try:
        yield paths
    finally:
        _TRACKED[:] = [x for x in _TRACKED if x is not paths]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for paths in _TRACKED:
        paths.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: a written table in the shared folder, so that a lost executor loses nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    discard_paths(df.sparkSession, [df._scratch_path])


def discard_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fetch_by_id(docs: DataFrame, wanted: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """Inner join of wide rows with a list of keys: the list is broadcast only if it counts at most `most` rows."""
    small = wanted.limit(most + 1).count() <= most
    return docs.join(F.broadcast(wanted) if small else wanted.hint("shuffle_merge"), key)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join of two narrow tables. Small ones would else each be sent through the driver, whose memory many such joins fill."""
    return df.hint("shuffle_merge")


def tidy() -> None:
    """Give freed memory back: Python workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A mapInArrow or mapInPandas function that tidies up after each partition."""

    def wrapped(batches):
        yield from run(batches)
        tidy()

    return wrapped


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Fewer rows in an Arrow batch than by default: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def held_out(n: int, rest: int, key: str = "doc_id"):
    return (F.crc32(F.col(key).cast("string")) % n) == rest


_HASHES = 1 << 62


def _below(most: int, n: int) -> int:
    """A bound of 62-bit hashes that a little more than `most` of n keys lie below."""
    return _HASHES if n <= most else min(_HASHES, _HASHES * (2 * most + 200) // n)


def bounded_sample(df: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """`most` of the rows, those with the smallest hashes; all of them if there are no more.

    With `by`, of which there must be few values, each value has an equal part of them; what rare ones leave goes to
    the others. A bound on the hash follows from a count of all rows, so that few more are written; where the rows
    below it don't suffice, it is widened. The hash takes all columns, so repeated or null keys are thinned like
    others. Of rows that are equal in all columns one stands for all where rows have to be thinned.
    """
    spark = df.sparkSession
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(7)).bitwiseAND(F.lit(_HASHES - 1))
    group = F.col(by) if by else F.lit(0)
    counts = {r["_by"]: r["count"] for r in df.groupBy(group.alias("_by")).count().collect()}
    if sum(counts.values()) <= most:
        return df
    quota, left, kinds = {}, most, len(counts)
    for value, n in sorted(counts.items(), key=lambda x: (x[1], str(x[0]))):
        quota[value] = min(n, max(1, left // kinds))
        left, kinds = left - quota[value], kinds - 1
    bound = {v: _below(q, counts[v]) for v, q in quota.items()}
    kind = df.schema[by].dataType.simpleString() if by else "int"
    while True:
        table = spark.createDataFrame([(v, q, bound[v]) for v, q in quota.items()], f"_by {kind}, _quota long, _below long")
        near = df.withColumn("_h", h).join(F.broadcast(table), group.eqNullSafe(F.col("_by"))).filter("_h < _below")
        near = materialize(near.dropDuplicates(["_by", "_h"]), "sample")
        have = {r["_by"]: r["count"] for r in near.groupBy("_by").count().collect()}
        short = [v for v, q in quota.items() if have.get(v, 0) < q and bound[v] < _HASHES]
        if not short:
            break
        discard(near)
        for v in short:
            bound[v] = min(_HASHES, 8 * bound[v])
    place = F.row_number().over(W.partitionBy("_by").orderBy("_h", key))
    return near.withColumn("_place", place).filter("_place <= _quota").select(*df.columns)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts (n + 1 offsets). Null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, most: int = PIECE):
    """(first row, past the last row, bytes, offsets) of runs of whole rows with about `most` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Letters, digits and all bytes of characters beyond ASCII, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where `inside` holds, none across rows, and how many runs lie before each row."""
    if len(inside) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, at)


_B = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size, inverse = max(n, PIECE + 65_536), pow(_B, -1, 1 << 64)
        for name, base in (("p", _B), ("i", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[name] = np.cumprod(x)
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a polynomial by prefix sums, then mixed with the length."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within rows, and how many lie before each row. A row of 1 to k-1 words gives one for all of them."""
    n = np.diff(first)
    each = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    before = np.concatenate(([0], np.cumsum(each)))
    start = np.repeat(first[:-1] - before[:-1], each) + np.arange(before[-1])
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    have = np.repeat(np.minimum(n, k), each)
    h = np.zeros(len(start), np.uint64)
    for j in range(k):
        w = padded[start + j]
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(have > j, w + np.uint64(j + 1), np.uint64(0))
    return mix(h + have.astype(np.uint64)), before


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an undirected edge list reaches.

    Alternating large-star and small-star steps, each a join-free grouped minimum; every step is a written
    table, so the plan stays short. The number of steps grows with the logarithm of a component's size.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    e = materialize(e, "cc")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(by_shuffle(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(by_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        same = e.count() == new.count() and new.exceptAll(e).isEmpty()
        discard(e)
        e = new
        if same:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
