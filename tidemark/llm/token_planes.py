"""Token ids in bit- or byte-plane blocks.

Documents are laid out in ascending doc_id over range partitions; each partition is a shard, a stream of 32-bit
ids with an end id after every document. The stream is cut into blocks of a fixed number of ids. A block is
transposed into planes (byte j, or bit j, of every id together), each plane is compressed with zstandard, and its
row carries the chunk index: place in the shard, checksum, and which documents lie in it from where.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_IDS = 1 << 16
#: Distinct pieces of text in a generation of a worker's memory; it holds two, some 30 bytes a piece.
REMEMBERED = 400_000
#: New pieces that are encoded in one call.
TOGETHER = 1024
FILE_SCHEMA = "shard long, block long, n_ids long, crc32 long, planes array<binary>, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>"

#: Bytes that may begin white space; a space is cut before only if none follows, so it is the last of its run.
_MAYBE_SPACE = C.SPACE.copy()
_MAYBE_SPACE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters and digits, and the marks between which and them every token ends; an apostrophe may begin one that goes on.
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~_PLAIN[33:127]
_MARK[39] = False
_BREAK = 10


def piece_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start, so that no rule of the byte-level pre-tokenizer crosses: at texts, before the last white space
    of a run, between plain letters or digits and marks, and around a lone line break."""
    cut = np.zeros(len(data), bool)
    cut[:-1] = (data[:-1] == 32) & ~_MAYBE_SPACE[data[1:]]
    # a space that ends a text has no next byte of its own
    ends = at[1:][np.diff(at) > 1] - 1
    cut[ends[data[ends] == 32]] = False
    plain, mark = _PLAIN[data], _MARK[data]
    cut[1:] |= (plain[:-1] & mark[1:]) | (mark[:-1] & plain[1:])
    solid = plain | mark
    lone = np.flatnonzero((data[1:-1] == _BREAK) & solid[:-2] & solid[2:]) + 1
    cut[lone] = True
    cut[lone + 1] = True
    cut[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(cut)


class Memory:
    """Ids of pieces by 64-bit hash: sorted hashes, and where each piece's ids lie in one flat array."""

    def __init__(self):
        self.key, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, i, -1)

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each place has, and all of them."""
        return self.n[i], self.ids[_runs(self.at[i], self.n[i])]

    def add(self, key: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        keys = np.concatenate((self.key, key))
        order = np.argsort(keys, kind="stable")
        self.key, self.n = keys[order], np.concatenate((self.n, n))[order]
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(n) - n))[order]
        self.ids = np.concatenate((self.ids, ids))


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, n of them."""
    total = np.cumsum(n)
    return np.repeat(start - (total - n), n) + np.arange(total[-1] if len(n) else 0)


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes. Each distinct piece is encoded once and remembered.

    The memory has two generations: pieces that are met go to the young one; once that is full it becomes the old one,
    and what the old one held that was not met again is forgotten.
    """

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # their strings in a text are ordinary text
        self.tokenizer.encode_special_tokens = True
        self.young, self.old, self.remembered = Memory(), Memory(), remembered
        # a token of a byte-level vocabulary is written with one character a byte
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them. Pieces without white space but a first space are encoded many at
        a time, a line break between any two: the tokens' lengths tell where each ends. The others are encoded one by one."""
        space = np.concatenate(([0], np.cumsum(_MAYBE_SPACE[data])))
        one = start + ((data[start] == 32) & (end - start > 1))
        joint = np.flatnonzero(space[end] == space[one])
        found: list = [None] * len(start)
        size = end[joint] - start[joint] + 1
        past = np.cumsum(size)
        text = np.full(past[-1] if len(joint) else 0, _BREAK, np.uint8)
        text[_runs(past - size, size - 1)] = data[_runs(start[joint], size - 1)]
        edge = np.append(past[::TOGETHER] - size[::TOGETHER], len(text))
        calls = [text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:])]
        n = np.zeros(len(start), np.int64)
        for k, encoded in enumerate(self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            ends = np.cumsum(self.n_bytes[ids])
            which = joint[k * TOGETHER : (k + 1) * TOGETHER]
            cuts = np.searchsorted(ends, past[k * TOGETHER : k * TOGETHER + len(which)] - edge[k])
            lows = np.append(0, cuts[:-1] + 1)
            n[which] = cuts - lows
            keep = np.ones(len(ids), bool)
            keep[cuts] = False
            found[which[0]] = ids[keep]
        rest = np.setdiff1d(np.arange(len(start)), joint, assume_unique=True)
        alone = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[rest], end[rest])]
        parts = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        n[rest] = [len(x) for x in parts]
        # joint pieces lie together in `found`, the others apart: bring all into the order of the pieces
        flat = np.concatenate([np.zeros(0, "<u4"), *[x for x in found if x is not None], *parts])
        order = np.concatenate((joint, rest))
        at = np.empty(len(start), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return n, flat[_runs(at, n)]

    def encode(self, column) -> list[bytes]:
        """For each text of an Arrow column, or list, its ids. Pieces are told apart by 64-bit hashes, and looked up once for all texts."""
        data, at = C.utf8(pa.array(column, pa.string()) if isinstance(column, list) else column)
        return [x for _, _, part, cut in C.pieces(data, at) for x in self._encode(part, cut)]

    def _encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        start = piece_cuts(data, at) if len(data) else np.zeros(0, np.int64)
        if not len(start):
            return [b""] * (len(at) - 1)
        end = np.append(start[1:], len(data))
        u, one, which = np.unique(C.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.young.key) > self.remembered:
            self.young, self.old = Memory(), self.young
        new = np.flatnonzero(self.young.find(u) < 0)
        if len(new):
            place = self.old.find(u[new])
            again, never = new[place >= 0], new[place < 0]
            self.young.add(u[again], *self.old.get(place[place >= 0]))
            if len(never):
                self.young.add(u[never], *self.learn(data, start[one[never]], end[one[never]]))
        where = self.young.find(u)
        each = self.young.n[where][which]
        out = self.young.ids[_runs(self.young.at[where][which], each)]
        # how many ids lie before each text
        before = np.append(0, np.cumsum(each))[np.searchsorted(start, at)]
        whole = out.tobytes()
        return [whole[x:y] for x, y in zip((4 * before[:-1]).tolist(), (4 * before[1:]).tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    import zstandard

    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = as_bytes.T
    z = zstandard.ZstdCompressor(level=3)
    return [z.compress(np.ascontiguousarray(r).tobytes()) for r in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    import zstandard

    z = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(z.decompress(p), np.uint8) for p in planes]) if n else np.zeros((4, 0), np.uint8)
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str, text: str, kind: str, block_ids: int, shards: int | None = None) -> DataFrame:
    """The rows of the file format, a shard per range partition of doc_id."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        held, block, at, open_docs = b"", 0, 0, []  # ids not yet in a block; where the next document starts; documents that reach into the next block

        def cut(ids: bytes, docs: list):
            x = np.frombuffer(ids, "<u4")
            return {"shard": [shard], "block": [block], "n_ids": [len(x)], "crc32": [zlib.crc32(ids)], "planes": [to_planes(x, kind)], "doc_ids": [[d[0] for d in docs]], "doc_starts": [[d[1] for d in docs]], "doc_lengths": [[d[2] for d in docs]]}

        def emit(last: bool):
            nonlocal held, block, open_docs
            size = 4 * block_ids
            while len(held) >= size or (last and held):
                hi = block * block_ids + min(len(held), size) // 4
                yield pa.RecordBatch.from_pydict(cut(held[:size], [d for d in open_docs if d[1] < hi]), schema=schema)
                open_docs = [d for d in open_docs if d[1] + d[2] > hi]
                held, block = held[size:], block + 1

        schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                new = []
                for key, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1))):
                    new += [ids, end]
                    n = len(ids) // 4 + 1
                    open_docs.append((key, at, n))
                    at += n
                held = b"".join([held, *new])
                yield from emit(False)
        yield from emit(True)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # rows of one doc_id stand in the order of their texts, whichever task writes them
    chosen = chosen.withColumn("tie", F.xxhash64("text"))
    return chosen.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(C.tidied(run), FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", kind: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Write all documents' ids under `path`. Null texts are empty and still get the end id; null doc_ids come first.

    Rows that repeat a doc_id are documents of their own, in the order of a hash of their texts. An empty table writes no blocks. Other columns are not read.
    """
    encode_blocks(docs, tokenizer_path, end_id, doc_id, text, kind, block_ids).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and on request ids (little-endian uint32 bytes).

    A block's checksum is verified. Documents inside one block come from it alone; pieces of those that cross
    blocks are put together by a grouping.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                ids = from_planes(list(r.planes), r.n_ids).tobytes()
                if zlib.crc32(ids) != r.crc32:
                    raise ValueError(f"shard {r.shard}, block {r.block}: wrong checksum")
                low = r.first
                for key, start, n in zip(r.doc_ids, r.doc_starts, r.doc_lengths):
                    part = ids[4 * max(0, start - low) : 4 * max(0, start + n - low)]
                    whole = len(part) == 4 * n
                    rows.append((r.shard, key, start, n, zlib.crc32(part) if whole else None, part if with_ids or not whole else None, r.block))
            yield pd.DataFrame(rows, columns=["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids", "block"]).astype({"doc_id": "Int64", "ids_crc32": "Int64"})

    # blocks have a fixed size, all but the last of a shard, so a block's place follows from its number
    size = blocks.groupBy("shard").agg(F.max("n_ids").alias("size"), F.sum("n_ids").alias("total"))
    sizes = C.materialize(size.selectExpr("shard", "size", "sum(total) over (order by shard) - total as before"), "shards")
    schema = "shard long, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary, block long"
    placed = blocks.join(F.broadcast(sizes.select("shard", "size")), "shard").withColumn("first", F.col("block") * F.col("size")).select("shard", "block", "n_ids", "crc32", "planes", "first", *[F.col(c) for c in ("doc_ids", "doc_starts", "doc_lengths")])
    parts = C.materialize(placed.mapInPandas(C.tidied(run), schema), "parts")
    whole = parts.filter("ids_crc32 is not null").drop("block")

    def put_together(key, pdf):
        ids = b"".join(pdf.sort_values("block")["ids"])
        return pd.DataFrame({"shard": [key[0]], "doc_id": [pdf["doc_id"].iloc[0]], "at": [key[1]], "n_tokens": [pdf["n_tokens"].iloc[0]], "ids_crc32": [zlib.crc32(ids)], "ids": [ids if with_ids else None]})

    crossing = parts.filter("ids_crc32 is null").groupBy("shard", "at").applyInPandas(put_together, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    out = whole.unionByName(crossing).join(F.broadcast(sizes.select("shard", "before")), "shard")
    return out.selectExpr("doc_id", "at + before as start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op7_token_planes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
