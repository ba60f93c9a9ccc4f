"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece (one match of the pattern) there is one token that ends the encoding of that prefix.
The last token of a prefix is the only token that ends there, whose start is a prefix of its own, and that may follow
that prefix's last token: two tokens may be neighbours if no merge across their border comes before the merges that
made them. The table of last tokens answers every prefix, grows byte by byte, and behind an edit agrees with the old
table again as soon as it has done so for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_planes import Encoder, Memory, _runs

#: Distinct pieces in a generation of a worker's memory, and neighbours whose verdict it keeps.
REMEMBERED, NEIGHBOURS = 800_000, 1_000_000
_NEVER = 1 << 60


class Merges:
    """The vocabulary by bytes, and of each token the two it is merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.parts: list[tuple[int, int] | None] = [None] * size
        #: Tokens that merging reaches; the others stand only for a piece that equals them.
        self.reached: dict[bytes, int] = {}
        self.of_pair: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token, i)
                if len(parts) != 2:
                    continue
                self.parts[i] = (parts[0], parts[1])
                self.of_pair[self.parts[i]] = i
            self.reached[token] = i
        #: The lengths of tokens by their last two bytes, longest first: no others need to be tried where they stand.
        by_end: dict[bytes, set[int]] = {}
        for token in self.reached:
            by_end.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {end: sorted(n, reverse=True) for end, n in by_end.items()}
        self.longest = max(map(len, ranks), default=1)
        self.verdicts: dict[int, bool] = {}

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The tokens that merges of ranks below a bound make of some bytes."""
        ranks = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], _NEVER))
            if ranks.get(parts[best] + parts[best + 1], _NEVER) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b together are encoded as these two.

        Goes back in time: of the two tokens at the border, the one made later gives way to its own part at the
        border. Meanwhile a merge across the border must not come before either is merged further.
        """
        key = (a << 32) | b
        known = self.verdicts.get(key)
        if known is not None:
            return known
        parts, of_pair = self.parts, self.of_pair
        until_a = until_b = _NEVER  # when the token at the border is merged further
        fits = True
        while True:
            made = of_pair.get((a, b))
            # of equal merges the left one comes first
            if made is not None and made < until_a and made <= until_b:
                fits = False
                break
            from_a, from_b = parts[a], parts[b]
            if from_b is not None and (from_a is None or b >= a):
                until_b, b = b, from_b[0]
            elif from_a is not None:
                until_a, a = a, from_a[1]
            else:
                break
        if len(self.verdicts) >= NEIGHBOURS:
            self.verdicts.clear()
        self.verdicts[key] = fits
        return fits

    def extend(self, piece: bytes, last: list[int], past: int | None = None) -> None:
        """Append the last tokens of the prefixes of a piece that `last` doesn't have yet."""
        reached, lengths, verdicts, may_follow = self.reached, self.lengths, self.verdicts, self.may_follow
        for end in range(len(last) + 1, (len(piece) if past is None else past) + 1):
            for n in lengths.get(piece[end - 2 : end], ()) if end > 1 else ():
                if n < end:
                    token = reached.get(piece[end - n : end])
                    if token is not None:
                        before = last[end - n - 1]
                        fits = verdicts.get(before << 32 | token)
                        if may_follow(before, token) if fits is None else fits:
                            break
                elif n == end and (token := reached.get(piece[:end])) is not None:
                    break
            else:
                # a byte alone, which every prefix may end with if nothing longer does
                token = reached.get(piece[end - 1 : end])
                if token is None or end > 1 and not may_follow(last[end - 2], token):
                    raise ValueError(f"no token of the vocabulary ends with byte {piece[end - 1]}")
            last.append(token)

    def whole(self, piece: bytes) -> list[int]:
        """The last tokens of a piece; where the piece is a token that no merges reach, that token is the last of the whole."""
        last: list[int] = []
        self.extend(piece, last)
        token = self.ranks.get(piece)
        if token is not None:
            last[-1] = token
        return last

    def walk(self, last) -> list[int]:
        """The tokens of a run of whole pieces: from the end, each token's length tells where the one before it ends."""
        ids, at = [], len(last)
        while at:
            ids.append(int(last[at - 1]))
            at -= len(self.bytes_of[ids[-1]])
        return ids[::-1]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Prefixes:
    """A text's bytes, the last token of every byte prefix within its piece, and where the pieces start."""

    def __init__(self, codec: Codec, text: bytes = b"", last=(), starts=()):
        self.codec, self.text, self.last, self.starts = codec, text, list(last), list(starts)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), 0, more)

    def ids(self) -> list[int]:
        return self.codec.merges.walk(self.last)

    def _safe(self, at: int) -> int:
        """How many leading pieces an edit at a byte leaves as they are: a match looks no further than three bytes past
        its own start, or one character past the white space that follows its end."""
        text = self.text
        k = bisect_right(self.starts, at)
        while k > 0:
            start = self.starts[k - 1]
            end = self.starts[k] if k < len(self.starts) else len(text)
            see = end
            while see < at and text[see] in _BLANK:
                see += 1
            # a character has four bytes at most
            if max(see, start) + 4 <= at:
                break
            k -= 1
        return k

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Replace bytes [at, at + removed) by a text; returns how many prefixes were worked out anew."""
        merges, pattern = self.codec.merges, self.codec.pattern
        new = inserted.encode()
        text = self.text[:at] + new + self.text[at + removed :]
        moved, same_from = len(new) - removed, at + len(new)
        keep = self._safe(at)
        low = self.starts[keep] if keep < len(self.starts) else len(self.text) if keep else 0
        last, starts, place, worked = self.last[:low], self.starts[:keep], low, 0
        for m in pattern.finditer(text[low:].decode("utf-8", "surrogatepass")):
            if place >= same_from:
                # from an old start behind the edit on, all is as it was
                old = bisect_left(self.starts, place - moved)
                if old < len(self.starts) and self.starts[old] == place - moved:
                    last += self.last[place - moved :]
                    starts += [s + moved for s in self.starts[old:]]
                    break
            piece = m[0].encode()
            if not piece:
                continue
            starts.append(place)
            mine = self._old_prefixes(place, len(piece), at)
            known = len(mine)
            worked += self._again(piece, mine, place, same_from, moved)
            worked -= known
            token = merges.ranks.get(piece)
            if token is not None:
                mine[-1] = token
            last += mine
            place += len(piece)
        self.text, self.last, self.starts = text, last, starts
        return worked

    def _old_prefixes(self, place: int, size: int, at: int) -> list[int]:
        """Last tokens that a piece has from before the edit: it starts where an old one did, and they lie before the edit."""
        old = bisect_left(self.starts, place)
        if place >= at or old == len(self.starts) or self.starts[old] != place:
            return []
        end = self.starts[old + 1] if old + 1 < len(self.starts) else len(self.text)
        # the last place of a whole piece may hold a token that merging doesn't reach
        return self.last[place : min(at, end - 1, place + size)]

    def _again(self, piece: bytes, mine: list[int], place: int, same_from: int, moved: int) -> int:
        """Extend over a piece until it agrees with the old one for the length of the longest token, and copy the rest; returns how far it got."""
        merges, longest = self.codec.merges, self.codec.merges.longest
        tail = same_from - place  # the bytes of the piece from here on are old ones
        old = bisect_right(self.starts, same_from - moved) - 1
        end = 0
        if old >= 0 and tail > 0:
            end = self.starts[old + 1] if old + 1 < len(self.starts) else len(self.text)
        if tail <= 0 or end + moved - place != len(piece) or len(piece) - tail <= 2 * longest:
            merges.extend(piece, mine)
            return len(mine)
        agreed, began = 0, self.starts[old]
        for k in range(len(mine), len(piece)):
            merges.extend(piece, mine, k + 1)
            there = place + k - moved
            agreed = agreed + 1 if k >= tail + longest and there - began > longest and self.last[there] == mine[-1] else 0
            if agreed >= longest and k + 1 < len(piece):
                mine += self.last[there + 1 : end]
                return k + 1
        return len(mine)


_BLANK = frozenset(np.flatnonzero(C.SPACE).tolist()) | {0x1C, 0x1D, 0x1E, 0x1F} | set(range(0x80, 0xC0)) | {0xC2, 0xE1, 0xE2, 0xE3}


class Codec:
    """Encoder and decoder of a worker; pieces that were met are remembered, see Encoder."""

    def __init__(self, merges: Merges, pattern: str):
        import regex

        self.merges, self.pattern = merges, regex.compile(pattern)
        lengths = np.array([len(x) for x in merges.bytes_of], np.int64)
        self.length, self.at = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(merges.bytes_of), np.uint8)
        self.pieces = _Pieces(self)

    def encode(self, column) -> list[bytes]:
        return self.pieces.encode(column)

    def prefixes(self, text: str) -> Prefixes:
        out = Prefixes(self)
        out.append(text)
        return out

    def decode(self, column: pa.Array) -> pa.Array:
        """The bytes of each row of ids (little-endian unsigned 32-bit integers)."""
        data = [x or b"" for x in column.to_pylist()]
        ids = np.frombuffer(b"".join(data), "<u4").astype(np.int64)
        if len(ids) and ids.max() >= len(self.length):
            raise ValueError(f"id {ids.max()} is not in the vocabulary")
        n = self.length[ids]
        out = self.flat[_runs(self.at[ids], n)]
        before = np.append(0, np.cumsum(n))[np.cumsum([0, *(len(x) // 4 for x in data)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


class _Pieces(Encoder):
    """Stretches of text that no match of the pattern crosses, each matched and encoded once."""

    def __init__(self, codec: Codec):
        self.codec, self.young, self.old, self.remembered = codec, Memory(), Memory(), REMEMBERED

    def learn(self, data, start, end):
        find, merges = self.codec.pattern.finditer, self.codec.merges
        parts: list[list[bytes]] = []
        for a, b in zip(start.tolist(), end.tolist()):
            piece = data[a:b].tobytes()
            plain = piece[1:] if piece[:1] == b" " else piece
            # letters behind at most one space are one match
            parts.append([piece] if plain.isalpha() else [m[0].encode() for m in find(piece.decode()) if m[0]])
        known: dict[bytes, list[int]] = {}
        # in order, pieces share their first bytes, and the last tokens of these prefixes, with the piece before
        before, last = b"", []
        for piece in sorted({x for p in parts for x in p}):
            shared = 0
            for x, y in zip(before, piece):
                if x != y:
                    break
                shared += 1
            before, last = piece, last[:shared]
            merges.extend(piece, last)
            token = merges.ranks.get(piece)
            known[piece] = merges.walk(last) if token is None else [token]
        n = np.array([sum(len(known[x]) for x in p) for p in parts], np.int64)
        return n, np.array([i for p in parts for x in p for i in known[x]], "<u4")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process; the vocabulary is a file of fixed size that every node has."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(Merges(read_ranks(ranks_path)), pattern)
    return _CODECS[ranks_path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of `docs` with `n_tokens` and `ids` (little-endian unsigned 32-bit integers) in place of the text.

    Null and empty texts have no ids. Special tokens' strings are ordinary text. Repeated rows, nulls in other columns
    and empty tables pass as they are; columns named n_tokens or ids are replaced. No shuffle. The pattern must be
    one that crosses none of the cuts of `token_planes.piece_cuts`, as the byte-level patterns of public vocabularies.
    """
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]

    def run(batches):
        enc = codec(ranks_path, pattern)
        for batch in batches:
            ids = enc.encode(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids")).schema
    return chosen.mapInArrow(C.tidied(run), schema)


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with a column of the bytes that their ids stand for; null ids are none, unknown ids raise."""
    keep = [c for c in rows.columns if c != into]
    at = keep.index(ids)

    def run(batches):
        dec = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, dec.decode(batch.column(at))], names=[*keep, into])

    plain = rows.select(*[F.col(f"`{c}`") for c in keep])
    return plain.mapInArrow(C.tidied(run), plain.withColumn(into, F.lit(b"")).schema)


STORED = "doc_id long, text string, last binary, starts binary, ids binary, n_tokens long, worked long"


def prefix_tables(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, last (the last token of every byte prefix), starts (bytes at which pieces start), ids, n_tokens, worked.

    What edit_texts() needs to encode changed texts near their changes. Null texts are empty.
    """

    def run(batches):
        cod = codec(ranks_path, pattern)
        for batch in batches:
            rows = [(k, t, p, len(p.last)) for k, t, p in ((k, t or "", cod.prefixes(t or "")) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
            yield _stored(rows)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(C.tidied(run), STORED)


def _stored(rows) -> pa.RecordBatch:
    ids = [p.ids() for _, _, p, _ in rows]
    columns = [[r[0] for r in rows], [r[1] for r in rows], *[[np.array(x, "<u4").tobytes() for x in y] for y in ([r[2].last for r in rows], [r[2].starts for r in rows], ids)], [len(x) for x in ids], [r[3] for r in rows]]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


_NAMES = [x.split()[0] for x in STORED.split(", ")]


def edit_texts(tables: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Tables of prefix_tables() after edits (doc_id, seq, at, removed, inserted); `worked` counts the prefixes that were worked out anew.

    `at` and `removed` count characters of the text as it is when the edit's turn comes, in the order of seq; both are
    cut to the text, null is 0, and a null `inserted` is empty. To append, give an `at` past the end. Edits of unknown
    documents do nothing; every row of a repeated doc_id gets its edits. Rows without edits pass with worked 0.
    """
    changes = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("at"), F.lit(0)).cast("long").alias("at"), F.coalesce(F.col("removed"), F.lit(0)).cast("long").alias("removed"), F.coalesce(F.col("inserted"), F.lit("")).alias("inserted")).alias("change"))
    listed = changes.groupBy("doc_id").agg(F.sort_array(F.collect_list("change")).alias("changes"))
    joined = tables.select(*_NAMES[:6]).join(listed, "doc_id", "left").select(*_NAMES[:6], "changes")

    def run(batches):
        cod = codec(ranks_path, pattern)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                p, t = Prefixes(cod, r["text"].encode(), np.frombuffer(r["last"], "<u4").tolist(), np.frombuffer(r["starts"], "<u4").tolist()), r["text"]
                worked = 0
                for c in r["changes"] or ():
                    at = min(max(c["at"], 0), len(t))
                    removed = min(max(c["removed"], 0), len(t) - at)
                    worked += p.edit(len(t[:at].encode()), len(t[at : at + removed].encode()), c["inserted"])
                    t = t[:at] + c["inserted"] + t[at + removed :]
                rows.append((r["doc_id"], t, p, worked))
            if rows:
                yield _stored(rows)

    return joined.mapInArrow(C.tidied(run), STORED)


def op11_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    where = P.path("byte_bpe_50k.tiktoken")
    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), where, P.PATTERN)
    return decode_ids(encoded, where, P.PATTERN).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
