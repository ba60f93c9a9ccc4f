"""Byte-level BPE by prefixes against the tokenizer library: texts, appends, edits, odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

WHERE = P.path("byte_bpe_50k.tiktoken")
ALPHABETS = ["ab", "a b'", "aeiou \n\t", "abcdefgh re'sl!", "日本é  　x", "aaaaaaa", " =-#_\n0123", "\x1c\x85  a.", "'sSdD' tTlL"]
ROW = "doc_id long, text string, ids string, n_tokens int, decoded long, lang string"
ROWS = [(0, None), (1, ""), (2, " "), (3, "Hello  world\n\n it's 42%"), (3, "Hello  world\n\n it's 42%"), (None, "no id"), (4, "日本語 ß \x00 \U0001f600"), (5, "<|endoftext|> as text"), (6, "x" * 60_000), (7, " =" * 20_000 + "   \n"), (8, "one long " * 9_000)]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    from tidemark.llm.byte_bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(WHERE), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    from tidemark.llm.byte_bpe import codec

    return codec(WHERE, P.PATTERN)


def random_text(r):
    alphabet = r.choice(ALPHABETS)
    return "".join(r.choice(alphabet) for _ in range(r.randint(0, r.choice([10, 100, 1500]))))


def test_texts_like_the_library(codec, reference):
    r = random.Random(5)
    texts = [random_text(r) for _ in range(400)] + [t for _, t in ROWS]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [reference.encode_ordinary(t or "") for t in texts]


def test_every_prefix_ends_with_its_last_token(codec, reference):
    for piece in (b"unbelievable", b" internationalization", b"aaaaaaaaaaa", "日本語日本語".encode(), b"========-==="):
        last = codec.merges.whole(piece)
        for n in range(1, len(piece) + 1):
            assert last[n - 1] == reference._encode_single_piece(piece[:n])[-1]


def test_neighbours(codec, reference):
    m, r = codec.merges, random.Random(2)
    for _ in range(3000):
        a, b = r.randrange(50_000) if r.random() < 0.5 else r.randrange(2_000), r.randrange(2_000)
        assert m.may_follow(a, b) == (reference._encode_single_piece(m.bytes_of[a] + m.bytes_of[b]) == [a, b])


def test_tokens_that_merges_do_not_reach():
    import tiktoken

    from tidemark.llm.byte_bpe import Codec, Merges

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257, b"aba": 258, b"bab": 259, b"cc": 260, b"ccc": 261, b"cccc": 262}
    cod, lib = Codec(Merges(ranks), P.PATTERN), tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert b"xyz" not in cod.merges.reached
    r = random.Random(1)
    for t in ["xyz", " xyz", "xyzxyz", "xyz xyz1xyz", *("".join(r.choice("abcxyz ") for _ in range(r.randint(1, 12))) for _ in range(500))]:
        want = lib.encode_ordinary(t)
        assert cod.prefixes(t).ids() == want and np.frombuffer(cod.encode([t])[0], "<u4").tolist() == want, t


def test_edits_and_appends_are_exact(codec, reference):
    r = random.Random(11)
    for _ in range(500):
        alphabet = r.choice(ALPHABETS)
        t = random_text(r)
        p = codec.prefixes(t)
        for _ in range(4):
            at = r.choice([len(t), r.randint(0, len(t))])
            removed = min(r.choice([0, 0, 1, 5, 50]), len(t) - at)
            new = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 10])))
            p.edit(len(t[:at].encode()), len(t[at : at + removed].encode()), new)
            t = t[:at] + new + t[at + removed :]
            whole = codec.prefixes(t)
            assert p.text == t.encode() and p.ids() == reference.encode_ordinary(t), t
            assert p.last == whole.last and p.starts == whole.starts, t


def test_edits_work_near_the_edit(codec):
    words = " ".join(f"word{i % 97} and" for i in range(20_000))
    p = codec.prefixes(words)
    assert p.edit(100_000, 3, "xyz") < 100 and p.append(" more") < 30
    # inside one piece: only until the tables agree again
    p = codec.prefixes("ab" * 50_000)
    assert p.edit(50_001, 1, "q") < 2_000


def test_frames(spark, reference):
    from tidemark.llm import byte_bpe as B

    docs = spark.createDataFrame([(i, t, "x", 1, 2, "en") for i, t in ROWS], ROW)
    encoded = B.encode_texts(docs, WHERE, P.PATTERN)
    assert encoded.columns == ["doc_id", "decoded", "lang", "n_tokens", "ids"]
    got = B.decode_ids(encoded, WHERE, P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == sorted((str(i), len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in ROWS for ids in [reference.encode_ordinary(t or "")])
    assert B.decode_ids(B.encode_texts(docs.limit(0), WHERE, P.PATTERN), WHERE, P.PATTERN).count() == 0
    assert [bytes(r["decoded"]) for r in B.decode_ids(spark.createDataFrame([(None,)], "ids binary"), WHERE, P.PATTERN).collect()] == [b""]


def test_stored_tables_and_edits(spark, reference):
    from tidemark.llm import byte_bpe as B
    from tidemark.llm import common as C

    rows = [(i, t) for i, t in ROWS if i != 7]
    tables = C.materialize(B.prefix_tables(spark.createDataFrame(rows, "doc_id long, text string"), WHERE, P.PATTERN), "prefixes")
    edits = [(3, 1, 5, 2, " "), (3, 0, 999, 0, " appended"), (4, 0, 1, 1, None), (99, 0, 0, 0, "nobody"), (0, 0, None, None, "now a text"), (8, 0, 40_000, 4, "THERE"), (6, 0, 30_000, 0, "y")]
    got = B.edit_texts(tables, spark.createDataFrame(edits, "doc_id long, seq long, at long, removed long, inserted string"), WHERE, P.PATTERN).collect()

    def after(i, t):
        for _, _, at, removed, new in sorted((e for e in edits if e[0] == i), key=lambda e: e[1]):
            at = min(at or 0, len(t))
            t = t[:at] + (new or "") + t[at + (removed or 0) :]
        return t

    want = sorted((str(i), after(i, t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == want
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) // 4
        assert (r["worked"] == 0) == (r["doc_id"] not in (3, 4, 0, 8, 6)) or r["doc_id"] == 4
    assert {r["doc_id"]: r["worked"] for r in got}[8] < 100


def test_query(spark, reference):
    import __spark_entry__ as E

    got = {r["doc_id"]: r for r in E.queries()["op11_prefix_bpe"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, x = reference.encode_ordinary(r["text"] or ""), got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
