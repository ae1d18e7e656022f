"""Piece segmentation against brute force, round trips and awkward rows."""

import zlib

import numpy as np
import pytest

from skipjack.llm.pieces import MARKER, DoubleArray, Encoder, Pieces, decode_pieces, encode_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", " ", "  ", " a", "a ", "a  b\nc", "The quick brown fox.", f"x{MARKER}y {MARKER} z", "日本語 ü ß 🙂 \x00\t", "w" * 300, "a" + " " * 40 + "b", None, " private"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(MODEL)


def test_double_array_finds_every_key():
    keys = [((1, 2, 3), 0), ((1, 2), 1), ((1,), 2), ((3, 1), 3), ((2, 2, 2, 2), 4), ((70000, 1), 5)]
    trie = DoubleArray(keys)
    for codes, value in keys:
        state = np.zeros(1, np.int64)
        for c in codes:
            state = trie.step(state, np.array([c]))
            assert state[0] >= 0
        assert trie.value[state[0]] == value
    assert trie.step(np.zeros(1, np.int64), np.array([4]))[0] == -1


def brute(pieces, chunk):
    table = {p: pieces.scores[i] for i, (p, _, k) in enumerate(pieces.table) if k == "normal"}
    best = [0.0] + [-1e300] * len(chunk)
    for i in range(len(chunk)):
        best[i + 1] = max(best[i + 1], best[i] + pieces.fallback)
        for j in range(i + 1, min(len(chunk), i + pieces.longest) + 1):
            if chunk[i:j] in table:
                best[j] = max(best[j], best[i] + table[chunk[i:j]])
    return best[-1]


def test_segmentation_is_best(pieces):
    rng = np.random.default_rng(2)
    chunks = [MARKER + "".join(rng.choice(list("aeinrst日üß"), int(rng.integers(1, 25)))) for _ in range(200)]
    for chunk, ids in zip(chunks, pieces.segment(chunks), strict=True):
        score, k = 0.0, 0
        while k < len(ids):
            if pieces.table[ids[k]][2] == "byte":
                n = 1
                while k + n < len(ids) and pieces.table[ids[k + n]][2] == "byte" and int(pieces.table[ids[k + n]][0][3:5], 16) & 0xC0 == 0x80:
                    n += 1
                score, k = score + pieces.fallback, k + n
            else:
                score, k = score + pieces.scores[ids[k]], k + 1
        assert abs(score - brute(pieces, chunk)) < 1e-6


def test_round_trip_and_memory_bound(pieces):
    texts = [t or "" for t in TEXTS]
    for bound in (10**6, 0):
        own = Encoder(pieces, bound)
        for _ in range(2):
            ids, offsets = own.encode(texts)
            assert [pieces.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == texts


def test_whole_text_equals_chunks(pieces):
    text = "the cat  sat   on"
    ids, _ = Encoder(pieces).encode([text])
    whole = pieces.segment([MARKER + text.replace(" ", MARKER)])[0]
    assert abs(sum(pieces.scores[ids]) - sum(pieces.scores[whole])) < 1e-9


def test_query_shape(spark):
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in enumerate(TEXTS)] + [(0, "again", "x", 5)], "doc_id long, text string, ids string, n_pieces int")
    out = encode_pieces(docs, MODEL)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["round_trip"] for r in rows)
    assert all(r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], np.int32).tobytes()) for r in rows)
    back = {r["doc_id"]: r["text"] for r in decode_pieces(out.where("doc_id > 0"), MODEL).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS) if k}
    assert encode_pieces(docs.limit(0), MODEL).count() == 0
