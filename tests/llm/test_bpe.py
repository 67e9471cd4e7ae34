"""Encoding against the tiktoken library, decoding as a round trip."""
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from sheetmetric.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def encoded(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.rank_encoder(PATH, P.PATTERN).encode(texts)]


def test_characters(library):
    texts = [f"a{chr(c)}b {chr(c)}1" for c in (*range(0x3400), *range(0x3400, 0xD800, 61), *range(0xE000, 0x110000, 997))]
    assert encoded(texts) == list(map(library.encode_ordinary, texts))


def test_mixtures(library):
    draw = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "the", " the", ".", "\t", "　", "日本", "<|endoftext|>", "\0"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(40))) for _ in range(3000)]
    assert encoded(texts) == list(map(library.encode_ordinary, texts))


def test_long_pieces(library):
    draw = random.Random(6)
    texts = ["a" * 50_000, "ab" * 4000, "xyx" * 999, " " * 3000 + "x", *("".join(draw.choices("etaoinshr", k=n)) for n in (3, 63, 64, 65, 66, 700, 9000))]
    texts.append("".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(2000)))
    assert encoded(texts) == list(map(library.encode_ordinary, texts))


def test_forgetting_words(library):
    encoder = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN, limit=5)
    for k in range(40):
        text = " ".join(f"w{i} common" for i in range(k, k + 9))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_each_match_is_merged_once(monkeypatch):
    """Marks and line breaks around a word make no new words of it: over all calls, as many pieces are merged as there are distinct matches."""
    encoder, merged = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN), []
    encode = encoder.vocabulary.encode
    monkeypatch.setattr(encoder.vocabulary, "encode", lambda pieces: merged.extend(pieces) or encode(pieces))
    calls = [[f"vorqx{a} zimbl{b}{m}\nvorqx{a}{m} zimbl{b}" for a in "abcd" for b in "efgh"] for m in (".", ",", "!?", "...", ";")]
    for texts in calls:
        encoder.encode(texts)
    assert sorted(merged) == sorted({m.encode() for texts in calls for t in texts for m in regex.findall(P.PATTERN, t)})


def test_cut():
    """Matches and their numbers as by the pattern itself, with texts side by side; other patterns are searched as they are."""
    draw = random.Random(14)
    parts = ["a", "Zé", "s", "t", "re", "r", "ve", "ll", "l", "m", "d", "'", "'", "''", " ", " ", "  ", "\n", "\t", "\r\n", "\u3000", "\x85", "\x1c", "1", "²", "ⅷ", "-", "...", "日本", "\0", "😀", "\u0301"]
    for pattern in (P.PATTERN, r"\S+|\s"):
        encoder = bpe.Encoder(bpe.read_ranks(PATH), pattern)
        assert (encoder.kinds is not None) == (pattern == P.PATTERN)
        for _ in range(300):
            texts = ["".join(draw.choices(parts, k=draw.choice([0, 1, 2, 3, 5, 30]))) for _ in range(draw.randrange(1, 30))]
            found = [regex.findall(pattern, t) for t in texts]
            matches, ends = encoder.cut(texts)
            assert [m.decode() for m in matches.to_pylist()] == [m for f in found for m in f]
            assert ends.tolist() == np.cumsum(list(map(len, found))).tolist()


def test_texts_that_are_cut_at_once(monkeypatch):
    encoder = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
    texts = ["", "one two", "x" * 90, "", " it's\n", "é" * 70 + " 1", ""]
    whole = encoder.encode(texts)
    assert whole == [encoder.encode([t])[0] for t in texts] and encoder.encode([]) == []
    monkeypatch.setattr(bpe, "CHARACTERS", 8)
    assert encoder.encode(texts) == whole
    assert max(map(len, encoder.words)) <= 64        # long matches are not remembered


def test_merges_that_open_lower_ranks():
    """A merge may open a pair of lower rank; then single steps and joint steps still agree."""
    draw = random.Random(7)
    ranks = {bytes([b]): b for b in range(256)}
    tokens = sorted({"".join(draw.choices("abc", k=draw.randrange(2, 5))).encode() for _ in range(60)})
    draw.shuffle(tokens)
    ranks |= {t: 256 + i for i, t in enumerate(tokens)}
    vocabulary = bpe.Vocabulary(ranks)
    for _ in range(60):
        piece = "".join(draw.choices("abc", k=90)).encode()
        ids = [ranks[bytes([b])] for b in piece]
        while True:
            pairs = [(ranks.get(vocabulary.tokens[a] + vocabulary.tokens[b], 10**9), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
            rank, i = min(pairs)
            if rank == 10**9:
                break
            ids[i:i + 2] = [rank]
        assert np.frombuffer(vocabulary._long(piece), "<u4").tolist() == ids
        assert np.frombuffer(vocabulary._matrix([piece], 96)[0], "<u4").tolist() == ids


def test_tables(spark, library):
    rows = [(1, "Hello the world"), (None, "x"), (2, None), (3, ""), (1, "Hello the world"), (4, "y " * 30_000)]
    docs = spark.createDataFrame([(i, t, "a", 7) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    found = {(r[0], r[1], r[2], r[3]) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == want
    assert bpe.round_trip(docs, PATH, P.PATTERN).count() == len(rows)
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []
    lists = bpe.encode_texts(docs, PATH, P.PATTERN)
    assert sorted(map(bytes, (r["bytes"] for r in bpe.decode_ids(lists, PATH, P.PATTERN).collect()))) == sorted((t or "").encode() for _, t in rows)
