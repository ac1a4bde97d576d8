"""Byte-level BPE and token counts against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from wardwise.llm import bpe, token_counts
from wardwise.llm.queries import BPE_RANKS, PIECES, op2_byte_bpe, op3_token_counts

RANKS = public_tokenizers.path(BPE_RANKS)
MODEL = public_tokenizers.path(PIECES)
PARTS = ["a", "b", " ", "'", "re", "ll", "\n", "  ", "1", "!", "é", "日本", "the ", "'ve", "\t", "ing", "%%%", "😀", "▁", "<s>", "\x00", "    ", "\x1c", " "]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    for _ in range(n):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60)))
        yield rnd.choice("a ex\n!") * rnd.randint(1, 300) + text if rnd.random() < 0.1 else text


def test_bpe_joins_equal_the_library(monkeypatch, library):
    """Tiny leaves, so that every text and match goes through many joins."""
    monkeypatch.setattr(bpe, "TEXT_LEAF", 8)
    monkeypatch.setattr(bpe, "BYTE_LEAF", 2)
    own = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    own.whole = {}
    for text in random_texts(2500):
        own.cache.clear()
        own.parts.clear()
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_every_token_is_its_own_encoding():
    own = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    own.whole = {}
    assert all(own.encode_bytes(t) == (r,) for t, r in own.ranks.items())


def test_bpe_halves_of_invented_words(library):
    """Words of pieces of words: most boundaries of halves lie inside a token."""
    own, rnd = bpe.bpe(RANKS, public_tokenizers.PATTERN), random.Random(6)
    syllables = "ach lich keit tion ment ness über ção ing ein ant qu zz x é ß 日 ov ski".split()
    for _ in range(4000):
        word = "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 12)))
        assert list(own.encode_bytes(word.encode())) == library.encode_ordinary(word) or len(own.split(word)) > 1


def test_bpe_long_runs(library):
    own = bpe.bpe(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 60_000, " " * 30_000, "ab" * 20_000, "x" * 9_999 + "é" * 77):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_frames(docs, no_docs, rows, library):
    odd = docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens * 4 == len(r.ids)
    once = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).select("doc_id", "ids", "n_tokens", "decoded")
    assert sorted(map(str, once.collect())) == sorted(str(r) for r in bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).select("doc_id", "ids", "n_tokens", "decoded").collect())
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_op2_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op2_byte_bpe(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_counts_equal_the_library(monkeypatch, pieces):
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "MAX_STATES", 3000)
    own = token_counts.PieceCounter(MODEL)
    for text in random_texts(2500, 2):
        assert own.count(text) == len(pieces.encode(text)), text


def test_chunk_maps_compose_associatively():
    own = token_counts.counter(MODEL)
    rnd = random.Random(4)
    for text in random_texts(300, 5):
        a, b, c = (own.chunk_map(text[i::3]) for i in range(3))
        left, right = own.compose(own.compose(a, b), c), own.compose(a, own.compose(b, c))
        state = rnd.choice([0, own.run("ab")[0], own.run(" th")[0]])
        for m in (left, right):
            s, n = own.run(m.head, state)
            assert (m.state if m.resets else s, n + m.count) == own.run("".join(text[i::3] for i in range(3)), state)


def test_count_frames(spark, docs, no_docs, rows, pieces, sf):
    out = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), MODEL).collect()
    assert len(out) == len(rows)
    assert all((r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in out)
    assert token_counts.count_tokens(no_docs, MODEL).count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_token_counts(spark, sf).collect():
        n = len(pieces.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit) == (n, n > 4096)
