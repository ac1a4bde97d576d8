"""SentencePiece ids, spans and decoded texts against the public library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_tokens import PARTS, random_texts
from wardwise.llm import sentence_pieces
from wardwise.llm.queries import PIECES, op11_sentence_pieces
from wardwise.llm.sentence_pieces import SentencePieces, _fields

MODEL = public_tokenizers.path(PIECES)
ODD = ["①", "ﬁ", "½", "é", "Å", "　", " ", "ｶﾞ", "한", "㍿", "​", "ß", "…", "¨", "﻿", "x̧́", "⁇"]


def framed(number: int, data: bytes) -> bytes:
    size, out = len(data), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + data


@pytest.fixture(scope="module", params=["plain", "nmt_nfkc", "nfkc_cf", "squeezed", "no_prefix", "no_bytes"])
def model(request, tmp_path_factory):
    """The given model, and the same pieces with other normalisation or without byte pieces."""
    if request.param == "plain":
        return MODEL
    with open(MODEL, "rb") as f:
        parts = list(_fields(f.read()))
    spec = framed(1, b"own")
    if request.param in ("nmt_nfkc", "nfkc_cf"):
        spec = sentencepiece.SentencePieceNormalizer(rule_name=request.param).serialized_normalizer_spec()
    spec += bytes([3 << 3, request.param != "no_prefix", 4 << 3, request.param in ("nmt_nfkc", "squeezed")])
    trainer = next(v for n, v in parts if n == 2)
    if request.param == "no_bytes":  # the byte pieces become ordinary pieces that no text merges to
        trainer += bytes([35 << 3 & 127 | 128, 35 << 3 >> 7, 0])
        parts = [(n, v[:-2] if n == 1 and v.endswith(bytes([3 << 3, 6])) else v) for n, v in parts]
    path = tmp_path_factory.mktemp("model") / request.param
    path.write_bytes(b"".join(framed(n, v) for n, v in parts if n == 1) + framed(2, trainer) + framed(3, spec))
    return str(path)


def odd_texts(n, seed):
    rnd = random.Random(seed)
    for text in random_texts(n, seed):
        yield text + "".join(rnd.choice(ODD + PARTS) for _ in range(rnd.randint(0, 20)))


def test_pieces_spans_and_decoding_equal_the_library(model):
    own, library = SentencePieces(model), sentencepiece.SentencePieceProcessor(model_file=model)
    for text in ["", " ", "  a  ", "▁", "▁ ▁a", "a ▁▁ b", "<s></s><unk><0x41>", *odd_texts(1500, 3)]:
        packed, begin = own.encode(text)
        ids, widths = (memoryview(packed).cast("i").tolist()[k::2] for k in (0, 1))
        want = library.encode(text, return_type="proto")
        assert ids == [p.id for p in want.pieces], text
        ends = [begin + sum(widths[: k + 1]) for k in range(len(widths))]
        assert [(p.begin, p.end) for p in want.pieces] == [(e - w, e) for e, w in zip(ends, widths, strict=True)], text
        assert own.decode(ids) == library.decode(ids), text


def test_decoding_any_ids_equals_the_library(model):
    own, library = SentencePieces(model), sentencepiece.SentencePieceProcessor(model_file=model)
    rnd = random.Random(4)
    some = [0, 1, 2, *range(3, 259), *(own.ids[p] for p in ("▁", "▁the", "a", "▁▁") if p in own.ids)]
    for _ in range(3000):
        ids = [rnd.choice(some) if rnd.random() < 0.8 else rnd.randrange(len(own.names)) for _ in range(rnd.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_long_units():
    own, library = SentencePieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("x" * 20_000, " " * 9_000, "ab" * 8_000 + "é" * 500, "▁ " * 3_000, "日本語" * 2_000):
        assert memoryview(own.encode(text)[0]).cast("i").tolist()[::2] == library.encode(text)


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        data = f.read()
    (tmp_path / "unigram").write_bytes(data + framed(2, bytes([3 << 3, 1])))
    with pytest.raises(ValueError):
        SentencePieces(str(tmp_path / "unigram"))


def test_frames(docs, no_docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = docs.withColumn("ids", F.lit("clash")).withColumn("spans", F.lit(1))
    out = sentence_pieces.round_trip(odd, MODEL).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r.text or ""
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids)
        ends = [s.end for s in r.spans]
        assert [s.start for s in r.spans] == [0, *ends][: len(ends)] and (ends or [0])[-1] == len(text.encode())
    apart = sentence_pieces.decode(sentence_pieces.encode(odd, MODEL), MODEL)
    assert sorted(map(str, apart.select("doc_id", "ids", "decoded").collect())) == sorted(str(r) for r in sentence_pieces.round_trip(docs, MODEL).select("doc_id", "ids", "decoded").collect())
    assert sentence_pieces.round_trip(no_docs, MODEL).count() == 0


def test_op11_whole_table(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    source = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op11_sentence_pieces(spark, sf).collect()
    assert len(found) == len(source)
    for r in found:
        ids = library.encode(source[r.doc_id])
        assert (r.n_tokens, r.n_span_bytes) == (len(ids), len(source[r.doc_id].encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
