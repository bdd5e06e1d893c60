import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import op4_token_planes
from tessella.llm.op4_token_planes import encoder, pack, read_tokens, unpack, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Plain words, and 12 numbers!!", None, "", "tabs\t\tand\n\n  spaces  \n", "ÀÉß ñandú l'été d'you'll",
    "<|endoftext|> inside", "日本語 mixed ½ ² text", "line sep\x85 nel\x1c fs", "!" * 700, "it's  !\n!", "x" * 3000, "emoji 😀 ퟿",
]


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert (unpack(pack(ids, mode)) == ids).all()


def test_pieces_encode_like_whole_texts():
    whole = Tokenizer.from_file(PATH)
    for text, got in zip(TEXTS, encoder(PATH)([t or "" for t in TEXTS]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("mode,block", [("bit", 64), ("byte", 50), ("byte", 1 << 16)])
def test_documents_read_back(spark, mode, block):
    texts = TEXTS * 3
    docs = spark.createDataFrame([(5 * i % 36, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(3)
    rows = sorted(read_tokens(write_tokens(docs, PATH, mode=mode, block=block)).collect())
    whole, start, want = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(((5 * i % 36, t) for i, t in enumerate(texts)), key=lambda x: x[0]):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(write_tokens(docs, PATH)).collect() == []


def test_pieces_met_first_stay_encoded_when_the_store_is_full(monkeypatch):
    monkeypatch.setattr(op4_token_planes, "PIECES", 8)
    own = op4_token_planes.Encoder(PATH)
    texts = ["one two", *[f"one two rare{chr(97 + i)} odd{chr(97 + i)}" for i in range(12)]]
    plain, new = Tokenizer.from_file(PATH), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: (new.append(pieces), learn(pieces)))
    for t in texts:
        (got,) = own([t])
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(own.pieces) <= 12
    assert not any(p in {"one", " two"} for pieces in new[1:] for p in pieces)
