import hashlib
import random
import struct

import pytest

from pagequarry.llm.piece_bpe import PieceBpe, encode_documents

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(1)
    some = ["", " ", "  ", "\n", " \n  a", "▁a ▁▁b", "<s> </s> <0x41>", "é\u0000x", "日本語 🎉🎉", "a" * 3000, "  " * 300 + "x", "�́", "\t\t  \t", " ⁇ ", "\r\n x"]
    letters = "abcdefghijklmnop eénthè\n  \t.,-_0123456789<>/日本▁🎉"
    some += ["".join(r.choice(letters[: r.choice([5, 10, 20, len(letters)])]) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    pieces = list(PieceBpe(MODEL).id_of)
    return some + ["".join(r.choice(pieces) for _ in range(r.randint(1, 8))).replace("▁", " ") for _ in range(1500)]


def test_as_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own, small = PieceBpe(MODEL), PieceBpe(MODEL, cache_segments=3)
    every = texts()
    for t in every:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == small.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids)
    rows = [(i, t) for i, t in enumerate(every[:100])] + [(None, None)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert len(got) == 101
    for r in got:
        ids = lib.encode(dict(rows)[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids == struct.pack(f"<{len(ids)}I", *ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded == lib.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
