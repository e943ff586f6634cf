import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import packing
from pagequarry.llm.word_bpe import WordBpe, as_ids, byte_characters

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def by_scanning(lengths, room, width):
    """The same assignment, by looking at every sequence for every piece."""
    n = sum(lengths) // room
    free, costs, placed, over = [room] * n, [0.0] * n, {}, []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(costs[s], s) for s in range(n) if free[s] >= lengths[k]]
        if fits:
            s = min(fits)[1]
            placed[k] = s
            free[s] -= lengths[k]
            costs[s] += packing.cost(lengths[k], width)
        else:
            over.append(k)
    return placed, over


def test_assignment_against_a_scan_of_all_sequences():
    r = random.Random(1)
    for _ in range(300):
        room = r.choice([8, 64, 256])
        lengths = [r.randint(1, room) if r.random() < 0.5 else r.randint(1, 1 + room // 8) for _ in range(r.randint(0, 60))]
        rows, n, parts = packing.balance(lengths, room, 16)
        placed, over = by_scanning(lengths, room, 16)
        assert {k: s for k, start, m, s in rows if k in placed} == placed
        assert sorted({k for k, *_ in rows + parts} - set(placed)) == sorted(over)
        filled = np.zeros(n, int)
        for _, _, m, s in rows:
            filled[s] += m
        assert (filled == room).all() and sum(m for *_, m in parts) == sum(lengths) % room
        for k, m in enumerate(lengths):  # the parts of a piece follow each other
            mine = sorted([(a, b) for j, a, b, _ in rows if j == k] + [(a, b) for j, a, b in parts if j == k])
            assert [a for a, _ in mine] == [sum(b for _, b in mine[:i]) for i in range(len(mine))] and sum(b for _, b in mine) == m


def test_balanced_costs_are_close():
    r = np.random.default_rng(0)
    lengths = np.minimum(2048, r.lognormal(5.5, 1, 4000).astype(int) + 1).tolist()
    rows, n, _ = packing.balance(lengths, 2048)
    costs = np.zeros(n)
    for _, _, m, s in rows:
        costs[s] += packing.cost(m)
    first_fit, free = np.zeros(2 * n), np.full(2 * n, 2048)
    for m in sorted(lengths, reverse=True):  # the first sequence with room, whatever it costs
        s = int(np.argmax(free >= m))
        first_fit[s] += packing.cost(m)
        free[s] -= m
    assert costs.std() < 0.9 * first_fit[first_fit > 0].std()


def test_words_are_encoded_as_by_the_library():
    r = random.Random(7)
    texts = ["", " ", "Hello, World!", "don't we'll 'tis O'Neil's", "a\x1cb\x85c\xa0d", "ÀÉ Straße ſ İstanbul ΑΣ Σ ǅ µm", "é ́x å", "x<|endoftext|>y <|startoftext|>", "1234 3.14 12,345", "日本語 テスト 😀😀 👍🏽", "\x00\x01 ﻿bom ​z", "¡hola! ¿qué? «oui»", "A.B.C. a--b __x__", "Ω ﬁ ① Ⅷ", "a" * 5000, "(x)|-y-", "É,É.é!"]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFéèàçñßÿŁ'.,-|0129 \n\t́"
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["".join(chr(r.choice([r.randint(32, 0x24F), r.randint(0x300, 0x3000), r.randint(0x1F300, 0x1F6FF)])) for _ in range(30)) for _ in range(200)]
    texts += ["x" * 300, "é" * 200 + ".", "ab" * 5000 + "!", "a\x01b \x01", "  lead and trail  \n"]
    mine, want = WordBpe(FILE), [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 97):
        assert [as_ids(x).tolist() for x in mine.encode(pa.array(texts[k : k + 97]))] == want[k : k + 97]
    assert [as_ids(x).tolist() for x in mine.encode(pa.array(texts).slice(3, 50))] == want[3:53]
    assert mine.encode(pa.array([], pa.string())) == [] and mine.encode(pa.array([""])) == [b""]


def test_every_entry_merges_to_itself():
    """What merging by the result's rank relies on."""
    import json

    with open(FILE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
    none = len(pairs)
    for token in model["vocab"]:
        if token.startswith("<|"):
            continue
        core = token.removesuffix("</w>")
        parts = list(core)
        if core != token:
            parts[-1] += "</w>"
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: pairs.get((parts[i], parts[i + 1]), none))
            if (parts[k], parts[k + 1]) not in pairs:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [token]
    assert set(byte_characters().values()) == set(range(256))


def check(pieces, rows, room):
    """Every id lies in one piece, sequences have no gaps; returns the filled lengths."""
    ids = {}
    for (key, _), e in zip(rows, library().encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids.setdefault(key, []).append([*e.ids, 1])
    found, filled = {}, {}
    for p in pieces:
        found.setdefault(p.doc_id, []).append(p)
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(found) == set(ids)
    for key, ps in found.items():
        if len(ids[key]) == 1:
            ps.sort(key=lambda p: p.start)
            assert [x for p in ps for x in as_ids(bytes(p.ids)).tolist()] == ids[key][0]
            assert [p.start for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
            assert all(p.doc_tokens == len(ids[key][0]) and p.length == len(p.ids) // 4 > 0 for p in ps)
        else:
            assert sum(p.length for p in ps) == sum(map(len, ids[key]))
    for s in filled.values():
        s.sort()
        assert [o for o, _ in s] == [sum(m for _, m in s[:i]) for i in range(len(s))]
    sizes = [sum(m for _, m in s) for s in filled.values()]
    assert max(sizes, default=0) <= room
    return sizes


@pytest.mark.parametrize("group", [packing.GROUP_TOKENS, 300])
def test_pieces_of_documents(spark, group):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of", "xyzzy", "é.", "9"]) for _ in range(r.choice([0, 3, 40, 700])))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "null id"), (102, "same"), (102, "same"), (103, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "start", "length", "sequence_id")}).repartition(3)
    pieces = packing.pack_documents(docs, FILE, length=256, group_tokens=group).cache()
    found = pieces.collect()
    sizes = check(found, rows, 256)
    assert all(n & (n - 1) == 0 for n in sizes) and sum(n < 256 for n in sizes) <= 3 * 8
    total = packing.padding(pieces, 256).first()
    assert (total.sequences, total.tokens, total.padding) == (len(sizes), sum(sizes), 0)
    joined = packing.sequences(pieces).collect()
    assert sorted(len(x.ids) // 4 for x in joined) == sorted(sizes) and sum(x.n_pieces for x in joined) == len(found)
    crc = {(x.doc_id, x.start): x.crc for x in pieces.where("doc_id = 103").select("doc_id", "start", F.crc32("ids").alias("crc")).collect()}
    assert crc == {(p.doc_id, p.start): zlib.crc32(p.ids) for p in found if p.doc_id == 103}


def test_empty_table_and_bad_length(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, FILE).collect() == []
    assert tuple(packing.padding(packing.pack_documents(none, FILE)).first()) == (0, 0, 0)
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(none, FILE, length=100)


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
