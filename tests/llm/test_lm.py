import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagequarry.llm import attention_lm as A

tokenizers = pytest.importorskip("public_tokenizers")


def small(seed=0):
    r = np.random.default_rng(seed)
    lm = A.AttentionLm.new(r.integers(0, 50, 400), r.integers(0, 9, (400, A.CONTEXTS)))
    lm.U[:-1] = r.normal(0, 0.3, lm.U[:-1].shape)
    return lm, r


def test_probabilities_add_up_and_match_a_plain_loop():
    lm, r = small()
    sizes = np.array([1, 15, 16, 17, 60, 1])
    ids = r.integers(0, 400, sizes.sum()).astype(np.int32)
    x, y, text = A.windows(ids, sizes, 1, lm.no_id)
    total = sum(10 ** lm.log10(x, np.full_like(y, t)) for t in range(400))
    assert abs(total[y >= 0] - 1).max() < 1e-4
    # Each id is scored once, in order.
    assert (y[y >= 0] == ids).all() and (np.bincount(text, weights=(y >= 0).sum(axis=1)) == sizes).all()
    got, at = lm.log10(x, y)[y >= 0], 0
    K, V = lm.KV[:, : A.DIM], lm.KV[:, A.DIM :]
    for n in sizes:
        seq = [1, *ids[at : at + n].tolist()]
        for i in range(n):
            lo = max(0, i // A.NOW * A.NOW - A.PAST)
            e = np.stack([lm.E[t] + lm.P[j - (i // A.NOW * A.NOW - A.PAST)] for j, t in enumerate(seq) if lo <= j <= i])
            s = np.exp(e @ K @ (e[-1] @ lm.Q) / math.sqrt(A.DIM))
            z = (e[-1] + (s / s.sum()) @ (e @ V) @ lm.O) @ lm.U[:-1] + lm.U[-1]
            c = lm.of_class[seq[i + 1]]
            assert abs(got[at + i] - ((z[c] - np.log(np.exp(z).sum())) / math.log(10) + lm.log_share[seq[i + 1]])) < 1e-4
        at += n


def test_large_logits_do_not_overflow():
    lm, r = small(2)
    ids = r.integers(0, 400, 40).astype(np.int32)
    x, y, _ = A.windows(ids, np.array([40]), 1, lm.no_id)
    lm.U *= 1000
    lm.Q *= 1000
    assert np.isfinite(lm.log10(x, y)).all() and all(np.isfinite(g).all() for g in lm.gradients(x, y).values())


def test_gradients_are_those_of_the_loss():
    lm, r = small(3)
    for n in lm.NAMES:
        setattr(lm, n, getattr(lm, n).astype(np.float64))
    ids = r.integers(0, 400, 50).astype(np.int32)
    x, y, _ = A.windows(ids, np.array([20, 30]), 1, lm.no_id)
    g = lm.gradients(x, y)
    whole = np.zeros_like(lm.E)
    np.add.at(whole, x, g["E"])
    g["E"] = whole
    loss = lambda: -lm.log10(x, y).sum() * math.log(10) / (y >= 0).sum()
    for n in lm.NAMES:
        p = getattr(lm, n)
        for _ in range(12):
            at = tuple(r.integers(0, k) for k in p.shape) if n != "E" else (int(r.choice(ids[:-1])), int(r.integers(0, A.DIM)))
            old, h = p[at], 1e-4
            p[at] = old + h
            up = loss()
            p[at] = old - h
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * h) - g[n][at]) < 2e-4 + 0.01 * abs(g[n][at]), n


def test_classes_follow_contexts():
    r = np.random.default_rng(6)
    counts = np.concatenate([np.arange(1000, 1000 - A.OWN_CLASS, -1), np.full(200, 20)])
    contexts = r.integers(0, 2, (len(counts), A.CONTEXTS))
    contexts[A.OWN_CLASS : A.OWN_CLASS + 100, 3] += 40
    contexts[A.OWN_CLASS + 100 :, 9] += 40
    found = A.context_classes(counts, contexts)
    assert (found[: A.OWN_CLASS] == np.arange(A.OWN_CLASS)).all() and found.max() < A.CLASSES
    assert not set(found[A.OWN_CLASS : A.OWN_CLASS + 100]) & set(found[A.OWN_CLASS + 100 :])


def test_training_lowers_the_loss():
    lm, r = small(1)
    ids = np.tile(r.integers(0, 400, 7), 8000).astype(np.int32)
    x, y, _ = A.windows(ids, np.array([len(ids)]), 1, lm.no_id)
    before = lm.log10(x, y).sum()
    lm.train(x, y, 0.1)
    assert lm.log10(x, y).sum() > 0.5 * before


def test_scores(spark):
    r = np.random.default_rng(4)
    words = ["the", "The", "cat", "sat", "Én", "x1", "zebra"]
    rows = [(i, " ".join(r.choice(words, r.integers(0, 40)))) for i in range(120)] + [(500, None), (501, "\x85 new"), (None, "the"), (3, "cat"), (3, "cat")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, chunk string, k int").repartition(3)
    got = A.score_documents(df, tokenizers.path("piece_bpe_32k.model"), chunk_chars=2000).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, ws in split if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in split)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == expected
    assert all(x.score < 0 for x in got)
    assert A.score_documents(df.where("false"), tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_every_window_is_trained_on_once(spark, monkeypatch):
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["cat", "sat", "zebra", "x1"], n)) for n in (3, 700, 40, 0, 900, 26_000, 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = A.tokenizer(tokenizers.path("piece_bpe_32k.model"))
    rows = df.select("doc_id", A.held_out("doc_id").alias("held_out"), df.text.cast("binary").alias("text"))
    gathered = A.Stored(rows.mapInArrow(A._gather(tokenizers.path("piece_bpe_32k.model"), 3000), A._GATHERED_DDL), "gathered").df
    learnt = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 2 <= len(learnt) < len(texts)
    want = sum(len(p) for t in learnt for p in model.encode(t.split())) + len(learnt)
    assert sum(sum(x.contexts) for x in gathered.where("kind = 's'").collect()) == want
    assert sorted(p for parts, _ in A.ROUNDS for p in parts) == list(range(8))
    seen = []
    monkeypatch.setattr(A.AttentionLm, "train", lambda self, x, y, rate, **kw: seen.append(int((y >= 0).sum())))
    share = type("Share", (), {"value": A.AttentionLm.new(np.ones(model.get_piece_size()))})
    stored = gathered.where("kind = 'i'")
    for parts, rate in A.ROUNDS:
        for batch in stored.where(stored.part.isin(*parts)).select("sizes", "held_out", "low").toArrow().to_batches():
            list(A._train_task(share, rate, model.bos_id())([batch]))
    assert sum(seen) == want
    # Some texts are held out, and every text's ids are stored whole.
    assert sum(len(x.low) // 2 for x in stored.collect()) == sum(len(p) for t in texts for p in model.encode(t.split())) + len(texts)


def test_held_out_text_is_predicted_better_than_by_counts_of_ids(spark):
    r = random.Random(8)
    syllables = [["ba", "ke", "li", "mo", "nu"], ["sch", "ein", "ung", "keit", "pf"]]
    texts = [" ".join("".join(r.choice(syllables[k % 2]) for _ in range(r.randint(1, 4))) for _ in range(60)) for k in range(600)]
    file = tokenizers.path("piece_bpe_32k.model")
    model = A.tokenizer(file)
    got = {x.doc_id: x for x in A.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), file).collect()}
    ids = {k: [i for w in t.split() for i in model.encode(w)] + [model.eos_id()] for k, t in enumerate(texts)}
    c = Counter(i for k in ids if not got[k].held_out for i in ids[k])
    n = sum(c.values()) + 0.1 * model.get_piece_size()
    held = [k for k in ids if got[k].held_out]
    plain = sum(math.log10((c[i] + 0.1) / n) for k in held for i in ids[k])
    assert len(held) > 50 and sum(got[k].score for k in held) > 0.8 * plain


def test_a_step_takes_each_logit_s_exponential_once_in_short_runs(monkeypatch):
    lm, r = small(7)
    ids = r.integers(0, 400, 3000).astype(np.int32)
    x, y, _ = A.windows(ids, np.array([len(ids)]), 1, lm.no_id)
    x, y = x[: A.BATCH], y[: A.BATCH]
    taken, exp2 = [], np.exp2
    monkeypatch.setattr(np, "exp2", lambda z, **kw: taken.append(z.shape) or exp2(z, **kw))
    for f in (lm.gradients, lm.log10):
        taken.clear()
        f(x, y)
        logits = [s for s in taken if s[-1] == A.CLASSES]
        assert sum(n for n, _ in logits) == x.shape[0] * A.NOW and max(n for n, _ in logits) <= A.ROWS


def test_chunks_number_the_words_of_each_text():
    texts = [b"", b"A\x00b\x1c c\r\na", b" \x0b\x0c ", b"\xff\xc3 a\tA", b"x", b""]
    c = A.Chunk(texts)
    words = c.words.to_pylist()
    assert [words[k] for k in c.words_at] == [w for t in texts for w in [*t.lower().split(), A.END]]
    assert len(set(words)) == len(words) and c.sizes.tolist() == [len(t.split()) + 1 for t in texts] and (np.bincount(c.text) == c.sizes).all()


def test_counts_hold_over_many_chunks_that_share_words(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["cat", "sat", "zebra", f"x{r.randint(0, 30)}"]) for _ in range(r.randint(0, 30))) for _ in range(200)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(texts, held) if not h for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    file = tokenizers.path("piece_bpe_32k.model")
    few, many = ({x.doc_id: x for x in A.score_documents(df, file, chunk_chars=k).collect()} for k in (8_000_000, 60))
    for i, t in enumerate(texts):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t.split(), None])
        for x in (few[i], many[i]):
            assert (x.train_tokens, x.n_tokens, x.n_known) == (n, len(t.split()) + 1, sum(c[w] > 0 for w in [*t.split(), None])) and abs(x.base_score - base) < 1e-6


def test_a_word_of_several_runs_is_encoded_once():
    encoded, model = [], A.tokenizer(tokenizers.path("piece_bpe_32k.model"))
    spy = type("Spy", (), {"eos_id": model.eos_id, "encode": staticmethod(lambda words, **kw: encoded.extend(words) or model.encode(words, **kw))})
    known, runs = A.Words(spy), ([b"cat sat", b"x1"], [b"the cat", b""], [b"sat"])
    for texts in runs:
        c = A.Chunk(texts)
        at = known.add(c, np.ones(len(texts), bool))[c.words_at]
        words = known.words.to_pylist()
        assert [words[k] for k in at] == [w for t in texts for w in [*t.split(), A.END]]
        ids, n = A.spread(at, known.flat, known.start)
        assert ids.tolist() == [i for t in texts for w in [*t.decode().split(), None] for i in (model.encode(w) if w else [model.eos_id()])]
    assert sorted(encoded) == [" ", "cat", "sat", "the", "x1"] and dict(zip(words, known.n)) == {b" ": 5, b"cat": 2, b"sat": 2, b"x1": 1, b"the": 1}
