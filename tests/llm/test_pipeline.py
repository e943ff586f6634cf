from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, tmp_path):
    import random

    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choice(["an", "er", "ti", "on", "the", "sh", "ou"]) for _ in range(r.randint(1, 4)))
    rows, labels, bad = [], [], set()
    for i in range(700):
        words = [word() for _ in range(r.randint(30, 120))]
        if i % 5 == 0:
            bad.add(i)
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grumblefux", "snorkwit"]))
        rows.append((i, " ".join(words), "en", f"s{0 if i < 500 else 1}", 0))
        if i < 650:
            labels.append((i, 1, int(i in bad)))
    clean = [x for x in rows if x[0] not in bad]
    copies = [(1000 + k, x[1].replace(" ", "  "), *x[2:]) for k, x in enumerate(clean[:5])]
    near = [(2000 + k, x[1] + " tail", *x[2:]) for k, x in enumerate(clean[10:15])]
    docs = spark.createDataFrame(rows + copies + near + [(3000, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    kept = Counter(x.doc_id for x in got)
    assert len(corpus_pipeline.STAGES) == 5
    # No toxic documents, copies or near copies; every clean document, and those of the small source twice at most.
    assert not set(kept) & bad and not set(kept) & {1000 + k for k in range(5)} and not set(kept) & {2000 + k for k in range(5)}
    assert set(kept) == {x[0] for x in clean} | {3000}
    assert all(n == 1 for i, n in kept.items() if i < 500) and max(kept.values()) == 2
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {x[0]: x[1] for x in rows} | {3000: ""}
    assert all(x.n_tokens == len(lib.encode(text[x.doc_id], add_bos=True, add_eos=True)) for x in got)


def test_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
