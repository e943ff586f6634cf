"""The registered queries of this subpackage, each over a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import attention_lm, chat, lexical_index, mixing, packing, periodic_runs, toxicity
from .common import read_table
from .exact_dedup import exact_dedup
from .near_join import near_join
from .pii import find_pii
from .piece_bpe import encode_documents
from .repetition import quality_rules
from .substring_dedup import remove_repeats


def op1_source_mixing(spark, sf_dir):
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


def op2_contextual_pii(spark, sf_dir):
    return find_pii(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_repetition_rules(spark, sf_dir):
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op5_fm_substrings(spark, sf_dir):
    found = remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=False)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.col("kept").alias("kept_sha256"))


def op6_sentencepiece_codec(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(read_table(spark, sf_dir, "documents"), model, outputs=())


def op7_perspective_rotation(spark, sf_dir):
    turns = chat.rotate(read_table(spark, sf_dir, "conversations"))
    digest = turns.withColumn("rendered_sha256", F.sha2("rendered", 256)).drop("rendered")
    return digest.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("mask_start", "mask_end")})


def op8_attention_scores(spark, sf_dir):
    import public_tokenizers

    return attention_lm.score_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_ngram_join(spark, sf_dir):
    return near_join(read_table(spark, sf_dir, "documents")).drop("k1", "k2")


def op10_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op11_harmonic_runs(spark, sf_dir):
    planted = periodic_runs.with_planted_runs(read_table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.find_runs(planted))


def op12_quantised_search(spark, sf_dir):
    index = lexical_index.build_index(read_table(spark, sf_dir, "documents"))
    return lexical_index.search(read_table(spark, sf_dir, "benchmark"), index)


def op13_cost_packing(spark, sf_dir):
    import public_tokenizers

    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_contextual_pii": op2_contextual_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_repetition_rules": op4_repetition_rules,
    "op5_fm_substrings": op5_fm_substrings,
    "op6_sentencepiece_codec": op6_sentencepiece_codec,
    "op7_perspective_rotation": op7_perspective_rotation,
    "op8_attention_scores": op8_attention_scores,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
    "op11_harmonic_runs": op11_harmonic_runs,
    "op12_quantised_search": op12_quantised_search,
    "op13_cost_packing": op13_cost_packing,
}

ORACLE_SQL = {
    "op1_source_mixing": mixing.SQL,
    "op7_perspective_rotation": chat.SQL,
    "op12_quantised_search": lexical_index.SQL,
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
}
