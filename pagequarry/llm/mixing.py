"""Mixing sources to target weights by temperature, with DataFrame operations only.

A source's share of the tokens is raised to an exponent and normalised to its weight.  An exponent
of 1 keeps the shares, 0 makes all sources equal.  The exponent is bisected to meet a target: an
entropy of the weights, or a limit on repetition, the most passes over any source that the budget
asks for.  Each source is cut into a fixed number of blocks by a hash of the document ids; a pass
over a source takes its blocks in an order that is a permutation of its own, and the last pass ends
with the block at which the source's token budget is used up.

The budget is ``budget_tokens``, or, if that is not given, the least with which the source that
grew least is still seen whole once: then no document is lost and the others are repeated.

Per source there is one row, so the bisection works on a single array with an entry a source.
Blocks are ranked in windows of ``blocks`` rows at most.  Tokens are counted by source and block
before anything is shuffled, so a hot source moves no more rows than another.

Defined cases: a null source is a source of its own; a null text counts as empty; documents without
tokens get the copies that their block gets; ties in a permutation go to the lesser block; a very long
text counts like any other; a null doc_id is hashed as an empty id; rows that
repeat a doc_id fall in one block; with no tokens at all every document has one copy; an empty table
gives an empty result; columns of other names are kept by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, store, text_or_empty, unused

STEPS = 60
#: The greatest exponent looked at for an entropy; one for a number of passes is at most 1.
STEEPEST = 64.0
#: Passes are compared as whole millionths, alike in every engine.
FINE = 1_000_000


def hashed(value: Column, modulus: int) -> Column:
    """A number under ``modulus`` from the MD5 digest of a text."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") % modulus


def with_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int, seed: int) -> DataFrame:
    key = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("n_tokens"), hashed(key, blocks).alias("block")
    )


def _entropy(shares: Column, exponent: Column) -> Column:
    """Entropy in nats of the shares raised to the exponent and normalised."""
    powers = F.transform(shares, lambda p: F.pow(p, exponent))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(powers, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total))


def _repetition(shares: Column, exponent: Column) -> Column:
    """The passes over the smallest source while the largest is seen once."""
    passes = F.transform(shares, lambda p: F.pow(p, exponent - 1))
    return F.array_max(passes) / F.array_min(passes)


def weights(sources: DataFrame, target_entropy: float | None, max_repeats: float) -> DataFrame:
    """source, tokens, exponent, weight of each source with tokens.

    The exponent is the least of those that keep to the target: an entropy of at most
    ``target_entropy``, or at most ``max_repeats`` passes over any source.  An entropy under that of
    the shares themselves takes an exponent above 1, up to ``STEEPEST``; one that no exponent up to
    it reaches, such as less than the logarithm of the number of equally largest sources, is met as
    closely as that one does.
    """
    used = sources.where("tokens > 0")
    one = used.agg(F.array_sort(F.collect_list("tokens")).alias("sizes"), F.sum("tokens").alias("total"))
    one = one.withColumn("shares", F.transform("sizes", lambda t: t / F.col("total")))
    shares = F.col("shares")

    def halve(s, _):
        middle = (s["low"] + s["high"]) / 2
        fits = _entropy(shares, middle) <= target_entropy if target_entropy is not None else _repetition(shares, middle) <= max_repeats
        return F.when(fits, F.struct(s["low"].alias("low"), middle.alias("high"))).otherwise(F.struct(middle.alias("low"), s["high"].alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0 if target_entropy is None else STEEPEST).alias("high")), halve)["high"]
    one = one.select("total", "shares", F.round(found, 9).alias("exponent"))
    one = one.withColumn("scale", F.aggregate(F.transform("shares", lambda p: F.pow(p, F.col("exponent"))), F.lit(0.0), lambda a, x: a + x))
    # One row with an entry a source: its size is the number of sources.
    return used.crossJoin(one).select("source", "tokens", "exponent", (F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("scale")).alias("weight"))


def block_copies(rows: DataFrame, target_entropy: float | None = None, max_repeats: float = 2.0, budget_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """source, block, weight, copies, place: how often each block is taken, and its place in the source's permutation."""
    blocks = store(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    shares = store(weights(sources, target_entropy, max_repeats), "weights")
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.col("least")
    least = shares.agg(F.max(F.col("tokens") / F.col("weight")).alias("least"))
    passes = shares.crossJoin(least).select("source", "weight", F.col("tokens").alias("source_tokens"), F.round(budget * F.col("weight") / F.col("tokens") * FINE).cast("long").alias("passes"))
    order = Window.partitionBy("source").orderBy("turn", "block")
    turned = blocks.withColumn("turn", F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("block").cast("string"))))
    placed = turned.select(
        "source", "block", F.row_number().over(order).alias("place"), F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    null_safe = placed["source"].eqNullSafe(passes["source"])
    whole = F.expr(f"passes div {FINE}")
    rest = F.col("passes") % FINE
    joined = placed.join(passes, null_safe, "left").drop(passes["source"])
    # A block of the last pass is taken while the budget is not used up when it starts.
    copies = whole + F.when(F.col("before") * FINE < rest * F.col("source_tokens"), 1).otherwise(0)
    return joined.select("source", "block", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(copies, F.lit(1)).cast("long").alias("copies"), "place")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = 1024, seed: int = 1, **options) -> DataFrame:
    """One row per input row: doc_id, source, n_tokens, block, place, weight, copies (may be 0 with a given budget)."""
    rows = with_tokens(docs, id_col, text_col, source_col, blocks, seed)
    counted = store(rows, "tokens")
    plan = store(block_copies(counted, seed=seed, **options), "plan")
    plan = plan.withColumnRenamed("source", "__source").withColumnRenamed("block", "__block")  # both sides' names are this module's own
    return counted.join(plan, (counted["block"] == plan["__block"]) & counted["source"].eqNullSafe(plan["__source"])).select("doc_id", "source", "n_tokens", "block", "place", "weight", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = 1024, seed: int = 1, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as many times as its block is taken, with all their columns."""
    rows = with_tokens(docs, id_col, text_col, source_col, blocks, seed)
    source, block, copies, own, turn = unused(docs, "source", "block", "copies", "own", "turn")
    plan = store(block_copies(rows, seed=seed, **options), "plan").select(F.col("source").alias(source), F.col("block").alias(block), F.col("copies").alias(copies))
    key = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.withColumn(own, hashed(key, blocks))
    taken = keyed.join(plan, (keyed[own] == plan[block]) & keyed[source_col].cast("string").eqNullSafe(plan[source]))
    turns = F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))).alias(turn)
    return taken.where(F.col(copies) > 0).select("*", turns).select(*(F.col(quoted(c)) for c in docs.columns))


#: The registered query's SQL; the exponent is bisected by a recursive query.
SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         ('0x' || substr(md5('1/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024 AS block FROM documents),
blocks AS (SELECT source, block, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
sources AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM blocks GROUP BY 1),
shares AS (SELECT source, tokens, tokens / sum(tokens) OVER () AS p FROM sources WHERE tokens > 0),
ends AS (SELECT min(p) AS least, max(p) AS most FROM shares),
halves(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN fits THEN low ELSE middle END, CASE WHEN fits THEN middle ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle, pow(least, (low + high) / 2 - 1) / pow(most, (low + high) / 2 - 1) <= 2.0 AS fits
        FROM halves, ends WHERE step < 60)),
found AS (SELECT round(high, 9) AS exponent FROM halves WHERE step = 60),
weights AS (SELECT source, tokens, pow(p, exponent) / sum(pow(p, exponent)) OVER () AS weight FROM shares, found),
passes AS (SELECT source, weight, tokens AS source_tokens,
             round((SELECT max(tokens / weight) FROM weights) * weight / tokens * 1000000)::BIGINT AS passes FROM weights),
placed AS (SELECT source, block, row_number() OVER o AS place,
             coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM (SELECT *, md5('1/' || coalesce(source, '') || '/' || block) AS turn FROM blocks)
           WINDOW o AS (PARTITION BY source ORDER BY turn, block)),
plan AS (SELECT b.source, block, place, coalesce(weight, 0) AS weight,
           coalesce(passes // 1000000 + CASE WHEN before * 1000000 < (passes % 1000000) * source_tokens THEN 1 ELSE 0 END, 1)::BIGINT AS copies
         FROM placed b LEFT JOIN passes p ON b.source IS NOT DISTINCT FROM p.source)
SELECT r.doc_id, r.source, r.n_tokens, r.block, place::INTEGER AS place, round(weight, 6) AS weight, copies
FROM rows r JOIN plan ON r.block = plan.block AND r.source IS NOT DISTINCT FROM plan.source
"""
