"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is in turn the assistant: the dialogue is rendered once for
each, with that speaker's turns as the assistant's, all others as named users, and only the
assistant's words (with the mark that ends them) counted in the loss.

The result has a row for each turn of each rendering, with its text and its place in characters, so
a rendering of any length is spread over rows; :func:`assemble` joins them where one string is
wanted.  Places are sums over the turns before; they are taken in two steps, within chunks of turn
numbers and over the chunks, so that no task needs a whole conversation.

Defined cases: a null role or text counts as empty; turns without a number come last, in a chunk of
their own; turns that share a number are in the order of their speakers and texts, repeated rows
are repeated turns; a null conv_id is a conversation of its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CHUNK = 256


def _header(own: Column, speaker: Column) -> Column:
    return F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, idx, speaker, as_role, rendered, start, end, mask_start, mask_end (null where nothing is learnt)."""
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(speaker_col).cast("string"), F.lit("")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    people = t.select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    rows = (
        t.join(people, t["conv_id"].eqNullSafe(people["c"]))
        .drop("c")
        .withColumns({"own": own, "header": _header(own, F.col("speaker")), "chunk": F.floor(F.col("turn") / CHUNK)})
        .withColumn("rendered", F.concat("header", "text", F.lit(CLOSE)))
        .withColumn("n", F.length("rendered"))
    )
    party = ["conv_id", "perspective"]
    within = Window.partitionBy(*party, "chunk").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({"k": F.row_number().over(within) - 1, "at": F.coalesce(F.sum("n").over(before), F.lit(0))})
    sums = rows.groupBy(*party, "chunk").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("turns"))
    over = Window.partitionBy(*party).orderBy(F.col("chunk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("h"), F.coalesce(F.sum("chars").over(over), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(over), F.lit(0)).alias("turns"))
    placed = local.join(offsets, local["conv_id"].eqNullSafe(offsets["c"]) & (local["perspective"] == offsets["p"]) & local["chunk"].eqNullSafe(offsets["h"]))
    start = F.col("chars") + F.col("at")
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("turns") + F.col("k")).cast("long").alias("idx"),
        "speaker",
        F.when(F.col("own"), "assistant").otherwise("user").alias("as_role"),
        "rendered",
        start.alias("start"),
        (start + F.col("n")).alias("end"),
        F.when(F.col("own"), start + F.length("header")).alias("mask_start"),
        F.when(F.col("own"), start + F.col("n") - 1).alias("mask_end"),
    )


def assemble(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: each rendering as one string, for conversations that fit in a row."""
    turn = F.struct("idx", "rendered", "mask_start", "mask_end")
    return rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(turn)).alias("all")).select(
        "conv_id",
        "perspective",
        F.array_join(F.col("all.rendered"), "").alias("text"),
        F.transform(F.filter("all", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"),
    )


#: The registered query's SQL.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t),
r AS (SELECT conv_id, turn, speaker, text, perspective, speaker = perspective AS own,
        CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || speaker || chr(10) END AS header
      FROM t JOIN people ON conv_id IS NOT DISTINCT FROM c),
x AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered FROM r),
y AS (SELECT *, row_number() OVER o - 1 AS idx, coalesce(sum(length(rendered)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
      FROM x WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, idx, speaker, CASE WHEN own THEN 'assistant' ELSE 'user' END AS as_role, sha256(rendered) AS rendered_sha256,
  s AS start, s + length(rendered) AS "end", CASE WHEN own THEN s + length(header) ELSE -1 END AS mask_start, CASE WHEN own THEN s + length(rendered) - 1 ELSE -1 END AS mask_end
FROM y
"""
