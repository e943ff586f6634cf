"""Exact deduplication by deterministic block naming, with DataFrame operations only.

Each normalised text is cut into blocks of a fixed size.  The distinct blocks are sorted by their
hash, those of one hash by themselves, and numbered in that order without gaps, so a block's name is
an integer that equals another's only if the blocks are equal, and does not depend on partitions.
Adjacent names are then paired, the distinct pairs are sorted and numbered in turn, and so on
until one name is left of each document.  Documents are equal exactly if their block counts and
last names are.

What is shuffled: the distinct blocks once (combined on the map side first), otherwise only rows
of a few integers.  A block is looked up by its 64-bit hash; hashes that two distinct blocks share
are found by counting, and their blocks are looked up by their whole text.  All joins have an
exchange on both sides, so a hot block or group can be split at run time.

Defined cases: null text counts as empty; all empty texts are equal; a null doc_id sorts after
all others; of equal rows that repeat a doc_id exactly one is kept; an empty table gives an empty
result; a very long text is a row of many blocks and never one value; further columns of the input are not read by :func:`exact_dedup` and are kept, whatever
their names, by :func:`keep_first`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Stored, store, text_or_empty, unused

#: Names given to blocks whose hash is shared lie from here on, apart from all others.
_SHARED_HASH_NAMES = 1 << 62
_NONE = -1


def normalised(text_col: str) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def _numbered(keys: DataFrame, *cols: str) -> DataFrame:
    """The keys, which are distinct, sorted as a whole and numbered from 0 without gaps, however they were partitioned."""
    part, place, before = "__part", "__place", "__before"
    placed = store(keys.orderBy(*cols).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place)), "sorted")
    over = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition of the sort.
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, F.coalesce(F.sum("n").over(over), F.lit(0)).alias(before))
    return placed.join(sizes, part).withColumn("name", F.col(before) + F.col(place)).drop(part, place, before)


def _block_names(occurrences: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rid, n_blocks, idx, name) of each block occurrence."""
    hashes = store(blocks.select("h", "block").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hashes")
    sole = store(_numbered(hashes.where("n = 1").select("h"), "h"), "block-names")
    named = occurrences.join(sole, "h").select("rid", "n_blocks", "idx", "name")
    shared = hashes.where("n > 1").select("h")
    if shared.isEmpty():
        return named
    # Looked up by the block itself; these rows are the few whose 64-bit hashes collide.
    doubtful = store(blocks.join(shared, "h", "left_semi").select("rid", "n_blocks", "idx", "block"), "shared-blocks")
    by_text = _numbered(doubtful.select("block").distinct(), "block").withColumn("name", F.col("name") + F.lit(_SHARED_HASH_NAMES))
    return named.unionByName(doubtful.join(by_text, "block").select("rid", "n_blocks", "idx", "name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per input row: rid, doc_id, text_sha256, n_blocks, name; (n_blocks, name) names the text."""
    mask = F.lit((1 << hash_bits) - 1 if hash_bits < 64 else -1)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    cut = rows.select("rid", "doc_id", "t", F.regexp_extract_all("t", F.lit(r"(?s).{1,%d}" % block_chars), F.lit(0)).alias("cut"))
    blocks = (
        cut.select("rid", "doc_id", F.sha2("t", 256).alias("text_sha256"), F.greatest(F.size("cut"), F.lit(1)).alias("n_blocks"), F.posexplode_outer("cut").alias("idx", "block"))
        .withColumns({"idx": F.coalesce("idx", F.lit(0)), "block": F.coalesce("block", F.lit(""))})
        .withColumn("h", F.xxhash64("block").bitwiseAND(mask))
    )
    first = F.col("idx") == 0
    occurrences = store(blocks.select("rid", "n_blocks", "idx", "h", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("text_sha256")).alias("text_sha256")), "occurrences")
    heads = occurrences.where("idx = 0").select("rid", "doc_id", "text_sha256", "n_blocks")
    named = Stored(_block_names(occurrences, blocks).withColumn("left", F.col("n_blocks")), "named")
    done = [named.df.where("left = 1").select("rid", "name")]
    longest = named.df.agg(F.max("n_blocks")).first()[0] or 1
    width = 1
    while width < longest:
        pairs = (
            named.df.where("left > 1")
            .groupBy("rid", F.expr("idx div 2").cast("int").alias("idx"), F.expr("(left + 1) div 2").cast("int").alias("left"), "n_blocks")
            .agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(_NONE)).alias("b"))
        )
        names = _pair_names(pairs)
        named = Stored(pairs.join(names, ["a", "b"]).select("rid", "n_blocks", "idx", "name", "left"), "paired")
        done.append(named.df.where("left = 1").select("rid", "name"))
        width *= 2
    last = done[0]
    for x in done[1:]:
        last = last.unionByName(x)
    return store(heads.join(last, "rid"), "identities")


def _pair_names(pairs: DataFrame) -> DataFrame:
    """Names of the distinct pairs: sorted as a whole, numbered in that order."""
    return _numbered(pairs.select("a", "b").distinct(), "a", "b")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    rows = identities(docs, id_col, text_col, block_chars, hash_bits)
    groups = store(
        rows.groupBy("n_blocks", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("least"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    (key,) = unused(docs, "key")
    kept = exact_dedup(docs, id_col, text_col, **options).where("kept").select(F.concat_ws(":", "text_sha256", F.col("doc_id").cast("string")).alias(key))
    keyed = docs.withColumn(key, F.concat_ws(":", F.sha2(normalised(text_col), 256), F.col(id_col).cast("string")))
    # A key is kept once, but its row may be repeated in the input.
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
