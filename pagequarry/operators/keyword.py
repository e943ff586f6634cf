"""Keyword search: BM25+ over blocks of postings with stored bounds, most of which a search passes over.

A chunk's score is the sum over a question's words of w * (delta + part), where part grows with the
word's count tf in the chunk and falls with the chunk's length dl.  Chunks that stand together are a
shard; a word's postings in a shard are a block.  A block's largest tf and
least dl / tf bound the part of all its postings, whatever the mean length has become since.  A search goes

1. for each question to the shard with the highest sum of its words' bounds; the k-th score there is a
   floor under the result;
2. to the other shards whose sum reaches the floor, and to no others;
3. within a shard through a question's words by falling bound, so rarest first.  As soon as the bounds of the words
   left are under the k-th sum so far, only chunks that can still come in are looked up in their blocks.

Floors are lowered by ``SLACK``, so rounding cannot lose a tie.  Postings never are rows of a plan.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from ..functions.text import tokens
from .scratch import keep

#: Chunks of a shard.
SHARD = 4096
#: Questions that are asked together.
QUESTIONS = 256
#: An index of no more shards is searched at once, without a floor from each question's best shard.
AT_ONCE = 32
SLACK = 1e-6
#: Bytes of text whose words are counted together, and postings that are made into blocks together: these bound a worker's memory.
TEXT, POSTINGS = 2 << 20, 1 << 20
_PLACE = ["seg", "shard"]


@dataclass
class KeywordIndex:
    """What a search reads.

    chunks: seg, shard, place (in the shard), chunk_id, seq, the filter columns and what else chunks have, dl, tfs (each term's count);
    shards: seg, shard, members (chunk_id, seq, dl, doc_name, fiscal_year; by place);
    blocks: seg, shard, term, n, max_tf, min_ratio, at (places as 2 bytes each, rising), tf (counts as 4 bytes each); a shard may have several blocks of a term;
    df: term, df; stats: n, avgdl, in one row; gone: seg, shard, places that are deleted (None: nothing is).
    """

    chunks: DataFrame
    shards: DataFrame
    blocks: DataFrame
    df: DataFrame
    stats: DataFrame
    gone: DataFrame | None = None

    def live(self) -> DataFrame:
        """The chunks that are not deleted."""
        if self.gone is None:
            return self.chunks
        return self.chunks.join(self.gone.select(*_PLACE, F.explode("places").alias("place")), [*_PLACE, "place"], "left_anti")


def _stretches(sizes: np.ndarray, most: int):
    """(begin, end) of stretches of rows, each of at most so much in all, or of one row."""
    until, at = np.cumsum(sizes), 0
    while at < len(until):
        before = until[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(until, before + most, "right")))
        yield at, end
        at = end


def count_terms(chunks: DataFrame, text: str = "indexed_text", seg: int = 0) -> DataFrame:
    """The chunks without their texts, with seg, dl (tokens) and tfs (the count of each); null texts have none."""
    kept = [f for f in chunks.schema.fields if f.name not in {text, "text", "indexed_text"}]
    names = [f.name for f in kept] + ["dl", "tfs"]
    schema = T.StructType([*kept, T.StructField("dl", T.IntegerType()), T.StructField("tfs", T.MapType(T.StringType(), T.IntegerType()))])

    def parts(batches):
        for batch in batches:
            for at, end in _stretches(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy().astype(np.int64), TEXT):
                yield batch.slice(at, end - at)

    def count(batches):
        for part in parts(batches):
            found = [Counter(t.split(" ")) if t else {} for t in part.column(part.num_columns - 1).to_pylist()]
            offsets = [0]
            for c in found:
                offsets.append(offsets[-1] + len(c))
            tfs = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([t for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int32()))
            dl = pa.array([sum(c.values()) for c in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], dl, tfs], names=names)

    listed = chunks.select(*(F.col(f"`{f.name}`") for f in kept), F.array_join(tokens(F.col(text)), " ").alias("__tokens"))
    return listed.mapInArrow(count, schema).withColumn("seg", F.lit(seg).cast("long"))


def in_shards(counted: DataFrame) -> DataFrame:
    """Adds shard and place: chunks that lie together in the input are together, in their order, so nothing is moved."""
    at = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.shiftright("__row", 33) * (1 << 24) + F.floor(at / SHARD)
    placed = counted.sortWithinPartitions("seq").withColumn("__row", F.monotonically_increasing_id())
    return placed.withColumns({"shard": shard.cast("long"), "place": (at % SHARD).cast("int")}).drop("__row")


def make_shards(chunks: DataFrame) -> DataFrame:
    """A row for each shard, of ``SHARD`` chunks at most."""
    member = F.struct("place", "chunk_id", "seq", "dl", F.col("doc_name").cast("string").alias("doc_name"), F.col("fiscal_year").cast("string").alias("fiscal_year"))
    return chunks.groupBy(*_PLACE).agg(F.array_sort(F.collect_list(member)).alias("members"))


_BLOCKS = "seg long, shard long, term string, n int, max_tf int, min_ratio double, at binary, tf binary"


def _shard_parts(batches, most: int):
    """Batches of chunks (seg, shard, place, dl, tfs) of one shard each; a shard that goes on in the next batch is joined, one of very many postings cut."""
    held, postings, of = [], 0, None
    for batch in batches:
        seg, shard = (batch.column(c).to_numpy() for c in (0, 1))
        sizes = np.diff(batch.column(4).offsets.to_numpy())
        cuts = np.flatnonzero((np.diff(seg) != 0) | (np.diff(shard) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(shard)] if len(shard) else []):
            for a, b in _stretches(sizes[begin:end], most):
                new = int(sizes[begin + a : begin + b].sum())
                if held and (of != (seg[begin], shard[begin]) or postings + new > most):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, postings = [], 0
                held.append(batch.slice(begin + a, b - a))
                of, postings = (seg[begin], shard[begin]), postings + new
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _runs_of_bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each run of the values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _blocks_of_parts(batches, most: int):
    """A word's postings in each part of a shard."""
    for part in _shard_parts(batches, most):
        seg, shard, place, dl, tfs = part.columns
        ends = tfs.offsets.to_numpy()
        row = np.repeat(np.arange(len(tfs), dtype=np.int32), np.diff(ends))
        if len(row):
            term, tf = tfs.keys.slice(ends[0], len(row)).dictionary_encode(), tfs.items.slice(ends[0], len(row)).to_numpy()
            of = term.indices.to_numpy()
            order = np.argsort(of, kind="stable")  # within a word in the order of the rows, so of their places
            of, tf, row = of[order], tf[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
            ends = np.append(first, len(row))
            same = [pa.array(np.full(len(first), c[0].as_py(), np.int64)) for c in (seg, shard)]
            bounds = [np.diff(ends).astype(np.int32), np.maximum.reduceat(tf, first), np.minimum.reduceat(dl.to_numpy()[row] / tf, first)]
            held = [_runs_of_bytes(place.to_numpy().astype(np.uint16)[row], ends), _runs_of_bytes(tf.astype(np.int32), ends)]
            yield pa.RecordBatch.from_arrays([*same, term.dictionary.take(pa.array(of[first])), *map(pa.array, bounds), *held], names=[c.split()[0] for c in _BLOCKS.split(", ")])


def make_blocks(chunks: DataFrame) -> DataFrame:
    """A word's postings in a shard, with what bounds their scores, made where the chunks lie: nothing is shuffled.

    A shard whose chunks are read by two tasks, or that has very many postings, has several blocks of a word, whose bounds add up.
    """
    return chunks.select(*_PLACE, "place", "dl", "tfs").mapInArrow(partial(_blocks_of_parts, most=POSTINGS), _BLOCKS)


def frequencies(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("n").alias("df"))


def lengths(counted: DataFrame) -> DataFrame:
    """(n, total): chunks and their tokens, in one row."""
    return counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total"))


def mean_length(lengths: DataFrame) -> DataFrame:
    """(n, avgdl) of rows (n, total)."""
    s = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"))
    return s.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avgdl"))


def build_index(chunks: DataFrame, text: str = "indexed_text") -> KeywordIndex:
    """An index that is not kept, from chunks (chunk_id, seq, text, doc_name, fiscal_year)."""
    placed = keep(in_shards(count_terms(chunks, text)), "chunks")
    blocks = keep(make_blocks(placed), "blocks")
    return KeywordIndex(placed, make_shards(placed), blocks, frequencies(blocks), mean_length(lengths(placed)))


def weigh(queries: DataFrame, index: KeywordIndex) -> DataFrame:
    """(query_id, term, w, avgdl) of the questions' words that the index has."""
    terms = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # The one row of corpus statistics.
    return terms.join(index.df, "term").crossJoin(index.stats).select("query_id", "term", "avgdl", (F.col("qtf") * F.log((F.col("n") + 1) / F.col("df"))).alias("w"))


def _bound(s: Settings) -> Column:
    """Of the parts of a block's postings: part grows with tf and falls with dl / tf."""
    return F.col("w") * (s.k1 + 1) / (s.k1 * (1 - s.b) / F.col("max_tf") + s.k1 * s.b * F.col("min_ratio") / F.col("avgdl") + 1)


def best_of_shard(words: list[tuple[float, float, np.ndarray, np.ndarray]], norm: np.ndarray, open_to: np.ndarray, floor: float, k: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, parts) of the k best open chunks and those as good as the last but for rounding, with parts of at least the floor.

    words: (bound, w, places, tfs) of each word's block by falling bound; norm: the chunks' part of the denominator.
    """
    rest = np.cumsum([x[0] for x in words][::-1])[::-1]
    part, least = np.zeros(len(norm)), floor
    for i, (_, w, places, tfs) in enumerate(words):
        top = part[open_to]
        if len(top) > k and rest[i] < top.max(initial=0.0):
            least = max(least, float(np.partition(top, -k)[-k]) - SLACK)
        if rest[i] < least:
            able = open_to[top + rest[i] >= least]
            for _, w, places, tfs in words[i:]:
                at = np.searchsorted(places, able)
                hit = at < len(places)
                hit[hit] = places[at[hit]] == able[hit]
                part[able[hit]] += w * (tfs[at[hit]] * gain / (norm[able[hit]] + tfs[at[hit]]))
            open_to = able
            break
        part[places] += w * (tfs * gain / (norm[places] + tfs))
    found = open_to[(part[open_to] > 0) & (part[open_to] >= least)]
    if len(found) > k:
        found = found[part[found] >= np.partition(part[found], -k)[-k] - SLACK]
        # Of equal parts, as copies have, the first k places are enough.
        found = found[np.lexsort((found, -part[found]))]
        begins = np.concatenate([[True], np.diff(part[found]) != 0])
        at = np.arange(len(found))
        found = found[at - np.maximum.accumulate(np.where(begins, at, 0)) < k]
    return found, part[found]


def _search_shards(pairs: DataFrame, weighted: DataFrame, wants: DataFrame, n_groups: int, index: KeywordIndex, k: int, s: Settings, few: bool = False) -> DataFrame:
    """(query_id, chunk_id, seq, part): the best chunks of each pair of a question and a shard (query_id, seg, shard, floor).

    few: each question has few of the shards, so of a shard just the blocks of its own questions' words are read.
    """
    ident, member = dict(weighted.dtypes)["query_id"], index.shards.schema["members"].dataType.elementType
    group = F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("group")
    asked = pairs.join(wants, "query_id").groupBy(*_PLACE, group).agg(F.collect_list(F.struct("query_id", "want_doc", "want_year", "floor")).alias("asked"))
    # Of a group of questions each word's block is sent to its shard once.
    by_word = weighted.groupBy(group, "term").agg(F.collect_list(F.struct("query_id", "w")).alias("by"), F.first("avgdl").alias("avgdl"))
    if few:
        needed = pairs.join(weighted, "query_id").select(*_PLACE, group, "term").distinct()
    else:
        needed = asked.select(*_PLACE, "group")
    blocks = by_word.join(index.blocks, "term").join(needed, needed.columns, "left_semi")
    words = blocks.groupBy(*_PLACE, "group").agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("by", "max_tf", "min_ratio", "at", "tf")).alias("words"))
    rows = asked.join(index.shards, _PLACE)
    if index.gone is not None:
        rows = rows.join(index.gone, _PLACE, "left")
    else:
        rows = rows.withColumn("places", F.lit(None).cast("array<int>"))
    # Last, as the words are by far the most and are then moved once.
    rows = rows.join(words, [*_PLACE, "group"])
    names, gain = ["query_id", "chunk_id", "seq", "part"], s.k1 + 1

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(*(batch.column(c)[row] for c in ("words", "asked", "members", "places", "avgdl")))

    def one(words, asked, members, places, avgdl):
        members, words, asked, avgdl = members.values, words.values, asked.values, avgdl.as_py()
        norm = s.k1 * (1 - s.b + s.b * members.field("dl").to_numpy() / avgdl)
        alive = np.ones(len(norm), bool)
        if places.is_valid:
            alive[places.values.to_numpy()] = False
        of: dict = {}
        facts = zip(words.field("by"), words.field("max_tf").to_pylist(), words.field("min_ratio").to_pylist(), words.field("at"), words.field("tf"))
        for by, max_tf, ratio, at, tfs in facts:
            at, tfs = np.frombuffer(at.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(tfs.as_buffer(), np.int32)
            for query_id, w in zip(by.values.field("query_id").to_pylist(), by.values.field("w").to_pylist()):
                of.setdefault(query_id, []).append((w * gain / (s.k1 * (1 - s.b) / max_tf + s.k1 * s.b * ratio / avgdl + 1), w, at, tfs))
        masks: dict = {}

        def mask(column, want):
            if (column, want) not in masks:
                masks[column, want] = pc.fill_null(pc.equal(members.field(column), want), False).to_numpy(zero_copy_only=False)
            return masks[column, want]

        ids, found, parts = [], [], []
        for a in asked.to_pylist():
            keep_to = alive
            for column, want in (("doc_name", a["want_doc"]), ("fiscal_year", a["want_year"])):
                if want:
                    keep_to = keep_to & mask(column, want)
            held = sorted(of.get(a["query_id"], []), key=lambda x: -x[0])
            if held and keep_to.any():
                at, part = best_of_shard(held, norm, np.flatnonzero(keep_to), a["floor"], k, gain)
                ids += [a["query_id"]] * len(at)
                found.append(at)
                parts.append(part)
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
        columns = [pa.array(ids, asked.field("query_id").type), members.field("chunk_id").take(at), members.field("seq").take(at), pa.array(np.concatenate([np.zeros(0), *parts]))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([pairs.schema["query_id"], T.StructField("chunk_id", member["chunk_id"].dataType), T.StructField("seq", member["seq"].dataType), T.StructField("part", T.DoubleType())])
    return rows.select("words", "asked", "members", "places", "avgdl").mapInArrow(run, schema)


def wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("doc_name").alias("want_doc"), F.col("fiscal_year").alias("want_year"))


def keyword_search(queries: DataFrame, index: KeywordIndex, settings: Settings = DEFAULTS, top_k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, seq, bm25_score, bm25_rank): the best chunks of each question that has a word of the index.

    Empty filters filter nothing, a null name or year of a chunk never matches.  A chunk without any of the
    words still has the constant part of the score.  Such chunks can only fill up a list that has too
    few others, so the first ``top_k`` chunks of the filtered order are enough of them.
    """
    k, s = top_k or settings.keyword_top_k, settings
    weighted, wants = keep(weigh(queries, index), "weighted"), keep(wanted(queries), "wanted")
    n_groups = -(-max(1, wants.count()) // QUESTIONS)
    base = weighted.groupBy("query_id").agg(F.sum(F.col("w") * s.delta).alias("base"))
    heads = index.blocks.select(*_PLACE, "term", "max_tf", "min_ratio")
    sums = weighted.join(heads, "term").groupBy("query_id", *_PLACE).agg(F.sum(_bound(s)).alias("bound"))
    search = lambda pairs, few=False: _search_shards(pairs, weighted, wants, n_groups, index, k, s, few)
    none = F.lit(float("-inf"))
    if index.shards.count() <= AT_ONCE:
        found = keep(search(sums.withColumn("floor", none)), "found")
    else:
        highest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), *_PLACE)) == 1
        pairs = keep(sums.withColumn("first", highest), "pairs")
        first = keep(search(pairs.where("first").withColumn("floor", none), True), "first")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
        floors = first.withColumn("r", place).where(F.col("r") == k).select("query_id", (F.col("part") - SLACK).alias("floor"))
        others = pairs.where("not first").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", none)).where(F.col("bound") >= F.col("floor"))
        found = keep(first.unionByName(search(keep(others.drop("bound", "first"), "others"))), "found")
    scored = found.unionByName(_fill(found, base, wants, index, k)).join(base, "query_id").withColumn("bm25_score", F.col("part") + F.col("base"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25_score", 9)), "seq")
    return scored.withColumn("bm25_rank", F.row_number().over(best)).where(F.col("bm25_rank") <= k).select("query_id", "chunk_id", "seq", "bm25_score", "bm25_rank")


def _fill(found: DataFrame, base: DataFrame, wants: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """The first chunks under the filters of each question that has found fewer than k, less those found."""
    key = lambda c: F.coalesce(F.col(c), F.lit(""))
    short = base.select("query_id").join(found.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < k)
    asked = short.join(wants, "query_id").select("query_id", key("want_doc").alias("fd"), key("want_year").alias("fy"))
    if asked.isEmpty():
        return found.where("false")
    # A chunk is in four filtered orders; only those that are asked for go on, each with its first k chunks.
    either = lambda c, name: F.array_distinct(F.array_compact(F.array(F.lit(""), F.col(c)))).alias(name)
    rows = index.live().select("chunk_id", "seq", F.explode(either("doc_name", "d")).alias("fd"), "fiscal_year")
    rows = rows.select("chunk_id", "seq", "fd", F.explode(either("fiscal_year", "y")).alias("fy")).join(asked.select("fd", "fy").distinct(), ["fd", "fy"])
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("fd", "fy").orderBy("seq"))).where(F.col("r") <= k)
    more = asked.join(first, ["fd", "fy"]).select("query_id", "chunk_id", "seq")
    return more.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("part", F.lit(0.0))
