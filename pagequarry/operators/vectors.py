"""Vector search: exact inner products of normalised vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings

QUERY_BLOCK, ROW_BLOCK = 256, 4096


def normalised(v: Column) -> Column:
    """Divided by the length; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(normalised(a), normalised(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


_MEMBER = ("seq", "chunk_id", "doc_name", "fiscal_year", "vec")


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(seq, chunk_id, doc_name, fiscal_year, vec) with the vectors as float64 bytes of unit length; zero vectors stay, null ones are left out."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0).cast("bigint")
    chosen = rows.where("vec is not null").select(seq.alias("seq"), "chunk_id", F.col("doc_name").cast("string"), F.col("fiscal_year").cast("string"), F.col("vec").cast("array<double>").alias("vec"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("vec", T.BinaryType())])

    def pack(batches):
        for batch in batches:
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(length == 0, 1.0, length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([v.tobytes() for v in x], pa.binary())], names=list(_MEMBER))

    return chosen.mapInArrow(pack, schema)


def _member_blocks(rows: DataFrame, size: int = ROW_BLOCK) -> DataFrame:
    """(members): unit vectors in blocks of at most ``size``, made where the rows are: nothing is shuffled."""
    unit = unit_vectors(rows)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                members = pa.StructArray.from_arrays(part.columns, names=list(_MEMBER))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)], names=["members"])

    return unit.mapInArrow(pack, T.StructType([T.StructField("members", T.ArrayType(unit.schema))]))


def query_blocks(queries: DataFrame) -> DataFrame:
    """(q_ids, q_vecs, q_docs, q_years, q_floors): questions (query_id, vec, doc_name, fiscal_year, floor if there is one) in blocks of at most ``QUERY_BLOCK``.

    The blocks are gathered by their measured size, so the rows are read once for each of few partitions of them.
    """
    floor = F.col("floor") if "floor" in queries.columns else F.lit(None).cast("double")
    chosen = queries.where("vec is not null").select("query_id", "vec", F.col("doc_name").cast("string"), F.col("fiscal_year").cast("string"), floor.alias("floor"))
    ident = chosen.schema["query_id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                ids, vecs, docs, years, floors = batch.slice(at, QUERY_BLOCK).columns
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, docs, years, floors)]
                run = pa.array([vecs.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([lists[0], run, *lists[1:]], names=["q_ids", "q_vecs", "q_docs", "q_years", "q_floors"])

    return chosen.mapInArrow(pack, f"q_ids array<{ident}>, q_vecs binary, q_docs array<string>, q_years array<string>, q_floors array<double>").hint("rebalance")


def _matrix(vecs: pa.BinaryArray) -> np.ndarray:
    """The vectors of a block, without a copy: their bytes lie one after the other."""
    begin, end = (vecs.buffers()[1][4 * (vecs.offset + i) : 4 * (vecs.offset + i) + 4].to_pybytes() for i in (0, len(vecs)))
    begin, end = (int.from_bytes(x, "little") for x in (begin, end))
    return np.frombuffer(vecs.buffers()[2], np.uint8)[begin:end].view(np.float64).reshape(len(vecs), -1)


def best_rows(rows: DataFrame, queries: DataFrame, member: T.StructType, cut: int, filtered: bool) -> DataFrame:
    """(query_id, chunk_id, seq, vector_score, doc_name, fiscal_year, want_doc, want_year): each block of questions in each block of members.

    rows: q_ids, q_vecs (bytes) or q_flat (doubles), q_docs, q_years, q_floors, members.  Only the best of a block go
    on, with all that equal the last of them, and none under the question's floor.
    """
    names = ["query_id", "chunk_id", "seq", "vector_score", "doc_name", "fiscal_year", "want_doc", "want_year"]
    schema = T.StructType([queries.schema["query_id"], member["chunk_id"], member["seq"], T.StructField("vector_score", T.DoubleType()), *(T.StructField(n, T.StringType()) for n in names[4:])])
    flat = "q_flat" in rows.columns

    def match(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                asked, want_docs, want_years, floors, members = (batch.column(batch.schema.names.index(c))[r].values for c in ("q_ids", "q_docs", "q_years", "q_floors", "members"))
                vecs = batch.column(batch.schema.names.index("q_flat" if flat else "q_vecs"))[r]
                a = (vecs.values.to_numpy() if flat else np.frombuffer(vecs.as_buffer())).reshape(len(asked), -1)
                near = np.round(a @ _matrix(members.field("vec")).T, 9)
                masks: dict = {}
                of, at = [], []
                for i, (doc, year, floor) in enumerate(zip(want_docs.to_pylist(), want_years.to_pylist(), floors.to_pylist())):
                    open_to = np.ones(near.shape[1], bool) if floor is None else near[i] >= floor - 1e-9
                    for column, want in (("doc_name", doc), ("fiscal_year", year)) if filtered else ():
                        if want:
                            if (column, want) not in masks:
                                masks[column, want] = pc.fill_null(pc.equal(members.field(column), want), False).to_numpy(zero_copy_only=False)
                            open_to = open_to & masks[column, want]
                    best = np.flatnonzero(open_to)
                    if len(best) > cut:  # all that reach the last place
                        best = best[near[i, best] >= np.partition(near[i, best], -cut)[-cut]]
                    of.append(np.full(len(best), i))
                    at.append(best)
                of, at = np.concatenate(of), np.concatenate(at)
                left, right = pa.array(of), pa.array(at)
                found = [asked.take(left), members.field("chunk_id").take(right), members.field("seq").take(right), pa.array(near[of, at]), members.field("doc_name").take(right), members.field("fiscal_year").take(right), want_docs.take(left), want_years.take(left)]
                yield pa.RecordBatch.from_arrays(found, names=names)

    return rows.mapInArrow(match, schema)


def ranked_rows(found: DataFrame, k: int, cut: int, overfetch: int | None) -> DataFrame:
    """(query_id, chunk_id, seq, vector_score, vector_rank) of what :func:`best_rows` has found; with ``overfetch`` filtered after the cut."""
    order = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "seq")
    ranked = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cut)
    if overfetch:
        no = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
        ranked = ranked.where((no("want_doc") | F.col("want_doc").eqNullSafe(F.col("doc_name"))) & (no("want_year") | F.col("want_year").eqNullSafe(F.col("fiscal_year"))))
        ranked = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return ranked.select("query_id", "chunk_id", "seq", "vector_score", F.col("r").alias("vector_rank"))


def vector_search(queries: DataFrame, rows: DataFrame, settings: Settings = DEFAULTS, top_k: int | None = None, overfetch: int | None = None) -> DataFrame:
    """(query_id, chunk_id, seq, vector_score, vector_rank), from rows that are in no index; scores are rounded to 9 places.

    queries: query_id, vec, doc_name, fiscal_year (may be null); rows: chunk_id, seq, vec, doc_name,
    fiscal_year.  The filters are applied before the cut; with ``overfetch`` after a cut at so many
    times ``top_k``, which may leave fewer.  Blocks of queries meet blocks of rows, so a task holds
    one of each at a time, and only the best of a block go on.  A query or row without a vector finds
    nothing and is not found; all vectors have one length.
    """
    k = top_k or settings.vector_top_k
    cut = k * overfetch if overfetch else k
    asked = queries.where("vec is not null").withColumn("vec", normalised(F.col("vec")))
    # A few hundred rows of blocks, not of vectors.
    blocks = _member_blocks(rows)
    found = best_rows(query_blocks(asked).crossJoin(blocks), queries, blocks.schema["members"].dataType.elementType, cut, not overfetch)
    return ranked_rows(found, k, cut, overfetch)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed tokens, made in one pass over them.

    Null texts have a null vector, texts without tokens the zero vector.
    """
    from ..functions.text import tokens

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def counted(hashes: pd.Series) -> pd.Series:
        def one(h):
            if h is None:
                return None
            h = np.asarray(h, np.int64)
            return np.bincount(h % dim, weights=np.where(h < 0, -1.0, 1.0), minlength=dim).astype(np.float32)

        return hashes.map(one)

    return counted(F.transform(tokens(text), lambda t: F.xxhash64(t)))
