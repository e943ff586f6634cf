"""The vector index as tables: normalised vectors in cells, of which a search reads those that can matter.

Vectors near a centre are a cell of bounded size, stored with the centre, the largest distance from it and
the names and years it holds.  By the triangle inequality no vector of a cell can be closer to a
question than the centre's inner product plus the question's length times that radius.  A search
scores each question's best cells, takes the k-th score as a floor, and reads just the other cells whose bound
reaches it, so it finds the same as a search of everything.  How many cells that spares depends on
the vectors: random ones in many dimensions have no cells worth the name.

Batches of cells lie in folders that a manifest names: what a failed change has written is never
seen, and a retry does not double anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from .ingest import with_indexed_text
from .manifest import Manifest, remove_unnamed
from .scratch import goes_at_exit, keep, shared_folder
from .vectors import QUERY_BLOCK, best_rows, hashed_embedding, normalised, query_blocks, ranked_rows, unit_vectors

#: Vectors of a cell; vectors that the centres are fitted on, at most so many centres, rounds of fitting.
CELL, SAMPLE, CENTRES, ROUNDS = 1024, 16_384, 4096, 8
#: Cells that are searched without bounds; cells of each question that give its floor.
AT_ONCE, FIRST = 16, 4
SLACK = 1e-9


class NotEmpty(RuntimeError):
    """The target holds rows already."""


@dataclass
class VectorIndex:
    """cells: cell, n, centre, radius, docs and years (distinct), members (seq, chunk_id, doc_name, fiscal_year, vec; float64 bytes of unit length)."""

    cells: DataFrame


def fit_centres(sample: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Centres of about equal crowds of the sample's unit vectors; fewer if the sample is small."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def make_cells(rows: DataFrame) -> DataFrame:
    """Cells of rows (chunk_id, seq, vec, doc_name, fiscal_year); null vectors are left out, zero vectors stay.

    The centres are fitted on ``SAMPLE`` vectors chosen by a hash of their ids; every vector goes to its nearest
    centre, and a centre with many vectors has them dealt out over several cells.
    """
    unit = keep(unit_vectors(rows), "unit")
    n = unit.count()
    chosen = unit.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vec").toPandas()["vec"]
    sample = np.stack([np.frombuffer(v) for v in chosen]) if len(chosen) else np.zeros((1, 1))
    centres = fit_centres(sample, min(CENTRES, -(-max(1, n) // CELL)))
    names = [f.name for f in unit.schema.fields]

    def assign(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(names.index("vec")).to_pylist())).reshape(batch.num_rows, -1)
            at = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            gap = np.linalg.norm(x - centres[at], axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64)), pa.array(gap)], names=[*names, "near", "gap"])

    schema = T.StructType([*unit.schema.fields, T.StructField("near", T.LongType()), T.StructField("gap", T.DoubleType())])
    near = keep(unit.mapInArrow(assign, schema), "near")
    parts = near.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    dealt = near.join(parts, "near").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    member = F.struct("seq", "chunk_id", "doc_name", "fiscal_year", "vec")
    cells = dealt.groupBy("near", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.collect_set("doc_name").alias("docs"), F.collect_set("fiscal_year").alias("years"), F.array_sort(F.collect_list(member)).alias("members")
    )
    # Of bounded size: at most CENTRES rows.
    at = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "near long, centre array<double>")
    return cells.join(at, "near").select(F.xxhash64("near", "part", F.lit(uuid.uuid4().hex)).alias("cell"), "n", "centre", "radius", "docs", "years", "members")


def _bounds(batches, most: int | None):
    """(query_id, cell, bound) of the open cells whose bound reaches the question's floor; with ``most`` the task's best."""
    found: dict = {}
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(k)[r] for k, c in enumerate(batch.schema.names)}
            centre = row["centre"].values.to_numpy()
            asked = row["q_ids"].values.to_pylist()
            vecs = np.frombuffer(row["q_vecs"].as_buffer()).reshape(len(asked), -1)
            bound = vecs @ centre + row["radius"].as_py() * np.linalg.norm(vecs, axis=1) + SLACK
            docs, years, cell = set(row["docs"].as_py()), set(row["years"].as_py()), row["cell"].as_py()
            for i, (doc, year, floor) in enumerate(zip(row["q_docs"].as_py(), row["q_years"].as_py(), row["q_floors"].as_py())):
                if (not doc or doc in docs) and (not year or year in years) and (floor is None or bound[i] >= floor):
                    held = found.setdefault(asked[i], [])
                    held.append((float(bound[i]), cell))
                    if most and len(held) > 8 * most:
                        held.sort(reverse=True)
                        del held[most:]
    rows = [(q, c, b) for q, held in found.items() for b, c in sorted(held, reverse=True)[:most]]
    return list(zip(*rows)) if rows else [(), (), ()]


def _pairs(queries: DataFrame, index: VectorIndex, most: int | None = None, filtered: bool = True) -> DataFrame:
    """(query_id, cell, bound) of questions (query_id, vec, doc_name, fiscal_year, floor)."""
    kind = queries.schema["query_id"]
    asked = query_blocks(queries if filtered else queries.withColumns({c: F.lit(None).cast("string") for c in ("doc_name", "fiscal_year")}))
    heads = index.cells.select("cell", "centre", "radius", "docs", "years")

    def run(batches):
        # Each row has a block of questions with it, so no more than a batch is held; only the best are taken over all of them.
        first = next(batches, None)
        if first is None:
            return
        of, every = first.schema.field("q_ids").type.value_type, chain([first], batches)
        for some in [every] if most else ([x] for x in every):
            ids, cells, bounds = _bounds(some, most)
            yield pa.RecordBatch.from_arrays([pa.array(ids, of), pa.array(cells, pa.int64()), pa.array(bounds, pa.float64())], names=["query_id", "cell", "bound"])

    return heads.crossJoin(asked).mapInArrow(run, T.StructType([kind, T.StructField("cell", T.LongType()), T.StructField("bound", T.DoubleType())]))


def _score(queries: DataFrame, pairs: DataFrame | None, index: VectorIndex, cut: int, filtered: bool) -> DataFrame:
    """The best rows of each question in each of its cells (all cells if there are no pairs)."""
    if pairs is None:
        rows = query_blocks(queries).crossJoin(index.cells.select("members"))
    else:
        # A cell meets its questions in groups of bounded size.
        group = F.pmod(F.xxhash64("query_id"), F.lit(-(-max(1, queries.count()) // QUERY_BLOCK)))
        each = F.array_sort(F.collect_list(F.struct("query_id", "vec", "doc_name", "fiscal_year", "floor")))
        met = pairs.select("query_id", "cell").join(queries, "query_id").groupBy("cell", group.alias("group")).agg(each.alias("a"))
        columns = (("query_id", "q_ids"), ("doc_name", "q_docs"), ("fiscal_year", "q_years"), ("floor", "q_floors"))
        flat = F.flatten(F.col("a.vec"))
        rows = met.join(index.cells.select("cell", "members"), "cell").select(*(F.col(f"a.{c}").alias(n) for c, n in columns), flat.alias("q_flat"), "members")
    return best_rows(rows, queries, index.cells.schema["members"].dataType.elementType, cut, filtered)


def cells_to_read(queries: DataFrame, index: VectorIndex, cut: int, filtered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query_id, cell, bound) of all cells that can hold one of a question's best ``cut`` rows; and the questions with their floors."""
    open_floor = queries.withColumn("floor", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    first = _pairs(open_floor, index, FIRST, filtered).withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).drop("r")
    scored = _score(open_floor, keep(first, "first"), index, cut, filtered)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vector_score")))
    floors = scored.withColumn("r", place).where(F.col("r") == cut).select("query_id", (F.col("vector_score") - SLACK).alias("floor"))
    asked = keep(queries.join(floors, "query_id", "left"), "floors")
    return keep(_pairs(asked, index, None, filtered), "cells"), asked


def search_index(queries: DataFrame, index: VectorIndex, settings: Settings = DEFAULTS, top_k: int | None = None, overfetch: int | None = None) -> DataFrame:
    """(query_id, chunk_id, seq, vector_score, vector_rank), as :func:`vectors.vector_search` finds them in the same rows."""
    k = top_k or settings.vector_top_k
    cut, filtered = (k * overfetch, False) if overfetch else (k, True)
    asked = queries.where("vec is not null").select("query_id", normalised(F.col("vec")).alias("vec"), F.col("doc_name").cast("string"), F.col("fiscal_year").cast("string"))
    pairs = None
    if index.cells.count() > AT_ONCE:
        pairs, asked = cells_to_read(keep(asked, "asked"), index, cut, filtered)
    found = _score(asked, pairs, index, cut, filtered)
    return ranked_rows(found, k, cut, overfetch)


class VectorStore:
    """A vector index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifest = spark, folder.rstrip("/"), Manifest(spark, folder)

    def _batches(self) -> list[dict]:
        return self.manifest.read()

    def count(self) -> int:
        return sum(b["n"] for b in self._batches())

    def _write(self, rows: DataFrame) -> dict:
        """A batch written beside the others and counted; it counts once a manifest names it."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/cells/{name}"
        make_cells(rows).write.parquet(path)
        written = self.spark.read.parquet(path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        expected = rows.where("vec is not null").count()
        if written != expected:
            raise RuntimeError(f"{path} holds {written} vectors, not {expected}")
        return {"name": name, "n": written}

    def add(self, rows: DataFrame) -> int:
        """Add rows (chunk_id, seq, vec, doc_name, fiscal_year); returns how many the index then holds."""
        base, batches = self.manifest.version(), self._batches()
        self.manifest.commit(base, [*batches, self._write(rows)])
        return self.count()

    def replace(self, rows: DataFrame) -> int:
        """The rows in place of all there were; readers have the old ones until the new are whole."""
        base = self.manifest.version()
        self.manifest.commit(base, [self._write(rows)])
        return self.count()

    def vacuum(self) -> int:
        """Remove batches that the newest manifest does not name; not while a writer or readers of older versions are at work."""
        gone = remove_unnamed(self.spark, f"{self.folder}/cells", {b["name"] for b in self._batches()})
        self.manifest.forget_older()
        return gone

    def index(self) -> VectorIndex:
        batches = self._batches()
        if not batches:
            raise ValueError(f"{self.folder} holds no vectors")
        return VectorIndex(self.spark.read.parquet(*(f"{self.folder}/cells/{b['name']}" for b in batches)))


def reindex(chunks: DataFrame, target: str, embed: Callable[[Column], Column] = hashed_embedding, force: bool = False) -> int:
    """Embed the searched text of all chunks and add the vectors to the index in ``target``; returns how many it then holds.

    A target with rows is refused unless ``force``.  The new vectors are counted before they are named,
    so a run that fails leaves the target as it was, and the next one adds them once.
    """
    store = VectorStore(chunks.sparkSession, target)
    if store.count() and not force:
        raise NotEmpty(f"{target} has {store.count()} vectors")
    rows = chunks if "indexed_text" in chunks.columns else with_indexed_text(chunks)
    rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0))
    return store.add(rows.select("chunk_id", "seq", embed(F.col("indexed_text")).alias("vec"), "doc_name", "fiscal_year"))


_resident: dict[tuple, str] = {}


def resident_vector_index(spark: SparkSession, key: tuple, rows: Callable[[], DataFrame]) -> VectorIndex:
    """The index of the rows, made once in an application for each key (the state of their files) and kept as tables."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _resident:
        folder = goes_at_exit(spark, f"{shared_folder(spark)}/pagequarry-index/vectors-{uuid.uuid4().hex}")
        VectorStore(spark, folder).add(rows())
        _resident[key] = folder
    return VectorStore(spark, _resident[key]).index()
