"""The keyword index as tables: immutable segments under a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keyword
from .keyword import KeywordIndex
from .manifest import Manifest, remove_unnamed
from .scratch import goes_at_exit, hadoop_path, shared_folder


@dataclass(frozen=True)
class Segment:
    """One immutable folder of the index.  number: its age; it holds chunks, or the places of chunks that are deleted from older ones."""

    number: int
    name: str
    deletes: bool = False


class KeywordStore:
    """A keyword index in a folder, that is added to, deleted from and merged without being built anew.

    Every change writes a segment of its own and then a manifest that names the segments that count;
    readers take the newest whole manifest, so a change that fails is not seen, and what it has
    written goes with :meth:`vacuum`.  A deletion holds the chunks' places, and the counts that go with them as
    negative numbers: frequencies and lengths are sums over all segments, and are those of an
    index built from the chunks that are left.  A chunk that is added again is a new one.

    One writer at a time: a manifest of a number that is there already is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifest = spark, folder.rstrip("/"), Manifest(spark, folder)

    def version(self) -> int:
        return self.manifest.version()

    def segments(self, version: int | None = None) -> list[Segment]:
        return [Segment(**x) for x in self.manifest.read(version)]

    def _commit(self, base: int, segments: list[Segment]) -> int:
        return self.manifest.commit(base, [asdict(s) for s in segments])

    # -- changes --------------------------------------------------------------------------------

    def _path(self, segment: Segment, table: str) -> str:
        return f"{self.folder}/segments/{segment.name}/{table}"

    def _next(self, segments: list[Segment], deletes: bool = False) -> Segment:
        return Segment(max((s.number for s in segments), default=0) + 1, uuid.uuid4().hex, deletes)

    def _write(self, segment: Segment, counted: DataFrame) -> None:
        """A segment of chunks with their counts; all other tables are made from the stored ones."""
        keyword.in_shards(counted.withColumn("seg", F.lit(segment.number).cast("long"))).write.parquet(self._path(segment, "chunks"))
        chunks = self.spark.read.parquet(self._path(segment, "chunks"))
        keyword.lengths(chunks).write.parquet(self._path(segment, "lengths"))
        keyword.make_shards(chunks).write.parquet(self._path(segment, "shards"))
        # Sorted by term in each file, so questions read few row groups.
        keyword.make_blocks(chunks).sortWithinPartitions("term", "shard").write.parquet(self._path(segment, "blocks"))
        keyword.frequencies(self.spark.read.parquet(self._path(segment, "blocks"))).write.parquet(self._path(segment, "df"))

    def add(self, chunks: DataFrame, text: str = "indexed_text") -> int:
        """Add chunks (chunk_id, seq, text, doc_name, fiscal_year, and what else is to be kept); all have the columns of the first ones."""
        base, segments = self.version(), self.segments()
        new = self._next(segments)
        self._write(new, keyword.count_terms(chunks, text))
        return self._commit(base, [*segments, new])

    def delete(self, chunk_ids: DataFrame) -> int:
        """Delete chunks (chunk_id); ids that are not there, nulls and repeated ids are left out."""
        base, segments = self.version(), self.segments()
        if not segments:
            return base
        index, new = self.index(base), self._next(segments, True)
        there = index.live().join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("seg", "shard", "place", "dl", "tfs")
        # The counts that go with them are needed twice, so they are stored with the places.
        there.write.parquet(self._path(new, "gone"))
        gone = self.spark.read.parquet(self._path(new, "gone"))
        keyword.lengths(gone).select((-F.col("n")).alias("n"), (-F.col("total")).alias("total")).write.parquet(self._path(new, "lengths"))
        gone.select(F.explode(F.map_keys("tfs")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df")).write.parquet(self._path(new, "df"))
        return self._commit(base, [*segments, new])

    def merge(self) -> int:
        """All segments in one, from the stored counts: no text is read."""
        base, segments = self.version(), self.segments()
        if len(segments) < 2:
            return base
        index, new = self.index(base), self._next(segments)
        self._write(new, index.live().drop("shard", "place"))
        return self._commit(base, [new])

    def vacuum(self) -> int:
        """Remove segments that the newest manifest does not name, and older manifests; returns how many segments went.

        Not while readers of older versions or a writer are at work.
        """
        gone = remove_unnamed(self.spark, f"{self.folder}/segments", {s.name for s in self.segments()})
        self.manifest.forget_older()
        return gone

    # -- reading --------------------------------------------------------------------------------

    def _all(self, table: str, segments: list[Segment]) -> DataFrame:
        return self.spark.read.parquet(*(self._path(s, table) for s in segments))

    def index(self, version: int | None = None) -> KeywordIndex:
        """The index as of a version, the newest by default."""
        segments = self.segments(version)
        adds, deletes = [s for s in segments if not s.deletes], [s for s in segments if s.deletes]
        if not adds:
            raise ValueError(f"{self.folder} holds no segment")
        df = self._all("df", segments)
        if len(segments) > 1:
            df = df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        gone = self._all("gone", deletes).groupBy("seg", "shard").agg(F.array_sort(F.collect_list("place")).alias("places")) if deletes else None
        return KeywordIndex(*(self._all(t, adds) for t in ("chunks", "shards", "blocks")), df, keyword.mean_length(self._all("lengths", segments)), gone)


def resident_keyword_index(spark: SparkSession, sources: list[str], chunks: Callable[[], DataFrame]) -> KeywordIndex:
    """The keyword index of chunks made from the source files, built once in an application and kept as tables.

    Files that were added, removed or changed make another index.  The tables lie in the folder that
    all executors share, and go when the session ends.
    """
    key = (spark.sparkContext.applicationId, file_state(spark, sources))
    if key not in _resident:
        folder = f"{shared_folder(spark)}/pagequarry-index/keyword-{uuid.uuid4().hex}"
        KeywordStore(spark, goes_at_exit(spark, folder)).add(chunks())
        _resident[key] = folder
    return KeywordStore(spark, _resident[key]).index()


_resident: dict[tuple, str] = {}


def file_state(spark: SparkSession, files: list[str]) -> tuple:
    """What changes if files are added, removed or changed."""
    found = []
    for file in sorted(files):
        path, fs = hadoop_path(spark, file)
        status = fs.getFileStatus(path)
        found.append((file, status.getLen(), status.getModificationTime()))
    return tuple(found)
