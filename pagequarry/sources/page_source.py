"""A data source of pages: ``spark.read.format("document_pages")`` over a folder of files."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .readers import page_text

SCHEMA = "file string, page_number int, n_pages int, text string, error string"


@dataclass
class PageRange(InputPartition):
    """Part ``part`` of ``parts`` of a file's pages."""

    file: str
    part: int
    parts: int


def _named(name: str | None) -> Callable[[bytes], Sequence] | None:
    """The extractor at ``module:attribute``."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.first, self.second = options["first"], options.get("second")
        self.split = int(options.get("splitBytes", 64 << 20))
        self.only: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Files and pages asked for by equality are found without reading others; Spark applies every filter again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("file",), ("page_number",)):
                self.only[f.attribute[0]] = f.value
            yield f

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if ":/" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> Sequence[InputPartition]:
        """Files by name, large ones in several ranges of pages; only the listing is read here."""
        files, root = self._fs()
        found = []
        for info in sorted(files.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            name = info.path[len(root) :].lstrip("/")
            if info.is_file and name.endswith(self.suffix) and self.only.get("file", name) == name:
                parts = max(1, -(-info.size // self.split))
                found += [PageRange(name, k, parts) for k in range(parts)]
        return found

    def read(self, partition: PageRange) -> Iterator[tuple]:
        files, root = self._fs()
        with files.open_input_file(f"{root.rstrip('/')}/{partition.file}") as f:
            content = f.read()
        first, second = _named(self.first), _named(self.second)
        try:
            yield from self._pages(partition, first(content), second, content)
        except Exception as e:
            if second is not None:
                try:
                    yield from self._pages(partition, second(content), None, content)
                    return
                except Exception as other:
                    e = other
            if partition.part == 0:
                yield partition.file, 0, None, None, f"{type(e).__name__}: {e}"

    def _pages(self, partition: PageRange, pages: Sequence, second, content: bytes) -> list[tuple]:
        n, out, others = len(pages), [], None
        for i in range(n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts):
            if self.only.get("page_number", i + 1) != i + 1:
                continue
            text = page_text(*pages[i])
            if not text and second is not None:
                try:
                    others = second(content) if others is None else others
                    text = page_text(*others[i]) if i < len(others) else ""
                except Exception:  # the page stays empty
                    others = []
            out.append((partition.file, i + 1, n, text, None))
        return out


class PageSource(DataSource):
    """Pages of the files in a folder.

    Options: path, a folder that pyarrow can open; first and second, extractors as ``module:attribute``; suffix of
    the files; splitBytes, from which on a file is read in several ranges of pages.  An extractor takes a file's bytes and
    returns a sequence of (text, tables); one that extracts a page when it is asked for does only its range.

    A page without text takes the second extractor's.  A file on which the first one fails is read with the
    second (of a file in ranges, the ranges on which it fails); one on which both fail has one row, page 0, with the error.
    """

    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path") or not self.options.get("first"):
            raise ValueError("the options path and first are needed")
        return PageReader({k: self.options.get(k) for k in ("path", "first", "second")} | {k: self.options[k] for k in ("suffix", "splitBytes") if k in self.options})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
