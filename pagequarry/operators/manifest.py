"""A folder of numbered manifests: which parts of a table count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from .scratch import hadoop_path


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Manifest:
    """Each manifest is a list of records, written aside and given its name in one step; readers take the newest.

    One writer at a time: a number that is there already is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/manifest"

    def _names(self) -> list[str]:
        p, fs = hadoop_path(self.spark, self.folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self._names() if n.endswith(".json") and n[0] not in "._"), default=0)

    def read(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if not version:
            return []
        return json.loads(self.spark.read.text(f"{self.folder}/{version:08}.json", wholetext=True).first().value)

    def commit(self, base: int, records: list[dict]) -> int:
        """The number of the new manifest; ``base`` is the one that the change was made from."""
        final, fs = hadoop_path(self.spark, f"{self.folder}/{base + 1:08}.json")
        aside, _ = hadoop_path(self.spark, f"{self.folder}/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(records).encode()))
        out.close()
        if self.version() != base or fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise Conflict(f"{final} is there already")
        return base + 1

    def forget_older(self) -> None:
        version = self.version()
        for name in self._names():
            if name != f"{version:08}.json":
                p, fs = hadoop_path(self.spark, f"{self.folder}/{name}")
                fs.delete(p, False)


def remove_unnamed(spark: SparkSession, folder: str, named: set[str]) -> int:
    """Delete what lies in the folder under other names; returns how many that were."""
    p, fs = hadoop_path(spark, folder)
    dead = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in named] if fs.exists(p) else []
    for x in dead:
        fs.delete(x, True)
    return len(dead)
