"""Tables of a long run, kept between runs: each under a fingerprint of what it is made from, and made again only where that changed.

A table is written to a side folder and renamed when it is whole, so what a stopped run left behind is never read and the next run
goes on after its last whole table. Two runs at once may make the same table, of which one stays."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fieldloom.sources.tables import fingerprint


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:20]


def code_version() -> str:
    """Of the library's sources but the text operators, which no plan uses."""
    root = Path(__file__).resolve().parents[1]
    files = sorted(p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm")
    return _digest(*[(str(p.relative_to(root)), hashlib.sha256(p.read_bytes()).hexdigest()) for p in files])


def files_version(spark: SparkSession, path: str) -> str:
    """Of the names, sizes and times of the files at path, listed and summed up by Spark; their contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return fingerprint(listed).first()["fingerprint"]


@dataclass(frozen=True)
class Stage:
    """A kept table. reused: it was there before this run."""

    name: str
    key: str
    path: str
    reused: bool
    table: DataFrame


class Stages:
    """The tables of one folder. version: what stands for the code; by default all of the library, so any change of it makes all anew."""

    def __init__(self, spark: SparkSession, folder: str, version: str | None = None):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version or code_version()
        self.used: dict[str, Stage] = {}
        self._files: dict[str, str] = {}
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, name: str, make: Callable[..., DataFrame], *sources: Stage | str, **params: object) -> Stage:
        """The table make(*sources, **params), where a source is a kept table, given as a frame, or a path, given as it is. Taken from the
        folder where sources, parameters and code are those that it was made with."""
        key = _digest(name, self.version, [s.key if isinstance(s, Stage) else self._version_of(s) for s in sources], params)
        path = f"{self.folder}/{name}-{key}"
        reused = self._whole(path)
        if not reused:
            side = f"{self.folder}/.{name}-{key}-{uuid.uuid4().hex}"
            make(*[s.table if isinstance(s, Stage) else s for s in sources], **params).write.parquet(side)
            if not self._whole(path) and not self._fs.rename(self._fs_path(side), self._fs_path(path)):
                raise OSError(f"{side} can't become {path}")
        stage = Stage(name, key, path, reused, self.spark.read.parquet(path))
        self.used[stage.path] = stage
        return stage

    def drop_unused(self) -> list[str]:
        """Deletes the folder's tables, whole or begun, that this run hasn't used; their names. Not while another run uses the folder."""
        gone = []
        for at in self._fs.listStatus(self._fs_path(self.folder)):
            name = at.getPath().getName()
            if f"{self.folder}/{name}" not in self.used:
                self._fs.delete(at.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def _version_of(self, path: str) -> str:
        """As it was when this run first saw it."""
        if path not in self._files:
            self._files[path] = files_version(self.spark, path)
        return self._files[path]

    def _whole(self, path: str) -> bool:
        return self._fs.exists(self._fs_path(f"{path}/_SUCCESS"))
