"""Versions of a set of tables in a folder that Spark's file systems reach.

A version is written to a staging folder and becomes visible by one rename;
its manifest names its files and their sizes. What a writer that died has left
in staging is never read, and goes with the next commit. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    keep: int = 1  # versions that stay

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self) -> list[str]:
        fs, root = self._fs(), self._path(self.root)
        return sorted(f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()) if fs.exists(root) else []

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        return [int(f[1:]) for f in self._folders() if f.startswith("v")]

    def at(self, name: str, version: int | None = None) -> str:
        """Where a table of a version is; of the newest one without version."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no version in {self.root}")
        return f"{self.root}/v{found[-1] if version is None else version:08d}/{name}"

    def commit(self, tables: dict[str, tuple[DataFrame, str, dict[str, str]]]) -> int:
        """Write tables (name: rows, format, options) as the next version and let the oldest ones beyond keep go."""
        fs = self._fs()
        for left in self._folders():
            if left.startswith("_staging"):
                fs.delete(self._path(f"{self.root}/{left}"), True)
        staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        fs.mkdirs(self._path(staging))
        for name, (df, kind, options) in tables.items():
            df.write.format(kind).options(**options).save(f"{staging}/{name}")
        files, listed = {}, fs.listFiles(self._path(staging), True)
        base = len(fs.makeQualified(self._path(staging)).toString()) + 1
        while listed.hasNext():
            f = listed.next()
            files[f.getPath().toString()[base:]] = f.getLen()
        version = max(self.versions(), default=0) + 1
        out = fs.create(self._path(f"{staging}/{MANIFEST}"))
        out.writeBytes(json.dumps({"version": version, "files": files}, sort_keys=True))
        out.close()
        if not fs.rename(self._path(staging), self._path(f"{self.root}/v{version:08d}")):
            raise OSError(f"version {version} of {self.root} could not be committed")
        for old in self.versions()[: -self.keep]:
            fs.delete(self._path(f"{self.root}/v{old:08d}"), True)
        return version

    def manifest(self, version: int | None = None) -> dict:
        """version, and files with their sizes."""
        return json.loads(self.spark.read.text(self.at(MANIFEST, version), wholetext=True).first()[0])
