"""Folders that driver and executors share, and files that change by a rename."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local one, if all tasks run on this machine; else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Files:
    """A directory of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> object:
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(""))) if self.exists() else []

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def read(self, name: str) -> bytes:
        size = self.fs.getFileStatus(self.at(name)).getLen()
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Writes under another name and renames: the file is there whole or not at all. The name must be new."""
        new = self.at(f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(new, False)
        out.write(bytearray(data))
        out.close()
        if not self.fs.rename(new, self.at(name)):
            self.fs.delete(new, False)
            raise FileExistsError(f"{self.path}/{name}")


class Versions:
    """A small value that is replaced as a whole: each version is a file of its own, and the highest whole one holds.

    Nothing is deleted before its successor is there, so a crash at any moment leaves the old or the new value. Of two
    writers of one version one fails.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.files = Files(spark, path)

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names() if n[:1] == "v" and n[1:].isdigit())

    def load(self) -> bytes | None:
        for version in reversed(self._versions()):
            head, _, data = self.files.read(f"v{version:020d}").partition(b"\n")
            if head == b"%d" % len(data):
                return data
        return None

    def save(self, data: bytes) -> None:
        have = self._versions()
        self.files.write(f"v{(have[-1] + 1 if have else 0):020d}", b"%d\n" % len(data) + data)
        for version in have[:-1]:  # the one before stays until the next save
            self.files.delete(f"v{version:020d}")
