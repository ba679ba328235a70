"""The few file operations a commit log needs, on local disks and on Hadoop file systems."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import SparkSession


class LocalFiles:
    """Files below a local (or mounted) folder."""

    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def url(self, name: str) -> str:
        """The path that Spark reads."""
        return f"file://{self.root}/{name}"

    def create(self, name: str, data: bytes) -> None:
        """Writes a new file; FileExistsError if it is there. Readers see all of it or nothing."""
        path = self.root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        draft = path.with_name(f".{path.name}.{os.getpid()}.{os.urandom(4).hex()}")
        with open(draft, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, path)  # fails if the name is taken
        finally:
            draft.unlink()
        folder = os.open(path.parent, os.O_RDONLY)  # the name lasts, too
        try:
            os.fsync(folder)
        finally:
            os.close(folder)

    def append(self, name: str, data: bytes, sync: bool = False) -> None:
        """Adds to a file."""
        path = self.root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, "ab") as f:
            f.write(data)
            f.flush()
            if sync:
                os.fsync(f.fileno())

    def read(self, name: str) -> bytes:
        return (self.root / name).read_bytes()

    def exists(self, name: str) -> bool:
        return (self.root / name).exists()

    def list(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        path = self.root / folder
        return sorted(p.name for p in path.iterdir() if not p.name.startswith(".")) if path.is_dir() else []

    def delete(self, name: str) -> None:
        path = self.root / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)


class HadoopFiles:
    """The same through the driver's Hadoop client, for any scheme Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.parts = 0

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str, data: bytes) -> None:
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:
            if self.fs.exists(self._path(name)):
                raise FileExistsError(name) from e
            raise
        out.write(bytearray(data))
        out.close()

    def append(self, name: str, data: bytes, sync: bool = False) -> None:
        """A file of its own for each call, read back together: object stores cannot append."""
        self.parts += 1
        self.create(f"{name}.{self.parts:08}.{os.urandom(4).hex()}", data)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        data = self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        stream.close()
        return bytes(data)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def files(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    """Access to a table's folder."""
    return LocalFiles(root) if root.startswith(("/", "file:///")) or "://" not in root else HadoopFiles(spark, root)
