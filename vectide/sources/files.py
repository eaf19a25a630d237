"""Folders and small files on any file system that Spark can write to: local, mounted, or remote by its address."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Place:
    """A path, with what versioned tables need of it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.text = spark, str(path).rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._at, conf = fs.Path(self.text), spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at.getFileSystem(conf)
        self._context = fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def __str__(self) -> str:
        return self.text

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self.text}/{name}")

    @property
    def name(self) -> str:
        return self._at.getName()

    def with_name(self, name: str) -> Place:
        return Place(self.spark, f"{self.text.rsplit('/', 1)[0]}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def make(self) -> None:
        self._fs.mkdirs(self._at)

    def folders(self) -> list[str]:
        """The names of the folders within."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at) if s.isDirectory())

    def read(self) -> str:
        stream = self._fs.open(self._at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str) -> None:
        """Replaces the file in one step: readers see the old text or the new one."""
        fresh = self.with_name(f"{self.name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(fresh._at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        fresh.move(self, over=True)

    def move(self, to: Place, over: bool = False) -> None:
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if over else kind.NONE
        self._context.rename(self._at, to._at, how)

    def remove(self) -> None:
        """The file, or the folder with all in it."""
        self._fs.delete(self._at, True)
