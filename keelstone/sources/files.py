"""Folders and small files through Spark's own file systems, local or remote."""

from __future__ import annotations

import json
import zlib
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


#: Bytes of a file that an executor reads at once, at most.
LARGE = 256 << 20


class Files:
    """File operations below any path that Spark can reach."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def drop_at_exit(self, path: str) -> None:
        fs, p = self._at(path)
        fs.deleteOnExit(p)

    def rename(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to))

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def copy(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        other, q = self._at(to)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, self.conf)

    def write(self, path: str, data: bytes, overwrite: bool = False) -> None:
        """Create the file; an existing one is an error unless overwritten."""
        fs, p = self._at(path)
        out = fs.create(p, overwrite)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def sums(self, paths: list[str]) -> dict[str, dict[str, list[int]]]:
        """[length, CRC-32] of each data file in some table folders.

        Executors read the files, whole; one above LARGE, which few writers
        make, is read in blocks on the driver.
        """
        out: dict[str, dict[str, list[int]]] = {}
        for p in paths:
            fs, at = self._at(p)
            own = out.setdefault(p.rstrip("/").rpartition("/")[2], {})
            for s in fs.listStatus(at):
                if s.getPath().getName().startswith("part-") and s.getLen() > LARGE:
                    own[s.getPath().getName()] = [s.getLen(), self._sum(fs, s.getPath())]
        if paths:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).where(F.col("length") <= LARGE)
            for r in files.select("path", "length", F.crc32("content").alias("sum")).collect():  # a row per file
                folder, name = r["path"].split("/")[-2:]
                out[folder][name] = [r["length"], r["sum"]]
        return out

    def _sum(self, fs, path) -> int:
        total = self.jvm.java.util.zip.CRC32()
        stream = self.jvm.java.util.zip.CheckedInputStream(fs.open(path), total)
        try:
            self.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, self.jvm.org.apache.commons.io.output.NullOutputStream.INSTANCE)
        finally:
            stream.close()
        return total.getValue()


def sealed(meta: dict[str, Any]) -> tuple[bytes, bytes]:
    """A metadata document and its checksum line."""
    data = json.dumps(meta, sort_keys=True, indent=1).encode()
    return data, f"{zlib.crc32(data):08x}".encode()
