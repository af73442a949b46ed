"""Small files on any Hadoop file system, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


class Files:
    """The few driver-side file operations that a dataset's metadata needs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        if not fs.rename(p, self._at(to)[1]):
            raise OSError(f"can't move {path} to {to}")

    def write(self, path: str, data: bytes) -> None:
        """Written under another name and renamed over what is there, so that readers see the old bytes or the new."""
        fs, p = self._at(path)
        _, t = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        fs.setWriteChecksum(False)  # a checksum file of its own could not be replaced together with it
        try:
            out = fs.create(t, True)
            out.write(bytearray(data))
            out.close()
        finally:
            fs.setWriteChecksum(True)
        if not fs.rename(t, p):  # local files are replaced by a plain rename, others on demand
            kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
            how = self.spark.sparkContext._gateway.new_array(kind, 1)
            how[0] = kind.OVERWRITE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(t, p, how)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        """Bytes of all files below ``path``."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def sizes(self, path: str) -> dict[str, int]:
        """Bytes of every file directly below ``path``, by name."""
        fs, p = self._at(path)
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p)} if fs.exists(p) else {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, or a temporary one)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="quern-"))
        folder = _FALLBACK[0]
    return f"{folder.rstrip('/')}/quern/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
