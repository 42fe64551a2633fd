"""Small files on any file system that Spark knows: settings, names, the results of writers."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path or URI, through Hadoop's file systems; it need not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def of(self, name: str) -> str:
        """Path of something in the folder."""
        return f"{self.path}/{name}"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name) if name else self._root

    def names(self, suffix: str = "") -> list[str]:
        """Names in the folder, in order; none where there is no folder."""
        if not self._fs.exists(self._root):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._root)) if n.endswith(suffix))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A whole file, in place of an older one."""
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    def move(self, name: str, new: str) -> None:
        """Rename within the folder, in place of an older file."""
        self._fs.mkdirs(self._path(new).getParent())
        if self.exists(new):
            self.delete(new)
        if not self._fs.rename(self._path(name), self._path(new)):
            raise OSError(f"{self.of(name)} can't be moved to {self.of(new)}")

    def delete(self, name: str) -> None:
        """A file or a folder with all that it holds; nothing happens where there is none."""
        self._fs.delete(self._path(name), True)
