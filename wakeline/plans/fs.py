"""Files through Hadoop's file systems, so that a store may lie on any of them."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def move(self, old: str, new: str) -> None:
        target = self._path(new)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(old), target):
            raise OSError(f"can't move {old} to {new}")

    def names(self, path: str) -> list[tuple[str, int, bool]]:
        """(name, bytes, is a folder) of what lies in a folder."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self._fs.listStatus(self._path(path)))

    def walk(self, path: str, suffix: str) -> list[str]:
        out = []
        for name, _, folder in self.names(path):
            out += self.walk(f"{path}/{name}", suffix) if folder else [f"{path}/{name}"] if name.endswith(suffix) else []
        return out

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: into a file beside it, then renamed."""
        partial = f"{path}.partial"
        out = self._fs.create(self._path(partial), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._path(path), False)
        self.move(partial, path)
