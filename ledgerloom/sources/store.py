"""Small files and renames in whatever file system Spark reads (Hadoop's FileSystem, from the driver)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm, self.root = spark, spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> None:
        """Move, replacing what stands there; for a file in one step, so readers find the old or the new one."""
        self._fs.mkdirs(self._path(new).getParent())
        if self.exists(new) and self._fs.getFileStatus(self._path(new)).isDirectory():
            self.delete(new)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(old), self._path(new), how)

    def rename_new(self, old: str, new: str) -> bool:
        """Move a file in one step, unless something stands there."""
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(old), self._path(new), how)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        except Py4JJavaError as error:
            raise OSError(f"{self.at(name)} can't be read") from error
        finally:
            source.close()

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getLen()

    def sha256(self, name: str) -> str:
        """Of a file's bytes, streamed: memory doesn't grow with the file."""
        source = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(source)
        finally:
            source.close()
