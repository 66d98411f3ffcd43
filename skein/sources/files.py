"""Small files and folders on any file system that Hadoop knows: local, HDFS, object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its URL; all calls go through the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.setWriteChecksum(False)
        self._fs.mkdirs(root)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def url(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist yet: under a name of its own first, then renamed, which fails where the name is taken."""
        import uuid

        own = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(own), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(own), self._at(name)):
            self._fs.delete(self._at(own), False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()
