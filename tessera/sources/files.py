"""Small files on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> None:
        """``new``: fail if the file is there; file systems do this atomically, so it serves as a lock."""
        p, fs = self._path(path)
        out = fs.create(p, not new)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def replace(self, source: str, target: str) -> None:
        """Rename over what is there, in one step."""
        s, _ = self._path(source)
        t, _ = self._path(target)
        fs = self.jvm.org.apache.hadoop.fs
        options = self.gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(t.toUri(), self.conf).rename(fs.FileContext.getFileContext(t.toUri(), self.conf).makeQualified(s), fs.FileContext.getFileContext(t.toUri(), self.conf).makeQualified(t), options)

    def size(self, path: str) -> int:
        """The bytes of a file or of all files of a folder."""
        p, fs = self._path(path)
        return fs.getContentSummary(p).getLength()

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)
