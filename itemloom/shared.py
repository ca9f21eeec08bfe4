"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset: a folder of our own if Spark runs inside one process
    (``local[n]``, as in tests), else an error, since executors on other
    machines would not see this machine's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="itemloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Small file operations of the driver, in whatever store a path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def qualified(self, path: str) -> str:
        """The path as Spark's file columns spell it."""
        store, at = self._at(path)
        return store.makeQualified(at).toString()

    def exists(self, path: str) -> bool:
        store, at = self._at(path)
        return store.exists(at)

    def sizes(self, folder: str) -> dict[str, int]:
        """Names and bytes of the data files below a folder (marker and checksum files left out); empty where there is none."""
        store, at = self._at(folder)
        out: dict[str, int] = {}
        if store.exists(at):
            root, files = len(self.qualified(folder)) + 1, store.listFiles(at, True)
            while files.hasNext():
                f = files.next()
                name = f.getPath().toString()[root:]
                if not name.rpartition("/")[2].startswith(("_", ".")):
                    out[name] = f.getLen()
        return out

    def text(self, path: str) -> str | None:
        store, at = self._at(path)
        if not store.exists(at):
            return None
        source = store.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def put(self, path: str, text: str) -> None:
        """A whole file at once: written beside its place, then renamed into it."""
        store, at = self._at(path)
        _, beside = self._at(f"{path}.new")
        sink = store.create(beside, True)
        try:
            self.jvm.org.apache.commons.io.IOUtils.write(text, sink, "UTF-8")
        finally:
            sink.close()
        store.delete(at, False)
        if not store.rename(beside, at):
            raise OSError(f"can't rename into {path}")

    def delete(self, path: str) -> None:
        store, at = self._at(path)
        store.delete(at, True)
