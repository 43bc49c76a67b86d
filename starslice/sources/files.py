"""Small control files and folders in whatever store the session can reach (manifests, pointers): no row of data passes here."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A folder of a store, through the session's own file system configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self):
        return self._at().getFileSystem(self._conf)

    def read_json(self, name: str) -> dict | None:
        """The object of a JSON file, None if there is no such file."""
        if not self._system().exists(self._at(name)):
            return None
        stream = self._system().open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_json(self, name: str, value: dict) -> None:
        """Write a JSON file whole and move it into place, over the one before: a reader sees either the old one or the new one."""
        staged = f"{name}.{value.get('version', 'new')}"
        stream = self._system().create(self._at(staged), True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf).rename(self._at(staged), self._at(name), options)

    def folders(self) -> list[str]:
        """Names of the subfolders, ascending."""
        if not self._system().exists(self._at()):
            return []
        return sorted(s.getPath().getName() for s in self._system().listStatus(self._at()) if s.isDirectory())

    def delete(self, name: str) -> None:
        self._system().delete(self._at(name), True)
