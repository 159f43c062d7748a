"""A small key-value store over any file system that Spark reaches: one JSON file a version of a key, written whole."""

from __future__ import annotations

import json
import re
import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = re.compile(r"(.*)~(\d{12})\.json")


class KeyValueStore:
    """For control-plane state (tasks), which is small, with one writer. Values are JSON; a key holds until it is deleted.

    A value is a new file, renamed to its place when it is complete; the newest version of a key counts and older ones
    go afterwards. A crash between leaves the old value or both, so a reader always finds the old value or the new one.
    """

    def __init__(self, spark: SparkSession, path: str, private: bool = False):
        """private: only the owner may look into the folder."""
        self.spark, self.path, self.private = spark, path.rstrip("/"), private
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> dict[str, list[int]]:
        """The versions of each quoted key, oldest first."""
        if not self._fs.exists(self._path(self.path)):
            return {}
        found: dict[str, list[int]] = {}
        for status in self._fs.listStatus(self._path(self.path)):
            if m := FILE.fullmatch(status.getPath().getName()):
                found.setdefault(m[1], []).append(int(m[2]))
        return {k: sorted(v) for k, v in found.items()}

    def _file(self, quoted: str, version: int) -> str:
        return f"{self.path}/{quoted}~{version:012d}.json"

    def set(self, key: str, value) -> None:
        """Write or replace; a reader sees the old value or the new one."""
        quoted = urllib.parse.quote(key, safe="")
        if self.private and not self._fs.exists(self._path(self.path)):
            self._fs.mkdirs(self._path(self.path))
            self._fs.setPermission(self._path(self.path), self._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
        old = self._versions().get(quoted, [])
        part = self._path(f"{self.path}/.{quoted}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"key": key, "value": json.dumps(value)}).encode()))
        out.close()
        if not self._fs.rename(part, self._path(self._file(quoted, old[-1] + 1 if old else 0))):
            raise OSError(f"{key} could not be written")
        for v in old:
            self._fs.delete(self._path(self._file(quoted, v)), False)

    def _read(self, quoted: str, versions: list[int]):
        for _ in range(20):  # a version may go between the listing and the read, as a newer one is there
            if not versions:
                break
            try:
                stream = self._fs.open(self._path(self._file(quoted, versions[-1])))
            except Py4JJavaError:
                versions = self._versions().get(quoted, [])
                continue
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            return json.loads(json.loads(text)["value"])
        raise KeyError(urllib.parse.unquote(quoted))

    def get(self, key: str):
        """The value; KeyError if there is none."""
        quoted = urllib.parse.quote(key, safe="")
        return self._read(quoted, self._versions().get(quoted, []))

    def prefix(self, prefix: str) -> dict:
        """All pairs whose key begins with prefix."""
        found = {urllib.parse.unquote(k): (k, v) for k, v in self._versions().items()}
        return {k: self._read(*found[k]) for k in sorted(found) if k.startswith(prefix)}

    def delete(self, key: str) -> None:
        quoted = urllib.parse.quote(key, safe="")
        for v in self._versions().get(quoted, []):  # the oldest first, so that a crash can't bring back an old value
            self._fs.delete(self._path(self._file(quoted, v)), False)

    def frame(self, prefix: str = "") -> DataFrame:
        """key, value (JSON) as a DataFrame; a file that isn't JSON fails the read."""
        schema = "key string, value string"
        files = [self._file(k, v[-1]) for k, v in self._versions().items()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(files).filter(F.col("key").startswith(prefix))
