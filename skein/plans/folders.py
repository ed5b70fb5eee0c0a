"""Folders of a store through Hadoop's file systems, so that any path Spark can read will do."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folders:
    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        self._root = root
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def match(self, pattern: str) -> list[str]:
        """The paths below the root that fit a pattern, relative to it and in order."""
        found = self._fs.globStatus(self._path(f"{self._root}/{pattern}")) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(str(f.getPath().toString()).rsplit("/", depth)[1:]) for f in found)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self._root}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self._root}/{name}"), True)

    def read_json(self, name: str):
        stream = self._fs.open(self._path(f"{self._root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write_json(self, name: str, value) -> None:
        out = self._fs.create(self._path(f"{self._root}/{name}"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def key_folder(self, key: str, value: str) -> str:
        """The name of a partition's folder, as Spark writes it."""
        return self._utils.getPartitionPathString(key, value)

    def value_of(self, folder: str) -> str:
        return self._utils.unescapePathName(folder.partition("=")[2])
