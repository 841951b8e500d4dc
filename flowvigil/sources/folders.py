"""Folders of the cluster's file store, through Hadoop's file API: what a DataFrame does not do.

Paths may be of any store that Spark reads. Nothing here reads data files.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_folder: bool


class Folders:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        store, where = self._at(path)
        return store.exists(where)

    def matching(self, pattern: str) -> list[Entry]:
        """Files and folders that match a glob pattern, by path; none when nothing does."""
        store, where = self._at(pattern)
        found = store.globStatus(where) or []
        return sorted((Entry(s.getPath().toString(), s.getPath().getName(), s.isDirectory()) for s in found), key=lambda e: e.path)

    def content(self, path: str) -> tuple[int, int]:
        """(files, bytes) below a path, from the store's own summary."""
        store, where = self._at(path)
        summary = store.getContentSummary(where)
        return summary.getFileCount(), summary.getLength()

    def create_new(self, path: str, text: str) -> bool:
        """Write a small file unless there is one: False then. Only one of several writers at once gets True."""
        store, where = self._at(path)
        try:
            out = store.create(where, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or store.exists(where):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def delete(self, path: str) -> bool:
        """Remove a path and all below it; False when it is not there, as after a repeated call."""
        store, where = self._at(path)
        return store.delete(where, True)
