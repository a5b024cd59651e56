"""A store's small files, on whatever file system its root names."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, *parts) -> str:
        return "/".join((self.root, *map(str, parts)))

    def _at(self, *parts):
        where = self.jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        return where.getFileSystem(self.conf), where

    def children(self, *parts) -> dict[str, int]:
        """The names in a folder, each with its time of change in milliseconds."""
        fs, where = self._at(*parts)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)} if fs.exists(where) else {}

    def read(self, *parts) -> str:
        fs, where = self._at(*parts)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts) -> bool:
        """A file that is there whole or not at all; False, and nothing done, if there is one already.

        It is written aside and then given its name by a step that the file system refuses for a name in use.
        """
        (fs, aside), where = self._at(f".{uuid.uuid4().hex}"), self._at(*parts)[1]
        fs.mkdirs(where.getParent())
        out = fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), where.toUri().getPath())
            else:
                options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(aside, where, options)
            return True
        except Exception:
            if fs.exists(where):
                return False
            raise
        finally:
            fs.delete(aside, False)

    def delete(self, *parts) -> None:
        fs, where = self._at(*parts)
        fs.delete(where, True)

    def used(self) -> int:
        fs, where = self._at()
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def free(self) -> int | None:
        return self._at()[0].getStatus().getRemaining()
