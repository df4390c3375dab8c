"""Files under a path, and their first lines, through Hadoop's file systems.

Listing and reading a line are a few calls a file on the driver, many files at a time; nothing that is
read grows with the length of a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

#: Files that are listed or read at a time.
THREADS = 16
#: A header lies in the first bytes of its file, so many at most.
HEADER_BYTES = 1 << 20


@dataclass(frozen=True, order=True)
class DataFile:
    """A file as Spark names it in ``_metadata.file_path``, and what tells when it has changed."""

    path: str
    length: int
    modified: int  # milliseconds


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


class Files:
    """The file systems of a session. Every call to the JVM takes its time, so classes and file systems
    are looked up once."""

    def __init__(self, spark: SparkSession):
        jvm = spark._jvm
        hadoop = jvm.org.apache.hadoop
        self.path = hadoop.fs.Path
        self.uri = jvm.java.net.URI
        self.text = hadoop.io.Text
        self.reader = hadoop.util.LineReader
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.codecs = hadoop.io.compress.CompressionCodecFactory(self.conf)
        self.systems: dict[str, JavaObject] = {}

    def system(self, name: str, path: JavaObject) -> JavaObject:
        store = re.match("(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?", name).group()
        if store not in self.systems:
            self.systems[store] = path.getFileSystem(self.conf)
        return self.systems[store]

    def under(self, path: str) -> list[DataFile]:
        """The files that a file's name, a folder or a glob stands for, folders with all below."""
        pattern = self.path(path)
        system = self.system(path, pattern)
        statuses = system.globStatus(pattern)
        found, left = [], list(statuses) if statuses is not None else []
        if not left:
            raise ValueError(f"{path}: no such file or folder")
        while left:
            status = left.pop()
            where = status.getPath()
            if _hidden(where.getName()):
                continue
            if status.isDirectory():
                left += list(system.listStatus(where))
            else:
                found.append(self._described(status, where))
        return sorted(found)

    @staticmethod
    def _described(status: JavaObject, path: JavaObject) -> DataFile:
        # Spark leaves out an empty host.
        uri = path.toUri().toString().replace(":///", ":/", 1)
        return DataFile(uri, status.getLen(), status.getModificationTime())

    def state(self, uri: str) -> DataFile:
        """A file that Spark has named."""
        path = self.path(self.uri(uri))
        status = self.system(uri, path).getFileStatus(path)
        return self._described(status, status.getPath())

    def first_line(self, file: DataFile) -> str | None:
        """The first line that is not blank, from the beginning of the file alone."""
        path = self.path(self.uri(file.path))
        codec = self.codecs.getCodec(path)
        stream = self.system(file.path, path).open(path)
        try:
            reader = self.reader(codec.createInputStream(stream) if codec else stream, self.conf)
            line = self.text()
            left = HEADER_BYTES
            while left > 0:
                taken = reader.readLine(line, left, left)
                if not taken:
                    return None
                left -= taken
                if left > 0 and (text := line.toString()).strip(" "):
                    return text
            raise ValueError(f"{file.path}: no header in its first {HEADER_BYTES} bytes")
        finally:
            stream.close()


def _at_once(call, items: Iterable) -> dict:
    items = list(dict.fromkeys(items))
    with ThreadPoolExecutor(THREADS) as pool:
        return dict(zip(items, pool.map(call, items)))


def list_files(spark: SparkSession, paths: Iterable[str]) -> dict[str, list[DataFile]]:
    """The files under each path."""
    return _at_once(Files(spark).under, paths)


def first_lines(spark: SparkSession, files: Iterable[DataFile]) -> dict[str, str]:
    """By path the header line of every file that has one; blank files have none and hold nothing."""
    lines = _at_once(Files(spark).first_line, files)
    return {file.path: line for file, line in lines.items() if line is not None}


def file_states(spark: SparkSession, uris: Iterable[str]) -> list[DataFile]:
    """The present state of files that Spark has named."""
    return sorted(_at_once(Files(spark).state, uris).values())
