"""Where manifests are kept: what a catalog needs of a store, and two stores.

Rows are written and read by Spark under the same root, so the store must be one
that all executors share.
"""

from __future__ import annotations

import os
import shutil
from typing import Protocol
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Storage(Protocol):
    """A store by relative paths; root is the same place as Spark names it."""

    root: str

    def names(self, folder: str) -> list[str]:
        """The names in a folder; none if there is no such folder."""

    def read(self, path: str) -> str: ...

    def create(self, path: str, text: str) -> bool:
        """Writes a file as a whole or not at all; False if there is one of that name already."""

    def remove(self, path: str) -> None:
        """Deletes a file or folder, if there is one."""


class FolderStorage:
    """A folder that the driver mounts."""

    def __init__(self, folder: str):
        self.folder, self.root = folder, f"file://{folder}"

    def place(self, path: str) -> str:
        return os.path.join(self.folder, path)

    def names(self, folder: str) -> list[str]:
        place = self.place(folder)
        return os.listdir(place) if os.path.isdir(place) else []

    def read(self, path: str) -> str:
        with open(self.place(path)) as f:
            return f.read()

    def create(self, path: str, text: str) -> bool:
        place = self.place(path)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        own = f"{place}.{os.getpid()}.tmp"
        with open(own, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, place)  # fails if another process was faster
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(own)

    def remove(self, path: str) -> None:
        place = self.place(path)
        if os.path.isdir(place):
            shutil.rmtree(place, ignore_errors=True)
        elif os.path.exists(place):
            os.remove(place)


class HadoopStorage:
    """Any file system that Spark reaches by a URL, with an atomic rename that does not overwrite."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark._jvm
        self.fs = self.place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def place(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def names(self, folder: str) -> list[str]:
        place = self.place(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.place(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        place = self.place(path)
        own = place.suffix(f".{os.getpid()}.tmp")
        stream = self.fs.create(own, True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        made = not self.fs.exists(place) and self.fs.rename(own, place)
        if not made:
            self.fs.delete(own, False)
        return made

    def remove(self, path: str) -> None:
        self.fs.delete(self.place(path), True)


def storage_at(spark: SparkSession, root: str) -> Storage:
    """The store for a path or URL."""
    url = urlparse(root)
    usual = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if (url.scheme or urlparse(usual).scheme) == "file":
        return FolderStorage(url.path if url.scheme else os.path.abspath(root))
    return HadoopStorage(spark, root)
