"""Files and folders of the warehouse, on a local or mounted path or in any store that Spark reads.

Commits need one thing of a store: that of two writers who create a name one fails.  Local paths do
that with a hard link and HDFS with a rename, which never overwrites; other stores are asked for a
conditional create, and refused if they have none.
"""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class LocalPlace:
    """A path that driver and executors see under one name."""

    def __init__(self, path: str | Path):
        self.path = Path(path).absolute()
        self.uri, self.name = f"file://{self.path}", self.path.name

    def __str__(self) -> str:
        return str(self.path)

    def __truediv__(self, name: str) -> LocalPlace:
        return LocalPlace(self.path / name)

    @property
    def parent(self) -> LocalPlace:
        return LocalPlace(self.path.parent)

    def exists(self) -> bool:
        return self.path.exists()

    def names(self) -> list[str]:
        """What the folder holds; nothing if there is none."""
        return [x.name for x in self.path.iterdir()] if self.path.is_dir() else []

    def files(self, suffix: str) -> list[str]:
        """Files at any depth, as readers are to name them."""
        return [str(x) for x in self.path.rglob(f"*{suffix}")]

    def make_folder(self) -> None:
        self.path.mkdir(parents=True, exist_ok=True)

    def read(self) -> str:
        return self.path.read_text()

    def create(self, text: str) -> None:
        """A new file, whole; FileExistsError if the name is taken."""
        draft = self.path.with_name(f".{self.name}.{uuid.uuid4().hex}")
        draft.write_text(text)
        try:
            os.link(draft, self.path)
        finally:
            draft.unlink()

    def replace(self, text: str) -> None:
        draft = self.path.with_name(f".{self.name}.{uuid.uuid4().hex}")
        draft.write_text(text)
        os.replace(draft, self.path)

    def remove(self) -> None:
        """The file or the folder; nothing happens if there is none."""
        if self.path.is_dir():
            shutil.rmtree(self.path, ignore_errors=True)
        else:
            self.path.unlink(missing_ok=True)


class StorePlace:
    """A name in a store that Spark's own file systems open; the driver's JVM does the work."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.name = self.uri.rsplit("/", 1)[1]
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __str__(self) -> str:
        return self.uri

    def __truediv__(self, name: str) -> StorePlace:
        return StorePlace(self.spark, f"{self.uri}/{name}")

    @property
    def parent(self) -> StorePlace:
        return StorePlace(self.spark, self.uri.rsplit("/", 1)[0])

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path)] if self.exists() else []

    def files(self, suffix: str) -> list[str]:
        found, out = self._fs.listFiles(self._path, True), []
        while found.hasNext():
            if (path := found.next().getPath().toString()).endswith(suffix):
                out.append(path)
        return out

    def make_folder(self) -> None:
        self._fs.mkdirs(self._path)

    def read(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, text: str) -> None:
        if self._fs.getScheme() == "hdfs":
            draft = self.parent / f".{self.name}.{uuid.uuid4().hex}"
            self._write(self._fs.create(draft._path, False), text)
            try:
                if not self._fs.rename(draft._path, self._path):
                    raise FileExistsError(self.uri)
            except (Py4JJavaError, PySparkException) as e:
                raise FileExistsError(self.uri) if self.exists() else e from None
            finally:
                draft.remove()
            return
        try:
            stream = self._fs.createFile(self._path).overwrite(False).must("fs.option.create.conditional.overwrite", "true").build()
        except (Py4JJavaError, PySparkException) as e:
            if "mandatory" in str(e) or "Unsupported" in str(e):
                raise NotImplementedError(f"nothing can be committed atomically to {self.uri}") from None
            raise
        try:
            self._write(stream, text)
        except (Py4JJavaError, PySparkException) as e:
            raise FileExistsError(self.uri) if self.exists() else e from None

    def replace(self, text: str) -> None:
        self._write(self._fs.create(self._path, True), text)

    def remove(self) -> None:
        self._fs.delete(self._path, True)


Place = LocalPlace | StorePlace


def place_of(spark: SparkSession, uri: str) -> Place:
    """The place of a path or URI; one that another scheme maps to a local folder is that folder."""
    if "://" not in uri and not uri.startswith("file:"):
        return LocalPlace(uri)
    if uri.startswith("file:"):
        return LocalPlace("/" + uri.removeprefix("file:").lstrip("/"))
    place, missing = StorePlace(spark, uri), []
    while not place.exists() and place.uri.count("/") > 3:
        missing.append(place.name)
        place = place.parent
    try:
        resolved = place._fs.resolvePath(place._path).toString()
    except (Py4JJavaError, PySparkException):  # a store without mounts
        return StorePlace(spark, uri)
    if resolved.startswith("file:"):
        return LocalPlace(Path("/" + resolved.removeprefix("file:").lstrip("/")).joinpath(*reversed(missing)))
    return StorePlace(spark, uri)


def footer(path: str) -> tuple[pq.FileMetaData, int]:
    """A Parquet file's footer, and its bytes; ``path`` as ``files`` gives it, on any executor."""
    if "://" not in path:
        return pq.read_metadata(path), os.path.getsize(path)
    fs, inside = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inside) as f:
        return pq.read_metadata(f), f.size()
