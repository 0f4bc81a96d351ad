"""What the training-data operators share: words, tables, shared files.

A *word* is a maximal run of characters other than ``\\x20`` and ``\\x09-\\x0D``.  In UTF-8 that
is what ``bytes.split()`` yields, so texts travel as bytes and are never decoded for splitting.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: What one step of a worker holds of text; a longer text makes a step of its own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(-1))


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``; the same for the same rows.

    Only rows with a hash below a bound leave their tasks, a few more than are wanted of all rows
    together: otherwise every task would send the driver as many as are wanted.
    """
    n = rows.count()
    share = F.shiftrightunsigned(F.xxhash64(key), 11) * 2.0**-53
    few = rows.where(share < min(1.0, (1.2 * most + 64) / max(n, 1)))
    return few.orderBy(share, key).limit(most)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two 64-bit values (unsigned, wraps around)."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ np.asarray(b, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8, nulls as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, so that a step's arrays stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def unused(names: Iterable[str], *stems: str) -> list[str]:
    """The stems, lengthened until none is among the names in any case."""
    taken, out = {n.lower() for n in names}, []
    for s in stems:
        while s.lower() in taken:
            s += "_"
        taken.add(s.lower())
        out.append(s)
    return out


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class Shared:
    """Files that the driver and all executors see: a folder made under ``spark.checkpoint.dir``.

    Only where all run in one process (a local master) a temporary folder may stand in for it.

    A local or mounted path is opened in place.  Any other store goes through pyarrow's file systems;
    it can't be mapped, so what would be mapped is read into memory there, file by file as it is
    asked for: mount the store for models that don't fit.  Files are written under another name and
    renamed, so a task that runs twice leaves one whole file.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, tag: str) -> Shared:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir isn't set, and a folder of this machine isn't seen by the others")
            root = tempfile.mkdtemp(prefix="millrace-")
        if "://" not in root:
            root = "file://" + os.path.abspath(root.removeprefix("file:"))
        out = cls(f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
        fs, path = out._fs("")
        fs.create_dir(path, recursive=True)
        return out

    def _fs(self, name: str) -> tuple[pafs.FileSystem, str]:
        uri = f"{self.root}/{name}" if name else self.root
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(uri)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, chunks: Iterable[bytes | memoryview]) -> int:
        fs, path = self._fs(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        n = 0
        with fs.open_output_stream(draft, compression=None) as f:
            for c in chunks:
                f.write(c)
                n += len(c) if isinstance(c, bytes) else c.nbytes
        fs.move(draft, path)
        return n

    def read(self, name: str) -> bytes:
        fs, path = self._fs(name)
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()

    def open(self, name: str):
        fs, path = self._fs(name)
        return fs.open_input_stream(path, compression=None)

    def exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.get_file_info(path).type == pafs.FileType.File

    def names(self, folder: str = "") -> list[str]:
        fs, path = self._fs(folder)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(x.base_name for x in found if x.is_file and not x.base_name.endswith(".draft"))

    def ages(self, folder: str = "") -> list[tuple[str, float]]:
        """All files under a folder, and the seconds since they were written."""
        fs, path = self._fs(folder)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        now, prefix = time.time(), self._fs("")[1].rstrip("/") + "/"
        return [(x.path.removeprefix(prefix), now - x.mtime.timestamp()) for x in found if x.is_file]

    def remove(self, name: str) -> None:
        fs, path = self._fs(name)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.Directory:
            fs.delete_dir(path)
        elif info.type == pafs.FileType.File:
            fs.delete_file(path)

    def map(self, name: str) -> np.ndarray:
        """The file's bytes, memory-mapped; from a store that can't be mapped, in memory."""
        fs, path = self._fs(name)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        return np.frombuffer(self.read(name), dtype=np.uint8)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Written and read again: cuts the lineage, and lost executors lose nothing of it.

        Shuffle files of the write are deleted with its end, not when the driver's garbage is collected.
        """
        conf, free = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(free, None)
        conf.set(free, "true")
        try:
            df.write.mode("overwrite").parquet(self.uri(name))
        finally:
            conf.set(free, before) if before is not None else conf.unset(free)
        return df.sparkSession.read.schema(df.schema).parquet(self.uri(name))
