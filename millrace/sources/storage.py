"""Raw objects in buckets: folders under one root."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class ObjectStore:
    def __init__(self, root: str):
        self.root = Path(root)

    def _path(self, bucket: str, key: str = "") -> Path:
        base = (self.root / bucket).resolve()
        path = (base / key).resolve()
        if not bucket or base.parent != self.root.resolve() or not path.is_relative_to(base):
            raise ValueError(f"no key of a bucket: {bucket!r}, {key!r}")
        return path

    def ensure_bucket(self, bucket: str) -> bool:
        """True if it was made, False if it was there; other failures are raised."""
        path = self._path(bucket)
        if path.is_dir():
            return False
        path.mkdir(parents=True)
        return True

    def upload(self, path: str, bucket: str, key: str) -> None:
        """The object appears whole or not at all; an earlier one is replaced."""
        if not self._path(bucket).is_dir():
            raise FileNotFoundError(f"no bucket {bucket!r}")
        to = self._path(bucket, key)
        to.parent.mkdir(parents=True, exist_ok=True)
        draft = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
        shutil.copyfile(path, draft)
        os.replace(draft, to)

    def download(self, bucket: str, key: str, path: str) -> None:
        shutil.copyfile(self._path(bucket, key), path)

    def remove(self, bucket: str, key: str) -> None:
        self._path(bucket, key).unlink()

    def objects(self, spark: SparkSession, bucket: str, pattern: str = "*") -> DataFrame:
        """``path, modificationTime, length, content`` of many objects, read by the executors."""
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(str(self._path(bucket)))
