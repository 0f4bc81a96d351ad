"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

An arrival is written as many small shards, one for each writing task, and becomes visible when the
next manifest is committed.  Compaction looks at sizes alone: shards of like size make a tier, and
a tier with enough of them is merged, neighbours in size first, into files of about the target
size.  A merge task streams its shards into one file, without a shuffle.  Files are never changed:
a commit swaps names in a new manifest, which is created exclusively, so that of two writers one
sees the conflict and tries again on top of the other's version.  What no kept manifest names can
be vacuumed.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Shared, record_batch

#: Parameters: bytes of a finished shard, shards of a tier that start a merge, ratio of sizes in a tier.
TARGET, FAN, RATIO, ROW_GROUP = 64 << 20, 4, 4.0, 8 << 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    name: str
    rows: int
    bytes: int


@dataclass
class Manifest:
    version: int = 0
    schema: str | None = None
    shards: list[Shard] = field(default_factory=list)
    operation: str = "create"

    def dumps(self) -> bytes:
        return json.dumps(asdict(self), indent=0).encode()

    @classmethod
    def loads(cls, data: bytes) -> Manifest:
        x = json.loads(data)
        return cls(x["version"], x["schema"], [Shard(**s) for s in x["shards"]], x["operation"])


def tier(size: int, target: int = TARGET, ratio: float = RATIO) -> int:
    """0 for finished shards, 1 for those down to target / ratio, and so on."""
    k = 0
    while size < target * 0.75 and k < 64:
        target /= ratio
        k += 1
    return k


def plan_merges(shards: list[Shard], target: int = TARGET, fan: int = FAN, ratio: float = RATIO) -> list[list[Shard]]:
    """Groups of two shards or more to merge, each of about the target size at most.

    The smallest tiers come first: a tier with ``fan`` shards or more is merged, together with the
    smaller ones that didn't fill a tier of their own.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if k := tier(s.bytes, target, ratio):
            tiers.setdefault(k, []).append(s)
    groups, smaller = [], []
    for k in sorted(tiers, reverse=True):
        waiting = smaller + sorted(tiers[k], key=lambda s: (s.bytes, s.name))
        if len(tiers[k]) < fan and len(waiting) < fan:
            smaller = waiting
            continue
        smaller, group, size = [], [], 0
        for s in waiting:
            if group and size + s.bytes > 1.25 * target:
                groups.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        if len(group) >= min(fan, 2):
            groups.append(group)
        else:
            smaller = group
    return [g for g in groups if len(g) > 1]


class ShardStore:
    """A table as immutable shards in ``shared``, with manifests ``manifest-<version>.json``."""

    def __init__(self, spark: SparkSession, shared: Shared, target: int = TARGET, fan: int = FAN):
        self.spark, self.shared, self.target, self.fan = spark, shared, target, fan

    # -- manifests

    def versions(self) -> list[int]:
        return [int(n[9:-5]) for n in self.shared.names() if n.startswith("manifest-") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest.loads(self.shared.read(f"manifest-{version:08d}.json")) if version else Manifest()

    def commit(self, new: Manifest) -> Manifest:
        """Creates the manifest of ``new.version``; :class:`Conflict` if there is one.

        That takes a store that creates a name exclusively: a local or mounted path (a hard link), or
        HDFS (a rename, which doesn't overwrite).  Any other store is refused.
        """
        name = f"manifest-{new.version:08d}.json"
        fs, path = self.shared._fs(name)
        if fs.type_name not in ("local", "hdfs"):
            raise NotImplementedError(f"no manifest can be committed atomically to {self.shared.root}")
        draft = f"draft-{uuid.uuid4().hex}"
        self.shared.write(draft, [new.dumps()])
        try:
            if fs.type_name == "local":
                os.link(self.shared._fs(draft)[1], path)  # fails if the name is taken
            else:
                fs.move(self.shared._fs(draft)[1], path)
        except OSError:
            if self.shared.exists(name):
                raise Conflict(name) from None
            raise
        finally:
            self.shared.remove(draft)
        return new

    # -- arrivals

    def append(self, df: DataFrame, arrival: Column | None = None) -> list[Manifest]:
        """Writes the rows as small shards and commits them, one version for each value of ``arrival`` in order.

        Without ``arrival`` all rows arrive at once.  An arrival without rows commits nothing.
        """
        mark = "__arrival"
        while mark in df.columns:
            mark += "_"
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn(mark, F.lit(0) if arrival is None else arrival.cast("int")).write.partitionBy(mark).parquet(self.shared.uri(folder))
        written = self.spark.read.schema(T.StructType([T.StructField(mark, T.IntegerType())])).parquet(self.shared.uri(folder))
        found = written.groupBy(mark, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).count().collect()
        out = []
        for a in sorted({r[0] for r in found}, key=lambda x: (x is None, x)):
            shards = [Shard(f"{folder}/{r.path.split(folder + '/', 1)[1]}", r["count"], r.bytes) for r in found if r[0] == a]
            out.append(self._swap([], sorted(shards, key=lambda s: s.name), "append", df.schema))
        return out

    def _swap(self, old: list[Shard], new: list[Shard], operation: str, schema: T.StructType | None = None) -> Manifest:
        while True:
            now = self.manifest()
            gone = {s.name for s in old}
            if not gone <= {s.name for s in now.shards}:
                raise Conflict("the merged shards are no longer in the table")
            kept = [s for s in now.shards if s.name not in gone]
            text = schema.json() if schema is not None else now.schema
            if schema is not None and now.schema and T.StructType.fromJson(json.loads(now.schema)).simpleString() != schema.simpleString():
                raise ValueError(f"the table has another schema: {T.StructType.fromJson(json.loads(now.schema)).simpleString()}")
            try:
                return self.commit(Manifest(now.version + 1, text, kept + new, operation))
            except Conflict:
                continue  # an append or a merge of other shards came first

    # -- compaction

    def compact(self) -> Manifest:
        """Merges what :func:`plan_merges` says and commits it; the present manifest if there is nothing to do."""
        now = self.manifest()
        groups = plan_merges(now.shards, self.target, self.fan)
        if not groups:
            return now
        shared, folder = self.shared, f"data/merged-{now.version + 1:08d}-{uuid.uuid4().hex[:8]}"
        schema = pa.schema([("name", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield record_batch(schema, [name], *([x] for x in merge_files(shared, parts, name)))

        jobs = [(f"{folder}/part-{i:06d}.parquet", [s.name for s in g]) for i, g in enumerate(groups)]
        plan = self.spark.createDataFrame(jobs, "name string, parts array<string>").repartition(len(jobs))
        made = [Shard(r.name, r.rows, r.bytes) for r in plan.mapInArrow(run, "name string, rows long, bytes long").collect()]
        old = [s for g in groups for s in g]
        if sum(s.rows for s in made) != sum(s.rows for s in old):
            raise RuntimeError("a merge has lost rows")
        return self._swap(old, sorted(made, key=lambda s: s.name), "compact")

    def vacuum(self, keep: int = 1, grace: float = 86400.0) -> int:
        """Deletes manifests but the last ``keep``, and files that none of these names; how many files went.

        Files that no manifest has ever named belong to a writer that hasn't committed yet or never
        will: they go once they are ``grace`` seconds old.
        """
        versions = sorted(self.versions())
        drop, kept = versions[:-keep] if keep else versions, versions[-keep:] if keep else []
        named = {s.name for v in kept for s in self.manifest(v).shards}
        gone = {s.name for v in drop for s in self.manifest(v).shards} - named
        gone |= {name for name, age in self.shared.ages("data") if age > grace and name not in named and name.endswith((".parquet", ".draft"))}
        for name in gone:
            self.shared.remove(name)
        for v in drop:
            self.shared.remove(f"manifest-{v:08d}.json")
        return len(gone)

    # -- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one), read from exactly the shards that its manifest names."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("nothing has been appended")
        schema = T.StructType.fromJson(json.loads(m.schema))
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.shared.uri(s.name) for s in m.shards])


def merge_files(shared: Shared, names: list[str], to: str) -> tuple[int, int]:
    """Streams Parquet files into one, a row group at a time; its rows and bytes.  The file appears whole or not at all."""
    fs, path = shared._fs(to)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft, writer, rows = f"{path}.{uuid.uuid4().hex}.draft", None, 0
    held: list[pa.RecordBatch] = []

    def flush() -> None:
        if held:
            writer.write_table(pa.Table.from_batches(held))
            held.clear()

    with fs.open_output_stream(draft, compression=None) as out:
        for name in names:
            with fs.open_input_file(shared._fs(name)[1]) as f:
                parquet = pq.ParquetFile(f)
                if writer is None:
                    writer = pq.ParquetWriter(out, parquet.schema_arrow, compression="zstd")
                for batch in parquet.iter_batches(batch_size=1024):
                    held.append(batch)
                    rows += batch.num_rows
                    if sum(b.nbytes for b in held) >= ROW_GROUP:
                        flush()
        flush()
        writer.close()
    fs.move(draft, path)
    return rows, fs.get_file_info(path).size


def shard_arrivals(df: DataFrame, arrival: Column, shared: Shared | None = None, target: int = TARGET, fan: int = FAN) -> ShardStore:
    """Appends each arrival, merges after all of them are in until no tier is full, and vacuums.

    Rows are kept as they are: nulls, empty and long texts, repeated rows and any columns.  An empty
    table commits an empty version.
    """
    spark = df.sparkSession
    store = ShardStore(spark, shared or Shared.create(spark, "shards"), target, fan)
    if not store.append(df, arrival):
        store._swap([], [], "append", df.schema)
    while True:
        before = store.manifest().version
        if store.compact().version == before:
            break
        store.vacuum()
    return store
