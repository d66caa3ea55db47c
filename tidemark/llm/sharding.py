"""Sharding (operator 4) by size-tiered compaction.

A store is a folder of immutable Parquet shards and of manifests, one file for each version, which list the shards that are live.
append() writes an arrival as small shards; compact() merges runs of shards of similar size (a tier spans a factor of FAN_IN) into
files of about the target size, once a tier has FAN_IN of them. Data files are written first; a version becomes visible in one step
that fails if its name is taken, so that readers see all of it or nothing and of two writers one commits: a hard link on a local file
system, elsewhere a rename without overwriting, which HDFS does in one step. A store whose rename is a copy (object stores) is not safe
for two writers at once.

Nothing is deleted by a merge, so that readers of the versions before go on. vacuum() deletes files that the newest versions do not
list and that are older than a grace time; a writer must commit within that time.

A merge reads each group of files in a task of its own and writes one file: rows are not shuffled. What the driver handles is the
manifest: a line for each shard.

Nulls and edge cases: rows are stored as they are, with any columns, nulls and repeats; arrivals may differ in columns (null where
one lacks them), but not in a column's type; an empty arrival commits a version without
new shards; a store without a version reads as nothing and raises FileNotFoundError; a lost race raises FileExistsError.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

TARGET_BYTES, SMALL_BYTES, FAN_IN, GROUPS_A_JOB, ARRIVALS, GRACE = 128 << 20, 1 << 20, 4, 64, 4, 86400.0


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = common.prepare(spark), root, target, fan_in
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.files = self._path(root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _listed(self, folder: str) -> list[tuple[str, int]]:
        if not self.files.exists(self._path(folder)):
            return []
        return sorted((s.getPath().toString(), s.getLen()) for s in self.files.listStatus(self._path(folder)))

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        names = [p.rpartition("/v")[2] for p, _ in self._listed(f"{self.root}/manifest") if p.endswith(".json")]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.files.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def _commit(self, shards: list[Shard], after: int) -> int:
        """Make the next version visible; it must still be the next one."""
        name, scratch = f"{self.root}/manifest/v{after + 1:08d}.json", f"{self.root}/scratch/{after + 1:08d}-{common.uuid.uuid4().hex}"
        body = json.dumps({"version": after + 1, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]})
        out = self.files.create(self._path(scratch), False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        self.files.mkdirs(self._path(f"{self.root}/manifest"))
        try:
            self._publish(scratch, name)
        except Exception as error:
            if self.files.exists(self._path(name)):
                raise FileExistsError(name) from error
            raise
        finally:
            self.files.delete(self._path(scratch), False)
        return after + 1

    def _publish(self, scratch: str, name: str) -> None:
        """Give scratch its name in one step, or fail if the name is taken."""
        if self.files.getScheme() == "file":
            one, two = (self.jvm.java.io.File(self._path(p).toUri().getPath()).toPath() for p in (name, scratch))
            self.jvm.java.nio.file.Files.createLink(one, two)
            return
        hadoop = self.jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        hadoop.FileContext.getFileContext(self._path(name).toUri(), self.conf).rename(self._path(scratch), self._path(name), options)

    def _write(self, rows: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{common.uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return [Shard(p, n) for p, n in self._listed(folder) if p.endswith(".parquet")]

    def append(self, rows: DataFrame) -> int:
        """Commit an arrival; each task of it writes one small shard."""
        version = self.version()
        return self._commit([*self.shards(version), *self._write(rows)], version)

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / SMALL_BYTES, self.fan_in) + 1)) if size > SMALL_BYTES else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: in each tier with fan_in shards or more, neighbours are put together up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: s.path):
            if s.bytes < self.target * 3 // 4:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        runs = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fan_in:
                continue
            run: list[Shard] = []
            for s in own:
                if run and sum(x.bytes for x in run) + s.bytes > self.target * 5 // 4:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> int:
        """Merge until no tier has a run; each round is a version."""
        while runs := self.plan(live := self.shards(version := self.version())):
            merged: list[Shard] = []
            for at in range(0, len(runs), GROUPS_A_JOB):
                parts = [self.spark.read.option("mergeSchema", "true").parquet(*[s.path for s in run]).coalesce(1) for run in runs[at : at + GROUPS_A_JOB]]
                rows = parts[0]
                for part in parts[1:]:
                    rows = rows.unionByName(part, allowMissingColumns=True)
                merged += self._write(rows)
            gone = {s.path for run in runs for s in run}
            before, after = (self.spark.read.parquet(*x).count() for x in (sorted(gone), [s.path for s in merged]))
            if before != after:
                raise RuntimeError(f"merging {before} rows wrote {after}")
            self._commit([*(s for s in live if s.path not in gone), *merged], version)
        return self.version()

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete data files, over grace seconds old, that none of the newest versions lists; how many. Older versions can then not be read."""
        newest, before = self.version(), time.time() - grace
        live = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.shards(v)}
        gone = 0
        for folder, _ in self._listed(f"{self.root}/data"):
            for path, _ in self._listed(folder):
                if path.endswith(".parquet") and path not in live and self.files.getFileStatus(self._path(path)).getModificationTime() < 1000 * before:
                    gone += self.files.delete(self._path(path), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.shards(version)
        if not shards:
            raise FileNotFoundError(self.root)
        return self.spark.read.option("mergeSchema", "true").parquet(*[s.path for s in shards])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_hash, shard, version: every document as stored after ARRIVALS appends and compaction."""
    docs = common.table(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    store = Store(spark, common.shared_dir(spark, "shards"))
    for k in range(ARRIVALS):
        if len(files) >= ARRIVALS:  # an arrival is a share of the files, so each is read once
            store.append(spark.read.schema(docs.schema).parquet(*files[k::ARRIVALS]))
        else:
            store.append(docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)), F.lit(0)) == k))
    version = store.compact()
    return store.read().select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)\.parquet$", 1).alias("shard"), F.lit(version).cast("long").alias("version"))
