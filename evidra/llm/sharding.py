"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder of immutable runs (folders of Parquet shards that one job wrote) and of manifests. append() adds
arrivals as small runs; compact() merges runs whose shards are of a similar size (a tier) into shards of about
target_bytes and splits those far above. Rows are written first; then a manifest of what the version adds and removes is
put in place under the next version's name, which exactly one writer can take: by a hard link on a local file system, by
the rename of a file elsewhere (of which HDFS says that it fails if the name is taken). A writer that loses tries the
version after it, if what it removes is still there. So a commit costs what it changes; every CHECKPOINT versions the live
runs are written out as a whole by Spark, and a reader takes the last of these and the manifests after it. Readers see
whole versions only. vacuum() deletes runs that no kept version has; runs that were never committed go only after a time,
as their writer may be about to.

Defined results: rows keep every column and value, nulls and repeated rows too; arrivals may have other columns than
before, and rows lack those of others as null; a column whose type differs from an earlier arrival's is an error, as the
arrival comes; an empty arrival commits a version and adds no row; a store without a run can't be read. No column name is
reserved. The order of rows is not kept.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions after which the live runs are written out as a whole.
CHECKPOINT = 32
ENTRY = "version int, added boolean, run string, bytes long, files int, schema string"


@dataclass(frozen=True)
class Run:
    """A folder of shards below the store, its size, and the digest of its schema."""

    run: str
    bytes: int
    files: int
    schema: str

    @property
    def shard_bytes(self) -> float:
        return self.bytes / max(self.files, 1)


class ShardStore:
    """A versioned table of shards at path (any file system that Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fan_in: int = 4, tier_ratio: int = 4):
        self.spark, self.target, self.fan_in, self.ratio = spark, target_bytes, fan_in, tier_ratio
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(self._path(path.rstrip("/"))).toString()

    # files

    def _at(self, *parts: str):
        return self._path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def _put(self, text: str, *parts: str) -> None:
        out = self._fs.create(self._at(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, new: str, name: str) -> bool:
        """Puts a file of manifests/ under another name there; whether the name was free."""
        source, goal = self._at("manifests", new), self._at("manifests", name)
        if source.toUri().getScheme() != "file":
            return self._fs.rename(source, goal)
        file = self.spark._jvm.java.io.File
        try:
            self.spark._jvm.java.nio.file.Files.createLink(file(goal.toUri().getPath()).toPath(), file(source.toUri().getPath()).toPath())
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            self._fs.delete(source, False)
        return True

    # versions

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max((int(n[1:9]) for n in self._names("manifests") if n.startswith("v")), default=0)

    def log(self, version: int | None = None) -> DataFrame:
        """The entries that make a version: of the last whole list before it and of the manifests since."""
        version = self.version() if version is None else version
        whole = [n for n in self._names("checkpoints") if int(n[1:9]) <= version and self._fs.exists(self._at("checkpoints", n, "_SUCCESS"))]
        since = int(whole[-1][1:9]) if whole else 0
        files = [f"{self.path}/manifests/v{v:08d}.json" for v in range(since + 1, version + 1)] + [f"{self.path}/checkpoints/{n}" for n in whole[-1:]]
        return self.spark.read.schema(ENTRY).json(files) if files else self.spark.range(0).selectExpr(*(f"cast(null AS {x.split()[1]}) {x.split()[0]}" for x in ENTRY.split(", ")))

    def live(self, version: int | None = None) -> DataFrame:
        """The runs of a version. A run is added once and removed once at most."""
        sign = F.sum(F.when(F.col("added"), 1).otherwise(-1))
        return self.log(version).groupBy("run").agg(F.max("bytes").alias("bytes"), F.max("files").alias("files"), F.max("schema").alias("schema"), F.max("version").alias("version"), sign.alias("n")).filter("n > 0").drop("n")

    def runs(self, version: int | None = None) -> list[Run]:
        """The runs of a version as metadata: one entry a run, however many files and rows it has."""
        return [Run(*r) for r in self.live(version).orderBy("run").select("run", "bytes", "files", "schema").toLocalIterator()]

    def _commit(self, added: list[Run], removed: list[Run]) -> int:
        while True:
            base = self.version()
            if removed and not {r.run for r in removed} <= {r.run for r in self.runs(base)}:
                for r in added:
                    self._fs.delete(self._at(r.run), True)
                raise RuntimeError("another writer has removed a run that was to be merged")
            entries = [{"version": base + 1, "added": k} | asdict(r) for k, runs in ((True, added), (False, removed)) for r in runs]
            new = f".new-{uuid.uuid4().hex}"
            self._put("".join(json.dumps(e) + "\n" for e in entries), "manifests", new)
            if self._publish(new, f"v{base + 1:08d}.json"):
                break
        if (base + 1) % CHECKPOINT == 0:
            self.live(base + 1).withColumn("added", F.lit(True)).coalesce(1).write.json(f"{self.path}/checkpoints/v{base + 1:08d}-{uuid.uuid4().hex}")
        return base + 1

    # schemas

    def _schema(self, digests: set[str]) -> StructType:
        """The columns of all these schemas; a column has one type."""
        kinds: dict = {}
        for digest in sorted(digests):
            for f in StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schemas/{digest}.json").first()[0])):
                if kinds.setdefault(f.name, f.dataType) != f.dataType:
                    raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()} and {f.dataType.simpleString()}")
        out = StructType()
        for name, kind in kinds.items():
            out.add(name, kind)
        return out

    def _new_schema(self, df: DataFrame) -> str:
        """The digest of df's schema, kept in the store; an error if it doesn't fit those before."""
        plain = StructType()
        for f in df.schema:
            plain.add(f.name, f.dataType)
        digest = hashlib.md5(plain.json().encode()).hexdigest()
        known = {n.removesuffix(".json") for n in self._names("schemas") if n.endswith(".json")}
        if digest not in known:
            ours = {f.name: f.dataType for f in plain}
            for f in self._schema(known):
                if ours.get(f.name, f.dataType) != f.dataType:
                    raise ValueError(f"column {f.name} is {f.dataType.simpleString()} in the store, not {ours[f.name].simpleString()}")
            self._put(plain.json(), "schemas", f".{digest}")
            self._fs.rename(self._at("schemas", f".{digest}"), self._at("schemas", f"{digest}.json"))
        return digest

    # rows

    def _write(self, df: DataFrame, schema: str, *by: str) -> list[Run]:
        """The runs that df is written to: one, or one for each value of by (ascending)."""
        folder = f"runs/{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/{folder}")
        # sizes and numbers of files are counted by Spark (the files' content isn't read); a row for each run comes back
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{folder}")
        below = F.regexp_replace(F.regexp_replace(F.substring_index("path", folder, -1), "/[^/]*$", ""), "^/", "")
        found = {r["run"]: r for r in files.groupBy(below.alias("run")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).toLocalIterator()}
        order = sorted(found, key=lambda n: (len(n), n))
        return [Run("/".join(filter(None, (folder, n))), found[n]["bytes"], found[n]["files"], schema) for n in order]

    def append(self, arrivals: DataFrame) -> int:
        """Commits arrivals as a new run, a shard for each task with rows."""
        return self._commit(self._write(arrivals, self._new_schema(arrivals)), [])

    def append_each(self, arrivals: DataFrame, key: Column) -> int:
        """Commits many arrivals, a version for each value of key (ascending); they are written in one pass."""
        schema, name = self._new_schema(arrivals), "arrival"
        while name.lower() in map(str.lower, arrivals.columns):
            name += "_"
        version = self.version()
        for run in self._write(arrivals.withColumn(name, key), schema, name):
            version = self._commit([run], [])
        return version

    def tier(self, shard_bytes: float) -> int:
        """Tier 0 holds shards near the target or above; each further tier is tier_ratio times smaller."""
        return max(0, math.floor(math.log(self.target / max(shard_bytes, 1), self.ratio) + 0.5))

    def _rows(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(self._schema({r.schema for r in runs})).parquet(*(f"{self.path}/{r.run}" for r in runs))

    def compact(self) -> int:
        """Merges every tier below the target that has at least fan_in runs, and splits runs whose shards are twice the
        target or more. A merge is one job without a shuffle; merged runs fall into a higher tier, and the work ends when
        no tier is full. Commits at most one version."""
        before = self.runs()
        now, made = list(before), []
        while True:
            tiers: dict[int, list[Run]] = {}
            for r in now:
                tiers.setdefault(self.tier(r.shard_bytes), []).append(r)
            work = [(group, False) for k, group in sorted(tiers.items()) if k > 0 and len(group) >= self.fan_in]
            work += [([r], True) for r in tiers.get(0, []) if r.shard_bytes >= 2 * self.target and r not in made]
            changed = False
            for group, split in work:
                size, files = sum(r.bytes for r in group), sum(r.files for r in group)
                goal = max(1, round(size / self.target))
                if not split and goal >= files:
                    continue
                rows = self._rows(group)
                run = self._write(rows.repartition(goal) if split else rows.coalesce(goal), self._new_schema(rows))
                gone, made, changed = set(group), [*made, *run], True
                now = [r for r in now if r not in gone] + run
            if not changed:
                break
        if not made:
            return self.version()
        kept, old = set(now), set(before)
        for r in made:
            if r not in kept:
                self._fs.delete(self._at(r.run), True)
        return self._commit([r for r in now if r not in old], [r for r in before if r not in kept])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest one)."""
        runs = self.runs(version)
        if not runs:
            raise ValueError("the version has no run")
        return self._rows(runs)

    def vacuum(self, keep: int = 1, orphan_seconds: float = 86_400) -> int:
        """Deletes the runs that none of the newest keep versions has. A run that no manifest names may be in the making:
        it goes if its folder is older than orphan_seconds. Manifests stay, so that no version's name is free again."""
        newest = self.version()
        oldest, log = max(1, newest - keep + 1), self.spark.read.schema(ENTRY).json(f"{self.path}/manifests")
        gone = 0
        for r in log.filter(~F.col("added") & (F.col("version") <= oldest)).select("run").distinct().toLocalIterator():
            gone += bool(self._fs.exists(self._at(r[0])) and self._fs.delete(self._at(r[0]), True))
        named = {r[0] for r in log.select(F.element_at(F.split("run", "/"), 2)).distinct().toLocalIterator()}
        for x in self._fs.listStatus(self._at("runs")) if self._fs.exists(self._at("runs")) else []:
            if x.getPath().getName() not in named and x.getModificationTime() / 1000 < time.time() - orphan_seconds:
                gone += bool(self._fs.delete(x.getPath(), True))
        return gone


def shard_documents(docs: DataFrame, path: str, arrivals: int = 8, target_bytes: int = 64 << 20) -> ShardStore:
    """All of docs as arrivals by id hash, appended and compacted; the store holds the newest version only."""
    store = ShardStore(docs.sparkSession, path, target_bytes)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int"))
    store.compact()
    store.vacuum()
    return store
