"""Operator 9: sharding by size-tiered compaction.  DataFrame functions only.

Method: arrivals are appended as small immutable Parquet shards; shards of similar
size (one tier: sizes within a factor ``fanout``) are merged in runs into files of
the target size; a manifest of the live shards is written aside, and committed by one
small file that names it, made under the next version without overwriting.  Making that
file is one atomic act (a hard link on a local file system, a rename that refuses an
existing target on others, as HDFS has it), so of two writers of a version one fails.

A merge reads its shards and writes one file in one task, without a shuffle; merges
of a wave run side by side in one job.  Readers see the shards of one manifest, so a
lost executor or a failed merge leaves the last version whole.  ``vacuum`` removes what
no kept version names.  The driver handles names of shards (about 100 bytes each), never rows.

Defined results: all rows and columns as they came, nulls, repeats and empty texts
included, in no order; texts of any length; an empty table has a manifest without rows
and gives an empty table; columns of any name that Parquet takes pass through.
"""

from __future__ import annotations

import functools
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm import common as C

MANIFEST = "path string, rows long, bytes long, tier int"
#: Merges of one job; a wave's plan and listing stay small however many shards there are.
WAVE = 64


class ShardStore:
    """A folder of immutable shards and versioned manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, x: str):
        return self._jvm.org.apache.hadoop.fs.Path(x)

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        folder = self._path(f"{self.root}/versions")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max([int(n[1:]) for n in names if n[0] == "v"], default=0)

    def _version_file(self, version: int) -> str:
        return f"{self.root}/versions/v{version:012d}"

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, rows, bytes, tier) of the shards of a version."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._named(v)}")

    def _named(self, version: int) -> str:
        """The folder of a version's manifest."""
        stream = self.fs.open(self._path(self._version_file(version)))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def commit(self, shards: DataFrame, base: int) -> int:
        """Publish ``shards`` as version ``base`` + 1; fails if that version exists."""
        name = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        self._claim(base + 1, name)
        return base + 1

    def _claim(self, version: int, name: str) -> None:
        """Make the version's file, with its whole content, unless there is one."""
        made, target = self._path(f"{self.root}/pending/{name}"), self._path(self._version_file(version))
        stream = self.fs.create(made, False)
        stream.writeUTF(name)
        stream.close()
        self.fs.mkdirs(target.getParent())
        try:
            if self.fs.getUri().getScheme() == "file":
                local = [self._jvm.java.io.File(self.fs.makeQualified(x).toUri().getPath()).toPath() for x in (target, made)]
                self._jvm.java.nio.file.Files.createLink(*local)
                self.fs.delete(made, False)
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf).rename(made, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            self.fs.delete(made, False)
            raise RuntimeError(f"version {version} was committed by another writer") from None

    def vacuum(self, keep: int = 1) -> int:
        """Remove the shards that none of the last ``keep`` versions names; how many files went."""
        newest = self.version()
        kept = [self.manifest(v).select("path") for v in range(max(1, newest - keep + 1), newest + 1)]
        live = {r["path"].rsplit("/", 2)[-2] + "/" + r["path"].rsplit("/", 1)[-1] for r in functools.reduce(DataFrame.union, kept).distinct().toLocalIterator()} if kept else set()
        gone, shards = 0, self._path(f"{self.root}/shards")
        for folder in self.fs.listStatus(shards) if self.fs.exists(shards) else ():
            for f in self.fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.endswith(".parquet") and f"{folder.getPath().getName()}/{name}" not in live:
                    gone += self.fs.delete(f.getPath(), False)
        return gone

    def described(self, folder: str, schema, smallest: int, fanout: int) -> DataFrame:
        """Rows and bytes of the files of a folder; tier k holds sizes up to smallest * fanout**k."""
        files = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        tier = F.greatest(F.lit(0), F.ceil(F.log(F.col("bytes") / smallest) / F.log(F.lit(float(fanout))))).cast("int")
        return files.groupBy("path", "bytes").agg(F.count("*").alias("rows")).select("path", "rows", "bytes", tier.alias("tier"))

    def append(self, arrivals: DataFrame, shard_rows: int, smallest: int, fanout: int) -> int:
        """Write arrivals as new small shards and commit them beside the live ones."""
        base = self.version()
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", shard_rows).parquet(folder)
        return self.commit(self.manifest(base).unionByName(self.described(folder, arrivals.schema, smallest, fanout)), base)

    def plan(self, live: DataFrame, target: int) -> DataFrame:
        """(path, run): the runs of similar shards to merge, each of about ``target`` bytes."""
        small = live.where(F.col("bytes") < target)
        run = Window.partitionBy("tier").orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("bytes").over(run), F.lit(0))
        runs = small.withColumn("run", F.concat_ws("-", "tier", F.floor(before / target)))
        return runs.withColumn("n", F.count("*").over(Window.partitionBy("run"))).where("n > 1").select("path", "rows", "run")

    def compact(self, schema, target: int, smallest: int, fanout: int) -> int:
        """One round of merges, committed as one version; the version stays if there is nothing to merge."""
        base = self.version()
        live = self.manifest(base)
        runs = self.plan(live, target).groupBy("run").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        folders, wave = [], []

        def merge() -> None:
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            parts = [self.spark.read.schema(schema).parquet(*paths).coalesce(1) for paths in wave]
            functools.reduce(DataFrame.union, parts).write.parquet(folder)
            folders.append(folder)
            wave.clear()

        for r in runs.toLocalIterator():  # file names, a wave at a time
            wave.append(r["paths"])
            if len(wave) == WAVE:
                merge()
        if wave:
            merge()
        if not folders:
            return base
        new = functools.reduce(DataFrame.union, [self.described(f, schema, smallest, fanout) for f in folders])
        gone = self.plan(live, target).select("path")
        return self.commit(live.join(gone, "path", "left_anti").select("path", "rows", "bytes", "tier").unionByName(new), base)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [r["path"] for r in self.manifest(version).select("path").orderBy("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def shard(
    table: DataFrame, root: str | None = None, target: int = 128 << 20, shard_rows: int = 4096, smallest: int = 1 << 20, fanout: int = 4,
) -> tuple[ShardStore, int]:
    """Append ``table`` to a store as small shards and compact it until nothing is left to merge."""
    spark = table.sparkSession
    store = ShardStore(spark, root or f"{C.shared_dir(spark).rstrip('/')}/folioforge-{uuid.uuid4().hex}")
    version = store.append(table, shard_rows, smallest, fanout)
    while (newer := store.compact(table.schema, target, smallest, fanout)) != version:  # each round leaves fewer shards
        version = newer
    return store, version
