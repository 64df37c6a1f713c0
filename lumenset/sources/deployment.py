"""A folder into which sets are deployed: tasks stage files, a manifest makes them visible at once.

    root/data/<stage>/<attempt>/<file>    what one attempt of one task wrote
    root/_manifests/<stage>/*.parquet     file, digest, size, path of all that is deployed
    root/_manifests/<version>.json        a commit: which of these tables counts from here on

A reader takes the newest commit's table, so it sees all of a deployment or nothing of it. Attempts that are killed or
repeated leave files that no table names; ``vacuum`` removes them. The folder may be in any store that both Spark and pyarrow reach.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, digest string, size long, path string"


class Conflict(RuntimeError):
    """Another deployment was committed meanwhile."""


class Deployment:
    """The deployments of one folder (a URI, or a path of the shared file system)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, (root if ":" in root.split("/")[0] else "file://" + root).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("_manifests").getFileSystem(conf)
        self._names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("_manifests").toUri(), conf)
        self._fs.mkdirs(self._path("_manifests"))

    # commits

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path("_manifests", f"{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, table: str | None, after: int) -> int:
        """Makes a table of files the newest one; ``after`` is the version that it was made from."""
        draft = self._path("_manifests", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps({"table": table, "after": after}).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._names.rename(draft, self._path("_manifests", f"{after + 1:010d}.json"), none)  # fails where there is one
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} is there already") from e
            raise
        return after + 1

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, digest, size, path of what is deployed, or was at a version."""
        version = self.version() if version is None else version
        table = self._read(version)["table"] if version else None
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/_manifests/{table}") if table else self.spark.createDataFrame([], SCHEMA)

    # writing

    def _staged(self, rows: DataFrame, stage: str) -> DataFrame:
        """Writes each row's content under its attempt, and says where."""
        root = self.root

        def run(batches) -> Iterator[pa.RecordBatch]:
            fs, base = pyarrow.fs.FileSystem.from_uri(root)
            folder = f"data/{stage}/{TaskContext.get().taskAttemptId()}"
            made = False
            for batch in batches:
                paths, sizes = [], []
                for name, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                    if not made:
                        fs.create_dir(f"{base}/{folder}", recursive=True)
                        made = True
                    whole = content.as_buffer()
                    with fs.open_output_stream(f"{base}/{folder}/{name}") as out:
                        out.write(whole)
                    paths.append(f"{folder}/{name}")
                    sizes.append(whole.size)
                yield pa.RecordBatch.from_arrays([batch["file"], batch["digest"], pa.array(sizes, pa.int64()), pa.array(paths, pa.string())], ["file", "digest", "size", "path"])

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.select("file", "digest", "content").repartition(n, "file").mapInArrow(run, SCHEMA)

    def _replace(self, wanted: DataFrame, scope: DataFrame | None) -> dict[str, int]:
        after, stage = self.version(), uuid.uuid4().hex
        old = self.manifest(after)
        own = wanted.filter(F.col("content").isNotNull()).select("file", "content", F.sha2("content", 256).alias("digest"))
        names = own.groupBy("file").agg(F.min("digest").alias("digest"))
        new = own.join(names, ["file", "digest"], "left_semi").join(old, ["file", "digest"], "left_anti").dropDuplicates(["file"])
        written = self._staged(new, stage)
        gone = old.join(names, "file", "left_anti")
        gone = gone if scope is None else gone.join(scope.select("file").distinct(), "file", "left_semi")
        kept = old.join(names.withColumnRenamed("digest", "now"), "file", "left").filter(F.col("now").isNull() | (F.col("now") == F.col("digest")))
        kept = kept.select("file", "digest", "size", "path").join(gone.select("file"), "file", "left_anti")
        written.unionByName(kept).write.parquet(f"{self.root}/_manifests/{stage}")
        done = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/_manifests/{stage}")
        count = done.agg(F.count_if(F.col("path").startswith(f"data/{stage}/")).alias("written"), F.count("*").alias("files")).first()
        removed = gone.count()
        return {"written": count.written, "removed": removed, "files": count.files, "version": self._commit(stage, after)}

    def deploy(self, wanted: DataFrame) -> dict[str, int]:
        """Makes the folder hold ``wanted`` (file, content) and nothing else; what is there with the same content isn't written again.

        Of rows with one name the one with the least digest counts; rows without content have no file. Returns written, removed, files, version.
        """
        return self._replace(wanted, None)

    def deploy_some(self, wanted: DataFrame, scope: DataFrame) -> dict[str, int]:
        """Makes the names in ``scope`` (file) hold ``wanted``; all other files stay: one medium's copies, for instance."""
        return self._replace(wanted.join(scope.select("file").distinct(), "file", "left_semi"), scope)

    def undeploy(self, scope: DataFrame | None = None) -> dict[str, int]:
        """Takes away the files that ``scope`` names, or all."""
        nothing = self.spark.createDataFrame([], "file string, content binary")
        return self._replace(nothing, scope)

    def undo(self) -> int:
        """Brings back what was deployed before the newest version, as a new version; no file is written."""
        at = self.version()
        if not at:
            raise ValueError("nothing was deployed")
        before = self._read(at)["after"]
        return self._commit(self._read(before)["table"] if before else None, at)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what none of the newest ``keep`` versions names, with what killed attempts left; returns how many files went.

        A deployment that isn't committed yet loses its files, so none may be under way.
        """
        live = self.versions()[-keep:]
        tables = {t for v in live if (t := self._read(v)["table"])}
        named = self.spark.createDataFrame([], "path string")
        for t in sorted(tables):
            named = named.union(self.spark.read.schema(SCHEMA).parquet(f"{self.root}/_manifests/{t}").select("path"))
        if not self._fs.exists(self._path("data")):
            return 0
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/data").select(F.regexp_extract("path", "/(data/[^/]+/[^/]+/[^/]+)$", 1).alias("path"))
        stray, root = found.join(named.distinct(), "path", "left_anti"), self.root

        def run(batches) -> Iterator[pa.RecordBatch]:
            fs, base = pyarrow.fs.FileSystem.from_uri(root)
            for batch in batches:
                for path in batch["path"].to_pylist():
                    fs.delete_file(f"{base}/{path}")
                yield batch

        gone = stray.mapInArrow(run, "path string").count()
        for v in self.versions()[:-keep]:
            if (t := self._read(v)["table"]) and t not in tables:
                self._fs.delete(self._path("_manifests", t), True)
        return gone

    # archives

    def zip(self, shards: int, name: str = "collection") -> DataFrame:
        """Packs what is deployed into ``shards`` flat archives, written by tasks: shard, path, files, size. Empty shards have no archive.

        Files are dealt by a hash of their names and streamed one by one; a repeated attempt writes another archive, and the returned
        (written) table names one of each.
        """
        stage, root = uuid.uuid4().hex, self.root

        def run(batches) -> Iterator[pa.RecordBatch]:
            fs, base = pyarrow.fs.FileSystem.from_uri(root)
            at, archive, out, row = None, None, None, None

            def closed():
                archive.close()
                size = out.tell()
                out.close()
                return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*row, size)], ["shard", "path", "files", "size"])

            for batch in batches:
                for shard, file, path in zip(*(batch[c].to_pylist() for c in ("shard", "file", "path")), strict=True):
                    if shard != at:
                        if archive:
                            yield closed()
                        folder = f"zip/{stage}/{TaskContext.get().taskAttemptId()}"
                        fs.create_dir(f"{base}/{folder}", recursive=True)
                        at, row = shard, [shard, f"{folder}/{name}-{shard:05d}.zip", 0]
                        out = fs.open_output_stream(f"{base}/{row[1]}")
                        archive = zipfile.ZipFile(out, "w")
                    with fs.open_input_stream(f"{base}/{path}") as source, archive.open(zipfile.ZipInfo(file), "w") as target:
                        while piece := source.read(1 << 20):
                            target.write(piece)
                    row[2] += 1
            if archive:
                yield closed()

        dealt = self.manifest().withColumn("shard", F.pmod(F.xxhash64("file"), F.lit(shards)).cast("long")).repartition(shards, "shard").sortWithinPartitions("shard", "file")
        dealt.mapInArrow(run, "shard long, path string, files long, size long").write.parquet(f"{self.root}/zip/{stage}/index")
        return self.spark.read.parquet(f"{self.root}/zip/{stage}/index")
