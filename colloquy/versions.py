"""Tables in versions: files that never change, and a log whose entries are put in place as a whole.

A write goes to a folder of its own, under a name that nobody reads yet. The commit is one small file, the manifest of the next
version: which folders make up each part of each table, and facts kept beside them. It is written under another name and renamed to
its number, which fails if that number is taken; so of two writers from one version the second fails, and a writer that
dies before its commit leaves the version before as it was. Readers name the version that they read. Everything goes through
the Hadoop file system of the path, so any store that Spark reads will do that renames without overwriting.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Versions:
    """The tables at a path. A table is dealt to numbered buckets; a version holds folders for each bucket, oldest first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.Path(self.path).getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._jvm.Path("/".join((self.path, *names)))

    def version(self) -> int:
        """The latest version, 0 if there is none."""
        log = self._at("log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "facts": {}}
        stream = self._fs.open(self._at("log", f"{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write rows (bucket, ..) to a folder that no version holds yet: its name, and the buckets that it has."""
        name = uuid.uuid4().hex
        rows.write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at("data", name))]
        return name, sorted(int(n[7:]) for n in found if n.startswith("bucket=") and n[7:].isdigit())

    def commit(self, base: dict, tables: dict[str, dict], facts: dict) -> dict:
        """The version after ``base`` with these tables (name -> schema, parts: bucket -> folders) and facts."""
        new = {"version": base["version"] + 1, "tables": tables, "facts": facts}
        if self.version() != base["version"]:
            raise Conflict(f"{self.path} is at version {self.version()}, not {base['version']}")
        self._fs.mkdirs(self._at("log"))
        draft = self._at("log", f"draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        files = self._jvm.FileContext.getFileContext(draft.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, self._at("log", f"{new['version']:012d}.json"), never)
        except Exception as e:
            self._fs.delete(draft, False)
            if self.version() > base["version"]:
                raise Conflict(f"version {new['version']} of {self.path} is another writer's") from e
            raise
        return new

    def folders(self, manifest: dict, table: str, buckets: list[int] | None = None) -> list[str]:
        parts = manifest["tables"].get(table, {"parts": {}})["parts"]
        wanted = parts if buckets is None else [str(b) for b in buckets if str(b) in parts]
        return [f"{self.path}/data/{name}/bucket={b}" for b in wanted for name in parts[b]]

    def read(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets: only their folders are opened."""
        schema = StructType.fromJson(manifest["tables"][table]["schema"])
        found = self.folders(manifest, table, buckets)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)


def schema_of(rows: DataFrame) -> dict:
    """How a manifest names the columns of staged rows."""
    return StructType([f for f in rows.schema if f.name != "bucket"]).jsonValue()


def whole(rows: DataFrame, name: str, buckets: list[int]) -> dict:
    """A table that is one staged folder."""
    return {"schema": schema_of(rows), "parts": {str(b): [name] for b in buckets}}


def with_folder(table: dict, name: str, buckets: list[int], instead: bool) -> dict:
    """``table`` with a staged folder in these buckets: after what is there, or instead of it."""
    parts = dict(table["parts"])
    for b in map(str, buckets):
        parts[b] = [name] if instead else [*parts.get(b, []), name]
    return table | {"parts": parts}


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Keyed:
    """A table of one row for each key, in versions that stay readable. Writes take the version that they start from."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        """``keys``: what tells rows apart; ``buckets``: for a new table, as many as it takes for one of them to be rewritten lightly."""
        self.log, self.keys, self._buckets = Versions(spark, path), keys, buckets

    def version(self) -> int:
        return self.log.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self.log.read(self.log.manifest(version), "rows")

    def _swap(self, rows: DataFrame, base: int | None, replaced) -> int:
        """Rewrite the buckets that ``rows`` touch: ``replaced(old, new)`` gives their next rows."""
        start = self.log.manifest(base)
        n = start["facts"].get("buckets", self._buckets)
        new = rows.withColumn("bucket", bucket_of(start["facts"].get("keys", self.keys), n))
        if not start["version"]:
            next_ = replaced(new.limit(0), new)
            staged = self.log.stage(next_.repartition("bucket"))
            return self.log.commit(start, {"rows": whole(new, *staged)}, {"buckets": n, "keys": self.keys})["version"]
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # numbers, as many as there are buckets
        if not touched:
            return start["version"]
        old = self.log.read(start, "rows", touched).select(*rows.columns).withColumn("bucket", bucket_of(self.keys, n))
        name, written = self.log.stage(replaced(old, new).repartition("bucket"))
        table = with_folder(start["tables"]["rows"], name, written, instead=True)
        table["parts"] = {b: f for b, f in table["parts"].items() if int(b) not in touched or int(b) in written}  # a bucket may be empty now
        return self.log.commit(start, {"rows": table}, start["facts"])["version"]

    def upsert(self, rows: DataFrame, order: str | None = None, base: int | None = None) -> int:
        """``rows`` in the place of those with the same keys; with ``order`` the greatest stays, whichever came first."""

        def latest(old: DataFrame, new: DataFrame) -> DataFrame:
            if order is None:
                return old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new)
            rest = F.struct(*[c for c in new.columns if c not in (*self.keys, "bucket")])
            return old.unionByName(new).groupBy("bucket", *self.keys).agg(F.max_by(rest, order).alias("r")).select(*self.keys, "r.*", "bucket")

        return self._swap(rows, base, latest)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        """Without the rows of these keys."""
        like = self.read(base).limit(0)
        padded = keys.select(*[F.col(f.name).cast(f.dataType) if f.name in keys.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])
        return self._swap(padded, base, lambda old, new: old.join(new.select(*self.keys).distinct(), self.keys, "left_anti"))

    def replace(self, rows: DataFrame, by: list[str], base: int | None = None) -> int:
        """All rows of the values of ``by`` that ``rows`` have make way for ``rows``. The table's keys must be ``by``, so that
        those rows share a bucket; within it, rows needn't be told apart."""
        if by != self.keys:
            raise ValueError("rows are replaced by the table's keys")
        return self._swap(rows, base, lambda old, new: old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new))
